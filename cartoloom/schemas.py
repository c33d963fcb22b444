"""Schemas of the entities. Nothing is ever inferred: tag values stay strings and no pass is spent on inference."""

from __future__ import annotations

from pyspark.sql import types as T

TAGS = T.MapType(T.StringType(), T.StringType())
MEMBER = T.StructType([T.StructField("type", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("role", T.StringType())])
NODE = T.StructType([T.StructField("id", T.LongType()), T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()), T.StructField("tags", TAGS)])
WAY = T.StructType([T.StructField("id", T.LongType()), T.StructField("tags", TAGS), T.StructField("node_ids", T.ArrayType(T.LongType()))])
RELATION = T.StructType([T.StructField("id", T.LongType()), T.StructField("tags", TAGS), T.StructField("members", T.ArrayType(MEMBER))])
#: All kinds in one table, as a block of a binary extract has them.
ENTITY = T.StructType([T.StructField("kind", T.StringType()), *NODE.fields, WAY["node_ids"], RELATION["members"]])
#: One element of each XML dialect, for from_xml.
XML_NODE = "_id string, _lat string, _lon string, tag array<struct<_k: string, _v: string>>"
XML_PAGE = "title string, ns long, id long, revision array<struct<id: long, text: struct<_VALUE: string>>>"
NODE_TYPE, WAY_TYPE, RELATION_TYPE = 0, 1, 2
