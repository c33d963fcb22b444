"""Sources: readers that give DataFrames of the schemas."""

from __future__ import annotations

from pyspark.sql import SparkSession


def register(spark: SparkSession) -> None:
    """Register the Python data sources by their names."""
    from cartoloom.sources.osm_pbf import PbfSource
    from cartoloom.sources.xml_records import XmlRecords

    for source in (PbfSource, XmlRecords):
        spark.dataSource.register(source)
