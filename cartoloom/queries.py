"""Stand-in queries: every relational operator over the star-schema tables, with the same in SQL.

The tables hold no map or encyclopedia data, so parts stand for nodes, orders with their lines for ways, and customers with
their orders for relations. Native formats are tested with fixtures. All queries run over whole tables; the only limits are
the operators that are limits.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoloom.checkpoint import shared_dir
from cartoloom.functions import codec, coord, geo, tags, text
from cartoloom.operators import aggregates, denormalise, sequence
from cartoloom.plans import extracts, maps, pages
from cartoloom.session import prepare
from cartoloom.sinks import lines, mapfiles
from cartoloom.sources import geojson_lines, osm_xml, wiki_xml

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Nodes, ways and relations of the stand-ins, for the SQL.
_WITH = """
WITH all_nodes AS (
  SELECT p_partkey AS id, (p_partkey % 1000) / 10::DOUBLE - 50 AS lat, p_size * 3::DOUBLE - 75 AS lon,
    CASE WHEN p_size % 10 = 0 THEN 2 WHEN p_size % 10 = 5 THEN 1 ELSE 0 END AS entrance,
    CASE WHEN p_size % 4 = 0 THEN 2 WHEN p_size % 4 = 1 THEN 1 ELSE 0 END AS wheelchair, p_brand, p_type, p_size
  FROM part),
nodes AS (SELECT * FROM all_nodes WHERE p_size > 2),
refs AS (
  SELECT l_orderkey AS way, l_partkey AS node, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS pos
  FROM lineitem),
whole AS (
  SELECT way FROM refs LEFT JOIN nodes ON node = id GROUP BY way HAVING bool_and(id IS NOT NULL)),
points AS (
  SELECT way, pos, lat, lon, entrance, wheelchair FROM refs JOIN whole USING (way) JOIN nodes ON node = id),
boxes AS (
  SELECT way AS id, max(lat) AS n, min(lat) AS s, max(lon) AS e, min(lon) AS w, count(*) AS points FROM points GROUP BY way),
members AS (
  SELECT o_custkey AS relation, o_orderkey AS way, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders),
fails AS (
  SELECT relation, min(pos) FILTER (b.id IS NULL) AS fail FROM members LEFT JOIN boxes b ON way = b.id GROUP BY relation),
kept AS (
  SELECT relation, pos, way, n, s, e, w FROM members JOIN fails USING (relation) JOIN boxes b ON way = b.id
  WHERE fail IS NULL OR pos < fail)
"""


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(prepare(spark), sf_dir)
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    door = F.when(size % 10 == 0, "Main").when(size % 10 == 5, "yes").otherwise("garage")
    chair = F.when(size % 4 == 0, "YES").when(size % 4 == 1, "limited").otherwise("no")
    found = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("addr:type"), F.col("p_type"), F.lit("size"), size.cast("string"), F.lit("entrance"), door, F.lit("wheelchair"), chair)
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), ((F.col("p_partkey") % 1000) / 10 - 50).alias("lat"), (size * 3.0 - 75).alias("lon"), found.alias("tags"), "p_size")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_nodes(spark, sf_dir).where("p_size > 2").drop("p_size")


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("items"))
    return rows.select("id", F.create_map(F.lit("kind"), F.lit("order")).alias("tags"), F.transform("items", lambda x: x["l_partkey"]).alias("node_ids"))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers; members are their orders, and the part of the customer's number as administrative centre."""
    customers = _table(spark, sf_dir, "customer")
    orders = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("orders"))
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "administrative").otherwise("other")
    member = lambda t, i, r: F.struct(F.lit(t).alias("type"), i.alias("id"), F.lit(r).alias("role"))
    listed = F.concat(F.array(member(0, F.col("c_custkey"), "admin_centre")), F.transform(F.coalesce("orders", F.array().cast("array<bigint>")), lambda o: member(1, o, "outer")))
    return customers.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("id"), F.create_map(F.lit("boundary"), kind).alias("tags"), listed.alias("members"))


@query(r"""SELECT doc_id, trim(regexp_replace(text, '[^\p{L}\p{N}]+', ' ', 'g')) AS tokens,
  CASE WHEN trim(regexp_replace(text, '[^\p{L}\p{N}]+', ' ', 'g')) = '' THEN 0
  ELSE len(string_split(trim(regexp_replace(text, '[^\p{L}\p{N}]+', ' ', 'g')), ' ')) END AS n_tokens FROM documents""")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.tokens(F.col("text")).alias("tokens"), F.size(text.token_list(F.col("text"))).cast("long").alias("n_tokens"))


@query(r"""SELECT doc_id::VARCHAR || chr(9) || trim(regexp_replace(text, '[^\p{L}\p{N}]+', ' ', 'g')) AS value
FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 100)""")
def token_rows_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id")
    return lines.token_rows(pages.tokenised(docs, 100))


@query("""SELECT p_partkey AS id FROM part
WHERE (p_brand = 'Brand#2' AND p_size::VARCHAR = '11') OR p_type = 'PROMO' OR (p_brand = 'Brand#4')""")
def tag_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = "brand~Brand#2+size~11,addr:type~PROMO,brand~Brand#4+entrance,nothing"
    return part_nodes(spark, sf_dir).where(tags.matches(F.col("tags"), wanted)).select("id")


@query("""SELECT p_partkey AS id, 'a' AS first_key, p_type AS first_value, (CASE WHEN p_size > 25 THEN 2 ELSE 1 END)::INT AS n FROM part""")
def tag_building(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal keys (the last wins), empty keys and values, white space."""
    pair = lambda k, v: F.struct(k.alias("_k"), v.alias("_v"))
    some = F.when(F.col("p_size") > 25, F.lit(" kept ")).otherwise(F.lit(""))
    pairs = F.array(pair(F.lit(" a "), F.lit("lost")), pair(F.lit(" a "), F.concat(F.lit("\t"), F.col("p_type"), F.lit(" "))), pair(F.lit(""), F.lit("x")), pair(F.lit("b"), some))
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), tags.trim(tags.from_pairs(pairs)).alias("tags"))
    entries = tags.to_lists(F.col("tags"))
    return rows.where(tags.has_tags(F.col("tags"))).select("id", entries[0]["key"].alias("first_key"), entries[0]["value"].alias("first_value"), F.size("tags").alias("n"))


@query("""SELECT p_partkey::VARCHAR AS id, p_size * 3::DOUBLE - 75 AS lon, p_name AS name, octet_length(encode(p_name)) > 10 AS long_name FROM part WHERE p_size % 7 <> 0""")
def geojson_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines made of parts, and read back; a seventh is broken."""
    made = lines.point_features(part_nodes(spark, sf_dir).join(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name"), "id").withColumn("cut", F.col("p_size") % 7 == 0), F.struct(F.col("p_name").alias("name"), F.when(F.col("cut"), F.lit("broken")).alias("mark")), F.col("id").cast("string"))
    broken = made.select(F.when(F.col("value").contains('"mark":"broken"'), F.substring("value", 1, 40)).otherwise(F.col("value")).alias("value"))
    features, _ = geojson_lines.parse_lines(broken)
    return features.select("id", "lon", "name", (F.octet_length("name") > 10).alias("long_name"))


@query("""SELECT 'not JSON' AS reason, count(*) AS n FROM part WHERE p_size % 7 = 0 HAVING count(*) > 0
UNION ALL SELECT 'the name is not a string', count(*) FROM part WHERE p_size % 7 = 1 HAVING count(*) > 0""")
def geojson_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part")
    value = F.when(F.col("p_size") % 7 == 0, "{broken").when(F.col("p_size") % 7 == 1, '{"type":"Feature","properties":{"name":5}}').otherwise('{"type":"Feature","properties":{"name":"x y"}}')
    return geojson_lines.parse_lines(rows.select(value.alias("value")))[1].groupBy("reason").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def id_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = aggregates.id_set(_table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'"), "l_orderkey")
    return aggregates.contains(_table(spark, sf_dir, "orders").select("o_orderkey"), ids, "o_orderkey")


@query("""SELECT o_orderkey AS id FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'""")
def either_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = aggregates.id_set(_table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'"), "o_orderkey")
    return aggregates.either(urgent, aggregates.id_set(_table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'"), "l_orderkey"))


@query("""SELECT 'orders' AS name, count(DISTINCT l_orderkey) AS n FROM lineitem UNION ALL SELECT 'parts', count(DISTINCT l_partkey) FROM lineitem""")
def set_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "lineitem")
    return aggregates.statistics(orders=aggregates.id_set(items, "l_orderkey"), parts=aggregates.id_set(items, "l_partkey"))


@query("""SELECT c_custkey AS id, 1::INT AS nodes, count(o_orderkey)::INT AS ways, 0::INT AS relations FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")
def member_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.member_counts(relations(spark, sf_dir))


@query("""SELECT DISTINCT o_custkey AS id FROM orders JOIN customer ON o_custkey = c_custkey""")
def relations_with_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations(spark, sf_dir).where(denormalise.has_way_member()).select("id")


@query("""SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)) UNION SELECT c_custkey FROM customer""")
def transitive_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return denormalise.needed_node_ids(relations(spark, sf_dir), ways(spark, sf_dir))


@query(_WITH + """SELECT id, points, n, s, e, w FROM boxes""")
def way_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-or-nothing ordered denormalisation, and bounding boxes."""
    found = denormalise.way_points(ways(spark, sf_dir), denormalise.located(nodes(spark, sf_dir)))
    return found.select("id", F.size("points").cast("long").alias("points"), geo.bounds(F.col("points")).alias("b")).select("id", "points", "b.*")


@query(_WITH + """SELECT way AS id, first(lat ORDER BY class, pos) AS lat, first(lon ORDER BY class, pos) AS lon FROM (
  SELECT *, CASE WHEN entrance = 2 THEN 0 WHEN wheelchair <> 0 THEN 1 ELSE 2 END AS class FROM points WHERE entrance > 0) GROUP BY way""")
def way_entrances(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = denormalise.way_points(ways(spark, sf_dir), denormalise.located(nodes(spark, sf_dir)))
    return found.select("id", geo.entrance(F.col("points")).alias("p")).where("p IS NOT NULL").select("id", "p.lat", "p.lon")


@query(_WITH + """, segments AS (
  SELECT way, pos, lat, lon, lead(lat) OVER o AS lat2, lead(lon) OVER o AS lon2,
    coalesce(sqrt((lead(lat) OVER o - lat) ** 2 + (lead(lon) OVER o - lon) ** 2), 0) AS d
  FROM points WINDOW o AS (PARTITION BY way ORDER BY pos)),
walked AS (SELECT *, sum(d) OVER (PARTITION BY way) / 2 AS half, sum(d) OVER (PARTITION BY way ORDER BY pos) - d AS travelled FROM segments),
hits AS (SELECT *, row_number() OVER (PARTITION BY way ORDER BY pos) AS k FROM walked WHERE d > 0 AND travelled + d > half + 1e-9),
means AS (SELECT way, avg(cos(radians(lat)) * cos(radians(lon))) AS x, avg(cos(radians(lat)) * sin(radians(lon))) AS y, avg(sin(radians(lat))) AS z FROM points GROUP BY way)
SELECT way AS id, round(coalesce(lat + (half - travelled) / d * (lat2 - lat), degrees(atan2(z, sqrt(x * x + y * y)))), 5) AS lat,
  round(coalesce(lon + (half - travelled) / d * (lon2 - lon), degrees(atan2(y, x))), 5) AS lon
FROM means LEFT JOIN (SELECT * FROM hits WHERE k = 1) USING (way)""")
def line_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = denormalise.way_points(ways(spark, sf_dir), denormalise.located(nodes(spark, sf_dir)))
    return found.select("id", geo.line_centroid(F.col("points")).alias("c")).select("id", F.round("c.lat", 5).alias("lat"), F.round("c.lon", 5).alias("lon"))


_RING = """, ring AS (
  SELECT way, pos, lat, lon,
    coalesce(lag(lat) OVER o, last_value(lat) OVER f) AS lat0, coalesce(lag(lon) OVER o, last_value(lon) OVER f) AS lon0,
    coalesce(lead(lat) OVER o, first_value(lat) OVER f) AS lat2, coalesce(lead(lon) OVER o, first_value(lon) OVER f) AS lon2
  FROM points WINDOW o AS (PARTITION BY way ORDER BY pos), f AS (PARTITION BY way ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
bent AS (
  SELECT way, pos, lat, lon, abs(
    degrees(atan2(sin(radians(lon - lon0)) * cos(radians(lat)), cos(radians(lat0)) * sin(radians(lat)) - sin(radians(lat0)) * cos(radians(lat)) * cos(radians(lon - lon0)))) -
    degrees(atan2(sin(radians(lon2 - lon0)) * cos(radians(lat2)), cos(radians(lat0)) * sin(radians(lat2)) - sin(radians(lat0)) * cos(radians(lat2)) * cos(radians(lon2 - lon0))))) > 1e-2 AS kept
  FROM ring)"""


@query(_WITH + _RING + """SELECT way AS id, count(*) FILTER (kept) AS kept FROM bent GROUP BY way""")
def simplified_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = denormalise.way_points(ways(spark, sf_dir), denormalise.located(nodes(spark, sf_dir)))
    return found.select("id", F.size(geo.simplified(F.col("points"))).cast("long").alias("kept"))


@query(_WITH + _RING + """, used AS (SELECT way, lat, lon, kept OR NOT bool_or(kept) OVER (PARTITION BY way) AS kept FROM bent),
means AS (SELECT way, avg(cos(radians(lat)) * cos(radians(lon))) AS x, avg(cos(radians(lat)) * sin(radians(lon))) AS y, avg(sin(radians(lat))) AS z FROM used WHERE kept GROUP BY way)
SELECT way AS id, round(degrees(atan2(z, sqrt(x * x + y * y))), 5) AS lat, round(degrees(atan2(y, x)), 5) AS lon FROM means""")
def polygon_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = denormalise.way_points(ways(spark, sf_dir), denormalise.located(nodes(spark, sf_dir)))
    return found.select("id", geo.polygon_centroid(F.col("points")).alias("c")).select("id", F.round("c.lat", 5).alias("lat"), F.round("c.lon", 5).alias("lon"))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = denormalise.way_points(ways(spark, sf_dir), denormalise.located(nodes(spark, sf_dir)))
    return denormalise.measured(found).select("id", "centroid", "bounds")


@query(_WITH + """SELECT relation AS relation_id, pos, way AS way_id FROM kept WHERE relation IN (SELECT c_custkey FROM customer)""")
def relation_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Member ways up to the first that can't be resolved."""
    found = denormalise.relation_ways(relations(spark, sf_dir), _boxes(spark, sf_dir))
    return found.select("relation_id", F.col("pos").cast("long").alias("pos"), "way_id")


@query(_WITH + """, sized AS (SELECT *, greatest(radians(e - w) * cos(radians((n + s) / 2)) * 6378137, 1e-6) * greatest(radians(n - s) * 6378137, 1e-6) AS area FROM kept)
SELECT relation AS id, n, s, e, w FROM (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY round(area, 3) DESC, pos) AS k FROM sized) WHERE k = 1 AND relation IN (SELECT c_custkey FROM customer)""")
def largest_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = denormalise.relation_ways(relations(spark, sf_dir), _boxes(spark, sf_dir))
    return denormalise.largest_way(kept).select("id", "bounds.*")


@query(_WITH + """SELECT c_custkey AS id, lat, lon, 'admin_centre' AS type FROM customer JOIN nodes ON c_custkey = id WHERE c_mktsegment = 'BUILDING'""")
def admin_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return denormalise.admin_centres(relations(spark, sf_dir), denormalise.located(nodes(spark, sf_dir))).select("id", "centre.*")


@query(_WITH + """SELECT c_custkey AS id, c_mktsegment = 'BUILDING' AND nodes.id IS NOT NULL AS by_centre, count(*) AS ways FROM customer JOIN kept ON c_custkey = relation LEFT JOIN nodes ON c_custkey = nodes.id GROUP BY ALL""")
def denormalised_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, w, n = relations(spark, sf_dir), ways(spark, sf_dir), nodes(spark, sf_dir)
    out = denormalise.denormalised_relations(r, w, n, "boundary")
    return out.select("id", F.coalesce(F.col("centroid.type") == "admin_centre", F.lit(False)).alias("by_centre"), "ways")


@query("""SELECT 'node' AS type, count(*) AS n FROM part WHERE p_size > 2 UNION ALL SELECT 'way', count(DISTINCT l_orderkey) FROM lineitem UNION ALL SELECT 'relation', count(*) FROM customer""")
def entity_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.entities(nodes(spark, sf_dir), ways(spark, sf_dir), relations(spark, sf_dir)).groupBy("type").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, p_name, (coalesce(sum(octet_length(encode(p_name)) + 1) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset",
  row_number() OVER (ORDER BY p_partkey) - 1 AS index FROM part""")
def running_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.running(_table(spark, sf_dir, "part").select("p_partkey", "p_name"), ["p_partkey"], text.byte_length(F.col("p_name")))


@query("""SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS index, 5 + (coalesce(sum(octet_length(encode(p_name)) + 1) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset",
  p_name AS name, ((p_partkey % 1000) / 10::DOUBLE - 50) * 60 AS y, (p_size * 3::DOUBLE - 75) * -60 AS x FROM part""")
def map_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = part_nodes(spark, sf_dir).select("id", "lat", "lon").join(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), "id")
    return mapfiles.named_columns(rows, ["id"])


@query("""WITH k AS (SELECT *, octet_length(encode(p_name)) > 9 AS named, sum((octet_length(encode(p_name)) > 9)::INT) OVER (ORDER BY p_partkey) AS c FROM part)
SELECT p_partkey AS id FROM k WHERE c <= 50""")
def named_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit that only some rows count for."""
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name")
    return sequence.first_n_where(rows, ["id"], 50, F.octet_length("p_name") > 9).select("id")


@query("""SELECT named, count(*) AS n FROM (SELECT octet_length(encode(p_name)) > 1 AS named FROM part) GROUP BY named""")
def named_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("name"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"))
    named, unnamed = maps.split(rows)
    return named.select(F.lit(True).alias("named")).union(unnamed.select(F.lit(False).alias("named"))).groupBy("named").agg(F.count("*").alias("n"))


@query("""WITH lines_ AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
  coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(l_quantity) OVER (PARTITION BY l_orderkey) / 2 AS half FROM lineitem)
SELECT l_orderkey, l_partkey, before, half FROM lines_ WHERE before <= half AND before + l_quantity > half""")
def midpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    found = sequence.midpoint(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], F.col("l_quantity"))
    return found.select("l_orderkey", "l_partkey", "before", "half")


@query("""SELECT o_custkey, o_orderkey, coalesce(lag(o_orderkey) OVER o, last_value(o_orderkey) OVER f) AS before, coalesce(lead(o_orderkey) OVER o, first_value(o_orderkey) OVER f) AS after FROM orders
WINDOW o AS (PARTITION BY o_custkey ORDER BY o_orderkey), f AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def circular_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.circular(_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], "o_orderkey")


@query("""SELECT event_id, value * 60 AS y, value * -60 AS x, coalesce(try_cast(event_type AS DOUBLE), 0) AS none, coalesce(try_cast(value::VARCHAR AS DOUBLE), 0) AS same,
  trunc(value)::INT AS whole, trunc((value - trunc(value)) * 1000000)::INT AS millionths FROM events""")
def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events")
    v = F.col("value")
    at = text.scaled(v, v)
    key = text.grid_key(v)
    return rows.select("event_id", at["y"].alias("y"), at["x"].alias("x"), text.number_or_zero(F.col("event_type")).alias("none"), text.number_or_zero(v.cast("string")).alias("same"), key["whole"].alias("whole"), key["millionths"].alias("millionths"))


@query("""SELECT event_id, printf('%.7f', value / 3) AS seven FROM events""")
def seven_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", text.seven_decimals(F.col("value") / 3).alias("seven"))


@query(_WITH + """SELECT id, entrance::INT AS entrance, wheelchair::INT AS wheelchair, ((entrance << 6) | (wheelchair << 4))::INT AS flags FROM all_nodes""")
def node_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("tags")
    rows = part_nodes(spark, sf_dir).select("id", codec.entrance_class(t).alias("entrance"), codec.wheelchair_class(t).alias("wheelchair"))
    made = rows.withColumn("flags", codec.flag_byte(F.col("entrance"), F.col("wheelchair")))
    again = codec.flags_of(F.col("flags"))
    return made.select("id", again["entrance"].alias("entrance"), again["wheelchair"].alias("wheelchair"), "flags")


def coordinate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    dms = F.concat(F.lit("x {{Coord|"), n.cast("string"), F.lit("| 30|"), (k % 60).cast("string"), F.when(k % 2 == 0, F.lit("|n|")).otherwise(F.lit("|S|")), (k % 180).cast("string"), F.lit("|W|display=title|type:city}} {{coord|1|2}}"))
    decimal = F.concat(F.lit("<!-- {{coord|9|9}} -->{{coord|"), n.cast("string"), F.lit(".25|-"), n.cast("string"), F.lit(".5|region:XX}}"))
    body = F.when((k % 5).isin(0, 3), dms).when(k % 5 == 1, decimal).when(k % 5 == 2, "<nowiki>{{coord|1|1}}</nowiki> none").otherwise("{{coord|north|N|7|E}}")
    return c.select(k.alias("id"), F.col("c_name").alias("title"), body.alias("text"))


@query("""SELECT c_custkey AS id,
  CASE WHEN c_custkey % 5 IN (0, 3) THEN round((c_nationkey + 30 / 60::DOUBLE + (c_custkey % 60) / 3600::DOUBLE) * CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE -1 END, 9) WHEN c_custkey % 5 = 1 THEN c_nationkey + 0.25 END AS lat,
  CASE WHEN c_custkey % 5 IN (0, 3) THEN (c_custkey % 180) * -1::DOUBLE WHEN c_custkey % 5 = 1 THEN -c_nationkey - 0.5 END AS lon, c_custkey % 5 = 4 AS bad FROM customer""")
def coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates made of customers: degrees, minutes and seconds; decimal; none, or in a comment only; malformed."""
    parsed = coordinate_pages(spark, sf_dir).select("id", coord.parse(F.col("text")).alias("at"))
    return parsed.select("id", F.round("at.lat", 9).alias("lat"), "at.lon", F.col("at.error").isNotNull().alias("bad"))


@query("""SELECT p_partkey::VARCHAR AS id, p_size * 3::DOUBLE - 75 AS lon, CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_retailprice END AS lat, p_brand AS brand, (CASE WHEN p_size > 25 THEN 2 ELSE 1 END)::INT AS n FROM part""")
def xml_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XML elements made of parts: missing and unreadable coordinates, duplicate keys, empty values."""
    p = _table(spark, sf_dir, "part")
    lat = F.when(F.col("p_size") % 3 == 0, F.lit("north")).otherwise(F.col("p_retailprice").cast("string"))
    tag = lambda k, v: F.concat(F.lit(f'<tag k="{k}" v="'), v, F.lit('"/>'))
    extra = F.when(F.col("p_size") > 25, tag("note", F.lit("x"))).otherwise(tag("note", F.lit("")))
    xml = F.concat(F.lit('<node id="'), F.col("p_partkey"), F.lit('" lat="'), lat, F.lit('" lon="'), (F.col("p_size") * 3.0 - 75).cast("string"), F.lit('">'), tag("brand", F.lit("lost")), tag("brand", F.col("p_brand")), extra, F.lit("</node>"))
    rows = osm_xml.parse_nodes(p.select(xml.alias("xml")))
    return rows.select("id", "lon", "lat", F.col("tags")["brand"].alias("brand"), F.size("tags").alias("n"))


@query("""SELECT doc_id AS id, source AS title, text FROM documents""")
def xml_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XML pages made of documents, and read back."""
    d = _table(spark, sf_dir, "documents")
    revision = F.concat(F.lit("<revision><id>1</id>"), wiki_xml.element("text", wiki_xml.escaped(F.col("text")), ' xml:space="preserve"'), F.lit("</revision>"))
    head = F.concat(wiki_xml.element("title", wiki_xml.escaped(F.col("source"))), F.lit("<ns>0</ns>"), wiki_xml.element("id", F.col("doc_id").cast("string")))
    xml = F.concat(F.lit("<page>"), head, revision, F.lit("</page>"))
    return wiki_xml.parse_pages(d.select(xml.alias("xml"))).select("id", "title", "text")


@query("""SELECT '[' || string_agg('{"key":' || r_regionkey || ',"name":"' || r_name || '"}', ',' ORDER BY r_regionkey) || ']' AS value FROM region""")
def strict_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "region").select("r_regionkey", F.to_json(F.struct(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))).alias("value"))
    return lines.strict_text(rows, ["r_regionkey"])


@query("""SELECT l_orderkey, l_returnflag AS first_flag FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem WHERE l_quantity > 10) WHERE k = 1""")
def first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").where("l_quantity > 10")
    return sequence.first_match(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], F.col("l_returnflag"), "first_flag")


def _json(path: str):
    return F.get_json_object("value", path)


def _read(made: DataFrame, column: str, *fields: str) -> DataFrame:
    """Fields of JSON texts beside the other columns; a text is parsed once for all of them, and made outside of the parser."""
    return made.select(*(c for c in made.columns if c != column), F.json_tuple(column, *fields).alias(*fields))


@query(_WITH + """SELECT lat, lon, p_brand AS brand, 'Feature' AS type FROM nodes""")
def node_feature_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lines.node_features(nodes(spark, sf_dir))
    return made.select(_json("$.geometry.coordinates[1]").cast("double").alias("lat"), _json("$.geometry.coordinates[0]").cast("double").alias("lon"), _json("$.properties.brand").alias("brand"), _json("$.type").alias("type"))


@query(_WITH + """SELECT id, lat, lon, p_type AS kind FROM nodes""")
def node_record_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lines.node_records(nodes(spark, sf_dir))
    return made.select(_json("$.id").cast("long").alias("id"), _json("$.lat").cast("double").alias("lat"), _json("$.lon").cast("double").alias("lon"), _json("$.tags['addr:type']").alias("kind"))


@query(_WITH + """SELECT id, printf('%.7f', n) AS n, printf('%.7f', s) AS s, printf('%.7f', e) AS e, printf('%.7f', w) AS w, points AS nodes FROM boxes""")
def way_record_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lines.way_records(denormalise.denormalised_ways(ways(spark, sf_dir), nodes(spark, sf_dir)), True)
    read = _read(_read(made, "value", "id", "bounds", "nodes"), "bounds", *"nsew")
    return read.select(F.col("id").cast("long").alias("id"), *"nsew", F.json_array_length("nodes").cast("long").alias("nodes"))


@query(_WITH + """, sized AS (SELECT *, greatest(radians(e - w) * cos(radians((n + s) / 2)) * 6378137, 1e-6) * greatest(radians(n - s) * 6378137, 1e-6) AS area FROM kept)
SELECT relation AS id, c_mktsegment = 'BUILDING' AS admin, printf('%.7f', n) AS n, printf('%.7f', w) AS w
FROM (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY round(area, 3) DESC, pos) AS k FROM sized) JOIN customer ON relation = c_custkey WHERE k = 1""")
def relation_record_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lines.relation_records(denormalise.denormalised_relations(relations(spark, sf_dir), ways(spark, sf_dir), nodes(spark, sf_dir)))
    return made.select(_json("$.id").cast("long").alias("id"), (_json("$.tags.boundary") == "administrative").alias("admin"), _json("$.bounds.n").alias("n"), _json("$.bounds.w").alias("w"))


@query(_WITH + """SELECT 'node' AS type, id FROM nodes WHERE p_size = 11 UNION ALL SELECT 'way', id FROM boxes
UNION ALL SELECT DISTINCT 'relation', relation FROM kept JOIN customer ON relation = c_custkey WHERE c_mktsegment = 'BUILDING'""")
def extract_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole tool: only nodes that a wanted way or relation needs are joined."""
    made = extracts.denormalised(nodes(spark, sf_dir), ways(spark, sf_dir), relations(spark, sf_dir), "boundary~administrative,kind~order,size~11")
    return _read(made, "value", "type", "id").select("type", F.col("id").cast("long").alias("id"))


@query("""SELECT c_name AS title,
  CASE WHEN c_custkey % 5 = 1 THEN c_nationkey + 0.25 ELSE round((c_nationkey + 30 / 60::DOUBLE + (c_custkey % 60) / 3600::DOUBLE) * CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE -1 END, 9) END AS lat,
  CASE WHEN c_custkey % 5 = 1 THEN -c_nationkey - 0.5 ELSE (c_custkey % 180) * -1::DOUBLE END AS lon FROM customer WHERE c_custkey % 5 IN (0, 1, 3)""")
def page_point_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pages.point_lines(pages.located(coordinate_pages(spark, sf_dir))[0])
    return made.select(_json("$.properties.name").alias("title"), F.round(_json("$.geometry.coordinates[1]").cast("double"), 9).alias("lat"), _json("$.geometry.coordinates[0]").cast("double").alias("lon"))


@query("""SELECT c_custkey AS id, c_name AS title, CASE WHEN c_custkey % 7 = 0 THEN 'no revision' ELSE 'bad coordinate: north|N|7|E' END AS reason
FROM customer WHERE c_custkey % 7 = 0 OR c_custkey % 5 = 4""")
def page_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that can't be placed; a seventh has no revision."""
    rows = coordinate_pages(spark, sf_dir).withColumn("text", F.when(F.col("id") % 7 != 0, F.col("text")))
    return pages.located(rows)[1]


@query(_WITH + """SELECT id, lon AS lat, lon, (CASE WHEN entrance > 0 THEN 13 ELSE 12 END)::INT AS bytes, entrance::INT AS entrance, (CASE WHEN entrance > 0 THEN wheelchair ELSE 0 END)::INT AS wheelchair FROM all_nodes""")
def point_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points as bytes and back; whole degrees keep all their bits."""
    rows = denormalise.located(part_nodes(spark, sf_dir))
    made = rows.select("id", codec.packed_point("lon", "lon", "entrance", "wheelchair").alias("data"))
    return made.select("id", F.octet_length("data").alias("bytes"), codec.unpacked_point("data").alias("p")).select("id", "bytes", "p.*")


@query(_WITH + """SELECT way AS id, string_agg(printf('%016X', node), '' ORDER BY pos) AS digits, true AS same FROM refs GROUP BY way""")
def id_list_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = ways(spark, sf_dir).withColumn("data", codec.packed_ids(F.col("node_ids")))
    return made.select("id", F.hex("data").alias("digits"), (codec.unpacked_ids(F.col("data")) == F.col("node_ids")).alias("same"))


@query("""SELECT 'both' AS kept, count(*) AS n FROM part UNION ALL SELECT 'points', count(*) FROM part WHERE octet_length(encode(p_name)) <= 1
UNION ALL SELECT 'tags', count(*) FROM part WHERE octet_length(encode(p_name)) > 1""")
def map_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("name"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"))
    counts = [a.union(b).agg(F.lit(k).alias("kept"), F.count("*").alias("n")) for k, (a, b) in {"both": maps.split(rows), "points": maps.split(rows, points=True), "tags": maps.split(rows, tags=True)}.items()]
    return counts[0].union(counts[1]).union(counts[2])


@query("""SELECT 'orders' AS name, count(DISTINCT l_orderkey) AS n FROM lineitem UNION ALL SELECT 'parts', count(DISTINCT l_partkey) FROM lineitem UNION ALL SELECT 'missing', 0""")
def saved_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id sets written and read again."""
    items, path = _table(spark, sf_dir, "lineitem"), f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    aggregates.save(path, orders=aggregates.id_set(items, "l_orderkey"), parts=aggregates.id_set(items, "l_partkey"))
    orders, parts, missing = aggregates.load(spark, path, "orders", "parts", "missing")
    return aggregates.statistics(orders=orders, parts=parts, missing=missing)
