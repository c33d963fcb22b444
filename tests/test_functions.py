"""Scalar functions and geometry: golden numbers and edge cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cartoloom.functions import codec, coord, geo, tags, text

POINTS = "array<struct<lat: double, lon: double, entrance: int, wheelchair: int>>"


def points(*rows):
    return [(float(r[0]), float(r[1]), r[2] if len(r) > 2 else 0, r[3] if len(r) > 3 else 0) for r in rows]


def centroid(spark, rows):
    df = spark.createDataFrame([(points(*rows),)], f"p {POINTS}")
    return df.select(geo.centroid(F.col("p")).alias("c"), geo.bounds(F.col("p")).alias("b")).first()


@pytest.mark.parametrize(
    ("rows", "at", "box"),
    [
        ([(1, 2, 1)], (1, 2), (1, 1, 2, 2)),
        ([(0, 0, 1), (1, 2, 2), (-1, -2, 1, 2)], (1, 2), (1, -1, 2, -2)),
        ([(0, 0, 1), (-1, -2, 1, 2)], (-1, -2), (0, -1, 0, -2)),
        ([(0, 0, 1)], (0, 0), (0, 0, 0, 0)),
        ([(1, 1), (-1, 1), (-1, -1), (1, -1), (1, 1)], (0, 0), (1, -1, 1, -1)),
        ([(1, 1), (0, 0), (-1, -1)], (0, 0), (1, -1, 1, -1)),
        ([(3, 4)], (3, 4), (3, 3, 4, 4)),
        ([(3, 4), (3, 4)], (3, 4), (3, 3, 4, 4)),
    ],
)
def test_centroid_and_bounds(spark, rows, at, box):
    got = centroid(spark, rows)
    assert (round(got.c.lat, 7), round(got.c.lon, 7)) == at
    assert (got.b.n, got.b.s, got.b.e, got.b.w) == box
    assert (got.c.type == "entrance") == any(len(r) > 2 for r in rows)


def test_centroid_of_a_building(spark):
    lat = [45.5424694, 45.5424261, 45.5432827, 45.5433259, 45.5430581, 45.5429060, 45.5424694]
    lon = [-122.9356798, -122.9361523, -122.9363111, -122.9358387, -122.9357890, -122.9357608, -122.9356798]
    got = centroid(spark, list(zip(lat, lon)))
    assert f"{got.c.lat:.7f} {got.c.lon:.7f}" == "45.5428760 -122.9359955"


def test_no_points(spark):
    got = centroid(spark, [])
    assert got.c is None and got.b is None


def test_entrance_and_wheelchair_classes(spark):
    rows = [({"entrance": "MAIN", "wheelchair": "Yes"},), ({"entrance": "staircase", "wheelchair": "no"},), ({"entrance": "garage", "wheelchair": "limited"},), ({},), (None,)]
    df = spark.createDataFrame(rows, "tags map<string,string>")
    got = [tuple(r) for r in df.select(codec.entrance_class(F.col("tags")), codec.wheelchair_class(F.col("tags"))).collect()]
    assert got == [(2, 2), (1, 0), (0, 1), (0, 0), (0, 0)]


def test_codec_round_trip(spark):
    assert len(codec.pack_point(-50.0, 77.0)) == 12
    body = codec.pack_point(-50.0, 77.0, 2, 2)
    assert len(body) == 13 and body[12] == 0xA0
    assert codec.unpack_point(body) == (-50.0, 77.0, 2, 2)
    ids = [0, 1, -5, 2**63 - 1]
    assert codec.unpack_ids(codec.pack_ids(ids)) == ids
    with pytest.raises(ValueError, match="multiple of 8"):
        codec.unpack_ids(b"123")
    df = spark.createDataFrame([(1.0, 2.0, 0, 2, [1, 2]), (1.0, 2.0, 1, 2, None)], "a double, b double, e int, w int, ids array<bigint>")
    got = df.select(codec.packed_point("a", "b", "e", "w").alias("p"), codec.packed_ids("ids").alias("i")).collect()
    assert [len(r.p) for r in got] == [12, 13] and got[1].i is None and codec.unpack_ids(got[0].i) == [1, 2]


def test_tag_conditions(spark):
    rows = [({"amenity": "school", "name": "a"},), ({"amenity": "cafe"},), ({"addr:street": "x"},), ({},), (None,)]
    df = spark.createDataFrame(rows, "tags map<string,string>")

    def hits(conditions):
        return [r[0] for r in df.select(tags.matches(F.col("tags"), conditions)).collect()]

    assert hits("amenity") == [True, True, False, False, False]
    assert hits("amenity+name") == [True, False, False, False, False]
    assert hits("amenity~cafe,addr:street") == [False, True, True, False, False]
    assert hits(None) == [True] * 5
    for bad in ("", " ", "a,,b", "a+"):
        with pytest.raises(ValueError, match="empty"):
            tags.parse_conditions(bad)


@pytest.mark.parametrize(
    ("body", "lat", "lon", "bad"),
    [
        ("none", None, None, False),
        (None, None, None, False),
        ("", None, None, False),
        ("{{coord|1.5|-2.5}}", 1.5, -2.5, False),
        ("{{ Coord | 10 | 30 | N | 20 | W }}", 10.5, -20, False),
        ("{{coord|10|30|36|S|20|0|0|E|type:city}}", -10.51, 20, False),
        ("<!-- {{coord|1|1}} -->{{coord|2|3}}{{coord|4|5}}", 2, 3, False),
        ("<nowiki>{{coord|1|1}}</nowiki>", None, None, False),
        ("{{coord|x|1}}", None, None, True),
        ("{{coord|91|1}}", None, None, True),
        ("{{coord}} {{coord|}}", None, None, True),
        ("{{coord|1|2|3|4|N|5|E}}", None, None, True),
    ],
)
def test_coordinates(spark, body, lat, lon, bad):
    got = spark.createDataFrame([(body,)], "t string").select(coord.parse(F.col("t")).alias("c")).first().c
    assert (got.lat, got.lon) == (pytest.approx(lat) if lat is not None else None, lon) and (got.error is not None) == bad


def test_texts_and_numbers(spark):
    df = spark.createDataFrame([("Ünï-code_x ½ 12",), ("",), ("--",), (None,)], "t string")
    got = df.select(text.tokens(F.col("t")).alias("a"), text.token_list(F.col("t")).alias("b")).collect()
    assert [r.a for r in got] == ["Ünï code x ½ 12", "", "", None]
    assert [r.b for r in got] == [["Ünï", "code", "x", "½", "12"], [], [], None]
    one = spark.createDataFrame([(1.00000005, "é")], "x double, s string")
    assert one.select(text.seven_decimals(F.col("x"))).first()[0] == "1.0000000"
    assert one.select(text.byte_length(F.col("s"))).first()[0] == 3
    assert bytes(one.select(text.nul_terminated(F.col("s"))).first()[0]) == "é\0".encode()


# a street and a block, in millionths of a degree: (lat, lon) less 40.7 and -73.9
STREET = [(19743, 101559), (21679, 99914), (24195, 97783), (24745, 97318), (25375, 96797), (27239, 95203), (28737, 93927), (30535, 92407), (31566, 91545), (31843, 91417), (34738, 90745), (37495, 90199), (39735, 89630), (41459, 89370), (42233, 89219), (43025, 89119), (45262, 88699), (49446, 87904), (52149, 87417), (54016, 86938), (54345, 86833), (55897, 86321), (56513, 86117), (57348, 85720), (57980, 85433), (60503, 83607), (65504, 79957), (66480, 79264)]
BLOCK = [(40760, 89605), (40762, 89615), (40763, 89619), (40864, 89855), (40867, 89859), (40874, 89866), (40882, 89870), (40891, 89872), (40899, 89870), (40907, 89865), (41288, 89584), (41294, 89575), (41298, 89564), (41300, 89559), (41300, 89547), (41299, 89535), (41297, 89529), (41293, 89519), (41290, 89514), (41283, 89507), (41265, 89501), (40776, 89570), (40770, 89575), (40765, 89581), (40761, 89590), (40760, 89595), (40760, 89605)]


def degrees(rows):
    return [((40_700_000 + a) / 1e6, -(73_900_000 + b) / 1e6) for a, b in rows]


def test_golden_street(spark):
    df = spark.createDataFrame([(points(*degrees(STREET)),)], f"p {POINTS}")
    got = df.select(geo.line_centroid(F.col("p")).alias("c")).first().c
    assert (got.lat, got.lon) == (pytest.approx(40.74239780132512, abs=1e-12), pytest.approx(-73.98919819175188, abs=1e-12))


def test_golden_block(spark):
    df = spark.createDataFrame([(points(*degrees(BLOCK)),)], f"p {POINTS}")
    got = df.select(geo.polygon_centroid(F.col("p")).alias("c")).first().c
    assert (got.lat, got.lon) == (pytest.approx(40.74101953854348, abs=1e-7), pytest.approx(-73.9896438848581, abs=1e-7))


def test_golden_bytes(spark):
    """Points and id lists as bytes, by the scalar functions and by the column ones."""
    rows = [(-50.0, 77.0, 0, 0, "c04900000000405340000000"), (-50.555555555, 77.777777777, 0, 0, "c049471c71c5405371c71c70"), (-50.0, 77.0, 2, 2, "c04900000000405340000000a0")]
    for lat, lon, e, w, want in rows:
        assert codec.pack_point(lat, lon, e, w).hex() == want
        a, b, *flags = codec.unpack_point(bytes.fromhex(want))
        assert (f"{a:.7f}", f"{b:.7f}", flags) == (f"{lat:.7f}", f"{lon:.7f}", [e, w])
    df = spark.createDataFrame(rows, "lat double, lon double, e int, w int, want string")
    made = df.select("want", codec.packed_point("lat", "lon", "e", "w").alias("data"))
    assert all(bytes(r.data).hex() == r.want for r in made.collect())
    assert [tuple(r.p)[2:] for r in made.select(codec.unpacked_point("data").alias("p")).collect()] == [(0, 0), (0, 0), (2, 2)]
    ids = [0, 100, 100_000, 100_000_000, 2**63 - 1, -1, -(2**63)]
    assert codec.unpack_ids(codec.pack_ids(ids)) == ids
    lists = spark.createDataFrame([(ids,), ([],), (None,)], "ids array<bigint>").select("ids", codec.packed_ids(F.col("ids")).alias("data"))
    for r in lists.select("ids", "data", codec.unpacked_ids(F.col("data")).alias("again")).collect():
        assert r.again == r.ids and (None if r.data is None else bytes(r.data)) == (None if r.ids is None else codec.pack_ids(r.ids))
    with pytest.raises(Exception, match="multiple of 8"):
        spark.sql("SELECT X'0011' AS data").select(codec.unpacked_ids(F.col("data"))).collect()


def test_seven_places_are_those_of_the_exact_value(spark):
    r = random.Random(3)
    values = [r.uniform(-180, 180) for _ in range(4000)] + [r.randint(-(10**9), 10**9) / 2**r.randint(0, 40) for _ in range(2000)]
    values += [(2 * k + 1) / 2**8 / 5**7 / 2 for k in range(500)] + [k / 1e7 + 5e-8 for k in range(-500, 500)] + [k / 128 for k in range(-300, 300)]
    values += [0.0, -0.0, -1e-9, 1e-9, 5e-8, 1.5e-7, 2.5e-7, 0.5**8, 123456789.123456789, -180.0, 8.9e8, float("nan"), None]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for v, got, near in rows.select("v", text.seven_decimals(F.col("v")), text.round_coordinate(F.col("v"))).collect():
        if v is None or v != v:
            assert got is None
        else:
            assert got == f"{v:.7f}" and near == float(f"{v:.7f}"), v
    assert "Python" not in rows.select(text.seven_decimals(F.col("v")))._jdf.queryExecution().executedPlan().toString()
