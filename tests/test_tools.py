"""Sources, plans and sinks on hand-made inputs in the native formats."""

from __future__ import annotations

import bz2
import gzip
import io
import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from cartoloom import cli
from cartoloom.functions import tags
from cartoloom.operators import aggregates, denormalise
from cartoloom.plans import extracts, maps, pages
from cartoloom.sinks import lines
from cartoloom.sources import geojson_lines, osm_pbf, osm_xml, wiki_xml, xml_records
from cartoloom.streaming import stateless

OSM = """<?xml version="1.0"?>
<osm>
 <node id="1" lat="1.5" lon="2.5"><tag k="name" v="a &amp; b"/><tag k="name" v="last"/><tag k="x" v=""/></node>
 <node id="2" lat="north" lon="7"/>
 <node lat="3" lon="4">
  <tag k="k" v="v"/>
 </node>
 <way id="9"><nd ref="1"/><tag k="w" v="w"/></way>
 <node id="4" lat="5"
"""
WIKI = """<mediawiki>
 <page><title>A &amp; B</title><ns>0</ns><id>1</id><revision><id>5</id><text xml:space="preserve">Paris {{coord|48|51|N|2|21|E}}</text></revision></page>
 <page><title>No place</title><ns>0</ns><id>2</id><revision><id>6</id><text>über x_y</text></revision></page>
 <page><title>Bad</title><ns>0</ns><id>3</id><revision><id>7</id><text>{{coord|x|y}}</text></revision></page>
 <page><title>Bare</title><ns>0</ns><id>4</id></page>
</mediawiki>
"""


@pytest.mark.parametrize("split", [40, 1 << 20])
def test_xml_nodes(spark, tmp_path, split):
    (tmp_path / "a.osm").write_text(OSM)
    got = [tuple(r) for r in osm_xml.read_nodes(spark, str(tmp_path / "a.osm"), split_bytes=split).collect()]
    assert sorted(got, key=str) == sorted([("1", 1.5, 2.5, {"name": "last"}), ("2", 0.0, 7.0, {}), ("", 3.0, 4.0, {"k": "v"})], key=str)


def test_compressed_xml_and_cut_off(spark, tmp_path):
    (tmp_path / "a.bz2").write_bytes(bz2.compress(OSM.encode()))
    (tmp_path / "b.gz").write_bytes(gzip.compress(OSM.encode()))
    (tmp_path / "c").write_bytes(gzip.compress(OSM.encode()))
    for name, codec in (("a.bz2", "auto"), ("b.gz", "auto"), ("c", "gzip")):
        assert osm_xml.read_nodes(spark, str(tmp_path / name), codec).count() == 3


def test_pages(spark, tmp_path):
    (tmp_path / "w.xml").write_text(WIKI)
    points, errors = pages.page_point_lines(spark, str(tmp_path / "w.xml"))
    (line,) = [json.loads(r.value) for r in points.collect()]
    assert line["properties"]["name"] == "A & B" and line["geometry"]["coordinates"] == [pytest.approx(2.35), pytest.approx(48.85)]
    assert {r.id: r.reason for r in errors.collect()} == {3: "bad coordinate: x|y", 4: "no revision"}
    tokens = [r.value for r in pages.page_token_lines(spark, str(tmp_path / "w.xml"), limit=2).collect()]
    assert sorted(tokens) == ["1\tParis coord 48 51 N 2 21 E", "2\tüber x y"]


def test_multistream_pages(spark, tmp_path):
    rows = [f"<page><title>T{k}</title><id>{k}</id><revision><text>t {k}</text></revision></page>" for k in range(6)]
    streams = [bz2.compress(b"<mediawiki>")] + [bz2.compress("".join(rows[k : k + 2]).encode()) for k in (0, 2, 4)]
    offset, index = len(streams[0]), []
    for k, s in enumerate(streams[1:]):
        index += [f"{offset}:{i}:T{i}\n" for i in (2 * k, 2 * k + 1)]
        offset += len(s)
    (tmp_path / "d.bz2").write_bytes(b"".join(streams))
    (tmp_path / "i.txt").write_text("".join(index))
    got = wiki_xml.read_pages(spark, str(tmp_path / "d.bz2"), str(tmp_path / "i.txt"), split_bytes=1)
    assert sorted(tuple(r) for r in got.select("id", "text").collect()) == [(k, f"t {k}") for k in range(6)]


# an encoder of tiny extracts, for the tests alone


def _varint(n):
    n &= (1 << 64) - 1
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number, value):
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _zig(n):
    return n << 1 ^ n >> 63


def _packed(values):
    return b"".join(map(_varint, values))


def _deltas(values):
    return _packed(_zig(b - a) for a, b in zip([0, *values], values))


def _blob(kind, data):
    body = _field(2, len(data)) + _field(3, zlib.compress(data))
    head = _field(1, kind) + _field(3, len(body))
    return struct.pack(">I", len(head)) + head + body


def pbf(nodes, ways, relations):
    strings = [""]

    def s(text):
        if text not in strings:
            strings.append(text)
        return strings.index(text)

    dense = _field(1, _deltas([n[0] for n in nodes])) + _field(8, _deltas([round(n[1] * 1e7) for n in nodes])) + _field(9, _deltas([round(n[2] * 1e7) for n in nodes]))
    dense += _field(10, _packed(x for n in nodes for x in [*(y for k, v in n[3].items() for y in (s(k), s(v))), 0]))
    pairs = lambda t: _field(2, _packed(map(s, t))) + _field(3, _packed(map(s, t.values())))
    way = b"".join(_field(3, _field(1, i) + pairs(t) + _field(8, _deltas(refs))) for i, t, refs in ways)
    relation = b"".join(_field(4, _field(1, i) + pairs(t) + _field(8, _packed(s(m[2]) for m in ms)) + _field(9, _deltas([m[1] for m in ms])) + _field(10, _packed(m[0] for m in ms))) for i, t, ms in relations)
    table = b"".join(_field(1, x.encode()) for x in strings)
    blocks = [_field(1, table) + _field(2, g) for g in (_field(2, dense), way, relation)]
    return _blob(b"OSMHeader", _field(4, b"OsmSchema-V0.6") + _field(4, b"DenseNodes")) + b"".join(_blob(b"OSMData", b) for b in blocks)


NODES = [(1, 0.0, 0.0, {"amenity": "toilets"}), (2, 0.0, 1.0, {}), (3, 1.0, 1.0, {}), (4, 1.0, 0.0, {}), (5, 0.5, 0.5, {"place": "town", "amenity": "x"}), (-7, -10.1234567, 20.0, {})]
WAYS = [(10, {"building": "yes"}, [1, 2, 3, 4, 1]), (11, {"highway": " path "}, [1, 2]), (12, {}, [1, 99]), (13, {"building": "no"}, [1, 2, 1])]
RELATIONS = [
    (20, {"boundary": "administrative"}, [(0, 98, "admin_centre"), (0, 5, "admin_centre"), (0, 4, "admin_centre"), (1, 10, "outer")]),
    (21, {"type": "multipolygon"}, [(1, 11, "outer"), (1, 12, "outer"), (1, 10, "outer")]),
    (22, {"type": "multipolygon"}, [(1, 12, "outer"), (1, 10, "outer")]),
    (23, {"type": "site"}, [(0, 1, "")]),
    (24, {"type": "tie"}, [(1, 13, ""), (1, 11, "")]),
]


@pytest.fixture
def extract(tmp_path):
    (tmp_path / "x.pbf").write_bytes(pbf(NODES, WAYS, RELATIONS))
    return str(tmp_path / "x.pbf")


def test_binary_extract(spark, extract):
    nodes, ways, relations = osm_pbf.read_kinds(spark, extract, split_bytes=1)
    assert sorted(tuple(r) for r in nodes.select("id", F.round("lat", 7), "lon", "tags").collect()) == sorted(NODES)
    assert sorted((r.id, r.tags, r.node_ids) for r in ways.collect()) == sorted(WAYS, key=lambda w: w[0])
    assert sorted((r.id, r.tags, [tuple(m) for m in r.members]) for r in relations.collect()) == RELATIONS
    assert osm_pbf.read_entities(spark, extract).where("kind = 'way'").count() == len(WAYS)


def test_bad_extracts(spark, tmp_path):
    (tmp_path / "bad.pbf").write_bytes(b"\xff\xff\xff\xff....")
    with pytest.raises(Exception, match="no blob header"):
        osm_pbf.read_entities(spark, str(tmp_path / "bad.pbf")).count()


def test_denormalised_extract(spark, extract):
    rows = [json.loads(r.value) for r in extracts.extract_lines(spark, extract, None, way_nodes=True).collect()]
    by = {f"{r['type']}:{r['id']}": r for r in rows}
    assert {k for k in by if k[0] == "w"} == {"way:10", "way:11", "way:13"}
    assert by["way:10"]["centroid"]["lat"].startswith("0.5000") and by["way:10"]["bounds"] == {"n": "1.0000000", "s": "0.0000000", "e": "1.0000000", "w": "0.0000000"}
    assert len(by["way:10"]["nodes"]) == 5 and by["way:11"]["tags"] == {"highway": "path"}
    assert {k for k in by if k[0] == "r"} == {"relation:20", "relation:21", "relation:24"}
    assert by["relation:20"]["centroid"] == {"lat": "0.5000000", "lon": "0.5000000", "type": "admin_centre"}
    assert by["relation:21"]["bounds"]["n"] == "0.0000000"  # the third way comes after one that can't be resolved
    toilets = [json.loads(r.value) for r in extracts.extract_lines(spark, extract, "amenity~toilets", node_features=True).collect()]
    assert [t["properties"] for t in toilets] == [{"amenity": "toilets"}] and toilets[0]["geometry"]["coordinates"] == [0.0, 0.0]


def test_first_of_equal_ways(spark, extract):
    nodes, ways, relations = osm_pbf.read_kinds(spark, extract)
    boxes = denormalise.measured(denormalise.way_points(ways, denormalise.located(nodes))).select("id", "centroid", "bounds")
    kept = denormalise.relation_ways(relations.where("id = 24"), boxes)
    assert [r.way_id for r in kept.orderBy("pos").collect()] == [13, 11]
    best = denormalise.largest_way(kept).first()
    want = boxes.where("id = 13").first()
    assert (best.centroid, best.bounds) == (want.centroid, want.bounds)


GEO = [
    '{"type":"Feature","id":"1","geometry":{"type":"Point","coordinates":[2.0,1.0]},"properties":{"name":"Zoë"}}',
    '{"type":"Feature","id":"2","geometry":{"type":"Point","coordinates":[4.0,3.0]},"properties":{"name":"x"}}',
    '{"type":"Feature","id":"3","geometry":{"type":"Point","coordinates":[6.0,5.0]}}',
    "{oops",
    '{"type":"Feature","properties":{"name":5}}',
    "",
    '{"type":"Feature","id":"4","geometry":{"type":"Point","coordinates":[8.0,7.0]},"properties":{"name":"Bo"}}',
]


def test_map_files(spark, tmp_path):
    (tmp_path / "g.json").write_text("\n".join(GEO))
    errors = maps.write_map(spark, str(tmp_path / "g.json"), str(tmp_path / "out/m"))
    read = lambda n: (tmp_path / f"out/m.{n}").read_bytes()
    assert read("tag_text") == "FAIL\0Zoë\0Bo\0".encode()
    assert struct.unpack("<3q", read("tag_offset")) == (0, 5, 10) and read("pre_offset") == b"0\n5\n10\n"
    assert struct.unpack("<6d", read("tag_points")) == (-6000, -60000, 60, -120, 420, -480)
    assert struct.unpack("<3q", read("tag_index")) == (-1, 0, 1) and read("tag_category") == bytes(24)
    assert struct.unpack("<4d", read("map_points")) == (180, -240, 300, -360) and read("map_data") == bytes(48)
    assert sorted(r.reason for r in errors.collect()) == ["not JSON", "the name is not a string"]


def test_map_limit_and_empty_input(spark, tmp_path):
    (tmp_path / "g.json").write_text("\n".join(GEO))
    maps.write_map(spark, str(tmp_path / "g.json"), str(tmp_path / "one"), limit=1, tags=True)
    assert (tmp_path / "one.tag_text").read_bytes() == "FAIL\0Zoë\0".encode() and (tmp_path / "one.map_points").read_bytes() == b""
    (tmp_path / "e.json").write_text("")
    maps.write_map(spark, str(tmp_path / "e.json"), str(tmp_path / "none"))
    assert (tmp_path / "none.tag_text").read_bytes() == b"FAIL\0" and (tmp_path / "none.map_points").read_bytes() == b""


def test_single_files(spark, tmp_path):
    rows = spark.createDataFrame([('{"a":1}',), ('{"a":2}',)], "value string").coalesce(1)
    lines.write_single(rows, str(tmp_path / "a.json.gz"), strict=True)
    assert json.loads(gzip.open(tmp_path / "a.json.gz").read()) == [{"a": 1}, {"a": 2}]
    lines.write_lines(rows, str(tmp_path / "folder"), "gzip")
    assert spark.read.text(str(tmp_path / "folder")).count() == 2
    assert list(lines.records(rows)) == [{"a": 1}, {"a": 2}]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/w.xml").write_text(WIKI)
    rows = lines.token_rows(stateless.stream_page_tokens(spark, str(tmp_path / "in")))
    stateless.write_lines(rows, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert spark.read.text(str(tmp_path / "out")).count() == 4


def test_features_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/g.json").write_text("\n".join(GEO))
    features, _ = stateless.stream_features(spark, str(tmp_path / "in"))
    q = features.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "o")).count() == 4


def test_command_line(extract, tmp_path, capsys):
    assert cli.main(["extract", "--tags", "building~yes", extract, str(tmp_path / "o.json")]) == 0
    assert [json.loads(x)["id"] for x in (tmp_path / "o.json").read_text().splitlines()] == [10]
    (tmp_path / "a.osm").write_text(OSM)
    assert cli.main(["osm", "--strict", str(tmp_path / "a.osm")]) == 0
    assert len(json.loads(capsys.readouterr().out)) == 3


class Input:
    """Stands for standard input."""

    def __init__(self, data):
        self.buffer = io.BytesIO(data)


@pytest.mark.parametrize(
    ("arguments", "data", "want"),
    [
        (["osm"], OSM.encode(), 3),
        (["osm", "-"], b"", 0),
        (["osm", "--compression", "gzip", "-"], gzip.compress(OSM.encode()), 3),
        (["wiki-points", "-"], WIKI.encode(), 1),
        (["wiki-tokens", "--limit", "3", "-"], WIKI.encode(), 3),
        (["wiki-tokens", "-"], b"", 0),
        (["extract", "-"], None, 12),
    ],
)
def test_tools_read_standard_input(spark, monkeypatch, capsys, arguments, data, want):
    monkeypatch.setattr("sys.stdin", Input(pbf(NODES, WAYS, RELATIONS) if data is None else data))
    assert cli.main(arguments) == 0
    out = capsys.readouterr()
    assert len(out.out.splitlines()) == want and f"{want:,} records in" in out.err


def test_map_reads_standard_input_and_tools_make_a_pipe(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr("sys.stdin", Input(OSM.encode()))
    assert cli.main(["osm"]) == 0
    monkeypatch.setattr("sys.stdin", Input(capsys.readouterr().out.encode()))
    assert cli.main(["map", "--outFile", str(tmp_path / "m"), "--verbose"]) == 0
    assert (tmp_path / "m.tag_text").read_bytes() == b"FAIL\0last\0" and len((tmp_path / "m.map_points").read_bytes()) == 32
    monkeypatch.setattr("sys.stdin", Input(b"{oops\n"))
    assert cli.main(["map", "--outFile", str(tmp_path / "n"), "--verbose", "-"]) == 0
    assert "not JSON: {oops" in capsys.readouterr().err


def test_inputs_without_anything(spark, tmp_path):
    (tmp_path / "folder").mkdir()
    (tmp_path / "e.osm").write_bytes(b"")
    (tmp_path / "e.pbf").write_bytes(_blob(b"OSMHeader", _field(4, b"OsmSchema-V0.6")))
    assert osm_xml.read_nodes(spark, str(tmp_path / "e.osm")).count() == 0
    assert osm_xml.read_nodes(spark, str(tmp_path / "folder")).count() == 0
    assert osm_pbf.read_entities(spark, str(tmp_path / "e.pbf")).count() == 0
    assert extracts.extract_lines(spark, str(tmp_path / "e.pbf"), None).count() == 0


def test_uris_and_wildcards(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"a{k}.osm").write_text(OSM)
    (tmp_path / "a.pbf").write_bytes(pbf(NODES, WAYS, RELATIONS))
    assert osm_xml.read_nodes(spark, f"{tmp_path}/a*.osm").count() == 9
    assert osm_xml.read_nodes(spark, f"file://{tmp_path}/a1.osm", split_bytes=50).count() == 3
    assert osm_pbf.read_entities(spark, f"file://{tmp_path}/a.pbf").count() == len(NODES) + len(WAYS) + len(RELATIONS)
    assert osm_pbf.read_entities(spark, f"file://{tmp_path}").count() == len(NODES) + len(WAYS) + len(RELATIONS)


def test_elements_at_any_border():
    """Blocks and ranges of any size give each element once."""
    parts = [b'<node id="1"/>', b"x", b'<node id="2"><tag k="a" v="b"/></node>', b"<nodes/>", b"<node>" + b"y" * 300 + b"</node>", b"<way/>", b"<node />", b'<node id="9" lat']
    data, want = b"".join(parts), [p for p in parts[:-1] if p[:6] in (b"<node ", b"<node>")]
    for block in (1, 7, 64, 1 << 20):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(xml_records, "BLOCK", block)
            for split in (1, 13, 100, 1 << 20):
                found = [x for a in range(0, len(data), split) for x in xml_records.elements(io.BytesIO(data), "node", a, a + split)]
                assert found == want, (block, split)


def test_an_extract_is_decoded_once_and_in_the_jvm(spark, extract):
    plan = extracts.extract_lines(spark, extract, None)._jdf.queryExecution().executedPlan().toString()
    assert "osmpbf" not in plan.lower() and "Python" not in plan and "Pandas" not in plan


def test_finer_coordinates_are_rounded(spark):
    rows = spark.createDataFrame([(1, 0.12345674999, -0.12345675001, {})], "id long, lat double, lon double, tags map<string,string>")
    assert tuple(denormalise.located(rows, True).first())[1:3] == (0.1234567, -0.1234568)


def test_streams_of_nodes_and_page_points(spark, tmp_path):
    for name, text in (("osm", OSM.rsplit(" <node", 1)[0] + "</osm>"), ("wiki", WIKI)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.xml").write_text(text)
    points, errors = stateless.stream_page_points(spark, str(tmp_path / "wiki"))
    rows = {"nodes": stateless.stream_node_lines(spark, str(tmp_path / "osm")), "points": points, "errors": errors.select(F.col("reason").alias("value"))}
    for name, df in rows.items():
        stateless.write_lines(df, str(tmp_path / f"out-{name}"), str(tmp_path / f"state-{name}")).awaitTermination(120)
    assert {n: spark.read.text(str(tmp_path / f"out-{n}")).count() for n in rows} == {"nodes": 3, "points": 1, "errors": 2}


def test_a_value_selects_a_part_of_several(spark):
    """Rows of one value are those of several values that have it."""
    rows = spark.createDataFrame([(k, {"amenity": v}) for k, v in enumerate(["toilets", "kindergarten", "school", "toilets", "Toilets"])] + [(9, {})], "id long, tags map<string,string>")
    several = rows.where(tags.matches(F.col("tags"), "amenity~toilets,amenity~kindergarten"))
    one = rows.where(tags.matches(F.col("tags"), "amenity~toilets"))
    assert {r.id for r in several.collect()} == {0, 1, 3}
    assert one.collect() == several.where("tags['amenity'] = 'toilets'").collect() and one.count() == 2


def test_sets_that_are_empty(spark):
    ids = spark.createDataFrame([(1,), (1,), (None,)], "id long")
    assert not aggregates.is_empty(aggregates.id_set(ids)) and aggregates.is_empty(aggregates.id_set(ids.where("id > 1")))


def test_rates_are_reported():
    to = io.StringIO()
    rate = lines.Rate(to, every=2)
    for _ in range(5):
        rate.count()
    rate.end()
    said = to.getvalue().splitlines()
    assert [x.split(" (")[0] for x in said[:2]] == ["2 records so far", "4 records so far"] and said[2].startswith("5 records in")


def test_error_rows_keep_the_line(spark):
    _, errors = geojson_lines.parse_lines(spark.createDataFrame([(x,) for x in GEO], "value string"))
    assert {r.line for r in errors.collect()} == {"{oops", '{"type":"Feature","properties":{"name":5}}'}
