"""Every registered query against DuckDB on the smallest tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from cartoloom import queries as own

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if hasattr(value, "asDict"):
        return plain(list(value))
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in value.items())
    return bytes(value) if isinstance(value, (bytearray, memoryview)) else value


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted(repr([plain(row[k]) for k in order]) for row in rows)


def duck(folder, sql):
    con = duckdb.connect()
    for name in TABLES:
        if os.path.exists(path := f"{folder}/{name}.parquet"):
            source = f"{path}/*.parquet" if os.path.isdir(path) else path
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{source}'")
    found = con.execute(sql)
    return sorted_rows([d[0] for d in found.description], found.fetchall())


@pytest.mark.parametrize("name", sorted(own.QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, small, name):
    df = entry.queries()[name](spark, small)
    got = sorted_rows(df.columns, df.collect())
    if name in own.ORACLE_SQL:
        assert got == duck(small, own.ORACLE_SQL[name])
    else:
        assert got[1]


def test_entry_and_contract(spark):
    assert entry.entry(spark).columns == ["doc_id", "tokens", "n_tokens"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_optional_subpackage():
    folder = os.path.dirname(own.__file__)
    for path in glob.glob(f"{folder}/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" not in path:
            with open(path) as f:
                assert "llm" not in f.read(), path


def test_pages_of_odd_texts_come_back_whole(spark, tmp_path):
    odd = ["", " ", " \n", None, "\r", "a\r\nb", "a\x00b\x1f", "\ue000", "\ue000@\x01\ue000_", " <text>&amp; ", "]]>", "\uffff"]
    rows = [(k, text, "s") for k, text in enumerate(odd)] + [(100 + k, "t", source) for k, source in enumerate(odd)] + [(None, "t", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = entry.queries()["xml_pages"](spark, str(tmp_path))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((i, source, text)) for i, text, source in rows)
    assert sorted_rows(got.columns, got.collect()) == duck(str(tmp_path), entry.oracle_sql()["xml_pages"])


def test_ways_are_kept_without_points_that_no_line_shows(spark, small, monkeypatch):
    kept, stored = [], own.extracts.stored
    monkeypatch.setattr(own.extracts, "stored", lambda df: kept.append(df.columns) or stored(df))
    made = [own.extracts.denormalised(own.nodes(spark, small), own.ways(spark, small), own.relations(spark, small), None, shown) for shown in (False, True)]
    assert ["points" in columns for columns in kept if "bounds" in columns] == [False, True]
    assert made[0].count() == made[1].count() > 0


@pytest.mark.parametrize("name, passes", [("way_record_lines", 2), ("extract_lines", 1)])
def test_made_lines_are_parsed_once(spark, small, name, passes):
    plan = entry.queries()[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object" not in plan and plan.count("json_tuple") == passes
