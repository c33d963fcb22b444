"""The pipeline, its contract, and the queries as registered."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from cartoloom.llm import bpe, mixing, packing, pii, quality, simhash
from cartoloom.llm import queries as llm
from tests.llm.test_search import brute_groups, brute_pack
from tests.test_queries import duck, sorted_rows


def test_stages_keep_the_columns_and_take_effect(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "pii", "mix_sources", "best_fit_packing"]
    counts = [docs.count()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, small))
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] == counts[3] >= counts[4] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    kept = {r.doc_id for r in docs.where("length(text) > 0").collect()}
    assert {r.doc_id for r in last.collect()} == kept
    whole = sorted(tuple(r) for r in corpus_pipeline.run(spark, small).collect())
    assert whole == sorted(tuple(r) for r in last.collect())


def test_near_dedup_broadcasts_no_fingerprints(spark, small, monkeypatch):
    plans, pairs = [], simhash.near_pairs

    def seen(distinct):
        found = pairs(distinct)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(simhash, "near_pairs", seen)
    dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, spark.read.parquet(f"{small}/documents.parquet"), small)
    assert len(plans) == 1 and "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]


def test_near_dedup_broadcasts_no_heads(spark, small, monkeypatch):
    plans, components = [], simhash.components

    def seen(edges):
        plans.append(edges._jdf.queryExecution().executedPlan().toString())
        return components(edges)

    monkeypatch.setattr(simhash, "components", seen)
    dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, spark.read.parquet(f"{small}/documents.parquet"), small)
    assert len(plans) == 1 and plans[0].count("SortMergeJoin") == 3 and "Broadcast" not in plans[0]


def test_every_operator_is_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


@pytest.mark.parametrize("name", sorted(llm.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, small, name):
    df = entry.queries()[name](spark, small)
    assert sorted_rows(df.columns, df.collect()) == duck(small, llm.ORACLE_SQL[name])


def test_stages_take_an_empty_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, small).count() == 0, name


ODD = "doc_id long, text string, lang string, source string, n_chars long, `x.y` string, row string, count long, `a b` string, C0 string"


@pytest.fixture
def odd(spark, small, tmp_path):
    """A table of documents with nulls in every column, repeats, a long text, copies, and columns of clashing names."""
    base = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").limit(90).collect()]
    more = [(k, *r[1:]) for k, r in enumerate(base[:15], 10_000)] + base[20:25] + [(None, *r[1:]) for r in base[30:33]]
    long = " ".join(r[1] for r in base if r[1]) * 3
    more += [(20_000, None, None, None, None), (20_001, "", "en", "src0", 0), (20_002, long, "en", None, len(long)), (None, None, None, None, None), (20_003, "mail a.b@mail1.example.com " + base[2][1], None, "src1", None), (20_003, None, "en", "src1", 3)]
    rows = [(*r, "x", None, 1, "y", None) for r in [*base, *more]]
    spark.createDataFrame(rows, ODD).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{small}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_every_stage_against_brute_force(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    columns = docs.columns
    rows = [tuple(r) for r in docs.collect()]

    def next_(k, docs):
        out = corpus_pipeline.stored(corpus_pipeline.STAGES[k][1](spark, docs, odd))
        assert out.columns == columns
        return out, sorted((tuple(r) for r in out.collect()), key=repr)

    # rules: the probability of each text alone
    model = quality.train(spark, odd)
    want = [r for r in rows if model.probability(pa.array([r[1]], pa.string()))[0] >= quality.KEEP]
    docs, got = next_(0, docs)
    assert got == sorted(want, key=repr) and 0 < len(got) < len(rows)
    # near copies: all pairs; of a repeated doc_id one row, with the largest text
    drop = {i for i, _ in brute_groups([r[:2] for r in got])}
    best = {}
    for r in got:
        if r[0] is not None and r[0] not in drop and (r[0] not in best or (r[1] or "") > (best[r[0]][1] or "")):
            best[r[0]] = r
    docs, got = next_(1, docs)
    assert [r[:2] for r in got] == [r[:2] for r in sorted([*best.values(), *(r for r in want if r[0] is None)], key=repr)] and drop
    # PII: every token of every text decoded
    field, want = pii.Field(pii.fitted().model, False), []
    for r in got:
        spans, data, offsets = pii.find(pa.array([r[1]], pa.string()), field)
        text = None if r[1] is None else pii._redacted(spans, data, offsets, 0)
        want.append((r[0], text, *r[2:4], r[4] if text == r[1] or r[4] is None else len(text), *r[5:]))
    docs, got = next_(2, docs)
    assert got == sorted(want, key=repr) and any("[EMAIL]" in (r[1] or "") for r in got)
    # mixing: the budgets, and the best sum that any subset gives
    size = {r[0]: len(bpe.tokenizer().encoding.encode_ordinary(r[1] or "")) for r in got if r[0] is not None}
    supply, held = Counter(), {}
    for r in got:
        if r[0] is not None:
            supply[r[3]] += size[r[0]]
            held.setdefault(r[3], []).append(size[r[0]])
    each = {s: n / mixing.WEIGHTS.get(s, 1.0) for s, n in supply.items() if n}
    middle = sorted(each.values())[len(each) // 2]
    unit = min(x for x in each.values() if x >= middle * mixing.SCARCE)
    before = got
    docs, got = next_(3, docs)
    assert {*got} <= {*before}
    for s, n in supply.items():
        budget = n if n and each[s] <= unit else int(unit * mixing.WEIGHTS.get(s, 1.0)) if n else 0
        sums = 1
        for x in held[s]:
            sums |= sums << x
        best = (sums & (1 << budget + 1) - 1).bit_length() - 1
        assert sum(size[r[0]] for r in got if r[3] == s) == best, s
    # packing: pieces tile the documents, and the bins are those of a search through all open ones
    pieces = corpus_pipeline.STAGES[4][1](spark, docs, odd).collect()
    most = max(packing.SIZES)
    want = sorted((min(most, size[r[0]] - a) for r in got for a in range(0, size[r[0]], most)), reverse=True)
    assert sorted((p.n_tokens for p in pieces), reverse=True) == want
    n, sizes = brute_pack(want, packing.SIZES)
    bins = {p.bin_id: p.bin_size for p in pieces}
    assert len(bins) == n and sorted(bins.values()) == sorted(sizes)
    assert sorted(map(tuple, corpus_pipeline.run(spark, odd).collect())) == sorted(map(tuple, pieces))
