"""The fitted models: gradients and inference against brute force, held-out accuracy, and edge cases."""

from __future__ import annotations

import itertools
import re
import resource
import tracemalloc
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from cartoloom.llm import _text as T
from cartoloom.llm import crf, fm, pii, quality, toxicity
from cartoloom.llm._features import Sparse, sample, sigmoid
from cartoloom.llm._spark import mapped, table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, quality string, score string, spans string, keep string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en" if k % 3 else None, None if k % 3 else "web", len(t or ""), "x", "x", "x", "x") for k, (i, t) in enumerate(rows)], SCHEMA)


ODD = [(1, None), (2, ""), (3, "one"), (None, "two words"), (None, None), (4, "same"), (4, "same"), (5, "very long " * 30_000), (6, "\x00\x01   🎉")]


def labelled(*args, **named):
    return sample(*args, **named).orderBy("doc_id").toArrow()


def held_out(spark, small, label, columns=()):
    """Labelled rows of a larger table, split by number: (fit, test)."""
    rows = labelled(spark, small.replace("0.001", "0.01"), label, 10_000, columns=columns)
    n = np.arange(rows.num_rows)
    return rows.filter(pa.array(n % 4 != 0)), rows.filter(pa.array(n % 4 == 0))


def accuracy(p, y, at=0.5):
    return float(np.mean((p >= at) == (y == 1)))


def brute(score, step, first):
    """All label sequences of one text: (sequence, score)."""
    n, k = score.shape
    for s in itertools.product(range(k), repeat=n):
        yield s, first[s[0]] + sum(score[t, s[t]] for t in range(n)) + sum(step[a, b] for a, b in zip(s, s[1:]))


def test_field_inference_is_exact():
    r = np.random.default_rng(1)
    score, step, first = r.normal(0, 1, (3, 5, 3)), r.normal(0, 1, (3, 3)), r.normal(0, 1, 3)
    mask = np.arange(5) < np.array([5, 3, 1])[:, None]
    single, pair, total = crf.marginals(score, mask, step, first)
    best = crf.viterbi(score, mask, step, first)
    want = np.zeros((3, 3))
    for i, n in enumerate((5, 3, 1)):
        every = list(brute(score[i, :n], step, first))
        weight = np.exp([s for _, s in every])
        z = weight.sum()
        assert total[i] == pytest.approx(np.log(z))
        assert tuple(best[i, :n]) == max(every, key=lambda x: x[1])[0]
        for t in range(n):
            for k in range(3):
                assert single[i, t, k] == pytest.approx(sum(w for (s, _), w in zip(every, weight) if s[t] == k) / z)
        for (s, _), w in zip(every, weight):
            for a, b in zip(s, s[1:]):
                want[a, b] += w / z
    np.testing.assert_allclose(pair, want)


def test_toxicity_marginals_are_the_fields():
    w = T.words(pa.array(["a b c d e", "", "b", "c c a", " ".join(f"w{k % 17}" for k in range(3 * toxicity.BLOCK + 5)), "x y " * (toxicity.BLOCK // 2)]))
    r = np.random.default_rng(2)
    weight = np.zeros(toxicity.FEATURES + 1)
    weight[: toxicity.FEATURES] = r.normal(0, 0.5, toxicity.FEATURES)
    model = toxicity.Model(weight, r.normal(0, 1, (2, 2)), r.normal(0, 1, 2))
    got = model.marginals(w)
    for i in (0, 2, 3, 4, 5):
        a, b = w.offsets[i], w.offsets[i + 1]
        gain = weight[toxicity._feature(toxicity.units(w))].sum(1)[a:b]
        score = np.stack([np.zeros(b - a), gain], 1)[None]
        single, _, _ = crf.marginals(score, np.ones((1, b - a), bool), model.step, model.first)
        np.testing.assert_allclose(got[a:b], single[0, :, 1], atol=1e-9)


def test_toxicity_held_out(spark, small):
    fit, test = held_out(spark, small, "toxic")
    model = toxicity.fit(fit.column("text"), fit.column("label").to_numpy())
    p, expected, spans = toxicity.tagged(test.column("text").combine_chunks(), model)
    y = test.column("label").to_numpy()
    assert accuracy(p, y, toxicity.TOXIC) >= 0.9
    assert np.mean(p[y == 0] >= toxicity.TOXIC) <= 0.05
    assert all(bool(s) == bool(x >= toxicity.SPAN) for s, x in zip(spans, p)) and (expected >= 0).all()


def test_toxicity_edge_cases(spark, small):
    nothing = toxicity.fit(pa.array([], pa.string()), np.zeros(0))
    rows = toxicity.score(documents(spark, ODD), nothing).collect()
    assert len(rows) == len(ODD) and all(r.score == 0 and not r.toxic and r.spans == [] for r in rows)
    one = toxicity.fit(pa.array(["a b", "c"]), np.zeros(2, np.int64))
    assert toxicity.score(documents(spark, []), one).count() == 0
    fit, _ = held_out(spark, small, "toxic")
    model = toxicity.fit(fit.column("text"), fit.column("label").to_numpy())
    assert len(toxicity.score(documents(spark, ODD), model).collect()) == len(ODD)


def test_toxic_offsets_are_characters():
    texts = ["é " * 5 + "badword é", "x"]
    weight = np.zeros(toxicity.FEATURES + 1)
    w = T.words(pa.array(["badword"]))
    weight[toxicity._feature(toxicity.units(w))[0]] = 3
    weight[toxicity.FEATURES] = 0
    score, _, spans = toxicity.tagged(pa.array(texts), toxicity.Model(weight, np.array([[0.0, -4.0], [0.0, -4.0]]), np.array([0.0, -4.0])))
    assert [texts[0][s["start"] : s["end"]] for s in spans[0]] == ["badword"] and spans[1] == [] and score[0] > 0.9


def test_quality_held_out_and_calibrated(spark, small):
    fit, test = held_out(spark, small, "quality")
    model = quality.fit(fit.column("text"), fit.column("label").to_numpy().astype(float))
    p, y = model.probability(test.column("text").combine_chunks()), test.column("label").to_numpy()
    assert accuracy(p, y) >= 0.9 and abs(p.mean() - y.mean()) <= 0.1


def test_quality_logit_is_that_of_its_features():
    texts = pa.array(["a b c abc", "", "a a a", "ü x"])
    r = np.random.default_rng(3)
    model = quality.Model(r.normal(0, 1, 3 * quality.SIZE), 0.25)
    np.testing.assert_allclose(model.logit(texts), quality.features(texts).dot(model.weights) + 0.25, atol=1e-9)


def test_quality_features_are_those_of_a_naive_count():
    """Words, pairs and byte sequences counted one by one, hashed by the same functions one value at a time."""
    text = "the cat the cat saw ü  saw saw, The end"
    words = ["the", "cat", "the", "cat", "saw", "ü", "saw", "saw", "the", "end"]
    h = [T.word_hash(x) for x in words]
    want = Counter()
    for x in h:
        want[x % quality.SIZE] += 1 / len(h)
    for a, b in itertools.pairwise(h):
        pair = 0 if a == b else int(T.mix(np.array([(a * 3 + b) % 2**64], T.U))[0])
        want[pair % quality.SIZE + quality.SIZE] += 1 / (len(h) - 1)
    data = text.encode()
    for k in range(len(data) - 3):
        want[(int.from_bytes(data[k : k + 4], "little") * 2654435761 % 2**32 >> 32 - quality.BITS) + 2 * quality.SIZE] += 1 / (len(data) - 3)
    got = quality.features(pa.array(["other words", text]))
    lo, hi = got.offsets[1:3]
    assert dict(zip(got.index[lo:hi].tolist(), got.value[lo:hi])) == {k: pytest.approx(v * quality.SCALE) for k, v in want.items()}


def test_calibration_is_the_best_sigmoid():
    """Platt's slope and shift against a search over a grid."""
    r = np.random.default_rng(6)
    y = (r.random(300) < 0.6).astype(float)
    z = 2 * y - 1 + r.normal(0, 1, 300)
    goal = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))

    def loss(a, b):
        p = sigmoid(a * z + b)
        return -(goal * np.log(p) + (1 - goal) * np.log(1 - p)).sum() + 5e-4 * ((a - 1) ** 2 + b**2)

    a, b = quality.platt(z, y)
    best = min((loss(a + da, b + db), da, db) for da in np.linspace(-0.5, 0.5, 21) for db in np.linspace(-0.5, 0.5, 21))
    assert best[1:] == (pytest.approx(0), pytest.approx(0))


def test_quality_edge_cases(spark, small):
    texts, y = pa.array(["good words here", "bad"] * 20), np.array([1.0, 0.0] * 20)
    model = quality.fit(texts, y)
    rows = quality.score(documents(spark, ODD), model).collect()
    assert len(rows) == len(ODD) and len({r.quality for r in rows if r.doc_id == 4}) == 1
    assert [r.quality for r in rows if r.doc_id in (1, 2)] == [rows[0].quality] * 2
    for labels, share in ((np.zeros(0), 1.0), (np.ones(3), 1.0), (np.zeros(3), 0.0)):
        one = quality.fit(pa.array(["a"] * len(labels), pa.string()), labels)
        assert one.probability(pa.array(["x", None])) == pytest.approx([share] * 2)
    assert quality.score(documents(spark, []), model).count() == 0
    df = documents(spark, ODD)
    kept = quality.filter_quality(spark, df, small)
    assert kept.columns == df.columns
    want = quality.train(spark, small).probability(pa.array([t for _, t in ODD])) >= quality.KEEP
    assert kept.count() == int(want.sum())


def test_machine_sums_all_pairs():
    r = np.random.default_rng(4)
    index = np.sort(r.choice(fm.WORDS, 6, replace=False))
    x = Sparse(index, r.normal(0, 1, 6), np.array([0, 6, 6]))
    model = fm.Model(0.5, r.normal(0, 1, fm.SIZE), r.normal(0, 1, (fm.SIZE, fm.RANK)), np.zeros(fm.STATS), np.ones(fm.STATS))
    want = 0.5 + (model.linear[index] * x.value).sum()
    for a, b in itertools.combinations(range(6), 2):
        want += model.factors[index[a]] @ model.factors[index[b]] * x.value[a] * x.value[b]
    assert model.logit(x) == pytest.approx([want, 0.5])


def test_machine_held_out(spark, small):
    parts = held_out(spark, small, "quality", ("lang", "source"))
    x, y = zip(*((fm.features(*(p.column(c).combine_chunks() for c in ("text", "lang", "source"))), p.column("label").to_numpy().astype(float)) for p in parts))
    model = fm.fit(x[0], y[0])
    assert accuracy(1 / (1 + np.exp(-model.logit(x[1]))), y[1]) >= 0.9


def test_machine_edge_cases(spark, small):
    model = fm.train(spark, small)
    rows = fm.classify(documents(spark, ODD), model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.quality <= 1 for r in rows)
    empty = fm.fit(fm.features(pa.array([], pa.string()), pa.array([], pa.string()), pa.array([], pa.string())), np.zeros(0))
    assert all(r.good for r in fm.classify(documents(spark, ODD), empty).collect())
    assert fm.classify(documents(spark, []), model).count() == 0


def whole(text, field):
    """Decoding of the whole text, without skipping plain tokens."""
    return pii.find(pa.array([text]), pii.Field(field.model, False))[0]


def test_skipping_plain_tokens_changes_nothing(spark, small):
    field = pii.fitted()
    texts = [r.text for r in table(spark, small, "documents").where("length(text) < 3000").select("text").collect()]
    for text in texts:
        a, b = pii.find(pa.array([text]), field)[0], whole(text, field)
        assert a.start.tolist() == b.start.tolist() and a.end.tolist() == b.end.tolist() and a.label.tolist() == b.label.tolist()


def test_long_runs_are_decoded_exactly():
    """Blocks against one recursion over the whole run."""
    field = pii.fitted()
    r = np.random.default_rng(8)
    tokens = [t for s in pii.labelled_rows(seed=5, rows=200) for t, k in s if k or any(c.isdigit() for c in t)]
    tokens = [tokens[i] for i in r.permutation(len(tokens))]
    assert len(tokens) > 2 * pii.BLOCK
    features, mask = pii.padded([pii.feature_rows([pii.plain(t) for t in tokens])])
    want = crf.viterbi(pii.scores(field.model, features), mask, field.model.step, field.model.first)[0]
    data = " ".join(tokens).encode()
    ends = np.cumsum([len(t.encode()) + 1 for t in tokens]) - 1
    starts = ends - [len(t.encode()) for t in tokens]
    for n in (len(tokens), 2 * pii.BLOCK, pii.BLOCK + 1):
        got = pii.decoded(np.frombuffer(data, np.uint8), starts[:n], ends[:n], np.array([0]), np.array([n]), field.model)
        if n == len(tokens):
            assert got.tolist() == want.tolist()
        assert len(got) == n and len({*got.tolist()}) > 1


def test_a_long_text_of_numbers_takes_bounded_memory():
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    spans, _, _ = pii.find(pa.array(["12 " * 1_000_000 + "call +1 (555) 123-4567 now"]), pii.fitted())
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 600_000  # KB
    assert len(spans.row) >= 1 and pii.LABELS[spans.label[-1]] == "PHONE"


def test_pii_of_fresh_sentences():
    field, good, total, wrong = pii.fitted(), 0, 0, 0
    for sentence in pii.labelled_rows(seed=77, rows=300):
        text = " ".join(t for t, _ in sentence)
        spans = pii.find(pa.array([text]), field)[0]
        at, found = 0, set()
        covered = np.zeros(len(text.encode()) + 1, bool)
        for s, e in zip(spans.start, spans.end):
            covered[s:e] = True
        for token, label in sentence:
            size = len(token.encode())
            hit = bool(covered[at : at + size].any())
            total, good, wrong = total + (label > 0), good + (hit and label > 0), wrong + (hit and label == 0)
            found.add(label)
            at += size + 1
    assert good >= 0.95 * total and wrong <= 0.05 * total


@pytest.mark.parametrize(
    ("text", "label"),
    [("write to anna.lopez@mail7.example.com today", "EMAIL"), ("call +1 (555) 123-4567 now", "PHONE"), ("from 192.168.4.17 again", "IP"), ('token = "ghp_0123456789abcdef0123456789abcdef0123"', "SECRET")],
)
def test_pii_is_found_and_redacted(spark, text, label):
    df = documents(spark, [(1, f"é {text} é")])
    row = pii.detect(df).first()
    assert [s.label for s in row.spans] == [label] and f"[{label}]" in row.redacted
    out = pii.redact(spark, df).first()
    assert out.text == row.redacted and out.n_chars == len(out.text)


def test_pii_edge_cases(spark):
    df = documents(spark, [*ODD, (7, "plain words only, in 1999 and 2004."), (8, "a@b.co " * 4000)])
    rows = pii.detect(df).collect()
    assert len(rows) == len(ODD) + 2 and all(r.spans == [] and r.redacted is None for r in rows if r.doc_id != 8)
    out = pii.redact(spark, df)
    assert out.columns == df.columns
    same = [(r.doc_id, r.text, r.n_chars) for r in out.collect() if r.doc_id != 8]
    assert same == [(r.doc_id, r.text, r.n_chars) for r in df.collect() if r.doc_id != 8]
    assert pii.redact(spark, documents(spark, [])).count() == 0


def test_toxicity_windows_stay_in_their_documents():
    """Documents shorter than a window fit, and a field of few tokens is no special case."""
    texts = pa.array(["vile slur here", "kind words here", "vile slur there", "kind thoughts"] * 3)
    model = toxicity.fit(texts, np.array([1, 0, 1, 0] * 3))
    assert np.isfinite(model.weight).all() and np.isfinite(model.step).all()


def test_labelled_takes_the_largest_label_and_bounds(spark, tmp_path):
    spark.createDataFrame([(1, 0, 0), (1, 1, 0), (2, None, 1), (None, 1, 1), (3, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a"), (1, "Z"), (1, None), (2, "b"), (3, None), (4, "d")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = labelled(spark, str(tmp_path), "quality", 10)
    assert got.select(["doc_id", "label", "text"]).to_pylist() == [{"doc_id": 1, "label": 1, "text": "a"}, {"doc_id": 3, "label": 0, "text": None}]
    assert labelled(spark, str(tmp_path), "quality", 1).num_rows == 1


def test_fit_holds_the_features_about_once():
    r = np.random.default_rng(4)
    texts = pa.array([" ".join(map(str, r.integers(0, 10_000, 120))) for _ in range(1500)])
    entries = len(quality.features(texts).index)
    tracemalloc.start()
    quality.fit(texts, np.arange(1500) % 2.0, 2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 2.7 * 16 * entries  # an entry is 16 bytes


def test_workers_give_free_memory_back(spark, monkeypatch):
    def resident():
        return int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) >> 10

    def run(batches):
        for batch in batches:
            blocks = [np.ones(12_000) for _ in range(1500)]  # 144 MB, of which a few stay
            kept.extend(blocks[::50])
            del blocks
            yield batch

    kept: list[np.ndarray] = []
    given, df = [], spark.range(1)
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: given.append(f) or self)
    mapped(df, run)
    batch = pa.RecordBatch.from_arrays([pa.array([1])], ["c0"])
    out = given[0](iter([batch]))
    assert next(out) is batch
    before = resident()
    assert list(out) == [] and resident() < before - 72
