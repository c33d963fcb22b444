"""SimHash near-dedup, stupid backoff, media chunks, Huffman ids, mixing and packing against brute force."""

from __future__ import annotations

import hashlib
import itertools
import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
import zstandard
from pyspark.sql import functions as F

from cartoloom.llm import _text as T
from cartoloom.llm import bpe, huffman, media, mixing, ngram_lm, packing, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, flip string, h1 string, seq string, rank string, part string, payload string, n_tokens string"
EXTRA = ("en", "s", 5, "x", "x", "x", "x", "x", "x", "x")


def documents(spark, rows):
    """Documents with further columns whose names are those that the operators use inside."""
    return spark.createDataFrame([(i, t, *EXTRA) for i, t in rows], SCHEMA)


def words(n, seed, size=400):
    r = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in r.integers(0, size, n))


def corpus():
    base = [words(int(n), k) for k, n in enumerate(np.random.default_rng(1).integers(5, 300, 60))]
    rows = list(enumerate(base))
    for k in range(0, 60, 4):  # near and exact copies
        parts = base[k].split()
        parts[len(parts) // 2] = "changed"
        rows += [(100 + k, " ".join(parts)), (200 + k, base[k].upper())]
    return [*rows, (301, None), (302, ""), (303, "... !"), (None, base[0]), (None, None), (5, base[5]), (5, base[5]), (304, "lone"), (305, "long " * 30_000)]


def brute_groups(rows):
    rows = [(i, t) for i, t in rows if i is not None]
    at, fp = simhash.fingerprint_batch(pa.array([t for _, t in rows]))
    ids, root = [rows[k][0] for k in at], {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(ids)), 2):
        if int(np.bitwise_count(fp[a] ^ fp[b]).sum()) <= simhash.TAU:
            x, y = sorted((find(ids[a]), find(ids[b])))
            root[y] = x
    return {(i, find(i)) for i in ids if find(i) != i}


def test_near_copies_are_those_of_brute_force(spark):
    rows = corpus()
    got = {tuple(r) for r in simhash.duplicates(documents(spark, rows)).collect()}
    want = brute_groups(rows)
    assert got == want and {i for i, _ in want} >= {200 + k for k in range(0, 60, 4)}
    kept = simhash.near_dedup(spark, documents(spark, rows)).collect()
    assert Counter(r.doc_id for r in kept) == Counter({i: 1 for i in {i for i, _ in rows if i is not None} - {i for i, _ in want}} | {None: 2})


def test_pairs_at_the_border_are_found(spark):
    r = np.random.default_rng(3)
    centre = r.integers(0, 2**63, 2, dtype=np.uint64)
    rows = [centre]
    for bits in (1, 8, 15, 16, 17, 18) * 8:
        flips = r.choice(128, bits, replace=False)
        x = centre.copy()
        for f in flips:
            x[f // 64] ^= np.uint64(1) << np.uint64(f % 64)
        rows.append(x)
    fp = np.unique(np.array(rows), axis=0).view(np.int64)
    df = spark.createDataFrame([tuple(map(int, x)) for x in fp], "h1 long, h2 long")
    got = {frozenset(((p.a1, p.a2), (p.b1, p.b2))) for p in simhash.near_pairs(df).collect()}
    u = fp.view(np.uint64)
    want = {frozenset((tuple(map(int, fp[a])), tuple(map(int, fp[b])))) for a, b in itertools.combinations(range(len(fp)), 2) if int(np.bitwise_count(u[a] ^ u[b]).sum()) <= simhash.TAU}
    assert got == want


def test_fingerprints_are_not_broadcast(spark):
    """A table of fingerprints is far below the threshold, the 134 rows of each aren't: they have no place in the driver's memory."""
    pairs = simhash.near_pairs(simhash.stored(spark.range(300).select(F.xxhash64("id").alias("h1"), F.hash("id").cast("long").alias("h2"))))
    for k in range(2):  # as planned, and as changed while it ran
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan, k
        pairs.collect()


def clustered(n, seed=7):
    """Distinct fingerprints of which many are near each other, as two columns."""
    r = np.random.default_rng(seed)
    centres = r.integers(0, 2, (n // 20, 128), dtype=np.uint8)
    bits = centres[r.integers(0, len(centres), n)] ^ (r.random((n, 128)) < r.uniform(0, 0.12, (n, 1)))
    return np.unique(np.packbits(bits, axis=1).view(np.uint64), axis=0)


def brute_pairs(fp):
    x, y = np.triu_indices(len(fp), 1)
    d = np.bitwise_count(fp[x] ^ fp[y]).sum(axis=1)
    return {frozenset((tuple(map(int, fp.view(np.int64)[a])), tuple(map(int, fp.view(np.int64)[b])))): int(k) for a, b, k in zip(x, y, d) if k <= simhash.TAU}


@pytest.mark.parametrize("fine, at_once", [(1 << 15, 1 << 15), (0, 1 << 15), (0, 7)])
def test_pairs_of_one_and_of_two_chunks_are_those_of_brute_force(monkeypatch, fine, at_once):
    monkeypatch.setattr(simhash, "FINE", fine)
    monkeypatch.setattr(simhash, "AT_ONCE", at_once)
    fp = clustered(700)
    a, b = fp[::2], fp[1::2]
    found = []
    for x, y, same in ((a, a, True), (b, b, True), (a, b, False)):
        for at_x, at_y, distance in simhash.chunk_pairs(np.ascontiguousarray(x.T), np.ascontiguousarray(y.T), same):
            u, v = x.view(np.int64)[at_x], y.view(np.int64)[at_y]
            found += [(frozenset((tuple(map(int, p)), tuple(map(int, q)))), int(d)) for p, q, d in zip(u, v, distance)]
    want = brute_pairs(fp)
    assert len(found) == len(want) > 1000 and dict(found) == want


def test_fingerprints_meet_in_chunks_and_not_as_rows(spark, monkeypatch):
    """What is joined is two rows for each two chunks, where 134 rows for a fingerprint made candidates grow with the square."""
    monkeypatch.setattr(simhash, "LEAST_CHUNK", 128)
    fp = clustered(900, 8)
    pairs = simhash.near_pairs(spark.createDataFrame([tuple(map(int, x)) for x in fp.view(np.int64)], "h1 long, h2 long"))
    rows = pairs.collect()
    want = brute_pairs(fp)
    assert len(rows) == len(want) and {frozenset(((r.a1, r.a2), (r.b1, r.b2))): r.distance for r in rows} == want
    assert all((r.a1, r.a2) < (r.b1, r.b2) for r in rows)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    join = plan[plan.index("Join") :]
    assert "data" in join and "flip" not in plan


def test_a_chunk_that_meets_itself_may_come_in_two_orders():
    fp = clustered(500, 9)
    other = np.random.default_rng(1).permutation(fp)
    found = [r for batch in simhash._met(pa.py_buffer(fp.tobytes()), pa.py_buffer(other.tobytes()), True) for r in batch.to_pylist()]
    want = brute_pairs(fp)
    assert len(found) == len(want) and {frozenset(((r["a1"], r["a2"]), (r["b1"], r["b2"]))): r["distance"] for r in found} == want


def test_thinned_pairs_link_the_same(spark):
    r = np.random.default_rng(9)
    groups = [[tuple(map(int, x)) for x in r.integers(-(2**63), 2**63, (n, 2))] for n in (2, 3, 40, 300)]
    pairs = [(*p, *q) for g in groups for p, q in itertools.combinations(g, 2)]
    path = [((k, 5), (k + 1, 5)) for k in range(50)]
    df = spark.createDataFrame(pairs + [(*p, *q) for p, q in path], "a1 long, a2 long, b1 long, b2 long")
    got = simhash.thinned(df.repartition(2)).collect()
    assert len(got) < 2 * (sum(map(len, groups)) + 51)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for row in got:
        root[find((row[0], row[1]))] = find((row[2], row[3]))
    found = Counter(find(x) for x in [*itertools.chain(*groups), *((k, 5) for k in range(51))])
    assert sorted(found.values()) == [2, 3, 40, 51, 300]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "u long, v long")
    got = {r.node: r.root for r in simhash.components(edges).collect() if r.node != r.root}
    assert got == {k: 0 for k in range(1, 41)} | {101: 100}


@pytest.mark.parametrize("partitions, top, dense", [(1, 260_000, 64), (3, 2, 3), (3, 40, 8), (2, 0, 2)])
def test_backoff_scores(spark, partitions, top, dense):
    """With and without codes, and with dense pairs among them."""
    rows = [(i, t) for i, t in corpus() if i != 305] + [(305, "the the the the cat the end " * 3000), (400, " ".join(f"gibber{k}" for k in range(40)))]
    uni, tri, bi, first, docs = Counter(), Counter(), Counter(), Counter(), []
    for i, t in rows:
        if i is None:
            continue
        x = T.words(pa.array([t or ""]))
        w = [bytes(x.data[a:b]).decode().lower() for a, b in zip(x.start, x.end)]
        grams = [*zip(["<s>", "<s>", *w], ["<s>", *w], w)]
        docs.append((i, grams))
        uni.update(w)
        tri.update(grams)
        bi.update(g[1:] for g in grams)
        first.update(g[1] for g in grams)
    want = defaultdict(lambda: [0, 0.0])
    for i, grams in docs:
        for s, v, w in grams:
            if tri[s, v, w] >= 2:
                p = tri[s, v, w] / (first[v] if v == "<s>" else bi[s, v])
            elif bi[v, w] >= 2:
                p = 0.4 * bi[v, w] / first[v]
            else:
                p = 0.4**2 * uni[w] / uni.total()
            want[i] = [want[i][0] + 1, want[i][1] + math.log(p)]
    got = {r.doc_id: r for r in ngram_lm.score(documents(spark, rows), partitions, top, dense).collect()}
    assert set(got) == {i for i, _ in rows if i is not None}
    for i, r in got.items():
        n, s = want[i]
        assert r.n_words == n and r.score == pytest.approx(s, rel=1e-9, abs=1e-9)
        assert r.perplexity == (pytest.approx(math.exp(-s / n)) if n else None)
    assert got[400].perplexity == pytest.approx(uni.total() / 0.4**2)


def test_one_pair_in_a_third_of_all_places_is_spread(spark):
    """Rows of a dense pair go by their trigrams: no partition gets many more than its share."""
    r = np.random.default_rng(14)
    rows = [(k, " ".join("hot pair" if x % 3 == 0 else f"w{x}" for x in r.integers(0, 3000, 300))) for k in range(40)]
    docs = documents(spark, rows)
    shared = spark.sparkContext.broadcast(ngram_lm.dense_counts(docs, ngram_lm.common_words(ngram_lm.word_counts(docs)), 8))
    sizes = Counter()
    for x in ngram_lm.positions(docs, 16, shared).where("rows IS NOT NULL").collect():
        sizes[x.part] += len(ngram_lm.unpack(bytes(x.rows), 4)[0])
    assert max(sizes.values()) < 2 * sum(sizes.values()) / 16


def test_backoff_of_an_empty_table(spark):
    assert ngram_lm.score(documents(spark, [])).count() == 0
    assert ngram_lm.score(documents(spark, [(1, None)])).first().n_words == 0


def test_media_are_verified_and_reconstructed(spark):
    r = np.random.default_rng(4)
    block = r.bytes(9000)
    payloads = [(1, block), (2, b"head" + block), (3, b""), (4, None), (5, r.bytes(100)), (6, b"\0" * 50_000), (7, block), (7, block), (None, block), (8, b"x")]
    m = spark.createDataFrame([(i, None if p is None else bytearray(p), 1, 2) for i, p in payloads], "media_id long, payload binary, seq int, digest int")
    got = {x.media_id: x for x in media.verify(m).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7, 8}
    assert {k: x.verified for k, x in got.items()} == {k: None if k == 4 else True for k in got}
    # brute force: chunks by a hash that rolls byte by byte, references and owners of the distinct media
    whole = {i: max(p for j, p in payloads if j == i) for i in (1, 2, 3, 5, 6, 7, 8)}
    cut = {i: [p[a:b] for a, b in itertools.pairwise([0, *brute_cuts(p)])] for i, p in whole.items()}
    refs, owner = Counter(c for row in cut.values() for c in row), {}
    for i in sorted(cut):
        for c in cut[i]:
            owner.setdefault(c, i)
    for i, row in cut.items():
        own = {c for c in row if owner[c] == i}
        want = (len(row), sum(refs[c] > 1 for c in row), sum(map(len, own)), [hashlib.sha256(c).digest() for c in row])
        assert (got[i].n_chunks, got[i].shared_chunks, got[i].stored_bytes, list(map(bytes, got[i].chunks))) == want
    assert got[4].n_chunks == 0 and got[7].shared_chunks == got[7].n_chunks
    chunks = media.chunked(m.dropDuplicates(["media_id"])).select("media_id", F.explode("chunks").alias("c")).select("media_id", "c.*")
    back = {x.media_id: bytes(x.payload) for x in media.reconstruct(chunks.select("media_id", "seq", "digest"), media.chunk_store(chunks)).collect()}
    assert back == {i: p for i, p in payloads if i and p}


def brute_cuts(data):
    """The ends of the chunks, by one pass over the bytes."""
    ends, at, h = [], 0, 0
    for k, b in enumerate(data, 1):
        h = (2 * h + int(media.GEAR[b])) % 2**32
        if k - at >= media.LEAST and k >= 32 and h >> (32 - media.CUT_BITS) == 0 or k - at == media.MOST or k == len(data):
            ends.append(k)
            at = k
    return ends


def test_repeated_media_add_no_references(spark):
    data = bytearray(np.random.default_rng(12).bytes(5000))
    rows = [(1, data), (1, data), (2, bytearray(b"short")), (2, bytearray(b"much longer than that"))]
    got = {x.media_id: x for x in media.verify(spark.createDataFrame(rows, "media_id long, payload binary")).collect()}
    assert got[1].shared_chunks == 0 and got[1].stored_bytes == 5000 and got[1].verified
    assert got[2].n_bytes == got[2].stored_bytes == 21 and got[2].n_chunks == 1 and got[2].verified


def shuffled(spark, run):
    """(what run returns, the bytes that its stages write to shuffles)."""
    sc = spark.sparkContext._jsc.sc()

    def stages():
        sc.listenerBus().waitUntilEmpty(30_000)
        gateway = spark.sparkContext._gateway
        found = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in map(found.apply, range(found.size()))}

    before = stages()
    out = run()
    return out, sum(n for key, n in stages().items() if key not in before)


def test_payloads_are_shuffled_once(spark, tmp_path):
    r = np.random.default_rng(21)
    block = r.bytes(4000)
    rows = [(k, bytearray(r.bytes(50_000) + block)) for k in range(20)]
    spark.createDataFrame(rows, "media_id long, payload binary").write.parquet(f"{tmp_path}/media")
    got, written = shuffled(spark, lambda: media.verify(spark.read.parquet(f"{tmp_path}/media")).collect())
    assert len(got) == 20 and all(x.verified and x.n_bytes == 54_000 for x in got)
    assert sum(x.stored_bytes for x in got) < 20 * 54_000 - 19 * 2000 and all(x.shared_chunks for x in got)
    assert 20 * 50_000 < written < 1.5 * 20 * 54_000


def test_shared_chunks_come_from_their_owner(spark, monkeypatch):
    """A medium is verified only if what its chunks' owners hold is sound; chunks that its own payload repeats are stored once too."""
    r = np.random.default_rng(22)
    block = r.bytes(9000)
    payloads = {1: block, 2: r.bytes(3000) + block, 3: r.bytes(3000), 4: b"", 5: b"\0" * 40_000}
    df = spark.createDataFrame([(k, bytearray(p)) for k, p in payloads.items()], "media_id long, payload binary")
    assert {x.media_id: x.verified for x in media.verify(df).collect()} == dict.fromkeys(payloads, True)
    checked, seen = media._checked, []
    monkeypatch.setattr(media, "_checked", lambda rows: checked(seen.append(rows) or rows.select("digest", F.lit(zstandard.compress(b"other bytes")).alias("payload"))))
    got = {x.media_id: x for x in media.verify(df).collect()}
    assert {k: x.verified for k, x in got.items()} == {1: True, 2: False, 3: True, 4: True, 5: False}
    assert got[5].stored_bytes < 40_000 and seen[0].count() == seen[0].select("digest").distinct().count()
    monkeypatch.setattr(media, "_checked", lambda rows: checked(rows).where("false"))  # what an owner has lost is missed
    assert {x.media_id: x.verified for x in media.verify(df).collect()} == {1: True, 2: False, 3: True, 4: True, 5: False}


def test_cut_points_are_those_of_a_rolling_hash():
    r = np.random.default_rng(13)
    texts = [r.bytes(30_000), b"", b"\0" * 20_000, r.bytes(31), b"ab" * 9_000, r.bytes(media.MOST + 1)]
    offsets = np.cumsum([0, *map(len, texts)])
    got = media.cut_points(np.frombuffer(b"".join(texts), np.uint8), offsets)
    assert [[e - o for e in row] for row, o in zip(got, offsets.tolist())] == list(map(brute_cuts, texts))


def test_chunks_follow_the_content():
    r = np.random.default_rng(5)
    a = np.frombuffer(r.bytes(60_000), np.uint8)
    b = np.concatenate([a[:10_000], np.frombuffer(b"inserted", np.uint8), a[10_000:]])
    cuts = [media.cut_points(x, np.array([0, len(x)]))[0] for x in (a, b)]
    assert len({c + 8 for c in cuts[0]} & set(cuts[1])) > 0.7 * len(cuts[0])
    assert all(media.LEAST <= y - x <= media.MOST for x, y in zip([0, *cuts[0]], cuts[0][:-1]))
    data = r.bytes(3000)
    assert media.polynomial(data) == media.compose([(media.polynomial(data[:1111]), 1111), (media.polynomial(data[1111:]), 1889)])
    assert media.polynomials(np.frombuffer(data, np.uint8), np.array([0]), np.array([3000])).tolist() == [media.polynomial(data)]


def test_damaged_chunks_are_noticed(spark):
    df = spark.createDataFrame([(bytearray(b"d" * 32), bytearray(zstandard.compress(b"other bytes")))], "digest binary, payload binary")
    assert not media._checked(df).first().intact


def test_media_are_put_together_from_the_stored_bytes(spark):
    """Chunks that are sound in themselves make no verified medium if what they make together isn't the original."""
    whole, pack = hashlib.sha256(b"abcdef").digest(), lambda *x: [(k, zstandard.compress(p), True) for k, p in enumerate(x)]
    cases = [(1, 6, whole, pack(b"abc", b"def")), (2, 6, whole, pack(b"def", b"abc")), (3, 6, whole, pack(b"abc")), (4, 6, None, None), (5, 0, hashlib.sha256(b"").digest(), None), (6, 6, whole, pack(b"abc", b"deg"))]
    df = spark.createDataFrame([(i, n, w, p, [], 0, 0) for i, n, w, p in cases], "media_id long, n_bytes long, sha binary, parts array<struct<seq: int, payload: binary, intact: boolean>>, digests array<binary>, shared_chunks long, stored_bytes long")
    assert {r.media_id: r.verified for r in media.rebuilt(df).collect()} == {1: True, 2: False, 3: False, 4: None, 5: True, 6: False}


TEXTS = ["Hello world, it's 2024!  Two  spaces\n\nnew line ", "", None, "ünïcødé ½ ١٢ 漢字 🎉🎉 a b", "'s 'll don't", "x" * 50_000, "  ", "a\r\n\tb", "tok " * 5000]


def test_token_ids_are_the_public_tokenizers():
    coder = bpe.tokenizer()
    assert isinstance(coder.encoding, tiktoken.Encoding)
    want = [coder.encoding.encode_ordinary(t or "") for t in TEXTS]
    ids, offsets = coder.encode(pa.array(TEXTS))
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == want
    assert coder.lengths(pa.array(TEXTS)).tolist() == list(map(len, want))


def test_huffman_round_trip(spark):
    df = documents(spark, [*enumerate(TEXTS), (None, "again"), (0, TEXTS[0])])
    tokens = huffman.token_ids(df)
    code = huffman.Code.of(huffman.code_lengths(huffman.count_ids(tokens)))
    rows = huffman.encode(tokens, code).collect()
    assert all(r.verified for r in rows) and len(rows) == len(TEXTS) + 2
    for r in rows:
        assert len(r.checkpoints) == -(-r.n_tokens // huffman.BLOCK)
        want = bpe.tokenizer().encoding.encode_ordinary("again" if r.doc_id is None else TEXTS[r.doc_id] or "")
        # any block can be decoded alone
        for k, mark in enumerate(r.checkpoints):
            n = min(huffman.BLOCK, r.n_tokens - k * huffman.BLOCK)
            shifted = bytes(int(f"{int.from_bytes(r.payload, 'big'):0{8 * len(r.payload)}b}"[mark:].ljust(-(-(8 * len(r.payload) - mark) // 8) * 8, "0")[8 * j : 8 * j + 8], 2) for j in range(min(600, -(-(8 * len(r.payload) - mark) // 8))))
            got, _ = code.decode([shifted], [[0]], np.array([n]))
            assert got.tolist() == want[k * huffman.BLOCK : k * huffman.BLOCK + n]
            if k > 2:
                break
    assert huffman.encode(huffman.token_ids(documents(spark, [])), huffman.Code.of(huffman.code_lengths(np.zeros(10)))).count() == 0


def test_code_lengths_are_optimal():
    r = np.random.default_rng(6)
    for n, most in ((2, 1), (3, 2), (5, 3), (6, 3), (7, 4)):
        counts = np.r_[0, r.integers(1, 1000, n) ** 2, 0]
        got = huffman.code_lengths(counts, most)
        assert got[0] == got[-1] == 0 and got.max() <= most and sum(2.0 ** -int(x) for x in got[1:-1]) <= 1
        best = min(sum(a * b for a, b in zip(counts[1:-1], x)) for x in itertools.product(range(1, most + 1), repeat=n) if sum(2.0**-y for y in x) <= 1)
        assert int((counts * got).sum()) == best
    assert huffman.code_lengths(np.array([0, 9, 0])).tolist() == [0, 1, 0]
    with pytest.raises(ValueError, match="don't fit"):
        huffman.code_lengths(np.ones(5), 2)


def test_nearest_subset_is_the_best():
    r = np.random.default_rng(7)
    for _ in range(40):
        lengths, counts, rest = sorted({*r.integers(1, 30, 4).tolist()}), r.integers(1, 4, 4).tolist(), int(r.integers(0, 90))
        counts = counts[: len(lengths)]
        take = mixing.nearest_subset(lengths, counts, rest)
        assert all(take.get(x, 0) <= c for x, c in zip(lengths, counts))
        got = sum(x * n for x, n in take.items())
        best = max(s for p in itertools.product(*(range(c + 1) for c in counts)) if (s := sum(x * n for x, n in zip(lengths, p))) <= rest)
        assert got == best


def test_long_documents_meet_a_reachable_budget():
    lengths = np.array([18_000, 25_000, 32_000, 41_000, 47_000])
    take = mixing.fit(lengths, np.ones(5, np.int64), 73_000)
    assert (lengths * take).sum() == 73_000 and take.max() == 1
    r = np.random.default_rng(10)
    for _ in range(20):
        lengths, counts = np.unique(r.integers(17_000, 60_000, 9), return_counts=True)
        budget = int(r.integers(20_000, 300_000))
        sums = [sum(p) for k in range(len(lengths) + 1) for p in itertools.combinations(np.repeat(lengths, counts).tolist(), k)]
        assert (lengths * mixing.fit(lengths, counts, budget)).sum() == max(x for x in sums if x <= budget)
    lengths = np.arange(17_000, 17_400)  # many picks, most of which stay
    take = mixing.fit(lengths, np.full(400, 30), 100_000_001)
    assert (lengths * take).sum() == 100_000_001 and (take <= 30).all()


def test_mixing_meets_the_weights(spark):
    r = np.random.default_rng(8)
    rows = [(k, "abc"[min(2, k % 7)], int(r.integers(0, 200))) for k in range(500)] + [(900, None, 50), (901, None, 70)]
    lengths = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    got = mixing.mix(lengths, {"a": 1, "b": 2, "c": 4}).collect()
    assert len({x.doc_id for x in got}) == len(got) and {tuple(x) for x in got} <= {*rows}
    supply, total = Counter(), Counter()
    for _, s, n in rows:
        supply[s] += n
    for x in got:
        total[x.source] += x.n_tokens
    weight = {"a": 1, "b": 2, "c": 4, None: 1}
    unit = min(supply[s] / w for s, w in weight.items())
    for s, w in weight.items():
        assert 0 <= math.floor(unit * w) - total[s] <= 1, s
    assert sorted(map(tuple, mixing.mix(lengths, {"a": 1, "b": 2, "c": 4}).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert mixing.mix(lengths.where("false")).count() == 0


def test_mixing_makes_no_rows_in_python(spark, monkeypatch):
    plans, cut = [], mixing.cut

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(mixing, "cut", seen)
    mixing.mix(spark.range(40).selectExpr("id AS doc_id", "concat('src', id % 3) AS source", "id + 1 AS n_tokens"), mixing.WEIGHTS)
    # the second plan reads the checkpoint of the cells; any other table of existing rows came through Python
    assert len(plans) == 2 and "[source#" in plans[1] and "[of#" not in plans[1]


def test_empty_and_scarce_sources_leave_the_others_alone(spark, tmp_path):
    """An empty source, one of a single short document, and the weights of the registered query and the stage."""
    sources = ["src0"] * 40 + ["src1"] * 30 + ["src2"] * 40 + ["src3", "src4", "src4", None]
    texts = [words(50, k) for k in range(110)] + ["one", "", None, ""]
    rows = [(k, t, "en", s, 5) for k, (t, s) in enumerate(zip(texts, sources))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got, supply = Counter(), Counter()
    for x in mixing._measured(docs).collect():
        supply[x.source] += x.n_tokens
    out = mixing.op5_mix_sources(spark, str(tmp_path)).collect()
    for x in out:
        got[x.source] += x.n_tokens
    unit = supply["src0"] / 2
    assert got["src0"] == supply["src0"] and 0 < got["src3"] == supply["src3"] < 5
    assert all(0 <= unit - got[s] <= 1 for s in ("src1", "src2")) and got["src4"] == got[None] == 0
    assert {x.doc_id for x in mixing.mix_sources(spark, docs).collect()} == {x.doc_id for x in out}
    no_tokens = mixing._measured(docs.where("source IN ('src0', 'src4')"))
    assert {x.source: x.n_tokens > 0 for x in mixing.mix(no_tokens).collect()} == {"src0": True, "src4": False}


def test_documents_alike_are_ranked_in_buckets(spark):
    """Any bucket size takes as many of each source and length, and those that come first by the seeded hash."""
    rows = [(k, None if k % 3 == 0 else "s", 7 if k % 4 else 9) for k in range(400)]
    lengths = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    takes = spark.createDataFrame([(None, 7, 40, 100), ("s", 7, 200, 200), ("s", 9, 1, 66)], "source string, n_tokens long, take long, docs long")
    order = {r.doc_id: r.h for r in lengths.select("doc_id", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(5)), 1).alias("h")).collect()}
    want = set()
    for s, n, k, _ in takes.collect():
        want |= {*sorted((d for d, a, b in rows if (a, b) == (s, n)), key=order.get)[:k]}
    for size in (1 << 16, 10, 1):
        got = [r.doc_id for r in mixing.taken(lengths, takes, 5, size).collect()]
        assert len(got) == len(want) == 241 and {*got} == want


def test_mixed_documents_keep_their_columns(spark):
    rows = [(1, "one two three"), (1, "one two three"), (2, None), (3, ""), (None, "x y"), (4, "a " * 3000)]
    df = documents(spark, rows)
    out = mixing.mix_sources(spark, df)
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} == {1, 2, 3, 4}


def test_huffman_result_decodes_by_itself(spark, tmp_path):
    rows = [(1, words(700, 1)), (2, None), (3, ""), (None, "lone text"), (4, words(300, 2))]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = huffman.op6_huffman_token_ids(spark, str(tmp_path)).collect()
    (lengths,) = [r.payload for r in out if r.n_tokens is None]
    code = huffman.Code.of(np.frombuffer(bytes(lengths), np.uint8))
    found = [r for r in out if r.n_tokens is not None]
    ids, at = code.decode([bytes(r.payload) for r in found], [r.checkpoints for r in found], np.array([r.n_tokens for r in found]))
    got = {r.doc_id: ids[a:b].tolist() for r, a, b in zip(found, at, at[1:])}
    want = {r.doc_id: np.frombuffer(bytes(r.ids), "<u2").tolist() for r in huffman.token_ids(documents(spark, rows)).collect()}
    assert len(found) == len(rows) and got == want


def brute_pack(lengths, sizes):
    """Best fit by looking at every open bin, the latest of equals."""
    bins, out, left = [], [], sum(lengths)
    for n in lengths:
        left -= n
        fit = [(cap - used, -k) for k, (cap, used) in enumerate(bins) if cap - used >= n]
        if fit:
            k = -min(fit)[1]
        else:
            unit = min(packing.cost(s) / s for s in sizes)
            cap = min((packing.cost(s) - unit * min(s - n, left), s) for s in sizes if s >= n)[1]
            bins.append([cap, 0])
            k = len(bins) - 1
        bins[k][1] += n
        out.append(bins[k][1])
    return len(bins), sorted(next(s for s in sorted(sizes) if s >= u) for _, u in bins)


def test_packing_is_best_fit(spark):
    r = np.random.default_rng(9)
    for _ in range(30):
        lengths = sorted(r.integers(1, 65, 60).tolist(), reverse=True)
        bins, at, sizes = packing.pack(lengths, (16, 32, 64))
        load = Counter()
        for b, n in zip(bins, lengths):
            load[b] += n
        assert all(load[b] <= s and all(o < load[b] for o in (16, 32, 64) if o < s) for b, s in enumerate(sizes))
        n, best = brute_pack(lengths, (16, 32, 64))
        assert len(sizes) == n and sum(sizes) == sum(best)


def test_packed_pieces_tile_the_documents(spark):
    lengths = spark.createDataFrame([(1, 20_000), (2, 0), (3, 1), (4, 8192), (5, 8193), (6, 500), (7, 500)], "doc_id long, n_tokens long")
    for shard in (packing.SHARD_TOKENS, 5000):
        got = packing.pack_lengths(lengths, shard_tokens=shard).collect()
        by = defaultdict(list)
        for x in got:
            by[x.doc_id].append((x.token_start, x.n_tokens))
        ends = {k: [(a, a + n) for a, n in sorted(v)] for k, v in by.items()}
        assert {k: v[-1][1] for k, v in ends.items()} == {1: 20_000, 3: 1, 4: 8192, 5: 8193, 6: 500, 7: 500}
        assert all(a[1] == b[0] for v in ends.values() for a, b in zip(v, v[1:]))
        bins = defaultdict(list)
        for x in got:
            bins[x.bin_id].append((x.position, x.n_tokens, x.bin_size))
        assert all(sum(n for _, n, _ in v) <= v[0][2] and all(a[0] + a[1] == b[0] for a, b in zip(sorted(v), sorted(v)[1:])) for v in bins.values())
    assert packing.pack_lengths(lengths.where("false")).count() == 0
    df = documents(spark, [(1, "a b"), (1, "c d"), (None, "x"), (2, None)])
    assert [(x.doc_id, x.n_tokens) for x in packing.best_fit_pack(spark, df).collect()] == [(1, 4)]
