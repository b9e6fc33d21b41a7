"""Each operator against a plain version, and nulls, empties, ties, clashing names and empty tables."""

import functools
import hashlib
import io
import random
import re
import struct
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.llm import lattice as L
from gneiss.llm.direct_codes import Codes, pack as pack_ids, read_codes, word_encoder, write_codes
from gneiss.llm.line_chunks import remove_repeated_chunks
from gneiss.llm.media import area_resize, as_media, decode, difference_hash, encode_pgm, npy_tile, tiles
from gneiss.llm.packing import BUCKETS, BUDGET, best_bounds, pack
from gneiss.llm.phrase_index import benchmark_hits, words_of
from gneiss.llm.quality import score_quality
from gneiss.llm.queries_python import op2_packing, op7_media_columns, op8_quality_classifier
from gneiss.llm.secrets import BASE, findings, scan_unseen, update_ledger
from gneiss.llm.shards import byte_shards
from gneiss.llm.similarity import boundary, overlap, parity_sketch, similar_components, subset_sizes

DOCS, SF_DIR = "doc_id long, text string", "/root/testdata/sf0.001"


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, repeated rows, ties, one very long text."""
    return frame(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, ""), (4, " \n\n "), (None, "lost id here now"), (5, "long word " * 30_000), (6, "a b c d e f")])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# lattice


def tiny():
    return L.pieces([("▁ab", -1.0), ("▁a", -2.0), ("b", -1.5), ("c", -2.5), ("bc", -1.2), ("▁▁", -1.0)])


def all_paths(v, word):
    """The sum over all segmentations, by recursion over strings."""
    table = {}
    for p in ("ab", "a", ""):
        table["^" + p] = v.log_p[np.nonzero(v.keys == L.hash_of(p, True))[0][0]]
    for p in ("b", "c", "bc"):
        table[p] = v.log_p[np.nonzero(v.keys == L.hash_of(p, False))[0][0]]

    @functools.cache
    def rest(s):
        if not s:
            return np.exp(v.log_p[v.stop])
        total = np.exp(sum(v.log_p[v.byte0 + b] for b in s[0].encode())) * rest(s[1:])
        return total + sum(np.exp(lp) * rest(s[len(p):]) for p, lp in table.items() if p[0] != "^" and s.startswith(p))

    return np.log(sum(np.exp(lp) * rest(word[len(p) - 1:]) for p, lp in table.items() if p[0] == "^" and word.startswith(p[1:])))


@pytest.mark.parametrize("word", ["a", "ab", "abc", "abcbc", "é", "x", "日本b", "😀c"])
def test_forward_sums_all_segmentations(word):
    v = tiny()
    assert L.Lattice(v).log_probabilities([word])[0] == pytest.approx(all_paths(v, word), rel=1e-9)


def test_expected_uses_are_counts_and_weights_are_distributions():
    v, into = tiny(), np.zeros(len(tiny().log_p))
    lattice = L.Lattice(v)
    with np.errstate(over="ignore"):
        for _, codes in lattice.batches(["abc", "bc", "é", "abcab", "b" * 40]):
            lattice.expect(codes, into)
    assert into[v.begins].sum() == pytest.approx(5.0) and into[v.stop] == pytest.approx(5.0)
    # an expected use is how the log probability changes with the piece's
    k, words = int(np.nonzero(v.keys == L.hash_of("bc", False))[0][0]), ["abc", "bc", "é", "abcab", "b" * 40]
    moved = [L.Lattice(v.weighted(v.log_p + step * (np.arange(len(v.log_p)) == k))).log_probabilities(words).sum() for step in (-1e-5, 1e-5)]
    assert (moved[1] - moved[0]) / 2e-5 == pytest.approx(into[k], rel=1e-4)
    assert np.exp(v.log_p[v.begins]).sum() == pytest.approx(1) and np.exp(v.log_p[~v.begins]).sum() == pytest.approx(1)


def test_base_score_and_tokens(spark):
    docs = frame(spark, [(1, "A b"), (2, "b"), (3, "b zz"), (4, None)])
    got = {r.doc_id: r for r in L.score_texts(docs, F.col("doc_id") > 2, [("▁a", -1.0), ("b", -2.0)]).collect()}
    base = lambda c: np.log10((c + 0.1) / (5 + 0.1 * 4))
    assert got[3].train_tokens == 5 and got[3].n_tokens == 3 and got[3].n_known == 2 and got[3].held_out
    assert got[3].base_score == pytest.approx(base(2) + base(0) + base(2)) and got[4].n_tokens == 1
    assert all(r.score < 0 for r in got.values())


def test_scores_equal_a_plain_model(spark):
    r = random.Random(8)
    words = ["ab", "abc", "bc", "é", "c" * 30, "abab", "xyz", "a"] + ["ab" + "c" * i for i in range(20)]
    docs = [(i, " ".join(r.choice(words).upper() for _ in range(r.choice([0, 1, 7, 40])))) for i in range(60)] + [(None, "ab new"), (None, "ab new"), (61, None)]
    scored = [("▁ab", -1.0), ("▁a", -2.0), ("b", -1.5), ("c", -2.5), ("bc", -1.2)]
    got = L.score_texts(frame(spark, docs), F.coalesce(F.col("doc_id") % 4 == 0, F.lit(True)), scored, passes=0).collect()
    held = lambda d: d is None or d % 4 == 0
    low = lambda t: (t or "").lower().split()
    c = Counter(w for d, t in docs if not held(d) for w in low(t))
    ends, once, twice = sum(not held(d) for d, _ in docs), sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())
    n, d = sum(c.values()) + ends, once / (once + 2 * twice) if once and twice else L.DISCOUNT
    q = lambda w: np.exp(all_paths(L.pieces(scored), w))
    p = lambda w: (max(c[w] - d, 0) + d * len(c) * q(w)) / n
    want = sorted((str(i), sum(np.log10(p(w)) for w in low(t)) + np.log10(ends / n), sum(c[w] > 0 for w in low(t)) + 1, len(low(t)) + 1) for i, t in docs)
    got = sorted((str(x.doc_id), x.score, x.n_known, x.n_tokens) for x in got)
    assert len(got) == len(want) and all(a[0] == b[0] and a[2:] == b[2:] and a[1] == pytest.approx(b[1], rel=1e-9) for a, b in zip(got, want))


def test_lattice_edge_cases(spark, odd, none):
    got = L.score_texts(odd, F.lit(False), [("▁a", -1.0)]).collect()
    assert len(got) == 8 and all(np.isfinite(r.score) for r in got)
    assert all(np.isfinite(r.score) for r in L.score_texts(odd, F.lit(True), [("▁a", -1.0)]).collect())
    assert L.score_texts(none, F.lit(False), [("▁a", -1.0)]).count() == 0


# packing


@pytest.mark.parametrize("seed", range(6))
def test_bounds_are_optimal(seed):
    r = random.Random(seed)
    lengths = sorted(r.sample(range(1, 60), 9))
    counts = [r.randint(1, 20) for _ in lengths]
    cost = lambda bounds: sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts))
    for k in (1, 2, 3, 4, 12):
        best = min(cost([*some, lengths[-1]]) for n in range(min(k, 9)) for some in combinations(lengths[:-1], n))
        got = best_bounds(lengths, counts, k)
        assert cost(got) == best and len(got) <= k


def test_batches_keep_the_budget(spark, none):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.pmod(F.xxhash64("id"), F.lit(700)).alias("n_tokens"), F.lit("x").alias("batch"))
    got = pack(rows, buckets=4, budget=1000)
    per = got.groupBy("bucket", "batch").agg(F.count("*").alias("n"), F.first("bucket_tokens").alias("t"), F.max("batch_slot").alias("s"), F.sum("padding").alias("p")).collect()
    assert got.count() == 3000 and all(r.n * r.t <= 1000 and r.s == r.n - 1 for r in per)
    assert got.agg(F.min("padding")).first()[0] >= 0
    assert pack(none.select("doc_id", F.lit(1).alias("n_tokens"))).count() == 0
    long = [(i, n) for i, n in enumerate([70_001, 70_003, 70_003, 90_000, 5, 5, 7, 200_001])]
    padding = [r.padding for r in pack(spark.createDataFrame(long, "doc_id long, n_tokens long"), buckets=4).collect()]
    assert sum(padding) == 2 + 2 + 2  # 5, 5 to 7 and 70001 to 70003
    docs = {r.doc_id: len((r.text or "").encode().split()) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    packed = op2_packing(spark, SF_DIR).collect()
    bounds = best_bounds(sorted(set(docs.values())), [n for _, n in sorted(Counter(docs.values()).items())], BUCKETS)
    assert {r.doc_id: (r.n_tokens, r.bucket_tokens) for r in packed} == {d: (n, min(b for b in bounds if b >= n)) for d, n in docs.items()}
    places = sorted((r.bucket, r.batch, r.batch_slot) for r in packed)
    size = {r.bucket: max(1, BUDGET // max(1, r.bucket_tokens)) for r in packed}
    assert places == [(b, i // size[b], i % size[b]) for b in sorted(size) for i in range(sum(r.bucket == b for r in packed))]
    assert pack(spark.createDataFrame([(1, None), (None, 5), (None, 5)], "doc_id long, n_tokens long")).count() == 3


# similarity


def plain_components(rows):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            i, j = sorted((find(a), find(b)))
            parent[j] = i
    return {(d, len(s), find(d)) for d, s in sets.items()}


def test_similarity_equals_all_pairs(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for d in range(150):
        if rows and r.random() < 0.6:
            w = rows[r.randrange(len(rows))][1].split()
            for _ in range(r.randint(0, 2)):
                w[r.randrange(len(w))] = r.choice(words)
            w = w + [r.choice(words)] * r.randint(0, 2)
        else:
            w = [r.choice(words) for _ in range(r.choice([1, 3, 6, 9, 14, 20, 40, 120]))]
        rows.append((d, " ".join(w)))
    got = {tuple(x) for x in similar_components(frame(spark, rows)).collect()}
    assert got == plain_components(rows)


def test_parity_sketches_never_differ_more_than_their_sets():
    r = np.random.default_rng(5)
    for size in (0, 1, 20, 300, 5000):
        x = np.unique(r.integers(0, 2**63, size).astype(np.uint64))
        y = np.unique(np.concatenate([x[r.random(len(x)) < 0.9], r.integers(0, 2**63, size // 10).astype(np.uint64)]))
        bits = sum((a ^ b).bit_count() for a, b in zip(*([v & 0xFFFFFFFFFFFFFFFF for v in parity_sketch(s)] for s in (x, y))))
        assert bits <= len(np.setxor1d(x, y))


def test_similarity_edge_cases(spark, odd, none):
    got = sorted((tuple(r) for r in similar_components(odd).collect()), key=str)
    assert got.count((1, 2, 1)) == 2 and (6, 2, 1) in got and (2, 0, 2) in got and (3, 0, 3) in got and (None, 1, None) in got
    assert similar_components(none).count() == 0


def test_subset_sizes_and_boundary():
    assert overlap(9, 9) == 8 and subset_sizes(9, 16) == sorted({overlap(9, m) for m in range(8, 12)})
    assert boundary({3: 10, 10: 5}, 0.0) <= 16 and boundary({}, 0.0) == 0


# token codes


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_codes_round_trip_and_access(n):
    ids = np.random.default_rng(n).integers(0, 1 << np.random.default_rng(n).integers(1, 32, n), dtype=np.uint64).astype(np.uint32) if n else np.zeros(0, np.uint32)
    codes = Codes(pack_ids(ids))
    assert len(codes) == n and (codes.all() == ids).all()
    assert all(codes[i] == ids[i] for i in range(0, n, max(1, n // 97)))


def test_written_codes_equal_whole_text_encoding(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    texts = ["Hello, world! it's", None, "", "á é\n\tNAÏVE  x<|endoftext|>y 12", "日本 語　z  ", "don't've " * 500]
    docs = frame(spark, [(10 - i, t) for i, t in enumerate(texts)])
    path = P.path("word_bpe_49k.json")
    got = read_codes(write_codes(docs, lambda: word_encoder(path), 2), lambda ids: zlib.crc32(ids.astype("<u4").tobytes())).orderBy("doc_id").collect()
    tokenizer, start = Tokenizer.from_file(path), 0
    for row, text in zip(got, reversed(texts)):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        assert (row.start, row.n_tokens, row.digest) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_code_edge_cases(odd, none):
    plain = lambda: lambda texts: [np.frombuffer(t, np.uint8).astype(np.uint32) for t in texts]
    assert read_codes(write_codes(odd, plain, 2), len).count() == 8
    assert read_codes(write_codes(none, plain, 2), len).count() == 0


# line chunks


def test_repeated_chunks_go_once(spark, odd, none):
    shared = "\n".join(f"shared line {i}" for i in range(200))
    docs = frame(spark, [(i, f"own {i}\n{shared}\nend {i}", "x") for i in range(4)], DOCS + ", chunks_removed string")
    got = {r.doc_id: r for r in remove_repeated_chunks(docs).collect()}
    assert got[0].chunks_removed == 0 and got[0].text.count("shared") == 200
    for i in (1, 2, 3):
        assert got[i].chunks_removed > 0 and f"own {i}" in got[i].text and f"end {i}" in got[i].text and got[i].text.count("shared") < 60
    twice = remove_repeated_chunks(frame(spark, [(None, shared), (None, shared)])).collect()
    assert sorted(r.chunks_removed > 0 for r in twice) == [False, True]
    assert sorted(r.text or "" for r in remove_repeated_chunks(odd).collect()) == sorted(r.text or "" for r in odd.collect())
    assert remove_repeated_chunks(none).count() == 0


def test_passages_go_to_their_ends(spark):
    line = lambda name, n: " ".join(f"{name}{j}" for j in range(n))
    alone, short = line("alone", 66), line("short", 50)
    passage = [line(f"part{k}", 20) for k in range(3)]
    docs = [(i, "\n".join([line(f"a{i}x", 5), alone, line(f"b{i}x", 5), short, line(f"c{i}x", 5), *passage[:1 + i % 2], "" if i else " ", *passage[1 + i % 2 :], line(f"d{i}x", 5)])) for i in range(12)]
    got = {r.doc_id: r.text.split("\n") for r in remove_repeated_chunks(frame(spark, docs)).collect()}
    assert got[0] == docs[0][1].split("\n")
    for i in range(1, 12):
        assert got[i] == [line(f"a{i}x", 5), line(f"b{i}x", 5), short, line(f"c{i}x", 5), line(f"d{i}x", 5)]
    same = frame(spark, [(1, "\n".join([line("s", 30)] * 6))])
    assert remove_repeated_chunks(same, spacing=10**9).first().text.split("\n") == [line("s", 30)] * 2


# phrase index


def test_hits_equal_a_scan(spark, odd, none):
    r = random.Random(3)
    vocabulary = [f"t{i}" for i in range(6)]
    docs = [(d, " ".join(r.choice(vocabulary) for _ in range(60))) for d in range(40)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(n))) for i, n in enumerate([1, 3, 4, 4, 5, 7, 0])]
    got = {x.doc_id: (x.n_words, [list(s) for s in x.spans], x.items) for x in benchmark_hits(frame(spark, docs), frame(spark, items, "item_id long, text string"), 4).collect()}
    for d, text in docs:
        w, hit, ids = words_of(text.encode()), set(), set()
        for i, t in items:
            q = words_of(t.encode())
            for k in range(max(1, len(q) - 3) if q else 0):
                part = q[k : k + 4]
                for p in range(len(w) - len(part) + 1):
                    if w[p : p + len(part)] == part:
                        hit |= set(range(p, p + len(part)))
                        ids.add(str(i))
        assert got[d][0] == 60 and {p for a, b in got[d][1] for p in range(a, b)} == hit and got[d][2] == sorted(ids)
    empty = spark.createDataFrame([], "item_id long, text string")
    assert benchmark_hits(odd, empty).count() == 8 and benchmark_hits(none, empty).count() == 0
    several = {x.doc_id: (x.n_words, [list(s) for s in x.spans], x.items) for x in benchmark_hits(frame(spark, docs), frame(spark, items, "item_id long, text string"), 4, block_words=3).collect()}
    assert several == got
    again = frame(spark, [(None, "t1 t2"), (None, "t1 t2"), (None, "t3"), (7, docs[0][1]), (7, docs[0][1])])
    one, more = ([(x.doc_id, x.n_words, x.spans, x.items) for x in benchmark_hits(again, frame(spark, items, "item_id long, text string"), 4, block_words=n).collect()] for n in (10**6, 3))
    assert len(one) == len(more) == 5 and sorted(one, key=str) == sorted(more, key=str)
    near = benchmark_hits(frame(spark, [(1, "x a q b y"), (2, "a q q q b")]), frame(spark, [(1, "b a")], "item_id long, text string"), near=2).collect()
    assert {r.doc_id: bool(r.items) for r in near} == {1: True, 2: False}


# media


def test_media_decode_and_resize(spark, odd, none):
    rgb = np.random.default_rng(1).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    gray = rgb[:, :, 0]
    assert (decode(encode_pgm(gray)) == gray).all()
    assert (decode(b"P6 # note\n7 5\n255\n" + rgb.tobytes()) == rgb).all()
    assert (decode(b"P2\n7 5\n255\n" + b" ".join(b"%d" % x for x in gray.ravel())) == gray).all()
    assert (decode(b"P1\n3 1\n1 0 1\n") == [[0, 1, 0]]).all()
    row = b"".join(rgb[y, :, ::-1].tobytes() + b"\0" * (-21 % 4) for y in reversed(range(5)))
    header = b"BM" + (54 + len(row)).to_bytes(4, "little") + b"\0" * 4 + (54).to_bytes(4, "little")
    info = (40).to_bytes(4, "little") + (7).to_bytes(4, "little") + (5).to_bytes(4, "little") + b"\x01\0\x18\0" + b"\0" * 24
    assert (decode(header + info + row) == rgb).all()
    masked = np.array([[0x00FF8000, 0x000000FF]], "<u4")
    fields = info[:4] + (2).to_bytes(4, "little") + (1).to_bytes(4, "little") + b"\x01\0\x20\0" + (3).to_bytes(4, "little") + info[20:]
    head = header[:10] + (66).to_bytes(4, "little")
    assert decode(head + fields + struct.pack("<III", 0xFF, 0xFF00, 0xFF0000) + masked.tobytes()).tolist() == [[[0, 128, 255], [255, 0, 0]]]
    deep = np.random.default_rng(3).integers(0, 65536, (32, 32)).astype(np.uint16)
    tile = np.load(io.BytesIO(npy_tile(decode(b"P5 32 32 65535\n" + deep.astype(">u2").tobytes()))))
    assert tile.dtype == np.uint16 and (tile == np.rint(deep.reshape(16, 2, 16, 2).mean(axis=(1, 3)))).all()
    big = np.kron(gray, np.ones((12, 16)))
    assert np.allclose(area_resize(big, 5, 7), gray) and area_resize(gray, 2, 3).mean() == pytest.approx(gray.mean())
    assert difference_hash(np.tile(np.arange(18), (16, 1))) == "ff" * 8
    got = tiles(as_media(odd)).collect()
    assert len(got) == 8 and all(r.error is None and len(r.pixels) % 576 == 0 and len(r.pixels) >= 576 for r in got)
    clash = odd.withColumn("tile", F.lit("mine")).withColumn("media", F.lit(1))
    assert tiles(as_media(clash)).columns.count("tile") == 1 and tiles(as_media(clash)).count() == 8
    broken = tiles(frame(spark, [(1, bytearray(b"P5 2 2 255\n")), (2, None)], "media_id long, media binary")).collect()
    assert all(r.error and r.pixels is None for r in broken) and tiles(as_media(none)).count() == 0


def test_media_query_keeps_every_byte(spark):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op7_media_columns(spark, SF_DIR).collect()}
    assert got.keys() == texts.keys()
    for d, raw in texts.items():
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        stored = b"P5\n24 %d\n255\n" % (len(payload) // 24) + payload
        r, hexed = got[d], lambda x: hashlib.sha256(x).hexdigest()
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hexed(payload), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hexed(stored)) and r.feature.split(":")[0] == difference_hash(np.frombuffer(payload, np.uint8).reshape(-1, 24))


# quality


def test_held_out_labels(spark):
    got = {r.doc_id: r for r in op8_quality_classifier(spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for d, r in got.items())
    assert np.mean([got[r.doc_id].predicted == r.quality for r in labels if got[r.doc_id].held_out]) > 0.94


def test_quality_separates_held_out(spark, odd, none):
    r = random.Random(9)
    words = "the of river stone is and with over light from many".split()
    good = lambda: " ".join(r.choice(words) for _ in range(60)) + "."
    bad = lambda: " ".join(r.choice(words) + r.choice(["###", "%%%", "&&&"]) for _ in range(60))
    rows = [(i, bad() if i % 5 == 0 else good()) for i in range(1000)]
    positives = spark.createDataFrame([(i,) for i in range(500) if i % 5], "doc_id long")
    got = {x.doc_id: x.score for x in score_quality(frame(spark, rows), positives).collect()}
    assert np.mean([(got[i] >= 0.3) == bool(i % 5) for i in range(500, 1000)]) > 0.97
    assert all(0 <= x.score <= 1 for x in score_quality(odd, positives).collect()) and score_quality(odd, positives).count() == 8
    assert score_quality(none, positives).count() == 0
    assert all(x.score > 0.5 for x in score_quality(odd, positives.limit(0)).collect())


# shards


def test_shards_are_contiguous_and_near_equal(spark, odd, none):
    rows = [(i * 7 % 1000, "é" * (i % 90)) for i in range(1000)]
    got = sorted((r.doc_id, r.shard, r.slot, r.size, r.text_crc32) for r in byte_shards(frame(spark, rows), 7).collect())
    assert [x[1] for x in got] == sorted(x[1] for x in got)
    texts = dict(rows)
    for s in range(7):
        own = [x for x in got if x[1] == s]
        assert [x[2] for x in own] == list(range(len(own))) and abs(sum(x[3] for x in own) - sum(x[3] for x in got) / 7) <= 2 * 194
    assert all(x[3] == len(texts[x[0]].encode()) + 16 and x[4] == zlib.crc32(texts[x[0]].encode()) for x in got)
    assert byte_shards(odd, 40).count() == 8 and byte_shards(none, 40).count() == 0


# secrets


def test_ledger_scans_only_unseen_pairs(spark, odd, none, tmp_path):
    v1 = frame(spark, [("a", 'api_key = "abcdef12" x'), ("b", 'api_key = "abcdef12" x'), ("c", "AKIA" + "Z" * 16 + " " + "0a" * 12)], "path string, text string")
    base, path = {"base-1": BASE}, f"file://{tmp_path}/ledger"
    assert update_ledger(path, v1, base).count() == 2 and update_ledger(path, v1, base).count() == 2
    v2 = v1.unionByName(frame(spark, [("a", "Token: abc secret=token: abcdefgh"), ("d", None), ("e", "x Bearer " + "k" * 24)], "path string, text string"))
    new = scan_unseen(v2, spark.read.parquet(path))
    # three new blobs under both versions, two old ones under the new version
    assert sorted(r["count"] for r in new.groupBy("rule_version").count().collect()) == [3, 5]
    ledger = update_ledger(path, v2)
    assert ledger.count() == 10 and scan_unseen(v2, ledger).count() == 0
    found = sorted(((r.path, tuple((s.kind, s.start, s.end) for s in r.spans)) for r in findings(v2, ledger).collect()), key=str)
    key = (("assign", 0, 19),)
    assert found == sorted([("a", key), ("b", key), ("c", (("access", 0, 20), ("hex", 21, 45))), ("a", ()), ("d", ()), ("e", (("bearer", 2, 33),))], key=str)
    assert [len(r.spans) for r in findings(v2, ledger, base).where("path = 'e'").collect()] == [0]
    odd = odd.withColumnRenamed("doc_id", "path").withColumn("blob", F.lit(1)).withColumn("spans", F.lit("x"))
    assert findings(odd, scan_unseen(odd)).count() == 8
    none = none.withColumnRenamed("doc_id", "path")
    assert findings(none, scan_unseen(none)).count() == 0


def test_secret_spans_of_long_texts_equal_a_plain_scan(spark):
    r, patterns = random.Random(4), {"assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), "access": ("AKIA[A-Z0-9]+", 0, 20), "hex": ("[0-9a-f]+", 0, 24)}
    bits = ["Secret: ", "token=", "é😀", "AKIA", "0f" * 13, "ABCDEFGH12345678", "abc", " ", "\n", "pass word"]
    texts = ["".join(r.choice(bits) for _ in range(n)) for n in (0, 5, 60, 300, 9000)]
    versions = frame(spark, list(enumerate(texts)), "path long, text string")
    got = {x.path: [(s.kind, s.start, s.end) for s in x.spans] for x in findings(versions, scan_unseen(versions)).collect()}
    for i, text in enumerate(texts):
        spans = [(m.start(), k, kind, m.end()) for k, (kind, (p, group, least)) in enumerate(patterns.items()) for m in re.finditer(p, text) if len(m.group(group)) >= least]
        assert got[i] == [(kind, a, b) for a, _, kind, b in sorted(spans)]
