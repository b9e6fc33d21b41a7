"""K2-treap search, prefix tries and personal data against plain versions, with edge cases."""

import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.llm import personal, prefix_trie, tagger, treap
from gneiss.llm.queries_python import op11_prefix_trie, op12_personal_data

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_ranks(docs, items, limit):
    terms = [(d, TERM.findall(lower(t))) for d, t in docs]
    terms = [(d, w) for d, w in terms if w]
    n, total = len(terms), sum(len(w) for _, w in terms)
    df = {}
    for _, w in terms:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        scores = []
        for d, w in terms:
            m = 50 + (50 * len(w) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((1000000000 * w.count(x)) // (1000 * w.count(x) + 20 * m)) for x in set(TERM.findall(lower(text))) & set(w))
            if s > 0:
                scores.append((-s, d is not None, d or 0, d))
        out += [(item, k, x[3], -x[0]) for k, x in enumerate(sorted(scores)[:limit], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("segment,wave", [(40, 1), (1_000_000, 256)])
def test_ranked_search_equals_plain_scores(spark, monkeypatch, segment, wave):
    monkeypatch.setattr(treap, "SEGMENT_POSTINGS", segment)
    monkeypatch.setattr(treap, "WAVE", wave)
    r = np.random.default_rng(3)
    text = lambda k: " ".join(f"W{int(x)}" for x in r.zipf(1.4, k) % 60)
    docs = [(i, text(int(r.integers(1, 40)))) for i in range(150)] + [(200 + i, "w1 w2 w3 é1") for i in range(30)] + [(400, None), (401, ""), (402, " ,. "), (None, "w1 w2 w3 é1"), (7, "w9 w9")]
    items = [(i, text(6)) for i in range(6)] + [(10, None), (11, ""), (12, "nowhere"), (13, "É1 é1 w3")]
    d = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, rank string").repartition(3)
    got = treap.ranked(d, spark.createDataFrame(items, "item_id long, text string"), 5)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_ranks(docs, items, 5)


def test_ranked_search_in_blocks_and_on_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c"), (2, "b c d")], "doc_id long, text string")
    i = spark.createDataFrame([(1, "a b"), (2, "d")], "item_id long, text string")
    assert sorted(map(tuple, treap.ranked(d, i, block_words=1).collect())) == sorted(map(tuple, treap.ranked(d, i).collect()))
    assert treap.ranked(d.limit(0), i).count() == treap.ranked(d, i.limit(0)).count() == treap.ranked(d.where("doc_id < 0"), i).count() == 0


def test_quadtree_gives_each_cell_and_maxima(spark):
    r = np.random.default_rng(1)
    cells = sorted({(int(a), int(b)) for a, b in r.integers(0, 13, (40, 2))})
    rows, columns = (np.array(x, np.int64) for x in zip(*cells))
    values = r.integers(1, 900, len(cells))
    masks, drops, top = treap.build(rows, columns, values, 4)
    t = treap.Treap(masks, drops, top, np.arange(13))
    for row in range(13):
        want = {c: int(v) for (a, c), v in zip(cells, values) if a == row}
        assert dict(t.best(np.array([row]), np.array([1]), 13, 1)) == want


def plain_trie(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    out = []
    for p, members in nodes.items():
        under = [q for q in nodes if q[: len(p)] == p]
        ends = sorted(c for c in members if len(convs[c]) == len(p))
        out.append((
            min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), sum(len(q) == len(p) + 1 for q in under), sum(not any(len(z) == len(q) + 1 and z[: len(q)] == q for z in nodes) for q in under),
            sum((len(nodes[q]) - 1) * words(q) for q in under), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def rebuilt(rows):
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return {c: own.get(c - c % 20, [])[: h[c]] + own[c][h[c] :] for c in own}


def test_prefix_trie_equals_plain_trie(spark, tmp_path):
    r = np.random.default_rng(5)
    # nested prefixes, copies, a long conversation, conversations without a base and without turns of their own
    rows = [(c, t, "user", f"say {int(r.integers(0, 2))}") for c in range(0, 90) for t in range(int(r.integers(1, 9)))]
    rows += [(100 + c, t, "a", f"same {t}") for c in range(12) for t in range(c + 1)] + [(300, t, None, f"long {t}") for t in range(70)] + [(301, t, None, f"long {t}") for t in range(65)]
    rows += [(205, 0, "user", "alone"), (320, None, "system", None), (320, 1, None, ""), (None, 0, "user", "none")]
    spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, node int").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = op11_prefix_trie(spark, str(tmp_path))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_trie(rebuilt(rows))


def test_prefix_trie_of_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_nodes(prefix_trie.rebuilt(prefix_trie.hashed_turns(none))).count() == 0


def test_fattest_number_of_an_interval(spark):
    pairs = [(a, b) for a in range(20) for b in range(a + 1, 40)]
    got = spark.createDataFrame(pairs, "a int, b int").select("a", "b", prefix_trie.fattest(F.col("a"), F.col("b")).alias("f")).collect()
    assert all(r.f == max(range(r.a + 1, r.b + 1), key=lambda x: x & -x) for r in got)


def test_crf_sums_best_path_and_gradient_equal_all_paths():
    r = np.random.default_rng(0)
    m = tagger.Tagger.new(3, 1)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x, y = r.integers(0, tagger.CLASSES, (2, 4)), np.array([[0, 1, 2, 0], [3, 4, 0, 7]])
    scores = m.scores(x)
    marginals, _, log_z = m.posteriors(scores)
    for k in range(2):
        paths = list(itertools.product(range(tagger.TAGS), repeat=4))
        sums = np.array([sum(scores[k, t, a] for t, a in enumerate(p)) + sum(m.p["trans"][a, b] for a, b in zip(p, p[1:])) for p in paths])
        assert np.isclose(np.log(np.exp(sums).sum()), log_z[k])
        assert tuple(m.best_paths(scores)[k]) == paths[int(sums.argmax())]
        share = np.exp(sums - log_z[k])
        assert np.isclose(sum(s for s, p in zip(share, paths) if p[2] == 1), marginals[k, 2, 1])
    _, grad = m.loss(x, y)
    for name, at in (("wx", (0, x[0, 0], 1)), ("wx", (1, x[1, 2], 8)), ("wh", (0, 1, 5)), ("wh", (1, 2, 10)), ("wo", (4, 3)), ("bo", (6,)), ("trans", (1, 2))):
        kept, e = m.p[name][at], 1e-5
        m.p[name][at] = kept + e
        high = m.loss(x, y)[0]
        m.p[name][at] = kept - e
        low = m.loss(x, y)[0]
        m.p[name][at] = kept
        assert np.isclose((high - low) / (2 * e), grad[name][at], atol=1e-7)


def plain_base(text):
    out = []
    for k, (kind, p) in enumerate(zip(tagger.KINDS, (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([ -]?[0-9])+", r"\+[0-9][ ().0-9-]+[0-9]"))):
        for m in re.finditer(p, text or ""):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            luhn = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
            if (True, kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), 14 <= len(digits) <= 19 and luhn, 10 <= len(digits) <= 15)[k]:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def card(r):
    d = [int(x) for x in r.integers(0, 10, 15)]
    total = sum(sum(divmod(2 * x, 10)) if i % 2 == 0 else x for i, x in enumerate(reversed(d)))
    return "".join(map(str, d)) + str(-total % 10)


def test_personal_data_keeps_base_spans_and_adds_found_ones(spark, tmp_path):
    r = np.random.default_rng(9)
    said = lambda: " ".join("".join(chr(97 + int(c)) for c in r.integers(0, 26, int(r.integers(2, 9)))) for _ in range(int(r.integers(6, 14))))
    value = lambda: (f"{said()[:4].strip()}.{int(r.integers(0, 99))}@mail{int(r.integers(0, 9))}.example.com", ".".join(str(int(x)) for x in r.integers(0, 256, 4)), card(r), f"+1 ({int(r.integers(100, 999))}) 555-{int(r.integers(1000, 9999))}")[int(r.integers(0, 4))]
    docs = [(i, f"{said()} {value()} {said()}, n {int(r.integers(0, 10**6))} {said()}") for i in range(500)]
    glued = [(1000 + i, f"{said()} +1 (826) 555-{1000 + i} 190.137.223.{10 + i} {said()}") for i in range(10)]
    edge = [(2000, None), (2001, ""), (2002, "é" * 5000 + " a@b.co " + "x" * 5000), (2003, "999.1.1.1 256.0.0.1 0001.2.3.4 +1 2"), (2003, "999.1.1.1 256.0.0.1 0001.2.3.4 +1 2"), (None, "x@y.zz"), (2004, "clean words only")]
    rows = docs + glued + edge
    spark.createDataFrame([(*x, "s") for x in rows], "doc_id long, text string, spans string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = op12_personal_data(spark, str(tmp_path)).collect()
    base = {d: plain_base(t) for d, t in rows}
    assert len(got) == len(rows)
    for x in got:
        assert x.base_sha256 == hashlib.sha256(",".join(base[x.doc_id]).encode()).hexdigest()
        assert set(base[x.doc_id]) <= set(filter(None, x.spans.split(",")))
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(s.startswith(k) for s in base[x.doc_id]) for k in tagger.KINDS]
    # phones that the pattern joins to what follows are found by the tagger
    more = {x.doc_id: x.spans for x in got}
    assert sum("phone:" in more[d] for d, _ in glued) >= 8
    assert more[2004] == more[2001] == more[2000] == ""


def test_tagger_finds_held_out_spans(spark):
    r = np.random.default_rng(2)
    make = lambda i: f"call {'abcdefg'[i % 7] * 3} at +1 ({int(r.integers(100, 999))}) 555-{int(r.integers(1000, 9999))} or write no {int(r.integers(0, 99999))} soon"
    model = personal.learn(spark.createDataFrame([(make(i),) for i in range(400)], "text string"))
    held = [make(i) for i in range(60)]
    found = personal.decode(model, [t[a:b] for t in held for a, b in personal.windows(t)][: len(held)])
    assert sum(any(s[1] == 3 for s in f) for f in found) >= 0.9 * len(found)
    assert personal.learn(spark.createDataFrame([("no digits",)], "text string")) is None


def test_reconciled_spans_do_not_overlap_and_heal_cuts():
    text = "mail bob.smith@example.com now"
    pieces = [(5, 0, 15, 0.9, False, True), (10, 0, 26, 0.8, True, False)]
    assert personal.reconciled(pieces, [], text) == [(5, 0, 26)]
    assert personal.reconciled(pieces, [(5, 0, 26)], text) == []
    assert personal.reconciled([(5, 0, 26, 0.3, False, False)], [], text) == []
