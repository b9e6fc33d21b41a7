"""Concept inventories against a plain version of their rules."""

import random
import re

from gneiss.operators import concepts as C
from gneiss.operators.admission import GENERIC


def norm(s):
    return re.sub(r"\s+", " ", re.sub("[-_/]", " ", s.lower())).strip()


def plain_phrases(chunks, most):
    out = []
    for d, c, text in chunks:
        for k, s in enumerate(x.strip() for x in re.split(r"(?<=[.!?])\s+|\n+", text or "") if x.strip()):
            t = list(re.finditer(r"[A-Za-z][A-Za-z0-9]*(?:['’]s)?(?:/[A-Za-z0-9]+)*", s))
            low = [m[0].lower() for m in t]
            stop = [w in C.STOPS or "'" in w for w in low]
            gap = [s[t[i - 1].end() : t[i].start()] if i else "" for i in range(len(t))]
            for i in range(len(t)):
                for n in range(2, most + 1):
                    if i + n > len(t) or stop[i]:
                        continue
                    run = not any(stop[i : i + n]) and not any(re.search(r"""[.!?;:,()"']""", g) for g in gap[i + 1 : i + n])
                    j = i
                    while j + 2 < len(t) and low[j + 1] in ("of", "per") and not stop[j + 2]:
                        j += 2
                    whole = not (j + 1 < len(t) and low[j + 1] in ("of", "per"))
                    if run or (whole and n % 2 and n - 1 <= j - i and all(w in ("of", "per") for w in low[i + 1 : i + n : 2])):
                        surface = s[t[i].start() : t[i + n - 1].end()]
                        out.append((d, c, k, i, n, surface, norm(surface)))
    return out


def acts(w):
    known = lambda x: x in C.VERBS or x + "e" in C.VERBS
    return w in C.VERBS or any(w.endswith(e) and len(w) > len(e) + 3 and known(w[: -len(e)]) for e in ("ed", "es", "s"))


def plain_inventory(chunks, summary, budget):
    found = {}
    for d, c, k, i, n, surface, concept in plain_phrases(chunks, 3):
        found.setdefault((d, concept), []).append((c, k, i, n, surface))
    kept = {}
    for (d, concept), rows in found.items():
        w = concept.split()
        hyphens = any(re.fullmatch(r"[A-Za-z0-9'’]+(-[A-Za-z0-9'’]+)+", r[4]) for r in rows)
        bad = any(map(acts, w)) and not (len(w) == 2 and w[-1] in C.VERBS and not acts(w[0]) and w[0] not in C.WEAK)
        gerund = re.match(r"(.{3,})ing$", w[0])
        bad |= bool(len(w) >= 3 and gerund and (gerund[1] in C.VERBS or gerund[1] + "e" in C.VERBS))
        if w[-1] not in GENERIC and w[0] not in C.WEAK and (hyphens or not bad):
            kept[d, concept] = rows
    out = []
    for (d, concept), rows in kept.items():
        w = concept.split()
        if rows[0][3] == 2:
            longer = sorted(o for (e, o), r in kept.items() if e == d and r[0][3] == 3 and " of " not in o and " per " not in o and f" {concept} " in f" {o} ")
            if longer:
                spans = [(c, k, i) for c, k, i, _, _ in kept[d, longer[0]]]
                if all((c, k, i) in spans or (c, k, i - 1) in spans for c, k, i, _, _ in rows):
                    continue
        if not any(map(acts, w)):
            weak = sum(x in C.WEAK for x in w)
            out.append((d, (len(rows), len({r[0] for r in rows}), round((len(w) - weak) / len(w), 3), rows[0][3], concept in norm(summary.get(d) or ""), -weak), concept, min(rows)[4]))
    ranked = {}
    for d, score, concept, surface in out:
        ranked.setdefault(d, []).append((score, concept, surface))
    return {d: sorted(((s, c) for s, c, _ in rows), reverse=True) for d, rows in ranked.items()}, budget


def test_phrases_and_inventory_equal_a_plain_version(spark):
    r = random.Random(8)
    words = "working memory load of per the new model Store graph-based index e/f learner's using runs replay session data deep net Alpha alpha beta gamma delta".split()
    make = lambda n: " ".join(r.choice(words) + r.choice(["", "", "", "", ".", ",", "-x", "\n"]) for _ in range(n))
    chunks = [(d, c, make(r.choice([0, 3, 40]))) for d in range(25) for c in range(3)] + [(90, 0, None), (91, 0, ""), (92, 0, "One of. Rate of change of state of mind")]
    df = spark.createDataFrame(chunks, "doc_id long, chunk_index int, text string")
    got = sorted((x.doc_id, x.chunk_index, x.sentence, x.place, x.n_tokens, x.surface, x.concept) for x in C.candidate_phrases(df).collect())
    assert got == sorted(plain_phrases(chunks, 5)) and (92, 0, 1, 0, 5, "Rate of change of state", "rate of change of state") in got
    summary = {d: make(20) for d in range(0, 25, 2)}
    said = spark.createDataFrame(list(summary.items()), "doc_id long, summary string")
    inventory = C.inventory(df, said)
    rows = {}
    for x in inventory.collect():
        rows.setdefault(x.doc_id, []).append(x)
    want, budget = plain_inventory(chunks, summary, 8)
    assert set(rows) == {d for d, w in want.items() if w}
    for d, xs in rows.items():
        xs.sort(key=lambda x: x.rank)
        scores = {c: s for s, c in want[d]}
        assert [scores[x.concept] for x in xs] == [s for s, _ in want[d]][:budget] and [x.rank for x in xs] == list(range(len(xs)))
        assert all((x.occurrences, x.chunks) == scores[x.concept][:2] for x in xs)
    texts = {x.doc_id: x.text for x in C.enriched(said, inventory).collect()}
    assert all(t.startswith("[DOCUMENT SUMMARY]\n") and len(t) <= len(summary[d]) + 240 for d, t in texts.items()) and C.inventory(df.limit(0)).count() == 0
    both = {x.concept: (x.occurrences, x.chunks) for x in C.merged(C.candidate_phrases(df)).collect()}
    for concept in list(both)[:50]:
        held = [p for p in plain_phrases(chunks, 5) if p[6] == concept]
        assert both[concept] == (len(held), len({p[:2] for p in held}))


def test_contractions_equal_a_plain_version(spark, monkeypatch):
    from gneiss.operators import contractions as X

    r = random.Random(5)
    words = ["red", "Gate", "north", "co-op", "x1"]
    names = [(d, " ".join(r.choice(words) for _ in range(r.randint(1, 5))), r.choice(["A", "B"])) for d in range(12) for _ in range(14)] + [(50, None, "A"), (50, "?!", "A"), (51, "a b c d e f g h i j k l", "A"), (51, "a d l", "A"), (51, "a b", "A"), (51, "l a", "A")]
    df = spark.createDataFrame(names, "doc_id long, surface string, type string")

    def tokens(s):
        return re.findall(r"[a-z0-9][a-z0-9\-]*", (s or "").lower())

    def plain(d, s, kind):
        st, found = tokens(s), {}
        for e, other, k in {(e, o or "", k) for e, o, k in names}:
            lt = tokens(other)
            if e != d or k != kind or not st or len(st) >= len(lt):
                continue
            it = iter(lt)
            if lt[: len(st)] == st:
                found[other] = X.PREFIX
            elif len(st) >= 2 and st[0] == lt[0] and st[-1] == lt[-1] and all(w in it for w in st):
                found[other] = X.ELISION
        one = len(found) == 1
        return (d, s, kind, "SAME_ENTITY" if one else "ABSTAIN", *(next(iter(found.items())) if one else (None, None)), sorted(found))

    want = sorted((plain(d, s, k) for d, s, k in {(d, s or "", k) for d, s, k in names}), key=str)
    for inner in (8, 1):
        monkeypatch.setattr(X, "INNER", inner)
        assert sorted(map(tuple, X.resolved(df).collect()), key=str) == want
