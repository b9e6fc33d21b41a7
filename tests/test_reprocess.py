"""What became of facts, on small cases and against a plain version."""

import random

from gneiss.operators import reprocess as R

FACT = "fact string, predicate string, subject string, object string"


def test_fact_delta_equals_a_plain_version(spark):
    r = random.Random(7)
    fact = lambda p, s, o: (f"{p}.{s}.{o}", p, s, o)
    some = lambda n: [fact(r.choice("pq"), r.choice("abcdef"), r.choice("abcdef")) for _ in range(n)]
    moves = {"a": "b", "c": "b", "e": "x"}
    before = some(40)
    to = lambda x: moves.get(x, x)
    after = [fact(p, to(s), to(o)) for _, p, s, o in before[:25]] + some(6)
    new, old = {f[1:]: f[0] for f in after}, {f[0]: f for f in before}
    come = {}
    for f, p, s, o in old.values():
        come.setdefault(new.get((p, to(s), to(o))), set()).add(f)
    want = [("GAINED", None, f, 0) for f in set(new.values()) if f not in come]
    for f, p, s, o in old.values():
        target = new.get((p, to(s), to(o)))
        n = len(come[target]) if target else 0
        want.append(("LOST" if not target else "KEPT" if (to(s), to(o)) == (s, o) else "MERGED" if n > 1 else "MOVED", f, target, n))
    got = R.fact_delta(spark.createDataFrame(before, FACT), spark.createDataFrame(after, FACT), spark.createDataFrame([*moves.items(), ("b", "b")], "old string, new string"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and {w[0] for w in want} == {"GAINED", "LOST", "KEPT", "MERGED", "MOVED"}
    counts = {x.change: (x.facts, x.targets) for x in R.delta_counts(got).collect()}
    assert all(counts[c][0] == sum(w[0] == c for w in want) for c in counts)


def test_fact_delta_of_empty_tables(spark):
    none, moves = spark.createDataFrame([], FACT), spark.createDataFrame([], "old string, new string")
    one = spark.createDataFrame([("f", "p", "a", None)] * 2, FACT)
    assert R.fact_delta(none, none, moves).count() == 0
    assert [tuple(x) for x in R.fact_delta(one, one, moves).collect()] == [("KEPT", "f", "f", 1)]
