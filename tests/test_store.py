"""Versioned tables: superseding, replays, failures, conflicts, snapshots, claims."""

import random

import pytest
from pyspark.sql import functions as F

from gneiss.operators import store as V
from gneiss.operators.discourse import antecedents

KV = "k long, v string"


def table(df):
    return sorted(((r.k, r.v) for r in df.collect()), key=str)


def test_upserts_equal_a_dictionary(spark, tmp_path):
    s, r, want = V.Store(spark, f"file://{tmp_path}/s", buckets=4), random.Random(1), {}
    for n in range(5):
        rows = {r.randrange(30): f"v{n}" for _ in range(8)}
        want |= rows
        version = s.commit(f"load-{n}", {"t": V.upsert(spark.createDataFrame(list(rows.items()), KV), "k")}, {"n": n})
        assert version == n + 1 and table(s.read("t")) == sorted(want.items(), key=str)
        if n == 2:
            third = dict(want)
        # the same attempt again, with other rows even, changes nothing
        assert s.commit(f"load-{n}", {"t": V.upsert(spark.createDataFrame([(1, "other")], KV), "k")}) == version
    assert table(s.read("t", 3)) == sorted(third.items(), key=str)
    assert [(x.version, x.attempt, x.receipt) for x in s.receipts().collect()] == [(n + 1, f"load-{n}", f'{{"n": {n}}}') for n in range(5)]
    assert s.commit("nothing", {"t": V.upsert(spark.createDataFrame([], KV), "k")}) == 6 and table(s.read("t")) == sorted(want.items(), key=str)


def test_groups_are_replaced_and_null_keys_stay(spark, tmp_path):
    s = V.Store(spark, f"file://{tmp_path}/s", buckets=3)
    s.commit("a", {"t": V.upsert(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "n")], KV), "k")})
    s.commit("b", {"t": V.upsert(spark.createDataFrame([(1, "x"), (None, "m")], KV), "k")})
    assert table(s.read("t")) == sorted([(1, "x"), (2, "c"), (None, "m"), (None, "n")], key=str)


def test_only_touched_buckets_are_written(spark, tmp_path):
    s = V.Store(spark, f"file://{tmp_path}/s", buckets=8)
    s.commit("a", {"t": V.upsert(spark.range(100).select(F.col("id").alias("k"), F.lit("a").alias("v")), "k")})
    s.commit("b", {"t": V.upsert(spark.createDataFrame([(5, "b")], KV), "k")})
    one, two = (s.manifest(n)["tables"]["t"]["buckets"] for n in (1, 2))
    assert sum(one[b] != two[b] for b in one) == 1 and len(one) == 8


def test_a_failed_commit_is_never_seen_and_can_be_run_again(spark, tmp_path, monkeypatch):
    s = V.Store(spark, f"file://{tmp_path}/s", buckets=2)
    first = {"t": V.upsert(spark.createDataFrame([(1, "a")], KV), "k"), "u": V.upsert(spark.createDataFrame([(1, "u")], KV), "k")}
    s.commit("a", first)
    second = {"t": V.upsert(spark.createDataFrame([(1, "b")], KV), "k"), "u": V.upsert(spark.createDataFrame([(1, "w")], KV), "k")}
    monkeypatch.setattr(V.Store, "_claimed", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        s.commit("b", second)
    monkeypatch.undo()
    assert table(s.read("t")) == [(1, "a")] and s.committed("b") is None and s.manifest()["version"] == 1
    assert s.commit("b", second) == 2 and table(s.read("t")) == [(1, "b")] and table(s.read("u")) == [(1, "w")]


def test_of_two_writers_the_first_wins(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/s"
    s, other = V.Store(spark, path, buckets=2), V.Store(spark, path, buckets=2)
    change = lambda v: {"t": V.upsert(spark.createDataFrame([(1, v)], KV), "k")}
    s.commit("a", change("a"))
    write = V.Store._write

    def slow(self, *args):
        out = write(self, *args)
        if self is s:
            other.commit("c", change("c"))
        return out

    monkeypatch.setattr(V.Store, "_write", slow)
    with pytest.raises(V.StoreError) as e:
        s.commit("b", change("b"))
    assert e.value.code == "CONFLICT" and table(s.read("t")) == [(1, "c")]
    monkeypatch.undo()
    # a claim of a writer that is gone blocks until it is stale
    (tmp_path / "s/manifests/00000003.claim").write_text("gone")
    with pytest.raises(V.StoreError):
        s.commit("b", change("b"))
    monkeypatch.setattr(V, "STALE_SECONDS", -5)
    assert s.commit("b", change("b")) == 3 and table(s.read("t")) == [(1, "b")]


def test_snapshots_are_refused_once_something_changed(spark, tmp_path):
    s = V.Store(spark, f"file://{tmp_path}/s", buckets=2)
    s.commit("a", {"t": V.upsert(spark.createDataFrame([(1, "a")], KV), "k")})
    taken = s.snapshot({"model": 1})
    s.commit("b", {"t": V.upsert(spark.createDataFrame([(1, "b")], KV), "k")})
    assert s.validated(taken, {"model": 1}) == taken and table(s.read("t", taken.version)) == [(1, "a")]
    with pytest.raises(V.StoreError) as e:
        s.validated(taken, {"model": 2})
    assert e.value.code == "CONFIGURATION_CHANGED"
    name = next((tmp_path / "s/manifests").glob("00000001-*.json"))
    for crc in (tmp_path / "s/manifests").glob(".*.crc"):
        crc.unlink()
    name.write_text(name.read_text().replace('"a"', '"z"'))
    with pytest.raises(V.StoreError) as e:
        s.validated(taken, {"model": 1})
    assert e.value.code == "MANIFEST_CHANGED"
    with pytest.raises(V.StoreError) as e:
        s.read("t", 9)
    assert e.value.code == "VERSION_UNKNOWN" and V.bundle_hash({"b": 1, "a": 2}) == V.bundle_hash({"a": 2, "b": 1})


def test_a_replayed_stream_changes_nothing(spark, tmp_path):
    spark.createDataFrame([(i % 7, f"v{i}") for i in range(20)], KV).repartition(1).write.parquet(f"file://{tmp_path}/in")
    s = V.Store(spark, f"file://{tmp_path}/s", buckets=2)
    calls = []

    def changes(batch):
        calls.append(1)
        return {"t": V.upsert(batch.groupBy("k").agg(F.max("v").alias("v")), "k")}

    for n in range(2):
        V.commit_stream(spark.readStream.schema(KV).parquet(f"file://{tmp_path}/in"), s, "in", changes, f"file://{tmp_path}/state{n}")
    assert len(calls) == 2 and s.manifest()["version"] == 1 and s.read("t").count() == 7 and [x.attempt for x in s.receipts().collect()] == ["in:0"]


def test_claims_follow_the_latest_attempt_and_loss(spark):
    a = spark.createDataFrame([("q", "c", "1", "h1", 1, 1), ("q", "c", "1", "h2", 3, 2), ("q", "c", "2", "h3", 1, 3)], "projection string, kind string, entity string, receipt_hash string, at int, attempt int")
    lost = spark.createDataFrame([("q", "c", "1", 2), ("q", "c", "2", 1)], "projection string, kind string, entity string, at int")
    got = {r.entity: (r.receipt_hash, r.attempts, r.active) for r in V.active_claims(a, lost).collect()}
    assert got == {"1": ("h2", 2, True), "2": ("h3", 1, False)} and V.active_claims(a).where("active").count() == 2


def test_antecedents_equal_a_plain_walk(spark):
    r = random.Random(4)
    names, heads = ["Red Gate", "Blue Gate", "gate", "Acme", "Borg Firm"], ["gate", "acme", "company", "firm", "second gate", "first gate", "fifth gate"]
    entities = [(d, p, n, "Organization" if n in ("Acme", "Borg Firm") else "Thing") for d in range(20) for p, n in ((r.randrange(30), r.choice(names)) for _ in range(r.randint(0, 6)))] + [(3, 1, None, "Thing")]
    asked = [(d, p, f"the {r.choice(heads)}") for d in range(20) for p in r.sample(range(30), 5)] + [(3, 2, None)]
    got = antecedents(spark.createDataFrame(entities, "d long, p int, surface string, type string"), spark.createDataFrame(asked, "d long, p int, mark string"), "d", ["p"])
    want = []
    for d, p, mark in asked:
        if mark is None:
            continue
        head, before = mark.split()[-1], sorted((q, n.lower()) for e, q, n, _ in entities if e == d and n and q < p)
        same = list(dict.fromkeys(n for _, n in before if n.split()[-1] == head))
        nth = {"second": 2, "first": 1, "fifth": 5}.get(mark.split()[1])
        if nth:
            # several names at one place come by name
            want.append((d, p, mark, head, "ORDINAL", int(len(same) >= nth), same[nth - 1] if len(same) >= nth else None))
        elif head in ("company", "firm"):
            orgs = {n.lower() for e, q, n, t in entities if e == d and n and q < p and t == "Organization"}
            want.append((d, p, mark, head, "UNIQUE_ORGANIZATION", len(orgs), *(orgs if len(orgs) == 1 else [None])))
        else:
            want.append((d, p, mark, head, "UNIQUE_HEAD", len(same), same[0] if len(same) == 1 else None))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(d, p, m, h, rule, n, a) for d, p, m, h, rule, n, a in want], key=str)


def test_each_distinct_text_is_encoded_once(spark, tmp_path):
    from gneiss.operators.nearest import hashed
    from gneiss.operators.vector_cache import with_vectors

    s = V.Store(spark, f"file://{tmp_path}/s", buckets=2)
    texts = spark.createDataFrame([(1, "abc def"), (2, "abc def"), (3, None), (4, ""), (5, "xyz")], "i int, text string")
    got = {r.i: (r.text, bytes(r.vector)) for r in with_vectors(texts, s).collect()}
    assert got == {r.i: (r.text, hashed(r.text).astype("<f4").tobytes()) for r in texts.collect()}
    more = texts.unionByName(spark.createDataFrame([(6, "new one")], "i int, text string"))
    assert with_vectors(texts, s).count() == 5 and with_vectors(more, s).count() == 6 and with_vectors(more, s, "other").count() == 6

    def never(texts):
        raise AssertionError("encoded again")

    assert with_vectors(more, s, encode=never).count() == 6 and with_vectors(texts.limit(0), s).count() == 0
    assert [r.receipt.split('"texts": ')[1] for r in s.receipts().collect()] == ["3}", "1}", "4}"]


def test_a_store_keeps_vectors_packed_and_finished_tables_go(spark, tmp_path, monkeypatch):
    import numpy as np

    from gneiss.operators import vector_cache as W

    v = np.array([[0.0, 1.0, -2.5, 3e-9], [7.0, 0.0, 0.0, np.inf]], "<f4")
    assert W.unpacked(W.packed(v)) == [x.tobytes() for x in v]
    gone, s = [], V.Store(spark, f"file://{tmp_path}/s", buckets=2)
    monkeypatch.setattr(W, "forget", lambda *tables: gone.extend(tables))
    texts = spark.createDataFrame([(i, f"river bank {i} and the long way to the harbour {i * i}") for i in range(50)], "i int, text string")
    got = W.with_vectors(texts, s, keep=["i"])
    assert got.columns == ["i", "vector"] and got.count() == 50 and gone[0].written_to
    assert all(len(r.packed) < 512 for r in s.read(next(iter(s.manifest()["tables"]))).collect())
