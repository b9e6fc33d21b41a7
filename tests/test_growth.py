"""Steps whose time, memory or shuffled rows grew faster than the tables."""

import random

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from gneiss.operators import evidence as E
from gneiss.operators import graph as G
from gneiss.operators import reprocess as R
from gneiss.operators import spans as S
from gneiss.operators import trees as T
from gneiss.plans import relations
from gneiss.sources import files


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_provenance_counts_documents_and_segments_without_expanding(spark, tmp_path):
    tables = {
        "lineitem": ([(1, 1, "R", 10), (1, 1, "R", 10), (1, 1, "R", 11), (1, 2, "N", 12), (1, 2, "N", 99), (2, 1, "A", None), (3, 3, "A", 13)], "l_partkey long, l_suppkey long, l_returnflag string, l_orderkey long"),
        "orders": ([(10, "F", 1), (10, "O", 2), (11, "F", 1), (12, None, 3), (13, "O", 4)], "o_orderkey long, o_orderstatus string, o_custkey long"),
        "customer": ([(1, "A"), (2, "B"), (3, None), (4, "A"), (4, "C")], "c_custkey long, c_mktsegment string"),
        "part": ([(1, "one")], "p_partkey long, p_name string"), "supplier": ([(2, "two")], "s_suppkey long, s_name string"),
    }
    con = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = relations.fact_provenance(spark, str(tmp_path))
    assert "Expand" not in plan(got)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, con.sql(relations.FACT_PROVENANCE).fetchall()))


def test_lost_facts_are_not_gathered_in_one_task(spark):
    facts = lambda ids: spark.createDataFrame([(f"f{i}", "p", f"s{i}", "o") for i in ids], "fact string, predicate string, subject string, object string")
    moves = spark.createDataFrame([("x", "y")], "old string, new string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        delta = R.fact_delta(facts(range(200)), facts(range(150, 160)), moves).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len({r.task for r in delta if r.change == "LOST"}) > 1
    assert sum(r.change == "LOST" for r in delta) == 190 and sum(r.change == "KEPT" and r.sources == 1 for r in delta) == 10


def test_inherited_values_are_not_broadcast_by_the_size_of_files(spark):
    nodes = spark.createDataFrame([(g, n, n - 1 if n else None, "v" if n == 0 else None) for g in range(3) for n in range(9)], "g int, n int, up int, v string")
    got = T.inherited(nodes, "g", "n", "up", "v")
    assert "Broadcast" not in plan(got) and got.where("v = 'v'").count() == 27


def test_residue_judges_each_fact_once(spark):
    facts = spark.createDataFrame([("f1", "a", "b"), ("f2", "b", "c"), ("f3", "c", "d"), ("f4", "e", "e")], "fact string, subject string, object string")
    evidence = spark.createDataFrame([("f1", 1), ("f1", 1), ("f2", 1), ("f2", 2), ("f4", 3), ("f4", 1)], "fact string, doc_id long")
    got = G.residue(facts, evidence, spark.createDataFrame([(1,), (1,), (3,)], "doc_id long"))
    assert "Join" not in plan(got)
    assert sorted(map(tuple, got.collect())) == [("entity", "a"), ("entity", "e"), ("fact", "f1"), ("fact", "f4")]


def test_conflicts_are_counted_in_ordered_passes(spark):
    rows = [("f1", "a", "p", "x"), ("f2", "b", "p", "x"), ("f2", "b", "p", "x"), ("f3", "a", "q", "x"), ("f4", "c", "r", "y"), (None, None, "p", "x"), ("f5", "d", None, "x"), ("f6", "e", "r", None)]
    got = G.conflicts(spark.createDataFrame(rows, "fact string, subject string, predicate string, object string"))
    assert "Join" not in plan(got)
    assert sorted(map(tuple, got.select("fact", "subjects", "predicates").collect())) == [("f1", 2, 2), ("f2", 2, 1), ("f2", 2, 1), ("f3", 1, 2)]


def test_excerpts_rank_their_terms_once(spark):
    df = spark.createDataFrame([(1, "\u0130zmir has alpha, longest and alpha again", ["alpha", "longest", None, "abc"]), (2, "plain\0text", []), (3, None, ["alpha"]), (4, "some text", None)], "i int, p string, t array<string>")
    got = df.select("i", E.excerpt(F.col("p"), F.col("t"), 12).alias("e"))
    assert got._jdf.queryExecution().analyzed().toString().count("_rarest_at(") == 1
    assert dict(map(tuple, got.collect())) == {1: "alpha, longest", 2: "plain\0text", 3: None, 4: "some text"}


def test_files_are_read_in_small_runs_of_rows():
    sizes = [10, files.SLICE, 5, 5, 3 * files.SLICE, 0, 7]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(sizes)], ["i", "size"])
    assert [r.column("i").to_pylist() for r in files._slices(batch)] == [[0], [1], [2, 3], [4], [5, 6]]
    assert list(files._slices(batch.slice(0, 0))) == []


def test_contents_of_files_do_not_come_back_from_python(spark):
    df = spark.createDataFrame([("a.txt", b"\xef\xbb\xbfa\r\nb", None), ("b.bin", None, None), ("c.md", b"\xff", None)], "path string, content binary, media_type string")
    got = files.materialized(df)
    assert "MapInPandas" not in plan(got)
    rows = {r.path: (r.status, r.text, r.error) for r in got.collect()}
    assert rows == {"a.txt": ("OK", "a\nb", None), "b.bin": ("FAILED", None, "UNSUPPORTED_FORMAT"), "c.md": ("FAILED", None, "CORRUPTED: UnicodeDecodeError")}


def test_line_candidates_are_made_in_rows_and_equal_the_ordered_passes(spark):
    r = random.Random(4)
    words = ["Ada", "Bob", "cat", " ", "Cat", "and", "the", "\n", "\n\n", "\u00c4rger Eva", "Dan with Dan", "\u2028", "\t\n"]
    rows = [(d, None if d == 3 else " ".join(r.choice(words) for _ in range(r.randint(0, 60)))) for d in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).localCheckpoint()
    trigger, entity = relations.TRIGGER, relations.ENTITY
    got = S.line_candidates(docs, trigger, entity)
    assert "Exchange" not in plan(got) and "Window" not in plan(got)
    lines = S.pieces(docs, r"\n")
    want = S.candidates(*(S.inside(S.marks(docs, p).drop("k"), lines) for p in (trigger, entity)))
    assert got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    twice = docs.unionByName(docs.where("doc_id = 1"))
    assert "Window" in plan(S.line_candidates(twice, trigger, entity))


def test_children_are_found_without_summaries(spark, tmp_path, monkeypatch):
    from gneiss.operators import chunking
    from gneiss.plans import retrieval as Q

    spark.createDataFrame([(d, f"River bank {d}. The harbour of day {d % 3}. Zeta.", "web") for d in range(30)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "river 7"), (2, "harbour zeta")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    made, real = [], chunking.summaries
    monkeypatch.setattr(chunking, "summaries", lambda texts, keys, *a: made.append(keys) or real(texts, keys, *a))
    got = Q.legacy_children(spark, str(tmp_path)).collect()
    assert not made and {r.query_id for r in got} == {1, 2} and all(r.rank < 40 for r in got) and len(got) == 60


def test_profiles_take_the_summaries_of_the_corpus(spark, tmp_path, monkeypatch):
    from gneiss.operators import chunking
    from gneiss.plans import retrieval as Q

    spark.createDataFrame([(d, f"River bank {d}. The harbour of day {d % 3}. Zeta.", "web") for d in range(30)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "river 7"), (2, "harbour zeta")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    made, real = [], chunking.summaries
    monkeypatch.setattr(chunking, "summaries", lambda texts, keys, *a: made.append(tuple(keys)) or real(texts, keys, *a))
    got = Q.legacy_documents(spark, str(tmp_path)).collect()
    assert made.count(("doc_id",)) == 1 and sorted((r.query_id, r["rank"]) for r in got) == [(q, n) for q in (1, 2) for n in range(10)]
