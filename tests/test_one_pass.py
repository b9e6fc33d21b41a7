"""Steps that work within a row: equal to the joins that serve other keys, and without a shuffle."""

import random

from pyspark.sql import functions as F

from gneiss.operators import chunking as C
from gneiss.operators import concepts as K
from gneiss.operators import lexical as L
from gneiss.operators import nearest as N
from gneiss.plans.text import hash_embedding

WORDS = "River river's banks, The the of. Zeta-9 café! it's 42. harbour_master x (Then) KELVIN".split()


def texts(spark, seed):
    r = random.Random(seed)
    rows = [(d, None if d == 2 else "" if d == 3 else " ".join(r.choice(WORDS) for _ in range(r.randint(1, 150)))) for d in range(30)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_summaries_are_made_in_rows_and_equal_the_joins(spark):
    docs = texts(spark, 1).localCheckpoint()
    got = C.summaries(docs, ["doc_id"])
    assert exchanges(got) == 0
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, C._summaries_by_joins(docs, ["doc_id"], 4, 900).collect()))
    twice = docs.unionByName(docs.withColumn("doc_id", F.lit(5).cast("long")))
    assert sorted(map(tuple, C.summaries(twice, ["doc_id"]).collect())) == sorted(map(tuple, C._summaries_by_joins(twice, ["doc_id"], 4, 900).collect()))


def test_lexical_hits_are_found_in_rows_and_equal_the_joins(spark, monkeypatch):
    docs = texts(spark, 2).localCheckpoint()
    queries = spark.createDataFrame([(1, "river x river"), (2, "the of"), (3, "harbour_master 9 caf"), (None, "zeta-9 it")], "query_id long, text string")
    monkeypatch.setattr(L, "KEPT_RUNS", 3)
    got = L.lexical_hits(docs, ["doc_id"], queries)
    assert exchanges(got) == 0
    rows = lambda df: sorted(map(tuple, df.select("query_id", "doc_id", "score").collect()), key=str)
    want = rows(L._hits_by_joins(docs, ["doc_id"], L.query_terms(queries)))
    assert rows(got) == want and len(want) > 40
    best = lambda hits: sorted({h for q in {h[0] for h in hits} for h in sorted((x for x in hits if x[0] == q), key=lambda x: (-x[2], x[1]))[:3]}, key=str)
    few = rows(L.lexical_hits(docs, ["doc_id"], queries, 3))
    assert best(few) == best(want) and len(few) < len(want)
    twice = docs.unionByName(docs)
    assert rows(L.lexical_hits(twice, ["doc_id"], queries)) == rows(L._hits_by_joins(twice, ["doc_id"], L.query_terms(queries)))


def test_nearest_holds_few_scores_at_once(spark, monkeypatch):
    docs = texts(spark, 3).withColumn("text", F.coalesce("text", F.lit(""))).localCheckpoint()
    asked = docs.select(F.col("doc_id").alias("query_id"), "text")
    kept = {"doc_id": docs.schema["doc_id"].dataType}

    def best():
        found = N.nearest(docs, kept, N.text_vectors, asked, 4)
        return sorted({(q, tuple(sorted(((-x.score, x.doc_id) for x in found.where(F.col("query_id") == q).collect()))[:4])) for q in (0, 7)})

    want = best()
    monkeypatch.setattr(N, "CELLS", 60)
    assert best() == want


def test_hashed_dimensions_are_counted_in_rows(spark, tmp_path):
    texts(spark, 4).write.parquet(str(tmp_path / "documents.parquet"))
    got = hash_embedding(spark, str(tmp_path))
    assert exchanges(got) == 0 and {x.doc_id for x in got.collect()} == set(range(30)) - {2, 3}
    assert all(abs(x.s - 1) < 1e-6 for x in got.groupBy("doc_id").agg(F.sum(F.col("value") * F.col("value")).alias("s")).collect())


def test_counts_by_chunk_equal_distinct_counts(spark):
    chunks = texts(spark, 5).select("doc_id", F.lit(0).alias("chunk_index"), "text")
    phrases = K.candidate_phrases(chunks.unionByName(chunks.withColumn("chunk_index", F.lit(1)))).localCheckpoint()
    for keys in ([], ["doc_id"]):
        got = K.merged(phrases, *keys, apart=True)
        assert "Expand" not in got._jdf.queryExecution().optimizedPlan().toString()
        want = K.merged(phrases, *keys)
        rows = lambda df: sorted(map(tuple, df.select(*want.columns).collect()))
        assert rows(got) == rows(want) and want.count() > 20
