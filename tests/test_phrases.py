"""Concepts, contractions and counts of phrases made in rows: equal to the joins that serve other keys, without shuffles of phrases."""

import random

import pytest
from pyspark.sql import functions as F

from gneiss.operators import chunking as K
from gneiss.operators import concepts as C
from gneiss.operators import contractions as X
from gneiss.operators import phrases as P
from gneiss.plans import concepts as Q

WORDS = "working memory load of per the new model Store graph-based index e/f learner's using runs replay session data deep net Alpha alpha beta river bank’s x/of a\\b café running rate change state-of-the-art mind_set".split()


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(3)
    make = lambda n: " ".join(r.choice(WORDS) + r.choice(["", "", "", "", "", ".", ",", "-x", "\n", "\x1f", " —", "!", "? Then"]) for _ in range(n))
    rows = [(d, make(r.choice([0, 1, 3, 40, 400, 1500]))) for d in range(40)] + [(90, None), (91, ""), (92, "One of. Rate of change of state of mind"), (93, "Rate of change of"), (94, "a of b. Of c per d")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3).localCheckpoint()


@pytest.fixture(scope="module")
def sf_dir(docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{path}/documents.parquet")
    return path


def own(docs):
    return K.pack_sentences(docs).select("doc_id", "chunk_index", "parent_index", "text")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_document_concepts_are_made_in_rows_and_equal_the_joins(spark, docs, sf_dir):
    assert sorted([(r.doc_id, i, t) for r in docs.collect() for i, t in enumerate(P.chunks_of(r.text))], key=str) == rows(own(docs).select("doc_id", "chunk_index", "text"))
    got = Q.document_concepts(spark, sf_dir)
    assert exchanges(got) == 0
    want = rows(C.inventory(own(docs)))
    assert rows(got) == want and len(want) > 100
    for budget in (1, 30):
        assert rows(P.inventories(docs, budget)) == rows(C.inventory(own(docs), budget=budget))
    said = docs.withColumn("summary", F.lit("Working memory-load, river! new model of change"))
    assert rows(P.inventories(said.withColumn("said", C.normal_concept(F.col("summary"))))) == rows(C.inventory(own(docs), said.drop("text")))


def test_section_concepts_are_made_in_rows_and_equal_the_joins(spark, docs, sf_dir):
    got = Q.section_concepts(spark, sf_dir)
    assert exchanges(got) == 0
    want = rows(C.inventory(own(docs), keys=("doc_id", "parent_index"), budget=6))
    assert rows(got) == want and len({x[:2] for x in want}) > len({x[0] for x in want})


def test_enriched_documents_are_made_in_rows_and_equal_the_joins(spark, docs, sf_dir):
    got = Q.enriched_documents(spark, sf_dir)
    assert exchanges(got) == 0
    first = docs.select("doc_id", F.coalesce(F.get(C.short_sentences(F.col("text")), F.lit(0)), F.lit("")).alias("summary"))
    assert rows(got) == rows(C.enriched(first, C.inventory(own(docs), first)).select("doc_id", "text"))


def test_phrase_contractions_are_made_in_rows_and_equal_the_joins(spark, docs, sf_dir, monkeypatch):
    got = Q.phrase_contractions(spark, sf_dir)
    assert exchanges(got) == 0
    names = C.merged(C.candidate_phrases(own(docs), 4), "doc_id").where("occurrences > 1").select("doc_id", F.col("concept").alias("surface"), F.lit("Phrase").alias("type"))
    want = rows(X.resolved(names).withColumn("candidates", F.array_join("candidates", "|")))
    assert rows(got) == want and any(x[3] == "SAME_ENTITY" for x in want)
    monkeypatch.setattr(X, "INNER", 1)
    surfaces = ["red gate", "red north gate", "red co-op x1 gate", "red x1 gate", "red", "gate red", "red co-op"]
    df = spark.createDataFrame([(1, s, "A") for s in surfaces], "doc_id long, surface string, type string")
    one = lambda x, c, shape: (1, x, "A", *(("SAME_ENTITY", c[0], shape) if len(c) == 1 else ("ABSTAIN", None, None)), c)
    assert sorted((one(*x) for x in P.contractions_of(surfaces)), key=str) == rows(X.resolved(df))


def test_corpus_concepts_are_counted_before_one_shuffle_and_equal_the_joins(spark, docs, sf_dir, monkeypatch):
    got = Q.corpus_concepts(spark, sf_dir)
    assert exchanges(got) == 1
    want = rows(C.merged(C.candidate_phrases(own(docs))).select("concept", "n_tokens", "occurrences", "chunks", "surface"))
    assert rows(got) == want and any(x[2] > x[3] > 1 for x in want)
    few = P.corpus_counts(docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") - 1000)).repartition(7))
    twice = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") - 1000))
    assert rows(few) == rows(C.merged(C.candidate_phrases(own(twice))).select("concept", "n_tokens", "occurrences", "chunks", "surface"))
