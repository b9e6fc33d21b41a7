"""Line dedup against a plain version of both of its rules, and tables whose column names clash with the operators' own."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gneiss.llm.line_chunks import remove_repeated_chunks
from gneiss.llm.packing import pack

ODD = {"x.y": 1, "__row": 2, "__key": 3, "__salt": 4, "row": 5, "rest": 6, "bucket.a": 7, "`q`": 8}


def plain_lines(docs):
    """{doc_id: (text, chunks that lost lines)} of distinct ids."""
    split = {d: (t or "").split("\n") for d, t in docs}
    h = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:15], 16) % 1_000_003
    words = lambda x: len(re.findall(r"[^ \t\n\x0B\f\r]+", x))
    chunk_of, chunks = {}, {}
    for d, lines in split.items():
        begin = k = 0
        chunk_of[d] = []
        for i, line in enumerate(lines):
            chunk_of[d].append(k)
            if i == len(lines) - 1 or (i and (h(lines[i - 1]) * 31 + h(line)) % 4 == 0):
                part = "\n".join(lines[begin : i + 1])
                if i > begin and words(part):
                    chunks.setdefault(part, []).append((d, begin, i))
                begin, k = i + 1, k + 1
    gone = {d: set() for d in split}
    for places in chunks.values():
        for d, a, b in sorted(places)[1:]:
            gone[d] |= set(range(a, b + 1))
    said = {d: [(i, x) for i, x in enumerate(lines) if words(x)] for d, lines in split.items()}
    counts = {}
    for rows in said.values():
        for _, x in rows:
            counts[x] = counts.get(x, 0) + 1
    runs = {}
    for d, rows in said.items():
        for step in (1, -1):
            for k in range(len(rows)):
                total, j = 0, k
                while 0 <= j < len(rows) and counts[rows[j][1]] > 1 and total <= 50:
                    total += words(rows[j][1])
                    j += step
                if total > 50:
                    a, b = min(k, j - step), max(k, j - step)
                    runs.setdefault(tuple(x for _, x in rows[a : b + 1]), set()).add((d, a, b, rows[a][0], rows[b][0]))
    for places in runs.values():
        d0, _, b0, _, _ = min(places)
        for d, a, _, i, j in places:
            if d != d0 or a > b0:
                gone[d] |= set(range(i, j + 1))
    return {d: ("\n".join(x for i, x in enumerate(lines) if i not in gone[d]), len({chunk_of[d][i] for i in gone[d]})) for d, lines in split.items()}


def test_line_dedup_equals_plain_rules(spark):
    r = np.random.default_rng(4)
    pool = [" ".join(f"w{int(x)}" for x in r.integers(0, 50, int(r.integers(1, 30)))) for _ in range(60)] + ["", "  ", "\x0b"]
    passages = [[pool[int(i)] for i in r.integers(0, len(pool), int(r.integers(3, 12)))] for _ in range(12)]
    docs = []
    for d in range(120):
        lines = []
        for _ in range(int(r.integers(1, 6))):
            lines += passages[int(r.integers(0, 12))][int(r.integers(0, 3)) :] if r.random() < 0.6 else [f"own {d} {int(x)}" for x in r.integers(0, 9, 3)]
        docs.append((d, "\n".join(lines)))
    docs += [(500, None), (501, ""), (502, "\n\n"), (503, docs[3][1]), (504, docs[3][1])]
    got = {x.doc_id: (x.text or "", x.chunks_removed) for x in remove_repeated_chunks(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert got == plain_lines(docs)


def test_line_dedup_equals_plain_rules_on_documents(spark):
    docs = [tuple(x) for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = {x.doc_id: (x.text or "", x.chunks_removed) for x in remove_repeated_chunks(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == plain_lines(docs)


def odd(df):
    return df.select("*", *(F.lit(v).alias(k) for k, v in ODD.items()))


def kept(row):
    return [row[k] for k in ODD] == list(ODD.values())


def test_line_dedup_keeps_columns_of_any_name(spark):
    text = "\n".join(f"line {i} of a chunk" for i in range(12))
    docs = odd(spark.createDataFrame([(1, text), (2, text), (2, "alone"), (None, text)], "doc_id long, text string"))
    out = remove_repeated_chunks(docs)
    assert out.columns == [*docs.columns, "chunks_removed"]
    rows = sorted(out.collect(), key=str)
    assert len(rows) == 4 and all(map(kept, rows)) and sorted(x.doc_id for x in rows if x.text == "") == [1, 2]


def test_packing_keeps_columns_of_any_name(spark):
    rows = odd(spark.createDataFrame([(i, i % 7) for i in range(50)] + [(None, None)], "doc_id long, n_tokens long"))
    out = pack(rows)
    assert out.columns == [*rows.columns, "bucket", "bucket_tokens", "batch", "batch_slot", "padding"]
    assert all(map(kept, out.collect())) and out.count() == 51


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_columns_of_any_name(spark, stage):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120)
    f = corpus_pipeline.STAGES[stage][1]
    plain = f(spark, docs, sf_dir)
    out = f(spark, odd(docs), sf_dir)
    assert out.columns == [*docs.columns, *ODD]
    rows = sorted(out.collect(), key=str)
    assert all(map(kept, rows))
    assert sorted(x.doc_id for x in rows) == sorted(x.doc_id for x in plain.collect())


def test_line_stage_of_the_pipeline_equals_plain_rules(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = plain_lines([(x.doc_id, x.text) for x in docs.collect()])
    got = {x.doc_id: (x.text or "", x.n_chars) for x in corpus_pipeline.unique_chunks(spark, docs, sf_dir).collect()}
    assert got == {d: (t, len(t)) for d, (t, n) in want.items() if not n or re.search(r"\S", t)}
