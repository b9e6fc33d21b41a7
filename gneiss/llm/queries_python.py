"""Queries of the operators that run numpy inside tasks."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_fold, table, written
from .direct_codes import read_codes, word_encoder, write_codes
from .media import as_media, tiles
from .packing import pack, word_count
from .phrase_index import benchmark_hits
from .personal import learn, personal_spans
from .prefix_trie import hashed_turns, prefix_nodes, rebuilt
from .quality import score_quality
from .tagger import KINDS
from .treap import ranked

END_ID = 2


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = table(spark, sf_dir, "documents").select("doc_id", word_count(F.col("text")).alias("n_tokens"))
    return pack(lengths)


def op4_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def encoder():
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers

        return word_encoder(public_tokenizers.path("word_bpe_49k.json"))

    segments = write_codes(table(spark, sf_dir, "documents"), encoder, END_ID)
    return read_codes(segments, lambda ids: zlib.crc32(ids.astype("<u4").tobytes())).withColumnRenamed("digest", "ids_crc32")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


OP6_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents
),
item_words AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark
),
windows AS (
  SELECT DISTINCT item_id, w[i + 1 : i + 10] AS win, least(10, len(w)) AS n FROM item_words, unnest(range(greatest(1, len(w) - 9))) r(i) WHERE len(w) > 0
),
doc_windows AS (
  SELECT doc_id, i, n, w[i + 1 : i + n] AS win FROM doc_words, (SELECT DISTINCT n FROM windows) s, unnest(range(greatest(0, len(w) - n + 1))) r(i)
),
found AS (SELECT doc_id, item_id, i, n FROM doc_windows JOIN windows USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = written(as_media(table(spark, sf_dir, "documents")), {"compression": "zstd", "parquet.block.size": str(32 << 20)})
    shown = tiles(stored).select(
        F.col("media_id").alias("doc_id"), "n_bytes", F.octet_length("pixels").cast("long").alias("payload_bytes"), F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.substring("pixels", -32, 32)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", "dhash", F.hex(F.crc32("tile"))).alias("feature"), "tile",
    )
    return written(shown, {"compression": "zstd"}).drop("tile")


LABEL_FOLDS, THRESHOLD = 5, 0.3


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_ids of good quality in the folds that labels may be learnt from."""
    labels = table(spark, sf_dir, "labels")
    return labels.where((F.col("quality") == 1) & (id_fold(F.col("doc_id"), LABEL_FOLDS) != 0)).select("doc_id")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(table(spark, sf_dir, "documents"), trusted(spark, sf_dir))
    return scored.select("doc_id", (id_fold(F.col("doc_id"), LABEL_FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents
),
q AS (
  SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '')) AS t FROM benchmark
),
totals AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
tf AS (SELECT doc_id, m, t, count(*) AS tf FROM (SELECT doc_id, 50 + ((50 * len(w) * n) // l) AS m, unnest(w) AS t FROM d, totals WHERE len(w) > 0) GROUP BY ALL),
weight AS (SELECT t, floor(1000 * ln((2 * n + 2) / (2 * df + 1)))::BIGINT AS wt FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), totals),
scores AS (
  SELECT item_id, doc_id, sum(wt * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN tf USING (t) JOIN weight USING (t) GROUP BY item_id, doc_id
),
numbered AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT * FROM numbered WHERE rank <= 50
"""


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_nodes(rebuilt(hashed_turns(table(spark, sf_dir, "conversations"))))


OP11_SQL = r"""
WITH crc_table AS (
  SELECT list(list_reduce([i] || range(1, 9), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)
),
ids AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
         xor(list_reduce([4294967295] || list_transform(range(octet_length(encode(conv_id::VARCHAR))), lambda k: ('0x' || hex(encode(conv_id::VARCHAR))[2 * k + 1 : 2 * k + 2])::BIGINT),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), crc_table
),
turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS t,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL
),
placed AS (
  SELECT i.conv_id, pos AS p, 0 AS part, t, words FROM ids i JOIN turns ON turns.conv_id = base AND pos <= h
  UNION ALL SELECT i.conv_id, pos, 1, t, words FROM ids i JOIN turns ON turns.conv_id = i.conv_id AND pos > h
),
ordered AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, p) AS d, sha256(t) AS t, words FROM placed),
paths AS (
  SELECT conv_id, d, sha256(string_agg(t, '') OVER (PARTITION BY conv_id ORDER BY d)) AS node, words FROM ordered
  UNION ALL SELECT conv_id, 0, 'root', 0 FROM ids
),
lengths AS (SELECT conv_id, max(d) AS n FROM paths GROUP BY conv_id),
nodes AS (SELECT d, node, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM paths GROUP BY d, node),
up AS (SELECT c.d, c.node, p.node AS parent FROM nodes c JOIN paths p ON p.conv_id = c.conv_id AND p.d = c.d - 1),
kids AS (SELECT d - 1 AS d, parent AS node, count(*) AS n_children FROM up GROUP BY ALL),
ends AS (SELECT d, node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS e FROM paths JOIN lengths USING (conv_id) WHERE d = n GROUP BY d, node),
below AS (
  SELECT p.d, p.node, sum((u.n_convs - 1) * u.words)::BIGINT AS saved_tokens, count(*) FILTER (k.n_children IS NULL) AS n_leaves
  FROM nodes u JOIN paths p ON p.conv_id = u.conv_id AND p.d <= u.d LEFT JOIN kids k ON k.d = u.d AND k.node = u.node GROUP BY p.d, p.node
)
SELECT n.conv_id, n.d AS depth, pn.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, coalesce(e, sha256('')) AS ends_sha256
FROM nodes n JOIN below USING (d, node) LEFT JOIN kids USING (d, node) LEFT JOIN ends USING (d, node) LEFT JOIN up USING (d, node)
LEFT JOIN nodes pn ON pn.d = n.d - 1 AND pn.node = up.parent
"""


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = personal_spans(docs, learn(docs))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", *map(n, KINDS), F.sha2(shown(F.col("base")).cast("binary"), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
