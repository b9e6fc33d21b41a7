"""Queries of the operators that use DataFrame functions only, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, table
from .line_chunks import remove_repeated_chunks
from .secrets import BASE, findings, update_ledger
from .shards import byte_shards

SHARDS = 40


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_shards(table(spark, sf_dir, "documents"), SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


OP9_SQL = """
WITH bytes AS (SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) + 16 AS size FROM documents),
crc_table AS (
  SELECT list(list_reduce([i] || range(1, 9), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)
),
crc AS (
  SELECT doc_id, xor(list_reduce([4294967295] || list_transform(range(size - 16), lambda k: ('0x' || hex[2 * k + 1 : 2 * k + 2])::BIGINT),
         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM (SELECT doc_id, size, hex(encode(text)) AS hex FROM bytes), crc_table
),
running AS (
  SELECT doc_id, size, text_crc32, sum(size) OVER (ORDER BY doc_id, size, text_crc32 ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total
  FROM bytes JOIN crc USING (doc_id)
),
cut AS (SELECT *, least(39, ((2 * upto - size) * 40) // (2 * total))::INTEGER AS shard FROM running)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY upto, doc_id) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM cut
"""


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    found = findings(versions, update_ledger(shared_folder(spark), versions))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*(r.kind for r in BASE)))
    return found.select(F.col("path").alias("doc_id"), n("assign"), n("access"), n("hex"), F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def _found_sql(kind: str, order: int, pattern: str, group: int, least: int) -> str:
    return f"""
SELECT doc_id, {order} AS ord, '{kind}' AS kind, start, start + length(found) AS stop
FROM (
  SELECT doc_id, found, held, sum(length(gap) + length(found)) OVER (PARTITION BY doc_id ORDER BY k) - length(found) AS start
  FROM (
    SELECT doc_id, unnest(range(len(f))) AS k, unnest(f) AS found, unnest(h) AS held, unnest(g[1:len(f)]) AS gap
    FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}', 0) AS f, regexp_extract_all(text, '{pattern}', {group}) AS h,
                 regexp_split_to_array(text, '{pattern}') AS g FROM documents)
  )
) WHERE length(held) >= {least}"""


_ANY_CASE = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = rf"""({_ANY_CASE})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
OP10_SQL = f"""
WITH spans AS ({_found_sql('assign', 0, _ASSIGN, 2, 6)} UNION ALL {_found_sql('access', 1, 'AKIA[A-Z0-9]+', 0, 20)}
  UNION ALL {_found_sql('hex', 2, '[0-9a-f]+', 0, 24)} UNION ALL {_found_sql('private', 3, '-----BEGIN [A-Z ]*PRIVATE KEY-----', 0, 1)}
  UNION ALL {_found_sql('jwt', 4, 'eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+', 0, 40)} UNION ALL {_found_sql('bearer', 5, '(Bearer\x20+)([A-Za-z0-9._~+/=-]+)', 2, 20)}),
by_doc AS (
  SELECT doc_id, count(*) FILTER (ord = 0) AS a, count(*) FILTER (ord = 1) AS k, count(*) FILTER (ord = 2) AS h,
         string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, ord) FILTER (ord < 3) AS base,
         string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, ord) AS spans
  FROM spans GROUP BY doc_id
)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN by_doc USING (doc_id)
"""


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeated_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), F.col("chunks_removed").cast("long").alias("chunks_removed"))


OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS line, len(l) AS n FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
),
hashed AS (SELECT *, ('0x' || md5(line)[1:15])::BIGINT % 1000003 AS h, len(regexp_extract_all(line, '[^ \t\n\x0B\f\r]+')) AS words FROM lines),
ended AS (
  SELECT *, i = n - 1 OR (i > 0 AND (lag(h) OVER w * 31 + h) % 4 = 0) AS last FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)
),
numbered AS (SELECT *, coalesce(sum(last::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM ended),
chunks AS (SELECT doc_id, c, min(i) AS pos, count(*) AS lines, string_agg(line, chr(10) ORDER BY i) AS chunk FROM numbered GROUP BY doc_id, c),
judged AS (
  SELECT *, lines >= 2 AND regexp_matches(chunk, '\S') AND row_number() OVER (PARTITION BY chunk, lines >= 2 ORDER BY doc_id, pos) > 1 AS goes FROM chunks
),
said AS (SELECT doc_id, i, line, words, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS idx FROM hashed WHERE words > 0),
again AS (SELECT * FROM said WHERE line IN (SELECT line FROM said GROUP BY line HAVING count(*) > 1)),
near AS (
  SELECT *, idx - row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS run, sum(words) OVER (PARTITION BY doc_id ORDER BY idx) AS upto, sum(words) OVER (PARTITION BY doc_id ORDER BY idx) - words AS before FROM again
),
runs AS (
  SELECT doc_id, min(idx) OVER f AS idx, max(idx) OVER f AS stop_idx, min(i) OVER f AS start, max(i) OVER f AS stop, sum(words) OVER f AS w, list(line) OVER f AS said
  FROM near WINDOW f AS (PARTITION BY doc_id, run ORDER BY before RANGE BETWEEN CURRENT ROW AND 50 FOLLOWING)
  UNION SELECT doc_id, min(idx) OVER b, max(idx) OVER b, min(i) OVER b, max(i) OVER b, sum(words) OVER b, list(line) OVER b
  FROM near WINDOW b AS (PARTITION BY doc_id, run ORDER BY upto RANGE BETWEEN 50 PRECEDING AND CURRENT ROW)
),
places AS (
  SELECT *, first_value(doc_id) OVER o AS first_doc, first_value(stop_idx) OVER o AS first_stop FROM runs WHERE w > 50 WINDOW o AS (PARTITION BY said ORDER BY doc_id, idx, stop_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(start, stop + 1)) AS i FROM places WHERE doc_id <> first_doc OR idx > first_stop
  UNION SELECT doc_id, unnest(range(pos, pos + lines)) FROM judged WHERE goes
)
SELECT l.doc_id, sha256(coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '')) AS text_sha256,
       length(coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '')) AS n_chars, count(DISTINCT c) FILTER (g.i IS NOT NULL) AS chunks_removed
FROM numbered l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id
"""
