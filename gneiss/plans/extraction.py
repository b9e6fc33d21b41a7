"""Queries of extraction: triggers of a rule pack, candidates of sentences, and facts by its rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators import spans as S
from gneiss.operators.rules import compiled, passive, validate_pack
from gneiss.operators.triggers import IRREGULAR, bound_triggers, trigger_spans as found_triggers
from gneiss.session import table

#: A sentence and its end marks; entities are capitalised words and long ones.
SENTENCE, ENTITY = r"[^.!?\n]+[.!?]*", "[A-Z][A-Za-z]{2,}|[a-z]{9,}"
#: Types of entities by their first letters, and the signatures of every third rule.
KINDS = (("Agent", "H"), ("Place", "P"), ("Thing", "Z"))
SIGNATURES = ([("Agent", "Place"), ("Agent", "Thing")], [("Place", "Thing"), ("Place", "Place")], [("Thing", "Agent"), ("Thing", "Thing")])


def _pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark as a dictionary of forty rules: words of five letters and more are verbs or nouns, pairs of words phrases."""
    items = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 40).cast("int").alias("rule"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("w"))
    single = items.select("rule", F.when(F.col("rule") % 2 == 0, "VERB").otherwise("NOUN").alias("kind"), F.explode(F.filter("w", lambda w: F.length(w) >= 5)).alias("phrase"))
    pairs = F.filter(F.zip_with("w", F.slice("w", F.lit(2), F.size("w")), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: (F.length(p["a"]) >= 3) & (F.length(p["b"]) >= 3))
    double = items.where(F.size("w") > 1).select("rule", F.lit("MULTIWORD").alias("kind"), F.explode(F.transform(pairs, lambda p: F.concat_ws(" ", p["a"], p["b"]))).alias("phrase"))
    return single.unionByName(double).distinct().select("rule", F.concat(F.lit("p"), "rule").alias("predicate"), F.concat(F.lit("c"), F.col("rule") % 5).alias("evidence_class"), "kind", "phrase")


def trigger_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every trigger in every document."""
    return found_triggers(table(spark, sf_dir, "documents"), _pack(spark, sf_dir))


def _type(mark: str) -> Column:
    first = F.upper(F.substring(mark, 1, 1))
    return F.when(first <= KINDS[0][1], KINDS[0][0]).when(first <= KINDS[1][1], KINDS[1][0]).otherwise(KINDS[2][0])


def type_of(mark: str) -> str:
    """The same in Python."""
    first = mark[0].upper()
    return next((name for name, last in KINDS[:2] if first <= last), KINDS[2][0])


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """predicate, evidence_class, trigger (a lemma), subject_type, object_type, symmetric."""
    sides = F.array(*(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in s)) for s in SIGNATURES))
    lemma = F.when(F.col("kind") == "MULTIWORD", F.substring_index("phrase", " ", 1)).otherwise(F.col("phrase"))
    rows = _pack(spark, sf_dir).select("rule", "predicate", "evidence_class", lemma.alias("trigger"), F.explode(F.get(sides, F.col("rule") % 3)).alias("s")).distinct()
    return rows.select("predicate", "evidence_class", "trigger", F.col("s.a").alias("subject_type"), F.col("s.b").alias("object_type"), (F.col("rule") % 3 == 1).alias("symmetric"))


def _bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of sentences, with `begin` and `sentence`."""
    docs, pack = table(spark, sf_dir, "documents").select("doc_id", "text"), _pack(spark, sf_dir)
    signatures = _rules(spark, sf_dir).select("evidence_class", "subject_type", "object_type").distinct()
    types = signatures.groupBy("evidence_class").agg(F.sort_array(F.collect_set("subject_type")).alias("a"), F.sort_array(F.collect_set("object_type")).alias("b")).collect()
    met = bound_triggers(docs, pack, SENTENCE, ENTITY, S.joints_in, type_of, {r.evidence_class: (tuple(r.a), tuple(r.b)) for r in types}, S.LIST)
    if met is not None:
        each = met.select("doc_id", "frame", "begin", "sentence", F.explode("triggers").alias("f"))
        own = ("start", "end", "mark", "kind", "lemma", "predicate", "evidence_class", "low", "high")
        t = F.struct("doc_id", "frame", *(F.col(f"f.{c}").alias(c) for c in own), "begin", "sentence")
        return S.paired(each.select(t.alias("t"), F.col("f.left").alias("left"), F.col("f.right").alias("right")), signatures)
    sentences = S.marks(docs, SENTENCE).withColumnRenamed("k", "frame")
    frames = sentences.select("doc_id", "frame", "start", "end")
    found = found_triggers(docs, pack).where("NOT covered").select("doc_id", F.col("span_start").cast("long").alias("start"), F.col("span_end").cast("long").alias("end"), "mark", "kind", "lemma", "predicate", "evidence_class")
    entities = S.inside(S.marks(docs, ENTITY).drop("k"), frames).withColumn("type", _type("mark"))
    triggers = S.regions_of(S.inside(found, frames), docs, frames)
    text = sentences.select("doc_id", "frame", F.col("start").alias("begin"), F.col("mark").alias("sentence"))
    return S.typed_candidates(triggers, entities, signatures).join(text, ["doc_id", "frame"])


def bound_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of typed entities around each trigger of a sentence that no longer one covers, or why there are none."""
    return _bound(spark, sf_dir).select(
        "doc_id", "frame", F.col("start").alias("trigger_start"), F.col("end").alias("trigger_end"), "kind", "lemma", "predicate", "low", "high", "outcome",
        F.col("subject.mark").alias("subject"), F.col("subject.start").alias("subject_start"), F.col("object.mark").alias("object"), F.col("object.start").alias("object_start"),
    )


def compiled_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate with the fact that its predicate's rules make of it, or why they make none."""
    rows = _bound(spark, sf_dir).where("outcome = 'CANDIDATE_CREATED'")
    scope = S.scope(F.col("sentence"), (F.col("start") - F.col("begin")).cast("int"), (F.col("end") - F.col("begin")).cast("int"))
    ready = rows.select(
        F.concat_ws(":", "doc_id", "start", "predicate", "kind", "lemma", F.col("subject.start"), F.col("object.start")).alias("candidate"), "evidence_class", F.col("lemma").alias("trigger"), "predicate",
        F.col("subject.mark").alias("subject"), F.col("subject.type").alias("subject_type"), F.col("object.mark").alias("object"), F.col("object.type").alias("object_type"), scope.alias("scope"), passive(F.col("sentence")).alias("passive"), "sentence",
        F.when(F.length("subject.mark") < 4, "MENTION_ONLY").alias("subject_class"), F.lit(None).cast("string").alias("object_class"),
    )
    q = "qualifiers"
    return compiled(ready, _rules(spark, sf_dir)).select("candidate", "decision", "reason", "predicate", "subject", "object", "year", F.col(f"{q}.certainty").alias("certainty"), F.col(f"{q}.attributed").alias("attributed"), F.col(f"{q}.attribution_source").alias("attribution_source"), F.col(f"{q}.comparison").alias("comparison"), "fact_id")


def pack_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the pack as its rules stand."""
    return validate_pack(_rules(spark, sf_dir))


def _marks_sql(pattern: str, text: str = "coalesce(text, '')") -> str:
    return f"""SELECT doc_id, k, upto - length(mark) AS a, upto AS b, mark FROM (
    SELECT doc_id, k, mark, sum(length(gap) + length(mark)) OVER (PARTITION BY doc_id ORDER BY k) AS upto FROM (
      SELECT doc_id, unnest(range(len(m))) AS k, unnest(m) AS mark, unnest(g[1:len(m)]) AS gap
      FROM (SELECT doc_id, regexp_extract_all({text}, '{pattern}') AS m, regexp_split_to_array({text}, '{pattern}') AS g FROM documents)))"""


_WORD_SQL = r"[\p{L}\p{N}_]+(?:''[\p{L}\p{N}_]+)?"
_IRREGULAR_SQL = ", ".join(f"('{k}', '{v}')" for k, v in IRREGULAR.items())
_FORMS = (
    (0, "true", "phrase"), (2, "phrase LIKE '%y' AND n > 2", "stem || 'ies'"), (3, "phrase LIKE '%e' AND n > 2", "stem || 'ing'"), (4, "n > 1", "phrase || 'ing'"), (5, "phrase LIKE '%e' AND n > 2", "stem || 'ed'"), (6, "n > 1", "phrase || 'ed'"),
    (7, "phrase LIKE '%y' AND n > 1", "stem || 'ied'"), (8, "n > 1", "phrase || phrase[n:n] || 'ed'"), (9, "phrase LIKE '%e' AND n > 2", "stem || 'es'"), (10, "n > 2", "phrase || 's'"),
)
PACK_CTE = f"""
items AS (SELECT (item_id % 40)::INT AS rule, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark),
pack AS (
  SELECT DISTINCT rule, 'p' || rule AS predicate, 'c' || rule % 5 AS evidence_class, kind, phrase FROM (
    SELECT rule, CASE WHEN rule % 2 = 0 THEN 'VERB' ELSE 'NOUN' END AS kind, unnest(list_filter(w, lambda x: length(x) >= 5)) AS phrase FROM items
    UNION ALL SELECT rule, 'MULTIWORD', w[i] || ' ' || w[i + 1] FROM items, unnest(range(1, len(w))) r(i) WHERE length(w[i]) >= 3 AND length(w[i + 1]) >= 3)
),
verbs AS (SELECT *, length(phrase) AS n, phrase[1:length(phrase) - 1] AS stem FROM pack WHERE kind = 'VERB'),
surfaces AS (
  {" UNION ALL ".join(f"SELECT rule, predicate, evidence_class, kind, phrase AS lemma, {o} AS ord, {f} AS surface FROM verbs WHERE {c}" for o, c, f in _FORMS)}
  UNION ALL SELECT rule, predicate, evidence_class, kind, phrase, 1, s FROM verbs JOIN (VALUES {_IRREGULAR_SQL}) v(s, l) ON l = phrase
  UNION ALL SELECT rule, predicate, evidence_class, kind, CASE WHEN kind = 'NOUN' THEN phrase ELSE split_part(phrase, ' ', 1) END, 0, phrase FROM pack WHERE kind <> 'VERB'
),
forms AS (SELECT rule, predicate, evidence_class, kind, surface, arg_min(lemma, (ord, lemma)) AS lemma FROM surfaces GROUP BY ALL)"""
TRIGGERS_CTE = f"""{PACK_CTE},
words AS (
  SELECT doc_id, a, b, mark AS w, lead(mark) OVER o AS w2, lead(a) OVER o AS a2, lead(b) OVER o AS b2 FROM ({_marks_sql(_WORD_SQL, "lower(coalesce(text, ''))")}) WINDOW o AS (PARTITION BY doc_id ORDER BY k)
),
hits AS (
  SELECT doc_id, a, b, kind, lemma, predicate, rule, evidence_class FROM words JOIN forms ON surface = w WHERE kind <> 'MULTIWORD'
  UNION ALL SELECT words.doc_id, a, b2, kind, lemma, predicate, rule, evidence_class FROM words JOIN forms ON surface = w || ' ' || w2 JOIN documents d ON d.doc_id = words.doc_id
    WHERE kind = 'MULTIWORD' AND a2 = b + 1 AND substring(d.text, b::INT + 1, 1) = ' '
),
found AS (
  SELECT *, b < max(b) OVER (PARTITION BY doc_id ORDER BY a, b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) OR a > min(a) OVER (PARTITION BY doc_id, b) AS covered FROM hits
)"""
TRIGGER_SPANS = f"""
WITH {TRIGGERS_CTE}
SELECT doc_id, a::INT AS span_start, b::INT AS span_end, substring(text, a::INT + 1, (b - a)::INT) AS mark, kind, lemma, predicate, rule, evidence_class, covered FROM found JOIN documents USING (doc_id)
"""
_SIGNATURES_SQL = ", ".join(f"({k}, '{a}', '{b}')" for k, s in enumerate(SIGNATURES) for a, b in s)
RULES_CTE = f"""rules AS (
  SELECT DISTINCT predicate, evidence_class, CASE WHEN kind = 'MULTIWORD' THEN split_part(phrase, ' ', 1) ELSE phrase END AS trigger, st, ot, rule % 3 = 1 AS mutual FROM pack JOIN (VALUES {_SIGNATURES_SQL}) s(k, st, ot) ON rule % 3 = k
)"""
BOUND_CTE = f"""{TRIGGERS_CTE}, {RULES_CTE},
sentences AS ({_marks_sql(SENTENCE)}),
joints AS ({_marks_sql(S.COORDINATOR)}),
ents AS (
  SELECT s.doc_id, s.k AS frame, m.a, m.b, m.mark, CASE WHEN upper(m.mark[1]) <= '{KINDS[0][1]}' THEN '{KINDS[0][0]}' WHEN upper(m.mark[1]) <= '{KINDS[1][1]}' THEN '{KINDS[1][0]}' ELSE '{KINDS[2][0]}' END AS type
  FROM ({_marks_sql(ENTITY)}) m ASOF JOIN sentences s ON m.doc_id = s.doc_id AND m.a >= s.a WHERE m.b <= s.b
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, frame, type ORDER BY a) AS n FROM ents),
trig AS (SELECT row_number() OVER () AS id, f.*, s.k AS frame FROM (SELECT * FROM found WHERE NOT covered) f ASOF JOIN sentences s ON f.doc_id = s.doc_id AND f.a >= s.a WHERE f.b <= s.b),
cuts AS (
  SELECT DISTINCT j.doc_id, s.k AS frame, j.a + length(regexp_replace(j.mark, '[ \\t\\n\\f\\r]+$', '')) AS joint FROM joints j ASOF JOIN sentences s ON j.doc_id = s.doc_id AND j.a >= s.a
  WHERE j.b <= s.b AND EXISTS (SELECT 1 FROM trig t WHERE t.doc_id = j.doc_id AND t.frame = s.k AND t.a = j.b)
),
bounded AS (
  SELECT t.*, l.joint AS low, h.joint AS high FROM trig t ASOF LEFT JOIN cuts l ON t.doc_id = l.doc_id AND t.frame = l.frame AND t.a >= l.joint ASOF LEFT JOIN cuts h ON t.doc_id = h.doc_id AND t.frame = h.frame AND t.b <= h.joint
),
subject_types AS (SELECT DISTINCT evidence_class, st AS type FROM rules),
object_types AS (SELECT DISTINCT evidence_class, ot AS type FROM rules),
lefts AS (
  SELECT * FROM (
    SELECT t.id, e.mark, e.a, e.type, row_number() OVER (PARTITION BY t.id ORDER BY e.b DESC) AS r
    FROM (SELECT x.*, o.n FROM (SELECT t.*, type FROM bounded t JOIN subject_types USING (evidence_class)) x ASOF JOIN ranked o ON x.doc_id = o.doc_id AND x.frame = o.frame AND x.type = o.type AND x.a >= o.b) t
    JOIN ranked e ON e.doc_id = t.doc_id AND e.frame = t.frame AND e.type = t.type AND e.n BETWEEN t.n - 2 AND t.n) l
  JOIN (SELECT id, low FROM bounded) USING (id) WHERE r <= 3 AND a >= coalesce(low, 0)
),
rights AS (
  SELECT * FROM (
    SELECT t.id, e.mark, e.a, e.type, row_number() OVER (PARTITION BY t.id ORDER BY e.a) AS r
    FROM (SELECT x.*, o.n FROM (SELECT t.*, type FROM bounded t JOIN object_types USING (evidence_class)) x ASOF JOIN ranked o ON x.doc_id = o.doc_id AND x.frame = o.frame AND x.type = o.type AND x.b <= o.a) t
    JOIN ranked e ON e.doc_id = t.doc_id AND e.frame = t.frame AND e.type = t.type AND e.n BETWEEN t.n AND t.n + 2) l
  JOIN (SELECT id, high FROM bounded) USING (id) WHERE r <= 3 AND coalesce(a <= high, true)
),
sized AS (SELECT t.*, coalesce(l.n, 0) AS ln, coalesce(r.n, 0) AS rn FROM bounded t LEFT JOIN (SELECT id, count(*) AS n FROM lefts GROUP BY id) l USING (id) LEFT JOIN (SELECT id, count(*) AS n FROM rights GROUP BY id) r USING (id)),
judged AS (SELECT *, CASE WHEN ln = 0 THEN 'SUBJECT_ENDPOINT_UNAVAILABLE' WHEN rn = 0 THEN 'OBJECT_ENDPOINT_UNAVAILABLE' WHEN ln > 1 AND rn > 1 THEN 'ARGUMENT_BINDING_AMBIGUOUS' ELSE 'PAIR' END AS o FROM sized),
paired AS (
  SELECT j.*, l.mark AS subject, l.a AS sa, l.type AS st, r.mark AS object, r.a AS oa, r.type AS ot FROM judged j JOIN lefts l USING (id) JOIN rights r USING (id) WHERE o = 'PAIR' AND (l.mark <> r.mark OR l.type <> r.type)
),
bound AS (
  SELECT j.* EXCLUDE (ln, rn, o), CASE WHEN j.o <> 'PAIR' THEN j.o WHEN p.id IS NULL THEN 'SELF_PAIR' WHEN EXISTS (SELECT 1 FROM rules u WHERE u.evidence_class = j.evidence_class AND u.st = p.st AND u.ot = p.ot) THEN 'CANDIDATE_CREATED' ELSE 'OBJECT_TYPE_INCOMPATIBLE' END AS outcome,
         p.subject, p.sa, p.st, p.object, p.oa, p.ot
  FROM judged j LEFT JOIN paired p USING (id)
)"""
BOUND_CANDIDATES = f"""
WITH {BOUND_CTE}
SELECT doc_id, frame::INT AS frame, a::BIGINT AS trigger_start, b::BIGINT AS trigger_end, kind, lemma, predicate, low::INT AS low, high::INT AS high, outcome, subject, sa::BIGINT AS subject_start, object, oa::BIGINT AS object_start FROM bound
"""


def _q(word: str) -> str:
    return "'" + word.replace("'", "''") + "'"


def _near_sql(cues: list[str]) -> str:
    return "(" + " OR ".join(f"(contains(near, {_q(c)}) AND contains(near_words, {_q(' ' + c + ' ')}))" for c in cues) + ")"


def _has_sql(text: str, cues: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {_q(c)})" for c in cues) + ")"


_CUE = "CASE " + " ".join(f"WHEN contains(before, {_q(c)}) THEN {_q(c)}" for c in sorted(S.ATTRIBUTION, key=lambda c: (-len(c), c))) + " END"
COMPILED_FACTS = f"""
WITH {BOUND_CTE},
c AS (
  SELECT b.*, m.mark AS sentence, lower(m.mark) AS low_s, (b.a - m.a)::INT AS ra, (b.b - m.a)::INT AS rb FROM bound b JOIN sentences m ON m.doc_id = b.doc_id AND m.k = b.frame WHERE outcome = 'CANDIDATE_CREATED'
),
n AS (SELECT *, substring(low_s, greatest(0, ra - 200) + 1, rb + 200 - greatest(0, ra - 200)) AS near, substring(low_s, 1, ra) AS before FROM c),
w AS (SELECT *, ' ' || array_to_string(regexp_extract_all(near, '[a-z]+(?:''[a-z]+)?'), ' ') || ' ' AS near_words, {_CUE} AS cue FROM n),
f AS (
  SELECT *, regexp_matches(sentence, '[?？]') AS question, {_near_sql(S.NEGATION)} AS negated, {_near_sql(S.HEDGE)} AS speculative, {_near_sql(S.CONDITIONAL)} AS conditional, {_has_sql("before", S.HYPOTHETICAL)} AS hypothetical,
         {_has_sql("low_s", S.COMPARISON)} AS comparison, nullif(regexp_replace(regexp_extract(substring(sentence, 1, strpos(low_s, cue) - 1), '([^ \\t\\n\\x0B\\f\\r]+)[ \\t\\n\\x0B\\f\\r]*$', 1), '[,.]+$', ''), '') AS source,
         regexp_matches(sentence, '(?i)\\b(?:is|are|was|were|been|being)\\s+(?:\\w+\\s+)?\\w+(?:ed|en)\\s+by\\b') AS turned
  FROM w
),
g AS (
  SELECT *, CASE WHEN question THEN 'REJECT_QUESTION' WHEN negated THEN 'REJECT_NEGATED' WHEN conditional THEN 'REJECT_CONDITIONAL' WHEN speculative OR hypothetical OR cue IS NOT NULL THEN 'QUALIFY' ELSE 'ACCEPT' END AS gate,
         CASE WHEN turned THEN object ELSE subject END AS x, CASE WHEN turned THEN subject ELSE object END AS y, CASE WHEN turned THEN ot ELSE st END AS xt, CASE WHEN turned THEN st ELSE ot END AS yt
  FROM f
),
j AS (
  SELECT g.*, r.mutual, CASE WHEN gate LIKE 'REJECT%' THEN gate WHEN length(subject) < 4 THEN 'ENDPOINT_MENTION_ONLY' WHEN r.predicate IS NULL THEN 'SIGNATURE_MISMATCH' WHEN x = y THEN 'SELF_EDGE' ELSE 'ACCEPTED' END AS reason
  FROM g LEFT JOIN rules r ON r.evidence_class = g.evidence_class AND r.trigger = g.lemma AND r.predicate = g.predicate AND r.st = xt AND r.ot = yt
),
d AS (
  SELECT doc_id || ':' || a::BIGINT || ':' || predicate || ':' || kind || ':' || lemma || ':' || sa::BIGINT || ':' || oa::BIGINT AS candidate, CASE WHEN reason = 'ACCEPTED' THEN gate ELSE 'REJECT' END AS decision, reason, reason = 'ACCEPTED' AS ok, predicate AS p,
         CASE WHEN mutual AND x > y THEN y ELSE x END AS s, CASE WHEN mutual AND x > y THEN x ELSE y END AS o, nullif(regexp_extract(' ' || sentence || ' ', '[^0-9A-Za-z]([12][0-9]{{3}})[^0-9A-Za-z]', 1), '')::INT AS yr,
         CASE WHEN hypothetical THEN 'hypothetical' WHEN speculative THEN 'speculative' END AS cert, cue IS NOT NULL AS att, CASE WHEN cue IS NOT NULL THEN source END AS src, gate = 'QUALIFY' AND comparison AS comp
  FROM j
),
e AS (SELECT *, concat_ws(',', '"certainty":"' || cert || '"', '"attribution_source":' || to_json(src)::VARCHAR, '"attributed":' || att, '"comparison":' || comp) AS q FROM d)
SELECT candidate, decision, reason, CASE WHEN ok THEN p END AS predicate, CASE WHEN ok THEN s END AS subject, CASE WHEN ok THEN o END AS object, CASE WHEN ok THEN yr END AS year, CASE WHEN ok THEN cert END AS certainty,
       CASE WHEN ok THEN att END AS attributed, CASE WHEN ok THEN src END AS attribution_source, CASE WHEN ok THEN comp END AS comparison,
       CASE WHEN ok THEN 'fact_' || sha256('{{"o":"' || o || '","p":"' || p || '","q":' || to_json('{{' || q || '}}')::VARCHAR || ',"s":"' || s || '"}}') END AS fact_id
FROM e
"""
PACK_PROBLEMS = f"""
WITH {PACK_CTE}, {RULES_CTE},
named AS (SELECT *, evidence_class || '|' || trigger || '|' || st || '|' || ot AS detail FROM rules)
SELECT DISTINCT predicate, 'OVERLAP' AS problem, detail FROM (SELECT *, min(predicate) OVER (PARTITION BY detail) <> max(predicate) OVER (PARTITION BY detail) AS several FROM named) WHERE several
UNION SELECT predicate, 'ASYMMETRIC', detail FROM named n WHERE mutual AND NOT EXISTS (SELECT 1 FROM rules r WHERE r.predicate = n.predicate AND r.evidence_class = n.evidence_class AND r.trigger = n.trigger AND r.st = n.ot AND r.ot = n.st)
"""
