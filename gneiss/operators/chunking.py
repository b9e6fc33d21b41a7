"""Sentences, chunks of whole sentences, parent sections and extractive summaries."""

from __future__ import annotations

import math
import re
from collections import Counter
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.functions.text import STOPWORDS, SUMMARY_STOPWORDS, TELLING, TOKEN, WORD, content_id, every_sentence, sentences, telling_sentences, truncated
from gneiss.functions.values import told_apart

TARGET, FANOUT, LEAD = 1200, 4, 0.6
WORD_FORM, SUMMARY_STOPS = re.compile(WORD), frozenset(SUMMARY_STOPWORDS)
TOKEN_FORM, STOPS, PLACES = re.compile(TOKEN), frozenset(STOPWORDS), Decimal("1e-12")


def sentence_rows(docs: DataFrame) -> DataFrame:
    """doc_id, idx (from 0), sentence."""
    return docs.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("idx", "sentence"))


def pack_sentences(docs: DataFrame, target: int = TARGET) -> DataFrame:
    """doc_id, chunk_index, chunk_id, parent_index, text, n_sentences: a sentence opens a chunk if with it and one
    separator the summed lengths would pass the target. Sentences are never split."""
    empty = F.expr("named_struct('done', cast(array() as array<array<string>>), 'cur', cast(array() as array<string>), 'n', 0)")

    def step(s, x):
        full = (F.size(s["cur"]) > 0) & (s["n"] + 1 + F.length(x) > target)
        return F.struct(
            F.when(full, F.concat(s["done"], F.array(s["cur"]))).otherwise(s["done"]).alias("done"),
            F.when(full, F.array(x)).otherwise(F.concat(s["cur"], F.array(x))).alias("cur"),
            F.when(full, F.length(x)).otherwise(s["n"] + F.length(x)).alias("n"),
        )

    chunks = F.aggregate(sentences(F.col("text")), empty, step, lambda s: F.when(F.size(s["cur"]) > 0, F.concat(s["done"], F.array(s["cur"]))).otherwise(s["done"]))
    rows = docs.select("doc_id", F.posexplode(chunks).alias("chunk_index", "parts"))
    text = F.array_join("parts", " ")
    return rows.select(
        "doc_id", "chunk_index", content_id("chunk_", d=F.col("doc_id").cast("string"), i=F.col("chunk_index"), t=text).alias("chunk_id"),
        F.floor(F.col("chunk_index") / FANOUT).alias("parent_index"), text.alias("text"), F.size("parts").alias("n_sentences"),
    )


def parents(chunks: DataFrame) -> DataFrame:
    """doc_id, parent_index, parent_id, children (their ids in order), text (their texts, a line each): FANOUT chunks a parent."""
    line = F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "text")))
    rows = chunks.groupBy("doc_id", "parent_index").agg(line.alias("c"))
    text = F.array_join(F.transform("c", lambda x: x["text"]), "\n")
    return rows.select("doc_id", "parent_index", parent_id(text).alias("parent_id"), F.transform("c", lambda x: x["chunk_id"]).alias("children"), text.alias("text"))


def parent_id(text) -> Column:
    return content_id("chunk_", d=F.col("doc_id").cast("string"), i=F.concat(F.lit("parent:"), "parent_index"), t=text)


def linked_chunks(chunks: DataFrame) -> DataFrame:
    """chunks with the id of their parent."""
    ids = parents(chunks).select("doc_id", "parent_index", "parent_id")
    return chunks.join(ids, ["doc_id", "parent_index"])


def summaries(texts: DataFrame, keys: list[str], most: int = 4, most_chars: int = 900) -> DataFrame:
    """keys, summary: the best sentences of each text (keys, text) in its order, cut to most_chars before a word.

    A sentence's score is the mean weight of its content words plus LEAD / (1 + idx); a word's weight is its number of sentences over all
    words times ln((n + 1) / (1 + that number) + 1). Earlier sentences win ties. Texts without sentences give no row. Each text is
    summed up in its own row and only the keys are shuffled, to see that they tell the texts apart; where they don't, sentences of equal keys meet by joins.
    """
    if not told_apart(texts, keys):
        return _summaries_by_joins(texts, keys, most, most_chars)
    chosen = _telling(sentences(F.col("text")), F.lit(most))
    return texts.select(*keys, chosen.alias("s")).where("s IS NOT NULL").select(*keys, truncated(F.array_join("s", " "), most_chars).alias("summary"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _telling(sentences: pd.Series, most: pd.Series) -> pd.Series:
    """Of a text's sentences the best by `summaries`, in order; null if there are none."""
    out = []
    for own, n in zip(sentences, most):
        words = [[w for w in map(str.lower, WORD_FORM.findall(s)) if w not in SUMMARY_STOPS] for s in own]
        total, size = sum(map(len, words)), len(own)
        if size <= n:
            out.append(list(own) or None)
            continue
        uses = [Counter(w) for w in words]
        df = Counter(w for u in uses for w in u)
        weight = {w: k / total * math.log((size + 1) / (1 + k) + 1.0) for w, k in df.items()}
        scores = [round(math.fsum(k * weight[w] for w, k in u.items()) / len(w_all) + LEAD / (1 + i), 9) if u else 0.0 for i, (u, w_all) in enumerate(zip(uses, words))]
        best = sorted(range(size), key=lambda i: (-scores[i], i))[:n]
        out.append([own[i] for i in sorted(best)])
    return pd.Series(out, dtype=object)


def _summaries_by_joins(texts: DataFrame, keys: list[str], most: int, most_chars: int) -> DataFrame:
    """The same for any keys. All steps group by the keys (and more), so rows are shuffled once."""
    rows = texts.repartition(*keys).select(*keys, F.posexplode(sentences(F.col("text"))).alias("idx", "sentence"))
    content = F.filter(F.transform(F.regexp_extract_all("sentence", F.lit(WORD), F.lit(0)), F.lower), lambda w: ~w.isin(SUMMARY_STOPWORDS))
    rows = rows.withColumn("words", content)
    each = rows.select(*keys, "idx", F.explode("words").alias("w"))
    uses = each.groupBy(*keys, "w", "idx").agg(F.count("*").alias("k"))
    df = uses.groupBy(*keys, "w").agg(F.count("*").alias("df"))
    sizes = rows.groupBy(*keys).agg(F.sum(F.size("words")).alias("total"), F.count("*").alias("n"))
    weight = F.col("df") / F.col("total") * F.log((F.col("n") + 1) / (1 + F.col("df")) + 1.0)
    scored = uses.join(df, [*keys, "w"]).join(sizes, keys).groupBy(*keys, "idx").agg(F.sum(F.col("k") * weight).alias("sum"), F.sum("k").alias("length"))
    content_score = F.when(F.col("length").isNotNull(), F.col("sum") / F.col("length") + F.lit(LEAD) / (1 + F.col("idx"))).otherwise(0.0)
    ranked = rows.drop("words").join(scored, [*keys, "idx"], "left").withColumn("score", F.round(content_score, 9))
    best = ranked.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "idx"))).where(F.col("r") <= most)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "sentence"))), lambda s: s["sentence"]), " ")
    return best.groupBy(*keys).agg(joined.alias("text")).select(*keys, truncated(F.col("text"), most_chars).alias("summary"))


def section_summaries(chunks: DataFrame) -> DataFrame:
    """doc_id, parent_index, summary: of each child its best sentence, and of these, a line a child, the best three."""
    children = summaries(chunks.select("doc_id", "parent_index", "chunk_index", "text"), ["doc_id", "parent_index", "chunk_index"], 1, 220)
    line = F.array_sort(F.collect_list(F.struct("chunk_index", "summary")))
    texts = children.groupBy("doc_id", "parent_index").agg(F.array_join(F.transform(line, lambda x: x["summary"]), "\n").alias("text"))
    return summaries(texts, ["doc_id", "parent_index"], 3, 600)


# retrieval summaries: addresses of sections and documents

SECTION_SENTENCES, SECTION_CHARS, DOC_SENTENCES, DOC_CHARS, NEAR = 4, 600, 12, 1600, 0.8
_CHOSEN = T.StructType().add("texts", T.ArrayType(T.StringType())).add("places", T.ArrayType(T.IntegerType()))


def _words_of(sentence: str) -> frozenset[str]:
    """The tokens that `content_tokens` gives."""
    return frozenset(TOKEN_FORM.findall(sentence.lower())) - STOPS


def _salience(words: frozenset[str], shares: dict[str, float]) -> float:
    """Mean over a sentence's tokens of 1 + 1 / (how many texts have it), 0 without tokens; halves are rounded up."""
    total = 0.0
    for w in sorted(words):
        total = total + 1 + shares[w]
    return float(Decimal(repr(total / len(words))).quantize(PLACES, ROUND_HALF_UP)) if words else 0.0


def _unlike(selected: list[tuple[str, frozenset[str]]]) -> list[str]:
    """Of (text, tokens), in order, the texts that are at least NEAR to none kept before."""
    kept: list[tuple[str, frozenset[str]]] = []
    for text, words in selected:
        same = [(len(words & k), len(words) + len(k)) for _, k in kept]
        if not any(n and n / (size - n) >= NEAR for n, size in same):
            kept.append((text, words))
    return [text for text, _ in kept]


def section_addresses(chunks: DataFrame) -> DataFrame:
    """doc_id, parent_index, summary, sources: of each child its share of SECTION_SENTENCES, the longest first, without near copies.

    Without a background all sentences that have tokens are equally salient. sources: the child of each sentence, and whether it is the section's only one. A section is done in its row.
    """
    child = F.struct("chunk_index", "chunk_id", telling_sentences(F.col("text")).alias("sentences"))
    rows = chunks.repartition("doc_id", "parent_index").groupBy("doc_id", "parent_index").agg(F.array_sort(F.collect_list(child)).alias("c"))
    done = rows.select("doc_id", "parent_index", "c", _of_section(F.transform("c", lambda x: x["sentences"])).alias("x"))
    source = lambda i: F.struct(F.get("c", i)["chunk_id"].alias("chunk_id"), (F.size("c") == 1).alias("only_child"))
    return done.select("doc_id", "parent_index", truncated(F.array_join("x.texts", " "), SECTION_CHARS).alias("summary"), F.transform("x.places", source).alias("sources"))


@F.pandas_udf(_CHOSEN)
def _of_section(children: pd.Series) -> pd.DataFrame:
    """Of a section's sentences by child the texts chosen, and the child's place for each choice."""
    texts, places = [], []
    for own in children:
        share = max(1, SECTION_SENTENCES // len(own))
        selected = [(s, words, c) for c, sentences in enumerate(own) for s, words in _longest(sentences, share)]
        kept = _unlike([x[:2] for x in selected])
        texts.append(kept)
        places.append([c for s, _, c in selected if s in kept])
    return pd.DataFrame({"texts": texts, "places": places})


def _longest(sentences: list[str], most: int) -> list[tuple[str, frozenset[str]]]:
    """The longest, the first among equals, with their tokens; those without tokens come last."""
    found, bare = [], []
    for s in sorted(sentences, key=len, reverse=True):
        words = _words_of(s)
        (found if words else bare).append((s, words))
        if len(found) == most:
            break
    return (found + bare)[:most]


def document_addresses(sections: DataFrame) -> DataFrame:
    """sections (doc_id, parent_index, text) to doc_id, summary, sources (parent_index of each sentence): every section has a say.

    First the most salient sentence of each section; then, up to DOC_SENTENCES, the most salient of the rest, at most
    max(2, DOC_SENTENCES / sections + 1) a section; then near copies go, and what is left stands in document order. The sections of a document meet once and it is done in its row.
    """
    rows = sections.where("doc_id IS NOT NULL").select("doc_id", "parent_index", every_sentence(F.col("text")).alias("sentences"))
    telling = F.bool_or(F.exists("sentences", lambda s: F.length(s) > TELLING)).alias("telling")
    docs = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("parent_index", "sentences"))).alias("s"), telling).where("telling")
    done = docs.select("doc_id", "s", _of_document(F.transform("s", lambda x: F.coalesce(x["parent_index"].cast("string"), F.lit(""))), F.transform("s", lambda x: x["sentences"])).alias("x"))
    return done.select("doc_id", truncated(F.array_join("x.texts", " "), DOC_CHARS).alias("summary"), F.transform("x.places", lambda i: F.get("s", i)["parent_index"]).alias("sources"))


@F.pandas_udf(_CHOSEN)
def _of_document(indices: pd.Series, sections: pd.Series) -> pd.DataFrame:
    """Of a document's sentences by section the texts chosen, and the section's place for each; sections with one index count as one where a section has its say."""
    texts, places = [], []
    for index, own in zip(indices, sections):
        words = [[_words_of(s) for s in part] for part in own]
        shares = {w: 1 / n for w, n in Counter(w for part in words for w in frozenset().union(*part)).items()}
        each = [(-_salience(w, shares), s, at, i, w) for at, part in enumerate(own) for i, (s, w) in enumerate(zip(part, words[at])) if len(s) > TELLING]
        by_index: dict[str, list] = {}
        for x in each:
            by_index.setdefault(index[x[2]], []).append(x)
        firsts = [min(xs, key=lambda x: (x[0], len(x[1]), x[3])) for xs in by_index.values()]
        cap, heads, said = max(2, DOC_SENTENCES // len(own) + 1), {x[2:4] for x in firsts}, Counter()
        rest = []
        for x in sorted((x for x in each if x[2:4] not in heads), key=lambda x: x[:4]):
            said[index[x[2]]] += 1
            if said[index[x[2]]] < cap and len(firsts) + len(rest) < DOC_SENTENCES:
                rest.append(x)
        chosen = [(x[1], x[4], x[2]) for x in firsts + rest]
        kept = set(_unlike([x[:2] for x in chosen]))
        nth = {k: n for n, k in enumerate(by_index)}
        ordered = sorted((x for x in chosen if x[0] in kept), key=lambda x: nth[index[x[2]]])
        texts.append([x[0] for x in ordered])
        places.append([x[2] for x in ordered])
    return pd.DataFrame({"texts": texts, "places": places})
