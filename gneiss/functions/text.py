"""Column expressions over text: sentences, tokens, lexical score, normal forms."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The patterns of tokens, of words and of sentence ends.
TOKEN = "[a-z0-9]+(?:[-_][a-z0-9]+)*"
WORD = "[A-Za-z0-9]+(?:['-][A-Za-z0-9]+)*"
SENTENCE_END = r"""(?<=[.!?])\s+(?=[A-Z0-9"'(\[])|\n+"""
PLAIN_END = r"(?<=[.!?])\s+|\n+"
#: Sentences of addresses have more characters than this.
TELLING = 20
#: Words that summaries leave out, and words that queries and token sets leave out too.
SUMMARY_STOPWORDS = (
    "a an the and or but if then else of to in on at by for with from as is are was were be been being that this "
    "these those it its it's they them their there here which who whom whose what when where why how not no nor so "
    "such than too very can could may might must shall should will would do does did done have has had i you he she "
    "we us our your his her him me my"
).split()
STOPWORDS = SUMMARY_STOPWORDS + "own into over under again once more most other some any all both each few between during before after above below up down out off".split()


def _trimmed(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def sentences(text: Column) -> Column:
    """Trimmed, non-empty sentences. Null and blank texts have none."""
    return _trimmed(F.split(F.coalesce(text, F.lit("")), SENTENCE_END, -1))


def every_sentence(text: Column) -> Column:
    """Sentences that end before any white space after an end mark."""
    return _trimmed(F.split(F.coalesce(text, F.lit("")), PLAIN_END, -1))


def telling_sentences(text: Column, least: int = TELLING) -> Column:
    """Those of more than `least` characters."""
    return F.filter(every_sentence(text), lambda s: F.length(s) > least)


def query_tokens(text: Column) -> Column:
    """All tokens in order, stop words and repetitions included."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def content_tokens(text: Column) -> Column:
    """Distinct tokens that are no stop words."""
    return F.array_except(F.array_distinct(query_tokens(text)), F.array(*map(F.lit, STOPWORDS)))


def occurrences(body: Column, term: Column) -> Column:
    """Non-overlapping occurrences of a non-empty term as a substring."""
    return (F.length(body) - F.length(F.replace(body, term, F.lit("")))) / F.length(term)


def truncated(text: Column, most: int) -> Column:
    """At most `most` characters, cut before a word, without punctuation at the cut."""
    cut = F.substring(text, 1, most)
    return F.when(F.length(text) <= most, text).otherwise(F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(cut, r" [^ ]*\z", ""), r"[.,;:-]+\z", ""), F.lit("")), cut))


@F.pandas_udf(T.StringType())
def nfc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Canonical composition, for which Spark has no function."""
    for part in texts:
        yield part.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def normal_surface(surface: Column) -> Column:
    """Composed, lower case, single spaces, nothing but letters and digits (of any script) at the edges. Null counts as empty."""
    collapsed = F.regexp_replace(F.regexp_replace(nfc(F.coalesce(surface, F.lit(""))), r"(?U)\s+", " "), r"^ | $", "")
    return F.regexp_replace(F.lower(collapsed), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def content_id(prefix: str, **fields: Column) -> Column:
    """prefix and the SHA-256 of the fields as JSON with sorted keys; nulls count as fields."""
    row = F.struct(*(v.alias(k) for k, v in sorted(fields.items())))
    return F.concat(F.lit(prefix), F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256))
