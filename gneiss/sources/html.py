"""HTML pages to text blocks."""

from __future__ import annotations

from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements whose content is no text, and elements that end a line.
HIDDEN = frozenset("script style head noscript template svg".split())
BLOCKS = frozenset("p div br li ul ol tr table h1 h2 h3 h4 h5 h6 section article header footer pre blockquote".split())


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.depth, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag in HIDDEN
        if tag in BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.depth = max(0, self.depth - (tag in HIDDEN))
        if tag in BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.depth:
            self.parts.append(data)


def text_of(html: str | None) -> str:
    """Visible text: one block a paragraph, white space collapsed. Broken markup never raises."""
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    lines = (" ".join(x.split()) for x in unescape("".join(parser.parts)).split("\n"))
    return "\n\n".join(x for x in lines if x)


#: Characters, and characters a byte of the source, below which a text is too little.
LEAST_CHARS, LEAST_YIELD = 20, 0.001


def status(text: Column, source_bytes: Column) -> Column:
    """OK, EMPTY or LOW_YIELD."""
    low = (F.length(text) < LEAST_CHARS) | (F.length(text) < LEAST_YIELD * source_bytes)
    return F.when(F.length(text) == 0, "EMPTY").when(low, "LOW_YIELD").otherwise("OK")


def materialize(pages: DataFrame) -> DataFrame:
    """page_id, url, text, content_hash, source_hash, status."""

    @F.pandas_udf("string")
    def visible(html: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in html:
            yield part.map(text_of)

    source = F.coalesce("html", F.lit(""))
    read = pages.select("page_id", "url", visible("html").alias("text"), F.octet_length(source).alias("bytes"), F.sha2(source, 256).alias("source_hash"))
    return read.select("page_id", "url", "text", F.sha2("text", 256).alias("content_hash"), "source_hash", status(F.col("text"), F.col("bytes")).alias("status"))
