"""Personal data in texts: spans by fixed patterns, and spans that a tagger trained on them finds besides."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tagger import KINDS, Tagger, classes_of, train

#: Characters of a window and from one window to the next; characters kept on either side of a digit or an "@".
WINDOW, STRIDE, CONTEXT = 64, 32, 20
#: Windows that the tagger learns from, at most, and pairs of labelled spans put side by side.
SAMPLE, PAIRS = 1500, 500
HIDDEN, EPOCHS, BATCH, RATE, SEED = 24, 6, 32, 0.02, 12
#: Windows decoded at once; the least mean posterior of a span's tags.
DECODED, CERTAIN = 512, 0.6
#: The patterns, in the order of the kinds.
PATTERNS = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
)
_DIGIT = re.compile(r"[^0-9]+")
_TRIGGER = re.compile(r"[0-9@]+")

Span = tuple[int, int, int]


def shaped(kind: int, found: str) -> bool:
    """Whether a match of the kind's pattern has its length in digits."""
    n = len(_DIGIT.sub("", found))
    return (True, True, 14 <= n <= 19, 10 <= n <= 15)[kind]


def valid(kind: int, found: str) -> bool:
    """Whether a match of the kind's pattern is one: parts at most 255, the Luhn sum, the number of digits."""
    if kind == 1:
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in found.split("."))
    if kind == 2 and shaped(kind, found):
        digits = [int(c) for c in _DIGIT.sub("", found)][::-1]
        return (sum(digits[::2]) + sum(2 * d - 9 * (d > 4) for d in digits[1::2])) % 10 == 0
    return shaped(kind, found)


def matches(text: str, test) -> list[Span]:
    """(start, kind, end) of the leftmost non-overlapping matches of each kind that pass the test, by start, then kind."""
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) if k or "@" in text for m in p.finditer(text) if test(k, m[0]))


def windows(text: str) -> list[tuple[int, int]]:
    """Overlapping windows over all places within CONTEXT of a digit or an "@": no kind has spans elsewhere."""
    regions: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        low, high = max(0, m.start() - CONTEXT), min(len(text), m.end() + CONTEXT)
        if regions and low <= regions[-1][1]:
            regions[-1][1] = high
        else:
            regions.append([low, high])
    return [(at, min(at + WINDOW, high)) for low, high in regions for at in range(low, max(low + 1, high - (WINDOW - STRIDE)), STRIDE)]


def tags(spans: list[Span], low: int, high: int) -> bytes:
    """The tags of text[low:high]."""
    out = bytearray(high - low)
    for start, kind, end in spans:
        for i in range(max(start, low), min(end, high)):
            out[i - low] = 2 * kind + (1 if i == start else 2)
    return bytes(out)


def labelled(docs: DataFrame) -> DataFrame:
    """(text, tags) of distinct windows. Labels are the matches of the right shape: a card or an address that only fails its check looks like one, and what the tagger finds is checked. Windows with matches of too many digits are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, labels = [], []
            for text in _triggered(batch):
                spans = []
                for start, kind, end in matches(text, shaped):
                    # of spans that overlap the first is the label
                    if not spans or start >= spans[-1][2]:
                        spans.append((start, kind, end))
                # a match with too many digits is several things in a row: what its parts are is not known
                several = matches(text, lambda k, found: k >= 2 and len(_DIGIT.sub("", found)) > (19, 15)[k - 2])
                for low, high in windows(text):
                    if any(s[0] < high and low < s[2] for s in several):
                        continue
                    texts.append(text[low:high])
                    labels.append(tags(_between(spans, low, high), low, high))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(labels, pa.binary())], names=["text", "tags"])

    return docs.select("text").mapInArrow(run, "text string, tags binary").dropDuplicates(["text"])


def _between(spans: list[Span], low: int, high: int) -> list[Span]:
    """Of ascending spans that don't overlap those that meet [low, high)."""
    return spans[max(0, bisect_right(spans, (low,)) - 1) : bisect_right(spans, (high,))]


def _triggered(batch: pa.RecordBatch) -> list[str]:
    """The texts that have a digit or an "@"."""
    column = batch.column("text")
    return column.filter(pc.fill_null(pc.match_substring_regex(column, "[0-9@]"), False)).to_pylist()


def learn(docs: DataFrame, sample: int = SAMPLE) -> Tagger | None:
    """A tagger from the `sample` distinct windows with the smallest hashes, and PAIRS windows of two of their spans side by side. None without windows."""
    found = labelled(docs)
    rows = found.orderBy(F.xxhash64("text"), "text").limit(sample).collect()
    if not rows:
        return None
    pairs = [(r.text, bytes(r.tags)) for r in rows]
    r = np.random.default_rng(SEED)
    spans = sorted({(t[m.start() : m.end()], g[m.start()]) for t, g in pairs for m in re.finditer(rb"[\1\3\5\7][\2\4\6\10]+", g)})
    plain = [t for t, g in pairs if not any(g)] or [" " * WINDOW]
    for _ in range(PAIRS if spans else 0):
        (a, ka), (b, kb) = (spans[i] for i in r.integers(0, len(spans), 2))
        before, gap, after = plain[r.integers(0, len(plain))][: int(r.integers(0, 16))], (" ", ", ", "; ", " / ")[r.integers(0, 4)], plain[r.integers(0, len(plain))]
        text = before + " " + a + gap + b + " " + after
        mark = bytes(len(before) + 1) + bytes([ka]) + bytes([ka + 1]) * (len(a) - 1) + bytes(len(gap)) + bytes([kb]) + bytes([kb + 1]) * (len(b) - 1)
        pairs.append((text[:WINDOW], (mark + bytes(WINDOW))[: len(text[:WINDOW])]))
    x, y = np.zeros((len(pairs), WINDOW), np.int16), np.zeros((len(pairs), WINDOW), np.int16)
    for k, (text, mark) in enumerate(pairs):
        x[k, : len(text)], y[k, : len(mark)] = classes_of(text), np.frombuffer(mark, np.uint8)
    return train(x, y, HIDDEN, EPOCHS, BATCH, RATE, SEED)


def decode(model: Tagger, pieces: list[str]) -> list[list[tuple[int, int, int, float]]]:
    """Of each window its spans on the best path: (start, kind, end, mean posterior of its tags)."""
    out: list[list[tuple[int, int, int, float]]] = []
    for low in range(0, len(pieces), DECODED):
        some = pieces[low : low + DECODED]
        x = np.zeros((len(some), WINDOW), np.int16)
        for k, text in enumerate(some):
            x[k, : len(text)] = classes_of(text)
        scores = model.scores(x)
        paths, sure = model.best_paths(scores), model.posteriors(scores)[0]
        for k, text in enumerate(some):
            path, spans = paths[k].tolist(), []
            for i, tag in enumerate(path[: len(text)]):
                if tag and spans and spans[-1][2] == i and tag == 2 * spans[-1][1] + 2:
                    spans[-1][2] = i + 1
                elif tag:
                    spans.append([i, (tag - 1) // 2, i + 1])
            out.append([(a, kind, b, float(np.mean([sure[k, i, path[i]] for i in range(a, b)]))) for a, kind, b in spans])
    return out


def reconciled(found: list[tuple[int, int, int, float, bool, bool]], base: list[Span], text: str) -> list[Span]:
    """Of what a text's windows found the spans that don't overlap each other with the greatest sum of posteriors, besides the base spans.

    found: start, kind, end, posterior, and whether a window's edge cut the start and the end. Pieces of one kind that
    overlap are also proposed as one. A span must not be cut, be a whole match of its kind's pattern that is
    valid, be CERTAIN, and overlap no base span.
    """
    joined: list[list] = []
    for start, kind, end, sure, cut, cut_end in sorted(found, key=lambda s: (s[1], s[0], s[2])):
        last = joined[-1] if joined else None
        if not last or last[1] != kind or start >= last[2]:
            joined.append([start, kind, end, sure, cut, cut_end])
            continue
        last[3] = max(last[3], sure)
        last[4] = last[4] and (cut or start > last[0])
        if end >= last[2]:
            last[2], last[5] = end, cut_end and (end > last[2] or last[5])
    proposed: dict[Span, float] = {}
    for start, kind, end, sure, cut, cut_end in (*found, *joined):
        if not (cut or cut_end) and sure >= CERTAIN and PATTERNS[kind].fullmatch(text, start, end) and valid(kind, text[start:end]) and not any(b[0] < end and start < b[2] for b in base):
            proposed[start, kind, end] = max(sure, proposed.get((start, kind, end), 0.0))
    spans = sorted(proposed, key=lambda s: (s[2], s))
    ends, best = [s[2] for s in spans], [(0.0, None, 0)]
    for i, s in enumerate(spans):
        j = bisect_right(ends, s[0], 0, i)
        best.append(max(best[-1][:1] + (None, i), (best[j][0] + proposed[s], s, j), key=lambda b: b[0]))
    out, i = [], len(spans)
    while i:
        _, s, j = best[i]
        if s:
            out.append(s)
        i = j
    return out


def personal_spans(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """Per row of docs: doc_id, base and spans, arrays of (start, kind, end, found) in code points by start, then kind.

    base are the patterns' spans; spans are these and the tagger's. Overlapping windows of a whole text are decoded and
    reconciled together. A null text is empty and has no spans; null and repeated doc_ids stay
    rows; an empty table gives no rows; other columns aren't read.
    """
    kind = "array<struct<start: int, kind: string, end: int>>"
    form = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            rows = np.flatnonzero(pc.fill_null(pc.match_substring_regex(column, "[0-9@]"), False).to_numpy(zero_copy_only=False)).tolist()
            base, added = [[] for _ in range(batch.num_rows)], [[] for _ in range(batch.num_rows)]
            held, pieces, size = [], [], 0

            def settle() -> None:
                spans = iter(decode(model, pieces) if model else [[]] * len(pieces))
                for i, text, places in held:
                    found = [(low + a, k, low + b, p, a == 0 < low, low + b == high < len(text)) for (low, high), each in zip(places, spans) for a, k, b, p in each]
                    added[i] = reconciled(found, base[i], text)
                held.clear()
                pieces.clear()

            for i in rows:
                text = column[i].as_py()
                base[i] = matches(text, valid)
                places = windows(text)
                held.append((i, text, places))
                pieces += [text[low:high] for low, high in places]
                if len(pieces) >= DECODED:
                    settle()
            settle()
            shown = lambda spans: [{"start": s, "kind": KINDS[k], "end": e} for s, k, e in spans]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([shown(b) for b in base], form), pa.array([shown(sorted(b + a)) for b, a in zip(base, added)], form)], names=["doc_id", "base", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, base {kind}, spans {kind}")
