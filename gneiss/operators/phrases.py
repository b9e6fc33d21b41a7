"""Concepts, contractions and counts of phrases made in each document's row, by the rules of chunking.py, concepts.py and contractions.py: a text is split, packed and searched where it stands."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections import Counter
from collections.abc import Callable, Collection, Container, Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import cache, lru_cache
from itertools import combinations
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gneiss.functions.text import PLAIN_END, SENTENCE_END
from gneiss.operators import concepts as C
from gneiss.operators import contractions as X
from gneiss.operators.admission import GENERIC
from gneiss.operators.chunking import FANOUT, TARGET

#: Words and gaps that a task keeps with what was found out about them; rows of a batch that are done at once.
KEPT, ROWS = 200_000, 256
SPACE = " \t\n\x0b\f\r"
SENTENCE, SHORT = re.compile(SENTENCE_END, re.ASCII), re.compile(PLAIN_END, re.ASCII)
#: Java's $ also stands before a last line terminator, which \s has not where it lies outside ASCII.
EDGES, ENDERS = re.compile(r"^\s+|\s+(?=[\x85  ]?\Z)", re.ASCII), ("\x85", " ", " ")
PIECES, BROKEN = re.compile(f"({C.TOKEN})").split, re.compile(C.BREAK).search
ENDS = re.compile(r"[.!?]\s|\n", re.ASCII).search
#: Over each token's letter and the mark of the gap behind it: where chains begin, and how they go on.
CHAINS, CHAIN = re.compile("[cd](?=(?:[^e]o[^e][cd])+(?![^e]o))").finditer, re.compile("(?:[^e]o[^e][cd])+").match
DASHES, WHITE, HYPHENS = re.compile("[-_/]").sub, re.compile(r"\s+", re.ASCII).sub, re.compile("[A-Za-z0-9'’]+(?:-[A-Za-z0-9'’]+)+").fullmatch
STOPS, VERBS, WEAK, HEADS = frozenset(C.STOPS), frozenset(C.VERBS), frozenset(C.WEAK), frozenset(GENERIC)
#: Concepts that JSON has as they are; codes in JSON.
PLAIN, CODES = re.compile("[a-z0-9 '’]*").fullmatch, re.compile(r"\\(?:u[0-9a-f]{4}|.)").sub
WORD = re.compile("[a-z0-9][a-z0-9-]*").findall


def chunks_of(text: str | None, target: int = TARGET) -> list[str]:
    """The texts that pack_sentences gives a document, in order."""
    done, cur, n = [], [], 0
    for s in SENTENCE.split(text or ""):
        own = s.strip(SPACE)
        if own.endswith(ENDERS):
            own = EDGES.sub("", s)
        if not own:
            continue
        if cur and n + 1 + len(own) > target:
            done.append(" ".join(cur))
            cur, n = [], 0
        cur.append(own)
        n += len(own)
    return done + [" ".join(cur)] if cur else done


def _low(piece: str) -> str:
    """Normal form of a token or of a gap; that of a phrase is those of its pieces side by side, since tokens begin and end with what stays."""
    return WHITE(" ", DASHES(" ", piece.lower().replace("ς", "σ") if "Σ" in piece else DASHES(" ", piece.lower())))


def _word(token: str) -> tuple[str, str]:
    """Its letter (o, s, c as in candidate_phrases, d for a c that is nothing but a word in any place of a phrase) and its normal form."""
    low = token.lower()
    letter = "o" if low in ("of", "per") else "s" if low in STOPS or "'" in low else "c" if "/" in low or low in WEAK or low in HEADS or low.endswith("ing") or _acts(low) else "d"
    return letter, token if token == low and "/" not in low else _low(token)


def _gap(gap: str) -> tuple[str, str]:
    """e: ends a sentence, b: ends a run, -: one space, h: one hyphen, g: any other; and its normal form."""
    return "-" if gap == " " else "e" if ENDS(gap) else "b" if BROKEN(gap) else "h" if gap == "-" else "g", _low(gap)


class Known(dict):
    """What a function gives for what it was asked."""

    def __init__(self, of: Callable):
        super().__init__()
        self.of = of

    def __missing__(self, x):
        value = self[x] = self.of(x)
        return value


class Found:
    """The candidates of chunks. Places are those of tokens over all chunks, so that a phrase that stands before another has the lower one, as by chunk, sentence and place.

    runs: of each length from two the places and concepts of runs, in order; plain: of runs of three, those of nothing but words; chains: (place, n_tokens, concept).
    """

    def __init__(self, pieces: list[str], low: list[str], letters: str, marks: str, most: int):
        self.pieces, self.low = pieces, low
        k, m = (np.frombuffer(x.encode(), np.uint8) for x in (letters, marks))
        self.chunk = np.cumsum([0, *("\n" in g for g in pieces[2:-1:2])]) if "e" in marks else np.zeros(len(k), int)
        f = k == ord("d")
        c = f | (k == ord("c"))
        run = pair = c[:-1] & c[1:] & (m != ord("b")) & (m != ord("e"))
        self.runs = []
        for n in range(2, most + 1):
            if n > 2:
                run = run[:-1] & pair[n - 2 :]
            at = np.nonzero(run)[0]
            ends = (2 * at).tolist()
            if n == 2:
                own = [low[i + 1] + low[i + 2] + low[i + 3] for i in ends]
            else:
                own = [own[j] + low[i + 2 * n - 2] + low[i + 2 * n - 1] for j, i in zip(np.searchsorted(before, at).tolist(), ends)]
            self.runs.append((at, own))
            before = at
        space = m == ord("-")
        at = self.runs[1][0]
        self.plain = (f[at] & f[at + 1] & f[at + 2] & space[at] & space[at + 1]).tolist()
        self.chains = []
        if "o" in letters:
            codes = "".join(map(add, letters, marks + "e"))
            for x in CHAINS(codes):
                i = x.start() // 2
                size = (CHAIN(codes, x.end()).end() - x.start() + 1) // 2
                self.chains += [(i, n, "".join(low[2 * i + 1 : 2 * (i + n)])) for n in range(3, min(most, size) + 1, 2)]
        self.hyphened = set()
        if "h" in marks:
            hyphen = m == ord("h")
            for n, (at, own) in enumerate(self.runs, start=2):
                whole = np.all([hyphen[at + d] for d in range(n - 1)], axis=0)
                self.hyphened.update(own[j] for j in np.nonzero(whole)[0] if HYPHENS(self.surface(at[j], n)))
            self.hyphened.update(x for i, n, x in self.chains if HYPHENS(self.surface(i, n)))

    def surface(self, i: int, n: int) -> str:
        return "".join(self.pieces[2 * i + 1 : 2 * (i + n)])

    def each(self, wanted: Container[str]) -> Iterator[tuple[int, int, str]]:
        """place, n_tokens, concept of every candidate that is wanted."""
        for n, (at, own) in enumerate(self.runs, start=2):
            yield from [(i, n, x) for i, x in zip(at.tolist(), own) if x in wanted]
        yield from [x for x in self.chains if x[2] in wanted]

    def counts(self) -> Counter:
        out = Counter()
        for _, own in self.runs:
            out.update(own)
        out.update([x[2] for x in self.chains])
        return out


class Phrases:
    """Finds candidates; one for a task, which keeps what it found out about words and gaps."""

    def __init__(self):
        self.word, self.gap = Known(_word), Known(_gap)

    def of(self, chunks: list[str], most: int) -> Found | None:
        """The candidates of a group's chunks, which have no newlines: one stands between them. None where there are no two tokens."""
        pieces = PIECES("\n".join(chunks))
        if len(pieces) < 5:
            return None
        if len(self.word) > KEPT or len(self.gap) > KEPT:
            self.__init__()
        low = [""] * len(pieces)
        letters, low[1::2] = zip(*map(self.word.__getitem__, pieces[1::2]))
        marks, low[2:-1:2] = zip(*map(self.gap.__getitem__, pieces[2:-1:2]))
        return Found(pieces, low, "".join(letters), "".join(marks), most)


@lru_cache(KEPT)
def _acts(w: str) -> bool:
    known = lambda x: x in VERBS or x + "e" in VERBS
    return w in VERBS or any(w.endswith(e) and len(w) > len(e) + 3 and known(w[: -len(e)]) for e in ("ed", "es", "s"))


def _is_known(w: list[str], acts: bool, hyphens: bool) -> bool:
    if w[-1] in HEADS or w[0] in WEAK:
        return False
    if hyphens:
        return True
    if acts and not (len(w) == 2 and w[1] in VERBS and not _acts(w[0])):
        return False
    stem = w[0][:-3] if len(w) >= 3 and w[0].endswith("ing") and len(w[0]) >= 6 else ""
    return not (stem in VERBS or stem + "e" in VERBS)


@cache
def _share(size: int, weak: int) -> float:
    return float(Decimal(repr((size - weak) / size)).quantize(Decimal("0.001"), ROUND_HALF_UP))


def _digest(concept: str) -> bytes:
    """The hash of concept_id, which Spark takes of JSON with upper-case codes of control characters."""
    said = concept if PLAIN(concept) else CODES(lambda m: m[0][:2] + m[0][2:].upper() if m[0][1] == "u" else m[0], json.dumps(concept, ensure_ascii=False))[1:-1]
    return hashlib.sha256(f'{{"contract":"{C.CONTRACT}","normalized":"{said}"}}'.encode()).digest()


def inventory_of(chunks: list[str], said: str | None, budget: int, phrases: Phrases) -> list[tuple]:
    """concept_id, concept, surface, n_tokens, occurrences, chunks by rank: the inventory of one group of chunks. said: the normal form of its summary.

    Concepts that occur more than once come first and are judged one by one. Of the others, those of three tokens without weak words come first:
    where enough of them are known, no others are judged.
    """
    found = phrases.of(chunks, C.LONGEST)
    if found is None:
        return []
    counts, said = found.counts(), said or ""
    (at, pairs), (three_at, threes) = found.runs

    def judged(concept: str) -> tuple[bool, bool, int, int]:
        """Is it known, is it of acts, its words, the weak ones among them."""
        w = concept.split(" ")
        acts = any(map(_acts, w))
        return _is_known(w, acts, concept in found.hyphened), acts, len(w), sum([x in WEAK for x in w])

    def kept(asked: set[str]) -> list[tuple]:
        """(order, concept, surface) of those that stay."""
        own = {x: (size, weak) for x in asked for known, acts, size, weak in [judged(x)] if known and not acts}
        uses: dict[str, list] = {}
        for i, n, x in found.each(own):
            uses.setdefault(x, []).append((i, n))
        short = {x for x, u in uses.items() if min([n for _, n in u]) < C.LONGEST}
        inside: dict[str, list] = {}
        if short:
            first = np.searchsorted(at, three_at).tolist()
            for by, i, j in zip(threes, three_at.tolist(), first):
                for d in (0, 1):
                    part = pairs[j + d]
                    if part in short:
                        x = inside.get(part)
                        if (x is None or by <= x[0]) and (x and by == x[0] or judged(by)[0]):
                            if x is None or by < x[0]:
                                x = inside[part] = [by, set()]
                            x[1].add(i + d)
        rows = []
        for x, u in uses.items():
            if not (x in short and x in inside and len(inside[x][1]) >= counts[x]):
                order = (counts[x], len({found.chunk[i] for i, _ in u}), _share(*own[x]), min([n for _, n in u]), x in said, -own[x][1])
                rows.append((order, x, found.surface(*min(u))))
        return rows

    rows = kept({x for x, n in counts.items() if n > 1})
    left = budget - len(rows)
    if left > 0:
        once = [(i, x) for i, x, plain in zip(three_at.tolist(), threes, found.plain) if plain and counts[x] == 1]
        if len(once) < left:
            rows += kept({x for x, n in counts.items() if n == 1})
        else:
            strange = [(i, x) for i, x, plain in zip(three_at.tolist(), threes, found.plain) if not plain and counts[x] == 1] + [(i, x) for i, n, x in found.chains if counts[x] == 1]
            once += [(i, x) for i, x in strange for known, acts, _, weak in [judged(x)] if known and not acts and not weak]
            best = heapq.nlargest(left, [(said != "" and x in said, _digest(x), i, x) for i, x in once])
            rows += [((1, 1, 1.0, C.LONGEST, told, 0), x, found.surface(i, C.LONGEST)) for told, _, i, x in best]
    rows.sort(key=lambda r: r[0], reverse=True)
    if len(rows) > budget:
        least = rows[budget - 1][0]
        rows = [r for r in rows if r[0] >= least]
    best = sorted([(order, _digest(x), x, surface) for order, x, surface in rows], reverse=True)[:budget]
    return [("concept_" + digest.hex(), x, surface, order[3], order[0], order[1]) for order, digest, x, surface in best]


def _made(docs: DataFrame, schema: T.StructType, columns: list[str], make: Callable[[], Callable[..., list[tuple]]]) -> DataFrame:
    """Rows of the schema, whose first column is doc_id, from what the function that `make` gives a task returns for each row's `columns`: tuples of the other columns."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            at, rows = [], []
            for i, values in enumerate(zip(*(batch.column(c).to_pylist() for c in columns))):
                new = of(*values)
                rows += new
                at += [i] * len(new)
            if rows:
                ids = batch.column("doc_id").take(pa.array(at, pa.int32()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, t.type) for x, t in zip(zip(*rows), list(arrow)[1:]))], schema=arrow)

    return docs.select("doc_id", *columns).mapInArrow(run, schema)


def _schema(docs: DataFrame, rest: str) -> T.StructType:
    return T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *T._parse_datatype_string(rest)])


def inventories(docs: DataFrame, budget: int = C.BUDGET, sections: bool = False) -> DataFrame:
    """What concepts.inventory gives for the packed chunks of docs (doc_id, text, and the normal form of a summary as said if there is one), whose ids tell them apart: by documents, or by their sections."""
    schema = _schema(docs, ("parent_index long, " if sections else "") + "rank int, concept_id string, concept string, surface string, n_tokens int, occurrences long, chunks long")

    def make() -> Callable[..., list[tuple]]:
        phrases = Phrases()

        def of(text: str | None, said: str | None = None) -> list[tuple]:
            chunks = chunks_of(text)
            if not sections:
                return [(rank, *x) for rank, x in enumerate(inventory_of(chunks, said, budget, phrases))]
            return [(at // FANOUT, rank, *x) for at in range(0, len(chunks), FANOUT) for rank, x in enumerate(inventory_of(chunks[at : at + FANOUT], said, budget, phrases))]

        return of

    return _made(docs, schema, ["text", *(c for c in ("said",) if c in docs.columns)], make)


def enriched_texts(docs: DataFrame, budget: int = C.BUDGET, most: int = 240) -> DataFrame:
    """doc_id, text: what concepts.enriched makes of docs (doc_id, text, summary, and its normal form as said) and their inventories."""

    def make() -> Callable[..., list[tuple]]:
        phrases = Phrases()

        def of(text: str | None, summary: str, said: str) -> list[tuple]:
            lines = [f"\n- {x[2]}" for x in inventory_of(chunks_of(text), said, budget, phrases)]
            out, limit = f"[DOCUMENT SUMMARY]\n{summary.strip(SPACE)}\n\n[KEY CONCEPTS]{''.join(lines)}", len(summary) + most
            return [(out[:limit].rstrip(SPACE) if len(out) > limit else out,)]

        return of

    return _made(docs, _schema(docs, "text string"), ["text", "summary", "said"], make)


def contractions_of(names: Collection[str]) -> Iterator[tuple[str, list[str], str]]:
    """surface, candidates, shape if there is only one, of one group's names, as contractions.resolved has them."""
    tokens = {x: tuple(WORD(x)) for x in names}
    known = set(tokens.values())
    longer: dict[tuple, dict[str, int]] = {}
    for x, t in tokens.items():
        forms = {t[:k]: 0 for k in range(1, len(t))}
        if 2 < len(t) <= X.INNER + 2:
            inner = t[1:-1]
            for k in range(len(inner)):
                for some in combinations(inner, k):
                    forms.setdefault((t[0], *some, t[-1]), 1)
        elif len(t) > 2:
            for s in known:
                if 1 < len(s) < len(t) and s[0] == t[0] and s[-1] == t[-1] and all(w in it for it in [iter(t)] for w in s):
                    forms.setdefault(s, 1)
        for s in forms.keys() & known:
            longer.setdefault(s, {})[x] = forms[s]
    for x, t in tokens.items():
        found = longer.get(t, {})
        yield x, sorted(found), X.ELISION if min(found.values(), default=0) else X.PREFIX


def contractions(docs: DataFrame, most: int = 4) -> DataFrame:
    """doc_id, surface, type, decision, resolved_to, shape, candidates (parted by |) of the phrases of up to `most` tokens that a document (doc_id, text) repeats, whose ids tell them apart."""

    def make() -> Callable[..., list[tuple]]:
        phrases = Phrases()

        def of(text: str | None) -> list[tuple]:
            found = phrases.of(chunks_of(text), most)
            names = [x for x, n in found.counts().items() if n > 1] if found else []
            return [(x, "Phrase", *(("SAME_ENTITY", c[0], shape) if len(c) == 1 else ("ABSTAIN", None, None)), "|".join(c)) for x, c, shape in contractions_of(names)]

        return of

    return _made(docs, _schema(docs, "surface string, type string, decision string, resolved_to string, shape string, candidates string"), ["text"], make)


def corpus_counts(docs: DataFrame, most: int = C.MOST) -> DataFrame:
    """concept, n_tokens, occurrences, chunks, surface (the first): what concepts.merged gives without keys for the packed chunks of docs (doc_id, text), whose ids tell them apart.

    ROWS documents are counted together before their concepts are shuffled, once; a surface goes along only where it is not its concept.
    """
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType(T._parse_datatype_string("concept string, n_tokens int, occurrences long, chunks long").fields + [T.StructField("doc_id", id_type), *T._parse_datatype_string("place int, surface string")])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases()
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            ids, texts = (batch.column(c).to_pylist() for c in ("doc_id", "text"))
            founds, concepts, at = [], [], []
            for i in sorted(range(len(ids)), key=ids.__getitem__):
                found = phrases.of(chunks_of(texts[i]), most)
                if found is None:
                    continue
                parts = [(p, np.full(len(p), n), own) for n, (p, own) in enumerate(found.runs, start=2)]
                if found.chains:
                    p, n, own = zip(*found.chains)
                    parts.append((np.array(p), np.array(n), list(own)))
                place, size, own = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts]), [y for x in parts for y in x[2]]
                order = np.lexsort((size, place))
                concepts += [own[j] for j in order.tolist()]
                at.append(np.stack([np.full(len(order), len(founds)), place[order], size[order], found.chunk[place[order]]]))
                founds.append((i, found))
            if not concepts:
                continue
            all_at = np.concatenate(at, axis=1)
            counts = Counter(concepts)
            first = dict(zip(reversed(concepts), range(len(concepts) - 1, -1, -1)))
            held: dict[str, set] = {}
            least: dict[str, int] = {}
            for j, x in enumerate(concepts):
                if counts[x] > 1:
                    held.setdefault(x, set()).add((all_at[0, j], all_at[3, j]))
                    least[x] = min(least.get(x, most), int(all_at[2, j]))
            own, firsts = list(first), all_at[:, list(first.values())]
            surfaces = [founds[d][1].surface(p, n) for d, p, n in zip(*firsts[:3].tolist())]
            rows = [
                pa.array(own, pa.string()), pa.array([least.get(x, n) for x, n in zip(own, firsts[2].tolist())], pa.int32()), pa.array([counts[x] for x in own], pa.int64()),
                pa.array([len(held[x]) if x in held else 1 for x in own], pa.int64()), batch.column("doc_id").take(pa.array([founds[d][0] for d in firsts[0].tolist()])),
                pa.array(firsts[1], pa.int32()), pa.array([None if s == x else s for s, x in zip(surfaces, own)], pa.string()),
            ]
            yield from pa.Table.from_arrays(rows, schema=arrow).to_batches(10_000)

    each = docs.select("doc_id", "text").mapInArrow(run, schema).repartition("concept")
    first = F.min(F.struct("doc_id", "place", F.coalesce("surface", "concept").alias("surface")))["surface"]
    return each.groupBy("concept").agg(F.min("n_tokens").alias("n_tokens"), F.sum("occurrences").alias("occurrences"), F.sum("chunks").alias("chunks"), first.alias("surface"))
