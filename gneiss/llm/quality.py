"""Quality by positive-unlabelled learning: non-negative unbiased risk, trusted positives, an estimated class prior."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import raw_texts, written
from .components import sized

#: Newton steps of a fit at most; L2 weight; cells of the histogram that the class prior is read from; confidence.
STEPS, RIDGE, CELLS, DELTA = 14, 1e-3, 400, 0.1
_CLASS = np.zeros(256, np.int64)  # 0: other punctuation
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = 1 if _b >= 128 or "a" <= _c <= "z" else 2 if "A" <= _c <= "Z" else 3 if "0" <= _c <= "9" else 4 if _c in " \t\r\n\v\f" else 5 if _c in "#$%&*@^~" else 6 if _c in "|<>{}[]\\/_=+" else 7 if _c in "!?" else 0
#: Characters (bytes) of an n-gram, and hashed n-grams told apart.
GRAM, GRAMS = 5, 1 << 15
N_FEATURES = 33


def gram_shares(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hashed n-grams of the text, A-Z lower-cased, and the share of each; a text shorter than one n-gram has none."""
    b = np.frombuffer(text.lower(), np.uint8).astype(np.uint32)
    if len(b) < GRAM:
        return np.zeros(0, np.int64), np.zeros(0)
    h = np.zeros(len(b) - GRAM + 1, np.uint32)
    for i in range(GRAM):
        h = h * np.uint32(0x01000193) ^ b[i : len(b) - GRAM + 1 + i]
    h = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - 15)
    if len(h) >= GRAMS // 4:
        shares = np.bincount(h, minlength=GRAMS)
        at = np.nonzero(shares)[0]
        return at, shares[at] / len(h)
    at, counts = np.unique(h, return_counts=True)
    return at.astype(np.int64), counts / len(h)


def gram_weights(docs: DataFrame) -> np.ndarray:
    """docs (text, positive): the log ratio of each hashed n-gram's mean share in trusted positives to that in all texts, from each half of the texts.

    A text's half is told by its bytes, and it takes its weights from the other half, so that none is scored by what was learnt from itself.
    Two sums per n-gram and half reach the driver.
    """
    out = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("v", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 2 * GRAMS + 2))
        for batch in batches:
            for text, positive in zip(raw_texts(batch), batch.column("positive").to_pylist()):
                (at, shares), own = gram_shares(text), total[half(text)]
                own[at] += shares
                own[2 * GRAMS] += 1
                if positive:
                    own[GRAMS + at] += shares
                    own[2 * GRAMS + 1] += 1
        total = total.ravel()
        used = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["k", "v"])

    got = np.zeros(2 * (2 * GRAMS + 2))
    for r in docs.select("text", "positive").mapInArrow(run, out).groupBy("k").agg(F.sum("v").alias("v")).collect():
        got[r.k] = r.v
    out = np.zeros((2, GRAMS))
    for own, weights in zip(got.reshape(2, -1), out):
        if own[-1]:
            weights[:] = np.log((own[GRAMS : 2 * GRAMS] / own[-1] + 0.02 / GRAMS) / (own[:GRAMS] / own[-2] + 0.02 / GRAMS))
    return out


def half(text: bytes) -> int:
    return zlib.crc32(text) & 1


def gram_features(text: bytes, weights: np.ndarray) -> list[float]:
    """The mean weight of the text's n-grams, and the shares of those that trusted texts have far less and far more."""
    at, shares = gram_shares(text)
    w = weights[1 - half(text)][at]
    return [float(shares @ w), float(shares[w < -0.7].sum()), float(shares[w > 0.3].sum())]


def features(text: bytes) -> list[float]:
    """Shares of byte classes and of repeated words and lines, and lengths; each also as a root, which tells small shares apart. Empty: all 0."""
    n = len(text)
    if not n:
        return [0.0] * (N_FEATURES - 3)
    kinds = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(text, np.uint8), minlength=256), minlength=8) / n
    words = text.lower().split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    counts = Counter(words)
    w = max(1, len(words))
    same = sum(a == b for a, b in zip(words, words[1:])) / w
    odd = sum(1 for x in words if not (x[-1] >= 97 or x[-1] in b".,")) / w
    lone = sum(1 for x in words if len(x) == 1 and not x.isalnum()) / w
    shares = [
        kinds[0], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], kinds[7], same, odd, lone,
        1 - len(counts) / w, max(counts.values(), default=0) / w, 1 - len(set(lines)) / max(1, len(lines)),
    ]
    sizes = [math.log1p(n), math.log1p(n / w), math.log1p(n / max(1, len(lines))), math.log1p(w)]
    return [*shares, *(math.sqrt(x) for x in shares), *sizes]


def featured(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """Write doc_id, positive and the features of each whole text as packed doubles."""
    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("positive", T.BooleanType()), T.StructField("x", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [np.array([*features(t), *gram_features(t, weights)]).tobytes() for t in raw_texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("positive"), pa.array(x, pa.binary())], names=out.names)

    return written(docs.select("doc_id", "positive", "text").mapInArrow(run, out), {"compression": "zstd"})


def _sums(rows: DataFrame, of, size: int) -> np.ndarray:
    """of(x, positive) gives a vector of `size` for each batch of feature rows; their sum over all rows."""
    out = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("v", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float64).reshape(-1, N_FEATURES)
                total += of(x, np.array(batch.column("positive").to_pylist(), bool))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], names=["k", "v"])

    got = np.zeros(size)
    for r in rows.select("x", "positive").mapInArrow(run, out).groupBy("k").agg(F.sum("v").alias("v")).collect():
        got[r.k] = r.v
    return got


def _z(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.hstack([np.ones((len(x), 1)), np.clip((x - mean) / scale, -8, 8)])


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(_z(x, self.mean, self.scale) @ self.weights)


def _newton(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, statistics, objective) -> np.ndarray:
    """Newton steps, one pass over all rows each. A step that doesn't lower the risk is halved."""
    d = N_FEATURES + 1
    w, step, last = np.zeros(d), None, math.inf
    for _ in range(STEPS):
        at = w.copy()
        s = _sums(rows, lambda x, p, at=at: statistics(_z(x, mean, scale), p, at), 2 * (d + d * d + 3) + d)
        risk, gradient, hessian = objective(s, w)
        if risk > last + 1e-12:
            step = step / 2
            w = before + step
            continue
        if last - risk < 1e-7:
            break
        before, last = w, risk
        step = -np.linalg.solve(hessian + RIDGE * np.eye(d), gradient + RIDGE * w)
        step *= min(1.0, 12 / max(1e-9, float(np.abs(step).max())))
        w = before + step
    return before if risk > last + 1e-12 else w


def _statistics(z: np.ndarray, positive: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of the positives and of all rows: count, sums of softplus(f), softplus(-f), of z * sigmoid(f), of the Hessian; and of the positives' z."""
    out = []
    for rows in (z[positive], z):
        f = rows @ w
        p = _sigmoid(f)
        out += [[len(rows), _softplus(f).sum(), _softplus(-f).sum()], p @ rows, ((rows * (p * (1 - p))[:, None]).T @ rows).ravel()]
    return np.concatenate([*out, z[positive].sum(axis=0)])


def _parts(s: np.ndarray) -> tuple[list[tuple[float, float, float, np.ndarray, np.ndarray]], np.ndarray]:
    d, at, out = N_FEATURES + 1, 0, []
    for _ in range(2):
        n = max(1.0, s[at])
        out.append((s[at], s[at + 1] / n, s[at + 2] / n, s[at + 3 : at + 3 + d] / n, s[at + 3 + d : at + 3 + d + d * d].reshape(d, d) / n))
        at += 3 + d + d * d
    return out, s[at:] / max(1.0, out[0][0])


def fit(rows: DataFrame) -> Model:
    """rows: x and positive (trusted); all rows are the unlabelled sample. Two fits, each over all rows.

    The first tells positives from unlabelled rows; the class prior is the least share of unlabelled to
    positive rows above a threshold on its score, at the threshold with the least upper confidence bound. The second minimises
    prior * E+[l(f)] + max(0, E[l(-f)] - prior * E+[l(-f)]) for the logistic loss l. No labels but the trusted positives are used.

    Without positives, or without rows, the model scores every text 1 (nothing is known to be bad).
    """
    d = N_FEATURES
    s = _sums(rows, lambda x, p: np.concatenate([[len(x), p.sum()], x.sum(axis=0), (x * x).sum(axis=0)]), 2 + 2 * d)
    n_all, n_pos = s[0], s[1]
    mean = s[2 : 2 + d] / max(1, n_all)
    scale = np.sqrt(np.maximum(s[2 + d :] / max(1, n_all) - mean**2, 1e-12)) + 1e-3
    if not n_pos:
        return Model(mean, scale, np.concatenate([[40.0], np.zeros(d)]), 1.0)

    def told_apart(s: np.ndarray, w: np.ndarray):
        (_, _, away, p_grad, p_hess), (_, near, _, u_grad, u_hess) = _parts(s)[0]
        positive_mean = _parts(s)[1]
        return away + near + RIDGE * (w @ w) / 2, p_grad - positive_mean + u_grad, p_hess + u_hess

    first = _newton(rows, mean, scale, _statistics, told_apart)
    prior = estimate_prior(rows, mean, scale, first, n_pos, n_all)

    def non_negative(s: np.ndarray, w: np.ndarray):
        (_, p_near, p_away, p_grad, p_hess), (_, u_near, _, u_grad, u_hess) = _parts(s)[0]
        positive_mean = _parts(s)[1]
        if u_near - prior * p_near < 0:
            # the bracket counts as 0
            return prior * p_away + RIDGE * (w @ w) / 2, prior * (p_grad - positive_mean), prior * p_hess
        # l(f) - l(-f) = -f: the positives' two terms are linear together
        return u_near - prior * p_near + prior * p_away + RIDGE * (w @ w) / 2, u_grad - prior * positive_mean, u_hess

    return Model(mean, scale, _newton(rows, mean, scale, _statistics, non_negative), prior)


def estimate_prior(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, n_pos: float, n_all: float) -> float:
    """The share of positives among all rows, from how they and the trusted ones share the classifier's top scores."""

    def cells(x: np.ndarray, p: np.ndarray) -> np.ndarray:
        at = np.minimum((_sigmoid(_z(x, mean, scale) @ weights) * CELLS).astype(int), CELLS - 1)
        return np.concatenate([np.bincount(at[p], minlength=CELLS), np.bincount(at, minlength=CELLS)])

    h = _sums(rows, cells, 2 * CELLS)
    pos, every = np.cumsum(h[:CELLS][::-1]) / n_pos, np.cumsum(h[CELLS:][::-1]) / n_all
    slack = math.sqrt(math.log(4 / DELTA) / 2 / n_all) + math.sqrt(math.log(4 / DELTA) / 2 / n_pos)
    ok = pos > 0
    best = np.argmin(np.where(ok, (every + slack) / np.where(ok, pos, 1), np.inf))
    return float(min(0.999, max(0.001, every[best] / pos[best])))


def score_quality(docs: DataFrame, positives: DataFrame) -> DataFrame:
    """Learn from all texts of docs and the doc_ids in `positives`; return doc_id and score in [0, 1] of every row.

    A text's features are shares of bytes, words and lines, and how much more trusted texts use its hashed n-grams than all texts do.

    Null and empty texts have all-zero features and a score like any other; rows with a null doc_id are
    scored and never trusted; repeated rows count as often as they occur; an empty docs gives no rows. Other
    columns of docs are never read.
    """
    known = positives.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("positive", F.lit(True))
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sized(written(known)), "doc_id", "left").select("doc_id", "text", F.coalesce("positive", F.lit(False)).alias("positive"))
    rows = featured(marked, gram_weights(marked))
    model = fit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float64).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(x))], names=["doc_id", "score"])

    return rows.select("doc_id", "x").mapInArrow(run, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())]))
