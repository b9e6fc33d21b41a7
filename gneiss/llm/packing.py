"""Length buckets with least padding, and token-budget batches inside each bucket."""

from __future__ import annotations

from array import array

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import folded, unfolded, written

BUCKETS, BUDGET = 16, 65_536
#: Rows of one (bucket, salt) group, about.
GROUP_ROWS = 100_000


def word_count(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def best_bounds(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """The upper bounds of at most `buckets` buckets over ascending lengths that minimise total padding.

    cost[k][j] = min over i < j of cost[k-1][i] + lengths[j-1] * (n[j] - n[i]) - (t[j] - t[i]), with prefix sums n of
    counts and t of tokens. For fixed j that is the least of lines in lengths[j-1] with slopes -n[i], which fall: the
    lower hull of lines gives each bucket's row in linear time.
    """
    m = len(lengths)
    n, t = [0], [0]
    for length, c in zip(lengths, counts):
        n.append(n[-1] + c)
        t.append(t[-1] + length * c)
    cost, back = [0] + [None] * m, []
    for _ in range(min(buckets, m)):
        hull, row, at, new = [], array("q", [0]) * (m + 1), 0, [None] * (m + 1)
        for j in range(1, m + 1):
            i = j - 1
            if cost[i] is not None:
                line = (-n[i], cost[i] + t[i], i)
                # the middle line goes if the new one is below it where it would begin to be the least
                while len(hull) >= 2 and (line[1] - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - line[0]):
                    hull.pop()
                hull.append(line)
                at = min(at, len(hull) - 1)
            x = lengths[j - 1]
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                at += 1
            if hull:
                new[j], row[j] = hull[at][0] * x + hull[at][1] + x * n[j] - t[j], hull[at][2]
        # fewer buckets stay allowed
        for j in range(m + 1):
            if cost[j] is not None and (new[j] is None or cost[j] <= new[j]):
                new[j], row[j] = cost[j], -1
        cost = new
        back.append(row)
    bounds, j = [], m
    for row in reversed(back):
        if j and row[j] != -1:
            bounds.append(lengths[j - 1])
            j = row[j]
    return bounds[::-1]


def pack(rows: DataFrame, length: str = "n_tokens", key: str = "doc_id", buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """rows with bucket, bucket_tokens (its bound), batch (from 0 in each bucket), batch_slot and padding.

    The histogram of all lengths goes to the driver (16 bytes a distinct length: of t tokens in all there are at most sqrt(2 t) of
    them), and a dynamic program over it finds the bounds of least padding. Every batch holds floor(budget / bound) documents, at least 1 (one document longer than the
    budget makes a batch of its own); the last of each bucket may hold fewer. Within a bucket rows are counted
    by salt (a hash of the row's number), then key: groups of a bounded size are numbered apart and shifted by the counts of those before.

    A null length counts as 0; length 0 is a length as any other; equal or null keys are in any
    order; rows with columns of the added names lose those; an empty table gives an empty result.
    """
    added = ("bucket", "bucket_tokens", "batch", "batch_slot", "padding")
    rows = rows.drop(*added)
    plain = folded(rows, key, length).select(F.col(key).alias("key"), F.coalesce(F.col(length).cast("long"), F.lit(0)).alias("len"), "rest")
    # a row's number is fixed by writing it
    known = written(plain.withColumn("row", F.monotonically_increasing_id()))
    hist = written(known.groupBy("len").count())
    at = hist.toArrow().sort_by("len")
    counts = at.column("count").to_pylist()
    bounds = best_bounds(at.column("len").to_pylist(), counts, buckets) or [0]
    total = sum(counts)
    groups = max(1, -(-total // GROUP_ROWS))

    limits = F.array(*(F.lit(b).cast("long") for b in bounds))
    bucket = F.size(F.filter(limits, lambda b: b < F.col("len")))
    salted = known.withColumn("bucket", bucket).withColumn("bound", F.get(limits, F.col("bucket"))).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(groups)))
    # one row per bucket and salt: the salts grow with the rows, by GROUP_ROWS of them
    before = Window.partitionBy("bucket").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("bucket", "salt").count().select("bucket", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("bucket", "salt").orderBy("key", "row")
    nth = salted.withColumn("nth", F.row_number().over(inside) - 1).join(offsets, ["bucket", "salt"]).withColumn("nth", F.col("nth") + F.col("before"))
    size = F.greatest(F.lit(1), F.expr(f"{budget} div greatest(1, bound)"))
    batch = F.expr(f"nth div greatest(1, {budget} div greatest(1, bound))")
    more = {"bucket": F.col("bucket"), "bucket_tokens": F.col("bound"), "batch": batch, "batch_slot": F.pmod(F.col("nth"), size), "padding": F.col("bound") - F.col("len")}
    return unfolded(nth, rows.columns, {key: F.col("key"), length: F.col("len")}, more)
