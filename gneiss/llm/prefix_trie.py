"""Tries of conversation prefixes: a Z-fast trie whose table of handles is a Spark table, filled in batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Digest of the empty sequence; ids of one row of ends.
ROOT, END_BITS = bytes(16), 12


def hashed_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, sig, words) of turns (conv_id, turn, role, text): order by turn, null first, equal ones by hash. A null role or text is empty; turns without conv_id belong to none."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    known = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("at"), F.substring(F.unhex(F.sha2(whole, 256)), 1, 16).alias("sig"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words")
    )
    return known.select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("at"), "sig")).alias("pos"), "sig", "words")


def rebuilt(turns: DataFrame, family: int = 20, heads: int = 4) -> DataFrame:
    """Every conversation c as (conv_id, path): the first h turns of conversation c - c % family, then its own after its first h; h = crc32(decimal c) % heads.

    A head of a family is joined to its `family` conversations and has fewer than `heads` turns.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads))
    ids = written(turns.select("conv_id").distinct().withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % family))
    first = turns.where(F.col("pos") < heads).select(F.col("conv_id").alias("base"), "pos", "sig", "words")
    begun = ids.join(first, "base").where(F.col("pos") <= F.col("h")).select("conv_id", F.lit(0).alias("part"), "pos", "sig", "words")
    own = turns.where(F.col("pos") > F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads))).select("conv_id", F.lit(1).alias("part"), "pos", "sig", "words")
    return sequences(ids.select("conv_id"), begun.unionByName(own))


def sequences(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, turns) of every id: its turns by (part, pos), one array a conversation of about 40 bytes a turn; none for an id without turns."""
    lists = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "pos", "sig", "words"))).alias("turns"))
    return ids.join(lists, "conv_id", "left").select("conv_id", F.col("turns.sig").alias("sigs"), F.col("turns.words").alias("words"))


def prefixes(convs: DataFrame) -> DataFrame:
    """(conv_id, key, n, path, upto): digests of all prefixes, the last of which is key, and words up to each depth from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, paths, upto = [], [], []
            for sigs, words in zip(batch.column("sigs").to_pylist(), batch.column("words").to_pylist()):
                path, last = [], ROOT
                for sig in sigs or []:
                    last = hashlib.sha256(last + sig).digest()[:16]
                    path.append(last)
                keys.append(last)
                paths.append(path)
                upto.append(list(accumulate(words or [], initial=0)))
            sizes = pa.array([len(p) for p in paths], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(keys, pa.binary()), sizes, pa.array(paths, pa.list_(pa.binary())), pa.array(upto, pa.list_(pa.int64()))], names=["conv_id", "key", "n", "path", "upto"])

    return convs.mapInArrow(run, "conv_id long, key binary, n int, path array<binary>, upto array<long>")


def fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] with the most trailing zero bits."""
    return F.when(low < high, high.bitwiseAND(F.expr("-1").bitwiseXOR(F.call_function("shiftleft", F.lit(1), F.length(F.bin(low.bitwiseXOR(high))) - 1) - 1)))


def _handles(nodes: DataFrame) -> DataFrame:
    """The hash table: the digest of each edge at its two-fattest depth, and the node below the edge."""
    f = fattest(F.col("a"), F.col("b"))
    return nodes.where("b > 0").select(F.get("label", f - F.col("a") - 1).alias("handle"), F.col("node").alias("h_node"), F.col("b").alias("h_b"))


def locate(active: DataFrame, nodes: DataFrame, steps: int) -> DataFrame:
    """active (key, n, path, upto, l: depth of a node on its path) with `exit`, the depth at which its path leaves the trie, and `edge`, the node below the edge that it leaves inside of.

    Fat binary search: each step looks up the prefix at the two-fattest depth of what is left of (l, n]; a node that is a
    prefix of the path raises the lower end, anything else lowers the upper one. Rows that are done look up
    a key of their own that no handle has.
    """
    handles = _handles(nodes)
    x = active.withColumn("r", F.col("n"))
    for _ in range(steps):
        f = fattest(F.col("l"), F.col("r"))
        x = x.withColumn("f", f).withColumn("probe", F.coalesce(F.get("path", F.col("f") - 1), F.concat("key", F.lit(b"-")))).join(handles, F.col("probe") == F.col("handle"), "left")
        held = F.coalesce((F.col("h_b") <= F.col("n")) & (F.get("path", F.col("h_b") - 1) == F.col("h_node")), F.lit(False))
        x = x.select("key", "n", "path", "upto", F.when(held, F.col("h_b")).otherwise(F.col("l")).alias("l"), F.when(held | F.col("f").isNull(), F.col("r")).otherwise(F.col("f") - 1).alias("r"))
    first = nodes.where("b > 0").select(F.get("label", F.lit(0)).alias("first"), F.col("node").alias("edge"), "label")
    x = x.withColumn("next", F.coalesce(F.get("path", F.col("l")), F.concat("key", F.lit(b"-")))).join(first, F.col("next") == F.col("first"), "left")
    same = F.size(F.filter(F.zip_with("label", F.slice("path", F.col("l") + 1, F.size("label")), lambda p, q: p == q), lambda e: e))
    return x.select("key", "n", "path", "upto", (F.col("l") + F.when(F.col("label").isNotNull(), same).otherwise(0)).alias("exit"), "edge")


def _edge(node: Column, a: Column, b: Column, above: Column, label: Column, upto: Column) -> Column:
    """A node with the edge (a, b] above it: digests of the depths a + 1 to b, and words up to each from a on."""
    return F.struct(node.alias("node"), a.alias("a"), b.alias("b"), above.alias("above"), label.alias("label"), upto.alias("upto"))


def insert(nodes: DataFrame, located: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trie with one batch more, and the sequences that are left with the depth of the node where they left it.

    The batch: of all sequences that leave the trie at one place by one turn, the one with the smallest hash of its key, as
    a leaf. Edges are split wherever a sequence leaves or ends inside of them.
    """
    out = located.where(F.col("exit") < F.col("n")).withColumn("by", F.get("path", F.col("exit")))
    chosen = out.groupBy("by").agg(F.min(F.struct(F.xxhash64("key"), "key"))["key"].alias("key")).select("key", F.lit(True).alias("chosen"))
    out = written(out.drop("by").join(chosen, "key", "left"))
    above = F.when(F.col("exit") == 0, F.lit(ROOT)).otherwise(F.get("path", F.col("exit") - 1))
    leaves = out.where("chosen").select(_edge(F.col("key"), F.col("exit"), F.col("n"), above, F.slice("path", F.col("exit") + 1, F.col("n") - F.col("exit")), F.slice("upto", F.col("exit") + 1, F.col("n") - F.col("exit") + 1)).alias("e")).select("e.*")
    cuts = located.where("edge IS NOT NULL").groupBy(F.col("edge").alias("node")).agg(F.array_sort(F.collect_set("exit")).alias("cuts"))
    at = lambda depth: F.get("label", depth - F.col("a") - 1)
    piece = lambda low, high: _edge(
        at(high), low, high, F.when(low == F.col("a"), F.col("above")).otherwise(at(low)), F.slice("label", low - F.col("a") + 1, high - low), F.slice("upto", low - F.col("a") + 1, high - low + 1)
    )
    split = nodes.join(cuts, "node", "left")
    whole = split.where("cuts IS NULL").drop("cuts")
    bounds = F.concat(F.array("a"), "cuts", F.array("b"))
    parts = split.where("cuts IS NOT NULL").withColumn("bounds", bounds).select(F.explode(F.transform(F.sequence(F.lit(0), F.size("cuts")), lambda i: piece(F.get("bounds", i), F.get("bounds", i + 1)))).alias("e")).select("e.*")
    return written(whole.unionByName(parts).unionByName(leaves)), out.where("chosen IS NULL").select("key", "n", "path", "upto", F.col("exit").alias("l"))


def z_fast_trie(distinct: DataFrame) -> DataFrame:
    """The compacted trie of distinct sequences (key, n, path, upto): node, a, b, above, label, upto. Nodes are branchings and ends, and the root.

    The smallest hash is a random choice, so a sequence's place among those that leave where it does about halves
    with every batch: batches grow with the logarithm of the sequences. Each takes as many lookups as a path's length has bits.
    """
    spark = distinct.sparkSession
    nodes = spark.createDataFrame([(ROOT, 0, 0, None, [], [0])], "node binary, a int, b int, above binary, label array<binary>, upto array<long>")
    active, longest = written(distinct.where("n > 0").select("key", "n", "path", "upto", F.lit(0).alias("l"))), 0
    while True:
        now = active.agg(F.max(F.col("n") - F.col("l"))).first()[0]
        if now is None:
            return nodes
        # nothing is looked up in an empty trie
        located = written(locate(active, nodes, now.bit_length() if longest else 0))
        longest = max(longest, now)
        nodes, left = insert(nodes, located)
        active = written(left)


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """nodes (node, above, and longs) with the sums of the longs over each subtree, and the least `conv_id`.

    Pointers to ancestors double: after k rounds a row has the sums of what is less than 2**k below it.
    """
    counts = [c for c in nodes.columns if c not in ("node", "above", "conv_id")]
    s = written(nodes.withColumnRenamed("above", "up"))
    while not s.where("up IS NOT NULL").isEmpty():
        below = s.where("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(*(F.sum(c).alias(f"+{c}") for c in counts), F.min("conv_id").alias("+conv_id"))
        # children of the root need no lookup to learn that nothing is above it
        higher = s.where("up IS NOT NULL").select(F.col("node").alias("up"), F.col("up").alias("higher"))
        s = written(
            s.join(below, "node", "left").join(higher, "up", "left")
            .select("node", F.col("higher").alias("up"), *((F.col(c) + F.coalesce(f"`+{c}`", F.lit(0))).alias(c) for c in counts), F.least("conv_id", "`+conv_id`").alias("conv_id"))
        )
    return s.drop("up")


def _ends(convs: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the conversations that end at each node.

    Ids are joined to strings of at most 2**END_BITS ids, and the strings of a node are hashed one after another as they
    arrive in order, so that no group is held.
    """
    blocks = convs.groupBy("key", F.shiftright("conv_id", END_BITS).alias("block")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        for batch in batches:
            keys, hashes = [], []
            for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                if key != at:
                    if at is not None:
                        keys.append(at)
                        hashes.append(digest.hexdigest())
                    at, digest = key, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pydict({"node": pa.array(keys, pa.binary()), "ends_sha256": pa.array(hashes, pa.string())})
        if at is not None:
            yield pa.RecordBatch.from_pydict({"node": pa.array([at], pa.binary()), "ends_sha256": pa.array([digest.hexdigest()], pa.string())})

    return blocks.repartition("key").sortWithinPartitions("key", "block").mapInArrow(run, "node binary, ends_sha256 string")


def prefix_nodes(convs: DataFrame) -> DataFrame:
    """Every node of the trie of conversations (conv_id, sigs, words), each edge expanded to its depths: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    saved_tokens sums, over the subtree, a node's members but one times the words of its turn. With T the words of a
    whole conversation that is the sum of T over the members, less the words above the subtree once a member, less the words of the subtree's turns.

    A conversation without turns is a member of the root alone; copies meet in one sequence before the trie is built; conv_ids are
    distinct (repeated ones count each); an empty table has no nodes.
    """
    convs = written(prefixes(convs))
    copies = convs.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("members"), F.sum(F.element_at("upto", -1)).alias("total"))
    copies = written(copies)
    distinct = convs.join(copies.select("conv_id"), "conv_id", "left_semi").dropDuplicates(["key"])
    nodes = z_fast_trie(distinct)
    kids = nodes.where("b > 0").groupBy(F.col("above").alias("node")).agg(F.count("*").alias("kids"))
    known = written(nodes.join(kids, "node", "left").join(copies.withColumnRenamed("key", "node"), "node", "left").join(_ends(convs), "node", "left").drop("label"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    edge = F.element_at("upto", -1) - F.get("upto", F.lit(0))
    sums = subtree_sums(known.select("node", "above", "conv_id", zero("members"), zero("total"), edge.alias("once"), F.col("kids").isNull().cast("long").alias("leaves")))
    full = known.drop("conv_id", "members", "total").join(sums, "node").where("members > 0")
    parents = sums.select(F.col("node").alias("above"), F.col("conv_id").alias("parent"))
    top = F.get("upto", F.lit(0))
    saved = F.col("total") - F.col("members") * top - F.col("once")
    full = full.join(parents, "above", "left").withColumn("below", saved - (F.col("members") - 1) * edge)
    depths = full.select("*", F.explode(F.when(F.col("b") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.col("a") + 1, F.greatest("b", F.col("a") + 1)))).alias("d"))
    last = F.col("d") == F.col("b")
    rest = F.when(F.col("d") > 0, (F.col("members") - 1) * (F.element_at("upto", -1) - F.get("upto", F.col("d") - F.col("a") - 1))).otherwise(0)
    return depths.select(
        "conv_id", F.col("d").cast("long").alias("depth"), F.when(F.col("d") > F.col("a") + 1, F.col("conv_id")).otherwise(F.col("parent")).alias("parent_conv_id"), F.col("members").alias("n_convs"),
        F.when(last, F.coalesce("kids", F.lit(0))).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("below") + rest).alias("saved_tokens"),
        F.when(last, F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256))).otherwise(F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )
