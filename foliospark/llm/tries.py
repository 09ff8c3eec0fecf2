"""The prefix trie of conversations, families of which share a beginning: merged within families first, then across.

Turns are put in order by ranges of (conversation, turn) and counted in one pass, so a conversation of any length lies in
as many partitions as it needs. From then on a turn is two hashes and a number of words. Conversations are cogrouped
with the beginning of their family's base by (family, partition): each group, which a range bounds, rebuilds its
conversations and builds the family's small trie, whose nodes list the few members that a family has. Only these
combined nodes are shuffled to be merged with those of other families.

A node is known by 128 bits, the exclusive or of hashes of (depth, turn) along its path, so a path can be continued from
one partition in the next. Every node belongs to the least conversation that runs through it; what a conversation owns is
the last part of its path. Sums over a subtree then are sums over the node's members of what each owns, less what the
owner has above the node, and need no walk over levels.

Defined results: turns are in order by turn (null first), then role, then text; null roles and texts are empty;
repeated rows are turns of their own; rows without a conversation are left out; an empty table has no nodes, not even
a root; columns of other names are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.kernel import U, mix
from foliospark.llm.mixing import size_of
from foliospark.llm.shared import Kept, Scratch, spread_join
from foliospark.ship import ship

FAMILY, MOST_HEAD = 20, 3


def crc_head(conv: Column) -> Column:
    """0 to MOST_HEAD turns, by crc32 of the id."""
    return F.crc32(conv.cast("string").cast("binary")) % (MOST_HEAD + 1)


def terms(depth: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two columns of hashes of a turn (64-bit hashes a and b) at a depth."""
    d, a, b = depth.astype(U), a.view(U), b.view(U)
    one = mix(mix(a ^ (d * U(0x9E3779B97F4A7C15))) + b * U(0xC2B2AE3D27D4EB4F))
    two = mix(mix(b + d * U(0xFF51AFD7ED558CCD)) ^ (a * U(0x9FB21C651E98DF25)))
    return np.stack((one, two), axis=1)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of conversations: ``nth`` within the conversation in this partition."""
    last, count = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column("conv_id").to_numpy()
        fresh = np.concatenate(([True], conv[1:] != conv[:-1]))
        first = np.flatnonzero(fresh)
        of = np.cumsum(fresh) - 1
        nth = np.arange(len(conv)) - first[of]
        if conv[0] == last:
            nth[of == 0] += count
        last, count = conv[-1], int(nth[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nth)], names=[*batch.schema.names, "nth"])


def ordered(turns: DataFrame) -> DataFrame:
    """(conv_id, part, nth, a, b, words): turns in order within ranges."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    rows = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role, text, F.monotonically_increasing_id().alias("row"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "row"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    narrow = ranged.select("conv_id", F.spark_partition_id().alias("part"), F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(7), "text", "role").alias("b"), size_of(F.col("text")).alias("words"))
    return narrow.mapInArrow(_numbered, "conv_id long, part int, a long, b long, words long, nth long")


def _xors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The exclusive or of a batch's own turns, by conversation and partition."""
    for batch in batches:
        column = lambda c: batch.column(c).to_numpy()  # noqa: B023, E731
        term = terms(column("depth"), column("a"), column("b"))
        pairs = np.stack((column("conv_id"), column("part")), axis=1)
        keys, of = np.unique(pairs, axis=0, return_inverse=True)
        out = np.zeros((len(keys), 2), U)
        np.bitwise_xor.at(out, of.ravel(), term)
        yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1].astype(np.int32)), *(pa.array(out[:, i].view(np.int64)) for i in (0, 1))], names=["conv_id", "part", "x1", "x2"])


def pieces(placed: DataFrame, head: Callable[[Column], Column], family: int, scratch: Scratch) -> DataFrame:
    """A row for each conversation and partition: what its turns there need to be put into the trie.

    start: own turns in earlier partitions; n: own turns in all; base: (a, b, words) of the turns that it takes from
    the base; x1, x2: hashes of its own turns in earlier partitions.
    """
    every = Window.partitionBy("conv_id")
    before = every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("conv_id", "part").agg(F.count("*").alias("here"))
    parts = counts.select(
        "conv_id", "part", "here", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("start"), F.sum("here").over(every).alias("n"),
        F.count("*").over(every).alias("n_parts"), (F.min("part").over(every) == F.col("part")).alias("first"),
    )
    parts = scratch.keep(parts.withColumn("family", F.col("conv_id") - F.col("conv_id") % family).withColumn("head", head(F.col("conv_id")).cast("int")), "parts")
    is_base = F.col("conv_id") % family == 0
    leads = placed.where(is_base & (F.col("nth") < MOST_HEAD)).join(parts.where(is_base & (F.col("start") < MOST_HEAD)).select("conv_id", "part", "start"), ["conv_id", "part"])
    leads = leads.withColumn("idx", F.col("nth") + F.col("start")).where(F.col("idx") < MOST_HEAD)
    bases = leads.groupBy(F.col("conv_id").alias("family")).agg(F.sort_array(F.collect_list(F.struct("idx", "a", "b", "words"))).alias("base"))
    taken = F.slice(F.coalesce("base", F.array().cast("array<struct<idx: long, a: long, b: long, words: long>>")), 1, F.col("head"))
    whole = parts.join(bases, "family", "left").withColumn("base", taken)
    split = whole.where("n_parts > 1")
    if split.isEmpty():
        return whole.withColumns({"x1": F.lit(0).cast("long"), "x2": F.lit(0).cast("long")})
    # Only the first and the last conversation of a range can reach beyond it: two rows a partition at most.
    split = scratch.keep(split, "split")
    own = placed.join(F.broadcast(split.select("conv_id", "part", "start", "head", F.size("base").alias("taken"))), ["conv_id", "part"])
    own = own.withColumn("depth", F.col("taken") + F.col("start") + F.col("nth") - F.col("head") + 1).where(F.col("start") + F.col("nth") >= F.col("head"))
    sums = own.select("conv_id", "part", "depth", "a", "b").mapInArrow(_xors, "conv_id long, part int, x1 long, x2 long").groupBy("conv_id", "part").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    sums = split.select("conv_id", "part").join(sums, ["conv_id", "part"], "left")
    sums = sums.select("conv_id", "part", *[F.bit_xor(F.coalesce(x, F.lit(0).cast("long"))).over(before).alias(x) for x in ("x1", "x2")])
    zero = F.lit(0).cast("long")
    return whole.join(F.broadcast(sums), ["conv_id", "part"], "left").withColumns({x: F.coalesce(x, zero) for x in ("x1", "x2")})


_NODE = "h1 long, h2 long, p1 long, p2 long, depth long, words long, part int, members array<long>, ends array<long>"


def _family_trie(left: pa.Table, right: pa.Table) -> pa.Table:
    """The nodes that a family's conversations have in one partition, with the members that run through and end in each."""
    rows = left.sort_by([("conv_id", "ascending"), ("nth", "ascending")])
    conv, a, b, words = (rows[c].to_numpy() for c in ("conv_id", "a", "b", "words"))
    paths = []
    for r in right.to_pylist():
        lo, hi = np.searchsorted(conv, r["conv_id"], "left"), np.searchsorted(conv, r["conv_id"], "right")
        lo += min(max(0, r["head"] - r["start"]), hi - lo)
        taken = len(r["base"])
        depth = taken + max(r["start"], r["head"]) - r["head"] + 1 + np.arange(hi - lo)
        base = [np.array([t[c] for t in r["base"]], np.int64) for c in ("a", "b", "words")]
        lead = terms(np.arange(1, taken + 1), base[0], base[1])
        start = np.bitwise_xor.reduce(lead, axis=0) ^ np.array([r["x1"], r["x2"]], np.int64).view(U)
        own = terms(depth, a[lo:hi], b[lo:hi])
        path = np.bitwise_xor.accumulate(np.concatenate((start[None], own)), axis=0)
        parent, node, size = path[:-1], path[1:], words[lo:hi]
        if r["first"]:
            above = np.bitwise_xor.accumulate(np.concatenate((np.zeros((1, 2), U), lead)), axis=0)
            depth = np.concatenate((np.arange(taken + 1), depth))
            parent = np.concatenate((np.zeros((1, 2), U), above[:-1], parent))
            node, size = np.concatenate((above, node)), np.concatenate(([0], base[2], size))
        is_end = np.zeros(len(depth), bool)
        if len(depth):
            is_end[-1] = r["start"] + r["here"] == r["n"] and hi > lo or r["first"] and r["n"] <= r["head"]
        paths.append((node, parent, depth, size, np.full(len(depth), r["conv_id"]), is_end))
    node, parent, depth, size, of, is_end = (np.concatenate(x) for x in zip(*paths, strict=True))
    order = np.lexsort((of, node[:, 1], node[:, 0]))
    node, parent, depth, size, of, is_end = (x[order] for x in (node, parent, depth, size, of, is_end))
    first = np.flatnonzero(np.concatenate(([True], (node[1:] != node[:-1]).any(axis=1)))) if len(node) else np.zeros(0, np.int64)
    ids, long = pa.int64(), lambda x: pa.array(np.ascontiguousarray(x).view(np.int64))
    lists = lambda values, starts: pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), pa.array(values, ids))
    ends = np.concatenate(([0], np.cumsum(is_end)))[first]
    part = right["part"][0].as_py() if right.num_rows else 0
    columns = [long(node[first, 0]), long(node[first, 1]), long(parent[first, 0]), long(parent[first, 1]), pa.array(depth[first]), pa.array(size[first])]
    columns += [pa.array([part] * len(first), pa.int32()), lists(of, first), lists(of[is_end], ends)]
    return pa.Table.from_arrays(columns, names=["h1", "h2", "p1", "p2", "depth", "words", "part", "members", "ends"])


#: Ids that one row of an end list has at most.
PIECE = 10_000


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by node and id: the ids of a node, joined by commas, PIECE at a time at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, conv = (batch.column(c).to_numpy() for c in ("h1", "h2", "conv"))
        first = np.flatnonzero(np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))))
        first = np.union1d(first, np.arange(0, len(conv), PIECE))
        ids = conv.tolist()
        lists = [",".join(map(str, ids[i:j])) for i, j in zip(first.tolist(), [*first[1:].tolist(), len(ids)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(h1[first]), pa.array(h2[first]), pa.array(conv[first]), pa.array(lists)], names=["h1", "h2", "first", "ids"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by node and first id: the digest of each node's lists, joined by commas, one list at a time."""
    at, digest = None, None
    for batch in batches:
        done = []
        for h1, h2, ids in zip(*(batch.column(c).to_pylist() for c in ("h1", "h2", "ids")), strict=True):
            if (h1, h2) == at:
                digest.update(b"," + ids.encode())
                continue
            if at is not None:
                done.append((*at, digest.hexdigest()))
            at, digest = (h1, h2), hashlib.sha256(ids.encode())
        if done:
            yield _digests(done)
    if at is not None:
        yield _digests([(*at, digest.hexdigest())])


def _digests(done: list[tuple[int, int, str]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)], names=["h1", "h2", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(h1, h2, ends_sha256) of (h1, h2, conv). Lists are made in ranges of (node, id), so that the one task that a digest needs sees them joined already."""
    order = ["h1", "h2", "conv"]
    lists = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_listed, "h1 long, h2 long, first long, ids string")
    by_node = lists.repartition("h1", "h2").sortWithinPartitions("h1", "h2", "first")
    return by_node.mapInArrow(_digested, "h1 long, h2 long, ends_sha256 string")


def family_nodes(turns: DataFrame, head: Callable[[Column], Column] = crc_head, family: int = FAMILY) -> tuple[DataFrame, DataFrame]:
    """(nodes of each family and partition with members and ends, a row for each conversation and partition), both kept.

    head: how many leading turns (MOST_HEAD at most) a conversation takes from its base instead of its own.
    """
    ship(turns.sparkSession)
    scratch = Scratch()
    placed = scratch.keep(ordered(turns), "turns")
    parts = Kept(pieces(placed, head, family, scratch), "pieces").frame
    mine = placed.withColumn("family", F.col("conv_id") - F.col("conv_id") % family)
    nodes = mine.groupBy("family", "part").cogroup(parts.groupBy("family", "part")).applyInArrow(_family_trie, _NODE)
    nodes = Kept(nodes, "family-nodes").frame
    scratch.clear()
    return nodes, parts.select("conv_id", "part")


def conversation_trie(turns: DataFrame, head: Callable[[Column], Column] = crc_head, family: int = FAMILY) -> DataFrame:
    """A row for each node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, and the 128 bits (h1, h2) that it is known by; (p1, p2) is its parent.

    saved_tokens: over the subtree, what sharing a node's last turn spares: its words for every member but one.
    """
    local, parts = family_nodes(turns, head, family)
    key = ["h1", "h2"]
    owner = F.min(F.struct(F.array_min("members").alias("conv"), "part")).alias("owner")
    same = [F.first(c).alias(c) for c in ("p1", "p2", "depth", "words")]
    merged = Kept(local.groupBy(*key).agg(owner, F.sum(F.size("members")).alias("n_convs"), *same).select(*key, "p1", "p2", "depth", "words", "n_convs", "owner.conv", "owner.part"), "merged").frame
    below = merged.where("depth > 0")
    children = below.groupBy(F.col("p1").alias("h1"), F.col("p2").alias("h2")).agg(F.count("*").alias("n_children"))
    count = F.coalesce("n_children", F.lit(0).cast("long"))
    nodes = merged.join(children, key, "left").withColumns({"n_children": count, "own": (F.col("n_convs") - 1) * F.col("words"), "leaf": (count == 0).cast("long")})
    nodes = Kept(nodes, "nodes").frame

    # What a conversation owns, in the order of its path; a long path has a part in each partition.
    in_part = Window.partitionBy("conv", "part").orderBy("depth")
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = nodes.groupBy("conv", "part").agg(F.sum("own").alias("own"), F.sum("leaf").alias("leaf"))
    starts = sums.select("conv", "part", F.sum("own").over(earlier).alias("above_part"))
    owned = sums.groupBy("conv").agg(F.sum("own").alias("own"), F.sum("leaf").alias("leaf"))
    above = F.coalesce(F.sum("own").over(in_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = nodes.withColumn("above", above).withColumn("rank", F.row_number().over(in_part)).join(starts, ["conv", "part"])
    placed = placed.withColumn("is_top", (F.col("rank") == 1) & F.col("above_part").isNull()).withColumn("above", F.col("above") + F.coalesce("above_part", F.lit(0)))
    placed = Kept(placed.select(*key, "p1", "p2", "depth", "conv", "n_convs", "n_children", "above", "is_top"), "placed").frame

    # Sums over members, in each part of each conversation first.
    shares = parts.join(owned, F.col("conv_id") == F.col("conv")).select("conv", "part", "own", "leaf").where("own > 0 or leaf > 0")
    through = local.select(*key, "part", F.explode("members").alias("conv")).join(shares, ["conv", "part"])
    totals = through.groupBy(*key).agg(F.sum("own").alias("owned"), F.sum("leaf").alias("n_leaves"))

    # The parent of all but the first node of what a conversation owns is the node before it.
    node = lambda a, b: F.struct(F.col(a).alias("h1"), F.col(b).alias("h2"))
    tops = placed.where("is_top and depth > 0").select(*key, node("p1", "p2").alias("node"))
    parents = spread_join(tops, merged.select(node("h1", "h2").alias("node"), F.col("conv").alias("parent")), "node", tops.groupBy("node").agg(F.count("*").alias("rows")), *key)
    digests = end_digests(local.select(*key, F.explode("ends").alias("conv")))
    done = placed.join(totals, key, "left").join(parents.select(*key, "parent"), key, "left").join(digests, key, "left")
    return done.select(
        F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") == 0, F.lit(None).cast("long")).when(F.col("is_top"), F.col("parent")).otherwise(F.col("conv")).alias("parent_conv_id"),
        "n_convs", "n_children", F.coalesce("n_leaves", F.lit(0).cast("long")).alias("n_leaves"), (F.coalesce("owned", F.lit(0)) - F.col("above")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"), *key, "p1", "p2",
    )
