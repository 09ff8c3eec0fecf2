"""Nearest neighbours by cosine: multi-index hashing over one learned rotated binary code, reranked by floats.

Code: the sample's principal axes, rotated to lose least by taking signs (iterative quantisation), several
rotations side by side, CODE bits. The code is cut into substrings of about log2(rows) bits, and each is an
index of its own, a table: every row lies in one bucket of each table, under the substring's value. A search
retrieves every code within ``near`` bits of the query's: with near = tables * a + b, such a code differs in at
most a bits in one of the first b + 1 substrings, or in at most a - 1 in one of the others, so these are the
values that a query probes. What meets in a table and is within ``near`` bits in the whole code is reranked in
double precision on the original vectors.

``near`` follows from the exact neighbours of PILOT queries: REACHED of them lie within it. In data whose
neighbours are near copies it is small and tables meet few pairs; where neighbours differ in a third of the bits
no cut of the code can prune much, and the tables meet about as many pairs as a scan of all codes would.
A query for which fewer than k are found is searched exactly, against all rows in blocks.

Equal vectors are one row of the index, with the least k + 1 of their ids, as that many suffice for any query;
each task cuts its ids to k + 1 a vector before they are shuffled. Tables are joined, not searched whole: buckets
and probes meet by table and first bits of the value, and where very many meet, in parts of bounded size.

Fitted on at most SAMPLE vectors, the first by hash of the id. Defined results: vectors that are null, zero,
hold null or non-finite components, or differ in length from the most frequent length (the shorter on a tie)
take no part, nor do rows without an id; rows that repeat an id count once, by their best score. Very large
and very small components are scaled before they are squared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.shared import Kept, Scratch
from foliospark.ship import ship

#: Vectors to fit on; queries whose exact neighbours tell the radius; share of these neighbours within it.
SAMPLE, PILOT, REACHED = 4000, 200, 0.99
#: Rows of a table, and queries, that meet in one part; rows and queries of an exact search that do.
ENTRIES, ASKING, SHARD, TOGETHER = 1 << 18, 1 << 16, 4096, 2048
#: Tables parts of which are listed to every executor (about 20 bytes each).
BROADCAST_PARTS = 200_000
#: Bits of the code, in words of 64; bits of a substring at most; pairs and probes that are held at once.
CODE, MOST_BITS, HELD = 512, 24, 1 << 20
WORDS = [f"c{i}" for i in range(CODE // 64)]


@dataclass
class Coder:
    mean: np.ndarray
    axes: np.ndarray  # dimensions x CODE
    bits: int = 16
    near: int = 0

    @property
    def cuts(self) -> np.ndarray:
        """Where each substring begins, and the end."""
        tables = -(-CODE // self.bits)
        return np.arange(tables + 1) * CODE // tables

    @property
    def radii(self) -> np.ndarray:
        """Bits that a probe of each table differs in at most; -1: not probed."""
        tables = len(self.cuts) - 1
        a, b = divmod(self.near, tables)
        return np.where(np.arange(tables) <= b, a, a - 1)

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The code (words of 64 bits) and the value in each table of each (unit) vector."""
        on = (x - self.mean) @ self.axes > 0
        values = [on[:, a:b] @ (1 << np.arange(b - a)) for a, b in zip(self.cuts, self.cuts[1:], strict=False)]
        return np.packbits(on, axis=1).view(np.uint64), np.stack(values, axis=1).astype(np.int64)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def rotations(x: np.ndarray, n_bits: int = CODE, bits: int = 64, steps: int = 5) -> Coder:
    """x: unit vectors of the sample."""
    mean, rng = x.mean(axis=0), np.random.default_rng(3)
    c, d = x - mean, x.shape[1]
    if d >= bits:
        _, vectors = np.linalg.eigh(c.T @ c)
        axes = vectors[:, ::-1][:, :bits]
    else:
        axes = rng.normal(size=(d, bits)) / np.sqrt(bits)
    v = c @ axes
    rotated = []
    for _ in range(-(-n_bits // bits)):
        r = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
        for _ in range(steps):
            left, _, right = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
            r = (left @ right).T
        rotated.append(axes @ r)
    return Coder(mean, np.hstack(rotated))


def bits_for(n_rows: int) -> int:
    """So many that a bucket holds about one row."""
    return int(np.clip(round(np.log2(max(n_rows, 1))), 8, MOST_BITS))


def settle(coder: Coder, a: np.ndarray, b: np.ndarray, n_rows: int) -> Coder:
    """Bits of a substring for n_rows rows, and the radius within which REACHED of the pairs (a, b) of unit vectors lie."""
    coder.bits = bits_for(n_rows)
    apart = np.bitwise_count(coder.codes(a)[0] ^ coder.codes(b)[0]).sum(axis=1, dtype=np.int64)
    coder.near = int(np.quantile(apart, REACHED, method="higher")) if len(apart) else 0
    return coder


@cache
def within(bits: int, radius: int) -> np.ndarray:
    """All numbers of so many bits of which at most ``radius`` are set."""
    return np.flatnonzero(np.bitwise_count(np.arange(1 << bits, dtype=np.uint32)) <= radius)


# --- exact search, in blocks ----------------------------------------------------------------------------


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _cosines(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    # Summed row by row in one order, so that equal vectors get equal scores.
    return (rows * query).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum()))


def _pack(name: str):
    """Rows (vid, vector) of a partition in shards of SHARD, as bytes."""

    def shard(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        ids = table.column("vid").to_numpy().astype(np.int64).tobytes()
        data = _vectors(table.column("vector").combine_chunks()).astype(np.float64).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([ids], pa.binary()), pa.array([data], pa.binary())], names=[f"{name}_ids", name])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, SHARD - n)
                held.append(part)
                n, batch = n + part.num_rows, batch.slice(part.num_rows)
                if n == SHARD:
                    yield shard(held)
                    held, n = [], 0
        if n:
            yield shard(held)

    return run


def _search_all(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c, kind: np.frombuffer(batch.column(c)[i].as_buffer(), kind)  # noqa: B023, E731
                ids, asking = get("rows_ids", np.int64), get("queries_ids", np.int64)
                rows, queries = get("rows", np.float64).reshape(len(ids), -1), get("queries", np.float64).reshape(len(asking), -1)
                near = unit(queries) @ unit(rows).T
                for j in range(len(asking)):
                    # A little more than k, as products of matrices round differently.
                    least = np.partition(near[j], max(0, len(ids) - k))[max(0, len(ids) - k)] - 1e-9
                    at = np.flatnonzero(near[j] >= least)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), asking[j])), pa.array(ids[at])], names=["qvid", "vid"])

    return run


def exact_pairs(rows: DataFrame, n_rows: int, queries: DataFrame, n_queries: int, k: int) -> DataFrame:
    """(qvid, vid) that hold the k nearest rows (vid, vector) of each of queries (vid, vector), and few others."""
    groups, blocks = max(1, -(-n_rows // SHARD)), max(1, -(-n_queries // TOGETHER))
    packed = queries.repartition(blocks, "vid").mapInArrow(_pack("queries"), "queries_ids binary, queries binary")
    copies = packed.select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    shards = rows.mapInArrow(_pack("rows"), "rows_ids binary, rows binary").withColumn("group", F.pmod(F.xxhash64("rows_ids"), F.lit(groups)).cast("int"))
    return shards.join(copies, "group").drop("group").mapInArrow(_search_all(k), "qvid long, vid long")


# --- the index ------------------------------------------------------------------------------------------


def _coded(coder: Coder):
    """(vid, asks, WORDS, code) of (vid, asks, vector); code: the value in each table, as 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                whole, values = coder.codes(unit(_vectors(batch.column("vector"))))
                code = pa.array([row.tobytes() for row in values.astype(np.uint32)], pa.binary())
                words = [pa.array(np.ascontiguousarray(w).view(np.int64)) for w in whole.T]
                yield pa.RecordBatch.from_arrays([batch.column("vid"), batch.column("asks"), *words, code], names=["vid", "asks", *WORDS, "code"])

    return run


_WORDS = ", ".join(f"{w} long" for w in WORDS)
_ENTRY = f"key long, asks boolean, vid long, {_WORDS}, value int"


def _entries(coder: Coder, cut: int, asking: bool, keys_only: bool = False):
    """Rows in their buckets, or queries at all keys that their probes reach. key: table and the value without its last ``cut`` bits."""
    # Substrings of one radius together: (tables, masks of keys).
    radii = coder.radii
    reached = [(np.flatnonzero(radii == r), within(coder.bits - cut, r) if asking else np.zeros(1, np.int64)) for r in np.unique(radii[radii >= 0])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tables, masks in reached:
                step = max(1, HELD // 4 // (len(tables) * len(masks)))
                for part in (batch.slice(i, step) for i in range(0, batch.num_rows, step)):
                    values = np.stack([np.frombuffer(x.as_buffer(), np.uint32) for x in part.column("code")])[:, tables].astype(np.int64)
                    keys = ((values >> cut)[:, :, None] ^ masks) + (tables << 32)[:, None]
                    if keys_only:
                        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel())], names=["key"])
                        continue
                    row = pa.array(np.repeat(np.arange(len(values)), len(tables) * len(masks)))
                    value = np.repeat(values.ravel(), len(masks)).astype(np.int32)
                    columns = [pa.array(keys.ravel()), pa.array(np.full(keys.size, asking)), *[part.column(c).take(row) for c in ("vid", *WORDS)], pa.array(value)]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "asks", "vid", *WORDS, "value"])

    return run


def _probed(queries: tuple[np.ndarray, ...], rows: tuple[np.ndarray, ...], radius: int, low: int, near: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) places whose values differ in at most ``radius`` bits and whose codes do in at most ``near``.

    The values of rows agree but for their last ``low`` bits.
    """
    q_value, *q_words = queries
    value, *words = rows
    order = np.argsort(value, kind="stable")
    held, first, n = np.unique(value[order], return_index=True, return_counts=True)
    masks = within(low, radius).astype(held.dtype)
    # Where probes are more than buckets there, all buckets are looked at.
    few = 8 * len(masks) < len(held)
    step = max(1, 4 * HELD // (len(masks) if few else len(held)))
    out = []
    for i in range(0, len(q_value), step):
        asked = q_value[i : i + step]
        if few:
            wanted = (held[0] >> low << low | asked & (1 << low) - 1)[:, None] ^ masks
            at = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
            asking, which = np.nonzero((held[at] == wanted) & (np.bitwise_count(wanted ^ asked[:, None]) <= radius))
            bucket = at[asking, which]
        else:
            asking, bucket = np.nonzero(np.bitwise_count(asked[:, None] ^ held) <= radius)
        # In steps, so that about HELD pairs are held.
        ends = np.cumsum(n[bucket])
        for part in np.split(np.arange(len(bucket)), np.searchsorted(ends, np.arange(HELD, ends[-1], HELD))) if len(ends) else ():
            times = n[bucket[part]]
            q = np.repeat(asking[part], times) + i
            r = order[np.repeat(first[bucket[part]] - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(times.sum())]
            apart = np.zeros(len(q), np.int16)
            for at, (a, b) in enumerate(zip(q_words, words, strict=True)):
                apart += np.bitwise_count(a[q] ^ b[r])
                # Half of the code tells most of those that are too far off.
                if at == len(words) // 2 - 1:
                    keep = np.flatnonzero(apart <= near)
                    q, r, apart = q[keep], r[keep], apart[keep]
            keep = apart <= near
            out.append((q[keep], r[keep]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2


def _meet(coder: Coder, cut: int):
    """(qvid, vid) of rows sorted by (key, part, block), queries first."""
    radii, near = coder.radii, coder.near

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            column = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "part", "block", "asks", "vid", *WORDS, "value")}
            column |= {c: column[c].view(np.uint64) for c in WORDS}
            new = np.zeros(batch.num_rows, bool)
            for c in ("key", "part", "block", "asks"):
                new[1:] |= column[c][1:] != column[c][:-1]
            edges = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                group = tuple(column[c][a] for c in ("key", "part", "block"))
                if group != last:
                    last, held = group, []
                here = tuple(column[c][a:b] for c in ("vid", "value", *WORDS))
                if column["asks"][a]:
                    held.append(here)
                    continue
                if not held:
                    continue
                if len(held) > 1:
                    held = [tuple(np.concatenate(x) for x in zip(*held, strict=True))]
                queries = held[0]
                for i in range(0, b - a, ENTRIES):
                    rows = tuple(x[i : i + ENTRIES] for x in here)
                    q, r = _probed(queries[1:], rows[1:], int(radii[group[0] >> 32]), cut, near)
                    if len(q):
                        yield pa.RecordBatch.from_arrays([pa.array(queries[0][q]), pa.array(rows[0][r])], names=["qvid", "vid"])

    return run


def index_pairs(codes: DataFrame, n_rows: int, coder: Coder, scratch: Scratch) -> DataFrame:
    """(qvid, vid): what the queries among codes retrieve from all of them, within the radius of its code."""
    # About half of ENTRIES rows share a key if values were spread evenly.
    first = int(np.clip(np.ceil(np.log2(max(1, 2 * n_rows / ENTRIES))), 0, coder.bits))
    cut = coder.bits - first
    asked = codes.where("asks")
    count = lambda frame, asking, name: frame.mapInArrow(_entries(coder, cut, asking, True), "key long").groupBy("key").agg(F.count("*").alias(name))
    rows_of, queries_of = count(codes, False, "rows"), count(asked, True, "asking")
    parts = rows_of.join(queries_of, "key").select("key", F.ceil(F.col("rows") / ENTRIES).cast("int").alias("parts"), F.ceil(F.col("asking") / ASKING).cast("int").alias("blocks"))
    large = scratch.keep(parts.where("parts > 1 or blocks > 1"), "large")
    large = F.broadcast(large) if large.count() <= BROADCAST_PARTS else large
    dealt = lambda n, by: F.pmod(F.xxhash64("vid"), F.coalesce(n, F.lit(1))).cast("int").alias(by)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    parts, blocks = F.col("parts"), F.col("blocks")
    columns = ["key", "asks", "vid", *WORDS, "value"]
    entries = codes.mapInArrow(_entries(coder, cut, False), _ENTRY).join(large, "key", "left").select(*columns, dealt(parts, "part"), every(blocks).alias("block"))
    probes = asked.mapInArrow(_entries(coder, cut, True), _ENTRY).join(large, "key", "left").select(*columns, every(parts).alias("part"), dealt(blocks, "block"))
    group = ["key", "part", "block"]
    met = entries.unionByName(probes).repartition(*group).sortWithinPartitions(*group, F.desc("asks"))
    return met.mapInArrow(_meet(coder, cut), "qvid long, vid long").distinct()


# --- all of it ------------------------------------------------------------------------------------------


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, vector of doubles) of the rows that take part."""
    v = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    v = v.where(F.col("id").isNotNull() & F.col("vector").isNotNull()).where(finite & F.exists("vector", lambda x: x != 0))
    lengths = v.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    v = v.where(F.size("vector") == (lengths[0]["d"] if lengths else 0))
    # Squares of very large and very small components do not fit into a double; a cosine does not change by scale.
    most = F.array_max(F.transform("vector", lambda x: F.abs(x)))
    scaled = F.transform("vector", lambda x: x / F.col("most"))
    v = v.withColumn("most", most)
    return v.select("id", F.when(F.col("most").between(1e-100, 1e100), F.col("vector")).otherwise(scaled).alias("vector"))


def _scored(pairs: DataFrame, index: DataFrame) -> DataFrame:
    """(qvid, vid, score, ids) of pairs (qvid, vid); index: (vid, vector, ids)."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    normed = index.withColumn("norm", F.sqrt(dot("vector", "vector")))
    asked = normed.select(F.col("vid").alias("qvid"), F.col("vector").alias("query"), F.col("norm").alias("q_norm"))
    met = pairs.join(normed, "vid").join(asked, "qvid")
    return met.select("qvid", "vid", (dot("vector", "query") / (F.col("norm") * F.col("q_norm"))).alias("score"), "ids")


def _best(scored: DataFrame, asking: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): k rows for each query (id, qvid) of what _scored gives."""
    single = scored.select("qvid", "score", F.explode("ids").alias("vec_id"))
    # An id may come with several vectors; its best counts.
    single = single.groupBy("qvid", "vec_id").agg(F.max("score").alias("score"))
    order = [F.desc("score"), F.col("vec_id")]
    top = single.withColumn("nth", F.row_number().over(Window.partitionBy("qvid").orderBy(*order))).where(F.col("nth") <= k + 1)
    own = asking.join(top, "qvid").where(F.col("vec_id") != F.col("query_id")).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return own.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row where is_query (a condition on ``id``) holds."""
    spark, scratch = vectors.sparkSession, Scratch()
    ship(spark)
    v = scratch.keep(usable(vectors, id_column, vector_column), "usable")
    once = v.dropDuplicates(["id", "vector"])
    nth = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    grouped = once.withColumn("asks", is_query).withColumn("nth", nth)
    # Which vectors are asked for is known only from all their ids.
    asked = once.where(is_query).select(F.col("id").alias("query_id"), F.col("vector").alias("asked"))
    index = grouped.where(F.col("nth") <= k + 1).groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    index = scratch.keep(index.withColumn("vid", F.monotonically_increasing_id()), "index")
    asking = scratch.keep(asked.join(index.select("vid", "vector"), F.col("asked") == F.col("vector")).select("query_id", F.col("vid").alias("qvid")), "asking")
    asks = scratch.keep(asking.select(F.col("qvid").alias("vid")).distinct(), "asks")
    n_rows, n_queries = index.count(), asks.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n_rows or not n_queries:
        scratch.clear()
        return spark.createDataFrame([], schema)
    queries = index.join(asks, "vid", "left_semi").select("vid", "vector")

    sample = index.orderBy(F.xxhash64(F.get("ids", F.lit(0))), F.get("ids", F.lit(0))).limit(SAMPLE).select("vector").toArrow()
    coder = rotations(unit(_vectors(sample.column("vector").combine_chunks())))
    pilot = scratch.keep(queries.orderBy(F.xxhash64("vid"), "vid").limit(PILOT), "pilot")
    known = _scored(exact_pairs(index.select("vid", "vector"), n_rows, pilot, min(PILOT, n_queries), k + 1), index).where(F.col("qvid") != F.col("vid"))
    order = Window.partitionBy("qvid").orderBy(F.desc("score"), "vid")
    known = known.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).select("qvid", "vid")
    both = known.join(index.select(F.col("vid").alias("qvid"), F.col("vector").alias("query")), "qvid").join(index.select("vid", "vector"), "vid").select("query", "vector").toArrow()
    sides = [unit(_vectors(both.column(c).combine_chunks())) if both.num_rows else np.zeros((0, len(coder.mean))) for c in ("query", "vector")]
    settle(coder, *sides, n_rows)

    flagged = index.join(asks.withColumn("asks", F.lit(True)), "vid", "left").select("vid", F.coalesce("asks", F.lit(False)).alias("asks"), "vector")
    codes = scratch.keep(flagged.mapInArrow(_coded(coder), f"vid long, asks boolean, {_WORDS}, code binary"), "codes")
    pairs = scratch.keep(index_pairs(codes, n_rows, coder, scratch), "pairs")
    found = scratch.keep(_best(_scored(pairs, index), asking, k), "found")
    enough = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("query_id")
    starved = asking.join(enough, "query_id", "left_anti")
    starved = scratch.keep(starved, "starved")
    left = scratch.keep(index.select("vid", "vector").join(starved.select(F.col("qvid").alias("vid")).distinct(), "vid", "left_semi"), "left")
    n_left = left.count()
    if n_left:
        rest = _best(_scored(exact_pairs(index.select("vid", "vector"), n_rows, left, n_left, k + 1), index), starved, k)
        found = found.join(starved.select("query_id").distinct(), "query_id", "left_anti").unionByName(rest)
    done = Kept(found, "nearest").frame
    scratch.clear()
    return done
