"""Documents put into shards by a consistent-hash ring with virtual nodes and bounded loads.

Keys (equal texts are one key) are points on a ring of 64-bit hashes; each shard stands at VIRTUAL points of it, and a
key goes to the next such point clockwise. A shard that is full takes no more: what overflows continues clockwise to
the next shard that is not. So no shard has more than its bound, and when a shard is added only the keys that its
points take over, and what overflowed otherwise, move. Copies of a text stay together but for what overflows.

Work is spread by ranges of (point, id), so a text that a third of all rows have lies in many tasks. Each task counts
the rows of every arc between two virtual points; the counts of arcs, whose number is fixed by the number of shards, are
all that the driver sees and all that decides. It fills shards from arcs: in the first round every arc's rows try the
arc's own point, in the next one the following point, and so on; within a round arcs go in order of the ring, within an
arc rows go by point, id and what else tells rows apart. Rows then find their shard by their place in the arc.

Bounds: by rows, with no slack, counts are at most one apart; with slack s, no shard has over (1 + s) times the mean. By bytes
the same holds of sizes, but for one row that reaches over the bound.

Defined results: a null text is an empty one of size 1; null, equal or repeated ids are rows of their own; an empty table
gives an empty one; other columns are carried along.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.shared import Kept, Scratch, sealed
from foliospark.ship import ship

#: Points of each shard on the ring. Shards times this are the arcs that the driver counts.
VIRTUAL = 256


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text, plus 1."""
    return F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long")) + 1


def key_of(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def ring(spark: SparkSession, shards: int, virtual: int = VIRTUAL) -> tuple[np.ndarray, np.ndarray]:
    """(point, shard) of all virtual nodes, clockwise. A shard's points are the same whatever number of shards there is."""
    nodes = spark.range(shards * virtual).select(F.xxhash64(F.concat_ws(":", F.lit("shard"), F.expr(f"id div {virtual}"), F.expr(f"id % {virtual}"))).alias("point"), F.expr(f"id div {virtual}").alias("shard"))
    found = sorted((r["point"], r["shard"]) for r in nodes.collect())
    return np.array([p for p, _ in found], np.int64), np.array([s for _, s in found], np.int64)


def filled(arcs: np.ndarray, owners: np.ndarray, room: list[int]) -> list[tuple[int, int, int, int]]:
    """(arc, from, to, shard): where each arc's weight goes, as ranges of the arc's running weight.

    arcs has one more element than the ring has points: what lies beyond the last point belongs to the first.
    """
    room, n = list(room), len(owners)
    waiting = [(a, 0, int(w), a % n) for a, w in enumerate(arcs) if w]
    out = []
    while waiting:
        later = []
        for arc, at, to, node in waiting:
            shard = int(owners[node])
            taken = min(room[shard], to - at)
            if taken > 0:
                room[shard] -= taken
                out.append((arc, at, at + taken, shard))
            if at + taken < to:
                later.append((arc, at + taken, to, node))
        if not any(room):
            break
        waiting = [(arc, at, to, next((node + i) % n for i in range(1, n + 1) if room[owners[(node + i) % n]])) for arc, at, to, node in later]
    return sorted(out)


def bounds(total: int, shards: int, slack: float) -> list[int]:
    """What each shard may hold: all alike with slack, else the parts of the total that differ by one at most."""
    if slack > 0:
        return [-(-max(total, int(total * (1 + slack))) // shards)] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def _counted(points: np.ndarray):
    """Rows come in order of points: arc, and weight and rows of that arc in this partition before each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, weight_before, rows_before = -1, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            arc = np.searchsorted(points, batch.column("point").to_numpy(), "left")
            weight = batch.column("weight").to_numpy()
            if arc[0] != last:
                weight_before = rows_before = 0
            sums = np.concatenate(([0], np.cumsum(weight)))
            first = np.flatnonzero(np.concatenate(([True], arc[1:] != arc[:-1])))
            of = np.cumsum(np.concatenate(([0], arc[1:] != arc[:-1])))
            nth, before = np.arange(len(arc)) - first[of], sums[:-1] - sums[first][of]
            nth[of == 0] += rows_before
            before[of == 0] += weight_before
            last, rows_before, weight_before = int(arc[-1]), int(nth[-1]) + 1, int(before[-1] + weight[-1])
            carried = [batch.column(c) for c in batch.schema.names if c not in ("point", "weight")]
            names = [c for c in batch.schema.names if c not in ("point", "weight")]
            yield pa.RecordBatch.from_arrays([*carried, pa.array(arc.astype(np.int32)), pa.array(weight), pa.array(nth), pa.array(before)], names=[*names, "arc", "weight", "nth", "before"])

    return run


#: Columns that shard_rows adds; columns of rows with these names are replaced.
ADDED = ("shard", "slot")


def shard_rows(rows: DataFrame, key: Column, weight: Column, *tell: str, shards: int = 8, slack: float = 0.0, virtual: int = VIRTUAL) -> DataFrame:
    """rows with ``shard`` (0 to shards - 1) and ``slot`` (0, 1, ... within the shard).

    key: a 64-bit hash; weight: what the bound counts, at least 1 a row; tell: columns that order rows of one
    key. All columns of rows are moved, so pass narrow ones and join, or use shard_documents.
    """
    spark = rows.sparkSession
    ship(spark)
    names, scratch = rows.columns, Scratch()
    keyed = rows.select(*[F.col(f"`{c}`").alias(f"own {i}") for i, c in enumerate(names)], key.alias("point"), weight.cast("long").alias("weight"))
    order = ["point", *(f"own {names.index(c)}" for c in tell), "mixed"]
    # Rows alike in all that tells them apart lie in many ranges too.
    keyed = scratch.keep(keyed.withColumn("mixed", F.xxhash64(F.monotonically_increasing_id())), "points")
    own = [f"own {i}" for i in range(len(names))]
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select(*own, "point", "weight", F.spark_partition_id().alias("part"))
    points, owners = ring(spark, shards, virtual)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema.fields if f.name not in ("point", "weight"))
    placed = Kept(ranged.mapInArrow(_counted(points), f"{schema}, arc int, weight long, nth long, before long"), "placed").frame
    scratch.clear()

    # A range has its own arcs and shares one with the next: as many rows as there are ranges and arcs together.
    sums = sorted((r["arc"], r["part"], r["weight"], r["rows"]) for r in placed.groupBy("arc", "part").agg(F.sum("weight").alias("weight"), F.count("*").alias("rows")).collect())
    arcs, starts, rows_of = np.zeros(len(points) + 1, np.int64), [], defaultdict(int)
    for arc, part, w, n in sums:
        starts.append((arc, part, int(arcs[arc]), rows_of[arc]))
        arcs[arc] += w
        rows_of[arc] += n
    goes = filled(arcs, owners, bounds(int(arcs.sum()), shards, slack))
    starts = F.broadcast(spark.createDataFrame(starts, "arc int, part int, weight_start long, row_start long"))
    ranges = F.broadcast(spark.createDataFrame(goes, "to_arc int, low long, high long, shard int"))
    at = placed.join(starts, ["arc", "part"]).select(*own, "arc", (F.col("before") + F.col("weight_start")).alias("at"), (F.col("nth") + F.col("row_start")).alias("row"))
    dealt = at.join(ranges, (F.col("arc") == F.col("to_arc")) & (F.col("at") >= F.col("low")) & (F.col("at") < F.col("high")))
    counts = sorted((r["shard"], r["arc"], r["low"], r["row"], r["rows"]) for r in dealt.groupBy("shard", "arc", "low").agg(F.min("row").alias("row"), F.count("*").alias("rows")).collect())
    slots, held = [], defaultdict(int)
    for shard, arc, low, row, n in counts:
        slots.append((arc, low, held[shard] - row))
        held[shard] += n
    slots = F.broadcast(spark.createDataFrame(slots, "arc int, low long, shift long"))
    done = dealt.join(slots, ["arc", "low"]).select(*own, "shard", (F.col("row") + F.col("shift")).alias("slot"))
    return done.select(*[F.col(f"own {i}").alias(c) for i, c in enumerate(names) if c not in ADDED], *ADDED)


def shard_documents(docs: DataFrame, by: str = "rows", shards: int = 8, slack: float = 0.0, virtual: int = VIRTUAL) -> DataFrame:
    """docs with shard and slot, equal texts one key; by ``rows`` or ``bytes``. Texts move with their rows, once, to where they are written."""
    if by not in ("rows", "bytes"):
        raise ValueError(f"a bound counts rows or bytes, not {by}")
    names = docs.columns
    docs, back = sealed(docs, ("doc_id", "text"))
    weight = size_of(F.col("text")) if by == "bytes" else F.lit(1)
    done = shard_rows(docs, key_of(F.col("text")), weight, "doc_id", shards=shards, slack=slack, virtual=virtual)
    return done.select(*[back[i] for i, c in enumerate(names) if c not in ADDED], *ADDED)


def write_shards(sharded: DataFrame, path: str, files: int = 16) -> None:
    """One folder a shard, rows in order of slots within each file; each shard is written by ``files`` tasks by ranges of its slots."""
    tasks = F.pmod(F.xxhash64("shard", F.pmod("slot", F.lit(files))), F.lit(1 << 30))
    sharded.repartition(tasks).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
