"""Sources mixed to target weights by repeating or thinning documents [DataFrame functions only].

Words are summed per source (partial sums first, so a hot source costs nothing), shares of the total
follow by filling to each source's cap, rate = target / size, and each document is emitted floor(rate)
times plus one copy with probability equal to the fraction, decided by a hash of the seed and the row.

Filling: all sources get their share by weight; those that it lifts to their cap stay there, what they
leave is shared among the others, until nothing changes. The round's two sums are all that the driver sees.

A row's hash is of its id, text and source, so reruns agree however the rows lie. Rows equal in all three
toss coins of their own: they are numbered, within each partition first, then across partitions.

Defined results: a null text has no words; a null source is a source, the last; a source without words
has target 0 and its documents are emitted no time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.shared import WORD, Kept, sealed

#: Sources up to this number are sent to every executor (about 100 bytes each); more are joined by shuffle, in SALTS parts.
BROADCAST_SOURCES, SALTS = 20_000, 32
#: Hashes of repeated rows up to this number are sent to every executor (about 60 bytes each).
BROADCAST_REPEATS = 100_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def _weighed(sizes: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """(source, source_size, weight): weights in turn over the sources in order, each range of them numbered on its own."""
    by_name = F.col("source").asc_nulls_last()
    ranged = sizes.select("source", "source_size").repartitionByRange(by_name).sortWithinPartitions(by_name)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranked = Kept(ranged.withColumn("part", F.spark_partition_id()).withColumn("place", place), "ranked").frame
    counts = {r["part"]: r["n"] for r in ranked.groupBy("part").agg(F.count("*").alias("n")).collect()}
    starts = [sum(n for q, n in counts.items() if q < p) % len(weights) for p in range(max(counts, default=0) + 1)]
    turn = (F.element_at(F.array(*map(F.lit, starts)), F.col("part") + 1) + F.col("place")) % len(weights)
    return ranked.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long").alias("weight"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target) of (source, source_size)."""
    weighed = _weighed(sizes, weights)
    exact = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("decimal(38,0)")
    whole = weighed.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    total, capped, left = whole["size"] or 0, 0, whole["weight"] or 0
    while True:
        at_cap = exact(F.lit(total - capped)) * exact(F.col("weight")) >= exact(F.col("source_size")) * exact(F.lit(most * left))
        after = weighed.agg(F.sum(F.when(at_cap, F.col("source_size") * most)).alias("capped"), F.sum(F.when(~at_cap, F.col("weight"))).alias("left")).first()
        if ((after["capped"] or 0), (after["left"] or 0)) == (capped, left):
            break
        capped, left = after["capped"] or 0, after["left"] or 0
    share = F.lit(total - capped).cast("double") * F.col("weight") / F.lit(max(left, 1))
    return weighed.select("source", "source_size", F.when(at_cap, (F.col("source_size") * most).cast("double")).otherwise(share).alias("target"))


def row_hash() -> Column:
    """32 hexadecimal digits of a row's id, text and source."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    source = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source")))
    return F.md5(F.concat_ws(":", word("doc_id"), F.md5(word("text").cast("binary")), source).cast("binary"))


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """rows with ``nth``: 1, 2, ... among rows of equal key. Only rows whose key repeats are moved."""
    repeated = Kept(rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key, F.lit(True).alias("again")), "repeated").frame
    if repeated.isEmpty():
        return rows.withColumn("nth", F.lit(1).cast("long"))
    side = F.broadcast(repeated) if repeated.limit(BROADCAST_REPEATS + 1).count() <= BROADCAST_REPEATS else repeated
    marked = rows.join(side, key, "left")
    again = Kept(marked.where("again").drop("again").withColumn("part", F.spark_partition_id()), "again").frame
    counts = again.groupBy(key, "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(key, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy(key, "part").orderBy(F.lit(1))
    placed = again.withColumn("nth", F.row_number().over(within)).join(starts, [key, "part"])
    once = marked.where(F.col("again").isNull()).drop("again").withColumn("nth", F.lit(1).cast("long"))
    return once.unionByName(placed.withColumn("nth", F.col("nth") + F.col("start")).drop("part", "start"))


def coin(seed: int) -> Column:
    """Uniform in [0, 1), the same in every run: 52 bits of md5 of the seed, the row's hash and its number among equal rows."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("row_hash"), F.col("nth").cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / float(2**52)


#: Columns that rates adds; columns of docs with these names are replaced.
ADDED = ("size", "source_size", "target", "rate", "copies")


def _rated(docs: DataFrame, weights: tuple[int, ...], most: int, seed: int) -> DataFrame:
    """docs, sealed, with ADDED."""
    sized = docs.withColumn("size", size_of(F.col("text"))).withColumn("row_hash", row_hash())
    sums = Kept(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources").frame
    goal = targets(sums, weights, most).withColumnRenamed("source", "of")
    rows, same = numbered(sized, "row_hash"), F.col("source").eqNullSafe(F.col("of"))
    if sums.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        goal = F.broadcast(goal)
    else:  # A hot source is dealt out by salt.
        goal = goal.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("its", F.pmod(F.xxhash64("row_hash", "nth"), F.lit(SALTS)).cast("int"))
        same = same & (F.col("its") == F.col("salt"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = rows.join(goal, same).withColumn("rate", rate)
    return joined.withColumn("copies", F.floor("rate") + (coin(seed) < F.col("rate") - F.floor("rate")).cast("long"))


def rates(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 17) -> DataFrame:
    """docs with size, source_size, target, rate and copies."""
    names = docs.columns
    docs, back = sealed(docs, ("doc_id", "text", "source"))
    return _rated(docs, weights, most, seed).select(*[back[i] for i, c in enumerate(names) if c not in ADDED], *ADDED)


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 17) -> DataFrame:
    """The mix itself: each document as often as it is taken, numbered by ``copy`` from 1 (which replaces a column of that name)."""
    names = docs.columns
    docs, back = sealed(docs, ("doc_id", "text", "source"))
    mixed = _rated(docs, weights, most, seed).where(F.col("copies") > 0)
    number = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")
    return mixed.select(*[back[i] for i, c in enumerate(names) if c != "copy"], number)
