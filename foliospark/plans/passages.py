"""Passages on disk in an inverted file: learned centroids, a folder for each, questions that read the nearest folders alone.

``build`` learns centroids from a bounded sample, puts every passage into the list of its nearest centroid, and notes for
each list how far its passages lie from the centroid. ``append`` adds passages by the same centroids. ``search``
goes to the ``probes`` nearest lists; ``exact`` goes on from there to just those lists that can hold anything nearer than
what was found, by the distances noted. ``tune`` measures how many probes reach a recall and notes that.

Layout under the path: ``centroids`` (list, centroid), ``lists`` by ``list``, ``reach`` (list, reach: largest angle, one row
for each write), ``settings`` (probes; the last written counts).

Defined results: passages without a vector, or whose vector is zero, of another length or has components that are null or not
finite, are kept out of the index; so are such questions. Rows of equal vectors are rows of their own, ties go to the smaller
id. With fewer than k passages all are returned. An index of no passages finds nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from foliospark.folders import folder, remove
from foliospark.ship import ship

#: Vectors that centroids are learned from; they go to the driver.
SAMPLE = 20_000
#: Passages of a list that one file has at most, so a list that holds a third of all passages is written by many tasks.
FILE_ROWS = 100_000
#: Passages of a list, and questions to it, that are compared at a time.
GROUP_ROWS, TOGETHER = 8192, 1024
PROBES, RECALL = 8, 0.9
#: Added to angles, so that rounding loses no list.
_SLIP = 1e-6


def _usable(vector: Column, size: int | None = None) -> Column:
    finite = F.forall(vector, lambda x: F.coalesce((F.abs(x.cast("double")) < math.inf), F.lit(False)))
    some = finite & F.exists(vector, lambda x: x != 0)
    return F.coalesce(some if size is None else some & (F.size(vector) == size), F.lit(False))


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _unit(values.reshape(len(column), -1)) if len(column) else np.zeros((0, 1))


def learn(vectors: np.ndarray, n_lists: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Unit centroids of unit vectors: means of what is nearest, again and again; a list that loses all takes the worst served vector."""
    rng = np.random.default_rng(seed)
    centroids = vectors[rng.choice(len(vectors), min(n_lists, len(vectors)), replace=False)].copy()
    for _ in range(rounds):
        score = vectors @ centroids.T
        nearest = score.argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, vectors)
        empty = np.flatnonzero(np.linalg.norm(sums, axis=1) < 1e-12)
        sums[empty] = vectors[np.argsort(score.max(axis=1))[: len(empty)]]
        centroids = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return centroids


def _assigned(centroids: np.ndarray):
    """Each row with its nearest list and the angle to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = _matrix(batch.column("embedding")) @ centroids.T if batch.num_rows else np.zeros((0, len(centroids)))
            nearest = score.argmax(axis=1) if batch.num_rows else np.zeros(0, np.int64)
            angle = np.arccos(np.clip(score[np.arange(len(score)), nearest], -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest.astype(np.int32)), pa.array(angle)], names=[*batch.schema.names, "list", "angle"])

    return run


def _angles(centroids: np.ndarray):
    """Each question with its lists, nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            angle = np.arccos(np.clip(_matrix(batch.column("query")) @ centroids.T, -1, 1))
            order = np.argsort(angle, axis=1, kind="stable")
            n, m = order.shape
            row = pa.array(np.repeat(np.arange(n), m))
            columns = [batch.column("query_id").take(row), pa.array(order.ravel().astype(np.int32)), pa.array(np.tile(np.arange(m, dtype=np.int32), n)), pa.array(np.take_along_axis(angle, order, 1).ravel())]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "list", "nth", "angle"])

    return run


def _centroids(spark: SparkSession, path: str) -> np.ndarray:
    """Ordered by list; their number was set when the index was built."""
    rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()
    return np.array([r["centroid"] for r in rows], np.float64)


def _write(passages: DataFrame, path: str, centroids: np.ndarray) -> None:
    spark = passages.sparkSession
    ship(spark)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in passages.schema.fields)
    placed = passages.where(_usable(F.col("embedding"), centroids.shape[1])).mapInArrow(_assigned(centroids), f"{schema}, list int, angle double")
    placed.write.parquet(staged := folder(spark, "assigned"))
    placed = spark.read.parquet(staged)
    counts = placed.groupBy("list").agg(F.count("*").alias("rows"), F.max("angle").alias("reach"))
    parts = counts.select("list", F.ceil(F.col("rows") / FILE_ROWS).cast("int").alias("parts"))
    dealt = placed.join(F.broadcast(parts), "list").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts"))).drop("parts", "angle")
    # What a search may leave out must be known before there is anything to find.
    counts.select("list", "reach", "rows").coalesce(1).write.mode("append").parquet(f"{path}/reach")
    dealt.repartition("list", "part").drop("part").write.mode("append").partitionBy("list").parquet(f"{path}/lists")
    remove(spark, staged)


def build(passages: DataFrame, path: str, n_lists: int | None = None, sample: int = SAMPLE) -> int:
    """Index passages (vec_id, embedding, …) under a new path; gives the number of lists, about the root of the number of passages."""
    spark = passages.sparkSession
    usable = passages.where(_usable(F.col("embedding")))
    n = usable.count()
    drawn = usable.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    size = max((len(r["embedding"]) for r in drawn), key=[len(r["embedding"]) for r in drawn].count, default=1)
    vectors = [r["embedding"] for r in drawn if len(r["embedding"]) == size]
    centroids = learn(_unit(np.array(vectors, np.float64)), n_lists or max(1, round(math.sqrt(n)))) if vectors else np.ones((1, 1))
    rows = [(i, c.tolist()) for i, c in enumerate(centroids)]
    spark.createDataFrame(rows, "list int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    _write(passages, path, centroids)
    return len(centroids)


def append(passages: DataFrame, path: str) -> None:
    """More passages of the same columns, by the centroids that were learned."""
    _write(passages, path, _centroids(passages.sparkSession, path))


def load(spark: SparkSession, path: str, lists: list[int] | None = None) -> DataFrame:
    """Passages of the index, or of some lists, whose folders alone are read."""
    found = spark.read.parquet(f"{path}/lists")
    return found if lists is None else found.where(F.col("list").isin([int(x) for x in lists]))


def _nearest(k: int):
    """The k passages of one group of a list nearest to each of the questions to it. Cosines are taken to 12 places, so that equal vectors are equally near."""

    def run(passages: pa.Table, questions: pa.Table) -> pa.Table:
        ids, asked = passages["vec_id"].to_numpy(zero_copy_only=False), questions["query_id"]
        if not passages.num_rows or not questions.num_rows:
            return pa.Table.from_arrays([asked.slice(0, 0), passages["vec_id"].slice(0, 0), pa.array([], pa.float64())], names=["query_id", "vec_id", "score"])
        score = np.round(_matrix(questions["query"].combine_chunks()) @ _matrix(passages["embedding"].combine_chunks()).T, 12)
        least = np.partition(score, max(0, len(ids) - k), axis=1)[:, max(0, len(ids) - k)]
        q, v = np.nonzero(score >= least[:, None])
        order = np.lexsort((ids[v], -score[q, v], q))
        q, v = q[order], v[order]
        first = np.searchsorted(q, np.arange(len(score)))
        keep = np.arange(len(q)) - first[q] < k
        q, v = q[keep], v[keep]
        return pa.Table.from_arrays([asked.take(pa.array(q)), passages["vec_id"].take(pa.array(v)), pa.array(score[q, v])], names=["query_id", "vec_id", "score"])

    return run


def _scored(asked: DataFrame, probes: DataFrame, path: str, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank) of the k nearest in the lists of probes (query_id, list).

    A list meets the questions to it in groups of GROUP_ROWS passages and TOGETHER questions, about, each of which gives k for a question.
    """
    spark = asked.sparkSession
    # No more than there are lists.
    wanted = [r["list"] for r in probes.select("list").distinct().collect()]
    parts = spark.read.parquet(f"{path}/reach").groupBy("list").agg(F.ceil(F.sum("rows") / GROUP_ROWS).cast("int").alias("parts"))
    blocks = max(1, -(-asked.count() // TOGETHER))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    rows = load(spark, path, wanted).select("vec_id", "embedding", "list").join(F.broadcast(parts), "list")
    rows = rows.withColumn("part", dealt("vec_id", F.col("parts"))).drop("parts").withColumn("block", every(F.lit(blocks)))
    pairs = probes.join(asked, "query_id").select("query_id", "query", "list").withColumn("block", dealt("query_id", F.lit(blocks)))
    pairs = pairs.join(F.broadcast(parts), "list").withColumn("part", every(F.col("parts"))).drop("parts")
    kind = lambda frame, c: frame.schema[c].dataType.simpleString()
    by = ["list", "part", "block"]
    met = rows.groupBy(*by).cogroup(pairs.groupBy(*by)).applyInArrow(_nearest(k), f"query_id {kind(asked, 'query_id')}, vec_id {kind(rows, 'vec_id')}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(questions: DataFrame, path: str, k: int = 3, probes: int | None = None, exact: bool = False) -> DataFrame:
    """(query_id, vec_id, score, rank): the k passages of largest cosine found for questions (query_id, query).

    probes: lists that each question goes to; what ``tune`` noted, or PROBES.
    """
    spark = questions.sparkSession
    ship(spark)
    try:
        held = load(spark, path)
        reach = spark.read.parquet(f"{path}/reach").groupBy("list").agg(F.max("reach").alias("reach"))
    except AnalysisException:  # nothing was ever put into it
        return spark.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    centroids = _centroids(spark, path)
    asked = questions.select("query_id", "query").where(_usable(F.col("query"), centroids.shape[1]))
    kind = questions.schema["query_id"].dataType.simpleString()
    lists = asked.mapInArrow(_angles(centroids), f"query_id {kind}, list int, nth int, angle double").join(F.broadcast(reach), "list")
    lists.write.parquet(at := folder(spark, "angles"))
    lists = spark.read.parquet(at)
    first = _scored(asked, lists.where(F.col("nth") < (probes or noted(spark, path))).select("query_id", "list"), path, k)
    if not exact or held.isEmpty():
        return first
    first.write.parquet(at := folder(spark, "first"))
    first = spark.read.parquet(at)
    # The k-th best so far; a list whose nearest possible passage is further holds none of the k nearest.
    worst = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.acos(F.greatest(F.least(F.min("score"), F.lit(1.0)), F.lit(-1.0)))).alias("worst"))
    near = F.coalesce(F.col("angle") - F.col("reach") <= F.col("worst") + _SLIP, F.lit(True))
    rest = lists.where(F.col("nth") >= (probes or noted(spark, path))).join(worst, "query_id", "left").where(near).select("query_id", "list")
    found = first.drop("rank").unionByName(_scored(asked, rest, path, k).drop("rank"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def noted(spark: SparkSession, path: str) -> int:
    try:
        return spark.read.parquet(f"{path}/settings").orderBy(F.desc("at")).first()["probes"]
    except AnalysisException:
        return PROBES


def recall(questions: DataFrame, path: str, k: int = 3, probes: int | None = None) -> float:
    """Share of the k nearest passages that a search with so many probes finds."""
    near, all_of_them = search(questions, path, k, probes), search(questions, path, k, exact=True)
    hit = all_of_them.select("query_id", "vec_id").join(near.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left").agg(F.count("*").alias("n"), F.sum("hit").alias("hits")).first()
    return (hit["hits"] or 0) / hit["n"] if hit["n"] else 1.0


def tune(questions: DataFrame, path: str, k: int = 3, least: float = RECALL, most: int = 200) -> int:
    """Note and give the fewest probes that reach the recall on at most ``most`` questions: one exact search tells in which list each answer lies."""
    spark = questions.sparkSession
    some = questions.orderBy(F.xxhash64("query_id"), "query_id").limit(most)
    answers = search(some, path, k, exact=True).select("query_id", "vec_id").join(load(spark, path).select("vec_id", "list"), "vec_id")
    centroids = _centroids(spark, path)
    kind = questions.schema["query_id"].dataType.simpleString()
    asked = some.select("query_id", "query").where(_usable(F.col("query"), centroids.shape[1]))
    lists = asked.mapInArrow(_angles(centroids), f"query_id {kind}, list int, nth int, angle double")
    # k places for each of the questions.
    places = np.sort([r["nth"] for r in answers.join(lists, ["query_id", "list"]).select("nth").collect()])
    probes = int(places[max(0, math.ceil(least * len(places)) - 1)]) + 1 if len(places) else PROBES
    spark.range(1).select(F.current_timestamp().alias("at"), F.lit(probes).alias("probes")).coalesce(1).write.mode("append").parquet(f"{path}/settings")
    return probes
