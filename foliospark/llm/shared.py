"""Tables kept between jobs, and small helpers that several operators use."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, newline, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: The same six characters, for trimming.
BLANKS = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where all run in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="foliospark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def sealed(docs: DataFrame, uses: tuple[str, ...]) -> tuple[DataFrame, dict[int, Column]]:
    """docs with every column but those that an operator uses under a name that clashes with none, and the way back.

    Columns are renamed by place, so dots, names of the operator's own and names that differ by case do no
    harm. The second value has, for the place of each column, the column under its own name.
    """
    names = [c if c in uses else f"own {i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), {i: F.col(f"`{n}`").alias(c) for i, (n, c) in enumerate(zip(names, docs.columns, strict=True))}


class Kept:
    """A DataFrame written to the shared folder and read again: cuts the lineage, survives lost executors.

    The files go with drop(), at the end of the scope in which they were written, or with the application.
    """

    open: ClassVar[list[Kept]] = []
    written: ClassVar[bool] = False

    def __init__(self, frame: DataFrame, name: str):
        spark = frame.sparkSession
        self.path = f"{shared_dir(spark)}/foliospark/{name}-{uuid.uuid4().hex}"
        self._at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._files = self._at.getFileSystem(spark._jsc.hadoopConfiguration())
        if not Kept.written:
            Kept.written = True
            atexit.register(_drop_all)
        Kept.open.append(self)
        frame.write.parquet(self.path)
        self.frame = spark.read.schema(frame.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files; for tables that nothing lazy reads any more."""
        if self in Kept.open:
            Kept.open.remove(self)
        with contextlib.suppress(Exception):  # what is left goes with the folder
            self._files.delete(self._at, True)


def _drop_all() -> None:
    for table in list(Kept.open):
        table.drop()


@contextlib.contextmanager
def scope() -> Iterator[list[Kept]]:
    """Tables kept within are deleted at the end but for those in the list that it gives; what reads them has to be written by then."""
    before, spared = list(Kept.open), []
    try:
        yield spared
    finally:
        for table in list(Kept.open):
            if table not in before and table not in spared:
                table.drop()


def fold(column: str, buckets: int) -> Column:
    """crc32 of the id as text, modulo buckets; a missing id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % buckets


#: Bytes of text that a training sample may have in all; it goes to the driver.
SAMPLE_BYTES = 24 << 20


def sampled_labels(docs: DataFrame, labels: DataFrame, label: str, most: int, held_out: int = 0, folds: int = 5, most_bytes: int = SAMPLE_BYTES) -> pa.Table:
    """(doc_id, text, y, weight) of at most ``most`` labelled documents outside the held-out fold, by doc_id.

    Up to half of the sample is positive and up to half negative, each the first by hash of the id, so
    reruns agree; a text that no longer fits into ``most_bytes`` is passed over. The weights restore the
    shares among all labelled rows. Labels of one id are averaged (a half counts as 1); null ids, labels and
    texts are left out.
    """
    y = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold("doc_id", folds) != held_out))
        .groupBy("doc_id")
        .agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    )
    counts = {r["y"]: r["n"] for r in y.groupBy("y").agg(F.count("*").alias("n")).collect()}
    half = most // 2
    parts = [y.where(F.col("y") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(half) for v in (0, 1)]
    ids = parts[0].unionByName(parts[1])
    # The ids number ``most`` at most, so this side is small whatever the corpus holds.
    found = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(ids), "doc_id")
    found = Kept(found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")), "sample")
    sizes = found.frame.select("doc_id", F.octet_length("text").alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    fits, held = [], 0
    for r in sizes:
        if held + r["size"] <= most_bytes:
            held += r["size"]
            fits.append((r["doc_id"],))
    frame = found.frame
    if len(fits) < len(sizes):
        chosen = docs.sparkSession.createDataFrame(fits, frame.select("doc_id").schema)
        frame = frame.join(F.broadcast(chosen), "doc_id", "left_semi")
    sample = frame.select("doc_id", "text", "y").toArrow().sort_by("doc_id").combine_chunks()
    found.drop()
    y, weight = sample.column("y").to_numpy(), np.ones(sample.num_rows)
    for v in (0, 1):
        weight[y == v] = max(1.0, counts.get(v, 0) / max(1, (y == v).sum()))
    return sample.append_column("weight", pa.array(weight))


def id_type(docs: DataFrame, column: str = "doc_id") -> str:
    return docs.schema[column].dataType.simpleString()


class Scratch:
    """Kept tables of one job, deleted together when nothing lazy reads them any more."""

    def __init__(self) -> None:
        self.tables: list[Kept] = []

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        self.tables.append(Kept(frame, name))
        return self.tables[-1].frame

    def clear(self) -> None:
        for table in self.tables:
            table.drop()
        self.tables.clear()


#: A key of more rows than HOT is dealt out in SALTS parts. There are at most MOST_HOT of them: the bound rises with the table.
HOT, SALTS, MOST_HOT = 10_000, 64, 50_000


def spread_join(rows: DataFrame, side: DataFrame, key: str, counts: DataFrame, *by: str) -> DataFrame:
    """rows joined to side (one row a key) on key; rows of hot keys lie in many partitions, by hash of their columns ``by``.

    counts (key, rows) has the number of rows of each key, at least of those with many. The hot ones, MOST_HOT
    at most, are sent to every executor.
    """
    total = counts.agg(F.sum("rows")).first()[0] or 0
    hot = F.broadcast(counts.where(F.col("rows") > max(HOT, total // MOST_HOT)).select(key, F.lit(True).alias("is_hot")))
    salted = rows.join(hot, key, "left").withColumn("part_of_key", F.when(F.col("is_hot"), F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).otherwise(0)).drop("is_hot")
    parts = F.when(F.col("is_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copied = side.join(hot, key, "left").withColumn("part_of_key", F.explode(parts)).drop("is_hot")
    return salted.join(copied, [key, "part_of_key"]).drop("part_of_key")
