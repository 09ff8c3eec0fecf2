"""A table of passages on disk: written, loaded and cleared by document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.dims import PLATFORMS

#: Passages lie in so many folders by hash of the document; a document is in one of them.
FOLDERS = 64


def _folder(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(FOLDERS)).cast("int")


def write(passages: DataFrame, path: str) -> None:
    """Append passages (doc_id, …)."""
    passages.withColumn("folder", _folder(F.col("doc_id"))).repartition("folder").write.mode("append").partitionBy("folder").parquet(path)


def load(spark: SparkSession, path: str, doc_id: int | None = None) -> DataFrame:
    """All passages, or those of one document, reading its folder alone."""
    found = spark.read.parquet(path)
    if doc_id is not None:
        folder = spark.range(1).select(_folder(F.lit(doc_id).cast("long"))).first()[0]
        found = found.where((F.col("folder") == folder) & (F.col("doc_id") == doc_id))
    return found.drop("folder")


def clear(spark: SparkSession, path: str, doc_id: int) -> None:
    """Remove one document: its folder is written anew without it, the others stay."""
    folder = spark.range(1).select(_folder(F.lit(doc_id).cast("long"))).first()[0]
    # Passages without a document stay, wherever they lie.
    rest = spark.read.parquet(path).where((F.col("folder") == folder) & ~F.col("doc_id").eqNullSafe(F.lit(doc_id)))
    # Read before the folder is replaced; a document's neighbours in one of 64 folders are re-written.
    staged = f"{path.rstrip('/')}-staged"
    rest.drop("folder").write.mode("overwrite").parquet(staged)
    spark.read.parquet(staged).write.mode("overwrite").parquet(f"{path.rstrip('/')}/folder={folder}")
    at = spark._jvm.org.apache.hadoop.fs.Path(staged)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def platforms(spark: SparkSession) -> DataFrame:
    """The shops that are told apart, in order of priority."""
    return spark.createDataFrame([(i, name) for i, name in enumerate([*PLATFORMS, "unknown"])], "priority int, platform string")
