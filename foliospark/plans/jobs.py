"""Batches of files as jobs: submitted once, run as often as needed, each file processed once.

A job is a folder: ``job`` (what was submitted), ``checkpoint`` (which files were taken), ``results`` and ``counters``, each with a
folder for every micro-batch. ``run`` streams whatever files are new, FILES at a time, and stops when there are none. A
micro-batch writes its results and its counters under its number, over what a broken attempt left there, before
the checkpoint counts it as done; so a run that breaks anywhere is gone on with by the next, and no file is lost or doubled.
Counters are observed while results are written, without a second look at them.

Defined results: a file that cannot be read as text is a failed row with its error and stops no other; an empty file, which
Spark's readers pass over, is no row; a job without files has no results and counters of zero.
"""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from foliospark.plans import batch
from foliospark.sources.files import is_pdf

#: Files of one micro-batch.
FILES = 1000
COUNTERS = ("total", "processed", "failed", "success", "partial")
_RECORDS = "inv_id long, text string, error string"


def submit(spark: SparkSession, jobs: str, source: str, kind: str = "files", as_of: datetime.date | str | None = None) -> str:
    """The id of a new job over the folder ``source``: ``files`` that are one text each, or ``records``, parquet of (inv_id, text, error)."""
    if kind not in ("files", "records"):
        raise ValueError(f"a job reads files or records, not {kind}")
    job = uuid.uuid4().hex
    day = str(as_of or datetime.date.today())
    row = spark.range(1).select(F.lit(job).alias("job"), F.lit(source).alias("source"), F.lit(kind).alias("kind"), F.lit(day).alias("as_of"), F.current_timestamp().alias("submitted"))
    row.coalesce(1).write.parquet(f"{jobs}/{job}/job")
    return job


def _texts(spark: SparkSession, source: str, kind: str, files: int) -> DataFrame:
    """A stream of (inv_id, text, error): the id of a file is its path."""
    stream = spark.readStream.option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true")
    if kind == "records":
        return stream.schema(_RECORDS).parquet(source)
    found = stream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(source)
    text = F.col("content").cast("string")
    error = F.when(is_pdf(F.col("content")), "no text layer").when(~F.is_valid_utf8(text), "not a text")
    return found.select(F.col("path").alias("inv_id"), F.when(error.isNull(), text).alias("text"), error.alias("error"))


def run(spark: SparkSession, jobs: str, job: str, files: int = FILES) -> None:
    """Process the files that no run of the job has processed."""
    spec = spark.read.parquet(f"{jobs}/{job}/job").first()
    at = f"{jobs}/{job}"

    def once(texts: DataFrame, number: int) -> None:
        done = batch.process(texts, spec["as_of"])
        failed, status = F.col("error").isNotNull(), F.col("status")
        seen = Observation()
        observed = done.observe(
            seen, F.count(F.lit(1)).alias("total"), F.count(F.when(~failed, 1)).alias("processed"), F.count(F.when(failed, 1)).alias("failed"),
            F.count(F.when(~failed & (status == "success"), 1)).alias("success"), F.count(F.when(~failed & (status == "partial"), 1)).alias("partial"),
        )
        observed.write.mode("overwrite").parquet(f"{at}/results/batch={number}")
        counted = seen.get
        row = texts.sparkSession.range(1).select(*[F.lit(counted[c]).cast("long").alias(c) for c in COUNTERS], F.current_timestamp().alias("finished"))
        row.coalesce(1).write.mode("overwrite").parquet(f"{at}/counters/batch={number}")

    stream = _texts(spark, spec["source"], spec["kind"], files)
    stream.writeStream.option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(once).start().awaitTermination()


def results(spark: SparkSession, jobs: str, job: str) -> DataFrame:
    """Rows of all micro-batches, with ``batch``."""
    return spark.read.option("basePath", f"{jobs}/{job}/results").parquet(f"{jobs}/{job}/results")


def status(spark: SparkSession, jobs: str, job: str) -> DataFrame:
    """One row: job, counters of what was processed so far, micro-batches."""
    try:
        seen = spark.read.parquet(f"{jobs}/{job}/counters")
    except AnalysisException:  # nothing was processed yet
        seen = spark.createDataFrame([], ", ".join(f"{c} long" for c in COUNTERS))
    return seen.agg(F.lit(job).alias("job"), *[F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in COUNTERS], F.count("*").alias("batches"))
