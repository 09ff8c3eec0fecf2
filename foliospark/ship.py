"""Makes a session ready for Python on its executors: this package on their path, batches of bounded size."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()

#: Batches between the JVM and Python. Spark's own (10000 rows, 64 MB) cost a gigabyte an executor on long texts.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}


def ship(spark: SparkSession) -> None:
    """Once per application: Spark hands a zip of the package to every worker, wherever the driver found it.

    Batch sizes are set where the session still has Spark's own; a size that the user chose stays.
    """
    for key, (spark_own, ours) in BATCHES.items():
        if spark.conf.get(key, spark_own) == spark_own:
            spark.conf.set(key, ours)
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="foliospark-")) / "foliospark.zip"
    with zipfile.ZipFile(target, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)
