"""Files: uploads by type, archives, and training lines."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.dims import ARCHIVE_SUFFIXES
from foliospark.settings import settings
from foliospark.ship import ship


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content and content_type of the files under path; the type by signature, else by suffix."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    by_suffix = F.when(suffix == "pdf", "application/pdf").when(suffix.isin("jpg", "jpeg"), "image/jpeg").when(suffix.isin("png", "tiff"), F.concat(F.lit("image/"), suffix)).otherwise("application/octet-stream")
    return files.select("path", "length", "content", F.when(is_pdf(F.col("content")), "application/pdf").otherwise(by_suffix).alias("content_type"))


def is_pdf(content: Column, content_type: Column | None = None) -> Column:
    signed = F.substring(content, 1, 4) == F.unhex(F.lit("25504446"))
    return signed if content_type is None else signed | F.contains(F.lower(content_type), F.lit("pdf"))


def route(content_type: Column, content: Column) -> Column:
    """Which reader a file goes to first."""
    return F.when(is_pdf(content, content_type), "pdf").when(F.startswith(content_type, F.lit("image/")), "image").otherwise("pdf_then_image")


#: Bytes of a member that are unpacked; a larger one is an error of its own.
MEMBER_BYTES = 256 << 20


def archive_members(archives: DataFrame, most: int | None = None, most_bytes: int = MEMBER_BYTES) -> DataFrame:
    """(path, member, content, error) of zip files (path, content): known suffixes, no hidden files.

    Members beyond the first ``most`` of an archive, ones of more than most_bytes and ones that cannot be read
    are rows with an error. Members are read one by one, each batch of rows has one.
    """
    ship(archives.sparkSession)
    most = settings(archives.sparkSession).archive_limit if most is None else most

    def unpacked(content: bytes | None) -> Iterator[tuple[str | None, bytes | None, str | None]]:
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                known = [x for x in z.infolist() if not x.filename.startswith("__MACOSX") and not x.filename.split("/")[-1].startswith(".") and x.filename.lower().rsplit(".", 1)[-1] in ARCHIVE_SUFFIXES]
                if not known:
                    yield None, None, "no supported file"
                for i, x in enumerate(known):
                    if i >= most:
                        yield x.filename, None, f"more than {most} files"
                        continue
                    try:
                        with z.open(x) as f:
                            data = f.read(most_bytes + 1)
                    except (zipfile.BadZipFile, RuntimeError, NotImplementedError, zlib.error):
                        yield x.filename, None, "cannot be read"
                        continue
                    yield (x.filename, data, None) if len(data) <= most_bytes else (x.filename, None, f"more than {most_bytes} bytes")
        except (zipfile.BadZipFile, TypeError):
            yield None, None, "not a zip file"

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                for row in unpacked(content):
                    yield pd.DataFrame([(path, *row)], columns=["path", "member", "content", "error"])

    return archives.select("path", "content").mapInPandas(members, "path string, member string, content binary, error string")


def training_lines(spark: SparkSession, path: str) -> DataFrame:
    """(instruction, input, output) of JSON lines; blank and malformed lines are skipped."""
    return spark.read.schema("instruction string, input string, output string").json(path, mode="DROPMALFORMED").where(F.col("instruction").isNotNull())
