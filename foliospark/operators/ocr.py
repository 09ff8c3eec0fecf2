"""Choices among recognition results that come in as tables: passes of a page, pages of a document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.settings import settings


def waterfall(candidates: DataFrame) -> DataFrame:
    """One row a page of candidates (doc_id, page, pass, cleaned, conf, n_regions, text).

    The first pass that is sure enough (surer on the original than on a cleaned image), else the best by
    confidence and regions, the earliest of equals. Text that is good enough is never thrown away.
    """
    limits = settings(candidates.sparkSession)
    sure = (F.col("n_regions") >= limits.ocr_regions) & (F.col("conf") >= F.when(F.col("cleaned"), limits.ocr_sure_after_cleaning).otherwise(limits.ocr_sure))
    one = F.struct("pass", "conf", "n_regions", "text")
    chosen = candidates.groupBy("doc_id", "page").agg(
        F.min_by(one, F.when(sure, F.col("pass"))).alias("_sure"), F.max_by(one, F.struct("conf", "n_regions", (-F.col("pass")).alias("early"))).alias("_best")
    )
    return chosen.select("doc_id", "page", F.col("_sure").isNotNull().alias("accepted"), F.coalesce("_sure", "_best").alias("_c")).select("doc_id", "page", "accepted", "_c.*")


def merge_pages(pages: DataFrame) -> DataFrame:
    """One row a document of pages (doc_id, page, text, conf, n_regions, engine, accepted).

    Texts that are not blank in order, mean confidence over all pages, regions summed, the engine of the
    last page that used any.
    """
    ordered = F.sort_array(F.collect_list(F.struct("page", "text")))
    text = F.array_join(F.transform(F.filter(ordered, lambda p: F.trim(F.coalesce(p["text"], F.lit(""))) != ""), lambda p: p["text"]), "\n\n")
    return pages.groupBy("doc_id").agg(
        text.alias("text"), F.avg("conf").alias("ocr_conf"), F.sum("n_regions").alias("merged_regions"), F.max_by("engine", F.when(F.col("engine") != "none", F.col("page"))).alias("engine"),
        F.bool_or("accepted").alias("any_accepted"), F.count("*").alias("n_pages"),
    )


def region_text(boxes: DataFrame) -> DataFrame:
    """(doc_id, page, text, conf, n_regions) of an engine's boxes (doc_id, page, seq, text, conf), blank ones left out."""
    seen = boxes.where(F.trim("text") != "")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda b: b["text"])
    return seen.groupBy("doc_id", "page").agg(F.array_join(ordered, "\n").alias("text"), F.round(F.avg("conf"), 3).alias("conf"), F.count("*").alias("n_regions"))


def text_layer(pages: DataFrame, least: int = 50) -> DataFrame:
    """(doc_id, text, ocr_conf, has_layer): the text layer of pages (doc_id, page, text) counts from ``least`` characters on."""
    ordered = F.sort_array(F.collect_list(F.struct("page", "text")))
    text = F.array_join(F.transform(F.filter(ordered, lambda p: F.trim(F.coalesce(p["text"], F.lit(""))) != ""), lambda p: p["text"]), "\n\n")
    joined = pages.groupBy("doc_id").agg(text.alias("text"))
    enough = F.char_length(F.trim("text")) >= least
    return joined.select("doc_id", F.when(enough, F.col("text")).alias("text"), F.when(enough, 0.98).otherwise(0.0).alias("ocr_conf"), enough.alias("has_layer"))


def deskew_angle(lines: DataFrame) -> DataFrame:
    """(doc_id, angle): the median of angles within 45 degrees of level, 0 if under 0.3."""
    near = lines.where(F.abs("angle") < 45).groupBy("doc_id").agg(F.median("angle").alias("angle"))
    return near.select("doc_id", F.when(F.abs("angle") < 0.3, 0.0).otherwise(F.col("angle")).alias("angle"))
