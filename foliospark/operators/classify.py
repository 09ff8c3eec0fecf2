"""What a document is, which shop it comes from, and what becomes of it."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.dims import (
    BANK_WORDS, CONTENT_TYPES, INVOICE_TYPES, INVOICE_WORDS, PLATFORMS,
)
from foliospark.functions.patterns import bound, first_contained
from foliospark.settings import Settings


def hits(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words the text contains."""
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))


def platform(text: Column) -> Column:
    """The first platform of which the text has a word; the letters of a PAN, also within a GSTIN, are none (AAMZN4381N)."""

    def first(lower: Column, bare: Column) -> Column:
        # Only words of up to five letters can lie within a PAN.
        has = lambda w: F.contains(lower, F.lit(w)) & (F.contains(bare, F.lit(w)) if len(w) <= 5 and w.isalpha() else F.lit(True))
        any_of = lambda words: reduce(or_, map(has, words))
        return F.coalesce(*[F.when(any_of(words), F.lit(name)) for name, words in PLATFORMS.items()], F.lit("unknown"))

    return bound(F.lower(text), lambda lower: bound(F.regexp_replace(lower, "[a-z]{5}[0-9]{4}[a-z]", " "), lambda bare: first(lower, bare)))


def invoice_type(text: Column) -> Column:
    return bound(F.lower(text), lambda lower: first_contained(lower, INVOICE_TYPES))


def classify(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with document_type, platform, confidence and all_scores (empty where no word is found). Ties: invoice."""
    lower = F.lower(F.coalesce(F.col(text), F.lit("")))
    scored = docs.withColumn("_i", hits(lower, INVOICE_WORDS)).withColumn("_b", hits(lower, BANK_WORDS))
    i, b = F.col("_i"), F.col("_b")
    none, invoice = (i + b) == 0, i >= b
    share = lambda x: F.round(x / (i + b), 3)
    return scored.withColumns(
        {
            "document_type": F.when(none, "unknown").when(invoice, "invoice").otherwise("bank_statement"),
            "platform": F.when(~none & invoice, platform(F.coalesce(F.col(text), F.lit("")))).otherwise("unknown"),
            "confidence": F.when(none, 0.0).otherwise(share(F.greatest(i, b))),
            "all_scores": F.when(none, F.create_map().cast("map<string,double>")).otherwise(F.create_map(F.lit("invoice"), share(i), F.lit("bank_statement"), share(b))),
        }
    ).drop("_i", "_b")


def status(fields: Column, valid: Column, ocr_confidence: Column, limits: Settings = Settings()) -> Column:  # noqa: B008
    """What an extracted invoice counts as."""
    return (
        F.when((fields >= limits.fields_for_success) & valid, "success")
        .when(fields >= limits.fields_for_partial, "partial")
        .when(ocr_confidence < limits.low_confidence, "low_confidence")
        .otherwise("partial")
    )


def batch_status(valid: Column) -> Column:
    return F.when(valid, "success").otherwise("partial")


def bank_status(n_transactions: Column) -> Column:
    return F.when(n_transactions > 0, "success").otherwise("partial")


def needs_fallback(fields: Column, limits: Settings = Settings()) -> Column:  # noqa: B008
    """Rows so sparse that they alone go to the expensive stage."""
    return fields < limits.fields_for_no_fallback


def accepted(uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by content type."""
    known = F.coalesce(F.lower("content_type").isin(*CONTENT_TYPES), F.lit(False))
    return uploads.where(known), uploads.where(~known)
