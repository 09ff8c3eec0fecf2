"""A model's answers parsed and merged into what the patterns found; training samples for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBERS = ("total_amount", "total_tax", "subtotal", "cgst_amount", "sgst_amount", "igst_amount", "discount")
#: Other keys that models use for a field.
ALIASES = {"seller_gst": ("gstin", "seller_gstin"), "invoice_number": ("invoice_no",), "order_number": ("order_id",), "total_amount": ("total", "grand_total"), "seller_name": ("seller",)}


def parse_response(response: Column, fields: tuple[str, ...]) -> dict[str, Column]:
    """Columns of a response: fences stripped, the first braces without braces inside; numbers cast, anything else null."""
    plain = F.regexp_replace(response, r"```(?:json)?", "")
    found = F.nullif(F.regexp_extract(plain, r"(?s)\{[^{}]*\}", 0), F.lit(""))
    parsed = F.from_json(found, F.lit("map<string,string>"), {"mode": "PERMISSIVE"})
    out = {}
    for f in fields:
        value = F.coalesce(*[F.nullif(F.trim(F.try_element_at(parsed, F.lit(k))), F.lit("")) for k in (f, *ALIASES.get(f, ()))])
        out[f] = F.regexp_replace(value, "[₹,\\s]", "").try_cast("decimal(18,2)") if f in NUMBERS else value
    return out


def fill_gaps(found: DataFrame, other: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """found with each field that is null or empty taken from other; one row of other a key."""
    o = other.select(F.col(key).alias("_key"), *[F.col(f).alias(f"_{f}") for f in fields])
    joined = found.join(o, found[key] == o["_key"], "left")
    empty = lambda f: F.nullif(F.col(f), F.lit("")) if dict(found.dtypes)[f] == "string" else F.col(f)
    return joined.select(*[F.coalesce(empty(c), F.col(f"_{c}")).alias(c) if c in fields else F.col(c) for c in found.columns])


def with_fallback(found: DataFrame, sparse: Column, expensive, key: str, fields: tuple[str, ...]) -> DataFrame:
    """Only the rows where ``sparse`` holds go to ``expensive`` (DataFrame to DataFrame with key and fields)."""
    return fill_gaps(found, expensive(found.where(sparse)), key, fields)


def prompt(template: str, text: Column, shop: Column, most: int = 3000) -> Column:
    """template with two %s: the shop and the text, cut."""
    return F.format_string(template, shop, F.substring(text, 1, most))


def training_sample(instruction: str, text: Column, answer: Column, most: int = 2500) -> Column:
    """A JSON line (instruction, input, output)."""
    return F.to_json(F.struct(F.lit(instruction).alias("instruction"), F.substring(text, 1, most).alias("input"), answer.alias("output")))
