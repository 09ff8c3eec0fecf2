"""Scalar functions on statement and invoice texts (all Column in, Column out)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.dims import DATE_FORMATS, MISREAD, NARRATION_STEPS, OCR_STEPS, RUN_TOGETHER, STATES
from foliospark.functions.patterns import bound, changed_where, contains_any, lookup, replaced

MONTHS = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
DATE_AT_START = rf"(?i)^(\d{{1,2}}[/-]\d{{2}}[/-]\d{{2,4}}|\d{{4}}[/-]\d{{2}}[/-]\d{{2}}|\d{{1,2}}[/-]{MONTHS}[/-]\d{{2,4}})\b"
AMOUNT = r"\b([\d,]+\.\d{2})\b"


def fix_amounts(text: Column) -> Column:
    """Stops misread for thousands separators; the longest shapes first, so that 1.23.456.78 comes out whole."""
    steps = (
        (r"(\d+)\.(\d{2})\.(\d{3})\.(\d{2})\b", "$1,$2,$3.$4"),
        (r"(\d+)\.(\d{3})\.(\d{3})\.(\d{2})\b", "$1,$2,$3.$4"),
        (r"(\d+)\.(\d{3})\.(\d{2})\b", "$1,$2.$3"),
        (",,+", ","),
    )
    # One look for what all steps need.
    return changed_where(text, lambda t: t.rlike(r"\.\d{2,3}\.\d{2}|,,"), lambda t: replaced(t, *steps))


def parse_amount(text: Column) -> Column:
    """The first d.dd, else the first whole number; currency signs, blanks, separators and signs do not count."""

    def read(plain: Column) -> Column:
        exact = F.nullif(F.regexp_extract(plain, r"\d+\.\d{2}", 0), F.lit(""))
        whole = F.nullif(F.regexp_extract(plain, r"\d+", 0), F.lit(""))
        return F.coalesce(exact.try_cast("decimal(18,2)"), whole.try_cast("decimal(18,2)"))

    return bound(F.regexp_replace(fix_amounts(F.trim(text)), r"[₹$€£¥,]|(?U)\s", ""), read)


def is_date(text: Column) -> Column:
    t = F.trim(text)
    return t.rlike(r"^(\d{2}[/-]\d{2}[/-]\d{2,4}|\d{4}[/-]\d{2}[/-]\d{2})$") | t.rlike(rf"(?i)\b\d{{1,2}}[/-]{MONTHS}[/-]\d{{2,4}}\b|\b{MONTHS}\s+\d{{1,2}},?\s+\d{{4}}\b")


def is_amount(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, ",", "")).rlike(r"^\d+\.\d{2}$")


def strip_cr_dr(text: Column) -> Column:
    return changed_where(text, lambda t: contains_any(t, ("Cr", "Dr", "CR", "DR")), lambda t: F.regexp_replace(t, r"(\d)\s*\b(?:Cr|Dr|CR|DR)\b", "$1"))


def clean_narration(text: Column) -> Column:
    """Clock times closed up; helplines, page marks, addresses and a last bare four-digit number gone."""
    # All steps but the last two need one of these.
    rare = changed_where(text, lambda t: contains_any(t, (":", "1930", "1800", "|", "http")), lambda t: replaced(t, *NARRATION_STEPS[:-2]))
    return F.trim(replaced(rare, *NARRATION_STEPS[-2:]))


def clean_name(text: Column) -> Column:
    line = F.regexp_extract(text, r"^[^\r\n]*", 0)
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(line, r"(?U)\s+", " ")), r"[^A-Za-z\s.\-]+$", ""))


def clean_ocr(text: Column) -> Column:
    """Misread currency signs, numbers run together, label punctuation, known misreadings."""
    out = replaced(text, *OCR_STEPS)
    for wrong, right in (MISREAD | RUN_TOGETHER).items():
        out = F.replace(out, F.lit(wrong), F.lit(right))
    return out


def parse_date(text: Column) -> Column:
    """The first of the known formats that fits, day before month."""
    return F.coalesce(*[F.try_to_date(F.trim(text), f) for f in DATE_FORMATS])


def state_name(code: Column) -> Column:
    return lookup(F.lpad(code, 2, "0"), STATES)


def state_label(code: Column) -> Column:
    """"NN - Name", or the code alone where it has no name."""
    return bound(F.lpad(code, 2, "0"), lambda padded: F.when(padded.isNotNull(), F.concat_ws(" - ", padded, state_name(padded))))


def state_in(address: Column) -> Column:
    """The first state that the address names, else what follows its last comma."""
    named = F.array(*[F.lit(s) for s in STATES.values()])
    found = F.try_element_at(F.filter(named, lambda s: F.contains(F.lower(address), F.lower(s))), F.lit(1))
    last = F.when(F.contains(address, F.lit(",")), F.nullif(F.substring(F.trim(F.substring_index(address, ",", -1)), 1, 60), F.lit("")))
    return F.coalesce(found, last)


def shown_money(value: Column) -> Column:
    """₹1,234.50, or a dash where there is none."""
    return F.coalesce(F.concat(F.lit("₹"), F.format_number(value, 2)), F.lit("-"))


def shown_percent(share: Column) -> Column:
    """6.5%, or a dash where there is none: one place of the double nearest to the percentage, so a decimal share is exact up to there."""
    return F.coalesce(F.concat(F.format_number((share * 100).cast("double"), 1), F.lit("%")), F.lit("-"))


def csv_cell(value: Column) -> Column:
    """Quoted where it holds a comma, a quote or a line end."""
    return F.when(value.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(value, F.lit("")))
