"""Checks of invoices: each is a column that is null or a message; hard ones decide, soft ones warn.

``as_of`` is a parameter, so that a run can be repeated. Checks of totals leave out discounts and charges.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.dims import GST_RATES
from foliospark.functions.identifiers import gstin_check_digit, gstin_fault, pan_fault
from foliospark.functions.text import parse_date

AMOUNTS = ("subtotal", "discount", "total_tax", "total_amount", "cgst_amount", "sgst_amount", "igst_amount")
NOT_NEGATIVE = ("subtotal", "total_tax", "cgst_amount", "sgst_amount", "igst_amount")
RATES = ("cgst_rate", "sgst_rate", "igst_rate")
TEXTS = ("seller_gst", "seller_pan", "invoice_date", "order_date")


def checks(as_of: datetime.date | str) -> tuple[dict[str, Column], dict[str, Column]]:
    """(hard, soft) by name."""
    c, zero = F.col, lambda x: F.coalesce(F.col(x), F.lit(0))
    gst, pan = c("seller_gst"), c("seller_pan")
    parts = zero("cgst_amount") + zero("sgst_amount") + zero("igst_amount")
    some = lambda x: F.coalesce(F.col(x) != 0, F.lit(False))
    invoiced, ordered = parse_date(c("invoice_date")), parse_date(c("order_date"))
    shaped, whole = gst.isNotNull() & gstin_fault(gst).isNull(), pan.isNotNull() & pan_fault(pan).isNull()
    say = lambda when, *text: F.when(F.coalesce(when, F.lit(False)), F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in text]))
    hard = {
        "gstin": F.when(gst.isNotNull(), F.concat(F.lit("GSTIN "), gstin_fault(gst))),
        "pan": F.when(pan.isNotNull(), F.concat(F.lit("PAN "), pan_fault(pan))),
        "tax_sum": say((parts > 0) & (F.abs(parts - c("total_tax")) > 1), "taxes do not sum to the total tax"),
        "halves": say(some("cgst_amount") & some("sgst_amount") & (F.abs(c("cgst_amount") - c("sgst_amount")) > 1), "CGST and SGST differ"),
        "either": say((zero("igst_amount") > 0) & ((zero("cgst_amount") > 0) | (zero("sgst_amount") > 0)), "IGST with CGST or SGST"),
        "total": say(F.abs(c("subtotal") + zero("total_tax") - c("total_amount")) > 2, "subtotal and tax do not make the total"),
        "future": say(invoiced > F.lit(as_of).cast("date"), "invoice date in the future"),
        "total_positive": say(c("total_amount") <= 0, "total is not positive"),
        "total_sane": say(c("total_amount") > 10_000_000, "total over 10000000"),
        "tax_sane": say(c("total_tax") > c("total_amount"), "tax exceeds the total"),
    } | {f"{a}_negative": say(c(a) < 0, f"{a} is negative") for a in NOT_NEGATIVE}
    soft = {
        "check_digit": F.when(shaped, say(F.substring(gst, 15, 1) != gstin_check_digit(F.substring(gst, 1, 14)), "GSTIN check digit")),
        "pan_in_gstin": F.when(shaped & whole, say(F.substring(gst, 3, 10) != pan, "PAN is not that of the GSTIN")),
        "rates": F.nullif(F.concat_ws("; ", *[say(~c(r).isin(*GST_RATES), f"{r} is no GST rate") for r in RATES]), F.lit("")),
        "order_first": say(invoiced < ordered, "invoice before order"),
        "complete": say(F.coalesce(c("fields_extracted"), F.lit(0)) < 8, "fewer than 8 fields"),
    }
    return hard, soft


def validate(invoices: DataFrame, as_of: datetime.date | str) -> DataFrame:
    """invoices with passed, tax_validated (the same) and validation_warnings (hard, then soft, in order). Columns that are missing count as null."""
    types = dict.fromkeys(AMOUNTS, "decimal(18,2)") | dict.fromkeys(RATES, "double") | dict.fromkeys(TEXTS, "string") | {"fields_extracted": "int"}
    whole = invoices.withColumns({k: F.lit(None).cast(t) for k, t in types.items() if k not in invoices.columns})
    hard, soft = checks(as_of)
    found = whole.withColumn("_hard", F.array_compact(F.array(*hard.values()))).withColumn("_soft", F.array_compact(F.array(*soft.values())))
    passed = F.size("_hard") == 0
    return found.select(*[c for c in invoices.columns if c != "tax_validated"], passed.alias("passed"), passed.alias("tax_validated"), F.concat("_hard", "_soft").alias("validation_warnings"))
