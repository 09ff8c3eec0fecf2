"""Tax identifiers: shapes and check digits, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.dims import PAN_KINDS, STATE_CODES

DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
GSTIN = r"\d{2}[A-Z]{5}\d{4}[A-Z][A-Z0-9]Z[A-Z0-9]"
PAN = r"[A-Z]{5}\d{4}[A-Z]"


def gstin_check_digit(first14: Column) -> Column:
    """Base 36, weights 1 and 2 in turn, quotient and remainder of each product summed."""
    upper = F.upper(first14)

    def term(i: int) -> Column:
        # A product is 70 at most, so its quotient by 36 is 0 or 1. Written out, the text is made once, not once a digit.
        product = F.greatest(F.instr(F.lit(DIGITS), F.substring(upper, i, 1)) - 1, F.lit(0)) * F.lit(2 - i % 2)
        return product - F.when(product >= 36, 35).otherwise(0)

    total = sum((term(i) for i in range(2, 15)), term(1))
    return F.substr(F.lit(DIGITS), (F.lit(36) - total % 36) % 36 + 1, F.lit(1))


def gstin_fault(gstin: Column) -> Column:
    """'length', 'format', 'state', or null."""
    return (
        F.when(F.char_length(gstin) != 15, "length")
        .when(~gstin.rlike(f"^{GSTIN}$"), "format")
        .when(~F.substring(gstin, 1, 2).try_cast("int").isin(*STATE_CODES), "state")
    )


def pan_fault(pan: Column) -> Column:
    """'format', 'kind', or null."""
    return F.when(~pan.rlike(f"^{PAN}$"), "format").when(~F.contains(F.lit(PAN_KINDS), F.substring(pan, 4, 1)), "kind")
