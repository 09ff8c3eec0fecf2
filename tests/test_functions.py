"""Text and identifier functions, value by value."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from foliospark.functions import identifiers, patterns, text


def one(spark, f, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (text.fix_amounts, "1.126.06 22.792.26 1.23.456.78 5,,000.00", "1,126.06 22,792.26 1,23,456.78 5,000.00"),
        (text.parse_amount, "₹ 1,23,456.78 Cr", Decimal("123456.78")),
        (text.parse_amount, "12", Decimal("12.00")),
        (text.parse_amount, "1.23.456.78", Decimal("123456.78")),
        (text.parse_amount, "none", None),
        (text.parse_amount, None, None),
        (text.is_date, " 05-Dec-2019 ", True),
        (text.is_date, "2019-12-05", True),
        (text.is_date, "5 apples", False),
        (text.is_amount, "1,234.50", True),
        (text.is_amount, "1234.5", False),
        (text.strip_cr_dr, "200.00 Cr 70.00 Dr", "200.00 70.00"),
        (text.clean_narration, "UPI 09: 18: 50 paid  Page 2 | 9 of many", "UPI 09:18:50 paid"),
        (text.clean_narration, "rent  1800 5700", "rent"),
        (text.clean_name, " Asha  Rao 12\nnext line", "Asha Rao"),
        (text.clean_ocr, "Tota1: R 12.50, G5TIN; x GrandTotal:5", "Total: ₹12.50, GSTIN; x Grand Total: 5"),
        (text.state_label, "7", "07 - Delhi"),
        (text.state_label, "25", "25"),
        (text.state_in, "12 Road, Pune, maharashtra 411001", "Maharashtra"),
        (text.state_in, "12 Road, Somewhere", "Somewhere"),
        (text.state_in, "nowhere", None),
        (identifiers.gstin_fault, "29AABCT", "length"),
        (identifiers.gstin_fault, "99AABCT1234F1Z5", "state"),
        (identifiers.gstin_fault, "29aabct1234f1z5", "format"),
        (identifiers.gstin_fault, "29AABCT1234F1Z5", None),
        (identifiers.gstin_check_digit, "29AABCT1234F1Z", "M"),
        (identifiers.pan_fault, "AABCT1234F", None),
        (identifiers.pan_fault, "AABZT1234F", "kind"),
        (identifiers.pan_fault, "AAB", "format"),
        (lambda x: patterns.squeezed(x, 7), "  a\u00a0 b\n\tc d e f ", "a b c d"),
        (patterns.money, "1,234.5", Decimal("1234.50")),
        (patterns.money, "abc", None),
    ],
)
def test_value(spark, f, value, want):
    assert one(spark, f, value) == want


@pytest.mark.parametrize(
    ("written", "want"),
    [("15/01/2025", (2025, 1, 15)), ("2025-01-15", (2025, 1, 15)), ("01/30/2025", (2025, 1, 30)), ("5 Jan 2025", (2025, 1, 5)), ("jan 5, 2025", (2025, 1, 5)), ("January 15, 2025", (2025, 1, 15)), ("15.01.2025", (2025, 1, 15)), ("15/01/25", None), ("soon", None)],
)
def test_dates(spark, written, want):
    assert one(spark, text.parse_date, written) == (want and datetime.date(*want))


def test_cascade_takes_the_next_pattern_not_the_next_match(spark):
    f = lambda x: patterns.first_of(x, [r"no\s*(\w+)", r"id\s*(\w+)"], patterns.long_enough(5))
    assert one(spark, f, "no 12 no 1234567 id 98765") == "98765"
    assert one(spark, f, "no 12") is None


def test_lines_and_case(spark):
    assert one(spark, lambda x: patterns.every(x, r"^tot[ae]l (\d+)$"), "TOTAL 1\nTotel 2\r\ntotal 3") == ["1", "3"]


def test_display(spark):
    frame = spark.createDataFrame([(1234.5, 0.876, 'a "b", c'), (None, None, None)], "m double, p double, c string")
    got = [tuple(r) for r in frame.select(text.shown_money(F.col("m")), text.shown_percent(F.col("p")), text.csv_cell(F.col("c"))).collect()]
    assert got == [("₹1,234.50", "87.6%", '"a ""b"", c"'), ("-", "-", "")]
