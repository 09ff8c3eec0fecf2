"""Invoice fields read row by row are those of the columns, by the same patterns."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from foliospark import queries
from foliospark.operators import invoice, invoice_rows
from foliospark.operators import invoice_shapes as shapes
from foliospark.operators.classify import platform
from foliospark.sources import render
from foliospark.sources import shapes as layouts
from tests.test_documents import SHOP

DATA = "/root/testdata/sf0.001"
ODD = [
    "", " ", "myntra\nInvoice Number: I2926SH123\nTOTAL Rs 10 Rs 20 Rs 30 Rs 5.40 Rs 35.40", "ıNVOıCE NUMBER: AB-12345\nGſTIN: 27AABCT1234F1Z5", "KWICKBOX Seller Name: Kwickbox\nSubtotal: 5",
    "swiggy\rTaxes Rate\r\nSold By: X Y PRIVATE LIMITED, \r", "CGST: 99999999999999999.00\nCGST: 1.005", "Total Tax: 0.00\nGrand Total ₹,5", "12.5\n \nAmount in words\nTen only", "3\n\nx\n7,00\nAmount (in words", "Phone: ٩876543210 Tel 9876543210",
    "Studocu is not sponsored by\nlOMoARcPSD|12 Grand Total: 7", "bigbasket\nGST Information\nCGST%\nRs. 1.2.3 Rs. 9.00 Rs. 0.2.5", "Bill To\nA\n\n\nShip To:\nthe house, of, ",
]


def odd_texts(spark) -> list[str]:
    facts = render.invoice_facts(*[queries.read(spark, DATA, t) for t in ("orders", "lineitem", "customer")]).limit(40)
    laid = layouts.layouts(queries.read(spark, DATA, "orders"), queries.read(spark, DATA, "customer")).limit(150)
    texts = [r["text"] for f in (render.invoices(facts), render.long_invoices(facts), render.shop_invoices(facts), laid) for r in f.select("text").collect()]
    some, out = random.Random(4), [*ODD, SHOP, *texts]
    for text in texts * 2:
        lines = text.split("\n") + some.choice(texts).split("\n")[:4]
        some.shuffle(lines)
        letters = list("\n".join(lines[: some.randint(1, 30)]))
        for _ in range(some.randint(0, 8)):
            letters[some.randrange(len(letters))] = some.choice("\n \t\r:₹%.,09aZ ſıİK\u0085é")
        out.append("".join(letters))
    return out


def test_rows_give_what_columns_give(spark):
    texts = odd_texts(spark)
    t, shop = F.col("text"), F.col("shop")
    columns = {
        "billing_address": invoice.billing_address(t, shop), "order_number": invoice.order_number(t), "order_date": invoice.date_of(t, True), "invoice_date": invoice.date_of(t, False), "invoice_number": invoice.invoice_number(t, shop),
        "seller_info": invoice.seller_info(t), "seller_name": invoice.seller_name(t), "seller_address": invoice.seller_address(t), "seller_gst": invoice.seller_gst(t, shop), "reverse_charge": invoice.reverse_charge(t),
        "total_amount": invoice.total_amount(t), "subtotal": invoice.subtotal(t, shop), "buyer_name": invoice.buyer_name(t), "payment_method": invoice.payment(t), "items": invoice.items(t),
        **{f"{n.lower()}_amount": F.coalesce(invoice.tax_of_shop(t, n, shop), invoice.tax(t, n)) for n in ("CGST", "SGST", "IGST")},
    }
    # Cover pages and second invoices are cut off before, in both.
    docs = spark.createDataFrame(list(enumerate(texts)), "inv_id long, text string").withColumn("text", invoice.without_cover(F.col("text")))
    docs = docs.withColumn("shop", platform(F.col("text"))).withColumn("text", invoice.sellers_part(F.col("text"), F.col("shop"))).repartition(4).cache()
    want = {r["inv_id"]: r for r in docs.select("inv_id", "shop", *[c.alias(name) for name, c in columns.items()]).collect()}
    got = {r["inv_id"]: r for r in invoice.extract(docs).collect()}
    assert len(got) == len(want) == len(texts)
    for i, r in want.items():
        if got[i]["platform"] == r["shop"]:  # a text that was cut may be another shop's
            assert {c: got[i][c] for c in columns} == {c: r[c] for c in columns}, texts[i]


def test_patterns_are_tried_only_beside_their_words():
    assert invoice_rows.leads(r"Bill(?:ed)?\s+to") == ("bill",) and invoice_rows.leads(r"Shipp?(?:ed)?\s+To") == ("ship",)
    assert invoice_rows.leads(r"(?:Mobile|Phone|Tel)\s*(\d+)") == ("mobile", "phone", "tel") and invoice_rows.leads(r"(?<!Fees\s)Handling\s+Charge") == ("handling",)
    assert invoice_rows.leads(r"\b(\d{18,})\b") == invoice_rows.leads(r"(?:Sub)?total") == invoice_rows.leads(r"^\d+x") == ()
    tried = []

    class Counted(invoice_rows.Text):
        def at(self, words):
            tried.append(words)
            return super().at(words)

    text = Counted("nothing here but a long line of other words " * 1000)
    for pattern in (*shapes.SELLER_NAME, *shapes.SUBTOTAL[2:], *shapes.TOTAL_TAX):
        shape = invoice_rows.Shape(pattern)
        assert shape.words and shape.find(text) is None and not text.at(shape.words)
    assert len(tried) > 10


@pytest.mark.parametrize(("number", "want"), [("1,234.5", 123450), ("0.005", 1), ("0.0049", 0), (",", None), ("1.2.3", None), ("9" * 17, None), ("0" * 30 + "7", 700), ("5.", 500), (".5", 50), (".", None)])
def test_cents(spark, number, want):
    assert invoice_rows.cents(number) == want
    column = spark.createDataFrame([(number,)], "n string").select(F.replace("n", F.lit(","), F.lit("")).try_cast("decimal(18,2)")).first()[0]
    assert column == (None if want is None else Decimal(want) / 100)


def test_extraction_is_one_pass_over_rows(spark):
    """No pattern is a column of the plan, whose projection grew with fields times patterns; columns of any name are carried."""
    docs = spark.createDataFrame([(1, SHOP, None, 2.5), (2, None, "x", None)], "`a key` long, text string, `an error` string, n double").withColumn("more", F.array(F.struct(F.col("n").alias("a `n`"))))
    found = invoice.extract(docs, "a key", carried=("an error", "more"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "regexp_extract" not in plan
    rows = {r["a key"]: r for r in found.collect()}
    assert rows[1]["total_amount"] == Decimal("1294.46") and rows[2]["an error"] == "x" and rows[1]["more"][0][0] == 2.5 and rows[2]["fields_extracted"] == 1
