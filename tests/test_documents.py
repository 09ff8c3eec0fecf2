"""Invoices, statements and checks on texts written by hand."""

import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from foliospark import queries
from foliospark.operators import bank, classify, invoice, validate

SHOP = """Tax Invoice/Bill of Supply/Cash Memo
Sold By:
ACME RETAIL PRIVATE LIMITED
5 Mill Road, Bengaluru, Karnataka
GST Registration No: 29AABCT1234F1Z5
PAN No: AABCT1234F
Billing Address:
Ravi Kumar
9 Lake View, Chennai, Tamil Nadu
Shipping Address:
Ravi Kumar
9 Lake View, Chennai, Tamil Nadu
Place of supply: TAMIL NADU
Order Number: 408-1234567-8901234
Order Date: 10.01.2025
Invoice Number: BLR-12345
Invoice Date: 12.01.2025
HSN:85183000 headphones ₹999.00
HSN: 8518 cable ₹98.00
Subtotal: ₹1,097.00
CGST @9%: ₹98.73
SGST @9%: ₹98.73
Total Tax: ₹197.46
Discount: ₹50.00
Delivery Charges: ₹40.00
Grand Total: ₹1,294.46
Amount in Words: One Thousand Two Hundred Ninety Four only
Whether tax is payable under reverse charge: No
Phone: 9876543210
Paid by amazon pay on amazon.in"""

STATEMENT = """HDFC BANK
Account Holder: RAVI KUMAR
Account Number: 5010 0123 4567
Account Type: Savings
IFSC Code: HDFC0001234
MICR: 560240002
Statement Period: 01/01/2025 to 31/01/2025
Opening Balance: 45,230.50
Date Narration Withdrawal Deposit Balance
02/01/2025 UPI/SWIGGY ORDER 500.00 44,730.50
at 09: 18: 50
05/01/2025 ATM WITHDRAWAL 123456 1,000.00 43,730.50
10/01/2025 SALARY CREDIT 50,000.00 93,730.50 Cr
31/01/2025 Closing Balance 93,730.50
15/01/2025 RENT 15,000.00 78,730.50
Page No 1
Closing Balance: 78,730.50"""


def row(spark, frame):
    return frame.first().asDict(recursive=True)


def test_invoice(spark):
    docs = spark.createDataFrame([(1, SHOP), (2, None), (3, "")], "inv_id long, text string")
    got = {r["inv_id"]: r.asDict(recursive=True) for r in invoice.extract(docs).collect()}
    r = got[1]
    want = {
        "platform": "amazon", "seller_gst": "29AABCT1234F1Z5", "seller_pan": "AABCT1234F", "order_number": "408-1234567-8901234", "invoice_number": "BLR-12345", "order_date": "10.01.2025", "invoice_date": "12.01.2025",
        "invoice_type": "Tax Invoice/Bill of Supply/Cash Memo", "seller_name": "ACME RETAIL PRIVATE LIMITED", "billing_address": "Ravi Kumar 9 Lake View, Chennai, Tamil Nadu", "place_of_supply": "TAMIL NADU",
        "place_of_delivery": "Tamil Nadu", "billing_state_code": "29 - Karnataka", "reverse_charge": "No", "subtotal": Decimal("1097.00"), "cgst_amount": Decimal("98.73"), "sgst_amount": Decimal("98.73"), "igst_amount": None,
        "total_tax": Decimal("197.46"), "total_amount": Decimal("1294.46"), "discount": Decimal("50.00"), "delivery_charge": Decimal("40.00"), "cgst_rate": 9.0, "buyer_phone": "9876543210", "payment_method": "Amazon Pay",
        "buyer_name": "Ravi Kumar", "amount_in_words": "One Thousand Two Hundred Ninety Four only", "seller_address": "5 Mill Road, Bengaluru, Karnataka",
    }
    assert {k: r[k] for k in want} == want
    assert [(i["hsn_code"], i["total_price"]) for i in r["items"]] == [("85183000", Decimal("999.00")), ("8518", Decimal("98.00"))]
    assert got[2]["fields_extracted"] == got[3]["fields_extracted"] == 1 and got[2]["reverse_charge"] == "No"


@pytest.mark.parametrize(
    ("shop", "text", "name", "want"),
    [
        ("bigbasket", "CGST% Sale Taxable Value Tax Value\n2.5% Rs. 100.00 Rs. 90.00 Rs. 2.25\n6% Rs. 50.00 Rs. 40.00 Rs. 2.40\nSGST% Sale", "CGST", "4.65"),
        ("zomato", "Total Value 390 9.75 9.80 409.5", "CGST", "9.75"),
        ("zomato", "Total Value 390 9.75 9.80 409.5", "SGST", "9.80"),
        ("swiggy", "1 Milk 100 2.50 2.60 105.1\n2 Bread 40 1.00 1.10 42.1", "SGST", "3.70"),
        ("jiomart", "Total 100.00 90.00 16.20 106.20", "IGST", "16.20"),
        ("flipkart", "Total 1 2000.00 -500.00 1271.19 228.81 1500.00", "IGST", "228.81"),
        ("myntra", "TOTAL Rs 10 Rs 20 Rs 30 Rs 5.40 Rs 35.40", "IGST", "5.40"),
        ("myntra", "1 Rs 10 Rs 20 Rs 90\n1 Rs 576.19 Rs 28.81 Rs 605.00", "IGST", "28.81"),
        ("myntra", "CGST Rs 4.50", "CGST", "4.50"),
        ("flipkart", "IGST ₹ 365.90", "IGST", "365.90"),
        ("flipkart", "Phone IGST: 12.0 %\n3049.11 x\n", "IGST", "3049.11"),
        ("bigbasket", "CGST% Sale Taxable Value Tax Value\n2.5% 100.00 90.00 2.25\nSGST% Sale", "CGST", "2.25"),
        ("bigbasket", "GST Information\nCGST%\nRs. 10.00 Rs. 9.00 Rs. 0.25\nRs. 20.00 Rs. 19.00 Rs. 0.50\nFinal Total", "CGST", "0.75"),
    ],
)
def test_taxes_in_tables(spark, shop, text, name, want):
    got = spark.createDataFrame([(shop, text)], "shop string, text string").select(invoice.tax_of_shop(F.col("text"), name, F.col("shop"))).first()[0]
    assert got == Decimal(want)


def test_other_shapes(spark):
    text = {
        1: "Order on blinkit\nName\n:\nAsha Rao\nAddress\n:\n4 Hill Road\nState\n:\nKerala\n",
        2: "Invoice To\nName: Vishnu\nAddress: 4-34-96 Lake Road\nPin code 1\nAmount in Words:\nTen Rupees Only\nTOTAL: ₹197.46 ₹1,294.46",
        3: "Tax Invoice on behalf of -\nLegal Entity Name: Foods Ltd\nRestaurant Name: Grill House\nInvoice No: A-12345\nRestaurant Packaging Charge 20 0 20\nBill to / Ship to:\nRavi Kumar, 9 Lake View",
    }
    got = {r["inv_id"]: r for r in invoice.extract(spark.createDataFrame(list(text.items()), "inv_id long, text string")).collect()}
    assert got[1]["billing_address"] == "Asha Rao, 4 Hill Road, Kerala" == got[1]["shipping_address"]
    assert got[2]["shipping_address"] == "4-34-96 Lake Road" and got[2]["amount_in_words"] == "Ten Rupees Only" and got[2]["total_amount"] == Decimal("1294.46")
    assert "Grill House" in got[3]["seller_info"] and got[3]["packaging_charge"] == Decimal("20") and got[3]["buyer_name"] == "Ravi Kumar"
    periods = {"for the period05/12/2019to30/12/2019": ("05/12/2019", "30/12/2019"), "period April 29, 2025 - July02, 2025": ("April 29, 2025", "July02, 2025"), "From 01/01/24 To 31/01/24": ("01/01/24", "31/01/24"), "no dates": (None, None)}
    for r in spark.createDataFrame([(t,) for t in periods], "t string").select("t", bank.period(F.col("t")).alias("p")).collect():
        assert tuple(r["p"] or (None, None)) == periods[r["t"]]


def test_tax_set_rule(spark):
    f = lambda t: spark.createDataFrame([(t,)], "t string").select(invoice.tax(F.col("t"), "CGST")).first()[0]
    assert f("CGST: 10.00\nCGST: 20.00\nCGST: 30.00") == Decimal("30.00")
    assert f("CGST: 10.00\nCGST: 20.00") == Decimal("30.00")
    assert f("SGST: 10.00") is None


def test_second_invoices_are_cut_off(spark):
    rows = [("blinkit", "first part\nBlink Commerce Private Limited (formerly known"), ("swiggy", "first part\nTaxes Rate\nrest"), ("zomato", "first part"), ("amazon", "first part")]
    got = spark.createDataFrame(rows, "shop string, text string").select(F.trim(F.regexp_replace(invoice.sellers_part(F.col("text"), F.col("shop")), "\n", " "))).collect()
    assert [r[0] for r in got] == ["first part"] * 4


def test_statement(spark):
    frame = spark.createDataFrame([(1, STATEMENT), (2, ""), (3, "no statement")], "stmt_id long, text string")
    head = row(spark, bank.header(frame).where("stmt_id = 1"))
    want = {
        "bank_name": "HDFC Bank", "account_holder": "RAVI KUMAR", "account_number": "501001234567", "account_type": "Savings", "ifsc_code": "HDFC0001234", "micr_code": "560240002", "period_from": "01/01/2025",
        "period_to": "31/01/2025", "opening_balance": Decimal("45230.50"), "closing_balance": Decimal("78730.50"),
    }
    assert {k: head[k] for k in want} == want
    found = bank.settled(frame).orderBy("seq").collect()
    d = Decimal
    assert [(r["txn_date"], r["debit"], r["credit"], r["balance"]) for r in found] == [
        ("02/01/2025", d("500.00"), None, d("44730.50")), ("05/01/2025", d("1000.00"), None, d("43730.50")), ("10/01/2025", None, d("50000.00"), d("93730.50")), ("15/01/2025", d("15000.00"), None, d("78730.50")),
    ]
    assert [r["description"] for r in found] == ["UPI/SWIGGY ORDER at 09:18:50", "ATM WITHDRAWAL", "SALARY CREDIT", "RENT"]
    assert [r["reference_no"] for r in found] == [None, "123456", None, None]
    total = row(spark, bank.analytics(bank.settled(frame)))
    assert (total["total_transactions"], total["total_debits"], total["largest_credit"]) == (4, d("16500.00"), d("50000.00"))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("pay x@HDFC0001234 now\nSBIN0000001", "State Bank of India"), ("see www.kotakbank.com", "Kotak Mahindra Bank"), ("UPI/icici bank/1\nAxis Bank Ltd", "Axis Bank"), ("code ZZZZ0123456", "Bank (ZZZZ)"),
        ("the Village Cooperative Bank", "Village Cooperative Bank"), ("nothing", None),
    ],
)
def test_bank_names(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(bank.bank_name(F.col("t"))).first()[0] == want


def test_ifsc_from_branch(spark):
    t = "Canara Bank\nBranch Code: 1234"
    assert spark.createDataFrame([(t,)], "t string").select(bank.ifsc(F.col("t"), F.lit("Canara Bank"))).first()[0] == "CNRB0001234"


def test_balances_within_a_row(spark):
    """Labels first, by what they say; then transactions; texts are read once, without windows or exchanges."""
    texts = ["Opening Balance: 5.00\n01/01/2025 A 1.00 6.00", "01/01/2025 A 1.00 6.00\n02/01/2025 B 1.00 7.00\nClosing Balance 9.00", "01/01/2025 A\nB/F 3.00", "no balance", None, "BALANCE  AS ON 1st 4.00 balance b/f 8.00", "Carried Forward 1,2.345.67"]
    found = bank.balances(spark.createDataFrame(list(enumerate(texts)), "stmt_id long, text string"))
    d = lambda x: x and Decimal(x)
    want = [("5.00", "6.00"), ("6.00", "9.00"), ("3.00", "3.00"), (None, None), (None, None), ("8.00", None), (None, "12345.67")]
    assert [(r["opening_balance"], r["closing_balance"]) for r in found.orderBy("stmt_id").collect()] == [(d(a), d(b)) for a, b in want]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Window", "Exchange", "Union"))


def test_continuity_sides(spark):
    rows = [(1, 1, None, 10.0, 90.0), (1, 2, 20.0, None, 110.0), (1, 3, 5.0, 5.0, 105.0), (1, 4, None, 7.0, None), (1, 5, None, 50.0, 155.0)]
    frame = spark.createDataFrame(rows, "stmt_id long, seq int, debit double, credit double, balance double").withColumn("opening", F.lit(100.0))
    got = [(r["debit"], r["credit"]) for r in bank.continuity(frame).orderBy("seq").collect()]
    assert got == [(10.0, None), (None, 20.0), (5.0, None), (None, 7.0), (None, 50.0)]


@pytest.mark.parametrize(
    ("fields", "passed", "warned"),
    [
        ({"cgst_amount": 50, "sgst_amount": 50, "total_tax": 100}, True, []), ({"cgst_amount": 50, "sgst_amount": 50, "total_tax": 200}, False, ["taxes do not sum to the total tax"]),
        ({"cgst_amount": 50, "sgst_amount": 80, "total_tax": 130}, False, ["CGST and SGST differ"]), ({"cgst_amount": 50, "igst_amount": 100, "total_tax": 150}, False, ["IGST with CGST or SGST"]),
        ({"igst_amount": 100, "total_tax": 100}, True, []), ({"cgst_amount": 50, "sgst_amount": 50, "total_tax": 100.5}, True, []), ({"subtotal": 1000, "total_tax": 180, "total_amount": 5000}, False, ["subtotal and tax do not make the total"]),
        ({"total_amount": 1000}, True, []), ({"subtotal": 1000, "total_tax": 180, "total_amount": 1130}, False, ["subtotal and tax do not make the total"]), ({"total_amount": -500}, False, ["total is not positive"]),
        ({"total_amount": 50_000_000}, False, ["total over 10000000"]), ({}, True, []), ({"seller_gst": "29AABCT"}, False, ["GSTIN length"]), ({"seller_gst": "29AABCT1234F1Z5", "seller_pan": "AABCT9999F"}, True, ["GSTIN check digit", "PAN is not that of the GSTIN"]),
        ({"invoice_date": "01/01/2030"}, False, ["invoice date in the future"]), ({"invoice_date": "01/01/2024", "order_date": "02/01/2024"}, True, ["invoice before order"]), ({"cgst_rate": 9.0, "sgst_rate": 7.0}, True, ["sgst_rate is no GST rate"]),
        ({"total_tax": 20, "total_amount": 10}, False, ["tax exceeds the total"]), ({"subtotal": -1}, False, ["subtotal is negative"]),
    ],
)
def test_checks(spark, fields, passed, warned):
    kinds = {k: "decimal(18,2)" if k in validate.AMOUNTS else "double" if k in validate.RATES else "string" for k in fields}
    values = [Decimal(str(v)) if kinds[k].startswith("decimal") else v for k, v in fields.items()]
    frame = spark.createDataFrame([(1, *values)], ", ".join(["inv_id long", *[f"{k} {t}" for k, t in kinds.items()]]))
    got = validate.validate(frame, "2026-01-01").first()
    assert got["passed"] == passed
    assert got["validation_warnings"] == [*warned, "fewer than 8 fields"]


def test_classes_and_decisions(spark):
    frame = spark.createDataFrame([(1, SHOP), (2, STATEMENT), (3, "hello"), (4, None)], "id long, text string")
    got = {r["id"]: r for r in classify.classify(frame).collect()}
    assert [got[i]["document_type"] for i in (1, 2, 3, 4)] == ["invoice", "bank_statement", "unknown", "unknown"]
    assert got[1]["platform"] == "amazon" and got[3]["all_scores"] == {} and got[2]["all_scores"]["bank_statement"] == got[2]["confidence"]
    rows = [(5, True, 0.9, "success"), (5, False, 0.9, "partial"), (2, True, 0.3, "low_confidence"), (2, True, 0.5, "partial")]
    decided = spark.createDataFrame(rows, "n int, valid boolean, ocr double, want string").where(classify.status(F.col("n"), F.col("valid"), F.col("ocr")) == F.col("want"))
    assert decided.count() == 4
    kept, refused = classify.accepted(spark.createDataFrame([("application/pdf",), ("text/plain",), (None,)], "content_type string"))
    assert (kept.count(), refused.count()) == (1, 2)


def test_platform_words_within_a_pan(spark):
    texts = [(1, "Ordered at corner shop\nPAN: AAMZN4381N", "unknown"), (2, "GSTIN: 27EKART1001N1ZQ", "unknown"), (3, "PAN: AAMZN4381N\nsold on AMZN", "amazon"), (4, "Ekart Logistics\nPAN: AAMZN4381N", "flipkart")]
    rows = spark.createDataFrame(texts, "id int, text string, want string").select("want", classify.platform(F.col("text")).alias("got")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]


def test_holder_names_no_bank(spark):
    pages = [(1, 1, "Account Holder: CUSTOMER IDFCX"), (1, 2, "IFSC Code: HDFC0008352"), (2, 1, "IDFC First\nAccount Holder: CUSTOMER BX")]
    found = bank.header_over_pages(spark.createDataFrame(pages, "stmt_id int, page int, text string")).collect()
    assert {r["stmt_id"]: (r["bank_name"], r["account_holder"]) for r in found} == {1: ("HDFC Bank", "CUSTOMER IDFCX"), 2: ("IDFC First Bank", "CUSTOMER BX")}


def test_items_are_read_in_one_pass(spark):
    """Codes and prices are those of the two groups of each line found, over line ends too; a text is matched once."""
    texts = ["HSN: 123456 goods ₹1,234.50\nhsn/12345678901 Rs.5.00 rs 7\nHSN 1234 x", "HSN\n 4321 a ₹ 12\n\nHSN:0000 ₹5 ₹\n6.25 \n", "HSN:12345 Rs.Rs. 1,2 x\nHSN1234₹,9.0", "none", "", None]
    line = re.compile(r"HSN[:/]?\s*(\d{4,8})[^\n]*?(?:₹|Rs\.?)\s*([\d,]+\.?\d+)\s*$", re.I | re.M)
    frame = spark.createDataFrame(list(enumerate(texts)), "inv_id long, text string")
    got = {r["inv_id"]: r["i"] and [(x["hsn_code"], x["total_price"]) for x in r["i"]] for r in frame.select("inv_id", invoice.items(F.col("text")).alias("i")).collect()}
    assert got == {i: [(a, Decimal(b.replace(",", "")).quantize(Decimal("0.01"))) for a, b in line.findall(t or "")] or None for i, t in enumerate(texts)} and got[1]
    plan = queries.invoice_items(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("HSN[:/]") == 1
