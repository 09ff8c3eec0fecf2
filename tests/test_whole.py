"""Queries without SQL that give an operator's whole result, against what the rendered invoices state."""

import pytest

from foliospark import queries
from foliospark.operators import layout
from foliospark.plans import batch
from foliospark.sources import render

DATA = "/root/testdata/sf0.001"
FAILED = (2, 3, 4, 6)


def stated(row):
    """Fields of an invoice from the facts it was rendered from; those that it leaves out are missing."""
    f, gst, pan = row["fault"], row["seller_gst"], row["seller_pan"]
    name = f"SELLER {str(row['seller']).translate(str.maketrans('0123456789', 'ABCDEFGHIJ'))} PRIVATE LIMITED"
    day = row["invoice_date"].strftime("%d/%m/%Y")
    out = {
        "platform": row["platform"], "invoice_type": "Tax Invoice", "invoice_number": row["invoice_number"], "order_number": row["order_number"], "order_date": day, "invoice_date": "01/01/2099" if f == 4 else day,
        "seller_name": name, "seller_address": f"Plot {row['seller']}, Trade Street, Karnataka", "seller_info": f"{name} Plot {row['seller']}, Trade Street, Karnataka", "buyer_name": row["buyer"],
        "seller_gst": gst[:14] + ("B" if gst[14] == "A" else "A") if f == 1 else "99" + gst[2:] if f == 2 else gst, "seller_pan": f"{pan[:3]}Z{pan[4:]}" if f == 6 else pan,
        "fssai_license": str(row["seller"]).rjust(14, "1"), "billing_address": f"{row['buyer']} 12 Market Road, Pune, Maharashtra", "billing_state_code": "27 - Maharashtra", "shipping_state_code": "27 - Maharashtra",
        "place_of_supply": "Maharashtra", "reverse_charge": "No", "payment_method": "UPI", "subtotal": row["subtotal"], "cgst_amount": row["cgst"], "sgst_amount": row["sgst"], "igst_amount": row["igst"],
        "total_tax": row["total_tax"] + (5 if f == 3 else 0), "total_amount": None if f == 5 else row["total_amount"],
    }
    if row["platform"] in ("bigbasket", "blinkit"):  # They deliver to the billing address.
        out |= {"shipping_address": out["billing_address"], "place_of_delivery": "Maharashtra"}
    return {k: str(v) for k, v in out.items() if v}


@pytest.fixture(scope="module")
def facts(spark):
    return {r["inv_id"]: r for r in queries.facts(spark, DATA).collect()}


def test_chat_context_whole(spark, facts):
    texts = {r["inv_id"]: r["text"] for r in render.invoices(queries.facts(spark, DATA)).collect()}
    labels = {
        "Platform": "platform", "Invoice Number": "invoice_number", "Order ID": "order_number", "Date": "invoice_date", "Seller": "seller_name", "GSTIN": "seller_gst", "Buyer": "buyer_name", "Subtotal": "subtotal",
        "CGST": "cgst_amount", "SGST": "sgst_amount", "IGST": "igst_amount", "Total Tax": "total_tax", "Total": "total_amount", "Payment": "payment_method",
    }
    warnings = {1: "GSTIN check digit", 2: "GSTIN state", 4: "invoice date in the future"}
    got = queries.chat_context_whole(spark, DATA).collect()
    assert {r["inv_id"] for r in got} == set(facts) and len(got) == len(facts)
    for r in got:
        known, fault = stated(facts[r["inv_id"]]), facts[r["inv_id"]]["fault"]
        lines = [f"{label}: {known[field]}" for label, field in labels.items() if field in known] + [f"Validated: {str(fault not in FAILED).lower()}"]
        head, text = r["context"][: len("\n".join(lines))], texts[r["inv_id"]][:1200]
        assert head == "\n".join(lines) and r["context"].endswith("\n" + text)
        rest = r["context"][len(head) + 1 : -len(text)].strip("\n")
        assert rest.startswith("Warnings: ") if fault in (1, *FAILED) else rest == ""
        assert fault not in warnings or rest == f"Warnings: {warnings[fault]}"


def test_export_and_sheet_whole(spark, facts):
    wide = queries.export_flat_csv_whole(spark, DATA)
    assert wide.columns == ["inv_id", *batch.EXPORT] and len(batch.EXPORT) == 36
    want = {i: stated(r) for i, r in facts.items()}
    got = wide.collect()
    assert len(got) == len(facts)
    for r in got:
        filled = {c: r[c] for c in batch.EXPORT if r[c]}
        assert filled == want[r["inv_id"]] and None not in tuple(r)
    sheet = sorted(map(tuple, queries.field_value_sheet_whole(spark, DATA).select("inv_id", "field", "value").collect()))
    assert sheet == sorted((i, field, value) for i, fields in want.items() for field, value in fields.items())


def test_pages_without_header(spark):
    boxes = []

    def line(page, y, words):
        boxes.extend((1, page, len(boxes), t, a, y - 8.0, b, y + 8.0) for t, a, b in words)

    for page in (0, 1):
        if page == 0:
            line(page, 20.0, [("Date", 20.0, 60.0), ("Narration", 140.0, 220.0), ("Debit", 430.0, 480.0), ("Credit", 550.0, 600.0), ("Balance", 690.0, 760.0)])
        line(page, 50.0, [("01/02/2024", 20.0, 80.0), ("SHOP", 140.0, 220.0), ("10.00", 420.0, 490.0), ("990.00", 680.0, 770.0)])
        line(page, 80.0, [("02/02/2024", 20.0, 80.0), ("PAY", 140.0, 220.0), ("20.00", 540.0, 610.0), ("1,010.00", 680.0, 770.0)])
    line(2, 50.0, [("03/02/2024", 20.0, 80.0), ("NOTICE", 140.0, 220.0)])
    frame = spark.createDataFrame(boxes, "doc_id long, page int, word_id int, text string, x1 double, y1 double, x2 double, y2 double")
    rows = layout.cluster_rows(frame)
    columns = layout.columns_of_pages(rows, 800.0)
    got = layout.transactions_of_cells(layout.cells(rows, columns)).select("page", "date", "narration", "debit", "credit", "balance").collect()
    shop, pay = ("SHOP", "10.00", None, "990.00"), ("PAY", None, "20.00", "1,010.00")
    cells = sorted((r["page"], r["date"], r["narration"].split()[-1], *tuple(r)[3:]) for r in got)
    assert cells == [(p, d, *x) for p in (0, 1) for d, x in (("01/02/2024", shop), ("02/02/2024", pay))] + [(2, "03/02/2024", "NOTICE", None, None, None)]
    assert {r["column"] for r in columns.where("page = 2").collect()} == set(layout.FALLBACK_COLUMNS)
