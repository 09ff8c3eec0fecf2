"""Whole jobs: invoices from text to decision, their export, and counts of a batch."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.operators import classify, invoice, validate
from foliospark.settings import settings

#: Columns of the flat export, in order.
EXPORT = (
    "platform", "billing_address", "shipping_address", "invoice_type", "order_number", "invoice_number", "order_date", "invoice_details", "invoice_date", "seller_info", "seller_pan", "seller_gst",
    "fssai_license", "billing_state_code", "shipping_state_code", "place_of_supply", "place_of_delivery", "reverse_charge", "amount_in_words", "seller_name", "seller_address", "total_tax", "total_amount",
    "buyer_name", "buyer_phone", "subtotal", "cgst_amount", "sgst_amount", "igst_amount", "cgst_rate", "sgst_rate", "igst_rate", "discount", "delivery_charge", "packaging_charge", "payment_method",
)


def with_error(docs: DataFrame) -> DataFrame:
    """docs with ``error``: what came along from reading, or that there is no text; null otherwise."""
    read = F.col("error") if "error" in docs.columns else F.lit(None).cast("string")
    return docs.withColumn("error", F.coalesce(read, F.when(F.col("text").isNull(), "no text")))


def process(docs: DataFrame, as_of: datetime.date | str, ocr_confidence: Column | None = None) -> DataFrame:
    """docs (inv_id, text) extracted, validated, scored and decided; a row with an ``error`` keeps it, with status failed.

    A text that yields nothing is a row with few fields, not an error; one that fails stops no other.
    """
    read = with_error(docs)
    done = validate.validate(invoice.extract(read.withColumn("text", F.when(F.col("error").isNull(), F.col("text"))), carried=("error",)), as_of)
    ocr = F.lit(0.98) if ocr_confidence is None else ocr_confidence
    return done.withColumn("confidence", invoice.confidence(F.col("fields_extracted"), ocr)).withColumn(
        "status", F.when(F.col("error").isNotNull(), "failed").otherwise(classify.status(F.col("fields_extracted"), F.col("passed"), ocr, settings(docs.sparkSession)))
    )


def counts(results: DataFrame) -> DataFrame:
    """Counters of a batch by status; an error counts as failed and does not stop the others."""
    failed = F.col("error").isNotNull() if "error" in results.columns else F.lit(False)
    return results.agg(
        F.count("*").alias("total"), F.count_if(~failed).alias("processed"), F.count_if(failed).alias("failed"),
        F.count_if(~failed & (F.col("status") == "success")).alias("success"), F.count_if(~failed & (F.col("status") == "partial")).alias("partial"),
    )


def flat(invoices: DataFrame, *keys: str) -> DataFrame:
    """keys, then the export's columns as text, empty where nothing was found; columns that are missing too."""
    return invoices.select(*keys, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in invoices.columns else F.lit("").alias(c) for c in EXPORT])


def write_csv(invoices: DataFrame, path: str) -> None:
    flat(invoices).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def field_values(invoices: DataFrame, key: str = "inv_id") -> DataFrame:
    """(key, field, value): one row for each field that has a value, for sheets of two columns."""
    wide = flat(invoices).columns
    text = invoices.select(key, *[(F.col(c).cast("string") if c in invoices.columns else F.lit(None).cast("string")).alias(c) for c in wide])
    return text.unpivot([key], list(wide), "field", "value").where(F.coalesce("value", F.lit("")) != "")


# Headings of the wide report and the column under each.
REPORT = {
    "Platform": "platform", "Invoice Number": "invoice_number", "Order Number": "order_number", "Invoice Date": "invoice_date", "Order Date": "order_date", "Invoice Type": "invoice_type", "Seller Name": "seller_name",
    "Seller GST": "seller_gst", "Seller PAN": "seller_pan", "FSSAI": "fssai_license", "Billing Address": "billing_address", "Shipping Address": "shipping_address", "Billing State": "billing_state_code",
    "Shipping State": "shipping_state_code", "Place of Supply": "place_of_supply", "Place of Delivery": "place_of_delivery", "Reverse Charge": "reverse_charge", "Subtotal": "subtotal", "CGST Rate": "cgst_rate",
    "CGST Amount": "cgst_amount", "SGST Rate": "sgst_rate", "SGST Amount": "sgst_amount", "IGST Rate": "igst_rate", "IGST Amount": "igst_amount", "Total Tax": "total_tax", "Discount": "discount",
    "Delivery": "delivery_charge", "Packaging": "packaging_charge", "Total Amount": "total_amount", "Amount in Words": "amount_in_words", "Buyer Name": "buyer_name", "Phone": "buyer_phone",
    "Payment Method": "payment_method", "Confidence %": "confidence", "Validated": "passed", "Fields Extracted": "fields_extracted", "Processing Time (s)": "seconds", "OCR Engine": "engine", "OCR Confidence %": "ocr_confidence",
}


def report(results: DataFrame, *keys: str) -> DataFrame:
    """keys, then the columns of REPORT as text: shares as per cent, decisions as Yes and No, nothing as empty."""
    shown = {
        "confidence": lambda c: F.concat(F.round(c * 100).cast("int").cast("string"), F.lit("%")),
        "passed": lambda c: F.when(c, "Yes").otherwise("No"),
        "seconds": lambda c: F.format_number(c, 2),
        "ocr_confidence": lambda c: F.concat(F.format_number(c * 100, 1), F.lit("%")),
    }
    cell = lambda c: shown.get(c, lambda x: x.cast("string"))(F.col(c)) if c in results.columns else F.lit("")
    return results.select(*keys, *[F.coalesce(cell(c), F.lit("")).alias(name) for name, c in REPORT.items()])


# Sections of a statement's sheet, labels and the column beside each.
SHEET = {
    "Account Details": {
        "Bank Name": "bank_name", "Account Holder": "account_holder", "Account Number": "account_number", "Account Type": "account_type", "IFSC Code": "ifsc_code", "MICR Code": "micr_code",
        "Period From": "period_from", "Period To": "period_to", "Pages Processed": "pages_processed",
    },
    "Balances & Analytics": {
        "Opening Balance": "opening_balance", "Closing Balance": "closing_balance", "Total Debits": "total_debits", "Total Credits": "total_credits", "Largest Debit": "largest_debit", "Largest Credit": "largest_credit",
        "Transaction Count": "total_transactions",
    },
}


def statement_sheet(heads: DataFrame, txns: DataFrame) -> DataFrame:
    """(stmt_id, section, row, cells): labelled values of heads, a dash for none, then a row for each transaction in order."""
    rows = [
        F.struct(F.lit(section).alias("section"), F.lit(i).cast("long").alias("row"), F.array(F.lit(label), F.coalesce(F.col(c).cast("string"), F.lit("—"))).alias("cells"))
        for section, labels in SHEET.items()
        for i, (label, c) in enumerate(labels.items(), 1)
    ]
    labelled = heads.select("stmt_id", F.inline(F.array(*rows)))
    text = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("txn_date", "description", "reference_no", "debit", "credit", "balance")])
    nth = F.row_number().over(Window.partitionBy("stmt_id").orderBy("page", "seq")).cast("long")
    return labelled.unionByName(txns.select("stmt_id", F.lit("Transactions").alias("section"), nth.alias("row"), text.alias("cells")))


#: What a run's history shows of each result.
HISTORY = ("platform", "invoice_number", "total_amount", "invoice_date", "confidence", "passed", "status")


def append_history(results: DataFrame, path: str, run_id: str) -> None:
    """Add the results of a run to the table of all runs."""
    results.select("inv_id", *HISTORY).withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def history(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """Results of all runs, or of one, whose folder alone is read."""
    found = spark.read.parquet(path)
    return found if run_id is None else found.where(F.col("run_id") == run_id)


def as_json(invoices: DataFrame) -> DataFrame:
    return invoices.select(F.to_json(F.struct("*")).alias("value"))
