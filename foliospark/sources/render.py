"""Documents rendered from relational tables, so that what is extracted can be held against its source.

Statements: one a user of ``events``, in order of time. Invoices: one an order that has lines. Faults are
put in by the remainder of the key, so that every check has both outcomes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.dims import BANK_BY_IFSC, PLATFORMS, STATES
from foliospark.functions.identifiers import gstin_check_digit

MONEY = "decimal(18,2)"
IFSC = ("HDFC", "ICIC", "SBIN", "UTIB", "KKBK", "BARB", "PUNB", "YESB")
KINDS = ("amazon", "flipkart", "meesho", "myntra", "swiggy", "zomato", "bigbasket", "blinkit", "jiomart", "unknown")
_STATE_CODES = tuple(STATES)[:36]


def _pick(values: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def money(value: Column) -> Column:
    return F.format_number(value, 2)


def statement_lines(events: DataFrame, added: int = 3) -> DataFrame:
    """(stmt_id, seq, ts, kind, amount, is_debit, opening, balance) of each event; the amount is its value and ``added``."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    amount = (F.col("value") + added).cast(MONEY)
    is_debit = F.col("event_type").isin("purchase", "error")
    lines = events.where(F.col("user_id").isNotNull()).select(
        F.col("user_id").alias("stmt_id"), "event_id", "ts", F.col("event_type").alias("kind"), amount.alias("amount"), is_debit.alias("is_debit"), F.row_number().over(order).alias("seq"), F.lit(100000).cast(MONEY).alias("opening"),
        F.sum(F.when(is_debit, -amount).otherwise(amount)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_run"),
    )
    return lines.withColumn("balance", (F.col("opening") + F.col("_run")).cast(MONEY)).drop("_run")


def statements(events: DataFrame, sides: bool = False, repeats: bool = False, labelled: bool = True, added: int = 3) -> DataFrame:
    """(stmt_id, text). sides: debit, credit and balance on a line; repeats: every tenth event's line twice; labelled: opening and closing balance."""
    lines = statement_lines(events, added)
    narration = F.concat(F.lit("UPI/"), F.upper("kind"), F.lit(" TXN"))
    if sides:
        nothing = F.lit(0).cast(MONEY)
        figures = F.concat_ws(" ", money(F.when(F.col("is_debit"), F.col("amount")).otherwise(nothing)), money(F.when(F.col("is_debit"), nothing).otherwise(F.col("amount"))), money(F.col("balance")))
    else:
        figures = F.concat_ws(" ", money(F.col("amount")), money(F.col("balance")))
    line = F.concat_ws(" ", F.date_format("ts", "dd/MM/yyyy"), narration, figures)
    line = F.when(F.col("kind") == "error", F.concat(line, F.lit("\nfailed at merchant"))).otherwise(line)
    line = F.when(F.col("seq") % 25 == 0, F.concat(line, F.lit("\nDate Narration Debit Credit Balance\nPage No 2"))).otherwise(line)
    if repeats:
        line = F.when(F.col("event_id") % 10 == 0, F.concat(line, F.lit("\n"), line)).otherwise(line)
    body = lines.withColumn("line", line).groupBy("stmt_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n").alias("body"),
        F.min("ts").alias("from_ts"), F.max("ts").alias("to_ts"), F.max_by("balance", "seq").alias("closing"), F.max("opening").alias("opening"),
    )
    head = _head(F.col("stmt_id"), F.col("opening") if labelled else F.lit(None).cast(MONEY))
    foot = F.concat(F.lit("Closing Balance: "), money(F.col("closing")))
    return body.select("stmt_id", F.concat_ws("\n", head, F.col("body"), foot if labelled else F.lit("End of statement")).alias("text"))


def _head(key: Column, opening: Column) -> Column:
    """What a statement begins with, of stmt_id, from_ts and to_ts."""
    return F.concat_ws(
        "\n",
        F.lit("STATEMENT OF ACCOUNT"),
        F.concat(F.lit("Account Holder: CUSTOMER "), F.translate(key.cast("string"), "0123456789", "ABCDEFGHIJ"), F.lit("X")),
        F.concat(F.lit("Account Number: "), F.lpad(key.cast("string"), 12, "9")),
        F.concat(F.lit("Account Type: "), _pick(("Savings", "Current", "Salary"), key)),
        F.concat(F.lit("IFSC Code: "), _pick(IFSC, key), F.lit("0"), F.lpad(key.cast("string"), 6, "0")),
        F.concat(F.lit("MICR Code: "), F.lpad(key.cast("string"), 9, "1")),
        F.concat(F.lit("From : "), F.date_format("from_ts", "dd/MM/yyyy"), F.lit(" To : "), F.date_format("to_ts", "dd/MM/yyyy")),
        F.concat(F.lit("Opening Balance: "), money(opening)),
    )


#: Lines on a page.
PAGE = 40


def statement_pages(events: DataFrame) -> DataFrame:
    """(stmt_id, page, text): the first page begins with the head; PAGE lines a page, as statements has them."""
    lines = statement_lines(events).withColumn("page", F.floor((F.col("seq") - 1) / PAGE).cast("int"))
    line = F.concat_ws(" ", F.date_format("ts", "dd/MM/yyyy"), F.concat(F.upper("kind"), F.lit(" TXN")), money(F.col("amount")), money(F.col("balance")))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"]), "\n")
    pages = lines.groupBy("stmt_id", "page").agg(body.alias("body"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.max("opening").alias("opening"))
    whole = Window.partitionBy("stmt_id")
    pages = pages.withColumn("from_ts", F.min("first").over(whole)).withColumn("to_ts", F.max("last").over(whole))
    head = F.when(F.col("page") == 0, _head(F.col("stmt_id"), F.col("opening")))
    return pages.select("stmt_id", "page", F.concat_ws("\n", head, F.col("body")).alias("text"))


def word_boxes(events: DataFrame) -> DataFrame:
    """(doc_id, page, word_id, text, x1, y1, x2, y2): statement lines as words at fixed columns, 40 lines a page."""
    lines = statement_lines(events).withColumn("page", F.floor((F.col("seq") - 1) / 40).cast("int")).withColumn("row", ((F.col("seq") - 1) % 40 + 1).cast("int"))
    cell = lambda row, at, text, x1, x2: F.struct(row.alias("row"), F.lit(at).alias("at"), text.alias("text"), F.lit(float(x1)).alias("x1"), F.lit(float(x2)).alias("x2"))
    shown = [
        (F.date_format("ts", "dd/MM/yyyy"), 20, 110),
        (F.upper("kind"), 140, 220),
        (F.lit("TXN"), 230, 260),
        (F.when(F.col("is_debit"), money(F.col("amount"))), 420, 490),
        (F.when(~F.col("is_debit"), money(F.col("amount"))), 540, 610),
        (money(F.col("balance")), 680, 770),
    ]
    heads = [("Date", 20, 60), ("Narration", 140, 220), ("Debit", 430, 480), ("Credit", 550, 600), ("Balance", 690, 760)]
    words = F.array(*[cell(F.col("row"), i, *w) for i, w in enumerate(shown)])
    # The first line of a page brings its head along.
    head = F.array(*[cell(F.lit(0), i, F.lit(t), x1, x2) for i, (t, x1, x2) in enumerate(heads)])
    both = lines.select(F.col("stmt_id").alias("doc_id"), "page", F.inline(F.when(F.col("row") == 1, F.concat(head, words)).otherwise(words))).where(F.col("text").isNotNull())
    # Lines are 30 apart; words of a line are up to 3 off its middle.
    y = F.col("row") * 30.0 + 50 + (F.col("at") * 5 % 7 - 3)
    return both.select("doc_id", "page", (F.col("row") * 10 + F.col("at")).cast("int").alias("word_id"), "text", "x1", (y - 8).alias("y1"), "x2", (y + 8).alias("y2"))


def pan_of(number: Column) -> Column:
    """A PAN of a seller's number: AAACx, four digits, a letter."""
    letter = lambda n: F.char(F.lit(65) + n % 26)
    return F.concat(F.lit("AA"), letter(F.floor(number / 26)), F.lit("C"), letter(number), F.lpad((number % 10000).cast("string"), 4, "0"), letter(number * 7))


def gstin_of(number: Column) -> Column:
    body = F.concat(_pick(_STATE_CODES, number), pan_of(number), F.lit("1Z"))
    return F.concat(body, gstin_check_digit(body))


def invoice_facts(orders: DataFrame, lineitem: DataFrame, customer: DataFrame) -> DataFrame:
    """One row an order that has lines: what its invoice states, before faults. Money is DECIMAL(18,2)."""
    net = (F.col("l_extendedprice").cast(MONEY) * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast(MONEY)
    tax = (net * F.col("l_tax").cast("decimal(4,2)")).cast(MONEY)
    line = F.struct(F.col("l_linenumber").alias("no"), F.lpad((F.col("l_partkey") % 1000000).cast("string"), 6, "1").alias("hsn"), net.alias("price"))
    items = lineitem.groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(line)).alias("items"), F.sum(net).cast(MONEY).alias("subtotal"), F.sum(tax).cast(MONEY).alias("tax"), F.min("l_suppkey").alias("seller"), F.count("*").alias("n_items"),
    )
    joined = orders.join(items, orders.o_orderkey == items.l_orderkey).join(customer, orders.o_custkey == customer.c_custkey)
    half = (F.col("tax") / 2).cast(MONEY)
    within = F.col("o_orderkey") % 2 == 0
    zero = F.lit(0).cast(MONEY)
    return joined.select(
        F.col("o_orderkey").alias("inv_id"), "items", "n_items", "subtotal", F.col("seller"), F.col("c_name").alias("buyer"), F.col("o_orderdate").cast("date").alias("invoice_date"),
        _pick(KINDS, F.col("o_orderkey")).alias("platform"), F.when(within, half).alias("cgst"), F.when(within, half).alias("sgst"), F.when(~within, F.col("tax")).alias("igst"),
        F.when(within, half + half).otherwise(F.col("tax")).cast(MONEY).alias("total_tax"),
        (F.col("subtotal") + F.when(within, half + half).otherwise(F.coalesce("tax", zero))).cast(MONEY).alias("total_amount"),
        gstin_of(F.col("seller")).alias("seller_gst"), pan_of(F.col("seller")).alias("seller_pan"),
        F.format_string("INV/%08d", F.col("o_orderkey")).alias("invoice_number"),
        F.format_string("408-%07d-%07d", F.col("o_orderkey") % 10000000, F.col("o_custkey") % 10000000).alias("order_number"),
        (F.col("o_orderkey") % 11).cast("int").alias("fault"),
    )


#: fault: what is wrong with the invoice whose key leaves it modulo 11.
FAULTS = {1: "check digit", 2: "state code", 3: "total tax", 4: "future date", 5: "no total", 6: "PAN kind"}


def invoices(facts: DataFrame, future: str = "2099-01-01") -> DataFrame:
    """(inv_id, text)."""
    fault = F.col("fault")
    gst = F.col("seller_gst")
    wrong_digit = F.concat(F.substring(gst, 1, 14), F.when(F.substring(gst, 15, 1) == "A", "B").otherwise("A"))
    wrong_state = F.concat(F.lit("99"), F.substring(gst, 3, 13))
    gst = F.when(fault == 1, wrong_digit).when(fault == 2, wrong_state).otherwise(gst)
    pan = F.when(fault == 6, F.concat(F.substring("seller_pan", 1, 3), F.lit("Z"), F.substring("seller_pan", 5, 6))).otherwise(F.col("seller_pan"))
    tax = F.when(fault == 3, F.col("total_tax") + 5).otherwise(F.col("total_tax"))
    date = F.when(fault == 4, F.lit(future).cast("date")).otherwise(F.col("invoice_date"))
    words = {k: PLATFORMS[k][0] for k in KINDS if k in PLATFORMS}
    shop = F.coalesce(*[F.when(F.col("platform") == k, F.lit(w)) for k, w in words.items()], F.lit("corner shop"))
    row = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: ₹"), money(value)))
    return facts.select(
        "inv_id",
        F.concat_ws(
            "\n",
            F.lit("Tax Invoice"),
            F.concat(F.lit("Ordered at "), shop),
            F.lit("Sold By:"),
            F.concat(F.lit("SELLER "), F.translate(F.col("seller").cast("string"), "0123456789", "ABCDEFGHIJ"), F.lit(" PRIVATE LIMITED")),
            F.concat(F.lit("Plot "), F.col("seller").cast("string"), F.lit(", Trade Street, Karnataka")),
            F.concat(F.lit("GSTIN: "), gst),
            F.concat(F.lit("PAN: "), pan),
            F.concat(F.lit("FSSAI License No: "), F.lpad(F.col("seller").cast("string"), 14, "1")),
            F.concat(F.lit("Billing Address:\n"), F.col("buyer"), F.lit("\n12 Market Road, Pune, Maharashtra")),
            F.lit("State Code: 27"),
            F.lit("Place of Supply: Maharashtra"),
            F.concat(F.lit("Order Number: "), F.col("order_number")),
            F.concat(F.lit("Order Date: "), F.date_format("invoice_date", "dd/MM/yyyy")),
            F.concat(F.lit("Invoice Number: "), F.col("invoice_number")),
            F.concat(F.lit("Invoice Date: "), F.date_format(date, "dd/MM/yyyy")),
            F.array_join(F.transform("items", lambda x: F.concat(F.lit("HSN: "), x["hsn"], F.lit(" goods ₹"), money(x["price"]))), "\n"),
            row("Subtotal", F.col("subtotal")),
            row("CGST", F.col("cgst")),
            row("SGST", F.col("sgst")),
            row("IGST", F.col("igst")),
            row("Total Tax", tax),
            row("Grand Total", F.when(fault != 5, F.col("total_amount"))),
            F.lit("Reverse charge: No"),
            F.lit("Payment Mode: UPI"),
        ).alias("text"),
    )


def shop_invoices(facts: DataFrame) -> DataFrame:
    """(inv_id, text): the taxes stand in the table that each shop prints; within a state for some shops, between states for others."""
    plain = lambda c: F.col(c).cast("string")
    net, tax, total = plain("subtotal"), plain("total_tax"), plain("total_amount")
    half, both = (F.col("total_tax") / 2).cast(MONEY), (F.col("subtotal") + (F.col("total_tax") / 2).cast(MONEY) * 2).cast(MONEY).cast("string")
    part = half.cast("string")
    row = lambda *parts: F.concat_ws(" ", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    table = lambda name: F.concat_ws("\n", F.lit(f"{name}% Sale Taxable Value Tax Value"), row("2.5% Rs.", net, "Rs.", net, "Rs.", part))
    tables = {
        "bigbasket": F.concat_ws("\n", table("CGST"), table("SGST"), F.lit("Transaction ID 1"), row("Final Total Rs.", both)),
        "zomato": row("Total Value", net, part, part, both),
        "swiggy": F.concat_ws("\n", row("1 Meals", net, part, part, both), row("Invoice Value", both)),
        "blinkit": F.concat_ws("\n", row("1 Goods", net, part, part, both), row("Total 1", net, part, part, both)),
        "jiomart": F.concat_ws("\n", row("Total", net, net, tax, total), row("Balance Due:", total)),
        "flipkart": row("Total 1", net, "-0.00", net, tax, total),
        "myntra": row("TOTAL Rs", net, "Rs 0.00 Rs 0.00 Rs", net, "Rs", tax, "Rs", total),
    }
    words = {k: PLATFORMS[k][0] for k in tables}
    text = F.coalesce(*[F.when(F.col("platform") == k, F.concat_ws("\n", F.lit("Tax Invoice"), F.lit(f"Ordered at {words[k]}"), v)) for k, v in tables.items()])
    return facts.select("inv_id", text.alias("text")).where(F.col("text").isNotNull())


def long_invoices(facts: DataFrame) -> DataFrame:
    """(inv_id, text): addresses, people, charges, rates and words, in another order than invoices has."""
    key = F.col("inv_id")
    charge = lambda n: money((key % n + 1).cast(MONEY))
    return facts.select(
        "inv_id",
        F.concat_ws(
            "\n",
            F.lit("Tax Invoice"),
            F.lit("Details of Supplier"),
            F.concat(F.lit("SELLER "), F.translate(F.col("seller").cast("string"), "0123456789", "ABCDEFGHIJ"), F.lit(" PRIVATE LIMITED")),
            F.concat(F.lit("Plot "), F.col("seller").cast("string"), F.lit(", Trade Street, Karnataka")),
            F.concat(F.lit("GSTIN: "), F.col("seller_gst")),
            F.lit("Bill To"),
            F.col("buyer"),
            F.concat(F.lit("House "), key.cast("string"), F.lit(", Market Road, Pune, Maharashtra")),
            F.lit("GSTIN: none"),
            F.lit("Ship To"),
            F.col("buyer"),
            F.concat(F.lit("Flat "), key.cast("string"), F.lit(", Lake View, Chennai, Tamil Nadu")),
            F.lit("Place of Supply: Tamil Nadu"),
            F.concat(F.lit("Phone: 9"), F.lpad((key % 1000000000).cast("string"), 9, "0")),
            F.concat(F.lit("CGST @9%: ₹"), money(F.col("total_tax"))),
            F.concat(F.lit("Discount: ₹"), charge(50)),
            F.concat(F.lit("Delivery Charges: ₹"), charge(40)),
            F.concat(F.lit("Packaging Charges: ₹"), charge(30)),
            F.concat(F.lit("Amount in Words: Rupees "), F.translate(key.cast("string"), "0123456789", "ABCDEFGHIJ"), F.lit(" Only")),
        ).alias("text"),
    )


def bank_names() -> dict[str, str]:
    return {k: BANK_BY_IFSC[k] for k in IFSC}
