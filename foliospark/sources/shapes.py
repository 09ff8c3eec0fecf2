"""Layouts in which invoices and statements print one field, as short texts with places for values, and what they say.

``{name}``, ``{street}``, ``{amount}``, ``{more}`` (an amount and one) and ``{day}`` are filled from orders and customers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BOTH = "{name} {street}"
_TRADER = "{name} TRADERS\n{street}, Pune\n"

#: By field: (text, what is read from it).
LAYOUTS: dict[str, list[tuple[str, str]]] = {
    "billing_address": [
        ("Billing Address : {name}, {street}\nPune 411001\nState Code: 27", "{name}, {street} Pune 411001"),
        ("Bill to / Ship to:\n{name}\n{street}\nInvoice Number : AB12345", _BOTH),
        ("Bill To\n{name}\n{street}\nShip To\nelsewhere", _BOTH),
        ("Bill To Address\n{name}\n{street}\nPlace of Supply: Goa", _BOTH),
        ("Invoice To: {name}   Seller Name: KWICKBOX", "{name}"),
        ("Invoice To\nName: {name}\nAddress: {street}\nPin code: 411001", "{name}"),
        ("Customer Name : {name}\nOrder 1", "{name}"),
        ("Customer Details\nName: A B\nDelivery Address : {street}\n", "Delivery Address : {street}"),
        ("Billed To\n{name}\n{street}\nState : Goa", _BOTH),
    ],
    "shipping_address": [
        ("Shipping Address : {name}, {street}\nPune 411001\nState Code: 27", "{name}, {street} Pune 411001"),
        ("Bill to / Ship to:\n{name}\n{street}\nInvoice Number : AB12345", _BOTH),
        ("Ship To\n{name}\n{street}\nKeep this invoice", _BOTH),
        ("Ship To Address\n{name}\n{street}\nGSTIN : none", _BOTH),
        ("Shipped To\n{name}\n{street}\nShipped From\nelsewhere", _BOTH),
        ("SHIP TO:\n{name}\n{street}\nTerms : 30 days", _BOTH),
        ("Delivery Address : {name}, {street}\nState name : Goa", "{name}, {street}"),
        ("Invoice To\nName: {name}\nAddress: {street}\nPin code: 411001", "{street}"),
    ],
    "seller_info": [
        ("Sold By\n{name} TRADERS\n{street}\nPAN No: none", "{name} TRADERS {street}"),
        ("Details of Supplier\n{name} TRADERS\n{street}\nTel. 99", "{name} TRADERS {street}"),
        ("Sold By / Seller\n{name} TRADERS\n{street}\nFSSAI : none", "{name} TRADERS {street}"),
        ("Seller Name: {name} TRADERS\nOrder 1", "{name} TRADERS"),
        ("Tax Invoice on behalf of -\nLegal Entity Name: {name}\nRestaurant Name: Inn\nInvoice No : 1", "Legal Entity Name: {name} Restaurant Name: Inn"),
        ("RELIANCE RETAIL LIMITED {street}\nPune", "RELIANCE RETAIL LIMITED {street}"),
        ("Sold By: {name} TRADERS\nPAN : none", "{name} TRADERS"),
        ("Bill From:\n{name} TRADERS\n{street}\nGSTIN : none", "{name} TRADERS {street}"),
        ("Invoice From: {name} TRADERS\nEmail: none", "{name} TRADERS"),
    ],
    "seller_address": [
        ("Sold By\n" + _TRADER + "PAN No: none", "{street}, Pune"),
        ("Details of Supplier\n{name} TRADERS\n{street}\nPune\nTel. 99", "{name} TRADERS {street} Pune"),
        ("Details of Supplier\n" + _TRADER + "GSTIN : none", "{street}, Pune"),
        ("Sold By / Seller\n" + _TRADER + "GSTIN : none", "{name} TRADERS {street}, Pune"),
        ("Supply/Dispatch Location Address : {street}, Pune\nSupply State : Goa", "{street}, Pune"),
        ("Invoice From: {name}\nAddress: {street}, Pune\nPincode 1", "{street}, Pune"),
        ("Ship-from Address: {street}, Pune\nGSTIN : none", "{street}, Pune"),
        ("Bill From:\n" + _TRADER + "Qty 1", "{street}, Pune"),
        ("Restaurant Address : {street}, Pune\nRestaurant GSTIN : none", "{street}, Pune"),
        ("Sold by: " + _TRADER + "Tax is not payable on reverse charge", "{street}, Pune"),
        ("Registered Address : {street}, Pune\nCity : Pune", "{street}, Pune"),
    ],
    "amount_in_words": [
        ("Total Invoice value (In words): Rs. {name} Rupees and Ten Paisa\n9", "{name} Rupees and Ten Paisa"),
        ("Total Invoice value In words: {name}\nRupees Only\n9", "{name}\nRupees Only"),
        ("Amount (in words): {name} Only\n9", "{name} Only"),
        ("Amount in Words:\n{name} hundred and\ntwo Only\n9", "{name} hundred and\ntwo Only"),
        ("Amount in Words\n{name} rupees, no more\n9", "{name} rupees, no more"),
        ("Invoice total in words {name} and ten, plus tax\n9", "{name} and ten, plus tax"),
        ("Amount in Word: {name} only\n9", "{name} only"),
    ],
    "total_amount": [
        (text, "{amount}")
        for text in (
            "{amount}\nAmount in words", "Grand Total ₹ {amount}", "Total Invoice value (In Figure): Rs. {amount}", "Final Total : Rs. {amount}", "Total Invoice Value\n₹ {amount}", "Total Value 390 9.75 9.75 {amount}",
            "Invoice Value {amount}", "Invoice Total ₹{amount}", "Balance Due : {amount}", "TOTAL Rs 1 Rs 2 Rs 3 Rs 4 Rs 5 Rs {amount}", "Total Rs.5 Rs.{amount}", "Total 3 10 1 {amount}", "Total ₹ {amount}",
            "TOTAL: ₹90.00 ₹{amount} paid",
        )
    ],
    "subtotal": [
        (text, "{amount}")
        for text in (
            "Total Taxable Amount: Rs. {amount}", "Total 2 700 -20 {amount} 3 683", "Taxable Value Rs.{amount}", "Total Value {amount} 9.75 9.75 409.5", "Item(s) Total 400 30 {amount}", "Taxable Amount : {amount}",
            "Sub-Total : ₹ {amount}", "Sub Total {amount}",
        )
    ] + [("bigbasket\nCGST% Sale Taxable Value Tax Value\n2.5% Rs. 10 Rs. {amount} Rs. 1\n9% Rs. 10 Rs. 1.00 Rs. 1\nTransaction ID", "{more}")],
    "discount": [(text, "{amount}") for text in ("You Saved : Rs. {amount}", "Discounts/Coupons ₹ -{amount}", "Total Discount : -₹{amount}")],
    "delivery_charge": [("Shipping Fee : ₹{amount}", "{amount}"), ("Delivery Costs {amount}", "{amount}")],
    "packaging_charge": [("Handling Charge\n₹{amount}", "{amount}"), ("Packing Charges : ₹{amount}", "{amount}"), ("Restaurant Packaging Charge 25 0 25", "25.00")],
    "buyer_name": [
        (text, "{name}")
        for text in (
            "Legal Name : {name}", "Invoice To : {name}   Seller Name : Inn", "Bill to / Ship to:\n{name}, {street}", "Customer Name : {name}", "Invoice To\nName : {name}", "Ship To:\n{name}\n{street}",
            "Name of the Customer : {name}", "Name : {name}",
        )
    ],
    "period": [
        (text, "0{day}/01/2024|31/01/2024")
        for text in (
            "From : 0{day}/01/2024 To : 31/01/2024", "From 0{day}/01/2024 To 31/01/2024", "Period : 0{day}/01/2024 to 31/01/2024", "Statement Date - 0{day}/01/2024 – 31/01/2024", "0{day}/01/2024 to 31/01/2024",
            "for the period0{day}/01/2024to31/01/2024",
        )
    ] + [
        ("Statement Period from Mar 0{day}, 2026 to Mar 31, 2026", "Mar 0{day}, 2026|Mar 31, 2026"),
        ("for the period April 0{day}, 2025 - July02, 2025", "April 0{day}, 2025|July02, 2025"),
        ("Sept. 0{day} 2025 - December 02, 2025", "Sept. 0{day} 2025|December 02, 2025"),
    ],
}

#: All layouts in one row, with their fields.
ALL = [(field, text, says) for field, layouts in LAYOUTS.items() for text, says in layouts]

_NUMBER = "(k % 9000 + {0})"
#: Values by key k and customer's segment s, as SQL that Spark and DuckDB read alike.
VALUES = {
    "name": "concat('Asha ', s)", "street": "concat(CAST(k AS VARCHAR(20)), ' Lake Road')", "amount": "concat(CAST(" + _NUMBER.format(100) + " AS VARCHAR(20)), '.50')",
    "more": "concat(CAST(" + _NUMBER.format(101) + " AS VARCHAR(20)), '.50')", "day": "CAST(k % 9 + 1 AS VARCHAR(20))",
}


def layouts(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """(inv_id, field, text): each order prints one field in one layout."""
    keyed = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("k"), F.col("c_mktsegment").alias("s"))
    nth = (F.col("k") % len(ALL)).cast("int")
    pick = lambda i: F.get(F.array(*[F.lit(x[i]) for x in ALL]), nth)
    text: Column = pick(1)
    for name, value in VALUES.items():
        text = F.replace(text, F.lit("{" + name + "}"), F.expr(value))
    return keyed.select(F.col("k").alias("inv_id"), pick(0).alias("field"), text.alias("text"))


def said() -> str:
    """SQL for (inv_id, field, value) from orders and customers."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    pick = lambda i: "list_extract([" + ", ".join(quoted(x[i]) for x in ALL) + f"], CAST(k % {len(ALL)} AS INTEGER) + 1)"
    value = pick(2)
    for name, sql in VALUES.items():
        value = f"replace({value}, '{{{name}}}', {sql})"
    keyed = "SELECT o_orderkey AS k, c_mktsegment AS s FROM orders JOIN customer ON o_custkey = c_custkey"
    return f"SELECT k AS inv_id, {pick(0)} AS field, {value} AS value FROM ({keyed})"
