"""Fields from any labelled text: candidates by label, by format and by table; the surest of each field stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.patterns import bound, every, group
from foliospark.functions.text import parse_amount

# Labels of fields, and formats that need no label.
LABELS = {
    "invoice_number": ("invoice number", "invoice no", "bill no", "bill number"),
    "order_number": ("order number", "order no", "order id"),
    "invoice_date": ("invoice date", "date of invoice", "bill date"),
    "order_date": ("order date", "ordered on"),
    "seller_name": ("sold by", "seller name", "seller", "supplier"),
    "seller_gst": ("gstin", "gst number", "gst no"),
    "seller_pan": ("pan", "pan no"),
    "buyer_name": ("customer name", "bill to", "buyer"),
    "place_of_supply": ("place of supply",),
    "subtotal": ("subtotal", "sub total", "taxable value"),
    "total_tax": ("total tax", "tax amount"),
    "total_amount": ("grand total", "total amount", "invoice value", "amount due"),
    "payment_method": ("payment mode", "payment method"),
    "account_number": ("account number", "account no"),
    "ifsc_code": ("ifsc code", "ifsc"),
    "account_holder": ("account holder",),
    "opening_balance": ("opening balance",),
    "closing_balance": ("closing balance",),
}
FORMATS = {
    "seller_gst": r"\b(\d{2}[A-Z]{5}\d{4}[A-Z][A-Z0-9]Z[A-Z0-9])\b",
    "seller_pan": r"\b([A-Z]{5}\d{4}[A-Z])\b",
    "order_number": r"\b(\d{3}-\d{7}-\d{7}|OD\d{12,})\b",
    "ifsc_code": r"\b([A-Z]{4}0[A-Z0-9]{6})\b",
    "invoice_date": r"\b(\d{2}[/-]\d{2}[/-]\d{4})\b",
    "buyer_phone": r"\b((?:\+91[\s-]?)?[6-9]\d{9})\b",
}
AMOUNTS = ("subtotal", "total_tax", "total_amount", "opening_balance", "closing_balance")


def _labels(spark) -> DataFrame:
    rows = [(label, field, i) for i, (label, field) in enumerate((label, field) for field, labels in LABELS.items() for label in labels)]
    return F.broadcast(spark.createDataFrame(rows, "known string, field string, rank int"))


def _numbered(lines: Column) -> Column:
    """array<struct<pos, line>> of trimmed lines."""
    return F.transform(lines, lambda x, i: F.struct(i.alias("pos"), F.trim(x).alias("line")))


def _pairs_by_label(text: Column) -> Column:
    """array<struct<emitted, label, value, conf>>: "label: value" on a line, label, colon and value on three, and line after line."""
    lines = F.filter(_numbered(F.split(text, "\n")), lambda x: x["line"] != "")
    # Each line beside the two after it; the lines are cut once.
    shifted = lambda x, n: F.slice(F.transform(x, lambda y: y["line"]), n, F.size(x))
    steps = bound(lines, lambda x: F.arrays_zip(F.transform(x, lambda y: y["pos"]).alias("pos"), shifted(x, 1).alias("line"), shifted(x, 2).alias("next"), shifted(x, 3).alias("after")))

    def found(x: Column) -> Column:
        one = F.regexp_extract(x["line"], r"^([A-Za-z][A-Za-z /.]{1,40}?)\s*[:#]\s*(\S.*)$", 1)
        label = F.regexp_extract(x["line"], r"^([A-Za-z][A-Za-z /.]{1,40}?)\s*:?$", 1)
        pair = lambda nth, l, v, conf: F.struct((x["pos"] * 3 + nth).alias("emitted"), l.alias("label"), v.alias("value"), F.lit(conf).alias("conf"))  # noqa: E731, E741
        on_line = F.when(one != "", pair(0, one, F.regexp_extract(x["line"], r"^[A-Za-z][A-Za-z /.]{1,40}?\s*[:#]\s*(\S.*)$", 1), 0.90))
        over_three = F.when((label != "") & (x["next"] == ":") & x["after"].isNotNull(), pair(1, label, x["after"], 0.85))
        over_two = F.when((label != "") & x["next"].isNotNull() & (x["next"] != ":"), pair(2, label, x["next"], 0.65))
        return F.array_compact(F.array(on_line, over_three, over_two))

    return F.flatten(F.transform(steps, found))


def label_values(docs: DataFrame) -> DataFrame:
    """(doc_id, emitted, label, value, conf)."""
    return docs.select("doc_id", F.inline(_pairs_by_label(F.col("text"))))


def match_labels(pairs: DataFrame) -> DataFrame:
    """pairs with the field of the label: the same words; else nearly the same, in any order; else one contained in the other.

    Nearly: of the words sorted, at most a fifth of the characters differ. Labels are compared once each, with
    a table of known labels of fixed size.
    """
    known = _labels(pairs.sparkSession)
    given = F.col("field") if "field" in pairs.columns else F.lit(None).cast("string")
    plain = pairs.withColumn("_given", given).drop("field").withColumn("_label", F.trim(F.lower(F.regexp_replace("label", r"[.\s]+", " "))))
    same = F.col("_label") == F.col("known")
    either = F.contains(F.col("_label"), F.col("known")) | F.contains(F.col("known"), F.col("_label"))
    in_order = lambda c: F.array_join(F.array_sort(F.split(F.col(c), " ")), " ")
    nearly = F.levenshtein(in_order("_label"), in_order("known")) * 5 <= F.greatest(F.char_length("_label"), F.char_length("known"))
    keys = plain.where(F.col("_label").isNotNull()).select("_label").distinct()
    order = F.struct((~same).alias("inexact"), (~nearly).alias("far"), "rank")
    fields = keys.join(known, (either | nearly) & (F.char_length("_label") > 2)).groupBy("_label").agg(F.min_by("field", order).alias("field"))
    # A pair that has its field already keeps it.
    found = plain.join(fields, "_label", "left").withColumn("field", F.coalesce("_given", "field"))
    return found.where(F.col("field").isNotNull()).drop("_label", "_given")


def _pairs_by_format(text: Column) -> Column:
    """array<struct<emitted, field, value, conf>> of fields that show by their shape alone."""
    found = [F.struct(F.lit(10**8 + i).alias("emitted"), F.lit(f).alias("field"), group(text, p, flags="").alias("value"), F.lit(0.88).alias("conf")) for i, (f, p) in enumerate(FORMATS.items())]
    return F.filter(F.array(*found), lambda x: x["value"].isNotNull())


def by_format(docs: DataFrame) -> DataFrame:
    """(doc_id, emitted, field, value, conf 0.88)."""
    return docs.select("doc_id", F.inline(_pairs_by_format(F.col("text"))))


def _pairs_by_table(text: Column) -> Column:
    """array<struct<emitted, label, value, conf>>: cells under a row of known labels, until a row with fewer than two cells or the next such row."""
    cut = r"\s*\|\s*|\t+| {3,}"
    every_label = F.array(*[F.lit(x) for labels in LABELS.values() for x in labels])

    def row(line: Column, pos: Column) -> Column:
        parts = F.filter(F.split(F.trim(F.regexp_replace(line, r"^\s*\||\|\s*$", "")), cut), lambda c: F.trim(c) != "")
        return F.struct(pos.alias("pos"), F.transform(parts, lambda c: F.trim(c)).alias("cells"))

    def is_head(x: Column) -> Column:
        return (F.size(x["cells"]) >= 2) & (F.size(F.filter(x["cells"], lambda c: F.array_contains(every_label, F.lower(c)))) >= 2)

    rows = F.transform(F.split(text, "\n"), row)
    marked = F.transform(rows, lambda x: F.struct(x["pos"].alias("pos"), x["cells"].alias("cells"), is_head(x).alias("head")))

    def table(marked: Column, head: Column) -> Column:
        body = F.slice(marked, head["pos"] + 2, F.greatest(head["end"] - head["pos"] - 1, F.lit(0)))
        cell = lambda x: F.transform(F.arrays_zip(head["cells"].alias("label"), x["cells"].alias("value")), lambda c, n: F.struct((F.lit(2 * 10**8) + x["pos"] * 100 + n).alias("emitted"), c["label"].alias("label"), c["value"].alias("value"), F.lit(0.75).alias("conf")))
        return F.filter(F.flatten(F.transform(body, cell)), lambda c: c["label"].isNotNull() & c["value"].isNotNull())

    def tables(marked: Column) -> Column:
        # A table ends where the next row stands that is a head or has fewer than two cells.
        stops = F.filter(marked, lambda x: x["head"] | (F.size(x["cells"]) < 2))
        ended = lambda all_of_them: F.transform(all_of_them, lambda x, i: F.struct(x["pos"].alias("pos"), x["cells"].alias("cells"), x["head"].alias("head"), F.coalesce(F.get(all_of_them, i + 1)["pos"], F.size(marked)).alias("end")))
        return F.flatten(F.transform(F.filter(bound(stops, ended), lambda x: x["head"]), lambda head: table(marked, head)))

    return bound(marked, tables)


def _fields_of_cells(matched: DataFrame) -> DataFrame:
    """Cells of a table under the label of an amount must hold a number."""
    number = ~F.col("field").isin(*AMOUNTS) | F.col("value").rlike(r"^[₹Rs.\s]*[\d,]+(?:\.\d+)?$")
    return matched.where((F.col("conf") != 0.75) | number)


def by_table(docs: DataFrame) -> DataFrame:
    """(doc_id, emitted, field, value, conf 0.75)."""
    cells = docs.select("doc_id", F.inline(_pairs_by_table(F.col("text"))))
    return _fields_of_cells(match_labels(cells)).select("doc_id", "emitted", "field", "value", "conf")


def best(candidates: DataFrame) -> DataFrame:
    """The surest candidate of each field, the first emitted of equals."""
    order = Window.partitionBy("doc_id", "field").orderBy(F.desc("conf"), "emitted")
    return candidates.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") == 1).drop("_nth")


def numeric(field: Column, value: Column) -> Column:
    return F.when(field.isin(*AMOUNTS), parse_amount(value))


def extract(docs: DataFrame) -> DataFrame:
    """(doc_id, field, value, amount, conf) of docs (doc_id, text). A text is read once, in place; labels are matched together."""
    text, none = F.col("text"), F.lit(None).cast("string")
    whole = lambda pairs, label, field: F.transform(pairs, lambda x: F.struct(x["emitted"].alias("emitted"), (x["label"] if label else none).alias("label"), (x["field"] if field else none).alias("field"), x["value"].alias("value"), x["conf"].alias("conf")))
    pairs = F.concat(whole(_pairs_by_label(text), True, False), whole(_pairs_by_table(text), True, False), whole(_pairs_by_format(text), False, True))
    found = docs.select("doc_id", F.inline(pairs))
    candidates = _fields_of_cells(match_labels(found)).select("doc_id", "emitted", "field", "value", "conf")
    return best(candidates).select("doc_id", "field", "value", numeric(F.col("field"), F.col("value")).alias("amount"), "conf")


def all_identifiers(text: Column) -> Column:
    return every(text, FORMATS["seller_gst"], flags="")
