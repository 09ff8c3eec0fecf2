"""Page layout: regions, rows of words, columns, and words put into cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.dims import COLUMN_WORDS
from foliospark.functions.patterns import bound, first_contained, group
from foliospark.functions.text import is_amount

# --- regions --------------------------------------------------------------------------------------------


def heuristic_regions(pages: DataFrame, top: float = 0.15, bottom: float = 0.82) -> DataFrame:
    """Header, table and footer bands of pages (doc_id, w, h), confidence 0.6."""
    w, h = F.col("w"), F.col("h")
    band = lambda name, a, b: F.struct(F.lit(name).alias("label"), F.lit(0.6).alias("conf"), F.array(F.lit(0.0), h * a, w.cast("double"), h * b).alias("bbox"))
    bands = F.array(band("header", 0.0, top), band("table", top, bottom), band("footer", bottom, 1.0))
    return pages.select("doc_id", F.explode(bands).alias("r")).select("doc_id", "r.*")


def relabel(label: Column, bbox: Column, w: Column, h: Column) -> Column:
    """A detector's label by where the box lies: top, bottom, tall, small."""
    y1, y2, width, height = bbox[1], bbox[3], (bbox[2] - bbox[0]) / w, (bbox[3] - bbox[1]) / h
    return (
        F.when(y2 / h < 0.15, "header").when(y1 / h > 0.85, "footer").when(height > 0.35, "table").when((width < 0.2) & (height < 0.1), "logo").otherwise(F.when(label.isin("header", "footer", "table"), label).otherwise("content"))
    )


def merge_regions(detected: DataFrame, heuristic: DataFrame, sure: float | None = 0.5) -> DataFrame:
    """All detected regions, and the heuristic ones whose label was not detected with at least that confidence."""
    found = detected if sure is None else detected.where(F.col("conf") >= sure)
    rest = heuristic.join(found.select("doc_id", "label").distinct(), ["doc_id", "label"], "left_anti")
    return detected.withColumn("src", F.lit("detected")).unionByName(rest.withColumn("src", F.lit("heuristic")))


def merge_regions_of_invoice(detected: DataFrame, heuristic: DataFrame) -> DataFrame:
    """As merge_regions, whatever the confidence of what was detected; a heuristic region says so in its label and has confidence 0.5."""
    rest = heuristic.join(detected.select("doc_id", "label").distinct(), ["doc_id", "label"], "left_anti")
    rest = rest.withColumn("label", F.concat("label", F.lit(" (heuristic fallback)"))).withColumn("conf", F.lit(0.5))
    return detected.withColumn("src", F.lit("detected")).unionByName(rest.withColumn("src", F.lit("heuristic")))


def detections(boxes: DataFrame, least: float = 0.25) -> DataFrame:
    """Boxes with enough confidence, with their area and its rank within the document, largest first."""
    b = F.col("bbox")
    area = (b[2] - b[0]) * (b[3] - b[1])
    order = Window.partitionBy("doc_id").orderBy(F.desc("area"), "label", "bbox")
    return boxes.where(F.col("conf") >= least).withColumn("area", area).withColumn("by_area", F.row_number().over(order))


def crop(bbox: Column, w: Column, h: Column, pad: float = 5) -> Column:
    zero = F.lit(0.0)
    return F.array(F.greatest(bbox[0] - pad, zero), F.greatest(bbox[1] - pad, zero), F.least(bbox[2] + pad, w.cast("double")), F.least(bbox[3] + pad, h.cast("double")))


# --- words, rows ----------------------------------------------------------------------------------------


def words_of_boxes(boxes: DataFrame) -> DataFrame:
    """x1, y1, x2, y2 of boxes (…, pts: array of [x, y])."""
    axis = lambda i: F.transform("pts", lambda p: p[i])
    return boxes.select("*", F.array_min(axis(0)).alias("x1"), F.array_min(axis(1)).alias("y1"), F.array_max(axis(0)).alias("x2"), F.array_max(axis(1)).alias("y2")).drop("pts")


def clustered_pages(words: DataFrame, share: float = 0.55) -> DataFrame:
    """(doc_id, page, words) of words (doc_id, page, word_id, text, x1, y1, x2, y2): an array from top to bottom, each with cx, cy and row_id.

    Words from top to bottom join the row while they are within a share of the median height of its running
    mean. The mean starts anew with each row, so this is a fold over the words of a page, which are few.
    """
    names = [c for c in words.columns if c not in ("doc_id", "page")]
    middle = {"cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2}
    word = F.struct(*[c.alias(n) for n, c in reversed(middle.items())], "word_id", F.struct(*names).alias("of"))
    pages = words.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(word)).alias("words"))
    heights = F.sort_array(F.transform("words", lambda w: w["of"]["y2"] - w["of"]["y1"]))
    gap = F.get(heights, F.floor(F.size("words") / 2).cast("int")) * share
    shape = "struct<mean:double,n:int,row:int,rows:array<int>>"

    def step(done: Column, w: Column, gap: Column) -> Column:
        new = done["mean"].isNull() | (F.abs(w["cy"] - done["mean"]) > gap)
        row = done["row"] + new.cast("int")
        mean = F.when(new, w["cy"]).otherwise((done["mean"] * done["n"] + w["cy"]) / (done["n"] + 1))
        return F.struct(mean.alias("mean"), F.when(new, 1).otherwise(done["n"] + 1).alias("n"), row.alias("row"), F.concat(done["rows"], F.array(row)).alias("rows"))

    start = F.struct(F.lit(None).cast("double").alias("mean"), F.lit(0).alias("n"), F.lit(-1).alias("row"), F.array().cast("array<int>").alias("rows")).cast(shape)
    # Bound, or the optimizer would put the median, a sort of the page, into every step.
    rows = bound(gap, lambda g: F.aggregate("words", start, lambda done, w: step(done, w, g), lambda done: done["rows"]))
    placed = lambda w: F.struct(*[w["words"]["of"][n].alias(n) for n in names], *[w["words"][n].alias(n) for n in middle], w["row_id"].alias("row_id"))
    return pages.select("doc_id", "page", F.transform(F.arrays_zip("words", rows.alias("row_id")), placed).alias("words"))


def cluster_rows(words: DataFrame, share: float = 0.55) -> DataFrame:
    """words (doc_id, page, word_id, text, x1, y1, x2, y2) with cx, cy and row_id, as ``clustered_pages`` places them."""
    return clustered_pages(words, share).select("doc_id", "page", F.inline("words"))


def cluster_1d(values: DataFrame, keys: list[str], value: str, gap: Column) -> DataFrame:
    """(keys, cluster, center, n): values cut where the step to the next exceeds gap."""
    order = Window.partitionBy(*keys).orderBy(value)
    jump = F.coalesce((F.col(value) - F.lag(value).over(order) > gap).cast("int"), F.lit(0))
    cut = values.withColumn("_jump", jump).withColumn("cluster", F.sum("_jump").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return cut.groupBy(*keys, "cluster").agg(F.avg(value).alias("center"), F.count("*").alias("n"))


# --- columns, cells -------------------------------------------------------------------------------------


def _pages_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id", "page").agg(F.collect_list(F.struct("row_id", "word_id", "cx", "text")).alias("words"))


def _by_header(words: Column, width: Column | float, first_rows: int) -> Column:
    def kinds(w: Column) -> Column:
        held = bound(F.lower(w["text"]), lambda lower: F.array_compact(F.array(*[F.when(lower.rlike(pattern), F.lit(column)) for column, pattern in COLUMN_WORDS.items()])))
        return F.transform(held, lambda k: F.struct(k.alias("column"), w["row_id"].alias("row_id"), F.struct(w["cx"].alias("cx"), w["word_id"].alias("word_id")).alias("at")))

    def of_row(named: Column, row: Column) -> Column:
        found = F.filter(named, lambda n: n["row_id"] == row)
        return bound(found, lambda f: F.transform(F.array_distinct(F.transform(f, lambda n: n["column"])), lambda c: reached(c, F.array_min(F.transform(F.filter(f, lambda n: n["column"] == c), lambda n: n["at"]))["cx"])))

    def reached(column: Column, cx: Column) -> Column:
        reach = F.when(column == "narration", 0.20).otherwise(0.12) * width
        return F.struct(column.alias("column"), (cx - reach).alias("lo"), (cx + reach).alias("hi"))

    def first(named: Column) -> Column:
        rows = F.array_sort(F.array_distinct(F.transform(named, lambda n: n["row_id"])))
        return F.get(F.filter(F.transform(rows, lambda r: of_row(named, r)), lambda f: F.size(f) >= 3), F.lit(0))

    return bound(F.flatten(F.transform(F.filter(words, lambda w: w["row_id"] < first_rows), kinds)), first)


def columns_by_header(rows: DataFrame, width: Column | float, first_rows: int = 20) -> DataFrame:
    """(doc_id, page, column, lo, hi): of the first rows, the first that names three columns or more.

    A column reaches 12 % of the page's width to either side of its heading's middle, narration 20 %.
    """
    return _pages_of(rows).select("doc_id", "page", F.inline(_by_header(F.col("words"), width, first_rows)))


def _by_amounts(words: Column, width: float) -> Column:
    """Cut where the step to the next exceeds 7 % of the width, as cluster_1d does."""

    def center(part: Column) -> Column:
        known = F.filter(part, lambda x: x.isNotNull())
        return bound(known, lambda k: F.when(F.size(k) > 0, F.aggregate(k, F.lit(0.0), lambda s, x: s + x) / F.size(k)))

    def clusters(xs: Column) -> Column:
        starts = F.filter(F.transform(xs, lambda x, i: F.when((i == 0) | (x - F.get(xs, i - 1) > 0.07 * width), i)), lambda i: i.isNotNull())
        parts = lambda at: F.transform(at, lambda a, k: F.slice(xs, a + 1, F.coalesce(F.get(at, k + 1), F.size(xs)) - a))
        return F.slice(F.reverse(bound(starts, parts)), 1, 3)

    names = F.array(F.lit("balance"), F.lit("credit"), F.lit("debit"))
    found = bound(F.sort_array(F.transform(F.filter(words, lambda w: is_amount(w["text"])), lambda w: w["cx"])), clusters)
    return F.transform(found, lambda part, i: F.struct(F.get(names, i).alias("column"), center(part).alias("center"), F.size(part).cast("long").alias("n")))


def columns_by_amounts(rows: DataFrame, width: float) -> DataFrame:
    """(doc_id, page, column, center, n): clusters of amounts; from the right, balance, credit, debit."""
    return _pages_of(rows).select("doc_id", "page", F.inline(_by_amounts(F.col("words"), width)))


#: Where columns are taken to be, as shares of the width, if nothing tells.
FALLBACK_COLUMNS = {"date": (0.0, 0.14), "narration": (0.14, 0.5), "ref": (0.5, 0.58), "debit": (0.58, 0.72), "credit": (0.72, 0.86), "balance": (0.86, 1.0)}


def columns_in(words: Column, width: float) -> Column:
    """(column, lo, hi) of a page's words (row_id, word_id, cx, text): by its header row, else by its amounts, else FALLBACK_COLUMNS.

    By amounts, a column reaches 11 % of the width to either side; the date lies left of 11 %, the narration between.
    """
    range_ = lambda column, lo, hi: F.struct(F.lit(column).alias("column") if isinstance(column, str) else column.alias("column"), lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))
    reach, start = 0.11 * width, F.lit(0.11 * width)
    fixed = F.array(*[range_(c, F.lit(lo * width), F.lit(hi * width)) for c, (lo, hi) in FALLBACK_COLUMNS.items()])

    def around(found: Column) -> Column:
        left = F.array_min(F.transform(found, lambda f: f["center"])) - reach
        end = F.when((left - start > 0.30 * width) & (F.size(found) >= 3), F.lit(0.50 * width)).otherwise(left)
        amounts = F.transform(found, lambda f: range_(f["column"], f["center"] - reach, f["center"] + reach))
        return F.when(F.size(found) > 0, F.concat(amounts, F.array(range_("date", F.lit(0.0), start), range_("narration", start, end))))

    return F.coalesce(_by_header(words, width, 20), bound(_by_amounts(words, width), around), fixed)


def columns_of_pages(rows: DataFrame, width: float) -> DataFrame:
    """(doc_id, page, column, lo, hi) for every page, as ``columns_in`` finds them."""
    return _pages_of(rows).select("doc_id", "page", F.inline(columns_in(F.col("words"), width)))


def cells(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """(doc_id, page, row_id, column, text): words whose middle lies in a column's range, from left to right.

    Ranges may overlap, and then a word lies in both. A page has at most six columns, so the range is
    checked after an equal join on the page.
    """
    within = rows.join(columns, ["doc_id", "page"]).where(F.col("cx").between(F.col("lo"), F.col("hi")))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("cx", "word_id", "text"))), lambda w: w["text"])
    return within.groupBy("doc_id", "page", "row_id", "column").agg(F.array_join(ordered, " ").alias("text"))


def transactions_of_cells(found: DataFrame) -> DataFrame:
    """Rows that have a date, with one column for each kind of cell."""
    wide = found.groupBy("doc_id", "page", "row_id").pivot("column", list(COLUMN_WORDS)).agg(F.first("text"))
    return wide.where(F.col("date").rlike(r"\d"))


def transactions_of_words(words: DataFrame, width: float) -> DataFrame:
    """``transactions_of_cells`` of ``cells`` of clustered words and their pages' columns, all within a page's row: words are dealt out by page once and not joined."""
    pages = clustered_pages(words.where(F.col("doc_id").isNotNull() & F.col("page").isNotNull()))
    ranged = pages.select("*", columns_in(F.col("words"), width).alias("_in"))
    range_of = lambda k: F.get(F.filter("_in", lambda c: c["column"] == k), F.lit(0))
    held = F.struct(*[range_of(k).alias(k) for k in COLUMN_WORDS])

    def row(part: Column) -> Column:
        inside = lambda ws, k: F.filter(ws, lambda w: w["cx"].between(F.col("_at")[k]["lo"], F.col("_at")[k]["hi"]))
        cell = lambda ws, k: bound(inside(ws, k), lambda found: F.when(F.size(found) > 0, F.array_join(F.transform(found, lambda w: w["text"]), " ")))
        ordered = F.sort_array(F.transform(part, lambda w: F.struct(w["cx"].alias("cx"), w["word_id"].alias("word_id"), w["text"].alias("text"))))
        return bound(ordered, lambda ws: F.struct(F.get(part, F.lit(0))["row_id"].alias("row_id"), *[cell(ws, k).alias(k) for k in COLUMN_WORDS]))

    def rows(ws: Column) -> Column:
        starts = F.filter(F.transform(ws, lambda w, i: F.when((i == 0) | ~w["row_id"].eqNullSafe(F.get(ws, i - 1)["row_id"]), i)), lambda i: i.isNotNull())
        return bound(starts, lambda at: F.transform(at, lambda a, k: row(F.slice(ws, a + 1, F.coalesce(F.get(at, k + 1), F.size(ws)) - a))))

    found = ranged.select("doc_id", "page", "words", held.alias("_at")).select("doc_id", "page", F.inline(rows(F.col("words"))))
    return found.where(F.col("date").rlike(r"\d"))


# Words that tell a bank from a region's text, in order.
REGION_BANKS = {
    "sbi": "State Bank of India", "state bank of india": "State Bank of India", "hdfc": "HDFC Bank", "icici": "ICICI Bank", "axis bank": "Axis Bank", "kotak": "Kotak", "yes bank": "Yes Bank", "bank of baroda": "Bank of Baroda",
    "punjab national": "PNB", "pnb": "PNB", "indusind": "IndusInd", "union bank": "Union Bank", "canara": "Canara Bank", "idbi": "IDBI Bank",
}


def region_parse(regions: DataFrame) -> DataFrame:
    """(doc_id, region_text, n_dated_lines, bank, account) of region texts (doc_id, label, text).

    A map by label; lines that begin with a date; the bank by a word, the account number by its label, both of
    the first region, by label, that tells.
    """
    text = F.coalesce("text", F.lit(""))
    dated = F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\s*\d{2}[/-]\d{2}[/-]\d{2,4}")))
    account = F.regexp_replace(group(text, r"(?:Account|A/C)\s+(?:Number|No)[.:\s]+(\d[\d ]{8,18}\d)"), " ", "")
    read = regions.select("doc_id", "label", "text", dated.alias("dated"), first_contained(F.lower(text), REGION_BANKS).alias("bank"), account.alias("account"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("label"))).alias(c)
    whole = F.map_from_entries(F.collect_list(F.struct("label", "text")))
    return read.groupBy("doc_id").agg(whole.alias("region_text"), F.sum("dated").alias("n_dated_lines"), first("bank"), first("account"))
