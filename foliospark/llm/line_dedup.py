"""Lines that many documents share, dropped everywhere but in one document [DataFrame functions only].

Lines become (128-bit hash, document, position). These are dealt out by ranges of (hash, document), so a line
that a third of all documents hold spreads over many partitions, and sorted within by position; one pass over
that order marks each first occurrence of a line in a document. First occurrences are counted by partition and
hash, then by hash, and the verdict goes back to the partitions in which the hash lies, so no step gathers a
line in one place. What comes out is a compressed bitmap per document instead of text.

Texts meet their bitmaps where they are while there are at most BROADCAST_DOCS documents that lose a line;
beyond that, by a join on the document.

Defined results: a null or empty text is one empty line; a null doc_id counts for no line and keeps none
that is dropped elsewhere; rows that repeat a doc_id are one document and each keeps its own lines;
any other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.shared import BLANKS, Kept, Scratch, sealed

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bitmaps up to this number are sent to every executor (about 100 bytes each).
BROADCAST_DOCS = 200_000


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc, spread, version, pos) of every line long enough.

    spread is null, or a number of the row's own where it has no id; version tells rows of one doc_id apart.
    """
    spread = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    long = docs.select(F.col("doc_id").alias("doc"), spread.alias("spread"), F.xxhash64("text").alias("version"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    long = long.withColumn("line", F.btrim("line", F.lit(BLANKS))).where(F.char_length("line") >= min_chars)
    key = F.translate("line", _UPPER, _LOWER)
    return long.select(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"), "doc", "spread", "version", "pos")


def streamed(found: DataFrame) -> DataFrame:
    """found with ``first`` (the line's first occurrence in its document) and ``part``, the range that it lies in."""
    document = ["h1", "h2", "doc", "spread"]
    # The ranges put all of a document's rows of a line together, so the window needs no other exchange.
    in_order = Window.partitionBy(*document).orderBy("pos", "version")
    ranged = found.repartitionByRange(*document)
    return ranged.withColumn("first", (F.row_number().over(in_order) == 1) & F.col("doc").isNotNull()).withColumn("part", F.spark_partition_id())


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc, version, keep) of documents that lose lines.

    keep: array<struct<word, bits>> by word; bit i of a word tells whether line 64 * word + i stays. Words
    that are not listed keep all their lines.
    """
    scratch = Scratch()
    found = scratch.keep(streamed(scratch.keep(occurrences(docs, min_chars), "lines")).drop("spread"), "sorted")
    by_part = found.groupBy("part", "h1", "h2").agg(F.count_if("first").alias("n_docs"), F.max("doc").alias("owner"))
    by_part = scratch.keep(by_part, "counts")
    shared = by_part.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("owner").alias("owner")).where(F.col("n_docs") >= min_docs)
    placed = scratch.keep(by_part.select("part", "h1", "h2").join(shared.select("h1", "h2", "owner"), ["h1", "h2"]), "shared")
    drops = found.join(placed, ["part", "h1", "h2"]).where(~F.col("doc").eqNullSafe(F.col("owner")))
    words = drops.groupBy("doc", "version", F.expr("cast(pos div 64 as int)").alias("word")).agg(F.expr("~bit_or(shiftleft(1L, pos % 64))").alias("bits"))
    bitmaps = Kept(words.groupBy("doc", "version").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("keep")), "bitmaps").frame
    scratch.clear()
    return bitmaps


def expanded(keep: Column) -> Column:
    """All words of a bitmap up to its last, so that a line's word is found by its place."""
    before = lambda i: F.coalesce(F.get(keep, i - 1)["word"], F.lit(-1))
    return F.flatten(F.transform(keep, lambda x, i: F.concat(F.array_repeat(F.lit(-1).cast("long"), x["word"] - before(i) - 1), F.array(x["bits"]))))


#: Columns that dedup_lines adds; columns of docs with these names are replaced.
ADDED = ("kept_text", "n_lines", "n_dropped", "keep")


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, broadcast_docs: int = BROADCAST_DOCS) -> DataFrame:
    """docs with kept_text, n_lines (before), n_dropped and the bitmap ``keep`` (null: all lines)."""
    names = docs.columns
    docs, back = sealed(docs, ("doc_id", "text"))
    bitmaps = keep_bitmaps(docs, min_chars, min_docs)
    dropped = F.aggregate("keep", F.lit(0), lambda n, x: n + 64 - F.bit_count(x["bits"]))
    side = bitmaps.select("doc", "version", "keep", expanded(F.col("keep")).alias("words"), dropped.cast("long").alias("dropped"))
    side = F.broadcast(side) if bitmaps.limit(broadcast_docs + 1).count() <= broadcast_docs else side.hint("merge")
    joined = docs.join(side, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.xxhash64("text") == F.col("version")), "left")
    stays = lambda _, i: F.getbit(F.coalesce(F.get("words", F.shiftright(i, 6)), F.lit(-1).cast("long")), i % 64) == 1
    kept = F.array_join(F.filter(_lines(F.col("text")), stays), "\n")
    # Names come back in a step of their own, so that no column of docs is taken for one of these.
    done = joined.select(
        *docs.columns,
        F.when(F.col("words").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept).alias("kept_text"),
        F.size(_lines(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce("dropped", F.lit(0).cast("long")).alias("n_dropped"),
        "keep",
    )
    return done.select(*[back[i] for i, c in enumerate(names) if c not in ADDED], *ADDED)
