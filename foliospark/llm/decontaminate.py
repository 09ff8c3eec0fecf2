"""Benchmark passages in documents, word substitutions included, by spaced seeds.

A seed is the hash of six words out of eight in a row, by fixed masks that ignore the other positions; test
and training seeds are joined by hash, and each hit is verified by lining up the words around it. A document
leaks an item if some WINDOW words in a row of it agree with the item but for at most SUBSTITUTIONS. The two
masks together hit every such window: whichever two words differ, one mask has a place that ignores them.

Shorter items must agree whole, with proportionally fewer substitutions, and get a mask of words in a row
that such agreement always contains; items under ``shortest`` words say little by themselves and leak only
into texts that have these words and no others (with shortest=1, into any text that has them in a row).

Words are runs of ASCII letters, digits and anything beyond ASCII, lower-cased; punctuation (of ASCII, Latin-1,
General Punctuation, CJK and full-width forms) never counts. In scripts without spaces (Chinese, Japanese, Thai, Lao) each character is a word.
A table of bits of fixed size tells documents' seeds that occur nowhere in the benchmark before anything is
joined. The benchmark's seeds are sent to every executor up to BROADCAST_SEEDS rows and joined by shuffle beyond.

Equal surroundings of a seed are verified once, however many items have them.

Defined results: null and empty texts hold nothing; a null doc_id or item_id is carried as it is; rows that
repeat an id give one row with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.kernel import ALNUM, U, Slice, mix, slices
from foliospark.llm.shared import Kept, id_type, sealed
from foliospark.ship import ship

WINDOW, SUBSTITUTIONS, SHORTEST = 13, 2, 5
#: Positions that count. Checked in the tests to hit every WINDOW with SUBSTITUTIONS.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
#: Words kept around a seed for verification: no window that holds a seed reaches further.
BEFORE, AFTER = 10, 12
BROADCAST_SEEDS = 200_000
#: Beyond it, seeds are joined in so many parts each.
SALTS = 16


def short_mask(n: int) -> tuple[int, ...]:
    """For an item of n < WINDOW words: as many in a row as always stay whole."""
    allowed = n * SUBSTITUTIONS // WINDOW
    return tuple(range(-(-(n - allowed) // (allowed + 1))))


def seeds(words: np.ndarray, text: np.ndarray, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of the mask at every place within one text."""
    n = len(words) - mask[-1]
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    at = np.flatnonzero(text[:n] == text[mask[-1] :])
    out = np.full(n, sum(1 << i for i in mask), U)
    for i in mask:
        out = out * U(0x9FB21C651E98DF25) + words[i : i + n]
    return mix(out[at]), at


def _plain(s: Slice) -> Slice:
    """The slice with blanks for punctuation beyond ASCII."""
    a = s.data
    if len(a) < 2 or not (a >= 0xC2).any():
        return s
    b, c = np.append(a[1:], [0]), np.append(a[2:], [0, 0])
    two = (a == 0xC2) & ~np.isin(b, (0xAA, 0xB5, 0xBA))
    full_width = (b == 0xBC) & ((c <= 0x8F) | ((c >= 0x9A) & (c <= 0xA0)) | (c >= 0xBB)) | (b == 0xBD) & ((c == 0x80) | ((c >= 0x9B) & (c <= 0xA5)))
    three = (a == 0xE2) & ((b == 0x80) | (b == 0x81)) | (a == 0xE3) & (b == 0x80) & (c != 0x85) & (c != 0x87) | (a == 0xEF) & full_width
    blank = two | three
    blank[1:] |= blank[:-1].copy()
    blank[2:] |= three[:-2]
    return Slice(s.first, np.where(blank, np.uint8(32), a), s.offsets)


def _words(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    s = _plain(s)
    start, end, text = s.words(ALNUM)
    lead = s.data[:-2]
    alone = np.flatnonzero(((lead >= 0xE3) & (lead <= 0xE9)) | ((lead == 0xE0) & (s.data[1:-1] >= 0xB8) & (s.data[1:-1] <= 0xBB))) if len(s.data) > 2 else lead
    if len(alone):
        cut = np.union1d(alone, alone + 3)
        cut = cut[cut < len(s.data)]
        word = np.searchsorted(start, cut, "right") - 1
        cut = cut[(word >= 0) & (cut > start[word]) & (cut < end[word])]
        start, end = np.union1d(start, cut), np.union1d(end, cut)
        text = np.searchsorted(s.offsets, start, "right") - 1
    words = s.hashes(s.sums(latin=True), start, end)
    return words, text, (words >> U(32)).astype(np.uint32) | np.uint32(1)


def _around(short: np.ndarray, text: np.ndarray, at: np.ndarray) -> pa.Array:
    """The 32-bit hashes of BEFORE words before each place to AFTER after it; 0 outside the text."""
    place = at[:, None] + np.arange(-BEFORE, AFTER + 1)
    inside = (place >= 0) & (place < len(short))
    place = np.clip(place, 0, max(0, len(short) - 1))
    inside &= text[place] == text[at][:, None]
    return pa.array([row.tobytes() for row in np.where(inside, short[place], 0).astype(np.uint32)], pa.binary())


def _item_seeds(shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("item_id")
            for s in slices(batch.column("text")):
                words, text, short = _words(s)
                bounds = s.bounds(text)
                for i in range(len(s)):
                    a, b = bounds[i], bounds[i + 1]
                    # An item that says little leaks into texts that are nothing else: width 0.
                    whole = bool(b - a < min(shortest, BEFORE))
                    for mask in () if a == b else MASKS if b - a >= WINDOW else (short_mask(int(b - a)),):
                        seed, at = seeds(words[a:b], text[a:b], mask)
                        n, width = len(seed), 0 if whole else min(int(b - a), WINDOW)
                        of = ids.take(pa.array([s.first + i] * n, pa.int64()))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(seed.view(np.int64)), of, pa.array([width] * n, pa.int32()), _around(short[a:b], text[a:b], at), pa.array([",".join(map(str, mask))] * n)],
                            names=["seed", "item_id", "width", "item_words", "mask"],
                        )

    return run


def _document_seeds(masks: dict[tuple[int, ...], bool], bits: int, table):
    """masks: each with whether only texts that have no other words are of interest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value
        for batch in batches:
            ids, versions = batch.column("doc_id"), batch.column("version")
            for s in slices(batch.column("text")):
                words, text, short = _words(s)
                n_words = np.diff(s.bounds(text))
                for mask, whole in masks.items():
                    seed, at = seeds(words, text, mask)
                    slot = (seed >> U(64 - bits)).astype(np.int64)
                    hit = np.flatnonzero(known[slot >> 6] >> (slot & 63).astype(U) & U(1))
                    if whole:
                        hit = hit[n_words[text[at[hit]]] == len(mask)]
                    for part in np.array_split(hit, -(-len(hit) // 20_000)) if len(hit) else ():
                        rows = pa.array(text[at[part]] + s.first)
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(rows), versions.take(rows), pa.array(seed[part].view(np.int64)), _around(short, text, at[part])], names=["doc_id", "version", "seed", "doc_words"]
                        )

    return run


def agreement(a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """The most words that agree in width in a row within both texts, per row of words of document and item; 0: no such row."""
    sums = lambda x: np.concatenate((np.zeros((len(x), 1), np.int64), np.cumsum(x, axis=1)), axis=1)
    inside = (a != 0) & (b != 0)
    same, inside = sums((a == b) & inside), sums(inside)
    whole = inside[:, width:] - inside[:, :-width] == width
    return np.where(whole, same[:, width:] - same[:, :-width], 0).max(axis=1)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        table = lambda c: np.stack([np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column(c)])  # noqa: B023, E731
        a, b, width = table("doc_words"), table("item_words"), batch.column("width").to_numpy()
        matched = np.zeros(batch.num_rows, np.int32)
        for w in np.unique(width):
            at = np.flatnonzero(width == w)
            # Width 0: all words around are the same, and none are beyond.
            matched[at] = agreement(a[at], b[at], int(w)) if w else np.where((a[at] == b[at]).all(axis=1), (b[at] != 0).sum(axis=1), -1)
        keep = pa.array(np.flatnonzero(matched >= width - width * SUBSTITUTIONS // WINDOW))
        if len(keep):
            found = [batch.column(c).take(keep) for c in ("doc_id", "version", "context")]
            window = np.where(width, width, matched)
            yield pa.RecordBatch.from_arrays([*found, pa.array(matched).take(keep), pa.array(window.astype(np.int32)).take(keep)], names=["doc_id", "version", "context", "matched_words", "window"])


def _item_side(benchmark: DataFrame, shortest: int) -> tuple[DataFrame, DataFrame]:
    """Distinct (seed, width, item_words, context, mask), however many items have them; (context, item_id)."""
    benchmark, _ = sealed(benchmark, ("item_id", "text"))
    schema = f"seed long, item_id {id_type(benchmark, 'item_id')}, width int, item_words binary, mask string"
    found = Kept(benchmark.select("item_id", "text").mapInArrow(_item_seeds(shortest), schema), "item-seeds").frame
    found = found.withColumn("context", F.xxhash64("seed", "width", "item_words"))
    return found.drop("item_id").distinct(), found.select("context", "item_id").distinct()


def hits(docs: DataFrame, benchmark: DataFrame, shortest: int = SHORTEST) -> tuple[DataFrame, DataFrame]:
    """(doc_id, version, context, matched_words, window) of seeds that were verified, and (context, item_id).

    version is xxhash64 of the text, which tells rows of one doc_id apart.
    """
    spark = docs.sparkSession
    ship(spark)
    docs, _ = sealed(docs, ("doc_id", "text"))
    contexts, members = _item_side(benchmark, shortest)
    contexts = Kept(contexts, "contexts").frame
    used = contexts.groupBy("mask").agg(F.max("width").alias("width")).orderBy("mask").collect()
    masks = {tuple(map(int, r["mask"].split(","))): r["width"] == 0 for r in used}
    n = contexts.count()
    bits = int(np.clip(n.bit_length() + 6, 16, 27))
    slot = F.shiftrightunsigned("seed", 64 - bits)
    # At most 2 ** (bits - 6) rows.
    rows = contexts.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))).alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    kind = id_type(docs)
    seen = docs.select("doc_id", F.xxhash64("text").alias("version"), "text")
    found = seen.mapInArrow(_document_seeds(masks, bits, spark.sparkContext.broadcast(table.view(U))), f"doc_id {kind}, version long, seed long, doc_words binary")
    sides, by = contexts.drop("mask"), ["seed"]
    if n <= BROADCAST_SEEDS:
        sides = F.broadcast(sides)
    else:  # A passage that very many documents hold is dealt out by salt.
        sides, by = sides.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["seed", "salt"]
        found = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "version"), F.lit(SALTS)).cast("int"))
    pairs = found.join(sides, by).select("doc_id", "version", "context", "width", "doc_words", "item_words")
    # Kept in between, so that a task never needs two Python workers at once.
    pairs = Kept(pairs, "pairs")
    verified = Kept(pairs.frame.mapInArrow(_verify, f"doc_id {kind}, version long, context long, matched_words int, window int"), "verified").frame
    pairs.drop()
    return verified, members


def leaks(docs: DataFrame, benchmark: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, item_id, matched_words, window, hits): each pair of a document and an item that it holds.

    matched_words: the most that agree among ``window`` words in a row; hits: seeds that were verified.
    """
    verified, members = hits(docs, benchmark, shortest)
    best = F.max("matched_words").alias("matched_words"), F.max("window").alias("window"), F.count("*").alias("hits")
    return verified.join(members, "context").groupBy("doc_id", "item_id").agg(*best)


def drop_leaking(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = 100_000, shortest: int = SHORTEST) -> DataFrame:
    """docs without the rows that hold an item; columns as they came. Rows that share a doc_id, or have none, are told apart by their texts."""
    docs, back = sealed(docs, ("doc_id", "text"))
    found, _ = hits(docs, benchmark, shortest)
    gone = Kept(found.select(F.col("doc_id").alias("leaking"), "version").distinct(), "leaking").frame
    side = F.broadcast(gone) if gone.limit(broadcast_rows + 1).count() <= broadcast_rows else gone.hint("merge")
    same = F.col("doc_id").eqNullSafe(F.col("leaking")) & (F.xxhash64("text") == F.col("version"))
    return docs.join(side, same, "left_anti").select(*back.values())
