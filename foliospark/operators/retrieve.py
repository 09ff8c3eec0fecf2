"""Passages for questions: chunks, nearest vectors, contexts, and answers by rule."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.dims import CHUNK, OVERLAP
from foliospark.functions.patterns import contains_any
from foliospark.settings import Settings, settings
from foliospark.ship import ship


def _window(docs: DataFrame, size: int | None, overlap: int | None) -> tuple[int, int]:
    """Length and overlap of chunks: what is given, else what the session sets."""
    own = settings(docs.sparkSession)
    window = Settings(chunk_size=own.chunk_size if size is None else size, chunk_overlap=own.chunk_overlap if overlap is None else overlap)
    return window.chunk_size, window.chunk_overlap


def chunks_fixed(docs: DataFrame, size: int | None = None, overlap: int | None = None) -> DataFrame:
    """(doc_id, chunk_id, chunk): windows of ``size`` characters, each beginning ``size - overlap`` after the last."""
    size, overlap = _window(docs, size, overlap)
    step = size - overlap
    starts = F.sequence(F.lit(1), F.greatest(F.char_length("text") - overlap, F.lit(1)), F.lit(step))
    whole = docs.where(F.char_length("text") > 0).select("doc_id", F.posexplode(F.transform(starts, lambda i: F.substr("text", i, F.lit(size)))).alias("chunk_id", "chunk"))
    return whole.where(F.col("chunk") != "")


def _pieces(text: str, a: int, b: int, separator: str) -> list[int]:
    """Where the pieces of text from a to b begin, and b: each separator begins a piece; without one, each character is one."""
    if not separator:
        return list(range(a, b + 1))
    edges, at = [a], text.find(separator, a, b)
    while at >= 0:
        if at > a:
            edges.append(at)
        at = text.find(separator, at + len(separator), b)
    return [*edges, b]


def _packed(edges: list[int], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Pieces that follow each other, as many as fit; the next run begins with up to ``overlap`` of the last."""
    first = 0
    for i, (start, end) in enumerate(pairwise(edges)):
        if i > first and end - edges[first] > size:
            yield edges[first], start
            while start > edges[first] and (start - edges[first] > overlap or end - edges[first] > size):
                first += 1
    yield edges[first], edges[-1]


def split_recursively(text: str, size: int = CHUNK, overlap: int = OVERLAP, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Pieces cut before the coarsest separator there is, packed up to ``size``; one of size or more is cut by finer ones.

    Separators stay with what follows them, so that pieces are stretches of the text; blanks at either end of
    a chunk go, and so do chunks of blanks.
    """
    spans: list[tuple[int, int]] = []
    todo = [(0, len(text), separators, False)]
    while todo:
        a, b, left, done = todo.pop()
        if done or a == b:
            spans.append((a, b))
            continue
        level = next(i for i, s in enumerate(left) if not s or text.find(s, a, b) >= 0)
        finer, edges, parts, held = left[level + 1 :], _pieces(text, a, b, left[level]), [], []
        for start, end in pairwise(edges):
            if end - start < size:
                held = held or [start]
                held.append(end)
                continue
            if held:
                parts += [(x, y, (), True) for x, y in _packed(held, size, overlap)]
                held = []
            parts.append((start, end, finer, not finer))
        if held:
            parts += [(x, y, (), True) for x, y in _packed(held, size, overlap)]
        todo += reversed(parts)
    return [chunk for a, b in spans if (chunk := text[a:b].strip())]


def chunks_recursive(docs: DataFrame, size: int | None = None, overlap: int | None = None) -> DataFrame:
    """(doc_id, chunk_id, chunk) by ``split_recursively``."""
    size, overlap = _window(docs, size, overlap)
    ship(docs.sparkSession)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pieces = [(d, i, c) for d, t in zip(batch["doc_id"], batch["text"], strict=True) for i, c in enumerate(split_recursively(t or "", size, overlap))]
            yield pd.DataFrame(pieces, columns=["doc_id", "chunk_id", "chunk"])

    return docs.select("doc_id", "text").mapInPandas(cut, "doc_id long, chunk_id int, chunk string")


#: Vectors and queries, about, that are compared at a time; scores of SLICE queries are held at once.
GROUP, TOGETHER, SLICE = 8192, 8192, 128
#: What matrix products may be off from a sum in order; all within it are scored anew.
_SLIP = 1e-9


def _vectors(column: pa.ChunkedArray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Lengths of vectors (-1: none), and by length the rows and the vectors as a matrix."""
    column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    found = []
    for n in np.unique(lengths[lengths >= 0]):
        rows = np.flatnonzero(lengths == n)
        found.append((rows, column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), n)))
    return lengths, found


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, summed from the first component to the last, so that equal vectors have equal scores wherever they lie."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


def _nearest(k: int):
    """The k of a group of vectors nearest to each of a group of queries: matrix products find those that may be, sums in order decide."""

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        # By id, so that places order ties.
        vectors = vectors.take(pc.sort_indices(vectors["vec_id"], null_placement="at_start"))
        n, out = vectors.num_rows, []
        lengths, by_length = _vectors(vectors["embedding"])
        of_length = {v.shape[1]: (rows, v, np.sqrt(_dots(v, v))) for rows, v in by_length}
        asked, groups = _vectors(queries["query"])
        # Without a vector, or one of no other's length: pairs without a score.
        nothing = (np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0))
        groups = [*groups, (np.flatnonzero(asked < 0), None)]
        for places, matrix in groups if n else []:
            rows, v, norms = of_length.get(matrix.shape[1], nothing) if matrix is not None else nothing
            for at in range(0, len(places), SLICE):
                part = places[at : at + SLICE]
                near = np.full((len(part), n), -np.inf)
                if len(rows):
                    q = matrix[at : at + SLICE]
                    own = np.sqrt(_dots(q, q))
                    over = norms[None, :] * own[:, None]
                    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                        score = q @ v.T / over
                    near[:, rows] = np.where(over == 0, -np.inf, np.where(np.isnan(score), np.inf, score))
                edge = np.partition(near, max(0, n - k), axis=1)[:, max(0, n - k)]
                i, j = np.nonzero(near >= (edge - _SLIP)[:, None])
                exact, known = np.zeros(len(i)), near[i, j] != -np.inf
                if known.any():
                    place = np.searchsorted(rows, j[known])
                    with np.errstate(invalid="ignore", over="ignore"):
                        exact[known] = _dots(q[i[known]], v[place]) / (norms[place] * own[i[known]])
                order = np.lexsort((j, -np.where(known, np.where(np.isnan(exact), np.inf, exact), -np.inf), i))
                i, j, exact, known = i[order], j[order], exact[order], known[order]
                keep = np.arange(len(i)) - np.searchsorted(i, i) < k
                out.append(pa.Table.from_arrays([queries["query_id"].take(pa.array(part[i[keep]])), vectors["vec_id"].take(pa.array(j[keep])), pa.array(exact[keep], mask=~known[keep])], names=["query_id", "vec_id", "score"]))
        none = pa.Table.from_arrays([queries["query_id"].slice(0, 0), vectors["vec_id"].slice(0, 0), pa.array([], pa.float64())], names=["query_id", "vec_id", "score"])
        return pa.concat_tables([none, *out])

    return run


def top_k(queries: DataFrame, vectors: DataFrame, k: int | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank): the k vectors (vec_id, embedding) of largest cosine for each of queries (query_id, query).

    Groups of vectors meet groups of queries, and each keeps k for a query. A pair has no score, and comes last, where a vector
    is null, zero, has a null component or another length.
    """
    spark = queries.sparkSession
    ship(spark)
    k = settings(spark).nearest if k is None else k
    whole = lambda c: F.when(~F.exists(c, lambda x: x.isNull()), F.col(c)).alias(c)
    rows, asked = vectors.select("vec_id", whole("embedding")), queries.select("query_id", whole("query"))
    blocks = max(1, -(-asked.count() // TOGETHER))
    # As many groups as the session shuffles to at least, so that few vectors are compared everywhere too.
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // GROUP))
    dealt = lambda frame, key, own, n, other, m: frame.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    by = ["_group", "_block"]
    kind = lambda frame, c: frame.schema[c].dataType.simpleString()
    met = dealt(rows, "vec_id", "_group", groups, "_block", blocks).groupBy(*by).cogroup(dealt(asked, "query_id", "_block", blocks, "_group", groups).groupBy(*by))
    scored = met.applyInArrow(_nearest(k), f"query_id {kind(asked, 'query_id')}, vec_id {kind(rows, 'vec_id')}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def context(found: DataFrame) -> DataFrame:
    """(query_id, context, sources): passages of (query_id, rank, chunk) in order, joined by blank lines; sources cut at 150."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("rank", "chunk"))), lambda x: x["chunk"])
    return found.groupBy("query_id").agg(F.array_join(ordered, "\n\n").alias("context"), F.transform(ordered, lambda c: F.substring(c, 1, 150)).alias("sources"))


# Words of a question and the fact that answers it, in order.
RULES = (
    (("total amount", "total", "how much", "grand total", "bill amount"), "total_amount"),
    (("invoice number", "invoice no"), "invoice_number"),
    (("order number", "order id", "order no"), "order_number"),
    (("date", "invoice date", "when"), "invoice_date"),
    (("seller", "sold by", "vendor", "company"), "seller_name"),
    (("gstin", "gst number", "gst no", "tax registration"), "seller_gst"),
    (("cgst", "central gst"), "cgst_amount"),
    (("sgst", "state gst"), "sgst_amount"),
    (("tax", "taxes"), "total_tax"),
    (("payment", "paid", "cod", "online"), "payment_method"),
    (("items", "products", "purchased", "bought", "what did"), "items"),
    (("address", "billing", "shipping"), "billing_address"),
)


def rule(question: Column) -> Column:
    """The field that answers the question, by the first rule one of whose words it contains; null if none."""
    lower = F.lower(question)
    any_of = lambda words: lower.rlike("|".join(re.escape(w) for w in words))
    return F.coalesce(*[F.when(any_of(words), F.lit(field)) for words, field in RULES])


def answer(question: Column, facts: dict[str, Column], passages: Column | None = None, model: Column | None = None) -> Column:
    """A model's answer, else the rule's fact, else up to 600 characters of the passages."""
    said = F.coalesce(*[F.when(rule(question) == f, F.coalesce(v.cast("string"), F.lit("N/A"))) for f, v in facts.items()])
    rest = [x for x in (model, said, F.substring(passages, 1, 600) if passages is not None else None) if x is not None]
    return F.coalesce(*rest)


# Words that a question must all have (each one of some), and the sentence that answers it, in order.
SENTENCES = (
    ((("total",), ("amount", "grand")), "The total amount is ₹{total_amount}."),
    ((("invoice",), ("number",)), "The invoice number is {invoice_number}."),
    ((("gstin",),), "The seller GSTIN is {seller_gst}."),
    ((("seller", "sold"),), "The seller is {seller_name}."),
    ((("tax",),), "Tax breakdown: CGST ₹{cgst_amount}, SGST ₹{sgst_amount}, IGST ₹{igst_amount}, Total Tax ₹{total_tax}."),
    ((("date",),), "The invoice date is {invoice_date}."),
    ((("payment",),), "Payment method: {payment_method}."),
)
KNOWN = "Here's what I know:\n• Platform: {platform}\n• Total: ₹{total_amount}\n• Date: {invoice_date}\n• Seller: {seller_name}\n\nAsk about specific fields like total, tax, GSTIN, seller, date, or payment."

# The same for the other form of asking, which tells a total and a seller by other words and says otherwise what is known.
PAGE_SENTENCES = (
    ((("total",), ("amount", "grand total")), "The total amount is ₹{total_amount}."),
    ((("invoice",), ("number",)), "The invoice number is {invoice_number}."),
    ((("gstin",),), "The seller GSTIN is {seller_gst}."),
    ((("seller", "sold by"),), "The seller is {seller_name}."),
    ((("tax",),), "Tax breakdown: CGST ₹{cgst_amount}, SGST ₹{sgst_amount}, IGST ₹{igst_amount}, Total Tax ₹{total_tax}."),
    ((("date",),), "The invoice date is {invoice_date}."),
    ((("payment",),), "Payment method: {payment_method}."),
)
PAGE_KNOWN = "Based on the extracted data, here's what I know:\n\n- Platform: {platform}\n- Total: ₹{total_amount}\n- Date: {invoice_date}\n- Seller: {seller_name}\n\nAsk me about specific fields like total, tax, GSTIN, seller, etc."


def sentence(question: Column, facts: dict[str, Column], sentences: tuple = SENTENCES, known: str = KNOWN, unknown: str = "not found") -> Column:
    """The first of sentences whose words the question has, with facts filled in; else known.

    Missing taxes are N/A, other facts "not found", and in what is known ``unknown``. A null question has the words of none.
    """
    lower = F.lower(question)

    def filled(template: str, missing: str) -> Column:
        parts = []
        for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
            parts.append(F.coalesce(facts[piece].cast("string"), F.lit(missing)) if i % 2 and piece in facts else F.lit(missing if i % 2 else piece))
        return F.concat(*parts)

    said = F.lit(None).cast("string")
    for words, template in reversed(sentences):
        fits = F.lit(True)
        for some in words:
            fits = fits & contains_any(lower, some)
        said = F.when(fits, filled(template, "N/A" if "Tax breakdown" in template else "not found")).otherwise(said)
    return F.coalesce(said, filled(known, unknown))


def facts_context(facts: dict[str, Column], text: Column, most: int = 1200) -> Column:
    """Lines "label: value" of the facts that are known, then the first characters of the text."""
    lines = [F.concat(F.lit(f"{name}: "), F.nullif(value.cast("string"), F.lit(""))) for name, value in facts.items()]
    return F.concat_ws("\n", *lines, F.substring(text, 1, most))
