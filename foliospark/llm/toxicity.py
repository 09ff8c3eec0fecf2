"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, learned from document labels.

A sentence ends at . ! ? or a line end, or after 40 words. Its score is a logistic function of the hashed words
and word beginnings that it has, however often; a document is toxic unless none of its sentences is: p = 1 - product(1 - p_s). Weights
are fitted on the driver from a bounded sample of labelled documents (MOST_DOCS, SAMPLE_BYTES); scoring is one pass over
all texts, and returns the sentences that offend.

Defined results: null and empty texts have no sentence and score 0; labels that contradict each other are
averaged; without labels of both kinds everything scores 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.kernel import ALNUM, U, Slice, mix, slices
from foliospark.llm.shared import id_type, sampled_labels, sealed
from foliospark.ship import ship

#: Bound of the training sample, half of it for either label (and SAMPLE_BYTES of text in all).
MOST_DOCS = 4000
BITS, WORDS = 18, 40
#: Beginnings of words, in bytes.
STEMS = (4, 5, 6, 7, 8)
THRESHOLD = 0.5

_END = np.zeros(256, bool)
_END[[10, 33, 46, 63]] = True


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def sentences(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (start, end), sentence of each word, first word of each sentence, text of each sentence."""
    start, end, text = s.words(ALNUM)
    if not len(start):
        return start, end, start, start, start
    ends = np.concatenate(([0], np.cumsum(_END[s.data])))
    new = np.ones(len(start), bool)
    new[1:] = (ends[start[1:]] > ends[end[:-1]]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    since = np.arange(len(start)) - np.repeat(first, np.diff(np.append(first, len(start))))
    new |= since % WORDS == 0
    first = np.flatnonzero(new)
    return start, end, np.cumsum(new) - 1, first, text[first]


def features(s: Slice, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, bucket of each): whole words, then the beginnings of those that are longer."""
    sums = s.sums(latin=True)
    yield np.arange(len(start)), (s.hashes(sums, start, end) >> U(64 - BITS)).astype(np.int64)
    for n in STEMS:
        at = np.flatnonzero(end - start > n)
        yield at, (mix(s.hashes(sums, start[at], start[at] + n) + U(n)) >> U(64 - BITS)).astype(np.int64)


def fit(texts: pa.Array, y: np.ndarray, weight: np.ndarray, steps: int = 150, rate: float = 0.08, lasso: float = 1.5) -> Model | None:
    """Noisy-or likelihood by Adam with a lasso; a feature needs three documents to count."""
    if len(set(y.tolist())) < 2:
        return None
    pairs, seen, docs_of, n_sentences = [], np.zeros(1 << BITS, np.int32), [], 0
    for s in slices(texts):
        start, end, sentence, _, text = sentences(s)
        keys = []
        for words, bucket in features(s, start, end):
            keys.append(sentence[words] << BITS | bucket)
        keys = np.unique(np.concatenate(keys))
        buckets = keys & ((1 << BITS) - 1)
        seen += np.bincount(np.unique(text[keys >> BITS] << BITS | buckets) & ((1 << BITS) - 1), minlength=1 << BITS).astype(np.int32)
        pairs.append(((keys >> BITS).astype(np.int32) + n_sentences, buckets.astype(np.int32)))
        docs_of.append(text + s.first)
        n_sentences += len(text)
    common = seen >= 3
    of = np.concatenate([a[common[b]] for a, b in pairs])
    names = np.flatnonzero(common)
    column = np.concatenate([np.searchsorted(names, b[common[b]]) for _, b in pairs]).astype(np.int32)
    doc = np.concatenate(docs_of)
    del pairs, docs_of
    # Pairs lie by sentence; sums over either side run through them in order.
    sentence_at = np.flatnonzero(np.diff(of, prepend=-1))
    by_name = np.argsort(column, kind="stable")
    of_name, name_at = of[by_name], np.searchsorted(column[by_name], np.arange(len(names)))
    total = weight.sum()
    share = float((weight * y).sum() / total)
    w, bias = np.zeros(len(names)), float(np.log(share * len(y) / max(n_sentences, 1)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.full(n_sentences, bias)
        if len(of):
            z[of[sentence_at]] += np.add.reduceat(w[column], sentence_at)
        p = np.clip(1 / (1 + np.exp(-np.clip(z, -30, 30))), 1e-12, 1 - 1e-9)
        none = np.bincount(doc, np.log1p(-p), minlength=len(y))
        pull = np.where(y == 1, -np.exp(none) / np.maximum(1 - np.exp(none), 1e-6), 1.0) * weight / total
        g = pull[doc] * p
        gw, gb = np.add.reduceat(g[of_name], name_at) if len(of) else w, float(g.sum())
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        scale = np.sqrt(v / (1 - 0.99**t)) + 1e-6
        step = rate / scale
        w -= step * m / (1 - 0.9**t)
        w = np.sign(w) * np.maximum(np.abs(w) - step * lasso / len(y), 0)
        bias -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-6)
    weights = np.zeros(1 << BITS, np.float32)
    weights[names] = w
    return Model(weights, bias)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", held_out: int = 0, folds: int = 5, most: int = MOST_DOCS) -> Model | None:
    sample = sampled_labels(docs, labels, label, most, held_out, folds)
    if not sample.num_rows:
        return None
    return fit(sample.column("text").combine_chunks(), sample.column("y").to_numpy(), sample.column("weight").to_numpy())


def score_slice(s: Slice, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Score of each text; then text, start byte, end byte and score of each sentence."""
    start, end, sentence, first, text = sentences(s)
    if not len(start):
        return np.zeros(len(s)), text, start, end, np.zeros(0)
    # Whether a sentence has a feature counts, not how often; so it was fitted.
    keys = []
    for words, bucket in features(s, start, end):
        counts = np.flatnonzero(model.weights[bucket])
        keys.append(sentence[words[counts]] << BITS | bucket[counts])
    keys = np.unique(np.concatenate(keys))
    z = model.bias + np.bincount(keys >> BITS, model.weights[keys & ((1 << BITS) - 1)], minlength=len(text))
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    none = np.bincount(text, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(s))
    last = np.append(first[1:], len(start)) - 1
    return 1 - np.exp(none), text, start[first], end[last], p


_SPANS = "array<struct<start:int,end:int,score:double>>"
_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def _score(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for s in slices(batch.column("text")) if model else ():
                own, text, a, b, p = score_slice(s, model)
                scores[s.first : s.first + len(s)] = own
                if len(hit := np.flatnonzero(p >= THRESHOLD)):
                    points = np.concatenate(([0], np.cumsum((s.data & 0xC0) != 0x80)))
                    base = points[s.offsets[text[hit]]]
                    for i, x, y, q in zip(text[hit].tolist(), (points[a[hit]] - base).tolist(), (points[b[hit]] - base).tolist(), p[hit].tolist(), strict=True):
                        spans[s.first + i].append({"start": x, "end": y, "score": q})
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(np.clip(scores, 0, 1)), pa.array(spans, _TYPE)], names=["doc_id", "held_out", "score", "offending"])

    return run


def score(docs: DataFrame, model: Model | None, held_out: Column) -> DataFrame:
    """(doc_id, held_out, score, offending) of docs (doc_id, text); offending: sentences of THRESHOLD or more, in code points."""
    ship(docs.sparkSession)
    docs, _ = sealed(docs, ("doc_id", "text"))
    return docs.select("doc_id", "text", held_out.alias("held_out")).mapInArrow(_score(model), f"doc_id {id_type(docs)}, held_out boolean, score double, offending {_SPANS}")


def drop_toxic(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score threshold or more; columns as they came."""
    ship(docs.sparkSession)
    docs, back = sealed(docs, ("text",))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for s in slices(batch.column("text")) if model else ():
                scores[s.first : s.first + len(s)] = score_slice(s, model)[0]
            yield batch.filter(pa.array(scores < threshold))

    return docs.mapInArrow(run, docs.schema).select(*back.values())


def predicted(threshold: float = THRESHOLD) -> Column:
    return (F.col("score") >= threshold).cast("int").alias("predicted")
