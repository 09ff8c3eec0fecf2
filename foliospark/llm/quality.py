"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Each passage is encoded: shares of pairs of neighbouring
character classes, word statistics, hashed words, and how much of it repeats elsewhere in the document. A small net
maps it to a hidden vector, gated attention weighs the passages (softmax of w . (tanh(V h) * sigmoid(U h))),
and the weighted sum is classified. All of it is learned from document labels, on the driver, from a bounded
sample of labelled documents (MOST_DOCS, SAMPLE_BYTES); scoring is one pass over all texts.

Defined results: null and empty texts have one passage without words and are scored like any other;
labels that contradict each other are averaged; without labels of both kinds everything scores the share
of the label there is (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.kernel import DARK, U, Slice, mix, slices, windows
from foliospark.llm.shared import id_type, sampled_labels, sealed
from foliospark.ship import ship

#: Bound of the training sample, half of it for either label (and SAMPLE_BYTES of text in all).
MOST_DOCS = 4000
WORDS, BUCKETS = 64, 64
THRESHOLD = 0.3

#: Character classes: blank, line end, lower, upper, digit, full stop, comma, ! or ?, symbol, other punctuation, first and further bytes beyond ASCII.
_CLASS = np.full(256, 9, np.int64)
_CLASS[[32, 9, 11, 12, 13]] = 0
_CLASS[10] = 1
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 2, 3, 4
_CLASS[46], _CLASS[44] = 5, 6
_CLASS[[33, 63]] = 7
_CLASS[[ord(c) for c in "#$%&*@^~|<>{}\\_=+"]] = 8
_CLASS[0xC0:], _CLASS[0x80:0xC0] = 10, 11
CLASSES = 12
WIDTH = CLASSES * CLASSES + BUCKETS + 10


def encode(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Features of each passage and the text of each passage; a text without words has one passage of zeros."""
    start, end, text = s.words(DARK)
    by_text = s.bounds(text)
    n_words = np.diff(by_text)
    per_text = np.maximum(1, -(-n_words // WORDS))
    first_passage = np.concatenate(([0], np.cumsum(per_text)))
    owner = np.repeat(np.arange(len(s)), per_text)
    out = np.zeros((len(owner), WIDTH), np.float32)
    if not len(start):
        return out, owner
    passage = first_passage[text] + (np.arange(len(start)) - by_text[text]) // WORDS
    n, count = len(owner), np.bincount(passage, minlength=len(owner))
    some = np.maximum(count, 1)

    # Pairs of classes; a byte belongs to the passage of the last word that starts at or before it.
    of_byte = np.repeat(np.concatenate(([passage[0]], passage)), np.diff(np.concatenate(([0], start, [len(s.data)]))))
    c = _CLASS[s.data]
    pairs = np.bincount(of_byte[:-1] * (CLASSES * CLASSES) + c[:-1] * CLASSES + c[1:], minlength=n * CLASSES * CLASSES).reshape(n, -1)
    out[:, : CLASSES * CLASSES] = np.sqrt(pairs / np.maximum(pairs.sum(axis=1, keepdims=True), 1))

    sums = s.sums(latin=True)
    words = s.hashes(sums, start, end)
    at = CLASSES * CLASSES
    bag = np.bincount(passage * BUCKETS + (words >> U(58)).astype(np.int64), minlength=n * BUCKETS).reshape(n, BUCKETS)
    out[:, at : at + BUCKETS] = np.sqrt(bag / some[:, None])

    length = (end - start).astype(float)
    mean = np.bincount(passage, length, minlength=n) / some
    spread = np.sqrt(np.maximum(np.bincount(passage, length**2, minlength=n) / some - mean**2, 0))
    same = np.zeros(len(words))
    same[1:] = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
    key = np.sort(mix(passage.astype(U) * U(0x9E3779B97F4A7C15) + words) & ~U(0xFFFFF) | (passage % (1 << 20)).astype(U))
    distinct = np.bincount((key[np.concatenate(([True], key[1:] != key[:-1]))] & U(0xFFFFF)).astype(np.int64), minlength=n)
    grams, where = windows(words, text, 3)
    _, inverse, times = np.unique(grams + text[where].astype(U) * U(0xD1342543DE82EF95), return_inverse=True, return_counts=True)
    again = np.bincount(passage[where], times[inverse] > 1, minlength=n) / some
    line_ends = np.bincount(of_byte, c == 1, minlength=n) / some
    extra = [
        np.log1p(count) / 4, mean / 10, spread / 10, np.bincount(passage, same, minlength=n) / some, distinct[:n] / some, again,
        np.log1p(n_words[owner]) / 8, line_ends, (count < WORDS) * 1.0, (np.bincount(passage, length > 20, minlength=n) / some),
    ]
    out[:, at + BUCKETS :] = np.stack(extra, axis=1)
    return out, owner


@dataclass
class Model:
    """Standardisation, hidden layer, the two halves of the gate, attention, classifier."""

    mean: np.ndarray
    scale: np.ndarray
    net: dict[str, np.ndarray]
    prior: float = 0.5


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(net: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray, owner: np.ndarray) -> dict[str, np.ndarray]:
    """owner: bag of each row, in order; first: first row of each bag."""
    h = np.tanh(x @ net["E"] + net["e"])
    t, g = np.tanh(h @ net["V"]), _sigmoid(h @ net["U"])
    a = (t * g) @ net["w"]
    a = np.exp(a - np.maximum.reduceat(a, first)[owner])
    a /= np.add.reduceat(a, first)[owner]
    z = np.add.reduceat(a[:, None] * h, first)
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": _sigmoid(z @ net["c"] + net["b"])}


def fit(texts: pa.Array, y: np.ndarray, weight: np.ndarray, hidden: int = 32, gate: int = 16, epochs: int = 60, batch: int = 128, rate: float = 3e-3, decay: float = 1e-3) -> Model:
    """Cross-entropy by Adam over shuffled batches of documents; seeded."""
    x, owner = [], []
    for s in slices(texts):
        features, own = encode(s)
        x.append(features), owner.append(own + s.first)
    x, owner = np.concatenate(x), np.concatenate(owner)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 0.02
    x = ((x - mean) / scale).clip(-8, 8)
    rng = np.random.default_rng(7)
    shape = {"E": (x.shape[1], hidden), "e": (hidden,), "V": (hidden, gate), "U": (hidden, gate), "w": (gate,), "c": (hidden,), "b": ()}
    net = {k: np.asarray(rng.normal(size=v) / np.sqrt(v[0] if v else 1), np.float32) * (len(v) > 0) for k, v in shape.items()}
    net["e"] *= 0
    share = float((weight * y).sum() / weight.sum())
    net["b"] = np.float32(np.log(share / (1 - share)))
    m, v = ({k: np.zeros_like(p) for k, p in net.items()} for _ in range(2))
    starts = np.searchsorted(owner, np.arange(len(y) + 1))
    t = 0
    for epoch in range(epochs):
        now = rate * (1 - epoch / epochs)
        for docs in np.array_split(order := rng.permutation(len(y)), max(1, len(order) // batch)):
            lengths = starts[docs + 1] - starts[docs]
            first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            rows = np.repeat(starts[docs] - first, lengths) + np.arange(lengths.sum())
            bag = np.repeat(np.arange(len(docs)), lengths)
            xb = x[rows]
            f = _forward(net, xb, first, bag)
            err = ((f["p"] - y[docs]) * weight[docs] / weight[docs].mean() / len(docs)).astype(np.float32)
            dz = err[:, None] * net["c"]
            da = (dz[bag] * f["h"]).sum(axis=1)
            da = f["a"] * (da - np.add.reduceat(f["a"] * da, first)[bag])
            dt, dg = da[:, None] * net["w"] * f["g"] * (1 - f["t"] ** 2), da[:, None] * net["w"] * f["t"] * f["g"] * (1 - f["g"])
            dh = (f["a"][:, None] * dz[bag] + dt @ net["V"].T + dg @ net["U"].T) * (1 - f["h"] ** 2)
            grad = {"E": xb.T @ dh, "e": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ da, "c": f["z"].T @ err, "b": err.sum()}
            t += 1
            for k, g in grad.items():
                g = g + decay * net[k] * (k in "EVUc")
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                net[k] = net[k] - np.asarray(now * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8), np.float32)
    return Model(mean, scale, net, share)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", held_out: int = 0, folds: int = 5, most: int = MOST_DOCS) -> Model | float:
    """A model, or the share of label 1 where there is but one label."""
    sample = sampled_labels(docs, labels, label, most, held_out, folds)
    y = sample.column("y").to_numpy().astype(np.float32)
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    return fit(sample.column("text").combine_chunks(), y, sample.column("weight").to_numpy().astype(np.float32))


def score_slice(s: Slice, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Score of each text, and the largest attention weight of its passages."""
    x, owner = encode(s)
    first = np.searchsorted(owner, np.arange(len(s)))
    f = _forward(model.net, ((x - model.mean) / model.scale).clip(-8, 8).astype(np.float32), first, owner)
    return f["p"].astype(float), np.maximum.reduceat(f["a"], first).astype(float)


def _score(model: Model | float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.full(batch.num_rows, 0.0 if isinstance(model, Model) else model)
            most = np.zeros(batch.num_rows)
            for s in slices(batch.column("text")) if isinstance(model, Model) else ():
                here = slice(s.first, s.first + len(s))
                scores[here], most[here] = score_slice(s, model)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array(most)], names=["doc_id", "held_out", "score", "top_attention"])

    return run


def score(docs: DataFrame, model: Model | float, held_out: Column) -> DataFrame:
    """(doc_id, held_out, score, top_attention) of docs (doc_id, text)."""
    ship(docs.sparkSession)
    docs, _ = sealed(docs, ("doc_id", "text"))
    return docs.select("doc_id", "text", held_out.alias("held_out")).mapInArrow(_score(model), f"doc_id {id_type(docs)}, held_out boolean, score double, top_attention double")


def predicted(threshold: float = THRESHOLD) -> Column:
    return (F.col("score") >= threshold).cast("int").alias("predicted")
