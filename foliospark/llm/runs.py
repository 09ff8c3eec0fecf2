"""Periodic runs: stretches of words that repeat with a period, found exactly, and texts with the repeats cut.

A run is a stretch of words with smallest period q and at least MIN_EXPONENT * q (and MIN_WORDS) words that no
neighbouring word extends with the same period.

Texts of a batch are laid end to end as numbers of words, each text with numbers of its own, so nothing matches
across texts. Doubling sorts the suffixes and leaves, for every power of two, the number of the words from each
place on, by which two places are compared forwards and backwards in a step for each power. Suffix array and common
prefixes of its neighbours give each place's longest previous factor and where that lies; the factors cut a
text into blocks. A run that touches the start or the end of a block is found by extending periods on both sides of the
boundary as far as words agree; periods are bounded there by the lengths of the two blocks, so all boundaries
together have no more of them than the text has words. A run strictly inside of a block is a copy of a run in the
block's source, and is copied from the bucket of that start, from left to right.

Defined results: words are runs of anything but the six ASCII blanks; a null or empty text has no words and no
runs, and collapses to an empty text; rows are treated on their own, so null, equal or repeated ids do no harm;
other columns are carried along. Texts are taken whole. Memory in a task is bounded by BATCH_WORDS or one longer text.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.shared import sealed
from foliospark.ship import ship

MIN_EXPONENT, MIN_WORDS = 4, 6
#: Words that are sorted together, and periods that are extended together.
BATCH_WORDS, PERIODS = 1 << 17, 1 << 20


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word, equal for equal words of one text and for no others; where each text starts, and the end."""
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    ids = np.zeros(bounds[-1], np.int64)
    for words, a, b in zip(texts, bounds.tolist(), bounds[1:].tolist(), strict=False):
        ids[a:b] = np.fromiter(map({}.setdefault, words, range(a, b)), np.int64, b - a)
    return ids, bounds


class Suffixes:
    """levels[k][i] tells apart what 2 ** k words from i on are; ``rank`` is the place of each suffix in the suffix array.

    Each level has one more element than there are words, which is like no other. Only places whose words occur
    again are sorted anew for the next level. ``repeated`` are the places whose two words occur again, in order of suffixes.
    """

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        counts = np.bincount(ids, minlength=n + 1)
        rank = np.append((np.cumsum(counts) - counts)[ids], -1).astype(np.int32)
        self.levels, active, step = [rank], np.flatnonzero(counts[ids] > 1), 1
        self.repeated = np.zeros(0, np.int64)
        while len(active):
            before = rank[active].astype(np.int64)
            key = before * (n + 1) + rank[np.minimum(active + step, n)] + 1
            order = np.argsort(key)
            active, before, key = active[order], before[order], key[order]
            place = np.arange(len(active))
            first, was_first = np.ones(len(active), bool), np.ones(len(active), bool)
            first[1:], was_first[1:] = key[1:] != key[:-1], before[1:] != before[:-1]
            start = lambda flags: np.maximum.accumulate(np.where(flags, place, 0))  # noqa: B023, E731
            rank = rank.copy()
            rank[active] = before + start(first) - start(was_first)
            active = active[~(first & np.append(first[1:], True))]
            if len(active):
                self.levels.append(rank)
            if step == 1:
                self.repeated = active
            step *= 2
        self.rank = rank
        self.repeated = self.repeated[np.argsort(rank[self.repeated])]

    def ahead(self, i: np.ndarray, j: np.ndarray, levels: int | None = None) -> np.ndarray:
        """How many words from i and from j on (i != j) agree; with ``levels``, where these many are known to be enough."""
        n = np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.levels) if levels is None else levels)):
            level = self.levels[k]
            n += (level[i + n] == level[j + n]).astype(np.int64) << k
        return n

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words up to i and up to j (i < j) agree, both included; i may be -1."""
        n = np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.levels))):
            level, a, b = self.levels[k], i - n - (1 << k) + 1, j - n - (1 << k) + 1
            n += ((a >= 0) & (level[np.maximum(a, -1)] == level[b])).astype(np.int64) << k
        return n

    def neighbours(self) -> np.ndarray:
        """Common prefix of each of ``repeated`` and the one before it, where it has two words at least; else 0."""
        i, j = self.repeated[:-1], self.repeated[1:]
        out = np.zeros(len(self.repeated) + 1, np.int64)
        left = np.arange(len(i))
        for k in range(1, len(self.levels) + 1):
            same = self.levels[k][i[left]] == self.levels[k][j[left]] if k < len(self.levels) else np.zeros(len(left), bool)
            done = left[~same]
            if k > 1 and len(done):  # equal in 2 ** (k - 1) words, not in 2 ** k
                known = 1 << (k - 1)
                out[done + 1] = known + self.ahead(i[done] + known, j[done] + known, k - 1)
            left = left[same]
        return out


def previous_factors(s: Suffixes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(length, place) of the longest factor that starts before each place and is found there too; shorter than two words: 0.

    Suffixes leave the array from the last place of the text to the first: what is then next to a suffix lies before it.
    """
    length, source = np.zeros(n, np.int64), np.zeros(n, np.int64)
    m = len(s.repeated)
    if not m:
        return length, source
    common, before, after = s.neighbours().tolist(), list(range(-1, m)), list(range(1, m + 2))
    found, at = [0] * m, [0] * m
    for t in np.argsort(s.repeated)[::-1].tolist():
        p, q = before[t], after[t]
        up, down = common[t], common[q]
        if up >= down:
            found[t], at[t], common[q] = up, p, down
        else:
            found[t], at[t], common[q] = down, q, up
        after[p], before[q] = q, p
    length[s.repeated] = found
    source[s.repeated] = s.repeated[np.clip(at, 0, m - 1)]
    return length, source


def blocks(length: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Starts of the blocks that each text falls into: a previous factor, or one word."""
    step, starts = np.maximum(length, 1).tolist(), []
    for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
        while a < b:
            starts.append(a)
            a += step[a]
    return np.array(starts, np.int64)


def at_boundaries(s: Suffixes, starts: np.ndarray, bounds: np.ndarray, exponent: int, least: int) -> dict[tuple[int, int], int]:
    """{(start, end): period} of the runs that touch a boundary of blocks.

    Take the last block k that such a run, of period q, reaches beyond the start of, b, or whose start it ends at. No
    match over q can begin before the block before b and reach over it, else that block were longer; so
    (exponent - 1) * q is less than the two blocks together, and less than block k if a period from the run's
    start reaches beyond b.
    """
    n = bounds[-1]
    ends = bounds[1:][np.diff(bounds) > 0]
    size = np.diff(np.append(starts, n))
    edge = np.concatenate((starts, ends))
    here = np.concatenate((size, np.zeros(len(ends), np.int64)))
    is_first = np.isin(starts, bounds[:-1])
    lead = np.concatenate((np.where(is_first, 0, np.concatenate(([0], size[:-1]))), size[np.searchsorted(starts, ends) - 1]))
    # Periods are laid out before the boundary (from edge - p) and after it (from edge).
    left = np.maximum(0, here + lead - 1) // (exponent - 1)
    left = np.minimum(left, edge - bounds[np.searchsorted(bounds, edge, "left") - (edge > 0)])
    right = np.maximum(0, here - 1) // (exponent - 1)
    found: dict[tuple[int, int], int] = {}
    for before, most in ((True, left), (False, right)):
        some = np.flatnonzero(most > 0)
        total = np.concatenate(([0], np.cumsum(most[some])))
        for lo in range(0, int(total[-1]), PERIODS):
            flat = np.arange(lo, min(lo + PERIODS, int(total[-1])))
            of = np.searchsorted(total, flat, "right") - 1
            p = flat - total[of] + 1
            i = edge[some[of]] - (p if before else 0)
            j, words = i + p, s.levels[0]
            near = np.flatnonzero((words[i] == words[j]) | (words[i - 1] == words[j - 1]))
            i, j, p = i[near], j[near], p[near]
            start, end = i - s.behind(i - 1, j - 1), j + s.ahead(i, j)
            whole = np.flatnonzero(end - start >= np.maximum(exponent * p, least))
            for a, b, q in zip(start[whole].tolist(), end[whole].tolist(), p[whole].tolist(), strict=True):
                found[a, b] = min(q, found.get((a, b), q))
    return found


def copied(found: dict[tuple[int, int], int], starts: np.ndarray, size: np.ndarray, source: np.ndarray, least: int) -> None:
    """Adds the runs strictly inside of blocks, from the runs of the blocks' sources, from left to right."""
    if not found:
        return
    bucket: dict[int, list[tuple[int, int]]] = {}
    for (a, b), q in found.items():
        bucket.setdefault(a, []).append((b, q))
    order = sorted(bucket)
    for k in np.flatnonzero(size >= least + 2).tolist():
        at, long, of = int(starts[k]), int(size[k]), int(source[k])
        move, i = at - of, bisect_right(order, of)
        while i < len(order) and order[i] < of + long:
            for b, q in bucket[order[i]]:
                if b < of + long and (order[i] + move, b + move) not in found:
                    found[order[i] + move, b + move] = q
                    if order[i] + move not in bucket:
                        insort(order, order[i] + move)
                    bucket.setdefault(order[i] + move, []).append((b + move, q))
            i += 1


def runs(texts: list[list[bytes]], exponent: int = MIN_EXPONENT, least: int = MIN_WORDS) -> list[list[tuple[int, int, int]]]:
    """For each text, (start, length, period) of its runs, by start, then period."""
    ids, bounds = numbered(texts)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(ids):
        return out
    s = Suffixes(ids)
    length, source = previous_factors(s, len(ids))
    starts = blocks(length, bounds)
    found = at_boundaries(s, starts, bounds, exponent, least)
    copied(found, starts, np.diff(np.append(starts, len(ids))), source[starts], max(least, exponent))
    for (a, b), q in found.items():
        text = int(np.searchsorted(bounds, a, "right")) - 1
        out[text].append((a - int(bounds[text]), b - a, q))
    for mine in out:
        mine.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], mine: list[tuple[int, int, int]]) -> bytes:
    """The words joined by a space, without those that repeat: what lies in a run after its first period."""
    if mine:
        start, length, period = np.array(mine).T
        edges = np.bincount(start + period, minlength=len(words) + 1) - np.bincount(start + length, minlength=len(words) + 1)
        words = compress(words, np.cumsum(edges[:-1]) == 0)
    return b" ".join(words)


def _batched(column: pa.Array) -> Iterator[list[list[bytes]]]:
    """Words of texts in order, BATCH_WORDS at least together (but for the last)."""
    texts, held = [], 0
    for value in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()):
        words = (value.as_py() or b"").split()  # on the six blanks
        texts.append(words)
        held += len(words)
        if held >= BATCH_WORDS:
            yield texts
            texts, held = [], 0
    if texts:
        yield texts


def _find(exponent: int, least: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [c for c in batch.schema.names if c != "text"]
            at = 0
            for texts in _batched(batch.column("text")):
                found = runs(texts, exponent, least)
                kept = pa.array([collapsed(w, r) for w, r in zip(texts, found, strict=True)], pa.binary()).cast(pa.string())
                rows = [[{"start": a, "length": n, "period": q} for a, n, q in mine] for mine in found]
                carried = [batch.column(c).slice(at, len(texts)) for c in names]
                yield pa.RecordBatch.from_arrays([*carried, pa.array(rows, kind), kept], names=[*names, "runs", "collapsed"])
                at += len(texts)

    return run


#: Columns that find_runs adds; columns of docs with these names are replaced.
ADDED = ("runs", "collapsed")


def find_runs(docs: DataFrame, exponent: int = MIN_EXPONENT, least: int = MIN_WORDS) -> DataFrame:
    """Columns of docs but text, with ``runs``: array<struct<start, length, period>> by start, then period, in words from 0;
    ``collapsed``: the text's words joined by single spaces, each run cut to its first period."""
    ship(docs.sparkSession)
    if exponent < 2:
        raise ValueError("a run repeats at least twice")
    names = docs.columns
    docs, back = sealed(docs, ("text",))
    carried = [f for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in carried), "runs array<struct<start: long, length: long, period: long>>", "collapsed string"])
    found = docs.mapInArrow(_find(exponent, least), schema)
    return found.select(*[back[i] for i, c in enumerate(names) if c not in ("text", *ADDED)], *ADDED)


def collapse_runs(docs: DataFrame, exponent: int = MIN_EXPONENT, least: int = MIN_WORDS) -> DataFrame:
    """docs with each text's runs cut to their first period and its blanks to single spaces; null texts become empty."""
    names = docs.columns
    docs, back = sealed(docs, ("text",))
    found = find_runs(docs, exponent, least).withColumnRenamed("collapsed", "text")
    return found.select(*[back[i] for i in range(len(names))])


def longest(found: str = "runs") -> dict[str, object]:
    """start, length, period and exponent_milli of the run with most words (ties: smallest start, then period); null without runs."""
    least = F.array_min(F.transform(found, lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    exponent = F.floor(F.lit(1000) * -least["less"] / least["period"])
    return {"start": least["start"], "length": -least["less"], "period": least["period"], "exponent_milli": exponent}
