"""Language by rank order: a document's most frequent n-grams against each language's, out-of-place distance.

N-grams are of 1 to 3 characters of the lower-cased text, with every stretch of anything but letters as one
blank; they are counted in a table of hash buckets. A language's profile is the order of its most frequent
buckets over all documents to learn from. The distance of a document to a language sums how far each of its
most frequent buckets is out of place there, and the length of the profile for those it lacks.

Defined results: a null text or one without a letter is ``und`` with score 0, and so is everything when no
language was learned; ties go to the language first in order; null languages and texts teach nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.kernel import U, mix
from foliospark.llm.shared import id_type, sealed
from foliospark.ship import ship

BUCKETS = 1 << 15
#: Length of a profile, of a language and of a document.
RANKS = 400


#: Counts of a language are added up in so many parts, whose best are then put together.
PARTS = 64


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: itself if it is a letter or a mark (which goes on with a word), else 0; and whether it is a letter."""
    import unicodedata

    kinds = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
    kind = np.array(kinds)
    return np.where(np.isin(kind, ("L", "M")), np.arange(0x110000, dtype=np.uint32), np.uint32(0)), kind == "L"


def grams(text: str) -> np.ndarray:
    """Buckets of all n-grams of a text; empty if it has no letter."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    dark, letter = _letters()
    if not letter[raw].any():
        return np.zeros(0, np.int64)
    c = dark[raw]
    blank = c == 0
    c = c[~(blank & np.concatenate(([False], blank[:-1])))]
    c = np.concatenate(([0] * int(c[0] != 0), c, [0] * int(c[-1] != 0))).astype(U)
    two = c[:-1] << U(21) | c[1:]
    three = two[:-1] << U(21) | c[2:]
    # A blank in the middle of three joins two words and says little.
    three = three[c[1:-1] != 0]
    everything = np.concatenate((c[c != 0], two + (U(1) << U(63)), three))
    return (mix(everything) >> U(49)).astype(np.int64)


def top(counts: np.ndarray, most: int = RANKS) -> np.ndarray:
    """The buckets with the largest counts, in order; of equal ones, the least first."""
    used = np.flatnonzero(counts)
    return used[np.lexsort((used, -counts[used]))[:most]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, part, counts): this task's counts of each language, one row for each part that has any."""
    total: dict[str, np.ndarray] = {}

    def out() -> pa.RecordBatch:
        rows = [(lang, i, part.tobytes()) for lang, counts in total.items() for i, part in enumerate(np.split(counts, PARTS)) if part.any()]
        langs, parts, counts = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(parts, pa.int32()), pa.array(counts, pa.binary())], names=["lang", "part", "counts"])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            counts = np.bincount(grams(text.as_py()), minlength=BUCKETS)
            total[lang] = total[lang] + counts if lang in total else counts
            if len(total) > 100:
                yield out()
                total.clear()
    yield out()


def _best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, best) of rows sorted by (lang, part): the RANKS largest counts of each part with their buckets."""
    key, total = None, None

    def out() -> pa.RecordBatch:
        at = top(total)
        best = [{"less": -int(total[b]), "bucket": int(b) + key[1] * len(total)} for b in at]
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([best], _BEST)], names=["lang", "best"])

    for batch in batches:
        for lang, part, counts in zip(batch.column("lang").to_pylist(), batch.column("part").to_pylist(), batch.column("counts"), strict=True):
            counts = np.frombuffer(counts.as_buffer(), np.int64)
            if (lang, part) == key:
                total = total + counts
                continue
            if key:
                yield out()
            key, total = (lang, part), counts
    if key:
        yield out()


_BEST = pa.list_(pa.struct([("less", pa.int64()), ("bucket", pa.int32())]))


def learn_profiles(docs: DataFrame) -> dict[str, list[int]]:
    """Profiles from docs (text, lang): one list of RANKS buckets a language, all that reaches the driver."""
    ship(docs.sparkSession)
    docs, _ = sealed(docs, ("lang", "text"))
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counted = known.mapInArrow(_count, "lang string, part int, counts binary").repartition("lang", "part").sortWithinPartitions("lang", "part")
    best = counted.mapInArrow(_best, "lang string, best array<struct<less:bigint,bucket:int>>")
    # PARTS rows of RANKS pairs a language at most.
    whole = best.groupBy("lang").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, RANKS)["bucket"].alias("profile"))
    return {r["lang"]: r["profile"] for r in sorted(whole.collect())}


def _predict(profiles: dict[str, list[int]]):
    names = list(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full((BUCKETS, max(1, len(names))), RANKS, np.int32)  # RANKS: not there
        for i, name in enumerate(names):
            place[profiles[name], i] = np.arange(len(profiles[name]))
        for batch in batches:
            pred, score = [], []
            for text in batch.column("text"):
                text = text.as_py()
                buckets = grams(text) if text and names else np.zeros(0, np.int64)
                if not len(buckets):
                    pred.append("und"), score.append(0.0)
                    continue
                mine = top(np.bincount(buckets, minlength=BUCKETS))
                at = place[mine]
                distance = np.where(at == RANKS, RANKS, np.abs(at - np.arange(len(mine), dtype=np.int32)[:, None])).sum(axis=0)
                best = int(distance.argmin())
                pred.append(names[best]), score.append(1.0 - float(distance[best]) / (RANKS * len(mine)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, held_out: Column, profiles: dict[str, list[int]]) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of docs (doc_id, text); score: 1 at distance 0, 0 at the largest."""
    ship(docs.sparkSession)
    docs, _ = sealed(docs, ("doc_id", "text"))
    return docs.select("doc_id", "text", held_out.alias("held_out")).mapInArrow(_predict(profiles), f"doc_id {id_type(docs)}, held_out boolean, lang_pred string, score double")
