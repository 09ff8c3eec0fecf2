"""Every stage of the pipeline on its own input, against brute force; and the whole of it."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_jaccard import brute
from tests.llm.test_native import dedup, fill

DATA = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows before and after each stage."""
    at = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        out.append(docs.collect())
        assert docs.columns[:5] == COLUMNS
    return out


def test_toxic_go_and_clean_stay(spark, stages):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    left = {r["doc_id"] for r in stages[1]}
    gone = {r["doc_id"] for r in stages[0]} - left
    assert {r["doc_id"]: r for r in stages[1]} == {r["doc_id"]: r for r in stages[0] if r["doc_id"] in left}
    marked = [d for d in gone if d in labels]
    assert marked and sum(labels[d] for d in marked) >= 0.8 * len(marked)
    assert sum(1 for d in left if labels.get(d) == 0) >= 0.97 * sum(1 for v in labels.values() if v == 0)


def test_lines(stages):
    import hashlib

    want = {r[0]: r[3] for r in dedup([(r["doc_id"], r["text"], "") for r in stages[1]])}
    assert {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in stages[2]} == want
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2])


def test_near_copies(stages):
    groups = brute([(r["doc_id"], r["text"]) for r in stages[2]], 5, 80)
    assert {r["doc_id"] for r in stages[3]} == {c for _, _, c in groups}


def holds(words, item):
    """Whether some 13 words in a row of the text agree with 13 in a row of the item, but for two; all of a shorter item, by proportion."""
    n = min(len(item), 13)
    spans = [item[j : j + n] for j in range(len(item) - n + 1)]
    least = n - n * 2 // 13
    return any(sum(x == y for x, y in zip(words[i : i + n], span, strict=True)) >= least for i in range(len(words) - n + 1) for span in spans)


def test_leaks(spark, stages):
    """By every window of every item that shares four words in a row with a text, as any that agrees so far does."""
    words = lambda x: re.findall(r"[^\W_]+", x.lower())
    items = [w for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() if len(w := words(r["text"])) >= 13]
    by_four = {}
    for k, w in enumerate(items):
        for i in range(len(w) - 3):
            by_four.setdefault(tuple(w[i : i + 4]), set()).add(k)
    leaking = set()
    for r in stages[3]:
        w = words(r["text"])
        near = {k for i in range(len(w) - 3) for k in by_four.get(tuple(w[i : i + 4]), ())}
        if any(holds(w, items[k]) for k in near):
            leaking.add(r["doc_id"])
    left = {r["doc_id"] for r in stages[4]}
    assert leaking and left == {r["doc_id"] for r in stages[3]} - leaking


def test_clean_documents_that_come_close_stay(spark):
    """A text that ends two words short of a window, or begins with the last words of an item, holds no item; one with two other words does."""
    item = next(w for r in spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").collect() if len(w := re.findall(r"[^\W_]+", r["text"])) >= 30)
    before = [f"word{i}" for i in range(20)]
    changed = [*item[:4], "other", *item[5:9], "word", *item[10:13]]
    texts = {1: before + item[:11], 2: item[-11:] + before, 3: before + item[:12], 4: before + changed + before, 5: before, 6: item[5:16]}
    docs = spark.createDataFrame([(i, " ".join(w), "en", "s", 1) for i, w in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.drop_leaks(spark, docs, DATA).collect()} == {i for i, w in texts.items() if not holds(w, item)} == {1, 2, 3, 5, 6}


def test_mix(stages):
    sizes, taken = Counter(), Counter()
    for r in stages[4]:
        sizes[r["source"]] += len(r["text"].split())
    for r in stages[5]:
        taken[r["source"]] += len(r["text"].split())
    copies = Counter(r["doc_id"] for r in stages[5])
    assert max(copies.values()) <= 3 and {(r["doc_id"], r["copy"]) for r in stages[5]} == {(d, i + 1) for d, n in copies.items() for i in range(n)}
    want = fill(sizes)
    assert abs(sum(taken.values()) - sum(want.values())) < 0.15 * sum(want.values())


def test_run_and_odd_rows(spark, stages):
    assert sorted((r["doc_id"], r["copy"]) for r in corpus_pipeline.run(spark, DATA).collect()) == sorted((r["doc_id"], r["copy"]) for r in stages[5])
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "x" * 50_000, None, "a", None), (2, "words in a row " * 9000, "en", None, 5)], "doc_id long, text string, lang string, source string, n_chars long"
    )
    odd = odd.withColumn("size", F.lit("clash")).withColumn("n_lines", F.lit("clash")).withColumn("component_id", F.lit(1)).withColumn("score", F.array(F.lit(1)))
    for docs in (odd, odd.limit(0)):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            after = stage(spark, docs, DATA)
            assert after.columns[: len(odd.columns)] == odd.columns or i == 4
            rows = after.collect()
            assert len(rows) <= 5 * 3 and all(r["size"] == r["n_lines"] == "clash" and r["component_id"] == 1 for r in rows)
