"""A training corpus from raw documents: toxic ones go, shared lines go, one of each group of near copies
stays, documents that hold benchmark passages go, and what is left is mixed to target weights.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns of
documents; the last adds ``copy``, the number of each emitted copy. Nulls, empty and repeated rows are
treated as each operator's docstring says; extra columns pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import decontaminate, jaccard_join, line_dedup, mixing, toxicity
from foliospark.llm.shared import Kept, read, scope, sealed


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels of this stage's own documents (fold 0 of 5 held out); score 0.5 or more goes."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 characters or more in five documents or more stay in one; texts and n_chars follow."""
    names = docs.columns
    docs, back = sealed(docs, ("doc_id", "text", "n_chars"))
    done = line_dedup.dedup_lines(docs)
    text = F.when(F.col("text").isNotNull(), F.col("kept_text"))
    n_chars = F.when(F.col("n_dropped") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    changed = {"text": text.alias("text"), "n_chars": n_chars.alias("n_chars")}
    return done.select(*[changed.get(name, back[i]) for i, name in enumerate(names)])


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies: Jaccard 0.8 or more on five-word shingles; the least doc_id of each group stays."""
    return jaccard_join.keep_one(docs, k=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaking(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("jaccard_join", keep_one_copy),
    ("decontaminate", drop_leaks),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scope() as spared:
            after = Kept(stage(spark, docs, sf_dir), f"stage-{name}")
            spared.append(after)
        if before:
            before.drop()
        docs, before = after.frame, after
    return STAGES[-1][1](spark, docs, sf_dir)


#: The trained stage has no SQL; tests/llm holds every stage against a brute-force version.
ORACLE_SQL = None
