"""Operators 1, 2 and 4: held-out accuracy, and texts and labels of every odd kind."""

import pytest
from pyspark.sql import functions as F

from foliospark.llm import language, quality, toxicity
from foliospark.llm.queries import QUERIES
from foliospark.llm.shared import fold

DATA = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "...!!! ???"), (6, "x" * 100_000), (7, "word " * 20_000), (None, "no id"), (8, "日本語 текст"), (8, "repeated id")]


def held_out(spark, name, label):
    scored = QUERIES[name](spark, DATA)
    assert scored.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    joined = scored.join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").where("held_out")
    return joined.agg(F.avg((F.col("predicted") == F.col(label)).cast("int")), F.count("*")).first()


def test_quality(spark):
    accuracy, n = held_out(spark, "op1_quality", "quality")
    assert n > 40 and accuracy >= 0.95


def test_toxicity(spark):
    accuracy, n = held_out(spark, "op2_toxicity", "toxic")
    assert n > 40 and accuracy >= 0.93


def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("y", F.lit(1))


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_odd_texts(spark, operator):
    docs = odd(spark)
    label = "quality" if operator is quality else "toxic"
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 9)] + [(None, 1), (4, None), (1, 0)], f"doc_id long, {label} int")
    for some in (labels, labels.where(f"{label} = 1"), labels.limit(0)):
        model = operator.train(docs, some, folds=1000, held_out=999)
        got = operator.score(docs, model, fold("doc_id", 5) == 0).collect()
        assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
        assert [r["score"] for r in got] == [r["score"] for r in operator.score(docs, operator.train(docs, some, folds=1000, held_out=999), fold("doc_id", 5) == 0).collect()]
    assert operator.score(docs.limit(0), model, F.lit(True)).collect() == []


def test_offending_sentences(spark):
    mild, bad = "The weather is fine today and we walk home.", "You are a wretched gnorf and nothing else."
    docs = [(i, f"Élan vital. {mild} {bad if i % 2 else mild}\nSome {i} more words here.") for i in range(200)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    model = toxicity.train(frame, labels)
    for r in toxicity.score(frame, model, F.lit(False)).collect():
        assert (r["score"] >= 0.5) == bool(r["doc_id"] % 2)
        for s in r["offending"]:
            assert docs[r["doc_id"]][1][s["start"] : s["end"]] == bad.rstrip(".")
    left = toxicity.drop_toxic(frame.withColumn("extra", F.array(F.lit(1))), model)
    assert left.columns == ["doc_id", "text", "extra"] and sorted(r["doc_id"] for r in left.collect()) == list(range(0, 200, 2))


def test_scores_are_the_models(spark):
    """Whole scores against plain loops: presence of features by sentence and noisy-or; gated attention over passages."""
    import numpy as np
    import pyarrow as pa

    from foliospark.llm.kernel import slices

    rng = np.random.default_rng(5)
    texts = ["bad bad bad bad bad bad bad. Good words here! bad", "fine", "", "one two\nthree bad four", "w " * 300 + "bad"]
    model = toxicity.Model(rng.normal(size=1 << toxicity.BITS).astype(np.float32), -3.0)
    for s in slices(pa.array(texts), most=1):
        start, end, sentence, first, _ = toxicity.sentences(s)
        none = 1.0
        for i in range(len(first)):
            seen = {int(b) for words, bucket in toxicity.features(s, start, end) for w, b in zip(words, bucket, strict=True) if sentence[w] == i}
            none *= 1 - 1 / (1 + np.exp(-(model.bias + sum(float(model.weights[b]) for b in seen))))
        assert abs(toxicity.score_slice(s, model)[0][0] - (1 - none)) < 1e-6
    once, often = ("You are bad today", "You are bad bad bad bad bad bad bad bad bad bad today")
    one = next(slices(pa.array([once, often])))
    assert np.ptp(toxicity.score_slice(one, model)[0]) < 1e-9

    hidden, gate = 5, 3
    net = {"E": rng.normal(size=(quality.WIDTH, hidden)), "e": rng.normal(size=hidden), "V": rng.normal(size=(hidden, gate)), "U": rng.normal(size=(hidden, gate)), "w": rng.normal(size=gate), "c": rng.normal(size=hidden), "b": 0.1}
    whole = quality.Model(np.zeros(quality.WIDTH), np.ones(quality.WIDTH), net)
    s = next(slices(pa.array(texts)))
    x, owner = quality.encode(s)
    scores, _ = quality.score_slice(s, whole)
    for i in range(len(texts)):
        h = [np.tanh(row @ net["E"] + net["e"]) for row in x[owner == i].astype(float)]
        a = [np.exp(net["w"] @ (np.tanh(v @ net["V"]) / (1 + np.exp(-(v @ net["U"]))))) for v in h]
        z = sum(p * v for p, v in zip(a, h, strict=True)) / sum(a)
        assert abs(scores[i] - 1 / (1 + np.exp(-(z @ net["c"] + net["b"])))) < 1e-4


def test_sample_is_bounded(spark):
    from foliospark.llm.shared import sampled_labels

    docs = spark.createDataFrame([(str(i), "x" * (10**6 if i == 3 else 100)) for i in range(40)], "doc_id string, text string")
    labels = spark.createDataFrame([(str(i), i % 2) for i in range(40)], "doc_id string, toxic int")
    whole = sampled_labels(docs, labels, "toxic", 100, held_out=7)
    some = sampled_labels(docs, labels, "toxic", 100, held_out=7, most_bytes=1500)
    assert whole.num_rows == 40 and some.num_rows == 15 and "3" not in some.column("doc_id").to_pylist()
    y, weight = some.column("y").to_numpy(), some.column("weight").to_numpy()
    assert abs(weight[y == 1].sum() - 20) < 1e-9 and abs(weight[y == 0].sum() - 20) < 1e-9


def test_rank_order_distance(spark):
    """Distances against the definition, over lists of ranks."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 60").select("doc_id", "text", "lang")
    profiles = language.learn_profiles(docs)
    import numpy as np

    for r in language.identify(docs, F.lit(True), profiles).join(docs, "doc_id").collect():
        mine = language.top(np.bincount(language.grams(r["text"] or ""), minlength=language.BUCKETS)).tolist()
        far = {n: sum(abs(p.index(b) - i) if b in p else language.RANKS for i, b in enumerate(mine)) for n, p in profiles.items()}
        best = min(far, key=lambda n: (far[n], n))
        if mine:
            assert (r["lang_pred"], round(r["score"], 9)) == (best, round(1 - far[best] / (language.RANKS * len(mine)), 9))
    marks = spark.createDataFrame([("m", "\u0301\u0302 1 \u0303"), ("l", "e\u0301")], "doc_id string, text string")
    assert {r["doc_id"]: r["lang_pred"] != "und" for r in language.identify(marks, F.lit(True), profiles).collect()} == {"m": False, "l": True}


def test_language(spark):
    got = QUERIES["op4_language"](spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet"), "doc_id").where("held_out")
    accuracy, n = got.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.count("*")).first()
    assert n > 200 and accuracy >= 0.97


def test_language_odd_texts(spark):
    train = spark.createDataFrame([("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "en"), ("x y z", None), ("123", "digits")], "text string, lang string")
    profiles = language.learn_profiles(train)
    assert list(profiles) == ["de", "en"]
    got = {(r["doc_id"], r["lang_pred"]): r["score"] for r in language.identify(odd(spark), F.lit(True), profiles).collect()}
    assert [k[1] for k in got if k[0] in (1, 2, 3, 5)] == ["und"] * 4 and all(0 <= s <= 1 for s in got.values())
    assert all(r["lang_pred"] == "und" for r in language.identify(odd(spark), F.lit(True), {}).collect())
    hund = spark.createDataFrame([(1, "Die Katze und der Hund"), (2, "THE dog")], "doc_id long, text string")
    assert [r["lang_pred"] for r in language.identify(hund, F.lit(True), profiles).orderBy("doc_id").collect()] == ["de", "en"]
    assert language.learn_profiles(train.limit(0)) == {}


def test_language_profile_counts_all(spark):
    """Profiles from many partitions are those of one, counted plainly."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 120")
    profiles = language.learn_profiles(docs.repartition(7))
    import numpy as np

    for lang, profile in profiles.items():
        counts = np.zeros(language.BUCKETS, np.int64)
        for r in docs.where(F.col("lang") == lang).collect():
            np.add.at(counts, language.grams(r["text"]), 1)
        assert profile == language.top(counts).tolist()
