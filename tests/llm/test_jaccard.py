"""Operator 3 against all pairs in plain Python."""

import random
import re
from collections import defaultdict

import pytest

from foliospark.llm import jaccard_join

SCHEMA = "doc_id long, text string, node string"


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) or frozenset([tuple(words)])


def brute(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    by_gram = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            by_gram[g].append(i)
    for i, s in enumerate(sets):
        for j in {j for g in s for j in by_gram[g] if j > i}:
            if 100 * len(s & sets[j]) >= percent * len(s | sets[j]):
                up[root(j)] = root(i)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)].append(doc)
    return sorted(((d, len(s), (min(least[root(i)], default=None) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def family(rng, n, size, edits, vocabulary=5000):
    """Copies of one text, each with some words replaced: they may link with the text but not with each other."""
    base = [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
    out = [" ".join(base)]
    for _ in range(size - 1):
        copy = list(base)
        for i in rng.sample(range(n), edits):
            copy[i] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def rows():
    rng = random.Random(5)
    texts = [None, "", " \t\n ", "one", "One", "one two", "one  two\n", "one two three", "one two three four", "ONE two three four", "Ünï ünï", "a a a a a a", "a a a a", "x" * 20000]
    texts += family(rng, 120, 60, 2) + family(rng, 200, 40, 5) + family(rng, 90, 30, 1)
    chain = [f"c{i}" for i in range(60)]
    for i in range(25):  # each links with the next only
        texts.append(" ".join(chain))
        chain = chain[2:] + [f"d{i}", f"e{i}"]
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 80))) for _ in range(150)]
    texts += [" ".join(f"r{rng.randrange(10**6)}" for _ in range(3000))] * 3
    out = list(enumerate(texts))
    rng.shuffle(out)
    return out + [(None, texts[20]), (None, "only here"), out[0], out[1], (7, "another text of doc seven, repeated id")]


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_against_all_pairs(spark, k, percent):
    table = rows()
    frame = spark.createDataFrame([(i, t, "clash") for i, t in table], SCHEMA).repartition(5)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(frame, k, percent).collect()]
    assert sorted(got, key=str) == brute(table, k, percent)


def test_large_tiles(spark, monkeypatch):
    """Many parts and bands to a tile, and members that link only among themselves."""
    monkeypatch.setattr(jaccard_join, "PART", 16)
    monkeypatch.setattr(jaccard_join, "BLOCK", 1 << 12)
    rng = random.Random(9)
    texts = [t for i in range(4) for t in family(rng, 60 + 4 * i, 60, 1)] + family(rng, 300, 120, 9)
    table = list(enumerate(texts))
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(spark.createDataFrame(table, "doc_id long, text string"), 4, 85).collect()]
    assert sorted(got, key=str) == brute(table, 4, 85)


def test_keep_one(spark):
    table = rows()
    kept = jaccard_join.keep_one(spark.createDataFrame([(i, t, "clash") for i, t in table], SCHEMA), 5, 80)
    assert kept.columns == ["doc_id", "text", "node"]
    got = kept.collect()
    groups = {}
    for (d, t), (_, n, c) in zip(sorted(table, key=str), brute(table, 5, 80), strict=False):
        del d, t
        if n:
            groups[c] = 1
    stay = [r for r in got if shingles(r["text"], 5)]
    assert {r["doc_id"] for r in stay if r["doc_id"] is not None} >= {c for c in groups if c is not None}
    assert sum(1 for r in got if not shingles(r["text"], 5)) == sum(1 for _, t in table if not shingles(t, 5))
    assert jaccard_join.keep_one(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_keep_one_without_ids(spark):
    text = " ".join(f"w{i}" for i in range(50))
    near, other = text.replace("w49", "x"), " ".join(f"o{i}" for i in range(9))
    rows = [(None, text)] * 4 + [(None, near), (None, other), (None, other), (3, other), (None, ""), (None, ""), (None, None), (5, "a b"), (5, "a b"), (5, near + " y z")]
    frame = spark.createDataFrame([(i, t, "x", j) for j, (i, t) in enumerate(rows)], "doc_id long, text string, leaving string, `a.b` int")
    got = jaccard_join.keep_one(frame)
    assert got.columns == frame.columns
    # Copies of text, its near copies and document 5's are one group; the row with the id stays.
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got.collect()) == sorted([(5, near + " y z"), (3, other), (0, ""), (0, ""), (0, ""), (5, "a b"), (5, "a b")])
    bare = jaccard_join.keep_one(frame.where("doc_id is null")).collect()
    assert sum(r["text"] == other for r in bare) == 1 and sum(r["text"] in (text, near) for r in bare) == 1


@pytest.mark.parametrize("hot", [0])
def test_hot_keys(spark, monkeypatch, hot):
    """Hubs, frequent hashes and large tiles dealt out in parts: the same links."""
    from foliospark.llm import shared

    monkeypatch.setattr(shared, "HOT", hot)
    monkeypatch.setattr(jaccard_join, "PART", 16)
    monkeypatch.setattr(jaccard_join, "BLOCK", 1 << 12)
    whole = jaccard_join._frequency_classes
    monkeypatch.setattr(jaccard_join, "_frequency_classes", lambda first: whole(first) + 3)
    table = rows()
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(spark.createDataFrame([(i, t, "clash") for i, t in table], SCHEMA), 4, 85).collect()]
    assert sorted(got, key=str) == brute(table, 4, 85)


def test_components(spark):
    """A star, a long path, a clique and pairs, against union-find."""
    from foliospark.llm.components import components
    from foliospark.llm.shared import Scratch

    rng = random.Random(3)
    name = {i: rng.getrandbits(63) for i in range(3000)}
    edges = [(0, i) for i in range(1, 900)] + [(i, i + 1) for i in range(1000, 1400)] + [(i, j) for i in range(1500, 1520) for j in range(1500, i)] + [(i, i + 1) for i in range(2000, 2400, 2)] + [(7, 7)]
    up = list(range(3000))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in edges:
        up[root(a)] = root(b)
    scratch = Scratch()
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame([(name[a], name[b]) for a, b in edges], "a long, b long"), scratch).collect()}
    nodes = sorted({x for a, b in edges if a != b for x in (a, b)})
    assert set(got) == {name[i] for i in nodes}
    groups, labels = defaultdict(set), defaultdict(set)
    for i in nodes:
        groups[root(i)].add(i)
        labels[got[name[i]]].add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, labels.values()))
    scratch.clear()
