"""Operators 11 to 13: runs, shards and tries against brute force, with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import runs, sharding, tries
from foliospark.llm.queries import op11_runs, op12_shards

DATA = "/root/testdata/sf0.001"


def brute_runs(words, exponent=4, least=6):
    """Every period at every place."""
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            length = i + q - start if i > start else 0
            if length >= max(least, exponent * q):
                found.setdefault((start, length), q)
            i += i == start
    return sorted(((a, n, q) for (a, n), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_by_every_period():
    rng, n = random.Random(1), 0
    for _ in range(400):
        texts = []
        for _ in range(rng.randrange(1, 5)):
            kinds = rng.choice([1, 2, 2, 3, 5])
            words = [b"%d" % rng.randrange(kinds) for _ in range(rng.randrange(90))]
            if rng.random() < 0.5 and words:
                a = rng.randrange(len(words))
                words = words[:a] + words[a : a + rng.randrange(1, 6)] * 10 + words[a:]
            if rng.random() < 0.4:
                words = words + words[len(words) // 3 :] + words
            texts.append(words * rng.choice([1, 1, 3]))
        for exponent, least in ((4, 6), (2, 2), (3, 1)):
            want = [brute_runs(w, exponent, least) for w in texts]
            n += sum(map(len, want))
            assert runs.runs(texts, exponent, least) == want
    assert n > 10_000


def test_runs_long():
    """One word, a long period, and a text whose blocks hold runs of their own; extended in many pieces, the same."""
    unit = [b"%d" % i for i in range(3000)]
    inner = [b"x", b"y"] * 5 + [b"%d" % i for i in range(40)]
    texts = [[b"a"] * 50_000, unit * 5, [b"p", *inner, b"q", *inner, b"r", *inner[2:], b"s"], []]
    want = [[(0, 50_000, 1)], [(0, 15_000, 3000)], brute_runs(texts[2]), []]
    assert runs.runs(texts) == want and len(want[2]) == 3
    periods, runs.PERIODS = runs.PERIODS, 100
    try:
        assert runs.runs(texts[2:]) == want[2:]
    finally:
        runs.PERIODS = periods


def test_runs_of_whole_table(spark):
    """The registered query, row by row."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in op11_runs(spark, DATA).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    some = 0
    for r in docs:
        words, h = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""), zlib.crc32(str(r["doc_id"]).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        row, want = got[r["doc_id"]], brute_runs(words)
        some += bool(want)
        best = min(want, key=lambda x: (-x[1], x[0], x[2])) if want else (None,) * 3
        assert (row["n_runs"], row["start"], row["length"], row["period"]) == (len(want), *best)
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if want else None)
        dropped = {i for a, m, q in want for i in range(a + q, a + m)}
        assert row["runs_sha256"] == sha("".join(f"{a},{m},{q}\n" for a, m, q in want))
        assert row["collapsed_sha256"] == sha(" ".join(w for i, w in enumerate(words) if i not in dropped))
    assert some >= 3 and len(got) == len(docs)


def test_runs_odd_rows(spark):
    rows = [(None, None, 1), (1, "", 2), (1, " \t\n", 3), (2, "é é\x0bé\x0cé\ré  é x", 4), (2, "a b " * 20, 5), (3, "w\x1fw w\xa0w " * 3, 6), (3, "tick " * 200_000, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").toDF("doc_id", "text", "runs").withColumn("a.b", F.col("runs")).withColumn("text ", F.lit("own"))
    got = {r["a.b"]: r for r in runs.find_runs(docs).collect()}
    found = lambda n: [tuple(x) for x in got[n]["runs"]]
    assert [found(n) for n in (1, 2, 3, 6)] == [[]] * 4 and [found(n) for n in (4, 5, 7)] == [[(0, 6, 1)], [(0, 40, 2)], [(0, 200_000, 1)]]
    assert [got[n]["collapsed"] for n in (1, 4, 5, 7)] == ["", "é x", "a b", "tick"]
    assert runs.find_runs(docs).columns == ["doc_id", "a.b", "text ", "runs", "collapsed"]
    assert runs.find_runs(docs.limit(0)).collect() == []
    kept = runs.collapse_runs(docs)
    assert kept.columns == docs.columns and {r["a.b"]: r["text"] for r in kept.collect()}[5] == "a b"
    with pytest.raises(ValueError, match="twice"):
        runs.find_runs(docs, exponent=1)


def one_by_one(points, owners, keys, room):
    """Every key on its own: arcs in order of the ring try one point after another, round by round."""
    n, room = len(owners), list(room)
    at = np.searchsorted(points, [k[0] for k in keys], "left")
    waiting, out = [(int(a), i, int(a) % n) for i, a in enumerate(at)], {}
    while waiting:
        later = []
        for arc, i, node in waiting:
            if room[owners[node]] > 0:
                room[owners[node]] -= 1
                out[i] = int(owners[node])
            else:
                later.append((arc, i, node))
        waiting = []
        for arc, i, node in later:
            steps = next(s for s in range(1, n + 1) if room[owners[(node + s) % n]] > 0) if any(room) else 0
            waiting.append((arc, i, (node + steps) % n))
    return out


def test_shards_one_by_one(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("text")).otherwise("one text").alias("text"))
    for shards, virtual in ((8, 16), (3, 4)):
        got = {r["doc_id"]: r for r in sharding.shard_documents(docs, shards=shards, virtual=virtual).collect()}
        keys = sorted((r["k"], r["doc_id"]) for r in docs.select(sharding.key_of(F.col("text")).alias("k"), "doc_id").collect())
        points, owners = sharding.ring(spark, shards, virtual)
        # All of a round that one arc sends arrives together, as the arcs do in order.
        want = one_by_one(points, owners, keys, sharding.bounds(len(keys), shards, 0))
        assert {d: got[d]["shard"] for _, d in keys} == {keys[i][1]: s for i, s in want.items()}


def test_shards_are_even_and_move_little(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").cache()
    n = docs.count()
    for by, slack in (("rows", 0.0), ("bytes", 0.0), ("rows", 0.1)):
        found = {}
        for shards in (8, 9):
            rows = sharding.shard_documents(docs, by=by, shards=shards, slack=slack).select("doc_id", "shard", "slot", sharding.size_of(F.col("text")).alias("size"), "text").collect()
            found[shards] = {r["doc_id"]: r["shard"] for r in rows}
            counts, sizes = Counter(r["shard"] for r in rows), Counter()
            for r in rows:
                sizes[r["shard"]] += r["size"]
            assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(c)) for s, c in counts.items())
            if by == "rows":
                assert max(counts.values()) - min(counts.values()) <= 1 if not slack else max(counts.values()) <= 1.1 * n / shards + 1
            else:
                assert max(sizes.values()) <= sum(sizes.values()) / shards + max(r["size"] for r in rows)
            of = defaultdict(set)
            for r in rows:
                of[r["text"]].add(r["shard"])
            assert sum(len(s) > 1 for s in of.values()) <= 2 * shards
        assert sum(found[8][d] != found[9][d] for d in found[8]) <= 0.25 * n


def test_shards_of_odd_rows(spark, tmp_path):
    rows = [(None, None, "a")] * 5 + [(1, "", "b"), (1, "x" * 100_000, "c")] + [(2, "same", "d")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string").withColumn("point", F.lit("own")).withColumn("a.b", F.lit(1))
    got = sharding.shard_documents(docs, shards=4)
    assert got.columns == ["doc_id", "text", "point", "a.b", "shard", "slot"]
    counts = Counter(r["shard"] for r in got.collect())
    assert sorted(counts.values()) == [11, 12, 12, 12]
    assert sharding.shard_documents(docs.limit(0)).collect() == []
    assert len(sharding.shard_documents(docs.limit(2)).collect()) == 2
    sharding.write_shards(got, str(tmp_path / "shards"))
    again = spark.read.parquet(str(tmp_path / "shards"))
    assert Counter(r["shard"] for r in again.collect()) == counts
    with pytest.raises(ValueError, match="rows or bytes"):
        sharding.shard_documents(docs, by="tokens")


def test_shards_query(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = op12_shards(spark, DATA).collect()
    assert len(rows) == len(docs) and all((r["size"], r["text_crc32"]) == (len(docs[r["doc_id"]].encode()) + 1, zlib.crc32(docs[r["doc_id"]].encode())) for r in rows)
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute_trie(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, r or "", x or ""))
    convs = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}
    nodes, ends, below, out, leaves, saved = defaultdict(list), defaultdict(list), defaultdict(list), [], {}, {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(convs.get(c - c % 20, [])[:h] + own[h:])
        for d in range(len(path) + 1):
            nodes[path[:d]].append(c)
        ends[path].append(c)
    for p in nodes:
        if p:
            below[p[:-1]].append(p)
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in below[p]) if below[p] else 1
        saved[p] = sum(saved[k] for k in below[p]) + ((len(nodes[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0)
        digest = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        out.append((min(nodes[p]), len(p), min(nodes[p[:-1]]) if p else None, len(nodes[p]), len(below[p]), leaves[p], saved[p], digest))
    return sorted(out, key=str)


def trie(frame):
    return sorted((tuple(r) for r in tries.conversation_trie(frame).select(*COLUMNS).collect()), key=str)


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("hot", [False, True])
def test_trie(spark, monkeypatch, hot):
    """Nulls, ties, repeats and missing bases; a conversation over many ranges, its family's base too; lists in pieces."""
    rng = random.Random(3)
    rows = []
    for c in range(90):
        if rng.random() < 0.8:
            rows += [(c, None if rng.random() < 0.1 else t, rng.choice(["u", "a", None]), rng.choice([None, "", "x y", "b", "c d e"])) for t in range(rng.choice([0, 1, 2, 3, 4, 6, 9]))]
    if hot:
        monkeypatch.setattr(tries, "PIECE", 3)
        rows += [(45, t, "u", rng.choice(["p", "q r"])) for t in range(2000)] + [(60, 5, "u", "same")] * 400 + [(None, 1, "u", "x")]
        rows += [(c, t, "u", "hello") for c in range(1000, 1100) for t in range(4)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("h1", F.lit("own")).withColumn("part", F.lit(1))
    assert trie(frame) == brute_trie(rows)


def test_trie_of_table(spark):
    turns = spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert trie(turns) == brute_trie([tuple(r) for r in turns.collect()])
    assert trie(turns.limit(0)) == []
    assert trie(spark.createDataFrame([(None, 1, "u", "x")], SCHEMA)) == []
    one = [(41, None, None, None)]
    assert trie(spark.createDataFrame(one, SCHEMA)) == brute_trie(one)
