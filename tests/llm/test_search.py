"""Operators 6, 8 and 9: plain patterns, all pairs, planted passages."""

import base64
import itertools
import json
import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from foliospark.llm import decontaminate, neighbours, secrets

DATA = "/root/testdata/sf0.001"


def base_spans(text):
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or "", re.I | re.A):
        found += [(m.start(), 0, m.end())] * (len(m[2]) >= 8)
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text or "") if len(m[0]) >= 32]
    return sorted(found)


def der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


RSA = der(0x30, der(2, b"\0"), *[der(2, bytes(range(1, 60)))] * 8)
PKCS8 = der(0x30, der(2, b"\0"), der(0x30, der(6, b"\x2a\x86\x48"), der(5)), der(4, RSA))
part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
JWT = f"{part({'alg': 'HS256', 'typ': 'JWT'})}.{part({'sub': 'someone'})}.c2lnbmF0dXJlc2lnbmF0dXJl"


def test_secrets_base(spark):
    texts = [None, "", "password = hunter2hunter2, PASSWORD:'short'", "api_key:abcdefgh apikey=\"ABCDEFGH.x\" tokentoken=12345678", "AKIAABCDEFGHIJKL AKIASHORT AKIAAKIAAKIAAKIA", "f" * 31 + " " + "0a" * 16 + "é" + "9" * 100_000, "ſecret=12345678 toKen=12345678", "💥token: 1234567890"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("secrets", F.lit(1))
    for docs in (frame, table):
        want = {r["doc_id"]: r["text"] for r in docs.collect()}
        for r in secrets.find_secrets(docs).collect():
            got = [(s["start"], secrets.KINDS.index(s["kind"]), s["end"]) for s in r["secrets"]]
            assert [s for s in got if s[1] < 3] == base_spans(want[r["doc_id"]])
    assert secrets.find_secrets(frame.limit(0)).collect() == []


def test_secrets_by_structure():
    kinds = lambda text: [secrets.KINDS[k] for _, k, _ in secrets.spans(text) if k >= 3]
    encoded = lambda x: base64.b64encode(x).decode()
    assert kinds(f"see {JWT} there") == ["jwt"]
    assert kinds(f"eyJ{'a' * 20}.{'b' * 20}.c") == []
    for key in (RSA, PKCS8):
        assert kinds(f"x {encoded(key)} y") == ["key"]
        assert kinds(f"x {encoded(key[:-1])} y") == []
        assert kinds(f"-----BEGIN PRIVATE KEY-----\n{encoded(key)}\n-----END PRIVATE KEY-----") == ["pem"]
        assert kinds(f"-----BEGIN PRIVATE KEY-----\n{encoded(key[:-3])}\n-----END PRIVATE KEY-----") == []
        assert "key" in kinds(f"hex {key.hex()} end")
    field = lambda x: len(x).to_bytes(4, "big") + x
    public, private = field(b"ssh-ed25519") + field(b"p" * 32), b"1234" * 2 + b"k" * 80
    ssh = lambda cipher, public, private: b"openssh-key-v1\0" + field(cipher) + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(public) + field(private)
    assert kinds(encoded(ssh(b"none", public, private))) == ["key"]
    assert kinds(encoded(ssh(b"aes256-gcm@openssh.com", public, private[3:]) + b"t" * 16)) == ["key"]
    for junk in (ssh(b"none", public, private)[:-5], ssh(b"none", public, private) + b"x" * 80, ssh(b"none", b"p" * 51, private), ssh(b"none", public, private[1:])):
        assert kinds(encoded(junk)) == []
    assert kinds("-----BEGIN OPENSSH PRIVATE KEY-----\n" + encoded(ssh(b"none", public, private)) + "\n-----END OPENSSH PRIVATE KEY-----") == ["pem"]


def test_secrets_nested_lengths():
    kinds = lambda x: [secrets.KINDS[k] for _, k, _ in secrets.spans(base64.b64encode(x).decode())]
    ids = {"rsa": "2a864886f70d010101", "ec": "2a8648ce3d0201", "ed25519": "2b6570", "pbes2": "2a864886f70d01050d", "sha256": "608648016503040201", "other": "2b0601040101"}
    algorithm = lambda name, *more: der(0x30, der(6, bytes.fromhex(ids[name])), *more)
    shell = lambda name, inner: der(0x30, der(2, b"\0"), algorithm(name), der(4, inner))
    ec = der(0x30, der(2, b"\1"), der(4, b"k" * 32), der(0xA1, der(3, b"\0" + b"q" * 65)))
    good = [RSA, ec, shell("rsa", RSA), shell("ec", ec), shell("ed25519", der(4, b"e" * 32)), shell("other", RSA), der(0x30, algorithm("pbes2", der(0x30, der(5))), der(4, b"c" * 64)), der(0x30, der(2, b"\0"), *[der(2, b"\1" * 20)] * 5)]
    bad = [shell("rsa", b"\xff" * 200), shell("rsa", ec), shell("ec", RSA), shell("rsa", RSA[:-1] + b""), shell("ed25519", der(4, b"e" * 31)), shell("other", b"\xff" * 60), der(0x30, algorithm("sha256", der(5)), der(4, b"h" * 32))]
    bad += [der(0x30, der(2, b"\0"), der(0x30, b"\x06\x09abc"), der(4, RSA)), der(0x30, der(2, b"\0"), der(0x30), der(4, RSA)), der(0x30, der(2, b"\0"), *[der(2, b"")] * 30), der(0x30, *[der(0xA0, b"\xff\xff")] * 20)]
    assert [kinds(x) for x in good] == [["key"]] * len(good)
    assert [kinds(x) for x in bad] == [[]] * len(bad)
    deep = der(2, b"\1")
    for _ in range(3000):
        deep = der(0x30, deep)
    assert kinds(deep) == []
    unsigned = f"{part({'alg': 'none'})}.{part({'sub': 1})}."
    assert [secrets.KINDS[k] for _, k, _ in secrets.spans(unsigned)] == ["jwt"] and secrets.spans(JWT.rsplit(".", 1)[0] + ".") == []


def test_secrets_pem_with_headers_or_escaped():
    kinds = lambda text: [secrets.KINDS[k] for _, k, _ in secrets.spans(text) if k >= 3]
    lines = lambda x: re.sub("(.{64})", r"\1\n", base64.b64encode(x).decode()).strip()
    block = lambda body, name="PRIVATE KEY": f"-----BEGIN {name}-----\n{body}\n-----END {name}-----\n"
    headers = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123456789ABCDEF0123456789ABCDEF\n\n"
    encrypted = block(headers + lines(bytes(range(7, 103))), "RSA PRIVATE KEY")
    plain = block(lines(PKCS8))
    for text in (encrypted, plain, encrypted.replace("\n", "\r\n")):
        for written in (text, json.dumps({"private_key": text}), json.dumps(json.dumps(text)), json.dumps(text).replace("/", "\\/").replace("+", "\\u002b").replace("=", "\\u003D")):
            assert kinds(f"a - b\n{written} c -- d") == ["pem"], written
            (start, _, end) = next(s for s in secrets.spans(written) if s[1] == 4)
            assert written[start:end].startswith("-----BEGIN ") and written[start:end].endswith(" PRIVATE KEY-----")
    assert kinds(encrypted + plain + encrypted) == ["pem"] * 3
    assert kinds(block(headers + "no-base64!", "RSA PRIVATE KEY")) == []
    assert kinds(block("Key-Info: none\n\n" + lines(bytes(range(7, 103))))) == []
    # A block without an end does not take the next one's.
    assert kinds("-----BEGIN PRIVATE KEY-----\nAAAA\n" + plain) == ["pem"]
    assert kinds('"\\n' + base64.b64encode(PKCS8).decode() + '\\n"') == ["key"]
    started = time.perf_counter()
    for text in ("-----BEGIN PRIVATE KEY-----" * 20_000, "-----BEGIN PRIVATE KEY-----\n" + "-" * 500_000, "-----BEGIN " + "A " * 300_000, "\\" * 500_000):
        assert kinds(text) == [] == kinds("-----BEGIN PRIVATE KEY-----" + text + "-----END PRIVATE KEY-----")
    assert time.perf_counter() - started < 10


def recall(got, table, k=5):
    """Share of the k nearest by brute force that were found, with ranks and scores checked."""
    rows = table.where("embedding is not null").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    found, n, mine = 0, 0, {}
    for r in sorted(got, key=lambda r: r["rank"]):
        mine.setdefault(r["query_id"], []).append(r)
    for q in np.flatnonzero(ids % 50 == 0):
        score = x @ x[q]
        score[q] = -2
        rows = mine[ids[q]]
        assert [r["rank"] for r in rows] == [1, 2, 3, 4, 5]
        assert all(abs(r["score"] - score[np.flatnonzero(ids == r["vec_id"])[0]]) < 1e-9 for r in rows)
        assert [(-r["score"], r["vec_id"]) for r in rows] == sorted((-r["score"], r["vec_id"]) for r in rows)
        found, n = found + len(set(ids[np.argsort(-score)[:k]].tolist()) & {r["vec_id"] for r in rows}), n + k
    return found / n


def test_neighbours_recall(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    assert recall(neighbours.nearest(table.withColumn("score", F.lit("clash")), F.col("id") % 50 == 0).collect(), table) >= 0.9


def test_neighbours_index(spark, monkeypatch):
    """What is retrieved is each row within the radius of the code, by brute force, however keys are cut; recall with queries outside the pilot."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    seen, whole = [], neighbours.index_pairs

    def counted(codes, n_rows, coder, scratch):
        pairs = whole(codes, n_rows, coder, scratch)
        rows = codes.select("vid", "asks", *neighbours.WORDS).toPandas()
        words = rows[neighbours.WORDS].to_numpy().view(np.uint64)
        asked = np.flatnonzero(rows["asks"])
        apart = np.bitwise_count(words[asked, None, :] ^ words[None, :, :]).sum(axis=2)
        want = {(rows["vid"][asked[q]], rows["vid"][r]) for q, r in zip(*np.nonzero(apart <= coder.near), strict=True)}
        assert {(r["qvid"], r["vid"]) for r in pairs.collect()} == want
        seen.append((len(want), apart.size))
        return pairs

    monkeypatch.setattr(neighbours, "index_pairs", counted)
    monkeypatch.setattr(neighbours, "PILOT", 10)
    once = neighbours.nearest(table, F.col("id") % 50 == 0).collect()
    assert recall(once, table) >= 0.9
    assert seen[0][0] < 0.4 * seen[0][1]
    for limit in ({"ENTRIES": 64, "ASKING": 3}, {"ENTRIES": 500, "BROADCAST_PARTS": 0, "HELD": 512}):
        for name, value in limit.items():
            monkeypatch.setattr(neighbours, name, value)
        assert sorted(neighbours.nearest(table, F.col("id") % 50 == 0).collect()) == sorted(once)
    assert len({x[0] for x in seen}) == 1
    # Where the radius holds too few, the exact way.
    monkeypatch.setattr(neighbours, "REACHED", 0.0)
    assert recall(neighbours.nearest(table, F.col("id") % 50 == 0).collect(), table) >= 0.99


def met(coder, x, q):
    """Pairs retrieved by the tables' probes, pairs met in them, and distances in the code."""
    (code, values), (code_q, values_q) = coder.codes(neighbours.unit(x)), coder.codes(neighbours.unit(q))
    pairs, n = set(), 0
    for t, radius in enumerate(coder.radii.tolist()):
        if radius >= 0:
            found = neighbours._probed((values_q[:, t], *code_q.T), (values[:, t], *code.T), radius, coder.bits, coder.near)
            pairs |= set(zip(*(p.tolist() for p in found), strict=True))
            n += int((np.bitwise_count(values_q[:, None, t] ^ values[None, :, t]) <= radius).sum())
    return pairs, n, np.bitwise_count(code_q[:, None, :] ^ code[None, :, :]).sum(axis=2)


def test_probing_reaches_the_radius():
    """Every code within any radius is retrieved, by the least radii of substrings that the pigeonhole principle allows."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 64))
    coder = neighbours.settle(neighbours.rotations(neighbours.unit(x)), neighbours.unit(x[:50]), neighbours.unit(x[50:100]), 300)
    tables = len(coder.radii)
    for near in (0, 3, tables - 1, tables, 100, 200, 230, 260):
        coder.near = near
        assert (coder.radii + 1).sum() == near + 1
        pairs, _, apart = met(coder, x, x[:60])
        assert pairs == {(int(i), int(j)) for i, j in zip(*np.nonzero(apart <= near), strict=True)}


def test_tables_prune_near_copies():
    """Neighbours that are near copies: tables meet a small part of the pairs, and all neighbours are retrieved."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(2000, 64))
    x = neighbours.unit(np.repeat(centres, 4, axis=0) + 0.03 * rng.normal(size=(8000, 64)))
    # Signs lie better in vectors that the rotation was learned from, so the radius comes from others, and the queries are others again.
    coder = neighbours.settle(neighbours.rotations(x[:2000]), x[2000:3600:4], x[2001:3600:4], len(x))
    pairs, n, _ = met(coder, x, x[4000::40])
    assert n < 0.1 * len(x) * 100
    assert sum((i, 4000 + 40 * i + j) in pairs for i in range(100) for j in range(4)) >= 0.95 * 400


def test_neighbours_scale(spark):
    """Components whose squares do not fit into a double; many equal vectors; a query among them."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 5))
    rows = [(i, (x[i] * s).tolist()) for i, s in enumerate([1, 1e200, 1e-200, 1e300, 5e-310] * 8)] + [(i, [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(1000, 1120)]
    got = {}
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 10 == 0).collect():
        got.setdefault(r["query_id"], []).append(r)
    whole = np.vstack([x, np.tile([1.0, 2, 3, 4, 5], (120, 1))])
    ids = np.array([r[0] for r in rows])
    whole /= np.linalg.norm(whole, axis=1)[:, None]
    for q in np.flatnonzero(ids % 10 == 0):
        score = np.round(whole @ whole[q], 9)
        want = [i for i in np.lexsort((ids, -score)) if i != q][:5]
        mine = sorted(got[ids[q]], key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert np.allclose([r["score"] for r in mine], score[want], atol=1e-4)
        if ids[q] >= 1000:
            assert [r["vec_id"] for r in mine] == [i for i in range(1000, 1007) if i != ids[q]][:5]


def test_neighbours_edges(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(60)]
    rows += [(100, None), (150, [0.0] * 6), (200, [float("nan")] + [1.0] * 5), (250, [None] + [1.0] * 5), (300, [float("inf")] * 6), (350, [1.0] * 4), (None, [1.0] * 6)]
    rows += [(i, rows[7][1]) for i in (400, 401, 402, 403, 404, 405, 406)] + [rows[3]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(frame, F.col("id") % 50 == 0).collect()
    assert {r["query_id"] for r in got} == {0, 50, 400}
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 400] == [7, 401, 402, 403, 404]
    assert neighbours.nearest(frame.limit(0), F.col("id") % 50 == 0).collect() == []
    two = neighbours.nearest(frame.where("vec_id in (0, 1, 2)"), F.col("id") % 50 == 0).collect()
    assert [r["rank"] for r in two] == [1, 2]


def test_masks_hit_every_window():
    for gone in itertools.combinations(range(decontaminate.WINDOW), decontaminate.SUBSTITUTIONS):
        assert any(not {o + i for i in m} & set(gone) for m in decontaminate.MASKS for o in range(decontaminate.WINDOW - m[-1]))
    for n in range(decontaminate.SHORTEST, decontaminate.WINDOW):
        m = decontaminate.short_mask(n)
        for gone in itertools.combinations(range(n), n * decontaminate.SUBSTITUTIONS // decontaminate.WINDOW):
            assert any(not {o + i for i in m} & set(gone) for o in range(n - m[-1]))


def test_decontamination(spark):
    rng = random.Random(2)
    word = lambda: f"v{rng.randrange(10**6)}"
    items = [[word() for _ in range(n)] for n in (5, 7, 12, 13, 14, 30, 60)]
    noise = lambda n: [word() for _ in range(n)]
    docs, want = [(0, None), (1, ""), (2, "one two three")], set()
    for i, item in enumerate(items):
        n = len(item)
        allowed = n * 2 // 13 if n < 13 else 2
        for edits in range(min(n, 5)):
            for _ in range(6):
                at = rng.randrange(max(1, n - 12)) if n > 13 else 0
                copy = list(item[at : at + 13])
                for j in rng.sample(range(len(copy)), min(edits, len(copy))):
                    copy[j] = word()
                doc = len(docs)
                docs.append((doc, " ".join(noise(rng.randrange(20)) + [w.upper() + "," for w in copy] + noise(rng.randrange(20)))))
                if edits <= allowed:
                    want.add((doc, i))
    docs += [(len(docs), " ".join(noise(5000) + items[5]))]
    want.add((len(docs) - 1, 5))
    frame = spark.createDataFrame(docs + [docs[-1], (None, docs[-1][1])], "doc_id long, text string").withColumn("seed", F.lit(3))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(50, None), (51, "too short"), (None, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(frame, bench).collect()}
    assert got == want | {(None, 5)}
    left = decontaminate.drop_leaking(frame, bench)
    assert left.columns == ["doc_id", "text", "seed"]
    assert {r["doc_id"] for r in left.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert decontaminate.leaks(frame, bench.limit(0)).collect() == [] and decontaminate.leaks(frame.limit(0), bench).collect() == []


def test_decontamination_by_windows(spark):
    """Against every window of every item at every place of every document."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(2)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [draw(n) for n in (1, 2, 4, 5, 6, 8, 12, 13, 15, 20)] + [["same", "start", *vocabulary, *vocabulary, *draw(8)] for _ in range(5)]
    docs = [draw(rng.randrange(1, 40)) for _ in range(60)] + [list(items[i]) for i in (0, 1, 2)] + [[*items[2], "x"]] + [draw(6) + items[-1][2:17] + draw(3)]

    def holds(doc, item, shortest=decontaminate.SHORTEST):
        n = min(len(item), 13)
        if len(item) < shortest:
            return doc == item
        spans = [item[j : j + n] for j in range(len(item) - n + 1)]
        return any(sum(x == y for x, y in zip(doc[i : i + n], span, strict=True)) >= n - n * 2 // 13 for i in range(len(doc) - n + 1) for span in spans)

    frame = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id int, text string")
    bench = spark.createDataFrame([(str(i), ", ".join(x)) for i, x in enumerate(items)], "item_id string, text string")
    for shortest in (5, 1):
        want = {(i, str(j)) for i, d in enumerate(docs) for j, x in enumerate(items) if holds(d, x, shortest)}
        got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(frame, bench, shortest).collect()}
        assert set(got) == want and len(want) > 30
    chinese = spark.createDataFrame([(1, "他说春眠不觉晓处处闻啼鸟夜来风雨声。"), (2, "今天天气很好我们去公园散步吧。")], "doc_id int, text string")
    poem = spark.createDataFrame([(1, "春眠不觉晓，处处闻啼鸟。夜来风雨声，花落知多少。")], "item_id int, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(chinese, poem).collect()] == [(1, 1)]


def test_leaking_rows_not_ids(spark):
    passage = " ".join(f"word{i}" for i in range(20))
    rows = [(None, passage), (None, "clean one"), (None, "clean two"), (7, f"see {passage}"), (7, "clean too"), (None, None), (8, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").toDF("doc_id", "text").withColumn("leaking", F.lit(1)).withColumn("a.b", F.lit(2)).withColumn("version", F.lit(3))
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    for broadcast_rows in (100, 0):
        left = decontaminate.drop_leaking(docs, bench, broadcast_rows)
        assert left.columns == docs.columns
        assert sorted((r["doc_id"] or 0, r["text"] or "") for r in left.collect()) == [(0, ""), (0, "clean one"), (0, "clean two"), (7, "clean too")]


def test_decontamination_by_shuffle(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    one = sorted(decontaminate.leaks(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 0)
    assert one and sorted(decontaminate.leaks(docs, bench).collect()) == one
