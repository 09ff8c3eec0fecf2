"""Operators 5, 7 and 10 against plain Python, on small documents with nulls, ties, repeats and odd texts."""

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from foliospark.llm import line_dedup, mixing, pii

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
DATA = "/root/testdata/sf0.001"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], SCHEMA)


def find(text):
    spans = []
    for kind, pattern in {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            if kind == "card":
                total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
                if not 14 <= len(digits) <= 19 or total % 10:
                    continue
            spans.append((m.start(), list(pii.PATTERNS).index(kind), kind, m.end()))
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(spans)]


ODD = [
    "", None, "a@b.c%x@d.e", "x@y mail me: a.b+c@d-e.co.uk.", "1.2.3.4.5.6.7.8 999.1.1.1 0001.02.3.4 255.255.255.255",
    "4111 1111 1111 1111 and 4111-1111-1111-1111 or 4111  1111 1111 1111, 4111111111111112", "0" * 14 + " " + "0" * 20, "1 " * 30 + "x" + "0" * 19,
    "call +1 (499) 555-6503 now +44 20 7946 0958. +1.", "é💥 +491234567890é a@b.de💥 4012888888881881", "IBAN DE89 3704 0044 0532 0130 00 ok GB82WEST12345698765432, DE00370400440532013000",
    "7" * 5000, "a" * 5000 + "@", "1." * 3000, "+" * 50 + "1" * 40, "a@b.c@d.e@f.g", "1-2-3 12 34 56 78 90 12 34 56 7",
]


def test_pii_is_the_contract(spark):
    got = {r["doc_id"]: r["pii"] for r in pii.find_pii(docs(spark, [(i, t, "s") for i, t in enumerate(ODD)])).collect()}
    for i, text in enumerate(ODD):
        assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in got[i] if s["kind"] in pii.BASE] == find(text), text
        assert all((text or "")[s["start"] : s["end"]] == s["text"] for s in got[i])
    assert [s["text"] for s in got[10] if s["kind"] == "iban"] == ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"]
    assert [s["score"] for s in got[10] if s["kind"] == "iban"][0] == 1.0


IBANS = {
    "DE89370400440532013000 Please pay": ["DE89370400440532013000"],
    "GB82 WEST 1234 5698 7654 32 Then": ["GB82 WEST 1234 5698 7654 32"],
    "é💥 DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX": ["DE89 3704 0044 0532 0130 00"],
    "NO9386011117947 12 times, BE68 5390 0754 7034 2026 A": ["NO9386011117947", "BE68 5390 0754 7034"],
    "DE89370400440532013000 GB82WEST12345698765432": ["DE89370400440532013000", "GB82WEST12345698765432"],
    "DE00 1234 5678 GB82WEST12345698765432 X": ["GB82WEST12345698765432"],
    "MT84 MALT 0110 0001 2345 MTLC AST0 01S AND MORE WORDS": ["MT84 MALT 0110 0001 2345 MTLC AST0 01S"],
    "DE89370400440532013000please DE893704004405320130001 xDE89370400440532013000": [],
    "ZZ68 5390 0754 7034 Z": [],
}


def test_pii_words_after_an_iban(spark):
    # A country without a set length: any end that passes.
    check = next(f"ZZ{n:02d}539007547034" for n in range(2, 99) if int(f"5390075470343535{n:02d}") % 97 == 1)
    texts = [*IBANS, f"{check} PLEASE 12"]
    for r in pii.find_pii(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect():
        spans = [s for s in r["pii"] if s["kind"] == "iban"]
        assert [s["text"] for s in spans] == IBANS.get(r["text"], [check]), r["text"]
        assert all(r["text"][s["start"] : s["end"]] == s["text"] for s in spans)


def test_pii_on_documents(spark):
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    for r in pii.find_pii(table.withColumn("pii", table.lang)).collect():
        assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["pii"] if s["kind"] in pii.BASE] == find(r["text"])


def dedup(rows):
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(strip))
    held = defaultdict(set)
    for i, text, _ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40 and i is not None:
                held[key(line)].add(i)
    out = []
    for i, text, _ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(held[key(x)]) < 5 or max(held[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def test_line_dedup(spark):
    line, other, short = "This line is shared by a number of documents, 2.", "Ünï" * 14, "short shared line"
    rows = [(i, f"head {i}\n  {line.upper() if i % 2 else line}\t\n{short}\n{other}", "s") for i in range(7)]
    rows += [(3, f"{line}\nanother version", "s"), (6, f"{line}\n{line}", "s"), (None, f"{line}\nnull id", "s"), (None, None, "s"), (20, "", "s"), (21, "\n" * 200 + line, "s"), (22, "x" * 100_000, "s")]
    rows += [rows[2], rows[2]] + [(i, "Only four documents hold this line of their own, all told.", "s") for i in range(30, 34)]
    rows += [(40 + i, "\n".join(f"line {j} of many that are long enough to be counted" for j in range(150)), "s") for i in range(6)]
    frame = docs(spark, rows).withColumn("n_lines", F.lit("clash")).withColumn("_h", F.lit(1))
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in line_dedup.dedup_lines(frame).collect()]
    order = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(got, key=order) == sorted(dedup(rows), key=order)
    assert line_dedup.dedup_lines(docs(spark, [])).collect() == []


def test_line_dedup_streams_in_order(spark):
    """One exchange, by ranges of hash and document, and a sort by position too, that no optimizer takes away."""
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    streamed = line_dedup.streamed(line_dedup.occurrences(table, 40))
    plan = streamed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("Exchange rangepartitioning(h1") == 1
    assert re.search(r"Window \[row_number.*\n.*Sort \[h1#\w+ ASC NULLS FIRST, h2#\w+ ASC NULLS FIRST, doc#\w+ ASC NULLS FIRST, spread#\w+ ASC NULLS FIRST, pos#", plan)
    # A line that all documents hold, with and without ids, lies in several ranges, and no document in two.
    rows = [(i % 700 if i % 3 else None, f"{'x' * 50}\n{i}\n{'x' * 50}") for i in range(4000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = line_dedup.streamed(line_dedup.occurrences(spark.createDataFrame(rows, "doc_id long, text string"), 40)).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r["part"] for r in got}) > 1 and sum(r["first"] for r in got) == len({d for d, _ in rows if d is not None})
    where = defaultdict(set)
    for r in got:
        where[r["doc"]].add(r["part"])
    assert len(where[None]) > 1 and all(len(p) == 1 for d, p in where.items() if d is not None)


def test_line_dedup_by_join_and_bitmap(spark):
    lines = [f"line {j} of those that are shared by all documents here" for j in range(300)]
    rows = [(i, "\n".join(lines[:: i + 1] + [f"own {i}"] * 200 + lines[290:]), "s") for i in range(8)]
    frame = docs(spark, rows)
    found = [sorted((r["doc_id"], r["n_dropped"], r["kept_text"]) for r in line_dedup.dedup_lines(frame, broadcast_docs=n).collect()) for n in (100, 0)]
    assert found[0] == found[1]
    want = {i: (dropped, sha) for i, _, dropped, sha in dedup(rows)}
    for r in line_dedup.dedup_lines(frame).collect():
        assert (r["n_dropped"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) == want[r["doc_id"]]
        listed = {x["word"]: x["bits"] for x in r["keep"] or []}
        text = r["text"].split("\n")
        kept = [x for i, x in enumerate(text) if listed.get(i // 64, -1) >> i % 64 & 1]
        assert "\n".join(kept) == r["kept_text"] and len(listed) <= -(-len(text) // 64)


CLASHING = ["_fs_doc", "_fs_source", "_pii_email", "pii email", "a.b", "own 1", "row_hash", "nth", "of", "version", "words", "spread", "part", "doc", "salt", "again", "leaking"]


def test_clashing_names(spark):
    """Columns named like the operators' own, with a dot, or twice."""
    frame = docs(spark, [(1, "mail a@b.cd", "x"), (None, "some words", None)])
    frame = frame.select("*", *[F.lit(f"own {n}").alias(n) for n in CLASHING], F.lit("twice").alias("n_chars"))
    for done in (line_dedup.dedup_lines(frame), mixing.rates(frame), mixing.mix(frame), pii.find_pii(frame)):
        rows = done.collect()
        assert rows and done.columns[: len(frame.columns)] == frame.columns
        assert all(r[5 + i] == f"own {n}" for r in rows for i, n in enumerate(CLASHING))


def fill(sizes, most=3):
    """Shares by weight, what is over a cap reshared, again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(sizes[s] * most for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        target = {s: sizes[s] * most if s in capped else left * weight[s] / free for s in names}
        if over := {s for s in names if target[s] > sizes[s] * most}:
            capped |= over
        else:
            return target


def test_mixing(spark):
    import random

    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["a", "b", "b", "b", "b", "é", "Z", None])) for i in range(2000)]
    rows += [(3000, None, "none"), (3001, "  \t\n", "none"), (None, "x y", "a")]
    got = mixing.rates(docs(spark, rows)).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = fill(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["size"] * r["copies"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.12 * max(t, 1)
    # Rows without an id, and equal rows, toss coins of their own.
    few = [(i, "w " * 40, "big") for i in range(3000)] + [(None, f"{i} " * 20, "nulls") for i in range(500)] + [(9, "same " * 20, "equal")] * 500 + [(None, "same " * 20, None)] * 500
    for table in (docs(spark, few), docs(spark, few).repartition(7)):
        sums, goal = defaultdict(int), {}
        copies = []
        for r in mixing.rates(table).collect():
            sums[r["source"]] += r["size"] * r["copies"]
            goal[r["source"]] = r["target"]
            copies.append((r["doc_id"] or 0, r["text"], r["source"] or "", r["copies"]))
        assert all(abs(sums[s] - goal[s]) <= 0.12 * goal[s] for s in goal), (sums, goal)
        assert (first := locals().get("first", sorted(copies))) == sorted(copies)
    again = mixing.rates(docs(spark, rows).repartition(7)).collect()
    assert sorted((r["doc_id"] or -1, r["copies"]) for r in got) == sorted((r["doc_id"] or -1, r["copies"]) for r in again)
    mixed = mixing.mix(docs(spark, rows))
    assert mixed.count() == sum(r["copies"] for r in got) and mixed.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert mixing.rates(docs(spark, [])).collect() == []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(mixing, "BROADCAST_SOURCES", 0)
        patch.setattr(mixing, "BROADCAST_REPEATS", 0)
        salted = mixing.rates(docs(spark, rows)).collect()
    assert sorted((r["doc_id"] or -1, r["copies"], r["target"]) for r in got) == sorted((r["doc_id"] or -1, r["copies"], r["target"]) for r in salted)
    # Sources in many ranges take their weights in turn.
    many = mixing.targets(spark.createDataFrame([(f"s{i:03d}", 1000) for i in range(299)] + [(None, 1000)], "source string, source_size long").repartition(5)).orderBy(F.col("source").asc_nulls_last()).collect()
    assert [round(r["target"]) for r in many] == [500, 1000, 1500] * 100
    assert [r["target"] for r in mixing.rates(docs(spark, [(1, None, None)])).collect()] == [0.0]


def test_pii_in_long_texts(spark):
    """Many spans and long stretches between them: positions, texts and words before each as plain Python finds them, in a time that grows with the text."""
    import time

    text = "".join(f"{'é' * (i % 90)} mail{'x' * (i % 60)} a{i}@b.de💥 " for i in range(3000)) + " DE89 3704 0044 0532 0130 00" * 700
    got = pii.find_pii(docs(spark, [(1, text, "s")])).first()["pii"]
    assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in got if s["kind"] in pii.BASE] == find(text)
    assert all(text[s["start"] : s["end"]] == s["text"] for s in got) and sum(s["kind"] == "iban" for s in got) == 700
    near = lambda s: any(w in text[max(0, s["start"] - pii.NEAR) : s["start"]].lower() for w in pii.CONTEXT["email"])
    assert all((s["score"] == 0.7) == near(s) for s in got if s["kind"] == "email")
    began = time.perf_counter()
    many = docs(spark, [(1, " ".join(f"u{i}@b.de" for i in range(100_000)), "s")])
    assert pii.find_pii(many).select(F.size("pii")).first()[0] == 100_000
    assert time.perf_counter() - began < 60
