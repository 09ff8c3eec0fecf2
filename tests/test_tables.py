"""Recognition tables, layout, key and value, retrieval, merging, files and streams."""

import io
import json
import re
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from foliospark import queries
from foliospark.operators import keyvalue, layout, merge, ocr, retrieve
from foliospark.plans import batch
from foliospark.sources import files, render
from foliospark.streaming import events as streams

DATA = "/root/testdata/sf0.001"


def test_waterfall_keeps_good_text(spark):
    rows = [(1, 1, 1, False, 0.8, 9, "a"), (1, 1, 2, True, 0.76, 5, "b"), (2, 1, 1, False, 0.7, 9, "a"), (2, 1, 3, False, 0.7, 9, "c"), (2, 1, 4, True, 0.9, 4, "d")]
    got = {r["doc_id"]: r for r in ocr.waterfall(spark.createDataFrame(rows, "doc_id long, page int, pass int, cleaned boolean, conf double, n_regions int, text string")).collect()}
    assert (got[1]["text"], got[1]["accepted"], got[2]["text"], got[2]["accepted"]) == ("b", True, "d", False)


def test_region_text_and_layer(spark):
    boxes = spark.createDataFrame([(1, 1, 2, "b", 0.5), (1, 1, 1, "a", 1.0), (1, 1, 3, "  ", 0.1)], "doc_id long, page int, seq int, text string, conf double")
    assert tuple(ocr.region_text(boxes).first()) == (1, 1, "a\nb", 0.75, 2)
    pages = spark.createDataFrame([(1, 1, "x" * 60), (1, 2, " "), (2, 1, "short")], "doc_id long, page int, text string")
    assert {r["doc_id"]: r["has_layer"] for r in ocr.text_layer(pages).collect()} == {1: True, 2: False}
    lines = spark.createDataFrame([(1, 2.0), (1, 4.0), (1, 80.0), (2, 0.1)], "doc_id long, angle double")
    assert {r["doc_id"]: r["angle"] for r in ocr.deskew_angle(lines).collect()} == {1: 3.0, 2: 0.0}


def test_rows_follow_the_running_mean(spark):
    words = [(1, 1, i, t, 10.0 * i, y, 10.0 * i + 5, y + 10) for i, (t, y) in enumerate([("a", 0.0), ("b", 4.0), ("c", 8.0), ("d", 30.0)])]
    got = layout.cluster_rows(spark.createDataFrame(words, "doc_id long, page int, word_id int, text string, x1 double, y1 double, x2 double, y2 double")).collect()
    assert {r["text"]: r["row_id"] for r in got} == {"a": 0, "b": 0, "c": 1, "d": 2}


def test_words_of_boxes(spark):
    boxes = spark.createDataFrame([(1, [[1.0, 2.0], [5.0, 2.5], [5.0, 9.0], [0.5, 9.0]])], "doc_id long, pts array<array<double>>")
    assert tuple(layout.words_of_boxes(boxes).first()) == (1, 0.5, 2.0, 5.0, 9.0)


def test_overlapping_columns_share_words(spark):
    rows = spark.createDataFrame([(1, 1, 0, 1, "x", 50.0), (1, 1, 0, 2, "y", 60.0)], "doc_id long, page int, row_id int, word_id int, text string, cx double")
    columns = spark.createDataFrame([(1, 1, "date", 0.0, 55.0), (1, 1, "narration", 40.0, 100.0)], "doc_id long, page int, column string, lo double, hi double")
    assert {r["column"]: r["text"] for r in layout.cells(rows, columns).collect()} == {"date": "x", "narration": "x y"}


def test_region_parse(spark):
    rows = spark.createDataFrame([(1, "table", "01/02/2025 a\nb\n03-02-2025 c"), (1, "header", None)], "doc_id long, label string, text string")
    got = layout.region_parse(rows).first()
    assert got["n_dated_lines"] == 2 and set(got["region_text"]) == {"table", "header"}


def test_labels_misspelt_or_turned_around(spark):
    pairs = spark.createDataFrame([(1, "Invoce Number"), (2, "number invoice"), (3, "Weather"), (4, "Your Grand Total incl. tax")], "doc_id long, label string")
    assert {r["doc_id"]: r["field"] for r in keyvalue.match_labels(pairs).collect()} == {1: "invoice_number", 2: "invoice_number", 4: "total_amount"}


def test_key_values(spark):
    text = "Invoice No: A-1234\nGrand Total\n:\n₹1,500.00\nCustomer Name\nAsha Rao\n\nSubtotal | Total Tax\n1,200.00 | 300.00\nend\nGSTIN 29AABCT1234F1Z5 here"
    got = {r["field"]: r for r in keyvalue.extract(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    assert got["invoice_number"]["value"] == "A-1234" and got["invoice_number"]["conf"] == 0.9
    assert float(got["total_amount"]["amount"]) == 1500.0 and got["total_amount"]["conf"] == 0.85
    assert got["buyer_name"]["value"] == "Asha Rao"
    assert float(got["subtotal"]["amount"]) == 1200.0 and float(got["total_tax"]["amount"]) == 300.0
    assert got["seller_gst"]["value"] == "29AABCT1234F1Z5"


@pytest.mark.parametrize("size", [20, 50, 400])
def test_recursive_chunks(size):
    text = "\n\n".join(" ".join(f"word{i}x{j}" for j in range(i % 40)) for i in range(60)) + "\n" + "z" * 130
    pieces = retrieve.split_recursively(text, size, size // 6)
    assert all(0 < len(p) <= size for p in pieces)
    assert set("".join(pieces).split()) and all(any(w in p for p in pieces) for w in text.split() if len(w) <= size // 2)
    assert retrieve.split_recursively("", size) == []


def by_definition(text, size, overlap, separators=("\n\n", "\n", " ", "")):
    """Recursive splitting spelled out over strings: separators begin the pieces, small ones are joined up to size, large ones cut by finer ones."""
    level = next(i for i, s in enumerate(separators) if s == "" or s in text)
    separator, finer = separators[level], separators[level + 1 :]
    parts = re.split(f"({re.escape(separator)})", text) if separator else list(text)
    pieces = [p for p in ([parts[0]] + [a + b for a, b in zip(parts[1::2], parts[2::2], strict=True)] if separator else parts) if p]
    out, small = [], []

    def join():
        held, total = [], 0
        for p in small:
            if held and total + len(p) > size:
                out.append("".join(held).strip())
                while held and (total > overlap or total + len(p) > size):
                    total -= len(held.pop(0))
            held.append(p)
            total += len(p)
        out.append("".join(held).strip())
        small.clear()

    for p in pieces:
        if len(p) < size:
            small.append(p)
            continue
        if small:
            join()
        out.extend(by_definition(p, size, overlap, finer) if finer else [p.strip()])
    if small:
        join()
    return [x for x in out if x]


@pytest.mark.parametrize(("size", "overlap"), [(10, 0), (25, 8), (60, 20), (400, 60)])
def test_recursive_chunks_by_definition(spark, size, overlap):
    import random

    rng = random.Random(size)
    odd = ["", " ", "\n\n\n\n", "a" * 1000, "a b", "\n\nx\n\n\ny z", "word " * 300, "e\u0301" * 200, "one\n\n" * 90]
    odd += ["".join(rng.choice(["a", "bc", " ", " ", "\n", "\n\n", "long" * 9]) for _ in range(rng.randrange(200))) for _ in range(200)]
    odd += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r["text"]]
    for text in odd:
        assert retrieve.split_recursively(text, size, overlap) == (by_definition(text, size, overlap) if text else []), text[:80]
    assert retrieve.split_recursively("first part\n\nsecond one", 14, 4) == ["first part", "second one"]
    assert retrieve.split_recursively("aa bb cc dd", 6, 3) == ["aa bb", "bb cc", "cc dd"]


def test_nearest_in_blocks(spark, monkeypatch):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    once = sorted(retrieve.top_k(asked, vectors).select("query_id", "rank", "vec_id", "score").collect())
    monkeypatch.setattr(retrieve, "TOGETHER", 4)
    monkeypatch.setattr(retrieve, "GROUP", 90)
    assert sorted(retrieve.top_k(asked, vectors).select("query_id", "rank", "vec_id", "score").collect()) == once


def test_nearest_odd_vectors(spark):
    """Copies go by id; pairs without a score come last; no join makes every pair a row."""
    rows = [(0, [1.0, 2.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [1.0, 2.0, 3.0]), (5, [-1.0, 0.5]), *[(i, [0.1, 0.2]) for i in range(6, 12)]]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = vectors.where("vec_id in (1, 2, 4, 5, 6)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    found = retrieve.top_k(asked, vectors, 9)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], None if r["score"] is None else round(r["score"], 6)))
    unscored = [(i, None) for i in range(9)]
    assert got[1] == got[2] == unscored
    assert got[4] == [(4, 1.0), *[(i, None) for i in (0, 1, 2, 3, 5, 6, 7, 8)]]
    assert {s for _, s in got[6][:7]} == {1.0} and [i for i, _ in got[6][:7] if i] == list(range(6, 12))
    assert got[6][7:] == [(5, 0.0), (1, None)]
    assert got[5] == [(5, 1.0), *got[5][1:8], (1, None)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_answers(spark):
    q = spark.createDataFrame([("How much is it?",), ("what is the GST number",), ("hello",)], "q string")
    facts = {"total_amount": F.lit(12.5), "seller_gst": F.lit(None)}
    got = [r[0] for r in q.select(retrieve.answer(F.col("q"), facts, F.lit("passage " * 200))).collect()]
    assert got[0] == "12.5" and got[1] == "N/A" and len(got[2]) == 600


def test_model_responses_and_fallback(spark):
    found = spark.createDataFrame([(1, "", None, 3), (2, "B", 5.0, 9)], "id long, name string, amount double, fields int")
    seen = []

    def expensive(rows):
        seen.append([r["id"] for r in rows.collect()])
        return rows.select("id", F.lit("from model").alias("name"), F.lit(7.0).alias("amount"))

    got = merge.with_fallback(found, F.col("fields") < 4, expensive, "id", ("name", "amount")).orderBy("id").collect()
    assert seen == [[1]] and [tuple(r) for r in got] == [(1, "from model", 7.0, 3), (2, "B", 5.0, 9)]
    broken = spark.createDataFrame([("no json",), ('{"total": "₹1,200.50"} {"x": 1}',)], "r string")
    assert [str(r[0]) for r in broken.select(merge.parse_response(F.col("r"), ("total_amount",))["total_amount"]).collect()] == ["None", "1200.50"]
    line = json.loads(spark.range(1).select(merge.training_sample("do", F.lit("x" * 3000), F.lit("{}"))).first()[0])
    assert len(line["input"]) == 2500 and line["instruction"] == "do"


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.PNG").write_bytes(b"x")
    (tmp_path / "c.bin").write_bytes(b"%PDF")
    got = {r["path"].rsplit("/", 1)[-1]: r["content_type"] for r in files.uploads(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": "application/pdf", "b.PNG": "image/png", "c.bin": "application/pdf"}
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name in ["x/1.pdf", "__MACOSX/1.pdf", ".hidden.png", "note.txt", *[f"{i}.jpg" for i in range(30)]]:
            z.writestr(name, b"1")
    members = files.archive_members(spark.createDataFrame([("good", data.getvalue()), ("bad", b"nope"), ("none", None)], "path string, content binary")).collect()
    good = [r for r in members if r["path"] == "good"]
    assert sum(r["error"] is None for r in good) == 20 and sum(r["error"] == "more than 20 files" and r["content"] is None for r in good) == 11
    assert {r["error"] for r in members if r["path"] != "good"} == {"not a zip file"}
    short = files.archive_members(spark.createDataFrame([("good", data.getvalue())], "path string, content binary"), most=3, most_bytes=0).collect()
    assert [r["error"] for r in short[:4]] == ["more than 0 bytes"] * 3 + ["more than 3 files"]
    (tmp_path / "t.jsonl").write_text('{"instruction": "a", "input": "b", "output": "c"}\n\nnot json\n')
    assert [tuple(r) for r in files.training_lines(spark, str(tmp_path / "t.jsonl")).collect()] == [("a", "b", "c")]


def test_history_and_report(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Invoice Number: A-12345\nGrand Total: 5.00", None), (2, None, None), (3, "x", "cannot be read")], "inv_id long, text string, error string")
    done = batch.process(docs, "2026-01-01")
    assert {r["inv_id"]: (r["status"], r["error"]) for r in done.collect()} == {1: ("partial", None), 2: ("failed", "no text"), 3: ("failed", "cannot be read")}
    for run in ("a", "b"):
        batch.append_history(done, str(tmp_path / "runs"), run)
    assert batch.history(spark, str(tmp_path / "runs")).count() == 6 and batch.history(spark, str(tmp_path / "runs"), "a").count() == 3
    shown = {r["inv_id"]: r for r in batch.report(done.withColumn("seconds", F.lit(1.234)), "inv_id").collect()}
    assert len(shown[1]) == 40 and shown[1]["Invoice Number"] == "A-12345" and shown[1]["Processing Time (s)"] == "1.23" and shown[1]["OCR Engine"] == "" and shown[1]["Validated"] == "Yes" and shown[1]["Confidence %"].endswith("%")


def test_regions_of_an_invoice(spark):
    found = spark.createDataFrame([(1, "header", 0.1, [0.0]), (1, "table", 0.9, [0.0])], "doc_id long, label string, conf double, bbox array<double>")
    bands = spark.createDataFrame([(1, x, 0.6, [1.0]) for x in ("header", "table", "footer")], "doc_id long, label string, conf double, bbox array<double>")
    got = {(r["label"], r["conf"], r["src"]) for r in layout.merge_regions_of_invoice(found, bands).collect()}
    assert got == {("header", 0.1, "detected"), ("table", 0.9, "detected"), ("footer (heuristic fallback)", 0.5, "heuristic")}
    read = spark.createDataFrame([(1, "header", "HDFC statement\nAccount No: 5010 0123 4567"), (1, "table", "01/02/2024 x\n02-02-24 y\nz"), (2, "table", None)], "doc_id long, label string, text string")
    rows = {r["doc_id"]: r for r in layout.region_parse(read).collect()}
    assert (rows[1]["bank"], rows[1]["account"], rows[1]["n_dated_lines"]) == ("HDFC Bank", "501001234567", 2) and rows[2]["bank"] is None


def test_export(spark, tmp_path):
    frame = spark.createDataFrame([(1, "amazon", 'a, "quoted"\nname', 12.5), (2, None, None, None)], "inv_id long, platform string, seller_name string, total_amount double")
    batch.write_csv(frame, str(tmp_path / "out"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "out")).orderBy("platform").collect()
    assert len(back[0]) == 36 and {r["seller_name"] for r in back} == {'a, "quoted"\nname', None}
    assert {(r["field"], r["value"]) for r in batch.field_values(frame).where("inv_id = 1").collect()} == {("platform", "amazon"), ("seller_name", 'a, "quoted"\nname'), ("total_amount", "12.5")}
    assert json.loads(batch.as_json(frame).where("value like '%amazon%'").first()[0])["total_amount"] == 12.5
    counted = batch.counts(spark.createDataFrame([("success", None), ("partial", None), (None, "broken")], "status string, error string")).first()
    assert tuple(counted) == (3, 2, 1, 1, 1)


def test_stream_of_pages(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").where("user_id < 6")
    lines = render.statements(events).select("stmt_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    pages = lines.where("pos < 8").select("stmt_id", F.col("pos").alias("page"), "text")
    pages.where("page < 4").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(pages.schema).parquet(str(tmp_path / "in"))
    query = streams.fold_pages(stream).writeStream.format("memory").queryName("heads").outputMode("update").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
        pages.where("page >= 4").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query.processAllAvailable()
    finally:
        query.stop()
    got = spark.sql("SELECT stmt_id, max_by(struct(*), pages) AS r FROM heads GROUP BY stmt_id").collect()
    assert got and all(r["r"]["pages"] == 8 and r["r"]["ifsc_code"] and r["r"]["account_number"] and r["r"]["period_to"] for r in got)


def test_stream_windows(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = streams.per_window(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    want = streams.per_window(events).toPandas().sort_values(["start", "event_type"]).reset_index(drop=True)
    got = spark.table("hours").toPandas().sort_values(["start", "event_type"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want)


def test_passage_index(spark, tmp_path):
    from foliospark.plans import index

    passages = retrieve.chunks_fixed(spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 40"))
    path = str(tmp_path / "passages")
    index.write(passages, path)
    n, of7 = passages.count(), passages.where("doc_id = 7").count()
    assert index.load(spark, path).count() == n and index.load(spark, path, 7).count() == of7 > 0
    index.clear(spark, path, 7)
    assert index.load(spark, path).count() == n - of7 and index.load(spark, path, 7).count() == 0
    assert index.platforms(spark).count() == 10


def test_long_texts_of_labels(spark):
    """A hundred thousand lines in one text: as many pairs, in seconds."""
    import time

    n = 100_000
    labelled = spark.createDataFrame([(1, "\n".join(f"Invoice No: {i}" for i in range(n)))], "doc_id long, text string")
    tables = spark.createDataFrame([(1, "\n".join("Invoice No | Order No" if i % 2 else f"a{i} | b{i}" for i in range(n)))], "doc_id long, text string")
    keyvalue.label_values(labelled.limit(0)).count()
    began = time.perf_counter()
    assert keyvalue.label_values(labelled).count() == n
    assert keyvalue.by_table(tables).count() == n - 2
    assert time.perf_counter() - began < 30


def test_sentences_of_both_forms(spark):
    questions = ["What is the GRAND TOTAL?", "grand sum of the total", "total amount", "invoice number please", "gstin", "who sold it", "it was sold by whom", "tax", "what date", "payment", "", None]
    rows = spark.createDataFrame([(i, q) for i, q in enumerate(questions)], "i int, q string")
    facts = {"platform": F.lit("shop"), "total_amount": F.lit("12.50"), "seller_name": F.lit("S"), "total_tax": F.lit(None).cast("string"), "cgst_amount": F.lit("1.00")}
    forms = retrieve.sentence(F.col("q"), facts), retrieve.sentence(F.col("q"), facts, retrieve.PAGE_SENTENCES, retrieve.PAGE_KNOWN, "None")
    got = [tuple(r) for r in rows.orderBy("i").select(*forms).collect()]
    total, seller = "The total amount is ₹12.50.", "The seller is S."
    known = "Here's what I know:\n• Platform: shop\n• Total: ₹12.50\n• Date: not found\n• Seller: S\n\n", "Based on the extracted data, here's what I know:\n\n- Platform: shop\n- Total: ₹12.50\n- Date: None\n- Seller: S\n\n"
    told = lambda k: tuple(a.startswith(b) for a, b in zip(got[k], known, strict=True))
    assert got[0] == got[2] == (total, total)
    assert got[1][0] == total and told(1) == (False, True)
    assert got[5][0] == seller and told(5) == (False, True) and got[6] == (seller, seller)
    same = ["The invoice number is not found.", "The seller GSTIN is not found.", "Tax breakdown: CGST ₹1.00, SGST ₹N/A, IGST ₹N/A, Total Tax ₹N/A.", "The invoice date is not found.", "Payment method: not found."]
    assert [got[k] for k in (3, 4, 7, 8, 9)] == [(s, s) for s in same]
    assert told(10) == told(11) == (True, True)


def test_words_are_dealt_out_once(spark):
    """Rows, columns and cells of a page come of one reading of its words, and are those of the steps one by one."""
    words = [(1, p, 10 * r + i, t, x, 50.0 * r, x + 40.0, 50.0 * r + 16) for p, top in ((0, "Date Narration Debit Credit Balance"), (1, ""), (2, "")) for r, line in enumerate([top, "01/01/2024 UPI 5.00 x 95.00", "02/01/2024 UPI x 7.00 102.00"])
             for i, (t, x) in enumerate(zip(line.split() if p < 2 else line.replace(".", "").split(), (20.0, 140.0, 430.0, 550.0, 690.0)))]
    words += [(None, 0, 1, "01/01/2024", 20.0, 0.0, 60.0, 16.0), (1, None, 1, "01/01/2024", 20.0, 0.0, 60.0, 16.0), (2, 0, 1, None, 20.0, 0.0, 60.0, 16.0), (2, 0, 2, "3/4", 20.0, 0.0, 60.0, 16.0)]
    frame = spark.createDataFrame(words, "doc_id long, page int, word_id int, text string, x1 double, y1 double, x2 double, y2 double")
    rows = layout.cluster_rows(frame)
    want = layout.transactions_of_cells(layout.cells(rows, layout.columns_of_pages(rows, 800.0)))
    got = layout.transactions_of_words(frame, 800.0)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 7
    plan = queries.words_to_cells_range_join(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "Join" not in plan
