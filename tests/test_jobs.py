"""Jobs that go on where they broke off, statements on a stream, archives by range."""

import zipfile

import pytest
from pyspark.sql import functions as F

from foliospark import queries
from foliospark.folders import folder
from foliospark.operators import bank
from foliospark.plans import batch, jobs
from foliospark.queries import invoices
from foliospark.sources import archives, files, render
from foliospark.streaming import statements

DATA = "/root/testdata/sf0.001"


def counters(spark, at, job):
    r = jobs.status(spark, at, job).first()
    return tuple(r[c] for c in jobs.COUNTERS)


def test_job_over_files(spark, tmp_path, monkeypatch):
    """New files only; a break after results are written leaves no doubles; counters are those of the whole."""
    texts = {r["inv_id"]: r["text"] for r in invoices(spark, DATA).select("inv_id", "text").limit(5).collect()}
    source = tmp_path / "in"
    source.mkdir()
    write = lambda name, data: (source / name).write_bytes(data)
    for i, t in texts.items():
        write(f"{i}.txt", t.encode())
    at, job = str(tmp_path / "jobs"), None
    job = jobs.submit(spark, at, str(source), as_of="2030-01-01")
    assert counters(spark, at, job) == (0, 0, 0, 0, 0)
    jobs.run(spark, at, job, files=3)
    assert counters(spark, at, job)[:3] == (5, 5, 0) and jobs.status(spark, at, job).first()["batches"] == 2
    jobs.run(spark, at, job)
    assert counters(spark, at, job)[0] == 5
    write("broken.txt", b"\xff\xfe\xfa")
    write("scan.pdf", b"%PDF-1.4 scan")
    write("empty.txt", b"")

    class Stop(Exception):
        pass

    def stop(self):
        raise Stop

    with monkeypatch.context() as m:  # results are written, counters are not
        m.setattr(jobs.Observation, "get", property(stop))
        with pytest.raises(Exception, match="Stop"):
            jobs.run(spark, at, job)
    assert jobs.results(spark, at, job).count() == 7 and counters(spark, at, job)[0] == 5
    jobs.run(spark, at, job)
    done = jobs.results(spark, at, job)
    assert done.count() == 7 == done.select("inv_id").distinct().count()
    assert counters(spark, at, job) == tuple(batch.counts(done).first()) and counters(spark, at, job)[:3] == (7, 5, 2)
    assert {r["error"] for r in done.where("error is not null").collect()} == {"not a text", "no text layer"}
    with pytest.raises(ValueError, match="files or records"):
        jobs.submit(spark, at, str(source), "tables")


def test_transactions_within_a_row(spark):
    pages = render.statement_pages(spark.read.parquet(f"{DATA}/events.parquet"))
    odd = ["", None, "01/02/2024", "Opening Balance 5.00\nloose 1.00", "01/02/2024 X 1.00\nmore words\n\n02/02/2024 Closing Balance 3.00\nlost 2.00\n03/02/2024 Y 123456\n1.00 2.00 3.00", "x\n" * 500]
    pages = pages.select("stmt_id", "page", "text").unionByName(spark.createDataFrame([(900 + i, 1, t) for i, t in enumerate(odd)], "stmt_id long, page int, text string"))
    want = bank.transactions(pages, ("stmt_id", "page")).select(*bank.TRANSACTION).collect()
    got = pages.select("stmt_id", "page", F.inline(bank.transactions_in(F.col("text")))).select(*bank.TRANSACTION).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) > 900


def test_statements_on_a_stream(spark, tmp_path):
    """Pages in any order and twice; open ones are known so far, closed ones leave no state."""
    pages = render.statement_pages(spark.read.parquet(f"{DATA}/events.parquet")).select("stmt_id", "page", "text").cache()
    at = str(tmp_path / "stream")
    minute = lambda m: F.timestamp_seconds(F.lit(1_700_000_000 + 60 * m))
    drop = lambda frame, m: frame.withColumn("at", minute(m)).coalesce(1).write.mode("append").parquet(f"{at}/in")
    odd = spark.createDataFrame([(None, 1, "x"), (3, None, "x")], "stmt_id long, page int, text string")
    drop(pages.where("page % 2 = 0").unionByName(odd), 0)
    drop(pages.where("page % 2 = 1 and stmt_id % 2 = 0"), 5)
    drop(pages.where("page % 2 = 1 and stmt_id % 2 = 0"), 6)
    read = lambda: spark.readStream.schema("stmt_id long, page int, text string, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    run = lambda: statements.write(statements.follow(read()), f"{at}/out", f"{at}/checkpoint").awaitTermination()
    same = lambda a, b: sorted(map(str, a.select(*b.columns).collect())) == sorted(map(str, b.collect()))
    run()
    heads, txns = statements.latest(spark, f"{at}/out")
    here = pages.where("page % 2 = 0 or stmt_id % 2 = 0")
    want = bank.statement_of_pages(here)
    assert same(heads, want[0]) and same(txns, want[1]) and heads.where("closed").isEmpty()
    # The other half ends the first one's time; another hour, and a page of some other statement, ends theirs.
    drop(pages.where("page % 2 = 1 and stmt_id % 2 = 1"), 30)
    drop(spark.createDataFrame([(99_999, 1, "nothing")], "stmt_id long, page int, text string"), 200)
    run()
    heads, txns = statements.latest(spark, f"{at}/out")
    want = bank.statement_of_pages(pages)
    assert same(heads.where("stmt_id < 99999"), want[0]) and same(txns, want[1])
    assert {r["stmt_id"] for r in heads.where("not closed").collect()} == {99_999}
    state = spark.read.format("statestore").option("path", f"{at}/checkpoint").option("stateVarName", "until").load()
    assert [r["key"]["stmt_id"] for r in state.select("key").collect()] == [99_999]


def test_archives_by_range(spark, tmp_path):
    top = tmp_path / "zips"
    (top / "deep").mkdir(parents=True)
    with zipfile.ZipFile(top / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(30):
            z.writestr(f"d/{i:02}.pdf", b"%PDF" + bytes([i]) * (1000 * i))
        z.writestr("__MACOSX/x.pdf", b"x")
        z.writestr("d/.hidden.png", b"x")
        z.writestr("notes.txt", b"x")
        z.writestr(zipfile.ZipInfo("e.png"), b"stored", zipfile.ZIP_STORED)
        z.writestr("f.jpg", b"packed" * 100, zipfile.ZIP_BZIP2)
    data = bytearray((top / "a.zip").read_bytes())
    at = data.index(b"d/05.pdf") + 40
    data[at : at + 4] = b"\0\0\0\0"
    (top / "a.zip").write_bytes(data)
    (top / "deep" / "none.zip").write_bytes(b"no zip")
    with zipfile.ZipFile(top / "deep" / "empty.zip", "w") as z:
        z.writestr("notes.txt", b"x")
    cells = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(top)).withColumn("path", F.regexp_replace("path", "^file:", ""))
    for most, most_bytes in ((100, 1 << 20), (20, 9000)):
        want = files.archive_members(cells, most, most_bytes).collect()
        got = archives.members(spark, str(top), most, most_bytes, group_bytes=100)
        assert sorted(map(str, got.collect())) == sorted(map(str, want))
    assert got.rdd.getNumPartitions() >= 10
    assert archives.members(spark, f"file://{top}/a.zip").count() == 32
    (top / "nothing").mkdir()
    assert archives.members(spark, str(top / "nothing")).collect() == []


def test_archive_of_more_than_two_gigabytes(spark, tmp_path):
    path = tmp_path / "big.zip"
    block = bytes(64 << 20)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("first.pdf", b"%PDF first")
        with z.open("scan.tiff", "w", force_zip64=True) as f:
            for _ in range(34):
                f.write(block)
        z.writestr("last.png", b"last")
    try:
        got = {r["member"]: (r["content"], r["error"]) for r in archives.members(spark, str(path)).collect()}
    finally:
        path.unlink()
    assert got["first.pdf"] == (b"%PDF first", None) and got["last.png"] == (b"last", None)
    assert got.get("scan.tiff", (None, "more"))[0] is None


def test_streamed_pages_are_read_by_many_tasks(spark, tmp_path, monkeypatch):
    """No third of all pages is one file, which one task would write and one task read."""
    monkeypatch.setattr(queries, "folder", lambda spark, name: str(tmp_path / name))
    got = queries.bank_statements_streamed(spark, DATA)
    assert len(list((tmp_path / "stream" / "pages").glob("*.parquet"))) > 3
    want = queries.bank_statement_of_pages(spark, DATA)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
