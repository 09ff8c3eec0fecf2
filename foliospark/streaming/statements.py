"""Statements followed page by page: what is known of each after every batch of pages, and its end when no more come.

A page is read within its row: header fields and transactions, by the functions that read whole statements. State keeps what
was read of each page, by its number, and the time until which the statement stays open; every batch emits
the pages so far, in order, whatever order they came in. When event time has passed ``quiet`` after a statement's last
page, a timer emits it for the last time, closed, and its state is gone. ``settle`` turns what was emitted into headers,
transactions with sides by continuity, balances and sums, exactly as a batch of whole statements would be;
``write`` does that for each micro-batch once, under the number of the batch.

Defined results: a page that comes again replaces what was read of it; a page that comes after the end opens its statement anew;
pages without a statement, a number or a time are left out; a page with no text is a page without fields.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from foliospark.operators import bank
from foliospark.ship import ship

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_TXN = "array<struct<seq: int, txn_date: string, description: string, reference_no: string, debit: decimal(18,2), credit: decimal(18,2), balance: decimal(18,2)>>"
_FIELDS = ", ".join(f"{f}: {'decimal(18,2)' if f.endswith('balance') else 'string'}" for f in bank.HEADER)
_PAGE = f"struct<{_FIELDS}, transactions: {_TXN}>"
OUT = "stmt_id long, closed boolean, pages array<struct<page: int, content: string>>"


class _Followed(StatefulProcessor):
    """Pages of one statement by number, and when its time is over."""

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # One value, as every call on state is a round trip to the JVM and every batch emits all pages anyway.
        self.known = handle.getValueState("until", "at long, pages string")

    def _so_far(self, key, pages: dict[int, str], closed: bool) -> Row:
        return Row(stmt_id=key[0], closed=closed, pages=[Row(page=p, content=c) for p, c in sorted(pages.items())])

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.known.get()
        until, pages = (known[0], dict(json.loads(known[1]))) if known else (0, {})
        for r in rows:
            pages[r["page"]] = r["content"]
            until = max(until, r["at_ms"] + self.quiet_ms)
        if not known:
            self.handle.registerTimer(until)
        self.known.update((until, json.dumps(list(pages.items()))))
        yield self._so_far(key, pages, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until, pages = self.known.get()
        if until > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(until)  # pages came since it was set
            return
        yield self._so_far(key, dict(json.loads(pages)), True)
        self.known.clear()

    def close(self) -> None:
        pass


def follow(pages: DataFrame, quiet_minutes: int = 30, late: str = "10 minutes") -> DataFrame:
    """OUT of a stream of pages (stmt_id, page, text, at): pages may come ``late`` after others, by event time ``at``."""
    spark = pages.sparkSession
    ship(spark)
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)  # the only store that keeps timers
    known = pages.where(F.col("stmt_id").isNotNull() & F.col("page").isNotNull() & F.col("at").isNotNull()).withWatermark("at", late)
    texts = known.select(F.col("stmt_id").cast("long").alias("stmt_id"), F.col("page").cast("int").alias("page"), F.coalesce("text", F.lit("")).alias("text"), "at")
    # Texts are slow to read, so they are dealt out by statement first, as the state is, however few files they come in.
    read = bank.header(texts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "stmt_id"))
    content = F.to_json(F.struct(*bank.HEADER, bank.transactions_in(F.col("text")).alias("transactions")))
    rows = read.select("stmt_id", "page", content.alias("content"), F.unix_millis("at").alias("at_ms"), "at")
    return rows.groupBy("stmt_id").transformWithState(statefulProcessor=_Followed(quiet_minutes * 60_000), outputStructType=OUT, outputMode="Update", timeMode="EventTime")


def _parsed(found: DataFrame) -> DataFrame:
    """OUT with the contents of its pages as they were read, in order."""
    read = F.transform(F.sort_array("pages"), lambda p: F.struct(p["page"].alias("page"), F.from_json(p["content"], _PAGE).alias("read")))
    return found.select("stmt_id", "closed", read.alias("pages"))


def _settled(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    first = lambda f: F.get(F.filter(F.transform("pages", lambda p: p["read"][f]), lambda x: x.isNotNull()), F.lit(0))
    head = parsed.select("stmt_id", *[first(f).alias(f) for f in bank.HEADER], F.size("pages").cast("long").alias("pages_processed"))
    pages = parsed.select("stmt_id", first("opening_balance").alias("opening"), F.inline("pages"))
    return bank.whole_statements(head, pages.select("stmt_id", "opening", "page", F.inline("read.transactions")).select(*bank.TRANSACTION, "opening"))


def settle(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(heads, transactions) as ``bank.statement_of_pages`` gives them, of OUT with a row for each statement at most."""
    return _settled(_parsed(found))


def write(found: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run the stream over all that there is: a folder for each micro-batch under path/heads and path/transactions, written once however often the batch is tried."""

    def once(batch: DataFrame, number: int) -> None:
        # A statement that ends in the batch in which its last page came is there twice.
        last = Window.partitionBy("stmt_id").orderBy(F.desc("closed"))
        parsed = _parsed(batch.withColumn("nth", F.row_number().over(last)).where("nth = 1")).persist()
        heads, txns = _settled(parsed)
        txns.persist()  # heads are sums of them
        txns.write.mode("overwrite").parquet(f"{path}/transactions/batch={number}")
        heads.join(parsed.select("stmt_id", "closed"), "stmt_id").write.mode("overwrite").parquet(f"{path}/heads/batch={number}")
        txns.unpersist()
        parsed.unpersist()

    return found.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(once).start()


def latest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(heads, transactions) of each statement as last emitted."""
    heads, txns = (spark.read.option("basePath", f"{path}/{x}").parquet(f"{path}/{x}") for x in ("heads", "transactions"))
    newest = heads.groupBy("stmt_id").agg(F.max("batch").alias("batch"))
    return heads.join(newest, ["stmt_id", "batch"]).drop("batch"), txns.join(newest, ["stmt_id", "batch"]).drop("batch")
