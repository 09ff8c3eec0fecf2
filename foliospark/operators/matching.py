"""Payments matched to invoices one to one, and points to the intervals that hold them.

Payments and invoices of an amount lie on a line of days, where all rows of an amount, a day and a kind are alike. So it is
settled by numbers of rows how many of a day go with how many of which other day: a row for each amount and day, however many
invoices and payments there are. Rows, numbered along the line by ranges, look up with which day and in which place they
go, and meet their partner by that: one join on equal values, with no key shared by more than two rows. An amount
that a third of all rows have lies in many tasks.

Intervals are put into bins as wide as they are themselves (by powers of two), two at most each; a point meets the bin
that it is in at each width that occurs. So long intervals cost no more than short ones, and the join is on equal values.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.operators.scans import ranged
from foliospark.ship import ship

DAYS = 10


def _shares(counts: DataFrame, days: int) -> DataFrame:
    """(amount, day, kind, shares) of counts (amount, day, kind, n): how many go with the other kind of which day.

    shares: array<struct<bill_day, step, first, n>>, n rows from the row ``first`` on go with those of the other kind, step days
    after bill_day. Only numbers of rows are dealt, a stretch of days of an amount at a time: days that lie more than ``days``
    apart have nothing in common, so the line of an amount is cut there.
    """
    sides = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(name) for k, name in ((0, "bills"), (1, "payments"))]
    daily = counts.groupBy("amount", F.unix_date("day").alias("day")).agg(*sides)
    ship(counts.sparkSession)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["amount", "day", "kind", "bill_day", "step", "first", "n"]
        held, last, out = {}, None, []
        for batch in batches:
            for amount, day, bills, payments in zip(batch["amount"], batch["day"], batch["bills"], batch["payments"], strict=True):
                if last and (amount != last[0] or day - last[1] > days):
                    out += [(last[0], *share) for share in _dealt(held, days)]
                    held = {}
                held[day], last = [bills, payments], (amount, day)
            if out:
                yield pd.DataFrame(out, columns=columns)
                out = []
        if last:
            yield pd.DataFrame([(last[0], *share) for share in _dealt(held, days)], columns=columns)

    amount = counts.schema["amount"].dataType.simpleString()
    dealt = daily.repartition("amount").sortWithinPartitions("amount", "day").mapInPandas(deal, f"amount {amount}, day int, kind int, bill_day int, step int, first long, n long")
    shares = dealt.groupBy("amount", "day", "kind").agg(F.collect_list(F.struct(F.date_from_unix_date("bill_day").alias("bill_day"), "step", "first", "n")).alias("shares"))
    return shares.withColumn("day", F.date_from_unix_date("day"))


def _dealt(left: dict[int, list[int]], days: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(day, kind, bill_day, step, first, n) of the numbers of invoices and payments of each day of a stretch, which it uses up."""
    taken = {day: [0, 0] for day in left}
    within = lambda kind, day: sum(left[d][1 - kind] for d in range(day - days, day + days + 1) if d in left)
    for apart in range(days + 1):
        pairs = [(d, d + step) for d in left for step in {-apart, apart} if left[d][0] and d + step in left and left[d + step][1]]
        # Those that have the fewest others to go with come first, so that more are matched.
        for _, bill, payment in sorted((within(0, d) + within(1, e), d, e) for d, e in pairs):
            if n := min(left[bill][0], left[payment][1]):
                for kind, day in ((0, bill), (1, payment)):
                    yield day, kind, bill, payment - bill, taken[day][kind], n
                    taken[day][kind] += n
                    left[day][kind] -= n


def match_payments(invoices: DataFrame, payments: DataFrame, days: int = DAYS) -> DataFrame:
    """(inv_id, pay_id, amount, days_apart) of invoices (inv_id, amount, day) and payments (pay_id, amount, day): a full outer match.

    Equal amounts; of one day first, in order of ids; then those a day apart, two days, and so on up to ``days``. Of as many days
    apart, those go first that have the fewest others within ``days``, then earlier ones. What finds nothing has null on the
    other side; nothing is matched twice. Rows without an amount or a day are never matched. Ids are taken as integers.
    """
    amount = F.col("amount").cast("decimal(18,2)").alias("amount")
    sides = [f.select(amount, F.col("day").cast("date").alias("day"), F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id")) for f, key, kind in ((invoices, "inv_id", 0), (payments, "pay_id", 1))]
    rows = sides[0].unionByName(sides[1])
    on_line = F.col("amount").isNotNull() & F.col("day").isNotNull()
    # The rows of an amount, a day and a kind are numbered along the line by ids.
    placed = ranged(rows.where(on_line), ("amount",), ("day", "kind", "id"))
    keys = ["amount", "day", "kind"]
    starts = placed.groupBy(*keys, "_part").agg(F.min("_place").alias("at"), F.count("*").alias("n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    skipped = starts.select(*keys, "_part", "at", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("skipped"))
    nth = placed.join(skipped, [*keys, "_part"]).select(*keys, "id", (F.col("_place") - F.col("at") + F.col("skipped")).alias("nth"))

    shares = _shares(starts.groupBy(*keys).agg(F.sum("n").alias("n")), days)
    # Each row falls into one share of its amount, day and kind, or into none; the two sides of a share go together in order.
    dealt = nth.join(shares, keys, "left").withColumn("share", F.try_element_at(F.filter("shares", lambda x: (x["first"] <= F.col("nth")) & (F.col("nth") < x["first"] + x["n"])), F.lit(1)))
    dealt = dealt.select("amount", "kind", "id", F.col("share.bill_day").alias("bill_day"), F.col("share.step").alias("step"), (F.col("nth") - F.col("share.first")).alias("place"))
    loose = rows.where(~on_line).select("amount", "kind", "id", *[F.lit(None).cast(t).alias(c) for c, t in (("bill_day", "date"), ("step", "int"), ("place", "long"))])
    whole, pair = dealt.unionByName(loose), ["amount", "bill_day", "step", "place"]
    side = lambda kind, name: whole.where(F.col("kind") == kind).select(*pair, F.col("id").alias(name))
    # Nulls of what has no share are equal to nothing, so such rows stay alone.
    return side(0, "inv_id").join(side(1, "pay_id"), pair, "full").select("inv_id", "pay_id", "amount", F.when(F.col("inv_id").isNotNull() & F.col("pay_id").isNotNull(), F.abs("step")).alias("days_apart"))


def in_intervals(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Columns of both for each point (keys, at) in an interval (keys, start, end): start <= at < end, times of the same keys.

    Other columns must differ in name. Empty and reversed intervals hold nothing, and null times lie in none.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    some = intervals.where(F.col(start) < F.col(end))
    # An interval of up to 2 ** level microseconds touches two bins of that width at most.
    level = F.ceil(F.log2((micros(end) - micros(start)).cast("double"))).cast("int")
    width = lambda n: F.pow(F.lit(2.0), n).cast("long")
    bin_of = lambda x, n: F.floor(x / width(n)).cast("long")
    sized = some.withColumn("_level", level)
    binned = sized.withColumn("_bin", F.explode(F.array_distinct(F.array(bin_of(micros(start), F.col("_level")), bin_of(micros(end) - 1, F.col("_level"))))))
    # At most 63.
    levels = [r["_level"] for r in sized.select("_level").distinct().collect()]
    spread = points.where(F.col(at).isNotNull()).withColumn("_level", F.explode(F.array(*[F.lit(n) for n in levels]) if levels else F.array().cast("array<int>")))
    spread = spread.withColumn("_bin", bin_of(micros(at), F.col("_level")))
    met = spread.join(binned, [*keys, "_level", "_bin"])
    return met.where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_level", "_bin")
