"""Joins and frames along time, matching, intervals and sketches, against plain Python."""

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from foliospark.operators import matching, scans, sketches

DAY = dt.date(2024, 1, 1)
at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small tables in as many ranges as large ones."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("hot", [False, True])
def test_as_of_and_rolling(spark, hot):
    """Keys over many ranges, ties, nulls in keys, times and values."""
    rng = random.Random(2)
    n, keys = (3000, [1]) if hot else (300, [1, 2, None])
    left = [(i, rng.choice(keys), rng.choice([None, at(rng.randrange(600))]) if i % 20 == 0 else at(rng.randrange(600)), rng.choice([None, 1, 2, 5])) for i in range(n)]
    right = [(rng.choice(keys), at(rng.randrange(0, 600, 7)), rng.randrange(100)) for _ in range(n // 3)] + [(1, None, 5)]
    a, b = spark.createDataFrame(left, "id int, k int, t timestamp, x int"), spark.createDataFrame(right, "k int, t timestamp, v int")
    for strict in (False, True):
        got = {r["id"]: r["v"] for r in scans.as_of(a, b, ("k",), "t", ("v",), strict).collect()}
        for i, k, t, _ in left:
            fits = [(u, v) for kk, u, v in right if t and u and kk == k and (u < t or (u == t and not strict))]
            assert got[i] == (max(fits)[1] if fits else None), (i, strict)
    rolled = scans.rolling_sum(a, ("k",), "t", "x", "30 minutes", "sum")
    assert rolled.columns == ["id", "k", "t", "x", "sum"]
    got = {r["id"]: r["sum"] for r in rolled.collect()}
    for i, k, t, _ in left:
        assert got[i] == (sum(x or 0 for _, kk, u, x in left if u and kk == k and t - dt.timedelta(minutes=30) <= u <= t) if t else None)
    assert len(got) == n
    placed = scans.ranged(a.where("t is not null"), ("k",), ("t",))
    assert placed.select("_part").distinct().count() > 1
    assert scans.as_of(a.limit(0), b, ("k",), "t", ("v",)).collect() == []
    assert {r["v"] for r in scans.as_of(a, b.limit(0), ("k",), "t", ("v",)).collect()} == {None}


def test_payments_to_invoices(spark):
    rng = random.Random(9)
    day = lambda: rng.choice([DAY + dt.timedelta(days=rng.randrange(60))] * 19 + [None])
    bills = [(i, rng.choice([10, 10, 10, 20, 30, None]), day()) for i in range(140)]
    paid = [(i + 1000, rng.choice([10, 10, 20, 20, 40]), day()) for i in range(120)]
    owed = spark.createDataFrame(bills, "inv_id long, amount int, day date")
    came = spark.createDataFrame(paid, "pay_id long, amount int, day date")
    rows = matching.match_payments(owed, came, days=4).collect()
    got = {(r["inv_id"], r["pay_id"]): r["days_apart"] for r in rows if r["inv_id"] is not None and r["pay_id"] is not None}
    by_inv, by_pay = {i: n for (i, _), n in got.items()}, {p: n for (_, p), n in got.items()}
    of, far, same = {p: (a, d) for p, a, d in paid}, 10**6, defaultdict(lambda: ([], []))
    assert all(of[p][0] == a and abs((of[p][1] - d).days) == got[i, p] for i, a, d in bills for p in of if (i, p) in got) and len(got) > 60
    for i, a, d in bills:
        for p, b, e in paid:
            if a is not None and a == b and d and e and abs((d - e).days) <= 4:
                # No two that would both be nearer to each other, and none left alone that could be matched.
                assert not (abs((d - e).days) < by_inv.get(i, far) and abs((d - e).days) < by_pay.get(p, far)), (i, p)
    for side, items in enumerate((bills, paid)):
        for i, a, d in items:
            if a is not None and d:
                same[a, d][side].append(i)
    for left, right in same.values():
        assert all(got[pair] == 0 for pair in zip(sorted(left), sorted(right), strict=False))
    assert Counter(r["inv_id"] for r in rows if r["inv_id"] is not None) == Counter(i for i, _, _ in bills)
    assert Counter(r["pay_id"] for r in rows if r["pay_id"] is not None) == Counter(i for i, _, _ in paid)
    assert {r["inv_id"] for r in matching.match_payments(owed, came.limit(0)).collect()} == {i for i, _, _ in bills}


def test_payments_on_busy_days(spark):
    """Many rows of two days next to each other: the number of jobs does not grow with them."""
    day = DAY
    owed = spark.range(300).select(F.col("id").alias("inv_id"), F.lit(5).alias("amount"), F.lit(day).alias("day"))
    came = spark.range(280).select(F.col("id").alias("pay_id"), F.lit(5).alias("amount"), F.date_add(F.lit(day), F.when(F.col("id") < 200, 1).otherwise(-2)).alias("day"))
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    rows = matching.match_payments(owed, came).collect()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before < 40
    assert Counter(r["days_apart"] for r in rows) == {1: 200, 2: 80, None: 20}
    assert sorted(r["inv_id"] for r in rows) == list(range(300)) and sorted(r["pay_id"] for r in rows if r["pay_id"] is not None) == list(range(280))


def test_intervals(spark):
    rng = random.Random(4)
    points = [(i, rng.choice([1, 2, None]), at(rng.randrange(2000)) if i % 10 else None) for i in range(200)]
    spans = []
    for i in range(60):
        start = rng.randrange(-100, 2000)
        spans.append((i, rng.choice([1, 2, None]), at(start), at(start + rng.choice([-5, 0, 1, 3, 60, 100_000]))))
    spans += [(98, 1, None, at(5)), (99, 1, at(5), None)]
    p = spark.createDataFrame(points, "p int, k int, t timestamp")
    s = spark.createDataFrame(spans, "s int, k int, a timestamp, b timestamp")
    holds = lambda t, a, b: t and a and b and a <= t < b
    keyed = matching.in_intervals(p, s, "t", "a", "b", ("k",))
    assert {(r["p"], r["s"]) for r in keyed.collect()} == {(i, j) for i, k, t in points for j, kk, a, b in spans if k is not None and k == kk and holds(t, a, b)}
    free = matching.in_intervals(p.drop("k"), s.drop("k"), "t", "a", "b")
    assert Counter((r["p"], r["s"]) for r in free.collect()) == Counter((i, j) for i, _, t in points for j, _, a, b in spans if holds(t, a, b))
    plan = free._sc._jvm.PythonSQLUtils.explainString(free._jdf.queryExecution(), "formatted")
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert matching.in_intervals(p, s.limit(0), "t", "a", "b", ("k",)).collect() == []


def test_sketches_merge(spark):
    rows = spark.range(200_000).select(
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 10).alias("ts"), (F.col("id") % 2).alias("g"), F.pmod(F.xxhash64("id"), F.lit(50_000)).alias("user"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10_000)).cast("double").alias("value")
    )
    rows = rows.unionByName(spark.createDataFrame([(None, None, None, None)], "ts timestamp, g long, user long, value double"))
    daily = sketches.daily(rows, "ts", ("g",), "user", "value")
    assert daily.where("day is not null").count() > 40
    by_group = {r["g"]: r for r in sketches.answers(sketches.merged(daily, "g"), "g").collect()}
    exact = {r["g"]: r for r in rows.groupBy("g").agg(F.count("*").alias("n"), F.countDistinct("user").alias("d"), F.expr("percentile(value, array(0.5D, 0.9D, 0.99D))").alias("q")).collect()}
    for g in (0, 1):
        assert by_group[g]["n"] == exact[g]["n"] and abs(by_group[g]["distinct"] / exact[g]["d"] - 1) < 0.05
        for name, want in zip(("q50", "q90", "q99"), exact[g]["q"], strict=True):
            assert abs(by_group[g][name] - want) < 0.03 * 10_000
    assert (by_group[None]["n"], by_group[None]["distinct"], by_group[None]["q50"]) == (1, 0, None)
