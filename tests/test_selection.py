"""Medians by counts, snapshots of several sources, and ranges that reach the scan."""

import bisect
import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from stressloom.operators import bars, snapshot
from stressloom.plans import basics, load_catalogue
from stressloom.sources import tables as tb

START = dt.date(2020, 1, 1)


def day(n):
    return START + dt.timedelta(days=n)


def medians(spark, groups, group_rows):
    rows = [(k, dt.datetime(2020, 1, 1), v) for k, values in groups.items() for v in values]
    points = spark.createDataFrame(rows, "symbol string, ts timestamp, price double")
    return {r.symbol: r.price for r in bars.daily_median(points, group_rows).collect()}


@pytest.mark.parametrize("group_rows", [1, 20, 100_000])
def test_median_of_any_values(spark, group_rows):
    rng = random.Random(1)
    groups = {
        "hot": [rng.random() for _ in range(4000)],  # 90 percent of all rows, all different
        "even": [float(i) for i in range(200)], "two": [1.0 + i * 1e-9 for i in range(50)] + [5.0 + i for i in range(50)],
        "wide": [rng.choice([-1, 1]) * 10.0 ** rng.randint(-250, 250) for _ in range(101)], "ties": [3.0] * 70 + [4.0] * 30,
        "half": [3.0] * 50 + [4.0] * 50, "zero": [0.0, -0.0, 1.0], "one": [7.5], "gaps": [None, 2.0, None, 4.0], "none": [None, None],
        "close": [1.0 + i * 2.0**-52 for i in range(99)], "below": [-float(i) for i in range(51)], None: [1.0, 2.0, 9.0],
    }
    got = medians(spark, groups, group_rows)
    assert got.keys() == groups.keys()
    for k, values in groups.items():
        known = [v for v in values if v is not None]
        assert got[k] == (pytest.approx(statistics.median(known), rel=1e-15) if known else None), k


def test_no_task_holds_a_crowded_group(spark):
    """The passes after the first one read less and less of the crowded group, and what is ordered in the end is small."""
    rng = random.Random(2)
    rows = spark.createDataFrame([("a", rng.gauss(0, 1), 1) for _ in range(5000)], "k string, v double, n long")
    plan = bars.weighted_median(rows, ["k"], "v", 100)
    values = sorted(r.v for r in rows.collect())
    assert plan.first().v == pytest.approx((values[2499] + values[2500]) / 2, rel=1e-15)
    ordered = [p for p in plan.inputFiles() if "median-kept" in p]
    assert sum(spark.read.parquet(p).where("_rows <= 100").count() for p in ordered) <= 100


def look_up(obs, ds, s):
    """One source at one date by plain search."""
    obs = sorted((d + dt.timedelta(days=s.lag_days), d, v) for d, v in obs.items() if v is not None)
    i = bisect.bisect_right([o[0] for o in obs], ds)
    before, after = obs[i - 1] if i else None, obs[i] if i < len(obs) else None
    pick = before
    if s.mode == "nearest" and after and (before is None or ds - before[0] > after[0] - ds):
        pick = after
    if pick and s.longest is not None and abs((ds - pick[1]).days) > s.longest or pick and s.mode == "exact" and pick[1] != ds:
        pick = None
    if pick is None:
        return s.default, None, "missing" if s.default is None else "default"
    kind = "exact" if (ds - pick[1]).days == s.lag_days else "nearest" if s.mode == "nearest" else "carried"
    return pick[2], (ds - pick[1]).days, kind


def test_snapshot_equals_plain_search(spark):
    rng = random.Random(3)
    made = {}
    for name in ("tvl", "rate", "today", "news", "price"):
        made[name] = {s: {day(i): rng.choice([None, float(rng.randrange(100))]) for i in rng.sample(range(400), 40)} for s in (["a", "b"] if name != "rate" else [""])}
    frame = lambda x: spark.createDataFrame([(s, d, v) for s, o in made[x].items() for d, v in o.items()], "series_id string, ds date, value double")
    sources = {
        "tvl": snapshot.Source(frame("tvl"), "nearest"), "rate": snapshot.Source(frame("rate").drop("series_id"), "backward", 2, default=3.5, common=True),
        "today": snapshot.Source(frame("today"), "exact"), "news": snapshot.Source(frame("news"), "backward", 1, longest=7),
        "price": snapshot.Source(frame("price"), "nearest", 3, longest=10, default=1.0),
    }
    targets = [(s, day(i)) for s in "ab" for i in range(-20, 440, 3)] + [("c", day(5))]
    got = snapshot.with_notes(snapshot.snapshot(spark.createDataFrame(targets, "series_id string, ds date"), sources), list(sources)).collect()
    assert len(got) == len(targets)
    for r in got:
        for name, s in sources.items():
            obs = made[name].get("" if s.common else r.series_id, {})
            assert (r[name], r[f"{name}_age"], r[f"{name}_quality"]) == look_up(obs, r.ds, s), (name, r)
            assert r.data_quality[name] == r[f"{name}_quality"]


def test_snapshot_of_no_rows(spark):
    none = spark.createDataFrame([], "series_id string, ds date, value double")
    targets = spark.createDataFrame([("a", day(1))], "series_id string, ds date")
    r = snapshot.snapshot(targets, {"x": snapshot.Source(none), "y": snapshot.Source(none, "nearest", default=2.0)}).first()
    assert (r.x, r.x_quality, r.y, r.y_quality) == (None, "missing", 2.0, "default")
    assert snapshot.snapshot(targets.limit(0), {"x": snapshot.Source(none)}).count() == 0
    with pytest.raises(ValueError):
        snapshot.snapshot(targets, {"x": snapshot.Source(none, "next")})


def scans(df):
    """(the plan, the lines of its scans of the fact table)."""
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", 5000)
    plan = df._jdf.queryExecution().executedPlan().toString()
    fact = [x for x in plan.split("\n") if "FileScan parquet" in x and "l_shipdate" in x]
    return plan, fact


def test_event_windows_reach_the_scan(spark, sf):
    _, fact = scans(load_catalogue()["filter_event_window"].build(spark, sf))
    assert len(fact) == 1 and "GreaterThanOrEqual(l_shipdate,1996-0" in fact[0] and "Or(" in fact[0]


def test_ranges_of_months(spark):
    days = spark.createDataFrame([(d,) for d in (day(0), day(20), day(40), day(200), None)], "ds date")
    assert tb.day_ranges(days) == [(day(0), dt.date(2020, 2, 29)), (dt.date(2020, 7, 1), dt.date(2020, 7, 31))]
    assert tb.day_ranges(days, 1) == [(day(0), dt.date(2020, 7, 31))]
    assert tb.day_ranges(days.limit(0)) == []


def test_ranges_keep_whole_days(spark, sf):
    a, b = dt.date(1998, 1, 1), dt.date(1998, 12, 31)
    part = tb.panel(spark, sf, [(a, b)])
    _, fact = scans(part)
    assert len(fact) == 1 and "1998-01-01" in fact[0] and "1999-01-01" in fact[0]
    whole = tb.panel(spark, sf).where(F.col("ds").between(F.lit(a), F.lit(b)))
    assert sorted(map(tuple, part.collect())) == sorted(map(tuple, whole.collect()))


def test_snapshots_are_pruned_by_partition(spark, sf):
    plan, fact = scans(basics.src_snapshot_as_of(spark, sf))
    assert not fact and plan.count("PartitionFilters: [isnotnull(as_of") == 2 and "(as_of" in plan and "Subquery" in plan
