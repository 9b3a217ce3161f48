import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import days, series
from stressloom.operators import asof, calendar
from stressloom.operators import eventjoin as ev

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def sides(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    at = lambda: T0 + dt.timedelta(seconds=int(rng.integers(0, 5 * 86400)))
    key = lambda: "hot" if rng.random() < 0.4 else f"k{rng.integers(0, 4)}"
    left = [(i, key(), at()) for i in range(n)]
    right = [(key(), at(), None if rng.random() < 0.1 else float(i)) for i in range(n // 2)]
    return left, right


def brute(left, right, how):
    out = {}
    for i, k, t in left:
        c = [(rt, v) for rk, rt, v in right if rk == k and v is not None]
        if how == "backward":
            c = [x for x in c if x[0] <= t]
            out[i] = max(c, key=lambda x: (x[0], x[1]))[1] if c else None
        else:
            out[i] = min(c, key=lambda x: (abs((x[0] - t).total_seconds()), x[0]))[1] if c else None
    return out


@pytest.mark.parametrize("how", ["backward", "nearest"])
@pytest.mark.parametrize("bucket,rows", [(3600, 10**6), (86400, 10**6), (86400, 7)])
def test_asof_equals_brute_force(spark, how, bucket, rows):
    left, right = sides(spark)
    l = spark.createDataFrame(left, "i int, k string, t timestamp")
    r = spark.createDataFrame(right, "k string, rt timestamp, v double")
    f = asof.backward if how == "backward" else asof.nearest
    got = {x["i"]: x["o"] for x in f(l, r, ["k"], "t", "rt", "v", "o", bucket_seconds=bucket, bucket_rows=rows).collect()}
    assert got == brute(left, right, how)


def test_lag_hides_unpublished_values(spark):
    l = spark.createDataFrame([("s", T0 + dt.timedelta(hours=10))], "k string, t timestamp")
    r = spark.createDataFrame([("s", T0, 1.0), ("s", T0 + dt.timedelta(hours=6), 2.0)], "k string, rt timestamp, v double")
    assert asof.lagged(l, r, ["k"], "t", "rt", "v", "o", F.lit(6)).first()["o"] == 1.0
    assert asof.lagged(l, r, ["k"], "t", "rt", "v", "o", F.lit(4)).first()["o"] == 2.0


def test_calendar_fill(spark):
    d = days(6)
    df = spark.createDataFrame([("A", d[0], 1.0), ("A", d[3], 4.0), ("A", d[5], None)], "series_id string, ds date, x double")
    got = [r["x"] for r in calendar.fill_calendar(df, ["series_id"], ["x"]).orderBy("ds").collect()]
    assert got == [1.0, 1.0, 1.0, 4.0, 4.0, 4.0]


def test_labels_and_exclusion(spark):
    s = series(spark, np.full(300, 50.0))
    d = days(300)
    e = spark.createDataFrame([("E", d[150])], "event string, event_date date")
    lab = {r["ds"]: r["label"] for r in ev.lead_label(s, e).collect()}
    assert [lab[d[i]] for i in (119, 120, 150, 151)] == [0, 1, 1, 0]
    ok = {r["ds"] for r in ev.eligible_dates(s.select("series_id", "ds"), e, 90, 20).collect()}
    assert d[60] in ok and d[61] not in ok and d[239] not in ok and d[240] in ok and d[10] not in ok


def test_alert_hits(spark):
    d = days(100)
    x = np.full(100, 50.0)
    x[[40, 90]] = 80
    e = spark.createDataFrame([("E", d[50])], "event string, event_date date")
    r = ev.alert_event_hits(series(spark, x), e, 70.0).first()
    assert (r["alerts"], r["tp"], r["detected"]) == (2, 1, 1)
