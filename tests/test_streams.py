import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F

from stressloom import schema as S
from stressloom.streaming import jobs, state

DAILY = "series_id string, ds date, idx double"
START = dt.date(2020, 1, 1)


def day(n):
    return START + dt.timedelta(days=n)


def runs(spark, folder, parts, schema, job, **kw):
    """Each part is landed and the job run on, from its checkpoint; all rows that came out and the progress of all batches."""
    seen = []
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        df = job(spark.readStream.schema(schema).parquet(f"{folder}/in"))
        seen += jobs.run_available(df, f"{folder}/out", f"{folder}/ck", **kw)
    return spark.read.schema(df.schema).parquet(f"{folder}/out").collect(), seen


def bands(rows):
    """Changes of the band by a plain loop."""
    out, last = [], {}
    for s, ds, x in sorted(rows):
        now = state._band(x)
        if last.get(s) != now:
            out.append((s, ds, x, last.get(s), now))
        last[s] = now
    return out


def test_days_in_any_order_give_the_batch_result_and_late_ones_are_returned(spark, tmp_path):
    rng = random.Random(1)
    rows = [(s, day(i), float(rng.randrange(100))) for s in "ab" for i in range(90)]
    arrival = {r: (r[1] - START).days + rng.randrange(9) for r in rows}  # up to 8 days late, 10 are allowed
    parts = [[r for r in rows if 30 * k <= arrival[r] < 30 * (k + 1) + (99 if k == 2 else 0)] for k in range(3)]
    for p in parts:
        rng.shuffle(p)
    late = [("a", day(3), 99.0), ("a", day(3), 1.0), ("b", day(40), 0.0)]
    again = ("b", day(85), rows[90 + 85][2])  # a second row of a day that is still held
    parts[2] += [*late, again, ("flush", day(400), None)]
    got, _ = runs(spark, tmp_path, parts, DAILY, lambda s: state.alert_changes(s, "10 days"), keyed=True)
    assert sorted((r.series_id, r.ds, r.idx, r.previous, r.band) for r in got if not r.late) == bands(rows)
    assert sorted((r.series_id, r.ds) for r in got if r.late) == sorted([(s, ds) for s, ds, _ in late] + [again[:2]])
    assert all(r.idx is None and r.band is None for r in got if r.late)


def test_recursion_goes_on_over_runs_and_null_days_are_late(spark, tmp_path):
    rng = random.Random(2)
    schema = "series_id string, ds date, " + ", ".join(f"{c} double" for c in S.CHANNELS)
    rows = [("a", day(i), *[float(rng.randrange(100)) for _ in S.CHANNELS]) for i in range(60)]
    gap = ("a", day(200), None, 1.0, 1.0, 1.0)
    parts = [rows[20:40] + rows[:20], rows[40:], [("a", None, 1.0, 1.0, 1.0, 1.0), gap, ("a", day(900), 1.0, 1.0, 1.0, 1.0)]]
    got, _ = runs(spark, tmp_path, parts, schema, lambda s: state.ewma_state(s, warmup=5, delay="3 days"), keyed=True)
    cov, want, n = [0.0] * len(state.PAIRS), [], 0
    for before, now in zip(rows, rows[1:]):
        d = [b - a for a, b in zip(before[2:], now[2:])]
        keep, add = (n / (n + 1), 1 / (n + 1)) if n < 5 else (0.94, 0.06)
        cov = [keep * c + add * d[i] * d[j] for c, (i, j) in zip(cov, state.PAIRS)]
        n += 1
        want.append((now[1], cov))
    out = sorted((r.ds, [r[f"c{i}{j}"] for i, j in state.PAIRS]) for r in got if not r.late)
    assert [x for x, _ in out] == [x for x, _ in want]
    assert all(abs(p - q) < 1e-9 for (_, a), (_, b) in zip(out, want) for p, q in zip(a, b))
    assert [r.ds for r in got if r.late] == [None]


def stamp(hour):
    return dt.datetime(2020, 1, 1) + dt.timedelta(hours=hour)


def test_each_source_has_its_own_watermark(spark, tmp_path):
    """48 hours and 1 hour of lag in one run; the slow source falls silent at the end and does not hold the other back."""
    rng, lags = random.Random(3), {"slow": 48, "fast": 1}
    rows = [(i, s, i, stamp(i), 1.0) for s in lags for i in range(0, 600, 2) if rng.random() < 0.2 and (s == "fast" or i < 300)]
    rows += [(9000, "fast", -1, stamp(2000), None)]
    parts = [[r for r in rows if stamp(150 * k) <= r[3] < stamp(150 * (k + 1)) or (k == 3 and r[2] == -1)] for k in range(4)]
    with jobs.newest_decides(spark):
        got, seen = runs(spark, tmp_path, parts, jobs.POINTS, lambda s: jobs.visible_values(s, s, lags))
    assert spark.conf.get(jobs.WATERMARKS) == "min"
    want = []
    for _, s, key, ts, _ in rows:
        hits = [p[3] for p in rows if p[1] == s and dt.timedelta(0) <= ts - dt.timedelta(hours=lags[s]) - p[3] < dt.timedelta(hours=24)]
        want += [(s, key, h) for h in hits] or [(s, key, None)]
    assert sorted(((r.source, r.key, r.p_ts) for r in got if r.key != -1), key=repr) == sorted((w for w in want if w[1] != -1), key=repr)
    kept = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in seen]
    assert max(kept) < len(rows) and kept[-1] <= 4  # what the bounds allow, not all that was read


def test_visible_points_are_counted_without_pairs(spark, tmp_path):
    """Crowded, repeated and bordering times, null keys, a source that falls silent; what is written and held grows with the rows."""
    rng, lags = random.Random(6), {"slow": 48, "fast": 1}
    minute = lambda m: dt.datetime(2020, 1, 1) + dt.timedelta(minutes=m)
    rows = [(i, s, rng.choice([None, i]), minute(rng.choice([30 * rng.randrange(400), rng.randrange(12000) + 0.25])), 1.0) for s in lags for i in range(400 if s == "fast" else 150)]
    rows = [r for r in rows if r[1] == "fast" or r[3] < minute(6000)]
    rows += [(9000, "fast", -1, stamp(2000), None)]
    parts = [[r for r in rows if minute(4000 * k) <= r[3] < minute(4000 * (k + 1)) or (k == 2 and r[2] == -1)] for k in range(3)]
    with jobs.newest_decides(spark):
        panes, seen = runs(spark, tmp_path, parts, jobs.POINTS, lambda s: jobs.visible_values(s, s, lags, counted=True))
    got = jobs.visible_counts(spark.read.parquet(f"{tmp_path}/out")).collect()
    want = []
    for _, s, key, ts, _ in rows:
        n = sum(p[1] == s and dt.timedelta(0) <= ts - dt.timedelta(hours=lags[s]) - p[3] < dt.timedelta(hours=24) for p in rows)
        want.append((s, key, ts, n))
    assert sorted(((r.source, r.key, r.ts, r.visible) for r in got if r.key != -1), key=repr) == sorted((w for w in want if w[1] != -1), key=repr)
    assert len(panes) <= 3 * len(rows) < sum(w[3] for w in want)
    assert seen[-1]["stateOperators"][0]["numRowsTotal"] <= 3  # only what lies ahead of the last row


def test_sliding_mean_adds_each_row_once(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, s, i, stamp(rng.randrange(24 * 60)), rng.choice([None, float(rng.randrange(50))])) for i in range(400) for s in "ab"]
    rows.sort(key=lambda r: r[3])
    end = [(-1, "end", -1, stamp(24 * 200), None)]
    got, seen = runs(spark, tmp_path, [rows[:400], rows[400:] + end], jobs.POINTS, lambda s: jobs.sliding_average(s, 7))
    panel = pd.DataFrame(rows, columns=["id", "source", "key", "ts", "value"])
    panel["ds"] = panel.ts.dt.date
    want = {}
    for s in "ab":
        for k in range(70):
            ds = day(k)
            v = panel[(panel.source == s) & (panel.ds < ds) & (panel.ds >= ds - dt.timedelta(days=7))].value.dropna()
            if ((panel.source == s) & (panel.ds < ds) & (panel.ds >= ds - dt.timedelta(days=7))).any():
                want[s, ds] = (len(v), round(v.mean(), 9) if len(v) else None)
    assert {(r.source, r.ds): (r.n, None if r.mean is None else round(r.mean, 9)) for r in got if r.source != "end"} == want
    second, first = seen[0]["stateOperators"]  # panes are the lower of the two steps
    assert first["numRowsTotal"] <= 2 * 61 and second["numRowsTotal"] <= 2 * 70
    df = jobs.sliding_average(spark.createDataFrame(rows, jobs.POINTS), 7)
    plan = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert [i for i, x in enumerate(plan) if "Expand" in x] < [max(i for i, x in enumerate(plan) if "Aggregate" in x)]


def test_spark_setting_of_the_caller_comes_back(spark):
    before = spark.conf.get(state.PROVIDER, None)
    with state.keyed_store(spark):
        assert spark.conf.get(state.PROVIDER) == state.ROCKS
    assert spark.conf.get(state.PROVIDER, None) == before
    assert F is not None
