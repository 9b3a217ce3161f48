"""Small fixtures built from row keys, so that they are the same on every run."""

import datetime as dt

import numpy as np
import pandas as pd

from stressloom import schema as S

START = dt.date(2020, 1, 1)


def days(n):
    return [START + dt.timedelta(days=i) for i in range(n)]


def series(spark, values, sid="A", name="idx"):
    pdf = pd.DataFrame({"series_id": sid, "ds": days(len(values)), name: np.asarray(values, float)})
    return spark.createDataFrame(pdf, f"series_id string, ds date, {name} double")


def panel(spark, arrays: dict):
    """{series: n x 4 array} -> channels and composite."""
    parts = []
    for sid, a in arrays.items():
        p = pd.DataFrame(np.asarray(a, float), columns=S.CHANNELS)
        p["idx"] = p[S.CHANNELS].to_numpy() @ np.array(list(S.CHANNEL_WEIGHTS.values()))
        p.insert(0, "ds", days(len(p)))
        p.insert(0, "series_id", sid)
        parts.append(p)
    return spark.createDataFrame(pd.concat(parts), S.DAILY_SERIES)


def rows(df, *order):
    return sorted([tuple(r) for r in df.select(*order).collect()]) if order else df.collect()
