import pytest
from pyspark.sql import functions as F

from stressloom import schema as S
from stressloom.functions import scoring as fn
from stressloom.operators import channels as ch


def one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).cast(t).alias(k) for k, (v, t) in cols.items()])
    return df.select(expr.alias("v")).first()["v"]


def val(spark, f, x, t="double"):
    return one(spark, f("x"), x=(x, t))


@pytest.mark.parametrize("shares,expected", [([1] * 4, 2500), ([5, 5], 5000), ([7], 10000), ([], 0), ([0, 0], 0)])
def test_concentration(spark, shares, expected):
    df = spark.createDataFrame([(float(s),) for s in shares], "v double")
    assert df.groupBy().agg(ch.hhi("v").alias("h")).first()["h"] == pytest.approx(expected)


@pytest.mark.parametrize("x,expected", [(0, 0), (5, 50), (10, 100), (-3, 0), (15, 100)])
def test_scale(spark, x, expected):
    assert val(spark, lambda c: fn.scale_100(c, 0, 10), x) == expected


def test_scale_empty_range(spark):
    assert val(spark, lambda c: fn.scale_100(c, 5, 5), 7) == 50


@pytest.mark.parametrize("h,expected", [(0, 0), (1500, 30), (2500, 60), (5000, 90), (10000, 100), (750, 15)])
def test_hhi_segments(spark, h, expected):
    assert val(spark, fn.hhi_risk, h) == pytest.approx(expected)


@pytest.mark.parametrize("r,expected", [(None, 50), (2.0, 10), (1.5, 20), (1.25, 35), (1.0, 50), (0.9, 65), (0.8, 80), (0.7, 90), (0.0, 100), (3.0, 0)])
def test_backing_ratio(spark, r, expected):
    assert val(spark, fn.backing_ratio_risk, r) == pytest.approx(expected)


@pytest.mark.parametrize("v,expected", [(None, 50), (0.2, 20), (0.3, 30), (0.45, 45), (0.8, 72.5), (1.0, 85), (2.0, 100)])
def test_collateral_volatility(spark, v, expected):
    assert val(spark, fn.collateral_vol_risk, v) == pytest.approx(expected)


@pytest.mark.parametrize("g,expected", [(None, 30), (0.025, 10), (0.05, 20), (0.20, 50), (0.5, 80), (5.0, 100)])
def test_dilution(spark, g, expected):
    assert val(spark, fn.dilution_risk, g) == pytest.approx(expected)


@pytest.mark.parametrize("a,t,expected", [(0, 0, 0), (5, 100, 20), (15, 100, 50), (30, 100, 80), (100, 100, 100)])
def test_share(spark, a, t, expected):
    assert one(spark, fn.share_risk("a", "t"), a=(a, "double"), t=(t, "double")) == pytest.approx(expected)


@pytest.mark.parametrize("x,five,four", [(96, "critical", "high"), (85, "high", "high"), (70, "elevated", "high"), (50, "moderate", "elevated"), (30, "low", "moderate"), (10, "low", "low")])
def test_bands(spark, x, five, four):
    assert val(spark, fn.alert_five, x) == five
    assert val(spark, fn.alert_four, x) == four


@pytest.mark.parametrize("s,hint,expected", [
    ("usdt", None, "fiat-collateral"), ("UST", None, "algorithmic"), ("frax", None, "hybrid"), ("lusd", None, "crypto-collateral"),
    ("crvUSD", None, "unknown"), ("xyz", "peggedUSD", "fiat-collateral"), ("xyz", "Algo", "algorithmic"), ("xyz", None, "unknown")])
def test_coin_mechanism(spark, s, hint, expected):
    assert one(spark, fn.coin_mechanism("s", "h"), s=(s, "string"), h=(hint, "string")) == expected


def test_adjustment_below_one_percent(spark):
    assert one(spark, fn.adjust_for_coins("b", "r", "w"), b=(40.0, "double"), r=(90.0, "double"), w=(0.005, "double")) == 40.0


def test_monotone_hhi(spark):
    df = spark.range(0, 10001, 100).select(F.col("id").alias("h"), fn.hhi_risk(F.col("id").cast("double")).alias("r")).orderBy("h")
    r = [x["r"] for x in df.collect()]
    assert all(a <= b for a, b in zip(r, r[1:]))


def test_audit_rule(spark):
    df = spark.createDataFrame([("2",), ("0",), ("yes",), ("",), (None,)], "audits string")
    assert [r["a"] for r in df.select(fn.has_audit("audits").alias("a")).collect()] == [True, False, True, False, False]


def test_dates(spark):
    for text, ok in [("2024-05-01", True), ("2024-05-01T10:00:00Z", True), ("Wed, 01 May 2024 10:00:00 GMT", True), ("soon", False)]:
        got = val(spark, fn.parse_when, text, "string")
        assert (got is not None) == ok
        if ok:
            assert str(got).startswith("2024-05-01")


def test_fiat_only_supply_has_no_coin_risk(spark):
    df = spark.createDataFrame([("USDT", 10.0), ("USDC", 5.0)], "symbol string, circulating double")
    r = ch.coin_risk(df, []).first()
    assert r["algo_risk"] == 0 and r["algo_weight"] == 0


def test_top_k_survives_a_hot_key(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 5).cast("string"))).alias("k"), F.col("id").cast("double").alias("v"), F.col("id").alias("t"))
    got = {(r["k"], r["v"]) for r in ch.top_k(df, ["k"], "v", 3, "t").collect()}
    exp = {}
    for r in df.collect():
        exp.setdefault(r["k"], []).append(r["v"])
    assert got == {(k, v) for k, vs in exp.items() for v in sorted(vs)[-3:]}


def test_weights_sum_to_one():
    from stressloom.operators import grids

    for c in S.CHANNELS:
        assert sum(grids.ablated_weights(S.CHANNEL_WEIGHTS, c)) == pytest.approx(1)
        assert sum(grids.shifted_weights(S.CHANNEL_WEIGHTS, c, 0.1)) == pytest.approx(1)
