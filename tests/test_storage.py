import pytest
from pyspark.sql import functions as F

from helpers import days, series
from stressloom.sources import payloads as pl
from stressloom.sources import sinks
from stressloom.streaming import jobs


def test_insert_or_ignore_counts_and_keeps(spark, tmp_path):
    t = str(tmp_path / "t")
    sinks.with_month(series(spark, range(40))).write.partitionBy("month").parquet(t)
    new = series(spark, [x + 100 for x in range(60)])
    assert sinks.insert_or_ignore(spark, t, new) == 20
    assert sinks.insert_or_ignore(spark, t, new) == 0
    got = spark.read.parquet(t)
    assert got.count() == 60 and got.filter("idx < 100").count() == 40


def test_upsert_rewrites_only_touched_months(spark, tmp_path):
    t = str(tmp_path / "t")
    sinks.with_month(series(spark, range(90))).write.partitionBy("month").parquet(t)
    old = {r["f"] for r in spark.read.parquet(t).filter("month = '2020-01'").select(F.input_file_name().alias("f")).distinct().collect()}
    sinks.upsert(spark, t, series(spark, range(1000, 1095)).filter(F.col("ds") >= F.lit("2020-03-15").cast("date")))
    got = spark.read.parquet(t)
    assert got.count() == 95 and got.filter("idx >= 1000").count() == 21
    assert old == {r["f"] for r in got.filter("month = '2020-01'").select(F.input_file_name().alias("f")).distinct().collect()}


def test_frozen_path_is_never_written(spark, tmp_path):
    p = str(tmp_path / "frozen")
    target = sinks.write_new(series(spark, [1, 2]), p, frozen=(p,))
    assert target != p and not (tmp_path / "frozen").exists()
    with pytest.raises(Exception):
        sinks.write_new(series(spark, [1]), p, frozen=(p,))


def test_append_csv_and_read_back(spark, tmp_path):
    p = str(tmp_path / "c")
    old = series(spark, range(5))
    sinks.append_csv(spark, old, series(spark, range(8)), p)
    back = pl.read_series_csv(spark, p, "series_id string, ds date, idx double, loaded_at timestamp")
    assert sorted(r["idx"] for r in back.collect()) == [5.0, 6.0, 7.0]


def test_export_rejects_other_formats(spark, tmp_path):
    with pytest.raises(ValueError):
        sinks.export_range(series(spark, [1]), "2020-01-01", "2020-01-02", "xml", str(tmp_path / "x"))


def test_replace_range(spark):
    old, new = series(spark, range(10)), series(spark, range(100, 110))
    d = days(10)
    got = sinks.replaced_range(old, new, str(d[3]), str(d[5]), clear=True)
    assert sorted(r["idx"] for r in got.collect()) == [0, 1, 2, 6, 7, 8, 9, 103, 104, 105]
    assert sinks.replaced_range(old, new, str(d[3]), str(d[5]), clear=False).count() == 10


def test_missing_observation_texts(spark):
    text = '{"observations":[{"date":"2020-01-01","value":"."},{"date":"2020-01-02","value":""},{"date":"2020-01-03","value":"4.5"},{"date":"2020-01-04"}]}'
    got = pl.parse_observations(spark.createDataFrame([(text,)], "p string"), "p", []).orderBy("ds").collect()
    assert [r["value"] for r in got] == [None, None, 4.5, None]


def test_pegged_defaults(spark):
    text = '{"peggedAssets":[{"name":"a","symbol":"A","pegType":"peggedUSD","circulating":{"peggedUSD":5.0},"price":"n/a"},{"name":"b","symbol":"B","price":"0.9"}]}'
    a, b = pl.parse_pegged(spark.createDataFrame([(text,)], "p string"), "p").orderBy("symbol").collect()
    assert (a["price"], a["circulating"]) == (1.0, 5.0) and b["circulating"] == 0.0 and b["peg_deviation"] == pytest.approx(0.1)


def test_canonical_columns(spark):
    from stressloom.operators import quality
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0)], "SCR double, defi double, Contagion double, or double")
    assert quality.canonical(df, []).columns == ["stablecoin_risk", "defi_liquidity_risk", "contagion_risk", "arbitrage_opacity"]
    with pytest.raises(ValueError):
        quality.canonical(df.drop("defi"), [])


def test_refresh_is_idempotent(spark, tmp_path):
    t, land, audit, ck = (str(tmp_path / x) for x in ("t", "land", "audit", "ck"))
    sinks.with_month(series(spark, range(20))).write.partitionBy("month").parquet(t)
    new = series(spark, range(30))
    new.write.parquet(land)
    jobs.refresh(spark, land, t, audit, ck, new.schema)
    new.write.mode("append").parquet(land)
    jobs.refresh(spark, land, t, audit, ck, new.schema)
    assert spark.read.parquet(t).count() == 30
    assert spark.read.parquet(audit).agg(F.sum("appended")).first()[0] == 10


def test_shared_folder_comes_from_the_session(spark):
    from stressloom.session import scratch_path, shared_folder

    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    folder = shared_folder(spark)
    assert folder and (named is None or folder == named)
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a.startswith(folder) and a != b


def test_replace_range_clears_and_keeps_the_rest(spark, tmp_path):
    t = str(tmp_path / "t")
    sinks.with_month(series(spark, range(90))).write.partitionBy("month").parquet(t)
    first = spark.read.parquet(t).agg(F.min("ds")).first()[0]
    new = series(spark, range(1000, 1090)).filter(F.col("ds") >= F.lit(first.replace(day=20)))
    sinks.replace_range(spark, t, new, str(first), str(first.replace(day=25)), clear=True)
    got = spark.read.parquet(t)
    inside = got.filter(F.col("ds").between(F.lit(first), F.lit(first.replace(day=25))))
    assert inside.count() == 6 and inside.filter("idx < 1000").count() == 0
    assert got.filter(F.col("ds") > F.lit(first.replace(day=25))).filter("idx >= 1000").count() == 0


def test_titles_are_compared_whole(spark):
    same = "x" * 100
    df = spark.createDataFrame([(3, same + "a"), (1, same + "b"), (2, same + "a"), (4, ""), (5, None)], "doc_id int, title string")
    assert sorted((r.doc_id, r.title[-1]) for r in pl.first_titles(df, "doc_id").collect()) == [(1, "b"), (2, "a")]
