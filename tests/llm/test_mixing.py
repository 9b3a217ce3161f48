import duckdb
import pytest
from pyspark.sql import functions as F

from stressloom.llm import mixing


def test_margins_meet_the_targets(spark):
    cells = spark.createDataFrame([(s, l, t, 10 * i + 7) for i, (s, l, t) in enumerate((s, l, t) for s in "abc" for l in "xy" for t in "pq")], "source string, lang string, topic string, tokens long")
    goal = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"x": 0.9, "y": 0.1}, "topic": {"p": 3, "q": 1}}
    rows = mixing.rake(cells, goal, 12).collect()
    for d, want in goal.items():
        for v, x in want.items():
            assert sum(r["weight"] for r in rows if r[d] == v) == pytest.approx(x / sum(want.values()), abs=1e-6)


def test_a_target_value_without_documents_is_left_out(spark):
    cells = spark.createDataFrame([("a", "x", "p", 5), ("b", "x", "p", 5)], "source string, lang string, topic string, tokens long")
    rows = {r.source: r.weight for r in mixing.rake(cells, {"source": {"a": 0.2, "b": 0.2, "none": 0.6}}).collect()}
    assert rows == pytest.approx({"a": 0.5, "b": 0.5})


def test_odd_rows(spark, odd, clash, none, sf):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r.probability <= 1 for r in rows)
    assert len({(r.probability, r.sampled) for r in rows if r.doc_id == 4}) == 1
    assert mixing.mix(clash).count() == odd.count() and mixing.mix(none).count() == 0
    assert mixing.stage(spark, none, sf).count() == 0
    blank = odd.withColumn("text", F.lit(None).cast("string"))
    assert not any(r.sampled for r in mixing.mix(blank).collect())


def test_one_source_with_most_rows(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") % 10 == 0, "rare").otherwise("hot").alias("source"))
    got = {r.source: r.n for r in mixing.mix(docs, {"source": {"rare": 0.1, "hot": 0.9}}).where("sampled").groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(got["hot"] / 2700 - 0.5) < 0.05 and abs(got["rare"] / 300 - 0.5) < 0.12


def test_shares_of_the_sample_meet_the_targets(spark):
    """On the given table, and where the wanted values are rare: the budget gives way, not the shares."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    mixed = mixing.mix(docs)
    for r in mixing.achieved(mixed).collect():
        assert r.share == pytest.approx(r.target, abs=1e-3), r
    assert mixed.agg(F.max("probability")).first()[0] == pytest.approx(1.0)
    rare = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.lit("x").alias("lang"), F.when(F.col("id") % 100 == 0, "rare").otherwise("hot").alias("source"))
    goal = {"source": {"rare": 0.5, "hot": 0.5}}
    mixed = mixing.mix(rare, goal)
    assert all(r.share == pytest.approx(r.target, abs=1e-6) for r in mixing.achieved(mixed, goal).collect())
    assert mixed.where("source = 'rare'").agg(F.sum("probability")).first()[0] == pytest.approx(40)


def test_no_python_on_the_main_path(spark, sf):
    plan = mixing.query(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_sql_gives_the_same_rows(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.execute(f"SELECT doc_id, topic, n_tokens, probability, sampled FROM ({mixing.sql()})").fetchall()}
    assert {r.doc_id: (r.topic, r.n_tokens, r.probability, r.sampled) for r in mixing.query(spark, sf).collect()} == want


def test_a_raking_step_has_one_join(spark, monkeypatch):
    """What a join broadcasts stays in the driver's memory until its garbage is collected."""
    cells = spark.createDataFrame([(s, l, t, 10 * i + 7) for i, (s, l, t) in enumerate((s, l, t) for s in "abc" for l in "xy" for t in "pq")], "source string, lang string, topic string, tokens long")
    joins, store = [], mixing.store

    def counted(df, name):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return store(df, name)

    monkeypatch.setattr(mixing, "store", counted)
    found = mixing.rake(cells, steps=3)
    assert sum(joins) <= 3 + 3 * 3  # the targets join the cells, then each step the factors
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_targets_of_zero_weigh_nothing(spark):
    cells = spark.createDataFrame([("a", "x", "p", 5), ("a", "y", "q", 3), ("b", "x", "p", 7), ("b", "z", "q", 2), ("c", "x", "q", 0)], "source string, lang string, topic string, tokens long")
    found = {(r.source, r.lang, r.topic): r.weight for r in mixing.rake(cells, {"source": {"a": 1.0}, "lang": {"x": 0.25, "y": 0.75}, "topic": {"p": 0.25, "q": 0.75}}).collect()}
    assert {k: v for k, v in found.items() if v} == pytest.approx({("a", "x", "p"): 0.25, ("a", "y", "q"): 0.75})
