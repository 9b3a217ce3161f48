import math
import random

import pytest

from stressloom.llm import topk

KIND = "vec_id long, embedding array<float>"


def brute(rows, k, every):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            ok.setdefault(i, []).append([math.floor(256 * x) for x in v])
    out = []
    for q, (a, *_) in ((q, v) for q, v in ok.items() if q % every == 0):
        best = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, vs in ok.items() if c != q for b in vs)[:k]
        out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("chunk,group", [(7, 3), (64, 64)])
def test_equals_brute_force_over_many_blocks(spark, monkeypatch, chunk, group):
    monkeypatch.setattr(topk, "CHUNK", chunk)
    monkeypatch.setattr(topk, "GROUP", group)
    rng = random.Random(3)
    f = lambda: round(rng.uniform(-1, 1) * 64) / 64  # noqa: E731  exact as float, with many ties
    rows = [(i, [f() for _ in range(6)]) for i in range(120)]
    rows += [(200, [0.5] * 6), (205, [0.5] * 6), (210, [0.0] * 6)]
    rows += [(300, None), (305, []), (310, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (315, [float("nan")] * 6), (320, [float("inf")] * 6), (None, [1.0] * 6)]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame(rows, KIND), 5, 5).collect())
    assert got == brute(rows, 5, 5)


def test_fewer_candidates_than_k_and_negative_scores(spark):
    rows = [(0, [1.0, 1.0]), (1, [-1.0, -1.0]), (2, [-0.5, -1.0])]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame(rows, KIND)).collect()) == brute(rows, 5, 50)
    assert topk.top_k(spark.createDataFrame(rows[:1], KIND)).count() == 0
    assert topk.top_k(spark.createDataFrame([], KIND)).count() == 0


def test_a_vector_that_most_rows_share(spark):
    rows = [(i, [0.25] * 4) for i in range(500)] + [(1000 + i, [i / 64] * 4) for i in range(20)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame(rows, KIND), 5, 50).collect()) == brute(rows, 5, 50)


def test_large_components_stay_exact(spark):
    rows = [(i, [float(300_000 + i), float(-20_000 * i)] * 3) for i in range(12)]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame(rows, KIND), 3, 4).collect())
    assert got == brute(rows, 3, 4)


def test_nothing_is_repeated_or_broadcast_where_queries_meet_candidates(spark):
    some = topk.whole_vectors(spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(200)], KIND).coalesce(1))
    queries, candidates = topk.packed(some.where("vec_id % 5 = 0"), 8, "queries"), topk.packed(some, 16, "candidates")
    both = topk.pairs(queries, candidates)
    plan = both._jdf.queryExecution().executedPlan().toString()  # repeated queries used to be broadcast: the driver held all pairs
    assert "Broadcast" not in plan and "Generate" not in plan
    assert both.count() == 5 * 13
    assert topk.gather(both, 3).count() == 40 * 3 * both.rdd.getNumPartitions()  # k of each query leave a task, not a chunk


@pytest.mark.parametrize("scale", [1, 300, 300_000])
def test_entries_are_kept_over_chunks_at_any_size_of_components(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "CHUNK", 13)
    monkeypatch.setattr(topk, "GROUP", 5)
    monkeypatch.setattr(topk, "FILE", 2)
    rng = random.Random(5)
    f = lambda: round(rng.uniform(-1, 1) * 16) / 16 * scale
    rows = [(i, [f() for _ in range(5)]) for i in range(90)]
    rows += [(0, [scale * 1.0] * 5), (7, [scale * 1.0] * 5), (7, [scale * 1.0] * 5), (8, rows[8][1])]
    rows[0] = (0, [-scale * 1.0] * 5)  # the query is the least of its id
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame(rows, KIND).coalesce(1), 4, 10).collect())
    assert got == brute(rows, 4, 10)
