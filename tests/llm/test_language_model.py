import math
import zlib
from collections import Counter

import numpy as np
import pytest
from samples import split

from stressloom.llm import language_model as lm


def base(rows):
    """(held_out, n_tokens, n_known, train_tokens, base_score) by counting."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = [(i, split(t) + [None]) for i, t in rows]
    c = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return [(held(i), len(ws), sum(w in c for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in tokens]


def check(got, rows):
    key = lambda r: (r[0], r[1], r[2], r[3], round(r[4], 6))
    assert sorted(map(key, ((r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got))) == sorted(map(key, base(rows)))


def test_query_counts_and_gain(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = lm.query(spark, sf).collect()
    check(got, rows)
    for part in (False, True):
        mine = [r for r in got if r.held_out == part]
        assert sum(r.score for r in mine) > sum(r.base_score for r in mine)


@pytest.mark.parametrize("frequent", [0, lm.FREQUENT])
def test_odd_rows(spark, odd, clash, none, monkeypatch, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = lm.score_texts(odd).collect()
    check(got, rows)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert len({r.score for r in got if r.doc_id == 4}) == 1
    assert lm.score_texts(clash).count() == odd.count() and lm.score_texts(none).count() == 0


def test_leaf_probabilities_sum_to_one():
    rng = np.random.RandomState(1)
    flat = rng.normal(size=len(lm.model())).astype(np.float32)
    v = lm.Vocabulary(np.empty(0, np.uint64), np.empty(0), np.empty(0, np.uint64), np.empty(0, np.int16), np.zeros(1024), 0.0, 0)
    total = 0.0
    for last in range(1024):  # every token after the same history
        leaf = np.array([5, 700, last])
        known, deep = lm.features(leaf, np.array([0, 3]))
        total += 10 ** lm.log_probability(flat, v, leaf, known, deep)[2]
    assert total == pytest.approx(1, abs=1e-4)


def test_a_step_goes_down_the_gradient():
    rng = np.random.RandomState(2)
    leaf = rng.randint(0, 1024, 400)
    known, deep = lm.features(leaf, np.array([0, 100, 400]))
    v = lm.Vocabulary(np.empty(0, np.uint64), np.empty(0), np.empty(0, np.uint64), np.empty(0, np.int16), np.zeros(1024), 0.0, 0)
    flat, past = lm.model(), lm.model()
    before = lm.log_probability(flat, v, leaf, known, deep).sum()
    assert before == pytest.approx(-400 * math.log10(1024))
    for _ in range(3):
        lm.step(flat, past, leaf, known, deep)
    assert lm.log_probability(flat, v, leaf, known, deep).sum() > before + 100


def test_sums_of_groups_are_those_of_reduceat_to_the_bit(monkeypatch):
    """Groups of one row, of a few, of many; only rows of large groups go through reduceat."""
    rng = np.random.RandomState(3)
    sizes = rng.choice([1, 1, 1, 2, 3, 4, 5, 9, 40], 300)
    new = np.cumsum(sizes) - sizes
    g = rng.normal(size=(500, 32)).astype(np.float32).view(lm.PAIR)
    at = rng.randint(0, 500, sizes.sum())
    want = np.add.reduceat(g[at], new, axis=0)
    for few in (sizes > 1, sizes > 9, np.ones(300, bool)):
        keep = np.repeat(few, sizes)
        begin = np.cumsum(sizes[few]) - sizes[few]
        assert (lm.sums(g, at[keep], begin).view(np.float32) == want[few].view(np.float32)).all()
    assert lm.sums(g, at[:0], np.empty(0, np.int64)).shape == (0, 16)
