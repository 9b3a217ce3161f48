import random

import pytest
from samples import DOCS, prose

from stressloom.llm import quality, toxicity
from stressloom.llm.rounds import labelled_sample


@pytest.mark.parametrize("score", [toxicity.score_toxicity, quality.score_quality])
def test_odd_rows(spark, odd, clash, none, score):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (4, 1, 0), (6, None, None), (None, 1, 1), (7, 3, 7), (99, 0, 1)], "doc_id long, quality int, toxic int")
    rows = score(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 4}) == 1  # repeated rows
    assert score(clash, labels).count() == odd.count()
    assert score(none, labels).count() == 0
    assert score(odd, labels.limit(0)).count() == odd.count()


def test_no_labels_means_nothing_is_toxic(odd, spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.score_toxicity(odd, labels).collect()} == {0}


def test_sample_is_bounded_and_leaves_out_the_held_fold(spark):
    import zlib

    docs = spark.createDataFrame([(i, "a b", "en", "s", 3) for i in range(200)], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    got = [r.doc_id for r in labelled_sample(docs.select("doc_id", "text"), labels, "toxic", 30).collect()]
    assert len(got) == 30 and all(zlib.crc32(str(i).encode()) % 5 for i in got)


def held_out(spark, module, make):
    rng = random.Random(3)
    made = [make(rng, i % 4 == 0) for i in range(600)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(made)], DOCS)
    name = "toxic" if module is toxicity else "quality"
    labels = spark.createDataFrame([(i, int((i % 4 == 0) == (name == "toxic"))) for i in range(600)], f"doc_id long, {name} int")
    rows = [r for r in (toxicity.score_toxicity if module is toxicity else quality.score_quality)(docs, labels).collect() if r.held_out]
    assert len(rows) > 60
    return sum(r.predicted == int((r.doc_id % 4 == 0) == (name == "toxic")) for r in rows) / len(rows)


def test_toxic_words_are_learned(spark):
    def make(rng, bad):
        words = prose(rng, 80).split()
        for _ in range(6 if bad else 0):
            words[rng.randrange(80)] = rng.choice(["zork", "blarg", "fnord"])
        return " ".join(words)

    assert held_out(spark, toxicity, make) >= 0.95


def test_marks_do_not_hide_a_word(spark):
    def make(rng, bad):
        words = prose(rng, 80).split()
        for _ in range(6 if bad else 0):
            words[rng.randrange(80)] = rng.choice(["zork", "blarg", "fnord"]) + rng.choice(["***", "###", "!", ",", "&%$"])
        return " ".join(w + rng.choice(["", "", "***", "###"]) for w in words)

    assert held_out(spark, toxicity, make) >= 0.95


def test_scores_equal_a_plain_sum_over_features(spark, sf):
    """Every row's score from the fitted weights, word by word."""
    import math
    import re
    import zlib

    import numpy as np

    from stressloom.llm.text import mix, words

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    weight = dict(zip(*(a.tolist() for a in toxicity.fit(docs.select("doc_id", "text"), labels))))
    size = toxicity.FAMILIES[0]
    one = {}

    def of(word):
        if word not in one:
            b = np.frombuffer(word.encode(), np.uint8)
            one[word] = words(b, np.array([0, len(b)])).hashes[0]
        return one[word]

    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert len(got) == docs.count()
    for d in docs.collect():
        h = [of(w) for w in re.findall("[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), d.text or ""))]
        found = set()
        with np.errstate(over="ignore"):
            for gap in range(3):
                keys = h if not gap else [mix(np.array([a * np.uint64(0x9E3779B97F4A7C15) + b + np.uint64(gap)]))[0] for a, b in zip(h, h[gap:])]
                found |= {gap * size + int(k >> np.uint64(40)) % size for k in keys}
        total = weight.get(toxicity.SIZE, 0.0) + sum(weight.get(i, 0.0) for i in found)
        r = got[d.doc_id]
        assert math.isclose(r.score, 1 / (1 + math.exp(-total)), rel_tol=1e-9, abs_tol=1e-12)
        assert r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 5 == 0)


def test_structure_is_learned(spark):
    def make(rng, bad):
        words = prose(rng, 80).split()
        return " ".join(w + rng.choice(["$$$", "***"]) for w in words) if bad else " ".join(words)

    assert held_out(spark, quality, make) >= 0.95


def test_linear_time_identity():
    """The pairwise sum equals the sum over pairs."""
    import numpy as np

    rng = np.random.RandomState(0)
    v, x = rng.normal(size=(7, 3)), rng.normal(size=7)
    pairs = sum(x[i] * x[j] * v[i] @ v[j] for i in range(7) for j in range(i))
    vx = v * x[:, None]
    assert np.isclose(pairs, 0.5 * ((vx.sum(0) ** 2) - (vx**2).sum(0)).sum())


def test_stage_drops_only_toxic(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = toxicity.stage(spark, docs, sf)
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
