import random

import numpy as np
from samples import DOCS, prose, split

from stressloom.llm import decontaminate


def plain_tiles(doc, item, least=decontaminate.MATCH):
    """Greedy tiling by looking at every pair of positions."""
    doc, item, marked = list(doc), list(item), 0
    while True:
        best = (least - 1, None)
        for j in range(len(item)):
            for i in range(len(doc)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] is not None:
                    n += 1
                if n > best[0]:
                    best = (n, (i, j))
        if best[1] is None:
            return marked
        n, (i, j) = best
        doc[i : i + n] = item[j : j + n] = [None] * n
        marked += n


def test_tiles_equal_the_plain_search():
    rng = random.Random(1)
    for _ in range(300):
        item = [rng.randrange(1, 30) for _ in range(rng.randint(5, 30))]
        doc = []
        for _ in range(4):
            a = rng.randrange(len(item))
            doc += item[a : a + rng.randint(1, 20)] + [rng.randrange(1, 30) for _ in range(rng.randint(0, 3))]
        got = decontaminate.tiled(np.arange(len(doc)), np.array(doc), np.array(item))
        assert got == plain_tiles(doc, item)


def test_copies_and_reordered_passages_are_caught(spark):
    rng = random.Random(2)
    items = [(i, prose(rng, 40)) for i in range(30)] + [(90, "too short"), (91, None), (None, prose(rng, 40))]
    w = items[3][1].split()
    docs = [
        (0, prose(rng, 50) + " " + items[0][1].upper() + " " + prose(rng, 50)),
        (1, " ".join(w[20:40]) + " " + prose(rng, 9) + " " + " ".join(w[:20])),
        (2, prose(rng, 20) + " " + " ".join(w[:12])), (3, prose(rng, 300)), (4, "too short"),
        (5, items[7][1] + "\n" + items[8][1]),
    ]
    rows = decontaminate.decontaminate(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: list(r["items"]) for r in rows} == {0: [0], 1: [3], 2: [], 3: [], 4: [], 5: [7, 8]}
    assert {r.doc_id for r in rows if r.contaminated} == {0, 1, 5} and [r.coverage for r in rows if r.doc_id == 1] == [1.0]


def test_items_of_repeated_words_and_tiny_tables(spark):
    """An item of one word or a short phrase over and over has few seeds, each at many positions; tables may hold a few words in all."""
    items = [(1, "na " * 20), (2, "ping pong " * 15), (3, "one two three four five six seven"), (4, "na na na na batman " * 6)]
    rng = random.Random(5)
    docs = [(0, prose(rng, 30) + " " + "na " * 20 + prose(rng, 30)), (1, "ping pong " * 15), (2, "na na na na"), (3, "na " * 5 + prose(rng, 9)), (4, "na na na na batman " * 6)]
    made = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.decontaminate(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], DOCS), made).collect()
    want = {i: [k for k, x in items if 2 * plain_tiles(split(t), split(x)) >= len(split(x))] for i, t in docs}
    assert {r.doc_id: list(r["items"]) for r in rows} == want and want[0] == [1] and want[1] == [2]
    for text in ("a", "a b", "a b c", "a b c d"):
        few = spark.createDataFrame([(1, text, "en", "s", 1)], DOCS).coalesce(1)
        assert not decontaminate.decontaminate(few, made).first().contaminated


def test_query_equals_brute_force(spark, sf):
    items = {r.item_id: split(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    seeds = {}
    for i, w in items.items():
        for k in range(len(w) - 4):
            seeds.setdefault(tuple(w[k : k + 5]), set()).add(i)
    got = {r.doc_id: list(r["items"]) for r in decontaminate.query(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        w = split(r.text)
        near = set().union(*(seeds.get(tuple(w[k : k + 5]), set()) for k in range(len(w) - 4)), set())
        assert got[r.doc_id] == sorted(i for i in near if 2 * plain_tiles(w, items[i]) >= len(items[i]))


def test_odd_rows(spark, odd, clash, none, sf):
    items = spark.createDataFrame([(1, None), (2, ""), (None, "a b c d e f"), (3, "one two three four five six"), (3, "one two three four five six")], "item_id long, text string")
    assert not any(r.contaminated for r in decontaminate.decontaminate(odd, items).collect())
    assert decontaminate.decontaminate(odd, items.limit(0)).count() == odd.count() and decontaminate.decontaminate(none, items).count() == 0
    staged = decontaminate.stage(spark, clash, sf)
    assert staged.columns == clash.columns and staged.count() == odd.count()
