import random
from collections import defaultdict

from samples import DOCS, prose, split
from stressloom.llm import near_dups
from stressloom.llm.components import components


def sets_of(text):
    w = split(text)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    """doc_id -> (size, component) by comparing all pairs."""
    sets = {i: sets_of(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def changed(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = prose(rng, 1)
    return " ".join(w)


def test_groups_chains_and_strangers(spark):
    rng = random.Random(5)
    rows, i = [], 0
    for _ in range(6):
        text = prose(rng, 150)
        for n in (0, 0, 1, 2, 3, 8, 20):
            rows.append((i, changed(rng, text, n)))
            i += 1
        for _ in range(12):  # a chain: ends are far apart
            text = changed(rng, text, 2)
            rows.append((i, text))
            i += 1
    rng.shuffle(rows)
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], DOCS)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_query_equals_all_pairs(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.query(spark, sf).collect()}
    assert got == brute(rows)


def test_odd_rows(spark, odd, clash, none):
    rows = near_dups.near_duplicates(odd).collect()
    by = defaultdict(set)
    for r in rows:
        by[r.doc_id].add((r.component_id, r.kept))
    assert len(rows) == odd.count()
    assert by[4] == {(4, True)} and by[5] == {(4, False)} and by[8] == {(7, False)} and by[1] == {(1, True)} and by[3] == {(3, True)}
    assert by[None] == {(None, True)}
    assert near_dups.near_duplicates(clash).count() == odd.count() and near_dups.near_duplicates(none).count() == 0


def test_stage_keeps_one_of_each_group(spark, odd, clash, none, sf):
    kept = near_dups.stage(spark, odd, sf).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id) == [1, 2, 3, 4, 6, 7, 9] and sum(r.doc_id is None for r in kept) == 2
    assert near_dups.stage(spark, clash, sf).columns == clash.columns and near_dups.stage(spark, none, sf).count() == 0


def test_every_pair_within_the_distance_shares_a_key(spark):
    from pyspark.sql import functions as F

    rng = random.Random(8)
    lanes = [[rng.randrange(1 << 16) for _ in range(28)] for _ in range(40)]
    rows = []
    for k, x in enumerate(lanes):
        for n in (0, 5, near_dups.DISTANCE):
            y = list(x)
            for at in rng.sample(range(28), n):
                y[at] ^= rng.randrange(1, 1 << 16)
            longs = [sum(v << (16 * j) for j, v in enumerate(y[4 * c : 4 * c + 4])) for c in range(7)]
            rows.append((k, n, *[v - (1 << 64) if v >> 63 else v for v in longs]))
    t = spark.createDataFrame(rows, "k long, n int, " + ", ".join(f"s{i} long" for i in range(7)))
    keyed = t.select("k", "n", near_dups.keys().alias("key"))
    shared = keyed.where("n = 0").alias("x").join(keyed.where("n > 0").alias("y"), ["k", "key"]).select("k", F.col("y.n")).distinct().count()
    assert shared == 80
    pair = t.where("n = 0").select("k", *[F.col(f"s{i}").alias(f"a_s{i}") for i in range(7)]).join(t.select("k", "n", *[F.col(f"s{i}").alias(f"b_s{i}") for i in range(7)]), "k")
    assert pair.where(near_dups.distance("a_", "b_") != F.col("n")).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (7, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(301)}, **{i: 1000 for i in range(1000, 1200)}}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_stage_links_from_080_on_and_the_query_from_085(spark, sf):
    rng = random.Random(9)
    rows, wide = [], []
    for k in range(12):
        w = prose(rng, 150).split()
        rows.append((10 * k, " ".join(w)))
        for j, n in enumerate((3, 4)):  # so many words far apart are changed, each of which takes five shingles
            y = list(w)
            for i in range(n):
                y[20 + 30 * i] = f"new{k}x{j}x{i}"
            rows.append((10 * k + 1 + j, " ".join(y)))
            x, z = sets_of(rows[-1 - j - 1][1]), sets_of(rows[-1][1])
            wide.append((10 * k, 10 * k + 1 + j, len(x & z) / len(x | z)))
    near = [b for _, b, s in wide if 0.80 <= s < 0.85]
    assert len(near) == 12 and all(s < 0.80 for _, b, s in wide if b not in near)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    assert all(r.kept for r in near_dups.near_duplicates(docs).collect())
    got = {r.doc_id: r.component_id for r in near_dups.near_duplicates(docs, least=80).collect()}
    assert all(got[b] == a if b in near else got[b] == b for a, b, _ in wide)
    assert {i for i, _ in rows} - {r.doc_id for r in near_dups.stage(spark, docs, sf).collect()} == set(near)


def test_tables_of_a_few_words(spark):
    for texts in (["a b"], ["a b c"], ["a", "a b"], ["", "a b c d"], ["a b", "A B"]):
        docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS).coalesce(1)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.near_duplicates(docs).collect()}
        assert got == {i: (min(1, len(t)), 0 if [x.lower() for x in texts] == ["a b", "a b"] else i) for i, t in enumerate(texts)}
