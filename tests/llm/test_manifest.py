import hashlib
import random
import zlib

from samples import DOCS, LOWER

from stressloom.llm import manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)])


def tree(nodes):
    """Levels from the leaves to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        a = i // 16 * 16
        out.append((level[a:i], level[i + 1 : a + 16]))
        i //= 16
    return out


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append((r, leaf(r, r[1])))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[s] = tree([h for _, h in groups[s]])
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for j, s in enumerate(names):
        for i, (r, h) in enumerate(groups[s]):
            p = path(trees[s], i) + path(top, j)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node = leaf(r, r[1].translate(LOWER)) if tampered and r[1] is not None else h
            for before, after in p:
                node = H(*before, node, *after)
            out.append((r[0], h, trees[s][-1][0], top[-1][0], H(*[x for b, a in p for x in b + a]), node, node == top[-1][0]))
    return sorted(out, key=repr)


def result(df):
    cols = "doc_id leaf subroot root proof_sha256 folded_root verified".split()
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def saved(spark, rows, folder):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_query_equals_plain_trees(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(*DOCS.names).collect()]
    assert result(manifest.query(spark, sf)) == brute(rows)


def test_sizes_around_full_runs_and_a_hot_id(spark, tmp_path):
    """Also more groups than one array holds, and an id that a third of all rows share."""
    rng, rows = random.Random(5), [(i, "A b", None, f"g{i % 300}", None) for i in range(700)]
    for s, n in enumerate([1, 2, 15, 16, 17, 255, 256, 257, 272, 273, 4097]):
        rows += [(i, f"Text {i} {s}", "en", f"s{s}", i) for i in rng.sample(range(-(10**6), 10**6), n)]
    rows += [(5, rng.choice(["Same", f"Own {i}"]), "en", "hot", 1) for i in range(2500)] + [(None, f"T {i % 9}", "en", "hot", 1) for i in range(300)]
    rows += [(i, f"T {i}", "en", "hot", 1) for i in range(500)]
    assert result(manifest.query(spark, saved(spark, rows, tmp_path))) == brute(rows)


def test_far_apart_ids(spark, tmp_path):
    rng = random.Random(6)
    ids = [-(2**63), 2**63 - 1, 0, -1, 63, 64, *[rng.randrange(-(2**63), 2**63) for _ in range(300)]]
    rows = [(i, "A", "en", rng.choice(["a", "é", "Z", None, "字"]), 1) for i in ids]
    assert result(manifest.query(spark, saved(spark, rows, tmp_path))) == brute(rows)


def test_odd_rows(spark, odd, clash, tmp_path):
    rows = [tuple(r) for r in odd.select(*DOCS.names).collect()]
    clash.write.parquet(f"{tmp_path}/documents.parquet")
    assert result(manifest.query(spark, str(tmp_path))) == brute(rows)


def test_empty_table(spark, tmp_path):
    assert manifest.query(spark, saved(spark, [], tmp_path)).count() == 0
