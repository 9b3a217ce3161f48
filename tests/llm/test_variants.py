import random
import re
import zlib
from collections import Counter

import numpy as np
from samples import DOCS, LOWER

from stressloom.llm import variants


def one_edit(a, b):
    """Whether the strings differ by exactly one code point inserted, deleted or replaced."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :]
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def brute_words(rows):
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{doc_id}:{word}".encode()) if doc_id is not None else 1
            if h % 199 == 0:
                k = h % len(word)
                word = word[:k] + word[k + 1 :]
            seen[word] += 1
    return {w: n for w, n in seen.items() if len(w) >= 6 and n >= 5}


def brute(seen):
    sized = {}
    for w in seen:
        sized.setdefault(len(w), []).append(w)
    near = {w: [v for k in (len(w) - 1, len(w), len(w) + 1) for v in sized.get(k, []) if one_edit(w, v)] for w in seen}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-seen[v], v), default=None)
        form[w] = best if best is not None and seen[best] >= 5 * seen[w] else None
    out = []
    for w in seen:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, seen[w], len(near[w]), seen[form[w]] if form[w] else None))
    return sorted(out)


def result(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def test_neighbourhood_is_every_single_edit():
    rng = random.Random(8)
    for n in (1, 2, 7):
        for _ in range(20):
            word = [rng.randrange(5) for _ in range(n)]
            edits = {tuple(word[:i] + word[i + 1 :]) for i in range(n)} | {tuple(word[:i] + [s] + word[i + 1 :]) for i in range(n) for s in range(5)}
            edits |= {tuple(word[:i] + [s] + word[i:]) for i in range(n + 1) for s in range(5)}
            rows = np.array([word])
            expect = {variants.mix(variants.sums(np.array([e], int).reshape(1, -1))[:, -1])[0] for e in edits}
            for width in (1, 3, 10):
                got = [variants.neighbourhood(rows, variants.sums(rows), 5, b, min(n, b + width)) for b in range(0, n, width)]
                assert {x for g in got for x in g[0]} == expect


def test_alphabet_grows_slowly():
    assert [variants.symbols_for(n) for n in (0, 1, 10**4, 10**5, 10**6, 10**7, 10**9, 10**12)] == [8, 8, 8, 16, 16, 32, 64, 64]


def test_made_words(spark):
    """Chains of forms, ties, accents, words of one reduced form, and words longer than one block of positions."""
    rng, seen = random.Random(9), {}
    for base in ("abcdefgh", "aqiyaqiy", "éàüöñçßÿ", "zzzzzz"):
        for _ in range(150):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(w))
                w[k : k + rng.randint(0, 1)] = rng.choice(["a", "q", "é", "÷", "", "z", "i"])
            if len(w := "".join(w)) >= 6:
                seen[w] = rng.choice([5, 5, 25, 125, 625, 3125])
    seen |= {"chainn": 5, "chain": 1, "chainnn": 30, "chainnnn": 200, "chainnnnn": 1000, "chainnnnnn": 5000}
    long = "".join(rng.choice("abcdef") for _ in range(9000))
    seen |= {long: 500, long[:4095] + long[4096:]: 50, long[:-1] + "z": 7, long + "y": 9}
    seen = {w: n for w, n in seen.items() if len(w) >= 6}
    words = spark.createDataFrame(list(seen.items()), "word string, n bigint")
    assert result(variants.variants(words)) == brute(seen)


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = result(variants.query(spark, sf))
    assert got == brute(brute_words(rows)) and any(r[1] for r in got)


def test_odd_rows(spark, odd, clash, none, tmp_path):
    clash.union(clash).union(clash).write.parquet(f"{tmp_path}/a/documents.parquet")
    rows = [(r.doc_id, r.text) for r in odd.collect()] * 3
    assert result(variants.query(spark, f"{tmp_path}/a")) == brute(brute_words(rows))
    none.write.parquet(f"{tmp_path}/b/documents.parquet")
    assert variants.query(spark, f"{tmp_path}/b").count() == 0
    assert set(DOCS.names) <= set(clash.columns)
