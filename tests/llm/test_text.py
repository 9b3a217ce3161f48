import random

import numpy as np
import pyarrow as pa
from samples import split

from stressloom.llm.text import chunks, grams, words


def taken(texts):
    parts = list(chunks(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"]), "text"))
    return words(parts[0][1], np.concatenate([parts[0][2][:1], *[b[1:] for _, _, b in parts]]))


def test_words_depend_on_the_word_alone():
    rng = random.Random(1)
    letters = "abcXYZéß \n\t.你"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["", None, " ", "a", "A"]
    w = taken(texts)
    seen = {}
    for i, t in enumerate(texts):
        mine = w.hashes[w.first[i] : w.first[i + 1]].tolist()
        assert len(mine) == len(split(t))
        for word, h in zip(split(t), mine):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_pieces_of_long_texts_give_the_same_hashes():
    long = "word " * 300_000 + "x" * 1_200_000 + " end"
    w = taken([long, "end word"])
    assert len(set(w.hashes[:300_000].tolist())) == 1
    assert w.hashes[w.first[1] - 1] == w.hashes[w.first[1]] and w.hashes[0] == w.hashes[-1]


def test_windows_stay_inside_rows():
    w = taken(["a b c d e f", "a b", "", "a b c d e", "a b"])
    g, first = grams(w, 5)
    assert np.diff(first).tolist() == [2, 1, 0, 1, 1]
    assert g[first[3]] == g[0] and g[first[1]] == g[first[4]] != g[0]


def test_pieces_of_one_to_four_words():
    """Alone, behind a huge text, and as the last row of a piece."""
    for n in range(1, 5):
        short = " ".join("abcd"[:n])
        for texts in ([short], ["", short], [short, ""], ["a", short], ["word " * 200_000, short]):
            w = taken(texts)
            g, first = grams(w, 5)
            size = [len(split(t)) for t in texts]
            assert np.diff(first).tolist() == [s - 4 if s >= 5 else min(s, 1) for s in size]
        only = taken([short])
        assert len(grams(only, 5)[0]) == 1
