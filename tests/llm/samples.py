"""Rows for the tests of this folder."""

import random
import re

from pyspark.sql import types as T

WORDS = "the of and to in that is was for it with as his on be at by he this had not are but from or have an they which one you were".split()
LOWER = {c: c + 32 for c in range(65, 91)}
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def split(text):
    return re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOWER))


def prose(rng, n):
    out = []
    for i in range(n):
        out.append(rng.choice(WORDS) + "".join(rng.choice("aeiounst") for _ in range(rng.randint(0, 4))))
    return " ".join(w + ("." if i % 7 == 6 else "") for i, w in enumerate(out))


def odd_rows():
    """Nulls in any column, empty and blank texts, a long text, ties and repeated rows."""
    rng = random.Random(4)
    long = prose(rng, 6000)
    same = prose(rng, 60)
    return [
        (1, None, "en", "a", None), (2, "", None, "a", 0), (3, " \n\t ", "en", None, 4), (None, same, "en", "a", None), (4, same, "en", "a", 1), (4, same, "en", "a", 1),
        (5, same.upper(), None, None, None), (6, long, "fr", "b", 9), (7, "One", "en", "b", 3), (8, "ONE", "en", "b", 3), (None, None, None, None, None), (9, "Ünïcode 你好 🙂. " * 30, "de", "a", 2),
    ]
