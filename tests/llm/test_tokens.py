import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stressloom.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(PATH)


def count(text):
    return len(WHOLE.encode(text or "", add_special_tokens=False).ids)


def test_units_are_encoded_as_in_the_text():
    rng, cut = random.Random(2), tokens.Splitter(PATH)
    letters = list(" \n\t\r\x0b\x0c\x1c\x1f\x85\xa0 　​aZé'sßt12٣.,!$你🙂́|") + ["<|endoftext|>", "'s", "  ", "\n\n", "'re"]
    for _ in range(5000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))
        special, units = cut.units(text)
        assert special + sum(cut.pieces(units)) == count(text), repr(text)


@pytest.mark.parametrize("frequent", [0, 20, tokens.FREQUENT])
def test_counts_do_not_depend_on_the_broadcast_table(odd, frequent):
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in tokens.count_tokens(odd, PATH, frequent=frequent).collect())
    assert got == sorted((r.doc_id or -1, len((r.text or "").encode()), count(r.text)) for r in odd.collect())


def test_empty_table_and_clashing_columns(none, clash):
    assert tokens.count_tokens(none, PATH).count() == 0
    assert tokens.count_tokens(clash, PATH).count() == clash.count()


def test_query(spark, sf):
    got = {r.doc_id: (r.n_tokens, r.over_limit) for r in tokens.query(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("text")).collect():
        assert got[r.doc_id] == (count(r.text), count(r.text) > 1024)
