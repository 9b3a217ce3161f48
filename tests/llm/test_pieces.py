import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from stressloom.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = SentencePieceProcessor(model_file=PATH)
LETTERS = ["a", "b", "e", "er", "in", "ing", "the", "tion", " ", "  ", "   ", "\n", "\t", "\x00", "1", "2024", "é", "ß", "你", "好", "𝔘", "　", "▁", "<s>", "</s>", "<0x0A>", ".", ",", "''", "Ab", "QX", "́", "ﬁ", "🙂", "==", "----"]


def encoded(text):
    made = pieces.loaded(PATH)
    return [i for part in made.split(text) for i in made.encode_part(part)]


def test_ids_equal_those_of_the_library():
    rng = random.Random(3)
    for _ in range(6000):
        text = "".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 14)))
        assert encoded(text) == LIBRARY.encode(text), repr(text)


def test_any_run_of_pieces_is_encoded_alike():
    rng = random.Random(4)
    known = [LIBRARY.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    for _ in range(6000):
        text = "".join(rng.choice(known) for _ in range(rng.randint(1, 8)))
        assert encoded(text) == LIBRARY.encode(text), repr(text)


def test_pairs_stay_apart_as_by_plain_merging():
    made, rng = pieces.loaded(PATH), random.Random(5)
    own = [p for p in made.left if p not in made.unordered]
    for _ in range(20000):
        a, b = rng.choice(own), rng.choice(own)
        assert made.apart(a, b) == (made.merged(a + b)[0] == [a, b]), (a, b)


def test_blanks_and_long_parts():
    for n in range(1, 70):
        for text in (" " * n, " " * n + "word", "word" + " " * n + "x", "=" * n, "a" * n):
            assert encoded(text) == LIBRARY.encode(text)
    rng = random.Random(6)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzé你") for _ in range(40_000))
    assert encoded(text) == LIBRARY.encode(text)


def test_decoding_of_any_ids():
    rng, texts = random.Random(7), pieces.Texts(PATH)
    rows = [[]]
    for _ in range(1500):
        rows.append([rng.choice([rng.randrange(32000), rng.randrange(3, 259), 28705, 2, 0, 1]) for _ in range(rng.randint(0, 7))])
        rows.append(LIBRARY.encode("".join(rng.choice(LETTERS) for _ in range(5))) + [2])
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    for row, text in zip(rows, texts.decode(np.array([i for r in rows for i in r]), bounds)):
        assert text == LIBRARY.decode(row), row


@pytest.mark.parametrize("held", [4, pieces.HELD])
def test_odd_rows(spark, odd, clash, none, held, monkeypatch):
    monkeypatch.setattr(pieces, "HELD", held)
    for docs in (odd, clash):
        got = sorted((r.doc_id or -1, r.text, r.ids) for r in pieces.decode(pieces.encode(docs, PATH), PATH).collect())
        assert got == sorted((r.doc_id or -1, LIBRARY.decode(LIBRARY.encode(r.text or "")), LIBRARY.encode(r.text or "", add_eos=True)) for r in docs.collect())
    assert pieces.decode(pieces.encode(none, PATH), PATH).count() == 0
    rows = spark.createDataFrame([(1, None), (2, []), (None, [264, 2])], "doc_id bigint, ids array<int>")
    assert [r.text for r in pieces.decode(rows, PATH).collect()] == [None, "", "a"]


def test_query(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = pieces.query(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = LIBRARY.encode(texts[r.doc_id], add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(LIBRARY.decode(ids)))
