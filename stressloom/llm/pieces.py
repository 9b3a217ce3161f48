"""SentencePiece encoding and decoding of whole texts, for BPE models with byte fallback and without a normaliser.

The encoding of a text is unique, and any stretch of its pieces is the encoding of that stretch. So every prefix has one last piece: of
the pieces that end there, the one that stands unmerged beside the last piece of what is before it. A table of these last pieces is
filled from left to right, and the ids are read backwards from its end.

1. An automaton over all pieces that encode to themselves names those that end at each position, longest first; a single character
   always may.
2. Pair compatibility: the right edge of one piece and the left edge of the other grow by merges in the order of the scores; the pair
   stays apart if no merge across the border ever comes first (the left one at equal scores). Pieces whose merges do not come in the
   order of their scores are tried by plain merging. Answers are kept, as few pairs are common.
3. No piece holds a blank behind another character, some characters (digits, line ends) are in no piece but their own, and some (commas)
   follow no letter in any piece. Text is cut there, and a worker fills the table of every distinct part once; ids of a text are gathered
   by numpy.

Decoding gathers the bytes of the pieces alike. Rows that no encoding gives (unknown or control ids inside, broken byte runs) are decoded
by the library.

Null texts are empty and have the end id alone; a null row of ids decodes to null; repeated rows give repeated results; a null id of a
row is passed through; an empty table gives an empty table. Other columns are not read. Work is per document and without a shuffle.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache
from typing import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stressloom.llm.staging import mapped, small_batches

BLANK = "▁"
LETTER = "[A-Za-zÀ-ɏ]"
#: Parts and pairs that a worker holds, and characters of text that are taken at once.
HELD, STRETCH = 1 << 18, 1 << 20


class Pieces:
    """Tables of one model file, and encoding of single parts."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        norm, made = model.normalizer_spec, model.trainer_spec
        plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces
        if made.model_type != made.BPE or not made.byte_fallback or made.treat_whitespace_as_suffix or not plain:
            raise ValueError("only BPE models with byte fallback, a leading blank and no normaliser are supported")
        self.path, self.end, self.size = path, made.eos_id, len(model.pieces)
        self.ids, self.score, self.bytes = {}, {}, [0] * 256
        self.texts: list[bytes | None] = [None] * self.size
        for i, p in enumerate(model.pieces):
            if p.type == kinds.NORMAL:
                self.ids[p.piece], self.score[p.piece] = i, p.score
                self.texts[i] = p.piece.replace(BLANK, " ").encode()
            elif p.type == kinds.BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
                self.texts[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type not in (kinds.UNKNOWN, kinds.CONTROL):
                raise ValueError("pieces given by hand and unused pieces are not supported")
        long = [p for p in self.ids if len(p) > 1]
        if any(BLANK in p.lstrip(BLANK) for p in long):
            raise ValueError("a piece holds a blank behind another character")
        self.parts = re.compile(self.pattern(long))
        import ahocorasick

        self.left, self.right, self.unordered, self.pairs = {}, {}, set(), {}
        self.names = sorted(self.ids, key=self.ids.get)
        self.lengths = [len(p) for p in self.names]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, p in enumerate(self.names):
            if len(p) > 1 and self.edges(p):
                self.automaton.add_word(p, i)
        if len(self.automaton):
            self.automaton.make_automaton()

    @staticmethod
    def pattern(long: list[str]) -> str:
        """Of parts that no merge leaves, given all pieces of several characters."""
        held = set("".join(long))
        loose = {c for c in map(chr, range(128)) if c not in held}
        closing = {c for c in map(chr, range(128)) if c in held and not c.isalnum()} - {c for p in long for x, c in zip(p, p[1:]) if re.match(LETTER, x)}
        loose, closing = (re.escape("".join(sorted(s))) for s in (loose, closing))
        word = f"{BLANK}*{LETTER}+(?=[{closing}])|" if closing else ""
        return f"{word}{BLANK}*[^{BLANK}{loose}]+|{BLANK}+" + (f"|[{loose}]" if loose else "")

    def merged(self, text: str) -> tuple[list[str], list[tuple[float, int, int]]]:
        """Pieces by plain merging of the best pair, the leftmost of equal ones, and its steps: (score, place, pieces before the step)."""
        parts, steps = list(text), []
        while True:
            best, at = None, 0
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts, steps
            steps.append((best, at, len(parts)))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def edges(self, piece: str) -> bool:
        """Keeps how both edges of the piece grow: (score of the merge, edge after it). False if the piece does not encode to itself."""
        parts, steps = self.merged(piece)
        if len(parts) > 1:
            return False
        if any(a[0] < b[0] for a, b in zip(steps, steps[1:])):
            self.unordered.add(piece)
            return True
        now = list(piece)
        left, right = [(None, now[0])], [(None, now[-1])]
        for score, at, size in steps:
            now[at : at + 2] = [now[at] + now[at + 1]]
            if at == 0:
                left.append((score, now[0]))
            if at == size - 2:
                right.append((score, now[-1]))
        self.left[piece], self.right[piece] = left, right
        return True

    def apart(self, a: str, b: str) -> bool:
        """Whether a and b stay two pieces where they meet."""
        if a in self.unordered or b in self.unordered:
            return self.merged(a + b)[0] == [a, b]
        right, left = self.right.get(a) or [(None, a)], self.left.get(b) or [(None, b)]
        i = j = 0
        while True:
            over = self.score.get(right[i][1] + left[j][1])
            grow_a = right[i + 1][0] if i + 1 < len(right) else None
            grow_b = left[j + 1][0] if j + 1 < len(left) else None
            if over is not None and not (grow_a is not None and grow_a >= over) and not (grow_b is not None and grow_b > over):
                return False
            if grow_a is None and grow_b is None:
                return True
            if grow_b is None or (grow_a is not None and grow_a >= grow_b):
                i += 1
            else:
                j += 1

    def fits(self, key: int) -> bool:
        """Whether the pair of pieces stays apart; key as made by encode_part."""
        a, b = key >> 16, key & 0xFFFF
        known = self.pairs[key] = self.apart(chr(a) if a >= 0 else self.names[~a], self.names[b])
        return known

    def encode_part(self, part: str) -> list[int]:
        """last[i] is the last piece of the first i characters: the code point of a single character, or ~ the number of a longer piece."""
        last, found = [0, *map(ord, part)], -1
        pairs, lengths = self.pairs, self.lengths
        for at, piece in self.automaton.iter(part) if len(self.automaton) else ():
            if at == found:
                continue
            start = at + 1 - lengths[piece]
            if start:
                key = (last[start] << 16) + piece
                fits = pairs.get(key)
                if not (self.fits(key) if fits is None else fits):
                    continue
            last[at + 1] = ~piece
            found = at
        out, i = [], len(part)
        while i:
            piece = last[i]
            if piece < 0:
                out.append(self.ids[self.names[~piece]])
                i -= lengths[~piece]
            else:
                known = self.ids.get(part[i - 1])
                if known is None:  # a character without a piece
                    out.extend(self.bytes[x] for x in reversed(part[i - 1].encode()))
                else:
                    out.append(known)
                i -= 1
        return out[::-1]

    def split(self, text: str) -> Iterable[str]:
        """The parts of a text, which are encoded alone to the same ids as in the text."""
        if not text:
            return ()
        text = BLANK + text.replace(" ", BLANK)
        return self.parts.findall(text) if len(text) <= STRETCH else (m[0] for m in self.parts.finditer(text))


class Parts(dict):
    """Number of each part met so far; its ids are flat[starts[number]:starts[number + 1]]. Parts of the generation before are taken over
    when they are met again."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces = pieces
        self.flat, self.starts = array("i"), array("q", [0])
        self.renew()

    def renew(self) -> None:
        self.old, self.old_flat, self.old_starts = dict(self), self.flat, self.starts
        self.clear()
        self.flat, self.starts = array("i"), array("q", [0])
        if len(self.pieces.pairs) > HELD:
            self.pieces.pairs.clear()

    def __missing__(self, part: str) -> int:
        before = self.old.get(part)
        self.flat.extend(self.pieces.encode_part(part) if before is None else self.old_flat[self.old_starts[before] : self.old_starts[before + 1]])
        self.starts.append(len(self.flat))
        number = self[part] = len(self.starts) - 2
        return number

    def full(self) -> bool:
        return len(self) > HELD or len(self.flat) > 16 * HELD


def gathered(starts: np.ndarray, index: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[starts[i]:starts[i + 1]] for every i of the index, one behind the other, and where each ends."""
    sizes = starts[index + 1] - starts[index]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts[index] - (ends - sizes), sizes) + np.arange(total)], ends


@lru_cache(2)
def loaded(path: str) -> Pieces:
    """Once in each worker."""
    return Pieces(path)


@lru_cache(1)
def met(path: str) -> Parts:
    """Of all tasks of a worker."""
    return Parts(loaded(path))


def stretches(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Consecutive rows of about STRETCH characters."""
    i = total = 0
    for j, t in enumerate(texts):
        total += len(t or "")
        if total > STRETCH:
            yield i, j + 1
            i, total = j + 1, 0
    if i < len(texts):
        yield i, len(texts)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end: bool = True) -> DataFrame:
    """(doc_id, ids array<int>) of every row, with the end id behind each text if asked for."""

    def run(batches):
        parts = met(path)
        for b in batches:
            texts = b.column("text").to_pylist()
            for i, j in stretches(texts):
                if parts.full():
                    parts.renew()
                index, sizes = [], [0]
                for t in texts[i:j]:
                    index.extend(map(parts.__getitem__, parts.pieces.split(t or "")))
                    sizes.append(len(index))
                starts, flat = np.array(parts.starts, np.int64), np.array(parts.flat, np.int32)
                ids, ends = gathered(starts, np.array(index, np.int64), flat)
                bounds = np.concatenate([[0], ends])[sizes]
                if end:
                    ids = np.insert(ids, bounds[1:], parts.pieces.end)
                    bounds = bounds + np.arange(len(bounds))
                rows = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), rows], ["doc_id", "ids"])

    small_batches(docs.sparkSession)
    return mapped(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id bigint, ids array<int>")


class Texts:
    """Decoding of rows of ids for one model file."""

    def __init__(self, path: str):
        self.pieces = loaded(path)
        known = [t or b"" for t in self.pieces.texts]
        self.starts = np.concatenate([[0], np.cumsum([len(t) for t in known])]).astype(np.int64)
        self.data = np.frombuffer(b"".join(known), np.uint8)
        single = np.zeros(self.pieces.size, bool)
        single[self.pieces.bytes] = True
        self.whole = np.array([t is not None for t in self.pieces.texts]) & ~single  # pieces of whole characters
        self.single = single

    def by_library(self, ids: list[int]) -> str:
        if not hasattr(self, "processor"):
            from sentencepiece import SentencePieceProcessor

            self.processor = SentencePieceProcessor(model_file=self.pieces.path)
        return self.processor.decode(ids)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """Texts of ids[bounds[i]:bounds[i + 1]]."""
        if not len(ids):
            return [""] * (len(bounds) - 1)
        if ids.min() < 0 or ids.max() >= self.pieces.size:
            raise ValueError("an id is not in the model")
        sizes = np.diff(bounds)
        filled = np.flatnonzero(sizes)
        odd = ~(self.whole[ids] | self.single[ids])
        odd[bounds[filled + 1] - 1] &= ids[bounds[filled + 1] - 1] != self.pieces.end
        odd[bounds[filled]] |= ~self.whole[ids[bounds[filled]]] & (sizes[filled] > 1)
        rows = np.zeros(len(sizes), bool)
        rows[filled] = np.add.reduceat(odd, bounds[filled]) > 0
        data, ends = gathered(self.starts, ids, self.data)
        at, data = np.concatenate([[0], ends])[bounds], data.tobytes()
        out = []
        for i in range(len(sizes)):
            try:
                if rows[i]:
                    raise ValueError
                begin = at[i] + (data[at[i] : at[i] + 1] == b" ")  # the blank put before every text
                out.append(data[begin : at[i + 1]].decode() if at[i + 1] > at[i] else "")
            except ValueError:
                out.append(self.by_library(ids[bounds[i] : bounds[i + 1]].tolist()))
        return out


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, ids, text) of every row of ids."""

    def run(batches):
        texts = Texts(path)
        for b in batches:
            col = b.column("ids")
            filled = col.fill_null([]) if col.null_count else col
            bounds = filled.offsets.to_numpy().astype(np.int64)
            made = texts.decode(filled.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]], bounds - bounds[0])
            made = [None if not ok else t for ok, t in zip(col.is_valid().to_pylist(), made)] if col.null_count else made
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), col, pa.array(made, pa.string())], ["doc_id", "ids", "text"])

    small_batches(encoded.sparkSession)
    return mapped(encoded.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")), run, "doc_id bigint, ids array<int>, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    found = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
