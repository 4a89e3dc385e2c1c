"""SentencePiece encoding and decoding by a single-pass Viterbi over an Aho-Corasick automaton.

The automaton holds the model's pieces. At each position of a text its state is the longest piece ending
there, and its output links name every shorter one; each relaxes the best score of the position. The best
segmentation has the highest sum of piece scores; among equals the longest last piece wins. A character that
no piece covers becomes its UTF-8 bytes, for which the model has pieces.

Text is marked as the model has it: a blank in front, blanks as U+2581, nothing else changed. No piece holds
that mark behind another character, so a segmentation never crosses into a marked word and words are solved
one by one, each distinct word once while it stays in a bounded table.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .resident import resident

MARK = "▁"
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+$")
#: Words that a worker keeps solved.
KEPT = 400_000
#: A character without a piece scores so much less than the lowest piece.
PENALTY = 10.0


@dataclass(frozen=True)
class Model:
    """pieces: (text, score) by id, None for ids that stand for no text; byte: id of each byte."""

    pieces: list[tuple[str, float] | None]
    byte: list[int]


def load(path: str) -> Model:
    """The pieces, scores and byte pieces of a SentencePiece model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte = [], [0] * 256
    for i in range(sp.get_piece_size()):
        text = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte[int(text[3:5], 16)] = i
        plain = not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
        pieces.append((text, sp.get_score(i)) if plain else None)
    for text, _ in filter(None, pieces):
        if MARK in text.lstrip(MARK):
            raise ValueError("a piece holds the mark of a blank behind another character")
    return Model(pieces, byte)


class Encoder:
    """The automaton over one model's pieces, and the words solved with it."""

    def __init__(self, model: Model):
        self.model = model
        self.step: list[dict[str, int]] = [{}]
        self.piece: list[tuple[int, float, int] | None] = [None]
        for i, p in enumerate(model.pieces):
            if p:
                at = 0
                for c in p[0]:
                    at = self.step[at].setdefault(c, len(self.step))
                    if at == len(self.step):
                        self.step.append({})
                        self.piece.append(None)
                self.piece[at] = len(p[0]), p[1], i
        self.fail = [0] * len(self.step)
        #: The nearest state, itself included, that is a piece; 0 if there is none.
        self.link = [0] * len(self.step)
        #: The same below a state.
        self.below = [0] * len(self.step)
        queue = deque([0])
        while queue:
            at = queue.popleft()
            for c, to in self.step[at].items():
                if at:
                    f = self.fail[at]
                    while f and c not in self.step[f]:
                        f = self.fail[f]
                    self.fail[to] = self.step[f].get(c, 0)
                self.below[to] = self.link[self.fail[to]]
                self.link[to] = to if self.piece[to] else self.below[to]
                queue.append(to)
        self.unknown = min((p[1] for p in model.pieces if p), default=0.0) - PENALTY
        self.wide = "<u2" if len(model.pieces) <= 1 << 16 else "<u4"
        self.kept: dict[str, bytes] = {}

    def solve(self, word: str) -> list[int]:
        """Ids of the best segmentation of a marked word."""
        step, fail, link, below, piece = self.step, self.fail, self.link, self.below, self.piece
        best, back, state = [0.0], [(0, -1)], 0
        for j, c in enumerate(word, 1):
            while state and c not in step[state]:
                state = fail[state]
            state = step[state].get(c, 0)
            top, how, at = best[j - 1] + self.unknown, (j - 1, -1), link[state]
            while at:
                size, score, i = piece[at]
                score += best[j - size]
                if score > top:
                    top, how = score, (j - size, i)
                at = below[at]
            best.append(top)
            back.append(how)
        out, j = [], len(word)
        while j:
            start, i = back[j]
            out.extend([i] if i >= 0 else [self.model.byte[b] for b in reversed(word[start:j].encode("utf-8", "surrogatepass"))])
            j = start
        return out[::-1]

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text; none for a null or empty one."""
        if not text:
            return np.zeros(0, self.wide)
        words = _WORDS.findall(MARK + text.replace(" ", MARK))
        kept = self.kept
        try:
            return np.frombuffer(b"".join([kept[w] for w in words]), self.wide)
        except KeyError:
            pass
        if len(kept) > KEPT:
            kept.clear()
        out = []
        for w in words:
            ids = kept.get(w)
            if ids is None:
                ids = np.array(self.solve(w), self.wide).tobytes()
                if len(w) <= 64:
                    kept[w] = ids
            out.append(ids)
        return np.frombuffer(b"".join(out), self.wide)


class Decoder:
    """The bytes of one model's pieces."""

    def __init__(self, model: Model):
        self.bytes_of = [p[0].replace(MARK, " ").encode("utf-8", "surrogatepass") if p else b"" for p in model.pieces]
        for value, i in enumerate(model.byte):
            self.bytes_of[i] = bytes([value])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
        table = self.bytes_of
        text = b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _mapped(df: DataFrame, model: Model, source: str, target: StructField, kind: type, run_rows) -> DataFrame:
    held = df.sparkSession.sparkContext.broadcast(model)
    name = uuid4().hex
    df = df.drop(target.name) if target.name != source else df
    at = df.columns.index(source)
    schema = StructType([*(f for f in df.schema if f.name != target.name), target])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = resident(name, lambda: kind(held.value))
        for whole in batches:
            for a in range(0, whole.num_rows, 500):
                batch = whole.slice(a, 500)
                keep = [i for i, c in enumerate(batch.schema.names) if c != target.name]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i) for i in keep), run_rows(codec, batch.column(at))], [*(batch.schema.names[i] for i in keep), target.name]
                )

    return df.mapInArrow(run, schema)


def _encode_rows(codec: Encoder, texts: pa.Array) -> pa.Array:
    rows = [codec.encode(t.as_py()) for t in texts]
    ends = np.cumsum([0] + [len(r) for r in rows]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, np.int32))


def _decode_rows(codec: Decoder, lists: pa.ListArray) -> pa.Array:
    return pa.array([codec.decode(x) if x is not None else None for x in lists.to_numpy(zero_copy_only=False)], pa.string())


def encode(docs: DataFrame, model: Model, column: str = "text", into: str = "pieces") -> DataFrame:
    """docs with the piece ids of a text column, array<int>. Null and empty texts have an empty list."""
    return _mapped(docs, model, column, StructField(into, ArrayType(IntegerType())), Encoder, _encode_rows)


def decode(docs: DataFrame, model: Model, column: str = "pieces", into: str = "decoded") -> DataFrame:
    """docs with the text of a column of piece ids. Null stays null, an empty list gives an empty text.

    decode(encode(x)) is x but for the mark U+2581 itself, which comes back as a blank.
    """
    return _mapped(docs, model, column, StructField(into, StringType()), Decoder, _decode_rows)
