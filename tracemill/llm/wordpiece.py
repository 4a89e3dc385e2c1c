"""Token counts by greedy longest-match word pieces, in linear time and without building the pieces.

The automaton is the trie of the vocabulary with a failure link and a count at each node. When no child takes
the next byte, the pieces that greedy matching would have cut off by now are counted by the node's number and
matching goes on at its failure link, so a text's bytes are read once and never gone back to.

Words are `[^\\x20\\x09-\\x0D]+`; each is matched with one blank in front, as the vocabulary writes the start of a
word. Every single byte must be a piece, so there are no unknown words.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

from .resident import resident

#: Words that a worker keeps counted, and the most bytes of a vocabulary that is sent to the executors.
KEPT, LARGEST = 400_000, 64 << 20


def load(path: str) -> list[bytes]:
    """The pieces of a byte-level tokenizer file as bytes; its special tokens are left out."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    special = {t["content"] for t in file.get("added_tokens", [])}
    return [bytes(byte[c] for c in piece) for piece in file["model"]["vocab"] if piece not in special]


class Counter:
    """The automaton over the pieces."""

    def __init__(self, pieces: Iterable[bytes]):
        step: list[dict[int, int]] = [{}]
        final = [False]
        for piece in pieces:
            at = 0
            for c in piece:
                if c not in step[at]:
                    step[at][c] = len(step)
                    step.append({})
                    final.append(False)
                at = step[at][c]
            final[at] = True
        if missing := [c for c in range(256) if c not in step[0] or not final[step[0][c]]]:
            raise ValueError(f"bytes without a piece: {missing[:5]}")
        # fail[v]: where matching goes on after the greedy pieces of v's string, pops[v] in number, are cut off.
        fail, pops = [0] * len(step), [0] * len(step)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for c, v in step[u].items():
                if final[v]:
                    pops[v] = 1
                else:
                    at, count = fail[u], pops[u]
                    while c not in step[at]:
                        count += pops[at]
                        at = fail[at]
                    fail[v], pops[v] = step[at][c], count
                queue.append(v)
        self.step, self.fail, self.pops = step, fail, pops
        self.kept: dict[bytes, int] = {}

    def word(self, word: bytes) -> int:
        """Pieces of a word, given without its blank."""
        step, fail, pops, at, count = self.step, self.fail, self.pops, self.step[0][32], 0
        for c in word:
            while c not in step[at]:
                count += pops[at]
                at = fail[at]
            at = step[at][c]
        while at:
            count += pops[at]
            at = fail[at]
        return count

    def text(self, text: bytes) -> tuple[int, int]:
        """Words and pieces of a text."""
        words, kept = text.split(), self.kept
        try:
            return len(words), sum([kept[w] for w in words])
        except KeyError:
            pass
        if len(kept) > KEPT:
            kept.clear()
        total = 0
        for w in words:
            n = kept.get(w)
            if n is None:
                n = self.word(w)
                if len(w) <= 64:
                    kept[w] = n
            total += n
        return len(words), total


def count(docs: DataFrame, vocabulary: list[bytes], column: str = "text") -> DataFrame:
    """docs with n_words and n_tokens (long) of a text column, for whole texts.

    A null, empty or blank text has 0 of both. Existing columns of these names are replaced.
    """
    if sum(map(len, vocabulary)) > LARGEST:
        raise ValueError("the vocabulary is too large to send to every executor")
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    name = uuid4().hex
    docs = docs.drop("n_words", "n_tokens")
    at = docs.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = resident(name, lambda: Counter(held.value))
        for batch in batches:
            got = [counter.text(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(at)]
            columns = [pa.array([x[i] for x in got], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "n_words", "n_tokens"])

    return docs.mapInArrow(run, StructType([*docs.schema, StructField("n_words", LongType()), StructField("n_tokens", LongType())]))
