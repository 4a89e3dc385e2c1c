"""Token ids of whole texts in flat binary files, and reading them back.

Format of a folder: for each part NNNNN, in ascending order of doc_id over the parts, written by the task attempt A,
  part-NNNNN-A.u2 or .u4   ids, unsigned little-endian 16- or 32-bit (16 where every id fits), nothing between documents
  part-NNNNN-A.off         signed little-endian 64-bit offsets in ids within the part, one more than documents
  part-NNNNN-A.doc         signed little-endian 64-bit doc_ids
A part's first id has as its place in the whole the sum of the earlier parts' sizes, the prefix sum of the
table of parts that the writer returns.

Texts are cut before every blank that a visible character follows, before a line feed between visible characters,
and before a mark behind a letter. The byte-level pattern always starts a token there, whatever stands before, so the
parts' ids put together are the text's ids. Arrow numbers the distinct parts of some megabytes of texts, and each of
these is looked up once in a bounded table; those that it lacks go through the tokenizers library, many at a time.
The ids are then gathered by number in numpy.
A text that holds an added token of the file, such as <|endoftext|>, is encoded whole where these count as tokens.
Every attempt of a task writes files of its own name. The table of parts, which Spark commits, names the attempt that
counts; files of others are deleted when the table is there, so a retry or a speculative attempt replaces nothing.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import store
from .resident import resident
from .textkeys import slices

#: Parts that a worker keeps encoded, bytes of texts encoded at a time, parts that are encoded as one text, and parts whose ids are gathered at a time.
KEPT, AT_ONCE, JOINED, GATHERED = 800_000, 8 << 20, 500, 1 << 16


def _bytes(*spans: range | list[int]) -> np.ndarray:
    return np.isin(np.arange(256), [x for r in spans for x in r])


#: Bytes by kind. VISIBLE: first bytes of characters that no Unicode version counts as white space (ASCII, U+00C0 to U+0FFF). MARK: ASCII
#: characters that are no letters, numbers or white space. LETTER: ASCII letters. TWO, LATIN: first bytes of characters of two bytes, and of
#: those that are letters (U+00C0 to U+017F) unless the second byte is one of SIGN, as in U+00D7 and U+00F7.
_VISIBLE, _TWO, _LATIN, _SIGN = _bytes(range(0x21, 0x7F), range(0xC3, 0xE1)), _bytes(range(0xC3, 0xE0)), _bytes(range(0xC3, 0xC6)), _bytes([0x97, 0xB7])
_LETTER = _bytes(range(0x41, 0x5B), range(0x61, 0x7B))
_MARK = _bytes(range(0x21, 0x30), range(0x3A, 0x41), range(0x5B, 0x61), range(0x7B, 0x7F))
_PLACE = _MARK | _bytes([0x20, 0x0A])
#: A part that starts with a visible character, or with one blank or line feed and such a character.
_PLAIN = re.compile("[ \n]?[!-~À-\u0fff]")
_SPACED = re.compile(r"\s")


def cut(data: np.ndarray, offsets: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Where the parts of texts start in their bytes, ascending. whole: texts that aren't cut."""
    at = np.flatnonzero(_PLACE[data])
    here, one, two, after = data[at], data[np.maximum(at - 1, 0)], data[np.maximum(at - 2, 0)], data[np.minimum(at + 1, len(data) - 1)]
    mark, double = _MARK[here], one >= 0x80
    marks = mark & (_LETTER[one] | (_LATIN[two] & double & ~_SIGN[one]))
    spaces = ~mark & _VISIBLE[after] & ((here == 0x20) | (_VISIBLE[one] & ~double) | (_TWO[two] & double))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # what follows a text's last byte is another text
    at = at[marks | (spaces & ~edge[at + 1])]
    if whole.any():
        at = at[~whole[np.searchsorted(offsets, at, "right") - 1]]
    edge[at] = True
    return np.flatnonzero(edge[:-1])


def _lengths(texts: list[str]) -> np.ndarray:
    """Bytes of each."""
    return pc.binary_length(pa.array(texts, pa.large_string())).to_numpy().astype(np.int64)


class Encoder:
    """Texts to the bytes of their ids, with an end id after each. added: whether special tokens written in a text are tokens, as in the library's plain encode."""

    def __init__(self, path: str, end_id: int, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if added else []
        #: Parts put together must not make a token that holds white space.
        self.joined = 0 if any(_SPACED.search(t) for t in self.added) else JOINED
        vocabulary = self.tokenizer.get_vocab()
        self.kind = np.dtype("<u2" if max(len(vocabulary), end_id + 1) <= 1 << 16 else "<u4")
        self.end = np.array([end_id], self.kind).tobytes()
        #: Bytes of each token; the file writes one character for every byte.
        self.length = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.length[i] = len(token)
        self.kept: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _fresh(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of each part. Many make one text, each with its blank or line feed or else a line feed of ours in front; the tokens' bytes tell where each ends."""
        plain = [w for w in parts if _PLAIN.match(w)] if self.joined else []
        every = "\n".join(plain)
        for token in self.added:
            plain = [w for w in plain if token not in w] if token in every else plain
        out, size = {}, self.kind.itemsize
        led = [w if w[0] in " \n" else "\n" + w for w in plain]
        bounds = range(0, len(plain), JOINED)
        for k, ids in zip(bounds, self._ids(["".join(led[k : k + JOINED]) for k in bounds]), strict=True):
            ends = np.cumsum(_lengths(led[k : k + JOINED]))
            starts = ends - _lengths(plain[k : k + JOINED])
            sums = np.concatenate([[0], np.cumsum(self.length[ids])])
            x, y = np.searchsorted(sums, starts), np.searchsorted(sums, ends)
            if y[-1] != len(sums) - 1 or (sums[x] != starts).any() or (sums[y] != ends).any():
                raise ValueError("a token crosses a part's end; the tokenizer isn't a byte-level one")
            data = ids.tobytes()
            out.update(zip(plain[k : k + JOINED], [data[a:b] for a, b in zip((x * size).tolist(), (y * size).tolist(), strict=True)], strict=True))
        alone = [w for w in parts if w not in out]
        out.update(zip(alone, [ids.tobytes() for ids in self._ids(alone)], strict=True))
        return out

    def parts(self, parts: list[str]) -> list[bytes]:
        """Ids of each of some distinct parts."""
        if len(self.kept) > KEPT:  # the parts met first are mostly the frequent ones
            self.kept = dict(islice(self.kept.items(), KEPT // 2))
        out = list(map(self.kept.get, parts))
        late = [k for k, ids in enumerate(out) if ids is None]
        new = self._fresh([parts[k] for k in late])
        for k in late:
            out[k] = new[parts[k]]
        self.kept.update((w, ids) for w, ids in new.items() if len(w) <= 24)
        return out

    def encode(self, texts: pa.Array) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        """For some texts at a time: pieces of their ids, which follow each other, and the number of ids of each text; end ids are in both."""
        for a, b, data, offsets in slices(texts, AT_ONCE):
            whole = np.zeros(b - a, bool)
            for token in self.added:
                whole |= pc.fill_null(pc.match_substring(texts.slice(a, b - a), token), False).to_numpy(zero_copy_only=False)
            starts = cut(data, offsets, whole)
            spans = [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)]
            numbered = pa.Array.from_buffers(pa.large_string(), len(starts), spans).dictionary_encode()
            ids = [*self.parts(numbered.dictionary.to_numpy(zero_copy_only=False).tolist()), self.end]
            last = np.searchsorted(starts, offsets[1:])
            numbers = np.insert(numbered.indices.to_numpy(), last, len(ids) - 1)
            table = np.frombuffer(b"".join(ids), self.kind)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.kind.itemsize
            place, ends = np.cumsum(sizes) - sizes, np.cumsum(sizes[numbers])
            out = []
            for k in range(0, len(numbers), GATHERED):
                some = numbers[k : k + GATHERED]
                before = np.cumsum(sizes[some]) - sizes[some]
                at = np.repeat(place[some] - before, sizes[some])
                out.append(table[at + np.arange(len(at))])
            yield out, np.diff(ends[last + np.arange(b - a)], prepend=0)


def _put(where: fs.FileSystem, path: str, data: bytes) -> None:
    with where.open_output_stream(path) as out:
        out.write(data)


def _drop_others(folder: str, parts: DataFrame) -> None:
    """Deletes the files of attempts that the table of parts doesn't name; one row a part comes to the driver."""
    where, base = fs.FileSystem.from_uri(folder)
    named = {f"part-{r['part']:05d}-{r['attempt']}" for r in parts.select("part", "attempt").collect()}
    for info in where.get_file_info(fs.FileSelector(base, allow_not_found=True)):
        if info.is_file and info.base_name.startswith("part-") and info.base_name.partition(".")[0] not in named:
            where.delete_file(info.path)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, added: bool = False) -> DataFrame:
    """Writes the files and returns the table of parts: part, attempt, n_docs, n_tokens, base_docs, base_tokens, width.

    docs: doc_id (long) and text. A null text is an empty one, which is its end id alone; rows with a null
    doc_id are left out; documents with equal doc_ids stand in the order of their texts. An empty table gives
    parts of no documents. With added, special tokens of the file that stand in a text are their own ids, as the
    library's plain encode(text, add_special_tokens=False) has them; else they are text. folder must be shared by driver and executors (any file system that pyarrow opens).
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = resident((tokenizer, end_id, added), lambda: Encoder(tokenizer, end_id, added))
        task = TaskContext.get()
        where, base = fs.FileSystem.from_uri(folder)
        where.create_dir(base, recursive=True)
        stem = f"{base}/part-{task.partitionId():05d}-{task.taskAttemptId()}"
        width, ids, sizes = encoder.kind.itemsize, [], [np.zeros(1, np.int64)]
        with where.open_output_stream(f"{stem}.u{width}") as out:
            for batch in batches:
                for pieces, counts in encoder.encode(batch.column(1)):
                    for piece in pieces:
                        out.write(piece.data)
                    sizes.append(counts)
                ids.append(batch.column(0).to_numpy())
        offsets = np.cumsum(np.concatenate(sizes))
        _put(where, f"{stem}.off", offsets.astype("<i8").tobytes())
        _put(where, f"{stem}.doc", np.concatenate([np.zeros(0, np.int64), *ids]).astype("<i8").tobytes())
        yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "attempt": [task.taskAttemptId()], "n_docs": [len(offsets) - 1], "n_tokens": [int(offsets[-1])], "width": [width]})

    table = store.written(rows.mapInArrow(run, "part long, attempt long, n_docs long, n_tokens long, width long"), folder, "parts")
    _drop_others(folder, table)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return table.select(
        "part", "attempt", "n_docs", "n_tokens", F.coalesce(F.sum("n_docs").over(before), F.lit(0)).alias("base_docs"),
        F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base_tokens"), "width",
    )


def open_part(folder: str, part: int, attempt: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, offsets and ids of a part; memory-mapped where the folder is a local one."""
    where, base = fs.FileSystem.from_uri(folder)

    def get(name: str, kind: str) -> np.ndarray:
        path = f"{base}/part-{part:05d}-{attempt}.{name}"
        if not where.get_file_info(path).size:
            return np.zeros(0, kind)
        with pa.memory_map(path) if where.type_name == "local" else where.open_input_file(path) as source:
            return np.frombuffer(source.read_buffer(), kind)

    return get("doc", "<i8"), get("off", "<i8"), get(f"u{width}", f"<u{width}")


def read(parts: DataFrame, folder: str) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32.

    start counts all ids before the document, n_tokens its ids with the end id, and ids_crc32 is the unsigned
    crc32 of those ids as little-endian unsigned 32-bit integers.
    """
    rows = 4096

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, attempt, base, width in zip(*(batch.column(c).to_pylist() for c in ("part", "attempt", "base_tokens", "width")), strict=True):
                docs, offsets, ids = open_part(folder, part, attempt, width)
                for a in range(0, len(docs), rows):
                    at = offsets[a : min(a + rows, len(docs)) + 1]
                    sums = [zlib.crc32(ids[x:y].astype("<u4").data) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs[a : a + rows]), pa.array(base + at[:-1]), pa.array(np.diff(at)), pa.array(sums, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    wide = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.select("part", "attempt", "base_tokens", "width").repartition(wide).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
