"""Token counts by a two-tier lookup on the map side.

A text is cut into pre-tokens that the tokenizer handles on their own (a run of spaces and what follows up to
the next space); the count of the text is the sum over its pre-tokens. A compact hash table of the lengths of frequent
pre-tokens is broadcast; what it lacks is encoded once for each distinct pre-token by the worker, which keeps a
bounded cache. No pre-token is shuffled.

The table is only a cache. It is filled from a bounded sample (TABLE_CHARS characters of TABLE_ROWS texts, TABLE_SIZE entries), read from as few
partitions as hold it; the result doesn't depend on it. A worker's cache lives as long as the worker, over its tasks.

Defined cases: a null or empty text has no tokens; texts with a mark that the model uses for a space count that mark
as a space, as the model does; repeated rows are counted alike; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Runs, blocks, byte_set, mix, small_batches, utf8

#: Bounds of the broadcast table and of the sample that fills it.
TABLE_ROWS, TABLE_CHARS, TABLE_SIZE = 2000, 5000, 1 << 16
#: Distinct pre-tokens that a worker remembers.
CACHE_SIZE = 200_000
_SLOTS = 1 << 18
_SPACE = byte_set(b" ")
_MARK = "▁".encode()


@cache
def _encoder(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


@cache
def _known(model: str) -> dict[bytes, int]:
    """The worker's cache for a model."""
    return {}


class LengthTable:
    """Open-addressed table from the 64-bit hash of a pre-token to its number of tokens (1 to 255)."""

    def __init__(self, keys: np.ndarray, lengths: np.ndarray):
        self.key, self.length = np.zeros(_SLOTS, np.uint64), np.zeros(_SLOTS, np.uint8)
        for k, v in zip(keys.tolist(), lengths.tolist(), strict=True):
            slot = k % _SLOTS
            while self.key[slot]:
                slot = (slot + 1) % _SLOTS
            self.key[slot], self.length[slot] = k, v

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Lengths, 0 where the table has none."""
        out = np.zeros(len(keys), np.int64)
        left, slot = np.arange(len(keys)), (keys % np.uint64(_SLOTS)).astype(np.int64)
        while len(left):
            found = self.key[slot]
            hit = found == keys[left]
            out[left[hit]] = self.length[slot[hit]]
            more = ~hit & (found != 0)
            left, slot = left[more], (slot[more] + 1) % _SLOTS
        return out


def _spans(data: np.ndarray, at: np.ndarray) -> tuple[Runs, np.ndarray, np.ndarray]:
    """Words between spaces, the spaces before each of them, and the spaces at each row's end."""
    words = Runs(data, at, _SPACE)
    before = words.start.copy()
    before[1:] -= words.end[:-1]
    opens = words.first[:-1][np.diff(words.first) > 0]
    row = words.row[opens]
    before[opens] = words.start[opens] - at[row]
    tail = np.diff(at)
    has = np.diff(words.first) > 0
    tail[has] = at[1:][has] - words.end[words.first[1:][has] - 1]
    before[opens] += 1  # the model puts a space before the text
    return words, before, tail


def _keys(words: Runs, before: np.ndarray) -> np.ndarray:
    key = words.hashes() ^ mix(before.astype(np.uint64))
    key[key == 0] = 1
    return key


def _encode(sp, raw: bytes, spaces: int) -> int:
    """Tokens of `spaces` spaces followed by raw; the first space is the one that the model itself adds."""
    if spaces == 0:
        raise ValueError("a pre-token starts with a space")
    return len(sp.encode(" " * (spaces - 1) + raw.decode()))


def _tail_tokens(sp, spaces: int) -> int:
    return 1 if spaces == 1 else len(sp.encode(" " * (spaces - 1)))


def _normal(block: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    import pyarrow.compute as pc

    column = block.column("_text")
    data, at = utf8(column)
    if _MARK in data.tobytes():
        data, at = utf8(pc.replace_substring(column, "▁", " "))
    return data, at


def count_block(block: pa.RecordBatch, sp, table: LengthTable, known: dict[bytes, int]) -> np.ndarray:
    data, at = _normal(block)
    words, before, tail = _spans(data, at)
    key = _keys(words, before)
    n = table.get(key)
    missing = np.flatnonzero(n == 0)
    if len(missing):
        _, first, back = np.unique(key[missing], return_index=True, return_inverse=True)
        lengths = np.empty(len(first), np.int64)
        raw = data.tobytes()
        for k, i in enumerate(missing[first].tolist()):
            piece, spaces = raw[words.start[i] : words.end[i]], int(before[i])
            name = piece if spaces == 1 else b"%d %s" % (spaces, piece)
            if (length := known.get(name)) is None:
                length = _encode(sp, piece, spaces)
                if len(piece) <= 256:
                    if len(known) >= CACHE_SIZE:
                        known.clear()
                    known[name] = length
            lengths[k] = length
        n[missing] = lengths[back]
    total = np.concatenate([[0], np.cumsum(n)])
    out = total[words.first[1:]] - total[words.first[:-1]]
    for r in np.flatnonzero(tail).tolist():
        # the space that the model adds stands before spaces that are the whole text
        out[r] += _tail_tokens(sp, int(tail[r]) + (words.first[r] == words.first[r + 1]))
    return out


def frequent(docs: DataFrame, model: str, text_col: str) -> LengthTable:
    """The table, from at most TABLE_ROWS texts of the first files; encoded on the driver, TABLE_SIZE entries at most."""
    # take() reads one partition, and more only while rows are missing
    rows = docs.select(F.substring(F.col(text_col), 1, TABLE_CHARS).alias("_text")).take(TABLE_ROWS)
    sample = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string())], ["_text"])
    sp, seen, where = _encoder(model), Counter(), {}
    for block in blocks(iter([sample]), "_text"):
        data, at = _normal(block)
        words, before, _ = _spans(data, at)
        key, raw = _keys(words, before), data.tobytes()
        kinds, first, times = np.unique(key, return_index=True, return_counts=True)
        for k, i, c in zip(kinds.tolist(), first.tolist(), times.tolist(), strict=True):
            seen[k] += c
            where.setdefault(k, (raw[words.start[i] : words.end[i]], int(before[i])))
    entries = [(k, n) for k, _ in seen.most_common(TABLE_SIZE) if (n := _encode(sp, *where[k])) < 256]
    return LengthTable(np.array([k for k, _ in entries], np.uint64), np.array([n for _, n in entries], np.int64))


def count_tokens(docs: DataFrame, model: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs. model: a path that executors can read."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(frequent(docs, model, text_col))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, known = _encoder(model), _known(model)
        for block in blocks(batches, "_text"):
            _, at = utf8(block.column("_text"))
            n = count_block(block, sp, shared.value, known)
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array(np.diff(at)), pa.array(n, pa.int64()), pa.array(n > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
