"""Quality rules by compression bands: zstandard ratios of whole documents and of fixed chunks.

A text that compresses better than prose of its length repeats itself; one that hardly compresses is
noise (keys, encoded data). Limits depend on the length, as short texts give a dictionary coder less to
work with. A few counting rules go first (`base_failed`).

The lower limits lie between the texts labelled bad and good in a sample of 10,000 documents, length by length and
over all languages, nearer to the bad where both meet; the upper ones lie well above any text of that sample. They are constants: no
label, language or source is read when a text is judged.

Defined cases: a null or empty text has no words and fails; a text of one very long word is measured like any
other; repeated rows are judged alike; an empty table gives an empty table; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import ASCII_SPACE, Runs, blocks, byte_set, mix, per_row, small_batches, utf8

MIN_WORDS = 50
#: Percent of words in repeated three-word windows.
MAX_REPEAT_PERCENT = 50
ZSTD_LEVEL = 3
CHUNK_BYTES = 4096
#: (bytes up to, lowest ratio, highest ratio) of whole documents.
DOCUMENT_BANDS = [
    (512, 0.535, 0.85), (1024, 0.5, 0.78), (2048, 0.472, 0.7), (4096, 0.448, 0.64), (8192, 0.424, 0.6), (16384, 0.403, 0.58),
    (32768, 0.388, 0.56), (float("inf"), 0.372, 0.55),
]
#: The same of one chunk; a last chunk under MIN_CHUNK bytes is judged with the whole only.
CHUNK_BANDS = [(2048, 0.455, 0.72), (float("inf"), 0.436, 0.66)]
MIN_CHUNK = 1024
#: Share of a document's chunks outside their band that rejects it.
MAX_BAD_CHUNKS = 0.3

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, zstd_ratio double, n_chunks int, n_bad_chunks int, reason string"
)
_SPACE, _LINE, _SYMBOL = byte_set(ASCII_SPACE), byte_set(b"\n"), byte_set(b"#*$%&|<>")
#: Bytes that begin a character of a word.
_WORD_CHAR = ~_SPACE & ((np.arange(256) & 0xC0) != 0x80)


def word_counts(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of the base rules for each row of a block."""
    words, lines = Runs(data, at, _SPACE), Runs(data, at, _LINE)
    n_words = np.diff(words.first)
    # a line counts if a word begins in it
    real = np.searchsorted(words.start, lines.end) > np.searchsorted(words.start, lines.start)
    row = lines.row[real]
    key = mix(lines.hashes()[real] ^ mix(row.astype(np.uint64) + np.uint64(1)))
    del lines
    distinct = np.bincount(row[np.unique(key, return_index=True)[1]], minlength=len(n_words))
    n_lines = np.bincount(row, minlength=len(n_words))
    return {
        "n_words": n_words,
        "word_chars": per_row(_WORD_CHAR[data], at),
        "n_symbols": per_row(_SYMBOL[data], at),
        "n_dup_lines": n_lines - distinct,
        "n_repeat_words": per_row(_in_repeated_windows(words), words.first),
    }


def _in_repeated_windows(words: Runs) -> np.ndarray:
    """For each word: is it in a three-word window that its row has twice or more?"""
    h, n = words.hashes(), len(words.row)
    covered = np.zeros(n, bool)
    if n < 3:
        return covered
    whole = np.flatnonzero(words.row[2:] == words.row[:-2])
    a, b, c = h[whole], h[whole + 1], h[whole + 2]
    key = mix(mix(mix(a) + b) + c) ^ mix(words.row[whole].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    for k in range(3):
        covered[whole[twice] + k] = True
    return covered


def _outside(ratio: float, size: int, bands: list[tuple[float, float, float]]) -> str:
    for upto, low, high in bands:
        if size <= upto:
            return "repetitive" if ratio < low else "incompressible" if ratio > high else ""
    return ""


def compression_verdict(raw: bytes, pack: zstandard.ZstdCompressor) -> tuple[float, int, int, str]:
    """(ratio of the whole, chunks judged, chunks outside their band, reason or '')."""
    ratio = len(pack.compress(raw)) / len(raw)
    reason = _outside(ratio, len(raw), DOCUMENT_BANDS)
    chunks = bad = 0
    if len(raw) > CHUNK_BYTES:
        for k in range(0, len(raw), CHUNK_BYTES):
            chunk = raw[k : k + CHUNK_BYTES]
            if len(chunk) >= MIN_CHUNK:
                chunks += 1
                bad += bool(_outside(len(pack.compress(chunk)) / len(chunk), len(chunk), CHUNK_BANDS))
        if not reason and bad > MAX_BAD_CHUNKS * chunks:
            reason = "chunks"
    return ratio, chunks, bad, reason


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=ZSTD_LEVEL)
    for block in blocks(batches, "_text"):
        data, at = utf8(block.column("_text"))
        counts = word_counts(data, at)
        failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])
        ratio, n_chunks, n_bad, reason = [], [], [], []
        for k in range(block.num_rows):
            raw = data[at[k] : at[k + 1]].tobytes()
            r, c, b, why = compression_verdict(raw, pack) if raw else (None, 0, 0, "")
            for out, x in ((ratio, r), (n_chunks, c), (n_bad, b), (reason, "base" if failed[k] else why or None)):
                out.append(x)
        kept = pa.array([x is None for x in reason], pa.bool_())
        new = {k: pa.array(v, pa.int64()) for k, v in counts.items()} | {
            "base_failed": pa.array(failed), "kept": kept, "zstd_ratio": pa.array(ratio, pa.float64()),
            "n_chunks": pa.array(n_chunks, pa.int32()), "n_bad_chunks": pa.array(n_bad, pa.int32()), "reason": pa.array(reason, pa.string()),
        }
        keep = [c for c in block.schema.names if c != "_text"]
        yield pa.RecordBatch.from_arrays([*(block.column(c) for c in keep), *new.values()], [*keep, *new])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, the counts, base_failed, kept and what the verdict rests on, for each row of docs. Map only."""
    small_batches(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_judge, f"doc_id {kind}, {SCHEMA}")


def _sieve(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, text_col):
        named = pa.RecordBatch.from_arrays([pa.array(range(block.num_rows), pa.int32()), block.column(text_col)], ["doc_id", "_text"])
        kept = [x for out in _judge(iter([named])) for x in out.column("kept").to_pylist()]
        yield block.filter(pa.array(kept, pa.bool_()))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that judge() keeps."""
    small_batches(docs.sparkSession)
    return docs.mapInArrow(lambda b: _sieve(b, text_col), docs.schema)
