"""Benchmark decontamination by the q-gram lemma.

A text within e edits of an item of length n has at least n - q + 1 - q * e of its q-grams, all within e diagonals of
one another. So the q-grams that a document shares with an item are counted in overlapping bands of diagonals; bands
that reach the bound mark a region, and a banded alignment of item and region decides.

Texts are compared in lower case with white space runs as one space; documents are the map side and aren't
shuffled. Items are a stated query set: they're dealt by hash into blocks of about BLOCK_BYTES each, staged once, and each block
is broadcast on its own and runs against all documents.

A row is one region: of the regions of an item in a document that overlap, the one with the fewest edits, the first of those.

Defined cases: null or empty texts hold nothing; an item too short for the bound to say anything (fewer than
MIN_ITEM characters) must occur exactly, and an empty or null one never does; repeated documents and repeated
items are each reported, null ids too; item_id keeps its type; items may be of any length; an empty table on either side gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, new_path, small_batches, utf8

Q = 8
#: Edits allowed for each byte of an item.
EDIT_RATE = 0.08
#: Shorter items are looked up exactly.
MIN_ITEM = 40
#: Bytes of items in one broadcast, about.
BLOCK_BYTES = 1 << 20
_BITS = 22
#: Makes every diagonal positive: more than the bytes of an item.
_SHIFT = 1 << 40
SCHEMA = "start int, end int, edits int, shared_qgrams int"


def normal(column: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.utf8_lower(column), r"\s+", " ")


def qgrams(data: np.ndarray) -> np.ndarray:
    """The q-gram at each byte as a 64-bit number (Q is 8: it is the bytes themselves)."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    raw = data.tobytes()
    for k in range(min(Q, n)):
        part = np.frombuffer(raw, "<u8", count=(len(raw) - k) // 8, offset=k)
        out[k::8] = part[: len(out[k::8])]
    return out


def edit_budget(size: int) -> int:
    """Edits allowed, no more than what leaves the lemma a positive bound."""
    return max(0, min(int(size * EDIT_RATE), (size - Q) // Q))


class Items:
    """A block of items and an index from q-gram to (item, place)."""

    def __init__(self, rows: list[tuple[object, bytes]], kind: pa.DataType):
        self.id, self.kind = [i for i, _ in rows], kind
        self.text = [t for _, t in rows]
        self.short = [k for k, t in enumerate(self.text) if 0 < len(t) < MIN_ITEM]
        self.budget = np.array([edit_budget(len(t)) if len(t) >= MIN_ITEM else 0 for t in self.text], np.int64)
        size = np.array([len(t) for t in self.text], np.int64)
        self.bound = np.maximum(1, size - Q + 1 - Q * self.budget)
        gram, item, place = [], [], []
        for k, t in enumerate(self.text):
            if len(t) >= MIN_ITEM:
                g = qgrams(np.frombuffer(t, np.uint8))
                gram.append(g)
                item.append(np.full(len(g), k))
                place.append(np.arange(len(g)))
        gram = np.concatenate(gram) if gram else np.zeros(0, np.uint64)
        order = np.argsort(gram, kind="stable")
        self.item = np.concatenate(item)[order] if item else np.zeros(0, np.int64)
        self.place = np.concatenate(place)[order] if place else np.zeros(0, np.int64)
        self.gram, self.first = np.unique(gram[order], return_index=True)
        self.first = np.append(self.first, len(gram))
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[self.slot(self.gram)] = True

    @staticmethod
    def slot(gram: np.ndarray) -> np.ndarray:
        return ((gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)).astype(np.int64)


def banded_distance(item: bytes, text: bytes, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the part of text nearest to item, if within budget; text may go on either side for free.

    One row of the alignment for each byte of item; a row is kept as a whole as text is about as long as item. The
    cheapest end is the first one; its start is carried along.
    """
    b = np.frombuffer(text, np.uint8)
    n = len(b)
    step = np.arange(n + 1)
    cost, start = np.zeros(n + 1, np.int64), step.copy()
    wide = n + 1
    for c in item:
        # best of substitution and deletion, then insertions as a running minimum of cost - column
        diag, up = cost[:-1] + (b != c), cost[1:] + 1
        new, new_start = np.empty(n + 1, np.int64), np.empty(n + 1, np.int64)
        new[0], new_start[0] = cost[0] + 1, start[0]
        better = diag <= up
        new[1:] = np.where(better, diag, up)
        new_start[1:] = np.where(better, start[:-1], start[1:])
        packed = np.minimum.accumulate((new - step) * wide + (n - step)) # equal cost: the nearest column
        from_col = n - np.mod(packed, wide)
        cost = (packed - (n - from_col)) // wide + step
        start = new_start[from_col]
        if cost.min() > budget:
            return None
    end = int(np.argmin(cost))
    return int(cost[end]), int(start[end]), end


def find(data: bytes, items: Items) -> list[tuple[int, int, int, int, int]]:
    """(item, start, end, edits, shared q-grams) of each region that holds an item."""
    raw = np.frombuffer(data, np.uint8)
    gram = qgrams(raw)
    hits = np.flatnonzero(items.maybe[items.slot(gram)])
    return _regions(data, hits, gram[hits], items)


def _regions(data: bytes, hits: np.ndarray, gram: np.ndarray, items: Items) -> list[tuple[int, int, int, int, int]]:
    out = []
    for k in items.short:
        p = data.find(items.text[k])
        while p >= 0:
            out.append((k, p, p + len(items.text[k]), 0, max(0, len(items.text[k]) - Q + 1)))
            p = data.find(items.text[k], p + len(items.text[k]))
    if not len(hits) or not len(items.gram):
        return out
    where = np.minimum(np.searchsorted(items.gram, gram), len(items.gram) - 1)
    true = items.gram[where] == gram
    hits, where = hits[true], where[true]
    n = items.first[where + 1] - items.first[where]
    entry = np.repeat(items.first[where] - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n, n) + np.arange(n.sum())
    item = items.item[entry]
    place = items.place[entry]
    diagonal = np.repeat(hits, n) - place + _SHIFT
    # an item can't reach its bound with fewer shared places in all
    enough = np.bincount(item, minlength=len(items.id))[item] >= items.bound[item]
    item, place, diagonal, at = item[enough], place[enough], diagonal[enough], np.repeat(hits, n)[enough]
    if not len(item):
        return out
    regions: list[tuple[int, int, int, int, int]] = []
    half = items.budget[item] + 1
    for shift in (0, 1):  # bands 2(e + 1) wide, at every e + 1: any e + 1 diagonals lie in one
        band = (diagonal // half + shift) // 2
        # a q-gram of the item counts once in a band, so one repeated in the text can't reach the bound
        order = np.lexsort((diagonal, place, band, item))
        i, b, p, d = item[order], band[order], place[order], diagonal[order]
        new_band = np.append(True, (i[1:] != i[:-1]) | (b[1:] != b[:-1]))
        starts = np.flatnonzero(new_band)
        count = np.add.reduceat((new_band | np.append(True, p[1:] != p[:-1])).astype(np.int64), starts)
        least = np.minimum.reduceat(d, starts)
        for g in np.flatnonzero(count >= items.bound[i[starts]]).tolist():
            k = int(i[starts[g]])
            begin = int(least[g]) - _SHIFT
            e = int(items.budget[k])
            text = items.text[k]
            exact = data.find(text, max(0, begin - e), begin + 3 * e + 2 + len(text))
            if exact >= 0:
                found = (k, exact, exact + len(text), 0, int(count[g]))
            else:
                a, b = max(0, begin - e), min(len(data), begin + 3 * e + 2 + len(text) + e)
                near = banded_distance(text, data[a:b], e)
                if near is None or near[0] > e:
                    continue
                found = (k, a + near[1], a + near[2], near[0], int(count[g]))
            regions.append(found)
    ends: dict[int, list[tuple[int, int]]] = {}
    for found in sorted(set(regions), key=lambda x: (x[0], x[3], x[1], x[2], -x[4])):
        own = ends.setdefault(found[0], [])
        if all(found[1] >= b or found[2] <= a for a, b in own):
            own.append((found[1], found[2]))
            out.append(found)
    return out


def _scan(batches: Iterator[pa.RecordBatch], items: Items, keep_rows: bool = False) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "_text"):
        data, at = utf8(normal(block.column("_text")))
        gram = qgrams(data)
        hits = np.flatnonzero(items.maybe[items.slot(gram)])
        cut = np.searchsorted(hits, at)
        fewest = items.bound[[len(t) >= MIN_ITEM for t in items.text]].min(initial=1 << 40)
        whole = data.tobytes()
        row, found = [], []
        for r in range(block.num_rows):
            a, b = int(cut[r]), int(np.searchsorted(hits, at[r + 1] - Q, side="right"))
            if b - a >= fewest or items.short:
                h = hits[a:b]
                for x in _regions(whole[at[r] : at[r + 1]], h - at[r], gram[h], items):
                    row.append(r)
                    found.append(x)
        if row:
            ids = block.column("doc_id").take(pa.array(row, pa.int64()))
            k, start, end, edits, n = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([items.id[x] for x in k], items.kind), *(pa.array(x, pa.int32()) for x in (start, end, edits, n))],
                ["doc_id", "item_id", "start", "end", "edits", "shared_qgrams"],
            )


def item_blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> Iterator[Items]:
    """The items in blocks of about BLOCK_BYTES; one block is on the driver at a time."""
    spark = benchmark.sparkSession
    rows = benchmark.where(F.length(F.trim(text_col)) > 0).select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = -(-total // BLOCK_BYTES)
    path = new_path(spark, "items")
    rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n or 1))).repartition("block").write.partitionBy("block").parquet(path)
    staged = spark.read.schema(f"item_id {rows.schema['item_id'].dataType.simpleString()}, text string, block long").parquet(path)
    for k in range(n):
        got = staged.where(F.col("block") == k).select("item_id", "text").orderBy("item_id", "text").toArrow()
        if got.num_rows:
            text = normal(got.column("text").combine_chunks()).to_pylist()
            kind = got.schema.field("item_id").type
            yield Items(list(zip(got.column("item_id").to_pylist(), [t.strip().encode() for t in text], strict=True)), kind)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each region of a document that holds an item: doc_id, item_id, start, end (bytes of the normal text), edits."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("_text"))
    kinds = rows.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, {SCHEMA}"
    found = []
    for items in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(items)
        found.append(rows.mapInArrow(lambda b, s=shared: _scan(b, s.value), schema))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, in which no item is found; a block of items is one pass of a sieve over the rows."""
    spark = docs.sparkSession
    small_batches(spark)
    for items in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(items)

        def sieve(batches: Iterator[pa.RecordBatch], s=shared) -> Iterator[pa.RecordBatch]:
            for block in blocks(batches, text_col):
                named = pa.RecordBatch.from_arrays([pa.array(range(block.num_rows), pa.int64()), block.column(text_col)], ["doc_id", "_text"])
                bad = {x for out in _scan(iter([named]), s.value) for x in out.column("doc_id").to_pylist()}
                yield block.filter(pa.array([r not in bad for r in range(block.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(sieve, docs.schema)
    return docs
