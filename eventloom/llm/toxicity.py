"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are a text's distinct words, word pairs and pairs over one word, hashed to HASH_BITS bits. Training is the usual
per-coordinate FTRL-proximal with L1, so few weights differ from zero; those are broadcast and every text is scored on the
map side.

Bounds (parameters): the model is fitted on at most TRAIN_ROWS labelled rows, those with the smallest hash of
doc_id, in one task. All weights that aren't zero are broadcast: L1 leaves few, and there are never more than
features in those rows or hash values. Everything else covers all rows. Rows held out (crc32 of doc_id
modulo 5 is 0) are never trained on; labels, lang, source and doc_id are no features.

Defined cases: a null or empty text scores by the bias alone; without labels every score is that of the prior; a label row with
a null id or label is ignored, repeated ones count as their maximum; repeated documents score alike, and where documents of one
doc_id meet the bound of the sample, those with the smallest hash of their text are in it; an empty table gives an empty table; other
columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, Runs, blocks, byte_set, mix, small_batches, utf8

HASH_BITS = 24
TRAIN_ROWS, EPOCHS = 16_000, 3
ALPHA, BETA, L1, L2, PRIOR = 1.0, 1.0, 2.0, 0.1, -2.0
FOLDS = 5
_SEP = byte_set(ASCII_SPACE, b"""!"'()*+,-./:;<=>?@[\\]^_`{|}~#$%&""")


def occurrences(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, feature) of all words, then of all pairs, then of all pairs over a word."""
    words = Runs(data, at, _SEP)
    h, row = words.hashes(), words.row
    top = np.uint64(64 - HASH_BITS)
    yield row, (mix(h + np.uint64(1)) >> top).astype(np.int32)
    for gap, salt in ((1, 2), (2, 3)):
        inside = np.flatnonzero(row[gap:] == row[:-gap])
        yield row[inside], (mix(mix(h[inside]) + h[inside + gap] + np.uint64(salt)) >> top).astype(np.int32)


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, offsets): the sorted distinct features of each row of a block."""
    key = np.unique(np.concatenate([(row << HASH_BITS) | found for row, found in occurrences(data, at)]))
    cut = np.searchsorted(key, np.arange(len(at)) << HASH_BITS)
    return (key & ((1 << HASH_BITS) - 1)).astype(np.int32), cut


def lower(column: pa.Array) -> pa.Array:
    import pyarrow.compute as pc

    return pc.utf8_lower(column)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "_text"):
        found, cut = features(*utf8(lower(block.column("_text"))))
        lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(found, pa.int32()))
        columns = [*(block.column(c) for c in ("_order", "_tie", "_toxic")), lists]
        yield pa.RecordBatch.from_arrays(columns, ["_order", "_tie", "toxic", "features"])


class Ftrl:
    """Per-coordinate FTRL-proximal over binary features; the bias has no regularisation."""

    def __init__(self):
        self.z, self.n = np.zeros(1 << HASH_BITS, np.float32), np.zeros(1 << HASH_BITS, np.float32)
        self.bias_sum, self.bias = 0.0, PRIOR

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= L1, 0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(self.bias + w.sum(), -30, 30))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g
        self.bias_sum += g * g
        self.bias -= 0.1 * g / (1 + np.sqrt(self.bias_sum))


def fit(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, their weights, bias), rows learnt in the order given, EPOCHS times."""
    model = Ftrl()
    for _ in range(EPOCHS):
        for at, y in zip(rows, labels.tolist(), strict=True):
            model.learn(at, y)
    used = np.flatnonzero(np.abs(model.z) > L1)
    return used, model.weights(used), model.bias


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    order, label, rows = [], [], []
    for batch in batches:
        order += zip(batch.column("_order").to_pylist(), batch.column("_tie").to_pylist(), strict=True)
        label += batch.column("toxic").to_pylist()
        found, cut = batch.column("features").values.to_numpy(), batch.column("features").offsets.to_numpy()
        rows += [found[a:b].copy() for a, b in zip(cut[:-1], cut[1:], strict=True)]
    by = sorted(range(len(rows)), key=order.__getitem__)
    at, w, bias = fit([rows[k] for k in by], np.array([label[k] for k in by], np.int64))
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(w, bias), pa.float64())], ["feature", "weight"])


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0


class Weights:
    """Sorted features with their weights, and a bias."""

    def __init__(self, at: np.ndarray, weight: np.ndarray, bias: float):
        self.at, self.weight, self.bias = at, weight, bias
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[at & 0xFFFFF] = True

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A score for each row; only features that have a weight are made distinct."""
        total = np.zeros(len(offsets) - 1)
        if len(self.at):
            hits = []
            for row, found in occurrences(data, offsets):
                some = np.flatnonzero(self.maybe[found & 0xFFFFF])
                where = np.minimum(np.searchsorted(self.at, found[some]), len(self.at) - 1)
                hit = self.at[where] == found[some]
                hits.append((row[some[hit]] << HASH_BITS) | where[hit])
            key = np.unique(np.concatenate(hits))
            total = np.bincount(key >> HASH_BITS, self.weight[key & ((1 << HASH_BITS) - 1)], minlength=len(total))
        return 1 / (1 + np.exp(-np.clip(self.bias + total, -30, 30)))


def train(docs: DataFrame, labels: DataFrame) -> Weights:
    """Fit on labelled rows that aren't held out, at most TRAIN_ROWS of them."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_toxic"))
    known = known.withColumn("_order", F.xxhash64("doc_id")).orderBy("_order").limit(TRAIN_ROWS)
    rows = docs.select("doc_id", docs["text"].alias("_text")).join(F.broadcast(known), "doc_id")
    # a repeated doc_id could exceed the sample, so the bound holds for rows as well
    rows = rows.select("_order", F.xxhash64("_text").alias("_tie"), "_toxic", "_text")
    found = rows.mapInArrow(_featurise, "_order long, _tie long, toxic int, features array<int>")
    one = found.orderBy("_order", "_tie").limit(TRAIN_ROWS).repartition(1)
    out = one.mapInArrow(_train, "feature int, weight double").toArrow()
    at, w = out.column("feature").to_numpy(), out.column("weight").to_numpy()
    if not len(at):
        return Weights(np.zeros(0, np.int32), np.zeros(0), PRIOR)
    last = at == -1
    order = np.argsort(at[~last])
    return Weights(at[~last][order], w[~last][order], float(w[last][0]))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), labels))
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("_text")).withColumn("held_out", held_out())

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "_text"):
            s = model.value.score(*utf8(lower(block.column("_text"))))
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), block.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(judge, f"doc_id {kind}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that score under 0.5."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs.select("doc_id", docs[text_col].alias("text")), labels))

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text_col):
            yield block.filter(pa.array(model.value.score(*utf8(lower(block.column(text_col)))) < 0.5))

    return docs.mapInArrow(sieve, docs.schema)
