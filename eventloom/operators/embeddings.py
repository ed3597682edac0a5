"""A text classifier on learned embeddings of hashed words and word pairs, trained in all partitions at once.

A text is the mean of the vectors of its features; a logistic unit over that mean gives the probability. In each round every partition runs plain
stochastic gradient descent in mini-batches over its own rows, from the same parameters; what it changed is averaged over the partitions (one
aggregation by feature) and starts the next round. Parameters are BUCKETS vectors of DIMENSION numbers whatever the corpus, so they can be broadcast.

With one partition a round is plain serial descent. Rows are dealt and ordered by hashes of key and seed, so a run can be repeated.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import staged
from .folds import at_once

DIMENSION, BUCKETS = 50, 1 << 14


@dataclass(frozen=True)
class Settings:
    """rounds: passes over the rows; rate: first learning rate, it falls to zero over the rounds; batch: rows of a step; part_rows: rows of a partition."""

    rounds: int = 10
    rate: float = 20.0
    batch: int = 8
    part_rows: int = 5000
    dimension: int = DIMENSION
    buckets: int = BUCKETS
    seed: int = 7


@dataclass(frozen=True)
class Embedding:
    vectors: np.ndarray
    weights: np.ndarray
    bias: float


def start(settings: Settings) -> Embedding:
    rng = np.random.default_rng(settings.seed)
    return Embedding(rng.uniform(-1, 1, (settings.buckets, settings.dimension)) / settings.dimension, np.zeros(settings.dimension), 0.0)


def features(text, buckets: int):
    """Buckets of the words and pairs of neighbouring words of a text, repeats kept; a null text has none."""
    place = lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int")

    def placed(words):
        pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b)))
        return F.concat(F.transform(words, place), F.transform(F.filter(pairs, lambda p: p.isNotNull()), place))

    # a list of one binds the words, so a text is split once
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    return F.element_at(F.transform(F.array(words), placed), 1)


def probability(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def descend(rows: list[np.ndarray], labels: np.ndarray, at: Embedding, rate: float, batch: int) -> Embedding:
    """One pass of mini-batch descent on the log loss.

    A step counts the features of its rows in a small table, so that it reads and writes the vector of each feature once, by products of matrices.
    """
    vectors, weights, bias = at.vectors.copy(), at.weights.copy(), at.bias
    sizes = np.array([len(r) for r in rows])
    for first in range(0, len(rows), batch):
        some = rows[first : first + batch]
        size = np.maximum(sizes[first : first + batch], 1).astype(float)
        feature = np.concatenate(some).astype(int)
        row = np.repeat(np.arange(len(some)), sizes[first : first + batch])
        used = np.flatnonzero(np.bincount(feature, minlength=len(vectors)))
        place = np.empty(len(vectors), int)
        place[used] = np.arange(len(used))
        share = np.bincount(row * len(used) + place[feature], minlength=len(some) * len(used)).reshape(len(some), len(used)) / size[:, None]
        own = vectors[used]
        mean = share @ own
        error = labels[first : first + batch] - probability(mean @ weights + bias)
        step = rate / len(some)
        vectors[used] = own + np.outer(step * (error @ share), weights)
        weights += step * (error @ mean)
        bias += step * float(error.sum())
    return Embedding(vectors, weights, bias)


def _pass(part: pd.DataFrame, sent, rate: float, batch: int) -> pd.DataFrame:
    """(feature, change) of the vectors that a partition's pass changed; feature -1 is the unit on top."""
    part, before = part.sort_values(["order", "name"]), sent.value
    rows = [np.asarray(f, int) for f in part["features"]]
    after = descend(rows, part["label"].to_numpy(float), before, rate, batch)
    moved = np.unique(np.concatenate(rows))
    top = np.append(after.weights - before.weights, after.bias - before.bias)
    changes = [np.append(c, 0.0) for c in after.vectors[moved] - before.vectors[moved]]
    return pd.DataFrame({"feature": np.append(moved, -1), "change": [*changes, top]})


def _passing(sent, rate: float, batch: int):
    return lambda part: _pass(part, sent, rate, batch)


def train(rows: DataFrame, key: str, text: str, label: str, settings: Settings = Settings()) -> Embedding:
    """Rows without a label don't count. Partitions are of about part_rows rows, however many there are; a round is two jobs."""
    return _train(staged(_placed(rows, key, text, label, settings), "features"), settings)


def _placed(rows: DataFrame, key: str, text: str, label: str, settings: Settings, *more: str) -> DataFrame:
    """order, name, label, features of rows, as training reads them, and more columns."""
    order = F.xxhash64(F.col(key), F.lit(settings.seed))
    return rows.select(*more, order.alias("order"), F.col(key).cast("string").alias("name"), F.col(label).cast("double").alias("label"), features(F.col(text), settings.buckets).alias("features"))


def _train(placed: DataFrame, settings: Settings) -> Embedding:
    spark, size = placed.sparkSession, settings.dimension + 1
    held = placed.where("label is not null").select("order", "name", "label", "features")
    n = max(1, -(-held.count() // settings.part_rows))
    now = start(settings)
    for k in range(settings.rounds):
        sent, rate = spark.sparkContext.broadcast(now), settings.rate * (1 - k / settings.rounds)
        dealt = held.withColumn("part", F.pmod("order", F.lit(n))).groupBy("part")
        passes = dealt.applyInPandas(_passing(sent, rate, settings.batch), "feature int, change array<double>")
        mean = passes.groupBy("feature").agg(F.array(*[F.sum(F.get("change", F.lit(j))) / n for j in range(size)]).alias("change")).toArrow().combine_chunks()
        feature, change = mean.column("feature").to_numpy(), mean.column("change").combine_chunks().flatten().to_numpy().reshape(-1, size)
        vectors, top = now.vectors.copy(), change[feature < 0].sum(0)
        vectors[feature[feature >= 0]] += change[feature >= 0, :-1]
        weights, bias = now.weights + top[:-1], now.bias + float(top[-1])
        sent.unpersist()
        now = Embedding(vectors, weights, bias)
    return now


def _score(frames: Iterator[pd.DataFrame], sent) -> Iterator[pd.DataFrame]:
    at = sent.value
    for frame in frames:
        mean = np.array([at.vectors[np.asarray(f, int)].mean(0) if len(f) else np.zeros(len(at.weights)) for f in frame["_features"]]).reshape(len(frame), -1)
        yield frame.drop(columns="_features").assign(p=probability(mean @ at.weights + at.bias))


def score(rows: DataFrame, model: Embedding, key: str, text: str) -> DataFrame:
    """key, p: probability of label 1; a text without words has that of the bias."""
    return _scored(rows.select(F.col(key).alias("_key"), features(F.col(text), len(model.vectors)).alias("_features")), model).withColumnRenamed("_key", key)


def _scored(named: DataFrame, model: Embedding) -> DataFrame:
    """The columns of named with p in place of _features."""
    sent = named.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"`{c}` {kind}" for c, kind in named.dtypes if c != "_features")
    return named.mapInPandas(lambda f: _score(f, sent), f"{kinds}, p double")


def out_of_fold(df: DataFrame, key: str, text: str, label: str, folds: int, settings: Settings = Settings()) -> DataFrame:
    """key, label, p: each row under the model that the other folds' rows give; df has the column fold. Features are made once for all folds."""
    own = df.select("fold", F.col(key).alias("_key"), F.col(label).alias("_label"), F.col(text).alias("_text"))
    held = staged(_placed(own, "_key", "_text", "_label", settings, "fold", "_key", "_label"), "features")

    def part(k: int) -> DataFrame:
        model = _train(held.where(F.col("fold") != k), settings)
        rest = held.where(F.col("fold") == k).select("_key", "_label", F.col("features").alias("_features"))
        return _scored(rest, model).select(F.col("_key").alias(key), F.col("_label").alias(label), "p")

    return reduce(DataFrame.unionByName, at_once(held, part, range(folds)))
