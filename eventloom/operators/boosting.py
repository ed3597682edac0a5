"""Gradient-boosted trees grown leaf by leaf over binned features.

Features are cut at quantiles of the training rows, once; the binned rows are staged. A split needs the sums of gradients in each bin of each feature over one
leaf: every task adds up its own rows, and one small aggregation (columns * bins numbers, whatever the rows) adds up the tasks. The leaf with the best
split grows next; only the smaller of its children is counted, the other one is what is left of the parent. Models are broadcast to score rows.

Missing values have a bin of their own, after all others. Fewer than LEAST_ROWS labelled rows, or one label value, give a constant.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import staged

LEAST_ROWS = 20


@dataclass(frozen=True)
class Settings:
    """loss: squared or logistic (labels 0 and 1); leaf_rows: rows of a leaf at least; l2: added to the sum of second derivatives."""

    trees: int = 10
    leaves: int = 8
    rate: float = 0.1
    bins: int = 32
    leaf_rows: int = 20
    l2: float = 1.0
    loss: str = "squared"


@dataclass
class Tree:
    """Node k is a leaf (feature -1) with a value, or sends bins up to `bin` of its feature to `left` and others to left + 1."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, bin: int, values: tuple[float, float]) -> int:
        self.feature[node], self.bin[node], self.left[node] = feature, bin, len(self.feature)
        for v in values:
            self.feature.append(-1)
            self.bin.append(0)
            self.left.append(0)
            self.value.append(v)
        return self.left[node]

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), int)
        feature, bin, left = np.array(self.feature), np.array(self.bin), np.array(self.left)
        while True:
            inner = np.flatnonzero(feature[at] >= 0)
            if not len(inner):
                return at
            node = at[inner]
            at[inner] = left[node] + (bins[inner, feature[node]] > bin[node])


@dataclass(frozen=True)
class Model:
    columns: list[str]
    cuts: list[list[float]]
    base: float
    trees: list[Tree]
    loss: str

    def raw(self, bins: np.ndarray) -> np.ndarray:
        return self.base + sum((np.array(t.value)[t.leaf_of(bins)] for t in self.trees), np.zeros(len(bins)))

    def predict(self, bins: np.ndarray) -> np.ndarray:
        raw = self.raw(bins)
        return 1 / (1 + np.exp(-raw)) if self.loss == "logistic" else raw


def binned(columns: list[str], cuts: list[list[float]]):
    """The number of cuts below each value; a missing one counts as above all."""
    place = lambda c, at: F.when(c.isNull() | F.isnan(c), F.lit(len(at) + 1)).otherwise(sum(((c > F.lit(v)).cast("int") for v in at), F.lit(0)))
    return F.array(*[place(F.col(c).cast("double"), at) for c, at in zip(columns, cuts, strict=True)])


def quantile_cuts(df: DataFrame, columns: list[str], bins: int) -> list[list[float]]:
    shares = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    got = df.agg(*[F.percentile_approx(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), shares, F.lit(100 * bins)) for c in columns]).first()
    return [sorted(set(v)) if v else [] for v in got]


def gradients(y: np.ndarray, raw: np.ndarray, loss: str) -> tuple[np.ndarray, np.ndarray]:
    if loss == "logistic":
        p = 1 / (1 + np.exp(-raw))
        return y - p, p * (1 - p)
    return y - raw, np.ones(len(y))


def _sums(frames: Iterator[pd.DataFrame], sent, leaf: int, width: int) -> Iterator[pd.DataFrame]:
    """(cell, g, h, n) of one leaf of the tree that grows (the last of the model) over a task's rows; a cell is feature * width + bin."""
    model = sent.value
    done = Model(model.columns, model.cuts, model.base, model.trees[:-1], model.loss)
    total = np.zeros((3, len(model.columns) * width))
    for frame in frames:
        bins = np.array(frame["bins"].tolist(), int).reshape(len(frame), -1)
        bins_here = bins[here := model.trees[-1].leaf_of(bins) == leaf]
        g, h = gradients(frame["y"].to_numpy(float)[here], done.raw(bins_here), model.loss)
        cell = (bins_here + np.arange(bins.shape[1]) * width).ravel()
        for k, w in enumerate((g, h, np.ones(len(g)))):
            total[k] += np.bincount(cell, np.repeat(w, bins.shape[1]), total.shape[1])
    used = np.flatnonzero(total[2])
    yield pd.DataFrame({"cell": used, "g": total[0, used], "h": total[1, used], "n": total[2, used]})


def best_split(hist: np.ndarray, settings: Settings) -> tuple[float, int, int] | None:
    """(gain, feature, bin) of hist (g, h and n by feature and bin); the first of equal gains, as gains count to nine digits."""
    left = np.cumsum(hist, axis=2)[:, :, :-1]
    whole = hist[:, 0].sum(axis=1)
    right = whole[:, None, None] - left
    score = lambda g, h: g**2 / (h + settings.l2)
    gain = score(left[0], left[1]) + score(right[0], right[1]) - score(whole[0], whole[1])
    gain = np.where((left[2] >= settings.leaf_rows) & (right[2] >= settings.leaf_rows), gain, -1.0)
    at = int(np.argmax(np.array([float(f"{v:.9g}") for v in gain.ravel()]))) if gain.size else 0
    if not gain.size or gain.ravel()[at] <= 1e-12:
        return None
    return float(f"{gain.ravel()[at]:.9g}"), *divmod(at, gain.shape[1])


def train(df: DataFrame, columns: list[str], label: str, settings: Settings = Settings()) -> Model:
    spark = df.sparkSession
    rows = df.where(F.col(label).isNotNull() & ~F.isnan(F.col(label).cast("double")))
    n, mean, kinds = rows.agg(F.count("*"), F.avg(label), F.count_distinct(label)).first()
    base = float(mean or 0.0)
    if n < LEAST_ROWS or kinds < 2:
        return Model(columns, [[] for _ in columns], base, [], "squared")
    if settings.loss == "logistic":
        base = float(np.log(base / (1 - base)))
    cuts = quantile_cuts(rows, columns, settings.bins)
    width = max(len(c) for c in cuts) + 2
    held = staged(rows.select(F.col(label).cast("double").alias("y"), binned(columns, cuts).alias("bins")), "binned")

    def histogram(model: Model, leaf: int) -> np.ndarray:
        sent = spark.sparkContext.broadcast(model)
        got = held.mapInPandas(lambda f: _sums(f, sent, leaf, width), "cell int, g double, h double, n double")
        got = got.groupBy("cell").agg(*[F.sum(c).alias(c) for c in "ghn"]).toPandas()
        out = np.zeros((3, len(columns) * width))
        out[:, got["cell"].to_numpy(int)] = got[["g", "h", "n"]].to_numpy().T
        return out.reshape(3, len(columns), width)

    trees: list[Tree] = []
    for _ in range(settings.trees):
        model = Model(columns, cuts, base, [*trees, Tree()], settings.loss)
        tree = model.trees[-1]
        hists = {0: histogram(model, 0)}
        splits = {0: best_split(hists[0], settings)}
        while len(hists) < settings.leaves and any(splits.values()):
            node = max((k for k, s in splits.items() if s), key=lambda k: (splits[k][0], -k))
            _, feature, bin = splits.pop(node)
            parent = hists.pop(node)
            lower, whole = parent[:, feature, : bin + 1].sum(axis=1), parent[:, feature].sum(axis=1)
            upper = whole - lower
            first = tree.split(node, feature, bin, tuple(float(settings.rate * g / (h + settings.l2)) for g, h, _ in (lower, upper)))
            small = first + int(upper[2] < lower[2])
            hists[small] = histogram(model, small)
            hists[2 * first + 1 - small] = parent - hists[small]
            splits |= {k: best_split(hists[k], settings) for k in (first, first + 1)}
        if len(tree.feature) == 1:
            break
        trees.append(tree)
    return Model(columns, cuts, base, trees, settings.loss)


def predict(df: DataFrame, model: Model) -> DataFrame:
    """df with p: the predicted value, or the probability of label 1."""
    if not model.trees:
        return df.withColumn("p", F.lit(float(model.base)))
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def value(bins: pd.Series) -> pd.Series:
        return pd.Series(sent.value.predict(np.array(bins.tolist(), int).reshape(len(bins), -1)))

    return df.withColumn("p", value(binned(model.columns, model.cuts)))
