"""Boosted trees against a plain search over all thresholds, and degenerate fits."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.operators import boosting as B

COLUMNS = ["a", "b", "c", "flat"]


def rows(n=500):
    r = random.Random(7)
    out = []
    for k in range(n):
        a, b, c = r.gauss(0, 1), r.choice([0.0, 1.0, 2.0, None]), r.random()
        y = (2.0 if a > 0.3 else -1.0) + (b or 0) * (1 if c > 0.5 else -1) + r.gauss(0, 0.3)
        out.append((k, a if r.random() < 0.9 else float("nan"), b, c, 1.0, y, float(y > 0)))
    return out


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(rows(), "id long, a double, b double, c double, flat double, y double, z double").repartition(5).cache()


def grown(bins, y, base, settings):
    """Raw scores and splits of trees found by trying every threshold on every leaf."""
    raw, all_splits = np.full(len(y), base), []
    for _ in range(settings.trees):
        g, h = (y - raw, np.ones(len(y))) if settings.loss == "squared" else (y - 1 / (1 + np.exp(-raw)), np.exp(-raw) / (1 + np.exp(-raw)) ** 2)
        leaves, splits, number = {0: np.arange(len(y))}, [], 1
        score = lambda i: g[i].sum() ** 2 / (h[i].sum() + settings.l2)  # noqa: E731, B023
        while len(leaves) < settings.leaves:
            best = None
            for node, i in leaves.items():
                for f in range(bins.shape[1]):
                    for t in range(bins[:, f].max()):
                        left, right = i[bins[i, f] <= t], i[bins[i, f] > t]
                        if min(len(left), len(right)) >= settings.leaf_rows:
                            gain = float(f"{score(left) + score(right) - score(i):.9g}")
                            if gain > 1e-12 and (best is None or (gain, -node, -f, -t) > best[0]):
                                best = ((gain, -node, -f, -t), node, f, t, left, right)
            if best is None:
                break
            _, node, f, t, left, right = best
            del leaves[node]
            leaves[number], leaves[number + 1] = left, right
            splits.append((node, f, t))
            number += 2
        for i in leaves.values():
            if splits:
                raw[i] += settings.rate * g[i].sum() / (h[i].sum() + settings.l2)
        all_splits.append(splits)
    return raw, all_splits


@pytest.mark.parametrize(("label", "loss"), [("y", "squared"), ("z", "logistic")])
def test_trees_match_a_plain_search(data, label, loss):
    settings = B.Settings(trees=3, leaves=5, rate=0.3, bins=8, leaf_rows=15, loss=loss)
    model = B.train(data, COLUMNS, label, settings)
    held = data.select("id", label, B.binned(COLUMNS, model.cuts).alias("bins")).orderBy("id").collect()
    bins, y = np.array([r.bins for r in held]), np.array([r[label] for r in held])
    mean = y.mean()
    raw, splits = grown(bins, y, np.log(mean / (1 - mean)) if loss == "logistic" else mean, settings)
    for tree, want in zip(model.trees, splits, strict=True):
        assert [(k, f, b) for k, (f, b) in enumerate(zip(tree.feature, tree.bin, strict=True)) if f >= 0] == sorted(want)
    assert np.allclose(model.raw(bins), raw, atol=1e-9)
    got = {r.id: r.p for r in B.predict(data, model).collect()}
    want = 1 / (1 + np.exp(-raw)) if loss == "logistic" else raw
    assert np.allclose([got[r.id] for r in held], want, atol=1e-9)
    assert ((want > 0.5) == (y > 0)).mean() > 0.8 if loss == "logistic" else np.corrcoef(want, y)[0, 1] > 0.8


def test_bins(data):
    cuts = B.quantile_cuts(data, COLUMNS, 4)
    assert len(cuts[0]) == 3 and cuts[3] == [1.0] and set(cuts[1]) <= {0.0, 1.0, 2.0}
    for r in data.select("a", "b", B.binned(COLUMNS, cuts).alias("bins")).collect():
        for value, at, bin in ((r.a, cuts[0], r.bins[0]), (r.b, cuts[1], r.bins[1])):
            assert bin == (len(at) + 1 if value is None or value != value else sum(value > c for c in at))


def test_degenerate_fits_are_constant(data):
    for df, want in ((data.limit(10), None), (data.withColumn("y", F.lit(2.0)), 2.0), (data.limit(0), 0.0), (data.withColumn("y", F.lit(None).cast("double")), 0.0)):
        model = B.train(df, COLUMNS, "y")
        assert not model.trees and (want is None or model.base == want)
        assert {r.p for r in B.predict(data, model).select("p").collect()} == {model.base}
    # nothing to split: a column without values and a constant
    model = B.train(data.withColumn("a", F.lit(None).cast("double")), ["a", "flat"], "y")
    assert not model.trees and model.base == pytest.approx(np.mean([r[5] for r in rows()]))
