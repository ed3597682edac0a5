"""Learned text embeddings: serial descent, averaging over partitions, odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.operators import embeddings as E
from eventloom.operators import models
from eventloom.operators.folds import with_fold

SMALL = E.Settings(rounds=4, rate=1.0, batch=4, dimension=8, buckets=256, part_rows=10_000)


def texts(n=300):
    """The label is whether a cheerful or a gloomy word follows 'not': single words tell nothing."""
    r, good, bad = random.Random(5), [f"good{k}" for k in range(6)], [f"bad{k}" for k in range(6)]
    out = []
    for k in range(n):
        y = k % 2
        a, b = r.choice(good), r.choice(bad)
        said = [f"not {b}", f"very {a}"] if y else [f"not {a}", f"very {b}"]
        r.shuffle(said)
        out.append((k, f"g{k % 9}", f"w{r.randint(0, 30)} {said[0]} and {said[1]} w{r.randint(0, 30)}", float(y)))
    return out


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(texts(), "id long, g string, t string, y double").repartition(3).cache()


def serial(rows, settings):
    """Plain loops over rows and features in the order of the hashes."""
    start = E.start(settings)
    vectors, weights, bias = start.vectors.copy(), start.weights.copy(), 0.0
    for k in range(settings.rounds):
        rate = settings.rate * (1 - k / settings.rounds)
        for first in range(0, len(rows), settings.batch):
            some = rows[first : first + settings.batch]
            old = vectors.copy()
            grad_w, grad_b = np.zeros_like(weights), 0.0
            for f, y in some:
                mean = old[f].mean(0)
                error = y - 1 / (1 + np.exp(-(mean @ weights + bias)))
                grad_w, grad_b = grad_w + error * mean, grad_b + error
                for j in f:
                    vectors[j] += rate / len(some) * error * weights / len(f)
            weights, bias = weights + rate / len(some) * grad_w, bias + rate / len(some) * grad_b
    return vectors, weights, bias


def ordered(data, settings):
    order = F.xxhash64("id", F.lit(settings.seed))
    rows = data.where("y is not null").select(order.alias("o"), F.col("id").cast("string").alias("n"), E.features(F.col("t"), settings.buckets).alias("f"), "y").collect()
    return [(r.o, (np.array(r.f, int), r.y)) for r in sorted(rows, key=lambda r: (r.o, r.n))]


def test_one_partition_is_serial_descent(data):
    model = E.train(data, "id", "t", "y", SMALL)
    vectors, weights, bias = serial([r for _, r in ordered(data, SMALL)], SMALL)
    assert np.abs(model.vectors - vectors).max() < 1e-9 and np.abs(model.weights - weights).max() < 1e-9 and abs(model.bias - bias) < 1e-9


def test_partitions_are_averaged(data):
    settings = E.Settings(rounds=1, rate=1.0, batch=4, dimension=8, buckets=256, part_rows=100)
    model = E.train(data, "id", "t", "y", settings)
    rows = ordered(data, settings)
    parts = [serial([r for o, r in rows if o % 3 == k], settings) for k in range(3)]
    assert np.abs(model.vectors - np.mean([p[0] for p in parts], 0)).max() < 1e-9 and np.abs(model.weights - np.mean([p[1] for p in parts], 0)).max() < 1e-9
    again = E.train(data.repartition(7), "id", "t", "y", settings)
    assert np.abs(model.vectors - again.vectors).max() < 1e-12


def auc(rows):
    pos, neg = [r.p for r in rows if r.y], [r.p for r in rows if not r.y]
    return np.mean([(p > q) + (p == q) / 2 for p in pos for q in neg])


def test_out_of_fold_beats_single_words(data):
    found = E.out_of_fold(with_fold(data, "g", 3), "id", "t", "y", 3, E.Settings(rounds=20, rate=2.0, batch=4, buckets=4096, part_rows=60)).collect()
    assert sorted(r.id for r in found) == list(range(300)) and auc(found) > 0.95
    one = models.zoo(data, {"e": models.Family("embedding", ["t"], {"rounds": 2})}, "id", "y", "g", 3, balanced=True)
    assert one.where("model = 'e'").count() == 300


def test_odd_rows(spark):
    rows = [(1, None, 1.0), (2, "", 0.0), (3, "a", None), (4, "a b", 1.0), (4, "a b", 1.0), (None, "c " * 5000, 0.0)]
    df = spark.createDataFrame(rows, "id long, t string, y double")
    model = E.train(df, "id", "t", "y", SMALL)
    got = E.score(df, model, "id", "t").collect()
    bias = 1 / (1 + np.exp(-model.bias))
    assert len(got) == 6 and all(0 < r.p < 1 for r in got) and [r.p for r in got if r.id in (1, 2)] == pytest.approx([bias, bias])
    none = E.train(df.limit(0), "id", "t", "y", SMALL)
    assert none.bias == 0 and not none.weights.any() and E.score(df.limit(0), none, "id", "t").count() == 0
