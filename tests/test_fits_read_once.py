"""Fits read their rows several times; columns that take work are made once, and folds are fitted side by side."""

import threading

import pytest
from pyspark.sql import functions as F

from eventloom.operators import embeddings, models


@pytest.fixture
def counted(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def work(i):
        made.add(1)
        return float(i % 7)

    rows = spark.range(120).select("id", (F.col("id") % 6).alias("g"), (F.col("id") % 2).cast("double").alias("y"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("at"))
    return rows.withColumns({"ends": F.col("at"), "x": work("id")}), made


def test_walk_forward(counted):
    df, made = counted
    assert models.walk_forward(df, [("2020-03-01", "2020-04-01"), ("2020-04-01", "2020-05-01")], "at", "ends", ["x"], "y", "ridge").count() == 60
    assert made.value == 120


@pytest.mark.parametrize("balanced", [False, True])
def test_out_of_fold(counted, balanced):
    df, made = counted
    assert models.out_of_fold(df, ["x"], "y", "logistic", "g", 3, balanced).count() == 120
    assert made.value == 120


def test_embeddings(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(i):
        made.add(1)
        return f"word{i % 2} word{i % 5}"

    df = spark.range(60).select("id", (F.col("id") % 3).alias("fold"), (F.col("id") % 2).cast("double").alias("y"), text("id").alias("t"))
    settings = embeddings.Settings(rounds=2, buckets=64, dimension=3)
    assert embeddings.out_of_fold(df, "id", "t", "y", 3, settings).count() == 60
    assert made.value == 60


def test_words_are_hashed_once_and_give_each_folds_own_fit(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(i):
        made.add(1)
        return f"word{i % 2 if i % 9 else 3} Word{i % 5} w{i % 7}" if i % 11 else None

    df = spark.range(60).select("id", (F.col("id") % 3).alias("fold"), (F.col("id") % 2).cast("double").alias("y"), text("id").alias("t"))
    got = models.out_of_given_fold(df, ["t"], "y", "text", 3)
    assert got.columns == ["id", "fold", "y", "t", "p"]
    got = {r.id: r.p for r in got.collect()}
    assert made.value == 60 == len(got)
    plain = df.fillna("", "t").cache()
    for k in range(3):
        own = models.predict(models.text_model(plain.where(F.col("fold") != k), "t", "y"), plain.where(F.col("fold") == k), "text")
        assert all(abs(got[r.id] - r.p) < 1e-9 for r in own.collect())


def test_folds_are_fitted_side_by_side(spark, monkeypatch):
    """Each fit waits for those of the other folds."""
    every = threading.Barrier(3, timeout=60)
    df = spark.range(30).select("id", (F.col("id") % 3).alias("fold"), (F.col("id") % 2).cast("double").alias("y"), F.lit("a b").alias("t"))
    monkeypatch.setattr(models, "fit", lambda *a, **k: float(every.wait() * 0))
    assert models.out_of_given_fold(df, ["id"], "y", "logistic", 3).count() == 30
    start = embeddings.start(embeddings.Settings(buckets=64, dimension=3))
    monkeypatch.setattr(embeddings, "_train", lambda *a: every.wait() * 0 or start)
    assert embeddings.out_of_fold(df, "id", "t", "y", 3, embeddings.Settings(buckets=64, dimension=3)).count() == 30
