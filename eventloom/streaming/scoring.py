"""Scoring that may be killed at any time: a stream over files with a checkpoint, a sink that may see a batch twice, failures that are tried again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Scorer = Callable[[DataFrame], DataFrame]


def _put(scored: DataFrame, path: str, run: str) -> None:
    """The batch's rows, in a folder of its own that a second try replaces."""
    scored.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def score_new_files(spark: SparkSession, source: str, schema: str, out: str, scorer: Scorer, files: int = 100) -> None:
    """Score the rows of all files of source that earlier runs haven't scored, then return. scorer adds `score` and `error` (null: fine).

    The checkpoint lies beside the results; `files` are read in a batch, so that a killed run loses one batch of work and no row.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    query = (
        stream.writeStream.foreachBatch(lambda batch, number: _put(scorer(batch), f"{out}/tries", f"new-{number:09d}")).option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def latest(spark: SparkSession, out: str, key: str) -> DataFrame:
    """The last try of each key: a success if there is one."""
    tries = spark.read.parquet(f"{out}/tries")
    rest = [c for c in tries.columns if c != key]
    best = tries.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.col("error").isNull(), "run")).alias("_r"))
    return best.select(key, "_r.*")


def retry_failures(spark: SparkSession, out: str, key: str, scorer: Scorer) -> int:
    """Score the keys without a success again; how many there were. The round's number is one more than the last, so no try is replaced by another round's."""
    failed = latest(spark, out, key).where("error is not null")
    n = failed.count()
    if n:
        past = spark.read.parquet(f"{out}/tries").where("run like 'retry-%'").agg(F.max("run")).first()[0]
        number = int(past.removeprefix("retry-")) + 1 if past else 0
        _put(scorer(failed.drop("run", "score", "error")), f"{out}/tries", f"retry-{number:09d}")
    return n


def results(spark: SparkSession, out: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(scores, failures): one row for each key in one of the two."""
    last = latest(spark, out, key)
    return last.where("error is null").drop("error", "run"), last.where("error is not null").drop("score", "run")
