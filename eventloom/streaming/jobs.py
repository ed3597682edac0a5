"""Structured Streaming counterparts of the batch operators: windowed counts, keep-latest, question pairing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import entry_date


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """day, event_type, n, total: by entry day; an append-mode result once a day is `late` old."""
    stamped = events.withColumn("at", F.col("ts").cast("timestamp")).withColumn("entry", entry_date(F.col("at")))
    w = stamped.withWatermark("at", late).groupBy(F.window("at", "1 day").alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").cast("date").alias("day"), "event_type", "n", "total")


def keep_latest(batch: DataFrame, _epoch: int, path: str, key: str, order: str) -> None:
    """foreachBatch sink: a table with the latest row of each key, rewritten to the folder that the epoch names."""
    spark = batch.sparkSession
    before = f"{path}/{_epoch - 1}"
    rows = batch if not _epoch else spark.read.parquet(before).unionByName(batch)
    last = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("r")).select(key, "r.*")
    last.write.mode("overwrite").parquet(f"{path}/{_epoch}")


def open_questions(turns: DataFrame) -> DataFrame:
    """conv_id, turn, question_turn: each answer with the latest question seen, kept as state for each conversation."""

    def pair(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        question = state.get[0] if state.exists else -1
        for rows in batches:
            out = []
            for turn, role in rows.sort_values("turn")[["turn", "role"]].itertuples(index=False):
                if role == "user":
                    question = turn
                elif role == "system":
                    question = -1
                else:
                    out.append((key[0], turn, question))
            if out:
                yield pd.DataFrame(out, columns=["conv_id", "turn", "question_turn"])
        state.update((int(question),))

    return turns.groupBy("conv_id").applyInPandasWithState(pair, "conv_id long, turn long, question_turn long", "question long", "append", "NoTimeout")
