"""Leakage and consistency checks as counts of violations, gathered into one audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """check, rows, violations, passed: one pass over df for all its rules; a null verdict is a violation."""
    bad = [F.struct(F.lit(name).alias("check"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("violations")) for name, ok in rules.items()]
    got = df.agg(F.count("*").alias("rows"), F.array(*bad).alias("all"))
    return got.select("rows", F.explode("all").alias("c")).select("c.check", "rows", "c.violations", (F.col("c.violations") == 0).alias("passed"))


def fold_rules(train_end: str, at: str, target_end: str, part: str, start: str) -> dict[str, Column]:
    """Train rows end before the fold, test rows begin in it, labels of train rows don't reach it."""
    train, test = F.col(part) == "train", F.col(part) == "test"
    return {
        "train before fold": ~train | (F.col(at) < F.col(start)), "test in fold": ~test | (F.col(at) >= F.col(start)),
        "labels purged": ~train | F.col(target_end).isNull() | (F.col(target_end) < F.col(train_end)),
    }


def audit(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def pending(sample: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed run still has to do."""
    return sample.join(done.select(key).distinct(), key, "left_anti")


def token_windows(text: str, size: int, stride: int) -> Column:
    """Overlapping windows of words; the last reaches the end, a short text is one window."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    n = F.size(words)
    starts = F.sequence(F.lit(0), F.greatest(n - size + stride - 1, F.lit(0)), F.lit(stride))
    return F.transform(starts, lambda s: F.slice(words, s + 1, F.lit(size)))
