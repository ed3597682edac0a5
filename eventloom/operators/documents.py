"""Line, paragraph and turn operators over documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import sentences


def first_lines(docs: DataFrame) -> DataFrame:
    """doc_id, pos, line: lines of each text without later copies of one; a text's own lines stay within its row."""
    kept = F.array_distinct(F.split("text", "\n"))
    return docs.where("text is not null").select("doc_id", F.posexplode(kept).alias("pos", "line"))


def without_adjacent_copies(values):
    """An array without elements equal to the one before."""
    return F.filter(values, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(values, i - 1)))


def sentence_rows(docs: DataFrame, least: int) -> DataFrame:
    """sentence_id (doc_id#0000000), text: sentences of `least` characters or more, numbered over those kept."""
    # a lambda, as a function of two arguments would get the position as the characters to trim
    clean = F.transform(sentences(F.regexp_replace("text", r"\s+", " ")), lambda s: F.trim(s))
    kept = F.filter(clean, lambda s: F.length(s) >= least)
    rows = docs.where("text is not null").select("doc_id", F.posexplode(kept).alias("n", "text"))
    return rows.select(F.concat(F.col("doc_id").cast("string"), F.lit("#"), F.lpad(F.col("n").cast("string"), 7, "0")).alias("sentence_id"), "text")


def question_pairs(turns: DataFrame, ask: str, answer: str, flush: str) -> DataFrame:
    """conv_id, turn, question_turn, orphan: each answer with the latest question since the last `flush` turn."""
    by = W.partitionBy("conv_id").orderBy("turn")
    past = by.rowsBetween(W.unboundedPreceding, -1)
    cut = F.max(F.when(F.col("role") == flush, F.col("turn"))).over(past)
    last = F.max(F.when(F.col("role") == ask, F.col("turn"))).over(past)
    paired = turns.withColumn("_q", F.when(F.coalesce(last > cut, last.isNotNull()), last))
    return paired.where(F.col("role") == answer).select("conv_id", "turn", F.col("_q").alias("question_turn"), F.col("_q").isNull().alias("orphan"))


def top_phrases(items: DataFrame, by: str, bucket: str, phrase: str, order: str, k: int) -> DataFrame:
    """by, rank, phrase, n: the k most counted phrases, each counted once in a bucket; ties by first occurrence."""
    once = items.groupBy(by, bucket, phrase).agg(F.min(order).alias("_at"))
    count = once.groupBy(by, phrase).agg(F.count("*").alias("n"), F.min("_at").alias("_at"))
    rank = F.row_number().over(W.partitionBy(by).orderBy(F.desc("n"), "_at", phrase))
    return count.withColumn("rank", rank).where(F.col("rank") <= k).select(by, "rank", phrase, "n")
