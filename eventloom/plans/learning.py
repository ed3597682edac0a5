"""Queries that fit models: no SQL gives their rows, tests hold them against known cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import features
from ..operators import embeddings as N
from ..operators import models as M
from ..operators.folds import with_fold
from ..sources.files import staged
from ..sources.views import table
from .evaluation import panel
from .registry import query


@query()
def l06_walk_forward(spark: SparkSession, sf: str) -> DataFrame:
    p = panel(spark, sf).withColumns({"size": F.log("score"), "ends": F.last_day(F.date_add("month", 1))})
    folds = [(f"{y}-01-01", f"{y + 1}-01-01") for y in range(1997, 2000)]
    return M.walk_forward(p, folds, "month", "ends", ["score", "size"], "ret", "ridge").select("fold", "month", "ticker", "ret", "p")


@query()
def l07_out_of_fold(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    columns = ["h14", "h21", "h24", "h25", "h26"]
    x = d.select("doc_id", "source", F.col("quality").cast("double").alias("y"), *features(F.col("text"))).select("doc_id", "source", "y", *columns)
    return M.out_of_fold(x, columns, "y", "logistic", "source", balanced=True).select("doc_id", "source", "y", "p")


@query()
def l08_text_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """Quality of labelled documents by learned embeddings of hashed words and pairs, out of balanced folds of whole sources."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").where("quality is not null")
    first = d.groupBy("doc_id").agg(F.min_by(F.struct("text", "source", F.col("quality").cast("double").alias("y")), F.struct("text", "source", "quality")).alias("r")).select("doc_id", "r.*")
    return N.out_of_fold(with_fold(staged(first, "labelled"), "source", 3), "doc_id", "text", "y", 3, N.Settings(rounds=5))
