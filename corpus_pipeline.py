"""The corpus pipeline: toxicity, quality rules, near copies, decontamination, mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs; all but the last return the columns of documents. Documents that the first four stages reject are gone from
then on. The last returns the rows that the mixture takes, with size, source_size, target and taken (words, repeats counted); a name
that documents has already is given as mix_size and so on. Rows with null or repeated doc_ids are told apart by a number of their own.

A document that holds a benchmark item is dropped whole. SQL can't express the learned and the sampled stages, so
there is no ORACLE_SQL; tests hold each stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import decontam, mixing, neardup, quality, toxicity
from eventloom.llm.common import numbered, odd_ids, stage, table

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def _free(name: str, taken: list[str]) -> str:
    while name in taken:
        name = f"mix_{name}"
    return name


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key = numbered(docs) if odd_ids(docs) else (docs, "doc_id")
    names = {c: _free(c, docs.columns) for c in ("size", "source_size", "target", "taken")}
    taken = mixing.mix(rows, [c for c in [key] if c != "doc_id"]).where("taken > 0")
    taken = taken.select(key, *[F.col(c).alias(name) for c, name in names.items()])
    return rows.join(taken, key).select(*docs.columns, *names.values())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", keep_quality),
    ("near copies", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("source mixture", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
