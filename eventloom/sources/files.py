"""File sources and sinks: wide CSV, zipped CSV, CSV with a preamble, JSON lines, transcripts, staged parquet, manifests."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def select_present(df: DataFrame, required: list[str], optional: list[str]) -> DataFrame:
    """Required columns, which must exist, then the optional ones that do; each once, in the order given."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {missing}")
    return df.select(*dict.fromkeys([*required, *(c for c in optional if c in df.columns)]))


def wide_csv(spark: SparkSession, path: str, columns: list[str], drop_type: str = "delete") -> DataFrame:
    """Chosen columns of a wide CSV as text; rows of one signal type dropped, dots in tickers as dashes."""
    df = select_present(spark.read.csv(path, header=True), columns, [])
    if "SignalType" in columns:
        df = df.where(F.col("SignalType").isNull() | (F.col("SignalType") != drop_type))
    return df.withColumns({c: F.replace(F.col(c), F.lit("."), F.lit("-")) for c in columns if "ticker" in c.lower()})


def coerce(df: DataFrame, whole: list[str], real: list[str], counts: list[str]) -> DataFrame:
    """Lenient types: invalid numbers become null, invalid counts 0."""
    kinds = {c: F.col(c).try_cast("bigint") for c in whole} | {c: F.col(c).try_cast("double") for c in real}
    return df.withColumns(kinds | {c: F.coalesce(F.col(c).try_cast("double").try_cast("int"), F.lit(0)) for c in counts})


def zipped_csv(spark: SparkSession, path: str, columns: list[str], member: str | None = None, rows: int = 50_000) -> DataFrame:
    """CSV members of ZIP archives as text columns: the named member, else the first .csv; an archive is one task, read in chunks."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    names = archive.namelist()
                    name = next((n for n in names if n.rpartition("/")[2] == member), None) or next(n for n in names if n.lower().endswith(".csv"))
                    with archive.open(name) as raw:
                        yield from pd.read_csv(raw, usecols=columns, dtype=str, chunksize=rows, keep_default_na=False)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, ", ".join(f"`{c}` string" for c in columns))


def csv_after_preamble(spark: SparkSession, path: str, first: str, keep: str = r"^[A-Z0-9\-]+$") -> DataFrame:
    """ticker, file: first column of the rows after the line that begins with `first`, where it fits `keep`. Files are small."""
    lines = spark.read.text(path, wholetext=True).select(F.split("value", r"\r?\n").alias("lines"), F.col("_metadata.file_name").alias("file"))
    at = F.array_position(F.transform("lines", lambda x: F.startswith(x, F.lit(first))), F.lit(True))
    rows = lines.where(at > 0).select("file", F.explode(F.slice("lines", (at + 1).cast("int"), F.size("lines"))).alias("line"))
    ticker = F.regexp_replace(F.regexp_extract("line", r'^("[^"]*"|[^,]*)', 1), '"', "")
    return rows.select(ticker.alias("ticker"), "file").where(F.col("ticker").rlike(keep)).distinct()


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a known schema; a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """ticker, quarter, text of files named TICKER_Q-YYYY.txt; other names are left out."""
    raw = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_name").alias("name"))
    part = lambda k: F.regexp_extract("name", r"^([^_]+)_(Q?\d)-(\d{4})\.txt$", k)
    return raw.where(part(1) != "").select(part(1).alias("ticker"), F.concat(part(2), F.lit("-"), part(3)).alias("quarter"), "text")


def zip_columns(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Two tables of the same rows side by side by an explicit row key; a key that only one has fails, as do clashing columns."""
    clash = set(left.columns) & set(right.columns) - {key}
    if clash:
        raise ValueError(f"clashing columns: {sorted(clash)}")
    r = right.withColumnRenamed(key, "_right")
    both = left.join(r, left[key] == r["_right"], "full")
    whole = F.when(F.col(key).isNull() | F.col("_right").isNull(), F.raise_error(F.lit("row counts differ")).cast("boolean")).otherwise(F.lit(True))
    return both.withColumn("_ok", whole).where("_ok").drop("_ok", "_right")


def write_manifest(df: DataFrame, path: str, phase: str, parameters: dict[str, str], inputs: dict[str, DataFrame] | None = None) -> None:
    """Parquet output with a one-row manifest beside it: phase, parameters, content hashes of inputs and output, rows."""
    df.write.mode("overwrite").parquet(f"{path}/data")
    back = df.sparkSession.read.parquet(f"{path}/data")
    row = fingerprint(back).select(F.lit(phase).alias("phase"), _text_map(parameters).alias("parameters"), _text_map(input_digests(inputs)).alias("inputs"), "rows", "digest")
    row.write.mode("overwrite").parquet(f"{path}/manifest")


def _text_map(pairs: dict[str, str]):
    items = [F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in sorted(pairs.items())]
    return F.map_from_entries(F.array(*items)) if items else F.create_map().cast("map<string,string>")


def input_digests(inputs: dict[str, DataFrame] | None) -> dict[str, str]:
    return {name: fingerprint(df).first().digest for name, df in (inputs or {}).items()}


def fingerprint(df: DataFrame) -> DataFrame:
    """rows, digest: a hash of the content that doesn't depend on the order of rows.

    Each value is hashed with its column and with whether it is null; two sums of the rows' hashes, so that equal rows add up.
    """
    h = F.xxhash64(*[F.xxhash64(F.lit(c), F.col(c).isNull(), F.col(c)) for c in sorted(df.columns)])
    total = lambda x: F.coalesce(F.sum(x.cast("decimal(20,0)")), F.lit(0)).cast("string")
    return df.agg(F.count("*").alias("rows"), F.concat_ws(":", total(h), total(F.xxhash64(h, F.lit("again")))).alias("digest"))


def fresh(spark: SparkSession, path: str, phase: str, parameters: dict[str, str], inputs: dict[str, DataFrame] | None = None) -> bool:
    """Does the manifest at path fit phase, parameters, the inputs and the data that is there?"""
    saved, now = spark.read.parquet(f"{path}/manifest").first(), fingerprint(spark.read.parquet(f"{path}/data")).first()
    return (saved.phase, saved.parameters, saved.inputs, saved.rows, saved.digest) == (phase, parameters, input_digests(inputs), now.rows, now.digest)


def write_json_lines(df: DataFrame, path: str) -> None:
    """One record a line; null fields are left out."""
    df.write.mode("overwrite").json(path)


def write_documents(df: DataFrame, keys: list[str], path: str) -> None:
    """Nested records as JSON, a folder for each key, so that one key can be replaced or read alone."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).json(path)


def read_documents(spark: SparkSession, path: str, schema: str, **keys) -> DataFrame:
    """The records of the given keys; only their folders are listed. A malformed record fails the read."""
    found = json_lines(spark, path, schema)
    for name, value in keys.items():
        found = found.where(F.col(name) == value)
    return found


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """word, positive, negative of a dictionary CSV (Word, Positive, Negative: a year above 0 is a member).

    Words are trimmed and in lower case; blank words and rows with an invalid year are left out, an empty year is 0, and a word
    that occurs twice has what either row says.
    """
    raw = select_present(spark.read.csv(path, header=True), ["Word", "Positive", "Negative"], [])
    year = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("0")).try_cast("int")
    rows = raw.select(F.lower(F.trim("Word")).alias("word"), year("Positive").alias("p"), year("Negative").alias("n")).where("word != '' and p is not null and n is not null")
    return rows.groupBy("word").agg((F.max("p") > 0).alias("positive"), (F.max("n") > 0).alias("negative")).where("positive or negative")


def dictionary_scores(docs: DataFrame, words: DataFrame) -> DataFrame:
    """doc_id, positive, negative, score of every text: counts of dictionary words, and (p - n) / (p + n), null without any.

    Words are counted within their text before the join; the dictionary is as large as it is, so the join is left to Spark.
    """
    said = docs.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"))).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("_k"))
    count = lambda kind: F.sum(F.when(F.col(kind), F.col("_k")).otherwise(0)).alias(kind)
    found = said.join(words, "word").groupBy("doc_id").agg(count("positive"), count("negative"))
    both = docs.select("doc_id").join(found, "doc_id", "left").fillna(0, ["positive", "negative"])
    p, n = F.col("positive"), F.col("negative")
    return both.withColumn("score", F.when(p + n > 0, (p - n) / (p + n)))


def write_result(path: str, run: str, **tables: DataFrame) -> None:
    """The tables of one run (metrics, equity, weights), each under its name; a rerun replaces its own run alone."""
    for name, df in tables.items():
        df.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(f"{path}/{name}")


def read_result(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One table of all runs, with the column run."""
    return spark.read.parquet(f"{path}/{name}")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path that all executors and the driver see: under spark.checkpoint.dir, else in the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/eventloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def is_folder(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again, for what several jobs read."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
