"""Queries that write files to the shared folder and read them back, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files
from ..sources.views import SIGNALS, table
from .evaluation import COHORT, cohort
from .market import R
from .registry import query


@query("""SELECT c_custkey::VARCHAR AS id, c_mktsegment || '-' || c_nationkey AS "Ticker", c_mktsegment AS "SignalType" FROM customer WHERE c_mktsegment != 'BUILDING'""")
def s01_s03_wide_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Three of the columns of a wide CSV, as text; deleted rows are dropped, dots in tickers are dashes."""
    path = files.shared_path(spark, "wide")
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "delete").otherwise(F.col("c_mktsegment"))
    wide = table(spark, sf, "customer").select("*", F.col("c_custkey").alias("id"), F.concat("c_mktsegment", F.lit("."), F.col("c_nationkey").cast("string")).alias("Ticker"), kind.alias("SignalType"))
    wide.write.csv(path, header=True)
    return files.wide_csv(spark, path, ["id", "Ticker", "SignalType"])


@query("SELECT event_id, event_type, user_id FROM events")
def s11_json_lines(spark: SparkSession, sf: str) -> DataFrame:
    path = files.shared_path(spark, "lines")
    events = table(spark, sf, "events").select("event_id", "event_type", "user_id")
    files.write_json_lines(events, path)
    return files.json_lines(spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema))


@query("SELECT CAST(c_nationkey AS INT) AS nation, c_custkey, c_mktsegment AS segment, round(c_acctbal, 4) AS balance FROM customer WHERE c_nationkey = 7")
def s12_document_store(spark: SparkSession, sf: str) -> DataFrame:
    """Customers nested under their nation and segment, a folder for each nation, of which one is read back."""
    path = files.shared_path(spark, "store")
    c = table(spark, sf, "customer").select(F.col("c_nationkey").cast("int").alias("nation"), F.col("c_mktsegment").alias("segment"), F.struct("c_custkey", F.round("c_acctbal", 4).alias("balance")).alias("c"))
    files.write_documents(c.groupBy("nation", "segment").agg(F.collect_list("c").alias("customers")), ["nation"], path)
    found = files.read_documents(spark, path, "segment string, customers array<struct<c_custkey: bigint, balance: double>>", nation=7)
    return found.select("nation", "segment", F.inline("customers"))


WORDS = "regexp_extract_all(lower(text), '[a-z]+')"


@query(f"""WITH w AS (SELECT doc_id, unnest({WORDS}) AS w FROM documents), x AS (SELECT doc_id, w, length(w) BETWEEN 2 AND 4 AND w NOT LIKE 'q%' AS listed FROM w),
c AS (SELECT doc_id, count(*) FILTER (WHERE listed AND w LIKE '%e') AS p, count(*) FILTER (WHERE listed AND w LIKE '%t') AS n FROM x GROUP BY doc_id)
SELECT d.doc_id, coalesce(p, 0) AS positive, coalesce(n, 0) AS negative, round(CASE WHEN p + n > 0 THEN (p - n)::DOUBLE / (p + n) END, {R}) AS score FROM documents d LEFT JOIN c USING (doc_id)""")
def s13_dictionary_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Words of documents looked up in a dictionary file; words that begin with q have an invalid year there, so they don't count."""
    path, docs = files.shared_path(spark, "dictionary"), table(spark, sf, "documents").select("doc_id", "text")
    # the file: all short words of the corpus, in capitals and with blanks, good ones end with e and bad ones with t
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"))).alias("w")).where(F.length("w").between(2, 4)).distinct()
    year = lambda end: F.when(F.startswith("w", F.lit("q")), "20O9").when(F.endswith("w", F.lit(end)), "2009").when(F.length("w") == 2, "").otherwise("0")
    words.select(F.concat(F.upper("w"), F.lit(" ")).alias("Word"), year("e").alias("Positive"), year("t").alias("Negative")).write.csv(path, header=True)
    return files.dictionary_scores(docs, files.dictionary(spark, path)).withColumn("score", F.round("score", R))


@query("SELECT 'S' || s_suppkey AS ticker FROM supplier WHERE s_acctbal > 0")
def s15_csv_with_preamble(spark: SparkSession, sf: str) -> DataFrame:
    """Holdings files, one for each nation, with lines before their header; names that don't look like tickers are left out."""
    path = files.shared_path(spark, "holdings")
    name = F.concat(F.when(F.col("s_acctbal") > 0, "S").otherwise("no ticker "), F.col("s_suppkey").cast("string"))
    line = F.concat(F.lit('"'), name, F.lit('","'), F.col("s_name"), F.lit('"'))
    funds = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.array_join(F.collect_list(line), "\n").alias("lines"))
    funds.select("s_nationkey", F.concat(F.lit("Fund Holdings\nas of,Jan 31\n\nTicker,Name\n"), "lines").alias("value")).write.partitionBy("s_nationkey").text(path)
    return files.csv_after_preamble(spark, f"{path}/*/*.txt", "Ticker").select("ticker")


@query(f"""WITH {SIGNALS}, s AS (SELECT count(*) AS n FROM signals) SELECT 'features' AS phase, n AS rows, TRUE AS same, FALSE AS other_parameters, FALSE AS other_input FROM s""")
def k05_k08_manifests(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest fits what it was written for, and neither other parameters nor another input."""
    from ..sources.views import signals

    path, s = files.shared_path(spark, "phase"), signals(spark, sf)
    parameters, orders = {"horizon": "5"}, table(spark, sf, "orders")
    files.write_manifest(s, path, "features", parameters, {"orders": orders})
    changed = orders.withColumn("o_totalprice", F.col("o_totalprice") + 1)
    same, tuned, moved = (files.fresh(spark, path, "features", p, {"orders": o}) for p, o in ((parameters, orders), ({"horizon": "6"}, orders), (parameters, changed)))
    found = spark.read.parquet(f"{path}/manifest")
    return found.select("phase", "rows", F.lit(same).alias("same"), F.lit(tuned).alias("other_parameters"), F.lit(moved).alias("other_input"))


@query(f"""WITH {SIGNALS}, {COHORT} SELECT r.run, month, count(*) AS names, round(sum(abs(weight)) * r.x, {R}) AS gross FROM cohort CROSS JOIN (VALUES ('base', 1), ('double', 2)) r(run, x) GROUP BY r.run, r.x, month""")
def k06_results(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of two runs, one of them written twice, read back as one history."""
    path, w = files.shared_path(spark, "results"), cohort(spark, sf).select("month", "ticker", "weight")
    files.write_result(path, "base", weights=w.where("weight > 0"))
    files.write_result(path, "double", weights=w.withColumn("weight", 2 * F.col("weight")))
    files.write_result(path, "base", weights=w)
    return files.read_result(spark, path, "weights").groupBy("run", "month").agg(F.count("*").alias("names"), F.round(F.sum(F.abs("weight")), R).alias("gross"))
