"""Queries for scans, windows over tokens, embeddings and leakage audits, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import series as S
from ..operators import validation as V
from ..sources.views import PRICES, SIGNALS, prices, signals, table
from .evaluation import COHORT, FOLDS, cohort
from .market import R
from .registry import query
from .text import BAD, GOOD


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (1, 5, 33, 70, 256, 1000, 77777777)")
def s08_in_list_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The list reaches the scan as a pushed filter."""
    return table(spark, sf, "orders").where(F.col("o_orderkey").isin(1, 5, 33, 70, 256, 1000, 77777777)).select("o_orderkey", "o_totalprice")


@query(f"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[\\t\\n\\x0B\\f\\r ]+'), lambda w: w != '') AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 510 + 256 - 1, 0) + 1, 256)) AS k FROM w),
x AS (SELECT doc_id, w[k + 1:k + 510] AS x FROM s), v AS (SELECT doc_id, len(x) AS n, (len(list_filter(x, lambda y: y IN ('{"','".join(GOOD)}'))) - len(list_filter(x, lambda y: y IN ('{"','".join(BAD)}'))))::DOUBLE / greatest(len(x), 1) AS v FROM x)
SELECT doc_id, count(*) AS windows, round(coalesce(sum(v * n) / nullif(sum(n), 0), 0), {R}) AS score FROM v GROUP BY doc_id""")
def f13_token_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of overlapping word windows, their mean weighted by length."""
    w = table(spark, sf, "documents").where("text is not null").select("doc_id", V.token_windows("text", 510, 256).alias("w"))
    count = lambda x, words: F.size(F.filter(x, lambda y: y.isin(words)))
    part = F.transform("w", lambda x: F.struct(F.size(x).alias("n"), ((count(x, GOOD) - count(x, BAD)) / F.greatest(F.size(x), F.lit(1))).alias("v")))
    rows = w.select("doc_id", F.explode(part).alias("p")).select("doc_id", "p.*")
    return rows.groupBy("doc_id").agg(F.count("*").alias("windows"), F.round(F.coalesce(F.sum(F.col("v") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)), R).alias("score"))


@query("""WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS m FROM e GROUP BY 1, 2)
SELECT vec_id, round(sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))), 6) AS cosine FROM e JOIN c USING (label, i) GROUP BY vec_id""")
def s19_centroid_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine of each embedding to the centroid of its label."""
    e = table(spark, sf, "embeddings")
    x = e.select("vec_id", "label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    c = x.groupBy("label", "i").agg(F.avg("x").alias("m")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m"))
    total = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    v, m = F.col("embedding"), F.col("m")
    return e.join(F.broadcast(c), "label").select("vec_id", F.round(total(v, m) / (F.sqrt(total(v, v)) * F.sqrt(total(m, m))), 6).alias("cosine"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def k03_pending(spark: SparkSession, sf: str) -> DataFrame:
    return V.pending(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@query(f"""WITH {PRICES}, {SIGNALS}, {COHORT}, {FOLDS}, s AS (SELECT signal_id, date, CASE WHEN signal_id % 9 > 0 THEN CAST(date + 20 AS DATE) END AS target_end FROM signals), f AS (SELECT start, date, target_end, CASE WHEN date >= start THEN 'test' WHEN target_end IS NULL OR target_end < start THEN 'train' ELSE 'purged' END AS part FROM s JOIN folds ON date < stop),
g AS (SELECT month, sum(abs(weight)) AS gross, sum(weight) AS net FROM cohort GROUP BY month), ex AS (SELECT count(*) AS n FROM (SELECT lead(date) OVER (PARTITION BY ticker ORDER BY date) AS e, date FROM prices) WHERE e <= date)
SELECT 'train before fold' AS "check", count(*) AS rows, count(*) FILTER (WHERE part = 'train' AND date >= start) AS violations, count(*) FILTER (WHERE part = 'train' AND date >= start) = 0 AS passed FROM f
UNION ALL SELECT 'test in fold', count(*), count(*) FILTER (WHERE part = 'test' AND date < start), TRUE FROM f UNION ALL SELECT 'labels purged', count(*), count(*) FILTER (WHERE part = 'train' AND target_end >= start), TRUE FROM f
UNION ALL SELECT 'gross is two', count(*), count(*) FILTER (WHERE abs(gross - 2) > 1e-9), count(*) FILTER (WHERE abs(gross - 2) > 1e-9) = 0 FROM g UNION ALL SELECT 'net is zero', count(*), count(*) FILTER (WHERE abs(net) > 1e-9), TRUE FROM g
UNION ALL SELECT 'exit after entry', (SELECT count(*) FROM prices), n, n = 0 FROM ex""")
def v01_v06_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Fold boundaries, portfolio rules and trade order, as one table of checks."""
    q = spark.range(8).select(F.col("id").cast("int").alias("fold"), F.add_months(F.lit("1997-01-01").cast("date"), (F.col("id") * 3).cast("int")).alias("start"))
    folds = q.withColumn("stop", F.add_months("start", 3))
    s = signals(spark, sf).withColumn("target_end", F.when(F.col("signal_id") % 9 > 0, F.date_add("date", 20)))
    parts = E.purged_folds(folds, s, "signal_id", "date", "target_end").join(folds.select("fold", "start"), "fold").join(s.select("signal_id", "date", "target_end"), "signal_id")
    weights = cohort(spark, sf).groupBy("month").agg(F.sum(F.abs("weight")).alias("gross"), F.sum("weight").alias("net"))
    exits = S.forward_returns(prices(spark, sf), [1])
    return V.audit([
        V.violations(parts, V.fold_rules("start", "date", "target_end", "part", "start")),
        V.violations(weights, {"gross is two": F.abs(F.col("gross") - 2) <= 1e-9, "net is zero": F.abs("net") <= 1e-9}),
        V.violations(exits, {"exit after entry": F.col("exit_1").isNull() | (F.col("exit_1") > F.col("date"))}),
    ])


@query("""SELECT round(sum(l_quantity), 4) AS q, count(*) AS n, CAST(year(l_shipdate) AS INT) AS yr FROM lineitem WHERE l_partkey % 20 IN (3, 4) GROUP BY 3""")
def s07_ticker_files(spark: SparkSession, sf: str) -> DataFrame:
    """A few tickers of the price source, by year; the predicate is part of the scan's stage."""
    li = table(spark, sf, "lineitem").where((F.col("l_partkey") % 20).isin(3, 4))
    return li.groupBy(F.year("l_shipdate").alias("yr")).agg(F.round(F.sum("l_quantity"), 4).alias("q"), F.count("*").alias("n"))
