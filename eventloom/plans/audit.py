"""Queries for roll-ups, guards and audits, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation as E
from ..operators import joins as J
from ..operators import models as M
from ..operators import sampling as P
from ..operators import series as S
from ..sources import files
from ..sources.views import PRICES, SIGNALS, prices, signals, table
from .evaluation import BASE, IC, panel
from .market import MARKET, R, RETURNS, market, r, returns
from .registry import query


@query(f"""WITH {SIGNALS}, c AS (SELECT ticker, date, max_by(signal_type, signal_id) AS a, min_by(signal_type, signal_id) AS b FROM signals GROUP BY 1, 2)
SELECT ticker, count(*) AS calls, count(*) FILTER (WHERE a = b) AS n_agree, round(count(*) FILTER (WHERE a = b)::DOUBLE / greatest(count(*), 1), {R}) AS rate FROM c GROUP BY ticker""")
def g07_roll_ups(spark: SparkSession, sf: str) -> DataFrame:
    """Agreement of two labels per call, rolled up per ticker."""
    c = signals(spark, sf).groupBy("ticker", "date").agg(F.max_by("signal_type", "signal_id").alias("a"), F.min_by("signal_type", "signal_id").alias("b"))
    same = F.count_if(F.col("a") == F.col("b"))
    return c.groupBy("ticker").agg(F.count("*").alias("calls"), same.alias("n_agree"), F.round(same / F.greatest(F.count("*"), F.lit(1)), R).alias("rate"))


@query(f"""{BASE}, f AS (SELECT month, ticker, ret, (id % 7 - 3) * (1 + id % 3) AS fluff FROM panel WHERE ret IS NOT NULL), k AS (SELECT month, rank() OVER (PARTITION BY month ORDER BY fluff) + (count(*) OVER (PARTITION BY month, fluff) - 1) / 2.0 AS a,
rank() OVER (PARTITION BY month ORDER BY ret) + (count(*) OVER (PARTITION BY month, ret) - 1) / 2.0 AS b FROM f), i AS (SELECT month, {IC} AS ic FROM k GROUP BY month HAVING count(*) >= 6)
SELECT count(ic) AS months, round(avg(ic), {R}) AS ic, count(ic) >= 6 AND abs(avg(ic)) < 0.2 AS passed FROM i""")
def g35_negative_control(spark: SparkSession, sf: str) -> DataFrame:
    """A signal that shouldn't predict anything: its mean coefficient must stay small."""
    p = panel(spark, sf).withColumn("fluff", (F.col("id") % 7 - 3) * (1 + F.col("id") % 3))
    ic = E.cross_sectional_ic(p, ["fluff"], ["ret"], ["month"], 6)
    return ic.agg(F.count("ic").alias("months"), F.round(F.avg("ic"), R).alias("ic"), ((F.count("ic") >= 6) & (F.abs(F.avg("ic")) < 0.2)).alias("passed"))


@query(f"""WITH {PRICES}, {RETURNS}, {MARKET}, b AS (SELECT ticker, date, ret, market, {", ".join(f"CASE WHEN count(*) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) >= 30 THEN covar_samp(ret, market) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) / nullif(var_samp(market) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 0) END AS b{n}" for n in (40, 60, 90))}
FROM returns JOIN market USING (date) WINDOW w AS (PARTITION BY ticker ORDER BY date)) SELECT ticker, date, {", ".join(f"round(ret - b{n} * market, 6) AS residual_{n}" for n in (40, 60, 90))}, coalesce(sign(ret - b40 * market) != sign(ret - b60 * market), FALSE) AS flips FROM b""")
def g36_p18_beta_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Residuals against the market at three beta windows, and whether the sign depends on the window."""
    rets = returns(spark, sf)
    m = market(rets)
    out = rets.join(m, "date")
    for n in (40, 60, 90):
        out = out.join(S.rolling_beta(rets, m, n, 30, 0).withColumnRenamed("beta", f"b{n}"), ["ticker", "date"])
    res = {n: F.col("ret") - F.col(f"b{n}") * F.col("market") for n in (40, 60, 90)}
    flips = F.coalesce(F.signum(res[40]) != F.signum(res[60]), F.lit(False))
    return out.select("ticker", "date", *[F.round(x, 6).alias(f"residual_{n}") for n, x in res.items()], flips.alias("flips"))


_BETA = ", ".join(f"CASE WHEN count(*) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) >= 30 THEN covar_samp(ret, market) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) / nullif(var_samp(market) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 0) END AS b{n}" for n in (40, 60, 90))


@query(f"""WITH {PRICES}, {SIGNALS}, {RETURNS}, {MARKET}, b0 AS (SELECT ticker, date, ret, market, {_BETA} FROM returns JOIN market USING (date) WINDOW w AS (PARTITION BY ticker ORDER BY date)),
b AS (SELECT ticker, date, {", ".join(f"ret - lag(b{n}, 4) OVER w * market AS r{n}" for n in (40, 60, 90))} FROM b0 WINDOW w AS (PARTITION BY ticker ORDER BY date)),
f AS (SELECT ticker, date, lead(close, 1) OVER w / close - 1 AS f1, lead(close, 5) OVER w / close - 1 AS f5 FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY date)),
j AS (SELECT signal_type, b.*, f1, f5 FROM signals JOIN b USING (ticker, date) JOIN f USING (ticker, date)), l AS (SELECT signal_type, x.* FROM j, LATERAL (VALUES {", ".join(f"({n}, {h}, r{n}, f{h})" for n in (40, 60, 90) for h in (1, 5))}) x("window", horizon, x, y)),
rk AS (SELECT signal_type, "window", horizon, rank() OVER (g ORDER BY x) + (count(*) OVER (PARTITION BY signal_type, "window", horizon, x) - 1) / 2.0 AS a, rank() OVER (g ORDER BY y) + (count(*) OVER (PARTITION BY signal_type, "window", horizon, y) - 1) / 2.0 AS b
  FROM l WHERE x IS NOT NULL AND y IS NOT NULL WINDOW g AS (PARTITION BY signal_type, "window", horizon)), ic AS (SELECT signal_type, "window", horizon, count(*) AS n, {IC} AS ic FROM rk GROUP BY 1, 2, 3 HAVING count(*) >= 30)
SELECT signal_type, CAST("window" AS INT) AS "window", CAST(horizon AS INT) AS horizon, n, round(ic, {R}) + 0.0 AS ic, coalesce(sign(ic) != max(CASE WHEN "window" = 60 THEN sign(ic) END) OVER (PARTITION BY signal_type, horizon), FALSE) AS flips FROM ic""")
def g36_beta_correlations(spark: SparkSession, sf: str) -> DataFrame:
    """Does the correlation of residuals with later returns depend on the window of the beta?"""
    rets = returns(spark, sf)
    m = market(rets)
    out = rets.join(m, "date")
    for n in (40, 60, 90):
        out = out.join(S.rolling_beta(rets, m, n, 30, 4).withColumnRenamed("beta", f"b{n}"), ["ticker", "date"])
    out = out.select("ticker", "date", *[(F.col("ret") - F.col(f"b{n}") * F.col("market")).alias(f"r{n}") for n in (40, 60, 90)])
    ahead = S.forward_returns(prices(spark, sf), [1, 5]).select("ticker", "date", "fwd_1", "fwd_5")
    rows = signals(spark, sf).select("signal_type", "ticker", "date").join(out, ["ticker", "date"]).join(ahead, ["ticker", "date"])
    ic = E.window_correlations(rows, {n: f"r{n}" for n in (40, 60, 90)}, {h: f"fwd_{h}" for h in (1, 5)}, "signal_type", 60, 30)
    return ic.withColumn("ic", F.round("ic", R) + F.lit(0.0))


@query(f"""{BASE}, k AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY score DESC, id) AS k FROM panel WHERE ret IS NOT NULL) SELECT month, round(avg(ret) FILTER (WHERE k <= 5), {R}) AS top, round(avg(ret), {R}) AS every, count(*) AS n FROM k GROUP BY month""")
def j02_top_of_month(spark: SparkSession, sf: str) -> DataFrame:
    k = F.row_number().over(W.partitionBy("month").orderBy(F.desc("score"), "id"))
    p = panel(spark, sf).where("ret is not null").withColumn("k", k)
    return p.groupBy("month").agg(F.round(F.avg(F.when(F.col("k") <= 5, F.col("ret"))), R).alias("top"), F.round(F.avg("ret"), R).alias("every"), F.count("*").alias("n"))


@query("""SELECT doc_id, quality::VARCHAR AS label_0, CASE WHEN doc_id % 4 = 0 THEN 'keep' ELSE toxic::VARCHAR END AS label_1 FROM labels""")
def j13_complete_votes(spark: SparkSession, sf: str) -> DataFrame:
    """Judges' latest labels side by side; blank labels count as keep, a missing id fails."""
    lab = table(spark, sf, "labels")
    first = lab.select("doc_id", F.col("quality").cast("string").alias("label"), F.lit(1).alias("seq"))
    early = lab.select("doc_id", F.lit("old").alias("label"), F.lit(0).alias("seq"))
    second = lab.select("doc_id", F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("toxic").cast("string")).alias("label"), F.lit(1).alias("seq"))
    return J.complete_votes(lab.select("doc_id"), [first.unionByName(early), second], "doc_id")


@query("""WITH e AS (SELECT s_suppkey AS ticker, 'miss' AS status FROM supplier WHERE s_acctbal > 2000), n AS (SELECT s_suppkey AS ticker, CASE WHEN s_acctbal > 5000 THEN 'ok' ELSE 'gone' END AS status FROM supplier WHERE s_nationkey < 15)
SELECT * FROM e WHERE ticker NOT IN (SELECT ticker FROM n) UNION ALL SELECT * FROM n WHERE status != 'ok'""")
def k04_failure_log(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").withColumnRenamed("s_suppkey", "ticker")
    old = s.where("s_acctbal > 2000").select("ticker", F.lit("miss").alias("status"))
    new = s.where("s_nationkey < 15").select("ticker", F.when(F.col("s_acctbal") > 5000, "ok").otherwise("gone").alias("status"))
    return P.log_failures(old, new, True)


@query(f"""WITH {SIGNALS} SELECT date, ticker, score FROM signals WHERE score IS NOT NULL AND signal_id % 13 > 0""")
def p12_p17_signal_projection(spark: SparkSession, sf: str) -> DataFrame:
    s = signals(spark, sf).withColumn("score", F.when(F.col("signal_id") % 13 > 0, F.col("score")))
    return s.select("date", "ticker", "score").dropna()


@query(f"""WITH {SIGNALS} SELECT signal_id FROM signals WHERE CAST(date + CAST(signal_id % 9 AS INT) AS DATE) <= DATE '1998-06-30'""")
def p14_eligible(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that were available on the rebalance date."""
    return signals(spark, sf).where(F.date_add("date", (F.col("signal_id") % 9).cast("int")) <= "1998-06-30").select("signal_id")


@query(f"""WITH {PRICES}, {SIGNALS} SELECT DISTINCT ticker FROM (SELECT ticker FROM prices UNION SELECT ticker FROM signals WHERE sector = 'BUILDING' UNION SELECT CAST(999 AS INT))""")
def p15_ticker_discovery(spark: SparkSession, sf: str) -> DataFrame:
    bench = spark.range(1).select(F.lit(999).alias("ticker"))
    return prices(spark, sf).select("ticker").union(signals(spark, sf).where("sector = 'BUILDING'").select("ticker")).union(bench).distinct()


@query("SELECT c_custkey, c_acctbal, c_mktsegment AS segment FROM customer WHERE c_acctbal > 0")
def p06_p09_s05_guarded_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Required and optional columns of a scan; optional ones that don't exist are left out."""
    c = table(spark, sf, "customer").withColumnRenamed("c_mktsegment", "segment")
    return files.select_present(c, ["c_custkey"], ["c_acctbal", "c_missing", "segment"]).where("c_acctbal > 0")


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'a|b|c' WHEN 1 THEN 'single' ELSE '' END AS items, CAST(CASE event_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 0 END AS INT) AS n FROM events""")
def m04_text_items(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 3 == 0, F.lit('["a", " b ", "", "c", "d"]')).when(F.col("event_id") % 3 == 1, F.lit("single"))
    e = table(spark, sf, "events").select("event_id", T.text_items(raw).alias("l"))
    return e.select("event_id", F.array_join("l", "|").alias("items"), F.size("l").alias("n"))


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS found FROM orders""")
def f02_written_dates(spark: SparkSession, sf: str) -> DataFrame:
    """A date written out in a heading, by month name."""
    o = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("Call held on "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit(" in town")).alias("t"))
    part = F.regexp_extract("t", r"([A-Z][a-z]+ \d{1,2}, \d{4})", 1)
    return o.select("o_orderkey", F.coalesce(F.try_to_timestamp(part, F.lit("MMMM d, yyyy")), F.try_to_timestamp(part, F.lit("MMM d, yyyy"))).cast("date").alias("found"))


@query("""WITH p AS (SELECT conv_id, max(CASE WHEN turn = 0 THEN text END) AS q, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id) SELECT conv_id, md5('Question: ' || q || ' / ' || roles) AS prompt FROM p""")
def f12_prompts(spark: SparkSession, sf: str) -> DataFrame:
    roles = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ",")
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("q"), roles.alias("roles"))
    return c.select("conv_id", F.md5(F.format_string("Question: %s / %s", "q", "roles")).alias("prompt"))


@query("""WITH m AS (SELECT p_brand AS model, round(avg(p_size) / 50, 8) AS macro_f1, round(avg(p_retailprice) / max(p_retailprice), 8) AS recall, p_brand LIKE '%1' AS ensemble FROM part GROUP BY p_brand)
SELECT model, macro_f1 FROM m WHERE recall >= 0.5 ORDER BY macro_f1 DESC, ensemble DESC, model LIMIT 3""")
def t08_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "part").groupBy(F.col("p_brand").alias("model")).agg(F.round(F.avg("p_size") / 50, R).alias("macro_f1"), F.round(F.avg("p_retailprice") / F.max("p_retailprice"), R).alias("recall"))
    m = m.withColumns({"ensemble": F.endswith("model", F.lit("1")), "eligible": F.lit(True)})
    return M.leaderboard(m, 0.5).limit(3).select("model", "macro_f1")


@query("""SELECT o_orderkey, o_totalprice, o_custkey * 2 AS doubled FROM orders""")
def s09_j16_zip_columns(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return files.zip_columns(o.select("o_orderkey", "o_totalprice"), o.select("o_orderkey", (F.col("o_custkey") * 2).alias("doubled")), "o_orderkey")
