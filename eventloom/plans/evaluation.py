"""Queries that evaluate signals, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranks import newey_west_short, return_stats
from ..operators import evaluation as E
from ..operators import series as S
from ..sources import views as V
from ..sources.views import CALENDAR, PRICES, SIGNALS, table
from .market import R, RETURNS, r, returns
from .registry import query

#: Monthly panel: the latest signal of each ticker and month with the return of the month after.
PANEL = """bars AS (SELECT ticker, last_day(date) AS month, max_by(close, date) AS close FROM prices GROUP BY 1, 2),
nxt AS (SELECT ticker, month, lead(close) OVER (PARTITION BY ticker ORDER BY month) / close - 1 AS ret FROM bars),
latest AS (SELECT last_day(date) AS month, ticker, max_by(score, (date, signal_id)) AS score, max_by(sector, (date, signal_id)) AS sector, max(signal_id) AS id FROM signals GROUP BY 1, 2),
panel AS (SELECT month, ticker, score, sector, id, ret FROM latest JOIN nxt USING (ticker, month))"""
BASE = f"WITH {PRICES}, {SIGNALS}, {PANEL}"
EDGES = """e AS (SELECT month, count(*) AS n, quantile_cont(score, [0, 0.25, 0.5, 0.75, 1]) AS q FROM panel WHERE ret IS NOT NULL GROUP BY month HAVING count(*) >= 8),
b AS (SELECT p.*, CAST(len(list_filter(list_distinct(q[2:4]), lambda x: x < score AND x > q[1] AND x < q[5])) AS INT) AS bucket FROM panel p JOIN e USING (month) WHERE ret IS NOT NULL)"""


def panel(spark: SparkSession, sf: str) -> DataFrame:
    p, s = V.prices(spark, sf), V.signals(spark, sf)
    bars = p.groupBy("ticker", F.last_day("date").alias("month")).agg(F.max_by("close", "date").alias("close"))
    nxt = bars.select("ticker", "month", (F.lead("close").over(W.partitionBy("ticker").orderBy("month")) / F.col("close") - 1).alias("ret"))
    order = F.struct("date", "signal_id")
    latest = s.groupBy(F.last_day("date").alias("month"), "ticker").agg(
        F.max_by("score", order).alias("score"), F.max_by("sector", order).alias("sector"), F.max("signal_id").alias("id")
    )
    return latest.join(nxt, ["ticker", "month"]).select("month", "ticker", "score", "sector", "id", "ret")


#: Spearman correlation of the ranks a and b over whole numbers, so that its sign is exact.
_DOUBLED = {"n": "count(*)::HUGEINT", "a": "sum((2 * a)::BIGINT)", "b": "sum((2 * b)::BIGINT)", "ab": "sum((2 * a)::BIGINT * (2 * b)::BIGINT)", "aa": "sum((2 * a)::BIGINT * (2 * a)::BIGINT)", "bb": "sum((2 * b)::BIGINT * (2 * b)::BIGINT)"}
IC = "({n} * {ab} - {a} * {b})::DOUBLE / nullif(sqrt(({n} * {aa} - {a} * {a})::DOUBLE * ({n} * {bb} - {b} * {b})::DOUBLE), 0)".format(**_DOUBLED)

RANKED = f"""rk AS (SELECT month, ret, rank() OVER (PARTITION BY month ORDER BY score) + (count(*) OVER (PARTITION BY month, score) - 1) / 2.0 AS a,
rank() OVER (PARTITION BY month ORDER BY ret) + (count(*) OVER (PARTITION BY month, ret) - 1) / 2.0 AS b FROM panel WHERE ret IS NOT NULL),
ic AS (SELECT month, count(*) AS n, {IC} AS ic FROM rk GROUP BY month HAVING count(*) >= 6)"""


@query(f"{BASE}, {RANKED} SELECT month, n, round(ic, {R}) + 0.0 AS ic FROM ic")
def g09_p07_monthly_ic(spark: SparkSession, sf: str) -> DataFrame:
    ic = E.cross_sectional_ic(panel(spark, sf), ["score"], ["ret"], ["month"], 6)
    return ic.select("month", "n", r("ic"))


@query(f"""{BASE}, {RANKED}, s AS (SELECT ic, row_number() OVER (ORDER BY month) AS k FROM ic WHERE ic IS NOT NULL), m AS (SELECT count(*) AS n, avg(ic) AS mean, stddev_samp(ic) AS sd, avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END) AS hit FROM s),
c AS (SELECT j, sum((a.ic - mean) * (b.ic - mean)) / any_value(n) AS g FROM range(0, 4) t(j) JOIN s a ON TRUE JOIN s b ON b.k = a.k + j CROSS JOIN m GROUP BY j),
v AS (SELECT sum(CASE WHEN j = 0 THEN g ELSE 2 * (1 - j / 4.0) * g END) AS v FROM c)
SELECT n, round(mean, {R}) AS mean, round(sd, {R}) AS sd, round(mean / (sd / sqrt(n)), {R}) AS t, round(mean / sqrt(v / n), {R}) AS nw_t, round(hit, {R}) AS hit_rate FROM m, v""")
def g10_g11_ic_summary(spark: SparkSession, sf: str) -> DataFrame:
    ic = E.cross_sectional_ic(panel(spark, sf), ["score"], ["ret"], ["month"], 6)
    out = E.ic_summary(ic, [], "month", 3)
    return out.select("n", *[r(c) for c in ("mean", "sd", "t", "nw_t", "hit_rate")])


@query(f"""{BASE}, {RANKED}, s AS (SELECT year(month) AS year, ic, row_number() OVER (PARTITION BY year(month) ORDER BY month) AS k, count(*) OVER (PARTITION BY year(month)) AS n, ic - avg(ic) OVER (PARTITION BY year(month)) AS d FROM ic WHERE ic IS NOT NULL),
c AS (SELECT a.year, b.k - a.k AS j, sum(a.d * b.d) / any_value(CASE WHEN b.k = a.k THEN a.n - 1 ELSE a.n - (b.k - a.k) END) AS g FROM s a JOIN s b ON a.year = b.year AND b.k >= a.k AND b.k - a.k <= least(4, a.n - 2) WHERE a.n >= 2 GROUP BY 1, 2),
v AS (SELECT year, greatest(sum(CASE WHEN j = 0 THEN g ELSE 2 * (1 - j / 5.0) * g END), 1e-15) AS v FROM c GROUP BY year)
SELECT CAST(year AS INT) AS year, count(*) AS n, round(CASE WHEN count(*) < 2 THEN NULL WHEN bool_or(ic != 0) THEN avg(ic) / sqrt(any_value(v) / count(*)) ELSE 0 END, {R}) AS nw_t FROM s LEFT JOIN v USING (year) GROUP BY year""")
def g11_yearly_newey_west(spark: SparkSession, sf: str) -> DataFrame:
    """The t statistic of each year's few coefficients, with the short series' own denominators."""
    ic = E.cross_sectional_ic(panel(spark, sf), ["score"], ["ret"], ["month"], 6).where("ic is not null")
    series = F.transform(F.array_sort(F.collect_list(F.struct("month", "ic"))), lambda x: x["ic"])  # twelve at most
    return ic.groupBy(F.year("month").alias("year")).agg(F.count("*").alias("n"), F.round(newey_west_short(series, 4), R).alias("nw_t"))


@query(f"{BASE}, {EDGES} SELECT month, bucket, round(avg(ret), {R}) AS ret, count(*) AS n FROM b GROUP BY month, bucket")
def g12_bucket_returns(spark: SparkSession, sf: str) -> DataFrame:
    return E.bucket_returns(panel(spark, sf), "score", "ret", ["month"], 4, 2).select("month", "bucket", r("ret"), "n")


@query(f"""{BASE}, {EDGES}, m AS (SELECT month, avg(ret) FILTER (WHERE bucket = 3) AS hi, avg(ret) FILTER (WHERE bucket = 0) AS lo FROM b GROUP BY month)
SELECT month, round(hi, {R}) AS long_only, round(-lo, {R}) AS short_only, round(hi - lo, {R}) AS long_short FROM m""")
def g18_long_short_pivot(spark: SparkSession, sf: str) -> DataFrame:
    out = E.long_short(E.bucket_returns(panel(spark, sf), "score", "ret", ["month"], 4, 2), "month", 3)
    return out.select("month", *[r(c) for c in ("long_only", "short_only", "long_short")])


@query(f"""{BASE}, {EDGES}, m AS (SELECT month, bucket, avg(ret) AS ret FROM b GROUP BY month, bucket)
SELECT bucket, count(*) AS n, round(avg(ret) * 12, {R}) AS ann_return, round(stddev_samp(ret) * sqrt(12), {R}) AS ann_vol, round(avg(ret) / stddev_samp(ret) * sqrt(12), {R}) AS sharpe FROM m GROUP BY bucket""")
def g17_return_stats(spark: SparkSession, sf: str) -> DataFrame:
    out = return_stats(E.bucket_returns(panel(spark, sf), "score", "ret", ["month"], 4, 2), "ret", ["bucket"], 12)
    return out.select("bucket", "n", *[r(c) for c in ("ann_return", "ann_vol", "sharpe")])


@query(f"""{BASE}, y AS (SELECT year(month) AS yr, * FROM panel WHERE ret IS NOT NULL), e AS (SELECT yr, sector, quantile_cont(score, 0.5) AS q, min(score) AS lo, max(score) AS hi FROM y GROUP BY 1, 2 HAVING count(*) >= 4 AND min(score) < max(score)),
b AS (SELECT y.*, CASE WHEN score > q AND q > lo AND q < hi THEN 1 ELSE 0 END AS bucket FROM y JOIN e USING (yr, sector)), s AS (SELECT yr, sector, bucket, avg(ret) AS ret, count(*) AS n FROM b GROUP BY 1, 2, 3)
SELECT CAST(yr AS INT) AS yr, bucket, round(avg(ret), {R}) AS ret, CAST(sum(n) AS BIGINT) AS n FROM s GROUP BY 1, 2""")
def g13_sector_neutral(spark: SparkSession, sf: str) -> DataFrame:
    p = panel(spark, sf).withColumn("yr", F.year("month"))
    return E.sector_neutral(p, "score", "ret", "yr", 2, 2).select("yr", "bucket", r("ret"), "n")


@query(f"{BASE}, {EDGES} SELECT month, bucket, round(sum(abs(score) * ret) / sum(abs(score)), {R}) AS ret, count(*) AS n FROM b GROUP BY month, bucket")
def g14_score_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return E.score_weighted(panel(spark, sf), "score", "ret", ["month"], 4, 2).select("month", "bucket", r("ret"), "n")


@query(f"""{BASE}, k AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY score DESC, id) AS u, row_number() OVER (PARTITION BY month ORDER BY score, id) AS d, count(*) OVER (PARTITION BY month) AS n FROM panel WHERE ret IS NOT NULL)
SELECT month, round(avg(ret) FILTER (WHERE u <= 3) - avg(ret) FILTER (WHERE d <= 3), {R}) AS spread FROM k WHERE n >= 6 GROUP BY month""")
def g15_t02_top_minus_bottom(spark: SparkSession, sf: str) -> DataFrame:
    return E.top_minus_bottom(panel(spark, sf), "score", "ret", "month", "id", 3).select("month", r("spread"))


COHORT = """m AS (SELECT *, last_day(date) AS month FROM signals), best AS (SELECT month, ticker, max_by(score - 90000, (abs(score - 90000), -signal_id)) AS v FROM m GROUP BY 1, 2),
k AS (SELECT *, count(*) OVER (PARTITION BY month) AS n, row_number() OVER (PARTITION BY month ORDER BY v DESC, ticker) AS u, row_number() OVER (PARTITION BY month ORDER BY v, ticker) AS d FROM best),
w AS (SELECT month, ticker, CASE WHEN u <= greatest(2, ceil(n * 0.2)) THEN 1 / greatest(2, ceil(n * 0.2)) ELSE 0 END - CASE WHEN d <= greatest(2, ceil(n * 0.2)) THEN 1 / greatest(2, ceil(n * 0.2)) ELSE 0 END AS w FROM k WHERE n >= 5),
c AS (SELECT month, ticker, w - avg(w) OVER (PARTITION BY month) AS w FROM w WHERE w != 0), cohort AS (SELECT month, ticker, 2 * w / sum(abs(w)) OVER (PARTITION BY month) AS weight FROM c)"""


def cohort(spark, sf):
    s = V.signals(spark, sf).withColumn("month", F.last_day("date")).withColumn("v0", F.col("score") - 90000)
    return E.cohort_weights(s, "month", "v0", "signal_id", 0.2, 5, 2)


@query(f"WITH {SIGNALS}, {COHORT} SELECT month, ticker, round(weight, {R}) AS weight FROM cohort")
def g31_cohort_weights(spark: SparkSession, sf: str) -> DataFrame:
    return cohort(spark, sf).select("month", "ticker", r("weight"))


@query(f"""WITH {PRICES}, {SIGNALS}, {COHORT}, o AS (SELECT month, lag(month) OVER (ORDER BY month) AS prev FROM (SELECT DISTINCT month FROM cohort)),
was AS (SELECT o.month, ticker, weight FROM cohort JOIN o ON cohort.month = o.prev), t AS (SELECT month, sum(abs(coalesce(a.weight, 0) - coalesce(b.weight, 0))) AS turnover FROM cohort a FULL JOIN was b USING (month, ticker) GROUP BY month),
bars AS (SELECT ticker, last_day(date) AS month, max_by(close, date) AS close FROM prices GROUP BY 1, 2), nxt AS (SELECT ticker, month, lead(close) OVER (PARTITION BY ticker ORDER BY month) / close - 1 AS ret FROM bars),
g AS (SELECT month, sum(weight * ret) AS pnl FROM cohort JOIN nxt USING (month, ticker) WHERE ret IS NOT NULL GROUP BY month)
SELECT month, CAST(bps AS INT) AS bps, round(turnover, {R}) AS turnover, round(pnl - bps / 10000.0 * turnover, {R}) AS net FROM g JOIN t USING (month) CROSS JOIN (VALUES (3), (5), (7), (10)) c(bps)""")
def w26_g32_rebalanced_net_of_costs(spark: SparkSession, sf: str) -> DataFrame:
    """Weights hold until the next rebalance; turnover against the one before; net at four cost levels."""
    w = cohort(spark, sf)
    order = w.select("month").distinct().withColumn("prev", F.lag("month").over(W.orderBy("month")))
    t = E.turnover(w, "month", order)
    nxt = panel_returns(spark, sf)
    g = w.join(nxt, ["month", "ticker"]).where("ret is not null").groupBy("month").agg(F.sum(F.col("weight") * F.col("ret")).alias("pnl"))
    cost = g.join(t, "month").withColumn("bps", F.explode(F.array(*[F.lit(b) for b in (3, 5, 7, 10)])))
    return cost.select("month", "bps", r("turnover"), F.round(F.col("pnl") - F.col("bps") / 10000.0 * F.col("turnover"), R).alias("net"))


def panel_returns(spark, sf):
    bars = V.prices(spark, sf).groupBy("ticker", F.last_day("date").alias("month")).agg(F.max_by("close", "date").alias("close"))
    return bars.select("ticker", "month", (F.lead("close").over(W.partitionBy("ticker").orderBy("month")) / F.col("close") - 1).alias("ret"))


@query(f"""WITH {PRICES}, {SIGNALS}, {COHORT}, adv AS (SELECT ticker, date, CASE WHEN count(*) OVER f = 20 THEN avg(volume * close) OVER f END AS adv FROM prices WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
lastadv AS (SELECT ticker, last_day(date) AS month, max_by(adv, date) AS adv FROM adv WHERE adv IS NOT NULL GROUP BY 1, 2), top AS (SELECT month, count(*) AS holdings, list_sum(list_sort(list(abs(weight)), 'DESC')[1:3]) / sum(abs(weight)) AS top3 FROM cohort GROUP BY month),
use AS (SELECT month, max(1e6 * abs(weight) / adv) AS use FROM cohort JOIN lastadv USING (month, ticker) GROUP BY month)
SELECT month, holdings, round(top3, {R}) AS top3, round(use, 4) AS use FROM top LEFT JOIN use USING (month)""")
def g20_capacity(spark: SparkSession, sf: str) -> DataFrame:
    w = cohort(spark, sf)
    p = V.prices(spark, sf).withColumn("traded", F.col("volume") * F.col("close"))
    adv = p.select("ticker", "date", S.prior_mean(p, "traded", 20).alias("adv")).where("adv is not null").groupBy("ticker", F.last_day("date").alias("month")).agg(F.max_by("adv", "date").alias("adv"))
    sizes = F.slice(F.reverse(F.array_sort(F.collect_list(F.abs("weight")))), 1, 3)
    top = w.groupBy("month").agg(F.count("*").alias("holdings"), (F.aggregate(sizes, F.lit(0.0), lambda a, x: a + x) / F.sum(F.abs("weight"))).alias("top3"))
    use = w.join(adv, ["month", "ticker"]).groupBy("month").agg(F.max(1e6 * F.abs("weight") / F.col("adv")).alias("use"))
    return top.join(use, "month", "left").select("month", "holdings", r("top3"), F.round("use", 4).alias("use"))


@query(f"""{BASE}, c AS (SELECT date, quantile_cont(close, 0.9) AS a, quantile_cont(close, 0.6) AS b, quantile_cont(close, 0.3) AS c FROM prices GROUP BY date)
SELECT ticker, date, CASE WHEN close >= a THEN 'mega' WHEN close >= b THEN 'large' WHEN close >= c THEN 'mid' ELSE 'small' END AS bucket FROM prices JOIN c USING (date)""")
def g16_size_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Size classes by the 90, 60 and 30 percent points of the same day's members."""
    p = V.prices(spark, sf)
    cuts = p.groupBy("date").agg(F.percentile("close", F.array(F.lit(0.9), F.lit(0.6), F.lit(0.3))).alias("q"))
    c, q = F.col("close"), F.col("q")
    name = F.when(c >= q[0], "mega").when(c >= q[1], "large").when(c >= q[2], "mid").otherwise("small")
    return p.join(cuts, "date").select("ticker", "date", name.alias("bucket"))


@query(f"""WITH {PRICES}, {SIGNALS}, s AS (SELECT DISTINCT last_day(date) AS month, ticker FROM signals), p AS (SELECT DISTINCT last_day(date) AS month, ticker FROM prices)
SELECT month, count(*) AS members, count(p.ticker) AS quoted, round(count(p.ticker)::DOUBLE / count(*), {R}) AS coverage, count(p.ticker) * 2 < count(*) AS low FROM s LEFT JOIN p USING (month, ticker) GROUP BY month""")
def g21_coverage(spark: SparkSession, sf: str) -> DataFrame:
    month = lambda df: df.select(F.last_day("date").alias("month"), "ticker").distinct()
    both = month(V.signals(spark, sf)).join(month(V.prices(spark, sf)).withColumn("q", F.lit(1)), ["month", "ticker"], "left")
    out = both.groupBy("month").agg(F.count("*").alias("members"), F.count("q").alias("quoted"))
    return out.select("month", "members", "quoted", F.round(F.col("quoted") / F.col("members"), R).alias("coverage"), (F.col("quoted") * 2 < F.col("members")).alias("low"))


FOLDS = "folds AS (SELECT CAST(x AS DATE) AS start, CAST(x + INTERVAL 3 MONTH AS DATE) AS stop, CAST(row_number() OVER (ORDER BY x) - 1 AS INT) AS fold FROM (SELECT unnest(generate_series(TIMESTAMP '1997-01-01', TIMESTAMP '1998-10-01', INTERVAL 3 MONTH)) AS x))"


@query(f"""WITH {SIGNALS}, {FOLDS}, s AS (SELECT signal_id, date, CASE WHEN signal_id % 9 > 0 THEN CAST(date + 20 AS DATE) END AS target_end FROM signals)
SELECT fold, CASE WHEN date >= start THEN 'test' WHEN target_end IS NULL OR target_end < start THEN 'train' ELSE 'purged' END AS part, count(*) AS n FROM s JOIN folds ON date < stop GROUP BY 1, 2""")
def w24_g23_purged_folds(spark: SparkSession, sf: str) -> DataFrame:
    q = spark.range(8).select(F.col("id").cast("int").alias("fold"), F.add_months(F.lit("1997-01-01").cast("date"), (F.col("id") * 3).cast("int")).alias("start"))
    folds = q.withColumn("stop", F.add_months("start", 3))
    s = V.signals(spark, sf).withColumn("target_end", F.when(F.col("signal_id") % 9 > 0, F.date_add("date", 20)))
    return E.purged_folds(folds, s, "signal_id", "date", "target_end").groupBy("fold", "part").agg(F.count("*").alias("n"))


PROB = "p AS (SELECT doc_id, quality AS y, (doc_id * 37 % 101) / 200.0 + quality * 0.45 AS p FROM labels)"


def scored(spark, sf):
    return table(spark, sf, "labels").select("doc_id", F.col("quality").alias("y"), (F.col("doc_id") * 37 % 101 / 200.0 + F.col("quality") * 0.45).alias("p"))


@query(f"""WITH {PROB}, g AS (SELECT i / 1000.0 AS t, i FROM range(0, 1001) x(i)),
c AS (SELECT t, sum(CASE WHEN y = 1 AND floor(p * 1000 + 1e-9) >= i THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN y = 0 AND floor(p * 1000 + 1e-9) >= i THEN 1 ELSE 0 END) AS fp, sum(y) AS pp, sum(1 - y) AS nn FROM p CROSS JOIN g GROUP BY t),
f AS (SELECT t, (coalesce(2 * tp / nullif(tp + fp + pp, 0), 0) + coalesce(2 * (nn - fp) / nullif(2 * (nn - fp) + (pp - tp) + fp, 0), 0)) / 2 AS f1 FROM c WHERE tp >= 0.96 * pp)
SELECT max_by(t, (f1, -t))::DOUBLE AS threshold, round(max(f1), {R}) AS f1 FROM f""")
def g28_threshold_search(spark: SparkSession, sf: str) -> DataFrame:
    return E.best_threshold(scored(spark, sf), "y", "p", 1000, 0.96).select("threshold", r("f1"))


@query(f"""WITH {PROB}, c AS (SELECT doc_id % 3 AS g, count(*) FILTER (WHERE y = 1 AND p >= 0.5) AS tp, count(*) FILTER (WHERE y = 0 AND p >= 0.5) AS fp, count(*) FILTER (WHERE y = 1 AND p < 0.5) AS fn, count(*) FILTER (WHERE y = 0 AND p < 0.5) AS tn FROM p GROUP BY 1),
f AS (SELECT *, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce(2.0 * tn / nullif(2 * tn + fp + fn, 0), 0) AS f0 FROM c)
SELECT g, tp, fp, fn, tn, round((tp + tn)::DOUBLE / (tp + fp + fn + tn), {R}) AS accuracy, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), {R}) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), {R}) AS recall, round(f1, {R}) AS f1, round((f1 + f0) / 2, {R}) AS macro_f1 FROM f""")
def g27_classification_report(spark: SparkSession, sf: str) -> DataFrame:
    d = scored(spark, sf).select((F.col("doc_id") % 3).alias("g"), "y", (F.col("p") >= 0.5).cast("int").alias("pred"))
    out = E.classification_report(d, "y", "pred", ["g"])
    return out.select("g", "tp", "fp", "fn", "tn", *[r(c) for c in ("accuracy", "precision", "recall", "f1", "macro_f1")])


@query(f"""WITH {PROB}, m AS (SELECT doc_id, p AS a, doc_id * 53 % 97 AS b FROM p), k AS (SELECT doc_id, count(*) OVER () AS n, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 - 1 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 - 1 AS rb FROM m)
SELECT doc_id, round((ra / (n - 1) + rb / (n - 1)) / 2, {R}) AS score FROM k""")
def g29_l09_rank_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    m = scored(spark, sf).withColumn("b", F.col("doc_id") * 53 % 97)
    return E.rank_ensemble(m, ["p", "b"]).select("doc_id", F.round("score", R).alias("score"))


@query("""WITH j AS (SELECT doc_id, quality AS a, CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END AS b, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN toxic ELSE quality END AS c FROM labels)
SELECT doc_id, CASE WHEN c IS NULL THEN 'missing' WHEN a = b AND b = c THEN '3-0' ELSE '2-1' END AS vote, CASE WHEN c IS NULL THEN NULL WHEN a + b + c >= 2 THEN 1 ELSE 0 END AS majority,
CASE WHEN c IS NOT NULL AND NOT (a = b AND b = c) THEN TRUE ELSE FALSE END AS arbiter FROM j""")
def g26_judge_votes(spark: SparkSession, sf: str) -> DataFrame:
    d, q = F.col("doc_id"), F.col("quality")
    j = table(spark, sf, "labels").select("doc_id", q.alias("a"), F.when(d % 5 == 0, 1 - q).otherwise(q).alias("b"), F.when(d % 7 == 0, F.lit(None)).when(d % 3 == 0, F.col("toxic")).otherwise(q).alias("c"))
    same = (F.col("a") == F.col("b")) & (F.col("b") == F.col("c"))
    return j.select(
        "doc_id", F.when(F.col("c").isNull(), "missing").when(same, "3-0").otherwise("2-1").alias("vote"),
        F.when(F.col("c").isNotNull(), (F.col("a") + F.col("b") + F.col("c") >= 2).cast("int")).alias("majority"), (F.col("c").isNotNull() & ~same).alias("arbiter"),
    )


@query("""WITH v AS (SELECT source, sum(quality) AS p, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source)
SELECT source, n, CAST(CASE WHEN 2 * p > n THEN 1 WHEN 2 * p < n THEN 0 ELSE CAST('0x' || substr(sha256('7' || chr(0) || source), 1, 2) AS INT) % 2 END AS INT) AS label FROM v""")
def g25_m05_majority_label(spark: SparkSession, sf: str) -> DataFrame:
    """Majority of a document group; a tie takes the low bit of a hash's first byte."""
    v = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id").groupBy("source").agg(F.sum("quality").alias("p"), F.count("*").alias("n"))
    tie = F.conv(F.substring(F.sha2(F.concat(F.lit("7\0"), F.col("source")), 256), 1, 2), 16, 10).cast("int") % 2
    return v.select("source", "n", F.when(2 * F.col("p") > F.col("n"), 1).when(2 * F.col("p") < F.col("n"), 0).otherwise(tie).cast("int").alias("label"))


@query("""SELECT o_custkey % 50 AS g, round(sum(o_totalprice * (o_orderkey % 4)) FILTER (WHERE o_orderkey % 4 > 0 AND o_orderkey % 11 > 0) / nullif(sum(o_orderkey % 4) FILTER (WHERE o_orderkey % 4 > 0 AND o_orderkey % 11 > 0), 0), 4) AS mean FROM orders GROUP BY 1""")
def g01_weighted_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Null values and weights that aren't positive don't count; null if nothing counts."""
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("g"), F.when(k % 11 > 0, F.col("o_totalprice")).alias("v"), (k % 4).alias("w"))
    w = F.when(F.col("v").isNotNull() & (F.col("w") > 0), F.col("w"))
    return rows.groupBy("g").agg(F.round(F.sum(F.col("v") * w) / F.nullif(F.sum(w), F.lit(0)), 4).alias("mean"))


@query("""WITH v AS (SELECT o_custkey % 40 AS g, o_orderpriority AS label, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS w, o_orderkey % 6 AS bucket FROM orders), b AS (SELECT g, bucket, label, max(w) AS w FROM v GROUP BY 1, 2, 3),
s AS (SELECT g, label, sum(w) AS w FROM b GROUP BY 1, 2), t AS (SELECT *, CASE label WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 3 ELSE 4 END AS pri FROM s)
SELECT g, max_by(label, (w, -pri)) AS label, CAST(max(w) AS BIGINT) AS votes FROM t GROUP BY g""")
def g02_weighted_vote(spark: SparkSession, sf: str) -> DataFrame:
    """One vote per bucket and label, ties by a fixed order of labels."""
    order = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]
    v = table(spark, sf, "orders").select((F.col("o_custkey") % 40).alias("g"), F.col("o_orderpriority").alias("label"), F.when(F.col("o_orderstatus") == "F", 2).otherwise(1).alias("w"), (F.col("o_orderkey") % 6).alias("bucket"))
    s = v.groupBy("g", "bucket", "label").agg(F.max("w").alias("w")).groupBy("g", "label").agg(F.sum("w").alias("w"))
    pri = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col("label")), F.lit(0)) - 1, F.lit(4))
    return s.groupBy("g").agg(F.max_by("label", F.struct("w", -pri)).alias("label"), F.max("w").alias("votes"))


@query(f"""WITH {SIGNALS}, s AS (SELECT DISTINCT sector, ticker, date FROM signals), z AS (SELECT sector, count(*) AS n FROM s GROUP BY sector), i AS (SELECT a.sector AS x, b.sector AS y, count(*) AS i FROM s a JOIN s b ON a.ticker = b.ticker AND a.date = b.date AND a.sector < b.sector GROUP BY 1, 2)
SELECT count(*) AS pairs, round(avg(coalesce(i, 0)::DOUBLE / (p.n + q.n - coalesce(i, 0))), {R}) AS jaccard FROM z p JOIN z q ON p.sector < q.sector LEFT JOIN i ON x = p.sector AND y = q.sector""")
def g05_j17_mean_pair_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """Mean Jaccard over unordered pairs of sectors, of the sets of (ticker, day) that have a signal; only pairs of sectors that meet in an element are formed."""
    s = V.signals(spark, sf).select("sector", "ticker", "date").distinct()
    size = s.groupBy("sector").agg(F.count("*").alias("n"))
    x, y = s.withColumnRenamed("sector", "x"), s.withColumnRenamed("sector", "y")
    both = x.join(y, ["ticker", "date"]).where("x < y").groupBy("x", "y").agg(F.count("*").alias("i"))
    p, q = size.select(F.col("sector").alias("x"), F.col("n").alias("nx")), size.select(F.col("sector").alias("y"), F.col("n").alias("ny"))
    i = F.coalesce("i", F.lit(0))
    pairs = p.join(q, F.col("x") < F.col("y")).join(both, ["x", "y"], "left")
    return pairs.agg(F.count("*").alias("pairs"), F.round(F.avg(i / (F.col("nx") + F.col("ny") - i)), R).alias("jaccard"))


@query(f"""WITH {SIGNALS}, m AS (SELECT ticker, sector, avg(score) AS m FROM signals GROUP BY 1, 2) SELECT ticker, count(*) AS roles, round(CASE WHEN count(*) >= 2 THEN stddev_samp(m) END, 4) AS sd,
(SELECT count(DISTINCT signal_type) >= 2 FROM signals s WHERE s.ticker = m.ticker AND s.score > 300000) AS disagree FROM m GROUP BY ticker""")
def g04_dispersion(spark: SparkSession, sf: str) -> DataFrame:
    s = V.signals(spark, sf)
    sd = s.groupBy("ticker", "sector").agg(F.avg("score").alias("m")).groupBy("ticker").agg(F.count("*").alias("roles"), F.when(F.count("*") >= 2, F.stddev_samp("m")).alias("sd"))
    kinds = s.groupBy("ticker").agg((F.count_distinct(F.when(F.col("score") > 300000, F.col("signal_type"))) >= 2).alias("disagree"))
    return sd.join(kinds, "ticker").select("ticker", "roles", F.round("sd", 4).alias("sd"), "disagree")


@query(f"""WITH {SIGNALS} SELECT ticker, count(*) AS n, min_by(signal_id, (score, signal_id)) AS weakest, max_by(signal_id, (score, signal_id)) AS strongest, count(*) FILTER (WHERE sector = 'BUILDING') AS building,
array_to_string(list_sort(list(DISTINCT signal_type)), ',') AS kinds FROM signals GROUP BY ticker""")
def g06_g08_narrative(spark: SparkSession, sf: str) -> DataFrame:
    order = F.struct("score", "signal_id")
    return V.signals(spark, sf).groupBy("ticker").agg(
        F.count("*").alias("n"), F.min_by("signal_id", order).alias("weakest"), F.max_by("signal_id", order).alias("strongest"),
        F.count_if(F.col("sector") == "BUILDING").alias("building"), F.array_join(F.array_sort(F.collect_set("signal_type")), ",").alias("kinds"),
    )


@query("""WITH r AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE length(text) < 200) AS short, count(*) FILTER (WHERE text IS NULL) AS missing FROM documents GROUP BY source)
SELECT source, round(short::DOUBLE / greatest(1, n), 8) AS short_rate, short * 10 <= greatest(1, n) AS short_ok, missing = 0 AS complete FROM r""")
def g24_quality_gates(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.length("text") < 200).alias("short"), F.count_if(F.col("text").isNull()).alias("missing"))
    n = F.greatest(F.lit(1), F.col("n"))
    return d.select("source", F.round(F.col("short") / n, R).alias("short_rate"), (F.col("short") * 10 <= n).alias("short_ok"), (F.col("missing") == 0).alias("complete"))


@query(f"""WITH {SIGNALS}, q AS (SELECT sector, quantile_cont(score, [0.2, 0.4, 0.6, 0.8]) AS q FROM signals GROUP BY sector), t AS (SELECT sector, unnest(q) AS tau FROM q),
c AS (SELECT sector, tau, count(*) AS n, avg(CASE WHEN signal_id % 3 = 0 THEN 1.0 ELSE 0.0 END) AS hit FROM t JOIN signals USING (sector) WHERE score >= tau GROUP BY 1, 2)
SELECT sector, round(max_by(tau, (hit, n)), 4) AS tau FROM c WHERE n >= 3 GROUP BY sector""")
def g30_quantile_grid(spark: SparkSession, sf: str) -> DataFrame:
    s = V.signals(spark, sf)
    grid = s.groupBy("sector").agg(F.explode(F.percentile("score", F.array(*[F.lit(x) for x in (0.2, 0.4, 0.6, 0.8)]))).alias("tau"))
    c = s.join(F.broadcast(grid), "sector").where("score >= tau").groupBy("sector", "tau").agg(F.count("*").alias("n"), F.avg((F.col("signal_id") % 3 == 0).cast("double")).alias("hit"))
    return c.where("n >= 3").groupBy("sector").agg(F.round(F.max_by("tau", F.struct("hit", "n")), 4).alias("tau"))


@query(f"""WITH {V.PRICES}, o AS (SELECT l_orderkey, CAST(l_partkey % {V.TICKERS} AS INT) AS ticker, CAST(l_shipdate AS DATE) AS date, sum(l_extendedprice) AS v, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2, 3),
r AS (SELECT ticker, date, sum(v) / sum(q) AS again FROM o GROUP BY 1, 2) SELECT count(*) AS rows, CAST(count(*) FILTER (WHERE (close IS NULL) != (again IS NULL)) AS BIGINT) AS only_one,
count(*) FILTER (WHERE abs(close - again) > 1e-12 + 1e-9 * abs(again)) AS mismatches FROM prices FULL JOIN r USING (ticker, date)""")
def g34_parity(spark: SparkSession, sf: str) -> DataFrame:
    """The batch's prices (exact sums by ticker and day) against a replay order by order (sums of doubles), within a relative and an absolute tolerance."""
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", (F.col("l_partkey") % V.TICKERS).cast("int").alias("ticker"), F.col("l_shipdate").cast("date").alias("date"), "l_extendedprice", "l_quantity"
    )
    orders = lines.groupBy("l_orderkey", "ticker", "date").agg(F.sum("l_extendedprice").alias("v"), F.sum("l_quantity").alias("q"))
    replay = orders.groupBy("ticker", "date").agg((F.sum("v") / F.sum("q")).alias("again"))
    far = F.abs(F.col("close") - F.col("again")) > 1e-12 + 1e-9 * F.abs("again")
    both = V.prices(spark, sf).join(replay, ["ticker", "date"], "full")
    return both.agg(F.count("*").alias("rows"), F.count_if(F.col("close").isNull() != F.col("again").isNull()).alias("only_one"), F.count_if(far).alias("mismatches"))


@query(f"""{BASE}, {RANKED} SELECT CASE WHEN month < DATE '1997-01-01' THEN 'early' WHEN month < DATE '1999-01-01' THEN 'middle' ELSE 'late' END AS period, count(ic) AS months, round(sum(ic * n) / sum(n) FILTER (WHERE ic IS NOT NULL), {R}) AS ic FROM ic GROUP BY 1""")
def g33_g37_subperiods(spark: SparkSession, sf: str) -> DataFrame:
    ic = E.cross_sectional_ic(panel(spark, sf), ["score"], ["ret"], ["month"], 6)
    m = F.col("month")
    period = F.when(m < "1997-01-01", "early").when(m < "1999-01-01", "middle").otherwise("late")
    return ic.groupBy(period.alias("period")).agg(F.count("ic").alias("months"), F.round(F.sum(F.col("ic") * F.col("n")) / F.sum(F.when(F.col("ic").isNotNull(), F.col("n"))), R).alias("ic"))


def g22_block_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """2.5 and 97.5 percent points of the mean and Sharpe ratio over resampled blocks of the monthly spread."""
    spread = E.top_minus_bottom(panel(spark, sf), "score", "ret", "month", "id", 3)
    b = E.block_bootstrap(spread, "month", "spread", 6, 2000, 42).withColumn("sharpe", F.col("mean") / F.nullif(F.col("sd"), F.lit(0.0)) * 12**0.5)
    q = F.array(F.lit(0.025), F.lit(0.975))
    return b.agg(F.percentile("mean", q).alias("mean_ci"), F.percentile("sharpe", q).alias("sharpe_ci"))


query()(g22_block_bootstrap)
