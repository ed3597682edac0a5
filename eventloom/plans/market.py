"""Queries over dates, prices and signals, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions.ranks import with_rank
from ..operators import joins as J
from ..operators import series as S
from ..sources import views as V
from ..sources.views import CALENDAR, PRICES, SIGNALS, table
from .registry import query

R = 8  # digits that floating results are compared at


def r(c: str, name: str | None = None):
    return (F.round(F.col(c), R) + F.lit(0.0)).alias(name or c)  # a negative zero becomes zero


RETURNS = "returns AS (SELECT * FROM (SELECT ticker, date, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM prices) WHERE ret IS NOT NULL)"
MARKET = "market AS (SELECT date, median(ret) AS market FROM returns GROUP BY date)"
DAYS = "days AS (SELECT ticker, date, max_by(score, signal_id) AS score FROM signals GROUP BY ticker, date)"


def returns(spark, sf):
    return S.simple_returns(V.prices(spark, sf))


def market(rets: DataFrame) -> DataFrame:
    """Cross-member median return of each date."""
    return rets.groupBy("date").agg(F.median("ret").alias("market"))


@query("""WITH e AS (SELECT event_id, ts, CAST(ts AS DATE) + CASE WHEN hour(ts) >= 13 THEN 1 ELSE 0 END AS d FROM events),
c AS (SELECT event_id, CAST(d + CASE isodow(d) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS DATE) AS entry_date FROM e)
SELECT event_id, entry_date, CAST(CASE WHEN entry_date < DATE '2024-01-15' THEN
  (SELECT min(x) FROM (SELECT CAST(entry_date + CAST(i AS INT) AS DATE) x FROM range(1, 8) t(i)) WHERE isodow(x) < 6 AND
     (SELECT count(*) FROM range(1, 8) u(j) WHERE isodow(CAST(entry_date + CAST(j AS INT) AS DATE)) < 6 AND CAST(entry_date + CAST(j AS INT) AS DATE) <= x) = 2)
  ELSE greatest(entry_date, CASE WHEN event_id % 3 > 0 THEN CAST(entry_date + CAST(event_id % 4 AS INT) AS DATE) END) END AS DATE) AS availability_date FROM c""")
def d02_d03_entry_and_availability(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", D.entry_date(F.col("ts")).alias("entry_date"))
    ingest = F.when(F.col("event_id") % 3 > 0, F.date_add("entry_date", (F.col("event_id") % 4).cast("int")))
    return e.withColumn("availability_date", D.availability_date(F.col("entry_date"), ingest, "2024-01-15"))


@query("""SELECT event_id, CAST((SELECT count(*) FROM range(0, CAST(event_id % 30 AS INT)) t(i) WHERE isodow(CAST(CAST(ts AS DATE) + CAST(i AS INT) AS DATE)) < 6) AS INT) AS n,
CAST(list_filter(list_transform(range(1, 9), lambda i: CAST(CAST(ts AS DATE) + CAST(i AS INT) AS DATE)), lambda x: isodow(x) < 6)[3] AS DATE) AS plus3,
CAST(list_filter(list_transform(range(1, 9), lambda i: CAST(CAST(ts AS DATE) - CAST(i AS INT) AS DATE)), lambda x: isodow(x) < 6)[3] AS DATE) AS minus3 FROM events""")
def d04_business_days(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("ts").cast("date")
    return table(spark, sf, "events").select(
        "event_id", D.business_days_between(d, F.date_add(d, (F.col("event_id") % 30).cast("int"))).alias("n"),
        D.add_business_days(d, 3).alias("plus3"), D.add_business_days(d, -3).alias("minus3"),
    )


@query("""SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter,
CAST(isoyear(o_orderdate) AS INT) AS iso_year, CAST(week(o_orderdate) AS INT) AS iso_week, last_day(CAST(o_orderdate AS DATE)) AS month_end,
CASE WHEN year(o_orderdate) < 1997 THEN 'early' WHEN year(o_orderdate) < 1999 THEN 'middle' ELSE 'late' END AS subperiod FROM orders""")
def d05_p13_periods(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.trunc(d, "month").alias("month"), F.trunc(d, "quarter").alias("quarter"),
        F.extract(F.lit("YEAROFWEEK"), d).alias("iso_year"), F.extract(F.lit("WEEK"), d).alias("iso_week"), F.last_day(d).alias("month_end"),
        F.when(F.year(d) < 1997, "early").when(F.year(d) < 1999, "middle").otherwise("late").alias("subperiod"),
    )


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN ts::TIMESTAMP WHEN 1 THEN date_trunc('day', ts)::TIMESTAMP END AS parsed,
CAST(CASE event_id % 4 WHEN 0 THEN hour(ts) WHEN 1 THEN 0 END AS INT) AS hour FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)""")
def d01_lenient_parse(spark: SparkSession, sf: str) -> DataFrame:
    k, ts = F.col("event_id") % 4, F.col("ts")
    text = F.when(k == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.date_format(ts, "yyyy/MM/dd")).when(k == 2, F.lit("not a date"))
    parsed = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd")])
    return table(spark, sf, "events").select("event_id", parsed.cast("timestamp_ntz").alias("parsed"), F.hour(parsed).alias("hour"))


@query(f"""WITH {SIGNALS}, {DAYS} SELECT ticker, date, round(score - lag(score) OVER (PARTITION BY ticker ORDER BY date), {R}) AS delta,
round((-3 * lag(score, 3) OVER w - lag(score, 2) OVER w + lag(score, 1) OVER w + 3 * score) / 10, {R}) AS slope FROM days WINDOW w AS (PARTITION BY ticker ORDER BY date)""")
def w01_w03_delta_and_slope(spark: SparkSession, sf: str) -> DataFrame:
    days = S.over_days(V.signals(spark, sf), "ticker", "date", "score", "signal_id")
    by = W.partitionBy("ticker").orderBy("date")
    return days.select("ticker", "date", F.round(F.col("score") - F.lag("score").over(by), R).alias("delta"), F.round(S.slope4("score", by), R).alias("slope"))


@query(f"""WITH {SIGNALS}, {DAYS}, l AS (SELECT ticker, date, lag(score) OVER (PARTITION BY ticker ORDER BY date) AS was FROM days)
SELECT signal_id, round(score - was, {R}) AS change FROM signals JOIN l USING (ticker, date)""")
def w02_j03_lag_over_distinct_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of one day share the baseline of the day before."""
    s = V.signals(spark, sf)
    days = S.over_days(s, "ticker", "date", "score", "signal_id")
    base = days.select("ticker", "date", F.lag("score").over(W.partitionBy("ticker").orderBy("date")).alias("was"))
    return s.join(base, ["ticker", "date"]).select("signal_id", F.round(F.col("score") - F.col("was"), R).alias("change"))


@query(f"""WITH {PRICES}, {RETURNS}, {MARKET}, b AS (SELECT ticker, date, CASE WHEN count(*) OVER f >= 30 THEN covar_samp(ret, market) OVER f / nullif(var_samp(market) OVER f, 0) END AS b
FROM returns JOIN market USING (date) WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
SELECT ticker, date, round(lag(b, 4) OVER (PARTITION BY ticker ORDER BY date), 6) AS beta FROM b""")
def w06_g19_rolling_beta(spark: SparkSession, sf: str) -> DataFrame:
    rets = returns(spark, sf)
    return S.rolling_beta(rets, market(rets), 60, 30, 4).withColumn("beta", F.round("beta", 6))


@query(f"""WITH {PRICES} SELECT ticker, date, {", ".join(f"round(lead(close, {h}) OVER w / close - 1, {R}) AS fwd_{h}, lead(date, {h}) OVER w AS exit_{h}" for h in (1, 3, 5, 10, 20))}
FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY date)""")
def w07_forward_returns(spark: SparkSession, sf: str) -> DataFrame:
    out = S.forward_returns(V.prices(spark, sf), [1, 3, 5, 10, 20])
    return out.select(*[r(c) if c.startswith("fwd") else F.col(c) for c in out.columns])


@query(f"""WITH {PRICES}, {RETURNS}, e AS (SELECT ticker, date, product(1 + ret / 100) OVER w AS equity FROM returns WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING))
SELECT ticker, date, round(equity, 6) AS equity, round(equity / max(equity) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) - 1, 6) AS drawdown FROM e""")
def w08_w09_equity_and_drawdown(spark: SparkSession, sf: str) -> DataFrame:
    rets = returns(spark, sf).withColumn("ret", F.col("ret") / 100)
    return S.equity_and_drawdown(rets).select("ticker", "date", F.round("equity", 6).alias("equity"), F.round("drawdown", 6).alias("drawdown"))


@query(f"""WITH {PRICES}, {RETURNS} SELECT ticker, date, round(CASE WHEN count(*) OVER f = 252 THEN avg(ret) OVER f / nullif(stddev_samp(ret) OVER f, 0) * sqrt(252) END, 6) AS sharpe
FROM returns WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)""")
def w10_rolling_sharpe(spark: SparkSession, sf: str) -> DataFrame:
    return S.rolling_sharpe(returns(spark, sf), 252, 252).withColumn("sharpe", F.round("sharpe", 6))


@query(f"""WITH {PRICES}, {RETURNS}, s AS (SELECT ticker, date, sum(ln(1 + ret)) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS s FROM returns)
SELECT ticker, date, round(exp(s - lag(s, 21) OVER (PARTITION BY ticker ORDER BY date)) - 1, 6) AS ret_21 FROM s""")
def w11_compounded_returns(spark: SparkSession, sf: str) -> DataFrame:
    return S.compounded(returns(spark, sf), 21).withColumn("ret_21", F.round("ret_21", 6))


@query(f"""WITH {SIGNALS}, m AS (SELECT *, CAST(date_trunc('month', date) AS DATE) AS month FROM signals)
SELECT month, ticker, max_by(signal_id, (date, signal_id)) AS latest, max_by(signal_id, (score, -signal_id)) AS strongest FROM m GROUP BY month, ticker""")
def w12_keep_last_and_best(spark: SparkSession, sf: str) -> DataFrame:
    m = V.signals(spark, sf).withColumn("month", F.trunc("date", "month"))
    return m.groupBy("month", "ticker").agg(
        F.max_by("signal_id", F.struct("date", "signal_id")).alias("latest"), F.max_by("signal_id", F.struct("score", -F.col("signal_id"))).alias("strongest")
    )


@query(f"""WITH {SIGNALS} SELECT signal_id, rank() OVER (PARTITION BY signal_type ORDER BY CAST(score / 1000 AS INT)) + (count(*) OVER (PARTITION BY signal_type, CAST(score / 1000 AS INT)) - 1) / 2.0::DOUBLE AS avg_rank FROM
(SELECT signal_id, signal_type, floor(score / 1000) * 1000 AS score FROM signals)""")
def w13_average_rank(spark: SparkSession, sf: str) -> DataFrame:
    s = V.signals(spark, sf).withColumn("v", F.floor(F.col("score") / 1000))
    return with_rank(s, "v", ["signal_type"]).select("signal_id", F.col("rank").cast("double").alias("avg_rank"))


@query(f"""WITH {PRICES}, {CALENDAR}, g AS (SELECT t.ticker, c.date FROM (SELECT DISTINCT ticker FROM prices) t, calendar c)
SELECT ticker, date, round(last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING), {R}) AS close FROM g LEFT JOIN prices USING (ticker, date)""")
def w14_j18_fill_forward(spark: SparkSession, sf: str) -> DataFrame:
    p = V.prices(spark, sf)
    # the grid: each ticker lists the calendar, a few thousand days, instead of a cross join
    days = p.agg(F.array_sort(F.collect_set("date")).alias("days"))
    grid = p.select("ticker").distinct().join(F.broadcast(days)).select("ticker", F.explode("days").alias("date"))
    return S.fill_forward(p, grid, "ticker", "date", "close").select("ticker", "date", r("close"))


@query(f"""WITH {PRICES}, {CALENDAR} SELECT 'daily' AS kind, date FROM calendar UNION ALL SELECT 'week_first', min(date) FROM calendar GROUP BY isoyear(date), week(date)
UNION ALL SELECT 'week_last', max(date) FROM calendar GROUP BY isoyear(date), week(date) UNION ALL SELECT 'month_first', min(date) FROM calendar GROUP BY date_trunc('month', date)""")
def w15_u01_rebalance_dates(spark: SparkSession, sf: str) -> DataFrame:
    return S.rebalance_dates(V.calendar(spark, sf).select("date"))


@query(f"""WITH {PRICES} SELECT ticker, date, round(CASE WHEN count(*) OVER f = 20 THEN avg(volume * close) OVER f END, 4) AS adv FROM prices
WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""")
def w16_prior_mean_volume(spark: SparkSession, sf: str) -> DataFrame:
    p = V.prices(spark, sf).withColumn("traded", F.col("volume") * F.col("close"))
    return p.select("ticker", "date", F.round(S.prior_mean(p, "traded", 20), 4).alias("adv"))


@query(f"""WITH {PRICES}, {CALENDAR}, {SIGNALS}, m AS (SELECT min(date) AS date FROM calendar GROUP BY date_trunc('month', date))
SELECT m.date AS rebalance, s.signal_id FROM m JOIN calendar c USING (date) JOIN calendar d ON d.pos BETWEEN c.pos - 20 AND c.pos JOIN signals s ON s.date = d.date""")
def w17_trailing_cohort(spark: SparkSession, sf: str) -> DataFrame:
    cal = V.calendar(spark, sf)
    first = S.rebalance_dates(cal.select("date")).where("kind = 'month_first'").select("date")
    return S.trailing_cohort(V.signals(spark, sf), cal, first, 21).select("rebalance", "signal_id")


@query(f"""WITH {PRICES}, {CALENDAR}, g AS (SELECT t.ticker, c.date, c.pos FROM (SELECT DISTINCT ticker FROM prices) t, calendar c), j AS (SELECT g.*, close FROM g LEFT JOIN prices USING (ticker, date))
SELECT ticker, date, coalesce(bool_or(close IS NOT NULL) OVER (PARTITION BY ticker ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), FALSE) AS recovers FROM j""")
def w22_look_ahead(spark: SparkSession, sf: str) -> DataFrame:
    p = V.prices(spark, sf)
    days = V.calendar(spark, sf).agg(F.collect_list(F.struct("date", "pos")).alias("days"))
    grid = p.select("ticker").distinct().join(F.broadcast(days)).select("ticker", F.explode("days").alias("d")).select("ticker", "d.*")
    dense = grid.join(p.select("ticker", "date", "close"), ["ticker", "date"], "left")
    return dense.select("ticker", "date", S.look_ahead(dense, 3).alias("recovers"))


@query(f"""WITH {SIGNALS}, s AS (SELECT *, CAST(date + CAST(signal_id % 5 AS INT) AS DATE) AS known FROM signals)
SELECT a.signal_id, round(CAST(count(*) FILTER (WHERE b.score <= a.score) AS DOUBLE) / nullif(count(b.signal_id), 0), {R}) AS pct
FROM s a LEFT JOIN s b ON a.sector = b.sector AND a.signal_type = b.signal_type AND b.known < a.date GROUP BY a.signal_id""")
def j12_w23_strict_past_percentile(spark: SparkSession, sf: str) -> DataFrame:
    s = V.signals(spark, sf).withColumn("known", F.date_add("date", (F.col("signal_id") % 5).cast("int")))
    out = J.strict_past_percentile(s, "signal_id", "score", "date", "known", ["sector", "signal_type"])
    return out.select("signal_id", r("pct"))


@query(f"""WITH {PRICES}, {SIGNALS} SELECT s.signal_id, p.date AS quote_date, round(p.close, {R}) AS close FROM signals s
ASOF LEFT JOIN (SELECT * FROM prices WHERE volume > 40) p ON s.ticker = p.ticker AND s.date >= p.date""".replace("p.date AS quote_date, round(p.close", "CASE WHEN s.date - p.date <= 3 THEN p.date END AS quote_date, round(CASE WHEN s.date - p.date <= 3 THEN p.close END"))
def j05_asof_backward(spark: SparkSession, sf: str) -> DataFrame:
    p = V.prices(spark, sf).where("volume > 40").select("ticker", F.col("date").alias("quote_date"), "close")
    return J.asof(V.signals(spark, sf), p, "ticker", "date", "quote_date", ["close"], 3).select("signal_id", "quote_date", r("close"))


@query(f"""WITH {PRICES}, {SIGNALS}, q AS (SELECT s.signal_id, s.date, p.date AS e, p.close FROM signals s ASOF LEFT JOIN (SELECT * FROM prices WHERE volume > 60) p ON s.ticker = p.ticker AND s.date <= p.date),
g AS (SELECT *, (SELECT count(*) FROM range(0, CAST(least(e - date, 20) AS INT)) t(i) WHERE isodow(CAST(date + CAST(i AS INT) AS DATE)) < 6) AS gap FROM q)
SELECT signal_id, CASE WHEN gap <= 5 AND e - date <= 10 THEN e END AS entry_date, round(CASE WHEN gap <= 5 AND e - date <= 10 THEN close END, {R}) AS entry_close FROM g""")
def j06_asof_forward(spark: SparkSession, sf: str) -> DataFrame:
    bars = V.prices(spark, sf).where("volume > 60").select("ticker", "date", "close")
    return J.forward_entry(V.signals(spark, sf), bars).select("signal_id", "entry_date", r("entry_close"))


@query(f"""WITH {PRICES}, {CALENDAR}, {SIGNALS} SELECT signal_id, c.date AS anchor FROM signals s ASOF LEFT JOIN calendar c ON s.date > c.date""")
def j08_strictly_before(spark: SparkSession, sf: str) -> DataFrame:
    days = V.calendar(spark, sf).select(F.lit(0).alias("k"), F.col("date").alias("anchor"))
    s = V.signals(spark, sf).select(F.lit(0).alias("k"), "signal_id", "date")
    # one calendar serves all rows: spans of time, not tickers, deal the work
    return J.asof(s, days, "k", "date", "anchor", [], 400, strict=True).select("signal_id", "anchor")


UNIVERSE = "universe AS (SELECT DISTINCT last_day(date) AS snapshot, ticker FROM signals WHERE signal_type = '1-URGENT')"


def universe(spark, sf):
    s = V.signals(spark, sf)
    return s.where("signal_type = '1-URGENT'").select(F.last_day("date").alias("snapshot"), "ticker").distinct()


@query(f"""WITH {SIGNALS}, {UNIVERSE}, d AS (SELECT DISTINCT snapshot FROM universe), a AS (SELECT s.signal_id, s.ticker, s.date, d.snapshot FROM signals s ASOF JOIN d ON s.date >= d.snapshot)
SELECT signal_id FROM a WHERE date - snapshot <= 20 AND EXISTS (SELECT 1 FROM universe u WHERE u.snapshot = a.snapshot AND u.ticker = a.ticker)""")
def j07_snapshot_members(spark: SparkSession, sf: str) -> DataFrame:
    return J.snapshot_members(V.signals(spark, sf), universe(spark, sf), "date", 20).select("signal_id")


@query(f"""WITH {PRICES}, {SIGNALS}, n AS (SELECT ticker, date, close, lead(close, 1) OVER w AS entry, lead(close, 6) OVER w AS e5, lag(close, 1) OVER w AS b1, lag(close, 22) OVER w AS b22 FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY date))
SELECT s.signal_id, round(n.e5 / nullif(n.entry, 0) - 1, {R}) AS label_5, round(n.b1 / nullif(n.b22, 0) - 1, {R}) AS momentum FROM signals s ASOF LEFT JOIN n ON s.ticker = n.ticker AND s.date <= n.date""")
def j09_bar_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Entry one bar after the first bar on or after the day, exit five bars later; momentum from the bars before."""
    by = W.partitionBy("ticker").orderBy("date")
    off = V.prices(spark, sf).select("ticker", F.col("date").alias("bar"), *[F.lead("close", k).over(by).alias(n) for k, n in ((1, "entry"), (6, "e5"))], *[F.lag("close", k).over(by).alias(n) for k, n in ((1, "b1"), (22, "b22"))])
    got = J.asof(V.signals(spark, sf), off, "ticker", "date", "bar", ["entry", "e5", "b1", "b22"], 4000, forward=True)
    ratio = lambda a, b: F.round(F.col(a) / F.nullif(F.col(b), F.lit(0.0)) - 1, R)
    return got.select("signal_id", ratio("e5", "entry").alias("label_5"), ratio("b1", "b22").alias("momentum"))


@query(f"""WITH {PRICES}, {SIGNALS} SELECT signal_id, round(p.close, {R}) AS bench FROM signals s LEFT JOIN (SELECT date, close FROM prices WHERE ticker = 0) p USING (date)""")
def j10_exact_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    bench = V.prices(spark, sf).where("ticker = 0").select("date", "close")
    return V.signals(spark, sf).join(bench, "date", "left").select("signal_id", r("close", "bench"))


@query(f"""WITH {PRICES}, {CALENDAR}, {SIGNALS}, s AS (SELECT DISTINCT ticker, date FROM signals), q AS (SELECT ticker, pos, date, close FROM (SELECT * FROM prices WHERE volume > 60) JOIN calendar USING (date)),
j AS (SELECT s.ticker, s.date, min_by(q.date, q.pos) AS quote_date, min_by(q.close, q.pos) AS quote FROM s JOIN calendar c USING (date) LEFT JOIN q ON q.ticker = s.ticker AND q.pos BETWEEN c.pos AND c.pos + 5 GROUP BY 1, 2)
SELECT s.ticker, s.date, quote_date, round(quote, {R}) AS quote FROM s LEFT JOIN j USING (ticker, date)""")
def j11_next_quote(spark: SparkSession, sf: str) -> DataFrame:
    plans = V.signals(spark, sf).select("ticker", "date").distinct()
    quotes = V.prices(spark, sf).where("volume > 60")
    return J.next_quote(plans, quotes, V.calendar(spark, sf), 5).select("ticker", "date", "quote_date", r("quote"))


@query(f"""WITH {SIGNALS}, {UNIVERSE}, m AS (SELECT CAST(last_day(CAST(x AS DATE)) AS DATE) AS month_end FROM (SELECT unnest(generate_series((SELECT date_trunc('month', min(snapshot)) FROM universe), TIMESTAMP '2001-12-01', INTERVAL 1 MONTH)) AS x)),
a AS (SELECT month_end, d.snapshot FROM m ASOF JOIN (SELECT DISTINCT snapshot FROM universe) d ON m.month_end >= d.snapshot) SELECT month_end, ticker FROM a JOIN universe USING (snapshot)""")
def j19_month_grid(spark: SparkSession, sf: str) -> DataFrame:
    return J.month_grid(universe(spark, sf), "2001-12-01")


@query(f"""WITH {SIGNALS}, c AS (SELECT ticker, date, max_by(signal_id, signal_id) % 3 > 0 AS added FROM signals GROUP BY 1, 2), s AS (SELECT *, lag(added) OVER (PARTITION BY ticker ORDER BY date) AS was FROM c),
t AS (SELECT ticker, added, date AS valid_from, lead(date) OVER (PARTITION BY ticker ORDER BY date) AS valid_to FROM s WHERE was IS NULL OR was != added) SELECT ticker, valid_from, valid_to FROM t WHERE added""")
def j20_membership_intervals(spark: SparkSession, sf: str) -> DataFrame:
    log = V.signals(spark, sf).groupBy("ticker", "date").agg((F.max("signal_id") % 3 > 0).alias("added"))
    return J.membership_intervals(log)


@query(f"""WITH {SIGNALS}, {PRICES}, p AS (SELECT ticker, last_day(date) AS month, count(*) AS bars FROM prices GROUP BY 1, 2), s AS (SELECT ticker, last_day(date) AS month, count(*) AS n FROM signals GROUP BY 1, 2)
SELECT ticker, month, n, bars FROM s JOIN p USING (ticker, month)""")
def j01_validated_join(spark: SparkSession, sf: str) -> DataFrame:
    bars = V.prices(spark, sf).groupBy("ticker", F.last_day("date").alias("month")).agg(F.count("*").alias("bars"))
    n = V.signals(spark, sf).groupBy("ticker", F.last_day("date").alias("month")).agg(F.count("*").alias("n"))
    return J.one_to_one(n, bars, ["ticker", "month"])


@query(f"""WITH {PRICES}, {CALENDAR}, {SIGNALS}, g AS (SELECT t.ticker, c.date, c.pos // 21 AS interval FROM (SELECT DISTINCT ticker FROM prices) t, calendar c),
b AS (SELECT g.*, CASE WHEN volume > 30 THEN close END AS price FROM g LEFT JOIN prices USING (ticker, date)),
n AS (SELECT *, row_number() OVER w AS n, last_value(price IGNORE NULLS) OVER (PARTITION BY ticker, interval ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM b WINDOW w AS (PARTITION BY ticker, interval ORDER BY date)),
a AS (SELECT *, n - max(CASE WHEN price IS NOT NULL THEN n END) OVER (PARTITION BY ticker, interval ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS streak FROM n),
c AS (SELECT *, bool_or(coalesce(streak >= 3 AND (price IS NULL OR streak > 3), FALSE)) OVER (PARTITION BY ticker, interval ORDER BY date ROWS UNBOUNDED PRECEDING) AS censored FROM a)
SELECT ticker, date, censored, round(CASE WHEN last IS NOT NULL AND NOT censored AND price IS NOT NULL THEN 0.05 * (price / last - 1) ELSE 0 END, {R}) AS pnl,
CAST(CASE WHEN last IS NOT NULL AND NOT censored AND price IS NULL THEN streak ELSE 0 END AS INT) AS gap_days FROM c""")
def w25_gap_states(spark: SparkSession, sf: str) -> DataFrame:
    p = V.prices(spark, sf).where("volume > 30").select("ticker", "date", F.col("close").alias("price"))
    days = V.calendar(spark, sf).agg(F.collect_list(F.struct("date", "pos")).alias("days"))
    grid = V.prices(spark, sf).select("ticker").distinct().join(F.broadcast(days)).select("ticker", F.explode("days").alias("d"))
    bars = grid.select("ticker", "d.date", F.expr("d.pos div 21").alias("interval")).join(p, ["ticker", "date"], "left").withColumn("weight", F.lit(0.05))
    return S.gap_states(bars).select("ticker", "date", "censored", r("pnl"), "gap_days")
