"""The simulated portfolio as queries, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import portfolio as P
from ..operators import series as S
from ..sources import views as V
from ..sources.views import PRICES, SIGNALS
from .market import R, r
from .registry import query

#: Weekly portfolios on quotes with gaps; small tables have few signals a day, so a leg needs two names.
RULES = P.Rules(floor=2)

CALENDAR = f"""quotes AS (SELECT ticker, date, close FROM prices, (SELECT min(date) AS a, max(date) AS b FROM signals) WHERE volume > 20 AND date BETWEEN a AND b + 30),
cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM quotes)),
fin AS (SELECT least(max(pos) FILTER (date <= (SELECT max(date) FROM signals)) + 1, max(pos)) AS stop FROM cal),
reb AS (SELECT c.date, c.pos, lead(c.date) OVER (ORDER BY c.date) AS nxt FROM cal c WHERE date <= (SELECT max(date) FROM signals)
  AND date IN (SELECT min(date) FROM cal GROUP BY date_part('isoyear', date), date_part('week', date)))"""
WEIGHTS = f"""best AS (SELECT date, ticker, max_by(score, (abs(score), score)) AS score FROM signals WHERE score IS NOT NULL GROUP BY 1, 2),
sized AS (SELECT *, count(*) OVER (PARTITION BY date) AS n FROM best),
rk AS (SELECT *, greatest({RULES.floor}, ceil(n * {RULES.share}::DOUBLE)) AS k, row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) AS up,
  row_number() OVER (PARTITION BY date ORDER BY score, ticker DESC) AS down FROM sized WHERE n >= {2 * RULES.floor}),
legs AS (SELECT date, ticker, CASE WHEN up <= k THEN 1 / k ELSE 0 END - CASE WHEN down <= k THEN 1 / k ELSE 0 END AS raw FROM rk WHERE up <= k OR down <= k),
net AS (SELECT reb.date AS rebalance, ticker, sum(raw) AS w FROM legs JOIN reb ON legs.date <= reb.date
  AND legs.date >= (SELECT date FROM cal WHERE cal.pos = greatest(0, reb.pos - {RULES.lookback - 1})) GROUP BY 1, 2),
centred AS (SELECT rebalance, ticker, w - avg(w) OVER (PARTITION BY rebalance) AS w FROM net),
target AS (SELECT rebalance, ticker, CASE WHEN sum(abs(w)) OVER g > 1e-10 THEN w * (2.0 / sum(abs(w)) OVER g) ELSE w END AS w FROM centred WINDOW g AS (PARTITION BY rebalance)),
found AS (SELECT t.*, c.pos AS reb_pos, (SELECT min(q.date) FROM quotes q JOIN cal d ON d.date = q.date WHERE q.ticker = t.ticker AND d.pos BETWEEN c.pos AND c.pos + {RULES.quote_days}) AS entry_date
  FROM target t JOIN cal c ON c.date = t.rebalance),
entered AS (SELECT f.rebalance, f.reb_pos, f.ticker, f.entry_date, c.pos AS entry_pos, q.close AS entry_price,
  CASE WHEN sum(abs(w)) OVER g > 1e-10 THEN w * (2.0 / sum(abs(w)) OVER g) ELSE w END AS weight
  FROM found f JOIN quotes q ON q.ticker = f.ticker AND q.date = f.entry_date JOIN cal c ON c.date = f.entry_date WINDOW g AS (PARTITION BY f.rebalance)),
starts AS (SELECT rebalance, lag(rebalance) OVER (ORDER BY rebalance) AS prev, coalesce(least(lead(reb_pos) OVER (ORDER BY reb_pos), stop), stop) AS stop_pos
  FROM (SELECT DISTINCT rebalance, reb_pos FROM entered), fin)"""
#: The state of a holding, day by day: last price, missing days in a row, censored.
DAYS = f"""placed AS (SELECT ticker, pos, close FROM quotes JOIN cal USING (date)),
held AS (SELECT e.rebalance, e.ticker, e.weight, e.entry_pos, e.entry_price, s.stop_pos FROM entered e JOIN starts s USING (rebalance) WHERE abs(weight) > 1e-12 AND e.entry_pos < s.stop_pos),
walk AS (
  SELECT rebalance, ticker, weight, stop_pos, entry_pos - 1 AS pos, entry_price AS price, 0 AS streak, FALSE AS censored, 0.0::DOUBLE AS pnl, FALSE AS gap FROM held
  UNION ALL
  SELECT w.rebalance, w.ticker, w.weight, w.stop_pos, w.pos + 1, CASE WHEN NOT w.censored THEN coalesce(p.close, w.price) ELSE w.price END,
    CASE WHEN p.close IS NULL THEN w.streak + 1 ELSE 0 END, w.censored OR (p.close IS NULL AND w.streak >= 2),
    CASE WHEN NOT w.censored AND p.close IS NOT NULL THEN w.weight * (p.close / w.price - 1) ELSE 0 END, p.close IS NULL AND (w.censored OR w.streak >= 2)
  FROM walk w LEFT JOIN placed p ON p.ticker = w.ticker AND p.pos = w.pos + 2 WHERE w.pos + 1 < w.stop_pos),
days AS (SELECT w.*, gap AND EXISTS (SELECT 1 FROM placed p WHERE p.ticker = w.ticker AND p.pos > w.pos AND p.pos <= w.pos + {RULES.recovery_days}) AS recovered
  FROM walk w JOIN held h USING (rebalance, ticker) WHERE w.pos >= h.entry_pos)"""


def weekly(spark: SparkSession, sf: str) -> P.Simulation:
    quotes = V.prices(spark, sf).where("volume > 20").select("ticker", "date", "close")
    signals = V.signals(spark, sf).select("date", "ticker", "score")
    # the first day with a quote of each week, from the first signal to the last
    ends = signals.agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    days = quotes.select("date").distinct().join(F.broadcast(ends), F.col("date").between(F.col("_a"), F.date_add("_b", 30))).select("date")
    rebalances = S.rebalance_dates(days).where("kind = 'week_first'").select("date")
    return P.simulate(signals, quotes, rebalances, RULES)


@query(f"""WITH RECURSIVE {PRICES}, {SIGNALS}, {CALENDAR}, {WEIGHTS}, {DAYS},
sums AS (SELECT pos, sum(pnl) AS pnl, sum(abs(weight)) AS gross, sum(weight) AS net, count(*) AS n_positions,
  sum(abs(weight)) FILTER (streak = 1 AND NOT gap) AS filled_1d_weight, count(*) FILTER (streak = 1 AND NOT gap) AS n_filled_1d, sum(abs(weight)) FILTER (streak = 2 AND NOT gap) AS filled_2d_weight,
  count(*) FILTER (streak = 2 AND NOT gap) AS n_filled_2d, sum(abs(weight)) FILTER (recovered) AS recovered_gap_weight, count(*) FILTER (recovered) AS n_recovered_gap,
  sum(abs(weight)) FILTER (gap AND NOT recovered) AS final_gap_weight, count(*) FILTER (gap AND NOT recovered) AS n_final_gap FROM days GROUP BY pos),
was AS (SELECT s.rebalance, e.ticker, e.weight FROM starts s JOIN entered e ON e.rebalance = s.prev),
turned AS (SELECT rebalance, sum(abs(coalesce(a.weight, 0) - coalesce(b.weight, 0))) AS turnover FROM entered a FULL JOIN was b USING (rebalance, ticker) GROUP BY rebalance)
SELECT c.date, reb.date IS NOT NULL AS rebalanced, {", ".join(f"round(coalesce({c}, 0), {R}) + 0.0 AS {c}" for c in ("turnover", "pnl", "gross", "net", "filled_1d_weight", "filled_2d_weight", "recovered_gap_weight", "final_gap_weight"))},
  {", ".join(f"coalesce({c}, 0) AS {c}" for c in ("n_positions", "n_filled_1d", "n_filled_2d", "n_recovered_gap", "n_final_gap"))}
FROM cal c CROSS JOIN fin LEFT JOIN reb ON reb.date = c.date LEFT JOIN turned ON turned.rebalance = c.date LEFT JOIN sums ON sums.pos = c.pos WHERE c.pos < stop""")
def w26_daily_simulation(spark: SparkSession, sf: str) -> DataFrame:
    """From signals to daily profit: weekly cohorts, delayed entries, gaps, exposures, turnover."""
    daily = weekly(spark, sf).daily
    return daily.select(*[r(c) if kind == "double" else c for c, kind in daily.dtypes])


@query(f"""WITH RECURSIVE {PRICES}, {SIGNALS}, {CALENDAR}, {WEIGHTS}, {DAYS},
gone AS (SELECT DISTINCT ticker FROM days WHERE gap AND NOT recovered),
every AS (SELECT f.rebalance, f.ticker, e.weight, f.entry_date, e.entry_price, CASE WHEN f.entry_date IS NOT NULL THEN reb.nxt END AS nxt FROM found f JOIN reb ON reb.date = f.rebalance
  JOIN starts USING (rebalance) LEFT JOIN entered e ON e.rebalance = f.rebalance AND e.ticker = f.ticker),
leave AS (SELECT v.rebalance, v.ticker, min(q.date) AS exit_date FROM every v JOIN cal c ON c.date = v.nxt JOIN cal d ON d.pos BETWEEN c.pos AND c.pos + {RULES.quote_days}
  JOIN quotes q ON q.ticker = v.ticker AND q.date = d.date GROUP BY 1, 2)
SELECT v.rebalance AS planned_entry_date, v.ticker, round(v.weight, {R}) + 0.0 AS weight, v.entry_date AS actual_entry_date, round(v.entry_price, {R}) AS entry_price, v.nxt AS planned_exit_date,
  l.exit_date AS actual_exit_date, round(q.close, {R}) AS exit_price,
  CASE WHEN v.entry_date IS NULL THEN 'skip_no_entry_quote' WHEN l.exit_date IS NOT NULL THEN NULL WHEN gone.ticker IS NOT NULL THEN 'delisting_exit_used' ELSE 'right_censored_no_exit_quote' END AS skip_reason
FROM every v LEFT JOIN leave l ON l.rebalance = v.rebalance AND l.ticker = v.ticker LEFT JOIN quotes q ON q.ticker = v.ticker AND q.date = l.exit_date LEFT JOIN gone ON gone.ticker = v.ticker""")
def w26_simulated_trades(spark: SparkSession, sf: str) -> DataFrame:
    """The trades of the same run: entries that wait for a quote, exits at the next rebalance, reasons for those that have none."""
    trades = weekly(spark, sf).trades
    return trades.select(*[r(c) if kind == "double" else c for c, kind in trades.dtypes])
