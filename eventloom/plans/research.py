"""Queries over wide signal features, trade logs, transcripts and model zoos, each with SQL that gives the same rows where it can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import features
from ..operators import features as X
from ..operators import joins as J
from ..operators import models as M
from ..operators import trades as D
from ..operators import transcripts as T
from ..sources import files
from ..sources.views import PRICES, SIGNALS, prices, signals, table
from .evaluation import BASE, panel
from .market import R
from .registry import query

#: The wide table of the row features: signal types are aspects, segments are themes and sectors, the price and the day of the month the rest.
ASPECT_OF = dict(zip(["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], X.ASPECTS, strict=True))
THEME_OF = {"AUTOMOBILE": "ESG", "BUILDING": "CapitalAllocation", "FURNITURE": "Other", "HOUSEHOLD": "OperationalPerformance", "MACHINERY": "StrategicInitiatives"}
SECTOR_OF = {"AUTOMOBILE": "Consumer Discretionary", "BUILDING": "Real Estate", "FURNITURE": "Consumer Staples", "HOUSEHOLD": "Materials", "MACHINERY": "Industrials"}


def _named(column: str, names: dict[str, str]):
    return F.replace(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col(column)], F.lit("\0"), F.lit(""))


def _features_sql() -> str:
    def three(name: str, test: str) -> str:
        n = lambda more: f"CAST(count(*) FILTER (WHERE {test}{more}) AS DOUBLE)"
        return (
            f"{n('')} AS {name}_total, {n(' AND good')} - {n(' AND NOT good')} AS {name}_net_sentiment, "
            f"3 * {n(' AND size = 3')} + 2 * {n(' AND size = 2')} + {n(' AND size = 1')} AS {name}_mag_weighted"
        )

    kind, segment = {a: t for t, a in ASPECT_OF.items()}, {t: s for s, t in THEME_OF.items()}
    sums = [three(f"aspect_{a}", f"signal_type = '{kind[a]}'") for a in X.ASPECTS] + [three(f"theme_{t}", f"sector = '{segment.get(t, '')}'") for t in X.THEMES]
    own = {s: k for k, s in SECTOR_OF.items()}
    hot = [f"CAST(max_by(sector, signal_id) = '{own.get(s, '')}' AS TINYINT) AS sector_{s.replace(' ', '_')}" for s in X.SECTORS]
    scores = [f"CAST(NULL AS DOUBLE) AS {c}" for c in X.EVENT_SCORES[1:]]
    return f"""WITH {SIGNALS}, s AS (SELECT *, last_day(date) AS month, day(date) % 2 = 0 AS good, CASE WHEN score > 200000 THEN 3 WHEN score > 100000 THEN 2 ELSE 1 END AS size FROM signals)
SELECT ticker, month, max(score) AS ATCClassifierScore, CAST(count(*) AS DOUBLE) AS EventsScore_1_1_1, {", ".join(scores)}, {", ".join(sums)}, CAST(count(*) AS DOUBLE) AS DOCSENTENCECOUNT, CAST(NULL AS DOUBLE) AS Sentences, {", ".join(hot)}
FROM s GROUP BY ticker, month"""


@query(_features_sql())
def p02_p03_p04_p05_row_features(spark: SparkSession, sf: str) -> DataFrame:
    """The 60 features of a row of a wide table with a column for each aspect, theme, magnitude and sentiment."""
    size = F.when(F.col("score") > 200000, "High").when(F.col("score") > 100000, "Medium").otherwise("Low")
    sign = F.when(F.day("date") % 2 == 0, "Positive").otherwise("Negative")
    name = F.concat(F.lit("AspectTheme_"), _named("signal_type", ASPECT_OF), F.lit("_"), _named("sector", THEME_OF), F.lit(" - "), size, F.lit(" - "), sign)
    long = signals(spark, sf).select("ticker", F.last_day("date").alias("month"), "signal_id", "score", "sector", name.alias("name"))
    columns = [f"AspectTheme_{a}_{t} - {m} - {s}" for a in X.ASPECTS for t in THEME_OF.values() for m in X.MAGNITUDES for s in ("Positive", "Negative")]
    wide = long.groupBy("ticker", "month").pivot("name", columns).agg(F.count("signal_id"))
    call = long.groupBy("ticker", "month").agg(F.max("score").alias("ATCClassifierScore"), F.count("*").alias("EventsScore_1_1_1"), F.count("*").alias("DOCSENTENCECOUNT"), F.max_by("sector", "signal_id").alias("sector"))
    call = call.withColumn("SECTOR_", _named("sector", SECTOR_OF)).drop("sector").withColumnRenamed("SECTOR_", "SECTOR")
    return X.row_features(wide.join(call, ["ticker", "month"]), ["ticker", "month"])


QUOTES = "quotes AS (SELECT ticker, date, close FROM prices WHERE volume > 60 AND NOT (ticker < 3 AND date >= DATE '1997-06-01'))"
PLANS = "plans AS (SELECT signal_id AS trade_id, ticker, CAST(date + 1 AS DATE) AS pe, CAST(date + 31 AS DATE) AS px FROM signals)"


@query(f"""WITH {PRICES}, {SIGNALS}, {QUOTES}, {PLANS}, l AS (SELECT ticker, max(date) AS last FROM quotes GROUP BY ticker), z AS (SELECT max(last) AS fin FROM l),
e AS (SELECT p.*, CASE WHEN q.date - pe <= 10 THEN q.date END AS ae, CASE WHEN q.date - pe <= 10 THEN q.close END AS ep FROM plans p ASOF LEFT JOIN quotes q ON p.ticker = q.ticker AND p.pe <= q.date),
x AS (SELECT e.*, CASE WHEN q.date - px <= 10 THEN q.date END AS ax, CASE WHEN q.date - px <= 10 THEN q.close END AS xp FROM e ASOF LEFT JOIN quotes q ON e.ticker = q.ticker AND e.px <= q.date)
SELECT trade_id, ticker, pe AS planned_entry_date, ae AS actual_entry_date, round(ep, {R}) AS entry_price, px AS planned_exit_date, CASE WHEN ep IS NOT NULL THEN ax END AS actual_exit_date, round(CASE WHEN ep IS NOT NULL THEN xp END, {R}) AS exit_price,
CASE WHEN ep IS NULL THEN 'skip_no_entry_quote' WHEN xp IS NOT NULL THEN NULL WHEN (last IS NULL OR last < px) AND fin >= px THEN 'delisting_exit_used' ELSE 'right_censored_no_exit_quote' END AS skip_reason FROM x LEFT JOIN l USING (ticker), z""")
def v05_trade_log(spark: SparkSession, sf: str) -> DataFrame:
    """Trades a day after each signal for thirty days, on quotes with gaps; three tickers leave the market."""
    quotes = prices(spark, sf).where("volume > 60 and not (ticker < 3 and date >= '1997-06-01')")
    plans = signals(spark, sf).select(F.col("signal_id").alias("trade_id"), "ticker", F.date_add("date", 1).alias("planned_entry_date"), F.date_add("date", 31).alias("planned_exit_date"))
    log = D.trade_log(plans, quotes, 10)
    return log.withColumns({c: F.round(c, R) for c in ("entry_price", "exit_price")})


@query("""WITH t AS (SELECT l_orderkey AS trade_id, min(l_shipdate)::DATE AS ae, max(l_shipdate)::DATE AS ax, min(l_extendedprice) FILTER (WHERE l_returnflag = 'N') AS ep, max(l_extendedprice) FILTER (WHERE l_linestatus = 'O') AS xp FROM lineitem GROUP BY 1),
g AS (SELECT t.*, CAST(o_orderdate AS DATE) + 30 AS pe, CAST(o_orderdate AS DATE) + 60 AS px, CASE o_orderstatus WHEN 'F' THEN 'skip_no_entry_quote' WHEN 'O' THEN 'right_censored_no_exit_quote' ELSE 'delisting_exit_used' END AS why FROM t JOIN orders ON o_orderkey = trade_id)
SELECT trade_id, 'entry_date_order' AS "check" FROM g WHERE ae < pe UNION ALL SELECT trade_id, 'exit_date_order' FROM g WHERE ax < px UNION ALL SELECT trade_id, 'skip_no_entry_quote_has_price' FROM g WHERE why = 'skip_no_entry_quote' AND ep IS NOT NULL
UNION ALL SELECT trade_id, 'censored_skip_has_exit_price' FROM g WHERE why = 'right_censored_no_exit_quote' AND xp IS NOT NULL UNION ALL SELECT trade_id, 'delisting_exit_has_exit_date' FROM g WHERE why = 'delisting_exit_used' AND ax IS NOT NULL
UNION ALL SELECT trade_id, 'delisting_exit_no_entry_price' FROM g WHERE why = 'delisting_exit_used' AND ep IS NULL""")
def v05_trade_violations(spark: SparkSession, sf: str) -> DataFrame:
    """All six rules on a log that breaks them: what orders planned against what their lines shipped."""
    only = lambda c, flag: F.when(F.col(flag[0]) == flag[1], F.col(c))
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("trade_id")).agg(
        F.min("l_shipdate").cast("date").alias("actual_entry_date"), F.max("l_shipdate").cast("date").alias("actual_exit_date"),
        F.min(only("l_extendedprice", ("l_returnflag", "N"))).alias("entry_price"), F.max(only("l_extendedprice", ("l_linestatus", "O"))).alias("exit_price"),
    )
    status = F.col("o_orderstatus")
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("trade_id"), F.date_add("o_orderdate", 30).alias("planned_entry_date"), F.date_add("o_orderdate", 60).alias("planned_exit_date"),
        F.when(status == "F", D.NO_ENTRY).when(status == "O", D.CENSORED).otherwise(D.DELISTED).alias("skip_reason"),
    )
    return D.trade_violations(lines.join(orders, "trade_id"))


@query("""WITH t AS (SELECT *, lag(role) OVER w AS r0, lag(text) OVER w AS t0 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), b AS (SELECT conv_id, turn, role, trim(text) AS text FROM t WHERE r0 IS NULL OR r0 != role OR t0 != text),
n AS (SELECT *, coalesce(lead(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'assistant', FALSE) AS answered FROM b),
q AS (SELECT *, last_value(CASE WHEN role = 'user' THEN {'body': text, 'answered': answered} END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q FROM n),
u AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM q WHERE role != 'user' OR NOT answered)
SELECT conv_id, CAST(k AS INT) AS "order", CASE role WHEN 'system' THEN 'presenter' ELSE 'qa' END AS kind, CASE role WHEN 'user' THEN 'Analysts' ELSE 'Executives' END AS role, CASE role WHEN 'user' THEN 'Equity Research' WHEN 'system' THEN 'Chair & CEO' ELSE 'Executives' END AS title,
md5(CASE WHEN role = 'user' THEN text WHEN role = 'assistant' AND q.answered THEN q.body END) AS question, md5(CASE WHEN role = 'user' THEN '' ELSE text END) AS text, CAST(length(CASE WHEN role = 'user' THEN '' ELSE text END) AS INT) AS n_chars,
CASE WHEN role = 'user' THEN 'orphan_question' WHEN role = 'assistant' AND NOT coalesce(q.answered, FALSE) THEN 'orphan_answer' END AS warning FROM u""")
def f01_transcript_units(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations written out as transcripts with header and role lines, and cut into units again."""
    head = F.when(F.col("role") == "system", "Presenter Speech\nExecutives - Chair & CEO\n").when(F.col("role") == "user", "Question\nAnalysts - Equity Research\n").otherwise("Answer\nExecutives\n")
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(head, "text").alias("t")))).alias("all"))
    calls = turns.select("conv_id", F.concat(F.lit("Some Company, Q1 2024 Earnings Call, Apr 30, 2024\n\n"), F.array_join(F.transform("all", lambda x: x["t"]), "\n\n")).alias("text"))
    return T.units(calls, "conv_id", "text").drop("unit_id").withColumns({"question": F.md5("question"), "text": F.md5("text")})


FIT_FOLDS = [(f"{y}-01-01", f"{y + 1}-01-01") for y in range(1996, 2002)]


@query(f"""{BASE}, f AS (SELECT CAST(i AS INT) AS fold, make_date(1996 + i, 1, 1) AS start FROM range(0, 6) t(i)), p AS (SELECT month, last_day(CAST(month + 1 AS DATE)) AS fin FROM panel WHERE ret IS NOT NULL)
SELECT fold, start, count(month) AS rows, min(month) AS first, max(month) AS last, max(fin) AS last_end, coalesce(greatest(max(month), max(fin)) < start, TRUE) AS clean FROM f LEFT JOIN p ON month < start AND fin < start GROUP BY fold, start""")
def v02_fit_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The dates that each fold's fit sees."""
    p = panel(spark, sf).withColumn("ends", F.last_day(F.date_add("month", 1)))
    return M.fit_windows(p, FIT_FOLDS, "month", "ends", "ret")


@query(f"""WITH {SIGNALS}, d AS (SELECT ticker, date, max(score) AS score FROM signals GROUP BY 1, 2), l AS (SELECT *, score - lag(score) OVER (PARTITION BY ticker ORDER BY date) AS delta FROM d)
SELECT signal_id, round(delta, {R}) AS delta FROM signals LEFT JOIN l USING (ticker, date)""")
def j04_row_id_join(spark: SparkSession, sf: str) -> DataFrame:
    """A feature that is computed apart comes back to its rows by an explicit row id, one to one."""
    from ..operators import series as S

    s = signals(spark, sf)
    days = s.groupBy("ticker", "date").agg(F.max("score").alias("score"))
    delta = S.lag_delta(days, "ticker", "date", "score")
    name = next(c for c in delta.columns if c not in days.columns)
    apart = s.select("signal_id", "ticker", "date").join(delta.select("ticker", "date", F.col(name).alias("delta")), ["ticker", "date"]).select("signal_id", "delta")
    return J.one_to_one(s.select("signal_id"), apart, ["signal_id"]).select("signal_id", F.round("delta", R).alias("delta"))


FAMILIES = {
    "rules": M.Family("rules", ["h14", "h25", "h26"]),
    "logistic": M.Family("logistic", [f"h{k:02}" for k in range(1, 31)]),
    "boosted": M.Family("boosted", ["h14", "h21", "h24", "h25", "h26"], {"maxIter": 5}),
    "words": M.Family("text", ["text"]),
    "embedding": M.Family("embedding", ["text"], {"rounds": 5}),
}


@query()
def l07_l08_zoo(spark: SparkSession, sf: str) -> DataFrame:
    """Families of classifiers scored out of fold, each at its best threshold with enough recall, the best first."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").where("quality is not null")
    x = d.select("doc_id", "source", "text", F.col("quality").cast("double").alias("y"), *features(F.col("text")))
    # staged, as every fit reads the features and every threshold the scores; an id that occurs twice counts once
    x = files.staged(x.groupBy("doc_id").agg(F.min_by(F.struct(*[c for c in x.columns if c != "doc_id"]), F.struct("text", "source", "y")).alias("r")).select("doc_id", "r.*"), "zoo-features")
    scored = files.staged(M.zoo(x, FAMILIES, "doc_id", "y", "source", 3, balanced=True), "zoo-scores")
    report = M.zoo_report(scored, "y", 0.96)
    board = report.withColumns({"ensemble": F.col("model") == "ensemble", "eligible": F.lit(True)})
    return M.leaderboard(board, 0.96).select("model", "threshold", "tp", "fp", "fn", "tn", "precision", "recall", "macro_f1")
