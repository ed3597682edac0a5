"""Universes, file sets, lists and resumed work as queries, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import folds as D
from ..operators import universe as U
from ..sources import files, filesets
from ..sources import tables as T
from ..sources.views import PRICES, SIGNALS, prices, signals, table
from ..streaming import scoring
from .market import R, UNIVERSE, universe
from .registry import query

START, END = "1996-01-01", "2001-06-30"
LOG = """ch AS (SELECT 'T-' || ticker AS ticker, date, max(signal_id) % 3 > 0 AS added FROM signals GROUP BY ticker, date),
cur AS (SELECT 'T-' || ticker AS ticker FROM signals GROUP BY ticker HAVING max(signal_id) % 2 = 0)"""


def change_pages(spark: SparkSession, sf: str) -> DataFrame:
    """year, html: a page for each year with a table of changes, two header levels, and a date cell for all rows of a day."""
    log = signals(spark, sf).groupBy("ticker", "date").agg((F.max("signal_id") % 3 > 0).alias("added")).withColumn("ticker", F.concat(F.lit("T."), F.col("ticker")))
    pick = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("ticker"))))
    days = log.groupBy("date").agg(pick(F.col("added")).alias("a"), pick(~F.col("added")).alias("r"))
    rows = F.transform(F.arrays_zip("a", "r"), lambda z: F.concat(*[x for side in ("a", "r") for x in (F.lit("<td>"), F.coalesce(z[side], F.lit("")), F.lit("</td><td>A &amp; Co</td>"))]))
    day = F.concat(F.lit("<tr><td rowspan="), F.size(rows).cast("string"), F.lit(">"), F.date_format("date", "MMMM d, yyyy"), F.lit("</td>"), F.array_join(rows, "</tr>\n<tr>"), F.lit("</tr>"))
    pages = days.groupBy(F.year("date").alias("year")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("date", day.alias("h")))), lambda s: s["h"]), "\n").alias("body"))
    head = "<table><tr><th rowspan=2>Effective date</th><th colspan=2>Added</th><th colspan='2'>Removed</th></tr><tr><th>Ticker</th><th>Security</th><th>Ticker</th><th>Security</th></tr>"
    return pages.select("year", F.concat(F.lit(f"<p>Changes</p>{head}"), "body", F.lit("</table><table><tr><td>no header</td></tr></table>")).alias("html"))


def parsed_changes(spark: SparkSession, sf: str) -> DataFrame:
    return T.change_log(T.html_tables(change_pages(spark, sf), "year").where("table_no = 0"))


@query(f"""WITH {SIGNALS}, {LOG}, n AS (SELECT *, row_number() OVER (PARTITION BY date, added ORDER BY ticker) AS k FROM ch)
SELECT date, max(ticker) FILTER (added) AS added, max(ticker) FILTER (NOT added) AS removed, CAST(k AS INT) AS k FROM n GROUP BY date, k""")
def s14_change_tables(spark: SparkSession, sf: str) -> DataFrame:
    """A change log read from tables in pages: spans, header levels, character references, dots in tickers."""
    rows = parsed_changes(spark, sf)
    return rows.select("date", "added", "removed", F.row_number().over(W.partitionBy("date").orderBy("row_no")).alias("k"))


@query(f"""WITH {SIGNALS}, {LOG}, ev AS (SELECT ticker, date, NOT added AS was FROM ch WHERE date > DATE '{START}'),
pt AS (SELECT ticker, DATE '{START}' AS valid_from FROM (SELECT ticker FROM ev UNION SELECT ticker FROM cur) UNION ALL SELECT ticker, date FROM ev),
st AS (SELECT p.ticker, p.valid_from, coalesce((SELECT min_by(e.was, e.date) FROM ev e WHERE e.ticker = p.ticker AND e.date > p.valid_from), p.ticker IN (SELECT ticker FROM cur)) AS member FROM pt p),
bad AS (SELECT ev.ticker, count(*) AS contradictions FROM ev JOIN st ON st.ticker = ev.ticker AND st.valid_from = ev.date AND st.member = ev.was GROUP BY 1),
ch2 AS (SELECT *, lag(member) OVER (PARTITION BY ticker ORDER BY valid_from) AS was FROM st WHERE valid_from <= DATE '{END}'),
sp AS (SELECT ticker, valid_from, lead(valid_from) OVER (PARTITION BY ticker ORDER BY valid_from) AS valid_to, member FROM ch2 WHERE was IS NULL OR was != member)
SELECT ticker, valid_from, valid_to, coalesce((SELECT contradictions FROM bad WHERE bad.ticker = sp.ticker), 0) AS contradictions FROM sp WHERE member""")
def j20_undone_membership(spark: SparkSession, sf: str) -> DataFrame:
    """Membership from today's list and a log of changes in pages, undone from the latest change back."""
    today = signals(spark, sf).groupBy("ticker").agg(F.max("signal_id").alias("last")).where("last % 2 = 0").select(F.concat(F.lit("T-"), F.col("ticker")).alias("ticker"))
    log = parsed_changes(spark, sf).withColumn("seq", F.col("row_no"))
    return U.undone(today, log, START, END)


DAILY = "daily AS (SELECT DISTINCT date AS snapshot, ticker FROM signals WHERE signal_type = '2-HIGH')"


def daily_universe(spark: SparkSession, sf: str) -> DataFrame:
    return signals(spark, sf).where("signal_type = '2-HIGH'").select(F.col("date").alias("snapshot"), "ticker").distinct()


@query(f"""WITH {SIGNALS}, {UNIVERSE}, {DAILY}, u AS (SELECT 'monthly' AS kind, * FROM universe UNION ALL SELECT 'daily', * FROM daily), d AS (SELECT DISTINCT kind, snapshot FROM u),
g AS (SELECT kind, snapshot - lag(snapshot) OVER (PARTITION BY kind ORDER BY snapshot) AS gap FROM d), t AS (SELECT kind, CASE WHEN median(gap) <= 7 THEN 7 ELSE 65 END AS days FROM g GROUP BY kind),
a AS (SELECT s.signal_id, s.ticker, s.date, d.kind, d.snapshot FROM (SELECT s.*, k.kind FROM signals s, (VALUES ('monthly'), ('daily')) k(kind)) s ASOF JOIN d ON s.kind = d.kind AND s.date >= d.snapshot)
SELECT a.kind, signal_id, CAST(days AS INT) AS days FROM a JOIN t USING (kind) WHERE date - snapshot <= days AND EXISTS (SELECT 1 FROM u WHERE u.kind = a.kind AND u.snapshot = a.snapshot AND u.ticker = a.ticker)""")
def j07_cadence_members(spark: SparkSession, sf: str) -> DataFrame:
    """Members of a monthly and of a daily universe; each one's own cadence says how stale a snapshot may be."""
    parts = [(u, name) for u, name in ((universe(spark, sf), "monthly"), (daily_universe(spark, sf), "daily"))]
    found = [U.members_by_cadence(signals(spark, sf), u, "date").select(F.lit(name).alias("kind"), "signal_id", F.lit(U.tolerance_days(u)).alias("days")) for u, name in parts]
    return found[0].unionByName(found[1])


FIRST, LAST = "1993-01-01", "2001-12-31"


@query(f"""WITH {SIGNALS}, {UNIVERSE}, {DAILY}, u AS (SELECT 'monthly' AS kind, * FROM universe UNION ALL SELECT 'daily', * FROM daily), d AS (SELECT DISTINCT kind, snapshot FROM u), f AS (SELECT kind, min(snapshot) AS f FROM d GROUP BY kind),
m AS (SELECT kind, CAST(last_day(CAST(x AS DATE)) AS DATE) AS month_end FROM (SELECT unnest(generate_series(TIMESTAMP '{FIRST}', TIMESTAMP '{LAST}', INTERVAL 1 MONTH)) AS x), (VALUES ('monthly'), ('daily')) k(kind)),
a AS (SELECT m.kind, month_end, coalesce((SELECT max(snapshot) FROM d WHERE d.kind = m.kind AND d.snapshot <= m.month_end), f) AS snapshot FROM m JOIN f USING (kind)) SELECT DISTINCT month_end, ticker FROM a JOIN u USING (kind, snapshot)""")
def j19_united_month_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Month ends of a monthly and a daily universe together; the months before a first snapshot take it."""
    return U.united([U.filled_month_grid(u, FIRST, LAST) for u in (universe(spark, sf), daily_universe(spark, sf))])


SHARES = "shares AS (SELECT ticker, CAST(last_day(date) AS DATE) AS date, 1000 + sum(volume) AS shares FROM prices WHERE ticker % 7 > 0 GROUP BY 1, 2)"


@query(f"""WITH {PRICES}, {SIGNALS}, {UNIVERSE}, {SHARES}, s AS (SELECT signal_id, ticker, CAST(date - 30 AS DATE) AS date FROM signals), d AS (SELECT DISTINCT date FROM s), sd AS (SELECT DISTINCT snapshot FROM universe),
dd AS (SELECT d.date, sd.snapshot FROM d ASOF JOIN sd ON d.date >= sd.snapshot), mb AS (SELECT date, ticker FROM dd JOIN universe USING (snapshot)), aq AS (SELECT date, ticker FROM mb UNION SELECT date, ticker FROM s),
px AS (SELECT aq.ticker, aq.date, p.close FROM aq ASOF LEFT JOIN prices p ON p.ticker = aq.ticker AND p.date < aq.date), sh AS (SELECT aq.ticker, aq.date, h.shares FROM aq ASOF LEFT JOIN shares h ON h.ticker = aq.ticker AND h.date < aq.date),
cp AS (SELECT ticker, date, close * shares AS capital FROM px JOIN sh USING (ticker, date)), q AS (SELECT date, quantile_cont(capital, [0.9, 0.6, 0.3]) AS q, count(capital) / count(*)::DOUBLE AS coverage FROM mb JOIN cp USING (ticker, date) GROUP BY date HAVING count(capital) > 0)
SELECT signal_id, CASE WHEN capital IS NULL OR q IS NULL THEN 'unknown' WHEN capital >= q[1] THEN 'mega' WHEN capital >= q[2] THEN 'large' WHEN capital >= q[3] THEN 'mid' ELSE 'small' END AS bucket, round(coverage, {R}) AS coverage
FROM s LEFT JOIN cp USING (ticker, date) LEFT JOIN q USING (date)""")
def g16_capital_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Size classes by close times shares of the day before, within the members of the latest snapshot; some tickers have no shares."""
    events = signals(spark, sf).select("signal_id", "ticker", F.date_sub("date", 30).alias("date"))
    p = prices(spark, sf)
    shares = p.where("ticker % 7 > 0").groupBy("ticker", F.last_day("date").alias("date")).agg((1000 + F.sum("volume")).alias("shares"))
    return U.capital_buckets(events, p, shares, universe(spark, sf)).select("signal_id", "bucket", F.round("coverage", R).alias("coverage"))


HORIZON = "1997-12-31"


@query(f"""WITH {SIGNALS}, {UNIVERSE}, d AS (SELECT DISTINCT CAST(date - 40 AS DATE) AS date FROM signals), f AS (SELECT min(snapshot) AS f FROM universe)
SELECT 'future' AS "check", count(*) AS rows, 0::BIGINT AS violations, TRUE AS passed FROM d WHERE date > DATE '{HORIZON}' UNION ALL SELECT 'ancient', count(*), 0, TRUE FROM d, f WHERE date < f
UNION ALL SELECT 'known', count(*), 0, TRUE FROM (SELECT date, max(snapshot) AS snapshot FROM d JOIN universe ON snapshot <= date WHERE date <= DATE '{HORIZON}' GROUP BY date) JOIN universe USING (snapshot)""")
def v03_point_in_time(spark: SparkSession, sf: str) -> DataFrame:
    """What look-ups must refuse or leave empty, on the days of the signals forty days earlier."""
    days = signals(spark, sf).select(F.date_sub("date", 40).alias("date"))
    return U.defence(universe(spark, sf), days, HORIZON)


@query(f"""WITH {PRICES} SELECT ticker, count(*) AS days, round(avg(close), {R}) AS close, min(date) AS first FROM prices WHERE ticker IN (3, 7, 11) AND volume > 10 AND date BETWEEN DATE '1995-01-01' AND DATE '1997-12-31' GROUP BY ticker""")
def s07_file_set(spark: SparkSession, sf: str) -> DataFrame:
    """A folder for each ticker; three of them and one that isn't there, between two dates, with the rules for trading."""
    path = files.shared_path(spark, "tickers")
    gaps = F.when(F.col("volume") > 10, F.col("volume")).otherwise(0)
    filesets.write_tickers(prices(spark, sf).withColumn("volume", gaps), path)
    rows = filesets.read_tickers(spark, path, [3, 7, 11, 99], "trading", "skip", "1995-01-01", "1997-12-31")
    return rows.groupBy("ticker").agg(F.count("*").alias("days"), F.round(F.avg("close"), R).alias("close"), F.min("date").alias("first"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 150000)")
def s08_list_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of a list of orders that is a table."""
    wanted = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT' and o_totalprice > 150000").select(F.col("o_orderkey").alias("l_orderkey"))
    return filesets.list_scan(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), wanted, "l_orderkey")


@query("""SELECT doc_id, length(text)::BIGINT AS score, CASE WHEN doc_id % 7 = 0 THEN 'retry' ELSE 'new' END AS found_in FROM documents WHERE doc_id % 11 != 0""")
def k03_resumed_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of all documents by a stream that resumes: some fail at first and are tried again, some never succeed."""
    out = files.shared_path(spark, "scores")
    docs = table(spark, sf, "documents").select("doc_id", "text")

    def scorer(tried: bool):
        down = (F.col("doc_id") % 11 == 0) | ((F.col("doc_id") % 7 == 0) & F.lit(not tried))
        return lambda rows: rows.select("doc_id", F.when(down, F.col("text")).alias("text"), F.when(~down, F.length("text").cast("long")).alias("score"), F.when(down, F.lit("no answer")).alias("error"), F.lit("retry" if tried else "new").alias("found_in"))

    landed = f"{sf}/documents.parquet"
    if not files.is_folder(spark, landed):  # a stream reads folders
        landed = files.shared_path(spark, "landed")
        docs.write.parquet(landed)
    scoring.score_new_files(spark, landed, "doc_id long, text string", out, scorer(False))
    scoring.retry_failures(spark, out, "doc_id", lambda rows: scorer(True)(rows))
    return scoring.results(spark, out, "doc_id")[0].select("doc_id", "score", "found_in")


@query("""WITH RECURSIVE g AS (SELECT source, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, source NULLS FIRST) AS k FROM documents JOIN labels USING (doc_id) GROUP BY source),
r AS (SELECT 0::BIGINT AS k, [0, 0, 0]::BIGINT[] AS load, NULL::VARCHAR AS source, 0::BIGINT AS size, -1 AS fold
  UNION ALL SELECT g.k, list_transform(range(1, 4), lambda i: load[i] + CASE WHEN i = list_position(load, list_min(load)) THEN g.size ELSE 0 END), g.source, g.size, list_position(load, list_min(load)) - 1 FROM r JOIN g ON g.k = r.k + 1)
SELECT source, size, CAST(fold AS INT) AS fold FROM r WHERE k > 0""")
def l07_balanced_folds(spark: SparkSession, sf: str) -> DataFrame:
    """The folds of the zoo: sources dealt largest first."""
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return D.balanced_folds(rows, "source", 3)
