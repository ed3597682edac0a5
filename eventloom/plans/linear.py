"""Linear models of many windows from one pass, with SQL that gives the same rows where it can."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import boosting as B
from ..operators import gram as G
from ..sources import views as V
from ..sources.files import staged
from ..sources.views import PRICES, SIGNALS
from .evaluation import IC
from .market import R
from .registry import query

PENALTIES = [0.01, 0.1, 1.0, 10.0, 100.0, 1000.0]
FOLDS = [(dt.date(y, 1, 1), dt.date(y + 1, 1, 1)) for y in range(1997, 2001)]
LABELS = {"ret_1": "end_1", "ret_2": "end_2"}
#: score has every value, momentum lacks a ticker's first month.
COLUMNS = ["score", "momentum"]
LEAST = 10

SAMPLE = f"""{PRICES}, {SIGNALS}, bars AS (SELECT ticker, last_day(date) AS month, max_by(close, date) AS close FROM prices GROUP BY 1, 2),
b AS (SELECT ticker, month, close / lag(close) OVER w - 1 AS momentum, lead(close) OVER w / close - 1 AS ret_1, lead(month) OVER w AS end_1, lead(close, 2) OVER w / close - 1 AS ret_2, lead(month, 2) OVER w AS end_2
  FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY month)),
l AS (SELECT last_day(date) AS month, ticker, max_by(score, (date, signal_id)) AS score FROM signals GROUP BY 1, 2),
x AS (SELECT ticker, month, score AS x0, momentum AS x1, label, y, u FROM l JOIN b USING (ticker, month), LATERAL (VALUES ('ret_1', ret_1, end_1), ('ret_2', ret_2, end_2)) v(label, y, u)),
f AS (SELECT * FROM (VALUES {", ".join(f"(DATE '{a}', DATE '{b}')" for a, b in FOLDS)}) f(start, stop)),
tr AS (SELECT start, stop, x.* FROM x JOIN f ON y IS NOT NULL AND month < start AND u < start),
md AS (SELECT label, start, list_sort(list(x0) FILTER (x0 IS NOT NULL))[(count(x0) + 1) // 2] AS m0, list_sort(list(x1) FILTER (x1 IS NOT NULL))[(count(x1) + 1) // 2] AS m1 FROM tr GROUP BY 1, 2),
fl AS (SELECT tr.*, m0, m1, coalesce(x0, m0) AS z0, coalesce(x1, m1) AS z1 FROM tr JOIN md USING (label, start)),
st AS (SELECT label, start, stop, m0, m1, count(*) AS n, avg(z0) AS a0, avg(z1) AS a1, avg(y) AS ay, stddev_pop(z0) AS s0, stddev_pop(z1) AS s1, covar_pop(z0, z1) AS c01, covar_pop(z0, y) AS c0, covar_pop(z1, y) AS c1
  FROM fl GROUP BY 1, 2, 3, 4, 5 HAVING count(*) >= {LEAST}),
eq AS (SELECT *, n * c01 / (s0 * s1) AS r, n * c0 / s0 AS b0, n * c1 / s1 AS b1 FROM st),
md2 AS (SELECT eq.*, penalty, (b0 * (n + penalty) - r * b1) / ((n + penalty) ** 2 - r ** 2) / s0 AS w0, (b1 * (n + penalty) - r * b0) / ((n + penalty) ** 2 - r ** 2) / s1 AS w1
  FROM eq, (VALUES {", ".join(f"({p}::DOUBLE)" for p in PENALTIES)}) p(penalty)),
sc AS (SELECT x.ticker, x.month, x.label, x.y, m.start, m.penalty, m.n, m.ay + w0 * (coalesce(x0, m0) - a0) + w1 * (coalesce(x1, m1) - a1) AS p FROM x JOIN md2 m ON x.label = m.label AND x.month >= m.start AND x.month < m.stop),
rk AS (SELECT label, penalty, start, rank() OVER (PARTITION BY label, penalty, start ORDER BY p) + (count(*) OVER (PARTITION BY label, penalty, start, p) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY label, penalty, start ORDER BY y) + (count(*) OVER (PARTITION BY label, penalty, start, y) - 1) / 2.0 AS b FROM sc WHERE y IS NOT NULL),
ic AS (SELECT label, penalty, start, {IC} AS ic FROM rk GROUP BY 1, 2, 3 HAVING count(*) >= 2),
mean AS (SELECT label, penalty, count(ic) AS folds, avg(ic) AS ic FROM ic GROUP BY 1, 2),
found AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(ic, 12) DESC NULLS LAST, penalty) = 1 AS best FROM mean)"""


def sample(spark: SparkSession, sf: str) -> DataFrame:
    """ticker, month, the latest score of the month, momentum, the returns over one and two bars and the months they end in."""
    by = W.partitionBy("ticker").orderBy("month")
    bars = V.prices(spark, sf).groupBy("ticker", F.last_day("date").alias("month")).agg(F.max_by("close", "date").alias("close"))
    ahead = [x for k in (1, 2) for x in ((F.lead("close", k).over(by) / F.col("close") - 1).alias(f"ret_{k}"), F.lead("month", k).over(by).alias(f"end_{k}"))]
    bars = bars.select("ticker", "month", (F.col("close") / F.lag("close").over(by) - 1).alias("momentum"), *ahead)
    latest = V.signals(spark, sf).groupBy(F.last_day("date").alias("month"), "ticker").agg(F.max_by("score", F.struct("date", "signal_id")).alias("score"))
    return staged(latest.join(bars, ["ticker", "month"]), "sample")


def scores(x: DataFrame, held: G.Grams, penalties: list[float]) -> DataFrame:
    models = G.ridge_models(x, held, FOLDS, list(LABELS), penalties, LEAST)
    return G.scored(x, models, COLUMNS, list(LABELS), "month", held.cuts, ["ticker", "month"])


def blocks(x: DataFrame, columns: list[str]) -> G.Grams:
    return G.grams(x, columns, LABELS, "month", [d for fold in FOLDS for d in fold])


@query(f"WITH {SAMPLE} SELECT label, penalty, folds, round(ic, {R}) AS ic, best FROM found")
def l04_purged_search(spark: SparkSession, sf: str) -> DataFrame:
    """Mean rank correlation of six ridge penalties over purged yearly folds, for two horizons; the sums are read once."""
    x = sample(spark, sf)
    found = G.search(scores(x, blocks(x, COLUMNS), PENALTIES))
    return found.select("label", "penalty", "folds", F.round("ic", R).alias("ic"), "best")


@query(f"WITH {SAMPLE} SELECT sc.label, sc.start AS fold, ticker, month, sc.penalty, sc.n AS n_train, round(y, {R}) + 0.0 AS y, round(p, {R}) + 0.0 AS p FROM sc JOIN found USING (label, penalty) WHERE best")
def l06_gram_walk_forward(spark: SparkSession, sf: str) -> DataFrame:
    """Every test row under the model of its fold with the penalty that the search finds."""
    x = sample(spark, sf)
    every = staged(scores(x, blocks(x, COLUMNS), PENALTIES), "scores")
    best = G.search(every).where("best").select("label", "penalty")
    starts = F.create_map(*[v for k, d in enumerate(sorted({d for fold in FOLDS for d in fold})) for v in (F.lit(k), F.lit(d))])
    rounded = [(F.round(c, R) + F.lit(0.0)).alias(c) for c in ("y", "p")]
    return every.join(F.broadcast(best), ["label", "penalty"]).select("label", starts[F.col("cut")].alias("fold"), "ticker", "month", "penalty", "n_train", *rounded)


@query()
def l05_lasso_selection(spark: SparkSession, sf: str) -> DataFrame:
    """The columns that a Lasso keeps within each fold's training window, among real ones and ones without meaning, and the model on them."""
    noise = {f"noise_{k}": F.pmod(F.xxhash64("ticker", "month", F.lit(k)), F.lit(1000)).cast("double") for k in range(8)}
    x = sample(spark, sf).withColumns(noise | {"reversal": -F.col("momentum") + F.col("noise_0") / 1e5, "size": F.log("score")})
    columns = [*COLUMNS, "reversal", "size", *noise]
    quarters = {dt.date(y, m, 1) for y in range(1995, 2001) for m in (1, 4, 7, 10)}
    held = G.grams(x, columns, LABELS, "month", sorted({d for fold in FOLDS for d in fold} | quarters))
    models = G.ridge_models(x, held, FOLDS, list(LABELS), [1.0], LEAST, inner=3, most=5)
    each = models.select("label", F.array(*[F.lit(d) for d in held.cuts])[F.col("cut")].alias("fold"), "n_train", F.posexplode("slope").alias("k", "slope"))
    return each.select("label", "fold", "n_train", F.array(*[F.lit(c) for c in columns])[F.col("k")].alias("column"), F.round("slope", R).alias("slope")).where("slope != 0")


@query()
def l02_boosted_trees(spark: SparkSession, sf: str) -> DataFrame:
    """Test rows of a year under trees grown leaf by leaf on the rows whose labels are known before it."""
    start, stop = FOLDS[1]
    x = sample(spark, sf)
    train = x.where((F.col("month") < F.lit(start)) & (F.col("end_1") < F.lit(start)))
    model = B.train(train, COLUMNS, "ret_1", B.Settings(trees=5))
    return B.predict(x.where((F.col("month") >= F.lit(start)) & (F.col("month") < F.lit(stop))), model).select("ticker", "month", "ret_1", F.round("p", R).alias("p"))
