"""Signal evaluation: information coefficients, buckets, portfolios, thresholds, resampling and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranks import newey_west, pooled_rank_correlation, rank_correlation, with_rank


def latest_per_ticker(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """One row for each group and ticker: the last by order."""
    keys = [*by, "ticker"]
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return last.select(*keys, "_r.*")


def cross_sectional_ic(df: DataFrame, features: list[str], targets: list[str], by: list[str], least: int) -> DataFrame:
    """by, feature, target, n, ic for all pairs in one job: features and targets are unpivoted, not looped over."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(t).alias("target"), F.col(f).cast("double").alias("x"), F.col(t).cast("double").alias("y")) for f in features for t in targets]))
    long = df.select(*by, pairs.alias("p")).select(*by, "p.*")
    return rank_correlation(long, "x", "y", [*by, "feature", "target"], least)


def ic_summary(ic: DataFrame, by: list[str], order: str, lag: int) -> DataFrame:
    """by, n, mean, sd, t, nw_t, hit_rate of a series of coefficients; a series is as long as there are periods."""
    series = F.transform(F.array_sort(F.collect_list(F.struct(order, "ic"))), lambda x: x["ic"])
    got = ic.where("ic is not null").groupBy(*by).agg(F.count("*").alias("n"), F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("sd"), F.avg((F.col("ic") > 0).cast("int")).alias("hit_rate"), series.alias("_s"))
    t = F.when(F.col("sd") > 0, F.col("mean") / (F.col("sd") / F.sqrt("n")))
    return got.select(*by, "n", "mean", "sd", t.alias("t"), newey_west(F.col("_s"), lag).alias("nw_t"), "hit_rate")


def window_correlations(df: DataFrame, values: dict[int, str], targets: dict[int, str], by: str, base: int, least: int) -> DataFrame:
    """by, window, horizon, n, ic, flips: pooled rank correlation of each window's value with each horizon's target; flips: another sign than the base window's.

    All pairs are one job; signs are exact (see rank_correlation). Groups under `least` pairs are left out.
    """
    same = [by, *{*values.values(), *targets.values()}]
    counted = df.groupBy(*same).agg(F.count(F.lit(1)).alias("_rows"))  # before the pairs are made: rows of one ticker and day are alike
    pair = F.explode(F.array(*[F.struct(F.lit(w).alias("window"), F.lit(h).alias("horizon"), F.col(v).alias("x"), F.col(t).alias("y")) for w, v in values.items() for h, t in targets.items()])).alias("p")
    ic = pooled_rank_correlation(counted.select(by, "_rows", pair).select(by, "_rows", "p.*"), "x", "y", [by, "window", "horizon"], least, F.col("_rows"))
    sign = F.signum("ic")
    reference = F.max(F.when(F.col("window") == base, sign)).over(W.partitionBy(by, "horizon"))
    return ic.withColumn("flips", F.coalesce(sign != reference, F.lit(False)))


def quantile_buckets(df: DataFrame, value: str, by: list[str], buckets: int, least: int) -> DataFrame:
    """df with bucket 0 .. n - 1 by the group's quantile edges (right-closed, equal edges merged); small groups are left out."""
    cuts = [k / buckets for k in range(buckets + 1)]
    edges = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("_n"), F.percentile(value, F.array(*[F.lit(c) for c in cuts])).alias("_e"))
    edges = edges.where(F.col("_n") >= buckets * least).withColumn("_e", F.array_distinct("_e")).where("size(_e) > 1")
    inner = F.slice("_e", F.lit(2), F.size("_e") - 2)
    out = df.where(F.col(value).isNotNull()).join(edges, by)
    return out.withColumn("bucket", F.size(F.filter(inner, lambda e: e < F.col(value)))).drop("_n", "_e")


def bucket_returns(df: DataFrame, value: str, ret: str, by: list[str], buckets: int, least: int) -> DataFrame:
    pairs = df.where(F.col(value).isNotNull() & F.col(ret).isNotNull())
    return quantile_buckets(pairs, value, by, buckets, least).groupBy(*by, "bucket").agg(F.avg(ret).alias("ret"), F.count("*").alias("n"))


def long_short(bucketed: DataFrame, by: str, top: int) -> DataFrame:
    """by, long_only, short_only, long_short: returns of the top and (negated) bottom bucket side by side."""
    wide = bucketed.groupBy(by).pivot("bucket", [0, top]).agg(F.first("ret"))
    return wide.select(by, F.col(str(top)).alias("long_only"), (-F.col("0")).alias("short_only"), (F.col(str(top)) - F.col("0")).alias("long_short"))


def sector_neutral(df: DataFrame, value: str, ret: str, by: str, buckets: int, least: int) -> DataFrame:
    inside = bucket_returns(df, value, ret, [by, "sector"], buckets, least)
    return inside.groupBy(by, "bucket").agg(F.avg("ret").alias("ret"), F.sum("n").alias("n"))


def score_weighted(df: DataFrame, value: str, ret: str, by: list[str], buckets: int, least: int) -> DataFrame:
    """Bucket returns weighted by |value|; equal weights where a bucket's weights are all zero."""
    b = quantile_buckets(df.where(F.col(value).isNotNull() & F.col(ret).isNotNull()), value, by, buckets, least)
    w = F.abs(value)
    return b.groupBy(*by, "bucket").agg(F.coalesce(F.sum(w * F.col(ret)) / F.nullif(F.sum(w), F.lit(0.0)), F.avg(ret)).alias("ret"), F.count("*").alias("n"))


def top_minus_bottom(df: DataFrame, value: str, ret: str, by: str, key: str, n: int) -> DataFrame:
    """by, spread: mean of the n highest minus that of the n lowest; groups under 2n are left out."""
    rows = df.where(F.col(value).isNotNull() & F.col(ret).isNotNull())
    ranked = rows.withColumns({
        "_up": F.row_number().over(W.partitionBy(by).orderBy(F.desc(value), key)), "_down": F.row_number().over(W.partitionBy(by).orderBy(value, key)),
        "_n": F.count("*").over(W.partitionBy(by)),
    }).where(F.col("_n") >= 2 * n)
    return ranked.groupBy(by).agg((F.avg(F.when(F.col("_up") <= n, F.col(ret))) - F.avg(F.when(F.col("_down") <= n, F.col(ret)))).alias("spread"))


def cohort_weights(df: DataFrame, by: str, value: str, key: str, share: float, least: int, floor: int) -> DataFrame:
    """by, ticker, weight: long the top and short the bottom share of the strongest row of each ticker, net, gross 2."""
    rows = df.where(F.col(value).isNotNull())
    best = rows.groupBy(by, "ticker").agg(F.max_by(value, F.struct(F.abs(value), -F.col(key))).alias("v"))
    n = F.count("*").over(W.partitionBy(by))
    ranked = best.withColumn("_n", n).where(F.col("_n") >= least).withColumns({
        "_k": F.greatest(F.lit(floor), F.ceil(F.col("_n") * share)),
        "_up": F.row_number().over(W.partitionBy(by).orderBy(F.desc("v"), "ticker")), "_down": F.row_number().over(W.partitionBy(by).orderBy("v", "ticker")),
    })
    w = F.when(F.col("_up") <= F.col("_k"), 1 / F.col("_k")).otherwise(0.0) - F.when(F.col("_down") <= F.col("_k"), 1 / F.col("_k")).otherwise(0.0)
    net = ranked.withColumn("w", w).where("w != 0").withColumn("w", F.col("w") - F.avg("w").over(W.partitionBy(by)))
    return net.select(by, "ticker", (2 * F.col("w") / F.sum(F.abs("w")).over(W.partitionBy(by))).alias("weight"))


def turnover(weights: DataFrame, by: str, order: DataFrame) -> DataFrame:
    """by, turnover: sum of |weight - weight at the rebalance before|; order lists the rebalances (by, prev)."""
    now = weights.select(by, "ticker", F.col("weight").alias("now"))
    was = weights.join(order.select(F.col(by).alias("_next"), F.col("prev").alias(by)), by).select(F.col("_next").alias(by), "ticker", F.col("weight").alias("was"))
    both = now.join(was, [by, "ticker"], "full")
    return both.groupBy(by).agg(F.sum(F.abs(F.coalesce("now", F.lit(0.0)) - F.coalesce("was", F.lit(0.0)))).alias("turnover"))


def best_threshold(df: DataFrame, label: str, p: str, steps: int, recall: float) -> DataFrame:
    """threshold, f1: the threshold on a grid with the best macro-F1 among those that reach the recall; the lowest on ties.

    Rows are counted once for each cell of the grid; running sums over its steps + 1 cells give all confusion tables.
    """
    cell = F.floor(F.col(p) * steps + 1e-9).cast("int")  # a row counts as positive at every threshold up to its cell
    hist = df.groupBy(cell.alias("cell")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))
    grid = df.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("cell"))
    up = W.orderBy(F.desc("cell")).rowsBetween(W.unboundedPreceding, 0)
    every = W.partitionBy(F.lit(0))
    t = grid.join(hist, "cell", "left").withColumns({"tp": F.sum(F.coalesce("pos", F.lit(0))).over(up), "fp": F.sum(F.coalesce("neg", F.lit(0))).over(up), "P": F.sum(F.coalesce("pos", F.lit(0))).over(every), "N": F.sum(F.coalesce("neg", F.lit(0))).over(every)})
    f1 = lambda tp, fp, fn: F.coalesce(2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0)), F.lit(0.0))
    pos = f1(F.col("tp"), F.col("fp"), F.col("P") - F.col("tp"))
    neg = f1(F.col("N") - F.col("fp"), F.col("P") - F.col("tp"), F.col("fp"))
    ok = t.withColumns({"f1": (pos + neg) / 2, "threshold": F.col("cell") / F.lit(float(steps))}).where(F.col("tp") >= recall * F.col("P"))
    return ok.agg(F.max_by("threshold", F.struct("f1", -F.col("threshold"))).alias("threshold"), F.max("f1").alias("f1"))


def classification_report(df: DataFrame, label: str, pred: str, by: list[str]) -> DataFrame:
    """Counts, accuracy, precision, recall and F1 of each class, macro-F1; 0 where a denominator is 0."""
    n = lambda a, b: F.sum(((F.col(label) == a) & (F.col(pred) == b)).cast("long"))
    c = df.groupBy(*by).agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    f1, f0 = ratio(2 * tp, 2 * tp + fp + fn), ratio(2 * tn, 2 * tn + fp + fn)
    return c.select(*by, "tp", "fp", "fn", "tn", ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), f1.alias("f1"), ((f1 + f0) / 2).alias("macro_f1"))


def rank_ensemble(df: DataFrame, models: list[str]) -> DataFrame:
    """df with `score`: the mean over the models of ranks scaled to 0 .. 1, all rows being one group; null for a single row."""
    names, out = df.columns, df.withColumn("_all", F.lit(0))
    for m in models:
        out = with_rank(out, m, ["_all"]).withColumn(f"_share_{m}", (F.col("rank") - 1) / F.nullif(F.col("size") - 1, F.lit(0))).drop("rank", "size")
    return out.select(*names, (sum((F.col(f"_share_{m}") for m in models), F.lit(0.0)) / len(models)).alias("score"))


def block_bootstrap(values: DataFrame, order: str, value: str, block: int, draws: int, seed: int) -> DataFrame:
    """draw, mean, sd of resampled series made of contiguous blocks; a series is one row for each period, so it's sent to every draw."""
    series = values.agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("s"))
    n = F.size("s")
    start = lambda d, k: F.pmod(F.xxhash64(d, k, F.lit(seed)), F.greatest(n - block + 1, F.lit(1)))
    drawn = values.sparkSession.range(draws).withColumnRenamed("id", "draw").join(F.broadcast(series))
    blocks = F.flatten(F.transform(F.sequence(F.lit(1), F.ceil(n / block).cast("int")), lambda k: F.slice("s", (start(F.col("draw"), k) + 1).cast("int"), F.lit(block))))
    return drawn.select("draw", F.explode(F.slice(blocks, F.lit(1), n)).alias("v")).groupBy("draw").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))


def purged_folds(folds: DataFrame, rows: DataFrame, key: str, at: str, target_end: str) -> DataFrame:
    """fold, key, part: train rows known before the fold's start whose label ends before it too, and the fold's test rows.

    folds: fold, start, stop (one row for each quarter).
    """
    joined = rows.join(F.broadcast(folds), F.col(at) < F.col("stop"))
    train = (F.col(at) < F.col("start")) & (F.col(target_end).isNull() | (F.col(target_end) < F.col("start")))
    return joined.select("fold", key, F.when(F.col(at) >= F.col("start"), "test").when(train, "train").otherwise("purged").alias("part"))
