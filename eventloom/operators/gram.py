"""Linear models of many windows, labels and penalties from one pass over the rows.

Time is cut at a few dates. A row lies in the block of its date and becomes usable for training in the block in which its label is known. For each label and
pair of blocks one pass sums the products of all columns; every purged, expanding training window and every validation window is a sum of such blocks,
whatever the number of folds, penalties and labels. A missing value is a zero and a mark of its own in these sums, so windows can be filled with their
own medians afterwards (mergeable sketches give those in another pass). Solving is a small task for each label and fold.

The sums hold (2 * columns + 2) ** 2 numbers for each label and pair of blocks; MOST_NUMBERS is the limit at which they are broadcast.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranks import rank_correlation
from ..sources.files import staged

MOST_NUMBERS = 1 << 24
#: Items of a quantile sketch: medians of windows with fewer values are exact (the lower of two in the middle).
SKETCH = 4096
#: Penalties of a path, the smallest as a part of the largest; change of a coefficient at which descent ends.
PENALTIES, SMALLEST, TOLERANCE, SWEEPS = 100, 1e-3, 1e-12, 5000
EPOCH = dt.date(1970, 1, 1)


@dataclass(frozen=True)
class Stats:
    """Centred sums of a window: rows, means, sums of products of the columns with each other and with the label."""

    n: float
    mean: np.ndarray
    mean_y: float
    xx: np.ndarray
    xy: np.ndarray
    yy: float

    def scale(self) -> np.ndarray:
        """Deviations of the columns; 1 where a column is constant but for rounding."""
        sd = np.sqrt(np.maximum(np.diag(self.xx), 0) / max(self.n, 1))
        return np.where(sd > 1e-9 * np.maximum(np.abs(self.mean), 1e-300), sd, 1.0)


@dataclass(frozen=True)
class Grams:
    """Sums of products by (label, block of the date, block in which the label is known); values are less their pivots."""

    columns: list[str]
    cuts: list[dt.date]
    pivots: np.ndarray
    cells: dict[tuple[str, int, int], np.ndarray]
    medians: dict[tuple[str, int], np.ndarray]

    def train(self, label: str, cut: int) -> np.ndarray:
        """Rows whose date and label end lie before cuts[cut]."""
        return self._sum(label, lambda a, u: u <= cut)

    def between(self, label: str, first: int, last: int | None = None, known: int | None = None) -> np.ndarray:
        """Rows dated from cuts[first] on and before cuts[last]; known: and known before cuts[known]."""
        return self._sum(label, lambda a, u: a > first and (last is None or a <= last) and (known is None or u <= known))

    def _sum(self, label, keep) -> np.ndarray:
        k = 2 * len(self.columns) + 2
        return sum((g for (name, a, u), g in self.cells.items() if name == label and keep(a, u)), np.zeros((k, k)))

    def stats(self, gram: np.ndarray, fills: np.ndarray) -> Stats:
        """The window's sums with missing values filled; means are in the columns' own units."""
        p = len(self.columns)
        to = np.zeros((p + 2, 2 * p + 2))
        to[0, 0] = to[-1, -1] = 1
        to[1:-1, 1 : p + 1] = np.eye(p)
        to[1:-1, p + 1 : -1] = np.diag(fills - self.pivots)
        full = to @ gram @ to.T
        n = full[0, 0]
        mean = full[0] / n if n else np.zeros(p + 2)
        centred = full - n * np.outer(mean, mean)
        return Stats(n, mean[1:-1] + self.pivots, mean[-1], centred[1:-1, 1:-1], centred[1:-1, -1], centred[-1, -1])


def _columns(labels: dict[str, str], columns: list[str], at: str) -> list:
    """The columns that the passes read: days, label values and label ends, features as doubles."""
    days = lambda c: F.datediff(F.col(c), F.lit(EPOCH))
    real = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    ends = [F.greatest(days(at), F.coalesce(days(end), days(at))).alias(f"_u{k}") for k, end in enumerate(labels.values())]
    return [days(at).alias("_at"), *[real(y).alias(f"_y{k}") for k, y in enumerate(labels)], *ends, *[real(c).alias(f"_x{k}") for k, c in enumerate(columns)]]


def _products(batches: Iterator[pd.DataFrame], p: int, labels: int, cuts: np.ndarray, pivots: np.ndarray) -> Iterator[pd.DataFrame]:
    sums: dict[tuple[int, int, int], np.ndarray] = {}
    for batch in batches:
        x = batch[[f"_x{k}" for k in range(p)]].to_numpy(float) - pivots
        missing = np.isnan(x)
        ones = np.ones((len(x), 1))
        a = np.searchsorted(cuts, batch["_at"].to_numpy(float), side="right")
        for label in range(labels):
            y = batch[f"_y{label}"].to_numpy(float)
            u = np.searchsorted(cuts, batch[f"_u{label}"].to_numpy(float), side="right")
            real = ~np.isnan(y)
            z = np.hstack([ones, np.where(missing, 0.0, x), missing, y[:, None]])[real]
            cell = a[real] * (len(cuts) + 1) + u[real]
            for c in np.unique(cell):
                part = z[cell == c]
                key = (label, *divmod(int(c), len(cuts) + 1))
                sums[key] = sums.get(key, 0.0) + part.T @ part
    for (label, a, u), gram in sums.items():
        yield pd.DataFrame({"label": [label], "a": [a], "u": [u], "sums": [gram.ravel()]})


def block(at: Column, cuts: list) -> Column:
    """How many of the cuts lie on or before a day."""
    return reduce(add, [(at >= F.lit(c)).cast("int") for c in cuts])


def medians(rows: DataFrame, labels: int, p: int, cuts: np.ndarray) -> DataFrame:
    """label, cut, fills: medians of the columns over the rows that a label's training window before each cut sees."""
    days = [int(c) for c in cuts]
    known = F.explode(F.array(*[F.struct(F.lit(k).alias("label"), F.when(F.col(f"_y{k}").isNotNull(), block(F.col(f"_u{k}"), days)).alias("u")) for k in range(labels)]))
    each = rows.select(known.alias("at"), *[f"_x{k}" for k in range(p)]).where(f"at.u < {len(cuts)}")
    sketches = each.groupBy("at.label", "at.u").agg(*[F.kll_sketch_agg_double(f"_x{k}", SKETCH).alias(f"s{k}") for k in range(p)])
    spread = sketches.withColumn("cut", F.explode(F.sequence("u", F.lit(len(cuts) - 1))))
    some = lambda k: F.kll_sketch_get_n_double(f"s{k}")
    middle = lambda k: F.when(F.sum(some(k)) > 0, F.kll_sketch_get_quantile_double(F.kll_merge_agg_double(F.when(some(k) > 0, F.col(f"s{k}"))), F.lit(0.5)))
    return spread.groupBy("label", "cut").agg(F.array(*[middle(k) for k in range(p)]).alias("fills"))


def grams(df: DataFrame, columns: list[str], labels: dict[str, str], at: str, cuts: list[dt.date]) -> Grams:
    """labels: label column -> column of the date from which it is known (null: the row's own). Rows without a date or label don't count."""
    spark, p = df.sparkSession, len(columns)
    names, cuts = list(labels), sorted(set(cuts))
    days = np.array([(c - EPOCH).days for c in cuts], float)
    rows = staged(df.select(*_columns(labels, columns, at)).where("_at is not null"), "rows")
    # sums of large values lose digits: all are taken less a number in their midst
    middle = np.array([v or 0.0 for v in rows.agg(*[F.avg(f"_x{k}") for k in range(p)]).first()])
    found = rows.mapInPandas(lambda b: _products(b, p, len(names), days, middle), "label int, a int, u int, sums array<double>")
    found = staged(found, "products")
    cells = found.select("label", "a", "u").distinct().count()
    if cells * (2 * p + 2) ** 2 > MOST_NUMBERS:
        raise ValueError(f"{cells} blocks of {p} columns are too many to hold")
    total = found.select("label", "a", "u", F.posexplode("sums").alias("i", "v")).groupBy("label", "a", "u", "i").agg(F.sum("v").alias("v")).toPandas()
    held = {}
    for (label, a, u), part in total.groupby(["label", "a", "u"]):
        gram = np.zeros((2 * p + 2) ** 2)
        gram[part["i"].to_numpy()] = part["v"].to_numpy()
        held[names[label], a, u] = gram.reshape(2 * p + 2, -1)
    fills = {(names[r.label], r.cut): np.array([middle[k] if v is None else v for k, v in enumerate(r.fills)]) for r in medians(rows, len(names), p, days).collect()}
    return Grams(columns, cuts, middle, held, fills)


# ---- solving a window ----


def ridge(stats: Stats, penalties: list[float]) -> list[np.ndarray]:
    """Coefficients of the standardised columns for each penalty; the intercept is free."""
    scale = stats.scale()
    value, vector = np.linalg.eigh(stats.xx / np.outer(scale, scale))
    turned = vector.T @ (stats.xy / scale)
    return [vector @ (turned / (np.maximum(value, 0) + a)) for a in penalties]


def penalty_path(stats: Stats, scale: np.ndarray) -> np.ndarray:
    most = np.abs(stats.xy / scale).max(initial=0) / max(stats.n, 1)
    return most * np.logspace(0, np.log10(SMALLEST), PENALTIES)


def lasso(stats: Stats, scale: np.ndarray, penalties: np.ndarray) -> np.ndarray:
    """Coefficients of the scaled columns, a row for each penalty, by coordinate descent on the sums from the penalty before."""
    c, b = stats.xx / np.outer(scale, scale) / stats.n, stats.xy / scale / stats.n
    diagonal = np.diag(c).copy()
    w, rest, out = np.zeros(len(b)), b.copy(), []
    live = np.flatnonzero(diagonal > 1e-12)
    for penalty in penalties:
        for _ in range(SWEEPS):
            largest = 0.0
            for j in live:
                pull = rest[j] + diagonal[j] * w[j]
                new = np.sign(pull) * max(abs(pull) - penalty, 0.0) / diagonal[j]
                step = new - w[j]
                if step:
                    rest -= c[j] * step
                    w[j] = new
                    largest = max(largest, abs(step))
            if largest <= TOLERANCE * max(np.abs(w).max(initial=0), 1e-300):
                break
        out.append(w.copy())
    return np.array(out)


def squared_error(train: Stats, validation: Stats, scale: np.ndarray, w: np.ndarray) -> float:
    """Mean squared error on a window of a model (scaled coefficients) whose intercept is that of the training window."""
    slope = w / scale
    shift = validation.mean_y - train.mean_y - slope @ (validation.mean - train.mean)
    return shift**2 + (validation.yy - 2 * slope @ validation.xy + slope @ validation.xx @ slope) / validation.n


def inner_cuts(held: Grams, label: str, cut: int, parts: int) -> list[int]:
    """The cuts next after each (parts + 1)-th of a training window's rows, in order of their dates; a block is not split."""
    n = np.zeros(len(held.cuts) + 1)
    for (name, a, u), gram in held.cells.items():
        if name == label and u <= cut:
            n[a] += gram[0, 0]
    upto = np.cumsum(n)
    found = [int(np.searchsorted(upto, upto[-1] * (k + 1) / (parts + 1) - 1e-9)) for k in range(parts)]
    return sorted({c for c in found if 0 <= c < cut})


def select_by_lasso(held: Grams, label: str, cut: int, parts: int = 3, most: int = 200) -> tuple[float, np.ndarray, list[int]]:
    """(penalty, scaled coefficients, kept columns): the penalty with the least mean error over purged inner windows of the training window.

    Fills and scale are those of the whole training window. Of more than `most` columns the largest stay, of none the first `most`.
    """
    fills = held.medians[label, cut]
    whole = held.stats(held.train(label, cut), fills)
    scale = whole.scale()
    path = penalty_path(whole, scale)
    ends = inner_cuts(held, label, cut, parts)
    errors = []
    for first, last in zip(ends, [*ends[1:], None], strict=True):
        train, validation = held.stats(held.train(label, first), fills), held.stats(held.between(label, first, last, cut), fills)
        if train.n and validation.n:
            errors.append([squared_error(train, validation, scale, w) for w in lasso(train, scale, path)])
    best = int(np.argmin(np.round(np.mean(errors, axis=0) / whole.yy * whole.n, 12))) if errors else len(path) - 1
    w = lasso(whole, scale, path[: best + 1])[-1]
    order = np.argsort(-np.abs(w), kind="stable")[:most]
    kept = sorted(int(j) for j in order if abs(w[j]) > 1e-10) or sorted(order.tolist())
    return float(path[best]), w, kept


def _solve(frames: Iterator[pd.DataFrame], held, penalties: list[float], least: int, inner: int | None, most: int) -> Iterator[pd.DataFrame]:
    held = held.value
    for frame in frames:
        for label, cut, last in frame.itertuples(index=False):
            if (label, cut) not in held.medians:
                continue
            fills = held.medians[label, cut]
            stats = held.stats(held.train(label, cut), fills)
            if stats.n < least or not stats.yy > 0:
                continue
            keep = np.arange(len(fills)) if inner is None else np.array(select_by_lasso(held, label, cut, inner, most)[2])
            part = Stats(stats.n, stats.mean[keep], stats.mean_y, stats.xx[np.ix_(keep, keep)], stats.xy[keep], stats.yy)
            for penalty, w in zip(penalties, ridge(part, penalties), strict=True):
                slope = np.zeros(len(fills))
                slope[keep] = w / part.scale()
                yield pd.DataFrame({"label": [label], "cut": [cut], "last": [last], "penalty": [penalty], "n_train": [int(stats.n)], "intercept": [stats.mean_y - slope @ stats.mean], "slope": [slope], "fills": [fills]})


def ridge_models(df: DataFrame, held: Grams, folds: list[tuple[dt.date, dt.date]], labels: list[str], penalties: list[float], least: int = 10, inner: int | None = None, most: int = 200) -> DataFrame:
    """label, cut, last, penalty, n_train, intercept, slope, fills: a model for each label, fold and penalty, solved in tasks.

    inner: first keep the columns that a Lasso over so many inner windows of the fold's own training window keeps.
    """
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(held)
    wanted = [(y, held.cuts.index(a), held.cuts.index(b)) for y in labels for a, b in folds]
    tasks = spark.createDataFrame(wanted, "label string, cut int, last int").repartition(len(wanted))
    schema = "label string, cut int, last int, penalty double, n_train long, intercept double, slope array<double>, fills array<double>"
    return staged(tasks.mapInPandas(lambda f: _solve(f, sent, penalties, least, inner, most), schema), "models")


def scored(df: DataFrame, models: DataFrame, columns: list[str], labels: list[str], at: str, cuts: list[dt.date], keep: list[str]) -> DataFrame:
    """keep, label, cut, penalty, n_train, y, p: the rows of each fold's test window under each of its models; y is null where it isn't known."""
    x = F.array(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns])
    wide = df.where(F.col(at).isNotNull()).select(
        *keep, block(F.col(at), cuts).alias("_a"), x.alias("_x"),
        F.explode(F.array(*[F.struct(F.lit(y).alias("label"), F.col(y).cast("double").alias("y")) for y in labels])).alias("_l"),
    ).select(*keep, "_a", "_x", "_l.label", "_l.y")
    # a model for each label and block of its test window: as many as folds, labels and penalties
    spread = models.withColumn("_a", F.explode(F.sequence(F.col("cut") + 1, F.col("last"))))
    term = F.zip_with(F.zip_with("_x", "fills", lambda v, f: F.coalesce(v, f)), "slope", lambda v, w: v * w)
    p = F.col("intercept") + F.aggregate(term, F.lit(0.0), lambda s, v: s + v)
    return wide.join(F.broadcast(spread), ["label", "_a"]).select(*keep, "label", "cut", "penalty", "n_train", "y", p.alias("p"))


def search(scores: DataFrame, least: int = 2) -> DataFrame:
    """label, penalty, folds, ic, best: mean rank correlation over the folds; the best is the highest to 12 digits, the smallest penalty on ties."""
    by_fold = rank_correlation(scores.where("p is not null and y is not null"), "p", "y", ["label", "penalty", "cut"], least)
    mean = by_fold.groupBy("label", "penalty").agg(F.count("ic").alias("folds"), F.avg("ic").alias("ic"))
    first = F.row_number().over(W.partitionBy("label").orderBy(F.round("ic", 12).desc_nulls_last(), "penalty"))
    return mean.withColumn("best", first == 1)
