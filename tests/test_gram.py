"""Models from sums of products against the same models from the rows themselves."""

import datetime as dt
import random

import numpy as np
import pytest

from eventloom.operators import gram as G

CUTS = [dt.date(2020, m, 1) for m in range(2, 11)]
FOLDS = [(dt.date(2020, 6, 1), dt.date(2020, 8, 1)), (dt.date(2020, 8, 1), dt.date(2020, 10, 1))]
COLUMNS = ["a", "b", "c", "flat", "rare"]
LABELS = {"y": "end", "z": "day"}


def rows(n=900):
    r = random.Random(2)
    out = []
    for k in range(n):
        day = dt.date(2020, 1, 1) + dt.timedelta(r.randint(0, 290))
        a, b = r.gauss(1e6, 3), r.gauss(0, 1)
        c = b + r.gauss(0, 0.1) if r.random() < 0.8 else None
        y = 0.5 * (a - 1e6) - 2 * b + r.gauss(0, 1)
        end = day + dt.timedelta(r.randint(0, 40)) if r.random() < 0.9 else None
        out.append((k, day if k % 97 else None, end, a if r.random() < 0.9 else float("nan"), b, c, 7.0, r.gauss(0, 1) if r.random() < 0.01 else None, y if r.random() < 0.9 else None, b * 3 + r.gauss(0, 2)))
    return out


@pytest.fixture(scope="module")
def data(spark):
    every = rows()
    return every, spark.createDataFrame(every, "id long, day date, end date, a double, b double, c double, flat double, rare double, y double, z double").repartition(5)


@pytest.fixture(scope="module")
def held(data):
    return G.grams(data[1], COLUMNS, LABELS, "day", CUTS)


def matrix(some):
    return np.array([[np.nan if v is None else v for v in r[3:8]] for r in some], float).reshape(-1, 5)


def known(row, label, cut):
    end = row[2] if label == "y" else row[1]
    return row[1] is not None and row[8 if label == "y" else 9] is not None and row[1] < cut and (end is None or end < cut)


def window(every, label, cut):
    some = [r for r in every if known(r, label, cut)]
    x, y = matrix(some), np.array([r[8 if label == "y" else 9] for r in some], float)
    fills = np.array([np.sort(v[~np.isnan(v)])[(np.sum(~np.isnan(v)) + 1) // 2 - 1] if (~np.isnan(v)).any() else np.nan for v in x.T])
    return some, x, y, fills


def filled(x, fills):
    return np.where(np.isnan(x), fills, x)


@pytest.mark.parametrize("label", ["y", "z"])
def test_windows(data, held, label):
    for k, cut in enumerate(held.cuts):
        some, x, y, fills = window(data[0], label, cut)
        if not some:
            continue
        got = held.medians[label, k]
        seen = ~np.isnan(fills)
        assert got[seen].tolist() == fills[seen].tolist()
        stats, full = held.stats(held.train(label, k), got), filled(x, got)
        assert stats.n == len(y) and np.allclose(stats.mean, full.mean(0)) and np.isclose(stats.mean_y, y.mean())
        assert np.allclose(stats.xx, (full - full.mean(0)).T @ (full - full.mean(0)), atol=1e-6) and np.allclose(stats.xy, (full - full.mean(0)).T @ (y - y.mean()), atol=1e-6)
        later = [r for r in data[0] if known(r, label, held.cuts[-1]) and r[1] >= cut]
        assert held.between(label, k, None, len(held.cuts) - 1)[0, 0] == len(later)


def ridge_by_rows(x, y, fills, penalty):
    full = filled(x, fills)
    mean, sd = full.mean(0), full.std(0)
    sd[sd < 1e-6] = 1
    z = (full - mean) / sd
    w = np.linalg.solve(z.T @ z + penalty * np.eye(5), z.T @ (y - y.mean()))
    return lambda other: y.mean() + (filled(other, fills) - mean) / sd @ w


def spearman(a, b):
    rank = lambda v: np.array([(np.sum(v < x) + np.sum(v <= x) + 1) / 2 for x in v])
    return np.corrcoef(rank(a), rank(b))[0, 1]


def test_search_and_scores(spark, data, held):
    penalties = [0.01, 10.0, 1000.0]
    models = G.ridge_models(data[1], held, FOLDS, ["y", "z"], penalties)
    scores = G.scored(data[1], models, COLUMNS, ["y", "z"], "day", held.cuts, ["id"])
    got = {(r.label, r.cut, r.penalty, r.id): r.p for r in scores.collect()}
    want, ics = {}, {}
    for label in ("y", "z"):
        for start, stop in FOLDS:
            _, x, y, fills = window(data[0], label, start)
            fills = np.where(np.isnan(fills), held.medians[label, held.cuts.index(start)], fills)
            test = [r for r in data[0] if r[1] is not None and start <= r[1] < stop]
            for penalty in penalties:
                p = ridge_by_rows(x, y, fills, penalty)(matrix(test))
                want |= {(label, held.cuts.index(start), penalty, r[0]): v for r, v in zip(test, p, strict=True)}
                pairs = [(v, r[8 if label == "y" else 9]) for r, v in zip(test, p, strict=True) if r[8 if label == "y" else 9] is not None]
                ics.setdefault((label, penalty), []).append(spearman(*np.array(pairs).T))
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    found = {(r.label, r.penalty): r for r in G.search(scores).collect()}
    assert all(found[k].ic == pytest.approx(np.mean(v), abs=1e-9) and found[k].folds == 2 for k, v in ics.items())
    for label in ("y", "z"):
        best = max((k for k in found if k[0] == label), key=lambda k: (round(found[k].ic, 12), -k[1]))
        assert [k for k in found if k[0] == label and found[k].best] == [best]


def test_jobs_do_not_depend_on_folds_and_penalties(spark, data):
    def jobs(folds, penalties):
        name = f"jobs-{len(folds)}-{len(penalties)}"
        spark.sparkContext.setJobGroup(name, name)
        held = G.grams(data[1], COLUMNS, LABELS, "day", CUTS)
        models = G.ridge_models(data[1], held, folds, list(LABELS), penalties)
        G.search(G.scored(data[1], models, COLUMNS, list(LABELS), "day", held.cuts, ["id"])).collect()
        n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return n

    # one more or less, as Spark plans a join anew by its size
    assert abs(jobs(FOLDS[:1], [1.0]) - jobs([(CUTS[k], CUTS[k + 1]) for k in range(2, 8)], [10.0**k for k in range(-3, 5)])) <= 2


def lasso_by_rows(z, y, penalty):
    """Coordinate descent over the rows."""
    w, n = np.zeros(z.shape[1]), len(y)
    for _ in range(20_000):
        before = w.copy()
        for j in range(len(w)):
            size = z[:, j] @ z[:, j] / n
            if size < 1e-12:
                continue
            rest = z[:, j] @ (y - z @ w + z[:, j] * w[j]) / n
            w[j] = np.sign(rest) * max(abs(rest) - penalty, 0) / size
        if np.abs(w - before).max() < 1e-13:
            break
    return w


def test_lasso_path(data, held):
    _, x, y, _ = window(data[0], "y", CUTS[6])
    fills = held.medians["y", 6]
    stats = held.stats(held.train("y", 6), fills)
    scale = stats.scale()
    path = G.penalty_path(stats, scale)
    found = G.lasso(stats, scale, path)
    z, target = (filled(x, fills) - stats.mean) / scale, y - y.mean()
    assert not found[0].any() and path[0] == pytest.approx(np.abs(z.T @ target).max() / len(y))
    for k in (1, 10, 40, 99):
        assert np.abs(found[k] - lasso_by_rows(z, target, path[k])).max() < 1e-8
    # the conditions of the optimum
    for penalty, w in zip(path, found, strict=True):
        pull = z.T @ (target - z @ w) / len(y)
        assert np.all(np.abs(pull) <= penalty + 1e-8) and np.allclose(pull[w != 0], penalty * np.sign(w[w != 0]), atol=1e-8)


def test_lasso_selection_in_folds(data, held):
    """The penalty by errors of purged inner windows, worked out from the rows."""
    every, cut = data[0], 6
    some, x, y, _ = window(every, "y", CUTS[cut])
    fills = held.medians["y", cut]
    stats = held.stats(held.train("y", cut), fills)
    scale, path = stats.scale(), G.penalty_path(stats, stats.scale())
    days = np.array([r[1] for r in some])
    ends = G.inner_cuts(held, "y", cut, 3)
    for c, part in zip(ends, (0.25, 0.5, 0.75), strict=True):
        assert np.sum(days < CUTS[c]) >= part * len(days) > np.sum(days < (CUTS[c - 1] if c else dt.date.min))
    errors = np.zeros((3, len(path)))
    full = filled(x, fills) / scale
    for i, (first, last) in enumerate(zip(ends, [*ends[1:], None], strict=True)):
        train = np.array([known(r, "y", CUTS[first]) for r in some])
        test = (days >= CUTS[first]) & ((days < CUTS[last]) if last is not None else True)
        mean, level = full[train].mean(0), y[train].mean()
        for k in range(0, len(path), 9):
            w = lasso_by_rows(full[train] - mean, y[train] - level, path[k])
            errors[i, k] = np.mean((y[test] - level - (full[test] - mean) @ w) ** 2)
            inner = held.stats(held.train("y", first), fills)
            assert G.squared_error(inner, held.stats(held.between("y", first, last, cut), fills), scale, w) == pytest.approx(errors[i, k], abs=1e-8)
    penalty, w, kept = G.select_by_lasso(held, "y", cut)
    tried = np.arange(0, len(path), 9)
    assert penalty <= path[tried[np.argmin(errors[:, tried].mean(0))]] * 1.9 and penalty >= path[tried[np.argmin(errors[:, tried].mean(0))]] / 1.9
    assert kept == np.flatnonzero(np.abs(w) > 1e-10).tolist() and {0, 1} <= set(kept) and 3 not in kept
    assert G.select_by_lasso(held, "y", cut, most=1)[2] == [int(np.argmax(np.abs(w)))]


def test_odd_tables(spark, data):
    none = G.grams(data[1].limit(0), COLUMNS, LABELS, "day", CUTS)
    assert G.ridge_models(data[1], none, FOLDS, ["y"], [1.0]).count() == 0
    constant = data[1].selectExpr("id", "day", "end", "a", "b", "c", "flat", "rare", "1.0D y", "z")
    assert G.ridge_models(constant, G.grams(constant, COLUMNS, LABELS, "day", CUTS), FOLDS, ["y"], [1.0]).count() == 0
    with pytest.raises(ValueError, match="too many"):
        G.grams(data[1].select("day", "end", "y", "z", *[data[1]["a"].alias(f"x{k}") for k in range(700)]), [f"x{k}" for k in range(700)], LABELS, "day", CUTS)
