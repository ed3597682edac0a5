"""Models over features on spark.ml: imputing, scaling, degenerate fits, purged folds, out-of-fold scores, a leaderboard."""

from __future__ import annotations

from functools import reduce
from operator import add
from typing import NamedTuple

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import HashingTF, Imputer, NGram, StandardScaler, Tokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import rank_correlation
from ..sources.files import staged
from . import embeddings
from .evaluation import best_threshold, classification_report
from .folds import at_once, with_fold

#: Fewer rows than this, or one class, give a constant.
LEAST_ROWS = 20


def factory(name: str, label: str, **params):
    """A model by name, with frozen parameters on top of its defaults."""
    common = {"featuresCol": "features", "labelCol": label} | params
    makers = {
        "logistic": lambda: LogisticRegression(**({"regParam": 0.01} | common)),
        "boosted": lambda: GBTClassifier(**({"maxIter": 10, "seed": 7} | common)),
        "ridge": lambda: LinearRegression(**({"regParam": 0.1, "elasticNetParam": 0.0} | common)),
        "lasso": lambda: LinearRegression(**({"regParam": 0.01, "elasticNetParam": 1.0} | common)),
        "boosted_value": lambda: GBTRegressor(**({"maxIter": 10, "seed": 7} | common)),
    }
    return makers[name]()


def preparation(columns: list[str]) -> list:
    """Median imputing and standardising, to be fitted on training rows only."""
    filled = [f"{c}_filled" for c in columns]
    return [
        Imputer(strategy="median", inputCols=columns, outputCols=filled, relativeError=0.0001), VectorAssembler(inputCols=filled, outputCol="raw", handleInvalid="keep"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
    ]


def fit(train: DataFrame, columns: list[str], label: str, name: str, **params) -> PipelineModel | float:
    """A fitted pipeline, or the mean label where the data are degenerate."""
    n, mean, kinds = train.agg(F.count(label), F.avg(label), F.count_distinct(label)).first()
    if n < LEAST_ROWS or kinds < 2:
        return float(mean) if mean is not None else 0.0
    live = [c for c, k in train.agg(*[F.count(c).alias(c) for c in columns]).first().asDict().items() if k]
    return Pipeline(stages=[*preparation(live), factory(name, label, **params)]).fit(train.where(F.col(label).isNotNull()))


def predict(model: PipelineModel | float, rows: DataFrame, name: str) -> DataFrame:
    """rows with p: the class-1 probability, or the predicted value of a regression."""
    if isinstance(model, float):
        return rows.withColumn("p", F.lit(model))
    out = model.transform(rows)
    p = F.get(vector_to_array("probability"), F.lit(1)) if "probability" in out.columns else F.col("prediction")
    return out.select(*rows.columns, p.alias("p"))


def out_of_fold(df: DataFrame, columns: list[str], label: str, name: str, group: str, folds: int = 5, balanced: bool = False, **params) -> DataFrame:
    """df with p from models that never saw the row's group; a fold is a hash of the group, or dealt by size (balanced). `text` models take one column of text."""
    folded = fold_groups(df, group, folds, balanced)
    return out_of_given_fold(folded, columns, label, name, folds, **params).drop("fold")


def fold_groups(df: DataFrame, group: str, folds: int, balanced: bool) -> DataFrame:
    """df with fold, staged: every fit reads its rows several times, so columns that take work are made once."""
    return staged(with_fold(df, group, folds) if balanced else df.withColumn("fold", F.pmod(F.xxhash64(group), F.lit(folds))), "folds")


def out_of_given_fold(folded: DataFrame, columns: list[str], label: str, name: str, folds: int, **params) -> DataFrame:
    """Rows with p from models of the other folds' rows; folded has the column fold. Words of texts are hashed once for all folds."""
    kept = folded.columns
    if name == "text":
        folded = staged(hashed_words(folded.fillna("", columns), columns[0]), "words")

    def part(k: int) -> DataFrame:
        train, rest = folded.where(F.col("fold") != k), folded.where(F.col("fold") == k)
        model = text_classifier(label, **params).fit(train) if name == "text" else fit(train, columns, label, name, **params)
        return predict(model, rest, name).select(*kept, "p")

    return reduce(DataFrame.unionByName, at_once(folded, part, range(folds)))


class Family(NamedTuple):
    """One kind of model of a zoo: a factory name, `text`, `embedding` (one column of text each), or `rules` (the mean of its columns is the probability)."""

    kind: str
    columns: list[str]
    params: dict = {}


def zoo(df: DataFrame, families: dict[str, Family], key: str, label: str, group: str, folds: int = 5, balanced: bool = False) -> DataFrame:
    """model, key, label, p: out-of-fold probabilities of each family, and of `ensemble`, the mean of all of them."""
    folded = fold_groups(df, group, folds, balanced)

    def part(name: str) -> DataFrame:
        family = families[name]
        # a family carries its own columns alone
        own = folded.select("fold", *dict.fromkeys([key, label, *family.columns]))
        if family.kind == "rules":
            scored = own.withColumn("p", reduce(add, [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in family.columns]) / len(family.columns))
        elif family.kind == "embedding":
            scored = embeddings.out_of_fold(own, key, family.columns[0], label, folds, embeddings.Settings(**family.params))
        else:
            scored = out_of_given_fold(own, family.columns, label, family.kind, folds, **family.params)
        return scored.select(F.lit(name).alias("model"), key, label, "p")

    # staged, as the mean reads the scores again
    every = staged(reduce(DataFrame.unionByName, at_once(df, part, families)), "scores")
    mean = every.groupBy(key, label).agg(F.avg("p").alias("p")).select(F.lit("ensemble").alias("model"), key, label, "p")
    return every.unionByName(mean)


def zoo_report(scored: DataFrame, label: str, recall: float, steps: int = 1000) -> DataFrame:
    """model, threshold, rows and the classification report at it, for each model of a zoo: the best macro-F1 that reaches the recall."""
    names = [r[0] for r in scored.select("model").distinct().collect()]  # one row a family
    best = [best_threshold(scored.where(F.col("model") == name), label, "p", steps, recall).select(F.lit(name).alias("model"), "threshold") for name in names]
    chosen = F.broadcast(reduce(DataFrame.unionByName, best))
    # the same cells as in the search, so that a row on the threshold counts alike
    pred = (F.floor(F.col("p") * steps + 1e-9) >= F.round(F.col("threshold") * steps)).cast("int")
    return classification_report(scored.join(chosen, "model").withColumn("_pred", pred), label, "_pred", ["model", "threshold"])


def known_before(at: str, ends: str, start) -> Column:
    """Rows dated before a fold starts, whose label ended before it, too."""
    return (F.col(at) < start) & (F.col(ends).isNull() | (F.col(ends) < start))


def fit_windows(df: DataFrame, folds: list[tuple[str, str]], at: str, ends: str, label: str) -> DataFrame:
    """fold, start, rows, first, last, last_end, clean: what the fit of each fold sees, in one pass; clean if nothing reaches the fold.

    The folds are a short list; a fold whose fit sees nothing has nulls and is clean.
    """
    parts = []
    for k, (start, _) in enumerate(folds):
        seen = known_before(at, ends, F.lit(start).cast("date")) & F.col(label).isNotNull()
        pick = lambda c, seen=seen: F.when(seen, F.col(c))
        parts.append(F.struct(
            F.lit(k).alias("fold"), F.lit(start).cast("date").alias("start"), F.count_if(seen).alias("rows"), F.min(pick(at)).alias("first"), F.max(pick(at)).alias("last"),
            F.max(pick(ends)).alias("last_end"),
        ))
    got = df.agg(F.array(*parts).alias("all")).select(F.inline("all"))
    return got.withColumn("clean", F.coalesce(F.greatest("last", "last_end") < F.col("start"), F.lit(True)))


def walk_forward(df: DataFrame, folds: list[tuple[str, str]], at: str, ends: str, columns: list[str], label: str, name: str, least: int = 10, **params) -> DataFrame:
    """Test rows of each fold with p; a model trains on rows known before the fold whose label ended before it, too. df is staged, as every fit reads it several times."""
    return _walk(staged(df, "walk"), folds, at, ends, columns, label, name, least, **params)


def _walk(df: DataFrame, folds: list[tuple[str, str]], at: str, ends: str, columns: list[str], label: str, name: str, least: int = 10, **params) -> DataFrame:
    out = None
    for k, (start, stop) in enumerate(folds):
        train = df.where(known_before(at, ends, F.lit(start).cast("date")) & F.col(label).isNotNull())
        test = df.where((F.col(at) >= start) & (F.col(at) < stop))
        if train.limit(least).count() < least:
            continue
        part = predict(fit(train, columns, label, name, **params), test, name).withColumn("fold", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else df.limit(0).withColumn("p", F.lit(0.0)).withColumn("fold", F.lit(0))


def nonzero_features(train: DataFrame, columns: list[str], label: str) -> list[str]:
    """Columns that an L1 fit keeps; all of them if it keeps none."""
    model = fit(train, columns, label, "lasso")
    if isinstance(model, float):
        return columns
    kept = [c for c, w in zip(model.stages[1].getInputCols(), model.stages[-1].coefficients.toArray(), strict=True) if w]
    return [c.removesuffix("_filled") for c in kept] or columns


def text_model(train: DataFrame, text: str, label: str, **params) -> PipelineModel:
    """Words and word pairs, hashed, under a logistic regression."""
    return Pipeline(stages=[*_hashing(text), text_classifier(label, **params)]).fit(train)


def text_classifier(label: str, **params) -> LogisticRegression:
    return factory("logistic", label, **({"regParam": 0.05} | params))


def _hashing(text: str) -> list:
    """Stages from a text to features; none needs a fit."""
    words, pairs = Tokenizer(inputCol=text, outputCol="words"), NGram(inputCol="words", outputCol="pairs", n=2)
    hashed = [HashingTF(inputCol=c, outputCol=f"tf_{c}", numFeatures=1 << 14) for c in ("words", "pairs")]
    return [words, pairs, *hashed, VectorAssembler(inputCols=["tf_words", "tf_pairs"], outputCol="features")]


def hashed_words(df: DataFrame, text: str) -> DataFrame:
    """df with features: its words and word pairs, hashed."""
    return PipelineModel(_hashing(text)).transform(df).select(*df.columns, F.col("features").alias("features", metadata={}))


def leaderboard(results: DataFrame, recall: float) -> DataFrame:
    """Eligible models that reach the recall, best first: macro-F1, then ensembles, then id."""
    return results.where(F.col("eligible") & (F.col("recall") >= recall)).orderBy(F.desc("macro_f1"), F.desc("ensemble"), "model")


def search(df: DataFrame, folds: list[tuple[str, str]], at: str, ends: str, columns: list[str], label: str, name: str, grid: list[dict]) -> tuple[dict, list[float | None]]:
    """The parameters with the best mean rank correlation over purged walk-forward folds, and all means. The grid is small."""
    means, df = [], staged(df, "walk")
    for params in grid:
        scored = _walk(df, folds, at, ends, columns, label, name, **params)
        means.append(rank_correlation(scored, "p", label, ["fold"]).agg(F.avg("ic")).first()[0])
    best = max(range(len(grid)), key=lambda k: (means[k] is not None, means[k] or 0.0, -k))
    return grid[best], means
