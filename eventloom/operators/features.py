"""Row features of wide signal tables: columns classified by name, sums over their groups, one-hot codes."""

from __future__ import annotations

import re
from functools import reduce
from operator import add
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names and weights that define the features.
ASPECTS = ["CurrentState", "Forecast", "Other", "StrategicPosition", "Surprise"]
THEMES = [
    "CapitalAllocation", "ESG", "FinancialPerformance", "MacroeconomicFactors", "MarketAndCompetitivePosition", "OperationalPerformance", "Other",
    "RegulatoryAndLegalIssues", "StrategicInitiatives",
]
SECTORS = [
    "Energy", "Materials", "Industrials", "Consumer Discretionary", "Consumer Staples", "Health Care", "Financials", "Information Technology",
    "Communication Services", "Utilities", "Real Estate",
]
MAGNITUDES = {"High": 3, "Medium": 2, "Low": 1}
LEFT_OUT = {"Fluff", "Filler"}
EVENT_SCORES = ["EventsScore_1_1_1", "EventsScore_4_2_1", "EventsScore_3_1_0", "EventsScore_1_1_0"]
LENGTHS = ["DOCSENTENCECOUNT", "Sentences"]


class Cell(NamedTuple):
    """What the name of one AspectTheme column says."""

    column: str
    aspect: str
    theme: str
    magnitude: str
    sentiment: str


def cells(columns: list[str]) -> list[Cell]:
    """Columns named `AspectTheme_{Aspect}_{Theme} - {Magnitude} - {Sentiment}`; fluff, filler and other names are left out."""
    found = ((c, re.fullmatch(r"AspectTheme_([^_]+)_(.+?) - (.+?) - (.+)", c)) for c in columns)
    return [Cell(c, *m.groups()) for c, m in found if m and m[1] not in LEFT_OUT]


def group_sums(name: str, members: list[Cell]) -> list[Column]:
    """Total, positive less negative, and unsigned sum by magnitude of a group of columns; nulls count 0, no columns give 0."""

    def total(weight) -> Column:
        terms = [F.coalesce(F.col(f"`{m.column}`").cast("double"), F.lit(0.0)) * w for m in members if (w := weight(m))]
        return reduce(add, terms) if terms else F.lit(0.0)

    return [
        total(lambda m: 1).alias(f"{name}_total"),
        total(lambda m: {"Positive": 1, "Negative": -1}.get(m.sentiment, 0)).alias(f"{name}_net_sentiment"),
        total(lambda m: MAGNITUDES.get(m.magnitude, 0)).alias(f"{name}_mag_weighted"),
    ]


def one_hot(column: str, values: list[str], prefix: str) -> list[Column]:
    """A 0/1 column for each value; null and unknown values are 0 in all of them."""
    return [F.coalesce(F.col(column) == v, F.lit(False)).cast("tinyint").alias(f"{prefix}_{v.replace(' ', '_')}") for v in values]


def row_features(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the 60 features of a row in one projection; input columns that don't exist give nulls."""
    known = cells(df.columns)
    number = lambda c: (F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double")).alias(c)
    groups = [("aspect", a, [m for m in known if m.aspect == a and m.theme in THEMES]) for a in ASPECTS]
    groups += [("theme", t, [m for m in known if m.theme == t and m.aspect in ASPECTS]) for t in THEMES]
    sums = [c for kind, name, members in groups for c in group_sums(f"{kind}_{name}", members)]
    return df.select(*keys, *map(number, ["ATCClassifierScore", *EVENT_SCORES]), *sums, *map(number, LENGTHS), *one_hot("SECTOR", SECTORS, "sector"))
