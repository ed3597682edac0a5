"""Joins that Spark lacks: as-of in both directions, snapshots, bounded scans, strict-past percentiles, validated keys."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import business_days_between
from ..functions.ranks import cell_of, finite_ends

#: Parts of the range of all values that are summed apart in a block of 2^CUT_LEVEL days or more.
VALUE_CELLS, CUT_LEVEL = 128, 6


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df; it fails where a key occurs twice, as the rows are read."""
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    checked = F.when(n > 1, F.raise_error(F.lit(f"repeated key {keys}")).cast("boolean")).otherwise(F.lit(True))
    return df.withColumn("_unique", checked).where("_unique").drop("_unique")


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join that fails on a key that either side repeats."""
    return require_unique(left, keys).join(require_unique(right, keys), keys)


def nearest(keys: DataFrame, right: DataFrame, by: str, at: str, right_at: str, carry: list[str], days: int, strict: bool = False, forward: bool = False) -> DataFrame:
    """_by, _at, _near (a struct of right_at and carry, or null): the nearest right row for each distinct by and at of keys, see asof.

    Time is cut into spans of `days`: a right row is sent to its span and the next one on, so a busy key is dealt over many tasks and no
    span needs more than its neighbour. Rows are read towards the key in either direction, as a running frame takes one step a row.
    """
    span = lambda c: F.floor(F.datediff(F.col(c), F.lit("1970-01-01").cast("date")) / (days + 1))
    packed = F.struct(F.col(right_at), *carry)
    reach = (F.lit(0), F.lit(-1)) if forward else (F.lit(0), F.lit(1))
    # on equal days the side that comes first is seen by the other: right first unless the join is strict
    r_side, l_side = (1, 0) if strict else (0, 1)
    known = right.where(F.col(right_at).isNotNull() & F.col(by).isNotNull())
    r = known.select(F.col(by).alias("_by"), F.explode(F.array(*[span(right_at) + k for k in reach])).alias("_span"), F.col(right_at).alias("_at"), packed.alias("_right"), F.lit(r_side).alias("_side"))
    once = keys.select(F.col(by).alias("_by"), F.col(at).alias("_at")).distinct()
    both = once.select("_by", span("_at").alias("_span"), "_at", F.lit(l_side).alias("_side")).unionByName(r, allowMissingColumns=True)
    order = W.partitionBy("_by", "_span").orderBy(F.desc("_at") if forward else F.asc("_at"), "_side").rowsBetween(W.unboundedPreceding, 0)
    seen = both.withColumn("_seen", F.last("_right", ignorenulls=True).over(order)).where(F.col("_side") == l_side)
    there = F.col(f"_seen.{right_at}")
    gap = F.datediff(there, "_at") if forward else F.datediff("_at", there)
    return seen.select("_by", "_at", F.when(gap <= days, F.col("_seen")).alias("_near"))


def asof(left: DataFrame, right: DataFrame, by: str, at: str, right_at: str, carry: list[str], days: int, strict: bool = False, forward: bool = False) -> DataFrame:
    """left with carry (and right_at) of the nearest right row of the same `by` within `days` calendar days before (after) at; null where nothing is near.

    Rows of the same by and at have one answer: it is found once and joined back by both, so rows of a busy key meet in no task.
    """
    found = nearest(left, right, by, at, right_at, carry, days, strict, forward)
    joined = left.join(found, left[by].eqNullSafe(found["_by"]) & left[at].eqNullSafe(found["_at"]))
    return joined.select(*[left[c] for c in left.columns], *[F.col(f"_near.{c}").alias(c) for c in [right_at, *carry]])


def forward_entry(events: DataFrame, bars: DataFrame, most_business_days: int = 5) -> DataFrame:
    """events with entry_date and entry_close: the first bar on or after the event, at most so many business days later."""
    near = asof(events, bars.withColumnRenamed("date", "entry_date"), "ticker", "date", "entry_date", ["close"], 2 * most_business_days, forward=True)
    ok = business_days_between(F.col("date"), F.col("entry_date")) <= most_business_days
    return near.withColumn("entry_close", F.when(ok, F.col("close"))).withColumn("entry_date", F.when(ok, F.col("entry_date"))).drop("close")


def snapshot_members(rows: DataFrame, universe: DataFrame, at: str, days: int) -> DataFrame:
    """Rows whose ticker is in the latest snapshot of the whole universe on or before `at`, not older than `days`."""
    dates = universe.select("snapshot").distinct()
    later = F.coalesce(F.lead("snapshot").over(W.orderBy("snapshot")), F.lit("9999-12-31").cast("date"))
    spans = dates.select("snapshot", F.least(later, F.date_add("snapshot", days + 1)).alias("_until"))
    # a row for each day that a snapshot is good for, so that the join is an equality
    by_day = spans.select(F.col("snapshot").alias("_s"), F.explode(F.sequence("snapshot", F.date_sub("_until", 1))).alias("_day"))
    dated = rows.join(by_day, rows[at] == by_day["_day"])
    members = universe.select(F.col("snapshot").alias("_s"), "ticker").distinct()
    return dated.join(members, ["_s", "ticker"], "left_semi").select(rows.columns)


def next_quote(plans: DataFrame, quotes: DataFrame, calendar: DataFrame, most: int) -> DataFrame:
    """plans (ticker, date) with quote_date and quote: the first non-null close within `most` calendar positions on or after date."""
    placed = plans.join(calendar, "date", "left").withColumn("_pos", F.explode_outer(F.expr(f"sequence(pos, pos + {most})")))
    priced = quotes.where("close is not null").join(calendar, "date").select("ticker", F.col("pos").alias("_pos"), F.col("date").alias("_d"), F.col("close").alias("_c"))
    found = placed.join(priced, ["ticker", "_pos"], "left")
    first = F.min(F.when(F.col("_d").isNotNull(), F.struct("_pos", "_d", "_c"))).alias("_q")
    return found.groupBy(*plans.columns).agg(first).select(*plans.columns, F.col("_q._d").alias("quote_date"), F.col("_q._c").alias("quote"))


def strict_past_percentile(rows: DataFrame, key: str, value: str, at: str, known_at: str, by: list[str]) -> DataFrame:
    """rows with `pct`: share of the group's values known (known_at) strictly before the row's day (at) that are at or below its own.

    Null without such values. key is unique. No pair of rows is formed: days are numbered and every day belongs to one block of
    2^k days on each level; the days before a row's are at most one block on each level (as in a binary indexed tree), and in a
    block the values at or below are a running sum. A large block holds half of its group, so blocks of CUT_LEVEL or more are cut into
    VALUE_CELLS parts by value, and the values below a part are carried in.
    """
    day = lambda c: F.datediff(F.col(c), F.lit("1900-01-01").cast("date"))
    real = rows.where(F.col(value).isNotNull())
    first, last, low, high = real.agg(F.min(day(known_at)), F.max(day(known_at)), *finite_ends(value)).first()
    if first is None:
        return rows.withColumn("pct", F.lit(None).cast("double"))
    # days count from the first known one; no row asks for more than all of them
    days = F.explode(F.sequence(F.lit(0), F.lit((last - first + 1).bit_length() - 1))).alias("_k")
    cut = {"_block": F.expr("shiftright(_d, _k)"), "_cell": F.when(F.col("_k") >= CUT_LEVEL, F.col("_cell")).otherwise(F.lit(0))}
    cell = cell_of(value, F.lit(low or 0.0), F.lit(high or 0.0), VALUE_CELLS)
    placed = real.select(F.col(key).alias("_key"), *by, F.col(value).alias("_v"), cell.alias("_cell"), day(at).alias("_at"), day(known_at).alias("_known"))
    adds = placed.where("_known is not null").select(*by, "_v", "_cell", (F.col("_known") - first).alias("_d"), days)
    adds = adds.withColumns(cut).where("_block % 2 = 0").groupBy(*by, "_k", "_block", "_cell", "_v").agg(F.count("*").alias("_n"))
    asks = placed.where(F.col("_at") > first).select("_key", *by, "_v", "_cell", (F.least("_at", F.lit(last + 1)) - first).alias("_d"), days)
    asks = asks.withColumns(cut).where("_block % 2 = 1").withColumn("_block", F.col("_block") - 1).drop("_d")
    both = asks.withColumn("_n", F.lit(0).cast("long")).unionByName(adds, allowMissingColumns=True)
    whole = W.partitionBy(*by, "_k", "_block")
    parts = both.groupBy(*by, "_k", "_block", "_cell").agg(F.sum("_n").alias("_in"))
    parts = parts.withColumns({"_under": F.sum("_in").over(whole.orderBy("_cell")) - F.col("_in"), "_all": F.sum("_in").over(whole)})
    parts = parts.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_k").alias("_pk"), F.col("_block").alias("_pb"), F.col("_cell").alias("_pc"), "_under", "_all")
    inner = W.partitionBy(*by, "_k", "_block", "_cell").orderBy("_v").rangeBetween(W.unboundedPreceding, W.currentRow)
    counted = both.withColumn("_upto", F.sum("_n").over(inner)).where("_key is not null")
    here = reduce(and_, (counted[c].eqNullSafe(parts[f"_by_{c}"]) for c in by)) & (counted["_k"] == parts["_pk"]) & (counted["_block"] == parts["_pb"]) & (counted["_cell"] == parts["_pc"])
    sums = counted.join(parts, here).groupBy("_key").agg(F.sum(F.col("_upto") + F.col("_under")).alias("_b"), F.sum("_all").alias("_a"))
    joined = rows.join(sums, rows[key] == sums["_key"], "left")
    return joined.select(*[rows[c] for c in rows.columns], F.when(F.col("_a") > 0, F.col("_b") / F.col("_a")).alias("pct"))


def month_grid(snapshots: DataFrame, last: str) -> DataFrame:
    """month_end, ticker: members of the latest snapshot at each month end up to `last`."""
    dates = snapshots.select("snapshot").distinct()
    spans = dates.withColumn("_next", F.coalesce(F.lead("snapshot").over(W.orderBy("snapshot")), F.lit("9999-12-31").cast("date")))
    months = dates.agg(F.min("snapshot").alias("first")).select(F.explode(F.expr(f"sequence(trunc(first, 'month'), date'{last}', interval 1 month)")).alias("m"))
    ends = months.select(F.last_day("m").alias("month_end"))
    picked = ends.join(F.broadcast(spans), (F.col("month_end") >= F.col("snapshot")) & (F.col("month_end") < F.col("_next")))
    return picked.select("month_end", "snapshot").join(snapshots.distinct(), "snapshot").select("month_end", "ticker")


def membership_intervals(changes: DataFrame) -> DataFrame:
    """ticker, valid_from, valid_to from a change log (ticker, date, added): state changes only, open at the end."""
    by = W.partitionBy("ticker").orderBy("date")
    steps = changes.withColumn("_was", F.lag("added").over(by)).where("_was is null or _was != added")
    out = steps.select("ticker", "added", F.col("date").alias("valid_from"), F.lead("date").over(by).alias("valid_to"))
    return out.where("added").drop("added")


def complete_votes(sample: DataFrame, judges: list[DataFrame], key: str) -> DataFrame:
    """sample with a label column for each judge, the latest of each id; fails if a judge lacks an id; blank counts as 'keep'."""
    out = sample
    for k, judge in enumerate(judges):
        latest = judge.groupBy(key).agg(F.max_by("label", "seq").alias(f"label_{k}"))
        out = out.join(latest.withColumn("_has", F.lit(True)), key, "left")
        label: Column = F.when(F.col("_has").isNull(), F.raise_error(F.lit(f"judge {k} lacks an id"))).otherwise(F.col(f"label_{k}"))
        out = out.withColumn(f"label_{k}", F.coalesce(F.nullif(label, F.lit("")), F.lit("keep"))).drop("_has")
    return out
