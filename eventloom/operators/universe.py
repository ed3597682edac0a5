"""Membership at a point in time: change logs undone from today's list, look-ups that refuse the future, tolerance by cadence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import snapshot_members

#: Days that a snapshot stays good for: snapshots up to a week apart, and others.
CLOSE_DAYS, FAR_DAYS = 7, 65


def undone(current: DataFrame, changes: DataFrame, start: str, end: str) -> DataFrame:
    """ticker, valid_from, valid_to (the day after the last; null: open at the end), contradictions: membership between start and end.

    current: ticker, today's members; changes: date, added, removed and a number `seq` for their order within a day. What held before a
    change is what today's list says with all changes from it on undone, so it depends on the next change of the same ticker alone: not a member before
    it was added, a member before it was removed (the last of a day's changes, as they are undone in their order). A change whose ticker isn't
    afterwards what it says is a contradiction: the change is believed for the days before it, and counted.
    """
    each = changes.where("date is not null").select("date", "seq", F.posexplode(F.array(F.struct(F.col("added").alias("ticker"), F.lit(False).alias("was")), F.struct(F.col("removed").alias("ticker"), F.lit(True).alias("was")))).alias("side", "c"))
    each = each.select("date", "seq", "side", "c.*").where("ticker is not null")
    daily = each.groupBy("ticker", "date").agg(F.max_by("was", F.struct("seq", "side")).alias("was"))
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    events = daily.where(F.col("date") > first)
    today = current.select("ticker").distinct()
    # what holds from each change on is what held before the next one; after the last, today's list
    marks = events.select("ticker", "date", "was", F.lit(False).alias("now")).unionByName(today.select("ticker", F.lit(None).cast("date").alias("date"), F.lit(None).cast("boolean").alias("was"), F.lit(True).alias("now")))
    by = W.partitionBy("ticker")
    order = by.orderBy("date")
    steps = marks.withColumn("_member", F.max("now").over(by)).where("date is not null").withColumns({
        "_after": F.coalesce(F.lead("was").over(order), F.col("_member")), "_till": F.lead("date").over(order), "_from": F.lag("date").over(order),
    })
    wrong = (F.col("was") == F.col("_after")).cast("long")
    after = steps.select("ticker", F.col("date").alias("valid_from"), F.col("_till").alias("valid_to"), F.col("_after").alias("member"), wrong.alias("wrong"))
    before = steps.where("_from is null").select("ticker", first.alias("valid_from"), F.col("date").alias("valid_to"), F.col("was").alias("member"), F.lit(0).cast("long").alias("wrong"))
    still = today.join(events.select("ticker").distinct(), "ticker", "left_anti").select("ticker", first.alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.lit(True).alias("member"), F.lit(0).cast("long").alias("wrong"))
    every = after.unionByName(before).unionByName(still)
    held = every.withColumn("contradictions", F.sum("wrong").over(by)).where((F.col("valid_from") <= last))
    ordered = by.orderBy("valid_from")
    turns = held.withColumn("_was", F.lag("member").over(ordered)).where("_was is null or _was != member")
    spans = turns.withColumn("valid_to", F.lead("valid_from").over(ordered)).where("member")
    return spans.select("ticker", "valid_from", "valid_to", "contradictions")


def business_day_grid(spans: DataFrame, end: str) -> DataFrame:
    """date, ticker: a row for each business day of each span, up to and with end."""
    last = F.least(F.coalesce(F.date_sub("valid_to", 1), F.lit(end).cast("date")), F.lit(end).cast("date"))
    days = spans.select("ticker", "valid_from", last.alias("_last")).where("valid_from <= _last").select(F.explode(F.sequence("valid_from", "_last")).alias("date"), "ticker")
    return days.where(F.weekday("date") < 5)


def tolerance_days(universe: DataFrame) -> int:
    """Days that a snapshot is good for, by the median gap between snapshots; one number for the whole universe."""
    dates = universe.where("snapshot is not null").select("snapshot").distinct()
    gaps = dates.select(F.datediff("snapshot", F.lag("snapshot").over(W.orderBy("snapshot"))).alias("gap"))  # a row for each snapshot
    middle = gaps.agg(F.median("gap")).first()[0]
    return CLOSE_DAYS if middle is not None and middle <= CLOSE_DAYS else FAR_DAYS


def members_by_cadence(rows: DataFrame, universe: DataFrame, at: str) -> DataFrame:
    """Rows whose ticker is in the latest snapshot on or before `at`, if that isn't staler than the universe's own cadence allows."""
    known = universe.where("snapshot is not null and ticker is not null")
    return snapshot_members(rows, known, at, tolerance_days(known))


def guarded(rows: DataFrame, at: str, horizon: Column) -> DataFrame:
    """rows; reading them fails on one dated after the horizon, whose state nobody can know yet."""
    known = F.when(F.col(at) > horizon, F.raise_error(F.concat(F.lit("a look-up after what is known: "), F.col(at).cast("string"))).cast("boolean")).otherwise(F.lit(True))
    return rows.where(known)


def members_at(universe: DataFrame, days: DataFrame, horizon: str) -> DataFrame:
    """date, ticker of the members on each of the days (date): the latest snapshot's, none before the first one; a day after the horizon fails."""
    dates = universe.select("snapshot").distinct()
    spans = dates.select("snapshot", F.coalesce(F.lead("snapshot").over(W.orderBy("snapshot")), F.date_add(F.lit(horizon).cast("date"), 1)).alias("_until"))
    good = spans.where("snapshot < _until").select("snapshot", F.explode(F.sequence("snapshot", F.date_sub("_until", 1))).alias("date"))
    asked = guarded(days.select("date").distinct(), "date", F.lit(horizon).cast("date"))
    return asked.join(good, "date").join(universe.select("snapshot", "ticker").distinct(), "snapshot").select("date", "ticker")


def defence(universe: DataFrame, days: DataFrame, horizon: str) -> DataFrame:
    """check, rows, violations, passed: what a point-in-time look-up must refuse or leave empty, on real days.

    future: days after the horizon, which must fail (counted, as a failed look-up has no rows); ancient: members on days before the first
    snapshot; known: members that the latest snapshot lacks.
    """
    first = universe.agg(F.min("snapshot").alias("_first"))
    asked = days.select("date").distinct().crossJoin(F.broadcast(first))  # one row
    known = asked.where(F.col("date") <= F.lit(horizon).cast("date"))
    found = members_at(universe, known.select("date"), horizon)
    early = found.join(known.where("date < _first").select("date"), "date", "left_semi")
    both = known.select("date", F.lit(None).cast("date").alias("snapshot")).unionByName(universe.select(F.col("snapshot").alias("date"), "snapshot").distinct())
    order = W.orderBy("date", F.col("snapshot").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)  # days and snapshots
    latest = both.withColumn("_seen", F.max("snapshot").over(order)).where("snapshot is null").select("date", F.col("_seen").alias("snapshot"))
    wrong = found.join(latest, "date").join(universe.select("snapshot", "ticker"), ["snapshot", "ticker"], "left_anti")
    future = asked.where(F.col("date") > F.lit(horizon).cast("date"))
    row = lambda name, rows, bad: rows.agg(F.count("*").alias("rows")).join(bad.agg(F.count("*").alias("violations"))).select(F.lit(name).alias("check"), "rows", "violations", (F.col("violations") == 0).alias("passed"))
    return row("future", future, members_at(universe, known.select("date"), horizon).join(future, "date", "left_semi")).unionByName(row("ancient", asked.where("date < _first"), early)).unionByName(row("known", found, wrong))


def filled_month_grid(snapshots: DataFrame, start: str, end: str) -> DataFrame:
    """month_end, ticker: the latest snapshot's members at each month end from start to end; months before the first snapshot take the first.

    Each snapshot is spread over the months that it is good for; nothing is compared with ranges.
    """
    dates = snapshots.select("snapshot").distinct()
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    order = W.orderBy("snapshot")  # a row for each snapshot
    spans = dates.select("snapshot", F.when(F.lag("snapshot").over(order).isNull(), F.least(first, "snapshot")).otherwise(F.col("snapshot")).alias("_from"), F.coalesce(F.lead("snapshot").over(order), F.date_add(last, 1)).alias("_until"))
    good = spans.select("snapshot", F.greatest("_from", first).alias("_from"), F.least("_until", F.date_add(last, 1)).alias("_until")).where("_from < _until")
    months = F.explode(F.expr("transform(sequence(trunc(_from, 'month'), trunc(date_sub(_until, 1), 'month'), interval 1 month), m -> last_day(m))")).alias("month_end")
    ends = good.select("snapshot", "_from", "_until", months).where("month_end >= _from and month_end < _until")
    return ends.join(snapshots.select("snapshot", "ticker").distinct(), "snapshot").select("month_end", "ticker")


def united(grids: list[DataFrame]) -> DataFrame:
    """Members of any of the grids, once each."""
    out = grids[0]
    for g in grids[1:]:
        out = out.unionByName(g)
    return out.distinct()


def static_months(snapshots: DataFrame, name: str, start: str) -> DataFrame:
    """universe, period_start, period_end, reason: the months that a universe fills from its first snapshot, if there are any."""
    first = snapshots.agg(F.min("snapshot").alias("_first"))
    reason = F.concat(F.lit("no snapshot before "), F.col("_first").cast("string"), F.lit("; the first stands for the months before it"))
    return first.where(F.col("_first") > F.lit(start).cast("date")).select(F.lit(name).alias("universe"), F.lit(start).cast("date").alias("period_start"), F.date_sub("_first", 1).alias("period_end"), reason.alias("reason"))


def _before(asked: DataFrame, history: DataFrame, value: str) -> DataFrame:
    """asked (ticker, date) with value: the ticker's last known one strictly before the date."""
    known = history.where(F.col(value) > 0).select("ticker", "date", F.col(value).alias("_v"), F.lit(True).alias("_known"))
    both = asked.withColumns({"_v": F.lit(None).cast("double"), "_known": F.lit(False)}).unionByName(known)
    seen = F.last(F.when(F.col("_known"), F.col("_v")), ignorenulls=True).over(W.partitionBy("ticker").orderBy("date", "_known").rowsBetween(W.unboundedPreceding, -1))
    return both.withColumn(value, seen).where("not _known").select("ticker", "date", value)


def capital_buckets(events: DataFrame, prices: DataFrame, shares: DataFrame, universe: DataFrame, cuts: tuple[float, ...] = (0.9, 0.6, 0.3)) -> DataFrame:
    """events (ticker, date, ...) with bucket (mega, large, mid, small, unknown) and coverage.

    Capital is the last close times the last number of shares, both strictly before the event's day. Its limits are quantiles over the members of the
    latest snapshot on or before that day; coverage is the share of members with a capital. unknown: no capital, or no member with one; an event's own ticker
    need not be a member. Days and members are thousands: a ticker's history is one window.
    """
    days = events.where("date is not null").select("date").distinct()
    dates = universe.select("snapshot").distinct()
    both = days.select("date", F.lit(None).cast("date").alias("snapshot")).unionByName(dates.select(F.col("snapshot").alias("date"), "snapshot"))
    order = W.orderBy("date", F.col("snapshot").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)  # days and snapshots
    dated = both.withColumn("_s", F.max("snapshot").over(order)).where("snapshot is null and _s is not null").select("date", F.col("_s").alias("snapshot"))
    members = dated.join(universe.where("ticker is not null").select("snapshot", "ticker").distinct(), "snapshot").select("date", "ticker")
    asked = members.unionByName(events.where("date is not null and ticker is not null").select("date", "ticker")).distinct()
    capital = _before(asked, prices, "close").join(_before(asked, shares, "shares"), ["ticker", "date"]).select("ticker", "date", (F.col("close") * F.col("shares")).alias("capital"))
    inside = members.join(capital, ["ticker", "date"]).groupBy("date")
    limits = inside.agg(F.percentile("capital", F.array(*[F.lit(c) for c in cuts])).alias("_q"), (F.count("capital") / F.count("*")).alias("coverage"))
    named = events.join(capital, ["ticker", "date"], "left").join(limits, "date", "left")
    c, q = F.col("capital"), F.col("_q")
    bucket = F.when(c.isNull() | q.isNull(), "unknown").when(c >= q[0], "mega").when(c >= q[1], "large").when(c >= q[2], "mid").otherwise("small")
    return named.select(*events.columns, bucket.alias("bucket"), F.when(q.isNotNull(), F.col("coverage")).alias("coverage"))
