"""A long/short portfolio that is rebuilt from recent signals at each rebalance and followed day by day.

Only the weights of the rebalance before link one interval to the next, so nothing is walked in order: cohorts of a signal date are weighed once,
sent to the rebalances that see them, netted, and each holding is spread over the days of its interval, where windows carry the state of
missing quotes. Days and rebalances are a few thousand rows; holdings join prices by (ticker, position).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.files import staged
from .evaluation import turnover
from .joins import next_quote
from .series import gap_states
from .trades import CENSORED, DELISTED, NO_ENTRY

#: Gross exposure of a new portfolio; a weight this close to zero holds nothing.
GROSS, NOTHING = 2.0, 1e-12


@dataclass(frozen=True)
class Rules:
    """share and floor: part of a cohort in each leg, and names in it at least; lookback: trading days whose signals a rebalance sees;
    quote_days: trading days that an entry or exit waits for a quote; recovery_days: those after which a gap counts as final."""

    lookback: int = 5
    share: float = 0.2
    floor: int = 5
    quote_days: int = 5
    recovery_days: int = 30


def cohort_legs(signals: DataFrame, rules: Rules) -> DataFrame:
    """date, ticker, raw: equal weights long and short in the first and last names of each signal date.

    A ticker counts with its score of largest size, the higher one on ties; dates with fewer than 2 * floor tickers have no cohort.
    """
    known = signals.where(F.col("score").isNotNull() & ~F.isnan("score"))
    best = known.groupBy("date", "ticker").agg(F.max_by("score", F.struct(F.abs("score"), "score")).alias("score"))
    day = W.partitionBy("date")
    sized = best.withColumn("_n", F.count("*").over(day)).where(F.col("_n") >= 2 * rules.floor)
    ranked = sized.withColumns({
        "_k": F.greatest(F.lit(rules.floor), F.ceil(F.col("_n") * rules.share)),
        "_up": F.row_number().over(day.orderBy(F.desc("score"), "ticker")), "_down": F.row_number().over(day.orderBy("score", F.desc("ticker"))),
    })
    leg = lambda c: F.when(F.col(c) <= F.col("_k"), 1 / F.col("_k")).otherwise(0.0)
    return ranked.where("_up <= _k or _down <= _k").select("date", "ticker", (leg("_up") - leg("_down")).alias("raw"))


def seen_at(dates: DataFrame, calendar: DataFrame, rebalances: DataFrame, lookback: int) -> DataFrame:
    """date, rebalance: the rebalances that see the signals of a date, which need not be a trading day."""
    every = calendar.select("date", "pos").unionByName(dates.select("date", F.lit(None).cast("int").alias("pos")))
    order = W.orderBy("date", F.col("pos").asc_nulls_last())  # trading days and signal dates: thousands of rows
    day = F.when(F.col("pos").isNotNull(), F.struct("date", "pos"))
    placed = every.withColumns({
        "_last": F.last(day, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)), "_next": F.first(day, ignorenulls=True).over(order.rowsBetween(1, W.unboundedFollowing)),
    })
    first = F.when(F.col("_last.date") == F.col("date"), F.col("_last.pos")).otherwise(F.col("_next.pos"))
    spread = placed.where("pos is null").select("date", first.alias("_from"), (F.col("_last.pos") + lookback - 1).alias("_to")).where("_from <= _to")
    at = rebalances.join(calendar, "date").select(F.col("date").alias("rebalance"), F.col("pos").alias("_at"))
    return spread.select("date", F.explode(F.sequence("_from", "_to")).alias("_at")).join(at, "_at").select("date", "rebalance")


def target_weights(signals: DataFrame, calendar: DataFrame, rebalances: DataFrame, rules: Rules) -> DataFrame:
    """rebalance, ticker, weight: the cohorts that a rebalance sees, netted by ticker, centred, scaled to GROSS."""
    legs = cohort_legs(signals, rules)
    seen = seen_at(signals.select("date").distinct(), calendar, rebalances, rules.lookback)
    net = legs.join(seen, "date").groupBy("rebalance", "ticker").agg(F.sum("raw").alias("w"))
    whole = W.partitionBy("rebalance")
    return scaled(net.withColumn("weight", F.col("w") - F.avg("w").over(whole)).drop("w"))


def scaled(weights: DataFrame) -> DataFrame:
    gross = F.sum(F.abs("weight")).over(W.partitionBy("rebalance"))
    return weights.withColumn("weight", F.when(gross > 1e-10, F.col("weight") * (GROSS / gross)).otherwise(F.col("weight")))


def entries(targets: DataFrame, quotes: DataFrame, calendar: DataFrame, rules: Rules) -> DataFrame:
    """targets with entry_date and entry_price: the first quote within quote_days; weights of those that have one are scaled to GROSS again."""
    plans = targets.withColumnRenamed("rebalance", "date")
    found = next_quote(plans, quotes, calendar, rules.quote_days).withColumnRenamed("date", "rebalance")
    found = found.withColumnsRenamed({"quote_date": "entry_date", "quote": "entry_price"})
    entered = scaled(found.where("entry_date is not null"))
    missed = found.where("entry_date is null").withColumn("weight", F.lit(None).cast("double"))
    # a rebalance at which nothing can be entered changes nothing
    return entered.unionByName(missed.join(entered.select("rebalance").distinct(), "rebalance", "left_semi").select(entered.columns))


def holdings(entered: DataFrame, calendar: DataFrame, last: DataFrame) -> DataFrame:
    """interval (its rebalance), ticker, weight, entry_pos, stop_pos: holdings stay until the next rebalance that enters something.

    last: one row with the position `_end` at which the last holdings stop.
    """
    held = entered.where(F.abs("weight") > NOTHING)
    at = calendar.select(F.col("date").alias("_d"), F.col("pos").alias("_p"))
    starts = entered.where("entry_date is not null").select("rebalance").distinct().join(at, F.col("rebalance") == F.col("_d")).select("rebalance", F.col("_p").alias("_start"))
    stops = starts.crossJoin(F.broadcast(last)).select("rebalance", F.least("_end", F.coalesce(F.lead("_start").over(W.orderBy("_start")), F.col("_end"))).alias("stop_pos"))
    placed = held.join(at, F.col("entry_date") == F.col("_d")).join(stops, "rebalance")
    return placed.where("_p < stop_pos").select(F.col("rebalance").alias("interval"), "ticker", "weight", F.col("_p").alias("entry_pos"), "stop_pos")


def position_days(held: DataFrame, quotes: DataFrame, calendar: DataFrame, rules: Rules) -> DataFrame:
    """interval, ticker, pos (of the day), weight, pnl, gap_days, long_gap, recovered: a row for each holding and day.

    A day's profit comes from the quote of the day after. long_gap: the third missing quote in a row and each missing one after it, until the
    interval ends; recovered: the ticker has a quote again within recovery_days.
    """
    by = W.partitionBy("ticker").orderBy("pos")
    placed = quotes.where("close > 0").join(calendar, "date").select("ticker", "pos", F.col("close").alias("price"))
    placed = placed.withColumn("_later", F.lead("pos").over(by))
    days = held.select("interval", "ticker", "weight", "entry_pos", F.explode(F.sequence("entry_pos", "stop_pos")).alias("pos"))
    bars = days.join(placed, ["ticker", "pos"], "left").withColumn("date", F.col("pos"))
    before = W.partitionBy("ticker", "interval").orderBy("date").rowsBetween(W.unboundedPreceding, W.currentRow)
    bars = bars.withColumn("_later", F.last("_later", ignorenulls=True).over(before)).withColumn("_quoted", F.last(F.when(F.col("price").isNotNull(), F.col("pos")), ignorenulls=True).over(before))
    state = gap_states(bars, ("pos", "entry_pos", "_later", "_quoted")).where("pos > entry_pos")
    gone = F.col("censored") & F.col("price").isNull()
    again = F.coalesce((F.col("_later") > F.col("_quoted")) & (F.col("_later") - (F.col("pos") - 1) <= rules.recovery_days), F.lit(False))
    return state.select(
        "interval", "ticker", (F.col("pos") - 1).alias("pos"), "weight", "pnl", F.when(gone, 0).otherwise(F.col("gap_days")).alias("gap_days"), gone.alias("long_gap"),
        (gone & again).alias("recovered"),
    )


def daily_returns(days: DataFrame, entered: DataFrame, calendar: DataFrame, rebalances: DataFrame, last: DataFrame) -> DataFrame:
    """A row for each day from the first signal on: profit, exposures, turnover, positions, and the weight and number of those without a quote."""
    some = lambda name, cond: [F.sum(F.when(cond, F.abs("weight"))).alias(f"{name}_weight"), F.count(F.when(cond, 1)).alias(f"n_{name}")]
    gap = F.col("gap_days")
    sums = days.groupBy("pos").agg(
        F.sum("pnl").alias("pnl"), F.sum(F.abs("weight")).alias("gross"), F.sum("weight").alias("net"), F.count("*").alias("n_positions"),
        *some("filled_1d", gap == 1), *some("filled_2d", gap == 2), *some("recovered_gap", F.col("recovered")), *some("final_gap", F.col("long_gap") & ~F.col("recovered")),
    )
    weights = entered.where("entry_date is not null").select("rebalance", "ticker", "weight")
    order = weights.select("rebalance").distinct().withColumn("prev", F.lag("rebalance").over(W.orderBy("rebalance")))
    turned = turnover(weights, "rebalance", order).withColumnRenamed("rebalance", "date")
    grid = calendar.crossJoin(F.broadcast(last)).where("pos < _end").select("date", "pos")
    flagged = grid.join(rebalances.select("date", F.lit(True).alias("rebalanced")), "date", "left").join(turned, "date", "left").join(sums, "pos", "left")
    return flagged.drop("pos").fillna(0.0).fillna(0).fillna(False)


@dataclass(frozen=True)
class Simulation:
    """The tables of one run; quotes and entered weights are staged, the rest is lazy."""

    entered: DataFrame
    days: DataFrame
    daily: DataFrame
    trades: DataFrame


def simulate(signals: DataFrame, prices: DataFrame, rebalances: DataFrame, rules: Rules = Rules()) -> Simulation:
    """signals: date, ticker, score; prices: ticker, date, close (above 0, else no quote); rebalances: trading days.

    Days run from the first signal to the last one; quotes up to 30 days later serve entries, exits and the last day's profit. Signals before
    the first trading day are never seen; an interval without entries keeps what was held; a rebalance resets the state of gaps.
    """
    ends = signals.agg(F.min("date").alias("_first"), F.max("date").alias("_last"))
    quotes = prices.where("close > 0").join(F.broadcast(ends), F.col("date").between(F.col("_first"), F.date_add("_last", 30)))
    quotes = staged(quotes.select("ticker", "date", "close"), "quotes")
    calendar = quotes.select("date").distinct().select("date", (F.row_number().over(W.orderBy("date")) - 1).alias("pos"))
    # one row: the day after the last simulated one
    inside = F.when(F.col("date") <= F.col("_last"), F.col("pos"))
    last = calendar.crossJoin(F.broadcast(ends)).agg(F.least(F.max(inside) + 1, F.max("pos")).alias("_end"))
    at = rebalances.join(F.broadcast(ends), F.col("date").between(F.col("_first"), F.col("_last"))).select("date").distinct()
    entered = staged(entries(target_weights(signals, calendar, at, rules), quotes, calendar, rules), "entered")
    days = position_days(holdings(entered, calendar, last), quotes, calendar, rules)
    return Simulation(entered, days, daily_returns(days, entered, calendar, at, last), trades_of(entered, days, quotes, calendar, at, rules))


def trades_of(entered: DataFrame, days: DataFrame, quotes: DataFrame, calendar: DataFrame, rebalances: DataFrame, rules: Rules) -> DataFrame:
    """A row for each planned holding: entry, exit at the first quote from the next rebalance on, and why it has none.

    A ticker with a gap that was never recovered has left the market: its missing exits are delistings.
    """
    nexts = rebalances.select(F.col("date").alias("rebalance"), F.lead("date").over(W.orderBy("date")).alias("planned_exit_date"))
    plans = entered.join(nexts, "rebalance").withColumnRenamed("planned_exit_date", "date")
    plans = plans.withColumn("date", F.when(F.col("entry_date").isNotNull(), F.col("date")))
    out = next_quote(plans, quotes, calendar, rules.quote_days).withColumnsRenamed({"date": "planned_exit_date", "quote_date": "actual_exit_date", "quote": "exit_price"})
    gone = days.where("long_gap and not recovered").select(F.col("ticker").alias("_gone")).distinct()
    out = out.join(gone, F.col("ticker") == F.col("_gone"), "left")
    reason = F.when(F.col("entry_date").isNull(), NO_ENTRY).when(F.col("exit_price").isNotNull(), F.lit(None)).when(F.col("_gone").isNotNull(), DELISTED).otherwise(CENSORED)
    return out.select(
        F.col("rebalance").alias("planned_entry_date"), "ticker", "weight", F.col("entry_date").alias("actual_entry_date"), "entry_price", "planned_exit_date", "actual_exit_date",
        "exit_price", reason.alias("skip_reason"),
    )
