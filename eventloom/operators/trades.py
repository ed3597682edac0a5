"""Trade logs: planned dates meet quotes, and the rules that a log must keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import asof, nearest

NO_ENTRY, CENSORED, DELISTED = "skip_no_entry_quote", "right_censored_no_exit_quote", "delisting_exit_used"


def trade_log(plans: DataFrame, quotes: DataFrame, days: int) -> DataFrame:
    """plans (trade_id, ticker, planned_entry_date, planned_exit_date) with the first quotes within `days` after each date.

    skip_reason: no quote to enter; no quote to leave because the ticker has none from the planned exit on though others do
    (delisted); no quote to leave for another reason (censored); else null. A trade without an entry has no exit.
    """
    side = lambda name: quotes.select("ticker", F.col("date").alias(f"actual_{name}_date"), F.col("close").alias(f"{name}_price"))
    out = asof(plans, side("entry"), "ticker", "planned_entry_date", "actual_entry_date", ["entry_price"], days, forward=True)
    # keys of plans, not of what was joined to them, so that the first look-up is not made again
    leave = nearest(plans, side("exit"), "ticker", "planned_exit_date", "actual_exit_date", ["exit_price"], days, forward=True)
    out = out.join(leave, F.col("ticker").eqNullSafe(F.col("_by")) & F.col("planned_exit_date").eqNullSafe(F.col("_at"))).select(*out.columns, "_near.*")
    last = quotes.groupBy("ticker").agg(F.max("date").alias("_last"))
    out = out.join(last, "ticker", "left").crossJoin(F.broadcast(last.agg(F.max("_last").alias("_end"))))  # one row
    entered = F.col("entry_price").isNotNull()
    gone = (F.coalesce(F.col("_last") < F.col("planned_exit_date"), F.lit(True))) & (F.col("_end") >= F.col("planned_exit_date"))
    reason = F.when(~entered, NO_ENTRY).when(F.col("exit_price").isNotNull(), F.lit(None)).when(gone, DELISTED).otherwise(CENSORED)
    return out.select(
        "trade_id", "ticker", "planned_entry_date", "actual_entry_date", "entry_price", "planned_exit_date",
        F.when(entered, F.col("actual_exit_date")).alias("actual_exit_date"), F.when(entered, F.col("exit_price")).alias("exit_price"), reason.alias("skip_reason"),
    )


def trade_rules() -> dict[str, Column]:
    """The six rules of a log; a rule holds where a value that it needs is missing."""
    is_ = lambda reason: F.coalesce(F.col("skip_reason") == reason, F.lit(False))
    ordered = lambda side: F.coalesce(F.col(f"actual_{side}_date") >= F.col(f"planned_{side}_date"), F.lit(True))
    return {
        "entry_date_order": ordered("entry"),
        "exit_date_order": ordered("exit"),
        "skip_no_entry_quote_has_price": ~is_(NO_ENTRY) | F.col("entry_price").isNull(),
        "censored_skip_has_exit_price": ~is_(CENSORED) | F.col("exit_price").isNull(),
        "delisting_exit_has_exit_date": ~is_(DELISTED) | F.col("actual_exit_date").isNull(),
        "delisting_exit_no_entry_price": ~is_(DELISTED) | F.col("entry_price").isNotNull(),
    }


def trade_violations(log: DataFrame) -> DataFrame:
    """trade_id, check: a row for each rule that a trade breaks."""
    broken = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in trade_rules().items()]))
    return log.select("trade_id", F.explode(broken).alias("check"))
