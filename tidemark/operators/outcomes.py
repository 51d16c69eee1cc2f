"""Daily bars, outcome labels and the outcome universe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import pct_return, share_change, turnover

#: Percent from which a move touches the limit, and change of listed shares that suggests a corporate action.
LIMIT, ACTION = 29.0, 5.0
UNAVAILABLE, NEW, UNCERTAIN, SUSPECT = "PRICE_UNAVAILABLE", "NEW_LISTING_OR_NO_PREVIOUS_CLOSE", "REFERENCE_PRICE_UNCERTAIN", "CORPORATE_ACTION_SUSPECTED"


def daily_bars(ticks: DataFrame, ticker: str, ts: str, value: str, tie: str) -> DataFrame:
    """ticker, trade_date, o, h, l, c, v from ticks; ``tie`` orders ticks of one time."""
    at = F.struct(ts, tie)
    return ticks.groupBy(F.col(ticker).alias("ticker"), F.to_date(ts).alias("trade_date")).agg(
        F.min_by(value, at).alias("o"), F.max(value).alias("h"), F.min(value).alias("l"), F.max_by(value, at).alias("c"), F.count(F.lit(1)).cast("double").alias("v")
    )


def with_previous(bars: DataFrame, *columns: str) -> DataFrame:
    """Each bar with the columns of the bar before it, as prev_*; the first has nulls."""
    w = Window.partitionBy("ticker").orderBy("trade_date")
    return bars.withColumns({f"prev_{c}": F.lag(c).over(w) for c in columns})


def label_columns(prev: Column, o: Column, h: Column, low: Column, c: Column) -> dict[str, Column]:
    """Returns and limit labels. Without a previous close returns are null and every label is false, not null."""
    ok = prev.isNotNull() & (prev != 0)
    gap, high, bottom, close = (F.when(ok, pct_return(x, prev)) for x in (o, h, low, c))
    yes = lambda cond: F.coalesce(cond, F.lit(False))
    touched, closed = yes(high >= LIMIT), yes(close >= LIMIT)
    return {
        "gap_return": gap, "high_return": high, "close_return": close, "touched_limit": touched, "closed_limit": closed, "released": touched & ~closed,
        "one_price": yes((gap >= LIMIT) & (high >= LIMIT) & (bottom >= LIMIT) & (close >= LIMIT)), "unavailable": ~ok,
    }


def outcome_labels(bars: DataFrame) -> DataFrame:
    framed = with_previous(bars, "c")
    labels = label_columns(*(F.col(x) for x in ("prev_c", "o", "h", "l", "c")))
    return framed.select("ticker", "trade_date", "o", "h", "l", "c", *[x.alias(n) for n, x in labels.items()])


def reference_flags(bars: DataFrame) -> DataFrame:
    """Flags of the checks on the reference price, in their order, for bars with listed shares ``s``. A day without a bar is handled by ``outcomes_on``."""
    framed = with_previous(bars, "trade_date", "c", "s")
    new = F.col("prev_trade_date").isNull()
    uncertain = ~new & (F.col("prev_c").isNull() | (F.col("prev_c") <= 0))
    suspect = ~new & ~uncertain & F.coalesce(share_change(F.col("s"), F.col("prev_s")) >= ACTION, F.lit(False))
    flags = F.concat(*[F.when(cond, F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>")) for cond, names in ((new, (UNAVAILABLE, NEW)), (uncertain, (UNAVAILABLE, UNCERTAIN)), (suspect, (UNAVAILABLE, SUSPECT)))])
    return framed.select("ticker", "trade_date", "c", "prev_c", turnover(F.col("v"), F.col("s")).alias("turnover"), flags.alias("flags"))


def outcome_universe(bars: DataFrame, day: str | Column) -> DataFrame:
    """Labels on ``day`` of all tickers whose price can be used."""
    day = F.lit(day).cast("date") if isinstance(day, str) else day
    flagged = reference_flags(bars).where(F.col("trade_date") == day).where(~F.array_contains("flags", UNAVAILABLE)).select("ticker", "trade_date", "turnover")
    return outcome_labels(bars).where(F.col("trade_date") == day).join(flagged, ["ticker", "trade_date"])


def outcomes_on(tickers: DataFrame, bars: DataFrame, day: str) -> DataFrame:
    """Every ticker asked for, with its flags; one without a bar on ``day`` has no price."""
    there = reference_flags(bars).where(F.col("trade_date") == F.lit(day).cast("date"))
    return tickers.join(there, "ticker", "left").withColumn("flags", F.coalesce("flags", F.array(F.lit(UNAVAILABLE))))
