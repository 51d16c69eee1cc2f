"""Metrics of ranked predictions against outcomes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import rate

CUTS = (5, 10, 20)
#: Percent thresholds of the high-return rates and recalls.
LEVELS = (5, 10, 15, 20)


def placed(candidates: DataFrame, *order) -> DataFrame:
    """Candidates of each prediction with their position by rank, which need not be the rank itself."""
    return candidates.withColumn("position", F.row_number().over(Window.partitionBy("prediction_id").orderBy(*(order or ("rank",)))))


def metrics_at(candidates: DataFrame, outcomes: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """One row per prediction. candidates: prediction_id, rank, ticker; outcomes: prediction_id, ticker, high_return, gap_return, touched, closed.

    Rates without a denominator are null, as is every recall without a universe (prediction_id, ticker, high_return, touched, closed). A high-return
    rate is over the candidates whose return is known. A ticker counts for a recall once, at its first position, if both its own outcome and the
    universe's satisfy it; recalls at k look at the first k positions, the others at all.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    first = lambda k: F.col("position") <= k
    again = Window.partitionBy("prediction_id", "ticker").orderBy("position")
    joined = placed(candidates).join(outcomes, ["prediction_id", "ticker"], "left").withColumn("is_new", F.row_number().over(again) == 1)
    hit, n = yes(F.col("touched")), F.count(F.lit(1))
    aggs = [n.alias("n_candidates"), *[F.count_if(first(k) & hit).alias(f"hits_at_{k}") for k in CUTS]]
    aggs += [rate(F.count_if(first(k) & hit), F.least(F.lit(k), n)).alias(f"precision_at_{k}") for k in CUTS]
    aggs += [F.avg(F.when(first(k), F.col("high_return"))).alias(f"avg_high_at_{k}") for k in CUTS]
    aggs += [rate(F.count_if(yes(F.col("high_return") >= x)), F.count("high_return")).alias(f"high_ge_{x}_rate") for x in LEVELS]
    aggs += [rate(F.count_if(yes(F.col("gap_return") > 0)), F.count("gap_return")).alias("gap_up_rate"), rate(F.count_if(~hit), n).alias("false_positive_rate")]
    if universe is None:
        return joined.groupBy("prediction_id").agg(*aggs)
    tests = {"limit_recall": lambda r: r("touched"), "closed_recall": lambda r: r("closed")} | {f"recall_ge_{x}": lambda r, x=x: r("high_return") >= x for x in LEVELS}
    known = universe.select("prediction_id", "ticker", *[F.col(c).alias(f"all_{c}") for c in ("high_return", "touched", "closed")])
    both = joined.join(known, ["prediction_id", "ticker"], "left")
    found = {}
    for name, test in tests.items():
        holds = F.col("is_new") & yes(test(F.col)) & yes(test(lambda c: F.col(f"all_{c}")))
        found |= {name: F.count_if(holds)} | {f"{name}_at_{k}": F.count_if(first(k) & holds) for k in CUTS}
    out = both.groupBy("prediction_id").agg(*aggs, *[c.alias(f"found_{m}") for m, c in found.items()])
    total = universe.groupBy("prediction_id").agg(*[F.count_if(yes(test(F.col))).alias(f"total_{name}") for name, test in tests.items()])
    names = [c for c in out.columns if not c.startswith("found_")]
    out = out.join(total, "prediction_id", "left")
    return out.select(*names, *[rate(F.col(f"found_{m}"), F.col(f"total_{re.sub('_at_[0-9]+$', '', m)}")).alias(m) for m in found])


def path_recall(candidates: DataFrame, universe: DataFrame, paths: dict[str, tuple[str, ...]], outcomes: DataFrame | None = None) -> DataFrame:
    """For each named set of path types the share of all limit tickers that its candidates found; the denominator is the same for all.

    With ``outcomes`` a candidate counts only if its own outcome touched the limit too.
    """
    if outcomes is not None:
        candidates = candidates.join(outcomes.where("touched").select("prediction_id", "ticker"), ["prediction_id", "ticker"], "left_semi")
    limit = universe.where("touched").select("prediction_id", "ticker").distinct()
    total = limit.groupBy("prediction_id").agg(F.count(F.lit(1)).alias("limit_tickers"))
    found = candidates.join(limit, ["prediction_id", "ticker"], "left_semi").groupBy("prediction_id").agg(*[F.count_distinct(F.when(F.col("path_type").isin(*p), F.col("ticker"))).alias(name) for name, p in paths.items()])
    return total.join(found, "prediction_id", "left").select("prediction_id", "limit_tickers", *[rate(F.coalesce(F.col(n), F.lit(0)), F.col("limit_tickers")).alias(n) for n in paths])


def misses(universe: DataFrame, candidates: DataFrame) -> DataFrame:
    """Limit tickers that no candidate named."""
    return universe.where("touched").select("prediction_id", "ticker").distinct().join(candidates, ["prediction_id", "ticker"], "left_anti")


def false_positives(candidates: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Candidates whose outcome did not touch the limit, or is unknown."""
    good = outcomes.where("touched").select("prediction_id", "ticker")
    return candidates.join(good, ["prediction_id", "ticker"], "left_anti")


def failure_codes(false_positive: DataFrame, missed: DataFrame, predictions: DataFrame) -> DataFrame:
    """UNKNOWN where there are false positives, then RANKING_MISS where there are misses."""
    fp, ms = (d.select("prediction_id").distinct().withColumn(n, F.lit(True)) for d, n in ((false_positive, "fp"), (missed, "ms")))
    codes = F.array_compact(F.array(F.when(F.col("fp"), F.lit("UNKNOWN")), F.when(F.col("ms"), F.lit("RANKING_MISS"))))
    return predictions.select("prediction_id").distinct().join(fp, "prediction_id", "left").join(ms, "prediction_id", "left").select("prediction_id", codes.alias("failure_codes"))


def eligibility(frame: DataFrame, rules: dict) -> DataFrame:
    """A boolean column for each named rule, null counting as false, and the names of those that fail."""
    held = {name: F.coalesce(rule, F.lit(False)) for name, rule in rules.items()}
    failed = F.array_compact(F.array(*[F.when(~c, F.lit(n)) for n, c in held.items()]))
    return frame.withColumns(held | {"failed_rules": failed})
