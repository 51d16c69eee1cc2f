"""What goes into prompts and reports: categories, queries for the web, summaries, compact payloads, groups by path, sample bars."""

from __future__ import annotations

import json
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Categories, each with the other names that it has.
CATEGORIES = {
    "positive_analogs": ("positive", "positive_analog"),
    "negative_controls": ("negative", "negative_analog", "negative_analogs", "negative_control"),
    "near_misses": ("near_miss",),
    "counterexamples": ("counterexample",),
    "leader_selection_pairs": ("leader_selection", "leader_selection_case", "leader_selection_cases", "leader_selection_pair"),
    "theme_formation_failures": ("theme_formation_failure",),
    "candidate_generation_errors": ("candidate_generation_error", "candidate_generation_failure", "candidate_generation_failures"),
}
#: The record type that a category asks for, and whether its records must be eligible.
TYPE_OF = {"counterexamples": "counterexample", "leader_selection_pairs": "blind_leader_preference_pair", "theme_formation_failures": "supervised_theme_formation_case"}
ELIGIBLE_OF = {"positive_analogs": True, "negative_controls": False, "near_misses": False}


def category(name: Column) -> Column:
    """The category that a name means, whatever its case, with blanks or hyphens for underscores; null if it means none."""
    plain = F.translate(F.lower(F.btrim(name)), "- ", "__")
    out = F.lit(None).cast("string")
    for own, others in CATEGORIES.items():
        out = F.when(plain.isin(own, *others), own).otherwise(out)
    return out


def in_category(category: Column, record_type: Column, eligible: Column, error_types: tuple[str, ...]) -> Column:
    """Whether a record belongs to a category. error_types: those of candidate_generation_errors. A category that isn't known takes all."""
    rule = F.when(category == "candidate_generation_errors", record_type.isin(*error_types))
    for name, kind in TYPE_OF.items():
        rule = rule.when(category == name, record_type == kind)
    for name, wanted in ELIGIBLE_OF.items():
        rule = rule.when(category == name, eligible == wanted)
    return F.coalesce(rule.otherwise(True), F.lit(False))


#: What is asked about each title, what is asked always, and what is asked if there is no title.
ABOUT = ("verify listing ticker novelty direct relation ", "beneficiary supply chain infrastructure relationship ", "D-1 absorption continuation leader review ")
ALWAYS = (
    "causal mechanism analogs for current catalyst",
    "market narrative propagation analogs and breadth formation",
    "direct company news versus policy-derived beneficiary cases",
    "successful analog cases with strong pre-open evidence",
    "failed analog cases false positives directness novelty absorption",
    "near misses candidates not selected as leaders",
    "counterexamples superficially similar opposite outcome",
    "unexpected leader selection in first-seen policy or industry event",
    "positive analogs negative analogs near misses counterexamples",
    "leader selection cases theme formation failures",
    "candidate generation errors missed beneficiaries and row disposition failures",
)
OPEN = "open-world market catalyst company discovery"


def web_queries(items: DataFrame, title: str, order: str, group: str, first: int = 10, width: int = 80) -> DataFrame:
    """(group, position, query): for each group the queries about its first titles, then those that are asked always; of equal ones the first.

    The first items by ``order``, then title, count, those with an empty title too; a group whose first items have no title asks the open query.
    """
    held = F.col(title).isNotNull() & (F.col(title) != "")
    place = F.row_number().over(Window.partitionBy(group).orderBy(order, title))
    few = items.select(group, F.col(order), F.col(title)).withColumn("place", place).where(F.col("place") <= first)
    own = few.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("place", F.when(held, F.substring(title, 1, width)).alias("t")))).alias("items"))
    titles = F.filter(F.transform("items", lambda x: x["t"]), lambda t: t.isNotNull())
    asked = F.flatten(F.transform(titles, lambda t: F.array(*[F.concat(F.lit(a), t) for a in ABOUT])))
    queries = F.concat(F.when(F.size(titles) == 0, F.array(F.lit(OPEN))).otherwise(asked), F.array(*map(F.lit, ALWAYS)))
    return own.select(group, F.posexplode(F.array_distinct(queries)).alias("position", "query"))


def summaries(records: DataFrame, payload: str = "payload") -> DataFrame:
    """The twelve fields that stand for a record: eight of its envelope, four of its payload."""
    own = ("record_id", "episode_id", "record_type", "training_target", "evidence_phase", "training_eligible", "available_from")
    return records.select(*own, *[F.get_json_object(payload, f"$.{c}").alias(c) for c in ("response_class", "ticker", "theme_id", "path_type")], "confidence_label")


#: Members and list items that a compact payload keeps, characters of a text, levels.
MEMBERS, ITEMS, CHARACTERS, LEVELS = 32, 12, 800, 4


def compact(payload: Column, fields: tuple[str, ...] = (), hidden: tuple[str, ...] = ()) -> Column:
    """A payload cut for a prompt, as canonical JSON: the members named by ``fields`` that it has, or, if none is left, all but those in ``hidden`` by name.

    Empty members go. Texts are stripped and cut, lists and objects too; below the last level their size stands for them. A payload that is no
    JSON object gives an empty one.
    """

    def shrunk(value, level: int):
        match value:
            case str():
                value = value.strip()
                return value if len(value) <= CHARACTERS else f"{value[:CHARACTERS]}...[truncated]"
            case list() if level >= LEVELS:
                return f"[nested list with {len(value)} items]"
            case dict() if level >= LEVELS:
                return f"[nested object with {len(value)} keys]"
            case list():
                return [x for x in (shrunk(x, level + 1) for x in value[:ITEMS]) if full(x)]
            case dict():
                return dict(kept((k, value[k]) for k in sorted(value)[:MEMBERS])(level + 1))
        return value

    def full(value) -> bool:
        return value is not None and value not in ("", [], {})

    def kept(members):
        return lambda level: ((k, x) for k, x in ((k, shrunk(v, level)) for k, v in members) if full(x))

    def one(text: str | None) -> str:
        try:
            held = json.loads(text or "null")
        except ValueError:
            held = None
        held = held if isinstance(held, dict) else {}
        out = dict(islice(kept((k, held[k]) for k in fields if k in held)(0), MEMBERS)) or dict(islice(kept((k, held[k]) for k in sorted(held) if k not in hidden)(0), MEMBERS))
        return json.dumps(out, sort_keys=True, ensure_ascii=False, separators=(",", ":"))

    def run(payload: pd.Series) -> pd.Series:
        return payload.map(one)

    return F.pandas_udf(run, "string")(payload)


#: The paths on which a candidate is found.
PATHS = ("SINGLE_EVENT", "THEME_BENEFICIARY", "CONTINUATION", "HYBRID")


def by_path(candidates: DataFrame, group: str, path: str = "path_type", rank: str = "rank") -> DataFrame:
    """(group, path_type, n, best_rank) for each group and every path, also those without a candidate; paths that aren't listed follow."""
    counted = candidates.groupBy(group, F.col(path).alias("path_type")).agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("best_rank"))
    wanted = candidates.select(group).distinct().select(group, F.explode(F.array(*map(F.lit, PATHS))).alias("path_type"))
    return wanted.join(counted, [group, "path_type"], "full_outer").na.fill(0, ["n"])


def lines_hash(rows: DataFrame, canonical: Column, order: str, *keys: str) -> DataFrame:
    """(keys, n, sha256) of the file that a key's rows make, one canonical line each. It holds one file's lines in one row, as the file does."""
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), canonical.alias("line"))))
    made = rows.groupBy(*keys).agg(lines.alias("lines")).select(*keys, F.size("lines").alias("n"), F.transform("lines", lambda x: F.concat(x["line"], F.lit("\n"))).alias("lines"))
    return made.select(*keys, "n", F.sha2(F.array_join("lines", "").cast("binary"), 256).alias("sha256"))


def sample_bars(tickers: DataFrame, ticker: str, through: Column, days: int = 5) -> DataFrame:
    """Bars made up from a hash of the ticker, the same at every run: one for each of the last days."""
    base = 1000 + F.conv(F.substring(F.sha2(F.col(ticker).cast("binary"), 256), 1, 2), 16, 10).cast("int")
    rows = tickers.select(ticker, through.alias("through"), base.alias("base"), F.explode(F.sequence(F.lit(days), F.lit(1))).alias("k"))
    k, b = F.col("k"), F.col("base")
    fields = {"open": b + k, "high": b + k + 10, "low": b + k - 5, "close": b + k + 3, "volume": b * k, "amount": b * k * 100, "market_cap": b * 1000, "listed_shares": b * 10}
    return rows.select(ticker, F.date_sub("through", k - 1).alias("trade_date"), *[v.cast("double").alias(n) for n, v in fields.items()])


def sample_outcome(ticker: Column, day: Column) -> dict[str, Column]:
    """Outcome fields made up from a hash of the ticker and the day."""
    bucket = F.conv(F.substring(F.sha2(F.concat_ws("|", ticker, day.cast("string")).cast("binary"), 256), 1, 2), 16, 10).cast("int")
    touched = bucket % 30 >= 29
    return {
        "open_gap_pct": (bucket % 7).cast("double"),
        "intraday_high_return_pct": (bucket % 30).cast("double"),
        "close_return_pct": (bucket % 15).cast("double"),
        "upper_limit_touched": touched,
        "upper_limit_closed": touched & (bucket % 2 == 0),
        "upper_limit_released": touched & (bucket % 2 == 1),
        "one_price_upper_limit": F.lit(False),
        "volume": (bucket * 1000).cast("double"),
        "amount": (bucket * 10000).cast("double"),
        "turnover_ratio": (bucket % 20).cast("double"),
        "market_cap_previous_close": (bucket * 1000000).cast("double"),
    }
