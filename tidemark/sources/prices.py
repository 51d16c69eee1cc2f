"""Price shards: CSV files by ticker prefix with aliased headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numbers import parse_number

#: Header names of each field, letters and digits alone; they are tried in alphabetical order.
FIELDS = {
    "trade_date": ("d", "date", "tradedate"),
    "o": ("o", "open", "openprice"),
    "h": ("h", "high", "highprice"),
    "l": ("l", "low", "lowprice"),
    "c": ("c", "close", "closeprice"),
    "v": ("v", "vol", "volume"),
    "a": ("a", "amount", "tradingvalue", "value"),
    "mc": ("marcap", "marketcap", "mc"),
    "s": ("listedshares", "s", "shares", "stocks"),
}


#: Columns of a file that are looked at.
COLUMNS = 64


def read_prices(spark: SparkSession, root: str) -> DataFrame:
    """All shards below ``root``/prefix/ticker/year.csv as ticker, trade_date, o, h, l, c, v, a, mc, s.

    One scan, whatever the headers: a file, a year of one ticker, is a row that is split by the executor that reads it. The first ten characters of a date
    count; rows whose date doesn't parse, and files that aren't UTF-8, are left out. Of a field's aliases the first that isn't blank decides.
    """
    return _parsed(spark.read.format("binaryFile").load(f"{root}/*/*/*.csv"), FIELDS)


#: Fields that a price source must declare, and where roots are named, the best first.
REQUIRED = ("close", "date", "high", "low", "open")
ROOTS = ("calibration_shard_root", "compat_shard_root", "raw_shard_root")
SHARD = r"/(\d{3})/(\d{6})/(\d{1,9})\.csv$"


def listed_shards(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(ticker, year, rank, path) of the shards below the roots, the first root of rank 0, by their names alone: no file is opened. Roots that are not there have none; files
    whose names are no shard's, or whose prefix is not the ticker's, are left out."""
    out = None
    for rank, root in enumerate(dict.fromkeys(r.rstrip("/") for r in roots)):
        folder = spark._jvm.org.apache.hadoop.fs.Path(root)
        found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/*/*/*.csv"))
        if not found:
            continue
        rows = spark.read.format("binaryFile").load(f"{root}/*/*/*.csv").select("path", F.lit(rank).alias("rank"))
        out = rows if out is None else out.unionByName(rows)
    out = spark.createDataFrame([], "path string, rank int") if out is None else out
    part = lambda k: F.regexp_extract("path", SHARD, k)
    named = out.select(part(2).alias("ticker"), part(3).try_cast("int").alias("year"), "rank", "path", part(1).alias("prefix"))
    return named.where("year is not null and prefix = substr(ticker, 1, 3)").drop("prefix")


def profile_years(profiles: DataFrame) -> DataFrame:
    """(ticker, year) that profiles (ticker, profile: JSON) claim in ``available_years``: numbers, or numbers as text; anything else is no year."""
    years = F.from_json(F.get_json_object("profile", "$.available_years"), "array<string>")
    return profiles.select("ticker", F.explode(years).alias("y")).select("ticker", F.trim("y").try_cast("double").cast("int").alias("year")).where("year is not null").distinct()


def available_years(shards: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """(ticker, year) that a profile claims or any root has."""
    found = shards.select("ticker", "year")
    return (found if profiles is None else found.unionByName(profile_years(profiles))).distinct()


def chosen_shards(shards: DataFrame) -> DataFrame:
    """Of each ticker the shards of the best root that has any of its."""
    best = shards.groupBy("ticker").agg(F.min("rank").alias("rank"))
    return shards.join(best, ["ticker", "rank"])


def read_roots(spark: SparkSession, roots: list[str], aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """The prices of every ticker from the best root that has it, as ``read_prices`` gives them; shadowed files are not opened.

    aliases: more header names for fields. Paths of chosen files come to the driver, whose file index holds all paths anyway.
    """
    chosen = chosen_shards(listed_shards(spark, roots))
    paths = sorted(r["path"] for r in chosen.select("path").toLocalIterator())
    fields = {f: tuple(sorted({*names, *[_plain(a) for a in (aliases or {}).get(f, [])]})) for f, names in FIELDS.items()}
    if not paths:
        return _parsed(spark.createDataFrame([], "path string, content binary"), fields)
    return _parsed(spark.read.format("binaryFile").load(paths), fields)


def _plain(name: str) -> str:
    return "".join(c for c in name.lower() if c.isalnum())


def source_status(spark: SparkSession, schema: dict | None, manifest: dict | None, root: str) -> dict:
    """Whether prices can be read: a manifest and a schema that declares the fields of REQUIRED by any alias, and at least one root that is there."""
    schema = schema or {}
    declared = set()
    for name in {str(c) for c in schema.get("fields", [])} | {str(c) for c in schema.get("raw_shard_columns", {})}:
        declared |= {long for long, short in zip(("date", "open", "high", "low", "close"), ("trade_date", "o", "h", "l", "c"), strict=True) if _plain(name) in FIELDS[short]}
    paths = {}
    for key in ROOTS:
        configured = schema.get(key)
        path = None if configured is None else str(configured) if "://" in str(configured) or str(configured).startswith("/") else f"{root.rstrip('/')}/{configured}"
        at = None if path is None else spark._jvm.org.apache.hadoop.fs.Path(path)
        paths[key] = {"path": path, "exists": at is not None and bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at))}
    missing = sorted(set(REQUIRED) - declared)
    readable = any(p["exists"] for p in paths.values())
    return {"status": "ok" if schema and manifest is not None and not missing and readable else "attention", "declared": sorted(declared), "missing": missing, "roots": paths, "readable": readable}


def _parsed(files: DataFrame, fields: dict[str, tuple[str, ...]]) -> DataFrame:
    files = files.select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("text")).where("text is not null")
    lines = F.filter(F.split(F.regexp_replace("text", "^\ufeff", ""), "\r?\n"), lambda x: F.trim(x) != "")
    cells = lambda line: F.from_csv(line, ", ".join(f"c{k} string" for k in range(COLUMNS)))
    listed = lambda row: F.array(*[F.col(f"{row}.c{k}") for k in range(COLUMNS)])
    raw = files.select(F.regexp_extract("path", r"/(\d{6})/[^/]+$", 1).alias("ticker"), lines.alias("lines"))
    raw = raw.withColumn("head", cells(F.get("lines", F.lit(0)))).withColumn("line", F.explode(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))))
    named = F.transform(listed("head"), lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", ""))
    rows = raw.select("ticker", named.alias("head"), cells(F.col("line")).alias("row")).select("ticker", "head", listed("row").alias("row"))

    def field(name: str) -> list[Column]:
        return [F.get("row", F.array_position("head", F.lit(a)).cast("int") - 1) for a in fields[name]]

    day = F.coalesce(*[F.nullif(c, F.lit("")) for c in field("trade_date")])
    rows = rows.select("ticker", F.substring(day, 1, 10).try_cast("date").alias("trade_date"), *[parse_number(*field(f)).alias(f) for f in fields if f != "trade_date"])
    return rows.where("trade_date is not null")
