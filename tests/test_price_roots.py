"""Roots of price shards: which one a ticker is read from, and what is never opened."""

from tidemark.sources import prices

ROW = "Date,Open,High,Low,Close,Volume,Turnover\n2024-01-0{},1,2,0.5,1.5,{},9\n"


def write(root, ticker, year, volume, prefix=None):
    path = root / (prefix or ticker[:3]) / ticker
    path.mkdir(parents=True, exist_ok=True)
    (path / f"{year}.csv").write_text(ROW.format(2, volume))


def made(tmp_path):
    roots = [tmp_path / n for n in ("calibration", "compat", "raw")]
    write(roots[0], "000001", 2023, 10)
    write(roots[1], "000001", 2022, 20)
    write(roots[1], "000001", 2023, 21)
    write(roots[1], "000002", 2023, 22)
    write(roots[2], "000003", 2021, 30)
    write(roots[2], "000003", "notes", 31)
    write(roots[2], "000004", 2021, 32, prefix="999")
    return [str(r) for r in roots]


def test_roots(spark, tmp_path):
    roots = made(tmp_path)
    shards = prices.listed_shards(spark, [*roots, str(tmp_path / "nowhere"), roots[0]])
    assert sorted((r["ticker"], r["year"], r["rank"]) for r in shards.collect()) == [("000001", 2022, 1), ("000001", 2023, 0), ("000001", 2023, 1), ("000002", 2023, 1), ("000003", 2021, 2)]
    assert sorted((r["ticker"], r["year"], r["rank"]) for r in prices.chosen_shards(shards).collect()) == [("000001", 2023, 0), ("000002", 2023, 1), ("000003", 2021, 2)]
    profiles = spark.createDataFrame([("000001", '{"available_years": [2020, "2023", "x", null, 2019.0]}'), ("000009", '{"available_years": 2020}'), ("000008", None)], "ticker string, profile string")
    assert {tuple(r) for r in prices.available_years(shards, profiles).collect()} == {("000001", y) for y in (2019, 2020, 2022, 2023)} | {("000002", 2023), ("000003", 2021)}
    # A shadowed file that cannot be read does no harm: it is not opened.
    shadowed = tmp_path / "compat" / "000" / "000001" / "2022.csv"
    shadowed.chmod(0)
    read = prices.read_roots(spark, roots, {"a": ["Turnover"]})
    assert {(r["ticker"], r["v"], r["a"]) for r in read.collect()} == {("000001", 10.0, 9.0), ("000002", 22.0, 9.0), ("000003", 30.0, 9.0)}
    files = {f.rsplit("/", 4)[-4] + "/" + f.rsplit("/", 1)[-1] for f in read.inputFiles()}
    assert files == {"calibration/2023.csv", "compat/2023.csv", "raw/2021.csv"}
    assert prices.read_roots(spark, [str(tmp_path / "nowhere")]).collect() == []


def test_status(spark, tmp_path):
    made(tmp_path)
    schema = {"fields": ["Date", "Open", "High", "Low", "Close"], "raw_shard_root": "raw", "compat_shard_root": "gone"}
    good = prices.source_status(spark, schema, {}, str(tmp_path))
    assert good["status"] == "ok" and good["roots"]["raw_shard_root"]["exists"] and not good["roots"]["compat_shard_root"]["exists"]
    assert prices.source_status(spark, schema | {"fields": ["Date", "Close"]}, {}, str(tmp_path))["missing"] == ["high", "low", "open"]
    assert prices.source_status(spark, schema | {"raw_shard_root": "gone"}, {}, str(tmp_path))["status"] == "attention"
    assert prices.source_status(spark, schema, None, str(tmp_path))["status"] == prices.source_status(spark, None, {}, str(tmp_path))["status"] == "attention"
