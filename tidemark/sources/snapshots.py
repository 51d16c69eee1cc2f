"""Tables that change together: readers get all tables of one commit, or all of the one before.

A table is dealt into shards by a hash of its key, each shard a folder of Parquet files that never changes. A manifest names for every table the folders of its shards; the manifest with
the highest number is the commit that counts. A writer makes new folders for the shards that it changes and names the old ones for the rest, then writes its manifest: if it dies before that, its
folders are litter that ``vacuum`` removes, and readers see nothing of them.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHARD = "_shard"


class ConflictError(RuntimeError):
    """Another writer has committed since this one began."""


@dataclass
class Table:
    """A table of a commit: schema (JSON), key, shards (number: [folder, rows, fingerprint]) and how many shards it is dealt into."""

    schema: str
    key: str
    parts: int
    shards: dict[str, list] = field(default_factory=dict)


def shard_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(parts)).cast("int")


#: Types whose values are hashed as they are; others go by their JSON.
PLAIN = (T.BooleanType, T.NumericType, T.StringType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _hashed(schema: T.StructType) -> list[Column]:
    """What is hashed of a row, columns by name: xxhash64 passes over nulls and takes -0.0 for 0.0, so that both stand beside the value."""
    out = []
    for f in sorted(schema.fields, key=lambda f: f.name):
        c = F.col(f"`{f.name}`")
        if not isinstance(f.dataType, PLAIN):
            out.append(F.to_json(F.struct(c), {"ignoreNullFields": "false"}))
            continue
        out += [c, c.isNull()]
        if isinstance(f.dataType, T.FloatType | T.DoubleType):
            out.append(F.when(c == 0, c.cast("string")))
    return out


def fingerprint(schema: T.StructType) -> Column:
    """What rows hold in any order, 128 bits wide at least; equal tables have equal ones. Hashes are summed in halves, which a long holds for some billions of rows."""
    sums = []
    for seed in (1, 2):
        h = F.xxhash64(F.lit(seed), *_hashed(schema))
        sums += [F.try_sum(h.bitwiseAND(F.lit(0xFFFFFFFF))), F.try_sum(F.shiftright(h, 32))]
    return F.concat_ws("/", F.count(F.lit(1)).cast("string"), *[F.coalesce(s.cast("string"), F.lit("-")) for s in sums])


class Snapshots:
    """Commits below one folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, at: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(at)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifest(self, number: int) -> dict[str, Table] | None:
        text = self.spark.read.text(f"{self.root}/manifests/{number:012d}.json", wholetext=True).first()
        try:
            return {name: Table(**t) for name, t in json.loads(text[0])["tables"].items()}
        except (TypeError, KeyError, ValueError):  # its writer died while writing it
            return None

    def numbers(self) -> list[int]:
        fs, folder = self._fs(), self._path(f"{self.root}/manifests")
        return sorted(int(x.getPath().getName().split(".")[0]) for x in fs.listStatus(folder) if x.getPath().getName().endswith(".json")) if fs.exists(folder) else []

    def head(self) -> tuple[int, dict[str, Table]]:
        """The number and tables of the commit that counts; 0 and none before the first."""
        for number in reversed(self.numbers()):
            tables = self._manifest(number)
            if tables is not None:
                return number, tables
        return 0, {}

    def at(self, number: int | None = None) -> dict[str, Table]:
        tables = self.head()[1] if number is None else self._manifest(number)
        if tables is None:
            raise FileNotFoundError(f"{self.root} has no commit {number}")
        return tables

    def frame(self, table: Table, shards: list[int] | None = None) -> DataFrame:
        """The rows of a table, or of some of its shards."""
        schema = T.StructType.fromJson(json.loads(table.schema))
        paths = [p for s, (p, *_) in sorted(table.shards.items()) if shards is None or int(s) in set(shards)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, name: str, number: int | None = None) -> DataFrame:
        """A table of the last commit, or of an earlier one. A frame keeps to its commit, whatever is written meanwhile."""
        return self.frame(self.at(number)[name])

    def stage(self, name: str, rows: DataFrame, key: str, parts: int, old: Table | None = None, touched: list[int] | None = None) -> tuple[Table, list[int]]:
        """Writes the shards of ``rows`` and names those of ``old`` for the rest: the table, not committed yet, and the shards that are not as they were.

        touched: the only shards that ``rows`` are of; they are replaced. Without it all are. A shard whose rows are the same keeps its folder.
        """
        schema = rows.schema.json()
        same = old is not None and old.schema == schema and old.parts == parts and old.key == key
        folder = f"{self.root}/data/{name}/{uuid.uuid4().hex}"
        dealt = rows.withColumn(SHARD, shard_of(F.col(key), parts))
        # A shard with much of the rows is split over several tasks, and has several files.
        dealt.hint("rebalance", SHARD).write.partitionBy(SHARD).parquet(folder)
        made = self.spark.read.schema(T.StructType([*rows.schema.fields, T.StructField(SHARD, T.IntegerType())])).parquet(folder)
        # One row for each shard.
        prints = {str(r[SHARD]): r for r in made.groupBy(SHARD).agg(F.count(F.lit(1)).alias("n"), fingerprint(rows.schema).alias("f")).collect()}
        kept = dict(old.shards) if same and touched is not None else {}
        wanted = set(map(str, touched if touched is not None else range(parts)))
        changed = []
        for s in sorted(wanted, key=int):
            before = old.shards.get(s) if same else None
            if s in prints and before and before[2] == prints[s]["f"]:
                kept[s] = before
                continue
            if s in prints:
                kept[s] = [f"{folder}/{SHARD}={s}", prints[s]["n"], prints[s]["f"]]
            else:
                kept.pop(s, None)
            if s in prints or before:
                changed.append(int(s))
        return Table(schema, key, parts, kept), changed

    def commit(self, tables: dict[str, Table], base: int) -> int:
        """Makes ``tables`` the ones that count; ``base``: the commit that they were made from."""
        if self.head()[0] != base:
            raise ConflictError(f"{self.root}: commit {base} is not the last one")
        number = max([base, *self.numbers()]) + 1
        fs, target = self._fs(), self._path(f"{self.root}/manifests/{number:012d}.json")
        try:
            out = fs.create(target, False)  # an existing file is an error
        except Exception as e:
            raise ConflictError(f"{self.root}: commit {number} is taken") from e
        out.write(json.dumps({"tables": {n: vars(t) for n, t in tables.items()}}).encode())
        out.close()
        return number

    def publish(self, frames: dict[str, tuple[DataFrame, str]], parts: int) -> int:
        """All tables at once, each with its key; tables of the commit before that aren't named here stay."""
        base, old = self.head()
        new = {name: self.stage(name, rows, key, parts, old.get(name))[0] for name, (rows, key) in frames.items()}
        return self.commit(old | new, base)

    def vacuum(self, keep: int = 2) -> int:
        """Removes manifests but the last ``keep``, and folders of shards that none of those names. No writer may be at work. Returns the folders removed."""
        fs, numbers = self._fs(), [n for n in self.numbers() if self._manifest(n) is not None]
        left = numbers[-keep:]
        named = {p for n in left for t in self._manifest(n).values() for p, *_ in t.shards.values()}
        gone = 0
        for number in set(self.numbers()) - set(left):
            fs.delete(self._path(f"{self.root}/manifests/{number:012d}.json"), False)
        for table in fs.listStatus(self._path(f"{self.root}/data")) if fs.exists(self._path(f"{self.root}/data")) else []:
            for made in fs.listStatus(table.getPath()):
                shards = [x.getPath() for x in fs.listStatus(made.getPath()) if x.isDirectory()]
                used = [any(str(p).endswith(n.removeprefix(self.root)) for n in named) for p in shards]
                if not any(used):
                    gone += len(shards)
                    fs.delete(made.getPath(), True)
                else:
                    for path, kept in zip(shards, used, strict=True):
                        if not kept:
                            gone += 1
                            fs.delete(path, True)
        return gone
