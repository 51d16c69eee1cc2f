"""Tables derived from sources, kept up to date by what has changed.

Sources have a key and a content hash. A derived table is either *mapped* (rows made from each source or row by itself, which they name as their owner) or *grouped* (rows made from all
rows of a key). An update compares hashes, rewrites the shards of the first table that hold a changed key, and goes on from table to table with the keys whose rows differ;
shards that come out as they were stay, and nothing below them is looked at. All tables of an update are one commit.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.snapshots import Snapshots, fingerprint, shard_of
from tidemark.stages import Stages


@dataclass(frozen=True)
class Mapped:
    """``rows``: from rows of table ``of`` to rows with the column ``owner``, the key of the row that each is of; stored by ``key``."""

    name: str
    of: str
    owner: str
    key: str
    rows: Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Grouped:
    """``rows``: from all rows of some keys of table ``of``, which is stored by that key, to the rows of those keys."""

    name: str
    of: str
    key: str
    rows: Callable[[DataFrame], DataFrame]


def change_set(before: DataFrame, after: DataFrame, key: str, sha: str) -> DataFrame:
    """(key, status): added, changed or removed, by content hash; both (key, sha), a row a key."""
    old, new = before.select(key, F.col(sha).alias("_old"), F.lit(True).alias("_was")), after.select(key, F.col(sha).alias("_new"), F.lit(True).alias("_is"))
    status = F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return old.join(new, key, "full_outer").select(key, status.alias("status")).where("status is not null")


def _shards(rows: DataFrame, key: str, parts: int) -> list[int]:
    """The shards of some keys: at most ``parts`` numbers come to the driver."""
    return sorted(r[0] for r in rows.select(shard_of(F.col(key), parts)).distinct().collect())


def _per_key(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(fingerprint(rows.schema).alias("_print"))


def update(store: Snapshots, sources: DataFrame, steps: list[Mapped | Grouped], name: str = "sources", key: str = "key", sha: str = "sha", parts: int = 64) -> dict[str, list[int]]:
    """Brings the store to what ``sources`` hold now, and returns for each table the shards that were written anew.

    sources: all that there are, keys that are null left out, of a repeated key the row with the largest hash (equal hashes: any). steps in an order in which each table comes after the one it is of.
    The first update, or one with other columns or another number of shards, makes everything. The outcome is that of making everything.
    """
    spark = store.spark
    base, old = store.head()
    stages = Stages(spark, "update")
    others = [c for c in sources.columns if c != key]
    listed = sources.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*others), sha).alias("_r")).select(key, "_r.*").select(*sources.columns)
    listed = stages.save(listed, "listing")
    fresh = name not in old or old[name].schema != listed.schema.json() or old[name].parts != parts
    before = store.frame(old[name]) if not fresh else listed.limit(0)
    changes = {name: stages.save(change_set(before, listed, key, sha), "sources")}
    touched = _shards(changes[name], key, parts)
    new, written = dict(old), {}
    inside = shard_of(F.col(key), parts).isin(touched) if touched else F.lit(False)
    new[name], written[name] = store.stage(name, listed.where(inside), key, parts, None if fresh else old[name], None if fresh else touched)
    keys = {name: key}
    for step in steps:
        above, was = new[step.of], old.get(step.name)
        changed, of_key = changes.get(step.of), keys[step.of]
        keys[step.name] = step.key
        if isinstance(step, Mapped):
            stale = was is None or fresh
            if not stale:
                live = store.frame(above, _shards(changed.where("status <> 'removed'"), of_key, parts)).join(changed.where("status <> 'removed'").select(of_key), of_key, "left_semi")
                made = stages.save(step.rows(live), f"{step.name}-rows")
                owners = changed.where("status <> 'added'").select(F.col(of_key).alias(step.owner))
                stale = was.schema != made.schema.json() or was.parts != parts
            if stale:
                made = step.rows(store.frame(above))
                hit, rest = list(range(parts)), made.limit(0)
            else:
                # Which shards hold rows of owners that changed or went: two thin columns of the table are read for it.
                lost = store.frame(was).select(step.owner, step.key).join(owners, step.owner, "left_semi")
                hit = sorted(set(_shards(lost, step.key, parts)) | set(_shards(made, step.key, parts)))
                rest = store.frame(was, hit).join(owners, step.owner, "left_anti").select(*made.columns)
            rows = rest.unionByName(made)
        else:
            stale = was is None or fresh
            hit = list(range(parts)) if stale else written[step.of]
            rows = step.rows(store.frame(above, None if stale else hit))
            if not stale and was.schema != rows.schema.json():
                stale, hit, rows = True, list(range(parts)), step.rows(store.frame(above))
        new[step.name], written[step.name] = store.stage(step.name, rows, step.key, parts, None if stale else was, None if stale else hit)
        if not any(isinstance(s, Mapped) and s.of == step.name for s in steps):
            continue  # grouped tables go by shards
        # The keys whose rows are not as they were, for the tables below.
        both = [store.frame(t, written[step.name]) if t is not None else rows.limit(0) for t in (None if stale else was, new[step.name])]
        changes[step.name] = stages.save(change_set(*[_per_key(b, step.key) for b in both], step.key, "_print"), f"{step.name}-changes")
    store.commit(new, base)
    return written
