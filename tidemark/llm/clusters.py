"""Components of a similarity graph from an index of shared keys, without all pairs of a group.

Rows that share a key are candidates. A group whose rows are already in one component needs no more comparisons: rounds of
stars compare every row with one centre of its group, the most typical row first, which joins groups of copies in a few
rows; groups that are in one component leave the index. The last round compares, exactly, all remaining candidates that are in
different components.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch
from tidemark.llm.components import connected_components

#: Rounds of stars at most; they end when less than this share of the rows asked found a link.
STARS, LITTLE = 6, 0.05
#: Bytes of a component's label in a broadcast, and of all of them.
LABEL_BYTES, BROADCAST = 64, 32 << 20


def labelled(rows: DataFrame, roots: DataFrame | None, id_col: str = "id", name: str = "comp") -> DataFrame:
    """``rows`` with the component of each id. roots: (node, root) of all nodes that are not their own root."""
    if roots is None:
        return rows.withColumn(name, F.col(id_col))
    own = roots.select(F.col("node").alias(id_col), F.col("root").alias("tidemark_root"))
    own = F.broadcast(own) if roots.count() * LABEL_BYTES <= BROADCAST else own
    return rows.join(own, id_col, "left").withColumn(name, F.coalesce("tidemark_root", id_col)).drop("tidemark_root")


def cluster(index: DataFrame, keys_of: DataFrame, verify: Callable[[DataFrame], DataFrame], scratch: Scratch, may: Callable, typical: str, links: DataFrame | None = None, roots: DataFrame | None = None, tried: DataFrame | None = None, least: int = 2, few: int = 1) -> DataFrame | None:
    """(node, root) for every id that is not the smallest of its component, None if there is no link.

    index: (key, id, ...), distinct in key and id; further columns are there for ``may(a, b)``, a condition on the columns
    ``a.*`` and ``b.*`` of a pair, symmetric, that is necessary for a link at the first key that both have. keys_of: (id, keys), all keys of each id
    in an order that all ids share. ``typical``: a column that is least for rows likely to be near many others of their groups. ``verify`` takes pairs
    (a, b), a < b, distinct, and returns those that link. links, tried: pairs (a, b), a < b, that are known already to link or not to; roots:
    the components of links. Keys of less than ``least`` rows make no pair that isn't known; keys of up to ``few`` rows get no star.
    """
    extra = [c for c in index.columns if c not in ("key", "id")]
    shared = index.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= least)
    index = scratch.save(index.join(shared, "key"), "index")
    pairs_of = lambda a, b: index.where("false").select(F.col("id").alias(a), F.col("id").alias(b))
    links = pairs_of("a", "b") if links is None else links
    tried = pairs_of("a", "b") if tried is None else tried

    def settle(pairs: DataFrame, name: str) -> int:
        nonlocal links, tried, roots
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
        pairs = scratch.save(pairs, f"pairs-{name}")
        found = scratch.save(verify(pairs).select("a", "b"), f"links-{name}")
        tried, links = tried.unionByName(pairs), links.unionByName(found)
        if more := found.count():
            roots = connected_components(links, scratch, f"cc-{name}-")
        return more

    def condition(a: str, b: str):
        side = lambda name: {c: F.col(f"{name}_{c}") for c in extra}
        return may(side(a), side(b))

    small, index, at = index.where(F.col("rows") <= few), index.where(F.col("rows") > few), None
    for star in range(STARS):
        rows = labelled(index, roots)
        # The first centre is the most typical row, which most copies of one original are near to; later ones are any rows.
        first = [] if star else [F.col(typical)]
        centre = F.min(F.struct(*[c.alias(f"first{k}") for k, c in enumerate(first)], F.xxhash64(F.lit(star), F.col("id")).alias("order"), "id", "comp", *extra)).alias("c")
        centres = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), centre).where("lo < hi")
        centres = scratch.save(centres.select("key", F.col("c.id").alias("y"), F.col("c.comp").alias("y_comp"), *[F.col(f"c.{c}").alias(f"y_{c}") for c in extra]), f"centres-{star}")
        if centres.limit(1).count() == 0:
            break
        asked = rows.select("key", "rows", F.col("id").alias("x"), F.col("comp").alias("x_comp"), *[F.col(c).alias(f"x_{c}") for c in extra]).join(centres, "key")
        asked = scratch.save(asked, f"rows-{star}")
        scratch.drop(f"centres-{star}", *[at] * (at is not None))
        # Two rows have been compared now, at the first key that both have.
        at, index = f"rows-{star}", asked.where("rows > 2").select("key", F.col("x").alias("id"), *[F.col(f"x_{c}").alias(c) for c in extra], "rows")
        found = settle(asked.where((F.col("x_comp") != F.col("y_comp")) & condition("x", "y")).select("x", "y"), f"star{star}")
        if found <= LITTLE * asked.select("x").distinct().count():
            break

    rows = labelled(small.select("key", "id", *extra).unionByName(index.select("key", "id", *extra)), roots)
    # Of each pair of a key one row at least is outside the key's largest component, so that such a component never meets itself.
    sizes = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max(F.struct("n", "comp"))["comp"].alias("main"), F.count(F.lit(1)).alias("comps")).where("comps > 1").select("key", "main")
    rows = scratch.save(rows.join(sizes, "key").join(keys_of, "id"), "mixed")
    scratch.drop("index", *[at] * (at is not None))
    side = lambda s: rows.select("key", F.col("comp").alias(f"{s}_comp"), F.col("id").alias(s), F.col("main").alias(f"{s}_main"), F.col("keys").alias(f"{s}_keys"), *[F.col(c).alias(f"{s}_{c}") for c in extra])
    others = side("x").where("x_comp <> x_main").drop("x_main")
    once = (F.col("x_comp") != F.col("y_comp")) & ((F.col("y_comp") == F.col("y_main")) | (F.col("x") < F.col("y")))
    # A pair is made at the first key that both have, and at no other.
    first = F.get(F.array_intersect("x_keys", "y_keys"), F.lit(0)) == F.col("key")
    pairs = others.join(side("y"), "key").where(once & condition("x", "y") & first)
    settle(pairs.select("x", "y"), "rest")
    scratch.drop("mixed")
    return roots
