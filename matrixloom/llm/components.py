"""Connected components of a link table, distributed: alternating large-star and small-star (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, tidied

MAX_ROUNDS = 60


def _mark(edges: DataFrame) -> tuple:
    """A fingerprint of an edge set: its size and a sum of hashes."""
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())


def _large(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of u to the smallest of u and its neighbours."""
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Links u and its smaller neighbours to the smallest of them; edges come with u > v."""
    least = materialize(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    return edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component_id) for each id with a link to another: the smallest id reachable. Written to the shared folder.

    Each round costs a few shuffles of the links, whose number never grows. Least neighbours are summed before the shuffle and written
    before they are joined, so that a join has plain shuffles on both sides, and adaptive execution splits a hub's partition.
    """
    return tidied(links.sparkSession, lambda: _settled(links, a, b))


def _settled(links: DataFrame, a: str, b: str) -> DataFrame:
    pair = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = materialize(pair, "links")
    before = _mark(edges)
    for _ in range(MAX_ROUNDS if before[0] else 0):
        edges = materialize(_small(materialize(_large(edges), "stars")), "stars")
        after = _mark(edges)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return materialize(edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(edges.select("v", "v").distinct()), "components")


def extended(groups: DataFrame, links: DataFrame, a: str, b: str) -> DataFrame:
    """The components once more links are added: groups is what components() gave, and only their numbers take part again. Both are written tables."""
    return groups if links.isEmpty() else tidied(groups.sparkSession, lambda: _extended(groups, links, a, b))


def _extended(groups: DataFrame, links: DataFrame, a: str, b: str) -> DataFrame:
    of = lambda end: groups.select(F.col("id").alias(end), F.col("component_id").alias(f"{end}_c"))
    between = links.join(of(a), a, "left").join(of(b), b, "left").select(F.coalesce(f"{a}_c", a).alias("p"), F.coalesce(f"{b}_c", b).alias("q"))
    joined = components(between, "p", "q")
    moved = groups.join(joined.select(F.col("id").alias("component_id"), F.col("component_id").alias("_to")), "component_id", "left").select("id", F.coalesce("_to", "component_id").alias("component_id"))
    return materialize(moved.union(joined.join(groups.select("id"), "id", "left_anti")), "components")
