"""Connected components by alternating large-star and small-star steps.

Every step is a pre-aggregated minimum per node and a join, written below the
shared checkpoint folder, so a node with very many links is one partial
aggregate and a join that the planner may split.  The edge table never grows
and no group is collected; the loop ends when the edges no longer change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m"))
    low = low.select("a", F.least("a", "m").alias("m"))
    return (both.filter("b > a").join(low, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct())


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    j = down.join(low, "a")
    return (j.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count("*").alias("n"),
              F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return r["n"], r["x"]


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for every node that has an
    edge in ``edges(a bigint, b bigint)`` to another node."""
    e = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
               .filter("a <> b").distinct(), "edges")
    state = _state(e)
    while state[0]:
        e = stored(_small_star(_large_star(e)), "edges")
        state, before = _state(e), state
        if state == before:
            break
    members = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return members.union(roots).groupBy("node").agg(F.min("component").alias("component"))
