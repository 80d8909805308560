"""Exact rank inside a group without a one-task window per group.

``row_number() over (partition by g order by o)`` sends each group to one
task; a group holding a third of the data is then one task.  Here the order
is cut into *cells* by an expression that is monotone in the ordering (a
hash prefix, a time bucket).  The rank is the ``row_number`` inside
(group, cell) plus the number of rows in the group's earlier cells.  The
offsets come from a (group, cell) count table, one row per cell.  That table
is force-broadcast only when the caller vouches that the group domain is
bounded by configuration (``broadcast_offsets=True``, e.g. class labels);
otherwise it is a plain equi-join and AQE converts it to a broadcast join at
run time only if the materialised table is under the broadcast threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distributed_rank(df: DataFrame, group: Sequence[str], cell: Column,
                     order: Sequence[Column], out: str = "rank",
                     cell_desc: bool = False, broadcast_offsets: bool = False,
                     with_counts: bool = False):
    """Add ``out`` = 0-based position of each row inside ``group`` by
    ``order``.  ``cell`` must be monotone with ``order`` (ascending, or
    descending with ``cell_desc=True``) and NULL cells sort last.

    With ``with_counts=True`` the (group, ``_cell``, ``_cn``) count table is
    returned too, so a caller that needs per-group totals aggregates it
    instead of reading ``df`` once more (the shared count exchange is then
    reused by the planner)."""
    g = list(group)
    x = df.withColumn("_cell", cell)
    counts = x.groupBy(*g, "_cell").agg(F.count(F.lit(1)).alias("_cn"))
    cell_order = (F.col("_cell").desc_nulls_last() if cell_desc
                  else F.col("_cell").asc_nulls_last())
    offs = counts.withColumn("_off", F.coalesce(F.sum("_cn").over(
        Window.partitionBy(*g).orderBy(cell_order)
        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_cn")
    keys = g + ["_cell"]
    renamed = offs.withColumnsRenamed({c: f"_o_{c}" for c in keys})
    if broadcast_offsets:
        w = Window.partitionBy(*keys).orderBy(*order)
        ranked = x.withColumn("_rn", F.row_number().over(w) - 1)
        # null-safe equality: a NULL cell (or group value) is a real cell here
        joined = ranked.join(F.broadcast(renamed), [ranked[c].eqNullSafe(F.col(f"_o_{c}")) for c in keys])
    else:
        # the cell as one struct, never NULL itself: window and join ask for the
        # same partitioning, so the rows are shuffled once
        w = Window.partitionBy("_key").orderBy(*order)
        ranked = x.withColumn("_key", F.struct(*keys)).withColumn("_rn", F.row_number().over(w) - 1)
        renamed = renamed.select(F.struct(*[F.col(f"_o_{c}").alias(c) for c in keys]).alias("_o_key"), "_off")
        joined = ranked.join(renamed, F.col("_key") == F.col("_o_key"))
    result = (joined.withColumn(out, F.col("_rn") + F.col("_off"))
              .drop("_cell", "_key", "_rn", "_off", "_o_key", *[f"_o_{c}" for c in keys]))
    return (result, counts) if with_counts else result
