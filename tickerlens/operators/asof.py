"""Forward as-of join: for each probe, the first tick at or after its time.

Spark has no public as-of join, and a bare range join is quadratic.  This is
the union form, made skew-safe by cutting time into cells:

1. probes and ticks are unioned and windowed per (key, cell), ordered by
   (time, side, tie) from the latest row down; the first tick row at or after
   each probe is ``last(..., ignorenulls)`` over ``unbounded preceding ..
   current row``, a running frame that costs one step per row.  Only ticks of
   cells that hold a probe are windowed.  A hot key is spread over many
   (key, cell) tasks.
2. probes whose cell holds no later tick take the first tick of the next
   non-empty cell, found on a one-row-per-(key, cell) table (small) built
   from the probes' own cells, so step 1 is computed once.

Both steps are exact; nothing is capped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def time_cell(ts: Column, cell_seconds: int) -> Column:
    """Cell index of an NTZ timestamp without any time-zone conversion."""
    secs = (F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint") * 86400
            + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts))
    return F.floor(secs / F.lit(cell_seconds)).cast("bigint")


def asof_forward(probes: DataFrame, ticks: DataFrame, key: str, probe_time: str,
                 tick_time: str, tick_tie: str, value: str,
                 cell_seconds: int = 86400) -> DataFrame:
    """Probes plus ``match_time``, ``match_id``, ``match_value`` of the first
    tick with ``tick_time >= probe_time`` for the same key (ties on time go
    to the smallest ``tick_tie``); NULLs when no such tick exists.

    ``probes`` must not contain columns named like the helper columns
    (``_t``, ``_side``, ``_cell``, ``_m``)."""
    pcols = probes.columns
    p = probes.select(
        F.col(key).alias("_k"), F.col(probe_time).alias("_t"),
        F.lit(0).alias("_side"), F.lit(None).cast("long").alias("_tie"),
        F.lit(None).cast("double").alias("_v"),
        F.struct(*[F.col(c) for c in pcols]).alias("_probe"))
    t = ticks.select(
        F.col(key).alias("_k"), F.col(tick_time).alias("_t"),
        F.lit(1).alias("_side"), F.col(tick_tie).cast("long").alias("_tie"),
        F.col(value).cast("double").alias("_v"),
        F.lit(None).cast(p.schema["_probe"].dataType).alias("_probe"))
    p = p.withColumn("_cell", time_cell(F.col("_t"), cell_seconds))
    t = t.withColumn("_cell", time_cell(F.col("_t"), cell_seconds))
    probed = p.select("_k", "_cell").distinct()
    u = p.unionByName(t.join(probed, ["_k", "_cell"], "left_semi").select(*p.columns))

    tick_struct = F.when(F.col("_side") == 1, F.struct(
        F.col("_t").alias("match_time"), F.col("_tie").alias("match_id"),
        F.col("_v").alias("match_value")))
    w = (Window.partitionBy("_k", "_cell")
         .orderBy(F.desc("_t"), F.desc("_side"), F.desc("_tie"))
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    in_cell = (u.withColumn("_m", F.last(tick_struct, ignorenulls=True).over(w))
               .filter(F.col("_side") == 0)
               .select("_k", "_cell", "_probe", "_m"))

    # first tick of every non-empty cell (one row per key and cell)
    cell_first = (t.groupBy("_k", "_cell")
                  .agg(F.min_by(F.struct(F.col("_t").alias("match_time"),
                                         F.col("_tie").alias("match_id"),
                                         F.col("_v").alias("match_value")),
                                F.struct("_t", "_tie")).alias("_f"))
                  .select("_k", "_cell", F.lit(0).alias("_side"), "_f"))
    probe_cells = probed.select("_k", "_cell", F.lit(1).alias("_side"),
                                F.lit(None).cast(cell_first.schema["_f"].dataType).alias("_f"))
    w2 = (Window.partitionBy("_k").orderBy(F.desc("_cell"), F.desc("_side"))
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    nxt = (cell_first.unionByName(probe_cells)
           .withColumn("_n", F.last("_f", ignorenulls=True).over(w2))
           .filter(F.col("_side") == 1)
           .select("_k", "_cell", "_n"))
    # a probe row at the same cell must not see that cell's own first tick:
    # probe-cell rows (side 1) come before cell rows (side 0) of their cell.

    out = in_cell.join(nxt, ["_k", "_cell"], "left").select(
        "_probe", F.coalesce(F.col("_m"), F.col("_n")).alias("_r"))
    return out.select(*[F.col("_probe")[c].alias(c) for c in pcols],
                      F.col("_r.match_time").alias("match_time"),
                      F.col("_r.match_id").alias("match_id"),
                      F.col("_r.match_value").alias("match_value"))
