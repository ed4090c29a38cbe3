"""Exact ``rank()`` / ``row_number()`` within groups that may be very large.

``Window.partitionBy(g)`` sends every row of a group to one task, so a sector
holding a third of all REITs (or a global ranking with no group at all) would
be sorted by a single task.  Here the rows are range-partitioned on
``(group, order keys)`` instead: the range partitioner samples the keys and
splits a hot group over many partitions, while equal keys always land in the
same partition (so ties never straddle a boundary).  Each partition ranks its
slice locally, and a small table of per-partition counts supplies the offset of
every slice within its group:

    rank = rows of the same group in earlier partitions + local rank

The counts table has at most (partitions + groups) rows.

Range bounds are sampled each time a plan runs, so the assignment of rows to
partitions is written to the shared checkpoint folder once, partition number
included, and both the ranks and the counts are read from that copy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reitlens.session import ensure_checkpoint_dir

def _fixed(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """``df`` in ``n`` ranges with the range's number, stored so that every reader sees the same assignment."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.repartitionByRange(n, *order).withColumn(_PID, F.spark_partition_id()).checkpoint()


_PID, _LOCAL, _OFF, _CNT = "_rk_pid", "_rk_local", "_rk_off", "_rk_cnt"


def rank_within(df: DataFrame, groups: Sequence[str], order: Sequence[Column], out: str,
                method: str = "rank", partitions: int | None = None) -> DataFrame:
    """Add ``out`` = rank()/row_number() of each row within ``groups`` by ``order``.

    ``order`` are sort expressions (``F.col(x).desc()`` …).  With ``method="rank"``
    ties share the smallest rank; with ``"row_number"`` the order must be total.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    gcols = [F.col(g) for g in groups]
    ranged = _fixed(df, n, *gcols, *order)
    fn = F.rank() if method == "rank" else F.row_number()
    w_local = Window.partitionBy(_PID, *groups).orderBy(*order)
    local = ranged.withColumn(_LOCAL, fn.over(w_local))
    counts = local.groupBy(_PID, *groups).agg(F.count(F.lit(1)).alias(_CNT))
    w_off = (Window.partitionBy(*groups).orderBy(_PID)
             .rowsBetween(Window.unboundedPreceding, -1))
    keys = [_PID, *groups]
    offsets = counts.select(*[F.col(k).alias(f"{k}__o") for k in keys],
                            F.coalesce(F.sum(_CNT).over(w_off), F.lit(0)).alias(_OFF))
    cond = [F.col(k).eqNullSafe(F.col(f"{k}__o")) for k in keys]
    joined = local.join(offsets, cond, "inner")
    return joined.select(*df.columns, (F.col(_OFF) + F.col(_LOCAL)).cast("int").alias(out))


def rank_stacked(rows: DataFrame, id_col: str, group: str, measures: Sequence[tuple[str, Column, Column]], partitions: int | None = None) -> DataFrame:
    """(id, <name> ...): per measure (name, value, whether a row takes part) the descending ``rank()`` of each row within its group, all from one range assignment.

    The values of all measures are stacked as (measure, group, value).  Rows are counted per distinct triple first (a partial
    aggregation, so a tie shared by a third of all rows becomes one row), the
    triples are put in ranges once, one pass of running counts numbers them, and
    the ranks are joined back and spread to a column per measure.
    ``rank = 1 + rows of the measure and group strictly ahead``; null values come
    last, and a row that takes no part has no rank.
    """
    spark = rows.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = [F.when(takes, F.struct(F.lit(i).alias("measure"), value.alias("value"))) for i, (_, value, takes) in enumerate(measures)]
    stacked = rows.select(F.col(id_col).alias("id"), F.col(group).alias("grp"), F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("m"))
    stacked = stacked.select("id", "grp", "m.measure", "m.value")
    keys = ["measure", "grp", "value"]
    order = [F.col("measure"), F.col("grp"), F.col("value").desc()]
    ranged = _fixed(stacked.groupBy(*keys).agg(F.count(F.lit(1)).alias(_CNT)), n, *order)
    before = Window.partitionBy(_PID, "measure", "grp").orderBy(F.col("value").desc()).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn(_LOCAL, F.coalesce(F.sum(_CNT).over(before), F.lit(0)))
    # at most (partitions + measures * groups) rows
    totals = ranged.groupBy(_PID, "measure", "grp").agg(F.sum(_CNT).alias("total"))
    earlier = Window.partitionBy("measure", "grp").orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col(_PID).alias("o_pid"), F.col("measure").alias("o_measure"), F.col("grp").alias("o_grp"), F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias(_OFF))
    same = (F.col(_PID) == F.col("o_pid")) & (F.col("measure") == F.col("o_measure")) & F.col("grp").eqNullSafe(F.col("o_grp"))
    ranked = local.join(offsets, same).select(*[F.col(k).alias(f"r_{k}") for k in keys], (F.col(_OFF) + F.col(_LOCAL) + 1).cast("int").alias("rank"))
    back = stacked.join(ranked, (F.col("measure") == F.col("r_measure")) & F.col("grp").eqNullSafe(F.col("r_grp")) & F.col("value").eqNullSafe(F.col("r_value")))
    return back.groupBy("id").agg(*[F.max(F.when(F.col("measure") == i, F.col("rank"))).alias(name) for i, (name, _, _) in enumerate(measures)]).withColumnRenamed("id", id_col)


def rank_collapsing_ties(df: DataFrame, groups: Sequence[str], keys: Sequence[tuple[str, bool]],
                         out: str, partitions: int | None = None) -> DataFrame:
    """``rank()`` within ``groups`` by ``keys`` [(column, ascending)], ties collapsed first.

    Rows are first counted per distinct (group, key) value (a partial
    aggregation, so a tie shared by a third of all rows becomes one row), the
    distinct values are ranked with running sums of those counts, and the ranks
    are joined back.  ``rank = 1 + rows of the group strictly ahead``, NULLs
    ordered as ``Window`` orders them (first ascending, last descending).
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kcols = [k for k, _ in keys]
    order = [F.col(k).asc() if asc else F.col(k).desc() for k, asc in keys]
    counts = df.groupBy(*groups, *kcols).agg(F.count(F.lit(1)).alias(_CNT))
    ranged = _fixed(counts, n, *[F.col(g) for g in groups], *order)
    before = (Window.partitionBy(_PID, *groups).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    local = ranged.withColumn(_LOCAL, F.coalesce(F.sum(_CNT).over(before), F.lit(0)))
    totals = local.groupBy(_PID, *groups).agg(F.sum(_CNT).alias("_rk_tot"))
    w_off = (Window.partitionBy(*groups).orderBy(_PID)
             .rowsBetween(Window.unboundedPreceding, -1))
    pk = [_PID, *groups]
    offsets = totals.select(*[F.col(k).alias(f"{k}__o") for k in pk],
                            F.coalesce(F.sum("_rk_tot").over(w_off), F.lit(0)).alias(_OFF))
    ranked = (local.join(offsets, [F.col(k).eqNullSafe(F.col(f"{k}__o")) for k in pk], "inner")
              .select(*[F.col(c).alias(f"{c}__r") for c in (*groups, *kcols)],
                      (F.col(_OFF) + F.col(_LOCAL) + 1).cast("int").alias(out)))
    cond = [F.col(c).eqNullSafe(F.col(f"{c}__r")) for c in (*groups, *kcols)]
    return (df.join(ranked, cond, "inner")
            .drop(*[f"{c}__r" for c in (*groups, *kcols)]))
