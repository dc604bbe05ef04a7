"""Exact, skew-safe ranking helpers.

``row_number() over (partition by g order by k)`` sends a whole group to one
task, and without ``partition by`` the whole table.  The helpers here get the
same numbers without that bottleneck:

1. ``repartitionByRange(P, g, k)`` splits the key space into P balanced ranges,
   so a hot group is spread over many partitions;
2. inside each (sorted) partition ``monotonically_increasing_id`` numbers the
   rows in order (the id is ``partition << 33 | row``);
3. a tiny table of (partition, group) -> (first local row, count) - at most
   P x G rows - gives each partition's offset inside its group by a prefix sum;
4. offset + local position = the exact index inside the group.

The numbered frame is checkpointed (reliable checkpoint in
``spark.checkpoint.dir``) so that a re-run after a lost executor sees the same
partitioning as the offset table.  The order keys must be a total order
(include a unique id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens.session import ensure_checkpoint_dir


def ordinal_within(df: DataFrame, group_cols, order_cols, index_col: str = "_idx",
                   size_col: str = "_n", num_partitions: int | None = None) -> DataFrame:
    """Add the 0-based position of each row inside its group, and the group size.

    Equal to ``row_number() over (partition by group_cols order by order_cols) - 1``
    and ``count(*) over (partition by group_cols)``.
    """
    group_cols = list(group_cols)
    order_cols = list(order_cols)
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    keys = group_cols + order_cols
    pid = F.spark_partition_id()
    numbered = (
        # Without a count, adaptive execution sizes the partitions.
        (df.repartitionByRange(num_partitions, *keys) if num_partitions else df.repartitionByRange(*keys))
        .sortWithinPartitions(*keys)
        .withColumn("_pid", pid)
        .withColumn("_local", F.monotonically_increasing_id() - F.shiftleft(pid.cast("long"), 33))
    ).checkpoint(eager=True)

    gkeys = [f"_g{i}" for i in range(len(group_cols))]
    stats = numbered.groupBy("_pid", *[F.col(c).alias(g) for c, g in zip(group_cols, gkeys)]).agg(
        F.min("_local").alias("_first"), F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy(*gkeys).orderBy("_pid") if gkeys else Window.orderBy("_pid")
    stats = (stats
             .withColumn("_off", F.coalesce(
                 F.sum("_cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
             .withColumn(size_col, F.sum("_cnt").over(
                 w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
             .drop("_cnt").withColumnRenamed("_pid", "_part"))
    on = numbered["_pid"] == stats["_part"]
    for c, g in zip(group_cols, gkeys):
        on = on & numbered[c].eqNullSafe(stats[g])
    joined = numbered.join(stats, on, "inner")
    out_cols = [numbered[c] for c in df.columns]
    return joined.select(
        *out_cols,
        (stats["_off"] + numbered["_local"] - stats["_first"]).alias(index_col),
        stats[size_col],
    )


def rank_within(df: DataFrame, group_cols, value_col: str, tiebreak_col: str,
                rank_col: str = "_rank_lt", size_col: str = "_n") -> DataFrame:
    """Per (group, value): number of rows of the group with a smaller value.

    Returns one row per distinct (group, value) with ``rank_col`` (= ``rank() - 1``
    under SQL's tie rule), the count of rows with that value (``_w``) and the
    group size.
    """
    o = ordinal_within(df.select(*group_cols, value_col, tiebreak_col), group_cols,
                       [value_col, tiebreak_col], "_i", size_col)
    return o.groupBy(*group_cols, value_col).agg(
        F.min("_i").alias(rank_col), F.count(F.lit(1)).alias("_w"), F.first(size_col).alias(size_col))


def exact_median(df: DataFrame, group_cols, value_col: str, tiebreak_col: str,
                 out_col: str = "median") -> DataFrame:
    """Exact median per group (mean of the two middle values for even sizes).

    Spark's ``median``/``percentile`` keeps a value map per group in one task;
    this form keeps only the middle rows and works for groups of any size.
    """
    group_cols = list(group_cols)
    o = ordinal_within(df.select(*group_cols, value_col, tiebreak_col), group_cols,
                       [value_col, tiebreak_col], "_i", "_n")
    lo = F.floor((F.col("_n") - 1) / 2)
    hi = F.ceil((F.col("_n") - 1) / 2)
    mid = o.where((F.col("_i") == lo) | (F.col("_i") == hi))
    agg = mid.groupBy(*group_cols).agg(
        F.min(value_col).alias("_lo"), F.max(value_col).alias("_hi"))
    # lo + (hi - lo) / 2: the interpolation both Spark's percentile and DuckDB use.
    return agg.select(*group_cols, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * 0.5).alias(out_col))
