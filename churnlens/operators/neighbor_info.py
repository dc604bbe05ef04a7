"""Nearest-neighbour mutual information of a column and a class.

For a row with value x in a class of n_c rows, r is the distance to its k-th nearest value
of the same class (k at most n_c - 1) and m the rows of any class inside (x - r, x + r),
those with the value x always included.  The score is, in nats,

    psi(n) + mean psi(k) - mean psi(n_c) - mean psi(m),     at least 0.

No bins are chosen and no pairs are formed.  In one dimension the k nearest of a class lie
within k places of the row in value order, so r comes from a window over slices of the
exact order, each with k rows of its neighbours.  m comes from merging the interval ends
with the values: an end's place among both, less its place among the ends, is the number
of values before it.  Both orders are range partitioned, so a class or a column that holds
most rows is many partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlens.functions.ranking import ordinal_within
from churnlens.operators.scores import _q, _stack
from churnlens.session import ensure_checkpoint_dir

SLICE_ROWS = 100_000
SHIFT = 8  # psi(x) from psi(x + SHIFT), where its series has converged


def digamma(x: Column) -> Column:
    """psi(x) for x of 1 or more, to about 1e-11."""
    z = x + F.lit(float(SHIFT))
    steps = reduce(lambda a, b: a + b, [F.lit(1.0) / (x + F.lit(float(i))) for i in range(SHIFT)])
    s = F.lit(1.0) / (z * z)
    series = s * (F.lit(1 / 12) - s * (F.lit(1 / 120) - s * (F.lit(1 / 252) - s * (F.lit(1 / 240) - s * F.lit(1 / 132)))))
    return F.log(z) - F.lit(0.5) / z - series - steps


def class_radii(long: DataFrame, k: int, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(feature, y, x, _w, _nc, _k, r): every distinct value of a class with its rows, the
    class's rows, the neighbours asked and the distance to the last of them.  A class of one
    row has none."""
    slice_rows = max(slice_rows, k)
    o = ordinal_within(long, ["feature", "y"], ["x", "id"], "_i", "_nc").where("_nc > 1")
    at, place = F.floor(F.col("_i") / slice_rows), F.col("_i") % slice_rows
    # The first k rows of a slice also end the one before, the last k begin the next.
    slices = F.array_compact(F.array(at, F.when((place < k) & (at > 0), at - 1), F.when(place >= slice_rows - k, at + 1)))
    o = o.withColumn("_own", at).withColumn("_slice", F.explode(slices))
    w = Window.partitionBy("feature", "y", "_slice").orderBy("_i")
    far = [F.abs(F.col("x") - f("x", j).over(w)) for f in (F.lag, F.lead) for j in range(1, k + 1)]
    o = (o.withColumn("_k", F.least(F.lit(k), F.col("_nc") - 1).cast("int")).withColumn("_far", F.array_sort(F.array_compact(F.array(*far))))
         .where(F.col("_slice") == F.col("_own")).withColumn("r", F.element_at("_far", F.col("_k"))))
    return o.groupBy("feature", "y", "x").agg(F.count(F.lit(1)).alias("_w"), F.first("_nc").alias("_nc"), F.first("_k").alias("_k"), F.first("r").alias("r"))


def _values_before(values: DataFrame, ends: DataFrame) -> DataFrame:
    """``ends`` (feature, v, kind, x, y) with ``_before``: the values below v (kinds -1 and 0)
    or up to v (kinds 2 and 3)."""
    rows = values.select("feature", F.col("x").alias("v"), F.lit(1).alias("kind"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), "id")
    none = F.lit(None).cast(dict(values.dtypes)["id"])
    marks = ends.select("feature", "v", "kind", "x", "y", none.alias("id"))
    order = ["v", "kind", "x", "y", "id"]
    among_all = ordinal_within(rows.unionByName(marks), ["feature"], order, "_all", "_n1").where("kind != 1")
    among_ends = ordinal_within(marks, ["feature"], order, "_ends", "_n2")
    key = ["feature", "kind", "x", "y"]
    return among_all.select(*key, "_all").join(among_ends.select(*key, "_ends"), key).withColumn("_before", F.col("_all") - F.col("_ends"))


def neighbor_info_scores(df: DataFrame, cols, label: str, id_col: str, k: int = 3, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(feature, mi): the score of every column, in nats.

    Rows whose label is null take no part, nor in a column's score those whose value is null
    or not finite, or whose class has no other row.  A column without rows left has no score.
    ``id_col`` is unique."""
    if k < 1:
        raise ValueError("one neighbour or more is needed")
    cols = list(cols)
    wide = df.where(_q(label).isNotNull()).select(_q(id_col).alias("id"), _q(label).cast("double").alias("y"),
                                                  *[_q(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    # Range partitions sample their rows first: each order and each join would build the table again.
    ensure_checkpoint_dir(df.sparkSession)
    wide = wide.checkpoint()
    # 0.0 + x: -0.0 and 0.0 are one value.
    long = (_stack(wide, cols, lambda i: [f"c{i}"], extra=["id", "y"]).withColumnRenamed("v0", "x")
            .where(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf"))).withColumn("x", F.lit(0.0) + F.col("x")))
    long = long.select("feature", "id", "y", "x")
    radii = class_radii(long, k, slice_rows).checkpoint()
    values = long.join(radii.select("feature", "y", "x"), ["feature", "y", "x"], "left_semi")
    key = ["feature", "x", "y"]
    # The value itself is inside, whatever rounding makes of the ends: an end that is the value
    # stands before it or behind it.
    below, above = F.col("x") - F.col("r"), F.col("x") + F.col("r")
    low = radii.select(*key, below.alias("v"), F.when(below < F.col("x"), F.lit(2)).otherwise(F.lit(-1)).alias("kind"))
    high = radii.select(*key, above.alias("v"), F.when(above > F.col("x"), F.lit(0)).otherwise(F.lit(3)).alias("kind"))
    ends = _values_before(values, low.unionByName(high))
    before = ends.groupBy(*key).agg(*[F.max(F.when(F.col("kind").isin(*kinds), F.col("_before"))).alias(n)
                                      for n, kinds in (("low", (-1, 2)), ("high", (0, 3)))])
    m = F.col("high") - F.col("low")
    w = F.col("_w")
    per = radii.join(before, key).withColumn("m", m.cast("double")).groupBy("feature").agg(
        F.sum(w).alias("n"), F.sum(w * digamma(F.col("_k").cast("double"))).alias("sk"),
        F.sum(w * digamma(F.col("_nc").cast("double"))).alias("sc"), F.sum(w * digamma(F.col("m"))).alias("sm"))
    n = F.col("n").cast("double")
    return per.select("feature", F.greatest(F.lit(0.0), digamma(n) + (F.col("sk") - F.col("sc") - F.col("sm")) / n).alias("mi"))
