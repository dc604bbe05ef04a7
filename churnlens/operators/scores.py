"""Column scores against a binary label.

Every score is a handful of SQL aggregates: one wide aggregate pass over the
rows (partial aggregation on the map side) produces a table of
(class x column) moments with a few dozen rows; the score formula then runs
on that tiny table.  Only the rank-based scores (MIC, binned MI) need the
distinct values of a column, and those come from the range-partitioned rank
helper, not from a single sorted task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.functions.ranking import rank_within
from churnlens.session import ship_package

LN2 = 0.6931471805599453
GRID_RANKS = 65_536  # ranks of a column that one task cuts into bins at a time


def _q(c: str):
    return F.col(f"`{c}`")


def _stack(df: DataFrame, names, cols_of, extra=()) -> DataFrame:
    """Unpivot a one-row-per-group frame into (group..., feature, values...)."""
    parts = []
    for i, n in enumerate(names):
        lit = n.replace("\\", "\\\\").replace("'", "\\'")
        parts.append(f"'{lit}', " + ", ".join(f"`{c}`" for c in cols_of(i)))
    width = len(cols_of(0))
    outs = ", ".join(["feature"] + [f"v{j}" for j in range(width)])
    return df.selectExpr(*extra, f"stack({len(names)}, {', '.join(parts)}) as ({outs})")


def variance_scores(df: DataFrame, cols) -> DataFrame:
    """(feature, variance): population variance per column."""
    cols = list(cols)
    wide = df.agg(*[F.var_pop(_q(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)])
    return _stack(wide, cols, lambda i: [f"s{i}"]).select("feature", F.col("v0").alias("variance"))


def select_by_variance(df: DataFrame, cols, threshold: float) -> list[str]:
    """Columns whose population variance is above ``threshold`` (a small list)."""
    return [r.feature for r in variance_scores(df, cols).where(F.col("variance") > threshold).collect()]


def _class_moments(df: DataFrame, cols, label: str) -> DataFrame:
    """(feature, class, n, sum, var_pop) from one grouped pass."""
    cols = list(cols)
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(cols):
        x = _q(c).cast("double")
        aggs += [F.sum(x).alias(f"s{i}"), F.var_pop(x).alias(f"v{i}")]
    per_class = df.groupBy(_q(label).alias("_y")).agg(*aggs)
    return _stack(per_class, cols, lambda i: [f"s{i}", f"v{i}"], extra=["_y", "n"]) \
        .select("feature", "_y", "n", F.col("v0").alias("sum"), F.col("v1").alias("var_pop"))


def chi2_scores(df: DataFrame, cols, label: str) -> DataFrame:
    """(feature, chi2): with class sums O_c, class counts n_c and
    E_c = sum(x) * n_c / n, chi2 = sum_c (O_c - E_c)^2 / E_c (non-negative x).  A column
    that is zero throughout has a null score."""
    m = _class_moments(df, cols, label)
    tot = m.groupBy("feature").agg(F.sum("n").alias("_tot_n"), F.sum("sum").alias("_tot_s"))
    e = m.join(tot, "feature").withColumn("_exp", F.col("_tot_s") * F.col("n") / F.col("_tot_n"))
    return e.groupBy("feature").agg(
        F.sum(F.try_divide((F.col("sum") - F.col("_exp")) ** 2, F.col("_exp"))).alias("chi2"))


def f_scores(df: DataFrame, cols, label: str) -> DataFrame:
    """(feature, f_score): one-way ANOVA F of the column across the classes,
    [sum n_c (m_c - m)^2 / (C - 1)] / [sum n_c var_c / (N - C)].  Null when the
    column does not vary inside any class (constant or perfectly separating)."""
    m = _class_moments(df, cols, label).withColumn("mean", F.col("sum") / F.col("n"))
    tot = m.groupBy("feature").agg(F.sum("n").alias("_tot_n"), F.sum("sum").alias("_tot_s"),
                                   F.count(F.lit(1)).alias("_k"))
    j = m.join(tot, "feature").withColumn("gm", F.col("_tot_s") / F.col("_tot_n"))
    return j.groupBy("feature").agg(
        F.try_divide(
            F.try_divide(F.sum(F.col("n") * (F.col("mean") - F.col("gm")) ** 2), F.first("_k") - 1),
            F.try_divide(F.sum(F.col("n") * F.col("var_pop")), F.first("_tot_n") - F.first("_k"))).alias("f_score"))


def _value_table(df: DataFrame, cols, label: str, id_col: str) -> DataFrame:
    """Per (feature, distinct value): rows below it, rows at it, positives at it, n."""
    cols = list(cols)
    long = df.select(_q(id_col).alias("_id"), _q(label).cast("double").alias("_y"),
                     *[_q(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    long = _stack(long, cols, lambda i: [f"c{i}"], extra=["_id", "_y"]).withColumnRenamed("v0", "x")
    ranks = rank_within(long.select("feature", "x", "_id"), ["feature"], "x", "_id")
    pos = long.groupBy("feature", "x").agg(F.sum("_y").alias("n1"))
    return ranks.join(pos, ["feature", "x"])


def _binned_mi(vals: DataFrame, bins_col) -> DataFrame:
    """Plug-in mutual information (bits) between equal-frequency bins and label.

    ``vals`` has feature, b (bins), bin, _w (rows), n1 (positives), _n (rows of
    the feature).
    """
    cell = vals.groupBy("feature", "b", "bin").agg(
        F.sum("_w").alias("nb"), F.sum("n1").alias("nb1"), F.first("_n").alias("_rows"))
    tot = cell.groupBy("feature", "b").agg(F.sum("nb1").alias("_pos"))
    c = cell.join(tot, ["feature", "b"])
    N, nb, nb1, P = F.col("_rows"), F.col("nb"), F.col("nb1"), F.col("_pos")
    nb0, P0 = nb - nb1, N - P

    def term(nxy, nx, ny):
        return F.when(nxy > 0, nxy / N * F.log(nxy * N / (nx * ny)))

    t = F.coalesce(term(nb1, nb, P), F.lit(0.0)) + F.coalesce(term(nb0, nb, P0), F.lit(0.0))
    return c.groupBy("feature", "b").agg((F.sum(t) / F.lit(LN2)).alias("mi"))


def mic_scores(df: DataFrame, cols, label: str, id_col: str) -> DataFrame:
    """(feature, mic): grid approximation of the maximal information coefficient.

    For b = 2 .. floor(n^0.6 / 2) the column is cut into b
    equal-frequency bins (ties stay together: bin = floor(rank * b / n)) and the
    mutual information with the binary label is taken in bits; the score is the
    maximum over b.  It is a lower bound of the exact MIC (which also searches
    unequal bin edges).
    """
    v = _value_table(df, cols, label, id_col)
    return grid_mi(v).groupBy("feature").agg(F.max("mi").alias("mic"))


def _terms(nb: np.ndarray, nb1: np.ndarray, rows: int, pos: float) -> np.ndarray:
    """What cells of ``nb`` rows and ``nb1`` positives add to the mutual information, in nats."""
    out = np.zeros(len(nb))
    for n, of in ((nb1, pos), (nb - nb1, rows - pos)):
        some = n > 0
        out[some] += n[some] / rows * np.log(n[some] * rows / (nb[some] * of))
    return out


def _grid_part(part: pd.DataFrame) -> pd.DataFrame:
    """One stretch of a column's values cut into b bins for every b: per b the sum of the cells
    inside (bin -1) and the two cells that may go on in the next stretches."""
    part = part.sort_values("_rank_lt")
    rank = part["_rank_lt"].to_numpy(np.int64)
    # Rows and positives before each value, and behind the last.
    below, pos_below = (np.concatenate([[0.0], part[c].to_numpy(float).cumsum()]) for c in ("_w", "n1"))
    rows, pos = int(part["_n"].iloc[0]), float(part["_pos"].iloc[0])
    out = []
    for b in range(2, max(2, int(part["_b_hi"].iloc[0])) + 1):
        first, last = int(rank[0] * b // rows), int(rank[-1] * b // rows)
        if last - first < len(rank):
            # A bin begins at the first value whose rank reaches bin * n / b.
            start = np.searchsorted(rank, -(-np.arange(first + 1, last + 1) * rows // b))
            start = np.unique(np.concatenate([[0], start]))
        else:
            start = np.flatnonzero(np.diff(rank * b // rows, prepend=-1))
        ends = np.append(start[1:], len(rank))
        nb, nb1 = below[ends] - below[start], pos_below[ends] - pos_below[start]
        if len(nb) > 2:
            out.append((b, -1, 0.0, 0.0, float(_terms(nb[1:-1], nb1[1:-1], rows, pos).sum())))
        for k in sorted({0, len(nb) - 1}):
            out.append((b, int(rank[start[k]] * b // rows), nb[k], nb1[k], 0.0))
    found = pd.DataFrame(out, columns=["b", "bin", "nb", "nb1", "inside"])
    return found.assign(feature=part["feature"].iloc[0], _rows=rows, _pos=pos)


def grid_mi(vals: DataFrame, ranks: int = GRID_RANKS) -> DataFrame:
    """(feature, b, mi) in bits for every b = 2 .. floor(n^0.6 / 2), ``vals`` as in ``_binned_mi``
    with ``_rank_lt``.

    Values times bins would be n^1.6 rows.  A column's values are dealt by rank to stretches
    of ``ranks`` ranks instead; a task sums its stretch once and reads every bin off its
    edges.  Only the cells at the ends of a stretch meet again: two a b and stretch."""
    ship_package(vals.sparkSession)
    b_hi = F.floor(F.pow(F.col("_n"), 0.6) / 2).cast("int")
    pos = vals.groupBy("feature").agg(F.sum("n1").alias("_pos"))
    v = vals.join(F.broadcast(pos), "feature").select(
        "feature", "_rank_lt", "_w", F.coalesce("n1", F.lit(0.0)).alias("n1"), "_n", "_pos", b_hi.alias("_b_hi"), F.floor(F.col("_rank_lt") / ranks).alias("_part"))
    cells = v.groupBy("feature", "_part").applyInPandas(
        _grid_part, "b int, bin long, nb double, nb1 double, inside double, feature string, _rows long, _pos double")
    cells = cells.groupBy("feature", "b", "bin").agg(
        F.sum("nb").alias("nb"), F.sum("nb1").alias("nb1"), F.sum("inside").alias("inside"), F.first("_rows").alias("N"), F.first("_pos").alias("P"))

    def term(n, of):
        return F.coalesce(F.when(n > 0, n / F.col("N") * F.log(n * F.col("N") / (F.col("nb") * of))), F.lit(0.0))

    nats = F.col("inside") + term(F.col("nb1"), F.col("P")) + term(F.col("nb") - F.col("nb1"), F.col("N") - F.col("P"))
    return cells.groupBy("feature", "b").agg((F.sum(nats) / F.lit(LN2)).alias("mi"))


def mutual_info_scores(df: DataFrame, cols, label: str, id_col: str, bins: int = 16) -> DataFrame:
    """(feature, mi): plug-in MI in bits with ``bins`` equal-frequency bins."""
    v = _value_table(df, cols, label, id_col).withColumn("b", F.lit(bins))
    v = v.withColumn("bin", F.floor(F.col("_rank_lt") * F.col("b") / F.col("_n")))
    return _binned_mi(v, "bin").select("feature", "mi")


def top_k(scores: DataFrame, k: int, score_col: str, name_col: str = "feature") -> DataFrame:
    """The k best rows by score (ties: smaller name first)."""
    return scores.orderBy(F.desc(score_col), F.asc(name_col)).limit(k)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """(col, count), most frequent first."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), F.col(f"`{col}`"))


def mean_scores(fold_scores: DataFrame, group_cols, value_cols) -> DataFrame:
    """Mean of per-fold scores per group."""
    return fold_scores.groupBy(*group_cols).agg(*[F.avg(c).alias(c) for c in value_cols])


def first_best(scores: DataFrame, key: str, value: str) -> DataFrame:
    """Row with the highest value; a tie goes to the smallest key (the
    reference's strict ``<`` keeps the first maximum)."""
    return scores.orderBy(F.desc(value), F.asc(key)).limit(1)
