"""Holdout split and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.functions.columns import hash_u32
from churnlens.functions.ranking import ordinal_within


def split_flag(id_col: str, train: float = 0.7, seed: int = 0):
    """True for training rows: md5(seed:id) bucket below train * 1000."""
    return (hash_u32(F.lit(seed), F.col(id_col)) % 1000) < int(round(train * 1000))


def hash_split(df: DataFrame, id_col: str, train: float = 0.7, seed: int = 0):
    """Deterministic 70/30 split by md5 of (seed, id); same rows in any engine."""
    f = split_flag(id_col, train, seed)
    return df.where(f), df.where(~f)


def fold_of(index, size, k: int):
    """ntile rule: the first (n mod k) folds get one extra row (0-based)."""
    q = F.floor(size / k)
    r = size % k
    big = r * (q + 1)
    return F.when(index < big, F.floor(index / (q + 1))).otherwise(r + F.floor((index - big) / q)).cast("int")


def assign_folds(df: DataFrame, id_col: str, k: int = 5, by: str | None = None,
                 method: str = "exact", fold_col: str = "fold", seed: int = 0) -> DataFrame:
    """Unshuffled (stratified when ``by`` is given) k folds.

    ``exact``: contiguous blocks of the id order inside each class, as
    ``ntile(k) over (partition by by order by id) - 1`` - computed with the
    range-partition ordinal so no class lands in a single task.
    ``hash``: md5(seed:id) mod k - one narrow projection, roughly equal folds.
    """
    if method == "hash":
        return df.withColumn(fold_col, (hash_u32(F.lit(seed), F.lit("fold"), F.col(id_col)) % k).cast("int"))
    groups = [by] if by else []
    o = ordinal_within(df, groups, [id_col], "_i", "_n")
    return o.withColumn(fold_col, fold_of(F.col("_i"), F.col("_n"), k)).drop("_i", "_n")
