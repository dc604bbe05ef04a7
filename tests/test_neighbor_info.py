"""Nearest-neighbour information against all pairs in numpy."""

import math

import numpy as np
import pytest

from churnlens.operators.neighbor_info import class_radii, digamma, neighbor_info_scores


def _psi(n):
    return -0.57721566490153286 + sum(1.0 / i for i in range(1, int(n)))


def _brute(x, y, k):
    keep = np.isfinite(x) & np.isin(y, [c for c in set(y) if (y[np.isfinite(x)] == c).sum() > 1])
    x, y = x[keep], y[keep]
    sk = sc = sm = 0.0
    for i in range(len(x)):
        same = np.delete(x, i)[np.delete(y, i) == y[i]]
        kk = min(k, len(same))
        r = np.sort(np.abs(same - x[i]))[kk - 1]
        m = (((x > x[i] - r) & (x < x[i] + r)) | (x == x[i])).sum()
        sk, sc, sm = sk + _psi(kk), sc + _psi(len(same) + 1), sm + _psi(m)
    return max(0.0, _psi(len(x)) + (sk - sc - sm) / len(x))


def test_digamma(spark):
    row = spark.range(1).select(*[digamma(spark_lit(n)).alias(f"p{n}") for n in (1, 2, 10, 1000)]).first()
    for n in (1, 2, 10, 1000):
        assert row[f"p{n}"] == pytest.approx(_psi(n), abs=1e-9)


def spark_lit(n):
    from pyspark.sql import functions as F
    return F.lit(float(n))


@pytest.mark.parametrize("k, slice_rows", [(3, 100_000), (3, 10), (1, 4), (5, 5)])
def test_equal_to_all_pairs(spark, k, slice_rows):
    rng = np.random.default_rng(8)
    n = 120
    y = (rng.random(n) < 0.3).astype(float)
    cols = {"near": y * 2 + rng.normal(size=n), "ties": rng.integers(0, 6, n).astype(float), "noise": rng.normal(size=n),
            "one": np.ones(n), "gaps": np.where(rng.random(n) < 0.2, np.nan, rng.normal(size=n) + y)}
    rows = [(i, float(y[i]), *[float(v[i]) for v in cols.values()]) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, y double, " + ", ".join(f"{c} double" for c in cols))
    got = {r.feature: r.mi for r in neighbor_info_scores(df, cols, "y", "id", k, slice_rows).collect()}
    assert set(got) == set(cols)
    for c, v in cols.items():
        assert got[c] == pytest.approx(_brute(v, y, k), abs=1e-8), c
    assert got["near"] > got["noise"]


def test_lone_class_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (2, 0.0, 2.0), (3, 0.0, 4.0), (4, 1.0, 2.5), (5, None, 2.0), (6, 0.0, None), (7, 0.0, math.inf)],
                               "id long, y double, x double")
    got = neighbor_info_scores(df, ["x"], "y", "id").first()
    # Three rows of one class are left: k = 2 of 3, every row inside all but its farthest ends.
    assert got.mi == pytest.approx(_brute(np.array([1.0, 2.0, 4.0]), np.zeros(3), 3), abs=1e-9)
    assert neighbor_info_scores(df.limit(0), ["x"], "y", "id").count() == 0
    radii = {r.x: r.r for r in class_radii(df.where("id < 4").selectExpr("'x' feature", "id", "y", "x"), 1).collect()}
    assert radii == {1.0: 1.0, 2.0: 1.0, 4.0: 2.0}


def test_ends_that_round_to_their_value(spark):
    # 2^53 + 1 is no double: the end of a value one away is the value itself.
    x = np.array([2.0 ** 53 - 1, 2.0 ** 53, 2.0 ** 53, 2.0 ** 53 + 2, 2.0 ** 53 + 4, 2.0 ** 53 + 8, 5.0, 7.0])
    y = np.array([1.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 1.0])
    df = spark.createDataFrame([(i, float(b), float(a)) for i, (a, b) in enumerate(zip(x, y))], "id long, y double, x double")
    for k in (1, 2, 3):
        assert neighbor_info_scores(df, ["x"], "y", "id", k).first().mi == pytest.approx(_brute(x, y, k), abs=1e-9)


def test_rows_are_built_once_and_have_two_ends(spark, monkeypatch):
    from churnlens.operators import neighbor_info as ninfo

    built, ends = spark.sparkContext.accumulator(0), []

    def counted(batches):
        for b in batches:
            built.add(len(b))
            yield b

    rows = [(i, float(i % 3 == 0), float(i * 7919 % 101)) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, y double, x double").mapInPandas(counted, "id long, y double, x double")
    before = ninfo._values_before
    monkeypatch.setattr(ninfo, "_values_before", lambda v, e: ends.append(e.count()) or before(v, e))
    neighbor_info_scores(df, ["x"], "y", "id").collect()
    assert built.value == 90  # three times before
    assert ends == [2 * 90]  # four a value before
