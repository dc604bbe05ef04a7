"""Logical churn tables derived from the driver's parquet tables.

The reference reads four warehouse tables (play log, user log, order
snapshot, account snapshot) and a telecom CSV.  The driver ships TPC-H-like
tables instead; the mapping below (see FIXTURES.md) turns them into the same
logical schemas.  Every function has a DuckDB twin in ``churnlens.oracle`` so
that results can be compared.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.functions.columns import day_int, epoch_millis
from churnlens.sources.io import read_table

# Fixed values of the mapping (FIXTURES.md section 2).
TRAIN_DAYS = (20240101, 20240115)
SCORED_DAYS = (20240116, 20240131)
ONE_DAY = (20240101, 20240101)
ORDER_WINDOW = ("1997-01-01", "2000-12-31")
SNAPSHOT_DAY = 20240201
STATE_OF_SEGMENT = {"MACHINERY": 4, "FURNITURE": 5, "AUTOMOBILE": 1}
CHURN_DAY_CHARGE = 900000.0


def _day_bounds(days):
    lo, hi = days
    d_lo = _dt.datetime.strptime(str(lo), "%Y%m%d")
    d_hi = _dt.datetime.strptime(str(hi), "%Y%m%d") + _dt.timedelta(days=1)
    return d_lo, d_hi


def _ts_range(days):
    """A parquet-pushable predicate on ``ts`` equivalent to ``day between``."""
    d_lo, d_hi = _day_bounds(days)
    return F.expr(f"ts >= TIMESTAMP_NTZ'{d_lo:%Y-%m-%d %H:%M:%S}' "
                  f"AND ts < TIMESTAMP_NTZ'{d_hi:%Y-%m-%d %H:%M:%S}'")


def play_log(spark: SparkSession, sf_dir: str, days=None) -> DataFrame:
    """play_log(user_id, video_type, server_time ms, device_id, day, event_id)."""
    ev = read_table(spark, sf_dir, "events")
    if days is not None:
        ev = ev.where(_ts_range(days))
    k = F.get_json_object("props", "$.k").cast("int")
    out = ev.select(
        F.col("user_id"),
        F.when(F.col("event_type") == "view", "vod")
         .when(F.col("event_type") == "click", "live")
         .otherwise(F.col("event_type")).alias("video_type"),
        epoch_millis("ts").alias("server_time"),
        F.when(k % 10 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("d"), (k % 4).cast("string"))).alias("device_id"),
        day_int("ts").alias("day"),
        F.col("event_id"),
    )
    if days is not None:
        out = out.where(F.col("day").between(*days))
    return out


def user_log(spark: SparkSession, sf_dir: str, days=None) -> DataFrame:
    """user_log(user_id, event_name, day)."""
    ev = read_table(spark, sf_dir, "events")
    if days is not None:
        ev = ev.where(_ts_range(days))
    out = ev.select(
        "user_id",
        F.when(F.col("event_type") == "signup", "search").otherwise(F.col("event_type")).alias("event_name"),
        day_int("ts").alias("day"),
    )
    if days is not None:
        out = out.where(F.col("day").between(*days))
    return out


def buy_order(spark: SparkSession, sf_dir: str, snapshot_day: int = SNAPSHOT_DAY) -> DataFrame:
    """Order snapshot: nns_user_id, nns_order_type, nns_order_state,
    nns_order_price, nns_modify_time (ms), day."""
    o = read_table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").alias("nns_user_id"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "other")
         .otherwise("product_buy").alias("nns_order_type"),
        F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "P", 5)
         .otherwise(0).alias("nns_order_state"),
        F.col("o_totalprice").alias("nns_order_price"),
        epoch_millis("o_orderdate").alias("nns_modify_time"),
        F.lit(snapshot_day).alias("day"),
    )


def user_state(spark: SparkSession, sf_dir: str, snapshot_day: int = SNAPSHOT_DAY) -> DataFrame:
    """Account snapshot: nns_id, nns_state (0 normal, 4 suspended, 5 closed), day."""
    c = read_table(spark, sf_dir, "customer")
    state = F.lit(0)
    expr = None
    for seg, st in STATE_OF_SEGMENT.items():
        expr = (F.when(F.col("c_mktsegment") == seg, st) if expr is None
                else expr.when(F.col("c_mktsegment") == seg, st))
    state = expr.otherwise(0)
    return c.select(F.col("c_custkey").alias("nns_id"), state.alias("nns_state"),
                    F.lit(snapshot_day).alias("day"))


def telecom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telecom-style churn table, one row per customer with orders (FIXTURES §3).

    Line items are reduced to one row per order first, so the join with
    ``orders`` is 1:1 and the per-customer aggregate reads pre-aggregated rows.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")

    parts = {"Day": F.col("l_returnflag") == "R", "Eve": F.col("l_returnflag") == "A",
             "Night": F.col("l_returnflag") == "N", "Intl": F.col("l_linestatus") == "O"}
    per_order = []
    for name, cond in parts.items():
        per_order += [
            F.sum(F.when(cond, F.col("l_quantity"))).alias(f"{name}_m"),
            F.count(F.when(cond, 1)).alias(f"{name}_c"),
            F.sum(F.when(cond, F.col("l_extendedprice"))).alias(f"{name}_g"),
        ]
    per_order.append(F.count(F.when(F.col("l_discount") > 0.05, 1)).alias("vm"))
    lo = li.groupBy("l_orderkey").agg(*per_order)
    oj = o.join(lo, o["o_orderkey"] == lo["l_orderkey"], "inner")
    per_cust = [F.count(F.lit(1)).alias("Account Length"),
                F.count(F.when(F.col("o_orderstatus") == "P", 1)).alias("CustServ Calls"),
                F.sum("vm").alias("VMail Message")]
    for name in parts:
        per_cust += [
            F.coalesce(F.sum(f"{name}_m"), F.lit(0.0)).alias(f"{name} Mins"),
            F.sum(f"{name}_c").alias(f"{name} Calls"),
            F.round(F.coalesce(F.sum(f"{name}_g"), F.lit(0.0)), 2).alias(f"{name} Charge"),
        ]
    agg = oj.groupBy("o_custkey").agg(*per_cust)
    cust = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"], "left")  # nation: 25 rows
    t = agg.join(cust, agg["o_custkey"] == cust["c_custkey"], "inner")
    yes_no = lambda cond: F.when(cond, "yes").otherwise("no")
    return t.select(
        F.col("o_custkey").alias("cust_id"),
        F.col("n_name").alias("State"),
        F.col("Account Length"),
        F.col("c_nationkey").alias("Area Code"),
        F.col("c_name").alias("Phone"),
        yes_no(F.col("c_mktsegment") == "BUILDING").alias("Int'l Plan"),
        yes_no(F.col("c_acctbal") > 5000).alias("VMail Plan"),
        F.col("VMail Message"),
        *[F.col(f"{p} {m}") for p in ("Day", "Eve", "Night", "Intl") for m in ("Mins", "Calls", "Charge")],
        F.col("CustServ Calls"),
        F.when(F.col("Day Charge") > CHURN_DAY_CHARGE, "True.").otherwise("False.").alias("Churn?"),
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, embedding array<double>, label."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
