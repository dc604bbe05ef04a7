from pyspark.sql import functions as F

from churnlens.operators.features import FILL_DEFAULTS, add_label, fill_features
from churnlens.operators.orders import order_features
from churnlens.sources import fixtures as fx
from conftest import SF001


def test_label_small(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 4), (4, 5), (5, None)], "user_id int, nns_state int")
    got = [r.label for r in add_label(df).orderBy("user_id").collect()]
    assert got == [0, 0, 1, 1, 0]


def test_fill_small(spark):
    schema = "user_id long, vod_time double, live_time double, userSearch long, userOther long, userOffer double, userCancel long"
    df = spark.createDataFrame([(1, None, None, None, None, None, None)], schema)
    r = fill_features(df).first()
    assert (r.vod_time, r.live_time, r.userSearch, r.userOther, r.userOffer, r.userCancel) == \
        (10215.79, 20872.1, -1, -1, -1.0, -1)
    assert set(FILL_DEFAULTS) == {"vod_time", "live_time", "userSearch", "userOther", "userOffer", "userCancel"}


def test_order_features_null_not_zero(spark):
    rows = [(1, "other", 1, 10.0, 0), (1, "product_buy", 5, 3.0, 0), (2, "product_buy", 0, 1.0, 0)]
    o = spark.createDataFrame(rows, "nns_user_id long, nns_order_type string, nns_order_state int, "
                                    "nns_order_price double, nns_modify_time long")
    got = {r.user_id: r for r in order_features(o).collect()}
    assert got[1].userOther == 1 and got[1].userOffer == 10.0 and got[1].userCancel == 1
    assert got[2].userOther is None and got[2].userOffer is None and got[2].userCancel is None


def test_order_window_is_inclusive_by_day(spark):
    from churnlens.operators.orders import order_filter
    day = 86_400_000
    rows = [(1, "other", 1, 1.0, 10 * day - 1), (1, "other", 1, 1.0, 10 * day),
            (1, "other", 1, 1.0, 11 * day - 1), (1, "other", 1, 1.0, 11 * day)]
    o = spark.createDataFrame(rows, "nns_user_id long, nns_order_type string, nns_order_state int, "
                                    "nns_order_price double, nns_modify_time long")
    kept = order_filter(o, window=("1970-01-11", "1970-01-11")).count()
    assert kept == 2


def test_flagship_smoke_sf0001(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["user_id", "user_time", "device_freq", "device_uni", "vod_time", "live_time",
                          "userSearch", "userOther", "userOffer", "userCancel", "nns_state"]
    assert df.count() == 15  # FIXTURES.md: 15 labelled rows at sf0.001
    assert df.where(F.col("nns_state").isin(4, 5)).count() == 7


def test_feature_plan_scans_no_self_join(spark):
    import __spark_entry__ as E
    plan = E.entry(spark)._jdf.queryExecution().optimizedPlan().toString()
    # lead() instead of a self-join; events are read by the main pass, the
    # heavy-user count and the slice heads, plus the user log; orders and
    # customers once each.
    assert "Window" in plan and plan.count("Relation") <= 7


def test_fixture_mapping(spark):
    p = fx.play_log(spark, SF001, fx.TRAIN_DAYS)
    assert set(r.video_type for r in p.select("video_type").distinct().collect()) <= \
        {"vod", "live", "signup", "purchase", "error"}
    assert p.where(F.col("day") < fx.TRAIN_DAYS[0]).count() == 0
