from pyspark.sql import Window
from pyspark.sql import functions as F

from churnlens.operators.viewing import viewing_features, watch_gaps
from churnlens.sources import fixtures as fx
from conftest import SF01

GAP_SCHEMA = "user_id string, video_type string, server_time long, device_id string, event_id long"


def _gap_small(spark):
    rows = [
        ("u1", "vod", 0, "a", 1), ("u1", "live", 60000, "a", 2), ("u1", "vod", 60000, "b", 3),
        ("u1", "vod", 180000, None, 4),
        ("u2", "vod", 5, "a", 5),
        (None, "vod", 1, "a", 6), (None, "live", 2, "a", 7),
        ("u3", "live", None, "c", 8), ("u3", "live", 10, "c", 9), ("u3", "vod", 70, "c", 10),
    ]
    return spark.createDataFrame(rows, GAP_SCHEMA)


def test_gap_small_literal(spark):
    g = watch_gaps(_gap_small(spark)).where(F.col("gap_ms").isNotNull())
    got = sorted((r.user_id, r.video_type, r.gap_ms) for r in g.collect())
    assert got == sorted([("u1", "vod", 60000), ("u1", "live", 0), ("u1", "vod", 120000), ("u3", "live", 60)])


def test_gap_small_features(spark):
    f = {r.user_id: r for r in viewing_features(_gap_small(spark)).collect()}
    assert set(f) == {"u1", "u3"}  # u2 has no gap, the null user is dropped
    assert f["u1"].user_time == 3.0 and f["u1"].vod_time == 3.0 and f["u1"].live_time == 0.0
    assert f["u1"].device_freq == 3 and f["u1"].device_uni == 2
    assert f["u3"].live_time == 0.001 and f["u3"].vod_time is None


def test_heavy_user_split_equals_plain_lead(spark):
    play = fx.play_log(spark, SF01, fx.TRAIN_DAYS)
    w = Window.partitionBy("user_id").orderBy("server_time", "event_id")
    plain = (play.where(F.col("user_id").isNotNull())
             .select("event_id", (F.lead("server_time").over(w) - F.col("server_time")).alias("gap_ms")))
    # Every user above 7 events is split into several slices.
    split = watch_gaps(play, rows_per_chunk=7).select("event_id", "gap_ms")
    assert split.exceptAll(plain).count() == 0 and plain.exceptAll(split).count() == 0
    one_row_slices = watch_gaps(play, rows_per_chunk=1).select("event_id", "gap_ms")
    assert one_row_slices.exceptAll(plain).count() == 0


def test_gap_small_every_user_split(spark):
    # rows_per_chunk=1 slices every user, including the null-time row of u3
    g = watch_gaps(_gap_small(spark), rows_per_chunk=1).where(F.col("gap_ms").isNotNull())
    got = sorted((r.user_id, r.video_type, r.gap_ms) for r in g.collect())
    assert got == sorted([("u1", "vod", 60000), ("u1", "live", 0), ("u1", "vod", 120000), ("u3", "live", 60)])


def test_burst_at_one_time_is_split(spark):
    # A bot's events share one timestamp: slices go by number, not by time.
    rows = [("bot", "vod", 1000, "a", i) for i in range(400)] + [("bot", "vod", 61000, "a", 400), ("u", "vod", 1, "b", 500)]
    g = watch_gaps(spark.createDataFrame(rows, GAP_SCHEMA), rows_per_chunk=16)
    gaps = {r.event_id: r.gap_ms for r in g.collect()}
    assert len(gaps) == 402 and gaps[399] == 60000 and gaps[400] is None
    assert all(gaps[i] == 0 for i in range(399))
