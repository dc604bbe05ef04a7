"""Registered queries: one Spark callable (spark, sf_dir) -> DataFrame per
operator of the inventory, and the DuckDB SQL twin where one exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.operators import features as feat
from churnlens.operators import orders as ords
from churnlens.operators import viewing as view
from churnlens.plans import oracle as sql
from churnlens.session import ensure_checkpoint_dir
from churnlens.sources import fixtures as fx
from churnlens.sources.io import scan_range, scan_snapshot

QUERIES: dict = {}
ORACLE: dict = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


# --- half A: scans, gaps, features ------------------------------------------------

@register("a1_range_scan", f"""
WITH {sql.play_cte(fx.TRAIN_DAYS).strip()}
SELECT user_id, video_type, server_time, device_id, day, event_id FROM play""")
def a1_range_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Play log rows of the training window (day between lo and hi)."""
    return scan_range(fx.play_log(spark, sf, fx.TRAIN_DAYS), *fx.TRAIN_DAYS)


@register("a2_snapshot_scan", f"""
WITH {sql.play_cte().strip()}
SELECT user_id, video_type, server_time, device_id, day, event_id FROM play WHERE day = {fx.ONE_DAY[0]}""")
def a2_snapshot_scan(spark, sf):
    """Play log of one day (``where day = d``)."""
    return scan_snapshot(fx.play_log(spark, sf, fx.ONE_DAY), fx.ONE_DAY[0])


@register("e2_watch_gap", f"""
WITH {sql.play_cte(fx.TRAIN_DAYS).strip()},
{sql.GAPS_CTE.strip()}
SELECT user_id, event_id, video_type, gap_ms / 60000.0::DOUBLE AS watch_time FROM d""")
def e2_watch_gap(spark, sf):
    """Per play row: minutes until the same user's next event (last event dropped)."""
    return view.gap_minutes(view.watch_gaps(fx.play_log(spark, sf, fx.TRAIN_DAYS)))


@register("d1_user_time", f"""
{sql.ctes(sql.play_cte(fx.TRAIN_DAYS), sql.GAPS_CTE, sql.VIEWING_CTE)}
SELECT user_id, user_time FROM viewing""")
def d1_user_time(spark, sf):
    """Total watch minutes per user."""
    return view.viewing_features(fx.play_log(spark, sf, fx.TRAIN_DAYS)).select("user_id", "user_time")


@register("d2_vod_live", f"""
{sql.ctes(sql.play_cte(fx.TRAIN_DAYS), sql.GAPS_CTE, sql.VIEWING_CTE)}
SELECT user_id, vod_time, live_time FROM viewing""")
def d2_vod_live(spark, sf):
    """Filtered watch-minute sums per user (vod, live); null when none."""
    return view.viewing_features(fx.play_log(spark, sf, fx.TRAIN_DAYS)).select("user_id", "vod_time", "live_time")


@register("d4_device_counts", f"""
{sql.ctes(sql.play_cte(fx.TRAIN_DAYS), sql.GAPS_CTE, sql.VIEWING_CTE)}
SELECT user_id, device_freq, device_uni FROM viewing""")
def d4_device_counts(spark, sf):
    """Non-null device count and exact distinct device count per user."""
    return view.viewing_features(fx.play_log(spark, sf, fx.TRAIN_DAYS)).select("user_id", "device_freq", "device_uni")


@register("d5_search", f"""
{sql.ctes(sql.userlog_cte(fx.TRAIN_DAYS), sql.SEARCH_CTE)}
SELECT user_id, userSearch FROM searches""")
def d5_search(spark, sf):
    """Search events per user."""
    return ords.search_features(fx.user_log(spark, sf, fx.TRAIN_DAYS))


@register("d5_order_features", f"""
{sql.ctes(sql.orders_cte(fx.ORDER_WINDOW), sql.SHOPPING_CTE)}
SELECT user_id, userOther, userOffer, userCancel FROM shopping""")
def d5_order_features(spark, sf):
    """Paid 'other' orders, paid amount and cancellations per user in the order window."""
    return ords.order_features(fx.buy_order(spark, sf), fx.ORDER_WINDOW)


@register("g1_order_dates", f"""
WITH {sql.orders_cte(fx.ORDER_WINDOW).strip()}
SELECT strftime(make_timestamp(nns_modify_time * 1000), '%Y-%m-%d') AS order_date, COUNT(*) AS n_orders
FROM buyorder GROUP BY 1""")
def g1_order_dates(spark, sf):
    """Orders per formatted day of the epoch-millisecond modify time, in the window."""
    o = ords.order_filter(fx.buy_order(spark, sf), window=fx.ORDER_WINDOW)
    from churnlens.functions.columns import millis_to_date
    return o.groupBy(millis_to_date("nns_modify_time").alias("order_date")).agg(F.count(F.lit(1)).alias("n_orders"))


@register("b5_paid_other_orders", f"""
WITH {sql.orders_cte(fx.ORDER_WINDOW).strip()}
SELECT nns_user_id, nns_order_type, nns_order_state, nns_order_price, nns_modify_time FROM buyorder
WHERE nns_order_type = 'other' AND nns_order_state = 1""")
def b5_paid_other_orders(spark, sf):
    """Conjunction filter on order type and state inside the order window."""
    o = ords.order_filter(fx.buy_order(spark, sf), types=["other"], states=[ords.PAID], window=fx.ORDER_WINDOW)
    return o.select("nns_user_id", "nns_order_type", "nns_order_state", "nns_order_price", "nns_modify_time")


@register("b6_labelled_users", f"""
WITH {sql.USERS_CTE.strip()}
SELECT nns_id AS user_id, nns_state FROM nnsuser WHERE nns_state = 0 OR nns_state = 4 OR nns_state = 5""")
def b6_labelled_users(spark, sf):
    """Account snapshot restricted to states 0, 4, 5 with the key renamed."""
    u = scan_snapshot(fx.user_state(spark, sf), fx.SNAPSHOT_DAY)
    return u.where(F.col("nns_state").isin(list(feat.LABEL_STATES))).select(
        F.col("nns_id").alias("user_id"), "nns_state")


@register("h9_train_features", sql.feature_sql(fx.TRAIN_DAYS, fx.ORDER_WINDOW, labelled=True))
def h9_train_features(spark, sf):
    """The labelled training feature row (flagship)."""
    return feat.build_features(
        fx.play_log(spark, sf, fx.TRAIN_DAYS), fx.user_log(spark, sf, fx.TRAIN_DAYS),
        fx.buy_order(spark, sf), fx.user_state(spark, sf), fx.ORDER_WINDOW, require_label=True)


@register("h10_scored_features", sql.feature_sql(fx.SCORED_DAYS, fx.ORDER_WINDOW, labelled=False))
def h10_scored_features(spark, sf):
    """The feature row of the scored month, no label required."""
    return feat.build_features(
        fx.play_log(spark, sf, fx.SCORED_DAYS), fx.user_log(spark, sf, fx.SCORED_DAYS),
        fx.buy_order(spark, sf), None, fx.ORDER_WINDOW, require_label=False)


def _processed_sql(days, labelled=True):
    inner = sql.feature_sql(days, fx.ORDER_WINDOW, labelled=labelled)
    label = (", CAST(CASE WHEN nns_state = 4 OR nns_state = 5 THEN 1 ELSE 0 END AS INTEGER) AS label"
             if labelled else "")
    return f"""
SELECT user_id, CAST(user_time AS DOUBLE) AS user_time, CAST(device_freq AS DOUBLE) AS device_freq,
       CAST(device_uni AS DOUBLE) AS device_uni,
       CAST(COALESCE(vod_time, 10215.79) AS DOUBLE) AS vod_time,
       CAST(COALESCE(live_time, 20872.1) AS DOUBLE) AS live_time,
       CAST(COALESCE(userSearch, -1) AS DOUBLE) AS userSearch,
       CAST(COALESCE(userOther, -1) AS DOUBLE) AS userOther,
       CAST(COALESCE(userOffer, -1) AS DOUBLE) AS userOffer,
       CAST(COALESCE(userCancel, -1) AS DOUBLE) AS userCancel{label}
FROM ({inner}) t"""


@register("b10_filled_one_day", _processed_sql(fx.ONE_DAY))
def b10_filled_one_day(spark, sf):
    """Null fill + double cast + label on a one-day window, where vod/live nulls occur."""
    f = feat.build_features(
        fx.play_log(spark, sf, fx.ONE_DAY), fx.user_log(spark, sf, fx.ONE_DAY),
        fx.buy_order(spark, sf), fx.user_state(spark, sf), fx.ORDER_WINDOW, require_label=True)
    return feat.process_features(f, labelled=True)


@register("b11_train_processed", _processed_sql(fx.TRAIN_DAYS))
def b11_train_processed(spark, sf):
    """Training rows after fill, cast and label derivation."""
    return feat.process_features(h9_train_features(spark, sf), labelled=True)


@register("b9_scored_processed", _processed_sql(fx.SCORED_DAYS, labelled=False))
def b9_scored_processed(spark, sf):
    """Scored-month rows after fill and cast (no label)."""
    return feat.process_features(h10_scored_features(spark, sf), labelled=False)


# --- half B: telecom table, preparation, splits, scores, metrics ----------------

from churnlens.operators import neighbor_info as ninfo  # noqa: E402
from churnlens.operators import metrics as met  # noqa: E402
from churnlens.operators import prepare as prep  # noqa: E402
from churnlens.operators import scores as sc  # noqa: E402
from churnlens.operators import split as spl  # noqa: E402

_B = sql.FEATURES_B
_TEL = f"WITH {sql.TELECOM_CTE.strip()}"
_TRAIN = f"WITH {sql.TELECOM_CTE.strip()},\n{sql.train_cte().strip()}"
_LONG = f"{_TRAIN},\n{sql.long_cte().strip()}"


def churn_table(spark, sf) -> DataFrame:
    """Telecom table with flags encoded and State / Area Code / Phone dropped."""
    return prep.prepare_churn(fx.telecom(spark, sf))


def churn_train(spark, sf) -> DataFrame:
    return spl.hash_split(churn_table(spark, sf), prep.ID_COL, 0.7, 0)[0]


@register("b0_telecom_table", f"{_TEL}\nSELECT * FROM telecom")
def b0_telecom_table(spark, sf):
    """One row per ordering customer in the telecom churn layout."""
    return fx.telecom(spark, sf)


@register("a3_csv_scan", f"{_TEL}\nSELECT * FROM telecom")
def a3_csv_scan(spark, sf):
    """Telecom table written as CSV with a header (A5) and read back with the declared schema (A3)."""
    import uuid

    from churnlens.session import scratch_path
    from churnlens.sources.io import read_churn_csv, write_csv

    path = scratch_path(spark, f"churn_csv_{uuid.uuid4().hex}")
    write_csv(fx.telecom(spark, sf), path)
    return read_churn_csv(spark, path)


@register("b13_encoded", f"{_TEL}\nSELECT * FROM churn")
def b13_encoded(spark, sf):
    """Drop State / Area Code / Phone, flags to 0/1."""
    return churn_table(spark, sf)


@register("b14_cross_features", f"""{_TEL}
SELECT cust_id, "Account Length", "Int'l Plan", "VMail Plan", "VMail Message",
       "Intl Mins", "Intl Calls", "Intl Charge", "CustServ Calls", "Churn?",
       "Day Charge" + "Eve Charge" + "Night Charge" AS "Charge",
       "Day Mins" + "Eve Mins" + "Night Mins" AS "Mins",
       "Day Calls" + "Eve Calls" + "Night Calls" - "CustServ Calls" AS "Calls"
FROM churn""")
def b14_cross_features(spark, sf):
    """Charge / Mins / Calls cross features replacing their nine parts."""
    return prep.add_cross_features(churn_table(spark, sf))


_NULLS = " UNION ALL ".join(
    f"SELECT {sql.lit(c)} AS \"column\", COUNT(*) - COUNT({sql.qi(c)}) AS n_null FROM telecom"
    for c in ["cust_id", "State", "Account Length", "Area Code", "Phone", "Int'l Plan", "VMail Plan",
              "VMail Message", *_B[4:], "Churn?"])


@register("b15_null_profile", f"{_TEL}\n{_NULLS}")
def b15_null_profile(spark, sf):
    """Null count per column in one aggregate pass."""
    return prep.null_profile(fx.telecom(spark, sf))


@register("j1_hash_split", f"""{_TEL}
SELECT cust_id, {sql.hash_u32_sql('0', 'cust_id')} % 1000 < 700 AS is_train FROM churn""")
def j1_hash_split(spark, sf):
    """Seeded 70/30 holdout flag from md5(seed:id)."""
    return churn_table(spark, sf).select(prep.ID_COL, spl.split_flag(prep.ID_COL, 0.7, 0).alias("is_train"))


@register("j2_stratified_folds", f"""{_TRAIN}
SELECT cust_id, "Churn?", CAST(ntile(5) OVER (PARTITION BY "Churn?" ORDER BY cust_id) - 1 AS INTEGER) AS fold
FROM train""")
def j2_stratified_folds(spark, sf):
    """Unshuffled stratified 5 folds of the training rows."""
    t = churn_train(spark, sf).select(prep.ID_COL, prep.LABEL_COL)
    return spl.assign_folds(t, prep.ID_COL, 5, by=prep.LABEL_COL)


@register("j3_plain_folds", f"""{_TRAIN}
SELECT cust_id, CAST(ntile(5) OVER (ORDER BY cust_id) - 1 AS INTEGER) AS fold FROM train""")
def j3_plain_folds(spark, sf):
    """Unshuffled plain 5 folds of the training rows."""
    return spl.assign_folds(churn_train(spark, sf).select(prep.ID_COL), prep.ID_COL, 5)


@register("l1_variance", f"""{_LONG}
SELECT feature, CAST(printf('%.11e', var_pop(x)) AS DOUBLE) AS variance FROM long GROUP BY feature""")
def l1_variance(spark, sf):
    """Population variance per feature of the training rows."""
    v = sc.variance_scores(churn_train(spark, sf), _B)
    from churnlens.functions.columns import round_sig
    return v.select("feature", round_sig("variance", 12).alias("variance"))


@register("l2_chi2", f"""{_LONG},
cls AS (SELECT feature, y, COUNT(*) AS n, SUM(x) AS o FROM long GROUP BY feature, y),
tot AS (SELECT feature, SUM(n) AS nn, SUM(o) AS s FROM cls GROUP BY feature)
SELECT cls.feature, ROUND(SUM(power(o - s * n / nn, 2) / (s * n / nn)), 6) AS chi2
FROM cls JOIN tot USING (feature) GROUP BY cls.feature""")
def l2_chi2(spark, sf):
    """Chi-square score of every feature against the churn label."""
    s = sc.chi2_scores(churn_train(spark, sf), _B, prep.LABEL_COL)
    return s.select("feature", F.round("chi2", 6).alias("chi2"))


@register("l6_f_scores", f"""{_LONG},
cls AS (SELECT feature, y, COUNT(*) AS n, AVG(x) AS m, var_pop(x) AS v FROM long GROUP BY feature, y),
tot AS (SELECT feature, AVG(x) AS gm, COUNT(*) AS nn, COUNT(DISTINCT y) AS k FROM long GROUP BY feature)
SELECT cls.feature,
       ROUND((SUM(n * power(m - gm, 2)) / (ANY_VALUE(k) - 1)) / (SUM(n * v) / (ANY_VALUE(nn) - ANY_VALUE(k))), 6) AS f_score
FROM cls JOIN tot USING (feature) GROUP BY cls.feature""")
def l6_f_scores(spark, sf):
    """One-way ANOVA F score of every feature across the churn classes."""
    s = sc.f_scores(churn_train(spark, sf), _B, prep.LABEL_COL)
    return s.select("feature", F.round("f_score", 6).alias("f_score"))


def _mi_sql(bins_expr: str, out: str, agg: str) -> str:
    return f"""{_LONG},
ranked AS (SELECT feature, x, y, rank() OVER (PARTITION BY feature ORDER BY x) - 1 AS r,
                  COUNT(*) OVER (PARTITION BY feature) AS n FROM long),
wide AS (SELECT ranked.*, unnest(range(2, greatest(17, CAST(floor(pow(n, 0.6) / 2) AS BIGINT) + 1))) AS b FROM ranked),
grid AS (SELECT * FROM wide WHERE {bins_expr}),
cells AS (SELECT feature, b, FLOOR(r * b / n) AS bin, COUNT(*) AS nb, SUM(y) AS nb1, ANY_VALUE(n) AS nn
          FROM grid GROUP BY feature, b, FLOOR(r * b / n)),
pos AS (SELECT feature, b, SUM(nb1) AS p FROM cells GROUP BY feature, b),
mi AS (SELECT c.feature, c.b,
         SUM(COALESCE(CASE WHEN nb1 > 0 THEN nb1 / nn * ln(nb1 * nn / (nb * p)) END, 0)
           + COALESCE(CASE WHEN nb - nb1 > 0 THEN (nb - nb1) / nn * ln((nb - nb1) * nn / (nb * (nn - p))) END, 0))
           / ln(2) AS mi
       FROM cells c JOIN pos USING (feature, b) GROUP BY c.feature, c.b)
SELECT feature, ROUND({agg}(mi), 6) AS {out} FROM mi GROUP BY feature"""


@register("l4_mic", _mi_sql("b <= greatest(2, CAST(floor(pow(n, 0.6) / 2) AS INTEGER))", "mic", "MAX"))
def l4_mic(spark, sf):
    """Grid (equal-frequency) approximation of the maximal information coefficient."""
    s = sc.mic_scores(churn_train(spark, sf), _B, prep.LABEL_COL, prep.ID_COL)
    return s.select("feature", F.round("mic", 6).alias("mic"))


@register("l5_mutual_info", _mi_sql("b = 16", "mi", "MAX"))
def l5_mutual_info(spark, sf):
    """Binned plug-in mutual information (16 equal-frequency bins) per feature."""
    s = sc.mutual_info_scores(churn_train(spark, sf), _B, prep.LABEL_COL, prep.ID_COL, bins=16)
    return s.select("feature", F.round("mi", 6).alias("mi"))


_PSI = ("(ln({0} + 8) - 0.5 / ({0} + 8) - 1 / (12 * pow({0} + 8, 2)) + 1 / (120 * pow({0} + 8, 4)) - 1 / (252 * pow({0} + 8, 6)) + 1 / (240 * pow({0} + 8, 8))"
        " - 1 / (132 * pow({0} + 8, 10)) - 1 / ({0}) - 1 / ({0} + 1) - 1 / ({0} + 2) - 1 / ({0} + 3) - 1 / ({0} + 4) - 1 / ({0} + 5) - 1 / ({0} + 6) - 1 / ({0} + 7))").format


@register("l5_neighbor_information", f"""{_LONG},
named AS (SELECT feature, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, row_number() OVER (PARTITION BY feature) AS i FROM long),
cls AS (SELECT feature, y, CAST(COUNT(*) AS DOUBLE) AS nc FROM named GROUP BY feature, y HAVING COUNT(*) > 1),
kept AS (SELECT named.*, nc, least(3.0, nc - 1) AS k FROM named JOIN cls USING (feature, y)),
same AS (SELECT a.feature, a.i, a.k, abs(b.x - a.x) AS d FROM kept a JOIN kept b ON a.feature = b.feature AND a.y = b.y AND a.i <> b.i),
far AS (SELECT feature, i, k, d, row_number() OVER (PARTITION BY feature, i ORDER BY d) AS place FROM same),
radius AS (SELECT feature, i, d AS r FROM far WHERE place = k),
inside AS (SELECT a.feature, a.i, a.k, a.nc, CAST(COUNT(*) AS DOUBLE) AS m
           FROM (SELECT * FROM kept JOIN radius USING (feature, i)) a JOIN kept b
             ON a.feature = b.feature AND ((b.x > a.x - a.r AND b.x < a.x + a.r) OR b.x = a.x)
           GROUP BY a.feature, a.i, a.k, a.nc),
score AS (SELECT feature, CAST(COUNT(*) AS DOUBLE) AS n, SUM({_PSI("k")}) - SUM({_PSI("nc")}) - SUM({_PSI("m")}) AS s FROM inside GROUP BY feature)
SELECT feature, ROUND(greatest(0.0, {_PSI("n")} + s / n), 6) + 0.0 AS mi FROM score""")
def l5_neighbor_information(spark, sf):
    """Nearest-neighbour mutual information (k = 3, nats) of every column with the label."""
    s = ninfo.neighbor_info_scores(churn_train(spark, sf), _B, prep.LABEL_COL, prep.ID_COL)
    return s.select("feature", F.round("mi", 6).alias("mi"))


@register("e5_top5_chi2", f"""{_LONG},
cls AS (SELECT feature, y, COUNT(*) AS n, SUM(x) AS o FROM long GROUP BY feature, y),
tot AS (SELECT feature, SUM(n) AS nn, SUM(o) AS s FROM cls GROUP BY feature),
sc AS (SELECT cls.feature, ROUND(SUM(power(o - s * n / nn, 2) / (s * n / nn)), 6) AS chi2
       FROM cls JOIN tot USING (feature) GROUP BY cls.feature)
SELECT feature, chi2 FROM sc ORDER BY chi2 DESC, feature LIMIT 5""")
def e5_top5_chi2(spark, sf):
    """SelectKBest(chi2, k=5): the five best-scoring features."""
    return sc.top_k(l2_chi2(spark, sf), 5, "chi2")


@register("d7_value_counts", f"""{_TRAIN}
SELECT "CustServ Calls", COUNT(*) AS count FROM train GROUP BY 1""")
def d7_value_counts(spark, sf):
    """Histogram of one column (``value_counts``)."""
    return sc.value_counts(churn_train(spark, sf), "CustServ Calls")


def _rule_pred():
    # A fixed rule standing in for a model's output: more day than evening calls.
    return F.when(F.col("`Day Calls`") > F.col("`Eve Calls`"), 1).otherwise(0)


_RULE = f"""{_TRAIN},
pred AS (SELECT CAST("Churn?" AS DOUBLE) AS label,
                CAST(CASE WHEN "Day Calls" > "Eve Calls" THEN 1 ELSE 0 END AS DOUBLE) AS prediction FROM train)"""


@register("i5_confusion", f"{_RULE}\nSELECT label, prediction, COUNT(*) AS n FROM pred GROUP BY 1, 2")
def i5_confusion(spark, sf):
    """Confusion counts of a rule classifier on the training rows."""
    t = churn_train(spark, sf).withColumn("prediction", _rule_pred())
    return met.confusion(t, prep.LABEL_COL, "prediction")


@register("i3_i4_precision_recall", f"""{_RULE}
SELECT CASE WHEN SUM(prediction) > 0 THEN SUM(label * prediction) / SUM(prediction) ELSE 0 END AS precision,
       CASE WHEN SUM(label) > 0 THEN SUM(label * prediction) / SUM(label) ELSE 0 END AS recall FROM pred""")
def i3_i4_precision_recall(spark, sf):
    """Positive-class precision and recall."""
    t = churn_train(spark, sf).withColumn("prediction", _rule_pred())
    return met.precision_recall(t, prep.LABEL_COL, "prediction", 1)


@register("i1_i2_weighted", f"""{_RULE},
c AS (SELECT label, prediction, COUNT(*) AS n FROM pred GROUP BY 1, 2),
per AS (SELECT a.cls, a.na, COALESCE(t.tp, 0) AS tp, COALESCE(p.np, 0) AS np
        FROM (SELECT label AS cls, SUM(n) AS na FROM c GROUP BY 1) a
        LEFT JOIN (SELECT label AS cls, n AS tp FROM c WHERE label = prediction) t ON a.cls = t.cls
        LEFT JOIN (SELECT prediction AS cls, SUM(n) AS np FROM c GROUP BY 1) p ON a.cls = p.cls)
SELECT SUM(na / (SELECT SUM(na) FROM per) * CASE WHEN np > 0 THEN tp / np ELSE 0 END) AS weightedPrecision,
       SUM(na / (SELECT SUM(na) FROM per) * tp / na) AS weightedRecall FROM per""")
def i1_i2_weighted(spark, sf):
    """Weighted precision and recall (true-class-share weights)."""
    t = churn_train(spark, sf).withColumn("prediction", _rule_pred())
    return met.weighted_precision_recall(t, prep.LABEL_COL, "prediction")


# --- neighbours, SMOTE, clustering --------------------------------------------

from churnlens.functions.columns import round_sig  # noqa: E402
from churnlens.operators import cluster as clu  # noqa: E402
from churnlens.operators import neighbors as nbr  # noqa: E402
from churnlens.operators import resample as rs  # noqa: E402


def churn_test(spark, sf) -> DataFrame:
    return spl.hash_split(churn_table(spark, sf), prep.ID_COL, 0.7, 0)[1]


def _sq_sql(a: str, b: str, cols) -> str:
    return " + ".join(f"(CAST({a}.{sql.qi(c)} AS DOUBLE) - CAST({b}.{sql.qi(c)} AS DOUBLE)) * "
                      f"(CAST({a}.{sql.qi(c)} AS DOUBLE) - CAST({b}.{sql.qi(c)} AS DOUBLE))" for c in cols)


@register("k5_knn_classify", f"""{_TRAIN},
test AS (SELECT * FROM churn WHERE {sql.hash_u32_sql('0', 'cust_id')} % 1000 >= 700),
pairs AS (SELECT t.cust_id AS qid, r.cust_id AS rid, CAST(r."Churn?" AS DOUBLE) AS y, {_sq_sql('t', 'r', _B)} AS d
          FROM test t CROSS JOIN train r),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, rid) AS rn FROM pairs),
votes AS (SELECT qid, y, COUNT(*) AS v FROM rk WHERE rn <= 5 GROUP BY qid, y),
best AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY v DESC, y) AS r FROM votes)
SELECT qid AS id, y AS prediction FROM best WHERE r = 1""")
def k5_knn_classify(spark, sf):
    """5-nearest-neighbour vote for every holdout customer (exact, metric index)."""
    tr = nbr.as_points(churn_train(spark, sf), _B, prep.ID_COL, prep.LABEL_COL)
    te = nbr.as_points(churn_test(spark, sf), _B, prep.ID_COL)
    return nbr.knn_classify(tr, te, 5)


def _smote_sql(k=5, seed=2):
    arr = ", ".join(f"CAST({sql.qi(c)} AS DOUBLE)" for c in _B)
    interp = ", ".join(f"xb[{i + 1}] + u * (xn[{i + 1}] - xb[{i + 1}])" for i in range(len(_B)))
    sq = " + ".join(f"(a.x[{i + 1}] - b.x[{i + 1}]) * (a.x[{i + 1}] - b.x[{i + 1}])" for i in range(len(_B)))
    return f"""{_TRAIN},
cls AS (SELECT CAST("Churn?" AS DOUBLE) AS y, COUNT(*) AS n FROM train GROUP BY 1),
mc AS (SELECT y AS ym, n AS nmin FROM cls ORDER BY n, y LIMIT 1),
need AS (SELECT MAX(n) - (SELECT nmin FROM mc) AS need FROM cls),
mino AS (SELECT cust_id AS id, [{arr}] AS x FROM train WHERE CAST("Churn?" AS DOUBLE) = (SELECT ym FROM mc)),
idx AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM mino),
pairs AS (SELECT a.id AS base_id, b.id AS nb_id, {sq} AS d FROM mino a JOIN mino b ON a.id <> b.id),
nb AS (SELECT base_id, nb_id, row_number() OVER (PARTITION BY base_id ORDER BY d, nb_id) - 1 AS rnk FROM pairs),
draws AS (SELECT j AS draw, j % (SELECT nmin FROM mc) AS i,
                 {sql.hash_u32_sql(str(seed), 'j', "'nb'")} % least({k}, (SELECT nmin FROM mc) - 1) AS rnk,
                 {sql.hash_u32_sql(str(seed), 'j', "'gap'")} / 4294967296.0 AS u
          FROM (SELECT unnest(range((SELECT need FROM need))) AS j) r),
d AS (SELECT draws.draw, idx.id AS base_id, nb.nb_id, draws.u, mb.x AS xb, mn.x AS xn
      FROM draws JOIN idx ON draws.i = idx.i
      JOIN nb ON nb.base_id = idx.id AND nb.rnk = draws.rnk
      JOIN mino mb ON mb.id = idx.id JOIN mino mn ON mn.id = nb.nb_id)
SELECT draw, base_id, nb_id, [{interp}] AS x, (SELECT ym FROM mc) AS y FROM d"""


@register("l12_smote", _smote_sql())
def l12_smote(spark, sf):
    """SMOTE samples bringing the churn class of the training rows to parity."""
    pts = nbr.as_points(churn_train(spark, sf), _B, prep.ID_COL, prep.LABEL_COL)
    return rs.smote(pts, k=5, seed=2)


def _emb_points(spark, sf):
    e = fx.embeddings(spark, sf)
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"), F.col("label").alias("cluster"))


def _label_centroids(points: DataFrame, dims: int) -> DataFrame:
    return points.groupBy("cluster").agg(
        F.array(*[F.avg(F.col("x")[i]) for i in range(dims)]).alias("center"))


EMB_DIMS = 64


def _reldist_sql(final: str) -> str:
    avgs = ", ".join(f"avg(x[{i + 1}])" for i in range(EMB_DIMS))
    sq = " + ".join(f"(x[{i + 1}] - center[{i + 1}]) * (x[{i + 1}] - center[{i + 1}])" for i in range(EMB_DIMS))
    return f"""
WITH e AS (SELECT vec_id AS id, label AS cluster, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
c AS (SELECT cluster, [{avgs}] AS center FROM e GROUP BY cluster),
d AS (SELECT e.id, e.cluster, sqrt({sq}) AS dist FROM e JOIN c USING (cluster)),
m AS (SELECT cluster, median(dist) AS median_dist FROM d GROUP BY cluster),
s AS (SELECT d.id, d.cluster, d.dist, m.median_dist,
             CASE WHEN m.median_dist > 0 THEN d.dist / m.median_dist END AS score FROM d JOIN m USING (cluster))
{final}"""


def _reldist(spark, sf):
    pts = _emb_points(spark, sf)
    return clu.relative_distance(pts, _label_centroids(pts, EMB_DIMS), "id", "x", "cluster")


@register("d8_median_distance", _reldist_sql(
    "SELECT cluster, CAST(printf('%.9e', median_dist) AS DOUBLE) AS median_dist FROM m"))
def d8_median_distance(spark, sf):
    """Exact median distance to the class centroid per embedding class."""
    pts = _emb_points(spark, sf)
    d = (pts.join(F.broadcast(_label_centroids(pts, EMB_DIMS)), "cluster")
         .select("id", "cluster", clu.euclidean("x", "center").alias("dist")))
    from churnlens.functions.ranking import exact_median
    m = exact_median(d, ["cluster"], "dist", "id", "median_dist")
    return m.select("cluster", round_sig("median_dist", 10).alias("median_dist"))


@register("l16_relative_distance", _reldist_sql(
    "SELECT id, cluster, CAST(printf('%.9e', score) AS DOUBLE) AS score FROM s"))
def l16_relative_distance(spark, sf):
    """Distance to the centroid over the class median distance, per embedding."""
    return _reldist(spark, sf).select("id", "cluster", round_sig("score", 10).alias("score"))


@register("l17_outliers_removed", _reldist_sql("SELECT id, cluster FROM s WHERE score <= 2"))
def l17_outliers_removed(spark, sf):
    """Embeddings kept after dropping relative distance above 2."""
    return clu.remove_outliers(_reldist(spark, sf), 2.0).select("id", "cluster")


# --- models (rows-only checks; unit tests cover their rules) ---------------------

from churnlens.plans import models as mdl  # noqa: E402
from churnlens.plans import stack as stk  # noqa: E402
from churnlens.plans import tune as tun  # noqa: E402

# Notebook-era library defaults of the compared estimators
# (gradient boosting 100 stages of depth 3, forest 10 trees without a depth limit - 30
# is the most Spark allows - 5 neighbours).
DEFAULT_GBT = dict(maxIter=100, maxDepth=3, stepSize=0.1)
DEFAULT_FOREST = dict(numTrees=10, maxDepth=30)


def train_vectors_a(spark, sf) -> DataFrame:
    """Half-A training month as (user_id, features, label)."""
    return feat.assemble(feat.process_features(h9_train_features(spark, sf), labelled=True))


def scored_vectors_a(spark, sf) -> DataFrame:
    return feat.assemble(feat.process_features(h10_scored_features(spark, sf), labelled=False), keep=("user_id",))


def _fit_half_a(spark, sf):
    data = train_vectors_a(spark, sf).persist()
    train, test = spl.hash_split(data, "user_id", 0.7, 0)
    return mdl.fit_churn_pipeline(train), test


@register("h5_pipeline_holdout")
def h5_pipeline_holdout(spark, sf):
    """Index -> vector index -> logistic regression pipeline; holdout predictions."""
    model, test = _fit_half_a(spark, sf)
    return model.transform(test).select("user_id", "label", "prediction", "predictedLabel")


@register("h7_scored_predictions")
def h7_scored_predictions(spark, sf):
    """Model of the training month applied to the scored month: (user_id, predictedLabel)."""
    model, _ = _fit_half_a(spark, sf)
    return mdl.score(scored_vectors_a(spark, sf), model)


@register("h8_backtest_rows")
def h8_backtest_rows(spark, sf):
    """Predictions of the scored month against the later account snapshot."""
    rows, _ = mdl.backtest(h7_scored_predictions(spark, sf), fx.user_state(spark, sf))
    return rows


@register("h8_backtest_metrics")
def h8_backtest_metrics(spark, sf):
    """weightedPrecision / weightedRecall of the back-test."""
    _, m = mdl.backtest(h7_scored_predictions(spark, sf), fx.user_state(spark, sf))
    return m


def vectors_b(spark, sf, cols=None, by=prep.LABEL_COL):
    """Half-B training and holdout frames: (cust_id, features, label[, fold]); folds are
    stratified by ``by``, plain without it."""
    cols = cols or _B
    # Folds need an order, whose ranges are sampled first: written out, the table is built once.
    ensure_checkpoint_dir(spark)
    tr = spl.assign_folds(churn_train(spark, sf).checkpoint(), prep.ID_COL, 5, by=by)
    vtr = mdl.dealt(mdl.to_vectors(tr, cols, prep.LABEL_COL, prep.ID_COL, keep=("fold",)), prep.ID_COL).persist()
    # Kept as well: every model that scores them would build the table again.
    vte = mdl.dealt(mdl.to_vectors(churn_test(spark, sf), cols, prep.LABEL_COL, prep.ID_COL), prep.ID_COL).persist()
    return vtr, vte


@register("k7_gbt_holdout")
def k7_gbt_holdout(spark, sf):
    """Tuned gradient-boosted trees fitted on the training rows, holdout predictions."""
    vtr, vte = vectors_b(spark, sf)
    return mdl.fit_predict(mdl.gbt(**mdl.TUNED_GBT), vtr, vte).select(prep.ID_COL, "label", "prediction")


@register("k6_forest_holdout")
def k6_forest_holdout(spark, sf):
    """Tuned random forest, holdout predictions."""
    vtr, vte = vectors_b(spark, sf)
    return mdl.fit_predict(mdl.forest(**mdl.TUNED_FOREST), vtr, vte).select(prep.ID_COL, "label", "prediction")


@register("k2_k4_linear_holdout")
def k2_k4_linear_holdout(spark, sf):
    """L2 and L1 logistic regression (C=1) and a linear SVC on the holdout rows."""
    vtr, vte = vectors_b(spark, sf)
    n = vtr.count()
    out = None
    for name, est in {"lr_l2": mdl.logistic(1.0, "l2", n), "lr_l1": mdl.logistic(1.0, "l1", n),
                      "svc": mdl.linear_svc()}.items():
        p = mdl.fit_predict(est, vtr, vte).select(prep.ID_COL, F.col("prediction").alias(name))
        out = p if out is None else out.join(p, prep.ID_COL)
    return out


@register("k8_gbt_importances")
def k8_gbt_importances(spark, sf):
    """Feature importances of the tuned GBT, descending."""
    vtr, _ = vectors_b(spark, sf)
    return mdl.importances(mdl.gbt(**mdl.TUNED_GBT).fit(vtr), _B)


@register("j4_cv_logistic")
def j4_cv_logistic(spark, sf):
    """Per-fold precision / recall of logistic regression over the stratified folds."""
    vtr, _ = vectors_b(spark, sf)
    return tun.cross_validate(vtr, mdl.logistic())


@register("j5_compare_models")
def j5_compare_models(spark, sf):
    """Mean CV precision / recall of the five compared classifiers."""
    vtr, _ = vectors_b(spark, sf)
    ests = {"logistic": mdl.logistic(1.0, "l2", vtr.count()), "svc": mdl.linear_svc(),
            "forest": mdl.forest(**DEFAULT_FOREST)}
    cv = tun.compare_models(vtr, ests).unionByName(
        spark.createDataFrame([("gbt", *_boosted(spark, sf, vtr).cv(_B))], "model string, precision double, recall double"))
    # kNN has no fit step: vote per fold with the other folds as reference.
    pts = vtr.select(F.col(prep.ID_COL).alias("id"), F.col("features"), "label", "fold")
    from pyspark.ml.functions import vector_to_array
    pts = pts.withColumn("x", vector_to_array("features")).withColumnRenamed("label", "y")
    folds = [r[0] for r in pts.select("fold").distinct().collect()]
    rows = []
    for f in sorted(folds):
        pred = nbr.knn_classify(pts.where(F.col("fold") != f), pts.where(F.col("fold") == f), 5)
        j = pred.join(pts.select("id", F.col("y").alias("label")), "id")
        m = met.precision_recall(j, "label", "prediction", 1).first()
        rows.append((m.precision, m.recall))
    knn_row = spark.createDataFrame(
        [("knn", sum(r[0] for r in rows) / len(rows), sum(r[1] for r in rows) / len(rows))],
        "model string, precision double, recall double")
    return cv.unionByName(knn_row)


@register("l13_sse_curve")
def l13_sse_curve(spark, sf):
    """K-means within-cluster sum of squares for k = 1..9 (training rows, label excluded)."""
    return clu.sse_curve(churn_train(spark, sf), _B, range(1, 10))


@register("l14_silhouette_curve")
def l14_silhouette_curve(spark, sf):
    """Silhouette (squared Euclidean) for k = 2..9."""
    return clu.silhouette_curve(churn_train(spark, sf), _B, range(2, 10))


@register("l15_kmeans_sizes")
def l15_kmeans_sizes(spark, sf):
    """Cluster sizes of K-means with k=4 and 500 iterations."""
    assign, _ = clu.kmeans_fit(churn_train(spark, sf), _B, prep.ID_COL, 4, 500, 0)
    return clu.cluster_sizes(assign)


@register("j15_stacking")
def j15_stacking(spark, sf):
    """Forest + GBT stacked by out-of-fold predictions over plain folds, meta GBT on the holdout rows."""
    vtr, vte = vectors_b(spark, sf, by=None)
    base = {"gbt": mdl.gbt(**mdl.TUNED_GBT), "rf": mdl.forest(**mdl.TUNED_FOREST)}
    st_tr, st_te = stk.stack_features(base, vtr, vte, prep.ID_COL)
    pred = stk.fit_stack(mdl.gbt(maxIter=20, maxDepth=3), st_tr, st_te, list(base))
    return pred.select(prep.ID_COL, "gbt", "rf", "label", "prediction")


# --- sinks, SQL edge, indexers ----------------------------------------------------

@register("a4_parquet_sink", sql.feature_sql(fx.TRAIN_DAYS, fx.ORDER_WINDOW, labelled=True))
def a4_parquet_sink(spark, sf):
    """Training features written as Parquet (fails if the path exists) and read back."""
    import uuid

    from churnlens.session import scratch_path
    from churnlens.sources.io import write_parquet

    path = scratch_path(spark, f"features_{uuid.uuid4().hex}")
    write_parquet(h9_train_features(spark, sf), path, partition_by="nns_state")
    return spark.read.parquet(path).select(*feat.FEATURE_COLS_OUT)


@register("a6_a7_model_roundtrip")
def a6_a7_model_roundtrip(spark, sf):
    """Pipeline saved with overwrite to the shared folder, loaded back, used to score."""
    import uuid

    from churnlens.session import scratch_path
    from churnlens.sources.io import load_model, save_model

    model, test = _fit_half_a(spark, sf)
    path = scratch_path(spark, f"model_{uuid.uuid4().hex}")
    save_model(model, path)
    return mdl.score(test, load_model(path))


@register("a8_sql_view", f"""
WITH {sql.play_cte(fx.TRAIN_DAYS).strip()},
{sql.GAPS_CTE.strip()}
SELECT user_id, video_type, gap_ms / 60000.0::DOUBLE AS watch_time FROM d""")
def a8_sql_view(spark, sf):
    """SQL users: the play log as a temp view, watch gaps in Spark SQL with lead()."""
    from churnlens.sources.io import register as reg

    reg({"playlog": fx.play_log(spark, sf, fx.TRAIN_DAYS)})
    return spark.sql("""
        SELECT user_id, video_type, watch_time / 60000.0D AS watch_time FROM (
          SELECT user_id, video_type,
                 lead(server_time) OVER (PARTITION BY user_id ORDER BY server_time, event_id) - server_time AS watch_time
          FROM playlog WHERE user_id IS NOT NULL) c
        WHERE watch_time IS NOT NULL""")


@register("a10_preview", f"""
SELECT * FROM ({sql.feature_sql(fx.TRAIN_DAYS, fx.ORDER_WINDOW, labelled=True)}) t ORDER BY user_id LIMIT 10""")
def a10_preview(spark, sf):
    """First ten feature rows under a total order (``show(10)`` with a defined answer)."""
    from churnlens.sources.io import preview

    return preview(h9_train_features(spark, sf), 10, "user_id")


@register("d6_count", f"""
SELECT COUNT(*) AS n_rows FROM ({sql.feature_sql(fx.TRAIN_DAYS, fx.ORDER_WINDOW, labelled=True)}) t""")
def d6_count(spark, sf):
    """Global row count of the labelled training features."""
    return h9_train_features(spark, sf).agg(F.count(F.lit(1)).alias("n_rows"))


@register("b17_concat_by_id", f"""{_TRAIN}
SELECT t.*, CAST(ntile(5) OVER (PARTITION BY t."Churn?" ORDER BY t.cust_id) - 1 AS INTEGER) AS fold FROM train t""")
def b17_concat_by_id(spark, sf):
    """Column-wise concatenation of the training rows and their folds by id (no positions)."""
    t = churn_train(spark, sf)
    folds = spl.assign_folds(t.select(prep.ID_COL, prep.LABEL_COL), prep.ID_COL, 5, by=prep.LABEL_COL)
    return prep.join_on_row_id(t, folds.select(prep.ID_COL, "fold"))


@register("h2_label_index", f"""
WITH f AS ({_processed_sql(fx.TRAIN_DAYS)}),
c AS (SELECT CAST(CAST(label AS DOUBLE) AS VARCHAR) AS label, COUNT(*) AS n FROM f GROUP BY 1)
SELECT label, CAST(row_number() OVER (ORDER BY n DESC, label) - 1 AS DOUBLE) AS label_index FROM c""")
def h2_label_index(spark, sf):
    """StringIndexer order of the label (most frequent first), fitted on the training features."""
    from pyspark.ml.feature import StringIndexer

    f = feat.process_features(h9_train_features(spark, sf), labelled=True).withColumn(
        "label", F.col("label").cast("double"))
    m = StringIndexer(inputCol="label", outputCol="idx").fit(f)
    return spark.createDataFrame([(lab, float(i)) for i, lab in enumerate(m.labels)], "label string, label_index double")


@register("h3_categorical_slots", f"""
WITH f AS ({_processed_sql(fx.TRAIN_DAYS)})
{" UNION ALL ".join(f"SELECT {i} AS slot, COUNT(DISTINCT {c}) <= 10 AS categorical FROM f" for i, c in enumerate(feat.FEATURE_COLS))}""")
def h3_categorical_slots(spark, sf):
    """Feature slots that VectorIndexer(maxCategories=10) treats as categorical."""
    from pyspark.ml.feature import VectorIndexer

    v = feat.assemble(feat.process_features(h9_train_features(spark, sf), labelled=True))
    m = VectorIndexer(inputCol="features", outputCol="idx", maxCategories=10, handleInvalid="keep").fit(v)
    cats = set(m.categoryMaps)
    return spark.createDataFrame([(i, i in cats) for i in range(len(feat.FEATURE_COLS))],
                                 "slot int, categorical boolean")


@register("l13_sse_k1", f"""{_LONG}
SELECT CAST(printf('%.11e', SUM(v)) AS DOUBLE) AS sse FROM (SELECT var_pop(x) * COUNT(*) AS v FROM long GROUP BY feature) t""")
def l13_sse_k1(spark, sf):
    """Within-cluster sum of squares for one cluster (k = 1: total sum of squares)."""
    return spark.createDataFrame([(clu.total_sum_of_squares(churn_train(spark, sf), _B),)], "sse double") \
        .select(round_sig("sse", 12).alias("sse"))


# --- back-test over stored predictions (C5, H8, I1, I2 with a DuckDB twin) --------

def _rule_predictions(spark, sf) -> DataFrame:
    """Stand-in stored predictions for the scored month: churn when the user cancelled."""
    f = b9_scored_processed(spark, sf)
    return f.select("user_id", F.when(F.col("userCancel") >= 1, 1.0).otherwise(0.0).alias("predictedLabel"))


_BACKTEST = f"""
WITH {sql.USERS_CTE.strip()},
f AS ({_processed_sql(fx.SCORED_DAYS, labelled=False)}),
pred AS (SELECT user_id, CASE WHEN userCancel >= 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS predictedLabel FROM f),
j AS (SELECT pred.user_id, pred.predictedLabel,
             CASE WHEN CAST(nns_state AS DOUBLE) = 4 OR CAST(nns_state AS DOUBLE) = 5 THEN 1.0 ELSE 0.0 END::DOUBLE AS label
      FROM pred JOIN nnsuser ON pred.user_id = nnsuser.nns_id)"""


@register("h8_backtest_stored_rows", f"{_BACKTEST}\nSELECT user_id, predictedLabel, label FROM j")
def h8_backtest_stored_rows(spark, sf):
    """Stored predictions joined to the later account snapshot and labelled."""
    rows, _ = mdl.backtest(_rule_predictions(spark, sf), fx.user_state(spark, sf))
    return rows


@register("h8_backtest_stored_metrics", f"""{_BACKTEST},
c AS (SELECT label, predictedLabel AS prediction, COUNT(*) AS n FROM j GROUP BY 1, 2),
per AS (SELECT a.cls, a.na, COALESCE(t.tp, 0) AS tp, COALESCE(p.np, 0) AS np
        FROM (SELECT label AS cls, SUM(n) AS na FROM c GROUP BY 1) a
        LEFT JOIN (SELECT label AS cls, n AS tp FROM c WHERE label = prediction) t ON a.cls = t.cls
        LEFT JOIN (SELECT prediction AS cls, SUM(n) AS np FROM c GROUP BY 1) p ON a.cls = p.cls)
SELECT SUM(na / (SELECT SUM(na) FROM per) * CASE WHEN np > 0 THEN tp / np ELSE 0 END) AS weightedPrecision,
       SUM(na / (SELECT SUM(na) FROM per) * tp / na) AS weightedRecall FROM per""")
def h8_backtest_stored_metrics(spark, sf):
    """weightedPrecision / weightedRecall of stored predictions against the later snapshot."""
    _, m = mdl.backtest(_rule_predictions(spark, sf), fx.user_state(spark, sf))
    return m


# --- profiles and checks (A11, B19, D9, D10, q12) ----------------------------------

@register("a11_shape", f"""{_TEL}
SELECT COUNT(*) AS n_rows, CAST({len(_B) + 5} AS INTEGER) AS n_columns FROM telecom""")
def a11_shape(spark, sf):
    """Rows and columns of the telecom table (``DataFrame.shape``)."""
    t = fx.telecom(spark, sf)
    return t.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(t.columns)).alias("n_columns"))


@register("b19_row_ids", f"""{_TRAIN}
SELECT t.cust_id, t."Account Length", c."Day Calls" FROM train t JOIN churn c ON t.cust_id = c.cust_id""")
def b19_row_ids(spark, sf):
    """Two column sets of one table put side by side by a stable row id, not by position."""
    t = prep.with_row_id(churn_train(spark, sf), prep.ID_COL)
    c = prep.with_row_id(churn_table(spark, sf), prep.ID_COL)
    both = prep.join_on_row_id(t.select("row_id", prep.ID_COL, "`Account Length`"), c.select("row_id", "`Day Calls`"), "row_id")
    return both.drop("row_id")


@register("d9_fold_means", f"""{_TRAIN},
f AS (SELECT "Churn?" AS y, ntile(5) OVER (ORDER BY cust_id) AS fold FROM train),
s AS (SELECT fold, AVG(CAST(y AS DOUBLE)) AS share, CAST(COUNT(*) AS DOUBLE) AS size FROM f GROUP BY fold)
SELECT 'churn' AS name, ROUND(AVG(share), 9) AS share, ROUND(AVG(size), 9) AS size FROM s""")
def d9_fold_means(spark, sf):
    """Per-fold values averaged over the folds: churn share and size of the plain folds."""
    f = spl.assign_folds(churn_train(spark, sf).select(prep.ID_COL, prep.LABEL_COL), prep.ID_COL, 5)
    per = f.groupBy("fold").agg(F.avg(F.col(f"`{prep.LABEL_COL}`").cast("double")).alias("share"),
                                F.count(F.lit(1)).cast("double").alias("size"))
    means = sc.mean_scores(per.withColumn("name", F.lit("churn")), ["name"], ["share", "size"])
    return means.select("name", F.round("share", 9).alias("share"), F.round("size", 9).alias("size"))


@register("d10_first_best", f"""{_LONG},
v AS (SELECT feature, var_pop(x) AS variance FROM long GROUP BY feature)
SELECT feature FROM v ORDER BY variance DESC, feature LIMIT 1""")
def d10_first_best(spark, sf):
    """The first best of a list of scores (a tie goes to the first): here, by variance."""
    return sc.first_best(sc.variance_scores(churn_train(spark, sf), _B), "feature", "variance").select("feature")


@register("q12_repeated_keys", f"""
WITH {sql.orders_cte().strip()}
SELECT nns_user_id, COUNT(*) AS n FROM buyorder GROUP BY 1 HAVING COUNT(*) > 1""")
def q12_repeated_keys(spark, sf):
    """Keys that a table holds more than once: here, users with several orders."""
    return prep.repeated_keys(fx.buy_order(spark, sf), ["nns_user_id"])


# --- selection sweeps (L1, L3, L5-L11): the compared model is the default GBT --------

from churnlens.plans import select as fsel  # noqa: E402

# Thresholds and column sets of the sweeps.
VARIANCE_THRESHOLDS = [0.1, 0.3, 0.5]
COEFFICIENT_THRESHOLDS = [i / 100_000 for i in range(60, 160, 5)]
IMPORTANCE_THRESHOLDS = [i / 10_000 for i in range(250, 350, 10)]
DROPPED_SETS = [["VMail Plan"], ["Night Calls", "Account Length"], ["Eve Calls"], ["Eve Calls", "Night Calls"]]


def _boosted(spark, sf, vtr: DataFrame | None = None) -> "fsel.BoostedSweep":
    """The default boosting, its fits in lock step."""
    vtr = vectors_b(spark, sf)[0] if vtr is None else vtr
    return fsel.BoostedSweep(vtr, _B, DEFAULT_GBT["maxIter"], DEFAULT_GBT["maxDepth"], DEFAULT_GBT["stepSize"])


@register("l1_variance_sweep")
def l1_variance_sweep(spark, sf):
    """CV precision and recall of GBT and forest on the columns above each variance threshold."""
    vtr, _ = vectors_b(spark, sf)
    scores = sc.variance_scores(churn_train(spark, sf), _B)
    out = None
    for name, sweep in {"gbt": _boosted(spark, sf, vtr), "forest": fsel.Sweep(vtr, _B, mdl.forest(**DEFAULT_FOREST))}.items():
        t = sweep.thresholds(scores, "variance", VARIANCE_THRESHOLDS, strict=True)[0]
        t = t.withColumn("model", F.lit(name))
        out = t if out is None else out.unionByName(t)
    return out


@register("l3_chi2_sweep")
def l3_chi2_sweep(spark, sf):
    """CV precision and recall on the k columns of best chi2, for every k."""
    return _boosted(spark, sf).best_k(l2_chi2(spark, sf), "chi2")[0]


@register("l5_mutual_info_sweep")
def l5_mutual_info_sweep(spark, sf):
    """CV precision and recall on the k columns of most mutual information, for every k."""
    return _boosted(spark, sf).best_k(l5_mutual_info(spark, sf), "mi")[0]


@register("l5_neighbor_sweep")
def l5_neighbor_sweep(spark, sf):
    """CV precision and recall on the k columns of most nearest-neighbour information, for every k."""
    return _boosted(spark, sf).best_k(l5_neighbor_information(spark, sf), "mi")[0]


@register("l6_f_sweep")
def l6_f_sweep(spark, sf):
    """CV precision and recall on the k columns of best F score, for every k."""
    return _boosted(spark, sf).best_k(l6_f_scores(spark, sf), "f_score")[0]


@register("l7_single_columns")
def l7_single_columns(spark, sf):
    """CV recall on each column alone."""
    return _boosted(spark, sf).single_columns()


@register("l8_elimination")
def l8_elimination(spark, sf):
    """Recursive elimination inside each fold: mean recall for every number of columns."""
    return _boosted(spark, sf).eliminate()[0]


@register("l9_l1_thresholds")
def l9_l1_thresholds(spark, sf):
    """CV recall on the columns whose L1 logistic coefficient reaches each threshold."""
    sweep = _boosted(spark, sf)
    model = mdl.logistic(1.0, "l1", sweep.df.count()).fit(sweep.df)
    return sweep.thresholds(mdl.coefficients(model, _B), "abs_coefficient", COEFFICIENT_THRESHOLDS)[0]


@register("l10_gbt_thresholds")
def l10_gbt_thresholds(spark, sf):
    """CV recall on the columns whose GBT importance reaches each threshold."""
    sweep = _boosted(spark, sf)
    return sweep.thresholds(sweep.importances(), "importance", IMPORTANCE_THRESHOLDS)[0]


@register("l11_dropped_columns")
def l11_dropped_columns(spark, sf):
    """CV precision and recall without each of the named sets of columns."""
    sweep = _boosted(spark, sf)
    left = {",".join(d): [c for c in _B if c not in d] for d in DROPPED_SETS}
    sweep.cv_many(left.values())
    rows = [(name, *sweep.cv(keep)) for name, keep in left.items()]
    return spark.createDataFrame(rows, "dropped string, precision double, recall double")


# The boosting grids, searched one after another.
GBT_TREES, GBT_TREES_DEPTH = range(75, 90), 4


@register("j6_gbt_trees")
def j6_gbt_trees(spark, sf):
    """CV precision and recall of boosting for every number of trees of the grid, from one fit a fold."""
    return _boosted(spark, sf).tree_counts(GBT_TREES, GBT_TREES_DEPTH)


from churnlens.plans import boosting as bst  # noqa: E402
from churnlens.plans import pruning as prn  # noqa: E402

# The forest grids, searched one after another.
FOREST_TREES = range(55, 90, 5)
FOREST_DEPTHS, FOREST_SPLITS = range(3, 8), range(2, 100, 20)
FOREST_LEAF_SPLITS, FOREST_LEAVES = range(2, 200, 50), range(1, 100, 10)


def _forest_search(spark, sf) -> "prn.ForestSearch":
    """A search that has the number of trees (from forests without a depth limit)."""
    vtr, _ = vectors_b(spark, sf)
    search = prn.ForestSearch(vtr, len(_B))
    search.stage("trees", trees=FOREST_TREES)
    return search


@register("j9_forest_trees")
def j9_forest_trees(spark, sf):
    """CV precision and recall of forests for every number of trees of the grid, from one forest a fold."""
    return _forest_search(spark, sf).table().select("trees", "precision", "recall")


@register("j10_forest_depth_split")
def j10_forest_depth_split(spark, sf):
    """Depth x minimum split at the best number of trees, from one deep forest a fold."""
    search = _forest_search(spark, sf)
    search.stage("depth x split", depth=FOREST_DEPTHS, min_split=FOREST_SPLITS)
    return search.table().where("stage = 'depth x split'").select("trees", "depth", "min_split", "precision", "recall")


@register("j12_forest_stages")
def j12_forest_stages(spark, sf):
    """All four stages of the forest search: trees, depth x split, split x leaf, columns per split."""
    search = _forest_search(spark, sf)
    search.stage("depth x split", depth=FOREST_DEPTHS, min_split=FOREST_SPLITS)
    search.stage("split x leaf", min_split=FOREST_LEAF_SPLITS, min_leaf=FOREST_LEAVES)
    search.stage("columns per split", max_features=range(1, len(_B) + 1))
    return search.table()


# --- flows into a fit (L12, L15-L17, B14) and the kernel classifier (K4) --------------

# The tuned boosting, with the minimum split that Spark's own lacks.
TUNED_TREES, TUNED_SHAPE = 78, dict(depth=5, min_split=52)
WITHOUT_EVE = [c for c in _B if c != "Eve Calls"]
HELD = 1  # fold of the holdout rows; training rows are fold 0


def _x_rows(df: DataFrame, cols, fold) -> DataFrame:
    return nbr.as_points(df, cols, prep.ID_COL, prep.LABEL_COL).withColumn("fold", F.lit(fold).cast("int"))


def _boosted_holdout(train: DataFrame, test: DataFrame, n_columns: int) -> DataFrame:
    """(precision, recall) on ``test`` of the tuned boosting fitted on ``train`` (x, y)."""
    from pyspark.ml.functions import array_to_vector

    rows = train.select("x", "y", F.lit(0).alias("fold")).unionByName(test.select("x", "y", F.lit(HELD).alias("fold")))
    frame = rows.select(array_to_vector("x").alias("features"), F.col("y").alias("label"), "fold").persist()
    found = bst.fit(frame, n_columns, [bst.Model(tuple(range(n_columns)), HELD, **TUNED_SHAPE)], TUNED_TREES)
    frame.unpersist()
    return train.sparkSession.createDataFrame([(float(found.precision[-1, 0]), float(found.recall[-1, 0]))],
                                              "precision double, recall double")


@register("l12_smote_folds")
def l12_smote_folds(spark, sf):
    """CV precision and recall of the default boosting with SMOTE inside every training part
    (no synthetic row has a parent among the rows that score it)."""
    from pyspark.ml.functions import array_to_vector

    folds = spl.assign_folds(churn_train(spark, sf), prep.ID_COL, 5, by=prep.LABEL_COL)
    pts = nbr.as_points(folds, WITHOUT_EVE, prep.ID_COL, prep.LABEL_COL, keep=("fold",)).persist()
    new = rs.smote_folds(pts).select("x", "y", bst.own_rows(F.col("fold")).alias("fold"))
    rows = pts.select("x", "y", "fold").unionByName(new)
    frame = rows.select(array_to_vector("x").alias("features"), F.col("y").alias("label"), "fold").persist()
    every = sorted(r[0] for r in pts.select("fold").distinct().collect())
    columns = tuple(range(len(WITHOUT_EVE)))
    found = bst.fit(frame, len(columns), [bst.Model(columns, f, DEFAULT_GBT["maxDepth"]) for f in every], DEFAULT_GBT["maxIter"])
    for df in (frame, pts):
        df.unpersist()
    return spark.createDataFrame([(int(f), float(found.precision[-1, k]), float(found.recall[-1, k])) for k, f in enumerate(every)],
                                 "fold int, precision double, recall double")


@register("l12_smote_holdout")
def l12_smote_holdout(spark, sf):
    """Tuned boosting fitted on the training rows brought to parity, on the holdout rows."""
    train = rs.oversample(nbr.as_points(churn_train(spark, sf), WITHOUT_EVE, prep.ID_COL, prep.LABEL_COL))
    return _boosted_holdout(train, _x_rows(churn_test(spark, sf), WITHOUT_EVE, HELD), len(WITHOUT_EVE))


def _kept_train(spark, sf) -> DataFrame:
    """Training rows without those far from their cluster's centre: K-means (label among the
    columns, as in the notebook), relative distance, threshold 2."""
    train, cols = churn_train(spark, sf).persist(), [*_B, prep.LABEL_COL]
    assign, centers = clu.kmeans_fit(train, cols, prep.ID_COL, 4, 500, 0)
    pts = nbr.as_points(train, cols, prep.ID_COL).join(assign.withColumnRenamed(prep.ID_COL, "id"), "id")
    # A cluster of equal rows has no distance to compare: its rows stay.
    scored = clu.relative_distance(pts, centers, "id", "x", "cluster").withColumn("score", F.coalesce("score", F.lit(0.0)))
    kept = clu.remove_outliers(scored, 2.0).select(F.col("id").alias(prep.ID_COL))
    return train.join(kept, prep.ID_COL)


@register("l17_kmeans_kept")
def l17_kmeans_kept(spark, sf):
    """Training customers left after K-means outlier removal."""
    return _kept_train(spark, sf).select(prep.ID_COL)


@register("l17_outlier_holdout")
def l17_outlier_holdout(spark, sf):
    """Tuned boosting fitted without the K-means outliers, on the holdout rows."""
    return _boosted_holdout(_x_rows(_kept_train(spark, sf), WITHOUT_EVE, 0), _x_rows(churn_test(spark, sf), WITHOUT_EVE, HELD),
                            len(WITHOUT_EVE))


@register("b14_cross_holdout")
def b14_cross_holdout(spark, sf):
    """Tuned boosting on the cross features in place of their parts, on the holdout rows."""
    train, test = (prep.add_cross_features(t(spark, sf)) for t in (churn_train, churn_test))
    cols = [c for c in train.columns if c not in (prep.ID_COL, prep.LABEL_COL)]
    return _boosted_holdout(_x_rows(train, cols, 0), _x_rows(test, cols, HELD), len(cols))


@register("k4_kernel_svc")
def k4_kernel_svc(spark, sf):
    """Support-vector classifier with an RBF kernel by random Fourier features, holdout predictions."""
    vtr, vte = vectors_b(spark, sf)
    return mdl.fit_predict(mdl.kernel_svc(len(_B)), vtr, vte).select(prep.ID_COL, "label", "prediction")


# Dozens to hundreds of fits each; run after the others.
SWEEPS = ("l12_smote_folds", "l12_smote_holdout", "l17_outlier_holdout", "b14_cross_holdout", "j9_forest_trees", "j10_forest_depth_split", "j12_forest_stages", "j6_gbt_trees", "l1_variance_sweep", "l3_chi2_sweep", "l5_mutual_info_sweep", "l5_neighbor_sweep", "l6_f_sweep", "l7_single_columns",
          "l8_elimination", "l9_l1_thresholds", "l10_gbt_thresholds", "l11_dropped_columns")
