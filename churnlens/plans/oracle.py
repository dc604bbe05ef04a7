"""DuckDB SQL twins of the registered queries.

shared misreading is less likely: window functions, filtered aggregates, ``ntile`` and
``median`` over the driver's parquet views.
"""

from __future__ import annotations

from churnlens.sources import fixtures as fx


def play_cte(days=None) -> str:
    where = f"WHERE day BETWEEN {days[0]} AND {days[1]}" if days else ""
    return f"""
play AS (
  SELECT * FROM (
    SELECT user_id,
           CASE event_type WHEN 'view' THEN 'vod' WHEN 'click' THEN 'live' ELSE event_type END AS video_type,
           epoch_us(ts) // 1000 AS server_time,
           CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 = 0 THEN NULL
                ELSE 'd' || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 AS VARCHAR) END AS device_id,
           CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS day,
           event_id
    FROM events) p {where})"""


def userlog_cte(days=None) -> str:
    where = f"WHERE day BETWEEN {days[0]} AND {days[1]}" if days else ""
    return f"""
userlog AS (
  SELECT * FROM (
    SELECT user_id,
           CASE event_type WHEN 'signup' THEN 'search' ELSE event_type END AS event_name,
           CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS day
    FROM events) u {where})"""


def orders_cte(window=None) -> str:
    where = (f"WHERE strftime(make_timestamp(nns_modify_time * 1000), '%Y-%m-%d') "
             f"BETWEEN '{window[0]}' AND '{window[1]}'") if window else ""
    return f"""
buyorder AS (
  SELECT * FROM (
    SELECT o_custkey AS nns_user_id,
           CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN 'other' ELSE 'product_buy' END AS nns_order_type,
           CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 5 ELSE 0 END AS nns_order_state,
           o_totalprice AS nns_order_price,
           epoch_us(o_orderdate) // 1000 AS nns_modify_time
    FROM orders) o {where})"""


USERS_CTE = """
nnsuser AS (
  SELECT c_custkey AS nns_id,
         CASE c_mktsegment WHEN 'MACHINERY' THEN 4 WHEN 'FURNITURE' THEN 5 WHEN 'AUTOMOBILE' THEN 1 ELSE 0 END AS nns_state
  FROM customer)"""


# Per play row, the time to the same user's next row; d has the rows with a next one.
GAPS_CTE = """
steps AS (
  SELECT user_id, event_id, video_type, device_id,
         lead(server_time) OVER (PARTITION BY user_id ORDER BY server_time NULLS FIRST, event_id) - server_time AS gap_ms
  FROM play WHERE user_id IS NOT NULL),
d AS (SELECT * FROM steps WHERE gap_ms IS NOT NULL)"""


def minutes(cond: str = "TRUE") -> str:
    """Watch minutes of the gaps that meet ``cond``; null without any."""
    return f"CAST(SUM(gap_ms) FILTER ({cond}) AS DOUBLE) / 60000.0::DOUBLE"


VIEWING_CTE = f"""
viewing AS (
  SELECT user_id, {minutes()} AS user_time, COUNT(device_id) AS device_freq, COUNT(DISTINCT device_id) AS device_uni,
         {minutes("video_type = 'vod'")} AS vod_time, {minutes("video_type = 'live'")} AS live_time
  FROM steps GROUP BY user_id HAVING COUNT(gap_ms) > 0)"""

SEARCH_CTE = """
searches AS (
  SELECT user_id, COUNT(*) FILTER (event_name = 'search') AS userSearch
  FROM userlog GROUP BY user_id HAVING bool_or(event_name = 'search'))"""

SHOPPING_CTE = """
shopping AS (
  SELECT nns_user_id AS user_id,
         NULLIF(COUNT(*) FILTER (nns_order_state = 1 AND nns_order_type = 'other'), 0) AS userOther,
         ROUND(SUM(nns_order_price) FILTER (nns_order_state = 1), 2) AS userOffer,
         NULLIF(COUNT(*) FILTER (nns_order_state = 5), 0) AS userCancel
  FROM buyorder GROUP BY 1)"""


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts)


def feature_sql(days, window, labelled: bool = True) -> str:
    """One grouped pass for each source, joined by user; with ``labelled`` only users in
    a labelled state."""
    state = ", nns_state" if labelled else ""
    users = "JOIN nnsuser ON nns_id = user_id AND nns_state IN (0, 4, 5)" if labelled else ""
    return f"""
{ctes(play_cte(days), userlog_cte(days), orders_cte(window), USERS_CTE, GAPS_CTE, VIEWING_CTE, SEARCH_CTE, SHOPPING_CTE)}
SELECT user_id, user_time, device_freq, device_uni, vod_time, live_time, userSearch, userOther, userOffer, userCancel{state}
FROM viewing LEFT JOIN searches USING (user_id) LEFT JOIN shopping USING (user_id) {users}"""


TELECOM_CTE = """
li AS (
  SELECT o.o_custkey AS cust,
         o.o_orderkey, o.o_orderstatus, l.*
  FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey),
per_cust AS (
  SELECT cust,
    COUNT(DISTINCT o_orderkey) AS acct,
    COUNT(DISTINCT CASE WHEN o_orderstatus = 'P' THEN o_orderkey END) AS cs,
    COUNT(CASE WHEN l_discount > 0.05 THEN 1 END) AS vm,
    COALESCE(SUM(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 0) AS day_m,
    COUNT(CASE WHEN l_returnflag = 'R' THEN 1 END) AS day_c,
    ROUND(COALESCE(SUM(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END), 0), 2) AS day_g,
    COALESCE(SUM(CASE WHEN l_returnflag = 'A' THEN l_quantity END), 0) AS eve_m,
    COUNT(CASE WHEN l_returnflag = 'A' THEN 1 END) AS eve_c,
    ROUND(COALESCE(SUM(CASE WHEN l_returnflag = 'A' THEN l_extendedprice END), 0), 2) AS eve_g,
    COALESCE(SUM(CASE WHEN l_returnflag = 'N' THEN l_quantity END), 0) AS night_m,
    COUNT(CASE WHEN l_returnflag = 'N' THEN 1 END) AS night_c,
    ROUND(COALESCE(SUM(CASE WHEN l_returnflag = 'N' THEN l_extendedprice END), 0), 2) AS night_g,
    COALESCE(SUM(CASE WHEN l_linestatus = 'O' THEN l_quantity END), 0) AS intl_m,
    COUNT(CASE WHEN l_linestatus = 'O' THEN 1 END) AS intl_c,
    ROUND(COALESCE(SUM(CASE WHEN l_linestatus = 'O' THEN l_extendedprice END), 0), 2) AS intl_g
  FROM li GROUP BY cust),
telecom AS (
  SELECT p.cust AS cust_id, n.n_name AS "State", p.acct AS "Account Length", c.c_nationkey AS "Area Code",
         c.c_name AS "Phone",
         CASE WHEN c.c_mktsegment = 'BUILDING' THEN 'yes' ELSE 'no' END AS "Int'l Plan",
         CASE WHEN c.c_acctbal > 5000 THEN 'yes' ELSE 'no' END AS "VMail Plan",
         p.vm AS "VMail Message",
         p.day_m AS "Day Mins", p.day_c AS "Day Calls", p.day_g AS "Day Charge",
         p.eve_m AS "Eve Mins", p.eve_c AS "Eve Calls", p.eve_g AS "Eve Charge",
         p.night_m AS "Night Mins", p.night_c AS "Night Calls", p.night_g AS "Night Charge",
         p.intl_m AS "Intl Mins", p.intl_c AS "Intl Calls", p.intl_g AS "Intl Charge",
         p.cs AS "CustServ Calls",
         CASE WHEN p.day_g > 900000 THEN 'True.' ELSE 'False.' END AS "Churn?"
  FROM per_cust p JOIN customer c ON c.c_custkey = p.cust
  LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey),
churn AS (
  SELECT cust_id, "Account Length",
         CASE WHEN "Int'l Plan" = 'yes' THEN 1 ELSE 0 END AS "Int'l Plan",
         CASE WHEN "VMail Plan" = 'yes' THEN 1 ELSE 0 END AS "VMail Plan",
         "VMail Message", "Day Mins", "Day Calls", "Day Charge", "Eve Mins", "Eve Calls", "Eve Charge",
         "Night Mins", "Night Calls", "Night Charge", "Intl Mins", "Intl Calls", "Intl Charge",
         "CustServ Calls",
         CASE WHEN "Churn?" = 'True.' THEN 1 ELSE 0 END AS "Churn?"
  FROM telecom)"""

# md5 split / bucket as in churnlens.functions.columns.hash_u32
def hash_u32_sql(*parts: str) -> str:
    key = " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"('0x' || substr(md5({key}), 1, 8))::BIGINT"


FEATURES_B = ["Account Length", "Int'l Plan", "VMail Plan", "VMail Message",
              "Day Mins", "Day Calls", "Day Charge", "Eve Mins", "Eve Calls", "Eve Charge",
              "Night Mins", "Night Calls", "Night Charge", "Intl Mins", "Intl Calls", "Intl Charge",
              "CustServ Calls"]


def qi(c: str) -> str:
    return '"' + c.replace('"', '""') + '"'


def lit(c: str) -> str:
    return "'" + c.replace("'", "''") + "'"


def train_cte() -> str:
    return f"""
train AS (SELECT * FROM churn WHERE {hash_u32_sql('0', 'cust_id')} % 1000 < 700)"""


def long_cte(src: str = "train") -> str:
    """Unpivot the feature columns of ``src`` into (cust_id, y, feature, x)."""
    parts = " UNION ALL ".join(
        f"SELECT cust_id, CAST(\"Churn?\" AS DOUBLE) AS y, {lit(c)} AS feature, CAST({qi(c)} AS DOUBLE) AS x FROM {src}"
        for c in FEATURES_B)
    return f"""
long AS ({parts})"""
