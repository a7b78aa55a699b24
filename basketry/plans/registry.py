"""Where queries register with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import roles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The clean roles in the SQL of the engine that checks.
CLEAN = """
customers AS (SELECT c_custkey AS customer_id, CAST(DATE '1994-06-01' + CAST((c_custkey * 37) % 500 AS INT) AS DATE) AS signup_date, 'CITY_' || c_nationkey AS city, 'COUNTRY_' || c_nationkey AS country,
  CAST(1 + c_custkey % 6 AS INT) AS household_size, CASE c_custkey % 3 WHEN 0 THEN 'bronze' WHEN 1 THEN 'silver' ELSE 'gold' END AS tier,
  CASE c_custkey % 4 WHEN 0 THEN 'app' WHEN 1 THEN 'web' ELSE 'store' END AS preferred_channel, c_custkey % 5 = 0 AS churn_label FROM customer),
products AS (SELECT p_partkey AS product_id, p_type AS department, p_brand AS category, p_name AS brand, p_partkey % 4 = 0 AS private_label, p_retailprice AS unit_price,
  10 + p_size AS typical_days, CAST(1 + p_size % 6 AS INT) AS pack_size, p_partkey % 3 = 0 AS perishable FROM part),
promotions AS (SELECT p_partkey AS promotion_id, p_partkey AS product_id, CASE p_partkey % 3 WHEN 0 THEN '2x1' WHEN 1 THEN 'discount_pct' ELSE 'coupon' END AS promo_type,
  CAST(p_partkey % 50 AS DOUBLE) / 100 AS discount_value, CAST(DATE '1995-06-01' + CAST((p_partkey * 13) % 2000 AS INT) AS DATE) AS start_date,
  CAST(DATE '1995-06-01' + CAST((p_partkey * 13) % 2000 + 5 + p_partkey % 30 AS INT) AS DATE) AS end_date FROM part WHERE p_partkey % 7 = 0),
baskets AS (SELECT o_orderkey AS basket_id, CASE WHEN o_orderkey % 10 <> 3 THEN o_custkey END AS customer_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'app' WHEN '2-HIGH' THEN 'web' ELSE 'store' END AS channel, o_orderdate + to_hours(CAST(o_orderkey % 24 AS INT)) AS basket_ts,
  CAST(o_orderdate AS DATE) AS basket_day, o_totalprice AS total_amount FROM orders),
items AS (SELECT l_orderkey AS basket_id, l_partkey AS product_id, CAST(l_quantity AS INT) AS quantity, l_extendedprice AS line_amount, l_discount >= 0.05 AS is_promo, CASE WHEN l_partkey % 7 = 0 AND l_discount >= 0.05 THEN l_partkey END AS promotion_id FROM lineitem),
log AS (SELECT user_id, ts, event_type, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS d, CAST(json_extract_string(props, '$.k') AS BIGINT) AS product_id,
  user_id * 1000 + date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS session_id FROM events),
sessions AS (SELECT session_id, max(CASE WHEN user_id % 9 <> 0 THEN user_id END) AS customer_id, min(ts) AS session_ts,
  max(CASE user_id % 3 WHEN 0 THEN 'mobile' WHEN 1 THEN 'desktop' ELSE 'tablet' END) AS device, max(CASE WHEN event_type = 'purchase' THEN user_id * 7 + d END) AS basket_id FROM log GROUP BY 1),
sevents AS (SELECT session_id, product_id, CASE WHEN event_type IN ('click', 'purchase') THEN 'add_to_cart' ELSE 'view' END AS event_type, ts AS event_ts FROM log)"""

#: The raw roles, on top of the clean ones.
RAW = (
    CLEAN
    + """,
rcustomers AS (SELECT * REPLACE (CASE WHEN customer_id % 17 <> 0 THEN city END AS city, CASE WHEN customer_id % 7 = 0 THEN CAST(signup_date + 2000 AS DATE) ELSE signup_date END AS signup_date) FROM customers),
rproducts AS (SELECT * REPLACE (CASE WHEN product_id % 11 = 0 THEN upper(category) WHEN product_id % 13 = 0 THEN '  ' || category ELSE category END AS category,
  CASE WHEN product_id % 19 <> 0 THEN brand END AS brand) FROM products),
rpromotions AS (SELECT * REPLACE (CASE WHEN product_id % 77 = 0 THEN CAST(start_date - 3 AS DATE) ELSE end_date END AS end_date) FROM promotions),
ritems AS (SELECT basket_id, product_id, CASE WHEN (basket_id + product_id) % 9 = 0 THEN -quantity WHEN (basket_id + product_id) % 101 = 0 THEN 0 ELSE quantity END AS quantity,
  round(line_amount / quantity * 100) / 100 AS unit_price_paid, CASE WHEN product_id % 7 = 0 AND is_promo THEN product_id END AS promotion_id FROM items),
rbaskets AS (SELECT *, CASE WHEN channel = 'store' AND basket_id % 50 <> 0 THEN basket_id % 20 END AS store_id FROM baskets),
rsessions AS (SELECT *, basket_id IS NOT NULL OR session_id % 10 = 0 AS converted FROM sessions),
revents AS (SELECT * FROM sevents UNION ALL SELECT * FROM sevents WHERE session_id % 20 = 0)"""
)


def query(name: str, sql: str | None = None, tables: str = "clean") -> Callable:
    """Register a function of the tables by role; ``sql`` goes on after the roles' WITH."""

    def add(make: Callable[[roles.Tables], DataFrame]) -> Callable:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        bind = roles.raw if tables == "raw" else roles.clean
        QUERIES[name] = lambda spark, sf_dir: make(bind(spark, sf_dir))
        if sql:
            ORACLES[name] = f"WITH {RAW if tables == 'raw' else CLEAN}{'' if sql.lstrip().upper().startswith('SELECT') else ','}\n{sql.strip()}"
        return make

    return add
