"""Roles of the driver's star schema as retail tables.

Every operator takes tables by role (``customers``, ``products``, ``promotions``,
``baskets``, ``items``, ``sessions``, ``events``). ``raw`` binds them with the defects that
cleaning is for; ``clean`` binds them without. Both are lazy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Tables = dict[str, DataFrame]


def clean(spark: SparkSession, sf_dir: str) -> Tables:
    """Retail tables without defects."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    customers = read("customer").select(
        F.col("c_custkey").alias("customer_id"),
        F.expr("date_add(DATE'1994-06-01', cast(pmod(c_custkey * 37, 500) as int))").alias("signup_date"),
        F.concat(F.lit("CITY_"), "c_nationkey").alias("city"), F.concat(F.lit("COUNTRY_"), "c_nationkey").alias("country"),
        F.expr("cast(1 + c_custkey % 6 as int)").alias("household_size"),
        F.expr("CASE c_custkey % 3 WHEN 0 THEN 'bronze' WHEN 1 THEN 'silver' ELSE 'gold' END").alias("tier"),
        F.expr("CASE c_custkey % 4 WHEN 0 THEN 'app' WHEN 1 THEN 'web' ELSE 'store' END").alias("preferred_channel"),
        F.expr("c_custkey % 5 = 0").alias("churn_label"),
    )
    products = read("part").select(
        F.col("p_partkey").alias("product_id"), F.col("p_type").alias("department"), F.col("p_brand").alias("category"), F.col("p_name").alias("brand"),
        F.expr("p_partkey % 4 = 0").alias("private_label"), F.col("p_retailprice").alias("unit_price"), F.expr("10 + p_size").alias("typical_days"),
        F.expr("cast(1 + p_size % 6 as int)").alias("pack_size"), F.expr("p_partkey % 3 = 0").alias("perishable"),
    )
    promotions = read("part").where("p_partkey % 7 = 0").select(
        F.col("p_partkey").alias("promotion_id"), F.col("p_partkey").alias("product_id"),
        F.expr("CASE p_partkey % 3 WHEN 0 THEN '2x1' WHEN 1 THEN 'discount_pct' ELSE 'coupon' END").alias("promo_type"),
        F.expr("cast(p_partkey % 50 as double) / 100").alias("discount_value"),
        F.expr("date_add(DATE'1995-06-01', cast(pmod(p_partkey * 13, 2000) as int))").alias("start_date"),
        F.expr("date_add(DATE'1995-06-01', cast(pmod(p_partkey * 13, 2000) + 5 + p_partkey % 30 as int))").alias("end_date"),
    )
    baskets = read("orders").select(
        F.col("o_orderkey").alias("basket_id"), F.expr("CASE WHEN o_orderkey % 10 <> 3 THEN o_custkey END").alias("customer_id"),
        F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN 'app' WHEN '2-HIGH' THEN 'web' ELSE 'store' END").alias("channel"),
        F.expr("timestampadd(HOUR, cast(o_orderkey % 24 as int), o_orderdate)").alias("basket_ts"), F.expr("cast(o_orderdate as date)").alias("basket_day"),
        F.col("o_totalprice").alias("total_amount"),
    )
    items = read("lineitem").select(
        F.col("l_orderkey").alias("basket_id"), F.col("l_partkey").alias("product_id"), F.expr("cast(l_quantity as int)").alias("quantity"),
        F.col("l_extendedprice").alias("line_amount"), F.expr("l_discount >= 0.05").alias("is_promo"), F.expr("CASE WHEN l_partkey % 7 = 0 AND l_discount >= 0.05 THEN l_partkey END").alias("promotion_id"),
    )
    log = read("events").select(
        F.col("user_id"), "ts", "event_type", F.expr("datediff(cast(ts as date), DATE'2024-01-01')").alias("d"),
        F.expr("cast(get_json_object(props, '$.k') as bigint)").alias("product_id"),
    ).withColumn("session_id", F.expr("user_id * 1000 + d"))
    sessions = log.groupBy("session_id").agg(
        F.expr("max(CASE WHEN user_id % 9 <> 0 THEN user_id END)").alias("customer_id"), F.min("ts").alias("session_ts"),
        F.expr("max(CASE user_id % 3 WHEN 0 THEN 'mobile' WHEN 1 THEN 'desktop' ELSE 'tablet' END)").alias("device"),
        F.expr("max(CASE WHEN event_type = 'purchase' THEN user_id * 7 + d END)").alias("basket_id"),
    )
    events = log.select(
        "session_id", "product_id", F.expr("CASE WHEN event_type IN ('click', 'purchase') THEN 'add_to_cart' ELSE 'view' END").alias("event_type"), F.col("ts").alias("event_ts")
    )
    return {"customers": customers, "products": products, "promotions": promotions, "baskets": baskets, "items": items, "sessions": sessions, "events": events, "nations": read("nation")}


def raw(spark: SparkSession, sf_dir: str) -> Tables:
    """The same tables with spelling variants, missing values, wrong signs, repeated rows and wrong ranges."""
    t = clean(spark, sf_dir)
    return t | {
        "customers": t["customers"].withColumns({
            "city": F.expr("CASE WHEN customer_id % 17 <> 0 THEN city END"), "signup_date": F.expr("CASE WHEN customer_id % 7 = 0 THEN date_add(signup_date, 2000) ELSE signup_date END"),
        }),
        "products": t["products"].withColumns({
            "category": F.expr("CASE WHEN product_id % 11 = 0 THEN upper(category) WHEN product_id % 13 = 0 THEN concat('  ', category) ELSE category END"),
            "brand": F.expr("CASE WHEN product_id % 19 <> 0 THEN brand END"),
        }),
        "promotions": t["promotions"].withColumn("end_date", F.expr("CASE WHEN product_id % 77 = 0 THEN date_add(start_date, -3) ELSE end_date END")),
        "items": t["items"].select("basket_id", "product_id", F.expr("CASE WHEN (basket_id + product_id) % 9 = 0 THEN -quantity WHEN (basket_id + product_id) % 101 = 0 THEN 0 ELSE quantity END").alias("quantity"),
                                   F.expr("round(line_amount / quantity * 100) / 100").alias("unit_price_paid"), F.expr("CASE WHEN product_id % 7 = 0 AND is_promo THEN product_id END").alias("promotion_id")),
        "baskets": t["baskets"].withColumn("store_id", F.expr("CASE WHEN channel = 'store' AND basket_id % 50 <> 0 THEN basket_id % 20 END")),
        "sessions": t["sessions"].withColumn("converted", F.expr("basket_id IS NOT NULL OR session_id % 10 = 0")),
        "events": t["events"].unionAll(t["events"].where("session_id % 20 = 0")),
    }
