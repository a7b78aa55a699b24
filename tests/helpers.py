"""Toy retail tables whose results can be worked out by hand."""

from datetime import date, datetime


def day(s: str) -> date:
    return date.fromisoformat(s)


def baskets(spark, rows):
    """(basket_id, customer_id, day, total) rows."""
    full = [(b, c, "store", datetime.fromisoformat(d), day(d), float(t)) for b, c, d, t in rows]
    return spark.createDataFrame(full, "basket_id long, customer_id long, channel string, basket_ts timestamp_ntz, basket_day date, total_amount double")


def items(spark, rows):
    """(basket_id, product_id[, quantity, amount]) rows."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else 1, float(r[3] if len(r) > 3 else 1), False) for r in rows]
    return spark.createDataFrame(full, "basket_id long, product_id long, quantity int, line_amount double, is_promo boolean")


def products(spark, rows):
    """(product_id, category, typical_days) rows."""
    full = [(p, "D", c, "b", False, 1.0, t) for p, c, t in rows]
    return spark.createDataFrame(full, "product_id long, department string, category string, brand string, private_label boolean, unit_price double, typical_days int")


def customers(spark, rows):
    """(customer_id, household_size) rows."""
    full = [(c, day("2025-01-01"), "X", h, "gold", "app", False) for c, h in rows]
    return spark.createDataFrame(full, "customer_id long, signup_date date, city string, household_size int, tier string, preferred_channel string, churn_label boolean")
