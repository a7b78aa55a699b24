"""The catalogue of business questions over clean retail tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fn import fixed, money, ratio

Tables = dict[str, DataFrame]


def lines(t: Tables) -> DataFrame:
    """Lines with their product's category, department and label, and their basket's day."""
    return t["items"].join(t["products"].select("product_id", "category", "department", "private_label"), "product_id").join(
        t["baskets"].select("basket_id", "basket_day", "customer_id", "channel"), "basket_id"
    )


def value_by(t: Tables, attribute: str) -> DataFrame:
    """Customers, baskets and spend by a customer attribute; customers without baskets count."""
    return t["customers"].join(t["baskets"].select("customer_id", "basket_id", "total_amount"), "customer_id", "left").groupBy(attribute).agg(
        F.countDistinct("customer_id").alias("n_customers"), F.count("basket_id").alias("n_baskets"), F.coalesce(money("total_amount"), F.lit(0.0)).alias("revenue"),
        fixed(F.avg("total_amount"), 2).alias("avg_ticket"),
    )


def baskets_per_customer(t: Tables, attribute: str) -> DataFrame:
    return t["customers"].join(t["baskets"].select("customer_id", "basket_id"), "customer_id", "left").groupBy(attribute).agg(
        fixed(ratio(F.count("basket_id"), F.countDistinct("customer_id")), 4).alias("baskets_per_customer")
    )


def add_shares(df: DataFrame, customers: str = "n_customers", revenue: str = "revenue") -> DataFrame:
    """Shares in % and the value index (share of revenue over share of customers) of a small table."""
    every = W.partitionBy()
    a, b = 100 * ratio(customers, F.sum(customers).over(every)), 100 * ratio(revenue, F.sum(revenue).over(every))
    return df.withColumns({"pct_customers": fixed(a, 4), "pct_revenue": fixed(b, 4), "value_index": fixed(ratio(b, a), 4)})


def sales_by(t: Tables, level: str = "category") -> DataFrame:
    sold = t["items"].join(t["products"].select("product_id", level), "product_id")
    return sold.groupBy(level).agg(F.count(F.lit(1)).alias("n_lines"), F.sum("quantity").alias("n_units"), money("line_amount").alias("revenue"))


def conditional_share(t: Tables, level: str, flag: str) -> DataFrame:
    """The share of revenue, in %, of lines for which a flag holds."""
    sold = t["items"].join(t["products"].select("product_id", level, "private_label"), "product_id")
    part = F.sum(F.when(F.col(flag), F.col("line_amount").cast("decimal(18,2)")).otherwise(0)).cast("double")
    return sold.groupBy(level).agg(money("line_amount").alias("revenue"), fixed(100 * ratio(part, money("line_amount")), 4).alias("pct"))


def covering(sales: DataFrame, key: str, threshold: float) -> DataFrame:
    """One row: how many of the largest entries of a small table reach ``threshold`` % of revenue."""
    if not 0 < threshold < 100:
        raise ValueError("threshold must be between 0 and 100")
    running = F.sum("revenue").over(W.orderBy(F.desc("revenue"), F.asc(key)).rowsBetween(W.unboundedPreceding, 0))
    share = sales.withColumn("share", 100 * running / F.sum("revenue").over(W.partitionBy()))
    return share.agg((F.sum((F.col("share") < threshold).cast("int")) + 1).cast("long").alias("n_entries"), F.count(F.lit(1)).alias("n_all"))


def monthly_sales(t: Tables) -> DataFrame:
    return t["baskets"].groupBy(F.date_format("basket_day", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("n_baskets"), money("total_amount").alias("revenue"), fixed(F.avg("total_amount"), 2).alias("avg_ticket")
    )


def seasonal_index(t: Tables, level: str = "category") -> DataFrame:
    """A category's share of a calendar month's lines over the mean of its monthly shares."""
    each = lines(t).groupBy(level, F.month("basket_day").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    share = ratio("n", F.sum("n").over(W.partitionBy("month")))
    return each.withColumn("share", share).withColumn("index", fixed(F.col("share") / F.avg("share").over(W.partitionBy(level)), 4)).select(level, "month", "n", "index")


def seasonal_matrix(index: DataFrame, level: str = "category") -> DataFrame:
    return index.groupBy(level).pivot("month", list(range(1, 13))).agg(F.first("index")).select(level, *[F.col(str(m)).alias(f"m{m:02}") for m in range(1, 13)])


def seasonal_peaks(index: DataFrame, level: str = "category") -> DataFrame:
    """The month of the largest index; the first such month in a tie."""
    return index.groupBy(level).agg(F.max(F.struct("index", (-F.col("month")).alias("m"))).alias("best")).select(level, (-F.col("best.m")).alias("peak_month"), F.col("best.index").alias("peak"))


def basket_by_channel(t: Tables) -> DataFrame:
    sizes = t["items"].groupBy("basket_id").agg(F.count(F.lit(1)).alias("n_lines"))
    return t["baskets"].join(sizes, "basket_id", "left").groupBy("channel").agg(
        F.count(F.lit(1)).alias("n_baskets"), fixed(F.avg("total_amount"), 2).alias("avg_ticket"), fixed(F.avg(F.coalesce("n_lines", F.lit(0))), 4).alias("avg_lines")
    )


def hour_profile(t: Tables) -> DataFrame:
    return t["baskets"].groupBy("channel", F.hour("basket_ts").alias("hour")).agg(F.count(F.lit(1)).alias("n_baskets"))


def lines_distribution(t: Tables, low: int = 1, high: int = 30) -> DataFrame:
    sizes = t["items"].groupBy("basket_id").agg(F.count(F.lit(1)).alias("n_lines"))
    return sizes.where(F.col("n_lines").between(low, high)).groupBy("n_lines").agg(F.count(F.lit(1)).alias("n_baskets"))


def top_pairs(affinity: DataFrame, min_baskets: int = 50, limit: int = 20) -> DataFrame:
    """The unordered pairs of the highest lift; ties by shared baskets and names."""
    half = affinity.where((F.col("antecedent") < F.col("consequent")) & (F.col("n_both") >= min_baskets))
    return half.orderBy(F.desc("lift"), F.desc("n_both"), "antecedent", "consequent").limit(limit).select("antecedent", "consequent", "n_both", "lift")


def cycle_by_category(cycles: DataFrame, least: int = 5) -> DataFrame:
    """Median observed cycle (an observed value) per category with enough customers."""
    known = cycles.where("observed_days is not null")
    return known.groupBy("category").agg(
        F.count(F.lit(1)).alias("n_customers"), F.first("typical").alias("typical"), F.percentile_approx("observed_days", 0.5, 1000000).alias("median_observed")
    ).where(F.col("n_customers") >= least)


def cycle_by_household(cycles: DataFrame, customers: DataFrame, categories: list[str]) -> DataFrame:
    return cycles.where(F.col("category").isin(*categories) & F.col("observed_days").isNotNull()).join(customers.select("customer_id", "household_size"), "customer_id").groupBy(
        "household_size"
    ).agg(F.count(F.lit(1)).alias("n"), fixed(F.avg("observed_days"), 4).alias("avg_observed"))


def due_summary(cycles: DataFrame) -> DataFrame:
    return cycles.agg(
        F.count(F.lit(1)).alias("n_pairs"), F.sum(F.col("due").cast("long")).alias("n_due"), F.countDistinct(F.when(F.col("due"), F.col("customer_id"))).alias("n_customers_due"),
        F.countDistinct("customer_id").alias("n_customers"),
    )


def churn_profile(rfm: DataFrame) -> DataFrame:
    return rfm.groupBy(F.when(F.col("churn_label"), "churned").otherwise("active").alias("label")).agg(
        F.count(F.lit(1)).alias("n_customers"), fixed(F.avg("recency_days"), 2).alias("mean_recency"), fixed(F.avg("frequency"), 4).alias("mean_frequency"), fixed(F.avg("monetary"), 2).alias("mean_spend")
    )


def at_risk_share(rfm: DataFrame, segments: tuple[str, ...] = ("At risk", "Hibernating")) -> DataFrame:
    """The share of buyers and of their spend in segments, in %."""
    inside = F.col("segment").isin(*segments)
    return rfm.where("has_purchases").agg(
        fixed(100 * F.avg(inside.cast("double")), 4).alias("pct_customers"),
        fixed(100 * ratio(F.sum(F.when(inside, F.col("monetary").cast("decimal(18,2)")).otherwise(0)).cast("double"), money("monetary")), 4).alias("pct_spend"),
    )


def promo_days(t: Tables) -> DataFrame:
    """``product_id, day``: the days on which a product is on promotion; ranges become days, so that joins are equi-joins."""
    valid = t["promotions"].where("end_date >= start_date")
    return valid.select("product_id", F.explode(F.sequence("start_date", "end_date")).alias("day")).distinct()


def promo_uplift(t: Tables) -> DataFrame:
    """``state, n_units, n_days, units_per_day``: promoted products on and off promotion, over all days with baskets, zero days too.

    The grid of products and days is counted, not built: off days are all days less on days.
    """
    days = t["baskets"].select(F.col("basket_day").alias("day")).distinct()
    on_days = promo_days(t).join(days, "day", "left_semi")
    promoted = t["promotions"].select("product_id").distinct()
    sold = t["items"].join(promoted, "product_id", "left_semi").join(t["baskets"].select("basket_id", F.col("basket_day").alias("day")), "basket_id").groupBy("product_id", "day").agg(F.sum("quantity").alias("units"))
    marked = sold.join(on_days.withColumn("on", F.lit(1)), ["product_id", "day"], "left")
    units = marked.agg(F.coalesce(F.sum(F.when(F.col("on") == 1, F.col("units"))), F.lit(0)).alias("units_on"), F.coalesce(F.sum(F.when(F.col("on").isNull(), F.col("units"))), F.lit(0)).alias("units_off"))
    n_on = on_days.agg(F.count(F.lit(1)).alias("days_on"))
    n_all = days.agg(F.count(F.lit(1)).alias("nd")).crossJoin(promoted.agg(F.count(F.lit(1)).alias("np")))
    both = units.crossJoin(n_on).crossJoin(n_all).withColumn("days_off", F.col("nd") * F.col("np") - F.col("days_on"))
    state = lambda name, s: F.struct(F.lit(name).alias("state"), F.col(f"units_{s}").alias("n_units"), F.col(f"days_{s}").alias("n_days"), fixed(ratio(f"units_{s}", f"days_{s}"), 6).alias("units_per_day"))
    return both.select(F.inline(F.array(state("on", "on"), state("off", "off")))).where("n_days > 0")


def uplift_ratio(states: DataFrame) -> DataFrame:
    """One row: units a day on promotion over those off it."""
    rate = lambda s: F.sum(F.when(F.col("state") == s, F.col("n_units") / F.col("n_days")))
    return states.agg(fixed(ratio(rate("on"), rate("off")), 4).alias("uplift"))


def promo_by_type(t: Tables) -> DataFrame:
    """What lines on promotion sell, by kind of promotion."""
    kinds = t["promotions"].select("promotion_id", "promo_type")
    return t["items"].where("promotion_id is not null").join(kinds, "promotion_id").groupBy("promo_type").agg(
        F.countDistinct("promotion_id").alias("n_promotions"), F.count(F.lit(1)).alias("n_lines"), money("line_amount").alias("revenue"), fixed(F.avg("quantity"), 4).alias("units_per_line")
    )


def funnel_by_device(t: Tables) -> DataFrame:
    """Sessions that viewed, added and bought, by device."""
    did = t["events"].groupBy("session_id").agg(
        F.max((F.col("event_type") == "view").cast("int")).alias("viewed"), F.max((F.col("event_type") == "add_to_cart").cast("int")).alias("added")
    )
    both = t["sessions"].join(did, "session_id", "left").withColumn("bought", F.col("basket_id").isNotNull().cast("int"))
    return both.groupBy("device").agg(
        F.count(F.lit(1)).alias("n_sessions"), F.sum(F.coalesce("viewed", F.lit(0))).alias("n_viewed"), F.sum(F.coalesce("added", F.lit(0))).alias("n_added"), F.sum("bought").alias("n_bought"),
        fixed(100 * F.avg("bought"), 4).alias("conversion_pct"),
    )


def event_basket_overlap(t: Tables, event_type: str) -> DataFrame:
    """Of the products seen (or added) in converted sessions, how many are in the session's basket."""
    if event_type not in ("view", "add_to_cart"):
        raise ValueError("event_type must be 'view' or 'add_to_cart'")
    seen = t["events"].where(F.col("event_type") == event_type).select("session_id", "product_id").distinct()
    sold = t["sessions"].where("basket_id is not null").select("session_id", "basket_id")
    had = t["items"].select("basket_id", "product_id").distinct().withColumn("had", F.lit(1))
    both = seen.join(sold, "session_id").join(had, ["basket_id", "product_id"], "left")
    return both.agg(F.count(F.lit(1)).alias("n_seen"), F.count("had").alias("n_bought")).withColumn("pct", fixed(100 * ratio("n_bought", "n_seen"), 4))


def basket_seen_online(t: Tables) -> DataFrame:
    """Of the products in converted sessions' baskets, how many had an event in the session."""
    had = t["sessions"].where("basket_id is not null").select("session_id", "basket_id").join(t["items"].select("basket_id", "product_id").distinct(), "basket_id")
    seen = t["events"].select("session_id", "product_id").distinct().withColumn("seen", F.lit(1))
    return had.join(seen, ["session_id", "product_id"], "left").agg(F.count(F.lit(1)).alias("n_bought"), F.count("seen").alias("n_seen")).withColumn("pct", fixed(100 * ratio("n_seen", "n_bought"), 4))


def seasonal_blind_spot(t: Tables, cutoff_month: int, level: str = "category") -> DataFrame:
    """Lines of each category in its peak month and in the month of a cutoff."""
    each = lines(t).groupBy(level, F.month("basket_day").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy(level).agg(
        F.max(F.struct("n", (-F.col("month")).alias("m"))).alias("p"), F.coalesce(F.max(F.when(F.col("month") == cutoff_month, F.col("n"))), F.lit(0)).alias("n_cutoff")
    ).select(level, (-F.col("p.m")).alias("peak_month"), F.col("p.n").alias("n_peak"), "n_cutoff", fixed(ratio("p.n", "n_cutoff"), 4).alias("peak_over_cutoff"))


def churn_deciles(rfm: DataFrame, by: str = "recency_days", bins: int = 10) -> DataFrame:
    """The churn rate of buyers by decile of a measure, ties by customer_id."""
    from .segments import with_tile

    return with_tile(rfm.where("has_purchases"), F.asc(by), bins, "decile").groupBy("decile").agg(
        F.count(F.lit(1)).alias("n"), fixed(F.avg(F.col("churn_label").cast("double")), 6).alias("churn_rate"), F.min(by).alias("low"), F.max(by).alias("high")
    )


def over_representation(affinity_like: DataFrame, sales: DataFrame, key: str) -> DataFrame:
    """Share of a count by key over the share of revenue by the same key."""
    every = W.partitionBy()
    both = affinity_like.join(sales.select(key, "revenue"), key)
    return both.withColumn("index", fixed(ratio(ratio("n", F.sum("n").over(every)), ratio("revenue", F.sum("revenue").over(every))), 4)).select(key, "n", "index")


def numeric_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: count, mean, population deviation, min and max, in one pass."""
    one = df.agg(*[F.struct(F.count(c).alias("n"), fixed(F.avg(c), 4).alias("mean"), fixed(F.stddev_pop(c), 4).alias("deviation"), F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high")).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("s")) for c in columns])).alias("x")).select("x.name", "x.s.*")


def activity_sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Event sessions by inactivity gap: an extension that the session log makes possible."""
    return events.groupBy("session_id", F.session_window(F.col("event_ts").cast("timestamp"), gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events"))
