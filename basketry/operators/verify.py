"""Measurements that verify a retail dataset: seasonality, uplift, cycles, loyalty, sizes and defects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fn import count_if, fixed, ratio
from ..functions.ranks import quantiles
from ..shared import saved
from .affinity import basket_items


def seasonality_ratio(lines: DataFrame, peaks: dict[str, list[int]]) -> DataFrame:
    """``category, ratio``: mean share of a month's lines in the peak months over the others."""
    each = lines.groupBy("category", F.month("basket_day").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    share = each.withColumn("share", ratio("n", F.sum("n").over(W.partitionBy("month"))))
    peak = F.lit(False)
    for category, months in peaks.items():
        peak = peak | ((F.col("category") == category) & F.col("month").isin(*months))
    return share.where(F.col("category").isin(*peaks)).groupBy("category").agg(fixed(ratio(F.avg(F.when(peak, F.col("share"))), F.avg(F.when(~peak, F.col("share")))), 4).alias("ratio"))


def promotion_uplift(promotions: DataFrame, baskets: DataFrame, items: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """One row: the sum over promotions of daily units inside their range over that of the rest of the calendar.

    Units by product and day meet the ranges turned into days, an equi-join.
    """
    valid = promotions.where("end_date >= start_date").withColumn("n_on", F.datediff("end_date", "start_date") + 1)
    span = baskets.agg((F.datediff(F.max("basket_day"), F.min("basket_day")) + 1).alias("n_days"))
    sold = items.join(valid.select("product_id").distinct(), "product_id", "left_semi").join(baskets.select("basket_id", "basket_day"), "basket_id").groupBy("product_id", "basket_day").agg(F.sum("quantity").alias("u"))
    total = sold.groupBy("product_id").agg(F.sum("u").alias("all_units"))
    inside = valid.select("promotion_id", "product_id", F.explode(F.sequence("start_date", "end_date")).alias("basket_day")).join(sold, ["product_id", "basket_day"]).groupBy("promotion_id").agg(F.sum("u").alias("on_units"))
    full = valid.select("promotion_id", "product_id", "n_on").join(inside, "promotion_id", "left").join(total, "product_id", "left").crossJoin(F.broadcast(span))
    on, everything = F.coalesce("on_units", F.lit(0)), F.coalesce("all_units", F.lit(0))
    rate_on, rate_off = ratio(on, "n_on"), ratio(everything - on, F.col("n_days") - F.col("n_on"))
    return full.agg(F.count(F.lit(1)).alias("n_promotions"), fixed(ratio(F.sum(fixed(rate_on, 9).cast("decimal(28,9)")), F.sum(fixed(rate_off, 9).cast("decimal(28,9)"))), 4).alias("uplift"))


def repurchase_cycles(days: DataFrame, typical: DataFrame) -> DataFrame:
    """``category, n_gaps, median_gap, median_gap_heavy, typical``: overall, and for the tenth of customers with most days."""
    gaps = days.withColumn("gap", F.datediff("day", F.lag("day").over(W.partitionBy("customer_id", "category").orderBy("day"))))
    load = days.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))
    cut = load.agg(F.percentile("n", F.lit(0.9)).alias("cut"))
    heavy = load.crossJoin(F.broadcast(cut)).where("n >= cut").select("customer_id", F.lit(True).alias("heavy"))
    both = gaps.where("gap is not null").join(heavy, "customer_id", "left")
    return both.groupBy("category").agg(
        F.count(F.lit(1)).alias("n_gaps"), F.percentile("gap", F.lit(0.5)).alias("median_gap"), F.percentile(F.when(F.col("heavy"), F.col("gap")), F.lit(0.5)).alias("median_gap_heavy")
    ).join(typical, "category")


def sku_loyalty(lines: DataFrame, min_purchases: int = 3) -> DataFrame:
    """``category, n_pairs, skus_per_purchase, favourite_share`` over customers with enough purchases."""
    per = lines.where("customer_id is not null").groupBy("customer_id", "category", "product_id").agg(F.count(F.lit(1)).alias("n"))
    pair = per.groupBy("customer_id", "category").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("skus"), F.max("n").alias("best")).where(F.col("total") >= min_purchases)
    return pair.groupBy("category").agg(F.count(F.lit(1)).alias("n_pairs"), fixed(F.avg(ratio("skus", "total")), 9).alias("skus_per_purchase"), fixed(F.avg(ratio("best", "total")), 9).alias("favourite_share"))


def basket_size(items: DataFrame) -> DataFrame:
    """One row: mean lines, variation (population deviation over mean), quantiles, and % of small and large baskets."""
    n = items.groupBy("basket_id").agg(F.count(F.lit(1)).alias("n"))
    quantiles = [F.percentile("n", F.lit(p)).alias(f"q{int(p * 100):02}") for p in (0.1, 0.25, 0.5, 0.75, 0.9, 0.99)]
    return n.agg(
        F.count(F.lit(1)).alias("n_baskets"), fixed(F.avg("n"), 4).alias("mean"), fixed(F.stddev_pop("n") / F.avg("n"), 4).alias("cv"), *quantiles,
        fixed(100 * F.avg((F.col("n") <= 3).cast("double")), 4).alias("pct_small"), fixed(100 * F.avg((F.col("n") >= 8).cast("double")), 4).alias("pct_large"),
    )


def lines_per_category(lines: DataFrame) -> DataFrame:
    """One row: how often a basket has more than one line of a category."""
    per = lines.groupBy("basket_id", "category").agg(F.count(F.lit(1)).alias("n"))
    baskets = per.groupBy("basket_id").agg(F.max("n").alias("most"))
    a = per.agg(fixed(F.avg("n"), 6).alias("mean_lines"), fixed(100 * F.avg((F.col("n") > 1).cast("double")), 4).alias("pct_pairs_repeated"))
    return a.crossJoin(baskets.agg(fixed(100 * F.avg((F.col("most") > 1).cast("double")), 4).alias("pct_baskets_repeated")))


def controlled_cooccurrence(items: DataFrame, products: DataFrame, least_expected: float = 5.0) -> DataFrame:
    """``a, b, lift, controlled``: raw lift, and lift within bands of basket size, relative to its median.

    Within a band lift is observed over expected; a pair's bands count by their baskets if
    at least ``least_expected`` are expected. Larger baskets pair anything; bands take that out.
    """
    sets = basket_items(items, products)
    size = sets.groupBy("basket_id").agg(F.count(F.lit(1)).alias("size"))
    band = F.when(F.col("size") <= 2, 0).when(F.col("size") <= 4, 1).when(F.col("size") <= 6, 2).otherwise(3)
    banded = sets.join(size.select("basket_id", band.alias("band")), "basket_id")
    n = banded.groupBy("band", "item").agg(F.count(F.lit(1)).alias("n"))
    total = banded.select("band", "basket_id").distinct().groupBy("band").agg(F.count(F.lit(1)).alias("t"))
    both = banded.select("band", "basket_id", F.col("item").alias("a")).join(banded.select("basket_id", F.col("item").alias("b")), "basket_id").where("a < b").groupBy("band", "a", "b").agg(F.count(F.lit(1)).alias("n_both"))
    full = both.join(n.select("band", F.col("item").alias("a"), F.col("n").alias("na")), ["band", "a"]).join(n.select("band", F.col("item").alias("b"), F.col("n").alias("nb")), ["band", "b"]).join(F.broadcast(total), "band")
    expected = F.col("na") * F.col("nb") / F.col("t")
    cells = full.withColumn("e", expected)
    wide = F.col("e") >= least_expected
    pairs = cells.groupBy("a", "b").agg(ratio(F.sum(F.when(wide, F.col("n_both") / F.col("e") * F.col("t"))), F.sum(F.when(wide, F.col("t")))).alias("mean_lift"), F.sum("n_both").alias("both"))
    alone = n.groupBy("item").agg(F.sum("n").alias("n"))
    every = total.agg(F.sum("t").alias("t"))
    out = pairs.where("mean_lift is not null").join(alone.toDF("a", "na"), "a").join(alone.toDF("b", "nb"), "b").crossJoin(F.broadcast(every))
    middle = out.agg(F.percentile("mean_lift", F.lit(0.5)).alias("mid"))
    return out.crossJoin(F.broadcast(middle)).select("a", "b", fixed(F.col("both") * F.col("t") / (F.col("na") * F.col("nb")), 4).alias("lift"), fixed(ratio("mean_lift", "mid"), 4).alias("controlled"))


def private_label_propensity(lines: DataFrame, min_lines: int = 10) -> DataFrame:
    """One row: the variance of customers' private-label shares over what chance alone gives."""
    per = lines.where("customer_id is not null").groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("private_label").cast("double")).alias("share")).where(F.col("n") >= min_lines)
    mean = per.agg(F.avg("share").alias("mean"))
    return per.crossJoin(F.broadcast(mean)).agg(
        F.count(F.lit(1)).alias("n_customers"), fixed(F.var_samp("share"), 6).alias("observed"), fixed(F.avg(F.col("mean") * (1 - F.col("mean")) / F.col("n")), 6).alias("expected"),
        fixed(F.var_samp("share") / F.avg(F.col("mean") * (1 - F.col("mean")) / F.col("n")), 4).alias("ratio"),
    )


def churn_signal(customers: DataFrame, baskets: DataFrame, window: int = 90) -> DataFrame:
    """``churn_label, n, visit_ratio, ticket_ratio``: medians of the last window against the time before, by label."""
    last = baskets.agg(F.max("basket_day").alias("last"), F.min("basket_day").alias("first"))
    known = baskets.where("customer_id is not null").crossJoin(F.broadcast(last))
    recent = F.col("basket_day") > F.date_sub("last", window)
    per = known.groupBy("customer_id", "last", "first").agg(
        count_if(recent).alias("n_recent"), count_if(~recent).alias("n_base"), F.avg(F.when(recent, F.col("total_amount").cast("decimal(18,2)"))).cast("double").alias("t_recent"), F.avg(F.when(~recent, F.col("total_amount").cast("decimal(18,2)"))).cast("double").alias("t_base")
    ).where("n_base > 0")
    base_days = F.datediff("last", "first") - window + 1
    rates = per.select("customer_id", (ratio("n_recent", F.lit(window)) / ratio("n_base", base_days)).alias("v"), ratio("t_recent", "t_base").alias("t"))
    both = saved(rates.join(customers.select("customer_id", "churn_label"), "customer_id"))
    out = both.groupBy("churn_label").agg(F.count(F.lit(1)).alias("n"))
    for value, name in (("v", "visit_ratio"), ("t", "ticket_ratio")):
        out = out.join(quantiles(both, value, (0.5,), name, ("churn_label",)), "churn_label", "left").withColumn(name, fixed(f"{name}0", 4)).drop(f"{name}0")
    return out


def quality_issues(raw: dict[str, DataFrame]) -> DataFrame:
    """``issue, n, pct``: rates of defects in raw tables; outliers are above the third quartile by three ranges."""
    items, customers, products, promotions, baskets = (raw[t] for t in ("items", "customers", "products", "promotions", "baskets"))

    def rate(name: str, df: DataFrame, condition) -> DataFrame:
        return df.agg(F.lit(name).alias("issue"), count_if(condition).alias("n"), fixed(100 * F.avg(F.coalesce(condition.cast("double"), F.lit(0.0))), 4).alias("pct"))

    q = quantiles(baskets, "total_amount", (0.25, 0.75), "q").toDF("q1", "q3")
    parts = [
        rate("negative_quantity", items, F.col("quantity") < 0), rate("missing_city", customers, F.col("city").isNull()), rate("missing_brand", products, F.col("brand").isNull()),
        rate("inverted_promotion", promotions, F.col("end_date") < F.col("start_date")), rate("total_outlier", baskets.crossJoin(F.broadcast(q)), F.col("total_amount") > F.col("q3") + 3 * (F.col("q3") - F.col("q1"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def churn_flag(baskets: DataFrame, final_days: int = 60) -> DataFrame:
    """``customer_id, churned``: the last purchase was before the final days."""
    last = baskets.agg(F.max("basket_day").alias("last"))
    return baskets.where("customer_id is not null").groupBy("customer_id").agg(F.max("basket_day").alias("day")).crossJoin(F.broadcast(last)).select("customer_id", (F.col("day") < F.date_sub("last", final_days)).alias("churned"))


def volumes(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def validate_catalog(categories: dict[str, str], typical_days: dict[str, int], pairs: list[tuple[str, str, float]], margins: dict[str, float]) -> list[str]:
    """What is wrong with a catalogue's configuration: unknown names, and values out of range."""
    wrong = [f"{c}: no typical days" for c in categories if c not in typical_days]
    wrong += [f"{c}: typical days {d} aren't positive" for c, d in typical_days.items() if d <= 0]
    wrong += [f"{a} - {b}: unknown category {x}" for a, b, _ in pairs for x in (a, b) if x not in categories]
    wrong += [f"{a} - {b}: lift {lift} isn't positive" for a, b, lift in pairs if lift <= 0]
    wrong += [f"{d}: margin {m} is outside [0, 1]" for d, m in margins.items() if not 0 <= m <= 1]
    return wrong + [f"{d}: no such department" for d in margins if d not in set(categories.values())]
