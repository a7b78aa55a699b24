"""Customer value segments and replenishment cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fn import expected_days, fixed, household_factor, money, ratio
from ..functions.ranks import placed


def reference_day(baskets: DataFrame, day: str | None = None) -> DataFrame:
    """One row ``reference_date``: the given day, or the last with a basket, anonymous ones too."""
    if day:
        return baskets.sparkSession.range(1).select(F.lit(day).cast("date").alias("reference_date"))
    return baskets.agg(F.max("basket_day").alias("reference_date"))


def rfm(customers: DataFrame, baskets: DataFrame, bins: int = 5, day: str | None = None) -> DataFrame:
    """Recency, frequency and spend of every customer, with scores of 1 to ``bins`` and a segment.

    Anonymous baskets count for the reference day only. Scores are by rank among buyers,
    ties by customer_id; who never bought scores 1 in all.
    """
    one = baskets.where("customer_id is not null").groupBy("customer_id").agg(
        F.max("basket_day").alias("last_day"), F.min("basket_day").alias("first_day"), F.countDistinct("basket_id").alias("frequency"), money("total_amount").alias("monetary")
    )
    base = customers.select("customer_id", "tier", "signup_date", "churn_label").join(one, "customer_id", "left").crossJoin(F.broadcast(reference_day(baskets, day)))
    measured = base.select(
        "customer_id", "tier", "churn_label", F.coalesce("frequency", F.lit(0)).alias("frequency"), F.coalesce("monetary", F.lit(0.0)).alias("monetary"),
        ratio("monetary", "frequency").alias("avg_ticket"), F.datediff("reference_date", "last_day").alias("recency_days"), F.datediff("reference_date", "signup_date").alias("tenure_days"),
        fixed(F.when(F.col("frequency") > 1, F.datediff("last_day", "first_day") / (F.col("frequency") - 1)), 1).alias("cadence_days"), F.col("frequency").isNotNull().alias("has_purchases"),
    )
    return with_segment(with_scores(measured, bins), bins)


def with_scores(measured: DataFrame, bins: int) -> DataFrame:
    """``r_score, f_score, m_score``: ntiles of buyers by each value, ties by customer_id."""
    scored = measured.where("has_purchases")
    for name, order in (("r_score", F.desc("recency_days")), ("f_score", F.asc("frequency")), ("m_score", F.asc("monetary"))):
        scored = with_tile(scored, order, bins, name)
    rest = measured.where("not has_purchases").withColumns({n: F.lit(1).cast("int") for n in ("r_score", "f_score", "m_score")})
    return scored.unionByName(rest)


def with_tile(df: DataFrame, order: Column, bins: int, name: str, key: str = "customer_id") -> DataFrame:
    """``df`` with the ntile of each row in ``order``, then ``key``; rows are placed in parallel ranges of both."""
    ranked = placed(df, [order, key], "_rank", total="_all")
    rank, size, extra = F.col("_rank") - 1, F.floor(F.col("_all") / bins), F.col("_all") % bins
    big = extra * (size + 1)
    tile = F.when(rank < big, F.floor(rank / (size + 1))).otherwise(extra + F.floor((rank - big) / F.greatest(size, F.lit(1))))
    return ranked.withColumn(name, (tile + 1).cast("int")).drop("_rank", "_all")


def with_segment(scored: DataFrame, bins: int = 5) -> DataFrame:
    """``segment`` by recency against the mean of frequency and spend; the first rule that holds."""
    high, mid = bins - 1, (bins + 1) // 2
    r, fm = F.col("r_score"), F.round((F.col("f_score") + F.col("m_score")) / 2)
    segment = (
        F.when(~F.col("has_purchases"), "No purchases").when((r >= high) & (fm >= high), "Champions").when((r >= mid) & (fm >= mid), "Loyal")
        .when((r >= high) & (fm < mid), "Promising").when((r == mid) & (fm < mid), "Needs attention").when(fm >= mid, "At risk").otherwise("Hibernating")
    )
    return scored.withColumns({"rfm_score": F.concat("r_score", "f_score", "m_score"), "segment": segment})


def typical_days(products: DataFrame) -> DataFrame:
    """``category, typical``: the rounded mean of its products' typical days."""
    return products.groupBy("category").agg(F.round(F.avg("typical_days")).cast("int").alias("typical"))


def purchase_days(baskets: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """``customer_id, category, day``: the distinct days on which a customer bought of a category."""
    known = baskets.where("customer_id is not null").select("basket_id", "customer_id", F.col("basket_day").alias("day"))
    lines = items.select("basket_id", "product_id").join(products.select("product_id", "category"), "product_id")
    return lines.join(known, "basket_id").select("customer_id", "category", "day").distinct()


def repurchase(
    customers: DataFrame, baskets: DataFrame, items: DataFrame, products: DataFrame, min_obs: int = 2, tolerance: float = 1.0, day: str | None = None
) -> DataFrame:
    """Per customer and category: the observed or expected cycle, how overdue it is, and whether due."""
    if tolerance <= 0 or min_obs < 2:
        raise ValueError("tolerance must be positive and min_obs 2 at least")
    days = purchase_days(baskets, items, products)
    order = W.partitionBy("customer_id", "category").orderBy("day")
    gaps = days.withColumn("gap", F.datediff("day", F.lag("day").over(order)))
    seen = gaps.groupBy("customer_id", "category").agg(
        F.max("day").alias("last_day"), F.count(F.lit(1)).alias("n_days"), F.avg("gap").alias("observed"), F.stddev_samp("gap").alias("gap_std")
    )
    full = (
        seen.join(customers.select("customer_id", "household_size"), "customer_id", "left").join(typical_days(products), "category")
        .crossJoin(F.broadcast(reference_day(baskets, day)))
    )
    expected = expected_days("observed", "typical", household_factor("household_size"), "n_days", min_obs)
    since = F.datediff("reference_date", "last_day")
    return full.select(
        "customer_id", "category", "n_days", fixed("observed", 2).alias("observed_days"), fixed("gap_std", 2).alias("gap_std"), "typical",
        household_factor("household_size").alias("household_factor"), fixed(expected, 4).alias("expected_days"), since.alias("days_since"),
        fixed(since / expected, 3).alias("overdue_ratio"), (since >= expected * tolerance).alias("due"),
    )


def cycle_rank_correlation(cycles: DataFrame, a: str, b: str) -> DataFrame:
    """Spearman's rank correlation of two columns of a small table, ties by mean rank."""
    def mean_rank(c: str) -> Column:
        return F.rank().over(W.orderBy(c)) + (F.count(F.lit(1)).over(W.partitionBy(c)) - 1) / 2

    known = cycles.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return known.select(mean_rank(a).alias("x"), mean_rank(b).alias("y")).agg(fixed(F.corr("x", "y"), 6).alias("spearman"))
