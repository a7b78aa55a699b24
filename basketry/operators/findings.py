"""The findings of the analysis as small tables: what a report says about value, the recommender and the next best action."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fn import count_if, fixed, ratio
from .segments import with_tile


def frequency_vs_ticket(shares: DataFrame) -> DataFrame:
    """Baskets per customer beside the mean ticket of each group, and both against the group of the least value.

    ``shares`` is a small table of ``questions.value_by`` with ``add_shares``.
    """
    every = W.partitionBy()
    per = ratio("n_baskets", "n_customers")
    least = F.min(F.struct("value_index", F.col("avg_ticket").alias("t"), F.col("per").alias("p"))).over(every)
    return shares.withColumn("per", per).withColumn("least", least).select(
        *[c for c in shares.columns if c not in ("n_baskets", "revenue")], fixed("per", 4).alias("baskets_per_customer"),
        fixed(ratio("avg_ticket", "least.t"), 4).alias("ticket_ratio"), fixed(ratio("per", "least.p"), 4).alias("frequency_ratio"),
    )


def affinity_outlier(check: DataFrame) -> DataFrame:
    """One row of ``affinity.expected_pairs``: how many declared pairs have a lift above 1, and the one farthest from its target."""
    far = F.max(F.struct(F.abs(F.col("lift_ratio") - 1).alias("gap"), (-F.col("position")).alias("p"), "antecedent", "consequent", "lift", "target_lift"))
    return check.agg(count_if(F.col("lift") > 1).alias("n_above_one"), far.alias("far")).select("n_above_one", "far.antecedent", "far.consequent", "far.lift", "far.target_lift")


def funnel(by_device: DataFrame) -> DataFrame:
    """One row of ``questions.funnel_by_device``: sessions, conversion in %, and how far devices are apart."""
    return by_device.agg(
        F.sum("n_sessions").alias("n_sessions"), fixed(100 * ratio(F.sum("n_bought"), F.sum("n_sessions")), 4).alias("pct_converted"),
        fixed(F.max(100 * ratio("n_bought", "n_sessions")) - F.min(100 * ratio("n_bought", "n_sessions")), 4).alias("spread"),
    )


def recommender(top: DataFrame, per_query: DataFrame, q: DataFrame, target: DataFrame, products: DataFrame) -> DataFrame:
    """``profile, n, ndcg, category_hit, product_hit`` by profile and for all: how much is lost between category and product, hits in %."""
    cats = target.join(products.select("product_id", "category"), "product_id").select("query_id", "category").distinct()
    hit = top.join(cats, ["query_id", "category"], "left_semi").select("query_id").distinct().withColumn("c", F.lit(1))
    each = per_query.select("query_id", "ndcg", "hit").join(q.select("query_id", F.col("profile").cast("string").alias("profile")), "query_id").join(hit, "query_id", "left")
    each = each.withColumn("profile", F.explode(F.array(F.lit("all"), F.col("profile"))))
    return each.groupBy("profile").agg(
        F.count(F.lit(1)).alias("n"), fixed(F.avg("ndcg"), 6).alias("ndcg"), fixed(100 * F.avg(F.coalesce("c", F.lit(0))), 4).alias("category_hit"), fixed(100 * F.avg("hit"), 4).alias("product_hit")
    )


def _who(frame: DataFrame, group: str) -> DataFrame:
    return frame.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_customers"), fixed(F.avg("p_churn"), 6).alias("p_churn"), fixed(F.avg("spend_90"), 4).alias("spend_90"), fixed(F.avg("value"), 6).alias("value"),
        fixed(100 * F.avg((F.col("action") != "none").cast("double")), 4).alias("pct_action"),
    )


def nba_by_segment(frame: DataFrame) -> DataFrame:
    """Risk, spend, the value of acting and how often something is done, by segment.

    ``frame``: customer_id, action, value, p_churn, spend_90 and segment.
    """
    return _who(frame, "segment")


def nba_by_risk(frame: DataFrame, bins: int = 10) -> DataFrame:
    """The same by tile of churn risk, ties by customer."""
    return _who(with_tile(frame, F.asc("p_churn"), bins, "decile"), "decile")


def nba_correlations(frame: DataFrame) -> DataFrame:
    """One row: how value goes with risk and with spend."""
    return frame.agg(fixed(F.corr("p_churn", "value"), 6).alias("with_risk"), fixed(F.corr("spend_90", "value"), 6).alias("with_spend"))


def nba_margin(decisions: DataFrame, sales: DataFrame, departments: DataFrame, rate) -> DataFrame:
    """``department, pct_actions, pct_sales, margin, index``: whether the policy goes where margins are.

    ``sales`` has revenue by department, ``departments`` that of each category, ``rate`` the margin as a
    column of ``department``. Departments without actions are left out.
    """
    every = W.partitionBy()
    acted = decisions.where("action <> 'none'").join(departments, "category").groupBy("department").agg(F.count(F.lit(1)).alias("n"))
    both = acted.withColumn("a", 100 * ratio("n", F.sum("n").over(every))).join(sales.withColumn("s", 100 * ratio("revenue", F.sum("revenue").over(every))), "department")
    return both.select("department", fixed("a", 4).alias("pct_actions"), fixed("s", 4).alias("pct_sales"), (100 * rate).alias("margin"), fixed(ratio("a", "s"), 4).alias("index"))
