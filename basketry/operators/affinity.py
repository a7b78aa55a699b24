"""Market-basket affinity of categories or products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fn import fixed, ratio


def basket_items(items: DataFrame, products: DataFrame, level: str = "category") -> DataFrame:
    """``basket_id, item``: the distinct categories or products of each basket."""
    if level not in ("category", "product"):
        raise ValueError("level must be 'category' or 'product'")
    if level == "product":
        return items.select("basket_id", F.col("product_id").alias("item")).distinct()
    return items.select("basket_id", "product_id").join(products.select("product_id", F.col("category").alias("item")), "product_id").select("basket_id", "item").distinct()


def cooccurrence(sets: DataFrame, min_baskets: int = 50, top: int | None = None) -> DataFrame:
    """Support, confidence, lift and Jaccard of ordered pairs that share ``min_baskets`` baskets.

    A pair of items is counted in one order only; what passes the threshold stands for both rules.
    ``top`` keeps for each antecedent those of the highest lift, ties by shared baskets and
    consequent, with their ``rank``.
    """
    n = sets.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    total = sets.select("basket_id").distinct().agg(F.count(F.lit(1)).alias("total_baskets"))
    met = sets.toDF("basket_id", "a").join(sets.toDF("basket_id", "b"), "basket_id").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_both")).where(F.col("n_both") >= min_baskets)
    rules = met.select("n_both", F.explode(F.array(F.struct(F.col("a").alias("antecedent"), F.col("b").alias("consequent")), F.struct(F.col("b").alias("antecedent"), F.col("a").alias("consequent")))).alias("r")).select("r.*", "n_both")
    full = rules.join(n.toDF("antecedent", "n_antecedent"), "antecedent").join(n.toDF("consequent", "n_consequent"), "consequent").crossJoin(F.broadcast(total))
    confidence = ratio("n_both", "n_antecedent")
    out = full.select(
        "antecedent", "consequent", "total_baskets", "n_antecedent", "n_consequent", "n_both", fixed(ratio("n_both", "total_baskets"), 6).alias("support"),
        fixed(confidence, 6).alias("confidence"), fixed(confidence / ratio("n_consequent", "total_baskets"), 4).alias("lift"),
        fixed(ratio("n_both", F.col("n_antecedent") + F.col("n_consequent") - F.col("n_both")), 6).alias("jaccard"),
    )
    if top is None:
        return out
    order = W.partitionBy("antecedent").orderBy(F.desc("lift"), F.desc("n_both"), F.asc("consequent"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def fpgrowth_rules(sets: DataFrame, min_support: float = 0.01, min_confidence: float = 0.1) -> DataFrame:
    """Association rules of FP-Growth: ``antecedent, consequent`` as joined item lists, with measures."""
    from pyspark.ml.fpm import FPGrowth

    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(sets.groupBy("basket_id").agg(F.collect_set("item").alias("items")))
    joined = lambda c: F.array_join(F.array_sort(F.transform(c, lambda x: x.cast("string"))), ",")
    return model.associationRules.select(joined(F.col("antecedent")).alias("antecedent"), joined(F.col("consequent")).alias("consequent"), *[fixed(c, 6).alias(c) for c in ("confidence", "lift", "support")])


def expected_pairs(affinity: DataFrame, declared: DataFrame) -> DataFrame:
    """Declared pairs (``position, antecedent, consequent, target_lift``) against what was measured."""
    found = affinity.select("antecedent", "consequent", "lift", "n_both")
    return declared.join(found, ["antecedent", "consequent"], "left").select(
        "position", "antecedent", "consequent", "target_lift", "lift", "n_both", fixed(ratio("lift", "target_lift"), 4).alias("lift_ratio")
    )


def structure(affinity: DataFrame) -> DataFrame:
    """One row: unordered pairs, how many have a lift above or below thresholds, and the median."""
    half = affinity.where("antecedent < consequent")
    above = lambda x: F.sum((F.col("lift") >= x).cast("long"))
    return half.agg(
        F.count(F.lit(1)).alias("n_pairs"), above(1.2).alias("lift_12"), above(1.5).alias("lift_15"), above(3.0).alias("lift_30"),
        F.sum((F.col("lift") < 0.8).cast("long")).alias("lift_below_08"), fixed(F.median("lift"), 4).alias("median_lift"),
    )
