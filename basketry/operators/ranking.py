"""Ordering of candidates, ranking metrics, baselines and resampling, all on DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fn import category_need_score, count_if, fixed, ratio, uniform

#: Gains of relevance 0, 1, 2.
GAINS = (0, 1, 3)


def order_candidates(scored: DataFrame, per_category: int = 1, demote_cart: bool = True) -> DataFrame:
    """``rank`` by score, products in ties; what exceeds the quota of its category, or is of a category in the cart, comes after all others.

    ``scored``: query_id, product_id, category, score and cat_in_cart. The quota counts
    before demotion.
    """
    inside = W.partitionBy("query_id", "category").orderBy(F.desc("score"), "product_id")
    late = F.row_number().over(inside) > per_category
    if demote_cart:
        late = late | (F.col("cat_in_cart") > 0)
    flagged = scored.withColumn("demoted", late.cast("int"))
    return flagged.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("demoted", F.desc("score"), "product_id")))


def top_k(scored: DataFrame, k: int = 5, **options) -> DataFrame:
    return order_candidates(scored, **options).where(F.col("rank") <= k)


def _log2(x: Column) -> Column:
    return F.log(x) / F.log(F.lit(2.0))


def _ideal(n: Column, k: int) -> Column:
    """The sum of 1/log2(i+1) for i from 1 to min(n, k)."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.lit(0.0), lambda acc, i: acc + F.when(i <= n, 1 / _log2(i.cast("double") + 1)).otherwise(0.0))


def per_query_metrics(top: DataFrame, q: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, ndcg, recall, precision, f1, hit``; queries without candidates score 0.

    ``top`` has query_id, rank and label; recall is against all that is still to come.
    """
    hits = top.where(F.col("rank") <= k).groupBy("query_id").agg(
        F.sum(F.when(F.col("label") == 1, 1 / _log2(F.col("rank").cast("double") + 1)).otherwise(0.0)).alias("dcg"), F.sum("label").alias("hits")
    )
    both = q.select("query_id", "n_target").join(hits, "query_id", "left").withColumns({"dcg": F.coalesce("dcg", F.lit(0.0)), "hits": F.coalesce("hits", F.lit(0))})
    return both.select(
        "query_id", fixed(F.coalesce(F.col("dcg") / F.when(F.col("n_target") > 0, _ideal(F.col("n_target"), k)), F.lit(0.0)), 6).alias("ndcg"),
        fixed(F.coalesce(ratio("hits", "n_target"), F.lit(0.0)), 6).alias("recall"), fixed(F.col("hits") / k, 6).alias("precision"),
        fixed(2 * F.col("hits") / (F.col("n_target") + k), 6).alias("f1"), (F.col("hits") > 0).cast("int").alias("hit"),
    )


def graded_per_query(top: DataFrame, q: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, ndcg, hit``: graded NDCG, its ideal being targets first and category mates in the slots left."""
    gain = F.when(F.col("relevance") == 2, GAINS[2]).when(F.col("relevance") == 1, GAINS[1]).otherwise(GAINS[0])
    got = top.where(F.col("rank") <= k).groupBy("query_id").agg(F.sum(gain / _log2(F.col("rank").cast("double") + 1)).alias("dcg"), F.max((F.col("relevance") > 0).cast("int")).alias("hit"))
    m = F.least(F.col("n_target"), F.lit(k))
    ideal = GAINS[2] * _ideal(m, k) + GAINS[1] * (_ideal(F.lit(k), k) - _ideal(m, k))
    both = q.select("query_id", "n_target").join(got, "query_id", "left")
    return both.select("query_id", fixed(F.coalesce(F.col("dcg"), F.lit(0.0)) / ideal, 6).alias("ndcg"), F.coalesce("hit", F.lit(0)).alias("hit"))


def summarise(per_query: DataFrame, groups: DataFrame | None = None, by: str = "profile") -> DataFrame:
    """Means of all metrics in total (``by`` = 'all') and by group; F1 of the means beside the mean F1."""
    metrics = [c for c in per_query.columns if c != "query_id"]
    aggs = [F.count(F.lit(1)).alias("n"), *[fixed(F.avg(m), 6).alias(m) for m in metrics]]
    total = per_query.agg(*aggs).withColumn(by, F.lit("all"))
    out = total
    if groups is not None:
        out = total.unionByName(per_query.join(groups.select("query_id", F.col(by).cast("string").alias(by)), "query_id").groupBy(by).agg(*aggs))
    if {"precision", "recall"} <= set(metrics):
        out = out.withColumn("f1_of_means", fixed(F.coalesce(2 * ratio(F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)), 6))
    return out


def prefix_bins(q: DataFrame) -> DataFrame:
    """``query_id, size_bin, fraction_bin``: prefix sizes 0 to 9 and 10+, and quarters of the basket."""
    size = F.when(F.col("prefix_size") >= 10, "10+").otherwise(F.col("prefix_size").cast("string"))
    f = F.col("prefix_size") / F.col("n_items")
    fraction = F.when(f <= 0, "0").when(f <= 0.25, "(0,.25]").when(f <= 0.5, "(.25,.5]").when(f <= 0.75, "(.5,.75]").otherwise("(.75,1)")
    return q.select("query_id", size.alias("size_bin"), fraction.alias("fraction_bin"))


def candidate_recall(pool: DataFrame, target: DataFrame, q: DataFrame, products: DataFrame) -> DataFrame:
    """One row: share of targets in the pool, share of target categories in it, and its mean size."""
    sizes = pool.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_pool"))
    found = target.join(pool.select("query_id", "product_id").withColumn("in", F.lit(1)), ["query_id", "product_id"], "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count("in").alias("n_in"))
    cat = products.select("product_id", "category")
    wanted = target.join(cat, "product_id").select("query_id", "category").distinct()
    have = pool.join(cat, "product_id").select("query_id", "category").distinct().withColumn("in", F.lit(1))
    cats = wanted.join(have, ["query_id", "category"], "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("c"), F.count("in").alias("c_in"))
    both = q.select("query_id").join(sizes, "query_id", "left").join(found, "query_id", "left").join(cats, "query_id", "left")
    return both.agg(
        fixed(F.avg(ratio("n_in", "n")), 6).alias("recall"), fixed(F.avg(ratio("c_in", "c")), 6).alias("category_recall"), fixed(F.avg(F.coalesce("n_pool", F.lit(0))), 4).alias("mean_pool")
    )


def wasted_slots(top: DataFrame) -> DataFrame:
    """One row: slots, those of a category in the cart, and those that repeat a category above them."""
    again = F.row_number().over(W.partitionBy("query_id", "category").orderBy("rank")) > 1
    return top.withColumn("again", again.cast("int")).agg(
        F.count(F.lit(1)).alias("n_slots"), count_if(F.col("cat_in_cart") > 0).alias("n_cart"), count_if(F.col("again") == 1).alias("n_repeat"),
        fixed(100 * F.avg(((F.col("cat_in_cart") > 0) | (F.col("again") == 1)).cast("double")), 4).alias("pct_wasted"),
    )


def recency_slots(top: DataFrame, product_history: DataFrame) -> DataFrame:
    """Slots and hits by days since the customer last bought the product."""
    both = top.join(product_history.select("query_id", "product_id", "days_since"), ["query_id", "product_id"], "left")
    band = F.when(F.col("days_since").isNull(), "never").when(F.col("days_since") <= 7, "1-7").when(F.col("days_since") <= 14, "8-14").when(F.col("days_since") <= 90, "15-90").otherwise("90+")
    return both.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n_slots"), F.sum("label").alias("n_hits"))


def recency_comparison(systems: dict[str, DataFrame], category_history: DataFrame, first: str, days: tuple[int, ...] = (7, 14), k: int = 5) -> DataFrame:
    """``days, system, n_queries, pct_recent, precision, hit``: all systems on the queries where the first one offered a category bought that recently.

    ``systems`` are top lists with category and label; precision and hits are of products.
    """
    since = category_history.select("query_id", "category", "days_since")
    limits = F.explode(F.array(*[F.lit(d) for d in days])).alias("days")
    marked = {n: top.join(since, ["query_id", "category"], "left").select("query_id", "label", "days_since", limits).withColumn("recent", F.coalesce((F.col("days_since") <= F.col("days")).cast("int"), F.lit(0))) for n, top in systems.items()}
    chosen = marked[first].where("recent = 1").select("query_id", "days").distinct()
    out = None
    for name, slots in marked.items():
        per = chosen.join(slots, ["query_id", "days"], "left").groupBy("days", "query_id").agg(F.coalesce(F.sum("recent"), F.lit(0)).alias("r"), F.coalesce(F.sum("label"), F.lit(0)).alias("h"))
        row = per.groupBy("days").agg(
            F.count(F.lit(1)).alias("n_queries"), fixed(100 * F.sum("r") / (F.count(F.lit(1)) * k), 4).alias("pct_recent"), fixed(F.avg(F.col("h") / k), 6).alias("precision"), fixed(F.avg((F.col("h") > 0).cast("double")), 6).alias("hit")
        ).withColumn("system", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


# --- baselines on the grid of queries and categories ------------------------------------

BASELINES = ("random", "global", "month", "frequency", "due", "favourite", "rules")


def baseline_scores(kind: str, q: DataFrame, categories: DataFrame, prefix: DataFrame, category_history: DataFrame, monthly: DataFrame, rules: DataFrame, products: DataFrame) -> DataFrame:
    """``query_id, category, score, fill``: a baseline's score for every category that isn't in the cart.

    ``categories`` (category, n) is a small dimension, so that the grid grows with the queries
    alone. ``fill`` is global popularity, which ranks what the baseline doesn't know.
    """
    if kind not in BASELINES:
        raise ValueError(f"no such baseline: {kind}")
    cart = prefix.join(products.select("product_id", "category"), "product_id").select("query_id", "category").distinct()
    grid = q.select("query_id", F.month("basket_day").alias("month")).crossJoin(categories.select("category", F.col("n").alias("fill")))
    grid = grid.join(cart, ["query_id", "category"], "left_anti")
    none = F.lit(-1.0)
    if kind == "random":
        score, out = uniform(F.concat_ws("-", "query_id", "category"), "random"), grid
    elif kind == "global":
        score, out = F.col("fill").cast("double"), grid
    elif kind == "month":
        out = grid.join(monthly.select("month", "category", F.col("n").alias("m")), ["month", "category"], "left")
        score = F.coalesce(F.col("m").cast("double"), none)
    elif kind == "rules":
        best = cart.withColumnRenamed("category", "antecedent").join(rules.select("antecedent", F.col("consequent").alias("category"), "confidence"), "antecedent").groupBy("query_id", "category").agg(F.max("confidence").alias("c"))
        out, score = grid.join(best, ["query_id", "category"], "left"), F.coalesce("c", none)
    else:
        out = grid.join(category_history.select("query_id", "category", "n_days", "due"), ["query_id", "category"], "left")
        score = {"frequency": F.col("n_days").cast("double"), "due": category_need_score("n_days", "due"), "favourite": F.when(F.col("n_days") >= 2, F.col("n_days").cast("double"))}[kind]
        score = F.coalesce(score, none)
    return out.select("query_id", "category", score.alias("score"), "fill")


def baseline_top(scores: DataFrame, k: int = 5) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("fill"), "category")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def category_hits(top: DataFrame, target: DataFrame, products: DataFrame, q: DataFrame) -> DataFrame:
    """One row: the share of queries with a target category among the top, and the mean number of them."""
    wanted = target.join(products.select("product_id", "category"), "product_id").select("query_id", "category").distinct()
    got = top.join(wanted, ["query_id", "category"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("h"))
    return q.select("query_id").join(got, "query_id", "left").agg(fixed(F.avg(F.col("h").isNotNull().cast("double")), 6).alias("hit_rate"), fixed(F.avg(F.coalesce("h", F.lit(0))), 6).alias("mean_hits"))


# --- resampling -------------------------------------------------------------------------


def poisson(u: Column) -> Column:
    """A Poisson(1) number from a uniform one, by its distribution function."""
    # fixed values: the Poisson(1) distribution function at 0, 1, ...
    steps = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712, 0.9999897508033253)
    out = F.lit(0)
    for s in steps:
        out = out + F.when(u >= s, 1).otherwise(0)
    return out


def bootstrap(per_query: DataFrame, clusters: DataFrame, metric: str, resamples: int = 1000, salt: str = "boot") -> DataFrame:
    """``replicate, mean`` of a metric, resampling whole clusters with Poisson(1) weights.

    Sums by cluster come first, so that each replicate costs a row a cluster; weights come
    from a hash of cluster and replicate, so that any engine and partitioning agrees.
    """
    sums = per_query.join(clusters.select("query_id", "cluster"), "query_id").groupBy("cluster").agg(F.sum(metric).alias("s"), F.count(F.lit(1)).alias("n"))
    each = sums.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(resamples))))
    weight = poisson(uniform(F.concat_ws("#", "cluster", "replicate"), salt))
    return each.withColumn("w", weight).groupBy("replicate").agg(ratio(F.sum(F.col("w") * F.col("s")), F.sum(F.col("w") * F.col("n"))).alias("mean"))


def percentile_interval(replicates: DataFrame, level: float = 0.95) -> DataFrame:
    tail = (1 - level) / 2
    return replicates.agg(fixed(F.percentile("mean", F.lit(tail)), 6).alias("low"), fixed(F.percentile("mean", F.lit(1 - tail)), 6).alias("high"))


def paired_bootstrap(a: DataFrame, b: DataFrame, clusters: DataFrame, metric: str, resamples: int = 1000) -> DataFrame:
    """One row ``difference, low, high, p``: the same resamples for both systems over the same queries.

    A query that only one of them has is an error, which the result raises when it is computed.
    """
    sides = [s.select("query_id", F.struct(F.col(metric).alias("m")).alias(n)) for s, n in ((a, "x"), (b, "y"))]
    both = sides[0].join(sides[1], "query_id", "full_outer")
    alone = F.raise_error(F.concat(F.lit("only one system has the query "), F.col("query_id").cast("string"))).cast("double")
    both = both.select("query_id", F.when(F.col("x").isNull() | F.col("y").isNull(), alone).otherwise(F.col("x.m") - F.col("y.m")).alias("d"))
    observed = both.agg(F.avg("d").alias("difference"))
    reps = bootstrap(both, clusters, "d", resamples).crossJoin(F.broadcast(observed))
    extreme = count_if(F.abs(F.col("mean") - F.col("difference")) >= F.abs("difference"))
    return reps.agg(
        fixed(F.first("difference"), 6).alias("difference"), fixed(F.percentile("mean", F.lit(0.025)), 6).alias("low"), fixed(F.percentile("mean", F.lit(0.975)), 6).alias("high"),
        fixed((1 + extreme) / (resamples + 1), 6).alias("p"),
    )


# --- ablations and the ceiling -----------------------------------------------------------

#: Variants of the ordering: name, quota of a category, whether the cart's categories go last.
VARIANTS = (("none", 1000, False), ("quota", 1, False), ("cart", 1000, True), ("both", 1, True), ("two each", 2, True))


def ablation(scored: DataFrame, q: DataFrame, k: int = 5) -> DataFrame:
    """``variant`` and mean metrics of each way to order the same pool, all in one pass over it."""
    ways = F.array(*[F.struct(F.lit(n).alias("variant"), F.lit(c).alias("quota"), F.lit(d).alias("cart")) for n, c, d in VARIANTS])
    each = scored.withColumn("w", F.explode(ways)).select("*", "w.*").withColumn("query_id", F.concat_ws("|", "variant", "query_id")).drop("w")
    place = F.row_number().over(W.partitionBy("query_id", "category").orderBy(F.desc("score"), "product_id"))
    late = ((place > F.col("quota")) | (F.col("cart") & (F.col("cat_in_cart") > 0))).cast("int")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("demoted", F.desc("score"), "product_id"))
    top = each.withColumn("demoted", late).withColumn("rank", rank).where(F.col("rank") <= k)
    all_q = q.withColumn("variant", F.explode(F.array(*[F.lit(n) for n, _, _ in VARIANTS]))).withColumn("query_id", F.concat_ws("|", "variant", "query_id"))
    return summarise(per_query_metrics(top, all_q, k), all_q, "variant").where("variant <> 'all'").select("variant", "n", "ndcg", "recall", "hit")


def _drawn(chances: DataFrame, samples: int, salt: str) -> DataFrame:
    each = chances.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    return each.where(uniform(F.concat_ws("-", "query_id", "category", "s"), salt) < F.col("p")).select("query_id", "category", "s")


def ceiling_choice(chances: DataFrame, samples: int = 1000, k: int = 5, salt: str = "ceiling") -> DataFrame:
    """``query_id, category``: the k categories drawn most often on the even samples."""
    even = _drawn(chances, samples, salt).where("s % 2 = 0").groupBy("query_id", "category").agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy("query_id").orderBy(F.desc("n"), "category")
    return even.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("query_id", "category")


def ceiling(chances: DataFrame, samples: int = 1000, k: int = 5, salt: str = "ceiling") -> DataFrame:
    """Per query, what the best list could hit: ``query_id, expected_hits, se``.

    ``chances`` has the probability ``p`` of each category. Baskets are simulated from hashes;
    the list is chosen on the even samples and valued on the odd ones, so that choosing on
    noise doesn't count.
    """
    drawn, best = _drawn(chances, samples, salt), ceiling_choice(chances, samples, k, salt)
    per = drawn.where("s % 2 = 1").join(best, ["query_id", "category"]).groupBy("query_id", "s").agg(F.count(F.lit(1)).alias("h"))
    odd = samples // 2
    sums = per.groupBy("query_id").agg(F.sum("h").alias("h"), F.sum(F.col("h") * F.col("h")).alias("h2"))
    mean = F.coalesce(F.col("h"), F.lit(0)) / odd
    spread = F.greatest((F.coalesce(F.col("h2"), F.lit(0)) - odd * mean * mean) / (odd - 1), F.lit(0.0))
    return chances.select("query_id").distinct().join(sums, "query_id", "left").select("query_id", fixed(mean, 6).alias("expected_hits"), fixed(F.sqrt(spread / odd), 6).alias("se"))


def ceiling_check(expected: DataFrame, realised: DataFrame) -> DataFrame:
    """One row: mean realised hits (``query_id, hits``) against the ceiling, and how many deviations apart."""
    both = expected.join(realised, "query_id")
    gap = F.avg("hits") - F.avg("expected_hits")
    scale = F.sqrt(F.var_samp(F.col("hits") - F.col("expected_hits")) / F.count(F.lit(1)))
    return both.agg(F.count(F.lit(1)).alias("n"), fixed(F.avg("hits"), 6).alias("realised"), fixed(F.avg("expected_hits"), 6).alias("ceiling"), fixed(F.when(scale > 0, gap / scale), 4).alias("z"))


def ceiling_given_cart(chances: DataFrame, samples: int = 1000, k: int = 5) -> DataFrame:
    """``query_id, expected_hits, se, ess``: the ceiling for baskets whose cart and size are known.

    ``chances`` has a row for each category of a query: ``weight``, whether it is ``in_cart``, and
    ``n`` categories of the whole basket. Categories enter a basket one after another, each in
    proportion to its weight, as if each had an exponential clock of that rate. So the categories
    outside the cart are drawn by their clocks, and a draw counts by the chance that those of the cart
    rang before the first one that didn't get in, which needs no rejected draws. Lists are chosen
    on the even samples and valued on the odd ones; ``ess`` is the effective number of samples.
    Draws follow from the query's id; a query's categories are one group.
    """
    import zlib

    import numpy as np
    import pandas as pd

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("category")
        rng = np.random.default_rng(zlib.crc32(str(group["query_id"].iloc[0]).encode()))
        free = group[(~group["in_cart"]) & (group["weight"] > 0)]["weight"].to_numpy()
        cart = group[group["in_cart"]]["weight"].to_numpy()
        left = max(0, int(group["n"].iloc[0]) - len(cart))
        times = rng.exponential(size=(samples, len(free))) / free
        order = np.argsort(times, axis=1, kind="stable")
        inside = np.zeros(times.shape, bool)
        np.put_along_axis(inside, order[:, :left], True, axis=1)
        if left < len(free):
            out = np.take_along_axis(times, order[:, left : left + 1], axis=1)
            weight = np.prod(-np.expm1(-out * cart), axis=1)
        else:
            weight = np.ones(samples)
        even, odd = weight[::2], weight[1::2]
        if not even.sum() or not odd.sum():
            return pd.DataFrame({"query_id": group["query_id"].iloc[:1], "expected_hits": [np.nan], "se": [np.nan], "ess": [0.0]})
        best = np.argsort(-(even[:, None] * inside[::2]).sum(axis=0), kind="stable")[:k]
        hits, share = inside[1::2][:, best].sum(axis=1), odd / odd.sum()
        mean = (share * hits).sum()
        return pd.DataFrame({"query_id": group["query_id"].iloc[:1], "expected_hits": [mean], "se": [np.sqrt((share**2 * (hits - mean) ** 2).sum())], "ess": [1 / (share**2).sum()]})

    rows = chances.select("query_id", "category", F.col("weight").cast("double").alias("weight"), F.col("in_cart").cast("boolean").alias("in_cart"), F.col("n").cast("long").alias("n"))
    return rows.groupBy("query_id").applyInPandas(one, "query_id string, expected_hits double, se double, ess double")


# --- systems against each other -----------------------------------------------------------


def compare_systems(systems: dict[str, DataFrame], clusters: DataFrame, metric: str = "ndcg", resamples: int = 1000) -> DataFrame:
    """``system, mean, difference, low, high, p`` of each system's metric by query, against the first one.

    All systems must have the same queries; otherwise the result raises an error when it is computed.
    """
    names = list(systems)
    out = None
    for name in names:
        row = systems[name].agg(fixed(F.avg(metric), 6).alias("mean")).select(F.lit(name).alias("system"), "mean")
        row = row.crossJoin(paired_bootstrap(systems[name], systems[names[0]], clusters, metric, resamples))
        out = row if out is None else out.unionByName(row)
    return out


def source_coverage(pool: DataFrame, target: DataFrame, q: DataFrame, flags: tuple[str, ...]) -> DataFrame:
    """``profile, source, n_candidates, n_targets, pct_targets``: what each source brings, by profile.

    Targets are counted for every source that has them; the share is of the profile's targets.
    """
    each = pool.join(q.select("query_id", "profile"), "query_id").join(target.select("query_id", "product_id").distinct().withColumn("t", F.lit(1)), ["query_id", "product_id"], "left")
    long = each.select("profile", "t", F.explode(F.array(*[F.struct(F.lit(f).alias("source"), F.col(f).alias("on")) for f in flags])).alias("s")).where("s.on = 1")
    found = long.groupBy("profile", F.col("s.source").alias("source")).agg(F.count(F.lit(1)).alias("n_candidates"), F.count("t").alias("n_targets"))
    total = q.groupBy("profile").agg(F.sum("n_target").alias("all"))
    return found.join(total, "profile").select("profile", "source", "n_candidates", "n_targets", fixed(100 * ratio("n_targets", "all"), 4).alias("pct_targets"))


#: What is learnt: name, gains of relevance 0, 1 and 2, features left out, and how validation queries are chosen.
RANK_FEATURES = frozenset(("cat_freq_rank", "cat_share", "cat_need_rank"))
OBJECTIVES = (
    ("product only", (0, 0, 1), frozenset(), "time"), ("graded without ranks", GAINS, RANK_FEATURES, "time"), ("graded", GAINS, frozenset(), "time"), ("graded, validation by hash", GAINS, frozenset(), "hash"),
)


def objective_ablation(
    train: DataFrame, test: DataFrame, q: DataFrame, features: tuple[str, ...], iterations: int = 30, depth: int = 5, rate: float = 0.1, patience: int | None = None, k: int = 5, variants=OBJECTIVES
) -> DataFrame:
    """``variant`` and mean metrics of models that differ in what they learn, on the same pools.

    ``train`` has ``is_validation`` for the split by time; by hash a fifth of its queries validate.
    """
    out = None
    for name, gains, without, split in variants:
        own = tuple(f for f in features if f not in without)
        rows = train if split == "time" else train.withColumn("is_validation", uniform("query_id", "validation") < 0.2)
        top = top_k(rank_with(fit_ranker(rows, own, iterations, depth, gains, rate, patience), test, own), k)
        metrics = per_query_metrics(top, q, k).join(graded_per_query(top, q, k).select("query_id", F.col("ndcg").alias("graded"), F.col("hit").alias("category_hit")), "query_id")
        row = summarise(metrics).drop("all").withColumn("variant", F.lit(name)).select("variant", "n", "ndcg", "graded", "hit", "category_hit")
        out = row if out is None else out.unionByName(row)
    return out


# --- learning to rank --------------------------------------------------------------------


def gain_of(relevance: str = "relevance", gains: tuple[int, ...] = GAINS) -> Column:
    return F.element_at(F.lit([float(g) for g in gains]), F.col(relevance).cast("int") + 1)


def _assembler(features: tuple[str, ...]):
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(features), outputCol="x")


def _learnable(matrix: DataFrame, features: tuple[str, ...], gains: tuple[int, ...]) -> DataFrame:
    """What trees are fitted to, without nulls."""
    flag = F.coalesce("is_validation", F.lit(False)) if "is_validation" in matrix.columns else F.lit(False)
    rows = matrix.select("query_id", "product_id", gain_of(gains=gains).alias("gain"), flag.alias("is_validation"), *[F.col(f).cast("double").alias(f) for f in features])
    return rows.na.fill(-1.0, list(features))


def _as_pipeline(spark, trees: list[dict], weights: list[float], features: tuple[str, ...], name: str):
    """A model that ``rank_with`` takes; scoring is one pass and saving is MLlib's."""
    from pyspark.ml.pipeline import PipelineModel

    from .boosting import as_model

    return PipelineModel([_assembler(features), as_model(spark, trees, weights, len(features), name).setFeaturesCol("x")])


def fit_ranker(matrix: DataFrame, features: tuple[str, ...], iterations: int = 30, depth: int = 5, gains: tuple[int, ...] = GAINS, rate: float = 0.1, patience: int | None = None):
    """A boosted regression on the gain of each pair (pointwise); queries without any relevance are left out.

    Rows with ``is_validation`` stop it early if the column is there: when their error hasn't lessened for ``patience``
    rounds, and by MLlib's rule without that.
    """
    from .boosting import boost

    trees, _ = boost(_learnable(matrix, features, gains), features, False, iterations, depth, rate, patience)
    return _as_pipeline(matrix.sparkSession, trees, [1.0] + [rate] * (len(trees) - 1), features, "ranker")


def lambdas(scored: DataFrame, k: int = 5) -> DataFrame:
    """``scored`` with ``lam`` and ``hess``: by how much NDCG wants each pair's score to rise, and the curvature of that.

    For two candidates of a query with different gains, the pull is the logistic loss of their score
    difference times the change of NDCG if they swapped places. A query's candidates are one group,
    of a pool's size; its pulls are summed with matrices of relevant by other candidates.
    """
    import numpy as np
    import pandas as pd

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["score", "product_id"], ascending=[False, True])
        gain, score = group["gain"].to_numpy(), group["score"].to_numpy()
        place = 1 / np.log2(np.arange(len(gain)) + 2.0)
        ideal = (np.sort(gain)[::-1][:k] * place[: min(k, len(gain))]).sum()
        lam, hess = np.zeros(len(gain)), np.zeros(len(gain))
        for level in np.unique(gain)[1:]:
            up, down = np.flatnonzero(gain == level), np.flatnonzero(gain < level)
            rho = 1 / (1 + np.exp(np.clip(score[up, None] - score[None, down], -50, 50)))
            swap = np.abs((gain[up, None] - gain[None, down]) * (place[up, None] - place[None, down])) / ideal
            pull, bend = rho * swap, rho * (1 - rho) * swap
            lam[up] += pull.sum(axis=1)
            lam[down] -= pull.sum(axis=0)
            hess[up] += bend.sum(axis=1)
            hess[down] += bend.sum(axis=0)
        return group.assign(lam=lam, hess=hess)

    schema = scored.select("*", F.lit(0.0).alias("lam"), F.lit(0.0).alias("hess")).schema
    return scored.groupBy("query_id").applyInPandas(one, schema)


def fit_lambda_ranker(matrix: DataFrame, features: tuple[str, ...], rounds: int = 20, depth: int = 5, rate: float = 0.3, patience: int = 3, k: int = 5):
    """Boosted trees on the pulls of ``lambdas`` (listwise), as a model that ``rank_with`` takes; and NDCG by round.

    Each round fits a tree to lam / hess, weighted by hess, and adds ``rate`` times it to the scores.
    Where ``is_validation`` marks queries, rounds end when their graded NDCG hasn't risen for
    ``patience`` rounds, and trees behind the best one are dropped. Queries without gain are left out.
    """
    from .boosting import boost

    trees, curve = boost(_learnable(matrix, features, GAINS), features, True, rounds, depth, rate, patience, k)
    return _as_pipeline(matrix.sparkSession, trees, [rate] * len(trees), features, "lambda_ranker"), curve


def mean_ndcg(scored: DataFrame, k: int = 5) -> float:
    """The mean over queries of the NDCG of ``gain`` in the order of ``score``: one number."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "product_id"))
    ideal = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("gain"), "product_id"))
    part = lambda at: F.sum(F.when(F.col(at) <= k, F.col("gain") / _log2(F.col(at).cast("double") + 1)).otherwise(0.0))
    per = scored.withColumns({"r": rank, "i": ideal}).groupBy("query_id").agg((part("r") / part("i")).alias("n"))
    return float(per.agg(F.avg("n")).first()[0] or 0.0)


def save_ranker(model, path: str, features: tuple[str, ...]) -> None:
    """The model and the features it was fitted on, in their order."""
    model.write().overwrite().save(f"{path}/model")
    SparkSession.active().createDataFrame(list(enumerate(features)), "place int, feature string").write.mode("overwrite").parquet(f"{path}/features")


def load_ranker(spark, path: str, features: tuple[str, ...] | None = None):
    """The model of ``save_ranker`` and its features; an error if they aren't those that are asked for."""
    from pyspark.ml.pipeline import PipelineModel

    known = tuple(r["feature"] for r in spark.read.parquet(f"{path}/features").orderBy("place").collect())
    if features is not None and known != tuple(features):
        raise ValueError("the model was fitted on other features")
    return PipelineModel.load(f"{path}/model"), known


def rank_with(model, matrix: DataFrame, features: tuple[str, ...]) -> DataFrame:
    scored = model.transform(matrix.na.fill(-1.0, list(features)))
    return scored.withColumnRenamed("prediction", "score").drop("x")


def importance(model, features: tuple[str, ...], spark) -> DataFrame:
    """``feature, gain, share, rank``, largest first."""
    values = [float(v) for v in model.stages[-1].featureImportances.toArray()]
    rows = spark.createDataFrame(list(zip(features, values, strict=True)), "feature string, gain double")
    every = W.partitionBy()
    return rows.withColumns({"share": ratio("gain", F.sum("gain").over(every)), "rank": F.row_number().over(W.orderBy(F.desc("gain"), "feature"))})


def pick_examples(per_query: DataFrame, q: DataFrame) -> DataFrame:
    """``profile, query_id, ndcg``: the hit query at the middle of each profile by NDCG, then query_id."""
    hits = per_query.where("hit = 1").join(q.select("query_id", "profile"), "query_id")
    w = W.partitionBy("profile")
    placed = hits.withColumns({"i": F.row_number().over(w.orderBy("ndcg", "query_id")), "n": F.count(F.lit(1)).over(w)})
    return placed.where(F.col("i") == F.floor((F.col("n") + 1) / 2)).select("profile", "query_id", "ndcg")
