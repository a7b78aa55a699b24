"""Next best action: labels and features at a cutoff, propensity models, and an expected-value policy."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fn import count_if, fixed, money, need_weight, ratio, uniform
from .segments import repurchase

HORIZON, CHURN, LOOKBACK = 7, 28, 180

# --- labels -----------------------------------------------------------------------------


def in_window(baskets: DataFrame, start: Column, end: Column) -> DataFrame:
    """Identified baskets of days in [start, end)."""
    return baskets.where(F.col("customer_id").isNotNull() & (F.col("basket_day") >= start) & (F.col("basket_day") < end))


def _day(cutoff: str, shift: int = 0) -> Column:
    return F.date_add(F.lit(cutoff).cast("date"), shift)


def category_lines(baskets: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """``customer_id, basket_id, basket_day, category, product_id, quantity, line_amount, is_promo`` of identified baskets."""
    return items.join(baskets.where("customer_id is not null").select("basket_id", "customer_id", "basket_day"), "basket_id").join(products.select("product_id", "category"), "product_id")


def active_customers(baskets: DataFrame, cutoff: str, lookback: int = LOOKBACK) -> DataFrame:
    return in_window(baskets, _day(cutoff, -lookback), _day(cutoff)).select("customer_id").distinct()


def candidate_pairs(lines: DataFrame, cutoff: str, lookback: int = LOOKBACK) -> DataFrame:
    """``customer_id, category`` bought in the look-back."""
    return in_window(lines, _day(cutoff, -lookback), _day(cutoff)).select("customer_id", "category").distinct()


def category_label(pairs: DataFrame, lines: DataFrame, cutoff: str, horizon: int = HORIZON) -> DataFrame:
    """``label``: whether the pair is bought in [cutoff, cutoff + horizon)."""
    bought = in_window(lines, _day(cutoff), _day(cutoff, horizon)).select("customer_id", "category").distinct().withColumn("_b", F.lit(1))
    return pairs.join(bought, ["customer_id", "category"], "left").select("customer_id", "category", F.coalesce("_b", F.lit(0)).alias("label"))


def churn_label(baskets: DataFrame, cutoff: str, horizon: int = CHURN, lookback: int = LOOKBACK) -> DataFrame:
    """``customer_id, churned``: active customers with no basket in [cutoff, cutoff + horizon)."""
    back = in_window(baskets, _day(cutoff), _day(cutoff, horizon)).select("customer_id").distinct().withColumn("_b", F.lit(1))
    return active_customers(baskets, cutoff, lookback).join(back, "customer_id", "left").select("customer_id", F.when(F.col("_b").isNull(), 1).otherwise(0).alias("churned"))


def label_agreement(churn: DataFrame, customers: DataFrame) -> DataFrame:
    """One row: how often the computed churn agrees with the given label."""
    both = churn.join(customers.select("customer_id", "churn_label"), "customer_id")
    return both.agg(F.count(F.lit(1)).alias("n"), fixed(F.avg((F.col("churned") == F.col("churn_label").cast("int")).cast("double")), 6).alias("agreement"))


# --- features ---------------------------------------------------------------------------


#: Closed domains, in the order of their numbers.
TIERS, CHANNELS = ("bronze", "silver", "gold"), ("app", "web", "store")


def trend(now: Column, previous: Column) -> Column:
    """now / previous; 1 where there is nothing to compare with."""
    return F.when(previous > 0, now.cast("double") / previous).otherwise(1.0)


def level(c: str, domain: tuple[str, ...]) -> Column:
    """The place of a value in its domain; -1 for others and null."""
    return F.coalesce(F.array_position(F.lit(list(domain)), F.col(c)).cast("int") - 1, F.lit(-1))


CUSTOMER_FEATURES = (
    "recency", "tenure", "frequency", "monetary", "avg_ticket", "cadence", "n_28", "n_prev28", "n_90", "spend_28", "spend_prev28", "spend_90", "visit_trend", "spend_trend", "ticket_trend",
    "n_categories", "n_products", "promo_share", "household_size", "signup_tenure", "tier_idx", "channel_idx",
)


def customer_features(baskets: DataFrame, lines: DataFrame, customers: DataFrame, cutoff: str) -> DataFrame:
    """``CUSTOMER_FEATURES`` of every customer with a basket before the cutoff: history, windows of days back, trends, variety, master data.

    The windows are [cutoff - 28, cutoff), [cutoff - 56, cutoff - 28) and [cutoff - 90, cutoff).
    Variety is null where no basket has lines.
    """
    at = F.lit(cutoff).cast("date")
    past, sold = (x.where(F.col("customer_id").isNotNull() & (F.col("basket_day") < at)) for x in (baskets, lines))
    age = F.datediff(at, F.col("basket_day"))
    spans = {"28": age <= 28, "prev28": (age > 28) & (age <= 56), "90": age <= 90}
    spend = lambda c: F.coalesce(F.sum(F.when(c, F.col("total_amount").cast("decimal(18,2)"))).cast("double"), F.lit(0.0))
    one = past.groupBy("customer_id").agg(
        F.min(age).alias("recency"), F.max(age).alias("tenure"), F.count(F.lit(1)).alias("frequency"), money("total_amount").alias("monetary"),
        *[count_if(c).alias(f"n_{n}") for n, c in spans.items()], *[spend(c).alias(f"spend_{n}") for n, c in spans.items()],
    )
    variety = sold.groupBy("customer_id").agg(F.countDistinct("category").alias("n_categories"), F.countDistinct("product_id").alias("n_products"), fixed(F.avg(F.col("is_promo").cast("double")), 6).alias("promo_share"))
    master = customers.select("customer_id", "household_size", F.datediff(at, F.col("signup_date")).alias("signup_tenure"), level("tier", TIERS).alias("tier_idx"), level("preferred_channel", CHANNELS).alias("channel_idx"))
    n, m, c, d = (F.col(x) for x in ("n_28", "n_prev28", "spend_28", "spend_prev28"))
    ticket = lambda total, times: F.coalesce(ratio(total, times), F.lit(0.0))
    full = one.join(variety, "customer_id", "left").join(master, "customer_id")
    return full.withColumns(
        {
            "avg_ticket": fixed(ratio("monetary", "frequency"), 4), "cadence": fixed(F.when(F.col("frequency") > 1, F.col("tenure") / (F.col("frequency") - 1)), 4),
            "visit_trend": fixed(trend(n, m), 6), "spend_trend": fixed(trend(c, d), 6), "ticket_trend": fixed(trend(ticket(c, n), ticket(d, m)), 6),
        }
    ).select("customer_id", *CUSTOMER_FEATURES)


def category_popularity(lines: DataFrame, cutoff: str, days: int = 90) -> DataFrame:
    """``category, pop_share``: shares of spend of the last days; 1 each if nothing was sold."""
    sums = in_window(lines, _day(cutoff, -days), _day(cutoff)).groupBy("category").agg(money("line_amount").alias("s"))
    total = F.sum("s").over(W.partitionBy())
    return sums.select("category", fixed(F.when(total > 0, F.col("s") / total).otherwise(1.0), 6).alias("pop_share"))


def category_departments(products: DataFrame) -> DataFrame:
    """``category, department``: the one with most of its products, first in the alphabet."""
    counts = products.groupBy("category", "department").agg((-F.count(F.lit(1))).alias("n"))
    return counts.groupBy("category").agg(F.min(F.struct("n", "department"))["department"].alias("department"))


CATEGORY_FEATURES = (
    "days_since", "expected_days", "observed_days", "gap_std", "typical", "overdue_ratio", "due", "n_days", "cat_spend", "spend_share", "cat_units", "pop_share", "department_idx",
)


def category_features(lines: DataFrame, baskets: DataFrame, items: DataFrame, customers: DataFrame, products: DataFrame, cutoff: str) -> DataFrame:
    """``department`` and ``CATEGORY_FEATURES`` of each pair bought before the cutoff: its cycle then, and what was spent on it.

    ``spend_share`` is the category's share of all that the customer spent; departments are
    numbered in alphabetical order.
    """
    at = F.lit(cutoff).cast("date")
    past = baskets.where(F.col("basket_day") < at)
    cycles = repurchase(customers, past, items, products, day=cutoff)
    spent = lines.where(F.col("basket_day") < at).groupBy("customer_id", "category").agg(money("line_amount").alias("cat_spend"), F.sum("quantity").cast("long").alias("cat_units"))
    total = F.sum(F.col("cat_spend").cast("decimal(18,2)")).over(W.partitionBy("customer_id")).cast("double")
    spent = spent.withColumn("spend_share", fixed(F.when(total > 0, F.col("cat_spend") / total).otherwise(0.0), 6))
    of = category_departments(products)
    numbers = of.select("department").distinct().agg(F.array_sort(F.collect_list("department")).alias("all"))  # a closed domain
    of = of.crossJoin(F.broadcast(numbers)).select("category", "department", (F.array_position("all", F.col("department")) - 1).cast("int").alias("department_idx"))
    full = cycles.join(spent, ["customer_id", "category"], "full_outer").join(category_popularity(lines, cutoff), "category", "left").join(of, "category", "left")
    return full.withColumn("due", F.col("due").cast("int")).select("customer_id", "category", "department", *CATEGORY_FEATURES)


def sample_customers(customers: DataFrame, cutoff: str, n: int) -> DataFrame:
    """About n customers by a hash of id and cutoff; all if there are no more."""
    total = customers.agg(F.count(F.lit(1)).alias("_n"))
    return customers.crossJoin(F.broadcast(total)).where(uniform("customer_id", cutoff) * F.col("_n") < n).drop("_n")


def economics(lines: DataFrame, cutoff: str) -> DataFrame:
    """One row ``visit_spend``: what a customer spends on a category on a day of buying it, on average; 0 without lines."""
    per = lines.where(F.col("basket_day") < F.lit(cutoff).cast("date")).groupBy("customer_id", "basket_day", "category").agg(F.sum(F.col("line_amount").cast("decimal(18,2)")).alias("s"))
    return per.agg(fixed(F.coalesce(F.sum("s").cast("double") / F.count("s"), F.lit(0.0)), 4).alias("visit_spend"))


# --- propensity -------------------------------------------------------------------------


def fit_propensity(matrix: DataFrame, features: list[str], label: str, iterations: int = 20, depth: int = 5, seed: int = 42):
    """A boosted classifier; rows with ``is_validation`` stop it early if the column is there."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    gbt = GBTClassifier(featuresCol="x", labelCol=label, maxIter=iterations, maxDepth=depth, seed=seed)
    if "is_validation" in matrix.columns:
        gbt = gbt.setValidationIndicatorCol("is_validation")
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="x", handleInvalid="keep"), gbt]).fit(matrix.na.fill(-1.0, features))


def predict(model, matrix: DataFrame, features: list[str], name: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(matrix.na.fill(-1.0, features)).withColumn(name, vector_to_array("probability")[1]).drop("x", "probability", "rawPrediction", "prediction")


def classification_metrics(scored: DataFrame, score: str, label: str) -> DataFrame:
    """One row ``n, auc, pr_auc, base_rate, lift``; null where there is one class only.

    Everything comes from counts by score to six decimals, so the one ordered pass runs over
    a million scores at most, whatever the rows. ``lift`` is the rate of the best tenth over the base rate,
    rows of a tied score counting in proportion.
    """
    per = scored.groupBy(F.round(F.col(score).cast("double"), 6).alias("s")).agg(F.sum(label).cast("double").alias("p"), F.count(F.lit(1)).cast("double").alias("n"))
    down = W.orderBy(F.desc("s")).rowsBetween(W.unboundedPreceding, 0)
    every = W.partitionBy()
    run = per.withColumns({"tp": F.sum("p").over(down), "k": F.sum("n").over(down), "all_p": F.sum("p").over(every), "all_n": F.sum("n").over(every)})
    run = run.withColumn("neg", F.col("n") - F.col("p"))
    top = F.ceil(F.col("all_n") / 10)
    taken = F.greatest(F.lit(0.0), F.least(F.col("n"), top - (F.col("k") - F.col("n"))))
    sums = run.agg(
        F.first("all_n").alias("n"), F.first("all_p").alias("pos"), F.sum(F.col("neg") * (F.col("tp") - F.col("p") / 2)).alias("u"),
        F.sum(F.col("p") * F.col("tp") / F.col("k")).alias("ap"), F.sum(F.col("p") * taken / F.col("n")).alias("hit"), F.first(top).alias("top"),
    )
    rate = F.col("pos") / F.col("n")
    both = (F.col("pos") > 0) & (F.col("pos") < F.col("n"))
    return sums.select(
        F.col("n").cast("long").alias("n"), fixed(F.when(both, F.col("u") / (F.col("pos") * (F.col("n") - F.col("pos")))), 6).alias("auc"), fixed(F.when(both, F.col("ap") / F.col("pos")), 6).alias("pr_auc"),
        fixed(rate, 6).alias("base_rate"), fixed(F.when(both, F.col("hit") / F.col("top") / rate), 4).alias("lift"),
    )


# --- policy -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Action:
    """What an action costs and does."""

    name: str
    cost: float = 0.0
    discount: float = 0.0
    uplift: float = 1.0
    churn_reduction: float = 0.0

    def __post_init__(self):
        if min(self.cost, self.discount, self.churn_reduction) < 0 or self.uplift < 0 or self.churn_reduction > 1:
            raise ValueError("an action's figures must not be negative")


# The assumptions of the actions, margins by department, and the policy's parameters.
NONE, HIGHLIGHT, COUPON = Action("none"), Action("highlight", 0.01, 0.0, 1.10, 0.02), Action("coupon", 0.05, 2.54, 1.35, 0.10)
ACTIONS = (NONE, HIGHLIGHT, COUPON)
DEFAULT_MARGIN, MIN_RELEVANCE, WEEKS, MAX_SPEND = 0.25, 0.15, 4, 60.0


def relevance(overdue: Column | str, least: float = MIN_RELEVANCE) -> Column:
    """From ``least`` for what isn't needed up to 1 for what is due."""
    return F.lit(least) + (1 - least) * need_weight(overdue)


def margin_rate(margins: dict[str, float]) -> Column:
    """The margin of ``department``; the default for others and null."""
    if not margins:
        return F.lit(DEFAULT_MARGIN)
    return F.coalesce(F.create_map(*[x for k, v in margins.items() for x in (F.lit(k), F.lit(float(v)))])[F.col("department")], F.lit(DEFAULT_MARGIN))


def blended_margin(pairs: DataFrame, margins: dict[str, float]) -> DataFrame:
    """``customer_id, blended``: each customer's mean margin over their own mix of departments, weighted by spend.

    ``pairs`` has customer_id, department and cat_spend. Without spend it is the default.
    """
    spent = F.coalesce("cat_spend", F.lit(0.0))
    exact = lambda c: F.sum(c.cast("decimal(28,8)")).cast("double")
    return pairs.groupBy("customer_id").agg(fixed(F.coalesce(ratio(exact(spent * margin_rate(margins)), exact(spent)), F.lit(DEFAULT_MARGIN)), 6).alias("blended"))


def policy_candidates(pairs: DataFrame, churn: DataFrame, features: DataFrame, economics: DataFrame, margins: dict[str, float]) -> DataFrame:
    """``customer_id, category, p_purchase, p_churn, expected_spend, gross_margin, retention_value, relevance``.

    ``pairs`` has p_purchase, ``churn`` p_churn and spend_90 by customer, ``features`` what
    ``category_features`` gives. A purchase is expected to cost what the customer spent on the
    category a day of buying it, up to ``MAX_SPEND``, or ``economics`` if there was none; it earns
    the margin of the category's department. Keeping a customer is worth ``WEEKS`` of their recent
    spend at their blended margin, whichever category is offered; unknown customers' churn counts 0.
    """
    own = pairs.join(features.select("customer_id", "category", "department", "cat_spend", "n_days", "overdue_ratio"), ["customer_id", "category"], "left")
    kept = churn.select("customer_id", "p_churn", "spend_90").join(blended_margin(own, margins), "customer_id", "left")
    kept = kept.select("customer_id", "p_churn", fixed(WEEKS * (F.col("spend_90") * F.lit(7.0 / 90.0)) * F.coalesce("blended", F.lit(DEFAULT_MARGIN)), 6).alias("retention_value"))
    full = own.join(kept, "customer_id", "left").crossJoin(F.broadcast(economics))  # one row
    expected = F.least(F.coalesce(ratio("cat_spend", "n_days"), F.col("visit_spend")), F.lit(MAX_SPEND))
    return full.select(
        "customer_id", "category", "p_purchase", F.coalesce("p_churn", F.lit(0.0)).alias("p_churn"), fixed(expected, 4).alias("expected_spend"),
        fixed(expected * margin_rate(margins), 6).alias("gross_margin"), F.coalesce("retention_value", F.lit(0.0)).alias("retention_value"), fixed(relevance("overdue_ratio"), 6).alias("relevance"),
    )


def action_value(action: Action) -> Column:
    """The expected gain over doing nothing; 0 for the null action."""
    if action == NONE:
        return F.lit(0.0)
    p, m = F.col("p_purchase"), F.col("gross_margin")
    sale = F.least(p * action.uplift, F.lit(1.0)) * (m - action.discount) - action.cost - p * m
    return sale + action.churn_reduction * F.col("relevance") * F.col("p_churn") * F.col("retention_value")


def action_values(candidates: DataFrame, actions: tuple[Action, ...] = ACTIONS) -> DataFrame:
    """A row for each candidate and action, with ``action_id`` and ``value``."""
    table = F.array(*[F.struct(F.lit(i).alias("action_id"), F.lit(a.name).alias("action"), fixed(action_value(a), 6).alias("value")) for i, a in enumerate(actions)])
    return candidates.withColumn("a", F.explode(table)).select("customer_id", "category", "a.action_id", "a.action", "a.value")


def decide(values: DataFrame) -> DataFrame:
    """Per customer the action and category of most value; nothing, with a null category, unless it is positive.

    Ties: the smaller action_id, then the category first in the alphabet.
    """
    order = W.partitionBy("customer_id").orderBy(F.desc("value"), "action_id", "category")
    best = values.withColumn("_r", F.row_number().over(order)).where("_r = 1")
    gain = F.col("value") > 0
    return best.select(
        "customer_id", F.when(gain, F.col("category")).alias("category"), F.when(gain, F.col("action")).otherwise(NONE.name).alias("action"), F.when(gain, F.col("value")).otherwise(0.0).alias("value")
    )


def cover_all(decisions: DataFrame, universe: DataFrame) -> DataFrame:
    """Customers without candidates get no action."""
    return universe.select("customer_id").join(decisions, "customer_id", "left").select("customer_id", "category", F.coalesce("action", F.lit(NONE.name)).alias("action"), F.coalesce("value", F.lit(0.0)).alias("value"))


def always(values: DataFrame, candidates: DataFrame, action: str) -> DataFrame:
    """One action for everybody, on the category of the largest propensity."""
    order = W.partitionBy("customer_id").orderBy(F.desc("p_purchase"), "category")
    top = candidates.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("customer_id", "category")
    return values.where(F.col("action") == action).join(top, ["customer_id", "category"]).select("customer_id", "category", "action", "value")


def compare(policies: dict[str, DataFrame]) -> DataFrame:
    """``policy, n_customers, n_actions, total_value``."""
    out = None
    for name, d in policies.items():
        row = d.agg(F.count(F.lit(1)).alias("n_customers"), count_if(F.col("action") != NONE.name).alias("n_actions"), F.sum(F.col("value").cast("decimal(18,6)")).cast("double").alias("total_value")).withColumn("policy", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def sensitivity(candidates: DataFrame, uplifts: tuple[float, ...] = (), churn_reductions: tuple[float, ...] = ()) -> DataFrame:
    """``uplift, churn_reduction, n_actions, total_value`` of the best policy as the coupon's assumptions vary.

    The grid is a short list of assumptions: each candidate is evaluated under all in one pass.
    """
    grid = [(u, COUPON.churn_reduction) for u in uplifts] + [(COUPON.uplift, c) for c in churn_reductions]
    rows = [
        F.struct(F.lit(u).alias("uplift"), F.lit(c).alias("churn_reduction"), fixed(F.greatest(*[action_value(a) for a in (NONE, HIGHLIGHT, Action("coupon", COUPON.cost, COUPON.discount, u, c))]), 6).alias("value"))
        for u, c in grid
    ]
    each = candidates.withColumn("g", F.explode(F.array(*rows))).groupBy("customer_id", "g.uplift", "g.churn_reduction").agg(F.max("g.value").alias("value"))
    return each.groupBy("uplift", "churn_reduction").agg(count_if(F.col("value") > 0).alias("n_actions"), F.sum(F.col("value").cast("decimal(18,6)")).cast("double").alias("total_value"))


def need_curve(features: DataFrame, labels: DataFrame, edges: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0)) -> DataFrame:
    """``band, n, rate``: how often pairs of an overdue band are in fact bought."""
    band = F.lit(-1)
    for i, e in enumerate(edges):
        band = F.when(F.col("overdue_ratio") >= e, i).otherwise(band)
    return features.where("overdue_ratio is not null").join(labels, ["customer_id", "category"]).groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), fixed(F.avg("label"), 6).alias("rate"))


def targeting(decisions: DataFrame, features: DataFrame) -> DataFrame:
    """``action, n, n_due, pct_due``: how many recommended categories are due."""
    both = decisions.where("category is not null").join(features.select("customer_id", "category", "due"), ["customer_id", "category"], "left")
    return both.groupBy("action").agg(F.count(F.lit(1)).alias("n"), count_if(F.col("due") == 1).alias("n_due"), fixed(100 * F.avg(F.coalesce("due", F.lit(0))), 4).alias("pct_due"))


# --- impact -----------------------------------------------------------------------------


def impact_baseline(baskets: DataFrame, items: DataFrame) -> DataFrame:
    """One row: months, baskets, online baskets per month, and the mean amount of a line."""
    months = baskets.agg(F.countDistinct(F.date_trunc("month", F.col("basket_day").cast("timestamp"))).alias("n_months"), F.count(F.lit(1)).alias("n_baskets"), count_if(F.col("channel") != "store").alias("n_online"))
    line = items.agg(fixed(F.avg(F.col("line_amount").cast("decimal(18,2)")).cast("double"), 2).alias("mean_line"))
    return months.crossJoin(line).withColumn("online_per_month", fixed(ratio("n_online", "n_months"), 4))


def cross_sell_impact(baseline: DataFrame, hit_gain: float, margin: float, rates: tuple[float, ...] = (0.02, 0.05, 0.10, 0.20, 0.30)) -> DataFrame:
    """``rate, monthly, yearly``: online baskets x gain in hits x incremental rate x line x margin."""
    if not 0 <= margin <= 1:
        raise ValueError("margin must be in [0, 1]")
    each = baseline.withColumn("rate", F.explode(F.array(*[F.lit(r) for r in rates])))
    monthly = F.col("online_per_month") * hit_gain * F.col("rate") * F.col("mean_line") * margin
    return each.select("rate", fixed(monthly, 2).alias("monthly"), fixed(monthly * 12, 2).alias("yearly"))


def nba_impact(comparison: DataFrame, policy: str, waves: int = 12, base: int = 100_000) -> DataFrame:
    """One row: the policy's gain over the best other one, per wave and year, for ``base`` customers."""
    mine = comparison.where(F.col("policy") == policy).select("n_customers", F.col("total_value").alias("mine"))
    rest = comparison.where(F.col("policy") != policy).agg(F.max("total_value").alias("other"))
    gain = (F.col("mine") - F.col("other")) * base / F.col("n_customers")
    return mine.crossJoin(rest).select("mine", "other", fixed(gain, 2).alias("per_wave"), fixed(gain * waves, 2).alias("per_year"))
