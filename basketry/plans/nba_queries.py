"""Queries of next best action, impact and dataset verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fn import fixed
from ..operators import nba
from ..operators import questions as q
from ..operators import segments as seg
from ..operators import verify as ve
from ..shared import forget, saved
from .quality_queries import CYCLES
from .question_queries import LINES
from .registry import query

CUT = "2000-06-01"
C = f"DATE '{CUT}'"
R6, R4 = "round({} * 1e6::DOUBLE) / 1e6::DOUBLE", "round({} * 10000) / 10000"

CL = """
cl AS (SELECT b.customer_id, i.basket_id, b.basket_day, category, i.product_id, quantity, line_amount, is_promo FROM items i JOIN baskets b ON b.basket_id = i.basket_id JOIN products p ON p.product_id = i.product_id WHERE b.customer_id IS NOT NULL)"""
PAIRS = f"""{CL},
pairs AS (SELECT DISTINCT customer_id, category FROM cl WHERE basket_day >= {C} - 180 AND basket_day < {C}),
labels_ AS (SELECT customer_id, category, coalesce(x, 0) AS label FROM pairs LEFT JOIN (SELECT DISTINCT customer_id, category, 1 AS x FROM cl WHERE basket_day >= {C} AND basket_day < {C} + 7) USING (customer_id, category)),
act AS (SELECT DISTINCT customer_id FROM baskets WHERE customer_id IS NOT NULL AND basket_day >= {C} - 180 AND basket_day < {C}),
churn_ AS (SELECT customer_id, CAST(x IS NULL AS INT) AS churned FROM act LEFT JOIN (SELECT DISTINCT customer_id, 1 AS x FROM baskets WHERE customer_id IS NOT NULL AND basket_day >= {C} AND basket_day < {C} + 28) USING (customer_id))"""
CFEAT = f"""{PAIRS},
past AS (SELECT *, date_diff('day', basket_day, {C}) AS age FROM baskets WHERE customer_id IS NOT NULL AND basket_day < {C}),
cf1 AS (SELECT customer_id, CAST(min(age) AS INT) AS recency, CAST(max(age) AS INT) AS tenure, count(DISTINCT basket_id) AS frequency, CAST(sum(CAST(total_amount AS DECIMAL(18,2))) AS DOUBLE) AS monetary,
  count(*) FILTER (basket_day >= {C} - 28) AS n_28, count(*) FILTER (basket_day >= {C} - 56 AND basket_day < {C} - 28) AS n_prev28, count(*) FILTER (basket_day >= {C} - 90) AS n_90,
  coalesce(CAST(sum(CAST(total_amount AS DECIMAL(18,2))) FILTER (basket_day >= {C} - 28) AS DOUBLE), 0) AS spend_28, coalesce(CAST(sum(CAST(total_amount AS DECIMAL(18,2))) FILTER (basket_day >= {C} - 56 AND basket_day < {C} - 28) AS DOUBLE), 0) AS spend_prev28,
  coalesce(CAST(sum(CAST(total_amount AS DECIMAL(18,2))) FILTER (basket_day >= {C} - 90) AS DOUBLE), 0) AS spend_90 FROM past GROUP BY 1),
cf2 AS (SELECT customer_id, count(DISTINCT category) AS n_categories, count(DISTINCT product_id) AS n_products, {R6.format("avg(CAST(is_promo AS DOUBLE))")} AS promo_share FROM cl WHERE basket_day < {C} GROUP BY 1),
cfeat AS (SELECT customer_id, recency, tenure, frequency, monetary, {R4.format("(monetary / frequency)")} AS avg_ticket, {R4.format("(CASE WHEN frequency > 1 THEN tenure / (frequency - 1) END)")} AS cadence, n_28, n_prev28, n_90, spend_28, spend_prev28, spend_90,
  {R6.format("(CASE WHEN n_prev28 > 0 THEN n_28 / n_prev28 ELSE 1 END)")} AS visit_trend, {R6.format("(CASE WHEN spend_prev28 > 0 THEN spend_28 / spend_prev28 ELSE 1 END)")} AS spend_trend,
  {R6.format("(CASE WHEN n_prev28 > 0 AND spend_prev28 > 0 THEN (CASE WHEN n_28 > 0 THEN spend_28 / n_28 ELSE 0 END) / (spend_prev28 / n_prev28) ELSE 1 END)")} AS ticket_trend, n_categories, n_products, promo_share, household_size,
  CAST(date_diff('day', signup_date, {C}) AS INT) AS signup_tenure, CASE tier WHEN 'bronze' THEN 0 WHEN 'silver' THEN 1 WHEN 'gold' THEN 2 ELSE -1 END AS tier_idx, CASE preferred_channel WHEN 'app' THEN 0 WHEN 'web' THEN 1 WHEN 'store' THEN 2 ELSE -1 END AS channel_idx
  FROM cf1 LEFT JOIN cf2 USING (customer_id) JOIN customers USING (customer_id))"""
KFEAT = CYCLES.replace("(SELECT max(basket_day) FROM baskets)", C).replace("WHERE customer_id IS NOT NULL", f"WHERE customer_id IS NOT NULL AND basket_day < {C}") + f""",
kpop0 AS (SELECT category, CAST(sum(CAST(line_amount AS DECIMAL(18,2))) AS DOUBLE) AS s FROM cl WHERE basket_day >= {C} - 90 AND basket_day < {C} GROUP BY 1),
kpop AS (SELECT category, {R6.format("(s / sum(s) OVER ())")} AS pop_share FROM kpop0),
kdep AS (SELECT category, department FROM (SELECT category, department, row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, department) AS r FROM products GROUP BY 1, 2) WHERE r = 1),
kspent AS (SELECT customer_id, category, sum(CAST(line_amount AS DECIMAL(18,2))) AS s, CAST(sum(quantity) AS BIGINT) AS cat_units FROM cl WHERE basket_day < {C} GROUP BY 1, 2),
kfeat AS (SELECT customer_id, category, department, days_since, expected_days, observed_days, gap_std, typical, overdue_ratio, CAST(due AS INT) AS due, n_days, CAST(s AS DOUBLE) AS cat_spend,
  {R6.format("(CAST(s AS DOUBLE) / CAST(sum(s) OVER (PARTITION BY customer_id) AS DOUBLE))")} AS spend_share, cat_units, pop_share, CAST((SELECT count(DISTINCT department) FROM kdep d WHERE d.department < k.department) AS INT) AS department_idx
  FROM cycles FULL JOIN kspent USING (customer_id, category) LEFT JOIN kpop USING (category) LEFT JOIN kdep k USING (category))"""
MARGINS = {"ECONOMY": 0.18, "STANDARD": 0.22, "PROMO": 0.30, "LARGE": 0.35}
_M = "CASE department " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in MARGINS.items()) + " ELSE 0.25::DOUBLE END"
#: Fixed scorers stand in for the models, so that the policy's arithmetic can be checked.
KECO = f"""
keco AS (SELECT round(CAST(sum(s) AS DOUBLE) / count(*) * 10000) / 10000 AS visit_spend FROM (SELECT sum(CAST(line_amount AS DECIMAL(18,2))) AS s FROM cl WHERE basket_day < {C} GROUP BY customer_id, basket_day, category))"""
KMAR = f"""
kmar AS (SELECT customer_id, {R6.format("(CAST(sum(CAST(cat_spend * rate AS DECIMAL(28,8))) AS DOUBLE) / CAST(sum(CAST(cat_spend AS DECIMAL(28,8))) AS DOUBLE))")} AS blended FROM (SELECT customer_id, cat_spend, {_M} AS rate FROM pairs JOIN kfeat USING (customer_id, category)) GROUP BY 1)"""
CAND = f"""{KECO},{KMAR},
cand AS (SELECT customer_id, category, p_purchase, p_churn, {R4.format("sp")} AS expected_spend, {R6.format("(sp * rate)")} AS gross_margin, {R6.format("(4 * (spend_90 * (7.0::DOUBLE / 90.0::DOUBLE)) * blended)")} AS retention_value,
  {R6.format("(0.15::DOUBLE + 0.85::DOUBLE * CASE WHEN overdue_ratio IS NULL THEN 0 WHEN overdue_ratio >= 1 THEN 1 ELSE overdue_ratio END)")} AS relevance FROM (SELECT p.customer_id, p.category, {_M} AS rate, blended, spend_90, overdue_ratio, least(coalesce(cat_spend / nullif(n_days, 0), visit_spend), 60) AS sp,
    {R6.format("least(n_days / 20, 0.9::DOUBLE)")} AS p_purchase, {R6.format("least(recency / 180, 0.95::DOUBLE)")} AS p_churn
  FROM pairs p JOIN kfeat k ON k.customer_id = p.customer_id AND k.category = p.category JOIN cfeat c ON c.customer_id = p.customer_id JOIN kmar m ON m.customer_id = p.customer_id, keco) x)"""


def value_sql(uplift: str, discount: str, cost: str, churn: str) -> str:
    return f"(least(p_purchase * {uplift}, 1) * (gross_margin - {discount}) - {cost} - p_purchase * gross_margin + {churn} * relevance * p_churn * retention_value)"


_HI, _CO = value_sql("1.1::DOUBLE", "0.0::DOUBLE", "0.01::DOUBLE", "0.02::DOUBLE"), value_sql("1.35::DOUBLE", "2.54::DOUBLE", "0.05::DOUBLE", "0.1::DOUBLE")
VALUES = f"""
vals AS (SELECT customer_id, category, 0 AS action_id, 'none' AS action, 0.0::DOUBLE AS value FROM cand UNION ALL SELECT customer_id, category, 1, 'highlight', {R6.format(_HI)} FROM cand UNION ALL SELECT customer_id, category, 2, 'coupon', {R6.format(_CO)} FROM cand)"""
DECIDE = """
dec AS (SELECT customer_id, CASE WHEN value > 0 THEN category END AS category, CASE WHEN value > 0 THEN action ELSE 'none' END AS action, CASE WHEN value > 0 THEN value ELSE 0 END AS value FROM
  (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY value DESC, action_id, category) AS rk FROM vals) WHERE rk = 1)"""
ALLV = ",".join([CFEAT, KFEAT, CAND, VALUES, DECIDE])
COMPARE = ALLV + """,
topc AS (SELECT customer_id, category FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY p_purchase DESC, category) AS rk FROM cand) WHERE rk = 1),
alw AS (SELECT customer_id, category, action, value FROM vals JOIN topc USING (customer_id, category)),
cmp AS (SELECT 'best' AS policy, count(*) AS n_customers, count(*) FILTER (action <> 'none') AS n_actions, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS total_value FROM (SELECT customer_id, coalesce(action, 'none') AS action, coalesce(value, 0) AS value FROM act LEFT JOIN dec USING (customer_id))
  UNION ALL SELECT 'always ' || action, count(*), count(*) FILTER (action <> 'none'), CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) FROM alw GROUP BY action)"""


class Snapshot:
    """All tables of one cutoff."""

    def __init__(self, t, cutoff: str = CUT):
        self.t, self.cutoff = t, cutoff
        self.lines = nba.category_lines(t["baskets"], t["items"], t["products"])
        self.pairs = nba.candidate_pairs(self.lines, cutoff)

    def labels(self):
        return nba.category_label(self.pairs, self.lines, self.cutoff)

    def churn(self):
        return nba.churn_label(self.t["baskets"], self.cutoff)

    def customers(self):
        return nba.customer_features(self.t["baskets"], self.lines, self.t["customers"], self.cutoff)

    def categories(self):
        return nba.category_features(self.lines, self.t["baskets"], self.t["items"], self.t["customers"], self.t["products"], self.cutoff)

    def candidates(self):
        own, cust = self.categories(), self.customers()
        scored = self.pairs.join(own.select("customer_id", "category", "n_days"), ["customer_id", "category"], "left").select("customer_id", "category", fixed(F.least(F.col("n_days") / 20, F.lit(0.9)), 6).alias("p_purchase"))
        churn = cust.select("customer_id", "spend_90", fixed(F.least(F.col("recency") / 180, F.lit(0.95)), 6).alias("p_churn"))
        return nba.policy_candidates(scored, churn, own, nba.economics(self.lines, self.cutoff), MARGINS)

    def comparison(self):
        cand = self.candidates()
        values = nba.action_values(cand)
        universe = nba.active_customers(self.t["baskets"], self.cutoff)
        policies = {"best": nba.cover_all(nba.decide(values), universe)} | {f"always {a.name}": nba.always(values, cand, a.name) for a in nba.ACTIONS}
        return nba.compare(policies)


@query("nba_category_lines", CL + " SELECT * FROM cl")
def _(t):
    return Snapshot(t).lines.select("customer_id", "basket_id", "basket_day", "category", "product_id", "quantity", "line_amount", "is_promo")


@query("nba_active_customers", PAIRS + " SELECT customer_id FROM act")
def _(t):
    return nba.active_customers(t["baskets"], CUT)


@query("nba_candidate_pairs", PAIRS + " SELECT * FROM pairs")
def _(t):
    return Snapshot(t).pairs


@query("nba_category_label", PAIRS + " SELECT * FROM labels_")
def _(t):
    return Snapshot(t).labels()


@query("nba_churn_label", PAIRS + " SELECT * FROM churn_")
def _(t):
    return Snapshot(t).churn()


@query("nba_label_agreement", PAIRS + " SELECT count(*) AS n, " + R6.format("avg(CAST(churned = CAST(churn_label AS INT) AS DOUBLE))") + " AS agreement FROM churn_ JOIN customers USING (customer_id)")
def _(t):
    return nba.label_agreement(Snapshot(t).churn(), t["customers"])


@query("nba_customer_features", CFEAT + " SELECT * FROM cfeat")
def _(t):
    return Snapshot(t).customers()


@query("nba_category_popularity", CL + "," + KFEAT + " SELECT * FROM kpop")
def _(t):
    return nba.category_popularity(Snapshot(t).lines, CUT)


@query("nba_category_features", CL + "," + KFEAT + " SELECT * FROM kfeat")
def _(t):
    return Snapshot(t).categories()


@query("nba_sample_customers", f"SELECT customer_id FROM customers WHERE CAST(concat('0x', substr(md5(concat(customer_id, '|{CUT}')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE * (SELECT count(*) FROM customers) < 300")
def _(t):
    return nba.sample_customers(t["customers"].select("customer_id"), CUT, 300)


@query("nba_economics", CL + "," + KECO + " SELECT * FROM keco")
def _(t):
    return nba.economics(Snapshot(t).lines, CUT)


@query("nba_blended_margin", PAIRS + "," + KFEAT + "," + KMAR + " SELECT * FROM kmar")
def _(t):
    s = Snapshot(t)
    return nba.blended_margin(s.pairs.join(s.categories(), ["customer_id", "category"]), MARGINS)


@query("nba_relevance", CL + "," + KFEAT + " SELECT customer_id, category, " + R6.format("(0.15::DOUBLE + 0.85::DOUBLE * CASE WHEN overdue_ratio IS NULL THEN 0 WHEN overdue_ratio >= 1 THEN 1 ELSE overdue_ratio END)") + " AS relevance FROM kfeat")
def _(t):
    return Snapshot(t).categories().select("customer_id", "category", fixed(nba.relevance("overdue_ratio"), 6).alias("relevance"))


@query("nba_policy_candidates", ",".join([CFEAT, KFEAT, CAND]) + " SELECT * FROM cand")
def _(t):
    return Snapshot(t).candidates()


@query("nba_action_values", ALLV + " SELECT * FROM vals")
def _(t):
    return nba.action_values(Snapshot(t).candidates())


@query("nba_decide", ALLV + " SELECT * FROM dec")
def _(t):
    return nba.decide(nba.action_values(Snapshot(t).candidates()))


@query("nba_cover_all", ALLV + " SELECT customer_id, category, coalesce(action, 'none') AS action, coalesce(value, 0) AS value FROM act LEFT JOIN dec USING (customer_id)")
def _(t):
    return nba.cover_all(nba.decide(nba.action_values(Snapshot(t).candidates())), nba.active_customers(t["baskets"], CUT))


@query("nba_compare_policies", COMPARE + " SELECT * FROM cmp")
def _(t):
    return Snapshot(t).comparison()


def _sens(u: float, c: float) -> str:
    best = f"greatest(0, {_HI}, {value_sql(f'{u}::DOUBLE', '2.54::DOUBLE', '0.05::DOUBLE', f'{c}::DOUBLE')})"
    return f"SELECT {u}::DOUBLE AS uplift, {c}::DOUBLE AS churn_reduction, customer_id, max({R6.format(best)}) AS value FROM cand GROUP BY customer_id"


_UPS, _REDS = (1.0, 1.35, 1.7, 2.0), (0.0, 0.05, 0.2)
_GRID = [(u, 0.1) for u in _UPS] + [(1.35, c) for c in _REDS]


@query("nba_sensitivity", ",".join([CFEAT, KFEAT, CAND]) + ", s AS (" + " UNION ALL ".join(_sens(u, c) for u, c in _GRID) + ") SELECT uplift, churn_reduction, count(*) FILTER (value > 0) AS n_actions, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS total_value FROM s GROUP BY 1, 2")
def _(t):
    return nba.sensitivity(Snapshot(t).candidates(), _UPS, _REDS)


@query("nba_need_curve", PAIRS + "," + KFEAT + ", b AS (SELECT CASE WHEN overdue_ratio >= 3 THEN 7 WHEN overdue_ratio >= 2 THEN 6 WHEN overdue_ratio >= 1.5 THEN 5 WHEN overdue_ratio >= 1 THEN 4 WHEN overdue_ratio >= 0.75 THEN 3 WHEN overdue_ratio >= 0.5 THEN 2 WHEN overdue_ratio >= 0.25 THEN 1 WHEN overdue_ratio >= 0 THEN 0 ELSE -1 END AS band, label FROM kfeat JOIN labels_ USING (customer_id, category) WHERE overdue_ratio IS NOT NULL) SELECT band, count(*) AS n, " + R6.format("avg(label)") + " AS rate FROM b GROUP BY 1")
def _(t):
    s = Snapshot(t)
    return nba.need_curve(s.categories(), s.labels())


@query("nba_targeting", ALLV + " SELECT action, count(*) AS n, count(*) FILTER (due = 1) AS n_due, " + R4.format("(100 * avg(coalesce(due, 0)))") + " AS pct_due FROM dec LEFT JOIN kfeat USING (customer_id, category) WHERE category IS NOT NULL GROUP BY 1")
def _(t):
    s = Snapshot(t)
    return nba.targeting(nba.decide(nba.action_values(s.candidates())), s.categories())


@query("nba_metrics", PAIRS + "," + KFEAT + """,
sc AS (SELECT least(n_days / 20, 0.9::DOUBLE) AS s, label FROM labels_ JOIN kfeat USING (customer_id, category)),
pr AS (SELECT s, CAST(sum(label) AS DOUBLE) AS p, CAST(count(*) AS DOUBLE) AS n FROM sc GROUP BY 1),
rn AS (SELECT *, n - p AS neg, sum(p) OVER w AS tp, sum(n) OVER w AS k, sum(p) OVER () AS pp, sum(n) OVER () AS nn FROM pr WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
sm AS (SELECT any_value(nn) AS nn, any_value(pp) AS pp, sum(neg * (tp - p / 2)) AS u, sum(p * tp / k) AS ap, sum(p * greatest(0, least(n, ceil(nn / 10) - (k - n))) / n) AS hit FROM rn)
SELECT CAST(nn AS BIGINT) AS n, """ + R6.format("(u / (pp * (nn - pp)))") + " AS auc, " + R6.format("(ap / pp)") + " AS pr_auc, " + R6.format("(pp / nn)") + " AS base_rate, " + R4.format("(hit / ceil(nn / 10) / (pp / nn))") + " AS lift FROM sm")
def _(t):
    s = Snapshot(t)
    scored = s.labels().join(s.categories(), ["customer_id", "category"]).select(F.least(F.col("n_days") / 20, F.lit(0.9)).alias("s"), "label")
    return nba.classification_metrics(scored, "s", "label")


#: Cutoffs to train on, to stop early by, and to judge on.
TRAIN, VALIDATE = ("2000-01-01", "2000-02-01", "2000-03-01", "2000-04-01"), "2000-05-01"
ROUNDS = 30


def model_metrics(t, rows, features, label, name):
    """Metrics on the last cutoff of a model trained on earlier ones, of which the last tells when to stop."""
    full = None
    for cutoff in (*TRAIN, VALIDATE):
        part = rows(Snapshot(t, cutoff)).select(*features, label).withColumn("is_validation", F.lit(cutoff == VALIDATE))
        full = part if full is None else full.unionByName(part)
    full = saved(full)
    model = nba.fit_propensity(full, features, label, ROUNDS)
    forget(full)
    return nba.classification_metrics(nba.predict(model, rows(Snapshot(t)), features, name), name, label)


@query("nba_churn_model")
def _(t):
    """A boosted churn model of four cutoffs, stopped by a fifth and judged on a later one."""
    return model_metrics(t, lambda s: s.customers().join(s.churn(), "customer_id"), list(nba.CUSTOMER_FEATURES), "churned", "p_churn")


@query("nba_purchase_model")
def _(t):
    def rows(s):
        return s.labels().join(s.customers(), "customer_id").join(s.categories(), ["customer_id", "category"])

    return model_metrics(t, rows, [*nba.CUSTOMER_FEATURES, *nba.CATEGORY_FEATURES], "label", "p_purchase")


BASELINE = "bl AS (SELECT count(DISTINCT date_trunc('month', basket_day)) AS n_months, count(*) AS n_baskets, count(*) FILTER (channel <> 'store') AS n_online, (SELECT round(CAST(sum(CAST(line_amount AS DECIMAL(18,2))) AS DOUBLE) / count(*) * 100) / 100 FROM items) AS mean_line FROM baskets), bl2 AS (SELECT *, " + R4.format("(n_online / n_months)") + " AS online_per_month FROM bl)"


@query("impact_baseline", BASELINE + " SELECT * FROM bl2")
def _(t):
    return nba.impact_baseline(t["baskets"], t["items"])


@query("impact_cross_sell", BASELINE + ", r AS (SELECT CAST(rate AS DOUBLE) AS rate, online_per_month * 0.04::DOUBLE * rate * mean_line * 0.25::DOUBLE AS m FROM bl2, (VALUES (0.02::DOUBLE), (0.05::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE), (0.3::DOUBLE)) v(rate)) SELECT rate, round(m * 100) / 100 AS monthly, round(m * 12 * 100) / 100 AS yearly FROM r")
def _(t):
    return nba.cross_sell_impact(nba.impact_baseline(t["baskets"], t["items"]), 0.04, 0.25)


@query("impact_nba", COMPARE + ", x AS (SELECT total_value AS mine, n_customers, (SELECT max(total_value) FROM cmp WHERE policy <> 'best') AS other FROM cmp WHERE policy = 'best') SELECT mine, other, round((mine - other) * 100000 / n_customers * 100) / 100 AS per_wave, round((mine - other) * 100000 / n_customers * 12 * 100) / 100 AS per_year FROM x")
def _(t):
    return nba.nba_impact(Snapshot(t).comparison(), "best")


# --- verification -------------------------------------------------------------------------

PEAKS = {"Brand#1": [1, 2], "Brand#2": [6, 7, 8], "Brand#3": [12]}


@query("verify_seasonality_ratio", LINES + ", m AS (SELECT category, month(basket_day) AS mo, count(*) AS n FROM ln GROUP BY 1, 2), s AS (SELECT *, n / sum(n) OVER (PARTITION BY mo) AS share FROM m), p AS (SELECT *, CASE category WHEN 'Brand#1' THEN mo IN (1, 2) WHEN 'Brand#2' THEN mo IN (6, 7, 8) WHEN 'Brand#3' THEN mo = 12 END AS pk FROM s WHERE category IN ('Brand#1', 'Brand#2', 'Brand#3')) SELECT category, " + R4.format("(avg(share) FILTER (pk) / avg(share) FILTER (NOT pk))") + " AS ratio FROM p GROUP BY 1")
def _(t):
    return ve.seasonality_ratio(q.lines(t), PEAKS)


@query("verify_promotion_uplift", """
v AS (SELECT *, date_diff('day', start_date, end_date) + 1 AS n_on FROM promotions WHERE end_date >= start_date), sp AS (SELECT date_diff('day', min(basket_day), max(basket_day)) + 1 AS nd FROM baskets),
so AS (SELECT product_id, basket_day, sum(quantity) AS u FROM items JOIN baskets USING (basket_id) GROUP BY 1, 2),
x AS (SELECT v.promotion_id, n_on, nd, coalesce((SELECT sum(u) FROM so WHERE so.product_id = v.product_id), 0) AS al, coalesce((SELECT sum(u) FROM so WHERE so.product_id = v.product_id AND basket_day BETWEEN v.start_date AND v.end_date), 0) AS o FROM v, sp)
SELECT count(*) AS n_promotions, round(CAST(sum(CAST(round(o / n_on * 1e9::DOUBLE) / 1e9::DOUBLE AS DECIMAL(28,9))) AS DOUBLE) / CAST(sum(CAST(round((al - o) / (nd - n_on) * 1e9::DOUBLE) / 1e9::DOUBLE AS DECIMAL(28,9))) AS DOUBLE) * 10000) / 10000 AS uplift FROM x""")
def _(t):
    return ve.promotion_uplift(t["promotions"], t["baskets"], t["items"])


@query("verify_repurchase_cycles", CYCLES + """, ld AS (SELECT customer_id, count(*) AS n FROM pdays GROUP BY 1), hv AS (SELECT customer_id FROM ld WHERE n >= (SELECT quantile_cont(n, 0.9) FROM ld))
SELECT category, count(*) AS n_gaps, median(gap) AS median_gap, median(gap) FILTER (customer_id IN (SELECT customer_id FROM hv)) AS median_gap_heavy, any_value(typical) AS typical FROM gaps JOIN typical USING (category) WHERE gap IS NOT NULL GROUP BY 1""")
def _(t):
    return ve.repurchase_cycles(seg.purchase_days(t["baskets"], t["items"], t["products"]), seg.typical_days(t["products"]))


@query("verify_sku_loyalty", LINES + ", p AS (SELECT customer_id, category, product_id, count(*) AS n FROM ln WHERE customer_id IS NOT NULL GROUP BY 1, 2, 3), r AS (SELECT customer_id, category, sum(n) AS total, count(*) AS skus, max(n) AS best FROM p GROUP BY 1, 2 HAVING sum(n) >= 3) SELECT category, count(*) AS n_pairs, " + "round(avg(skus / total) * 1e9::DOUBLE) / 1e9::DOUBLE" + " AS skus_per_purchase, " + "round(avg(best / total) * 1e9::DOUBLE) / 1e9::DOUBLE" + " AS favourite_share FROM r GROUP BY 1")
def _(t):
    return ve.sku_loyalty(q.lines(t))


@query("verify_basket_size", "SELECT count(*) AS n_baskets, " + R4.format("avg(n)") + " AS mean, " + R4.format("(stddev_pop(n) / avg(n))") + " AS cv, " + ", ".join(f"quantile_cont(n, {p}) AS q{int(p * 100):02}" for p in (0.1, 0.25, 0.5, 0.75, 0.9, 0.99)) + ", " + R4.format("(100 * avg(CAST(n <= 3 AS DOUBLE)))") + " AS pct_small, " + R4.format("(100 * avg(CAST(n >= 8 AS DOUBLE)))") + " AS pct_large FROM (SELECT basket_id, count(*) AS n FROM items GROUP BY 1)")
def _(t):
    return ve.basket_size(t["items"])


@query("verify_lines_per_category", LINES + ", p AS (SELECT basket_id, category, count(*) AS n FROM ln GROUP BY 1, 2) SELECT " + R6.format("avg(n)") + " AS mean_lines, " + R4.format("(100 * avg(CAST(n > 1 AS DOUBLE)))") + " AS pct_pairs_repeated, (SELECT " + R4.format("(100 * avg(CAST(m > 1 AS DOUBLE)))") + " FROM (SELECT basket_id, max(n) AS m FROM p GROUP BY 1)) AS pct_baskets_repeated FROM p")
def _(t):
    return ve.lines_per_category(q.lines(t))


@query("verify_controlled_cooccurrence", """
s AS (SELECT DISTINCT basket_id, category AS item FROM items JOIN products USING (product_id)), z AS (SELECT basket_id, CASE WHEN count(*) <= 2 THEN 0 WHEN count(*) <= 4 THEN 1 WHEN count(*) <= 6 THEN 2 ELSE 3 END AS band FROM s GROUP BY 1),
b AS (SELECT s.*, band FROM s JOIN z USING (basket_id)), n AS (SELECT band, item, count(*) AS n FROM b GROUP BY 1, 2), t AS (SELECT band, count(*) AS t FROM z GROUP BY 1),
o AS (SELECT x.band, x.item AS a, y.item AS b, count(*) AS nb FROM b x JOIN b y ON x.basket_id = y.basket_id AND x.item < y.item GROUP BY 1, 2, 3),
c AS (SELECT o.*, p.n * q.n / t AS e, t FROM o JOIN n p ON p.band = o.band AND p.item = a JOIN n q ON q.band = o.band AND q.item = o.b JOIN t ON t.band = o.band),
l AS (SELECT a, b, sum(nb / e * t) FILTER (e >= 5) / sum(t) FILTER (e >= 5) AS ml, sum(nb) AS nb FROM c GROUP BY 1, 2), al AS (SELECT item, sum(n) AS n FROM n GROUP BY 1),
f AS (SELECT a, b, ml, nb * (SELECT sum(t) FROM t) / (p.n * q.n) AS lift FROM l JOIN al p ON p.item = a JOIN al q ON q.item = b WHERE ml IS NOT NULL)
SELECT a, b, round(lift * 10000) / 10000 AS lift, round(ml / (SELECT median(ml) FROM f) * 10000) / 10000 AS controlled FROM f""")
def _(t):
    return ve.controlled_cooccurrence(t["items"], t["products"])


@query("verify_private_label", LINES + ", p AS (SELECT customer_id, count(*) AS n, avg(CAST(private_label AS DOUBLE)) AS share FROM ln WHERE customer_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 10), m AS (SELECT *, avg(share) OVER () AS mean FROM p) SELECT count(*) AS n_customers, " + R6.format("var_samp(share)") + " AS observed, " + R6.format("avg(mean * (1 - mean) / n)") + " AS expected, " + R4.format("(var_samp(share) / avg(mean * (1 - mean) / n))") + " AS ratio FROM m")
def _(t):
    return ve.private_label_propensity(q.lines(t))


@query("verify_churn_signal", """
l AS (SELECT max(basket_day) AS last, min(basket_day) AS first FROM baskets),
p AS (SELECT customer_id, count(*) FILTER (basket_day > last - 90) AS nr, count(*) FILTER (basket_day <= last - 90) AS nb, CAST(avg(total_amount) FILTER (basket_day > last - 90) AS DOUBLE) AS tr, CAST(avg(total_amount) FILTER (basket_day <= last - 90) AS DOUBLE) AS tb, any_value(date_diff('day', first, last)) AS span FROM baskets, l WHERE customer_id IS NOT NULL GROUP BY 1)
SELECT churn_label, count(*) AS n, round(median(nr / 90 / (nb / (span - 89))) * 10000) / 10000 AS visit_ratio, round(median(tr / tb) * 10000) / 10000 AS ticket_ratio FROM p JOIN customers USING (customer_id) WHERE nb > 0 GROUP BY 1""")
def _(t):
    return ve.churn_signal(t["customers"], t["baskets"])


@query("verify_quality_issues", """
qq AS (SELECT quantile_cont(total_amount, 0.25) AS q1, quantile_cont(total_amount, 0.75) AS q3 FROM rbaskets)
SELECT 'negative_quantity' AS issue, count(*) FILTER (quantity < 0) AS n, round(100 * avg(CAST(quantity < 0 AS DOUBLE)) * 10000) / 10000 AS pct FROM ritems
UNION ALL SELECT 'missing_city', count(*) FILTER (city IS NULL), round(100 * avg(CAST(city IS NULL AS DOUBLE)) * 10000) / 10000 FROM rcustomers
UNION ALL SELECT 'missing_brand', count(*) FILTER (brand IS NULL), round(100 * avg(CAST(brand IS NULL AS DOUBLE)) * 10000) / 10000 FROM rproducts
UNION ALL SELECT 'inverted_promotion', count(*) FILTER (end_date < start_date), round(100 * avg(CAST(end_date < start_date AS DOUBLE)) * 10000) / 10000 FROM rpromotions
UNION ALL SELECT 'total_outlier', count(*) FILTER (total_amount > q3 + 3 * (q3 - q1)), round(100 * avg(CAST(total_amount > q3 + 3 * (q3 - q1) AS DOUBLE)) * 10000) / 10000 FROM rbaskets, qq""", "raw")
def _(t):
    return ve.quality_issues(t)


@query("verify_churn_flag", "SELECT customer_id, max(basket_day) < (SELECT max(basket_day) FROM baskets) - 60 AS churned FROM baskets WHERE customer_id IS NOT NULL GROUP BY 1")
def _(t):
    return ve.churn_flag(t["baskets"])


@query("verify_volumes", "\nUNION ALL ".join(f"SELECT '{a}' AS \"table\", count(*) AS n FROM {b}" for a, b in {"customers": "customers", "products": "products", "promotions": "promotions", "baskets": "baskets", "items": "items", "sessions": "sessions", "events": "sevents"}.items()))
def _(t):
    return ve.volumes({n: df for n, df in t.items() if n != "nations"})
