"""Queries of the findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import affinity as aff
from ..operators import findings as fi
from ..operators import nba
from ..operators import questions as q
from .nba_queries import ALLV, MARGINS, _M, Snapshot
from .quality_queries import DECLARED, RFM, affinity_category, affinity_sql
from .question_queries import TIER, rfm
from .reco_queries import METRICS, Window
from .registry import query


@query("finding_frequency_vs_ticket", TIER + """, a AS (SELECT *, 100 * n_customers / sum(n_customers) OVER () AS pc, 100 * revenue / sum(revenue) OVER () AS pr, n_baskets / n_customers AS per FROM tiers),
b AS (SELECT *, round(pr / pc * 10000) / 10000 AS value_index FROM a), l AS (SELECT avg_ticket AS t, per AS p FROM b ORDER BY value_index, avg_ticket LIMIT 1)
SELECT tier, n_customers, avg_ticket, round(pc * 10000) / 10000 AS pct_customers, round(pr * 10000) / 10000 AS pct_revenue, value_index, round(per * 10000) / 10000 AS baskets_per_customer,
round(avg_ticket / t * 10000) / 10000 AS ticket_ratio, round(per / p * 10000) / 10000 AS frequency_ratio FROM b, l""")
def _(t):
    return fi.frequency_vs_ticket(q.add_shares(q.value_by(t, "tier")))


@query("finding_affinity", affinity_sql("category", 50) + f""",
declared AS (SELECT * FROM (VALUES {", ".join(f"({a}, '{b}', '{c}', {d}::DOUBLE)" for a, b, c, d in DECLARED)}) AS v(position, antecedent, consequent, target_lift)),
x AS (SELECT *, round(lift / target_lift * 10000) / 10000 AS r FROM declared LEFT JOIN aff USING (antecedent, consequent))
SELECT (SELECT count(*) FROM x WHERE lift > 1) AS n_above_one, antecedent, consequent, lift, target_lift FROM x WHERE r IS NOT NULL ORDER BY abs(r - 1) DESC, position LIMIT 1""")
def _(t):
    declared = t["items"].sparkSession.createDataFrame(DECLARED, "position int, antecedent string, consequent string, target_lift double")
    return fi.affinity_outlier(aff.expected_pairs(affinity_category(t), declared))


@query("finding_funnel", """d AS (SELECT device, count(*) AS n, count(basket_id) AS b FROM sessions GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n_sessions, round(100 * sum(b) / sum(n) * 10000) / 10000 AS pct_converted, round((max(100 * b / n) - min(100 * b / n)) * 10000) / 10000 AS spread FROM d""")
def _(t):
    return fi.funnel(q.funnel_by_device(t))


@query("finding_recommender", METRICS + """, wc AS (SELECT DISTINCT query_id, category FROM target JOIN products USING (product_id)), ch AS (SELECT DISTINCT query_id, 1 AS c FROM top5 SEMI JOIN wc USING (query_id, category)),
e AS (SELECT unnest(['all', CAST(profile AS VARCHAR)]) AS profile, ndcg, hit, coalesce(c, 0) AS c FROM pq JOIN qs USING (query_id) LEFT JOIN ch USING (query_id))
SELECT profile, count(*) AS n, round(avg(ndcg) * 1e6::DOUBLE) / 1e6::DOUBLE AS ndcg, round(100 * avg(c) * 10000) / 10000 AS category_hit, round(100 * avg(hit) * 10000) / 10000 AS product_hit FROM e GROUP BY 1""")
def _(t):
    w = Window(t)
    return fi.recommender(w.top(), w.metrics(), w.q, w.target, t["products"])


def frame(t):
    """Decisions with the risk, the recent spend and the segment of each customer."""
    s = Snapshot(t)
    churn = s.customers().select("customer_id", "spend_90", F.round(F.least(F.col("recency") / 180, F.lit(0.95)) * 1e6).alias("p")).withColumn("p_churn", F.col("p") / 1e6).drop("p")
    decided = nba.decide(nba.action_values(s.candidates()))
    return decided.join(churn, "customer_id").join(rfm(t).select("customer_id", "segment"), "customer_id")


FRAME = ALLV + "," + RFM + """,
frame AS (SELECT customer_id, dec.category, action, value, spend_90, round(least(recency / 180, 0.95::DOUBLE) * 1e6::DOUBLE) / 1e6::DOUBLE AS p_churn, segment FROM dec JOIN cfeat USING (customer_id) JOIN rfm USING (customer_id))"""
_WHO = "count(*) AS n_customers, round(avg(p_churn) * 1e6::DOUBLE) / 1e6::DOUBLE AS p_churn, round(avg(spend_90) * 10000) / 10000 AS spend_90, round(avg(value) * 1e6::DOUBLE) / 1e6::DOUBLE AS value, round(100 * avg(CAST(action <> 'none' AS DOUBLE)) * 10000) / 10000 AS pct_action"


@query("finding_nba_segments", FRAME + f" SELECT segment, {_WHO} FROM frame GROUP BY 1")
def _(t):
    return fi.nba_by_segment(frame(t))


@query("finding_nba_risk", FRAME + f", d AS (SELECT *, CAST(ntile(10) OVER (ORDER BY p_churn, customer_id) AS INT) AS decile FROM frame) SELECT decile, {_WHO} FROM d GROUP BY 1")
def _(t):
    return fi.nba_by_risk(frame(t))


@query("finding_nba_correlations", FRAME + " SELECT round(corr(p_churn, value) * 1e6::DOUBLE) / 1e6::DOUBLE AS with_risk, round(corr(spend_90, value) * 1e6::DOUBLE) / 1e6::DOUBLE AS with_spend FROM frame")
def _(t):
    return fi.nba_correlations(frame(t))


@query("finding_nba_margin", ALLV + f""", acts AS (SELECT department, count(*) AS n FROM dec JOIN kdep USING (category) WHERE action <> 'none' GROUP BY 1),
sold AS (SELECT department, CAST(sum(CAST(line_amount AS DECIMAL(18,2))) AS DOUBLE) AS r FROM items JOIN products USING (product_id) GROUP BY 1),
a AS (SELECT department, 100 * n / sum(n) OVER () AS a FROM acts), s AS (SELECT department, 100 * r / sum(r) OVER () AS s FROM sold)
SELECT department, round(a * 10000) / 10000 AS pct_actions, round(s * 10000) / 10000 AS pct_sales, 100 * {_M} AS margin, round(a / s * 10000) / 10000 AS index FROM a JOIN s USING (department)""")
def _(t):
    decided = nba.decide(nba.action_values(Snapshot(t).candidates()))
    return fi.nba_margin(decided, q.sales_by(t, "department"), nba.category_departments(t["products"]), nba.margin_rate(MARGINS))
