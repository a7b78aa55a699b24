"""Queries of the business questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import affinity as aff
from ..operators import questions as q
from ..operators import segments as seg
from .quality_queries import CYCLES, RFM, affinity_category, affinity_sql
from .registry import query

LINES = """
ln AS (SELECT i.*, category, department, private_label, basket_day, customer_id, channel FROM items i JOIN products USING (product_id) JOIN baskets USING (basket_id))"""
SEASON = LINES + """,
sn AS (SELECT category, CAST(month(basket_day) AS INT) AS month, count(*) AS n FROM ln GROUP BY 1, 2),
ss AS (SELECT *, n / sum(n) OVER (PARTITION BY month) AS share FROM sn),
si AS (SELECT category, month, n, round(share / avg(share) OVER (PARTITION BY category) * 10000) / 10000 AS index FROM ss)"""
MONEY = "CAST(sum(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"
TIER = f"""
tiers AS (SELECT tier, count(DISTINCT customer_id) AS n_customers, count(basket_id) AS n_baskets, coalesce({MONEY.format("total_amount")}, 0) AS revenue, round(avg(total_amount) * 100) / 100 AS avg_ticket
  FROM customers LEFT JOIN baskets USING (customer_id) GROUP BY 1)"""
SALES = f"""
sales AS (SELECT category, count(*) AS n_lines, CAST(sum(quantity) AS BIGINT) AS n_units, {MONEY.format("line_amount")} AS revenue FROM items JOIN products USING (product_id) GROUP BY 1)"""


@query("q1_value_by_tier", TIER + " SELECT * FROM tiers")
def q1(t):
    return q.value_by(t, "tier")


@query("q1_basket_by_household", "SELECT household_size, round(count(basket_id) / count(DISTINCT customer_id) * 10000) / 10000 AS baskets_per_customer FROM customers LEFT JOIN baskets USING (customer_id) GROUP BY 1")
def _(t):
    return q.baskets_per_customer(t, "household_size")


@query("q1_share_columns", TIER + """ SELECT *, round(a * 10000) / 10000 AS pct_customers, round(b * 10000) / 10000 AS pct_revenue, round(b / a * 10000) / 10000 AS value_index
FROM (SELECT *, 100 * n_customers / sum(n_customers) OVER () AS a, 100 * revenue / sum(revenue) OVER () AS b FROM tiers)""".replace("SELECT *, round", "SELECT tier, n_customers, n_baskets, revenue, avg_ticket, round"))
def _(t):
    return q.add_shares(q1(t))


@query("q2_sales_by_category", SALES + " SELECT * FROM sales")
def q2(t):
    return q.sales_by(t)


@query("q2_private_label_by_department", f"""SELECT department, {MONEY.format("line_amount")} AS revenue,
round(100 * CAST(sum(CASE WHEN private_label THEN CAST(line_amount AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) / {MONEY.format("line_amount")} * 10000) / 10000 AS pct FROM items JOIN products USING (product_id) GROUP BY 1""")
def _(t):
    return q.conditional_share(t, "department", "private_label")


@query("q2_categories_covering", SALES + """, c AS (SELECT 100 * sum(revenue) OVER (ORDER BY revenue DESC, category ROWS UNBOUNDED PRECEDING) / sum(revenue) OVER () AS share FROM sales)
SELECT CAST(sum(CAST(share < 80 AS INT)) + 1 AS BIGINT) AS n_entries, count(*) AS n_all FROM c""")
def _(t):
    return q.covering(q2(t), "category", 80)


@query("q2_private_label_share", f"""SELECT round(100 * CAST(sum(CASE WHEN private_label THEN CAST(line_amount AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) / {MONEY.format("line_amount")} * 10000) / 10000 AS pct FROM items JOIN products USING (product_id)""")
def _(t):
    return q.conditional_share(t | {"products": t["products"].withColumn("every", F.lit(1))}, "every", "private_label").select("pct")


@query("q3_monthly_sales", f"SELECT strftime(basket_day, '%Y-%m') AS month, count(*) AS n_baskets, {MONEY.format('total_amount')} AS revenue, round(avg(total_amount) * 100) / 100 AS avg_ticket FROM baskets GROUP BY 1")
def _(t):
    return q.monthly_sales(t)


@query("q3_seasonal_index", SEASON + " SELECT * FROM si")
def _(t):
    return q.seasonal_index(t)


@query("q3_seasonal_matrix", SEASON + " SELECT category, " + ", ".join(f"max(CASE WHEN month = {m} THEN index END) AS m{m:02}" for m in range(1, 13)) + " FROM si GROUP BY 1")
def _(t):
    return q.seasonal_matrix(q.seasonal_index(t))


@query("q3_seasonal_peaks", SEASON + " SELECT category, month AS peak_month, index AS peak FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY index DESC, month) AS rk FROM si) WHERE rk = 1")
def _(t):
    return q.seasonal_peaks(q.seasonal_index(t))


@query("q4_basket_by_channel", """z AS (SELECT basket_id, count(*) AS n_lines FROM items GROUP BY 1)
SELECT channel, count(*) AS n_baskets, round(avg(total_amount) * 100) / 100 AS avg_ticket, round(avg(coalesce(n_lines, 0)) * 10000) / 10000 AS avg_lines FROM baskets LEFT JOIN z USING (basket_id) GROUP BY 1""")
def _(t):
    return q.basket_by_channel(t)


@query("q4_hour_profile", "SELECT channel, CAST(hour(basket_ts) AS INT) AS hour, count(*) AS n_baskets FROM baskets GROUP BY 1, 2")
def _(t):
    return q.hour_profile(t)


@query("q4_lines_distribution", "SELECT n_lines, count(*) AS n_baskets FROM (SELECT basket_id, count(*) AS n_lines FROM items GROUP BY 1) WHERE n_lines BETWEEN 1 AND 30 GROUP BY 1")
def _(t):
    return q.lines_distribution(t)


@query("q5_top_affinity_pairs", affinity_sql("category", 50) + " SELECT antecedent, consequent, n_both, lift FROM aff WHERE antecedent < consequent ORDER BY lift DESC, n_both DESC, antecedent, consequent LIMIT 20")
def _(t):
    return q.top_pairs(affinity_category(t))


@query("q5_expected_pairs", affinity_sql("category", 50) + """, declared AS (SELECT 1 AS position, 'Brand#7' AS antecedent, 'Brand#8' AS consequent, CAST(1.3 AS DOUBLE) AS target_lift)
SELECT position, antecedent, consequent, target_lift, lift, n_both, round(lift / target_lift * 10000) / 10000 AS lift_ratio FROM declared LEFT JOIN aff USING (antecedent, consequent)""")
def _(t):
    declared = t["items"].sparkSession.createDataFrame([(1, "Brand#7", "Brand#8", 1.3)], "position int, antecedent string, consequent string, target_lift double")
    return aff.expected_pairs(affinity_category(t), declared)


def cycles(t):
    return seg.repurchase(t["customers"], t["baskets"], t["items"], t["products"])


@query("q6_cycle_by_category", CYCLES + " SELECT category, count(*) AS n_customers, any_value(typical) AS typical, quantile_disc(observed_days, 0.5) AS median_observed FROM cycles WHERE observed_days IS NOT NULL GROUP BY 1 HAVING count(*) >= 5")
def _(t):
    return q.cycle_by_category(cycles(t))


@query("q6_cycle_by_household", CYCLES + " SELECT household_size, count(*) AS n, round(avg(observed_days) * 10000) / 10000 AS avg_observed FROM cycles JOIN customers USING (customer_id) WHERE category IN ('Brand#1', 'Brand#2', 'Brand#3') AND observed_days IS NOT NULL GROUP BY 1")
def _(t):
    return q.cycle_by_household(cycles(t), t["customers"], ["Brand#1", "Brand#2", "Brand#3"])


@query("q6_due_summary", CYCLES + " SELECT count(*) AS n_pairs, count(*) FILTER (due) AS n_due, count(DISTINCT CASE WHEN due THEN customer_id END) AS n_customers_due, count(DISTINCT customer_id) AS n_customers FROM cycles")
def _(t):
    return q.due_summary(cycles(t))


@query("q6_cycle_rank_correlation", CYCLES + """, m AS (SELECT category, any_value(typical) AS typical, quantile_disc(observed_days, 0.5) AS med FROM cycles WHERE observed_days IS NOT NULL GROUP BY 1 HAVING count(*) >= 5),
r AS (SELECT rank() OVER (ORDER BY typical) + (count(*) OVER (PARTITION BY typical) - 1) / 2 AS x, rank() OVER (ORDER BY med) + (count(*) OVER (PARTITION BY med) - 1) / 2 AS y FROM m)
SELECT round(corr(x, y) * 1e6::DOUBLE) / 1e6::DOUBLE AS spearman FROM r""")
def _(t):
    return seg.cycle_rank_correlation(q.cycle_by_category(cycles(t)), "typical", "median_observed")


def rfm(t):
    return seg.rfm(t["customers"], t["baskets"])


@query("q7_churn_profile", RFM + """ SELECT CASE WHEN churn_label THEN 'churned' ELSE 'active' END AS label, count(*) AS n_customers, round(avg(recency_days) * 100) / 100 AS mean_recency,
round(avg(frequency) * 10000) / 10000 AS mean_frequency, round(avg(monetary) * 100) / 100 AS mean_spend FROM rfm GROUP BY 1""")
def _(t):
    return q.churn_profile(rfm(t))


@query("q7_at_risk_share", RFM + """ SELECT round(100 * avg(CAST(segment IN ('At risk', 'Hibernating') AS DOUBLE)) * 10000) / 10000 AS pct_customers,
round(100 * CAST(sum(CASE WHEN segment IN ('At risk', 'Hibernating') THEN CAST(monetary AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) / CAST(sum(CAST(monetary AS DECIMAL(18,2))) AS DOUBLE) * 10000) / 10000 AS pct_spend FROM rfm WHERE has_purchases""")
def _(t):
    return q.at_risk_share(rfm(t))


@query("q8_promo_uplift", """
pd AS (SELECT DISTINCT product_id, CAST(unnest(generate_series(start_date, end_date, INTERVAL 1 DAY)) AS DATE) AS day FROM promotions WHERE end_date >= start_date),
days AS (SELECT DISTINCT basket_day AS day FROM baskets),
grid AS (SELECT product_id, day FROM (SELECT DISTINCT product_id FROM promotions), days),
sold AS (SELECT product_id, basket_day AS day, sum(quantity) AS units FROM items JOIN baskets USING (basket_id) GROUP BY 1, 2),
g AS (SELECT g.*, coalesce(units, 0) AS units, pd.day IS NOT NULL AS on_ FROM grid g LEFT JOIN sold USING (product_id, day) LEFT JOIN pd USING (product_id, day)),
a AS (SELECT CAST(coalesce(sum(units) FILTER (on_), 0) AS BIGINT) AS units_on, count(*) FILTER (on_) AS days_on, CAST(coalesce(sum(units) FILTER (NOT on_), 0) AS BIGINT) AS units_off, count(*) FILTER (NOT on_) AS days_off FROM g)
SELECT state, CAST(n_units AS BIGINT) AS n_units, n_days, round(n_units / n_days * 1e6::DOUBLE) / 1e6::DOUBLE AS units_per_day FROM (SELECT 'on' AS state, units_on AS n_units, days_on AS n_days FROM a UNION ALL SELECT 'off', units_off, days_off FROM a) WHERE n_days > 0""")
def _(t):
    return q.promo_uplift(t)


@query("q8_uplift_ratio", """
pd AS (SELECT DISTINCT product_id, basket_day AS day FROM promotions JOIN (SELECT DISTINCT basket_day FROM baskets) ON basket_day BETWEEN start_date AND end_date),
n AS (SELECT (SELECT count(*) FROM pd) AS days_on, (SELECT count(DISTINCT product_id) FROM promotions) * (SELECT count(DISTINCT basket_day) FROM baskets) AS every),
s AS (SELECT sum(quantity) FILTER (pd.day IS NOT NULL) AS u_on, sum(quantity) FILTER (pd.day IS NULL) AS u_off FROM items i JOIN baskets b ON b.basket_id = i.basket_id LEFT JOIN pd ON pd.product_id = i.product_id AND pd.day = basket_day WHERE i.product_id IN (SELECT product_id FROM promotions))
SELECT round((u_on / days_on) / (u_off / (every - days_on)) * 10000) / 10000 AS uplift FROM s, n""")
def _(t):
    return q.uplift_ratio(q.promo_uplift(t))


@query("q8_promo_share_by_department", f"""SELECT department, {MONEY.format("line_amount")} AS revenue,
round(100 * CAST(sum(CASE WHEN is_promo THEN CAST(line_amount AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) / {MONEY.format("line_amount")} * 10000) / 10000 AS pct FROM items JOIN products USING (product_id) GROUP BY 1""")
def _(t):
    return q.conditional_share(t, "department", "is_promo")


@query("q8_promo_by_type", f"SELECT promo_type, count(DISTINCT promotion_id) AS n_promotions, count(*) AS n_lines, {MONEY.format('line_amount')} AS revenue, round(avg(quantity) * 10000) / 10000 AS units_per_line FROM items JOIN promotions USING (promotion_id) GROUP BY 1")
def _(t):
    return q.promo_by_type(t)


@query("q9_funnel_by_device", """did AS (SELECT session_id, max(CAST(event_type = 'view' AS INT)) AS viewed, max(CAST(event_type = 'add_to_cart' AS INT)) AS added FROM sevents GROUP BY 1)
SELECT device, count(*) AS n_sessions, CAST(sum(coalesce(viewed, 0)) AS BIGINT) AS n_viewed, CAST(sum(coalesce(added, 0)) AS BIGINT) AS n_added, count(basket_id) AS n_bought,
round(100 * avg(CAST(basket_id IS NOT NULL AS INT)) * 10000) / 10000 AS conversion_pct FROM sessions LEFT JOIN did USING (session_id) GROUP BY 1""")
def _(t):
    return q.funnel_by_device(t)


for _kind in ("view", "add_to_cart"):

    @query(f"q9_{_kind}_to_basket_overlap", f"""e AS (SELECT DISTINCT session_id, product_id FROM sevents WHERE event_type = '{_kind}'), h AS (SELECT DISTINCT basket_id, product_id, 1 AS had FROM items)
SELECT count(*) AS n_seen, count(had) AS n_bought, round(100 * count(had) / count(*) * 10000) / 10000 AS pct FROM e JOIN (SELECT session_id, basket_id FROM sessions WHERE basket_id IS NOT NULL) USING (session_id) LEFT JOIN h USING (basket_id, product_id)""")
    def _(t, kind=_kind):
        return q.event_basket_overlap(t, kind)


@query("q9_basket_seen_online", """h AS (SELECT DISTINCT session_id, product_id FROM sessions JOIN items USING (basket_id) WHERE basket_id IS NOT NULL), e AS (SELECT DISTINCT session_id, product_id, 1 AS seen FROM sevents)
SELECT count(*) AS n_bought, count(seen) AS n_seen, round(100 * count(seen) / count(*) * 10000) / 10000 AS pct FROM h LEFT JOIN e USING (session_id, product_id)""")
def _(t):
    return q.basket_seen_online(t)


@query("q10_seasonal_blind_spot", SEASON + """, c AS (SELECT category, coalesce(max(CASE WHEN month = 9 THEN n END), 0) AS n_cutoff FROM sn GROUP BY 1),
p AS (SELECT category, month AS peak_month, n AS n_peak FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, month) AS rk FROM sn) WHERE rk = 1)
SELECT category, peak_month, n_peak, n_cutoff, round(n_peak / nullif(n_cutoff, 0) * 10000) / 10000 AS peak_over_cutoff FROM p JOIN c USING (category)""")
def _(t):
    return q.seasonal_blind_spot(t, 9)


@query("q11_churn_deciles", RFM + """, d AS (SELECT *, CAST(ntile(10) OVER (ORDER BY recency_days, customer_id) AS INT) AS decile FROM rfm WHERE has_purchases)
SELECT decile, count(*) AS n, round(avg(CAST(churn_label AS DOUBLE)) * 1e6::DOUBLE) / 1e6::DOUBLE AS churn_rate, min(recency_days) AS low, max(recency_days) AS high FROM d GROUP BY 1""")
def _(t):
    return q.churn_deciles(rfm(t))


@query("q11_over_representation", SALES + """, p AS (SELECT category, count(*) AS n FROM products GROUP BY 1)
SELECT category, n, round((n / sum(n) OVER ()) / (revenue / sum(revenue) OVER ()) * 10000) / 10000 AS index FROM p JOIN sales USING (category)""")
def _(t):
    return q.over_representation(t["products"].groupBy("category").agg(F.count(F.lit(1)).alias("n")), q2(t), "category")


@query("q11_recency_frequency_correlation", RFM + " SELECT round(corr(recency_days, frequency) * 1e6::DOUBLE) / 1e6::DOUBLE AS r FROM rfm WHERE has_purchases")
def _(t):
    from ..functions.fn import fixed

    return rfm(t).where("has_purchases").agg(fixed(F.corr("recency_days", "frequency"), 6).alias("r"))


@query("q12_numeric_summary", "\nUNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS n, round(avg({c}) * 10000) / 10000 AS mean, round(stddev_pop({c}) * 10000) / 10000 AS deviation, CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high FROM items" for c in ("quantity", "line_amount")))
def _(t):
    return q.numeric_summary(t["items"], ["quantity", "line_amount"])


@query("q12_churn_rate", "SELECT round(avg(CAST(churn_label AS DOUBLE)) * 1e6::DOUBLE) / 1e6::DOUBLE AS churn_rate, count(*) AS n FROM customers")
def _(t):
    from ..functions.fn import fixed

    return t["customers"].agg(fixed(F.avg(F.col("churn_label").cast("double")), 6).alias("churn_rate"), F.count(F.lit(1)).alias("n"))


@query("ext_session_windows", """g AS (SELECT session_id, event_ts, CASE WHEN event_ts - lag(event_ts) OVER (PARTITION BY session_id ORDER BY event_ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM sevents),
w AS (SELECT session_id, sum(s) OVER (PARTITION BY session_id ORDER BY event_ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT session_id, count(*) AS n_events FROM w GROUP BY session_id, k""")
def _(t):
    return q.activity_sessions(t["events"]).select("session_id", "n_events")
