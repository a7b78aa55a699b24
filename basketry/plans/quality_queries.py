"""Queries of cleaning, data trust, segments, cycles and affinity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import affinity as aff
from ..operators import cleaning as cl
from ..operators import segments as seg
from ..operators import trust as tr
from .registry import query

# --- SQL shared by oracles -------------------------------------------------------------

SPELLING = """
spell AS (SELECT norm, category AS canonical FROM (
  SELECT *, row_number() OVER (PARTITION BY norm ORDER BY n DESC, faults, flat, category) AS rk FROM (
    SELECT category, count(*) AS n, lower(trim(regexp_replace(category, '\\s+', ' ', 'g'))) AS norm, length(category) - length(trim(regexp_replace(category, '\\s+', ' ', 'g'))) AS faults,
      CAST(category = upper(category) OR category = lower(category) AS INT) AS flat FROM rproducts GROUP BY category)) WHERE rk = 1)"""
CITEMS = """
citems AS (SELECT *, round(quantity * unit_price_paid * 100) / 100 AS line_amount, promotion_id IS NOT NULL AS is_promo FROM (
  SELECT basket_id, product_id, abs(quantity) AS quantity, unit_price_paid, promotion_id, max(quantity < 0) AS sign_corrected FROM ritems GROUP BY 1, 2, 3, 4, 5) WHERE quantity > 0)"""
CBASKETS = f"""{CITEMS},
isum AS (SELECT basket_id, CAST(sum(CAST(line_amount AS DECIMAL(18,2))) AS DOUBLE) AS recalc, count(*) AS n_lines, CAST(sum(quantity) AS BIGINT) AS n_units FROM citems GROUP BY 1),
cbaskets AS (SELECT b.basket_id, customer_id, channel, basket_day, store_id, coalesce(recalc, 0) AS total_amount, total_amount AS total_raw,
  coalesce(recalc, 0) > 0 AND total_amount > coalesce(recalc, 0) * 1.5 AS is_outlier, coalesce(n_lines, 0) AS n_lines, coalesce(n_units, 0) AS n_units, customer_id IS NULL AS is_anonymous
  FROM rbaskets b LEFT JOIN isum USING (basket_id))"""
CCUSTOMERS = """
seen AS (SELECT customer_id, min(basket_day) AS first_purchase, max(basket_day) AS last_purchase FROM rbaskets WHERE customer_id IS NOT NULL GROUP BY 1),
ccustomers AS (SELECT customer_id, CASE WHEN first_purchase < signup_date THEN first_purchase ELSE signup_date END AS signup_date, signup_date AS signup_raw,
  coalesce(signup_date > first_purchase, false) AS signup_corrected, coalesce(city, 'unknown') AS city, city IS NULL AS city_is_missing, first_purchase, last_purchase
  FROM rcustomers LEFT JOIN seen USING (customer_id))"""


@query("clean_category_spelling", SPELLING + " SELECT norm, canonical FROM spell", "raw")
def _(t):
    return cl.canonical_spelling(t["products"])


@query("clean_products", SPELLING + """
SELECT product_id, coalesce(canonical, category) AS category, category AS category_raw, coalesce(brand, 'no brand') AS brand, brand IS NULL AS brand_is_missing
FROM rproducts LEFT JOIN spell ON norm = lower(trim(regexp_replace(category, '\\s+', ' ', 'g')))""", "raw")
def _(t):
    return cl.clean_products(t["products"]).select("product_id", "category", "category_raw", "brand", "brand_is_missing")


@query("clean_items", CITEMS + " SELECT basket_id, product_id, quantity, unit_price_paid, promotion_id, sign_corrected, line_amount, is_promo FROM citems", "raw")
def _(t):
    return cl.clean_items(t["items"])


@query("clean_items_drop", """SELECT basket_id, product_id, quantity, unit_price_paid, promotion_id, false AS sign_corrected FROM ritems WHERE quantity > 0 GROUP BY ALL""", "raw")
def _(t):
    return cl.clean_items(t["items"], "drop").drop("line_amount", "is_promo")


@query("clean_baskets", CBASKETS + " SELECT * FROM cbaskets", "raw")
def _(t):
    return cl.clean_baskets(t["baskets"], cl.clean_items(t["items"])).drop("basket_ts")


@query("clean_customers", CCUSTOMERS + " SELECT * FROM ccustomers", "raw")
def _(t):
    return cl.clean_customers(t["customers"], t["baskets"]).select(
        "customer_id", "signup_date", "signup_raw", "signup_corrected", "city", "city_is_missing", "first_purchase", "last_purchase"
    )


@query("clean_promotions", "SELECT *, end_date < start_date AS range_invalid, CAST(date_diff('day', start_date, end_date) + 1 AS INT) AS duration_days FROM rpromotions", "raw")
def _(t):
    return cl.clean_promotions(t["promotions"])


@query("clean_sessions", """SELECT session_id, customer_id, device, basket_id, converted AS converted_raw, basket_id IS NOT NULL AS converted, CAST(session_ts AS DATE) AS session_day,
customer_id IS NULL AS is_anonymous FROM rsessions""", "raw")
def _(t):
    return cl.clean_sessions(t["sessions"]).drop("session_ts")


@query("clean_events", "SELECT DISTINCT session_id, product_id, event_type, epoch_us(event_ts) AS us FROM revents", "raw")
def _(t):
    return cl.clean_events(t["events"]).select("session_id", "product_id", "event_type", F.unix_micros(F.col("event_ts").cast("timestamp")).alias("us"))


@query("clean_duplicate_diagnostic", """
SELECT (SELECT count(*) FROM ritems) AS n_lines, (SELECT count(*) FROM (SELECT DISTINCT * FROM ritems)) AS n_distinct_raw,
(SELECT count(*) FROM (SELECT DISTINCT * REPLACE (abs(quantity) AS quantity) FROM ritems)) AS n_distinct_signed,
(SELECT count(*) FROM (SELECT DISTINCT * FROM ritems)) - (SELECT count(*) FROM (SELECT DISTINCT * REPLACE (abs(quantity) AS quantity) FROM ritems)) AS hidden""", "raw")
def _(t):
    return cl.duplicate_diagnostic(t["items"])


@query("clean_dedupe_by_key", "SELECT basket_id, product_id, quantity, line_amount, is_promo, promotion_id FROM (SELECT *, row_number() OVER (PARTITION BY basket_id, product_id ORDER BY quantity NULLS FIRST, line_amount NULLS FIRST, is_promo NULLS FIRST, promotion_id NULLS FIRST) AS rk FROM items) WHERE rk = 1")
def _(t):
    return cl.dedupe_by_key(t["items"], ["basket_id", "product_id"])


@query("clean_report", SPELLING + "," + CBASKETS + "," + CCUSTOMERS + """
SELECT 'products' AS "table", 'category_respelt' AS rule, count(*) FILTER (coalesce(canonical, category) <> category) AS rows_affected, count(*) AS rows_total FROM rproducts LEFT JOIN spell ON norm = lower(trim(regexp_replace(category, '\\s+', ' ', 'g')))
UNION ALL SELECT 'products', 'brand_filled', count(*) FILTER (brand IS NULL), count(*) FROM rproducts
UNION ALL SELECT 'items', 'negative_quantity', count(*) FILTER (quantity < 0), count(*) FROM ritems
UNION ALL SELECT 'items', 'zero_quantity', count(*) FILTER (quantity = 0), count(*) FROM ritems
UNION ALL SELECT 'baskets', 'header_outlier', count(*) FILTER (is_outlier), count(*) FROM cbaskets
UNION ALL SELECT 'baskets', 'without_lines', count(*) FILTER (n_lines = 0), count(*) FROM cbaskets
UNION ALL SELECT 'customers', 'signup_moved', count(*) FILTER (signup_corrected), count(*) FROM ccustomers
UNION ALL SELECT 'customers', 'city_filled', count(*) FILTER (city_is_missing), count(*) FROM ccustomers
UNION ALL SELECT 'promotions', 'range_inverted', count(*) FILTER (end_date < start_date), count(*) FROM rpromotions
UNION ALL SELECT 'sessions', 'conversion_changed', count(*) FILTER (converted <> (basket_id IS NOT NULL)), count(*) FROM rsessions""", "raw")
def _(t):
    return cl.cleaning_report(t, cl.clean_all(t))


# --- data trust ------------------------------------------------------------------------


def _row_sql(table: str, source: str, *checks: tuple[str, str, str]) -> str:
    return "\nUNION ALL ".join(
        f"""SELECT '{table}' AS "table", '{d}' AS dimension, '{n}' AS name, count(*) AS rows_total, count(*) FILTER ({p}) AS rows_failed FROM {source}""" for d, n, p in checks
    )


def _unique_sql(table: str, source: str, keys: str, name: str) -> str:
    return f"SELECT '{table}', 'uniqueness', '{name}', count(*), count(*) - (SELECT count(*) FROM (SELECT DISTINCT {keys} FROM {source})) FROM {source}"


def _fk_sql(table: str, source: str, column: str, other: str, key: str) -> str:
    return f"SELECT '{table}', 'integrity', '{column} known', count({column}), count(*) FILTER ({column} IS NOT NULL AND {column} NOT IN (SELECT {key} FROM {other} WHERE {key} IS NOT NULL)) FROM {source}"


def _present(*columns: str) -> list[tuple[str, str, str]]:
    return [("completeness", f"{c} present", f"{c} IS NULL") for c in columns]


def _ours(table: str, *checks: tuple[str, str, str]) -> str:
    return _row_sql(table, f"r{table}", *_present(*tr.REQUIRED[table]), *checks)


CHECKS = SPELLING + """,
lsum AS (SELECT basket_id, CAST(sum(CAST(quantity * unit_price_paid AS DECIMAL(18,2))) AS DOUBLE) AS lines FROM ritems GROUP BY 1),
headers AS (SELECT b.*, lines FROM rbaskets b LEFT JOIN lsum USING (basket_id)),
firsts AS (SELECT customer_id, min(basket_day) AS first_day FROM rbaskets WHERE customer_id IS NOT NULL GROUP BY 1),
signups AS (SELECT c.*, first_day FROM rcustomers c LEFT JOIN firsts USING (customer_id)),
spelt AS (SELECT category, canonical FROM rproducts LEFT JOIN spell ON norm = lower(trim(regexp_replace(category, '\\s+', ' ', 'g')))),
active AS (SELECT basket_day, start_date, end_date FROM ritems i JOIN rpromotions p ON i.promotion_id = p.promotion_id JOIN rbaskets b ON b.basket_id = i.basket_id),
timed AS (SELECT event_ts, session_ts FROM revents LEFT JOIN rsessions USING (session_id)),
checks AS (""" + "\nUNION ALL ".join([
    _ours("customers", ("validity", "household 1 to 6", "household_size NOT BETWEEN 1 AND 6"), ("validity", "tier known", "tier NOT IN ('bronze', 'silver', 'gold')"), ("validity", "preferred channel known", "preferred_channel NOT IN ('app', 'web', 'store')")),
    _row_sql("customers", "signups", ("consistency", "signup before first purchase", "signup_date > first_day"), ("consistency", "signup within the period", "signup_date > (SELECT max(basket_day) FROM rbaskets)")),
    _ours("products", ("validity", "price positive", "unit_price <= 0"), ("validity", "pack size positive", "pack_size <= 0"), ("validity", "typical days positive", "typical_days <= 0")),
    _row_sql("products", "spelt", ("validity", "category spelt as usual", "category <> canonical")),
    _ours("promotions", ("validity", "type known", "promo_type NOT IN ('2x1', 'discount_pct', 'coupon')"), ("validity", "discount positive", "discount_value <= 0"), ("validity", "range in order", "end_date < start_date")),
    _ours("baskets", ("validity", "channel known", "channel NOT IN ('app', 'web', 'store')"), ("validity", "total positive", "total_amount <= 0"), ("consistency", "store iff channel", "(channel = 'store') <> (store_id IS NOT NULL)")),
    _row_sql("baskets", "headers", ("consistency", "header is sum of lines", "abs(total_amount - coalesce(lines, 0)) > 0.01")),
    _ours("items", ("validity", "quantity positive", "quantity <= 0"), ("validity", "price paid positive", "unit_price_paid <= 0")),
    _row_sql("items", "active", ("consistency", "promotion active on day", "basket_day NOT BETWEEN start_date AND end_date")),
    _ours("sessions", ("validity", "device known", "device NOT IN ('mobile', 'desktop', 'tablet')"), ("consistency", "converted iff basket", "converted <> (basket_id IS NOT NULL)")),
    _ours("events", ("validity", "type known", "event_type NOT IN ('view', 'add_to_cart')")),
    _row_sql("events", "timed", ("consistency", "event after session start", "event_ts < session_ts")),
    *[_unique_sql(n, f"r{n}", k, f"{k} unique") for n, k in (("customers", "customer_id"), ("products", "product_id"), ("promotions", "promotion_id"), ("baskets", "basket_id"), ("sessions", "session_id"))],
    _unique_sql("items", "ritems", "basket_id, product_id", "basket_id + product_id unique"), _unique_sql("items", "ritems", "*", "no repeated rows"), _unique_sql("events", "revents", "*", "no repeated rows"),
    *[_fk_sql(n, f"r{n}", k, f"r{o}", k) for n, k, o in (("promotions", "product_id", "products"), ("baskets", "customer_id", "customers"), ("items", "basket_id", "baskets"), ("items", "product_id", "products"), ("items", "promotion_id", "promotions"),
      ("sessions", "customer_id", "customers"), ("sessions", "basket_id", "baskets"), ("events", "session_id", "sessions"), ("events", "product_id", "products"))],
]) + ")"
DETAIL = CHECKS + """,
detail AS (SELECT dimension, count(*) AS n_checks, count(*) FILTER (rows_failed > 0) AS n_failing, avg(CASE WHEN rows_total > 0 THEN 1 - rows_failed / rows_total ELSE 1 END) * 100 AS rs,
  avg(CAST(rows_failed = 0 AS DOUBLE)) * 100 AS cs FROM checks GROUP BY 1),
scored AS (SELECT dimension, n_checks, n_failing, round(rs * 10000) / 10000 AS row_score, round(cs * 10000) / 10000 AS check_score, round((rs * 0.5 + cs * 0.5) * 100) / 100 AS score FROM detail)"""


@query("trust_checks", CHECKS + " SELECT * FROM checks", "raw")
def _(t):
    return tr.retail_checks(t)


@query("trust_dimensions", DETAIL + " SELECT * FROM scored", "raw")
def _(t):
    return tr.dimension_detail(tr.retail_checks(t))


@query("trust_score", DETAIL + """, s AS (SELECT round(sum(score * 0.2) * 100) / 100 AS score FROM scored)
SELECT score, CASE WHEN score >= 97 THEN 'A' WHEN score >= 93 THEN 'B' WHEN score >= 85 THEN 'C' WHEN score >= 75 THEN 'D' ELSE 'E' END AS grade FROM s""", "raw")
def _(t):
    return tr.trust_score(tr.retail_checks(t))


@query("trust_failing_checks", CHECKS + " SELECT * FROM checks WHERE rows_failed > 0", "raw")
def _(t):
    return tr.retail_checks(t).where("rows_failed > 0")


def _rel_sql(name: str, child: str, column: str, parent: str, key: str) -> str:
    orphan = f"{column} IS NOT NULL AND {column} NOT IN (SELECT {key} FROM {parent} WHERE {key} IS NOT NULL)"
    return f"""SELECT '{name}' AS relation, count(*) AS n_rows, count(*) FILTER ({column} IS NULL) AS n_null, count(DISTINCT {column}) AS n_keys, count(*) FILTER ({orphan}) AS n_orphans,
round(100 * (count({column}) - count(*) FILTER ({orphan})) / nullif(count({column}), 0) * 10000) / 10000 AS match_pct FROM {child}"""


RELATIONS = [
    ("items-baskets", "items", "basket_id", "baskets", "basket_id"), ("items-products", "items", "product_id", "products", "product_id"), ("items-promotions", "items", "promotion_id", "promotions", "promotion_id"),
    ("baskets-customers", "baskets", "customer_id", "customers", "customer_id"), ("baskets-items", "baskets", "basket_id", "items", "basket_id"), ("products-items", "products", "product_id", "items", "product_id"),
    ("customers-baskets", "customers", "customer_id", "baskets", "customer_id"), ("promotions-products", "promotions", "product_id", "products", "product_id"), ("promotions-items", "promotions", "promotion_id", "items", "promotion_id"),
    ("sessions-customers", "sessions", "customer_id", "customers", "customer_id"), ("sessions-baskets", "sessions", "basket_id", "baskets", "basket_id"), ("sessions-events", "sessions", "session_id", "events", "session_id"),
    ("events-sessions", "events", "session_id", "sessions", "session_id"), ("events-products", "events", "product_id", "products", "product_id"),
]


@query("trust_referential_integrity", "\nUNION ALL ".join(_rel_sql(n, f"r{a}", b, f"r{c}", d) for n, a, b, c, d in RELATIONS), "raw")
def _(t):
    return tr.referential_integrity([(n, t[a], b, t[c], d) for n, a, b, c, d in RELATIONS])


# --- segments and cycles ---------------------------------------------------------------

RFM = """
ref AS (SELECT max(basket_day) AS day FROM baskets),
one AS (SELECT customer_id, max(basket_day) AS last_day, min(basket_day) AS first_day, count(DISTINCT basket_id) AS frequency, CAST(sum(CAST(total_amount AS DECIMAL(18,2))) AS DOUBLE) AS monetary
  FROM baskets WHERE customer_id IS NOT NULL GROUP BY 1),
measured AS (SELECT c.customer_id, tier, churn_label, coalesce(frequency, 0) AS frequency, coalesce(monetary, 0) AS monetary, monetary / frequency AS avg_ticket,
  CAST(date_diff('day', last_day, day) AS INT) AS recency_days, CAST(date_diff('day', signup_date, day) AS INT) AS tenure_days,
  round(CASE WHEN frequency > 1 THEN date_diff('day', first_day, last_day) / (frequency - 1) END * 10) / 10 AS cadence_days, frequency IS NOT NULL AS has_purchases
  FROM customers c LEFT JOIN one USING (customer_id), ref),
scored AS (SELECT *, CAST(ntile(5) OVER (ORDER BY recency_days DESC, customer_id) AS INT) AS r_score, CAST(ntile(5) OVER (ORDER BY frequency, customer_id) AS INT) AS f_score,
  CAST(ntile(5) OVER (ORDER BY monetary, customer_id) AS INT) AS m_score FROM measured WHERE has_purchases
  UNION ALL SELECT *, 1, 1, 1 FROM measured WHERE NOT has_purchases),
rfm AS (SELECT *, concat(r_score, f_score, m_score) AS rfm_score, CASE WHEN NOT has_purchases THEN 'No purchases' WHEN r_score >= 4 AND fm >= 4 THEN 'Champions' WHEN r_score >= 3 AND fm >= 3 THEN 'Loyal'
  WHEN r_score >= 4 AND fm < 3 THEN 'Promising' WHEN r_score = 3 AND fm < 3 THEN 'Needs attention' WHEN fm >= 3 THEN 'At risk' ELSE 'Hibernating' END AS segment
  FROM (SELECT *, round((f_score + m_score) / 2) AS fm FROM scored))"""
CYCLES = """
typical AS (SELECT category, CAST(round(avg(typical_days)) AS INT) AS typical FROM products GROUP BY 1),
pdays AS (SELECT DISTINCT customer_id, category, basket_day AS day FROM items JOIN products USING (product_id) JOIN baskets USING (basket_id) WHERE customer_id IS NOT NULL),
gaps AS (SELECT *, date_diff('day', lag(day) OVER (PARTITION BY customer_id, category ORDER BY day), day) AS gap FROM pdays),
seenc AS (SELECT customer_id, category, max(day) AS last_day, count(*) AS n_days, avg(gap) AS observed, stddev_samp(gap) AS gap_std FROM gaps GROUP BY 1, 2),
cyc AS (SELECT s.customer_id, s.category, n_days, observed, gap_std, typical, coalesce(1.45::DOUBLE - 0.125::DOUBLE * household_size, 1.0) AS hf,
  date_diff('day', last_day, (SELECT max(basket_day) FROM baskets)) AS days_since FROM seenc s LEFT JOIN customers USING (customer_id) JOIN typical USING (category)),
cycles AS (SELECT customer_id, category, n_days, round(observed * 100) / 100 AS observed_days, round(gap_std * 100) / 100 AS gap_std, typical, hf AS household_factor,
  round(e * 10000) / 10000 AS expected_days, CAST(days_since AS INT) AS days_since, round(days_since / e * 1000) / 1000 AS overdue_ratio, days_since >= e AS due
  FROM (SELECT *, greatest(CASE WHEN n_days >= 2 AND observed IS NOT NULL THEN observed ELSE typical * hf END, 2.0) AS e FROM cyc))"""


@query("rfm", RFM + """ SELECT customer_id, tier, churn_label, frequency, monetary, round(avg_ticket * 10000) / 10000 AS avg_ticket, recency_days, tenure_days, cadence_days, has_purchases,
r_score, f_score, m_score, rfm_score, segment FROM rfm""")
def _(t):
    from ..functions.fn import fixed

    return seg.rfm(t["customers"], t["baskets"]).withColumn("avg_ticket", fixed("avg_ticket", 4))


@query("rfm_segments", RFM + """ SELECT segment, count(*) AS n_customers, round(avg(monetary) * 100) / 100 AS mean_spend, round(avg(recency_days) * 100) / 100 AS mean_recency FROM rfm GROUP BY 1""")
def _(t):
    from ..functions.fn import fixed

    return seg.rfm(t["customers"], t["baskets"]).groupBy("segment").agg(
        F.count(F.lit(1)).alias("n_customers"), fixed(F.avg("monetary"), 2).alias("mean_spend"), fixed(F.avg("recency_days"), 2).alias("mean_recency")
    )


@query("repurchase_typical_days", "SELECT category, CAST(round(avg(typical_days)) AS INT) AS typical FROM products GROUP BY 1")
def _(t):
    return seg.typical_days(t["products"])


@query("repurchase_purchase_days", "SELECT DISTINCT customer_id, category, basket_day AS day FROM items JOIN products USING (product_id) JOIN baskets USING (basket_id) WHERE customer_id IS NOT NULL")
def _(t):
    return seg.purchase_days(t["baskets"], t["items"], t["products"])


@query("repurchase_cycles", CYCLES + " SELECT * FROM cycles")
def _(t):
    return seg.repurchase(t["customers"], t["baskets"], t["items"], t["products"])


# --- affinity --------------------------------------------------------------------------


def affinity_sql(item: str, least: int, prefix: str = "") -> str:
    source = "items JOIN products USING (product_id)" if item == "category" else "items"
    return f"""
{prefix}sets AS (SELECT DISTINCT basket_id, {item} AS item FROM {source}),
{prefix}n AS (SELECT item, count(*) AS n FROM {prefix}sets GROUP BY 1),
{prefix}half AS (SELECT l.item AS a, r.item AS b, count(*) AS n_both FROM {prefix}sets l JOIN {prefix}sets r ON l.basket_id = r.basket_id AND l.item < r.item GROUP BY 1, 2 HAVING count(*) >= {least}),
{prefix}aff AS (SELECT p.a AS antecedent, p.b AS consequent, t.total_baskets, x.n AS n_antecedent, y.n AS n_consequent, n_both, round(n_both / t.total_baskets * 1e6::DOUBLE) / 1e6::DOUBLE AS support,
  round(n_both / x.n * 1e6::DOUBLE) / 1e6::DOUBLE AS confidence, round((n_both / x.n) / (y.n / t.total_baskets) * 1e4::DOUBLE) / 1e4::DOUBLE AS lift,
  round(n_both / (x.n + y.n - n_both) * 1e6::DOUBLE) / 1e6::DOUBLE AS jaccard
  FROM (SELECT a, b, n_both FROM {prefix}half UNION ALL SELECT b, a, n_both FROM {prefix}half) p JOIN {prefix}n x ON x.item = p.a JOIN {prefix}n y ON y.item = p.b,
  (SELECT count(DISTINCT basket_id) AS total_baskets FROM {prefix}sets) t)"""


@query("affinity_category", affinity_sql("category", 50) + " SELECT * FROM aff")
def affinity_category(t):
    return aff.cooccurrence(aff.basket_items(t["items"], t["products"]), 50)


@query("affinity_product_top", affinity_sql("product_id", 2) + """
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY antecedent ORDER BY lift DESC, n_both DESC, consequent) AS INT) AS rank FROM aff) WHERE rank <= 20""")
def _(t):
    return aff.cooccurrence(aff.basket_items(t["items"], t["products"], "product"), 2, top=20)


@query("affinity_basket_items", "SELECT DISTINCT basket_id, category AS item FROM items JOIN products USING (product_id)")
def _(t):
    return aff.basket_items(t["items"], t["products"])


@query("affinity_structure", affinity_sql("category", 50) + """ SELECT count(*) AS n_pairs, CAST(sum(CAST(lift >= 1.2 AS INT)) AS BIGINT) AS lift_12, CAST(sum(CAST(lift >= 1.5 AS INT)) AS BIGINT) AS lift_15,
CAST(sum(CAST(lift >= 3 AS INT)) AS BIGINT) AS lift_30, CAST(sum(CAST(lift < 0.8 AS INT)) AS BIGINT) AS lift_below_08, round(median(lift) * 10000) / 10000 AS median_lift FROM aff WHERE antecedent < consequent""")
def _(t):
    return aff.structure(affinity_category(t))


DECLARED = [(1, "Brand#1", "Brand#2", 1.5), (2, "Brand#3", "Brand#4", 1.2), (3, "Brand#5", "nothing", 2.0)]


@query("affinity_expected_pairs", affinity_sql("category", 50) + f""",
declared AS (SELECT * FROM (VALUES {", ".join(f"({a}, '{b}', '{c}', {d}::DOUBLE)" for a, b, c, d in DECLARED)}) AS v(position, antecedent, consequent, target_lift))
SELECT position, antecedent, consequent, target_lift, lift, n_both, round(lift / target_lift * 10000) / 10000 AS lift_ratio FROM declared LEFT JOIN aff USING (antecedent, consequent)""")
def _(t):
    spark = t["items"].sparkSession
    return aff.expected_pairs(affinity_category(t), spark.createDataFrame(DECLARED, "position int, antecedent string, consequent string, target_lift double"))


#: At this support itemsets have two categories at most, so that rules are pairs.
@query("affinity_fpgrowth", """s AS (SELECT DISTINCT basket_id, category AS i FROM items JOIN products USING (product_id)), t AS (SELECT count(DISTINCT basket_id) AS t FROM s), n AS (SELECT i, count(*) AS n FROM s GROUP BY 1),
b AS (SELECT x.i AS a, y.i AS c, count(*) AS nb FROM s x JOIN s y ON x.basket_id = y.basket_id AND x.i <> y.i GROUP BY 1, 2)
SELECT a AS antecedent, c AS consequent, round(nb / x.n * 1e6::DOUBLE) / 1e6::DOUBLE AS confidence, round((nb / x.n) / (y.n / t) * 1e6::DOUBLE) / 1e6::DOUBLE AS lift, round(nb / t * 1e6::DOUBLE) / 1e6::DOUBLE AS support
FROM b JOIN n x ON x.i = a JOIN n y ON y.i = c, t WHERE nb >= ceil(0.01::DOUBLE * t) AND nb / x.n >= 0.1::DOUBLE""")
def _(t):
    return aff.fpgrowth_rules(aff.basket_items(t["items"], t["products"]))
