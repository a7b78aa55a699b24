"""Queries of splits, candidate sources, history, features and ranking."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from ..functions.fn import fixed
from ..operators import affinity as aff
from ..operators import candidates as ca
from ..operators import features as fe
from ..operators import ranking as rk
from ..operators import splits as sp
from ..shared import forget, saved
from .quality_queries import affinity_sql
from .registry import query

FIT_END, TEST_START, TEST_END = "1999-06-01", "2000-06-01", "2000-07-01"
PLAN = sp.CutPlan("empty_and_half")
#: Rounds at most, depth of trees (64 leaves; the reference's 63 grow leaf by leaf), rate, and rounds without gain on validation queries that end learning.
REFERENCE = (800, 6, 0.05, 50)


def u(key: str, salt: str) -> str:
    return f"(CAST(concat('0x', substr(md5(concat({key}, '|{salt}')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


HB = f"""
hb AS (SELECT * FROM baskets WHERE basket_day < DATE '{TEST_START}'),
hi AS (SELECT i.* FROM items i SEMI JOIN hb USING (basket_id)),
tb AS (SELECT * FROM baskets WHERE basket_day >= DATE '{TEST_START}' AND basket_day < DATE '{TEST_END}')"""
ADDS = """
adds AS (SELECT basket_id, product_id, min(event_ts) AS added_ts FROM sevents JOIN (SELECT session_id, basket_id FROM sessions WHERE basket_id IS NOT NULL) USING (session_id) WHERE event_type = 'add_to_cart' GROUP BY 1, 2)"""
PARTS = f"""{HB},{ADDS},
placed AS (SELECT basket_id, product_id, CAST(row_number() OVER (PARTITION BY basket_id ORDER BY added_ts ASC NULLS LAST, {u("concat_ws('-', basket_id, product_id)", "order")}, product_id) AS INT) AS position,
  CAST(count(*) OVER (PARTITION BY basket_id) AS INT) AS n_items FROM (SELECT DISTINCT basket_id, product_id FROM items SEMI JOIN tb USING (basket_id)) LEFT JOIN adds USING (basket_id, product_id)),
parts AS (SELECT basket_id || '#k' || k AS query_id, basket_id, product_id, position, n_items, CAST(k AS INT) AS prefix_size
  FROM (SELECT *, unnest(CASE WHEN n_items <= 1 THEN [0] ELSE list_sort(list_distinct([0, n_items // 2])) END) AS k FROM placed)),
prefix AS (SELECT query_id, product_id FROM parts WHERE position <= prefix_size),
target AS (SELECT query_id, product_id FROM parts WHERE position > prefix_size)"""
QS = f"""{PARTS},
began AS (SELECT basket_id, min(session_ts) AS session_ts FROM sessions WHERE basket_id IS NOT NULL GROUP BY 1),
heads AS (SELECT query_id, basket_id, any_value(n_items) AS n_items, any_value(prefix_size) AS prefix_size, max(CASE WHEN position <= prefix_size THEN added_ts END) AS last_add FROM parts LEFT JOIN adds USING (basket_id, product_id) GROUP BY 1, 2),
qs AS (SELECT query_id, h.basket_id, b.customer_id, basket_day, channel, n_items, prefix_size, k.customer_id IS NOT NULL AS is_known,
  CAST(CASE WHEN k.customer_id IS NOT NULL THEN 3 ELSE 1 END + CASE WHEN prefix_size > 0 THEN 1 ELSE 0 END AS INT) AS profile, coalesce(last_add, session_ts) AS cut_ts, n_items - prefix_size AS n_target
  FROM heads h JOIN baskets b ON b.basket_id = h.basket_id LEFT JOIN (SELECT DISTINCT customer_id FROM hb WHERE customer_id IS NOT NULL) k ON k.customer_id = b.customer_id LEFT JOIN began g ON g.basket_id = h.basket_id)"""
POP = """
hl AS (SELECT DISTINCT basket_id, product_id, basket_day FROM hi JOIN hb USING (basket_id)),
hlast AS (SELECT max(basket_day) AS last FROM hb),
pm AS (SELECT product_id, CAST(month(basket_day) AS INT) AS month, count(*) AS n_pm FROM hl GROUP BY 1, 2),
pp AS (SELECT product_id, count(*) AS n_p, count(*) FILTER (basket_day > last - 90) AS recent FROM hl, hlast GROUP BY 1),
mm AS (SELECT CAST(month(basket_day) AS INT) AS month, count(*) AS n_m, sum(count(*)) OVER () AS n_all FROM hb GROUP BY 1),
pop0 AS (SELECT month, product_id, n_p AS pop_all, recent, round((n_pm / n_p) / (n_m / n_all) * 10000) / 10000 AS index FROM pm JOIN pp USING (product_id) JOIN mm USING (month)),
pop AS (SELECT *, recent * index AS score, row_number() OVER (PARTITION BY month ORDER BY recent * index DESC, product_id) AS rank FROM pop0)"""
CATPOP = POP + """,
cw AS (SELECT month, category, round(sum(score) * 10000) / 10000 AS weight FROM pop JOIN products USING (product_id) GROUP BY 1, 2),
cwr AS (SELECT *, CAST(row_number() OVER (PARTITION BY month ORDER BY weight DESC, category) AS INT) AS category_rank FROM cw),
catpop AS (SELECT p.month, p.category, product_id, score, rank, weight, category_rank, rank_in_category FROM
  (SELECT month, category, product_id, score, rank, CAST(row_number() OVER (PARTITION BY month, category ORDER BY score DESC, product_id) AS INT) AS rank_in_category FROM pop JOIN products USING (product_id)) p JOIN cwr USING (month, category))"""
CANDPOP = """
candpop AS (SELECT query_id, product_id, score AS pop_score, rank AS pop_rank FROM qs JOIN (SELECT * FROM catpop WHERE rank <= 150 OR category_rank <= 62 AND rank_in_category <= 1) c ON c.month = month(basket_day))"""
HAFF = affinity_sql("product_id", 2, "p").replace("FROM items)", "FROM hi)").replace("FROM items\n", "FROM hi\n")
HCAFF = affinity_sql("category", 50, "c").replace("items JOIN products", "hi JOIN products")
CANDAFF = """
candaff AS (SELECT query_id, product_id, aff_lift, aff_confidence, aff_support FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY aff_lift DESC, aff_confidence DESC, product_id) AS r FROM (
  SELECT query_id, consequent AS product_id, max(lift) AS aff_lift, round(sum(confidence) * 1e6::DOUBLE) / 1e6::DOUBLE AS aff_confidence, count(*) AS aff_support FROM prefix p JOIN paff a ON a.antecedent = p.product_id GROUP BY 1, 2)) WHERE r <= 50)"""
LEADERS = """
leaders AS (SELECT category, product_id, CAST(r AS INT) AS leader_rank FROM (SELECT category, product_id, row_number() OVER (PARTITION BY category ORDER BY n DESC, product_id) AS r FROM
  (SELECT product_id, count(*) AS n FROM (SELECT DISTINCT basket_id, product_id FROM hi) JOIN (SELECT basket_id FROM hb WHERE basket_day > (SELECT max(basket_day) FROM hb) - 90) USING (basket_id) GROUP BY 1) JOIN products USING (product_id)) WHERE r <= 4)"""
CANDCAT = """
candcat AS (SELECT query_id, product_id, cataff_lift, cataff_confidence FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cataff_lift DESC, consequent) AS r FROM (
  SELECT query_id, consequent, max(lift) AS cataff_lift, max(confidence) AS cataff_confidence FROM (SELECT DISTINCT query_id, category FROM prefix JOIN products USING (product_id)) c JOIN caff a ON a.antecedent = c.category GROUP BY 1, 2)) b
  JOIN leaders l ON l.category = b.consequent WHERE r <= 15)"""
ASOF = """
own AS (SELECT query_id, customer_id, basket_day AS query_day FROM qs WHERE customer_id IS NOT NULL),
seenb AS (SELECT o.*, b.basket_id, b.basket_day AS day, total_amount FROM own o JOIN baskets b ON b.customer_id = o.customer_id AND b.basket_day < o.query_day),
hlines AS (SELECT s.query_id, s.query_day, s.basket_id, s.day, s.customer_id, i.product_id, units FROM seenb s JOIN (SELECT basket_id, product_id, sum(quantity) AS units FROM items GROUP BY 1, 2) i USING (basket_id)),
hvar AS (SELECT query_id, count(DISTINCT product_id) AS n_products, count(DISTINCT day) AS n_days FROM hlines GROUP BY 1),
hvis AS (SELECT query_id, count(*) AS n_baskets, CAST(sum(CAST(total_amount AS DECIMAL(18,2))) AS DOUBLE) AS spend, CAST(date_diff('day', max(day), query_day) AS INT) AS recency,
  round(CASE WHEN count(*) >= 2 THEN date_diff('day', min(day), max(day)) / (count(*) - 1) END * 10000) / 10000 AS cadence FROM seenb GROUP BY query_id, query_day),
hcust AS (SELECT query_id, n_baskets, spend, round(spend / n_baskets * 10000) / 10000 AS avg_ticket, recency, cadence, coalesce(n_products, 0) AS n_products, coalesce(n_days, 0) AS n_days FROM hvis LEFT JOIN hvar USING (query_id)),
hprod AS (SELECT query_id, product_id, count(*) AS n_times, CAST(sum(units) AS BIGINT) AS n_units, CAST(date_diff('day', max(day), query_day) AS INT) AS days_since FROM hlines GROUP BY query_id, product_id, query_day),
hdays AS (SELECT DISTINCT query_id, query_day, customer_id, category, day FROM hlines JOIN products USING (product_id)),
htyp AS (SELECT category, CAST(round(avg(typical_days)) AS INT) AS typical FROM products GROUP BY 1),
hcat0 AS (SELECT query_id, category, count(*) AS n_days, date_diff('day', max(day), query_day) AS since, CASE WHEN count(*) >= 2 THEN date_diff('day', min(day), max(day)) / (count(*) - 1) END AS gap, customer_id FROM hdays GROUP BY query_id, category, query_day, customer_id),
hcat AS (SELECT query_id, category, n_days, CAST(since AS INT) AS days_since, round(e * 10000) / 10000 AS expected_days, round(since / e * 10000) / 10000 AS overdue_ratio, CAST(since >= e AS INT) AS due FROM (
  SELECT h.*, greatest(coalesce(gap, typical * coalesce(1.45::DOUBLE - 0.125::DOUBLE * household_size, 1.0)), 2.0) AS e FROM hcat0 h LEFT JOIN customers USING (customer_id) JOIN htyp USING (category)))"""
CANDHIST = """
candhist AS (SELECT query_id, product_id, personal_score, CAST(r AS INT) AS hist_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY personal_score DESC, days_since, product_id) AS r FROM (
  SELECT h.query_id, h.product_id, h.days_since, round((n_times * (1 + CASE WHEN coalesce(overdue_ratio, 0) >= 1 THEN 1 ELSE 0 END) + coalesce(overdue_ratio, 0)) * 1e6::DOUBLE) / 1e6::DOUBLE AS personal_score
  FROM hprod h JOIN products p ON p.product_id = h.product_id LEFT JOIN hcat c ON c.query_id = h.query_id AND c.category = p.category)) WHERE r <= 120)"""
ALLC = ",".join([QS, CATPOP, CANDPOP, HAFF, CANDAFF, HCAFF, LEADERS, CANDCAT, ASOF, CANDHIST])
#: The columns of each source in the pool.
_SOURCES = {"candpop": ("pop_score", "pop_rank"), "candaff": ("aff_lift", "aff_confidence", "aff_support"), "candcat": ("cataff_lift", "cataff_confidence"), "candhist": ("personal_score", "hist_rank")}
_VALUES = [c for cols in _SOURCES.values() for c in cols]
_FLAGS = ["src_pop", "src_aff", "src_cataff", "src_hist"]
POOL = ALLC + ", srcs AS (" + " UNION ALL ".join(
    f"SELECT query_id, product_id, {', '.join(c if c in cols else f'NULL AS {c}' for c in _VALUES)}, {', '.join(f'{int(i == j)} AS {f}' for j, f in enumerate(_FLAGS))} FROM {name}" for i, (name, cols) in enumerate(_SOURCES.items())
) + f"), pool AS (SELECT query_id, product_id, {', '.join(f'max({c}) AS {c}' for c in _VALUES + _FLAGS)}, {' + '.join(f'max({f})' for f in _FLAGS)} AS n_sources FROM srcs ANTI JOIN prefix USING (query_id, product_id) GROUP BY 1, 2)"
#: A fixed score, so that ordering and metrics can be checked without a model.
SCORED = POOL + """,
incart AS (SELECT DISTINCT query_id, category, 1 AS x FROM prefix JOIN products USING (product_id)),
samecat AS (SELECT DISTINCT query_id, category, 1 AS y FROM target JOIN products USING (product_id)),
scored AS (SELECT query_id, product_id, category, round((coalesce(pop_score, 0) + coalesce(aff_lift, 0) + coalesce(cataff_lift, 0) + 5 * coalesce(personal_score, 0)) * 10000) / 10000 AS score, coalesce(x, 0) AS cat_in_cart,
  CASE WHEN t.product_id IS NOT NULL THEN 2 WHEN y = 1 THEN 1 ELSE 0 END AS relevance, CAST(t.product_id IS NOT NULL AS INT) AS label
  FROM pool JOIN products USING (product_id) LEFT JOIN incart USING (query_id, category) LEFT JOIN (SELECT DISTINCT query_id, product_id FROM target) t USING (query_id, product_id) LEFT JOIN samecat USING (query_id, category)),
ordered AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY demoted, score DESC, product_id) AS INT) AS rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id, category ORDER BY score DESC, product_id) > 1 OR cat_in_cart > 0 AS INT) AS demoted FROM scored)),
top5 AS (SELECT * FROM ordered WHERE rank <= 5)"""
_IDEAL = "list_sum(list_transform(range(1, least({n}, {k}) + 1), lambda i: 1 / log2(i + 1)))"
METRICS = SCORED + f""",
hitq AS (SELECT query_id, sum(CASE WHEN label = 1 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, sum(label) AS hits FROM top5 GROUP BY 1),
pq AS (SELECT query_id, round(coalesce(coalesce(dcg, 0) / CASE WHEN n_target > 0 THEN {_IDEAL.format(n="n_target", k=5)} END, 0) * 1e6::DOUBLE) / 1e6::DOUBLE AS ndcg,
  round(coalesce(coalesce(hits, 0) / nullif(n_target, 0), 0) * 1e6::DOUBLE) / 1e6::DOUBLE AS recall, round(coalesce(hits, 0) / 5 * 1e6::DOUBLE) / 1e6::DOUBLE AS precision,
  round(2 * coalesce(hits, 0) / (n_target + 5) * 1e6::DOUBLE) / 1e6::DOUBLE AS f1, CAST(coalesce(hits, 0) > 0 AS INT) AS hit FROM qs LEFT JOIN hitq USING (query_id))"""


class Window:
    """The steps of one test window, each once: what several steps start from is written."""

    def __init__(self, t):
        self.t = t
        self.history = sp.before(t["baskets"], TEST_START)
        self.history_items = sp.restrict(t["items"], self.history)
        self.test = sp.between(t["baskets"], TEST_START, TEST_END)
        self.adds = sp.first_adds(t["sessions"], t["events"])
        self.lazy_parts = sp.query_items(sp.restrict(t["items"], self.test), self.adds, PLAN)

    @cached_property
    def parts(self):
        return saved(self.lazy_parts)

    @cached_property
    def q(self):
        return saved(sp.queries(self.parts, self.t["baskets"], self.history, self.adds, self.t["sessions"]))

    @property
    def prefix(self):
        return sp.prefix_and_target(self.parts)[0]

    @property
    def target(self):
        return sp.prefix_and_target(self.parts)[1]

    def popularity(self):
        return ca.popularity(self.history, self.history_items)

    @cached_property
    def popular(self):
        return saved(self.popularity())

    def category_popularity(self):
        return ca.category_popularity(self.popular, self.t["products"])

    def affinity(self, level):
        return aff.cooccurrence(aff.basket_items(self.history_items, self.t["products"], level), 2 if level == "product" else 50)

    def asof(self):
        return ca.asof_history(self.q, self.t["baskets"], self.t["items"], self.t["products"], self.t["customers"], saved)

    @cached_property
    def past(self):
        return {name: saved(table) for name, table in self.asof().items()}

    def source(self, name):
        t = self.t
        if name == "pop":
            return ca.from_popularity(self.q, self.category_popularity())
        if name == "aff":
            return ca.from_product_affinity(self.prefix, self.affinity("product"))
        if name == "cataff":
            return ca.from_category_affinity(self.prefix, t["products"], self.affinity("category"), ca.category_leaders(self.history, self.history_items, t["products"]))
        if name == "hist":
            return ca.from_history(self.past["product"], self.past["category"], t["products"])
        return ca.from_latent(self.q, ca.fit_latent(ca.customer_products(self.history, self.history_items)))

    def sources(self, *more):
        """All sources for ``union_sources``; what is popular as rows of its month. Each is written, as one plan of them all takes the driver's memory."""
        return {"pop": saved(ca.offered(self.category_popularity())), **{n: saved(self.source(n)) for n in ("aff", "cataff", "hist", *more)}}

    def pool(self, *more):
        return ca.union_sources(self.q, ca.in_cart(self.prefix), **self.sources(*more))

    def matrix(self, *more, target=None):
        """The feature matrix; with ``target`` its relevance and label too, and whether its query is one of the last days'."""
        t = self.t
        seen = fe.events_before_cut(self.q, t["sessions"], t["events"])
        head = fe.query_head(self.q, self.prefix, self.past, t["products"], t["customers"], seen, target)
        if target is not None:
            head = head.join(sp.validation_tail(self.q).select("query_id", "is_validation"), "query_id")
        head = saved(head)
        about = fe.product_details(self.q, self.popular, t["products"], t["promotions"])
        return fe.matrix_from(self.sources(*more), ca.in_cart(self.prefix), head, about)

    def scored_parts(self):
        """The pool with a fixed score of all sources, relevance, and what it is made of."""
        z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
        pairs = self.pool().join(self.t["products"].select("product_id", "category"), "product_id")
        labelled = fe.with_relevance(pairs, self.target, self.t["products"])
        cart = fe.cart_features(self.prefix, self.t["products"])[0]
        score = fixed(z("pop_score") + z("aff_lift") + z("cataff_lift") + 5 * z("personal_score"), 4)
        return labelled.join(cart, ["query_id", "category"], "left").select("query_id", "product_id", "category", score.alias("score"), F.coalesce("cat_in_cart", F.lit(0)).alias("cat_in_cart"), "relevance", "label", "pop_score")

    def scored(self):
        return self.scored_parts().drop("pop_score")

    def top(self):
        return rk.top_k(self.scored(), 5)

    def metrics(self):
        return rk.per_query_metrics(self.top(), self.q)


@query("split_before", f"SELECT basket_id, basket_day FROM baskets WHERE basket_day < DATE '{FIT_END}'")
def _(t):
    return sp.before(t["baskets"], FIT_END).select("basket_id", "basket_day")


@query("split_between", f"SELECT basket_id, basket_day FROM baskets WHERE basket_day >= DATE '{FIT_END}' AND basket_day < DATE '{TEST_START}'")
def _(t):
    return sp.between(t["baskets"], FIT_END, TEST_START).select("basket_id", "basket_day")


@query("split_restrict_items", HB + " SELECT * FROM hi")
def _(t):
    return Window(t).history_items


@query("split_first_adds", ADDS + " SELECT basket_id, product_id, epoch_us(added_ts) AS us FROM adds")
def _(t):
    return sp.first_adds(t["sessions"], t["events"]).select("basket_id", "product_id", F.unix_micros(F.col("added_ts").cast("timestamp")).alias("us"))


@query("split_sample", f"SELECT basket_id, customer_id, channel FROM baskets ORDER BY {u('basket_id', 'sample')}, basket_id LIMIT 500")
def _(t):
    return sp.sample(t["baskets"], 500).select("basket_id", "customer_id", "channel")


@query("split_new_customers", HB + " SELECT basket_id FROM tb WHERE customer_id IS NULL OR customer_id NOT IN (SELECT customer_id FROM hb WHERE customer_id IS NOT NULL)")
def _(t):
    w = Window(t)
    return sp.of_new_customers(w.test, w.history).select("basket_id")


@query("split_query_items", PARTS + " SELECT * FROM parts")
def _(t):
    return Window(t).lazy_parts


@query("split_all_prefixes", PARTS + """ SELECT basket_id || '#k' || k AS query_id, basket_id, product_id, position, n_items, CAST(k AS INT) AS prefix_size
FROM (SELECT *, unnest(CASE WHEN n_items <= 1 THEN [0] ELSE range(1, n_items) END) AS k FROM placed)""")
def _(t):
    w = Window(t)
    return sp.query_items(sp.restrict(t["items"], w.test), w.adds, sp.CutPlan("all_prefixes"))


@query("split_headline", PARTS + f""" SELECT CAST(basket_id AS VARCHAR) AS query_id, basket_id, product_id, position, n_items,
CAST(CASE WHEN n_items <= 1 OR {u("basket_id", "cut")} < 0.5 THEN 0 ELSE n_items // 2 END AS INT) AS prefix_size FROM placed""")
def _(t):
    w = Window(t)
    return sp.query_items(sp.restrict(t["items"], w.test), w.adds, sp.CutPlan("headline"))


@query("split_random_fractions", PARTS + """ SELECT basket_id || '#k' || k AS query_id, basket_id, product_id, position, n_items, CAST(k AS INT) AS prefix_size
FROM (SELECT *, unnest(CASE WHEN n_items <= 1 THEN [0] ELSE list_distinct([greatest(1, least(CAST(round(n_items * f) AS INT), n_items - 1)) for f in [0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE]]) END) AS k FROM placed)""")
def _(t):
    w = Window(t)
    return sp.query_items(sp.restrict(t["items"], w.test), w.adds, sp.CutPlan("random_fractions"))


@query("split_queries", QS + " SELECT * REPLACE (epoch_us(cut_ts) AS cut_ts) FROM qs")
def _(t):
    return Window(t).q.withColumn("cut_ts", F.unix_micros(F.col("cut_ts").cast("timestamp")))


@query("split_prefix", PARTS + " SELECT * FROM prefix")
def _(t):
    return Window(t).prefix


@query("split_target", PARTS + " SELECT * FROM target")
def _(t):
    return Window(t).target


@query("split_validation_tail", QS + " SELECT query_id, basket_day > (SELECT max(basket_day) FROM qs) - 14 AS is_validation FROM qs")
def _(t):
    return sp.validation_tail(Window(t).q).select("query_id", "is_validation")


@query("split_validation_first", QS + """, b AS (SELECT basket_id, row_number() OVER (ORDER BY CAST(basket_id AS VARCHAR)) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT basket_id FROM qs))
SELECT query_id, r <= CASE WHEN n < 1200 THEN round(n * 200 / 1200) ELSE 200 END AS is_validation FROM qs JOIN b USING (basket_id)""")
def _(t):
    return sp.validation_first(Window(t).q, 200, 1000).select("query_id", "is_validation")


@query("cand_popularity_fit", HB + "," + POP + " SELECT * FROM pop")
def _(t):
    return Window(t).popularity()


@query("cand_category_popularity_fit", HB + "," + CATPOP + " SELECT * FROM catpop")
def _(t):
    return Window(t).category_popularity()


@query("cand_popularity", QS + "," + CATPOP + "," + CANDPOP + " SELECT * FROM candpop")
def _(t):
    return Window(t).source("pop")


@query("cand_product_affinity", PARTS + "," + HAFF + "," + CANDAFF + " SELECT * FROM candaff")
def _(t):
    return Window(t).source("aff")


@query("cand_category_leaders", HB + "," + LEADERS + " SELECT * FROM leaders")
def _(t):
    w = Window(t)
    return ca.category_leaders(w.history, w.history_items, t["products"])


@query("cand_category_affinity", PARTS + "," + HCAFF + "," + LEADERS + "," + CANDCAT + " SELECT * FROM candcat")
def _(t):
    return Window(t).source("cataff")


@query("cand_customer_products", HB + " SELECT customer_id, product_id, count(DISTINCT basket_id) AS n_baskets, CAST(sum(quantity) AS BIGINT) AS n_units, max(basket_day) AS last_day FROM hi JOIN hb USING (basket_id) WHERE customer_id IS NOT NULL GROUP BY 1, 2")
def _(t):
    w = Window(t)
    return ca.customer_products(w.history, w.history_items)


@query("cand_personal", QS + "," + ASOF + "," + CANDHIST + " SELECT * FROM candhist")
def _(t):
    return Window(t).source("hist")


@query("cand_dense_index", "SELECT category, CAST(row_number() OVER (ORDER BY category) - 1 AS INT) AS category_idx FROM (SELECT DISTINCT category FROM products)")
def _(t):
    return ca.dense_index(t["products"], "category", "category_idx")


@query("cand_in_cart", PARTS + " SELECT DISTINCT query_id, product_id FROM prefix")
def _(t):
    return ca.in_cart(Window(t).prefix)


@query("cand_latent")
def _(t):
    return Window(t).source("als")


@query("cand_union", POOL + " SELECT * FROM pool")
def _(t):
    return Window(t).pool()


@query("asof_customer", QS + "," + ASOF + " SELECT * FROM hcust")
def _(t):
    return Window(t).asof()["customer"]


@query("asof_product", QS + "," + ASOF + " SELECT * FROM hprod")
def _(t):
    return Window(t).asof()["product"]


@query("asof_category", QS + "," + ASOF + " SELECT * FROM hcat")
def _(t):
    return Window(t).asof()["category"]


_RANKS = """round({n} / u.n_days * 1e6::DOUBLE) / 1e6::DOUBLE AS share, CAST(dense_rank() OVER (PARTITION BY query_id ORDER BY {n} DESC) AS INT) AS freq_rank,
CAST(dense_rank() OVER (PARTITION BY query_id ORDER BY CASE WHEN due = 1 THEN 2 * {n} ELSE {n} END DESC) AS INT) AS need_rank"""


@query("asof_category_ranks", QS + "," + ASOF + " SELECT " + _RANKS.format(n="h.n_days") + """, h.* FROM hcat h JOIN hcust u USING (query_id)""")
def _(t):
    past = Window(t).asof()
    return ca.with_category_ranks(past["category"], past["customer"])


BEFORE = """
bc AS (SELECT query_id, product_id, event_type, event_ts, cut_ts FROM (SELECT query_id, basket_id, cut_ts FROM qs WHERE cut_ts IS NOT NULL) JOIN (SELECT session_id, basket_id FROM sessions WHERE basket_id IS NOT NULL) USING (basket_id) JOIN sevents USING (session_id) WHERE event_ts <= cut_ts)"""


def before_cut(t):
    return fe.events_before_cut(Window(t).q, t["sessions"], t["events"])


@query("feat_customer_profile", HB + """ SELECT customer_id, n_baskets, round(spend / n_baskets * 10000) / 10000 AS avg_ticket, last_day, n_products FROM (SELECT customer_id, count(DISTINCT basket_id) AS n_baskets, CAST(sum(CAST(total_amount AS DECIMAL(18,2))) AS DOUBLE) AS spend, max(basket_day) AS last_day FROM hb WHERE customer_id IS NOT NULL GROUP BY 1)
LEFT JOIN (SELECT customer_id, count(DISTINCT product_id) AS n_products FROM hi JOIN hb USING (basket_id) WHERE customer_id IS NOT NULL GROUP BY 1) USING (customer_id)""")
def _(t):
    w = Window(t)
    return ca.customer_profile(w.history, w.history_items)


@query("feat_events_before_cut", QS + "," + BEFORE + " SELECT query_id, product_id, event_type, epoch_us(event_ts) AS us FROM bc")
def _(t):
    return before_cut(t).select("query_id", "product_id", "event_type", F.unix_micros(F.col("event_ts").cast("timestamp")).alias("us"))


@query("feat_session_cart", QS + "," + BEFORE + " SELECT DISTINCT query_id, product_id FROM bc WHERE event_type = 'add_to_cart'")
def _(t):
    return fe.session_cart(before_cut(t))


@query("feat_session_views", QS + "," + BEFORE + " SELECT query_id, product_id, count(*) AS n_views, CAST(floor(epoch(any_value(cut_ts))) - floor(epoch(max(event_ts))) AS BIGINT) AS view_age_s FROM bc WHERE event_type = 'view' GROUP BY 1, 2")
def _(t):
    return fe.session_features(before_cut(t))[0]


@query("feat_session_activity", QS + "," + BEFORE + " SELECT query_id, count(*) AS n_events FROM bc GROUP BY 1")
def _(t):
    return fe.session_features(before_cut(t))[1]


@query("feat_cart_departments", PARTS + " SELECT query_id, department, count(*) AS dep_in_cart, round(count(*) / sum(count(*)) OVER (PARTITION BY query_id) * 1e6::DOUBLE) / 1e6::DOUBLE AS dep_share FROM prefix JOIN products USING (product_id) GROUP BY 1, 2")
def _(t):
    return fe.cart_features(Window(t).prefix, t["products"])[1]


@query("feat_active_discount", QS + """ SELECT basket_day, product_id, max(discount_value) AS promo_discount FROM (SELECT DISTINCT basket_day FROM qs) JOIN promotions ON basket_day BETWEEN start_date AND end_date GROUP BY 1, 2""")
def _(t):
    return fe.active_discount(Window(t).q, t["promotions"])


@query("feat_codes", "SELECT basket_id, CASE channel WHEN 'app' THEN 0 WHEN 'store' THEN 1 ELSE 3 END AS channel_code FROM (SELECT basket_id, CASE WHEN channel = 'web' THEN 'other' ELSE channel END AS channel FROM baskets)")
def _(t):
    return t["baskets"].select("basket_id", fe.code(F.when(F.col("channel") == "web", "other").otherwise(F.col("channel")), fe.CHANNELS).alias("channel_code"))


@query("feat_relevance", SCORED + " SELECT query_id, product_id, relevance, label FROM scored")
def _(t):
    return Window(t).scored().select("query_id", "product_id", "relevance", "label")


_MATRIX = {
    **{f: f"p.{f}" for f in _VALUES + _FLAGS + ["n_sources"] if f != "personal_score"}, "als_score": "NULL", "als_rank": "NULL", "src_als": "NULL",
    "n_times": "n_times", "n_units": "n_units", "days_since": "hprod.days_since", "ever_bought": "CAST(n_times IS NOT NULL AS INT)",
    "cat_n_days": "hr.n_days", "cat_days_since": "hr.days_since", "cat_expected": "expected_days", "cat_overdue": "overdue_ratio", "cat_due": "due", "cat_share": "share", "cat_freq_rank": "freq_rank", "cat_need_rank": "need_rank",
    "pop_all": "pop.pop_all", "pop_recent": "pop.recent", "season_index": "pop.index", "month_rank": "pop.rank", "unit_price": "unit_price", "pack_size": "pack_size", "typical_days": "typical_days",
    "private_label": "CAST(private_label AS INT)", "perishable": "CAST(perishable AS INT)", "department_idx": "(SELECT count(DISTINCT department) FROM products x WHERE x.department < d.department)",
    "category_idx": "(SELECT count(DISTINCT category) FROM products x WHERE x.category < d.category)",
    "prefix_size": "prefix_size", "month": "month(qs.basket_day)", "weekday": "dayofweek(qs.basket_day) + 1", "channel_code": "CASE channel WHEN 'app' THEN 0 WHEN 'store' THEN 1 WHEN 'web' THEN 2 ELSE 3 END", "is_known": "CAST(is_known AS INT)",
    "n_baskets": "n_baskets", "recency": "recency", "avg_ticket": "avg_ticket", "n_products": "n_products", "household_size": "household_size", "tier_code": "CASE tier WHEN 'bronze' THEN 0 WHEN 'silver' THEN 1 WHEN 'gold' THEN 2 ELSE 3 END",
    "on_promo": "CAST(promo_discount IS NOT NULL AS INT)", "promo_discount": "promo_discount", "has_session": "CAST(cut_ts IS NOT NULL AS INT)", "viewed": "CAST(n_views IS NOT NULL AS INT)", "n_views": "n_views", "view_age_s": "view_age_s", "n_events": "n_events",
    "cat_in_cart": "cat_in_cart", "dep_in_cart": "dep_in_cart", "dep_share": "dep_share",
}
MATRIX = POOL + "," + BEFORE + """,
disc AS (SELECT basket_day, product_id, max(discount_value) AS promo_discount FROM (SELECT DISTINCT basket_day FROM qs) JOIN promotions ON basket_day BETWEEN start_date AND end_date GROUP BY 1, 2),
cic AS (SELECT DISTINCT query_id, category, 1 AS cat_in_cart FROM prefix JOIN products USING (product_id)),
dic AS (SELECT query_id, department, count(*) AS dep_in_cart, round(count(*) / sum(count(*)) OVER (PARTITION BY query_id) * 1e6::DOUBLE) / 1e6::DOUBLE AS dep_share FROM prefix JOIN products USING (product_id) GROUP BY 1, 2),
vw AS (SELECT query_id, product_id, count(*) AS n_views, floor(epoch(any_value(cut_ts))) - floor(epoch(max(event_ts))) AS view_age_s FROM bc WHERE event_type = 'view' GROUP BY 1, 2),
ev AS (SELECT query_id, count(*) AS n_events FROM bc GROUP BY 1),
hr AS (SELECT """ + _RANKS.format(n="h.n_days") + """, h.* FROM hcat h JOIN hcust u USING (query_id))
SELECT p.query_id, p.product_id, d.category, """ + ", ".join(
    f"CAST({f'coalesce({_MATRIX[n]}, 0)' if n in fe.ZERO else _MATRIX[n]} AS DOUBLE) AS {n}" for n in fe.FEATURES
) + """ FROM pool p JOIN products d ON d.product_id = p.product_id JOIN qs ON qs.query_id = p.query_id LEFT JOIN customers cu ON cu.customer_id = qs.customer_id LEFT JOIN pop ON pop.product_id = p.product_id AND pop.month = month(qs.basket_day)
LEFT JOIN disc ON disc.basket_day = qs.basket_day AND disc.product_id = p.product_id LEFT JOIN cic ON cic.query_id = p.query_id AND cic.category = d.category LEFT JOIN dic ON dic.query_id = p.query_id AND dic.department = d.department
LEFT JOIN hcust ON hcust.query_id = p.query_id LEFT JOIN hprod ON hprod.query_id = p.query_id AND hprod.product_id = p.product_id LEFT JOIN hr ON hr.query_id = p.query_id AND hr.category = d.category
LEFT JOIN vw ON vw.query_id = p.query_id AND vw.product_id = p.product_id LEFT JOIN ev ON ev.query_id = p.query_id"""  # fmt: skip


@query("feat_matrix", MATRIX)
def _(t):
    return Window(t).matrix()


@query("rank_order_candidates", SCORED + " SELECT query_id, product_id, category, score, cat_in_cart, relevance, label, demoted, rank FROM ordered")
def _(t):
    return rk.order_candidates(Window(t).scored())


@query("rank_top_k", SCORED + " SELECT query_id, product_id, rank FROM top5")
def _(t):
    return Window(t).top().select("query_id", "product_id", "rank")


@query("rank_per_query_metrics", METRICS + " SELECT * FROM pq")
def _(t):
    return Window(t).metrics()


@query("rank_graded_metrics", SCORED + f""", g AS (SELECT query_id, sum(CASE relevance WHEN 2 THEN 3 WHEN 1 THEN 1 ELSE 0 END / log2(rank + 1)) AS dcg, max(CAST(relevance > 0 AS INT)) AS hit FROM top5 GROUP BY 1)
SELECT query_id, round(coalesce(dcg, 0) / (3 * {_IDEAL.format(n="n_target", k=5)} + ({_IDEAL.format(n=5, k=5)} - {_IDEAL.format(n="n_target", k=5)})) * 1e6::DOUBLE) / 1e6::DOUBLE AS ndcg, coalesce(hit, 0) AS hit FROM qs LEFT JOIN g USING (query_id)""")
def _(t):
    w = Window(t)
    return rk.graded_per_query(w.top(), w.q)


_MEANS = ", ".join(f"round(avg({m}) * 1e6::DOUBLE) / 1e6::DOUBLE AS {m}" for m in ("ndcg", "recall", "precision", "f1", "hit"))


@query("rank_summary", METRICS + f""", s AS (SELECT count(*) AS n, {_MEANS}, 'all' AS profile FROM pq UNION ALL SELECT count(*), {_MEANS.replace(" AS ndcg", "").replace(" AS recall", "").replace(" AS precision", "").replace(" AS f1", "").replace(" AS hit", "")}, CAST(profile AS VARCHAR) FROM pq JOIN qs USING (query_id) GROUP BY profile)
SELECT *, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) * 1e6::DOUBLE) / 1e6::DOUBLE AS f1_of_means FROM s""")
def _(t):
    w = Window(t)
    return rk.summarise(w.metrics(), w.q)


@query("rank_prefix_bins", QS + """ SELECT query_id, CASE WHEN prefix_size >= 10 THEN '10+' ELSE CAST(prefix_size AS VARCHAR) END AS size_bin,
CASE WHEN prefix_size / n_items <= 0 THEN '0' WHEN prefix_size / n_items <= 0.25 THEN '(0,.25]' WHEN prefix_size / n_items <= 0.5 THEN '(.25,.5]' WHEN prefix_size / n_items <= 0.75 THEN '(.5,.75]' ELSE '(.75,1)' END AS fraction_bin FROM qs""")
def _(t):
    return rk.prefix_bins(Window(t).q)


@query("rank_candidate_recall", POOL + """, a AS (SELECT query_id, count(*) AS n_pool FROM pool GROUP BY 1), b AS (SELECT query_id, count(*) AS n, count(p.product_id) AS n_in FROM target t LEFT JOIN pool p USING (query_id, product_id) GROUP BY 1),
w AS (SELECT DISTINCT query_id, category FROM target JOIN products USING (product_id)), h AS (SELECT DISTINCT query_id, category, 1 AS x FROM pool JOIN products USING (product_id)), c AS (SELECT query_id, count(*) AS c, count(x) AS c_in FROM w LEFT JOIN h USING (query_id, category) GROUP BY 1)
SELECT round(avg(n_in / n) * 1e6::DOUBLE) / 1e6::DOUBLE AS recall, round(avg(c_in / c) * 1e6::DOUBLE) / 1e6::DOUBLE AS category_recall, round(avg(coalesce(n_pool, 0)) * 10000) / 10000 AS mean_pool FROM qs LEFT JOIN a USING (query_id) LEFT JOIN b USING (query_id) LEFT JOIN c USING (query_id)""")
def _(t):
    w = Window(t)
    return rk.candidate_recall(w.pool(), w.target, w.q, t["products"])


@query("rank_wasted_slots", SCORED + """, a AS (SELECT *, row_number() OVER (PARTITION BY query_id, category ORDER BY rank) > 1 AS again FROM top5)
SELECT count(*) AS n_slots, count(*) FILTER (cat_in_cart > 0) AS n_cart, count(*) FILTER (again) AS n_repeat, round(100 * avg(CAST(cat_in_cart > 0 OR again AS DOUBLE)) * 10000) / 10000 AS pct_wasted FROM a""")
def _(t):
    return rk.wasted_slots(Window(t).top())


@query("rank_recency_slots", SCORED + """ SELECT CASE WHEN h.days_since IS NULL THEN 'never' WHEN h.days_since <= 7 THEN '1-7' WHEN h.days_since <= 14 THEN '8-14' WHEN h.days_since <= 90 THEN '15-90' ELSE '90+' END AS band,
count(*) AS n_slots, CAST(sum(label) AS BIGINT) AS n_hits FROM top5 LEFT JOIN hprod h USING (query_id, product_id) GROUP BY 1""")
def _(t):
    w = Window(t)
    return rk.recency_slots(w.top(), w.past["product"])


_POP = SCORED.replace("round((coalesce(pop_score, 0) + coalesce(aff_lift, 0) + coalesce(cataff_lift, 0) + 5 * coalesce(personal_score, 0)) * 10000) / 10000 AS score", "round(coalesce(pop_score, 0) * 10000) / 10000 AS score")


@query("rank_recency_comparison", SCORED + ", y AS (WITH " + _POP[len(QS) + 1 :].lstrip() + """ SELECT * FROM top5), sy AS (SELECT 'all sources' AS system, query_id, category, label FROM top5 UNION ALL SELECT 'popular', query_id, category, label FROM y),
m AS (SELECT system, days, sy.query_id, label, CAST(coalesce(days_since <= days, false) AS INT) AS r FROM sy LEFT JOIN hcat USING (query_id, category), (VALUES (7), (14)) v(days)),
ch AS (SELECT DISTINCT query_id, days FROM m WHERE system = 'all sources' AND r = 1), ss AS (SELECT DISTINCT system FROM sy),
p AS (SELECT ss.system, ch.days, ch.query_id, coalesce(sum(r), 0) AS r, coalesce(sum(label), 0) AS h FROM ch CROSS JOIN ss LEFT JOIN m ON m.query_id = ch.query_id AND m.days = ch.days AND m.system = ss.system GROUP BY 1, 2, 3)
SELECT days, system, count(*) AS n_queries, round(100 * sum(r) / (count(*) * 5) * 10000) / 10000 AS pct_recent, round(avg(h / 5) * 1e6::DOUBLE) / 1e6::DOUBLE AS precision, round(avg(CAST(h > 0 AS DOUBLE)) * 1e6::DOUBLE) / 1e6::DOUBLE AS hit FROM p GROUP BY 1, 2""")
def _(t):
    w = Window(t)
    full = saved(w.scored_parts())
    popular = full.withColumn("score", fixed(F.coalesce("pop_score", F.lit(0.0)), 4))
    return rk.recency_comparison({"all sources": rk.top_k(full, 5), "popular": rk.top_k(popular, 5)}, w.past["category"], "all sources")


_BASE = QS + "," + ASOF + "," + HCAFF + """,
cats AS (SELECT category, count(*) AS n FROM csets s JOIN (SELECT DISTINCT category FROM products) c ON c.category = s.item GROUP BY 1),
mons AS (SELECT CAST(month(basket_day) AS INT) AS month, item AS category, count(*) AS n FROM csets JOIN hb USING (basket_id) GROUP BY 1, 2),
cart AS (SELECT DISTINCT query_id, category FROM prefix JOIN products USING (product_id)),
grid AS (SELECT query_id, month(basket_day) AS month, category, n AS fill FROM (SELECT query_id, basket_day, category, n FROM qs, cats) ANTI JOIN cart USING (query_id, category)),"""
_BASE_SCORE = {
    "random": f"SELECT query_id, category, {u('query_id || chr(45) || category', 'random')} AS score, fill FROM grid",
    "global": "SELECT query_id, category, CAST(fill AS DOUBLE) AS score, fill FROM grid",
    "month": "SELECT query_id, g.category, coalesce(CAST(m.n AS DOUBLE), -1) AS score, fill FROM grid g LEFT JOIN mons m ON m.month = g.month AND m.category = g.category",
    "frequency": "SELECT query_id, category, coalesce(CAST(n_days AS DOUBLE), -1) AS score, fill FROM grid LEFT JOIN hcat USING (query_id, category)",
    "due": "SELECT query_id, category, coalesce(CAST(n_days * (1 + due) AS DOUBLE), -1) AS score, fill FROM grid LEFT JOIN hcat USING (query_id, category)",
    "favourite": "SELECT query_id, category, coalesce(CASE WHEN n_days >= 2 THEN CAST(n_days AS DOUBLE) END, -1) AS score, fill FROM grid LEFT JOIN hcat USING (query_id, category)",
    "rules": "SELECT g.query_id, g.category, coalesce(c, -1) AS score, fill FROM grid g LEFT JOIN (SELECT query_id, consequent AS category, max(confidence) AS c FROM cart JOIN caff ON antecedent = category GROUP BY 1, 2) r USING (query_id, category)",
}
_BASE_TOP = """),
btop AS (SELECT * FROM (SELECT query_id, category, score, fill, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fill DESC, category) AS INT) AS rank FROM bs) WHERE rank <= 5)"""


def baseline(t, kind):
    w = Window(t)
    sets = aff.basket_items(w.history_items, t["products"])
    categories = sets.groupBy(F.col("item").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    monthly = sets.join(w.history.select("basket_id", F.month("basket_day").alias("month")), "basket_id").groupBy("month", F.col("item").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return w, rk.baseline_top(rk.baseline_scores(kind, w.q, categories, w.prefix, w.asof()["category"], monthly, w.affinity("category"), t["products"]))


for _kind in rk.BASELINES:

    @query(f"baseline_{_kind}", _BASE + " bs AS (" + _BASE_SCORE[_kind] + _BASE_TOP + " SELECT query_id, category, rank FROM btop")
    def _(t, kind=_kind):
        return baseline(t, kind)[1].select("query_id", "category", "rank")


@query("baseline_category_hits", _BASE + " bs AS (" + _BASE_SCORE["frequency"] + _BASE_TOP + """, w AS (SELECT DISTINCT query_id, category FROM target JOIN products USING (product_id)), g AS (SELECT query_id, count(*) AS h FROM btop JOIN w USING (query_id, category) GROUP BY 1)
SELECT round(avg(CAST(h IS NOT NULL AS DOUBLE)) * 1e6::DOUBLE) / 1e6::DOUBLE AS hit_rate, round(avg(coalesce(h, 0)) * 1e6::DOUBLE) / 1e6::DOUBLE AS mean_hits FROM qs LEFT JOIN g USING (query_id)""")
def _(t):
    w, top = baseline(t, "frequency")
    return rk.category_hits(top, w.target, t["products"], w.q)


_POISSON = " + ".join(f"CAST(u >= {s} AS INT)" for s in ("0.36787944117144233::DOUBLE", "0.7357588823428847::DOUBLE", "0.9196986029286058::DOUBLE", "0.9810118431238462::DOUBLE", "0.9963401531726563::DOUBLE", "0.9994058151824183::DOUBLE", "0.999916758850712::DOUBLE", "0.9999897508033253::DOUBLE"))
_BOOT = METRICS + f""",
cl AS (SELECT basket_id AS cluster, sum(hit) AS s, count(*) AS n FROM pq JOIN qs USING (query_id) GROUP BY 1),
bt AS (SELECT replicate, sum(w * s) / nullif(sum(w * n), 0) AS mean FROM (SELECT *, {_POISSON} AS w FROM (SELECT *, {u("concat_ws('#', cluster, replicate)", "boot")} AS u FROM cl, range(1, 1001) r(replicate))) GROUP BY 1)"""


def clusters(w):
    return w.q.select("query_id", F.col("basket_id").alias("cluster"))


@query("boot_replicates", _BOOT + " SELECT CAST(replicate AS INT) AS replicate, round(mean * 1e6::DOUBLE) / 1e6::DOUBLE AS mean FROM bt")
def _(t):
    w = Window(t)
    return rk.bootstrap(w.metrics(), clusters(w), "hit", 1000).withColumn("mean", fixed("mean", 6))


@query("boot_interval", _BOOT + " SELECT round(quantile_cont(mean, 0.025) * 1e6::DOUBLE) / 1e6::DOUBLE AS low, round(quantile_cont(mean, 0.975) * 1e6::DOUBLE) / 1e6::DOUBLE AS high FROM bt")
def _(t):
    w = Window(t)
    return rk.percentile_interval(rk.bootstrap(w.metrics(), clusters(w), "hit", 1000))


@query("boot_paired", METRICS + f""",
dd AS (SELECT query_id, CAST(hit AS DOUBLE) - recall AS d FROM pq), o AS (SELECT avg(d) AS difference FROM dd),
cl AS (SELECT basket_id AS cluster, sum(d) AS s, count(*) AS n FROM dd JOIN qs USING (query_id) GROUP BY 1),
bt AS (SELECT replicate, sum(w * s) / nullif(sum(w * n), 0) AS mean FROM (SELECT *, {_POISSON} AS w FROM (SELECT *, {u("concat_ws('#', cluster, replicate)", "boot")} AS u FROM cl, range(1, 1001) r(replicate))) GROUP BY 1)
SELECT round(any_value(difference) * 1e6::DOUBLE) / 1e6::DOUBLE AS difference, round(quantile_cont(mean, 0.025) * 1e6::DOUBLE) / 1e6::DOUBLE AS low, round(quantile_cont(mean, 0.975) * 1e6::DOUBLE) / 1e6::DOUBLE AS high,
round((1 + count(*) FILTER (abs(mean - difference) >= abs(difference))) / 1001 * 1e6::DOUBLE) / 1e6::DOUBLE AS p FROM bt, o""")
def _(t):
    w = Window(t)
    m = w.metrics()
    return rk.paired_bootstrap(m.select("query_id", F.col("hit").cast("double").alias("x")), m.select("query_id", F.col("recall").alias("x")), clusters(w), "x", 1000)


@query("rank_examples", METRICS + """, h AS (SELECT profile, query_id, ndcg, row_number() OVER (PARTITION BY profile ORDER BY ndcg, query_id) AS i, count(*) OVER (PARTITION BY profile) AS n FROM pq JOIN qs USING (query_id) WHERE hit = 1)
SELECT profile, query_id, ndcg FROM h WHERE i = (n + 1) // 2""")
def _(t):
    w = Window(t)
    return rk.pick_examples(w.metrics(), w.q)


@query("rank_learned_top")
def _(t):
    """A boosted ranker on the full pool, with latent factors: fitted on a half of the queries, stopped by its last days, applied to the rest."""
    w = Window(t)
    full = saved(w.matrix("als", target=w.target))
    half = (F.hash("query_id") % 2) == 0
    model = rk.fit_ranker(full.where(half), fe.FEATURES)
    return rk.top_k(rk.rank_with(model, full.where(~half), fe.FEATURES), 5).select("query_id", "product_id", "score", "rank", "label")


def _variant(name: str, quota: int, cart: bool) -> str:
    order = f"CAST(row_number() OVER (PARTITION BY query_id, category ORDER BY score DESC, product_id) > {quota}{' OR cat_in_cart > 0' if cart else ''} AS INT)"
    return f"""(SELECT '{name}' AS variant, count(*) AS n, round(avg(ndcg) * 1e6::DOUBLE) / 1e6::DOUBLE AS ndcg, round(avg(recall) * 1e6::DOUBLE) / 1e6::DOUBLE AS recall, round(avg(hit) * 1e6::DOUBLE) / 1e6::DOUBLE AS hit FROM (
SELECT query_id, round(coalesce(coalesce(dcg, 0) / CASE WHEN n_target > 0 THEN {_IDEAL.format(n="n_target", k=5)} END, 0) * 1e6::DOUBLE) / 1e6::DOUBLE AS ndcg, round(coalesce(coalesce(hits, 0) / nullif(n_target, 0), 0) * 1e6::DOUBLE) / 1e6::DOUBLE AS recall, CAST(coalesce(hits, 0) > 0 AS INT) AS hit
FROM qs LEFT JOIN (SELECT query_id, sum(CASE WHEN label = 1 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, sum(label) AS hits FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dm, score DESC, product_id) AS rank FROM (SELECT *, {order} AS dm FROM scored)) WHERE rank <= 5 GROUP BY 1) USING (query_id)))"""


@query("rank_ablation", SCORED + " " + " UNION ALL ".join(_variant(*v) for v in rk.VARIANTS))
def _(t):
    w = Window(t)
    return rk.ablation(w.scored(), w.q)


@query("rank_cut_report", METRICS + """ SELECT CASE WHEN prefix_size >= 10 THEN '10+' ELSE CAST(prefix_size AS VARCHAR) END AS size_bin, count(*) AS n, round(avg(ndcg) * 1e6::DOUBLE) / 1e6::DOUBLE AS ndcg, round(avg(hit) * 1e6::DOUBLE) / 1e6::DOUBLE AS hit FROM pq JOIN qs USING (query_id) GROUP BY 1""")
def _(t):
    w = Window(t)
    return rk.summarise(w.metrics(), rk.prefix_bins(w.q), "size_bin").where("size_bin <> 'all'").select("size_bin", "n", "ndcg", "hit")


@query("rank_cold_start", METRICS + " SELECT profile IN (1, 2) AS is_new, count(*) AS n, round(avg(ndcg) * 1e6::DOUBLE) / 1e6::DOUBLE AS ndcg, round(avg(hit) * 1e6::DOUBLE) / 1e6::DOUBLE AS hit FROM pq JOIN qs USING (query_id) GROUP BY 1")
def _(t):
    w = Window(t)
    groups = w.q.select("query_id", F.when(F.col("is_known"), "false").otherwise("true").alias("is_new"))
    return rk.summarise(w.metrics(), groups, "is_new").where("is_new <> 'all'").select((F.col("is_new") == "true").alias("is_new"), "n", "ndcg", "hit")


_CHANCE = QS + "," + ASOF + """,
ch AS (SELECT query_id, category, least(0.9::DOUBLE, n_days / 20) AS p FROM hcat),
dr AS (SELECT query_id, category, s FROM ch, range(0, 1000) r(s) WHERE """ + u("concat_ws('-', query_id, category, s)", "ceiling") + """ < p),
ev AS (SELECT query_id, category FROM (SELECT query_id, category, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, category) AS r FROM dr WHERE s % 2 = 0 GROUP BY 1, 2) WHERE r <= 5),
od AS (SELECT query_id, s, count(*) AS h FROM dr JOIN ev USING (query_id, category) WHERE s % 2 = 1 GROUP BY 1, 2),
sm AS (SELECT query_id, sum(h) AS h, sum(h * h) AS h2 FROM od GROUP BY 1),
ce AS (SELECT query_id, round(coalesce(h, 0) / 500 * 1e6::DOUBLE) / 1e6::DOUBLE AS expected_hits, round(sqrt(greatest((coalesce(h2, 0) - 500 * (coalesce(h, 0) / 500) * (coalesce(h, 0) / 500)) / 499, 0) / 500) * 1e6::DOUBLE) / 1e6::DOUBLE AS se FROM (SELECT DISTINCT query_id FROM ch) LEFT JOIN sm USING (query_id))"""


def chances(w):
    return w.asof()["category"].select("query_id", "category", F.least(F.lit(0.9), F.col("n_days") / 20).alias("p"))


@query("rank_ceiling", _CHANCE + " SELECT * FROM ce")
def _(t):
    return rk.ceiling(chances(Window(t)))


@query("rank_ceiling_check", _CHANCE + """, w AS (SELECT DISTINCT query_id, category FROM target JOIN products USING (product_id)),
re AS (SELECT query_id, count(w.category) AS hits FROM (SELECT DISTINCT query_id FROM ch) LEFT JOIN ev USING (query_id) LEFT JOIN w USING (query_id, category) GROUP BY 1)
SELECT count(*) AS n, round(avg(hits) * 1e6::DOUBLE) / 1e6::DOUBLE AS realised, round(avg(expected_hits) * 1e6::DOUBLE) / 1e6::DOUBLE AS ceiling, round((avg(hits) - avg(expected_hits)) / sqrt(var_samp(hits - expected_hits) / count(*)) * 10000) / 10000 AS z FROM re JOIN ce USING (query_id)""")
def _(t):
    w = Window(t)
    p = chances(w)
    best = rk.ceiling_choice(p)
    wanted = w.target.join(t["products"].select("product_id", "category"), "product_id").select("query_id", "category").distinct().withColumn("y", F.lit(1))
    realised = p.select("query_id").distinct().join(best, "query_id", "left").join(wanted, ["query_id", "category"], "left").groupBy("query_id").agg(F.count("y").alias("hits"))
    return rk.ceiling_check(rk.ceiling(p), realised)


@query("rank_listwise_top")
def _(t):
    """The listwise ranker on the pool without latent factors, stopped by the last days of its half of the queries, applied to the rest."""
    w = Window(t)
    full = saved(w.matrix(target=w.target))
    half = (F.hash("query_id") % 2) == 0
    model, _ = rk.fit_lambda_ranker(full.where(half), fe.FEATURES, *REFERENCE)
    return rk.top_k(rk.rank_with(model, full.where(~half), fe.FEATURES), 5).select("query_id", "product_id", "score", "rank", "label")


@query("rank_objective_ablation")
def _(t):
    """Four objectives and validations, fitted on a half of the queries and judged on the rest."""
    w = Window(t)
    full = saved(w.matrix(target=w.target))
    half = (F.hash("query_id") % 2) == 0
    return rk.objective_ablation(full.where(half), full.where(~half), w.q.where(~half), fe.FEATURES, *REFERENCE)


def cart_chances(w):
    """Weights of categories by how often the customer bought them, with those in the cart and the number in the basket."""
    category = w.t["products"].select("product_id", "category")
    cart = w.prefix.join(category, "product_id").select("query_id", "category").distinct().withColumn("in_cart", F.lit(True))
    size = w.parts.join(category, "product_id").groupBy("query_id").agg(F.countDistinct("category").alias("n"))
    own = w.past["category"].select("query_id", "category", F.col("n_days").cast("double").alias("weight"))
    both = own.join(cart, ["query_id", "category"], "full_outer").join(w.past["customer"].select("query_id"), "query_id", "left_semi").join(size, "query_id")
    return both.select("query_id", "category", F.coalesce("weight", F.lit(0.5)).alias("weight"), F.coalesce("in_cart", F.lit(False)).alias("in_cart"), "n")


@query("rank_ceiling_given_cart")
def _(t):
    return rk.ceiling_given_cart(cart_chances(Window(t)))


@query("rank_source_coverage", POOL + """, e AS (SELECT profile, unnest([{'s': 'src_pop', 'o': src_pop}, {'s': 'src_aff', 'o': src_aff}, {'s': 'src_cataff', 'o': src_cataff}, {'s': 'src_hist', 'o': src_hist}]) AS s, t.product_id AS hit
  FROM pool JOIN qs USING (query_id) LEFT JOIN (SELECT DISTINCT query_id, product_id FROM target) t USING (query_id, product_id)), n AS (SELECT profile, sum(n_target) AS every FROM qs GROUP BY 1)
SELECT profile, s.s AS source, count(*) AS n_candidates, count(hit) AS n_targets, round(100 * count(hit) / any_value(every) * 10000) / 10000 AS pct_targets FROM e JOIN n USING (profile) WHERE s.o = 1 GROUP BY 1, 2""")
def _(t):
    w = Window(t)
    return rk.source_coverage(w.pool(), w.target, w.q, ("src_pop", "src_aff", "src_cataff", "src_hist"))


#: The same metrics with a score that only knows what is popular.
_POPULAR = METRICS.replace("round((coalesce(pop_score, 0) + coalesce(aff_lift, 0) + coalesce(cataff_lift, 0) + 5 * coalesce(personal_score, 0)) * 10000) / 10000 AS score", "round(coalesce(pop_score, 0) * 10000) / 10000 AS score")
_COMPARE = ",".join([QS, "x AS (WITH " + METRICS[len(QS) + 1 :].lstrip() + " SELECT * FROM pq)", "y AS (WITH " + _POPULAR[len(QS) + 1 :].lstrip() + " SELECT * FROM pq)"]) + f""",
sy AS (SELECT 'popular' AS system, query_id, ndcg FROM y UNION ALL SELECT 'all sources', query_id, ndcg FROM x), df AS (SELECT system, s.query_id, s.ndcg, s.ndcg - y.ndcg AS d FROM sy s JOIN y USING (query_id)),
cl AS (SELECT system, basket_id AS cluster, sum(d) AS s, count(*) AS n FROM df JOIN qs USING (query_id) GROUP BY 1, 2), o AS (SELECT system, avg(ndcg) AS mean, avg(d) AS difference FROM df GROUP BY 1),
bt AS (SELECT system, replicate, sum(w * s) / nullif(sum(w * n), 0) AS m FROM (SELECT *, {_POISSON} AS w FROM (SELECT *, {u("concat_ws('#', cluster, replicate)", "boot")} AS u FROM cl, range(1, 1001) r(replicate))) GROUP BY 1, 2)
SELECT system, round(any_value(mean) * 1e6::DOUBLE) / 1e6::DOUBLE AS mean, round(any_value(difference) * 1e6::DOUBLE) / 1e6::DOUBLE AS difference, round(quantile_cont(m, 0.025) * 1e6::DOUBLE) / 1e6::DOUBLE AS low,
round(quantile_cont(m, 0.975) * 1e6::DOUBLE) / 1e6::DOUBLE AS high, round((1 + count(*) FILTER (abs(m - difference) >= abs(difference))) / 1001 * 1e6::DOUBLE) / 1e6::DOUBLE AS p FROM bt JOIN o USING (system) GROUP BY 1"""


@query("rank_compare_systems", _COMPARE)
def _(t):
    w = Window(t)
    full = saved(w.scored_parts())
    popular = full.withColumn("score", fixed(F.coalesce("pop_score", F.lit(0.0)), 4))
    systems = {n: rk.per_query_metrics(rk.top_k(s, 5), w.q) for n, s in (("popular", popular), ("all sources", full))}
    return rk.compare_systems(systems, clusters(w), "ndcg")


@query("rank_importance")
def _(t):
    w = Window(t)
    full = saved(w.matrix("als", target=w.target))
    model = rk.fit_ranker(full, fe.FEATURES)
    forget(full)
    return rk.importance(model, fe.FEATURES, t["products"].sparkSession)


#: The served cart in SQL: the same definitions, with history up to its day and one query.
_LIVE = """qs AS (SELECT 'live' AS query_id, CAST(7 AS BIGINT) AS customer_id, DATE '2000-06-15' AS basket_day),
prefix AS (SELECT 'live' AS query_id, unnest([1, 2, 3]) AS product_id)"""
_HB2 = "hb AS (SELECT * FROM baskets WHERE basket_day < DATE '2000-06-15'), hi AS (SELECT i.* FROM items i SEMI JOIN hb USING (basket_id))"
_TOP20 = "paff AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY antecedent ORDER BY lift DESC, n_both DESC, consequent) AS rk FROM paff0) WHERE rk <= 20)"
SERVE_SQL = ",".join([_HB2, _LIVE, CATPOP, CANDPOP, HAFF.replace("paff AS", "paff0 AS"), _TOP20, CANDAFF, HCAFF, LEADERS, CANDCAT, ASOF, CANDHIST]) + POOL[len(ALLC):] + """,
sc AS (SELECT product_id, category, round((coalesce(pop_score, 0) + coalesce(aff_lift, 0) + coalesce(cataff_lift, 0) + 5 * coalesce(personal_score, 0)) * 10000) / 10000 AS score,
  category IN (SELECT category FROM products WHERE product_id IN (1, 2, 3)) AS carted FROM pool JOIN products USING (product_id)),
od AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, product_id) > 1 OR carted AS demoted FROM sc)
SELECT * FROM (SELECT product_id, category, score, CAST(row_number() OVER (ORDER BY demoted, score DESC, product_id) AS INT) AS rank FROM od) WHERE rank <= 5"""
