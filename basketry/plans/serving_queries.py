"""Queries of serving, demo slices, catalogue and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fn
from ..operators import serving as sv
from ..shared import shared_dir
from ..sources import files
from . import steps
from .nba_queries import CFEAT, PAIRS, Snapshot
from .reco_queries import PARTS, POOL, QS, SCORED, SERVE_SQL, Window, u
from .registry import query

PLAIN = "trim(regexp_replace(translate(lower({}), 'áàâäãåéèêëíìîïóòôöõúùûüñç', 'aaaaaaeeeeiiiiooooouuuunc'), '\\s+', ' ', 'g'))"


SERVED = (7, "2000-06-15", [1, 2, 3])


@query("serve_recommend", SERVE_SQL)
def _(t):
    """A cart of one customer, answered from an exported bundle."""
    spark = t["items"].sparkSession
    folder = shared_dir(spark)
    customer, day, cart = SERVED
    sv.export_bundle(t, day, folder)
    return sv.recommend(spark, folder, customer, day, cart)


@query("serve_slice", "SELECT basket_id, customer_id, channel FROM baskets WHERE customer_id % 50 = 0")
def _(t):
    return sv.slice_for(t, t["customers"].where("customer_id % 50 = 0"))["baskets"].select("basket_id", "customer_id", "channel")


@query("demo_scenarios", CFEAT + """, c AS (SELECT customer_id, recency AS r, spend_90 AS s, n_90 AS v FROM cfeat), k AS (SELECT quantile_cont(r, 0.25) AS rl, quantile_cont(r, 0.75) AS rh, quantile_cont(s, 0.25) AS sl, quantile_cont(s, 0.75) AS sh, quantile_cont(v, 0.25) AS vl, quantile_cont(v, 0.75) AS vh FROM c)
SELECT customer_id, CASE WHEN rh > rl AND r >= rh THEN 'at risk' WHEN sh > sl AND s >= sh THEN 'large spend' WHEN vh > vl AND v >= vh THEN 'frequent' WHEN vh > vl AND v <= vl THEN 'occasional' ELSE 'typical' END AS scenario FROM c, k""")
def _(t):
    return sv.scenarios(Snapshot(t).customers(), risk="recency")


@query("demo_risk_labels", CFEAT + """, c AS (SELECT customer_id, recency AS r FROM cfeat), k AS (SELECT quantile_cont(r, 0.5) AS m, quantile_cont(r, 0.75) AS h FROM c)
SELECT customer_id, CASE WHEN r >= h THEN 'high' WHEN r >= m THEN 'medium' ELSE 'low' END AS risk FROM c, k""")
def _(t):
    return sv.risk_labels(Snapshot(t).customers(), "recency")


@query("serve_demo_bundle", "SELECT 'baskets' AS \"table\", count(*) AS n_rows FROM baskets WHERE customer_id % 50 = 0 UNION ALL SELECT 'customers', count(*) FROM customers WHERE customer_id % 50 = 0 UNION ALL SELECT 'products', count(*) FROM products")
def _(t):
    """A bundle for some customers, and its manifest."""
    spark = t["customers"].sparkSession
    folder = shared_dir(spark)
    sv.export_demo_bundle({n: t[n] for n in ("baskets", "customers", "products")}, t["customers"].where("customer_id % 50 = 0"), folder)
    return spark.read.parquet(f"{folder}/manifest").select("table", "n_rows")


@query("demo_spread_pick", "p AS (SELECT customer_id, tier, row_number() OVER (PARTITION BY tier ORDER BY customer_id) - 1 AS i, count(*) OVER (PARTITION BY tier) AS n FROM customers) SELECT customer_id, tier FROM p WHERE i % greatest(n // 10, 1) = 0 AND i / greatest(n // 10, 1) < 10")
def _(t):
    return sv.spread_pick(t["customers"].select("customer_id", "tier"), "tier", 10)


@query("demo_explain", POOL + """, e AS (SELECT p.*, h.due FROM pool p JOIN products d ON d.product_id = p.product_id LEFT JOIN hcat h ON h.query_id = p.query_id AND h.category = d.category)
SELECT query_id, product_id, CASE WHEN due = 1 THEN 'due' WHEN src_hist = 1 THEN 'bought before' WHEN src_aff = 1 THEN 'goes with the cart' WHEN src_cataff = 1 THEN 'its category goes with the cart' ELSE 'popular' END AS reason FROM e""")
def _(t):
    w = Window(t)
    due = w.asof()["category"].select("query_id", "category", F.col("due").alias("cat_due"))
    pool = w.pool().join(t["products"].select("product_id", "category"), "product_id").join(due, ["query_id", "category"], "left").withColumn("src_als", F.lit(0))
    return sv.explain(pool).select("query_id", "product_id", "reason")


@query("demo_promo_badge", "SELECT promotion_id, CASE promo_type WHEN '2x1' THEN '2 for 1' WHEN 'discount_pct' THEN '-' || CAST(round(discount_value * 100) AS INT) || '%' WHEN 'coupon' THEN 'coupon' END AS badge FROM promotions")
def _(t):
    return t["promotions"].select("promotion_id", sv.promo_badge("promo_type", "discount_value").alias("badge"))


@query("demo_search", "SELECT product_id, unit_price FROM products WHERE contains(" + PLAIN.format("concat_ws(' ', brand, category, department)") + ", 'blue') AND contains(" + PLAIN.format("concat_ws(' ', brand, category, department)") + ", 'bolt') ORDER BY unit_price, product_id LIMIT 20")
def _(t):
    return sv.search(t["products"], "Blüe BOLT").select("product_id", "unit_price")


@query("demo_browse", "SELECT product_id, category, unit_price FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY unit_price, product_id) AS rk FROM products) WHERE rk = 1")
def _(t):
    return sv.browse(t["products"]).select("product_id", "category", "unit_price")


@query("demo_basket_hits", SCORED + """, e AS (SELECT DISTINCT query_id, product_id, 1 AS x FROM target), c AS (SELECT DISTINCT query_id, category, 1 AS y FROM target JOIN products USING (product_id))
SELECT query_id, count(x) AS product_hits, count(y) AS category_hits, count(*) AS n_shown FROM top5 LEFT JOIN e USING (query_id, product_id) LEFT JOIN c USING (query_id, category) GROUP BY 1""")
def _(t):
    w = Window(t)
    return sv.basket_hits(w.top(), w.target, t["products"])


@query("demo_abandoned", "SELECT DISTINCT s.basket_id, e.product_id FROM sevents e JOIN sessions s ON s.session_id = e.session_id WHERE event_type = 'add_to_cart' AND s.basket_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM items i WHERE i.basket_id = s.basket_id AND i.product_id = e.product_id)")
def _(t):
    return sv.abandoned(t["sessions"], t["events"], t["items"])


@query("demo_cart_total", PARTS + " SELECT query_id, count(*) AS n, CAST(sum(CAST(unit_price AS DECIMAL(18,2))) AS DOUBLE) AS total FROM prefix JOIN products USING (product_id) GROUP BY 1")
def _(t):
    return sv.cart_total(Window(t).prefix, t["products"])


@query("demo_basket_selector", QS + " SELECT basket_id, customer_id, basket_day FROM qs WHERE is_known AND prefix_size > 0 ORDER BY basket_day DESC, basket_id LIMIT 20")
def _(t):
    return Window(t).q.where("is_known and prefix_size > 0").orderBy(F.desc("basket_day"), "basket_id").limit(20).select("basket_id", "customer_id", "basket_day")


@query("catalog_slugs", "SELECT product_id, regexp_replace(regexp_replace(" + PLAIN.format("department || ' ' || category") + ", '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM products")
def _(t):
    return t["products"].select("product_id", sv.slugify(F.concat_ws(" ", "department", "category")).alias("slug"))


_CLEAN = "trim(regexp_replace(regexp_replace({}, '[#_]+', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("catalog_product_names", f"""w AS (SELECT product_id, list_aggregate(list_transform(string_split(lower({_CLEAN.format("brand")} || ' ' || {_CLEAN.format("category")}), ' '), lambda x: upper(x[1]) || x[2:]), 'string_agg', ' ') AS name FROM products),
p AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY product_id) AS i, count(*) OVER (PARTITION BY name) AS n FROM w) SELECT product_id, CASE WHEN n > 1 THEN name || ' ' || i ELSE name END AS name FROM p""")
def _(t):
    return sv.product_names(t["products"])


@query("catalog_groups", "g AS (SELECT regexp_replace(regexp_replace(" + PLAIN.format("department || ' ' || category") + ", '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, brand FROM products) SELECT slug, count(*) AS n_products, array_to_string(list_sort(list_distinct(list(brand))), ', ') AS brands FROM g GROUP BY 1")
def _(t):
    return sv.group_table(t["products"])


HASHES = """h AS (SELECT product_id AS id, xor(CAST(concat('0x', substr(md5(CAST(product_id // 3 AS VARCHAR)), 1, 8)) AS BIGINT), CAST(pow(2, product_id % 3) AS BIGINT)) AS hash FROM products)"""


@query("catalog_hash_pairs", HASHES + " SELECT a.id AS a, b.id AS b, CAST(bit_count(xor(a.hash, b.hash)) AS INT) AS distance FROM h a JOIN h b ON a.id < b.id WHERE bit_count(xor(a.hash, b.hash)) <= 8")
def _(t):
    base = F.conv(F.substring(F.md5(F.floor(F.col("product_id") / 3).cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    hashes = t["products"].select(F.col("product_id").alias("id"), base.bitwiseXOR(F.pow(F.lit(2), F.col("product_id") % 3).cast("long")).alias("hash"))
    return sv.hamming_pairs(hashes)


@query("catalog_dhash", """p AS (SELECT product_id, list_transform(range(72), lambda i: (product_id * (i * 7 + 3)) % 251) AS v FROM products),
b AS (SELECT product_id, list_sum(list_transform(range(64), lambda k: CAST(v[k // 8 * 9 + k % 8 + 1] > v[k // 8 * 9 + k % 8 + 2] AS HUGEINT) * CAST(pow(2, 63 - k) AS HUGEINT))) AS h FROM p)
SELECT product_id, CAST(CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END AS BIGINT) AS hash FROM b""")
def _(t):
    pixels = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(71).cast("long")), lambda i: (F.col("product_id") * (i * 7 + 3)) % 251)
    return t["products"].select("product_id", sv.dhash(pixels).alias("hash"))


@query("catalog_merge_credits", "SELECT category AS slug, 'old' AS author FROM (SELECT DISTINCT category FROM products) WHERE category > 'Brand#2' UNION ALL SELECT DISTINCT category, 'new' FROM products WHERE category <= 'Brand#2'")
def _(t):
    names = t["products"].select(F.col("category").alias("slug")).distinct()
    return sv.merge_credits(names.withColumn("author", F.lit("old")), names.where("slug <= 'Brand#2'").withColumn("author", F.lit("new")))


@query("file_point_read", "SELECT basket_id, channel FROM baskets WHERE basket_id = 77")
def _(t):
    return t["baskets"].where("basket_id = 77").select("basket_id", "channel")


@query("file_csv_round_trip", "SELECT CAST(promotion_id AS VARCHAR) AS promotion_id, CAST(product_id AS VARCHAR) AS product_id, promo_type, discount_value, start_date, CASE WHEN product_id % 5 > 0 THEN end_date END AS end_date FROM promotions")
def _(t):
    """Written as CSV, read back with the declared schema; an empty field is null."""
    spark, p = t["promotions"].sparkSession, t["promotions"]
    folder = shared_dir(spark)
    raw = p.select(F.col("promotion_id").cast("string"), F.col("product_id").cast("string"), "promo_type", "discount_value", "start_date", F.when(F.col("product_id") % 5 > 0, F.col("end_date")).alias("end_date"))
    raw.write.option("header", "true").csv(f"{folder}/promotions.csv")
    return files.read_raw(spark, folder, "promotions")


@query("file_processed_round_trip", "SELECT customer_id, city, tier FROM customers WHERE tier = 'gold'")
def _(t):
    """Written in parts by tier, found by path, and read back in one part."""
    spark = t["customers"].sparkSession
    folder = shared_dir(spark)
    files.write_tables({"customers": t["customers"].select("customer_id", "city", "tier")}, folder, {"customers": ["tier"]})
    found = files.resolve(spark, f"{folder}/none", f"{folder}/customers")
    return files.read_tables(spark, found.removesuffix("/customers"), ["customers"])["customers"].where("tier = 'gold'").select("customer_id", "city", "tier")


@query("file_single", "SELECT n_nationkey, n_name, CAST(1 AS BIGINT) AS n_files FROM nation")
def _(t):
    """A small table as one file."""
    spark = t["nations"].sparkSession
    path = shared_dir(spark) + "/one"
    files.write_single(t["nations"].select("n_nationkey", "n_name").repartition(4), path)
    back = spark.read.parquet(path).withColumn("file", F.col("_metadata.file_path"))
    return back.drop("file").crossJoin(F.broadcast(back.agg(F.countDistinct("file").alias("n_files"))))


@query("file_views", "SELECT c.tier, count(*) AS n FROM baskets b JOIN customers c ON c.customer_id = b.customer_id GROUP BY 1")
def _(t):
    """SQL over registered views."""
    files.register_views(t, "retail_")
    return t["baskets"].sparkSession.sql("SELECT c.tier, count(*) AS n FROM retail_baskets b JOIN retail_customers c ON c.customer_id = b.customer_id GROUP BY 1")


@query("file_manifest", """
m AS (SELECT 'customers' AS "table", to_json({'churn_label': churn_label, 'city': city, 'country': country, 'customer_id': customer_id, 'household_size': household_size, 'preferred_channel': preferred_channel, 'signup_date': CAST(signup_date AS VARCHAR), 'tier': tier}) AS j FROM customers
  UNION ALL SELECT 'nations', to_json({'n_name': n_name, 'n_nationkey': n_nationkey, 'n_regionkey': n_regionkey}) FROM nation)
SELECT "table", count(*) AS n_rows, CAST(CAST(sum(CAST(CAST(concat('0x', substr(sha256(CAST(j AS VARCHAR)), 1, 12)) AS BIGINT) AS DECIMAL(38,0))) AS DECIMAL(38,0)) AS VARCHAR) AS digest FROM m GROUP BY 1""")
def _(t):
    return files.manifest({"customers": t["customers"], "nations": t["nations"]})


@query("fixture_defects", f"SELECT customer_id, CASE WHEN {u('customer_id', 'd')} < 0.1 THEN NULL ELSE city END AS city FROM customers")
def _(t):
    return sv.defect(t["customers"], "city", F.lit(None), 0.1, "customer_id", "d").select("customer_id", "city")


@query("step_graph_labels", PAIRS + " SELECT * FROM labels_")
def _(t):
    return steps.retail_graph().run(["labels"], have={"tables": t}, start="lines")["labels"]


@query("fn_uniform", f"SELECT basket_id, {u('basket_id', 's')} AS u FROM baskets")
def _(t):
    return t["baskets"].select("basket_id", fn.uniform("basket_id", "s").alias("u"))


@query("fn_category_need", "SELECT basket_id, product_id, CAST(quantity * CASE WHEN is_promo THEN 2 ELSE 1 END AS DOUBLE) AS need, CASE WHEN quantity >= 20 THEN 1.0::DOUBLE ELSE quantity / 20 END AS weight FROM items")
def _(t):
    return t["items"].select("basket_id", "product_id", fn.category_need_score("quantity", F.col("is_promo").cast("int")).alias("need"), fn.need_weight(F.col("quantity") / 20).alias("weight"))


@query("fn_household_factor", "SELECT customer_id, 1.45::DOUBLE - 0.125::DOUBLE * household_size AS factor FROM customers")
def _(t):
    return t["customers"].select("customer_id", fn.household_factor("household_size").alias("factor"))
