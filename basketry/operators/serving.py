"""Serving and demo slices, catalogue texts and search: the same functions over small or large tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fn import fixed, uniform
from ..functions.ranks import quantiles
from ..shared import forget, saved

# --- one query, the same code as in batch ------------------------------------------------


def one_query(spark, query_id: str, customer_id: int | None, day: str, channel: str, cart: list[int]) -> tuple[DataFrame, DataFrame]:
    """A query of one row and its prefix, for the functions that rank batches."""
    q = spark.createDataFrame([(query_id, customer_id, channel, len(cart))], "query_id string, customer_id long, channel string, prefix_size int")
    q = q.withColumns({"basket_day": F.lit(day).cast("date"), "is_known": F.col("customer_id").isNotNull(), "cut_ts": F.lit(None).cast("timestamp_ntz"), "basket_id": F.lit(None).cast("long")})
    return q, spark.createDataFrame([(query_id, int(p)) for p in cart], "query_id string, product_id long")


#: Parts of the bundle's tables by customer.
BUCKETS = 64


def _bucket(customer: Column) -> Column:
    return F.pmod(F.xxhash64(customer.cast("long")), F.lit(BUCKETS)).cast("int")


def export_bundle(t: dict[str, DataFrame], day: str, folder: str, latent_top: int = 0) -> list[str]:
    """The fitted sources of a day, customers' histories and the dimensions as Parquet, for lookups by key; the names written.

    Histories are partitioned by a bucket of the customer, so that a lookup reads one part.
    """
    from ..sources.files import write_tables
    from . import affinity, candidates, splits

    history = splits.before(t["baskets"], day)
    items = splits.restrict(t["items"], history)
    popular = saved(candidates.popularity(history, items))
    bought = candidates.customer_products(history, items)
    bucket = _bucket(F.col("customer_id"))
    known = history.where("customer_id is not null").withColumn("bucket", bucket)
    tables = {
        "popularity": popular, "category_popularity": candidates.category_popularity(popular, t["products"]),
        "affinity_product": affinity.cooccurrence(affinity.basket_items(items, t["products"], "product"), 2, top=20),
        "affinity_category": affinity.cooccurrence(affinity.basket_items(items, t["products"])),
        "leaders": candidates.category_leaders(history, items, t["products"]), "customer_products": bought.withColumn("bucket", bucket),
        "customer_baskets": known.select("customer_id", "basket_id", "basket_day", "total_amount", "bucket"),
        "customer_lines": t["items"].join(known.select("basket_id", "customer_id", "bucket"), "basket_id").select("customer_id", "basket_id", "product_id", "quantity", "bucket"),
        "products": t["products"], "customers": t["customers"], "promotions": t["promotions"],
    }
    if latent_top:
        found = candidates.fit_latent(bought).recommendForAllUsers(latent_top).select(F.col("customer_id").cast("long").alias("customer_id"), F.posexplode("recommendations").alias("at", "rec"))
        tables["latent"] = found.select("customer_id", F.col("rec.product_id").cast("long").alias("product_id"), F.col("rec.rating").cast("double").alias("als_score"), (F.col("at") + 1).alias("als_rank")).withColumn("bucket", bucket)
    write_tables(tables, folder, {n: ["bucket"] for n, df in tables.items() if "bucket" in df.columns})
    forget(popular)
    return list(tables)


def pool_for(spark, folder: str, customer_id: int | None, day: str, cart: list[int], channel: str = "web") -> tuple[DataFrame, DataFrame]:
    """The candidates of all sources for one cart, by lookups in an exported bundle, and their feature matrix.

    The functions are those that rank batches; a customer's tables are read from one bucket.
    """
    from ..sources.files import exists
    from . import candidates, features

    read = lambda n: spark.read.parquet(f"{folder}/{n}")
    mine = lambda n: read(n).where((F.col("bucket") == _bucket(F.lit(customer_id))) & (F.col("customer_id") == F.lit(customer_id).cast("long"))).drop("bucket")
    q, prefix = one_query(spark, "live", customer_id, day, channel, cart)
    products = read("products")
    past = candidates.asof_history(q, mine("customer_baskets"), mine("customer_lines").drop("customer_id"), products, read("customers"))
    sources = {
        "pop": candidates.from_popularity(q, read("category_popularity")), "aff": candidates.from_product_affinity(prefix, read("affinity_product")),
        "cataff": candidates.from_category_affinity(prefix, products, read("affinity_category"), read("leaders")), "hist": candidates.from_history(past["product"], past["category"], products),
    }
    if exists(spark, f"{folder}/latent"):
        sources["als"] = mine("latent").select(F.lit("live").alias("query_id"), "product_id", "als_score", "als_rank")
    pool = candidates.union_sources(q, candidates.in_cart(prefix), **sources)
    seen = spark.createDataFrame([], "query_id string, product_id long, event_type string, event_ts timestamp_ntz, cut_ts timestamp_ntz")
    return pool, features.build_matrix(pool, q, prefix, past, read("popularity"), products, read("customers"), read("promotions"), seen)


def recommend(spark, folder: str, customer_id: int | None, day: str, cart: list[int], k: int = 5, channel: str = "web", ranker=None) -> DataFrame:
    """``product_id, category, score, rank``: the best candidates for one cart, from an exported bundle.

    ``ranker`` is a fitted model of ``features.FEATURES``, or the folder where ``ranking.save_ranker``
    put one; without it the sources' scores are summed.
    """
    from . import features, ranking

    pool, matrix = pool_for(spark, folder, customer_id, day, cart, channel)
    if isinstance(ranker, str):
        ranker, _ = ranking.load_ranker(spark, ranker, features.FEATURES)
    if ranker is not None:
        scored = ranking.rank_with(ranker, matrix, features.FEATURES)
    else:
        z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
        own = pool.select("query_id", "product_id", "personal_score")
        scored = matrix.join(own, ["query_id", "product_id"]).withColumn("score", fixed(z("pop_score") + z("aff_lift") + z("cataff_lift") + 5 * z("personal_score"), 4))
    return ranking.top_k(scored, k).select("product_id", "category", "score", "rank")


def slice_for(tables: dict[str, DataFrame], customers: DataFrame) -> dict[str, DataFrame]:
    """Tables cut to some customers; those without a customer_id stay whole."""
    chosen = customers.select("customer_id").distinct()
    return {n: df.join(chosen, "customer_id", "left_semi") if "customer_id" in df.columns else df for n, df in tables.items()}


def export_demo_bundle(tables: dict[str, DataFrame], customers: DataFrame, folder: str) -> list[str]:
    """Tables cut to some customers, each as one file, with ``manifest`` (table, n_rows, digest) beside them; the names written."""
    from ..sources.files import manifest, write_single

    cut = slice_for(tables, customers)
    for name, df in cut.items():
        write_single(df, f"{folder}/{name}")
    spark = customers.sparkSession
    write_single(manifest({name: spark.read.parquet(f"{folder}/{name}") for name in cut}), f"{folder}/manifest")
    return [*cut, "manifest"]


# --- demo customers -----------------------------------------------------------------------


def scenarios(customers: DataFrame, risk: str = "p_churn", spend: str = "spend_90", visits: str = "n_90", low: float = 0.25, high: float = 0.75) -> DataFrame:
    """``customer_id, scenario`` by quantiles: risk first, then large spend, frequent, occasional, typical.

    A rule whose quantile doesn't separate (equal to the other one) is off.
    """
    cuts = None
    for c in dict.fromkeys((risk, spend, visits)):
        one = quantiles(customers, c, (low, high), c).toDF(f"{c}_lo", f"{c}_hi")
        cuts = one if cuts is None else cuts.crossJoin(F.broadcast(one))  # one row each
    both = customers.crossJoin(F.broadcast(cuts))
    on = lambda c: F.col(f"{c}_hi") > F.col(f"{c}_lo")
    name = (
        F.when(on(risk) & (F.col(risk) >= F.col(f"{risk}_hi")), "at risk").when(on(spend) & (F.col(spend) >= F.col(f"{spend}_hi")), "large spend")
        .when(on(visits) & (F.col(visits) >= F.col(f"{visits}_hi")), "frequent").when(on(visits) & (F.col(visits) <= F.col(f"{visits}_lo")), "occasional").otherwise("typical")
    )
    return both.select("customer_id", name.alias("scenario"))


def spread_pick(scored: DataFrame, group: str, n: int, key: str = "customer_id") -> DataFrame:
    """About n rows of each group, evenly spaced in the order of the key."""
    w = W.partitionBy(group)
    placed = scored.withColumns({"_i": F.row_number().over(w.orderBy(key)) - 1, "_n": F.count(F.lit(1)).over(w)})
    step = F.greatest(F.floor(F.col("_n") / n), F.lit(1))
    return placed.where((F.col("_i") % step == 0) & (F.col("_i") / step < n)).drop("_i", "_n")


def risk_labels(customers: DataFrame, risk: str = "p_churn", high: float = 0.75) -> DataFrame:
    """``customer_id, risk``: high, medium or low against all others: above a quantile, above the median, below."""
    cuts = quantiles(customers, risk, (0.5, high), "q")
    label = F.when(F.col(risk) >= F.col("q1"), "high").when(F.col(risk) >= F.col("q0"), "medium").otherwise("low")
    return customers.crossJoin(F.broadcast(cuts)).select("customer_id", label.alias("risk"))


# --- explanations -------------------------------------------------------------------------


def explain(pool: DataFrame) -> DataFrame:
    """``reason`` of each candidate: due, bought before, goes with the cart, its category does, liked by similar, popular."""
    reason = (
        F.when(F.col("cat_due") == 1, "due").when(F.col("src_hist") == 1, "bought before").when(F.col("src_aff") == 1, "goes with the cart")
        .when(F.col("src_cataff") == 1, "its category goes with the cart").when(F.col("src_als") == 1, "liked by similar customers").otherwise("popular")
    )
    return pool.withColumn("reason", reason)


def promo_badge(promo_type: Column | str, discount: Column | str) -> Column:
    kind, value = (F.col(c) if isinstance(c, str) else c for c in (promo_type, discount))
    return F.when(kind == "2x1", "2 for 1").when(kind == "discount_pct", F.concat(F.lit("-"), F.round(value * 100).cast("int").cast("string"), F.lit("%"))).when(kind == "coupon", "coupon")


# --- search -------------------------------------------------------------------------------

# fixed values: letters with marks and those without
_MARKED, _PLAIN = "áàâäãåéèêëíìîïóòôöõúùûüñç", "aaaaaaeeeeiiiiooooouuuunc"


def plain(c: Column | str) -> Column:
    """Lower case, without marks, with single spaces."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(F.translate(F.lower(c), _MARKED, _PLAIN), r"\s+", " "))


def search(products: DataFrame, text: str, limit: int = 20, columns: tuple[str, ...] = ("brand", "category", "department")) -> DataFrame:
    """Products that have every word of the text somewhere, marks and case aside; cheapest first."""
    hay, out = plain(F.concat_ws(" ", *columns)), products
    for word in text.split():
        out = out.where(F.contains(hay, plain(F.lit(word))))
    return out.orderBy("unit_price", "product_id").limit(limit)


def browse(products: DataFrame) -> DataFrame:
    """The cheapest product of each category."""
    order = W.partitionBy("category").orderBy("unit_price", "product_id")
    return products.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


# --- catalogue texts ------------------------------------------------------------------------


def slugify(c: Column | str) -> Column:
    """Lower-case words of letters and digits, joined by hyphens."""
    return F.regexp_replace(F.regexp_replace(plain(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def clean_brand(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[#_]+", " "), r"\s+", " "))


def product_names(products: DataFrame) -> DataFrame:
    """``product_id, name``: brand and category; equal names get ordinals by product_id."""
    name = F.initcap(F.concat_ws(" ", clean_brand("brand"), clean_brand("category")))
    w = W.partitionBy("name")
    placed = products.select("product_id", name.alias("name")).withColumns({"i": F.row_number().over(w.orderBy("product_id")), "n": F.count(F.lit(1)).over(w)})
    return placed.select("product_id", F.when(F.col("n") > 1, F.concat_ws(" ", "name", F.col("i").cast("string"))).otherwise(F.col("name")).alias("name"))


def group_table(products: DataFrame) -> DataFrame:
    """``slug, n_products, brands``: visual groups of department and category with their brands, sorted."""
    return products.groupBy(slugify(F.concat_ws(" ", "department", "category")).alias("slug")).agg(F.count(F.lit(1)).alias("n_products"), F.concat_ws(", ", F.array_sort(F.collect_set("brand"))).alias("brands"))


def hamming_pairs(hashes: DataFrame, most: int = 8, bands: int = 16, halves: int = 2) -> DataFrame:
    """``a, b, distance``: 64-bit hashes that differ in at most ``most`` bits.

    Of ``bands`` bands at least ``bands - most`` agree, and so, in one of ``halves`` parts of the bands,
    ``ceil((bands - most) / halves)``: every choice of so many bands of a part is a key of an
    equi-join, and no pair is missed. At the defaults these are 140 keys of 16 bits a hash, which a
    random pair shares with a chance of one in 470. The pairs that share keys are counted first (a job):
    where bits hardly vary they are more than a twentieth of all pairs, and all are compared instead,
    once each, by tiles.
    """
    if bands <= most or 64 % bands or bands % halves:
        raise ValueError("bands must divide 64, be above most, and divide into parts")
    width, size = 64 // bands, bands // halves
    need = -(-(bands - most) // halves)
    masks = []
    for part in range(halves):
        for chosen in combinations(range(part * size, (part + 1) * size), need):
            mask = sum(((1 << width) - 1) << (band * width) for band in chosen)
            masks.append(mask - (1 << 64) if mask >> 63 else mask)
    keys = F.transform(F.lit(masks).cast("array<bigint>"), lambda m, i: F.struct(i.alias("i"), F.col("hash").bitwiseAND(m).alias("v")))
    each = hashes.select("id", "hash", F.explode(keys).alias("k"))
    met = each.groupBy("k").agg(F.count(F.lit(1)).cast("double").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"), F.sum(F.when(F.col("k.i") == 0, F.col("n"))).alias("n")).first()
    n = met["n"] or 0.0
    if met["pairs"] and met["pairs"] > n * (n - 1) / 40:
        return _all_pairs(hashes, int(n), most)
    left, right = each.toDF("a", "ha", "k"), each.toDF("b", "hb", "k")
    d = F.bit_count(F.col("ha").bitwiseXOR(F.col("hb")))
    return left.join(right, "k").where("a < b").select("a", "b", d.alias("distance")).where(F.col("distance") <= most).distinct()


def _all_pairs(hashes: DataFrame, n: int, most: int, rows: int = 4096, tiles: int = 64) -> DataFrame:
    """``a, b, distance`` by comparing all pairs: rows are dealt into tiles, and every two tiles meet in one place."""
    count = max(1, min(tiles, -(-n // rows)))
    parts = max(1, min(count * (count + 1) // 2, 4 * int(hashes.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    t = F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")
    left = hashes.select(F.col("id").alias("x"), F.col("hash").alias("hx"), t.alias("i"), F.explode(F.sequence(t, F.lit(count - 1))).alias("j")).repartition(parts, "i", "j")
    right = hashes.select(F.col("id").alias("y"), F.col("hash").alias("hy"), t.alias("j"), F.explode(F.sequence(F.lit(0), t)).alias("i")).repartition(parts, "i", "j")
    d = F.bit_count(F.col("hx").bitwiseXOR(F.col("hy")))
    near = left.join(right, ["i", "j"]).where((d <= most) & ((F.col("i") < F.col("j")) | (F.col("x") < F.col("y"))))
    return near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), d.alias("distance"))


def dhash(pixels: Column | str, size: int = 8) -> Column:
    """The hash of a grey picture of ``size`` rows and ``size + 1`` columns, as one list: whether each pixel is lighter than the next."""
    pixels = F.col(pixels) if isinstance(pixels, str) else pixels
    places = [r * (size + 1) + c for r in range(size) for c in range(size)]
    bits = F.transform(F.lit(places), lambda i: (F.get(pixels, i) > F.get(pixels, i + 1)).cast("long"))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b))


# fixed values: words of a photo's description that bar it, and what others are worth
BARRED = (
    "woman women man men person people girl boy child children kid kids toddler infant newborn mother father parent family portrait model smiling hand hands holding chef cook cooking waiter barista "
    "shopper customer female females male males anonymous crop torso lying sitting standing wearing laughing cute adorable playing sleeping feet foot legs arms face fingers skin"
).split()
WORTH = {
    1.2: "white background isolated studio closeup close-up product packaging container bottle jar can pack package".split(),
    -1.0: "restaurant kitchen cafe bar dining table plate served meal recipe farm field garden market supermarket shelf store aisle picnic party christmas street urban graffiti outdoor sidewalk wall".split(),
    -0.8: "with alongside surrounded accompanied arrangement flatlay rustic cozy decorated festive aesthetic artistic vintage stacked composition".split(),
    -1.5: "mockup blank plain unlabeled unbranded template".split(),
}


def photo_score(photos: DataFrame) -> DataFrame:
    """``photo_id, score`` of photos that may show a product: bright ones, in words of a studio, not too long or wide.

    ``photos``: photo_id, alt, avg_color (#RRGGBB), width, height. Barred ones are left out; an
    unknown colour counts as middling, an unknown size as 1.
    """
    words = F.array_distinct(F.split(F.trim(F.regexp_replace(F.lower(F.coalesce("alt", F.lit(""))), r"[\s,-]+", " ")), " "))
    shade = lambda at: F.conv(F.substring("avg_color", at, 2), 16, 10).cast("double")
    bright = F.when(F.col("avg_color").rlike("^#[0-9A-Fa-f]{6}$"), (0.299 * shade(2) + 0.587 * shade(4) + 0.114 * shade(6)) / 255).otherwise(0.5)
    w, h = (F.when(F.col(c) > 0, F.col(c)).otherwise(1) for c in ("width", "height"))
    score = 3.0 * bright - F.least(F.greatest(w, h) / F.least(w, h) - 1, F.lit(2.0))
    for worth, names in WORTH.items():
        score = score + worth * F.size(F.array_intersect("words", F.lit(names)))
    return photos.withColumn("words", words).where(~F.arrays_overlap("words", F.lit(BARRED))).select("photo_id", fixed(score, 3).alias("score"))


def merge_credits(old: DataFrame, new: DataFrame, key: str = "slug") -> DataFrame:
    """Old rows that aren't replaced, and the new ones."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


# --- demo baskets ---------------------------------------------------------------------------


def basket_hits(top: DataFrame, target: DataFrame, products: DataFrame) -> DataFrame:
    """``query_id, product_hits, category_hits, n_shown`` at two levels."""
    wanted = target.join(products.select("product_id", "category"), "product_id")
    exact = target.select("query_id", "product_id").distinct().withColumn("x", F.lit(1))
    cats = wanted.select("query_id", "category").distinct().withColumn("y", F.lit(1))
    both = top.join(exact, ["query_id", "product_id"], "left").join(cats, ["query_id", "category"], "left")
    return both.groupBy("query_id").agg(F.count("x").alias("product_hits"), F.count("y").alias("category_hits"), F.count(F.lit(1)).alias("n_shown"))


def abandoned(sessions: DataFrame, events: DataFrame, items: DataFrame) -> DataFrame:
    """``basket_id, product_id`` put in the cart of a converted session and not bought."""
    sold = sessions.where("basket_id is not null").select("session_id", "basket_id")
    added = events.where("event_type = 'add_to_cart'").join(sold, "session_id").select("basket_id", "product_id").distinct()
    return added.join(items.select("basket_id", "product_id").distinct(), ["basket_id", "product_id"], "left_anti")


def cart_total(cart: DataFrame, products: DataFrame) -> DataFrame:
    """``query_id, n, total`` of carts at list prices."""
    return cart.join(products.select("product_id", "unit_price"), "product_id").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("unit_price").cast("decimal(18,2)")).cast("double").alias("total")
    )


def defect(df: DataFrame, column: str, value: Column, rate: float, key: str, salt: str) -> DataFrame:
    """``column`` replaced by ``value`` in a fixed share of rows, by a hash of the key: fixtures with known defects."""
    return df.withColumn(column, F.when(uniform(key, salt) < rate, value).otherwise(F.col(column)))


def mean_hits(precision: Column | str, k: int) -> Column:
    return fixed((F.col(precision) if isinstance(precision, str) else precision) * k, 4)

