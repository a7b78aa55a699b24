"""The feature matrix of query and candidate pairs; each family is a small table joined once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fn import fixed, ratio

CHANNELS, TIERS = ("app", "store", "web"), ("bronze", "silver", "gold")


def code(c: Column | str, domain: tuple[str, ...]) -> Column:
    """The place of a value in a closed domain; unknown ones get its size."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.lit(len(domain))
    for i, value in enumerate(domain):
        out = F.when(c == value, i).otherwise(out)
    return out


def events_before_cut(q: DataFrame, sessions: DataFrame, events: DataFrame) -> DataFrame:
    """``query_id, product_id, event_type, event_ts, cut_ts``: a session's events up to the cut, and nothing later."""
    of = sessions.where("basket_id is not null").select("session_id", "basket_id")
    cut = q.where("cut_ts is not null").select("query_id", "basket_id", "cut_ts").join(of, "basket_id")
    return cut.join(events, "session_id").where("event_ts <= cut_ts").select("query_id", "product_id", "event_type", "event_ts", "cut_ts")


def session_cart(seen: DataFrame) -> DataFrame:
    return seen.where("event_type = 'add_to_cart'").select("query_id", "product_id").distinct()


def session_features(seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per query and product: views and seconds since the last; per query: events."""
    product = seen.where("event_type = 'view'").groupBy("query_id", "product_id", "cut_ts").agg(F.count(F.lit(1)).alias("n_views"), F.max("event_ts").alias("last")).select(
        "query_id", "product_id", "n_views", (F.unix_timestamp("cut_ts") - F.unix_timestamp("last")).alias("view_age_s")
    )
    return product, seen.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_events"))


def cart_features(prefix: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per query and category in the cart; per query and department, with its share of the cart; per query, the cart's size."""
    full = prefix.select("query_id", "product_id").distinct().join(products.select("product_id", "category", "department"), "product_id")
    return (
        full.select("query_id", "category").distinct().withColumn("cat_in_cart", F.lit(1)),
        full.groupBy("query_id", "department").agg(F.count(F.lit(1)).alias("dep_in_cart")).withColumn("dep_share", fixed(ratio("dep_in_cart", F.sum("dep_in_cart").over(W.partitionBy("query_id"))), 6)),
        full.groupBy("query_id").agg(F.count(F.lit(1)).alias("cart_size")),
    )


def with_relevance(pairs: DataFrame, target: DataFrame, products: DataFrame) -> DataFrame:
    """``relevance``: 2 for a product still to come, 1 for another of its category, else 0; ``label`` is 1 for 2.

    ``pairs`` has a ``category``.
    """
    exact = target.select("query_id", "product_id").distinct().withColumn("_exact", F.lit(1))
    same = target.join(products.select("product_id", "category"), "product_id").select("query_id", "category").distinct().withColumn("_same", F.lit(1))
    both = pairs.join(exact, ["query_id", "product_id"], "left").join(same, ["query_id", "category"], "left")
    return both.withColumns({"relevance": F.when(F.col("_exact") == 1, 2).when(F.col("_same") == 1, 1).otherwise(0), "label": F.coalesce("_exact", F.lit(0))}).drop("_exact", "_same")


def active_discount(q: DataFrame, promotions: DataFrame) -> DataFrame:
    """``basket_day, product_id, promo_discount``: the largest discount active on each query day.

    Ranges are turned into days, so that the range join is an equi-join.
    """
    valid = promotions.where("end_date >= start_date").select("product_id", "discount_value", F.explode(F.sequence("start_date", "end_date")).alias("basket_day"))
    return valid.join(q.select("basket_day").distinct(), "basket_day", "left_semi").groupBy("basket_day", "product_id").agg(F.max("discount_value").alias("promo_discount"))


def index_products(products: DataFrame) -> DataFrame:
    """``products`` with ``department_idx`` and ``category_idx``, alphabetical numbers from 0."""
    names = products.agg(*[F.array_sort(F.collect_set(c)).alias(f"_{c}") for c in ("department", "category")])  # closed domains
    place = lambda c: (F.array_position(F.col(f"_{c}"), F.col(c)) - 1).cast("int")
    return products.crossJoin(F.broadcast(names)).withColumns({"department_idx": place("department"), "category_idx": place("category")}).drop("_department", "_category")


#: The contract of the matrix: its features, by family.
FAMILIES: dict[str, tuple[str, ...]] = {
    "source": (
        "pop_score", "pop_rank", "aff_lift", "aff_confidence", "aff_support", "cataff_lift", "cataff_confidence", "hist_rank", "als_score", "als_rank",
        "src_pop", "src_aff", "src_cataff", "src_hist", "src_als", "n_sources",
    ),
    "pair": ("n_times", "n_units", "days_since", "ever_bought"),
    "category": ("cat_n_days", "cat_days_since", "cat_expected", "cat_overdue", "cat_due", "cat_freq_rank", "cat_share", "cat_need_rank"),
    "product": ("pop_all", "pop_recent", "season_index", "month_rank", "unit_price", "pack_size", "typical_days", "private_label", "perishable", "department_idx", "category_idx"),
    "context": (
        "prefix_size", "month", "weekday", "channel_code", "is_known", "n_baskets", "recency", "avg_ticket", "n_products", "household_size", "tier_code", "on_promo", "promo_discount",
    ),
    "session": ("has_session", "viewed", "n_views", "view_age_s", "n_events"),
    "cart": ("cat_in_cart", "dep_in_cart", "dep_share"),
}
FEATURES = tuple(f for family in FAMILIES.values() for f in family)
#: 0 where nothing is known: never bought, not on offer, not seen. All others stay null.
ZERO = frozenset(
    ("n_times", "n_units", "cat_n_days", "cat_due", "cat_share", "promo_discount", "n_views", "n_events", "n_sources", "n_baskets", "n_products", "src_pop", "src_aff", "src_cataff", "src_hist", "src_als", *FAMILIES["cart"])
)


#: What ``product_details`` has of a product, and of a product in a month.
OWN = tuple(f for f in FAMILIES["product"] if f not in ("pop_all", "pop_recent", "season_index", "month_rank"))
SHELF = ("pop_all", "pop_recent", "season_index", "month_rank")
#: The maps of ``query_head``: name, key, and the features found there.
MAPS = (
    ("_bought", "product_id", ("n_times", "n_units", "days_since")), ("_seen", "product_id", ("n_views", "view_age_s")),
    ("_ranked", "category", ("cat_n_days", "cat_days_since", "cat_expected", "cat_overdue", "cat_due", "cat_share", "cat_freq_rank", "cat_need_rank", "cat_in_cart")), ("_shelves", "department", ("dep_in_cart", "dep_share")),
)


def _doubles(names) -> Column:
    return F.array(*[F.col(c).cast("double") for c in names])


def _entries(key: str, values: Column) -> Column:
    """The rows of a group as a map."""
    return F.map_from_entries(F.collect_list(F.struct(F.col(key), values)))


def product_details(q: DataFrame, popular: DataFrame, products: DataFrame, promotions: DataFrame) -> DataFrame:
    """``product_id, about``: its category and department, ``OWN``, ``SHELF`` by month and discounts by day, for the months and days of the queries.

    Numbers are lists of doubles: generated code ends at rows of more than a hundred fields, nested ones included.
    """
    months = q.select(F.month("basket_day").alias("month")).distinct()  # twelve at most
    places = popular.join(F.broadcast(months), "month", "left_semi").select("product_id", "month", "pop_all", F.col("recent").alias("pop_recent"), F.col("index").alias("season_index"), F.col("rank").alias("month_rank"))
    shelf = places.groupBy("product_id").agg(_entries("month", _doubles(SHELF)).alias("shelf"))
    promos = active_discount(q, promotions).groupBy("product_id").agg(_entries("basket_day", F.col("promo_discount")).alias("promos"))
    full = index_products(products).join(shelf, "product_id", "left").join(promos, "product_id", "left")
    return full.select("product_id", F.struct("category", "department", _doubles(OWN).alias("own"), "shelf", "promos").alias("about"))


def query_head(q: DataFrame, prefix: DataFrame, history: dict[str, DataFrame], products: DataFrame, customers: DataFrame, seen: DataFrame, target: DataFrame | None = None) -> DataFrame:
    """A row a query: its own features, and what is known of it by product, category or department as maps to lists of doubles."""
    from .candidates import with_category_ranks

    categories, departments, _ = cart_features(prefix, products)
    views, activity = session_features(seen)
    ranked = with_category_ranks(history["category"], history["customer"]).select(
        "query_id", "category", F.col("n_days").alias("cat_n_days"), F.col("days_since").alias("cat_days_since"), F.col("expected_days").alias("cat_expected"),
        F.col("overdue_ratio").alias("cat_overdue"), F.col("due").alias("cat_due"), F.col("share").alias("cat_share"), F.col("freq_rank").alias("cat_freq_rank"), F.col("need_rank").alias("cat_need_rank"),
    ).join(categories, ["query_id", "category"], "full_outer")
    head = q.select("query_id", "customer_id", "basket_day", "channel", "is_known", "prefix_size", F.col("cut_ts").isNotNull().alias("has_session"), F.month("basket_day").alias("month"))
    head = head.join(customers.select("customer_id", "household_size", "tier"), "customer_id", "left").drop("customer_id")
    head = head.join(history["customer"].select("query_id", "n_baskets", "recency", "avg_ticket", "n_products"), "query_id", "left").join(activity, "query_id", "left")
    for (name, key, values), table in zip(MAPS, (history["product"], views, ranked, departments), strict=True):
        known = table.where(F.col(key).isNotNull()).groupBy("query_id").agg(_entries(key, _doubles(values)).alias(name))
        head = head.join(known, "query_id", "left")
    if target is not None:
        wanted = target.join(products.select("product_id", "category"), "product_id", "left")
        head = head.join(wanted.groupBy("query_id").agg(F.collect_set("product_id").alias("_targets"), F.collect_set("category").alias("_wanted")), "query_id", "left")
    return head


def _projected(pairs: DataFrame) -> DataFrame:
    """The matrix from pairs that have the columns of ``query_head`` and ``about``; without a shuffle."""
    full = pairs.withColumns({"category": F.col("about")["category"], "department": F.col("about")["department"], "_own_f": F.col("about")["own"]})
    full = full.withColumns({"_shelf": F.try_element_at(F.col("about")["shelf"], F.col("month")), "promo_discount": F.try_element_at(F.col("about")["promos"], F.col("basket_day"))})
    full = full.withColumns({f"{name}_v": F.try_element_at(name, F.col(key)) for name, key, _ in MAPS})
    found = {v: F.get(f"{name}_v", F.lit(i)) for name, _, values in MAPS for i, v in enumerate(values)}
    found |= {f: F.get("_shelf", F.lit(i)) for i, f in enumerate(SHELF)} | {f: F.get("_own_f", F.lit(i)) for i, f in enumerate(OWN)}
    full = full.withColumns(found)
    known = lambda c: F.col(c).isNotNull()
    made = {
        "weekday": F.dayofweek("basket_day"), "channel_code": code("channel", CHANNELS), "tier_code": code("tier", TIERS), "on_promo": known("promo_discount"), "ever_bought": known("n_times"), "viewed": known("n_views"),
    } | {f: F.lit(None) for f in FAMILIES["source"] if f not in pairs.columns}
    full = full.withColumns(made)
    # a lambda has no generated code: it keeps this wide projection out of the loop over candidates, whose method would be too long to be compiled
    full = full.withColumn("promo_discount", F.get(F.transform(F.array("promo_discount"), lambda d: d), F.lit(0)))
    value = lambda f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) if f in ZERO else F.col(f).cast("double")
    labels = []
    if "_targets" in pairs.columns:
        exact, same = F.array_contains("_targets", F.col("product_id")), F.array_contains("_wanted", F.col("category"))
        labels = [F.when(exact, 2).when(same, 1).otherwise(0).alias("relevance"), F.when(exact, 1).otherwise(0).alias("label")]
    labels += [c for c in ("is_validation",) if c in pairs.columns]
    return full.select("query_id", "product_id", "category", *[value(f).alias(f) for f in FEATURES], *labels)


def build_matrix(
    pool: DataFrame, q: DataFrame, prefix: DataFrame, history: dict[str, DataFrame], popular: DataFrame, products: DataFrame, customers: DataFrame, promotions: DataFrame, seen: DataFrame
) -> DataFrame:
    """``query_id, product_id, category`` and all ``FEATURES`` as double, in one projection.

    Sources that ``pool`` hasn't got are silent. ``popular`` is what ``candidates.popularity`` gives.
    """
    pairs = pool.join(product_details(q, popular, products, promotions), "product_id")
    return _projected(pairs.join(query_head(q, prefix, history, products, customers, seen), "query_id"))


def matrix_from(sources: dict[str, DataFrame], cart: DataFrame, head: DataFrame, about: DataFrame) -> DataFrame:
    """``build_matrix`` of the pool that ``candidates.union_sources`` makes of the sources, dealt out of one row a query.

    ``head`` is what ``query_head`` gives, ``about`` what ``product_details`` does: the latter is joined to the rows
    of the sources, so that pairs are made last and never shuffled. A head with targets gives ``relevance`` and
    ``label`` too, as ``with_relevance`` does; ``is_validation`` stays if a head has it.
    """
    from .candidates import union_sources

    keep = tuple(c for c in head.columns if c != "query_id")
    return _projected(union_sources(head, cart, lambda rows: rows.join(about, "product_id"), keep, **sources))
