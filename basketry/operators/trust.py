"""Data trust score: checks in five dimensions as a long table, and their summary."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fn import count_if, fixed
from .cleaning import canonical_spelling, normalized

DIMENSIONS = ("completeness", "uniqueness", "validity", "consistency", "integrity")
#: Least scores of the grades; below the last one it is E.
GRADES = ((97.0, "A"), (93.0, "B"), (85.0, "C"), (75.0, "D"))
#: By (dimension, name) what fails; with a scope in front, the rows that count at all.
Checks = dict[tuple[str, str], Column | tuple[Column, Column]]


def row_checks(table: str, df: DataFrame, failing: Checks) -> DataFrame:
    """One pass for any number of predicates by (dimension, name); null doesn't fail.

    A predicate may come with a scope: then only rows of the scope are counted.
    """
    counts = []
    for (d, n), p in failing.items():
        scope, bad = p if isinstance(p, tuple) else (F.lit(True), p)
        counts.append(F.struct(F.lit(d).alias("dimension"), F.lit(n).alias("name"), F.coalesce(count_if(scope), F.lit(0)).alias("rows_total"), F.coalesce(count_if(scope & bad), F.lit(0)).alias("rows_failed")))
    return df.agg(F.array(*counts).alias("checks")).select(F.lit(table).alias("table"), F.inline("checks"))


def required(columns: Iterable[str]) -> Checks:
    """Completeness predicates of columns."""
    return {("completeness", f"{c} present"): F.col(c).isNull() for c in columns}


def outside(column: str, domain: Iterable) -> Column:
    """Not null and not in the domain."""
    return F.col(column).isNotNull() & ~F.col(column).isin(*domain)


def _one(table: str, dimension: str, name: str, counts: DataFrame) -> DataFrame:
    return counts.select(F.lit(table).alias("table"), F.lit(dimension).alias("dimension"), F.lit(name).alias("name"), "rows_total", "rows_failed")


def unique_check(table: str, df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows beyond the distinct keys; without keys, beyond the distinct rows."""
    groups = df.groupBy(*(keys or df.columns)).agg(F.count(F.lit(1)).alias("n"))
    counts = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows_total"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("rows_failed"))
    return _one(table, "uniqueness", " + ".join(keys) + " unique" if keys else "no repeated rows", counts)


def unique_rows_and_keys(table: str, df: DataFrame, keys: list[str]) -> DataFrame:
    """Both checks in one pass: distinct rows first, and of those distinct keys."""
    rows = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    found = rows.groupBy(*keys).agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("rows"))
    sums = found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("keys"))
    one = lambda name, left: F.struct(F.lit(name).alias("name"), F.col("n").alias("rows_total"), (F.col("n") - F.col(left)).alias("rows_failed"))
    both = sums.select(F.inline(F.array(one("no repeated rows", "rows"), one(" + ".join(keys) + " unique", "keys"))))
    return both.select(F.lit(table).alias("table"), F.lit("uniqueness").alias("dimension"), "name", "rows_total", "rows_failed")


def foreign_key_check(table: str, df: DataFrame, column: str, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in the other table, of those that have one: counts by key, then one join of distinct keys."""
    keys = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    known = other.select(F.col(key).alias("k"), F.lit(True).alias("known")).distinct()
    counts = keys.join(known, "k", "left").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows_total"), F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n")).otherwise(0)), F.lit(0)).alias("rows_failed"))
    return _one(table, "integrity", f"{column} known", counts)


def _flagged(df: DataFrame, column: str, other: DataFrame, key: str) -> DataFrame:
    """``df`` with ``known_<column>``: null where the other table hasn't got the key."""
    return df.join(other.select(F.col(key).alias(column), F.lit(True).alias(f"known_{column}")).distinct(), column, "left")


def known(*names: str) -> Checks:
    """Integrity predicates of flagged columns, over the rows that have a key."""
    return {("integrity", f"{n} known"): (F.col(n).isNotNull(), F.col(f"known_{n}").isNull()) for n in names}


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# fixed values: the closed domains, and the columns that must not be null
TIERS, CHANNELS, DEVICES, PROMOS, EVENTS = ("bronze", "silver", "gold"), ("app", "web", "store"), ("mobile", "desktop", "tablet"), ("2x1", "discount_pct", "coupon"), ("view", "add_to_cart")
REQUIRED = {
    "customers": ("customer_id", "signup_date", "country", "city", "household_size", "tier", "preferred_channel", "churn_label"),
    "products": ("product_id", "department", "category", "brand", "private_label", "perishable", "unit_price", "pack_size", "typical_days"),
    "promotions": ("promotion_id", "product_id", "promo_type", "discount_value", "start_date", "end_date"),
    "baskets": ("basket_id", "channel", "basket_ts", "total_amount"), "items": ("basket_id", "product_id", "quantity", "unit_price_paid"),
    "sessions": ("session_id", "session_ts", "device", "converted"), "events": ("session_id", "product_id", "event_type", "event_ts"),
}


def _customers(t: dict[str, DataFrame]) -> list[DataFrame]:
    c, baskets = F.col, t["baskets"]
    first = baskets.where("customer_id is not null").groupBy("customer_id").agg(F.min("basket_day").alias("first_day"))
    full = t["customers"].join(first, "customer_id", "left").crossJoin(F.broadcast(baskets.agg(F.max("basket_day").alias("last_day"))))
    return [row_checks("customers", full, required(REQUIRED["customers"]) | {
        ("validity", "household 1 to 6"): ~c("household_size").between(1, 6), ("validity", "tier known"): outside("tier", TIERS), ("validity", "preferred channel known"): outside("preferred_channel", CHANNELS),
        ("consistency", "signup before first purchase"): c("signup_date") > c("first_day"), ("consistency", "signup within the period"): c("signup_date") > c("last_day"),
    }), unique_check("customers", t["customers"], ["customer_id"])]


def _products(t: dict[str, DataFrame]) -> list[DataFrame]:
    c = F.col
    full = t["products"].withColumn("norm", normalized("category")).join(canonical_spelling(t["products"]), "norm", "left")
    return [row_checks("products", full, required(REQUIRED["products"]) | {
        ("validity", "category spelt as usual"): c("category") != c("canonical"), ("validity", "price positive"): c("unit_price") <= 0, ("validity", "pack size positive"): c("pack_size") <= 0, ("validity", "typical days positive"): c("typical_days") <= 0,
    }), unique_check("products", t["products"], ["product_id"])]


def _promotions(t: dict[str, DataFrame]) -> list[DataFrame]:
    c = F.col
    return [row_checks("promotions", _flagged(t["promotions"], "product_id", t["products"], "product_id"), required(REQUIRED["promotions"]) | known("product_id") | {
        ("validity", "type known"): outside("promo_type", PROMOS), ("validity", "discount positive"): c("discount_value") <= 0, ("validity", "range in order"): c("end_date") < c("start_date"),
    }), unique_check("promotions", t["promotions"], ["promotion_id"])]


def _baskets(t: dict[str, DataFrame]) -> list[DataFrame]:
    c = F.col
    sums = t["items"].groupBy("basket_id").agg(F.sum((c("quantity") * c("unit_price_paid")).cast("decimal(18,2)")).cast("double").alias("lines"))
    full = _flagged(t["baskets"].join(sums, "basket_id", "left"), "customer_id", t["customers"], "customer_id")
    return [row_checks("baskets", full, required(REQUIRED["baskets"]) | known("customer_id") | {
        ("validity", "channel known"): outside("channel", CHANNELS), ("validity", "total positive"): c("total_amount") <= 0,
        ("consistency", "store iff channel"): (c("channel") == "store") != c("store_id").isNotNull(), ("consistency", "header is sum of lines"): F.abs(c("total_amount") - F.coalesce("lines", F.lit(0.0))) > 0.01,
    }), unique_check("baskets", t["baskets"], ["basket_id"])]


def _items(t: dict[str, DataFrame]) -> list[DataFrame]:
    c = F.col
    days = t["baskets"].groupBy("basket_id").agg(F.min("basket_day").alias("day"), F.lit(True).alias("known_basket_id"))
    ranges = t["promotions"].groupBy("promotion_id").agg(F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"), F.lit(True).alias("known_promotion_id"))
    full = _flagged(t["items"].join(days, "basket_id", "left").join(ranges, "promotion_id", "left"), "product_id", t["products"], "product_id")
    both = c("known_promotion_id").isNotNull() & c("known_basket_id").isNotNull()
    return [row_checks("items", full, required(REQUIRED["items"]) | known("basket_id", "product_id", "promotion_id") | {
        ("validity", "quantity positive"): c("quantity") <= 0, ("validity", "price paid positive"): c("unit_price_paid") <= 0,
        ("consistency", "promotion active on day"): (both, ~c("day").between(c("start_date"), c("end_date"))),
    }), unique_rows_and_keys("items", t["items"], ["basket_id", "product_id"])]


def _sessions(t: dict[str, DataFrame]) -> list[DataFrame]:
    full = _flagged(_flagged(t["sessions"], "basket_id", t["baskets"], "basket_id"), "customer_id", t["customers"], "customer_id")
    return [row_checks("sessions", full, required(REQUIRED["sessions"]) | known("customer_id", "basket_id") | {
        ("validity", "device known"): outside("device", DEVICES), ("consistency", "converted iff basket"): F.col("converted") != F.col("basket_id").isNotNull(),
    }), unique_check("sessions", t["sessions"], ["session_id"])]


def _events(t: dict[str, DataFrame]) -> list[DataFrame]:
    began = t["sessions"].groupBy("session_id").agg(F.min("session_ts").alias("session_ts"), F.lit(True).alias("known_session_id"))
    full = _flagged(t["events"].join(began, "session_id", "left"), "product_id", t["products"], "product_id")
    return [row_checks("events", full, required(REQUIRED["events"]) | known("session_id", "product_id") | {
        ("validity", "type known"): outside("event_type", EVENTS), ("consistency", "event after session start"): F.col("event_ts") < F.col("session_ts"),
    }), unique_check("events", t["events"])]


RETAIL = {"customers": _customers, "products": _products, "promotions": _promotions, "baskets": _baskets, "items": _items, "sessions": _sessions, "events": _events}


def retail_checks(t: dict[str, DataFrame], only_tables: Iterable[str] | None = None) -> DataFrame:
    """``table, dimension, name, rows_total, rows_failed`` of all 79 checks on the seven retail tables, or of those on some.

    A table's own rules, its keys to others and what it must agree with come from one pass over it,
    joined with the keys of the others; uniqueness takes another.
    """
    if missing := set(RETAIL) - set(t):
        raise KeyError(f"missing tables: {sorted(missing)}")
    names = list(RETAIL if only_tables is None else only_tables)
    if unknown := set(names) - set(RETAIL):
        raise KeyError(f"no such tables: {sorted(unknown)}")
    return union([part for n in names for part in RETAIL[n](t)])


def dimension_detail(checks: DataFrame) -> DataFrame:
    """``dimension, n_checks, n_failing, row_score, check_score, score``: half by rows, half by flawless checks.

    An empty table passes; a dimension without checks scores 100.
    """
    rate = F.when(F.col("rows_total") > 0, 1 - F.col("rows_failed") / F.col("rows_total")).otherwise(1.0)
    known = checks.groupBy("dimension").agg(
        F.count(F.lit(1)).alias("n_checks"), count_if(F.col("rows_failed") > 0).alias("n_failing"), (F.avg(rate) * 100).alias("row_score"), (F.avg((F.col("rows_failed") == 0).cast("double")) * 100).alias("check_score")
    )
    every = checks.sparkSession.createDataFrame([(d,) for d in DIMENSIONS], "dimension string")
    return F.broadcast(every).join(known, "dimension", "left").select(
        "dimension", F.coalesce("n_checks", F.lit(0)).alias("n_checks"), F.coalesce("n_failing", F.lit(0)).alias("n_failing"),
        fixed(F.coalesce("row_score", F.lit(100.0)), 4).alias("row_score"), fixed(F.coalesce("check_score", F.lit(100.0)), 4).alias("check_score"),
        fixed(F.coalesce("row_score", F.lit(100.0)) * 0.5 + F.coalesce("check_score", F.lit(100.0)) * 0.5, 2).alias("score"),
    )


def trust_score(checks: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """One row ``score, grade``: the weighted mean of the dimensions (0.2 each unless given)."""
    weights = weights or dict.fromkeys(DIMENSIONS, 1 / len(DIMENSIONS))
    if unknown := set(weights) - set(DIMENSIONS):
        raise KeyError(f"no such dimensions: {sorted(unknown)}")
    weight = F.create_map(*[x for d, w in weights.items() for x in (F.lit(d), F.lit(float(w)))])
    total = dimension_detail(checks).agg((F.sum(F.col("score") * F.coalesce(weight[F.col("dimension")], F.lit(0.0))) / sum(weights.values())).alias("s"))
    grade = F.lit("E")
    for least, name in reversed(GRADES):
        grade = F.when(F.col("score") >= least, name).otherwise(grade)
    return total.select(fixed("s", 2).alias("score")).withColumn("grade", grade)


def referential_integrity(relations: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Per relation (name, child, column, parent, key): rows, null keys, distinct keys, orphans, match % over informed keys."""

    def one(name, child, column, parent, key):
        keys = child.groupBy(F.col(column).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        known = parent.select(F.col(key).alias("k"), F.lit(True).alias("known")).distinct()
        informed, orphan = F.col("k").isNotNull(), F.col("k").isNotNull() & F.col("known").isNull()
        add = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n")).otherwise(0)), F.lit(0))
        return keys.join(known, "k", "left").agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), add(~informed).alias("n_null"), count_if(informed).alias("n_keys"), add(orphan).alias("n_orphans"),
            fixed(F.when(add(informed) > 0, 100 * (add(informed) - add(orphan)) / add(informed)), 4).alias("match_pct"),
        ).select(F.lit(name).alias("relation"), "n_rows", "n_null", "n_keys", "n_orphans", "match_pct")

    return union([one(*r) for r in relations])
