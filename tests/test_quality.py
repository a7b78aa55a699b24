import pytest

from basketry.operators import affinity, cleaning, segments, trust

from . import helpers as h


def test_affinity_of_ten_baskets(spark):
    """A in 6, B in 8, C in 2 of 10 baskets; A&B in 4, B&C in 2, A&C in none."""
    sets = {1: "AB", 2: "AB", 3: "AB", 4: "AB", 5: "A", 6: "A", 7: "BC", 8: "BC", 9: "B", 10: "B"}
    df = spark.createDataFrame([(b, x) for b, s in sets.items() for x in s], "basket_id long, item string")
    got = {(r["antecedent"], r["consequent"]): r for r in affinity.cooccurrence(df, 1).collect()}
    ab, ba = got["A", "B"], got["B", "A"]
    assert (ab["support"], ab["confidence"], ab["lift"], ab["jaccard"]) == (0.4, 0.666667, 0.8333, 0.4)
    assert ba["confidence"] == 0.5 and ba["lift"] == ab["lift"] and ("A", "C") not in got
    assert ("B", "C") not in {(r[0], r[1]) for r in affinity.cooccurrence(df, 3).collect()}
    top = affinity.cooccurrence(df, 1, top=1).where("antecedent = 'B'").first()
    assert top["consequent"] == "C" and top["lift"] == 1.25
    with pytest.raises(ValueError):
        affinity.basket_items(df, df, "shop")


def test_affinity_of_nothing(spark):
    assert affinity.cooccurrence(spark.createDataFrame([], "basket_id long, item string"), 1).count() == 0


def test_cycles(spark):
    b = h.baskets(spark, [(1, 1, "2025-01-01", 1), (2, 1, "2025-01-08", 1), (3, 1, "2025-01-15", 1), (4, 1, "2025-01-22", 1), (5, 2, "2025-01-03", 1), (6, None, "2025-02-01", 1), (7, 1, "2025-01-22", 1)])
    i = h.items(spark, [(1, 1), (2, 1), (3, 1), (4, 1), (7, 1), (1, 2), (5, 2), (6, 1)])
    p, c = h.products(spark, [(1, "a", 30), (2, "b", 20)]), h.customers(spark, [(1, 1), (2, 5)])
    got = {(r["customer_id"], r["category"]): r for r in segments.repurchase(c, b, i, p).collect()}
    a = got[1, "a"]
    assert (a["n_days"], a["observed_days"], a["expected_days"], a["days_since"], a["overdue_ratio"], a["due"]) == (4, 7.0, 7.0, 10, 1.429, True)
    assert got[1, "b"]["expected_days"] == 26.5 and got[2, "b"]["expected_days"] == 16.5  # 20 x 1.325 and 20 x 0.825
    late = {(r["customer_id"], r["category"]): r["due"] for r in segments.repurchase(c, b, i, p, tolerance=1.5).collect()}
    assert late[1, "a"] is False
    with pytest.raises(ValueError):
        segments.repurchase(c, b, i, p, min_obs=1)


def test_rfm_scores(spark):
    rows, n = [], 0
    for c in range(1, 6):
        for k in range(6 - c):
            n += 1
            rows.append((n, c, f"2025-0{7 - c}-{10 + k:02}", 100))
    rows.append((99, None, "2025-07-01", 1))
    got = {r["customer_id"]: r for r in segments.rfm(h.customers(spark, [(c, 1) for c in range(1, 7)]), h.baskets(spark, rows)).collect()}
    assert [got[c]["rfm_score"] for c in range(1, 6)] == ["555", "444", "333", "222", "111"]
    assert got[1]["segment"] == "Champions" and got[6]["segment"] == "No purchases" and got[6]["r_score"] == 1 and got[6]["recency_days"] is None
    assert got[1]["cadence_days"] == 1.0 and got[5]["cadence_days"] is None and got[1]["recency_days"] == 17


def test_ntile_of_any_size(spark):
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    for n in (1, 3, 5, 23):
        df = spark.range(n).select(F.col("id").alias("customer_id"), (F.col("id") * 7 % 5).alias("v"))
        want = df.select("customer_id", F.ntile(5).over(W.orderBy("v", "customer_id")).alias("t"))
        assert sorted(map(tuple, segments.with_tile(df, F.asc("v"), 5, "t").select("customer_id", "t").collect())) == sorted(map(tuple, want.collect()))


def test_sign_before_repeats(spark):
    df = spark.createDataFrame([(1, 1, 2, 3.0, None), (1, 1, -2, 3.0, None), (1, 2, 0, 1.0, 9), (1, 3, -1, 1.005, 9)], "basket_id long, product_id long, quantity int, unit_price_paid double, promotion_id long")
    got = sorted(map(tuple, cleaning.clean_items(df).select("product_id", "quantity", "sign_corrected", "is_promo").collect()))
    assert got == [(1, 2, True, False), (3, 1, True, True)]
    assert cleaning.clean_items(df, "drop").count() == 1
    assert cleaning.duplicate_diagnostic(df).first()["hidden"] == 1
    with pytest.raises(ValueError):
        cleaning.clean_items(df, "keep")


def test_spelling_ties(spark):
    names = ["Dairy"] * 2 + ["DAIRY"] * 2 + [" dairy"] * 2 + ["Fruit "] + [None]
    df = spark.createDataFrame([(x,) for x in names], "category string")
    assert {r["norm"]: r["canonical"] for r in cleaning.canonical_spelling(df).collect()} == {"dairy": "Dairy", "fruit": "Fruit "}


def test_header_outlier_and_empty_basket(spark):
    b = h.baskets(spark, [(1, 1, "2025-01-01", 16), (2, 1, "2025-01-01", 15), (3, None, "2025-01-01", 9)])
    lines = spark.createDataFrame([(1, 10.0, 1), (2, 10.0, 1)], "basket_id long, line_amount double, quantity int")
    got = {r["basket_id"]: r for r in cleaning.clean_baskets(b, lines).collect()}
    assert [got[k]["is_outlier"] for k in (1, 2, 3)] == [True, False, False] and got[3]["total_amount"] == 0.0 and got[3]["is_anonymous"]


def test_one_defect_one_check(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "a"), (2, None), (2, "z")], "id long, v string")
    checks = trust.union([trust.row_checks("t", df, trust.required(["id", "v"]) | {("validity", "v known"): trust.outside("v", ["a"])}), trust.unique_check("t", df, ["id"])])
    got = {(r["dimension"], r["name"]): r["rows_failed"] for r in checks.collect()}
    assert got == {("completeness", "id present"): 0, ("completeness", "v present"): 1, ("validity", "v known"): 1, ("uniqueness", "id unique"): 1}
    detail = {r["dimension"]: r["score"] for r in trust.dimension_detail(checks).collect()}
    assert detail["completeness"] == 66.67 and detail["integrity"] == 100.0
    perfect = trust.row_checks("t", df, {("validity", "x"): F.lit(False)})
    assert tuple(trust.trust_score(perfect).first()) == (100.0, "A")
    empty = trust.row_checks("t", df.where("false"), {("validity", "x"): F.lit(True)})
    assert trust.trust_score(empty).first()["score"] == 100.0
    with pytest.raises(KeyError):
        trust.trust_score(perfect, {"beauty": 1.0})


def test_foreign_keys_ignore_nulls(spark):
    a, b = spark.createDataFrame([(1,), (1,), (7,), (None,)], "k long"), spark.createDataFrame([(1,), (None,)], "id long")
    assert trust.foreign_key_check("t", a, "k", b, "id").first()["rows_failed"] == 1


def flawless(spark):
    """Seven tables on which no check fails."""
    d, ts = h.day, __import__("datetime").datetime.fromisoformat
    make = spark.createDataFrame
    return {
        "customers": make([(1, d("2025-01-01"), "ES", "X", 2, "gold", "app", False), (2, d("2025-01-01"), "ES", "Y", 6, "silver", "web", True)], "customer_id long, signup_date date, country string, city string, household_size int, tier string, preferred_channel string, churn_label boolean"),
        "products": make([(1, "D", "a", "b", True, False, 2.0, 1, 9), (2, "D", "a", "b", True, False, 3.0, 1, 9)], "product_id long, department string, category string, brand string, private_label boolean, perishable boolean, unit_price double, pack_size int, typical_days int"),
        "promotions": make([(1, 1, "2x1", 0.5, d("2025-02-01"), d("2025-02-09"))], "promotion_id long, product_id long, promo_type string, discount_value double, start_date date, end_date date"),
        "baskets": make([(1, 1, "store", ts("2025-02-02 10:00"), d("2025-02-02"), 7.0, 3), (2, None, "app", ts("2025-03-02 10:00"), d("2025-03-02"), 2.0, None)], "basket_id long, customer_id long, channel string, basket_ts timestamp_ntz, basket_day date, total_amount double, store_id long"),
        "items": make([(1, 1, 2, 2.0, 1), (1, 2, 1, 3.0, None), (2, 1, 1, 2.0, None)], "basket_id long, product_id long, quantity int, unit_price_paid double, promotion_id long"),
        "sessions": make([(1, 1, ts("2025-02-02 09:00"), "mobile", 1, True), (2, None, ts("2025-02-02 09:00"), "tablet", None, False)], "session_id long, customer_id long, session_ts timestamp_ntz, device string, basket_id long, converted boolean"),
        "events": make([(1, 1, "view", ts("2025-02-02 09:01")), (1, 1, "add_to_cart", ts("2025-02-02 09:02"))], "session_id long, product_id long, event_type string, event_ts timestamp_ntz"),
    }


def test_a_flawless_dataset_and_its_mutations(spark):
    from pyspark.sql import functions as F

    good = flawless(spark)
    failed = lambda t, *only: {(r["table"], r["dimension"], r["name"]) for r in trust.retail_checks(t, only).where("rows_failed > 0").collect()}
    checks = trust.retail_checks(good).collect()
    assert len(checks) == 79 and len({(r["table"], r["name"]) for r in checks}) == 79 and not any(r["rows_failed"] for r in checks)
    total = {(r["table"], r["name"]): r["rows_total"] for r in checks}
    assert total["baskets", "customer_id known"] == 1 and total["items", "promotion active on day"] == 1 and total["customers", "signup before first purchase"] == 2
    assert tuple(trust.trust_score(trust.retail_checks(good)).first()) == (100.0, "A")
    one = F.col("customer_id") == 1
    set_ = lambda table, column, value, rows=None: good | {table: good[table].withColumn(column, F.when(F.lit(True) if rows is None else rows, value).otherwise(F.col(column)).cast(good[table].schema[column].dataType))}
    null = F.lit(None)
    for table, names in trust.REQUIRED.items():
        name = names[-1]
        assert (table, "completeness", f"{name} present") in failed(set_(table, name, null), table)
    cases = [
        (set_("customers", "household_size", F.lit(7)), ("customers", "validity", "household 1 to 6")), (set_("customers", "preferred_channel", F.lit("fax")), ("customers", "validity", "preferred channel known")),
        (set_("customers", "signup_date", F.lit("2025-02-03"), one), ("customers", "consistency", "signup before first purchase")), (set_("customers", "signup_date", F.lit("2025-03-03")), ("customers", "consistency", "signup within the period")),
        (set_("products", "category", F.lit("A "), F.col("product_id") == 2), ("products", "validity", "category spelt as usual")), (set_("products", "pack_size", F.lit(0)), ("products", "validity", "pack size positive")),
        (set_("promotions", "promo_type", F.lit("gift")), ("promotions", "validity", "type known")), (set_("promotions", "product_id", F.lit(9)), ("promotions", "integrity", "product_id known")),
        (set_("baskets", "total_amount", F.lit(8.0), one), ("baskets", "consistency", "header is sum of lines")), (set_("baskets", "customer_id", F.lit(9)), ("baskets", "integrity", "customer_id known")),
        (set_("items", "quantity", -F.col("quantity")), ("items", "validity", "quantity positive")), (set_("items", "quantity", -F.col("quantity")), ("baskets", "consistency", "header is sum of lines")),
        (set_("items", "promotion_id", F.lit(1)), ("items", "consistency", "promotion active on day")), (set_("items", "product_id", F.lit(1)), ("items", "uniqueness", "basket_id + product_id unique")),
        (set_("sessions", "converted", F.lit(True)), ("sessions", "consistency", "converted iff basket")), (set_("sessions", "customer_id", F.lit(9)), ("sessions", "integrity", "customer_id known")),
        (set_("events", "session_id", F.lit(9)), ("events", "integrity", "session_id known")), (set_("events", "event_type", F.lit("click")), ("events", "validity", "type known")),
        (good | {"items": good["items"].unionAll(good["items"])}, ("items", "uniqueness", "no repeated rows")), (good | {"promotions": good["promotions"].unionAll(good["promotions"])}, ("promotions", "uniqueness", "promotion_id unique")),
    ]
    for t, want in cases:
        assert want in failed(t, want[0]), want
    some = trust.retail_checks(good, ["events", "products"])
    assert {r["table"] for r in some.select("table").distinct().collect()} == {"events", "products"}
    for wrong in (lambda: trust.retail_checks({}), lambda: trust.retail_checks(good, ["orders"])):
        with pytest.raises(KeyError):
            wrong()
