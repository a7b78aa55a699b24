import pytest
from pyspark.sql import functions as F

from basketry.operators import nba, serving
from basketry.plans import steps
from basketry.sources import files

from . import helpers as h

AT = "2025-06-01"


def test_labels(spark):
    b = h.baskets(spark, [(1, 1, "2025-05-20", 1), (2, 1, "2025-06-03", 1), (3, 2, "2025-05-20", 1), (4, None, "2025-06-02", 1), (5, 2, "2025-06-29", 1)])
    i = h.items(spark, [(1, 1), (2, 1), (3, 1), (4, 1), (1, 2), (5, 1)])
    lines = nba.category_lines(b, i, h.products(spark, [(1, "a", 9), (2, "b", 9)]))
    assert {r[0]: r[1] for r in nba.churn_label(b, AT).collect()} == {1: 0, 2: 1}  # day 28 is outside
    labels = {(r[0], r[1]): r[2] for r in nba.category_label(nba.candidate_pairs(lines, AT), lines, AT).collect()}
    assert labels == {(1, "a"): 1, (1, "b"): 0, (2, "a"): 0}


def test_features_don_t_see_the_future(spark):
    rows = [(1, 1, "2025-05-20", 10), (2, 1, "2025-04-20", 5)]
    i, p = h.items(spark, [(1, 1, 1, 10), (2, 1, 1, 5), (3, 1, 1, 7)]), h.products(spark, [(1, "a", 9)])
    both = []
    for more in ([], [(3, 1, "2025-06-01", 7)]):
        b = h.baskets(spark, rows + more)
        lines = nba.category_lines(b, i, p)
        who = h.customers(spark, [(1, 2)])
        both.append((nba.customer_features(b, lines, who, AT).collect(), nba.category_features(lines, b, i, who, p, AT).collect()))
    one = both[0][0][0]
    assert both[0] == both[1] and (one["visit_trend"], one["spend_trend"], one["ticket_trend"]) == (1.0, 2.0, 2.0)
    assert (one["recency"], one["tenure"], one["cadence"], one["signup_tenure"], one["tier_idx"], one["channel_idx"], one["household_size"]) == (12, 42, 42.0, 151, 2, 0, 2)
    pair = both[0][1][0]
    assert (pair["cat_spend"], pair["cat_units"], pair["n_days"], pair["spend_share"], pair["pop_share"], pair["observed_days"]) == (15.0, 2, 2, 1.0, 1.0, 30.0)


def test_policy_candidates_by_hand(spark):
    """Margins blend over a customer's own departments: the worth of keeping one is the same whatever is offered."""
    pairs = spark.createDataFrame([(1, "a", 0.2), (1, "b", 0.4), (2, "a", 0.1), (3, "b", 0.3)], "customer_id long, category string, p_purchase double")
    churn = spark.createDataFrame([(1, 0.5, 90.0), (2, 0.25, 900.0)], "customer_id long, p_churn double, spend_90 double")
    features = spark.createDataFrame(
        [(1, "a", "fresh", 30.0, 3, 2.0), (1, "b", "care", 10.0, 1, 0.5), (2, "a", "fresh", 1000.0, 2, None)], "customer_id long, category string, department string, cat_spend double, n_days long, overdue_ratio double"
    )
    economics = spark.createDataFrame([(7.5,)], "visit_spend double")
    got = {(r["customer_id"], r["category"]): r for r in nba.policy_candidates(pairs, churn, features, economics, {"fresh": 0.2, "care": 0.4}).collect()}
    # (30 x 0.2 + 10 x 0.4) / 40 = 0.25; 4 weeks of 7 a week at that margin
    assert [got[1, c]["retention_value"] for c in "ab"] == [7.0, 7.0] and got[2, "a"]["retention_value"] == 4 * 70 * 0.2
    assert [got[1, c]["gross_margin"] for c in "ab"] == [2.0, 4.0] and (got[2, "a"]["expected_spend"], got[2, "a"]["gross_margin"]) == (60.0, 12.0)
    assert (got[3, "b"]["expected_spend"], got[3, "b"]["gross_margin"], got[3, "b"]["p_churn"], got[3, "b"]["retention_value"]) == (7.5, 1.875, 0.0, 0.0)
    assert [got[k]["relevance"] for k in ((1, "a"), (1, "b"), (2, "a"))] == [1.0, 0.575, 0.15]
    assert {r[0]: r[1] for r in nba.blended_margin(features, {}).collect()} == {1: 0.25, 2: 0.25}


def test_economics_and_departments(spark):
    b = h.baskets(spark, [(1, 1, "2025-05-20", 1), (2, 1, "2025-05-20", 1), (3, 2, "2025-05-21", 1), (4, 2, "2025-06-02", 1)])
    i = h.items(spark, [(1, 1, 1, 4), (2, 1, 1, 6), (3, 2, 1, 2), (4, 1, 1, 99)])
    p = h.products(spark, [(1, "a", 9), (2, "b", 9)])
    lines = nba.category_lines(b, i, p)
    assert nba.economics(lines, AT).first()[0] == 6.0  # 10 on one day of one customer, 2 of another
    assert nba.economics(lines, "2020-01-01").first()[0] == 0.0
    many = spark.createDataFrame([(1, "a", "Z"), (2, "a", "Y"), (3, "a", "Z"), (4, "b", "Y"), (5, "b", "X")], "product_id long, category string, department string")
    assert {r[0]: r[1] for r in nba.category_departments(many).collect()} == {"a": "Z", "b": "X"}


def candidate(spark, **kw):
    row = {"customer_id": 1, "category": "a", "p_purchase": 0.2, "p_churn": 0.9, "gross_margin": 2.5, "retention_value": 20.0, "relevance": 0.0} | kw
    return spark.createDataFrame([tuple(row.values())], "customer_id long, category string, p_purchase double, p_churn double, gross_margin double, retention_value double, relevance double")


def test_action_values_by_hand(spark):
    values = {r["action"]: r["value"] for r in nba.action_values(candidate(spark)).collect()}
    assert values == {"none": 0.0, "highlight": 0.04, "coupon": -0.5608}
    kept = {r["action"]: r["value"] for r in nba.action_values(candidate(spark, relevance=1.0)).collect()}
    assert round(kept["coupon"] - values["coupon"], 6) == 1.8
    sure = {r["action"]: r["value"] for r in nba.action_values(candidate(spark, p_purchase=0.95)).collect()}
    assert sure["coupon"] == round(1 * (2.5 - 2.54) - 0.05 - 0.95 * 2.5, 6)
    with pytest.raises(ValueError):
        nba.Action("bad", cost=-1)


def test_nothing_rather_than_a_loss(spark):
    d = nba.decide(nba.action_values(candidate(spark, gross_margin=0.0))).first()
    assert (d["action"], d["category"], d["value"]) == ("none", None, 0.0)
    sweep = [r["total_value"] for r in nba.sensitivity(candidate(spark), (1.0, 1.5, 2.0, 4.0)).orderBy("uplift").collect()]
    assert sweep == sorted(sweep) and sweep[0] >= 0


def test_metrics(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)], "s double, y int")
    m = nba.classification_metrics(df, "s", "y").first()
    assert (m["n"], m["auc"], m["base_rate"], m["lift"]) == (4, 0.875, 0.5, 2.0)
    one = nba.classification_metrics(df.where("y = 1"), "s", "y").first()
    assert one["auc"] is None and one["lift"] is None


def test_impact(spark):
    base = spark.createDataFrame([(100.0, 10.0)], "online_per_month double, mean_line double")
    got = nba.cross_sell_impact(base, 0.5, 0.2, (0.1,)).first()
    assert (got["monthly"], got["yearly"]) == (10.0, 120.0)
    with pytest.raises(ValueError):
        nba.cross_sell_impact(base, 0.5, 2.0)


def test_search_and_names(spark):
    df = spark.createDataFrame([(1, "Café_Olé", "Hot Drinks", "D", 2.0), (2, "cafe", "x", "D", 1.0), (3, "Café_Olé", "Hot Drinks", "D", 3.0)], "product_id long, brand string, category string, department string, unit_price double")
    assert [r["product_id"] for r in serving.search(df, "CAFE  drinks").collect()] == [1, 3]
    assert {r[0]: r[1] for r in serving.product_names(df).collect()} == {1: "Café Olé Hot Drinks 1", 2: "Cafe X", 3: "Café Olé Hot Drinks 2"}
    assert df.select(serving.slugify("brand")).first()[0] == "cafe-ole"


def test_hamming_pairs_miss_none(spark):
    import random

    rng = random.Random(1)
    base = [rng.getrandbits(63) for _ in range(20)]
    hashes = [b ^ sum(1 << k for k in rng.sample(range(63), rng.randint(0, 10))) for b in base for _ in range(4)]
    df = spark.createDataFrame(list(enumerate(hashes)), "id long, hash long")
    want = {(a, b, (hashes[a] ^ hashes[b]).bit_count()) for a in range(80) for b in range(a + 1, 80) if (hashes[a] ^ hashes[b]).bit_count() <= 8}
    assert set(map(tuple, serving.hamming_pairs(df).collect())) == want
    signed = df.withColumn("hash", -F.col("hash"))
    assert serving.hamming_pairs(signed, 6, 8).count() == sum((-hashes[a] & (1 << 64) - 1 ^ -hashes[b] & (1 << 64) - 1).bit_count() <= 6 for a in range(80) for b in range(a + 1, 80))


def test_files(spark, tmp_path):
    (tmp_path / "baskets.csv").write_text("basket_id,customer_id,channel,basket_date,store_id,total_amount\nB1,,app,2025-01-02 10:30:00,,5.5\n")
    row = files.read_raw(spark, str(tmp_path), "baskets").first()
    assert row["customer_id"] is None and row["basket_date"].hour == 10 and row["total_amount"] == 5.5
    with pytest.raises(KeyError):
        files.read_raw(spark, str(tmp_path), "orders")
    t = {"a": spark.range(5).withColumn("b", F.col("id") * 2)}
    files.write_tables(t, f"{tmp_path}/out")
    back = files.read_tables(spark, f"{tmp_path}/out", ["a"])
    assert files.manifest(back).collect() == files.manifest({"a": t["a"].orderBy(F.desc("id"))}).collect()
    assert files.manifest({"a": t["a"].withColumn("b", F.col("id"))}).collect() != files.manifest(t).collect()
    assert files.resolve(spark, f"{tmp_path}/no", f"{tmp_path}/out/a") == f"{tmp_path}/out/a"
    assert "| id | b |" in files.markdown(t["a"])


def test_step_graph():
    ran = []
    g = steps.Graph([steps.Step("a", lambda: ran.append("a") or 1), steps.Step("b", lambda a: ran.append("b") or a + 1, ("a",)), steps.Step("c", lambda: 5), steps.Step("d", lambda b, c: b + c, ("b", "c"), 2.0)])
    assert g.resolve(["d"]) == ["a", "b", "c", "d"] and g.resolve(["b"]) == ["a", "b"] and g.resolve(["d"], only=True) == ["d"] and g.resolve(start="c") == ["c", "d"]
    assert g.run(["b"]) == {"a": 1, "b": 2} and ran == ["a", "b"] and g.run(["d"], only=True, have={"b": 1, "c": 1})["d"] == 2
    assert g.estimate(["c", "d"], 0.5) == 1.3
    for bad in ([steps.Step("x", int, ("y",))], [steps.Step("x", int), steps.Step("x", int)]):
        with pytest.raises(ValueError):
            steps.Graph(bad)
    with pytest.raises(KeyError):
        g.resolve(["zz"])


def test_hamming_pairs_of_hashes_that_hardly_vary(spark):
    """32 of 64 bits are the same everywhere: most pairs share keys, and each is compared once."""
    import random

    rng = random.Random(3)
    hashes = [rng.getrandbits(32) for _ in range(400)]
    hashes += [h ^ (1 << rng.randrange(32)) for h in hashes[:50]] + hashes[:20]
    df = spark.createDataFrame(list(enumerate(hashes)), "id long, hash long")
    want = {(a, b, (hashes[a] ^ hashes[b]).bit_count()) for a in range(len(hashes)) for b in range(a + 1, len(hashes)) if (hashes[a] ^ hashes[b]).bit_count() <= 8}
    found = serving.hamming_pairs(df)
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
    rows = [tuple(r) for r in found.collect()]
    assert set(rows) == want and len(rows) == len(want)
    tiled = [tuple(r) for r in serving._all_pairs(df, len(hashes), 8, rows=40).collect()]
    assert set(tiled) == want and len(tiled) == len(want)
