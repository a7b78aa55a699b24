import pytest
from pyspark.sql import functions as F

from basketry.operators import candidates, features, ranking, splits

from . import helpers as h


def test_windows_are_half_open(spark):
    b = h.baskets(spark, [(1, 1, "2025-01-01", 1), (2, 1, "2025-01-02", 1), (3, 1, "2025-01-03", 1)])
    assert [r[0] for r in splits.between(b, "2025-01-01", "2025-01-03").select("basket_id").collect()] == [1, 2]
    assert [r[0] for r in splits.before(b, "2025-01-02").select("basket_id").collect()] == [1]


def test_cuts(spark):
    i = h.items(spark, [(1, 1)] + [(2, p) for p in range(5)])
    none = spark.createDataFrame([], "basket_id long, product_id long, added_ts timestamp_ntz")
    sizes = lambda plan: {(r[0], r[1]) for r in splits.query_items(i, none, plan).select("basket_id", "prefix_size").collect()}
    assert sizes(splits.CutPlan("empty_and_half")) == {(1, 0), (2, 0), (2, 2)}
    assert sizes(splits.CutPlan("all_prefixes")) == {(1, 0), (2, 1), (2, 2), (2, 3), (2, 4)}
    parts = splits.query_items(i, none, splits.CutPlan("all_prefixes"))
    prefix, target = splits.prefix_and_target(parts)
    assert prefix.intersect(target).count() == 0 and prefix.union(target).count() == parts.count()
    with pytest.raises(ValueError):
        splits.CutPlan("other")


def test_first_added_comes_first(spark):
    from datetime import datetime

    i = h.items(spark, [(1, 1), (1, 2), (1, 3)])
    adds = spark.createDataFrame([(1, 3, datetime(2025, 1, 1, 9)), (1, 1, datetime(2025, 1, 1, 10))], "basket_id long, product_id long, added_ts timestamp_ntz")
    got = {r["product_id"]: r["position"] for r in splits.query_items(i, adds, splits.CutPlan()).collect()}
    assert got == {3: 1, 1: 2, 2: 3}


def test_history_is_strictly_before_the_day(spark):
    b = h.baskets(spark, [(1, 1, "2025-01-01", 10), (2, 1, "2025-01-11", 20), (3, 1, "2025-02-01", 99), (4, 2, "2025-02-01", 5), (5, 1, "2025-03-01", 7)])
    i = h.items(spark, [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1)])
    q = spark.createDataFrame([("q1", 1, h.day("2025-02-01")), ("q2", 2, h.day("2025-02-01")), ("q3", None, h.day("2025-02-01"))], "query_id string, customer_id long, basket_day date")
    got = candidates.asof_history(q, b, i, h.products(spark, [(1, "a", 30)]), h.customers(spark, [(1, None)]))
    (c,) = got["customer"].collect()
    assert (c["query_id"], c["n_baskets"], c["spend"], c["recency"], c["cadence"]) == ("q1", 2, 30.0, 21, 10.0)
    (k,) = got["category"].collect()
    assert (k["n_days"], k["expected_days"], k["overdue_ratio"], k["due"]) == (2, 10.0, 2.1, 1)


def test_union_leaves_the_cart_out(spark):
    q = spark.createDataFrame([("q",)], "query_id string")
    a = spark.createDataFrame([("q", 1, 0.5), ("q", 2, 0.4), ("other", 1, 0.1)], "query_id string, product_id long, x double")
    b = spark.createDataFrame([("q", 2, 9.0), ("q", 3, 8.0)], "query_id string, product_id long, y double")
    cart = spark.createDataFrame([("q", 3)], "query_id string, product_id long")
    got = {r["product_id"]: r.asDict() for r in candidates.union_sources(q, cart, a=a, b=b).collect()}
    assert set(got) == {1, 2} and got[2]["n_sources"] == 2 and got[1]["y"] is None and got[1]["src_b"] == 0


def test_metrics_by_hand(spark):
    """A hit at rank 2 of two targets."""
    top = spark.createDataFrame([("q", 1, 0), ("q", 2, 1)], "query_id string, rank int, label int")
    q = spark.createDataFrame([("q", 2), ("none", 3)], "query_id string, n_target int")
    got = {r["query_id"]: r for r in ranking.per_query_metrics(top, q).collect()}
    assert (got["q"]["ndcg"], got["q"]["recall"], got["q"]["precision"], got["q"]["f1"], got["q"]["hit"]) == (0.386853, 0.5, 0.2, 0.285714, 1)
    assert tuple(got["none"])[1:] == (0.0, 0.0, 0.0, 0.0, 0)


def test_quota_and_cart(spark):
    rows = [("q", 1, "a", 9.0, 0), ("q", 2, "a", 8.0, 0), ("q", 3, "b", 7.0, 1), ("q", 4, "c", 1.0, 0)]
    df = spark.createDataFrame(rows, "query_id string, product_id long, category string, score double, cat_in_cart int")
    order = [r[0] for r in ranking.order_candidates(df).orderBy("rank").select("product_id").collect()]
    assert order == [1, 4, 2, 3]
    assert [r[0] for r in ranking.order_candidates(df, 9, False).orderBy("rank").select("product_id").collect()] == [1, 2, 3, 4]


def test_bootstrap_properties(spark):
    per = spark.range(40).select(F.col("id").cast("string").alias("query_id"), F.lit(1.0).alias("m"), (F.col("id") % 2).cast("double").alias("x"))
    clusters = per.select("query_id", F.col("query_id").alias("cluster"))
    assert tuple(ranking.percentile_interval(ranking.bootstrap(per, clusters, "m", 50)).first()) == (1.0, 1.0)
    one = ranking.percentile_interval(ranking.bootstrap(per, clusters, "x", 100)).first()
    few = per.select("query_id", (F.col("query_id").cast("int") % 2).alias("cluster"))
    wide = ranking.percentile_interval(ranking.bootstrap(per, few, "x", 100)).first()
    assert wide["high"] - wide["low"] > one["high"] - one["low"]
    same = ranking.paired_bootstrap(per, per, clusters, "x", 50).first()
    assert same["difference"] == 0.0 and same["p"] == 1.0


def test_codes_and_baselines(spark):
    df = spark.createDataFrame([("app",), ("web",), ("fax",), (None,)], "c string")
    assert [r[0] for r in df.select(features.code("c", features.CHANNELS)).collect()] == [0, 2, 3, 3]
    with pytest.raises(ValueError):
        ranking.baseline_scores("best", *[None] * 7)


def test_scan_is_pruned(spark):
    """Only the columns that a query needs are read, and filters reach the scan."""
    import __spark_entry__ as entry

    plan = entry.queries()["file_point_read"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    scan = next(x for x in plan.split("== Physical Plan ==")[1].splitlines() if "FileScan parquet" in x)
    assert "o_totalprice" not in scan and "EqualTo(o_orderkey,77)" in scan


def test_latent_query_uses_the_production_settings(spark, monkeypatch):
    from __spark_entry__ import queries
    from basketry.plans import reco_queries

    seen = []
    monkeypatch.setattr(reco_queries.ca, "fit_latent", lambda counts, *args, **options: seen.append((args, options)))
    monkeypatch.setattr(reco_queries.ca, "from_latent", lambda q, model, *args, **options: seen.append((args, options)) or q)
    queries()["cand_latent"](spark, "/root/testdata/sf0.001")
    assert seen == [((), {}), ((), {})] and candidates.POPULAR == 150 and candidates.CATEGORIES == 62


def test_category_ranks_by_hand(spark):
    """Shares are of the customer's days; need doubles what is due, so a due category passes a more frequent one."""
    category = spark.createDataFrame([("q", "a", 3, 0, 0.5), ("q", "b", 2, 1, 1.0), ("q", "c", 2, 0, 0.9), ("q", "d", 1, 1, 9.0)], "query_id string, category string, n_days long, due int, overdue_ratio double")
    customer = spark.createDataFrame([("q", 4)], "query_id string, n_days long")
    got = {r["category"]: (r["share"], r["freq_rank"], r["need_rank"]) for r in candidates.with_category_ranks(category, customer).collect()}
    # needs: a 3, b 4, c 2, d 2
    assert got == {"a": (0.75, 1, 2), "b": (0.5, 2, 1), "c": (0.5, 2, 3), "d": (0.25, 3, 3)}


def test_due_baseline_by_hand(spark):
    q = spark.createDataFrame([("q", h.day("2025-02-01"))], "query_id string, basket_day date")
    none = spark.createDataFrame([], "query_id string, product_id long")
    history = spark.createDataFrame([("q", "a", 3, 0), ("q", "b", 2, 1), ("q", "c", 5, 0)], "query_id string, category string, n_days long, due int")
    categories = spark.createDataFrame([(c, 10 - i) for i, c in enumerate("abcd")], "category string, n long")
    products = h.products(spark, [(1, "a", 9)])
    scores = {r["category"]: r["score"] for r in ranking.baseline_scores("due", q, categories, none, history, None, None, products).collect()}
    assert scores == {"a": 3.0, "b": 4.0, "c": 5.0, "d": -1.0}
    frequency = {r["category"]: r["score"] for r in ranking.baseline_scores("frequency", q, categories, none, history, None, None, products).collect()}
    assert frequency == {"a": 3.0, "b": 2.0, "c": 5.0, "d": -1.0}


def test_paired_bootstrap_wants_the_same_queries(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 0.0)], "query_id string, m double")
    clusters = a.select("query_id", F.col("query_id").alias("cluster"))
    with pytest.raises(Exception, match="only one system has the query"):
        ranking.paired_bootstrap(a, a.where("query_id = 'x'"), clusters, "m", 10).collect()


def test_places_over_hot_values(spark):
    from pyspark.sql import Window as W

    from basketry.functions.ranks import placed, quantiles

    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 11).alias("v"), (F.col("id") % 2).alias("g"))
    want = {r["id"]: r["r"] for r in df.withColumn("r", F.row_number().over(W.partitionBy("g").orderBy(F.desc("v"), "id"))).collect()}
    got = placed(df, [F.desc("v"), "id"], "r", ("g",), total="n").collect()
    assert {r["id"]: r["r"] for r in got} == want and {r["n"] for r in got} == {2500}
    assert placed(df.where("false"), ["v", "id"], "r").count() == 0
    x = df.select(F.when(F.col("id") % 5 > 0, F.col("id") * 0.37).alias("x"))
    shares = (0.0, 0.25, 0.5, 0.77, 1.0)
    exact = x.agg(*[F.percentile("x", F.lit(s)) for s in shares]).first()
    assert [round(v, 9) for v in quantiles(x, "x", shares, "p").first()] == [round(v, 9) for v in exact]


def ranking_rows(spark, n=60, pool=12):
    rows = []
    for i in range(n):
        for p in range(pool):
            good = (i * 7 + p * 5) % pool
            rows.append((f"q{i}", p, 2 if good == 0 else 1 if good == 1 else 0, float(good), float((i * 13 + p) % 7), i >= 2 * n // 3))
    return spark.createDataFrame(rows, "query_id string, product_id long, relevance int, f1 double, f2 double, is_validation boolean")


def test_lambdas_by_hand(spark):
    import math

    rows = spark.createDataFrame([("q", 1, 0.0, 0.0), ("q", 2, 3.0, 0.0)], "query_id string, product_id long, gain double, score double")
    got = {r["product_id"]: r for r in ranking.lambdas(rows).collect()}
    swap = 3 * (1 - 1 / math.log2(3)) / 3
    assert abs(got[2]["lam"] - 0.5 * swap) < 1e-12 and got[1]["lam"] == -got[2]["lam"] and abs(got[1]["hess"] - 0.25 * swap) < 1e-12


def test_listwise_ranker(spark, tmp_path):
    matrix = ranking_rows(spark)
    model, curve = ranking.fit_lambda_ranker(matrix, ("f1", "f2"), rounds=6, depth=3)
    assert curve[-1] > 0.99 and len(model.stages[-1].trees) <= 6
    again = ranking.rank_with(model, matrix, ("f1", "f2")).withColumn("gain", ranking.gain_of())
    assert abs(ranking.mean_ndcg(again.where("is_validation")) - max(curve)) < 1e-6
    ranking.save_ranker(model, f"{tmp_path}/m", ("f1", "f2"))
    back, features_ = ranking.load_ranker(spark, f"{tmp_path}/m", ("f1", "f2"))
    assert features_ == ("f1", "f2")
    scores = lambda m: [r["score"] for r in ranking.rank_with(m, matrix, ("f1", "f2")).orderBy("query_id", "product_id").limit(20).collect()]
    assert scores(back) == scores(model)
    with pytest.raises(ValueError):
        ranking.load_ranker(spark, f"{tmp_path}/m", ("f2", "f1"))


def test_early_stopping_keeps_the_best(spark):
    """Validation that can't be learnt ends the rounds."""
    noise = ranking_rows(spark).withColumn("f1", F.when(F.col("is_validation"), F.hash("query_id", "product_id") % 100).otherwise(F.col("f1")).cast("double"))
    model, curve = ranking.fit_lambda_ranker(noise, ("f1", "f2"), rounds=12, depth=3, patience=2)
    assert len(curve) < 12 and len(model.stages[-1].trees) == curve.index(max(curve)) + 1


def test_the_contract_of_the_matrix():
    assert len(features.FEATURES) == len(set(features.FEATURES)) == 60


def test_ceiling_given_the_cart(spark):
    """Against all orders in which categories can enter the basket."""
    from itertools import permutations

    weights, cart, n, k = {"a": 4.0, "b": 2.0, "c": 1.0, "d": 1.5, "e": 0.5}, {"c"}, 3, 2
    chance = {}
    for order in permutations(weights, n):
        left, p = sum(weights.values()), 1.0
        for c in order:
            p *= weights[c] / left
            left -= weights[c]
        if cart <= set(order):
            rest = frozenset(order) - cart
            chance[rest] = chance.get(rest, 0.0) + p
    total = sum(chance.values())
    marginal = {c: sum(p for rest, p in chance.items() if c in rest) / total for c in weights if c not in cart}
    want = sum(sorted(marginal.values(), reverse=True)[:k])
    rows = [(f"q{i}", c, w, c in cart, n) for i in range(20) for c, w in weights.items()]
    got = ranking.ceiling_given_cart(spark.createDataFrame(rows, "query_id string, category string, weight double, in_cart boolean, n int"), 2000, k).collect()
    assert len(got) == 20 and abs(sum(r["expected_hits"] for r in got) / 20 - want) < 0.02
    assert all(100 < r["ess"] <= 1000 and abs(r["expected_hits"] - want) < 5 * r["se"] for r in got)
    whole = ranking.ceiling_given_cart(spark.createDataFrame([("q", "a", 1.0, False, 2), ("q", "b", 1.0, True, 2)], "query_id string, category string, weight double, in_cart boolean, n int"), 10, 5).first()
    assert (round(whole["expected_hits"], 9), round(whole["ess"], 9)) == (1.0, 5.0)


def test_compare_systems(spark):
    a = spark.range(30).select(F.col("id").cast("string").alias("query_id"), (F.col("id") % 3).cast("double").alias("ndcg"))
    clusters = a.select("query_id", F.col("query_id").alias("cluster"))
    got = {r["system"]: r for r in ranking.compare_systems({"one": a, "two": a.withColumn("ndcg", F.col("ndcg") + 1)}, clusters, resamples=50).collect()}
    assert (got["one"]["difference"], got["two"]["difference"], got["two"]["mean"], got["two"]["low"]) == (0.0, 1.0, 2.0, 1.0)
    with pytest.raises(Exception, match="only one system has the query"):
        ranking.compare_systems({"one": a, "two": a.where("query_id < '2'")}, clusters, resamples=5).collect()


def test_objectives(spark):
    rows = ranking_rows(spark).withColumns({"category": F.col("product_id").cast("string"), "cat_in_cart": F.lit(0)})
    q = rows.where("relevance = 2").groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("n_target")).withColumn("n_items", F.lit(3))
    full = rows.withColumn("label", (F.col("relevance") == 2).cast("int"))
    got = {r["variant"]: r for r in ranking.objective_ablation(full, full.where("is_validation"), q.join(full.where("is_validation").select("query_id").distinct(), "query_id"), ("f1", "f2"), 5).collect()}
    assert set(got) == {v[0] for v in ranking.OBJECTIVES} and all(r["hit"] == 1.0 and r["ndcg"] > 0.6 for r in got.values())


def test_what_a_month_offers_is_dealt_to_its_queries(spark):
    """Rows by month give the pool that the same rows by query give, and pairs are made last: nothing is shuffled behind them."""
    q = spark.createDataFrame([("q", h.day("2025-01-05")), ("r", h.day("2025-01-09")), ("s", h.day("2025-02-01")), ("none", h.day("2025-03-01"))], "query_id string, basket_day date")
    offers = spark.createDataFrame([(1, 1, 5.0, 1), (1, 2, 4.0, 2), (2, 9, 1.0, 1)], "month int, product_id long, pop_score double, pop_rank int")
    own = spark.createDataFrame([("q", 2, 0.5), ("q", 3, 0.4), ("s", 9, 0.1), ("none", 8, 0.1)], "query_id string, product_id long, x double")
    cart = spark.createDataFrame([("q", 3), ("r", 1)], "query_id string, product_id long")
    pool = candidates.union_sources(q, cart, pop=offers, a=own)
    by_query = q.select("query_id", F.month("basket_day").alias("month")).join(offers, "month").drop("month")
    want = candidates.union_sources(q, cart, pop=by_query, a=own)
    rows = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert rows(pool) == rows(want) and pool.count() == 5
    assert {(r["query_id"], r["product_id"]): (r["pop_rank"], r["x"], r["n_sources"]) for r in pool.collect()}["q", 2] == (2, 0.5, 2)
    plan = pool._jdf.queryExecution().sparkPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Generate")] and "Join" not in plan[: plan.index("Generate")]


def test_labels_of_the_matrix(spark):
    """A matrix with targets is labelled as ``with_relevance`` labels it, and the pool joined row by row gives the same features."""
    from basketry import roles
    from basketry.plans.reco_queries import Window

    w = Window(roles.clean(spark, "/root/testdata/sf0.001"))
    got = w.matrix(target=w.target).cache()
    want = features.with_relevance(got.drop("relevance", "label"), w.target, w.t["products"]).select(got.columns)
    assert got.count() > 1000 and got.where("relevance = 2 and label = 1").count() > 0 and got.exceptAll(want).count() == 0
    got.unpersist()


def test_trees_do_not_depend_on_partitioning(spark):
    from basketry.operators import boosting

    rows = ranking_rows(spark, 200).withColumn("gain", ranking.gain_of())
    want = None
    for n in (1, 7):
        for listwise in (True, False):
            got = boosting.boost(rows.repartition(n), ("f1", "f2"), listwise, 5, 3, 0.3)
            want = want or {}
            assert want.setdefault(listwise, got) == got


def test_pulls_of_rows_in_memory(spark):
    """What the trees are fitted to is what ``lambdas`` says, for scores with ties."""
    import numpy as np

    from basketry.operators import boosting

    rows = ranking_rows(spark, 9).select("query_id", F.col("product_id"), ranking.gain_of().alias("gain"), (F.hash("query_id", "product_id") % 4 / 2.0).alias("score"))
    want = ranking.lambdas(rows).orderBy("query_id", F.desc("gain"), "product_id").toPandas()
    table = {"q": want["query_id"].str[1:].astype(int).to_numpy(), "p": want["product_id"].to_numpy(), "gain": want["gain"].to_numpy(), "codes": []}
    part = boosting._part(table, np.arange(len(want)))
    lam, hess = boosting._pulls(part, 5)(want["score"].to_numpy())
    assert np.allclose(lam, want["lam"], atol=1e-12) and np.allclose(hess, want["hess"], atol=1e-12)
    total, n = boosting._ndcg(part, 5)(want["score"].to_numpy())
    assert n == 9 and abs(total / n - ranking.mean_ndcg(rows)) < 1e-8


def test_pointwise_trees_are_those_of_mllib(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.regression import GBTRegressor

    rows = ranking_rows(spark, 80).withColumns({"f3": (F.hash("query_id", "product_id") % 9).cast("double"), "gain": ranking.gain_of()})
    names = ("f1", "f2", "f3")
    model = ranking.fit_ranker(rows, names, 6, 3)
    gbt = GBTRegressor(featuresCol="x", labelCol="gain", maxIter=6, maxDepth=3, seed=1, validationIndicatorCol="is_validation")
    other = Pipeline(stages=[ranking._assembler(names), gbt]).fit(rows)
    score = lambda m: [r["score"] for r in ranking.rank_with(m, rows, names).orderBy("query_id", "product_id").collect()]
    assert len(model.stages[-1].trees) == len(other.stages[-1].trees)
    assert max(abs(a - b) for a, b in zip(score(model), score(other), strict=True)) < 1e-4
    assert all(abs(a - b) < 1e-3 for a, b in zip(model.stages[-1].featureImportances.toArray(), other.stages[-1].featureImportances.toArray(), strict=True))


@pytest.mark.parametrize("name", ["rank_listwise_top", "rank_objective_ablation"])
def test_rankers_learn_until_validation_stops_them(spark, monkeypatch, name):
    """The registered queries ask for the reference's 800 rounds at most and its patience of 50, not for a few rounds."""
    from basketry import plans

    class Asked(Exception):
        pass

    def listwise(matrix, features, rounds=20, depth=5, rate=0.3, patience=3, k=5):
        raise Asked(rounds, patience)

    def pointwise(matrix, features, iterations=30, depth=5, gains=None, rate=0.1, patience=None):
        raise Asked(iterations, patience)

    monkeypatch.setattr(ranking, "fit_lambda_ranker", listwise)
    monkeypatch.setattr(ranking, "fit_ranker", pointwise)
    with pytest.raises(Asked) as asked:
        plans.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert asked.value.args == (800, 50)
