import json
import os
import re

import pytest
from pyspark.sql import functions as F

from basketry import roles
from basketry.operators import features, ranking, serving, verify
from basketry.plans.reco_queries import TEST_START, Window
from basketry.sources import files, tracking

SF = "/root/testdata/sf0.001"


def test_recommend_from_a_bundle(spark, tmp_path):
    t = roles.clean(spark, SF)
    names = serving.export_bundle(t, "2000-06-15", str(tmp_path))
    assert set(files.read_tables(spark, str(tmp_path), names)) == set(names)
    one = files.point_read(spark, f"{tmp_path}/customer_products", "customer_id", 7)
    assert {r["customer_id"] for r in one.collect()} == {7}
    got = serving.recommend(spark, str(tmp_path), 7, "2000-06-15", [1, 2, 3], k=5).collect()
    assert [r["rank"] for r in got] == [1, 2, 3, 4, 5] and not {r["product_id"] for r in got} & {1, 2, 3}
    assert len({r["category"] for r in got}) == 5
    assert len(serving.recommend(spark, str(tmp_path), None, "2000-06-15", [], k=3).collect()) == 3
    # one bucket is read
    spark.conf.set("spark.sql.maxPlanStringLength", str(1 << 24))
    plan = serving.pool_for(spark, str(tmp_path), 7, "2000-06-15", [1])[0]._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.maxPlanStringLength", "8192")
    assert len(re.findall(r"PartitionFilters: \[isnotnull\(bucket#\d+\), \(bucket#\d+ = \d+\)\]", plan)) >= 2
    cut = serving.slice_for(t, t["customers"].where("customer_id = 7"))
    assert {r[0] for r in cut["baskets"].select("customer_id").collect()} == {7} and cut["products"].count() == t["products"].count()


def test_served_and_batch_rankings_agree(spark, tmp_path):
    """A query of the batch window on its first day, answered from a bundle of that day by the same trained ranker."""
    t = roles.clean(spark, "/root/testdata/sf0.01")
    w = Window(t)
    first = w.q.where(F.col("basket_day") == TEST_START).where("customer_id is not null and prefix_size > 0").orderBy("query_id").first()
    full = features.with_relevance(w.matrix(), w.target, t["products"])
    ranker = ranking.fit_ranker(full, features.FEATURES, iterations=3, depth=3)
    ranking.save_ranker(ranker, f"{tmp_path}/ranker", features.FEATURES)
    serving.export_bundle(t, TEST_START, f"{tmp_path}/bundle")
    cart = [r["product_id"] for r in w.prefix.where(F.col("query_id") == first["query_id"]).collect()]
    _, live = serving.pool_for(spark, f"{tmp_path}/bundle", first["customer_id"], str(first["basket_day"]), cart, first["channel"])
    batch = w.matrix().where(F.col("query_id") == first["query_id"])
    # a live cart has no session, and is known by its customer
    own = [f for f in features.FEATURES if f not in ("has_session", "viewed", "n_views", "view_age_s", "n_events", "is_known")]
    rows = lambda df: sorted(map(tuple, df.select("product_id", "category", *own).collect()))
    assert rows(live) == rows(batch) and len(rows(live)) > 100
    served = serving.recommend(spark, f"{tmp_path}/bundle", first["customer_id"], str(first["basket_day"]), cart, channel=first["channel"], ranker=f"{tmp_path}/ranker").collect()
    assert [r["rank"] for r in served] == [1, 2, 3, 4, 5]


def test_tracking(tmp_path):
    log = tmp_path / "x" / "runs.jsonl"
    with tracking.track("a run: 1", str(log), k=5) as run:
        run.metric(hit=0.5, none=None, nan=float("nan"))
    with pytest.raises(KeyError), tracking.track("bad", str(log)):
        raise KeyError("x")
    first, second = map(json.loads, log.read_text().splitlines())
    assert first["name"] == "a_run_1" and first["metrics"] == {"hit": 0.5} and first["params"] == {"k": "5"} and second["state"] == "KeyError"
    with tracking.track("nowhere", "/proc/none/runs.jsonl"):
        pass


def test_catalog():
    assert verify.validate_catalog({"a": "D"}, {"a": 3}, [("a", "a", 1.5)], {"D": 0.2}) == []
    assert len(verify.validate_catalog({"a": "D", "b": "D"}, {"a": 0}, [("a", "z", -1.0)], {"D": 2.0, "E": 0.1})) == 6


def test_reports_are_whole_or_refused(spark, tmp_path):
    df = spark.range(30)
    files.write_report(df, f"{tmp_path}/r.json", 30)
    assert len(json.loads((tmp_path / "r.json").read_text())) == 30 and files.markdown(df, 30).count("\n") == 31
    for write in (lambda: files.write_report(df, f"{tmp_path}/s.json", 29), lambda: files.markdown(df, 29)):
        with pytest.raises(ValueError, match="more than 29 rows"):
            write()


def test_snapshots(spark, tmp_path):
    path, inputs = f"{tmp_path}/s.json", {"a": spark.range(5)}
    files.freeze(spark, {"ndcg": 0.3}, inputs, path)
    assert files.frozen(path, {"a": spark.range(5).orderBy(F.desc("id"))}) == {"ndcg": 0.3}
    with pytest.raises(FileExistsError):
        files.freeze(spark, {}, inputs, path)
    files.freeze(spark, {"ndcg": 0.4}, inputs, path, force=True)
    for other in ({"a": spark.range(6)}, {"a": spark.range(5), "b": spark.range(1)}):
        with pytest.raises(ValueError, match="not the same inputs"):
            files.frozen(path, other)


def test_command_line(spark, tmp_path, capsys):
    from basketry.__main__ import main

    assert main(["list"]) == 0 and "affinity" in capsys.readouterr().out
    assert main(["rfm", "--dry-run"]) == 0 and capsys.readouterr().out.startswith("tables, rfm: about 1 min")
    assert main(["nothing"]) == 2 and "no such step" in capsys.readouterr().err
    run = lambda *args: main([*args, "--data", SF, "--out", str(tmp_path)])
    assert run("rfm", "labels") == 0 and "lines: written" in capsys.readouterr().out
    assert spark.read.parquet(f"{tmp_path}/rfm").count() == 150 and spark.read.parquet(f"{tmp_path}/labels").count() > 0
    assert run("features", "--only") == 0 and spark.read.parquet(f"{tmp_path}/features").count() > 0
    assert main(["labels", "--only", "--data", SF, "--out", f"{tmp_path}/none"]) == 2 and "labels needs lines" in capsys.readouterr().err


def test_all_raw_tables(spark, tmp_path):
    for name, schema in files.RAW_SCHEMAS.items():
        spark.createDataFrame([], schema).write.option("header", "true").csv(f"{tmp_path}/{name}.csv")
    raw = files.read_all_raw(spark, str(tmp_path))
    assert {n: df.schema.simpleString() for n, df in raw.items()} == {n: spark.createDataFrame([], s).schema.simpleString() for n, s in files.RAW_SCHEMAS.items()}


def test_session_settings(spark):
    """Tests, queries and the command line run on the same settings."""
    conf = {k: spark.conf.get(k) for k in ("spark.sql.session.timeZone", "spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled")}
    assert conf == {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}


def test_shared_tables(spark):
    from basketry import shared

    df = shared.saved(spark.range(5))
    folder = df._written_to.removeprefix("file://").removesuffix("/t")
    assert df.count() == 5 and os.path.isdir(folder) and f"basketry-{spark.sparkContext.applicationId}" in folder
    shared.forget(df, spark.range(1))
    assert not os.path.exists(folder)


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from basketry import shared

    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.root_dir(fake)


def test_photos(spark):
    rows = [(1, "White Bottle, isolated", "#FFFFFF", 100, 100), (2, "Smiling woman with jar", "#FFFFFF", 100, 100), (3, None, None, None, None), (4, "blank mockup on table", "#000000", 400, 100), (5, "close-up can", "#zzz", 300, 200)]
    got = {r[0]: r[1] for r in serving.photo_score(spark.createDataFrame(rows, "photo_id long, alt string, avg_color string, width int, height int")).collect()}
    assert got == {1: 6.6, 3: 1.5, 4: -6.0, 5: 2.2}
    picture = [[(r * 3 + c * c) % 7 for c in range(9)] for r in range(8)]
    want = int("".join("1" if row[c] > row[c + 1] else "0" for row in picture for c in range(8)), 2)
    one = spark.createDataFrame([([x for row in picture for x in row],)], "p array<int>").select(serving.dhash("p")).first()[0]
    assert one & (1 << 64) - 1 == want
