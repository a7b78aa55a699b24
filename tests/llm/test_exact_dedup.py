import random
from collections import defaultdict

import pyarrow as pa
import pytest

from basketry.llm import common
from basketry.llm import exact_dedup as ed
from basketry.llm.common import saved
from basketry.llm.exact_dedup import digest_runs, drop_copies, exact_dedup, merge_runs

from .helpers import docs_of, odd_pairs, rows_of, sample, sha


def plain(pairs, keep=max):
    groups = defaultdict(list)
    for i, t in pairs:
        groups[t or ""].append(i)
    out = []
    for i, t in pairs:
        ids = [x for x in groups[t or ""] if x is not None]
        out.append((i, keep(ids) if ids else None, len(groups[t or ""]), sha(t or "")))
    return sorted(out, key=repr)


@pytest.mark.parametrize("keep", ["max", "min"])
@pytest.mark.parametrize("lanes", [None, 1, 8])
def test_against_plain(spark, keep, lanes):
    pairs = odd_pairs() + sample(spark, 60)
    got = exact_dedup(docs_of(spark, pairs).repartition(5), keep, lanes)
    assert rows_of(got.select("doc_id", "keep_id", "group_size", "text_sha256")) == plain(pairs, max if keep == "max" else min)
    kept = got.where("kept").groupBy("text_sha256").count().collect()
    assert all(r["count"] == 1 for r in kept) and len(kept) == len({t or "" for _, t in pairs})
    assert got.where("kept and not doc_id <=> keep_id").count() == 0


def test_drop_copies_keeps_whole_rows(spark):
    pairs = odd_pairs()
    docs = docs_of(spark, pairs)
    got = drop_copies(docs)
    assert got.columns == docs.columns and sorted(x or "" for (x,) in got.select("text").collect()) == sorted({t or "" for _, t in pairs})
    assert {r[0] for r in got.select("_key").collect()} == {"x"}


def test_empty_and_wrong(spark):
    docs = docs_of(spark, [])
    assert exact_dedup(docs).count() == 0 and drop_copies(docs).count() == 0
    with pytest.raises(ValueError):
        digest_runs(docs, "first")


def test_one_row_a_lane_and_digest(spark):
    docs = docs_of(spark, [(i, "same") for i in range(200)]).repartition(8)
    assert rows_of(merge_runs(digest_runs(docs), lanes=8).select("doc_id", "group_size")) == [(199, 200)]


def test_a_small_table_makes_few_files(spark, tmp_path):
    """A thousand rows are one lane, and leave in a few partitions per core, however many there are to shuffle to."""
    spark.createDataFrame([(i, f"text {i % 300}" if i % 3 else "hot") for i in range(1000)], "doc_id long, text string").repartition(40).write.parquet(f"{tmp_path}/d")
    docs, most = spark.read.parquet(f"{tmp_path}/d"), common.PARTS_PER_CORE * spark.sparkContext.defaultParallelism
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.files.openCostInBytes")}
    try:
        for k, v in zip(was, ("211", "false", "128m"), strict=True):
            spark.conf.set(k, v)
        assert docs.rdd.getNumPartitions() == 40
        assert len(merge_runs(digest_runs(docs)).inputFiles()) == 1
        for i, out in enumerate((exact_dedup(docs), drop_copies(docs))):
            out.write.parquet(f"{tmp_path}/{i}")
            assert len(spark.read.parquet(f"{tmp_path}/{i}").inputFiles()) <= most
        assert spark.read.parquet(f"{tmp_path}/0").where("kept").count() == spark.read.parquet(f"{tmp_path}/1").count() == len({f"text {i % 300}" if i % 3 else "hot" for i in range(1000)})
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_a_large_table_keeps_its_partitions(spark, monkeypatch):
    docs = docs_of(spark, [(i, f"text {i}") for i in range(64)])
    monkeypatch.setattr(common, "PART_BYTES", 1)
    assert common.worth(docs) >= 64
    monkeypatch.setattr(ed, "LEAST_ROWS", 16)
    assert len(merge_runs(digest_runs(docs.repartition(8))).inputFiles()) == 4


def test_lanes_meet_in_binary_rounds(spark, monkeypatch):
    """Lanes exchange log2 times, each of a pair's rows goes to one of the two, and nothing is sorted again."""
    plans = []
    monkeypatch.setattr(ed, "saved", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or saved(df))
    docs = docs_of(spark, [(i, f"text {i % 300}") for i in range(1000)]).repartition(6)
    runs = digest_runs(docs)
    assert merge_runs(runs, lanes=8).count() == 300
    plan = plans[-1]
    assert plan.count("REPARTITION_BY_NUM") == 3 and "Sort" not in plan and "Aggregate" not in plan
    run = pa.table({"key": sorted(sha_key(i) for i in range(500)), "lane": pa.array([5] * 500, pa.int32())})
    sent = pa.Table.from_batches(ed._exchanged(run, 5, 1, 8))
    assert {x.as_py() for x in sent["lane"]} == {5, 7} and sent["key"].equals(run["key"])
    assert all((int.from_bytes(k.as_py()[:4]) & 2) == (x.as_py() & 2) for k, x in zip(sent["key"], sent["lane"]))


def sha_key(i):
    return bytes.fromhex(sha(str(i))) + bytes(8)


@pytest.mark.parametrize("keep", ["max", "min"])
def test_merging_against_plain(keep):
    rng = random.Random(6)
    for _ in range(60):
        runs, groups, row = [], defaultdict(list), 0
        for _ in range(rng.randint(1, 5)):
            rows = []
            for k in sorted(rng.sample(range(12), rng.randint(1, 12)), key=sha_key):
                row, i, n = row + 1, rng.choice([None, *range(6)]), rng.randint(1, 3)
                rows.append((sha_key(k), i, row, 0, n))
                groups[sha_key(k)].append((i, row, n))
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            runs.append(pa.table([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=["key", "doc_id", "row_no", "lane", "group_size"]))
        got = ed.merge_all(runs, keep).to_pylist()
        assert [r["key"] for r in got] == sorted(groups)
        for r in got:
            ids = [i for i, _, _ in groups[r["key"]] if i is not None]
            best = (max(ids) if keep == "max" else min(ids)) if ids else None
            assert r["doc_id"] == best and r["row_no"] == max(n for i, n, _ in groups[r["key"]] if i == best) and r["group_size"] == sum(n for *_, n in groups[r["key"]])
