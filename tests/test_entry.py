"""The contract of the entry points, and that the rest lives without the llm folders."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_and_names(spark):
    assert len(entry.entry(spark).columns) == 10
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 150


@pytest.mark.parametrize("name", ["clean_items", "trust_score", "rfm", "q8_promo_uplift", "split_queries", "cand_popularity_fit", "nba_decide", "catalog_hash_pairs"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    rel = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in rel.description]
    text = lambda rows: sorted(tuple(str(round(v, 6) if isinstance(v, float) else v) for v in r) for r in rows)
    got = entry.queries()[name](spark, SF).select(*columns)
    assert text(map(tuple, got.collect())) == text(rel.fetchall())


CODE = "import __spark_entry__ as e; n = e.queries(); assert len(n) > 100 and not any(x.startswith('op') or x == 'pipeline' for x in n), n; assert set(e.oracle_sql()) <= set(n)"


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_the_llm_folders(tmp_path, pipeline):
    """Without them, and with or without the pipeline's file, the rest imports; and its tests pass."""
    gone = [".git", "__pycache__", "llm"] + ["corpus_pipeline.py"] * (not pipeline)
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(*gone))
    subprocess.run([sys.executable, "-B", "-c", CODE], cwd=tmp_path / "r", check=True)
    if pipeline:
        # but for three slow ones, which import nothing else
        slow = "not without_the_llm and not broken_import and not agree and not from_a_bundle and not flawless"
        subprocess.run([sys.executable, "-B", "-m", "pytest", "tests", "-x", "-q", "-k", slow], cwd=tmp_path / "r", check=True)


def test_a_broken_import_is_an_error(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    (tmp_path / "r" / "basketry" / "llm" / "pii.py").write_text("import nothing_of_this_name\n")
    run = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__"], cwd=tmp_path / "r", capture_output=True, text=True)
    assert run.returncode and "nothing_of_this_name" in run.stderr
