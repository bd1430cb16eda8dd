"""Every registered query against its checking SQL on the smallest tables, and the shape of the plans."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from scrubframe.plans import catalog
from scrubframe.plans.fixtures import TABLES
from tests.conftest import SMALL
from tools.check_oracle import compare

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
# Queries whose text or pixel step needs Python; all others must stay in the JVM.
PYTHON_STEPS = {"rect_similar", "fold_rects_coalesce", "detector_plugin", "redact_frames", "redact_all",
                "redact_highbit_overlay", "redact_overlay_frame", "redaction_report", "redact_frames_pixels", "redact_frames_bucketed", "redact_highbit_per_file",
                "redact_all_per_file"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    status = compare(df, duck, SQL.get(name))
    assert status.startswith(("ok", "rows")) and not status.endswith("(0)"), status
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan
    if name not in PYTHON_STEPS:
        assert "Python" not in plan and "InPandas" not in plan


def test_sql_covers_queries():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == {"form_classifier"}


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["filename", "n_boxes", "area"] and df.count() > 0


@pytest.mark.parametrize("name", ["group_head_n", "combo_sample_files", "combo_unique_n", "fetch_sampled_rows"])
def test_ranked_rows_are_limited_before_the_shuffle(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.count("Partial") >= 1


def test_rules_and_allowlist_need_no_shuffle(spark):
    from scrubframe.operators import allowlist, rules
    from scrubframe.plans.fixtures import Tables
    from scrubframe.plans.queries_boxes import RECIPE, RULE_COLUMNS
    t = Tables(spark, SMALL)
    tags = t.fx_regions
    for df in (rules.match_rules(tags, RECIPE, RULE_COLUMNS), allowlist.apply_allowlist_before_redaction(t.fx_rects),
               allowlist.allowlist_match(t.fx_texts)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan


def test_filters_reach_the_scan(spark):
    from scrubframe.operators import rects
    df = spark.read.parquet(f"{SMALL}/lineitem.parquet").selectExpr(
        "l_orderkey as filename", "l_linenumber as box_left", "l_tax as other")
    plan = rects.rects_valid(df).select("filename")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_linenumber), Not(EqualTo(l_linenumber,-1))]" in plan
    assert "l_tax" not in plan


def test_entry_without_the_text_folders(tmp_path):
    root = Path(entry.__file__).parent
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(root / name, tmp_path)
    shutil.copytree(root / "scrubframe", tmp_path / "scrubframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert done.stdout.split() == [str(len(QUERIES)), str(len(SQL))], done.stderr
