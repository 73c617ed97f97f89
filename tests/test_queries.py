"""Registered queries beside their SQL on the smallest tables, and plan checks."""

import os
import re
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from chronotext.operators import ngrams
from chronotext.plans import views as V
from tests.check import compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "src_metadata", "incremental_extract", "reference_sample_stratified", "repair_temporal", "impute_all_max",
    "target_words_by_lang", "neologism_flags", "compression_ratio_o2", "nrc_o2", "ncd_o2", "feature_row",
    "evaluation_report", "binary_sweep", "best_model_gap", "performance_summary", "winsorize", "box_stats",
    "permutation_importance", "shapley_additive", "knn_exact", "tomek_removed", "knn_fit_score", "kernel_features",
    "permutation_any_model", "model_versions", "violin_density", "importance_by_subset", "correlation_by_subset",
]


@pytest.mark.parametrize("key", SAMPLE)
def test_matches_sql(spark, key):
    con = connect(SF)
    got = entry.queries()[key](spark, SF).toPandas()
    assert compare(got, con.execute(entry.oracle_sql()[key]).df()) is None


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    own = {k for k in set(queries) - set(sql) if not re.match(r"op\d+_|pipeline$", k)}
    assert own == {
        "smote", "rf_fit_score", "gbt_ovr_fit_score", "linear_svm_ovr", "train_grid", "seed_runs", "model_store",
        "tree_importance", "pca_loadings", "pca_variance", "pca_contribution", "importance_by_scale", "knn_lsh",
        "boosting_fit_score", "kernel_svm_fit_score", "permutation_learners",
    }


def test_queries_load_without_session_and_jars(tmp_path):
    """Reading the registry starts no session and reads no file beside the Spark package."""
    code = f"""
import pyspark
pyspark.__file__ = {str(tmp_path / "__init__.py")!r}
import __spark_entry__ as e
from pyspark.sql import SparkSession
assert len(e.queries()) > 100 and len(e.oracle_sql()) > 100
assert SparkSession.getActiveSession() is None
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = dict(os.environ, SPARK_HOME=str(tmp_path), PYTHONPATH=root)
    done = subprocess.run([sys.executable, "-c", code], cwd=root, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]


def test_entry(spark):
    assert entry.entry(spark).count() == 20


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", ["feature_row", "mean_by_period", "gnb_score", "evaluation_report", "winsorize"])
def test_no_python_and_no_cross_join_in_plans(spark, key):
    plan = plan_of(entry.queries()[key](spark, SF))
    for bad in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan


def test_code_needs_one_shuffle_of_the_text(spark):
    docs = V.corpus(spark, SF).select("file_name", "text")
    code = ngrams.document_code(docs, 2, model=V.reference(spark, SF), alphabet_size=65)
    assert plan_of(code).count("Exchange hashpartitioning(file_name") == 1


def test_samples_are_kept_out_without_a_shuffle_of_text(spark):
    for texts in (V.processed(spark, SF), V.corpus(spark, SF).join(V.sampled(spark, SF, "validation_ids", V.validation_ids), "file_name", "left_semi")):
        plan = texts.select("file_name", "text")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning(file_name" not in plan
        assert "Window" not in plan  # the sample is drawn once, not in every query
