"""The registered queries: the contract, and a spread of them against their SQL on the smallest tables."""

from __future__ import annotations

import os
import re
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from tests.check_sql import check, duck

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver tables not present")

SPREAD = [
    "S2_declared_types", "B3b_disease_class", "B12_normalise_documents", "D1_first_row", "D5_modal_value", "Q2_unique_keys", "Q3_orphans",
    "Q8_profile", "R2_missing_offers", "V1_claims_lifecycle", "V2_district_month_cube", "V4_beneficiary_journey", "D02_enrollment_summary_by_district",
    "D72_multi_hospital_admissions", "D77_readmission_rate", "D82_public_private_comparison", "D98_expenditure_concentration", "D130_readmission_rate",
    "D141_access_profile", "T02_claims_summary", "T99_enrolment_to_treatment_funnel", "T206_underperforming_districts", "T284_multi_metric_rank",
    "G0e_specialty_gap", "G6_repeat_use", "P7_claims_quality", "M5_distributions", "M16_scored_candidates", "O18_compare", "C3_nearest_site_by_rings",
    "C5_top_k_cosine", "C8_resolve_names",
]


@pytest.fixture(scope="module")
def registered():
    return entry.queries(), entry.oracle_sql(), duck(SMALL)


#: Statuses of written files, sampling, t tests, ranking, figures and sentences; tested against brute force elsewhere in this folder.
WITHOUT_SQL = {
    "S7_candidate_json", "S8_materialised_dashboards", "Q8b_sample", 
    "M16_district_month_mined", "M16_beneficiary_journey_mined", "M16_claims_lifecycle_mined", "M22_figures", "M23_summaries", "O0_additivity_guard",
}
#: Their parameters do not occur in the smallest tables.
EMPTY = {"T02_claims_summary", "T284_multi_metric_rank", "O18_compare"}
CORPUS = re.compile(r"op\d+_|pipeline$")  # registered if they are there, with tests of their own


def test_every_query_but_the_named_ones_has_sql(registered):
    queries, sqls, _ = registered
    assert set(sqls) <= set(queries)
    assert {k for k in queries if k not in sqls and not CORPUS.match(k)} == WITHOUT_SQL


def test_core_is_registered_without_the_corpus_operators(tmp_path, registered):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for folder in ("cohortline", "workload", "oracle"):
        shutil.copytree(os.path.join(root, folder), tmp_path / folder, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for file in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(os.path.join(root, file), tmp_path)
    code = "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True).stdout.splitlines()
    queries, sqls, _ = registered
    assert [set(x.split()) for x in said[-2:]] == [{k for k in names if not CORPUS.match(k)} for names in (queries, sqls)]


def test_entry_returns_rows(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["district_name", "division_name"] and df.count() > 0


def test_every_registered_query_is_lazy_enough_to_explain(spark, registered):
    queries, _, _ = registered
    for name in ("T28_claims_by_status", "D36_top_hospitals_by_claims", "T245_public_private_comparison"):
        assert queries[name](spark, SMALL).columns


@pytest.mark.parametrize("name", SPREAD)
def test_values_equal_the_sql(spark, registered, name):
    queries, sqls, con = registered
    problem, rows, _ = check(spark, con, SMALL, queries[name], sqls[name])
    assert problem == "" and (rows > 0 or name in EMPTY)
