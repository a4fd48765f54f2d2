from __future__ import annotations

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cohortline.sources import readers, schema, sinks


def _csv(tmp_path, text):
    path = tmp_path / "t.csv"
    path.write_text(text)
    return str(path)


def test_csv_round_trip_keeps_text_and_types(spark, tmp_path):
    path = _csv(tmp_path, 'id,name,when,flag,amount\n1,"a, b",2024-01-02 03:04:05,True,1.50\n2,,2024-01-03 00:00:00,False,\n')
    out = sinks.csv_to_parquet(spark, path, str(tmp_path / "out"), str(tmp_path / "staging"))
    assert {t for _, t in out.dtypes} == {"string"}
    assert [r["amount"] for r in out.orderBy("id").collect()] == ["1.50", None]
    back = readers.retype(spark.read.parquet(str(tmp_path / "out")))
    assert dict(back.dtypes) == {"id": "int", "name": "string", "when": "timestamp", "flag": "boolean", "amount": "double"}


def test_quoted_empty_fields_are_refused_and_leave_nothing(spark, tmp_path):
    path = _csv(tmp_path, 'id,name\n1,""\n2,x\n')
    status = sinks.csv_dir_to_parquet(spark, {"t": path}, str(tmp_path / "out"), str(tmp_path / "staging"))
    assert status.first()["status"].startswith("refused")
    assert not (tmp_path / "out").exists()


def test_declared_casts_coerce_or_fail(spark):
    df = spark.createDataFrame([("1", "x", "2024-01-02T03:04:05Z"), ("y", "2.5", "no")], "n string, v string, t string")
    got = readers.typed(df, {"n": "int", "v": "float", "t": "timestamp"}).collect()
    assert (got[0]["n"], got[0]["v"], got[1]["n"], got[1]["v"], got[1]["t"]) == (1, None, None, 2.5, None)
    with pytest.raises(Exception):
        readers.typed(df, {"n": "int"}, strict=True).collect()


def test_missing_tables_are_named(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "a.parquet"))
    with pytest.raises(FileNotFoundError, match="b, c"):
        readers.Tables(spark, str(tmp_path), ["a", "b", "c"])
    assert readers.Tables(spark, str(tmp_path), ["a"]).a.count() == 3


def test_materialise_reports_errors(spark, tmp_path):
    good = spark.range(7).withColumnRenamed("id", "n")
    bad = spark.range(3).select(F.raise_error(F.lit("no")).alias("n"))
    got = {r["query_id"]: (r["row_count"], r["status"][:5]) for r in sinks.materialise(
        spark, {"g": lambda: good, "b": lambda: bad, "e": lambda: good.where("false"), "n": lambda: good.select("no_such")}, str(tmp_path)).collect()}
    assert got == {"g": (7, "FRESH"), "b": (0, "ERROR"), "e": (0, "ERROR"), "n": (0, "ERROR")}


def test_declarations_are_consistent():
    tables = set(schema.CASTS)
    assert set(schema.PRIMARY_KEYS) <= tables and len(tables) == 21 and len(schema.FOREIGN_KEYS) == 21
    assert all(child in tables and parent in tables for child, _, parent, _ in schema.FOREIGN_KEYS)


def test_every_dashboard_question_is_materialised(spark, monkeypatch):
    from cohortline.plans.catalogue import QUESTIONS
    from cohortline.sources.driver_binding import BoundTables
    from workload import foundation

    monkeypatch.setattr(foundation.sinks, "materialise", lambda spark, queries, out: queries)
    built = foundation.dashboards(BoundTables(spark, "/root/testdata/sf0.001"))
    assert set(built) == {q for q in QUESTIONS if q.startswith("D")} and len(built) == 133
    assert all(built[q]().columns for q in built if QUESTIONS[q].params)


def test_joins_that_dashboards_share_are_written_once(spark, monkeypatch):
    from types import SimpleNamespace

    from cohortline.plans.catalogue import Model, StoredModel, base

    written = []
    monkeypatch.setattr(base, "cut_lineage", lambda df, cut=base.cut_lineage: written.append(df.columns) or cut(df))
    tables = SimpleNamespace(
        cm_case=spark.createDataFrame([("C1", "B1", 1), ("C2", "B1", 2), ("C2", "B2", 2), (None, "B3", 3), ("C4", None, 4)], "case_id string, beneficiary_id string, created_at int"),
        bm_beneficiary=spark.createDataFrame([("B1", "H1", 1, 1), ("B2", "H1", 1, 1), ("B3", None, 1, 1)], "beneficiary_id string, household_id string, created_at int, updated_at int"),
        bm_household=spark.createDataFrame([("H1", "N", 1)], "household_id string, home_district_code string, created_at int"))
    stored, plain = StoredModel(tables), Model(tables)
    for _ in range(2):
        for name in ("home_cases", "members", "cases"):
            got, want = getattr(stored, name), getattr(plain, name)
            assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert stored.home_cases.inputFiles() and len(written) == 3
    assert stored.within("admission", "2024-01-01", "2024-12-31").__class__ is Model


def test_tables_that_dashboards_share_are_written_once(spark, monkeypatch):
    from types import SimpleNamespace

    from cohortline.plans.catalogue import Model, StoredModel, base

    written = []
    monkeypatch.setattr(base, "cut_lineage", lambda df, cut=base.cut_lineage: written.append(df.columns) or cut(df))
    tables = SimpleNamespace(
        cm_preauth_procedure_line=spark.createDataFrame([("P1", "X", 1), ("P1", "X", 1), (None, "Y", 2)], "preauth_id string, hbp_procedure_code string, procedure_rank int"),
        cm_preauth_request=spark.createDataFrame([("P1", "C1"), (None, "C2")], "preauth_id string, case_id string"),
        cm_claim=spark.createDataFrame([("L1", "C1"), ("L1", "C1"), (None, None)], "claim_id string, case_id string"),
        ref_hbp_procedure_master=spark.createDataFrame([("X", "SP1")], "hbp_procedure_code string, specialty_code string"))
    stored, plain = StoredModel(tables), Model(tables)
    for _ in range(2):
        for ask in (lambda m: m.lines, lambda m: m.preauths, lambda m: m.claims, lambda m: m.table("cm_preauth_procedure_line")):
            got, want = ask(stored), ask(plain)
            assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert len(written) == 3 and stored.lines.inputFiles()


def test_cases_of_the_claims_lifecycle_are_shuffled_by_site_person_and_case_only(spark, capsys):
    from cohortline.plans.views import claims_lifecycle
    from cohortline.sources.driver_binding import BoundTables

    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large for it
    try:
        claims_lifecycle(BoundTables(spark, "/root/testdata/sf0.001")).explain("formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    moved = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[([^\]]*)\]\nArguments: hashpartitioning\((\w+?)#", capsys.readouterr().out)
    assert sorted(key for columns, key in moved if "hospital_division" in columns) == ["beneficiary_id", "case_id", "hospital_id"]
    assert not any("admission_month" in columns for columns, _ in moved)


def test_cases_without_parts_stay_in_the_claims_lifecycle(spark):
    from types import SimpleNamespace

    from cohortline.plans.views import claims_lifecycle

    def table(rows, ddl):
        return spark.createDataFrame(rows, ddl)

    at = datetime(2024, 1, 5, 9)
    tables = SimpleNamespace(
        cm_case=table([(c, p, h, "D", "V", "EMERGENCY", None, True, at, at) for c, p, h in (("C1", "B1", "H1"), ("C1", "B1", "H1"), ("C2", None, None), (None, "B9", "H9"), ("C4", "B1", "H1"))],
                      "case_id string, beneficiary_id string, hospital_id string, hospital_division string, hospital_district string, admission_type string, "
                      "discharge_type string, is_portability boolean, admission_datetime timestamp, discharge_datetime timestamp"),
        bm_beneficiary=table([("B1", "F", 1980, "HH")], "beneficiary_id string, gender string, yob long, household_id string"),
        bm_household=table([("HH", "N", "R", "SECC")], "household_id string, home_district_code string, home_division_name string, entitlement_source string"),
        hm_hospital=table([("H1", "PUBLIC", "CHC", None, 40)], "hospital_id string, hospital_type string, hospital_sub_type string, accreditation_level string, total_bed_strength long"),
        cm_case_diagnosis=table([("C1", "I10", 1), ("C1", "I11", 1), ("C4", None, 1), ("C2", "A00", 2), (None, "I10", 1)], "case_id string, icd_code string, diagnosis_rank long"),
        cm_preauth_request=table([("P1", "C1", "APPROVED", at), ("P2", "C4", "REJECTED", None), (None, "C2", "PENDING", at)], "preauth_id string, case_id string, status string, initiated_at timestamp"),
        cm_preauth_procedure_line=table([("P1", "X", 1.0, 2.0, 3.0, 1), ("P1", "Y", 4.0, 5.0, 6.0, 1), ("P1", "X", 7.0, 8.0, 9.0, 2), (None, "X", 1.0, 1.0, 1.0, 1)],
                                        "preauth_id string, hbp_procedure_code string, base_amount double, computed_final_amount double, expected_payable_amount double, procedure_rank int"),
        ref_hbp_procedure_master=table([("X", "SP1", "Care", "Name")], "hbp_procedure_code string, specialty_code string, specialty_name string, procedure_name string"),
        cm_claim=table([("L1", "C1", "SETTLED", at, 9.0, 8.0, 3.0, 0), (None, "C4", "PENDING", at, 7.0, None, None, 1)],
                       "claim_id string, case_id string, claim_status string, submitted_at timestamp, amount_claimed double, amount_approved double, settlement_tat_days double, query_count long"),
        cm_payment=table([("L1", 5.0, "SUCCESS"), ("L1", 1.0, "SUCCESS"), (None, 3.0, "FAILED")], "claim_id string, amount_paid double, payment_status string"))
    got = sorted(str(tuple(r[c] for c in ("case_id", "division", "hospital_type", "icd_code", "disease_category", "preauth_status", "specialty_code", "base_amount", "claim_status",
                                         "amount_paid", "admission_month", "is_emergency", "is_death"))) for r in claims_lifecycle(tables).collect())
    one = [("C1", "R", "PUBLIC", icd, "NCD", "APPROVED", code, base, "SETTLED", 6.0, "2024-01", 1, 0) for icd in ("I10", "I11") for code, base in (("SP1", 1.0), (None, 4.0))]
    want = [*one, *one, ("C2", None, None, None, None, "PENDING", None, None, None, None, "2024-01", 1, 0), (None, None, None, None, None, None, None, None, None, None, "2024-01", 1, 0),
            ("C4", "R", "PUBLIC", None, "UNKNOWN", "REJECTED", None, None, "PENDING", None, "2024-01", 1, 0)]
    assert got == sorted(map(str, want))
