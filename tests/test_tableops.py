from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cohortline.operators import tableops as ops

ROLES = {"hospital_name": "dimension", "case_count": "additive_count", "total_claimed": "additive_value",
         "approval_rate": "ratio", "total_beds": "snapshot_stock", "mystery": "unclassified"}


@pytest.fixture
def table(spark):
    rows = [("Alpha", 100, 5000.0, 80.0, 50, 1), ("Beta", 300, 12000.0, 60.0, 150, 2), ("Gamma", 100, 3000.0, 90.0, 100, 3)]
    df = spark.createDataFrame(rows, "hospital_name string, case_count long, total_claimed double, approval_rate double, "
                                     "total_beds long, mystery long")
    return ops.tagged(df, ROLES)


def value(df):
    return df.first()["value"]


def test_scalars_name_their_row(table):
    assert value(ops.scalar(table, "sum", "case_count")) == 500
    assert value(ops.scalar(table, "average", "total_claimed")) == pytest.approx(6666.6667, abs=1e-3)
    assert tuple(ops.scalar(table, "max", "approval_rate").first()) == (90.0, "Gamma")
    assert tuple(ops.scalar(table, "min", "case_count").first()) == (100.0, "Alpha")
    assert value(ops.count_rows(table)) == 3


def test_the_guard(table, spark):
    for operation in ops.ADDITIVE_ONLY:
        for column in ("approval_rate", "mystery", "hospital_name"):
            with pytest.raises(ops.Refused):
                ops.guard(table, operation, column)
    assert value(ops.scalar(table, "sum", "total_beds")) == 300
    over_time = ops.tagged(table.withColumn("month", F.lit("2024-01")), {**ROLES, "month": "temporal"})
    with pytest.raises(ops.Refused):
        ops.scalar(over_time, "sum", "total_beds")
    assert value(ops.spread(table, "median", "approval_rate")) == 80.0


def test_spread(table):
    assert value(ops.spread(table, "stdev", "case_count")) == pytest.approx(115.4701, abs=1e-3)
    assert value(ops.spread(table, "percentile", "case_count", 75)) == 200.0
    assert value(ops.spread(table, "range", "total_claimed")) == 9000.0
    assert value(ops.spread(table.limit(1), "stdev", "case_count")) is None
    with pytest.raises(ops.Refused):
        ops.spread(table, "percentile", "case_count", 101)


def test_frequencies(table):
    assert tuple(ops.frequencies(table, "mode", "case_count").first()) == ("100", 1, 2)
    assert ops.frequencies(table, "mode", "hospital_name").first()["ties"] == 0
    assert value(ops.frequencies(table, "count_distinct", "case_count")) == 2


def test_shares(table):
    got = {r["hospital_name"]: r["share_of_case_count_pct"] for r in ops.share_of_total(table, "case_count").collect()}
    assert got == {"Alpha": 20.0, "Beta": 60.0, "Gamma": 20.0}
    assert ops.share_of_total(table, "case_count", " beta ").first()["share_of_case_count_pct"] == 60.0


def test_percent_change_orders_by_time_and_refuses_a_zero_start(spark):
    def change(rows):
        return ops.percent_change(ops.tagged(spark.createDataFrame(rows, "month string, cases double")), "cases").first()

    assert change([("2024-03", 150.0), ("2024-01", 100.0), ("2024-02", 7.0)])["value"] == 50.0
    assert change([("2024-01", -100.0), ("2024-02", -50.0)])["value"] == 50.0
    assert change([("2024-01", 0.0), ("2024-02", 5.0)])["refused"] == "zero start"
    assert change([("2024-01", 4.0)])["refused"] == "too few values"


def test_rows(table):
    def names(df):
        return [r["hospital_name"] for r in df.collect()]

    assert names(ops.sort_rows(table, "approval_rate")) == ["Gamma", "Alpha", "Beta"]
    assert names(ops.first_rows(table, "top_n", "case_count", 2)) == ["Beta", "Alpha"]
    assert names(ops.first_rows(table, "bottom_n", "case_count", 1)) == ["Alpha"]
    assert names(ops.filter_rows(table, "total_claimed", ">=", "₹5,000")) == ["Alpha", "Beta"]
    assert names(ops.filter_rows(table, "hospital_name", "contains", "ALP")) == ["Alpha"]
    assert names(ops.filter_rows(table, "hospital_name", "!=", "beta")) == ["Alpha", "Gamma"]
    with pytest.raises(ops.Refused):
        ops.filter_rows(table, "case_count", ">", "many")


def test_roles_by_rule():
    assert {n: ops.role_of(n) for n in ("month", "claim_id", "approval_rate_pct", "total_beds", "total_claimed", "case_count",
                                        "district_name", "zzz")} == {
        "month": "temporal", "claim_id": "identifier", "approval_rate_pct": "ratio", "total_beds": "snapshot_stock",
        "total_claimed": "additive_value", "case_count": "additive_count", "district_name": "dimension", "zzz": "unclassified"}


def test_compare_tags_and_stacks(spark):
    def ask(place):
        return spark.createDataFrame([(place, 1)], "place string, n int")

    got = ops.compare(ask, "place", ["a", "b"]).collect()
    assert [(r["place"], r["compared_value"]) for r in got] == [("a", "a"), ("b", "b")]
    with pytest.raises(ops.Refused):
        ops.compare(ask, "place", list("abcde"))


def test_operate_resolves_columns_and_refuses(table):
    assert ops.operate(table, "sum").first()["value"] == ops.scalar(table, "sum", "total_claimed").first()["value"]
    assert ops.operate(table, "max", " Case Count").first()["label"] == "Beta"
    assert ops.operate(table, "max", "case").first()["value"] == ops.scalar(table, "max", "case_count").first()["value"]
    ends = ops.operate(table, "range", "case_count").first()
    assert (ends["low_label"], ends["high_label"]) == ("Alpha", "Beta") and ends["high"] - ends["low"] == ends["value"]
    assert ops.operate(table, "count").first()["value"] == 3.0
    assert ops.operate(table, "count_distinct", "hospital").first()["value"] == 3.0
    for bad in (lambda: ops.operate(table.where("false"), "sum"), lambda: ops.operate(table, "sum", "nothing like it"), lambda: ops.operate(table, "cube"),
                lambda: ops.operate(table, "sum", "approval rate")):
        with pytest.raises(ops.Refused):
            bad()
