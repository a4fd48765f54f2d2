"""The gap studies over a few rows of their own."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortline.sources.driver_binding import BoundTables
from workload import studies

DAY = dt.datetime(1997, 3, 1)


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("star"))
    tables = {
        "region": ([(0, "R")], "r_regionkey int, r_name string"),
        "nation": ([(0, "N0", 0), (1, "N1", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(k, f"C{k}", k % 2, 900.0 * k, "BUILDING") for k in range(6)],
                     "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "supplier": ([(k, f"S{k}", k % 2, 1500.0 * k) for k in range(3)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
        "part": ([(k, "p", f"Brand#{k + 1}", "T", k, 1.0) for k in range(4)],
                 "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "orders": ([(k, k % 6, "FOP"[k % 3], 1000.0 + k, DAY, "3-MEDIUM") for k in range(90)],
                   "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
        "lineitem": ([(k, (k * 3 + j) % 4, k % 3, j, 5.0, 10.0, 0.0, 0.0, "N", "O", DAY) for k in range(90) for j in (2, 1)],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                     "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_gap_studies_do_not_write_the_hospital_table(spark, star):
    assert studies.study(0, "block_flows")(spark, star).count() > 0
    made = studies._STUDIES[spark.sparkContext.applicationId, star]
    assert "hospital_performance" not in vars(made[0]) and 1 not in made
    assert studies.study(1, "summary")(spark, star).columns
    assert "hospital_performance" in vars(made[0])


def test_lines_are_ranked_once_for_all_studies(spark, star):
    studies.study(0, "specialty_gap")(spark, star)
    gap = studies._STUDIES[spark.sparkContext.applicationId, star][0]
    assert "Window" not in gap.procedures._jdf.queryExecution().toString()


def test_median_stay_is_the_exact_median(spark, star):
    studies.study(0, "block_flows")(spark, star)
    gap = studies._STUDIES[spark.sparkContext.applicationId, star][0]
    key = ["hospital_id", "hbp_procedure_code", "month"]
    rows = gap.cases.join(gap.procedures, "case_id", "left")
    want = {tuple(r[k] for k in key): r["m"] for r in rows.groupBy(*key).agg(F.percentile("los_days", F.lit(0.5)).alias("m")).collect()}
    got = {tuple(r[k] for k in key): r["median_los_days"] for r in gap.hospital_performance.collect()}
    assert got == want and len({*want.values()}) > 2
    assert BoundTables(spark, star).cm_case.count() == sum(r["case_count"] for r in gap.hospital_performance.collect())


def test_large_tables_are_read_in_small_pieces(spark, star, tmp_path):
    spark.range(6_000_000, numPartitions=1).write.option("parquet.block.size", 4 << 20).option("compression", "none").parquet(f"{tmp_path}/large")
    own = spark.newSession()  # as large as a core may read: not cut by the number of cores
    own.conf.set("spark.sql.files.minPartitionNum", "1")
    studies.study(0, "claims_per_case")(own, star)
    assert own.read.parquet(f"{tmp_path}/large").rdd.getNumPartitions() >= 3

    given = spark.newSession()
    given.conf.set("spark.sql.files.maxPartitionBytes", "64m")
    studies.study(0, "claims_per_case")(given, star)
    assert given.conf.get("spark.sql.files.maxPartitionBytes") == "64m"
