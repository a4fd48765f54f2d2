"""Operations on results, coverage, retrieval and name resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortline.functions.geo import haversine_km
from cohortline.functions.numbers import rnd
from cohortline.operators import coverage, quality, resolve, retrieval, tableops
from cohortline.plans.catalogue import ask
from cohortline.sources import schema
from oracle.catalogue import PARAMS

from .common import Query, bound
from .studies import tidy

ALIASES = {"seven": "NATION_7", "capital": "NATION_0"}
GRID = {"height": 620, "width": 730, "origin_lat": 30.0, "origin_lng": 77.0, "pixel_deg": 0.01}


def summary(t):
    """Claims per district, with its columns tagged by role."""
    return tableops.tagged(ask(t, "D18").where(F.col("district_name").isNotNull()))


def guard_matrix(t):
    """Verdict per aggregation and column of three results."""
    rows = []
    for qid in ("D18", "D33", "D14"):
        df = ask(t, qid)
        known = tableops.roles(df)
        rows += [(qid, c, r, op, tableops.policy(op, r, "temporal" in known.values())) for c, r in known.items()
                 for op in ("sum", "average", "share_of_total", "max")]
    verdicts = t.spark.createDataFrame(rows, "qid string, column string, role string, operation string, verdict string")
    sizes = ask(t, "D18").agg(F.count(F.lit(1)).alias("result_rows"))
    return verdicts.withColumn("result_rows", sizes.scalar())


def pixels(t):
    return t.customer.select(((F.col("c_custkey") * 7) % 613).cast("int").alias("row"),
                             ((F.col("c_custkey") * 13) % 727).cast("int").alias("col"),
                             F.floor(F.abs("c_acctbal")).cast("long").alias("pop"))


def cells(t):
    return coverage.grid_cells(pixels(t), **GRID)


def site_places(t):
    return t.supplier.select(
        F.concat(F.lit("HS"), F.col("s_suppkey").cast("string")).alias("hospital_id"),
        (F.lit(24.0) + (F.col("s_suppkey") * 37 % 113) / 20.0).alias("lat"),
        (F.lit(77.0) + (F.col("s_suppkey") * 53 % 131) / 18.0).alias("lng"),
        ((F.col("s_suppkey") % 10 + 1) / 10.0).alias("strength"))


def offering(t, specialty="SP2"):
    return site_places(t).join(t.hm_specialty_offered.where(F.col("specialty_code") == specialty).select("hospital_id"), "hospital_id")


def distances(t):
    return cells(t).select("r", "c", rnd(haversine_km("lat", "lng", F.lit(26.85), F.lit(80.95)), 6).alias("km"))


def catalogue_vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("entry_id"), F.col("embedding").alias("vector"), "label")


def label_queries(t):
    """One query per label: the mean vector of the label, with its first entry as the gold answer."""
    e = t.embeddings
    means = e.select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(
        F.avg(F.col("x").cast("double")).alias("m"))
    vectors = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda p: p["m"]).alias("vector"))
    gold = e.groupBy("label").agg(F.min("vec_id").alias("gold_id"))
    return vectors.join(gold, "label").select(F.col("label").alias("query_id"), "vector", "gold_id")


def nearest(t, k=10):
    return retrieval.top_k_cosine(catalogue_vectors(t), label_queries(t), k)


def recall(t):
    return retrieval.recall_report(retrieval.gold_ranks(catalogue_vectors(t), label_queries(t)), [5, 10, 20, 30])


def crowd(t):
    return retrieval.crowding(
        nearest(t, 30), label_queries(t).select("query_id", F.col("query_id").alias("query_family")),
        catalogue_vectors(t).select("entry_id", F.col("label").alias("entry_family")))


def spelled(t):
    """District names as people write them: as they are, in other case, an alias, one letter short, or something else."""
    joined = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    k, name = F.col("c_custkey") % 6, F.col("n_name")
    text = (F.when(k == 0, name).when(k == 1, F.concat(F.lit(" "), F.lower(name), F.lit(" "))).when(k == 2, "Seven")
            .when(k == 3, F.expr("substring(n_name, 2, 20)")).when(k == 4, F.concat(name, F.lit("x"))).otherwise(F.col("c_mktsegment")))
    return joined.select(text.alias("written"))


#: Names as people write them, by type: the table, and what is written in its rows (the same text for both engines).
WRITTEN = {
    "hospital": ("hm_hospital", "CASE total_bed_strength % 5 WHEN 0 THEN ' ' || lower(hospital_name) || ' ' WHEN 1 THEN substr(hospital_name, 2, 40) WHEN 2 THEN "
                                "replace(hospital_name, 'Supplier', 'The suplier') WHEN 3 THEN 'Clinic of ' || hospital_name ELSE hospital_name END"),
    "district": ("hm_hospital", "CASE total_bed_strength % 4 WHEN 0 THEN district_name || 'x' WHEN 1 THEN substr(district_name, 2, 40) WHEN 2 THEN lower(district_name) ELSE 'All' END"),
    "block": ("bm_household", "CASE WHEN home_block_name LIKE '%0 %' THEN replace(home_block_name, 'I', 'Y') WHEN home_block_name LIKE '%1 %' THEN 'seat of ' || home_block_name "
                              "ELSE substr(home_block_name, 3, 60) END"),
    "division": ("hm_hospital", "CASE total_bed_strength % 3 WHEN 0 THEN division_name || 'S' WHEN 1 THEN 'Entire State' ELSE upper(division_name) END"),
    "specialty": ("hm_specialty_offered", "CASE WHEN specialty_code IN ('SP1', 'SP2') THEN 'Cardiology' WHEN specialty_code = 'SP3' THEN 'SP3x' ELSE lower(specialty_code) END"),
    "claim_status": ("cm_claim", "CASE claim_status WHEN 'APPROVED' THEN 'approve' WHEN 'QUERY_RAISED' THEN 'query-raised' WHEN 'PENDING' THEN 'pendng' WHEN 'SETTLED' THEN "
                                 "'setled ' ELSE 'lost' END"),
    "hospital_type": ("hm_hospital", "CASE hospital_type WHEN 'PUBLIC' THEN 'govt' ELSE 'privat' END"),
}
ENTITY_ALIASES = {"specialty": {"cardiology": "SP1"}, "claim_status": {"Approve": "APPROVED"}, "hospital_type": {"govt": "PUBLIC"}}
FIXED_ENTITIES = {"claim_status": schema.DOMAINS["cm_claim", "claim_status"], "hospital_type": schema.DOMAINS["hm_hospital", "hospital_type"]}
HELD = {"district": ("hm_hospital", "district_name"), "division": ("hm_hospital", "division_name"), "block": ("bm_household", "home_block_name"),
        "specialty": ("hm_specialty_offered", "specialty_code"), "hospital": ("hm_hospital", "hospital_name")}


def resolved_entities(t):
    """Written names of seven types against the registry of their type, by its cut-off and its aliases."""
    raw = quality.stack([getattr(t, table).select(F.lit(kind).alias("entity_type"), F.expr(said).alias("raw")) for kind, (table, said) in WRITTEN.items()])
    held = resolve.registry({kind: (getattr(t, table), column) for kind, (table, column) in HELD.items()}, FIXED_ENTITIES)
    return resolve.resolve_entities(raw, held, ENTITY_ALIASES)


def entity_registry(t):
    return resolve.registry({"district": (t.hm_hospital, "district_name"), "division": (t.hm_hospital, "division_name"),
                             "specialty": (t.hm_specialty_offered, "specialty_code"), "hospital": (t.hm_hospital, "hospital_name")},
                            {"month": [str(m) for m in range(1, 13)]})


def result_queries() -> dict[str, Query]:
    def b(build):
        return bound(lambda t: tidy(build(t)))

    scalar, spread = tableops.scalar, tableops.spread
    params = {k: PARAMS[k] for k in ("district",)}
    return {
        "O0_additivity_guard": b(guard_matrix),
        "O1_sum": b(lambda t: scalar(summary(t), "sum", "amount_claimed")),
        "O2_average": b(lambda t: scalar(summary(t), "average", "total_cases")),
        "O3_min": b(lambda t: scalar(summary(t), "min", "total_cases")),
        "O4_max": b(lambda t: scalar(summary(t), "max", "total_cases")),
        "O5_count": b(lambda t: tableops.count_rows(summary(t))),
        "O6_median": b(lambda t: spread(summary(t), "median", "total_cases")),
        "O7_stdev": b(lambda t: spread(summary(t), "stdev", "total_cases")),
        "O8_percentile": b(lambda t: spread(summary(t), "percentile", "total_cases", 90)),
        "O9_range": b(lambda t: spread(summary(t), "range", "total_cases")),
        "O9_operate_default_column": b(lambda t: tableops.operate(summary(t), "sum")),
        "O9_operate_loose_name": b(lambda t: tableops.operate(summary(t), "max", "Total Cases")),
        "O10_mode": b(lambda t: tableops.frequencies(summary(t), "mode", "division_name")),
        "O11_count_distinct": b(lambda t: tableops.frequencies(summary(t), "count_distinct", "division_name")),
        "O12_share_of_total": b(lambda t: tableops.share_of_total(summary(t), "total_cases")),
        "O13_percent_change": b(lambda t: tableops.percent_change(tableops.tagged(ask(t, "T05", **params)), "case_count")),
        "O14_sort": b(lambda t: tableops.sort_rows(summary(t), "total_cases")),
        "O15_top_n": b(lambda t: tableops.first_rows(summary(t), "top_n", "total_cases")),
        "O16_bottom_n": b(lambda t: tableops.first_rows(summary(t), "bottom_n", "total_cases", 3)),
        "O17_filter_rows": b(lambda t: tableops.filter_rows(tableops.filter_rows(summary(t), "total_cases", ">", "500"),
                                                            "division_name", "contains", "a")),
        "O18_compare": b(lambda t: tableops.compare(lambda **kw: ask(t, "T02", **kw), "district",
                                                    ["NATION_7", "NATION_9", "NATION_11"])),
        "C1_grid_cells": b(cells),
        "C2_haversine": b(distances),
        "C3_nearest_site": b(lambda t: coverage.need(coverage.nearest_site(cells(t), offering(t)))),
        "C3_nearest_site_by_rings": b(lambda t: coverage.nearest_by_rings(cells(t), offering(t).select("lat", "lng").distinct())),
        "C4_coverage": b(lambda t: coverage.coverage(cells(t), offering(t))),
        "C5_top_k_cosine": b(nearest),
        "C6_recall": b(recall),
        "C6_crowding": b(crowd),
        "C7_zones": b(lambda t: retrieval.zones(nearest(t, 2), clear=1.0, margin=0.02)),
        "C7_zones_as_declared": b(lambda t: retrieval.zones(nearest(t, 2))),
        "C8_resolve_names": b(lambda t: resolve.resolve(spelled(t), "written", t.nation.select(F.col("n_name").alias("value")), ALIASES)),
        "C8_resolve_entities": b(resolved_entities),
        "C9_entity_registry": b(entity_registry),
        "C10_date_range": b(lambda t: ask(t, "T02", dates=("1997-01-01", "1997-12-31"), **params)),
    }
