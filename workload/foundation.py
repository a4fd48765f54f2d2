"""Sources, derived columns, selection, quality, repair and views over the operational model."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cohortline.functions import derive
from cohortline.functions.numbers import parse_number, rnd, safe_div
from cohortline.functions.text import normalise
from cohortline.operators import quality, repair, select
from cohortline.plans import views
from cohortline.plans.catalogue import StoredModel, ask
from cohortline.plans.catalogue.base import QUESTIONS
from cohortline.runtime import checkpoint_dir, cut_lineage
from cohortline.sources import readers, schema, sinks

from .catalogue import arguments
from .common import Query, bound, plain

AS_OF = "2001-06-30"
GIVEN = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark",
         "labels", "conversations"]
ABBREVIATIONS = {"red": "crimson", "ring": "circular band", "small": "compact"}
EXPECTED_ROWS = {"cm_case": 15000, "cm_claim": 15000, "bm_beneficiary": 2000, "hm_hospital": 100, "cm_payment": 9000}
PRIORITY = {"REJECTED": 5, "QUERY_RAISED": 4, "PENDING": 3, "APPROVED": 2, "SETTLED": 1}
AGING = [(30, "0-30 days"), (60, "31-60 days"), (90, "61-90 days"), (180, "91-180 days")]


def scratch(spark) -> str:
    return f"{checkpoint_dir(spark)}/cohortline-{uuid.uuid4().hex}"


# -- sources and sinks


def raw_text(spark, sf_dir):
    return readers.read_raw(spark, f"{sf_dir}/customer.parquet")


def typed_orders(spark, sf_dir):
    casts = {"o_orderkey": "int", "o_custkey": "int", "o_totalprice": "float", "o_orderdate": "timestamp"}
    return plain(readers.typed(readers.read_raw(spark, f"{sf_dir}/orders.parquet"), casts))


def _csv(spark, sf_dir, name):
    path = f"{scratch(spark)}/{name}.csv"
    spark.read.parquet(f"{sf_dir}/{name}.parquet").write.csv(path, header=True)
    return path


def inferred_csv(spark, sf_dir):
    return readers.read_inferred(spark, _csv(spark, sf_dir, "customer")).select(
        F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


def csv_parquet(spark, sf_dir):
    path = _csv(spark, sf_dir, "customer")
    return sinks.csv_to_parquet(spark, path, path[:-4] + ".parquet", path[:-4] + ".staging")


def csv_folder(spark, sf_dir):
    """A folder of CSV files converted, with what each became."""
    out = scratch(spark)
    done = sinks.csv_dir_to_parquet(spark, {n: _csv(spark, sf_dir, n) for n in ("region", "nation", "supplier")}, out, f"{out}/staging")
    rows = [spark.read.parquet(f"{out}/{n}.parquet").agg(F.lit(n).alias("name"), F.count("*").alias("row_count")) for n in ("region", "nation", "supplier")]
    return done.join(quality.stack(rows), "name")


def stored_types(spark, sf_dir):
    path = _csv(spark, sf_dir, "supplier")
    done = sinks.csv_to_parquet(spark, path, path[:-4] + ".parquet", path[:-4] + ".staging")
    return readers.retype(done).withColumn("s_suppkey", F.col("s_suppkey").cast("long"))


def written_view(t):
    return sinks.write_view(views.hospital_performance(t), f"{scratch(t.spark)}/view3")


def dashboards(t):
    """Every dashboard question, whole, with the arguments of its own query; what cannot be built or has no rows is an ERROR."""
    chosen = [q for q in QUESTIONS if q.startswith("D")]
    model = StoredModel(t)
    return sinks.materialise(t.spark, {q: lambda q=q: ask(model, q, **arguments(q)) for q in chosen}, f"{scratch(t.spark)}/dashboards")


def loaded(spark, sf_dir):
    t = readers.Tables(spark, sf_dir, ["region", "nation"])
    return t.nation.join(t.region, t.nation.n_regionkey == t.region.r_regionkey).groupBy("r_name").agg(
        F.count(F.lit(1)).alias("nations"))


# -- derived columns


def ages(t):
    return views.Staged(t).bm_beneficiary.select("beneficiary_id", "age_group")


def case_periods(t):
    return views.Staged(t).cm_case.select("case_id", "admission_month", "admission_quarter", "admission_year")


def stays(t):
    return t.cm_case.select(
        "case_id", derive.days_between("admission_datetime", "discharge_datetime").alias("length_of_stay"),
        derive.whole_days("admission_datetime", "discharge_datetime").alias("los_days"))


def case_flags(t):
    return views.Staged(t).cm_case.select("case_id", "is_emergency", "is_death", "is_lama_dama")


def normalised(t):
    return t.part.select("p_partkey", normalise(F.concat(F.lit("  What IS   "), "p_name", F.lit(" ?? ")),
                                                ABBREVIATIONS).alias("text"))


def normalised_documents(t):
    clean = normalise("text")
    return t.documents.select("doc_id", F.md5(clean).alias("digest"), F.length(clean).alias("n"))


def parsed(t):
    return t.orders.select("o_orderkey", parse_number(F.concat(F.lit("₹"), F.format_number("o_totalprice", 2))).alias("v"))


def builtins(t):
    d = F.to_date("o_orderdate")
    return t.orders.select(
        "o_orderkey", rnd("o_totalprice", 0).alias("rounded"), F.abs(-F.col("o_totalprice")).alias("absolute"),
        F.ceil("o_totalprice").alias("ceiling"), F.nullif("o_orderstatus", F.lit("F")).alias("not_f"),
        F.coalesce(F.nullif("o_orderstatus", F.lit("F")), F.lit("none")).alias("filled"),
        F.datediff(F.lit(AS_OF).cast("date"), d).alias("days"), F.date_format(F.trunc(d, "month"), "yyyy-MM-dd").alias("month"),
        F.quarter(d).alias("quarter"), F.col("o_orderpriority").ilike("%high%").alias("is_high"),
        F.upper(F.trim(F.substring("o_orderpriority", 3, 20))).alias("priority"), F.date_format(d, "yyyy-MM").alias("ym"),
        F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("epoch"))


# -- selection


def claims(t):
    return t.cm_claim


# -- quality


def tables(t):
    return {name: getattr(t, name) for name in schema.PRIMARY_KEYS}


def view_rules(t):
    v1, v2 = views.claims_lifecycle(t), views.district_month_cube(t)
    v3 = views.hospital_performance(t)
    money = quality.expectations(v1, {
        **{f"{c} is not negative": quality.all_hold(F.col(c) >= 0)
           for c in ("amount_claimed", "amount_approved", "amount_paid")},
        "gender balance": quality.share_where(F.col("gender") == "M").between(0.3, 0.7),
        "public hospitals present": quality.some_hold(F.col("hospital_type") == "PUBLIC")})
    cube = quality.expectations(v2, {
        "approval rate within 0 and 1": quality.all_hold(F.col("approval_rate").between(0, 1)),
        "rate per 1000 is not negative": quality.all_hold(F.col("claims_per_1000_beneficiaries") >= 0)})
    zero = quality.expectations(v3, {
        "idle specialties present": quality.some_hold(F.col("zero_claim_flag") == 1),
        "used specialties present": quality.some_hold(F.col("cases_treated") > 0),
        "coverage of cases": F.sum("cases_treated") * 100.0 / F.lit(t.cm_case.agg(F.count(F.lit(1))).scalar()) > 20})
    dx = quality.expectations(views.Staged(t).cm_case_diagnosis, {
        "share of NCD": quality.share_where(F.col("disease_category") == "NCD") > 0.2})
    return quality.stack([money, cube, zero, dx])


def time_order(t):
    people = t.bm_beneficiary.select("beneficiary_id", "household_id", F.col("created_at").alias("enrolled"))
    homes = t.bm_household.select("household_id", F.col("created_at").alias("founded"))
    first = t.cm_case.groupBy("beneficiary_id").agg(F.min("admission_datetime").alias("admitted"))
    cards = t.bm_card.join(people, "beneficiary_id", "left").join(first, "beneficiary_id", "left")
    return quality.stack([
        quality.order_violations(people.join(homes, "household_id", "left"), "household before person",
                                 F.col("founded") > F.col("enrolled")),
        quality.order_violations(cards, "person before card", F.col("enrolled") > F.col("issued_at")),
        quality.order_violations(cards, "card before admission", F.col("issued_at") >= F.col("admitted"))])


def two_copies(t):
    """A table against a copy with noise below the tolerance in one column and a real change in another."""
    copy = t.cm_claim.withColumns({
        "amount_claimed": F.col("amount_claimed") * (1 + 1e-12),
        "query_count": F.when(F.col("claim_status") == "QUERY_RAISED", F.col("query_count") + 1).otherwise(
            F.col("query_count"))})
    keep = ["claim_id", "claim_status", "amount_claimed", "amount_approved", "query_count"]
    return quality.parity(t.cm_claim.select(*keep), copy.select(*keep), ["claim_id"])


#: A copy of the claims that went wrong, column by column (the same text for both engines); preauth_id got lost on the way.
SPOILT = {
    "claim_id": "claim_id", "case_id": "case_id", "claim_status": "CASE WHEN claim_status = 'PENDING' THEN lower(claim_status) ELSE claim_status END",
    "submitted_at": "submitted_at", "settled_at": "CASE WHEN claim_id LIKE '%5' THEN settled_at + INTERVAL 1 SECOND ELSE settled_at END",
    "amount_claimed": "amount_claimed * (1 + 1e-12)", "amount_approved": "CASE WHEN claim_status <> 'REJECTED' THEN amount_approved END",
    "settlement_tat_days": "COALESCE(settlement_tat_days, CAST('NaN' AS DOUBLE))",
    "query_count": "CAST(CASE WHEN claim_status = 'QUERY_RAISED' THEN query_count + 1 ELSE query_count END AS DOUBLE)",
    "is_portability_claim": "is_portability_claim", "batch": "'second'",
}
LEFT_OUT, TWICE = "case_id LIKE '%77'", "claim_id LIKE '%99'"


def spoilt_copy(t):
    """All claims against a copy with rows left out and added, values changed, a column lost, one added and one of another type."""
    copy = t.cm_claim.where(f"NOT ({LEFT_OUT})").select(*[F.expr(x).alias(c) for c, x in SPOILT.items()])
    more = copy.where(TWICE).withColumn("claim_id", F.concat("claim_id", F.lit("n")))
    return quality.parity(t.cm_claim, copy.unionByName(more), ["claim_id"])


def every_table(spark, sf_dir):
    """All given tables through the checked loader, with their rows and columns."""
    t = readers.Tables(spark, sf_dir, GIVEN)
    return quality.stack(getattr(t, n).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("row_count"), F.lit(len(getattr(t, n).columns)).alias("column_count"))
                         for n in t.names())


def all_checks(t):
    return quality.stack([
        *[quality.row_count(getattr(t, n), n, k) for n, k in EXPECTED_ROWS.items()],
        *[quality.unique_key(getattr(t, n), f"{n}.{k}", [k]) for n, k in schema.PRIMARY_KEYS.items()],
        *[quality.orphans(getattr(t, c), cc, getattr(t, p), pc, f"{c}.{cc}") for c, cc, p, pc in schema.FOREIGN_KEYS],
        *[quality.null_rates(df, n) for n, df in tables(t).items()],
        *[quality.value_domain(getattr(t, n), c, allowed, f"{n}.{c}") for (n, c), allowed in schema.DOMAINS.items()],
        *[quality.date_span(getattr(t, n), c, f"{n}.{c}") for n, c in schema.DATE_SPANS], time_order(t)])


def strict_run(t):
    """Strict mode over every check of the tables: the failed ones as they were written when the job was stopped, or all if none failed."""
    out = f"{scratch(t.spark)}/failed"
    checks = cut_lineage(all_checks(t))
    try:
        return quality.require_passed(checks, out)
    except quality.ChecksFailed:
        return t.spark.read.schema(checks.schema).parquet(out)


def strict(t):
    return quality.require_passed(quality.stack([
        quality.unique_key(t.cm_case, "cm_case.case_id", ["case_id"]),
        quality.value_domain(t.cm_case, "admission_type", schema.DOMAINS["cm_case", "admission_type"], "cm_case.admission_type")]), f"{scratch(t.spark)}/failed")


# -- repair


def treated(t):
    """Hospital and specialty of each case, by its leading procedure."""
    line = t.cm_preauth_procedure_line.where(F.col("procedure_rank") == 1).select("preauth_id", "hbp_procedure_code")
    return (line.join(t.cm_preauth_request.select("preauth_id", "case_id"), "preauth_id")
            .join(t.ref_hbp_procedure_master.select("hbp_procedure_code", "specialty_code"), "hbp_procedure_code")
            .join(t.cm_case.select("case_id", "hospital_id"), "case_id").where(F.col("hospital_id").isNotNull()))


def repaired_cards(t):
    people = t.bm_beneficiary.select("beneficiary_id", "created_at")
    first = t.cm_case.groupBy("beneficiary_id").agg(F.min("admission_datetime").alias("first_admission"))
    cards = t.bm_card.join(people, "beneficiary_id").join(first, "beneficiary_id", "left")
    return repair.cards_before_admission(cards).select("card_id", "issued_at")


def foundation_queries() -> dict[str, Query]:
    b = bound
    claim_cols = ["claim_id", "claim_status", "amount_claimed"]
    return {
        "S1_raw_text": raw_text,
        "S2_declared_types": typed_orders,
        "S3_inferred_types": inferred_csv,
        "S4_csv_to_parquet": csv_parquet,
        "S4_csv_folder": csv_folder,
        "S5_stored_types": stored_types,
        "S6_written_view": b(written_view),
        "S8_materialised_dashboards": b(dashboards),
        "S9_checked_loader": loaded,
        "S9_every_table": every_table,
        "B1_age_group": b(ages),
        "B1b_age_band": b(lambda t: t.bm_beneficiary.select("beneficiary_id", derive.age_band("yob").alias("age_band"))),
        "B2_period_text": b(case_periods),
        "B2b_length_of_stay": b(stays),
        "B2c_flags": b(case_flags),
        "B3_disease_category": b(lambda t: t.cm_case_diagnosis.select(
            "case_diagnosis_id", derive.disease_category("icd_code").alias("disease_category"))),
        "B3b_disease_class": b(lambda t: t.cm_case_diagnosis.select(
            "case_diagnosis_id", derive.disease_class("icd_code").alias("disease_class"))),
        "B4_bed_buckets": b(lambda t: t.hm_hospital.select(
            "hospital_id", derive.bed_size_bucket("total_bed_strength").alias("bed_size_bucket"),
            derive.capacity_band("total_bed_strength").alias("capacity_band"))),
        "B5_licence_expired": b(lambda t: views.Staged(t).hm_license_certificate.select("hospital_license_id", "is_expired")),
        "B6_document_bucket": b(lambda t: views.beneficiary_journey(t).select("beneficiary_id", "document_count_bucket")),
        "B7_amounts": b(lambda t: t.cm_claim.select(
            "claim_id", derive.amount_diff("amount_claimed", "amount_approved").alias("amount_diff"),
            rnd(derive.approval_ratio("amount_claimed", "amount_approved"), 9).alias("approval_ratio"))),
        "B8_safe_div": b(lambda t: t.cm_claim.select(
            "claim_id", rnd(safe_div("amount_claimed", "query_count"), 6).alias("ratio"))),
        "B9_aging_bucket": b(lambda t: t.cm_claim.where("claim_status = 'PENDING'").select(
            "claim_id", derive.aging_bucket("submitted_at", F.lit(AS_OF).cast("date"), AGING, "180+ days").alias("bucket"))),
        "B10_age_bucket": b(lambda t: t.bm_beneficiary.select(
            "beneficiary_id", derive.age_bucket("yob", "dob", F.lit(AS_OF).cast("date")).alias("age_bucket"))),
        "B11_validity": b(lambda t: t.hm_license_certificate.select(
            "hospital_license_id",
            derive.validity("expiry_date", F.lit(AS_OF).cast("date"), "OPEN", "CURRENT", "EXPIRED").alias("status"))),
        "B12_normalise": b(normalised),
        "B12_normalise_documents": b(normalised_documents),
        "B13_parse_number": b(parsed),
        "B14_scalar_builtins": b(builtins),
        "D1_first_row": b(lambda t: select.first_per_key(t.cm_claim, ["case_id"], ["submitted_at", "claim_id"], claim_cols)),
        "D2_latest_row": b(lambda t: select.latest_per_key(
            t.bm_card, ["beneficiary_id"], ["issued_at", "card_id"], ["card_id", "card_status"])),
        "D3_latest_excluding": b(lambda t: select.latest_excluding(
            t.cm_preauth_request, ["case_id"], ["initiated_at", "preauth_id"], "status", ["REJECTED", "PENDING"],
            ["preauth_id", "status"])),
        "D4_primary_row": b(lambda t: select.primary_rows(t.cm_case_diagnosis, "diagnosis_rank").select("case_id", "icd_code")),
        "D5_modal_value": b(lambda t: select.modal_value(t.cm_adjudication_event, ["claim_id"], "reason_category")),
        "D6_worst_status": b(lambda t: select.worst_status(t.cm_claim, ["case_id"], "claim_status", PRIORITY, "worst")),
        "D7_first_non_null": b(lambda t: select.first_non_null(
            t.cm_adjudication_event, ["claim_id"], ["reason_category", "actor_role"])),
        "Q1_row_counts": b(lambda t: quality.stack(
            quality.row_count(getattr(t, n), n, k) for n, k in EXPECTED_ROWS.items())),
        "Q2_unique_keys": b(lambda t: quality.stack(
            quality.unique_key(getattr(t, n), f"{n}.{k}", [k]) for n, k in schema.PRIMARY_KEYS.items())),
        "Q3_orphans": b(lambda t: quality.stack(
            quality.orphans(getattr(t, c), cc, getattr(t, p), pc, f"{c}.{cc}") for c, cc, p, pc in schema.FOREIGN_KEYS)),
        "Q4_null_rates": b(lambda t: quality.stack(
            quality.null_rates(df, n) for n, df in tables(t).items())),
        "Q5_value_domains": b(lambda t: quality.stack(
            quality.value_domain(getattr(t, n), c, allowed, f"{n}.{c}") for (n, c), allowed in schema.DOMAINS.items())),
        "Q6_date_spans": b(lambda t: quality.stack(
            quality.date_span(getattr(t, n), c, f"{n}.{c}") for n, c in schema.DATE_SPANS)),
        "Q7_view_grain": b(lambda t: quality.stack([
            quality.grain(views.claims_lifecycle(t), "view1", ["case_id"], expected=15000),
            quality.grain(views.district_month_cube(t), "view2", ["district", "month"], at_least=1000),
            quality.grain(views.hospital_performance(t), "view3", ["hospital_id", "specialty_code"], at_least=200),
            quality.grain(views.beneficiary_journey(t), "view4", ["beneficiary_id"], expected=2000)])),
        "Q8_profile": b(lambda t: quality.profile(t.hm_hospital)),
        "Q8b_top_values": b(lambda t: quality.top_values(
            views.claims_lifecycle(t), ["division", "hospital_type", "specialty_code", "age_group", "claim_status"])),
        "Q8b_measure_stats": b(lambda t: quality.measure_stats(
            views.claims_lifecycle(t), ["length_of_stay", "amount_claimed", "amount_paid", "settlement_tat_days"])),
        "Q8b_sample": b(lambda t: quality.sample_rows(views.hospital_performance(t))),
        "Q9_view_expectations": b(view_rules),
        "Q10_time_order": b(time_order),
        "Q11_parity": b(two_copies),
        "Q11_parity_of_all_columns": b(spoilt_copy),
        "Q12_strict": b(strict),
        "Q12_strict_run": b(strict_run),
        "R1_date_into_window": b(repaired_cards),
        "R2_missing_offers": b(lambda t: repair.missing_offers(treated(t), t.hm_specialty_offered, "hospital_id", "specialty_code")),
        "R3_offer_coverage": b(lambda t: repair.offer_coverage(treated(t), t.hm_specialty_offered, "hospital_id", "specialty_code")),
        "V1_claims_lifecycle": b(views.claims_lifecycle),
        "V2_district_month_cube": b(views.district_month_cube),
        "V3_hospital_performance": b(views.hospital_performance),
        "V4_beneficiary_journey": b(views.beneficiary_journey),
    }
