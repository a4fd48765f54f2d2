"""The four denormalised views over the operational model, with the derived columns they need."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import derive
from ..functions.numbers import safe_div
from ..operators.select import first_per_key, latest_per_key, modal_value


def with_periods(cases: DataFrame) -> DataFrame:
    """Cases with the month, quarter and year of admission, the length of stay and flags."""
    at, out = "admission_datetime", "discharge_datetime"
    return cases.withColumns({
        "admission_month": derive.month_text(at), "admission_quarter": derive.quarter_text(at),
        "admission_year": derive.year_text(at), "length_of_stay": derive.days_between(at, out),
        "is_emergency": derive.flag(F.col("admission_type") == "EMERGENCY"),
        "is_death": derive.flag(F.col("discharge_type") == "DEATH"),
        "is_lama_dama": derive.flag(F.col("discharge_type").isin("LAMA", "DAMA"))})


class Staged:
    """Tables with their derived columns; anything not derived here is the table itself."""

    def __init__(self, tables):
        self._tables = tables

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return getattr(self._tables, name)

    @cached_property
    def last_admission(self) -> DataFrame:
        return self._tables.cm_case.agg(F.max("admission_datetime").alias("t"))

    @cached_property
    def bm_beneficiary(self) -> DataFrame:
        year = self.last_admission.select(F.year("t")).scalar()
        return self._tables.bm_beneficiary.withColumn("age_group", derive.age_group("yob", year))

    @cached_property
    def cm_case(self) -> DataFrame:
        return with_periods(self._tables.cm_case)

    @cached_property
    def cm_case_diagnosis(self) -> DataFrame:
        return self._tables.cm_case_diagnosis.withColumn("disease_category", derive.disease_category("icd_code"))

    @cached_property
    def hm_hospital(self) -> DataFrame:
        return self._tables.hm_hospital.withColumn("bed_size_bucket", derive.bed_size_bucket("total_bed_strength"))

    @cached_property
    def hm_license_certificate(self) -> DataFrame:
        return self._tables.hm_license_certificate.withColumn(
            "is_expired", derive.is_expired(F.col("expiry_date").cast("timestamp"), self.last_admission.scalar()))

    @cached_property
    def residents(self) -> DataFrame:
        """People with the geography of their household, known or not."""
        home = self.bm_household.select("household_id", "home_district_code", "home_division_name", "entitlement_source")
        return self.bm_beneficiary.join(home, "household_id", "left")

    @cached_property
    def main_lines(self) -> DataFrame:
        return self.cm_preauth_procedure_line.where(F.col("procedure_rank") == 1)


def claims_lifecycle(tables) -> DataFrame:
    """One row per case: people, place, leading diagnosis and procedure, first claim, payments.

    Requests get their line and claims their payments before they meet the cases, so that cases, with their people,
    are shuffled by person and by case only; what follows from a case's own columns is added last.
    """
    t = Staged(tables)
    people = t.residents.select("beneficiary_id", "gender", "age_group", F.col("home_division_name").alias("division"),
                                F.col("home_district_code").alias("district"))
    sites = t.hm_hospital.select("hospital_id", "hospital_type", "hospital_sub_type", "accreditation_level",
                                 "bed_size_bucket")
    dx = t.cm_case_diagnosis.where(F.col("diagnosis_rank") == 1).select("case_id", "icd_code", "disease_category")
    request = latest_per_key(t.cm_preauth_request, ["case_id"], ["initiated_at", "preauth_id"], ["preauth_id", "status"])
    line = t.main_lines.select("preauth_id", "hbp_procedure_code", "base_amount", "computed_final_amount",
                               "expected_payable_amount")
    procedure = t.ref_hbp_procedure_master.select("hbp_procedure_code", "specialty_code", "specialty_name", "procedure_name")
    claim = first_per_key(t.cm_claim, ["case_id"], ["submitted_at", "claim_id"],
                          ["claim_id", "claim_status", "amount_claimed", "amount_approved", "settlement_tat_days",
                           "query_count"])
    paid = t.cm_payment.groupBy("claim_id").agg(F.sum("amount_paid").alias("amount_paid")).join(
        modal_value(t.cm_payment, ["claim_id"], "payment_status"), "claim_id")
    asked = request.withColumnRenamed("status", "preauth_status").join(line, "preauth_id", "left").join(
        procedure, "hbp_procedure_code", "left").drop("preauth_id", "hbp_procedure_code")
    claimed = claim.join(paid, "claim_id", "left").drop("claim_id")
    cases = tables.cm_case.select("case_id", "beneficiary_id", "hospital_id", "hospital_division", "hospital_district", "admission_type", "discharge_type",
                                  "is_portability", "admission_datetime", "discharge_datetime")
    rows = cases.join(sites, "hospital_id", "left").join(people, "beneficiary_id", "left").drop("hospital_id", "beneficiary_id")
    for part in (dx, asked, claimed):
        rows = rows.join(part, "case_id", "left")
    return with_periods(rows).select(
        "case_id", "division", "district", "hospital_division", "hospital_district", "hospital_type", "hospital_sub_type",
        "specialty_code", "specialty_name", "procedure_name", "disease_category", "icd_code", "gender", "age_group",
        "admission_type", "discharge_type", "is_portability", "claim_status", "preauth_status", "payment_status",
        "accreditation_level", "bed_size_bucket", "admission_month", "admission_quarter", "admission_year",
        "length_of_stay", "is_emergency", "is_death", "is_lama_dama", "base_amount", "computed_final_amount",
        "expected_payable_amount", "amount_claimed", "amount_approved", "amount_paid", "settlement_tat_days",
        "query_count", F.lit(1).cast("long").alias("case_count"))


_ZERO_FILLED = (
    "new_beneficiaries", "new_households", "cases_admitted", "emergency_cases", "portability_cases", "deaths",
    "lama_dama_cases", "public_cases", "private_cases", "unique_hospitals", "cards_issued", "claims_submitted",
    "claims_approved", "claims_rejected", "amount_claimed", "amount_approved", "amount_paid", "payment_count",
    "payment_failures",
)


def activity_by_month(t: Staged) -> list[DataFrame]:
    """The five monthly aggregates, each on its own date, all by the home district of the person."""
    home = t.residents.select("beneficiary_id", F.col("home_district_code").alias("district"))
    case_home = t.cm_case.join(home, "beneficiary_id", "left")
    owner = case_home.select("case_id", "district")

    def month(column):
        return derive.month_text(column).alias("month")

    enrolled = t.residents.groupBy(
        F.col("home_division_name").alias("division"), F.col("home_district_code").alias("district"), month("created_at")
    ).agg(F.count("beneficiary_id").alias("new_beneficiaries"), F.countDistinct("household_id").alias("new_households"))
    cards = t.bm_card.join(home, "beneficiary_id", "left").groupBy("district", month("issued_at")).agg(
        F.count("card_id").alias("cards_issued"))
    kind = F.col("hospital_type")
    cases = case_home.join(t.hm_hospital.select("hospital_id", "hospital_type"), "hospital_id", "left").groupBy(
        "district", month("admission_datetime")).agg(
        F.count("case_id").alias("cases_admitted"), F.sum("is_emergency").alias("emergency_cases"),
        F.sum(derive.flag(F.col("is_portability"))).alias("portability_cases"), F.sum("is_death").alias("deaths"),
        F.sum("is_lama_dama").alias("lama_dama_cases"), F.sum(derive.flag(kind == "PUBLIC")).alias("public_cases"),
        F.sum(derive.flag(kind == "PRIVATE")).alias("private_cases"),
        F.countDistinct("hospital_id").alias("unique_hospitals"), F.avg("length_of_stay").alias("avg_length_of_stay"))
    status = F.col("claim_status")
    claims = t.cm_claim.join(owner, "case_id", "left").groupBy("district", month("submitted_at")).agg(
        F.count("claim_id").alias("claims_submitted"),
        F.sum(derive.flag(status.isin("APPROVED", "SETTLED"))).alias("claims_approved"),
        F.sum(derive.flag(status == "REJECTED")).alias("claims_rejected"),
        F.sum("amount_claimed").alias("amount_claimed"), F.sum("amount_approved").alias("amount_approved"),
        F.avg("settlement_tat_days").alias("avg_settlement_tat"))
    payments = (
        t.cm_payment.join(t.cm_claim.select("claim_id", "case_id"), "claim_id", "left").join(owner, "case_id", "left")
        .groupBy("district", month("payment_date")).agg(
            F.sum("amount_paid").alias("amount_paid"), F.count("payment_id").alias("payment_count"),
            F.sum(derive.flag(F.col("payment_status") == "FAILED")).alias("payment_failures")))
    return [enrolled, cases, cards, claims, payments]


def district_month_cube(tables) -> DataFrame:
    """One row per district and month.

    The five aggregates are stacked and merged by one aggregation on the key: the
    result of a chain of full outer joins with a single shuffle of small rows.
    Rows whose key is incomplete match nothing, as in a join, and stay apart.
    """
    t = Staged(tables)
    stacked = None
    for i, part in enumerate(activity_by_month(t)):
        lone = F.when(F.col("district").isNull() | F.col("month").isNull(), F.lit(i))
        part = part.withColumn("_apart", lone)
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    values = [c for c in stacked.columns if c not in ("district", "month", "_apart", "division")]
    merged = stacked.groupBy("district", "month", "_apart").agg(
        F.min("division").alias("division"), *[F.max(c).alias(c) for c in values])
    whole = Window.partitionBy("district")
    filled = merged.withColumns({c: F.coalesce(c, F.lit(0)) for c in _ZERO_FILLED}).withColumn(
        "division", F.coalesce("division", F.min("division").over(whole)))
    upto = whole.orderBy(F.col("month").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    cube = filled.withColumn("cumulative_beneficiaries", F.sum("new_beneficiaries").over(upto))
    first = F.to_date(F.concat("month", F.lit("-01")))
    doubles = [c for c in (*values, "cumulative_beneficiaries") if c != "portability_cases"]
    return cube.select(
        "division", "district", "month", *[F.col(c).cast("double").alias(c) for c in doubles],
        F.col("portability_cases").cast("long").alias("portability_cases"),
        derive.quarter_text(first).alias("quarter"), F.substring("month", 1, 4).alias("year"),
        (safe_div("cases_admitted", "cumulative_beneficiaries") * 1000.0).alias("claims_per_1000_beneficiaries"),
        safe_div("claims_approved", "claims_submitted").alias("approval_rate"),
        safe_div("emergency_cases", "cases_admitted").alias("emergency_share"),
        safe_div("deaths", "cases_admitted").alias("death_rate"),
        safe_div("public_cases", F.col("private_cases") + 1).alias("public_private_ratio"),
        safe_div("amount_claimed", "claims_submitted").alias("avg_claim_amount"))


def hospital_performance(tables) -> DataFrame:
    """One row per hospital and offered specialty, whether or not it treated anyone.

    The activity chain is deliberately not reduced to one claim or payment per
    case: repeated requests, claims and payments count again, as documented.
    """
    t = Staged(tables)
    line = t.main_lines.select("preauth_id", "hbp_procedure_code")
    master = t.ref_hbp_procedure_master.select("hbp_procedure_code", "specialty_code")
    work = (
        t.cm_case.join(t.cm_preauth_request.select("preauth_id", "case_id", "status"), "case_id", "left")
        .join(line, "preauth_id", "left").join(master, "hbp_procedure_code", "left")
        .join(t.cm_claim.drop("preauth_id"), "case_id", "left")
        .join(t.cm_payment.select("claim_id", "amount_paid"), "claim_id", "left")
    )
    done = work.groupBy("hospital_id", "specialty_code").agg(
        F.count("case_id").alias("cases_treated"),
        F.sum(derive.flag(F.col("status").isin("AUTO_APPROVED", "APPROVED"))).alias("preauth_approved"),
        F.sum(derive.flag(F.col("status") == "REJECTED")).alias("preauth_rejected"),
        F.sum(derive.flag(F.col("claim_status").isin("APPROVED", "SETTLED"))).alias("claims_approved"),
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("amount_claimed", "amount_approved", "amount_paid")],
        F.avg("settlement_tat_days").alias("avg_settlement_tat"), F.sum("is_emergency").alias("emergency_count"),
        F.sum("is_death").alias("death_count"))
    staff = t.hm_staff.groupBy("hospital_id").agg(
        F.count("staff_id").alias("total_staff"), F.avg("experience_years").alias("avg_experience_years"))
    papers = t.hm_license_certificate.groupBy("hospital_id").agg(
        F.count("hospital_license_id").alias("total_licenses"), F.sum("is_expired").alias("expired_licenses"),
        F.sum(1 - F.col("is_expired")).alias("active_licenses"))
    site = t.hm_hospital.select(
        "hospital_id", F.col("division_name").alias("division"), F.col("district_name").alias("district"), "hospital_type",
        "hospital_sub_type", "accreditation_level", "bed_size_bucket", "total_bed_strength", "inpatient_beds",
        F.col("has_fully_equipped_ot").alias("has_ot"), F.col("has_icu_with_ac").alias("has_icu"))
    rows = (
        t.hm_specialty_offered.join(site, "hospital_id", "left").join(done, ["hospital_id", "specialty_code"], "left")
        .join(staff, "hospital_id", "left").join(papers, "hospital_id", "left")
    )
    treated = F.coalesce("cases_treated", F.lit(0))
    doubles = ("preauth_approved", "preauth_rejected", "claims_approved", "emergency_count", "death_count")
    return rows.withColumns({
        "cases_treated": treated.cast("double"), "zero_claim_flag": derive.flag(treated == 0),
        "cases_per_bed": safe_div(treated, "total_bed_strength"), **{c: F.col(c).cast("double") for c in doubles}})


def beneficiary_journey(tables) -> DataFrame:
    """One row per person: latest request and card, documents, claims, and the days between the steps."""
    t = Staged(tables)
    request = latest_per_key(t.bm_enrolment_request, ["beneficiary_id"], ["submitted_at", "enrolment_request_id"],
                             ["status", "auth_mode"]).withColumnRenamed("status", "enrolment_status")
    card = latest_per_key(t.bm_card, ["beneficiary_id"], ["issued_at", "card_id"], ["card_status", "issued_at"])
    docs = t.bm_id_document.groupBy("beneficiary_id").agg(
        F.count("id_doc_id").alias("document_count"),
        F.max(derive.flag(F.col("doc_type") == "AADHAAR")).alias("has_aadhaar"))
    claims = t.cm_claim.select("case_id", "amount_claimed", "amount_approved")
    used = t.cm_case.select("case_id", "beneficiary_id", "admission_datetime").join(claims, "case_id", "left").groupBy(
        "beneficiary_id").agg(
        F.count("case_id").alias("claim_count"),
        F.coalesce(F.sum("amount_claimed"), F.lit(0.0)).alias("total_amount_claimed"),
        F.coalesce(F.sum("amount_approved"), F.lit(0.0)).alias("total_amount_approved"),
        F.min("admission_datetime").alias("first_admission"))
    rows = t.residents
    for part in (request, card, docs, used):
        rows = rows.join(part, "beneficiary_id", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("document_count", "has_aadhaar", "claim_count")})
    has_claim = derive.flag(F.col("claim_count") > 0)
    return rows.select(
        "beneficiary_id", "gender", "age_group", "bis_record_status", "is_duplicate",
        F.col("home_division_name").alias("division"), F.col("home_district_code").alias("district"), "entitlement_source",
        "enrolment_status", "auth_mode", "card_status", "document_count", "has_aadhaar", "claim_count",
        "total_amount_claimed", "total_amount_approved", has_claim.alias("has_claim"),
        derive.document_bucket("document_count").alias("document_count_bucket"),
        derive.days_between("created_at", "issued_at").alias("days_enrolment_to_card"),
        derive.days_between("issued_at", "first_admission").alias("days_card_to_first_claim"),
        has_claim.alias("claim_rate"))


VIEWS = {
    "view1_claims_lifecycle": (claims_lifecycle, ["case_id"]),
    "view2_district_month_cube": (district_month_cube, ["district", "month"]),
    "view3_hospital_performance": (hospital_performance, ["hospital_specialty_id"]),
    "view4_beneficiary_journey": (beneficiary_journey, ["beneficiary_id"]),
}
