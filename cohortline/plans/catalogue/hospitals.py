"""Hospital registry, capacity, licences, clinicians, and how public and private hospitals are used."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...operators.quantiles import exact_quantiles
from .base import (
    CARE, HOME, SITE, Model, agg_by, at, either, mean, month_of, n, n_if, named_hospital, nd, nd_if, ordered, pct,
    per, quantile, reg, rnd, share, top, total,
)
from .enrolment import mix

# -- counts and lists -------------------------------------------------------------------------

reg("D09", "hospital_count", "", lambda t, p: mix(t.hospitals, "hospital_type"))
reg("T06", "hospital_count", "district", lambda t, p: ordered(
    agg_by(at(t.hospitals, SITE["district"], p["district"]), ["hospital_type", "hospital_sub_type"],
           n("hospital_count"), F.sum("total_bed_strength").alias("total_beds")),
    "-hospital_count", "hospital_type", "hospital_sub_type"), dated=None)
reg("T13", "hospital_count", "block", lambda t, p: ordered(
    at(t.hospitals, SITE["block"], p["block"]).select(
        "hospital_name", "hospital_type", "district_name", "total_bed_strength"), "hospital_name"), dated=None)
reg("D10", "hospital_count_by_district", "", lambda t, p: ordered(
    agg_by(t.hospitals, ["district_name", "division_name"], n("hospital_count")), "-hospital_count", "district_name"))


def density(t: Model) -> DataFrame:
    """Hospitals per 100,000 enrolled people; each side is counted per district before they meet."""
    sites = agg_by(t.hospitals, "district_name", n("hospital_count"))
    people = agg_by(t.members, "home_district_code as district_name", n("beneficiary_count"))
    out = sites.join(people, "district_name").withColumn(
        "hospitals_per_lakh", per("hospital_count", "beneficiary_count", 100000, 2))
    return ordered(out, "-hospitals_per_lakh", "district_name")


reg("D11", "hospital_density", "", lambda t, p: density(t))


def offered(t: Model) -> DataFrame:
    return t.table("hm_specialty_offered").join(
        t.hospitals.select("hospital_id", "hospital_name", "district_name", "block_name"), "hospital_id")


def coverage(df: DataFrame) -> DataFrame:
    return ordered(agg_by(df, ["specialty_code", "specialty_name"], nd("hospital_id", "hospital_count"),
                          F.sum("admissions_prev_fy").alias("admissions_prev_fy")),
                   "-hospital_count", "specialty_code")


reg("D12", "specialty_coverage", "", lambda t, p: coverage(t.table("hm_specialty_offered")))
for _q, _lvl in (("T40", "district"), ("T54", "block")):
    reg(_q, "specialty_coverage", _lvl, lambda t, p, v=_lvl: coverage(at(offered(t), SITE[v], p[v])), dated=None)
reg("T16", "hospital_specialties", "hospital", lambda t, p: ordered(
    at(offered(t), "hospital_name", p["hospital"]).select(
        "specialty_code", "specialty_name", "admissions_prev_fy", "admissions_before_last_year"),
    "-admissions_prev_fy", "specialty_code"), dated=None)
reg("T150", "hospital_payment_details", "hospital", lambda t, p: ordered(
    at(t.hospitals, "hospital_name", p["hospital"]).select("hospital_id", "hospital_name")
    .join(t.table("hm_hospital_bank_account"), "hospital_id")
    .select("hospital_name", "bank_name", "ifsc_code", "account_number_token", "authorized_signatory_name",
            "hospital_bank_id"), "hospital_bank_id").drop("hospital_bank_id"), dated=None)


def performance(t: Model, hospital: str) -> DataFrame:
    """Volume, value, speed and rejections of one hospital; a hospital without cases still shows."""
    site = at(t.hospitals, "hospital_name", hospital)
    work = t.claimed_cases.groupBy("hospital_id").agg(
        n("total_cases"), F.sum("n_claims").alias("total_claims"), F.sum("claimed").alias("claimed"),
        F.sum("tat_sum").alias("tat_sum"), F.sum("tat_n").alias("tat_n"), F.sum("n_rejected").alias("rejected_claims"))
    zero = F.lit(0)
    return site.join(work, "hospital_id", "left").select(
        "hospital_name", "hospital_type", "district_name", "total_bed_strength",
        F.coalesce("total_cases", zero).alias("total_cases"), F.coalesce("total_claims", zero).alias("total_claims"),
        rnd("claimed", 2).alias("total_claimed"), per("tat_sum", "tat_n", 1, 1).alias("avg_tat"),
        F.coalesce("rejected_claims", zero).alias("rejected_claims"))


reg("T15", "hospital_performance", "hospital", lambda t, p: performance(t, p["hospital"]))

# -- beds and staff ---------------------------------------------------------------------------


def beds(df: DataFrame) -> DataFrame:
    return ordered(agg_by(df, ["hospital_type", "hospital_sub_type"], n("hospital_count"),
                          F.sum("total_bed_strength").alias("total_beds"),
                          F.sum("inpatient_beds").alias("inpatient_beds"),
                          mean("total_bed_strength", "avg_beds_per_hospital", 0)),
                   "-total_beds", "hospital_type", "hospital_sub_type")


reg("D14", "hospital_bed_capacity", "", lambda t, p: beds(t.hospitals))
for _q, _lvl in (("T42", "district"), ("T56", "block")):
    reg(_q, "hospital_bed_capacity", _lvl, lambda t, p, v=_lvl: beds(at(t.hospitals, SITE[v], p[v])), dated=None)


def staff_ratio(t: Model, sites: DataFrame, by: list[str], beds_once: bool = False) -> DataFrame:
    """Staff per bed. The published figure counts a hospital's beds once per staff row;
    ``beds_once`` gives the plain ratio."""
    staffed = sites.join(t.table("hm_staff").groupBy("hospital_id").agg(n("n_staff")), "hospital_id", "left")
    bed_rows = F.lit(1) if beds_once else F.greatest(F.coalesce("n_staff", F.lit(0)), F.lit(1))
    out = agg_by(staffed, by, n("hospitals"), F.sum(F.col("total_bed_strength") * bed_rows).alias("total_beds"),
                 F.coalesce(F.sum("n_staff"), F.lit(0)).alias("total_staff"))
    return ordered(out.withColumn("staff_per_bed", per("total_staff", "total_beds", 1, 3)), "-staff_per_bed", *by)


_TYPES = ["hospital_type", "hospital_sub_type"]
reg("D15", "hospital_staff_ratio", "", lambda t, p: staff_ratio(t, t.hospitals, _TYPES))
reg("T43", "hospital_staff_ratio", "district",
    lambda t, p: staff_ratio(t, at(t.hospitals, SITE["district"], p["district"]), _TYPES), dated=None)
reg("T57", "hospital_staff_ratio", "block",
    lambda t, p: staff_ratio(t, at(t.hospitals, SITE["block"], p["block"]), ["hospital_type"]), dated=None)

_CROWD = "bed_overcrowding"


def monthly_load(t: Model) -> DataFrame:
    """Hospitals whose average monthly admissions exceed their beds."""
    monthly = t.cases.where(F.col("admission_datetime").isNotNull()).groupBy(
        "hospital_id", month_of("admission_datetime").alias("month")).agg(n("k"))
    load = monthly.groupBy("hospital_id").agg(mean("k", "avg_monthly_cases", 2))
    out = named_hospital(load, t, "hospital_name", "district_name", "hospital_type", "total_bed_strength")
    ratio = F.col("avg_monthly_cases") / F.col("total_bed_strength")
    out = out.where((F.col("total_bed_strength") > 0) & (F.col("avg_monthly_cases") > F.col("total_bed_strength")))
    out = out.withColumn("cases_per_bed_per_month", rnd(ratio, 3))
    return top(out, 50, "-cases_per_bed_per_month", "hospital_id").drop("hospital_id")


def load_per_bed(t: Model, district: str, bed_column: str) -> DataFrame:
    visits = at(t.cases, CARE["district"], district).groupBy("hospital_id").agg(n("case_count"))
    return named_hospital(visits, t, "hospital_name", "hospital_type", bed_column)


def above_half(t: Model, district: str) -> DataFrame:
    out = load_per_bed(t, district, "inpatient_beds").withColumn(
        "cases_per_bed_ratio", per("case_count", "inpatient_beds", 1, 2))
    return ordered(out.where(F.col("cases_per_bed_ratio") > 0.5), "-cases_per_bed_ratio", "hospital_id").drop(
        "hospital_id")


def above_average(t: Model, district: str) -> DataFrame:
    """Hospitals whose cases per bed exceed one and a half times the average of their district's hospitals."""
    out = load_per_bed(t, district, "total_bed_strength").withColumn(
        "cases_per_bed", per("case_count", "total_bed_strength", 1, 2))
    out = out.withColumn("district_avg", out.agg(F.avg("cases_per_bed")).scalar())
    out = out.where(F.col("cases_per_bed") > F.col("district_avg") * 1.5)
    out = out.withColumn("ratio_to_avg", per("cases_per_bed", "district_avg", 1, 2))
    return ordered(out.withColumn("district_avg", rnd("district_avg", 6)), "-ratio_to_avg", "hospital_id").drop(
        "hospital_id")


def occupancy(t: Model, hospital: str, as_of: str) -> DataFrame:
    site = at(t.hospitals, "hospital_name", hospital)
    since = F.date_sub(F.lit(as_of).cast("date"), 30).cast("timestamp")
    recent = t.cases.where(F.col("admission_datetime") >= since).join(site.select("hospital_id"), "hospital_id")
    out = site.select("hospital_name", "inpatient_beds").withColumn(
        "admissions_last_30_days", recent.agg(n("c")).scalar())
    return out.withColumn("estimated_avg_daily_occupancy_pct",
                          pct("admissions_last_30_days", F.col("inpatient_beds") * 30, 1))


reg("D47", _CROWD, "", lambda t, p: monthly_load(t))
reg("T83", _CROWD, "district", lambda t, p: above_half(t, p["district"]))
reg("T221", _CROWD, "district", lambda t, p: above_average(t, p["district"]))
reg("T152", _CROWD, "hospital as_of", lambda t, p: occupancy(t, p["hospital"], p["as_of"]), dated=None)


def infrastructure_gaps(t: Model) -> DataFrame:
    lacking = {"icu": ~F.col("has_icu_with_ac"), "ot": ~F.col("has_fully_equipped_ot"), "hdu": ~F.col("has_hdu")}
    out = t.hospitals.agg(n("total_hospitals"), *[n_if(c, f"no_{k}") for k, c in lacking.items()],
                          n_if(lacking["icu"] & lacking["ot"] & lacking["hdu"], "missing_all_three"))
    out = out.withColumns({f"pct_no_{k}": pct(f"no_{k}", "total_hospitals", 2) for k in lacking})
    return out.withColumn("pct_missing_all_three", pct("missing_all_three", "total_hospitals", 2))


reg("D50", "infrastructure_gaps", "", lambda t, p: infrastructure_gaps(t))

# -- licences and accreditation ---------------------------------------------------------------

_LIC = "hospital_license_status"


def licences(t: Model) -> DataFrame:
    return t.table("hm_license_certificate").join(
        t.hospitals.select("hospital_id", "hospital_name", "hospital_type", "district_name", "block_name"), "hospital_id")


def expired_share(df: DataFrame, as_of: str) -> DataFrame:
    out = df.agg(nd("hospital_id", "total_hospitals_with_licenses"),
                 nd_if(F.col("expiry_date") < F.lit(as_of).cast("date"), "hospital_id", "expired"))
    return out.withColumn("pct_expired", pct("expired", "total_hospitals_with_licenses", 2))


reg("D13", _LIC, "as_of", lambda t, p: expired_share(t.table("hm_license_certificate"), p["as_of"]))
for _q, _lvl in (("T41", "district"), ("T55", "block")):
    reg(_q, _LIC, f"{_lvl} as_of",
        lambda t, p, v=_lvl: expired_share(at(licences(t), SITE[v], p[v]), p["as_of"]), dated=None)
reg("T18", _LIC, "hospital as_of", lambda t, p: ordered(
    at(licences(t), "hospital_name", p["hospital"]).select(
        "hospital_name", "license_name", "certificate_no", "issue_date", "expiry_date",
        F.when(F.col("expiry_date") >= F.lit(p["as_of"]).cast("date"), "CURRENT").otherwise("EXPIRED").alias("status")),
    "-expiry_date", "license_name"), dated=None)

_ACC = "accreditation_status"


def accredited_approval(t: Model) -> DataFrame:
    """Mean approved share of the claimed amount at accredited and other hospitals."""
    paid = t.case_claims.where(F.col("amount_claimed") > 0).join(
        t.hospitals.select("hospital_id", "accreditation_board"), "hospital_id")
    status = F.when(F.col("accreditation_board").isNotNull(), "Accredited").otherwise("Not Accredited")
    ratio = F.col("amount_approved") / F.col("amount_claimed") * 100.0
    return ordered(agg_by(paid, [status.alias("accreditation_status")], nd("hospital_id", "hospital_count"),
                          n("total_claims"), mean(ratio, "avg_approval_rate_pct", 1)),
                   "-avg_approval_rate_pct", "accreditation_status")


def accreditation_list(t: Model, district: str, as_of: str) -> DataFrame:
    until = F.col("accreditation_valid_upto")
    status = (F.when(until.isNull(), "NOT_ACCREDITED").when(until >= F.lit(as_of).cast("date"), "VALID")
              .otherwise("EXPIRED"))
    return ordered(at(t.hospitals, SITE["district"], district).select(
        "hospital_name", "hospital_type", "accreditation_board", "accreditation_level", "accreditation_valid_upto",
        status.alias("accreditation_status")), "hospital_name")


def accredited_share(t: Model, district: str) -> DataFrame:
    held = at(t.site_cases, CARE["district"], district).agg(
        n("total_cases"), n("accredited_hospital_cases", "accreditation_board"))
    return held.withColumn("accredited_share_pct", pct("accredited_hospital_cases", "total_cases", 1))


reg("D48", _ACC, "", lambda t, p: mix(
    t.hospitals.withColumn("accreditation_board", F.coalesce("accreditation_board", F.lit("NONE"))),
    "accreditation_board", "hospital_count"))
reg("D49", _ACC, "", lambda t, p: accredited_approval(t))
reg("T84", _ACC, "district as_of", lambda t, p: accreditation_list(t, p["district"], p["as_of"]), dated=None)
reg("T213", _ACC, "district", lambda t, p: accredited_share(t, p["district"]))

_DELISTED = "delisted_with_cases"


def delisted_active(t: Model, as_of: str) -> DataFrame:
    since = F.add_months(F.lit(as_of).cast("date"), -12).cast("timestamp")
    recent = t.cases.where(F.col("admission_datetime") >= since).groupBy("hospital_id").agg(
        n("recent_case_count"), F.to_date(F.max("admission_datetime")).alias("latest_admission"))
    out = named_hospital(recent, t, "hospital_name", "district_name", "hospital_type", "delisted_from_gov_schemes")
    out = out.where("delisted_from_gov_schemes").drop("delisted_from_gov_schemes")
    return top(out, 20, "-recent_case_count", "hospital_id").drop("hospital_id")


def expired_active(t: Model, district: str, as_of: str) -> DataFrame:
    day = F.lit(as_of).cast("date")
    recent = t.cases.where(F.col("admission_datetime") >= F.date_sub(day, 365).cast("timestamp")).groupBy(
        "hospital_id").agg(n("recent_cases"))
    lapsed = at(licences(t), SITE["district"], district).where(F.col("expiry_date") < day)
    out = lapsed.select("hospital_id", "hospital_name", "hospital_type", "expiry_date").distinct().join(
        recent, "hospital_id")
    return top(out, 10, "-recent_cases", "hospital_id", "expiry_date").drop("hospital_id")


reg("D51", _DELISTED, "as_of", lambda t, p: delisted_active(t, p["as_of"]))
reg("T190", _DELISTED, "district as_of", lambda t, p: expired_active(t, p["district"], p["as_of"]), dated=None)

# -- clinicians -------------------------------------------------------------------------------

_CLIN = "clinician_workload"


def clinician_lines(t: Model) -> DataFrame:
    """Procedure lines that name a clinician, with the case they belong to."""
    line = t.table("cm_preauth_procedure_line").where(F.col("clinician_staff_id").isNotNull())
    return line.select("preauth_id", "clinician_staff_id", "hbp_procedure_code").join(
        t.preauths.select("preauth_id", "case_id"), "preauth_id")


def clinician_cases(df: DataFrame) -> DataFrame:
    return df.groupBy("clinician_staff_id").agg(nd("case_id", "case_count"))


def workload_by_hospital(t: Model) -> DataFrame:
    counts = clinician_cases(clinician_lines(t).join(t.cases.select("case_id"), "case_id"))
    staff = t.table("hm_staff").select("staff_id", "hospital_id").join(
        counts.withColumnRenamed("clinician_staff_id", "staff_id"), "staff_id")
    out = staff.groupBy("hospital_id").agg(
        nd("staff_id", "doctor_count"), mean("case_count", "avg_cases_per_doctor", 1),
        F.min("case_count").alias("min_cases"), F.max("case_count").alias("max_cases"),
        quantile("case_count", 0.75, "p75_cases"), quantile("case_count", 0.95, "p95_cases"))
    out = named_hospital(out, t, "hospital_name", "district_name", "hospital_type")
    return top(out, 50, "-avg_cases_per_doctor", "hospital_id").drop("hospital_id")


def busiest_clinicians(t: Model) -> DataFrame:
    """The 20 clinicians with most cases and the procedure each performs most (name settles ties)."""
    lines = clinician_lines(t)
    counts = clinician_cases(lines)
    done = (
        lines.join(t.procedures.select("hbp_procedure_code", "procedure_name"), "hbp_procedure_code")
        .groupBy("clinician_staff_id", "hbp_procedure_code", "procedure_name").agg(n("k"))
        .groupBy("clinician_staff_id")
        .agg(F.min_by("procedure_name", F.struct(-F.col("k"), "procedure_name")).alias("top_procedure"))
    )
    staff = t.table("hm_staff").select(F.col("staff_id").alias("clinician_staff_id"),
                                       F.col("name").alias("clinician_name"), "hospital_id")
    out = counts.join(staff, "clinician_staff_id").join(
        t.hospitals.select("hospital_id", "hospital_name"), "hospital_id").join(done, "clinician_staff_id", "left")
    return top(out, 20, "-case_count", "clinician_staff_id")


def district_workload(t: Model, district: str) -> DataFrame:
    here = at(t.cases, CARE["district"], district).select("case_id")
    return clinician_cases(clinician_lines(t).join(here, "case_id")).agg(
        n("total_clinicians"), mean("case_count", "avg_cases_per_clinician", 1),
        F.max("case_count").alias("max_cases_per_clinician"),
        quantile("case_count", 0.5, "median_cases_per_clinician"))


def staffed_lines(t: Model, district: str) -> DataFrame:
    here = at(t.site_cases, CARE["district"], district).select("case_id", "hospital_name")
    staff = t.table("hm_staff").select(F.col("staff_id").alias("clinician_staff_id"), F.col("name").alias("clinician_name"),
                                       "role_type")
    return clinician_lines(t).join(here, "case_id").join(staff, "clinician_staff_id")


_CLIN_KEYS = ["clinician_staff_id", "clinician_name", "role_type", "hospital_name"]


def clinician_value(t: Model, district: str) -> DataFrame:
    paid = staffed_lines(t, district).join(t.claims.select("case_id", "amount_approved"), "case_id")
    out = agg_by(paid, _CLIN_KEYS, nd("case_id", "case_count"), mean("amount_approved", "avg_approved_amount", 2))
    return top(out, 10, "-avg_approved_amount", "clinician_staff_id", "hospital_name").drop("clinician_staff_id")


def staffing(t: Model, hospital: str) -> DataFrame:
    site = at(t.hospitals, "hospital_name", hospital).select("hospital_id", "hospital_name")
    out = (site.join(t.table("hm_staff").groupBy("hospital_id").agg(n("staff")), "hospital_id", "left")
           .join(t.cases.groupBy("hospital_id").agg(n("visits")), "hospital_id", "left"))
    out = agg_by(out, "hospital_name", F.coalesce(F.sum("staff"), F.lit(0)).alias("total_clinicians"),
                 F.coalesce(F.sum("visits"), F.lit(0)).alias("total_cases"))
    return out.withColumn("cases_per_clinician", per("total_cases", "total_clinicians", 1, 1))


reg("D53", _CLIN, "", lambda t, p: workload_by_hospital(t))
reg("D135", _CLIN, "", lambda t, p: busiest_clinicians(t))
reg("T85", _CLIN, "district", lambda t, p: district_workload(t, p["district"]))
reg("T148", _CLIN, "hospital", lambda t, p: staffing(t, p["hospital"]), dated=None)
reg("T202", _CLIN, "district", lambda t, p: top(
    agg_by(staffed_lines(t, p["district"]), _CLIN_KEYS, nd("case_id", "case_count")),
    10, "-case_count", "clinician_staff_id", "hospital_name").drop("clinician_staff_id"), dated=None)
reg("T203", _CLIN, "district", lambda t, p: clinician_value(t, p["district"]), dated=None)

# -- billing outside the declared scope -------------------------------------------------------

_UNAUTH = "unauthorized_specialty_billing"


def unoffered_lines(t: Model, cases: DataFrame) -> DataFrame:
    """Procedure lines whose hospital does not offer the specialty."""
    declared = t.table("hm_specialty_offered").select("hospital_id", "specialty_code").distinct()
    return t.lines.join(cases.select("case_id", "hospital_id"), "case_id").join(
        declared, ["hospital_id", "specialty_code"], "left_anti")


def unauthorised(t: Model) -> DataFrame:
    out = agg_by(unoffered_lines(t, t.cases), ["hospital_id", "specialty_code as unauthorized_specialty_code"],
                 n("procedure_count"))
    out = named_hospital(out, t, "hospital_name", "district_name", "hospital_type")
    return top(out, 50, "-procedure_count", "hospital_id", "unauthorized_specialty_code").drop("hospital_id")


def unauthorised_in(t: Model, district: str) -> DataFrame:
    lines = unoffered_lines(t, at(t.cases, CARE["district"], district)).join(
        t.hospitals.select("hospital_id", "hospital_name", "hospital_type"), "hospital_id")
    return ordered(agg_by(lines, ["hospital_name", "hospital_type", "specialty_code as treated_specialty",
                                  "specialty_name as treated_specialty_name"], nd("case_id", "case_count")),
                   "-case_count", "hospital_name", "treated_specialty")


reg("D46", _UNAUTH, "", lambda t, p: unauthorised(t))
reg("T82", _UNAUTH, "district", lambda t, p: unauthorised_in(t, p["district"]), dated=None)

_RESERVED = "reserved_procedure_violations"


def reserved_lines(t: Model) -> DataFrame:
    """Procedures kept for public hospitals, billed by private ones."""
    private = at(t.hospitals, "hospital_type", "PRIVATE").select("hospital_id", "hospital_name", "hospital_type")
    return t.case_lines.where("reserved_public_hospitals_only").join(private, "hospital_id")


reg("D136", _RESERVED, "", lambda t, p: ordered(
    agg_by(reserved_lines(t), ["hospital_district as district", "hbp_procedure_code", "procedure_name"],
           nd("case_id", "private_cases"), nd("hospital_id", "private_hospitals_billing")),
    "-private_cases", "district", "hbp_procedure_code"))
reg("T204", _RESERVED, "district", lambda t, p: ordered(
    agg_by(at(reserved_lines(t), CARE["district"], p["district"]),
           ["hospital_id", "hospital_name", "hospital_type", "hbp_procedure_code", "procedure_name"],
           nd("case_id", "case_count")),
    "-case_count", "hospital_id", "hbp_procedure_code").drop("hospital_id"), dated=None)

# -- public and private use -------------------------------------------------------------------


def by_type(t: Model, cases: DataFrame, count_name: str, digits: int, amount: str | None = "total_claimed",
            share_name: str = "pct_cases") -> DataFrame:
    """Cases (and claimed amount) per hospital type, summed per hospital before the registry is joined."""
    sums = [n("k")] + ([F.sum("claimed").alias("amount")] if amount else [])
    sites = cases.groupBy("hospital_id").agg(*sums).join(t.hospitals.select("hospital_id", "hospital_type"), "hospital_id")
    out = agg_by(sites, "hospital_type", F.sum("k").alias(count_name), *([total("amount", amount)] if amount else []))
    return ordered(share(out, count_name, share_name, digits), f"-{count_name}", "hospital_type")


_USE = "hospital_type_utilization"
reg("D25", _USE, "", lambda t, p: by_type(t, t.claimed_cases, "total_cases", 2))
reg("T29", _USE, "district",
    lambda t, p: by_type(t, at(t.claimed_cases, CARE["district"], p["district"]), "case_count", 2))
reg("T63", _USE, "block", lambda t, p: by_type(
    t, t.claimed_cases.join(at(t.hospitals, SITE["block"], p["block"]).select("hospital_id"), "hospital_id"),
    "case_count", 2))
reg("T133", _USE, "division",
    lambda t, p: by_type(t, at(t.claimed_cases, CARE["division"], p["division"]), "case_count", 1))

_PP = "public_private_comparison"


def approval_by_type(t: Model) -> DataFrame:
    """Mean and median approved share per hospital type; the median is of an unbounded value, hence located exactly
    by counting rather than by holding the group."""
    paid = t.case_claims.where(F.col("amount_claimed") > 0).join(
        t.hospitals.select("hospital_id", "hospital_type"), "hospital_id")
    paid = paid.withColumn("ratio", F.col("amount_approved") / F.col("amount_claimed") * 100.0)
    out = agg_by(paid, "hospital_type", nd("hospital_id", "hospital_count"), n("total_claims"),
                 mean("ratio", "avg_approval_rate_pct", 1))
    middle = exact_quantiles(paid.select("hospital_type", "ratio"), ["hospital_type"], "ratio", {"q": 0.5})
    out = out.join(middle, "hospital_type", "left").withColumn("median_approval_rate_pct", rnd("q", 1)).drop("q")
    return ordered(out, "-avg_approval_rate_pct", "hospital_type")


def tat_by_type(t: Model) -> DataFrame:
    done = t.case_claims.where(F.col("settlement_tat_days").isNotNull()).join(
        t.hospitals.select("hospital_id", "hospital_type"), "hospital_id")
    tat = "settlement_tat_days"
    return ordered(agg_by(done, "hospital_type", nd("hospital_id", "hospital_count"), n("settled_claims"),
                          mean(tat, "avg_tat_days"), quantile(tat, 0.5, "median_tat_days"),
                          quantile(tat, 0.9, "p90_tat_days"), F.max(tat).alias("max_tat_days")),
                   "-avg_tat_days", "hospital_type")


def reliance(t: Model, kind: str) -> DataFrame:
    """Home districts by the share of their cases treated at one type of hospital."""
    treated = t.home_cases.join(t.hospitals.select("hospital_id", "hospital_type"), "hospital_id")
    label = kind.lower()
    out = agg_by(treated, "home_district_code as home_district", n("total_cases"),
                 n_if(F.col("hospital_type") == kind, f"{label}_cases"))
    return top(out.withColumn(f"{label}_pct", pct(f"{label}_cases", "total_cases", 1)), 20,
               f"-{label}_pct", "home_district")


def type_split(t: Model, cases: DataFrame, name: str) -> DataFrame:
    out = by_type(t, cases, "k", 1, amount=None, share_name=name)
    return out.select("hospital_type", "k", name)


def against_state(t: Model, district: str) -> DataFrame:
    state = type_split(t, t.cases, "state_pct").drop("k")
    local = type_split(t, at(t.cases, CARE["district"], district), "district_pct").drop("k")
    out = state.join(local, "hospital_type", "left").withColumn(
        "district_pct", F.coalesce("district_pct", F.lit(0.0)))
    return ordered(out.withColumn("difference", rnd(F.col("district_pct") - F.col("state_pct"), 1)), "hospital_type")


def home_district_of(t: Model, block: str):
    """The district of a block, as a one-value subquery (a block lies in one district)."""
    return at(t.households, HOME["block"], block).agg(F.min(HOME["district"])).scalar()


def against_district(t: Model, block: str) -> DataFrame:
    local = type_split(t, at(t.home_cases, HOME["block"], block), "block_pct").withColumnRenamed("k", "block_cases")
    wider = t.home_cases.where(F.col(HOME["district"]) == home_district_of(t, block))
    around = type_split(t, wider, "district_pct").withColumnRenamed("k", "district_cases")
    return ordered(local.join(around, "hospital_type", "full_outer"), "-block_cases", "hospital_type")


reg("D82", _PP, "", lambda t, p: approval_by_type(t))
reg("D83", _PP, "", lambda t, p: tat_by_type(t))
reg("D110", _PP, "", lambda t, p: reliance(t, "PRIVATE"))
reg("D111", _PP, "", lambda t, p: reliance(t, "PUBLIC"))
reg("T120", _PP, "district district_2", lambda t, p: ordered(
    share(agg_by(either(t.site_cases, CARE["district"], p), ["hospital_district as district_name", "hospital_type"],
                 n("case_count")), "case_count", "pct_of_district_cases", 1, within="district_name"),
    "district_name", "-case_count", "hospital_type"))
reg("T207", _PP, "district", lambda t, p: against_state(t, p["district"]))
reg("T245", _PP, "block", lambda t, p: against_district(t, p["block"]))
reg("T252", _PP, "block", lambda t, p: by_type(
    t, at(t.home_cases, HOME["block"], p["block"]), "case_count", 1, amount=None, share_name="share_pct"))
reg("T266", _PP, "district district_2", lambda t, p: ordered(
    agg_by(either(t.case_lines, CARE["district"], p).join(t.hospitals.select("hospital_id", "hospital_type"), "hospital_id"),
           ["hospital_district", "hospital_type", "specialty_code"], nd("case_id", "case_count")),
    "hospital_district", "specialty_code", "-case_count", "hospital_type"))

_MIXPP = "procedure_mix_pub_priv"


def procedure_mix(t: Model, district: str) -> DataFrame:
    """The ten most used procedures at each type of hospital."""
    used = at(t.case_lines, CARE["district"], district).join(
        t.hospitals.select("hospital_id", "hospital_type"), "hospital_id")
    out = agg_by(used, ["hospital_type", "procedure_name"], n("usage_count"))
    rank = F.row_number().over(Window.partitionBy("hospital_type").orderBy(
        F.col("usage_count").desc(), F.col("procedure_name")))
    out = out.withColumn("rnk", rank).where(F.col("rnk") <= 10)
    return ordered(out, "hospital_type", "rnk").drop("rnk")


reg("T220", _MIXPP, "district", lambda t, p: procedure_mix(t, p["district"]))
reg("T283", _MIXPP, "district district_2", lambda t, p: ordered(
    agg_by(either(t.case_lines, CARE["district"], p).join(t.hospitals.select("hospital_id", "hospital_type"), "hospital_id"),
           ["hospital_district as district", "hospital_type", "specialty_code", "procedure_name"],
           nd("case_id", "case_count")),
    "district", "hospital_type", "-case_count", "procedure_name"))
