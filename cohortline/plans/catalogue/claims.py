"""Claims: volume, value, status, adjudication, turnaround, payments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...operators.quantiles import exact_quantiles, order_statistics, same_keys
from ...runtime import cut_lineage
from .base import (
    CARE, HOME, SITE, Model, agg_by, at, days, either, mean, month_of, n, n_if, named_hospital, nd, nd_if, ordered, pct,
    per, quantile, reg, rnd, share, top, total,
)
from .enrolment import mix

_DISTRICT, _DIVISION = "hospital_district as district_name", "hospital_division as division_name"


def zero() -> Column:
    return F.lit(0)



def site_claimed(t: Model) -> DataFrame:
    """Cases with claim totals at registered hospitals."""
    return t.claimed_cases.join(t.hospitals, "hospital_id")


def site_claims(t: Model) -> DataFrame:
    return t.case_claims.join(t.hospitals, "hospital_id")


def home_claims(t: Model) -> DataFrame:
    return t.case_claims.join(t.members, "beneficiary_id")


# -- summaries --------------------------------------------------------------------------------


def summary(df: DataFrame, by, *, claims: bool = True, names: tuple[str, str] = ("total_claimed", "total_approved"),
            approved: bool = True, tat: bool = False, rejected: bool = False) -> DataFrame:
    """Cases, claims and amounts over cases that carry their claim totals, so nothing fans out."""
    out = [n("total_cases")]
    if claims:
        out.append(F.coalesce(F.sum("n_claims"), zero()).alias("total_claims"))
    out.append(total("claimed", names[0]))
    if approved:
        out.append(total("approved", names[1]))
    if tat:
        out.append(per(F.sum("tat_sum"), F.sum("tat_n"), 1, 1).alias("avg_tat_days"))
    if rejected:
        out.append(F.coalesce(F.sum("n_rejected"), zero()).alias("rejected_claims"))
    return agg_by(df, by, *out)


_AMOUNTS = ("amount_claimed", "amount_approved")
_CS = "claims_summary"
reg("D16", "claims_total", "",
    lambda t, p: summary(t.claimed_cases, None, names=("total_amount_claimed", "total_amount_approved")))
reg("D18", "claims_summary_by_district", "", lambda t, p: ordered(
    summary(t.claimed_cases, [_DISTRICT, _DIVISION], names=_AMOUNTS), "-total_cases", "district_name"))
reg("D19", "claims_summary_by_division", "", lambda t, p: ordered(
    summary(t.claimed_cases, _DIVISION, names=_AMOUNTS), "-total_cases", "division_name"))
reg("T02", _CS, "district",
    lambda t, p: summary(at(t.claimed_cases, CARE["district"], p["district"]), _DISTRICT, tat=True))
reg("T129", _CS, "division",
    lambda t, p: summary(at(t.claimed_cases, CARE["division"], p["division"]), _DIVISION, tat=True))
reg("T59", _CS, "block", lambda t, p: summary(at(site_claimed(t), SITE["block"], p["block"]), "block_name", tat=True))
reg("T12", _CS, "block district", lambda t, p: summary(
    at(at(site_claimed(t), SITE["block"], p["block"]), SITE["district"], p["district"]),
    ["block_name", "district_name"], claims=False, approved=False))
reg("T26", "district_comparison", "district district_2", lambda t, p: ordered(
    summary(either(t.claimed_cases, CARE["district"], p), _DISTRICT, rejected=True), "-total_cases", "district_name"))
reg("T140", _CS, "division division_2", lambda t, p: ordered(
    summary(either(t.claimed_cases, CARE["division"], p, "division"), _DIVISION, rejected=True),
    "-total_cases", "division_name"))


def year_admitted() -> Column:
    return F.year("admission_datetime").alias("year")


reg("T31", "annual_totals", "year district", lambda t, p: summary(
    at(t.claimed_cases, CARE["district"], p["district"]).where(F.year("admission_datetime") == p["year"]),
    [F.expr(_DISTRICT), year_admitted()]), dated=None)
reg("T163", "financial_summary", "year", lambda t, p: summary(
    t.claimed_cases.where(F.year("admission_datetime") == p["year"]), [year_admitted()], rejected=True), dated=None)
reg("T167", "case_volume_trend", "year", lambda t, p: ordered(
    summary(t.claimed_cases.where(F.year("admission_datetime") == p["year"]),
            [year_admitted(), F.quarter("admission_datetime").alias("quarter")]), "year", "quarter"), dated=None)
reg("T33", "case_volume_by_district", "year", lambda t, p: ordered(
    agg_by(t.claimed_cases.where(F.year("admission_datetime") == p["year"]), _DISTRICT,
           F.sum(F.greatest(F.coalesce("n_claims", zero()), F.lit(1))).alias("case_count"),
           F.coalesce(F.sum("n_claims"), zero()).alias("claim_count"), total("claimed", "total_claimed")),
    "-case_count", "district_name"), dated=None)
reg("T10", "block_case_volume", "district", lambda t, p: ordered(
    agg_by(at(site_claimed(t), SITE["district"], p["district"]), ["block_name", "district_name"],
           n("case_count"), total("claimed", "total_claimed")), "-case_count", "block_name"))


def in_month(df: DataFrame, column: str, p: dict) -> DataFrame:
    """Rows of one calendar month, as a range on the column so that it can reach the scan."""
    first = f"{int(p['year']):04d}-{int(p['month']):02d}-01"
    start = F.lit(first).cast("date")
    return df.where((F.col(column) >= start.cast("timestamp"))
                    & (F.col(column) < F.add_months(start, 1).cast("timestamp")))


def _month_year(column: str):
    return [F.month(column).alias("month"), F.year(column).alias("year")]


reg("T32", "claims_total", "month year", lambda t, p: agg_by(
    in_month(t.claims, "submitted_at", p), _month_year("submitted_at"), n("total_claims"),
    total("amount_claimed", "total_claimed"), total("amount_approved", "total_approved"),
    n_if(F.col("claim_status") == "REJECTED", "rejected_claims")), dated=None)

# -- hospitals by volume and value ------------------------------------------------------------

_TOP = "top_hospitals_by_claims"


def hospital_volume(t: Model, cases: DataFrame, *columns: str, limit: int | None = None) -> DataFrame:
    sums = cases.groupBy("hospital_id").agg(n("case_count"), total("claimed", "total_claimed"))
    out = named_hospital(sums, t, *columns)
    order = ("-case_count", "hospital_id")
    return (top(out, limit, *order) if limit else ordered(out, *order)).drop("hospital_id")


def hospital_value(t: Model) -> DataFrame:
    sums = t.case_claims.groupBy("hospital_id").agg(
        n("claim_count"), total("amount_claimed", "total_claimed"), total("amount_approved", "total_approved"))
    return ordered(named_hospital(sums, t, "hospital_name", "district_name", "hospital_type"),
                   "-total_claimed", "hospital_id").drop("hospital_id")


reg("D36", _TOP, "", lambda t, p: hospital_value(t))
reg("T03", _TOP, "district", lambda t, p: hospital_volume(
    t, at(t.claimed_cases, CARE["district"], p["district"]), "hospital_name", "hospital_type"))
reg("T64", _TOP, "block", lambda t, p: hospital_volume(
    t, t.claimed_cases.join(at(t.hospitals, SITE["block"], p["block"]).select("hospital_id"), "hospital_id"),
    "hospital_name", "hospital_type"))
reg("T136", _TOP, "division", lambda t, p: hospital_volume(
    t, at(t.claimed_cases, CARE["division"], p["division"]), "hospital_name", "hospital_type", "district_name", limit=10))

# -- case volume over time --------------------------------------------------------------------


def monthly(df: DataFrame, name: str = "case_count") -> DataFrame:
    return ordered(agg_by(df, [month_of("admission_datetime").alias("month")], n(name)), "month")


def between(df: DataFrame, column: str, p: dict) -> DataFrame:
    """Rows from ``first_day`` up to but not including ``last_day``."""
    return df.where((F.col(column) >= F.lit(p["first_day"]).cast("timestamp"))
                    & (F.col(column) < F.lit(p["last_day"]).cast("timestamp")))


_TREND = "case_volume_trend"
reg("D17", _TREND, "first_day last_day", lambda t, p: monthly(between(t.cases, "admission_datetime", p)))
reg("T05", _TREND, "district", lambda t, p: monthly(at(t.cases, CARE["district"], p["district"])))
reg("T135", _TREND, "division", lambda t, p: monthly(at(t.cases, CARE["division"], p["division"])))
for _q, _lvl in (("T17", "hospital"), ("T58", "block")):
    reg(_q, _TREND, _lvl, lambda t, p, v=_lvl: monthly(at(t.site_cases, SITE[v], p[v])))


def calendar_month_average(df: DataFrame, column: str, p: dict) -> DataFrame:
    """Cases per calendar month divided by the whole years in the range."""
    years = int(p["last_day"][:4]) - int(p["first_day"][:4])
    out = agg_by(between(df, column, p), [F.month(column).alias("month")], n("_k"))
    return ordered(out.withColumn("avg_monthly_cases", per("_k", F.lit(years), 1, 1)).drop("_k"), "month")


reg("D27", "seasonal_pattern", "first_day last_day",
    lambda t, p: calendar_month_average(t.cases, "admission_datetime", p))
reg("D61", "expenditure_trend", "first_day", lambda t, p: ordered(
    agg_by(t.case_claims.where(F.col("admission_datetime") >= F.lit(p["first_day"]).cast("timestamp")),
           [month_of("admission_datetime").alias("month")], n("claim_count"),
           total("amount_approved", "monthly_paid"), total("amount_claimed", "monthly_claimed")), "month"))

# -- status and money -------------------------------------------------------------------------


def status_mix(df: DataFrame) -> DataFrame:
    out = agg_by(df, "claim_status", n("count"), total("amount_claimed", "total_claimed"))
    return ordered(share(out, "count", "pct", 2), "-count", "claim_status")


_STATUS = "claim_status_distribution"
reg("D20", _STATUS, "", lambda t, p: status_mix(t.claims))
reg("T27", _STATUS, "district", lambda t, p: status_mix(at(t.case_claims, CARE["district"], p["district"])))
reg("T60", _STATUS, "block", lambda t, p: status_mix(at(site_claims(t), SITE["block"], p["block"])))
reg("T28", "claims_by_status", "claim_status district", lambda t, p: top(
    at(at(t.case_claims, "claim_status", p["claim_status"]), CARE["district"], p["district"])
    .join(t.hospitals.select("hospital_id", "hospital_name"), "hospital_id")
    .select("claim_id", "case_number", "hospital_name", "submitted_at", "amount_claimed", "amount_approved",
            "settlement_tat_days"), 100, "-submitted_at", "claim_id"))


def money(df: DataFrame) -> DataFrame:
    """Settled, open and rejected amounts, and everything claimed."""
    status = F.col("claim_status")

    def where(cond, amount):
        return F.when(cond, F.col(amount)).otherwise(0.0)

    return df.agg(
        total(where(status == "SETTLED", "amount_approved"), "total_settled"),
        total(where(status.isin("APPROVED", "QUERY_RAISED", "PENDING"), "amount_approved"), "total_pending"),
        total(where(status == "REJECTED", "amount_claimed"), "total_rejected"),
        total(F.coalesce("amount_claimed", F.lit(0.0)), "grand_total_claimed"))


_FIN = "financial_summary"
reg("D35", _FIN, "", lambda t, p: money(t.claims))
reg("T47", _FIN, "district", lambda t, p: money(at(t.case_claims, CARE["district"], p["district"])))
reg("T69", _FIN, "block", lambda t, p: money(at(site_claims(t), SITE["block"], p["block"])))

_HAIR = "claim_haircut"


def gap(df: DataFrame, by, digits: int) -> DataFrame:
    """Claimed minus approved, in money and as a share of the claimed amount."""
    out = agg_by(df, by, F.sum("amount_claimed").alias("c"), F.sum("amount_approved").alias("a"))
    keys = [c for c in out.columns if c not in ("c", "a")]
    return out.select(*keys, rnd("c").alias("total_claimed"), rnd("a").alias("total_approved"),
                      rnd(F.col("c") - F.col("a")).alias("gap_amount"),
                      pct(F.col("c") - F.col("a"), "c", digits).alias("gap_pct"))




def cut_share() -> Column:
    return F.when(F.col("amount_claimed") != 0, (F.col("amount_claimed") - F.col("amount_approved"))
                  / F.col("amount_claimed") * 100.0)


reg("D54", _HAIR, "", lambda t, p: gap(
    t.claims.where(F.col("amount_claimed").isNotNull() & F.col("amount_approved").isNotNull()), None, 2))
reg("T78", _HAIR, "district",
    lambda t, p: gap(at(t.case_claims, CARE["district"], p["district"]), _DISTRICT, 1))
reg("T214", _HAIR, "district", lambda t, p: ordered(
    agg_by(at(site_claims(t), CARE["district"], p["district"]), "hospital_type", n("total_claims"),
           mean(cut_share(), "avg_haircut_pct", 1)), "-avg_haircut_pct", "hospital_type"))
reg("T273", _HAIR, "district district_2", lambda t, p: ordered(
    agg_by(either(t.case_claims, CARE["district"], p), "hospital_district as district", mean(cut_share(), "avg_haircut_pct", 1),
           total("amount_claimed", "total_claimed"), total("amount_approved", "total_approved"),
           total(F.col("amount_claimed") - F.col("amount_approved"), "total_haircut")),
    "-avg_haircut_pct", "district"))

# -- approval, rejection, queries -------------------------------------------------------------

_APPR, _REJ = "claim_approval_rate", "rejection_rate"


def approved_share() -> Column:
    return F.when(F.col("amount_claimed") != 0, F.col("amount_approved") / F.col("amount_claimed") * 100.0)


def passed(df: DataFrame) -> DataFrame:
    status = F.col("claim_status")
    out = agg_by(df, "hospital_name", n("total_claims"), n_if(status == "APPROVED", "approved"),
                 n_if(status == "SETTLED", "settled"), n_if(status == "REJECTED", "rejected"))
    return out.withColumn("approval_rate_pct", pct(F.col("approved") + F.col("settled"), "total_claims", 2))


reg("T19", _APPR, "hospital", lambda t, p: passed(at(site_claims(t), "hospital_name", p["hospital"])),
    dated="submission")
reg("T113", _APPR, "district district_2", lambda t, p: ordered(
    agg_by(either(t.case_claims, CARE["district"], p), _DISTRICT, n("total_claims"),
           mean(approved_share(), "avg_approval_rate_pct", 1)), "-avg_approval_rate_pct", "district_name"))
reg("T134", _REJ, "division", lambda t, p: agg_by(
    at(t.case_claims, CARE["division"], p["division"]), _DIVISION, n("total_claims"),
    mean(approved_share(), "avg_approval_rate_pct", 1)))


def rejections(df: DataFrame, by) -> DataFrame:
    out = agg_by(df, by, n("total_claims"), n_if(F.col("claim_status") == "REJECTED", "rejected_claims"))
    return out.withColumn("rejection_rate_pct", pct("rejected_claims", "total_claims", 2))


reg("D34", _REJ, "", lambda t, p: ordered(rejections(t.claims, [month_of("submitted_at").alias("month")]), "month"))
reg("T08", _REJ, "district",
    lambda t, p: rejections(at(t.case_claims, CARE["district"], p["district"]), _DISTRICT), dated="submission")
reg("T62", _REJ, "block", lambda t, p: rejections(at(site_claims(t), SITE["block"], p["block"]), "block_name"),
    dated="submission")
reg("T34", _REJ, "month year",
    lambda t, p: rejections(in_month(t.claims, "submitted_at", p), _month_year("submitted_at")), dated=None)
reg("T124", _REJ, "district district_2", lambda t, p: ordered(
    rejections(either(t.case_claims, CARE["district"], p), _DISTRICT), "-rejection_rate_pct", "district_name"))


def queried(df: DataFrame, by, name: str) -> DataFrame:
    out = agg_by(df, by, n("total_claims"), n_if(F.col("claim_status") == "QUERY_RAISED", name))
    return out.withColumn("query_rate_pct", pct(name, "total_claims", 1))


def most_queried(t: Model) -> DataFrame:
    """Hospitals with at least ten claims, by the share of claims under query."""
    out = queried(t.case_claims, "hospital_id", "query_claims").where(F.col("total_claims") >= 10)
    return top(named_hospital(out, t, "hospital_name", "district_name", "hospital_type"), 20,
               "-query_rate_pct", "hospital_id")


def hospital_queries(t: Model, district: str) -> DataFrame:
    out = queried(at(t.case_claims, CARE["district"], district), "hospital_id", "query_raised_claims")
    return top(named_hospital(out, t, "hospital_name", "hospital_type"), 10, "-query_rate_pct", "hospital_id").drop(
        "hospital_id")


def adjudication_queries(t: Model, action: str) -> DataFrame:
    """Share of claims that were ever queried, beside the ten most frequent reasons."""
    events = t.table("cm_adjudication_event")
    reasons = agg_by(events.where(F.col("reason_category").isNotNull()), "reason_category",
                     nd("claim_id", "reason_claim_count"))
    reasons = share(reasons, "reason_claim_count", "reason_pct", 2)
    asked = events.where((F.col("action") == action) | F.col("reason_category").isNotNull()).select("claim_id").distinct()
    whole = t.claims.select("claim_id").join(asked.withColumn("_q", F.lit(True)), "claim_id", "left").agg(
        n("total_claims"), n("queried_claims", "_q"))
    whole = whole.withColumn("query_rate_pct", pct("queried_claims", "total_claims", 2))
    return top(reasons, 10, "-reason_claim_count", "reason_category").withColumns(
        {c: whole.select(c).scalar() for c in whole.columns})


_AQ = "adjudication_query_rate"
reg("D59", _AQ, "query_action", lambda t, p: adjudication_queries(t, p["query_action"]))
reg("D128", _AQ, "", lambda t, p: most_queried(t))
_DOCS = "documents_per_claim"
reg("T192", _DOCS, "district", lambda t, p: hospital_queries(t, p["district"]), dated=None)
reg("T276", _DOCS, "district district_2", lambda t, p: ordered(
    queried(either(t.case_claims, CARE["district"], p), "hospital_district as district", "query_raised"),
    "-query_rate_pct", "district"))


def documents(t: Model) -> DataFrame:
    """Claims by number of documents, with how many pass and what share of the money is approved."""
    held = t.table("cm_claim_document").groupBy("claim_id").agg(n("_docs"))
    claims = t.claims.join(held, "claim_id", "left").withColumn("doc_count", F.coalesce("_docs", zero()))
    k = F.col("doc_count")
    claims = claims.withColumn("doc_bucket", F.when(k == 0, "0 docs").when(k <= 2, "1-2 docs").when(k <= 5, "3-5 docs")
                               .when(k <= 10, "6-10 docs").otherwise("11+ docs"))
    flag = F.when(F.col("claim_status").isin("APPROVED", "SETTLED"), 1.0).otherwise(0.0)
    out = agg_by(claims, "doc_bucket", n("claim_count"), mean("doc_count", "avg_docs", 1),
                 rnd(F.avg(flag) * 100.0, 2).alias("approval_rate_pct"),
                 mean(approved_share(), "avg_amount_approval_pct", 2), F.min("doc_count").alias("_o"))
    return ordered(out, "_o").drop("_o")


reg("D58", _DOCS, "", lambda t, p: documents(t))


def rejection_reasons(t: Model) -> DataFrame:
    rejected = at(t.claims, "claim_status", "REJECTED").select("claim_id")
    reason = F.coalesce("reason_category", F.lit("UNSPECIFIED")).alias("reason_category")
    out = agg_by(t.table("cm_adjudication_event").join(rejected, "claim_id"), [reason],
                 nd("claim_id", "rejected_claim_count"))
    return top(share(out, "rejected_claim_count", "pct", 2), 10, "-rejected_claim_count", "reason_category")


reg("D60", "rejection_reasons", "", lambda t, p: rejection_reasons(t))

_MIS = "diagnosis_package_mismatch"


def mismatch_reasons(t: Model) -> DataFrame:
    """Claims per hospital and mismatch reason, against all the hospital's claims with such a reason."""
    events = t.table("cm_adjudication_event").where(
        F.col("reason_category").ilike("%mismatch%") | F.col("reason_category").ilike("%diagnosis%"))
    hit = events.select("claim_id", "reason_category").join(t.claims.select("claim_id", "case_id"), "claim_id").join(
        t.cases.select("case_id", "hospital_id"), "case_id")
    pairs = agg_by(hit, ["hospital_id", "reason_category"], nd("claim_id", "affected_claims"))
    whole = agg_by(hit, "hospital_id", nd("claim_id", "_all"))
    out = pairs.join(whole, "hospital_id").withColumn("pct_of_hospital_claims", pct("affected_claims", "_all", 1)).drop(
        "_all")
    out = named_hospital(out, t, "hospital_name", "district_name", "hospital_type")
    return top(out, 20, "-affected_claims", "hospital_id", "reason_category")


def flagged_claims(t: Model, cond) -> DataFrame:
    return t.table("cm_adjudication_event").where(cond).select("claim_id").distinct().withColumn("_hit", F.lit(True))


def mismatch_rate(t: Model, claims: DataFrame, by, cond, name: str, digits: int) -> DataFrame:
    out = agg_by(claims.join(flagged_claims(t, cond), "claim_id", "left"), by, n("total_claims"), n(name, "_hit"))
    return out.withColumn("mismatch_rate_pct", pct(name, "total_claims", digits))




def mismatch() -> Column:
    return F.col("reason_category").ilike("%mismatch%")


reg("D129", _MIS, "", lambda t, p: mismatch_reasons(t))
reg("T191", _MIS, "district", lambda t, p: top(
    named_hospital(mismatch_rate(t, at(t.case_claims, CARE["district"], p["district"]), "hospital_id", mismatch(),
                                 "mismatch_claims", 1), t, "hospital_name", "hospital_type"),
    10, "-mismatch_rate_pct", "hospital_id").drop("hospital_id"), dated=None)
reg("T275", _MIS, "district district_2", lambda t, p: ordered(
    mismatch_rate(t, either(t.case_claims, CARE["district"], p), "hospital_district as district",
                  mismatch() | F.col("reason_category").ilike("%diagnosis%"), "mismatch_queries", 2),
    "-mismatch_rate_pct", "district"), dated=None)

# -- turnaround -------------------------------------------------------------------------------

_TAT = "settlement_tat_days"


def turnaround(df: DataFrame, by, *, avg_name: str = "avg_tat", points: dict[str, float], high: bool = False,
               count: str | None = None, distinct: bool = False) -> DataFrame:
    """Mean and percentiles of the settlement time of settled claims.

    The settled claims are written once as key and time; the percentiles come from order statistics of
    what is written, so that no task holds all times of a group.
    """
    keys = [F.expr(k) if isinstance(k, str) else k for k in ([by] if isinstance(by, str) else by or [])]
    settled = cut_lineage(df.where(F.col(_TAT).isNotNull()).select(*keys, "claim_id", F.col(_TAT).cast("double").alias(_TAT)))
    names = [c for c in settled.columns if c not in ("claim_id", _TAT)]
    out = []
    if count:
        out.append(nd("claim_id", count) if distinct else n(count))
    if avg_name:
        out.append(mean(_TAT, avg_name))
    if high:
        out.append(F.max(_TAT).alias("max_tat"))
    placed = exact_quantiles(settled, names, _TAT, points).withColumns({name: rnd(name, 1) for name in points})
    return same_keys(agg_by(settled, names, *(out or [n("_rows")])), placed, names).drop("_rows")


_P = {"median_tat": 0.5, "p95_tat": 0.95}
_P3 = {"median_tat": 0.5, "p65_tat": 0.65, "p95_tat": 0.95}
_ST = "settlement_tat"
reg("D31", _ST, "", lambda t, p: turnaround(t.claims, None, points=_P3, high=True))
reg("D32", "settlement_tat_portability", "", lambda t, p: ordered(
    turnaround(t.claims, "is_portability_claim", avg_name="", points=_P3, high=True), "is_portability_claim"))
reg("D33", "settlement_tat_by_district", "", lambda t, p: ordered(
    turnaround(t.case_claims, _DISTRICT, avg_name="avg_tat_days", points={"median_tat": 0.5}, count="settled_claims"),
    "-avg_tat_days", "district_name"))
reg("T07", _ST, "district", lambda t, p: turnaround(
    at(t.case_claims, CARE["district"], p["district"]), _DISTRICT, points=_P, high=True), dated="submission")
reg("T61", _ST, "block", lambda t, p: turnaround(
    at(site_claims(t), SITE["block"], p["block"]), "block_name", points=_P, high=True), dated="submission")
reg("T114", _ST, "district district_2", lambda t, p: ordered(
    turnaround(either(t.case_claims, CARE["district"], p), _DISTRICT, avg_name="avg_tat_days",
               points={"median_tat_days": 0.5}), "avg_tat_days", "district_name"))
reg("T132", _ST, "division", lambda t, p: turnaround(
    at(t.case_claims, CARE["division"], p["division"]), _DIVISION, avg_name="avg_tat_days",
    points={"median_tat_days": 0.5, "p95_tat_days": 0.95}))
reg("T165", _ST, "month year", lambda t, p: turnaround(
    in_month(t.case_claims, "admission_datetime", p), _month_year("admission_datetime"), avg_name="avg_tat_days",
    points={"median_tat_days": 0.5}, count="total_claims"), dated=None)
reg("T215", _ST, "district", lambda t, p: ordered(
    turnaround(at(site_claims(t), CARE["district"], p["district"]), "hospital_type", avg_name="avg_tat_days",
               points={"median_tat_days": 0.5}, count="total_claims"), "avg_tat_days", "hospital_type"))

_LAG = "claim_submission_lag"


def submit_lag() -> Column:
    return days("discharge_datetime", "submitted_at")


def submitted_after_exit(df: DataFrame) -> DataFrame:
    return df.where(F.col("discharge_datetime").isNotNull() & F.col("submitted_at").isNotNull())


def cycle(t: Model) -> DataFrame:
    """Mean days of each leg from admission to settlement."""
    legs = {
        "avg_admission_to_discharge_days": ("admission_datetime", "discharge_datetime"),
        "avg_discharge_to_submission_days": ("discharge_datetime", "submitted_at"),
        "avg_submission_to_settlement_days": ("submitted_at", "settled_at"),
        "avg_total_cycle_days": ("admission_datetime", "settled_at"),
    }
    whole = t.case_claims.dropna(subset=["admission_datetime", "discharge_datetime", "submitted_at", "settled_at"])
    return whole.agg(*[mean(days(a, b), name) for name, (a, b) in legs.items()])


reg("D96", _LAG, "", lambda t, p: cycle(t))
reg("D134", _LAG, "", lambda t, p: top(
    agg_by(submitted_after_exit(t.case_claims), "hospital_district as district", n("claim_count"),
           mean(submit_lag(), "avg_lag_days"), quantile(submit_lag(), 0.5, "median_lag_days")),
    30, "-avg_lag_days", "district"))
reg("T200", _LAG, "district", lambda t, p: agg_by(
    submitted_after_exit(at(t.case_claims, CARE["district"], p["district"])), _DISTRICT, n("total_claims"),
    mean(submit_lag(), "avg_lag_days")), dated=None)
reg("T242", _LAG, "block", lambda t, p: submitted_after_exit(at(home_claims(t), HOME["block"], p["block"])).agg(
    mean(submit_lag(), "avg_lag_days"), quantile(submit_lag(), 0.5, "median_lag_days"), nd("case_id", "total_cases")),
    dated=None)


def payment_lag(t: Model, district: str) -> DataFrame:
    """Days from settlement to payment of approved claims."""
    paid = at(t.case_payments, CARE["district"], district).where(
        F.col("claim_status").isin("APPROVED", "SETTLED") & F.col("settled_at").isNotNull()
        & F.col("payment_date").isNotNull())
    return agg_by(paid, _DISTRICT, nd("claim_id", "paid_claims"),
                  mean(days("settled_at", "payment_date"), "avg_approval_to_payment_days"))


reg("T201", "payment_lag", "district", lambda t, p: payment_lag(t, p["district"]), dated=None)

# -- open claims by age -----------------------------------------------------------------------


def age_buckets(df: DataFrame, as_of: str, limits: list[tuple[int, str]], last: str, column: str) -> DataFrame:
    """Pending claims per age bucket, youngest first."""
    pending = at(df, "claim_status", "PENDING").where(F.col("submitted_at").isNotNull())
    age = F.datediff(F.lit(as_of).cast("date"), F.col("submitted_at"))
    bucket = F.when(age <= limits[0][0], limits[0][1])
    for bound, label in limits[1:]:
        bucket = bucket.when(age <= bound, label)
    return agg_by(pending.withColumn("_age", age), [bucket.otherwise(last).alias(column)], n("claim_count"),
                  total("amount_claimed", "_money"), F.min("_age").alias("_o"))


_AGING = "pending_claims_aging"
reg("D56", _AGING, "as_of", lambda t, p: ordered(
    share(age_buckets(t.claims, p["as_of"], [(7, "0-7 days"), (14, "7-14 days"), (30, "14-30 days")], "30+ days",
                      "age_bucket"), "claim_count", "pct_of_pending", 2), "_o")
    .drop("_o").withColumnRenamed("_money", "total_amount_claimed"))
reg("T80", _AGING, "district as_of", lambda t, p: ordered(
    age_buckets(at(t.case_claims, CARE["district"], p["district"]), p["as_of"],
                [(30, "0-30 days"), (60, "31-60 days"), (90, "61-90 days"), (180, "91-180 days")], "180+ days",
                "aging_bucket"), "_o").drop("_o").withColumnRenamed("_money", "total_claimed"), dated=None)

# -- payments ---------------------------------------------------------------------------------

_FAIL = "failed_payments"


def failed(t: Model) -> DataFrame:
    return at(t.case_payments, "payment_status", "FAILED")


def failing_hospitals(t: Model, df: DataFrame, count, amount: str, *columns: str) -> DataFrame:
    out = df.groupBy("hospital_id").agg(count, total("amount_paid", amount))
    return named_hospital(out, t, *columns)


_FP, _FA = "failed_payment_count", "total_failed_amount"
_HOSP = ("hospital_name", "district_name", "hospital_type")
reg("D57", _FAIL, "", lambda t, p: top(failing_hospitals(t, failed(t), n(_FP), _FA, *_HOSP), 20,
                                       f"-{_FA}", "hospital_id").drop("hospital_id"))
reg("D127", _FAIL, "", lambda t, p: top(
    failing_hospitals(t, failed(t), nd("claim_id", _FP), "failed_amount", *_HOSP), 20, f"-{_FP}", "hospital_id"))
reg("T96", _FAIL, "district", lambda t, p: ordered(
    failing_hospitals(t, at(failed(t), CARE["district"], p["district"]), n(_FP), _FA, "hospital_name", "hospital_type"),
    f"-{_FA}", "hospital_id").drop("hospital_id"), dated=None)
reg("T193", _FAIL, "district", lambda t, p: top(
    failing_hospitals(t, at(failed(t), CARE["district"], p["district"]), nd("claim_id", _FP), _FA, "hospital_name",
                      "hospital_type"), 10, f"-{_FA}", "hospital_id").drop("hospital_id"), dated=None)
reg("T151", _FAIL, "hospital", lambda t, p: agg_by(
    failed(t).join(at(t.hospitals, "hospital_name", p["hospital"]).select("hospital_id", "hospital_name"), "hospital_id"),
    "hospital_name", n(_FP), total("amount_paid", _FA)), dated=None)
reg("T274", _FAIL, "district district_2", lambda t, p: ordered(
    agg_by(either(failed(t), CARE["district"], p), "hospital_district as district", n("failed_payments"),
           total("amount_paid", "failed_amount")), "-failed_amount", "district"), dated=None)
reg("D63", "top_hospitals_by_payment", "", lambda t, p: top(
    failing_hospitals(t, at(t.case_payments, "payment_status", "SUCCESS"), n("payment_count"), "total_payment_received",
                      *_HOSP), 20, "-total_payment_received", "hospital_id").drop("hospital_id"))

# -- spend concentration ----------------------------------------------------------------------

_CONC = "expenditure_concentration"


def payment_tiers(t: Model) -> DataFrame:
    """Hospitals in tiers by payments received, and each tier's share of all payments.

    The tenth, fifth and half of the hospitals end at an order statistic of the
    payments: equal payments share a tier, and no ranking of all hospitals is needed.
    """
    paid = at(t.case_payments, "payment_status", "SUCCESS").groupBy("hospital_id").agg(
        F.sum("amount_paid").alias("paid")).join(t.hospitals.select("hospital_id"), "hospital_id")
    ranked = paid.withColumn("size", F.coalesce("paid", F.lit(float("-inf"))))

    def last_of(share: float):
        return 1 - share, F.col("_n") - F.ceil(F.col("_n") * F.lit(share))

    ends = order_statistics(ranked, [], "size", {"e10": last_of(0.10), "e20": last_of(0.20), "e50": last_of(0.50)})
    ranked = ranked.withColumns({c: ends.select(c).scalar() for c in ends.columns})
    tier = (F.when(F.col("size") >= F.col("e10"), "Top 10%").when(F.col("size") >= F.col("e20"), "Next 10% (11-20%)")
            .when(F.col("size") >= F.col("e50"), "Middle 30% (21-50%)").otherwise("Bottom 50%"))
    out = agg_by(ranked, [tier.alias("hospital_tier")], n("hospital_count"), F.sum("paid").alias("p"))
    out = out.withColumns({"tier_total_paid": rnd("p"), "share_of_total_pct": pct("p", paid.agg(F.sum("paid")).scalar(), 2)})
    return ordered(out.drop("p"), "-share_of_total_pct", "hospital_tier")


def spend_by_hospital(t: Model, cases: DataFrame, *extra: str) -> DataFrame:
    """Approved amount per hospital from cases that carry their claim totals."""
    return cases.groupBy(*extra, "hospital_id").agg(F.sum("approved").alias("spend"), F.sum("n_claims").alias("k"))


def with_first_rows(sizes: DataFrame, by: str, size: str, k: int) -> DataFrame:
    """All rows, with no ``rn``, and once more the k largest of each group with their place in ``rn``.

    One aggregation over both gives totals and the share of the first; only the
    k largest per task reach the ranking. The hospital id settles ties.
    """
    order = Window.partitionBy(by).orderBy(F.col(size).desc_nulls_last(), F.col("hospital_id").asc_nulls_last())
    first = sizes.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k)
    return sizes.withColumn("rn", F.lit(None).cast("int")).unionByName(first)


def of_all(size: str) -> Column:
    return F.sum(F.when(F.col("rn").isNull(), F.col(size)))


def of_first(size: str, k: int) -> Column:
    return F.sum(F.when(F.col("rn") <= k, F.col(size)))


def ranked_spend(t: Model, cases: DataFrame) -> DataFrame:
    """Per district: approved amount of the hospitals that have claims, and of the five largest."""
    spend = spend_by_hospital(t, cases, "hospital_district").where(F.col("k") > 0)
    return with_first_rows(spend, "hospital_district", "spend", 5)


def top_five_share(t: Model) -> DataFrame:
    rows = ranked_spend(t, t.claimed_cases)
    out = agg_by(rows, "hospital_district as district", F.coalesce(of_first("spend", 5), F.lit(0.0)).alias("five"), of_all("spend").alias("all"))
    return ordered(out.select("district", rnd("five").alias("top5_spend"), rnd("all").alias("district_total_spend"),
                              pct("five", "all", 1).alias("top5_concentration_pct")),
                   "-top5_concentration_pct", "district")


def largest_share(t: Model) -> DataFrame:
    spend = spend_by_hospital(t, t.claimed_cases, "hospital_district").where(
        (F.col("k") > 0) & F.col("hospital_district").isNotNull())
    out = agg_by(spend, "hospital_district as district", F.sum("spend").alias("all"), F.max("spend").alias("top"))
    return top(out.select("district", rnd("all").alias("district_total_spend"), rnd("top").alias("top_hospital_spend"),
                          pct("top", "all", 1).alias("top_hospital_concentration_pct")),
               20, "-top_hospital_concentration_pct", "district")


def district_spend(t: Model, district: str) -> DataFrame:
    spend = spend_by_hospital(t, at(t.claimed_cases, CARE["district"], district))
    out = named_hospital(spend, t, "hospital_name").withColumn("spend", rnd("spend")).drop("k")
    return out.withColumn("total_spend", out.agg(F.sum("spend")).scalar())


def first_five(t: Model, district: str) -> DataFrame:
    out = district_spend(t, district).withColumn("share_pct", pct("spend", "total_spend", 1))
    out = out.withColumnRenamed("spend", "hospital_spend")
    return top(out, 5, "-hospital_spend", "hospital_id").select("hospital_name", "hospital_spend", "share_pct",
                                                               "total_spend")


def running_share(t: Model, district: str) -> DataFrame:
    """The ten largest hospitals of a district with single and running shares of its spend."""
    first = top(district_spend(t, district), 10, "-spend", "hospital_id")
    order = Window.partitionBy().orderBy(F.col("spend").desc_nulls_last(), F.col("hospital_id"))
    out = first.withColumns({
        "rnk": F.row_number().over(order),
        "_run": F.sum("spend").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    return ordered(out.select("rnk", "hospital_name", "spend", pct("spend", "total_spend", 1).alias("share_pct"),
                              pct("_run", "total_spend", 1).alias("cumulative_share_pct")), "rnk")


def compare_concentration(t: Model, p: dict) -> DataFrame:
    rows = ranked_spend(t, either(t.claimed_cases, CARE["district"], p))
    out = agg_by(rows, "hospital_district as district", of_all("spend").alias("total_spend"),
                 *[of_first("spend", k).alias(f"top{k}_spend") for k in (1, 3, 5)])
    return ordered(out.withColumn("top5_share_pct", pct("top5_spend", "total_spend", 1)), "-top5_share_pct", "district")


def compare_dependence(t: Model, p: dict) -> DataFrame:
    visits = either(t.cases, CARE["district"], p).groupBy("hospital_district", "hospital_id").agg(n("k"))
    out = agg_by(with_first_rows(visits, "hospital_district", "k", 5), "hospital_district as district",
                 of_all("k").alias("total_cases"), of_first("k", 5).alias("top5_cases"))
    return ordered(out.withColumn("top5_share_pct", pct("top5_cases", "total_cases", 1)), "-top5_share_pct", "district")


_SITE3 = ("hospital_name", "hospital_type", "district_name")


def block_usage(t: Model, block: str, by_spend: bool, name: str) -> DataFrame:
    """Hospitals used by the people of one block, by cases or by approved amount."""
    cases = at(t.claimed_cases.join(t.members.select("beneficiary_id", HOME["block"]), "beneficiary_id"),
               HOME["block"], block)
    sums = cases.groupBy("hospital_id").agg(n("case_count"), F.sum("approved").alias("spend"))
    out = named_hospital(sums, t, *_SITE3)
    if by_spend:
        out = share(out, "spend", name, 1).withColumn("total_approved", rnd("spend")).drop("spend")
        return top(out, 15, "-total_approved", "hospital_id").drop("hospital_id")
    return top(share(out, "case_count", name, 1), 15, "-case_count", "hospital_id").drop("hospital_id", "spend")


def block_concentration(t: Model, block: str) -> DataFrame:
    cases = at(t.home_cases, HOME["block"], block)
    sums = named_hospital(cases.groupBy("hospital_id").agg(n("case_count")), t, *_SITE3)
    out = sums.withColumn("share_pct", pct("case_count", cases.agg(n("c")).scalar(), 1))
    return top(out, 15, "-case_count", "hospital_id").drop("hospital_id")


reg("D98", _CONC, "", lambda t, p: payment_tiers(t))
reg("D138", _CONC, "", lambda t, p: top_five_share(t))
reg("D143", _CONC, "", lambda t, p: largest_share(t))
reg("T178", _CONC, "district", lambda t, p: first_five(t, p["district"]))
reg("T205", _CONC, "district", lambda t, p: running_share(t, p["district"]))
reg("T243", _CONC, "block", lambda t, p: block_concentration(t, p["block"]))
reg("T253", _CONC, "block", lambda t, p: block_usage(t, p["block"], True, "spend_share_pct"))
reg("T254", _CONC, "block", lambda t, p: block_usage(t, p["block"], False, "admission_share_pct"))
reg("T264", _CONC, "district district_2", lambda t, p: compare_dependence(t, p))
reg("T280", _CONC, "district district_2", lambda t, p: compare_concentration(t, p))

_HC = "hospital_concentration"


def top_three(t: Model) -> DataFrame:
    visits = t.cases.groupBy("hospital_district", "hospital_id").agg(n("k"))
    out = agg_by(with_first_rows(visits, "hospital_district", "k", 3), "hospital_district as district",
                 of_first("k", 3).alias("top3_cases"), of_all("k").alias("district_total"))
    return top(out.withColumn("top3_concentration_pct", pct("top3_cases", "district_total", 1)), 20,
               "-top3_concentration_pct", "district")


def district_shares(t: Model) -> DataFrame:
    visits = t.cases.where(F.col("hospital_district").isNotNull()).groupBy(
        "hospital_id", F.col("hospital_district").alias("district")).agg(n("case_count"))
    whole = visits.groupBy("district").agg(F.sum("case_count").alias("district_total"))
    out = named_hospital(visits.join(whole, "district"), t, "hospital_name", "hospital_type")
    out = out.withColumn("intra_district_share_pct", pct("case_count", "district_total", 1))
    return top(out, 20, "-intra_district_share_pct", "hospital_id", "district")


def share_of_district(t: Model, district: str) -> DataFrame:
    visits = at(t.cases, CARE["district"], district).groupBy("hospital_id").agg(n("case_count"))
    out = share(named_hospital(visits, t, "hospital_name", "hospital_type"), "case_count", "district_share_pct", 1)
    return top(out, 10, "-case_count", "hospital_id")


reg("D112", _HC, "", lambda t, p: top_three(t))
reg("D113", _HC, "", lambda t, p: district_shares(t))
reg("T177", _HC, "district", lambda t, p: share_of_district(t, p["district"]))

# -- claim value ------------------------------------------------------------------------------

_VALUE = "claim_value_by_procedure"
_PROC = ["hbp_procedure_code", "procedure_name", "specialty_name"]
_SPEC = ["specialty_code", "specialty_name"]


def line_claims(t: Model, lines: DataFrame | None = None) -> DataFrame:
    """Procedure lines beside every claim of their case."""
    return (t.case_lines if lines is None else lines).join(t.claims.drop("preauth_id"), "case_id")


def value_by_procedure(t: Model) -> DataFrame:
    """Approved amount per leading procedure of a case."""
    main = line_claims(t, t.lines.where(F.col("procedure_rank") == 1)).where(F.col("amount_approved").isNotNull())
    a = "amount_approved"
    return top(agg_by(main, _PROC, nd("claim_id", "claim_count"), mean(a, "avg_approved", 2),
                      rnd(F.min(a)).alias("min_approved"), rnd(F.max(a)).alias("max_approved"),
                      rnd(F.stddev(a)).alias("stddev_approved")), 20, "-avg_approved", "hbp_procedure_code")


def versus_state(t: Model, df: DataFrame, everyone: DataFrame, value, names: tuple[str, str], digits: int) -> DataFrame:
    """One hospital's mean beside the overall mean, and the difference of the rounded figures."""
    mine, state = names
    out = agg_by(df, "hospital_name", mean(value, mine, digits))
    out = out.withColumn(state, everyone.agg(mean(value, "s", digits)).scalar())
    return out.withColumn("diff_from_state_avg", rnd(F.col(mine) - F.col(state), digits))


reg("D55", _VALUE, "", lambda t, p: value_by_procedure(t))
reg("T79", _VALUE, "district", lambda t, p: top(
    agg_by(at(line_claims(t), CARE["district"], p["district"]), _PROC, nd("claim_id", "claim_count"),
           mean("amount_approved", "avg_approved_amount", 2)), 20, "-avg_approved_amount", "hbp_procedure_code"))
reg("T106", _VALUE, "block", lambda t, p: agg_by(
    at(home_claims(t), HOME["block"], p["block"]), "home_block_name as block_name", n("total_claims"),
    mean("amount_claimed", "avg_claimed", 2), mean("amount_approved", "avg_approved", 2),
    total("amount_approved", "total_approved")))
reg("T122", _VALUE, "district district_2", lambda t, p: ordered(
    agg_by(either(t.case_claims, CARE["district"], p), _DISTRICT, n("total_claims"),
           mean("amount_approved", "avg_approved_amount", 2), mean("amount_claimed", "avg_claimed_amount", 2)),
    "-avg_approved_amount", "district_name"))
reg("T147", _VALUE, "hospital", lambda t, p: versus_state(
    t, at(site_claims(t), "hospital_name", p["hospital"]), t.claims, "amount_approved",
    ("hospital_avg_claim", "state_avg_claim"), 2))
reg("T154", _VALUE, "specialty", lambda t, p: agg_by(
    at(line_claims(t), "specialty_code", p["specialty"]), _SPEC, nd("claim_id", "claim_count"),
    mean("amount_approved", "avg_approved_amount", 2), mean("amount_claimed", "avg_claimed_amount", 2)))
reg("T158", _ST, "specialty", lambda t, p: turnaround(
    at(line_claims(t), "specialty_code", p["specialty"]), _SPEC, avg_name="avg_tat_days",
    points={"median_tat_days": 0.5}, count="claim_count", distinct=True))
reg("T155", "specialty_performance", "specialty", lambda t, p: agg_by(
    at(line_claims(t), "specialty_code", p["specialty"]), _SPEC, nd("claim_id", "total_claims"),
    mean(approved_share(), "avg_approval_rate_pct", 1)))


def specialty_performance(t: Model) -> DataFrame:
    status = F.col("claim_status")
    out = agg_by(line_claims(t), _SPEC, nd("claim_id", "total_claims"),
                 nd_if(status.isin("APPROVED", "SETTLED"), "claim_id", "_ok"),
                 nd_if(status == "REJECTED", "claim_id", "_no"), mean(_TAT, "avg_tat_days"))
    out = out.withColumns({"approval_rate_pct": pct("_ok", "total_claims", 1),
                           "rejection_rate_pct": pct("_no", "total_claims", 1)})
    return ordered(out.drop("_ok", "_no"), "-total_claims", "specialty_code")


reg("D118", "specialty_performance", "", lambda t, p: specialty_performance(t))


def value_outliers(t: Model) -> DataFrame:
    """Hospital and procedure pairs whose mean approved amount is over 1.5 times the mean of the hospitals' means."""
    main = line_claims(t, t.case_lines.where(F.col("procedure_rank") == 1)).where(F.col("amount_approved").isNotNull())
    mine = agg_by(main, ["hospital_id", "hbp_procedure_code", "procedure_name"], nd("case_id", "case_count"),
                  mean("amount_approved", "hosp_avg_approved", 2))
    state = agg_by(mine, "hbp_procedure_code", mean("hosp_avg_approved", "state_avg_approved", 2))
    both = mine.join(state, "hbp_procedure_code")
    ratio = F.col("hosp_avg_approved") / F.when(F.col("state_avg_approved") != 0, F.col("state_avg_approved"))
    both = both.where((F.col("case_count") >= 5) & (ratio > 1.5)).withColumn("ratio_to_state_avg", rnd(ratio, 3))
    out = named_hospital(both, t, "hospital_name", "district_name", "hospital_type")
    return top(out, 20, "-ratio_to_state_avg", "hospital_id", "hbp_procedure_code").drop("hospital_id")


reg("D76", "claim_value_outliers", "", lambda t, p: value_outliers(t))

_SPB = "per_beneficiary_spend"


def spend_per_patient(df: DataFrame, by) -> DataFrame:
    """Approved amount per distinct patient, patients without claims included."""
    out = agg_by(df, by, nd("beneficiary_id", "unique_beneficiaries"), F.sum("approved").alias("_a"))
    return out.withColumns({"total_approved": rnd("_a"),
                            "spend_per_beneficiary": per("_a", "unique_beneficiaries", 1, 2)}).drop("_a")


def spend_by_home_district(t: Model) -> DataFrame:
    paid = home_claims(t).where(F.col("amount_approved").isNotNull())
    out = agg_by(paid, ["home_district_code as district_name", "home_division_name as division_name"],
                 nd("beneficiary_id", "treated_beneficiaries"), F.sum("amount_approved").alias("_a"))
    out = out.withColumns({"total_approved": rnd("_a"),
                           "spend_per_beneficiary": per("_a", "treated_beneficiaries", 1, 2)}).drop("_a")
    return ordered(out, "-spend_per_beneficiary", "district_name")


reg("D62", _SPB, "", lambda t, p: spend_by_home_district(t))
reg("T81", _SPB, "district",
    lambda t, p: spend_per_patient(at(t.claimed_cases, CARE["district"], p["district"]), _DISTRICT))
reg("T139", _SPB, "division",
    lambda t, p: spend_per_patient(at(t.claimed_cases, CARE["division"], p["division"]), _DIVISION))
reg("T115", _SPB, "district district_2", lambda t, p: ordered(
    spend_per_patient(either(t.claimed_cases, CARE["district"], p), _DISTRICT), "-spend_per_beneficiary",
    "district_name"))

# -- pre-authorisation ------------------------------------------------------------------------

_PA = "preauth_analysis"


def case_preauths(t: Model) -> DataFrame:
    return t.preauths.join(t.cases, "case_id")


def preauth_rejections(df: DataFrame, by) -> DataFrame:
    out = agg_by(df, by, n("total_preauths"), n_if(F.col("status") == "REJECTED", "rejected_count"))
    return out.withColumn("rejection_rate_pct", pct("rejected_count", "total_preauths", 2))


def forced_approvals(t: Model) -> DataFrame:
    """Approvals granted because the time limit passed, per month and against all requests."""
    forced = t.preauths.where((F.col("status") == "AUTO_APPROVED") & F.col("auto_approval_type").isNotNull())
    months = agg_by(forced, [month_of("initiated_at").alias("month")], n("force_approved_count"))
    out = months.withColumns({"total_force_approved": forced.agg(n("c")).scalar(),
                              "total_preauths": t.preauths.agg(n("c")).scalar()})
    return ordered(out.withColumn("force_approved_pct", pct("total_force_approved", "total_preauths", 2)), "month")


reg("D64", _PA, "", lambda t, p: mix(t.preauths, "status"))
reg("D66", _PA, "", lambda t, p: forced_approvals(t))
reg("T76", _PA, "district",
    lambda t, p: mix(at(case_preauths(t), CARE["district"], p["district"]), "status", "request_count"), dated="preauth")
reg("T105", _PA, "block", lambda t, p: mix(
    at(case_preauths(t).join(t.members, "beneficiary_id"), HOME["block"], p["block"]), "status", "request_count"),
    dated="preauth")
reg("T121", _PA, "district district_2", lambda t, p: ordered(
    preauth_rejections(either(case_preauths(t), CARE["district"], p), _DISTRICT), "-rejection_rate_pct",
    "district_name"), dated=None)
reg("T149", _PA, "hospital", lambda t, p: preauth_rejections(
    case_preauths(t).join(at(t.hospitals, "hospital_name", p["hospital"]), "hospital_id"), "hospital_name"), dated=None)
reg("T164", _PA, "month year", lambda t, p: preauth_rejections(
    in_month(t.preauths, "initiated_at", p), _month_year("initiated_at")), dated=None)



def decision_days() -> Column:
    return days("initiated_at", "ppd_decision_at")


reg("D65", "preauth_tat", "", lambda t, p: t.preauths.dropna(subset=["ppd_decision_at", "initiated_at"]).agg(
    mean(decision_days(), "avg_tat_days"), quantile(decision_days(), 0.5, "median_tat_days"),
    quantile(decision_days(), 0.9, "p90_tat_days"), F.min(decision_days()).alias("min_tat_days"),
    F.max(decision_days()).alias("max_tat_days")))
reg("T77", "preauth_tat", "district", lambda t, p: agg_by(
    at(case_preauths(t), CARE["district"], p["district"]).where(F.col("ppd_decision_at").isNotNull()), _DISTRICT,
    n("total_preauths"), mean(decision_days(), "avg_tat_days"), quantile(decision_days(), 0.5, "median_tat_days")), dated="preauth")

# -- payout factor and portability money ------------------------------------------------------

reg("D97", "payout_factor_distribution", "", lambda t, p: ordered(
    share(agg_by(t.table("cm_preauth_procedure_line").where(F.col("payout_factor").isNotNull()), "payout_factor",
                 n("occurrence_count"), total("computed_final_amount", "total_amount"),
                 mean("base_amount", "avg_base_amount", 2), mean("computed_final_amount", "avg_final_amount", 2)),
          "occurrence_count", "pct", 2), "payout_factor"))
reg("D29", "portability_financials", "", lambda t, p: ordered(
    agg_by(t.claims, "is_portability_claim", n("claim_count"), total("amount_claimed", "total_claimed"),
           mean("amount_claimed", "avg_claimed", 2), total("amount_approved", "total_approved")),
    "is_portability_claim"))
