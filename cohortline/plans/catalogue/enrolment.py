"""Enrolment, cards, identity quality, and the way from enrolment to treatment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import HOME, Model, agg_by, at, days, either, mean, month_of, n, n_if, nd, nd_if, ordered, pct, per
from .base import quantile, reg, rnd, share, top

APPROVED_REQUEST = ("ISA_APPROVED", "AUTO_APPROVED")


def mix(df: DataFrame, key: str, count_name: str = "count", digits: int = 2) -> DataFrame:
    """Rows per category with their share of all rows."""
    return ordered(share(agg_by(df, key, n(count_name)), count_name, "pct", digits), f"-{count_name}", key)


# -- head counts ------------------------------------------------------------------------------


def household_counts(t: Model) -> DataFrame:
    """Households with the number of their members and of those members' active cards."""
    active = t.table("bm_card").where(F.col("card_status") == "ACTIVE").groupBy("beneficiary_id").agg(n("n_active"))
    people = (
        t.table("bm_beneficiary").select("beneficiary_id", "household_id").join(active, "beneficiary_id", "left")
        .groupBy("household_id").agg(n("n_people"), F.sum("n_active").alias("n_active"))
    )
    return t.households.join(people, "household_id", "left")


def head_count(df: DataFrame, by, cards: bool = False, prefix: str = "") -> DataFrame:
    out = [n(f"{prefix}households"), F.coalesce(F.sum("n_people"), F.lit(0)).alias(f"{prefix}beneficiaries")]
    if cards:
        out.append(F.coalesce(F.sum("n_active"), F.lit(0)).alias("active_cards"))
    return agg_by(df, by, *out)


_DISTRICT, _DIVISION, _BLOCK = (
    "home_district_code as district_name", "home_division_name as division_name", "home_block_name as block_name",
)
_EC = "enrollment_count"
reg("D01", _EC, "", lambda t, p: head_count(household_counts(t), None, cards=True, prefix="total_"))
reg("T01", _EC, "district",
    lambda t, p: head_count(at(household_counts(t), HOME["district"], p["district"]), _DISTRICT), dated=None)
reg("T11", _EC, "block district",
    lambda t, p: head_count(at(at(household_counts(t), HOME["block"], p["block"]), HOME["district"], p["district"]),
                            [_BLOCK, _DISTRICT]), dated=None)
reg("T48", _EC, "block",
    lambda t, p: head_count(at(household_counts(t), HOME["block"], p["block"]), _BLOCK), dated=None)
reg("T112", _EC, "district district_2",
    lambda t, p: ordered(head_count(either(household_counts(t), HOME["district"], p), _DISTRICT, cards=True),
                         "-beneficiaries", "district_name"), dated=None)
reg("T128", _EC, "division",
    lambda t, p: head_count(at(household_counts(t), HOME["division"], p["division"]), _DIVISION, cards=True), dated=None)
reg("D02", "enrollment_summary_by_district", "",
    lambda t, p: ordered(head_count(household_counts(t), [_DISTRICT, _DIVISION], cards=True),
                         "-beneficiaries", "district_name"))
reg("D03", "enrollment_summary_by_division", "",
    lambda t, p: ordered(head_count(household_counts(t), _DIVISION), "-beneficiaries", "division_name"))


def request_counts(df: DataFrame, by, count_name: str) -> DataFrame:
    status = F.col("status")
    return agg_by(df, by, n(count_name), n_if(status == "ISA_APPROVED", "isa_approved"),
                  n_if(status == "AUTO_APPROVED", "auto_approved"), n_if(status == "REJECTED", "rejected"))


reg("T162", _EC, "year",
    lambda t, p: ordered(request_counts(t.table("bm_enrolment_request").where(F.year("submitted_at") == p["year"]),
                                        [F.month("submitted_at").alias("month")], "enrolment_count"), "month"),
    dated=None)
reg("D44", "enrolment_trend", "first_day last_day",
    lambda t, p: ordered(request_counts(
        t.table("bm_enrolment_request").where((F.col("submitted_at") >= F.lit(p["first_day"]).cast("timestamp"))
                                              & (F.col("submitted_at") < F.lit(p["last_day"]).cast("timestamp"))),
        [month_of("submitted_at").alias("enrolment_month")], "new_enrolments"), "enrolment_month"))

# -- who is enrolled --------------------------------------------------------------------------

reg("D04", "enrollment_gender_breakdown", "", lambda t, p: mix(t.table("bm_beneficiary"), "gender"))
reg("D07", "enrollment_bis_status", "", lambda t, p: mix(t.table("bm_beneficiary"), "bis_record_status"))
reg("D06", "enrollment_source_breakdown", "", lambda t, p: mix(t.households, "entitlement_source", "households"))
reg("D40", "authentication_mode_breakdown", "", lambda t, p: mix(t.table("bm_enrolment_request"), "auth_mode"))
reg("D43", "card_status_distribution", "", lambda t, p: mix(t.table("bm_card"), "card_status"))


def requests(t: Model) -> DataFrame:
    return t.table("bm_enrolment_request").join(t.members, "beneficiary_id")


def cards(t: Model) -> DataFrame:
    return t.table("bm_card").join(t.members, "beneficiary_id")


for _q, _lvl in (("T09", "district"), ("T49", "block")):
    reg(_q, "enrollment_gender_breakdown", _lvl,
        lambda t, p, v=_lvl: mix(at(t.members, HOME[v], p[v]), "gender"), dated=None)
for _q, _lvl in (("T38", "district"), ("T52", "block")):
    reg(_q, "enrollment_bis_status", _lvl,
        lambda t, p, v=_lvl: mix(at(t.members, HOME[v], p[v]), "bis_record_status"), dated=None)
for _q, _lvl in (("T37", "district"), ("T51", "block")):
    reg(_q, "enrollment_source_breakdown", _lvl,
        lambda t, p, v=_lvl: mix(at(t.households, HOME[v], p[v]), "entitlement_source", "households"), dated=None)
reg("T75", "authentication_mode_breakdown", "district",
    lambda t, p: mix(at(requests(t), HOME["district"], p["district"]), "auth_mode", "request_count"), dated=None)
for _q, _lvl, _dig in (("T73", "district", 2), ("T101", "block", 2), ("T168", "district", 1), ("T227", "block", 1)):
    reg(_q, "card_status_distribution", _lvl,
        lambda t, p, v=_lvl, k=_dig: mix(at(cards(t), HOME[v], p[v]), "card_status", "card_count", k), dated=None)


def card_rates(t: Model) -> DataFrame:
    status = F.col("card_status")
    out = agg_by(cards(t), "home_district_code as district", n_if(status == "ACTIVE", "active"),
                 n_if(status == "INACTIVE", "inactive"), n_if(status == "DISABLED", "disabled"), n("total"))
    return ordered(out.withColumn("active_pct", pct("active", "total", 1)), "-total", "district")


reg("D99", "card_status_distribution", "", lambda t, p: card_rates(t))


def active_card_rate(df: DataFrame) -> DataFrame:
    """Active cards per enrolled person; a person may hold several cards."""
    out = agg_by(df, "home_district_code as district", n("total_enrolled"),
                 F.coalesce(F.sum("n_active"), F.lit(0)).alias("active_cards"))
    return ordered(out.withColumn("active_card_rate_pct", pct("active_cards", "total_enrolled", 1)),
                   "-active_card_rate_pct", "district")


reg("T255", "card_status_distribution", "district district_2",
    lambda t, p: active_card_rate(
        either(t.members, HOME["district"], p).join(
            t.table("bm_card").where(F.col("card_status") == "ACTIVE").groupBy("beneficiary_id").agg(n("n_active")),
            "beneficiary_id", "left")), dated=None)


def age_mix(df: DataFrame, as_of: str) -> DataFrame:
    """People per age bucket; year of birth falls back on the date of birth, and unknown ages are left out."""
    born = F.coalesce(F.col("yob"), F.year("dob"))
    age = F.year(F.lit(as_of).cast("date")) - born
    bucket = (
        F.when(age < 18, "0-17").when(age < 46, "18-45").when(age < 66, "46-65").otherwise("65+").alias("age_bucket")
    )
    out = share(agg_by(df.where(born.isNotNull()), [bucket], n("count")), "count", "pct", 2)
    return ordered(out, "age_bucket")


_AGE = "enrollment_age_distribution"
reg("D05", _AGE, "as_of", lambda t, p: age_mix(t.table("bm_beneficiary"), p["as_of"]))
for _q, _lvl in (("T36", "district"), ("T50", "block")):
    reg(_q, _AGE, f"{_lvl} as_of",
        lambda t, p, v=_lvl: age_mix(at(t.members, HOME[v], p[v]), p["as_of"]), dated=None)


def mobile_coverage(df: DataFrame) -> DataFrame:
    out = df.agg(n("total_beneficiaries"), n("with_mobile", "mobile"))
    return out.withColumn("mobile_pct", pct("with_mobile", "total_beneficiaries", 2))


reg("D08", "enrollment_mobile_coverage", "", lambda t, p: mobile_coverage(t.table("bm_beneficiary")))
for _q, _lvl in (("T39", "district"), ("T53", "block")):
    reg(_q, "enrollment_mobile_coverage", _lvl,
        lambda t, p, v=_lvl: mobile_coverage(at(t.members, HOME[v], p[v])), dated=None)

# -- completeness and duplicates --------------------------------------------------------------



def has_birth() -> Column:
    return F.col("yob").isNotNull() | F.col("dob").isNotNull()


_PC = "profile_completeness"


def missing_fields(df: DataFrame) -> DataFrame:
    gaps = {"missing_dob": ~has_birth(), "missing_mobile": F.col("mobile").isNull(),
            "missing_photo": F.col("photo_uri").isNull()}
    gaps["any_field_missing"] = gaps["missing_dob"] | gaps["missing_mobile"] | gaps["missing_photo"]
    out = df.agg(n("total_beneficiaries"), *[n_if(c, f"{k}_count") for k, c in gaps.items()])
    return out.withColumns({f"{k}_pct": pct(f"{k}_count", "total_beneficiaries", 2) for k in gaps})


def completeness(df: DataFrame, by, names: tuple[str, str, str], birth: Column | None = None,
                 counts: bool = False, overall: bool = False) -> DataFrame:
    """Share of people with a birth year (or any birth information), a mobile number and a photo."""
    held = {"yob": F.col("yob").isNotNull() if birth is None else birth, "mobile": F.col("mobile").isNotNull(),
            "photo": F.col("photo_uri").isNotNull()}
    out = agg_by(df, by, n("total_beneficiaries"), *[n_if(c, f"with_{k}") for k, c in held.items()])
    out = out.withColumns({name: pct(f"with_{k}", "total_beneficiaries", 1) for name, k in zip(names, held)})
    if overall:
        out = out.withColumn("overall_completeness_pct", pct(
            F.col("with_yob") + F.col("with_mobile") + F.col("with_photo"), F.col("total_beneficiaries") * 3, 1))
    return out if counts else out.drop("with_yob", "with_mobile", "with_photo")


_RATE3 = ("yob_completeness_pct", "mobile_completeness_pct", "photo_completeness_pct")
_PCT3 = ("dob_pct", "mobile_pct", "photo_pct")
reg("D41", _PC, "", lambda t, p: missing_fields(t.table("bm_beneficiary")))
reg("D100", _PC, "", lambda t, p: ordered(
    completeness(t.members, "home_district_code as district",
                 ("dob_completeness_pct", "mobile_completeness_pct", "photo_completeness_pct")),
    "-total_beneficiaries", "district"))
reg("T169", _PC, "district", lambda t, p: completeness(
    at(t.members, HOME["district"], p["district"]), None, _RATE3, counts=True), dated=None)
reg("T228", _PC, "block",
    lambda t, p: completeness(at(t.members, HOME["block"], p["block"]), None, _RATE3), dated=None)
reg("T211", _PC, "district", lambda t, p: ordered(
    completeness(at(t.members, HOME["district"], p["district"]), "entitlement_source",
                 ("yob_pct", "mobile_pct", "photo_pct"), overall=True),
    "-overall_completeness_pct", "entitlement_source"), dated=None)
reg("T251", _PC, "block", lambda t, p: ordered(
    completeness(at(t.members, HOME["block"], p["block"]), "entitlement_source", _PCT3, has_birth()),
    "-total_beneficiaries", "entitlement_source"), dated=None)
for _q in ("T256", "T272"):
    reg(_q, _PC, "district district_2", lambda t, p: ordered(
        completeness(either(t.members, HOME["district"], p), "home_district_code as district", _PCT3, has_birth()),
        "-dob_pct", "district"), dated=None)

_DUP = "duplicate_beneficiaries"


def duplicate_rate(df: DataFrame, by, count_name: str = "duplicate_count", digits: int = 2) -> DataFrame:
    out = agg_by(df, by, n("total_beneficiaries"), n_if(F.col("is_duplicate"), count_name))
    return out.withColumn("duplicate_rate_pct", pct(count_name, "total_beneficiaries", digits))


reg("D42", _DUP, "", lambda t, p: top(
    share(agg_by(t.members.where("is_duplicate"), [_DISTRICT, _DIVISION], n("duplicate_count")),
          "duplicate_count", "pct_of_all_dupes", 2), 50, "-duplicate_count", "district_name"))
reg("T72", _DUP, "district",
    lambda t, p: duplicate_rate(at(t.members, HOME["district"], p["district"]), _DISTRICT), dated=None)
reg("T102", _DUP, "block", lambda t, p: duplicate_rate(at(t.members, HOME["block"], p["block"]), _BLOCK), dated=None)
reg("T208", _DUP, "district", lambda t, p: ordered(
    duplicate_rate(at(t.members, HOME["district"], p["district"]), "entitlement_source", digits=1),
    "-duplicate_rate_pct", "entitlement_source"), dated=None)
reg("T249", _DUP, "block", lambda t, p: ordered(
    duplicate_rate(at(t.members, HOME["block"], p["block"]), "entitlement_source", "duplicates"),
    "-duplicate_rate_pct", "entitlement_source"), dated=None)
reg("T270", _DUP, "district district_2", lambda t, p: ordered(
    duplicate_rate(either(t.members, HOME["district"], p), "home_district_code as district", "duplicates"),
    "-duplicate_rate_pct", "district"), dated=None)

# -- request rejections -----------------------------------------------------------------------

_REJ = "enrolment_rejection_rate"


def request_rejections(df: DataFrame, by, name: str = "rejected", digits: int = 2) -> DataFrame:
    out = agg_by(df, by, n("total_requests"), n_if(F.col("status") == "REJECTED", name))
    return out.withColumn("rejection_rate_pct", pct(name, "total_requests", digits))


def rejection_overview(t: Model) -> DataFrame:
    """Overall rejection rate beside the 15 most frequent reasons."""
    asked = t.table("bm_enrolment_request")
    whole = request_rejections(asked, None, "rejected_count")
    reason = F.coalesce("rejection_reason", F.lit("UNSPECIFIED")).alias("rejection_reason")
    reasons = share(agg_by(asked.where(F.col("status") == "REJECTED"), [reason], n("reason_count")),
                    "reason_count", "reason_pct", 2)
    return top(reasons, 15, "-reason_count", "rejection_reason").withColumns(
        {c: whole.select(c).scalar() for c in ("total_requests", "rejected_count", "rejection_rate_pct")})


reg("D39", _REJ, "", lambda t, p: rejection_overview(t))
reg("T74", _REJ, "district",
    lambda t, p: request_rejections(at(requests(t), HOME["district"], p["district"]), _DISTRICT), dated=None)
for _q, _lvl, _key in (("T209", "district", "submitted_by_role"), ("T210", "district", "auth_mode"),
                       ("T250", "block", "auth_mode")):
    reg(_q, _REJ, _lvl, lambda t, p, v=_lvl, k=_key: ordered(
        request_rejections(at(requests(t), HOME[v], p[v]), k, digits=1), "-rejection_rate_pct", k), dated=None)
reg("T271", _REJ, "district district_2", lambda t, p: ordered(
    request_rejections(either(requests(t), HOME["district"], p), ["home_district_code as district", "auth_mode"],
                       digits=1), "district", "-rejection_rate_pct", "auth_mode"), dated=None)


def duplicates_and_rejections(t: Model) -> DataFrame:
    """Districts ranked on duplicate rate and on enrolment rejection rate together."""
    dup = duplicate_rate(t.members, "home_district_code as district", digits=1).drop("duplicate_count")
    rej = request_rejections(requests(t), "home_district_code as district", digits=1)
    both = dup.join(rej.select("district", "rejection_rate_pct"), "district", "left")
    both = both.withColumns({
        "dup_rank": F.rank().over(Window.partitionBy().orderBy(F.col("duplicate_rate_pct").desc_nulls_last())),
        "rej_rank": F.rank().over(Window.partitionBy().orderBy(F.col("rejection_rate_pct").desc_nulls_last())),
        "_sum": rnd(F.col("duplicate_rate_pct") + F.coalesce("rejection_rate_pct", F.lit(0.0)), 1),
    })
    return top(both, 20, "-_sum", "district").drop("_sum")


reg("D137", "duplicate_enrolment_correlation", "", lambda t, p: duplicates_and_rejections(t))

# -- from request to card ---------------------------------------------------------------------


def request_cards(t: Model) -> DataFrame:
    """Requests paired with every card of the same person that has an issue date."""
    held = t.table("bm_card").where(F.col("issued_at").isNotNull()).select("beneficiary_id", "issued_at")
    return requests(t).join(held, "beneficiary_id").withColumn("lag_days", days("submitted_at", "issued_at"))


reg("D38", "enrolment_to_card_lag", "", lambda t, p: ordered(
    agg_by(request_cards(t).where(F.col("submitted_at").isNotNull() & (F.col("lag_days") >= 0)),
           [_DISTRICT, _DIVISION], nd("beneficiary_id", "enrolments_with_card"),
           mean("lag_days", "avg_days_to_card"), quantile("lag_days", 0.5, "median_days_to_card")),
    "-avg_days_to_card", "district_name"))
reg("T71", "enrolment_to_card_lag", "district", lambda t, p: agg_by(
    at(request_cards(t), HOME["district"], p["district"]), _DISTRICT,
    nd("enrolment_request_id", "total_enrolments"), nd("enrolment_request_id", "with_card"),
    mean("lag_days", "avg_days_to_card"), quantile("lag_days", 0.5, "median_days_to_card")), dated=None)

_SPEED = "card_issuance_speed"


def issued_within(df: DataFrame) -> DataFrame:
    out = df.agg(nd("enrolment_request_id", "total_enrolments"),
                 nd_if(F.col("lag_days") <= 30, "enrolment_request_id", "within_30_days"))
    return out.withColumn("within_30_days_pct", pct("within_30_days", "total_enrolments", 1))


for _q, _lvl in (("T173", "district"), ("T231", "block")):
    reg(_q, _SPEED, _lvl, lambda t, p, v=_lvl: issued_within(at(request_cards(t), HOME[v], p[v])), dated=None)


def first_approved(t: Model) -> DataFrame:
    return (t.table("bm_enrolment_request").where(F.col("status").isin(*APPROVED_REQUEST))
            .groupBy("beneficiary_id").agg(F.min("submitted_at").alias("first_submitted")))


def first_admission(t: Model) -> DataFrame:
    return t.cases.groupBy("beneficiary_id").agg(F.min("admission_datetime").alias("first_admitted"))


def first_card_speed(t: Model) -> DataFrame:
    issued = t.table("bm_card").groupBy("beneficiary_id").agg(F.min("issued_at").alias("first_issued"))
    pairs = first_approved(t).join(issued, "beneficiary_id").join(t.members, "beneficiary_id")
    pairs = pairs.where(F.col("first_issued").isNotNull() & F.col("first_submitted").isNotNull())
    out = agg_by(pairs, "home_district_code as district", n("total_issued"),
                 n_if(days("first_submitted", "first_issued") <= 30, "issued_within_30d"))
    return top(out.withColumn("pct_within_30d", pct("issued_within_30d", "total_issued", 1)), 30,
               "-pct_within_30d", "district")


reg("D105", _SPEED, "", lambda t, p: first_card_speed(t))


def issued_within_by_person(t: Model, p: dict) -> DataFrame:
    """Per district: people with a request, and those with some card issued within 30 days of some request."""
    issued = t.table("bm_card").select("beneficiary_id", "issued_at")
    pairs = either(requests(t), HOME["district"], p).join(issued, "beneficiary_id", "left")
    out = agg_by(pairs, "home_district_code as district", nd("beneficiary_id", "total_enrolments"),
                 nd_if(days("submitted_at", "issued_at") <= 30, "beneficiary_id", "issued_within_30d"))
    return ordered(out.withColumn("pct_within_30d", pct("issued_within_30d", "total_enrolments", 1)),
                   "-pct_within_30d", "district")


reg("T260", _SPEED, "district district_2", lambda t, p: issued_within_by_person(t, p), dated=None)

# -- from request to first admission ----------------------------------------------------------

_EARLY = "early_admission_rate"


def early_admissions(pairs: DataFrame, by, names: tuple[str, str, str]) -> DataFrame:
    """People with both a first request and a first admission, and those at most 30 days apart."""
    everyone, early, rate = names
    out = agg_by(pairs, by, n(everyone), n_if(days("first_submitted", "first_admitted") <= 30, early))
    return out.withColumn(rate, pct(early, everyone, 1))


def first_request(t: Model) -> DataFrame:
    return t.table("bm_enrolment_request").groupBy("beneficiary_id").agg(F.min("submitted_at").alias("first_submitted"))


def request_and_admission(t: Model, started: DataFrame) -> DataFrame:
    return t.members.join(started, "beneficiary_id").join(first_admission(t), "beneficiary_id")


reg("D106", _EARLY, "", lambda t, p: ordered(
    early_admissions(request_and_admission(t, first_approved(t)), "home_district_code as district",
                     ("enrolled_with_case", "admitted_within_30d", "pct_admitted_within_30d")),
    "-pct_admitted_within_30d", "district"))
for _q, _lvl in (("T174", "district"), ("T232", "block")):
    reg(_q, _EARLY, _lvl, lambda t, p, v=_lvl: early_admissions(
        at(request_and_admission(t, first_request(t)), HOME[v], p[v]), None,
        ("total_claimants", "within_30_days", "within_30_days_pct")), dated=None)
reg("T261", _EARLY, "district district_2", lambda t, p: ordered(
    early_admissions(either(request_and_admission(t, first_request(t)), HOME["district"], p),
                     "home_district_code as district", ("ever_admitted", "admitted_within_30d", "pct_within_30d")),
    "-pct_within_30d", "district"), dated=None)

# -- people without a card, people without a case ---------------------------------------------

_NOCARD = "enrolled_without_card"


def without_card(t: Model, df: DataFrame, by, missing: str, with_count: bool = False) -> DataFrame:
    """Anti-join side as a flag: a person counts once however many cards they hold."""
    holders = t.table("bm_card").select("beneficiary_id").distinct().withColumn("_held", F.lit(True))
    out = agg_by(df.join(holders, "beneficiary_id", "left"), by, n("total_enrolled"), n("with_card", "_held"),
                 n_if(F.col("_held").isNull(), missing))
    out = out.withColumn("no_card_pct", pct(missing, "total_enrolled", 1))
    return out if with_count else out.drop("with_card")


reg("T223", _NOCARD, "district", lambda t, p: without_card(
    t, at(t.members, HOME["district"], p["district"]), None, "without_card", with_count=True), dated=None)
reg("T224", _NOCARD, "district", lambda t, p: top(
    without_card(t, at(t.members, HOME["district"], p["district"]), _BLOCK, "without_card"),
    10, "-no_card_pct", "block_name"), dated=None)
reg("T246", _NOCARD, "block",
    lambda t, p: without_card(t, at(t.members, HOME["block"], p["block"]), None, "no_card"), dated=None)

_UNUSED = "beneficiary_utilization_gap"


def never_treated(t: Model, people: DataFrame, ever: bool, digits: int) -> DataFrame:
    treated = t.cases.select("beneficiary_id").distinct().withColumn("_seen", F.lit(True))
    out = people.join(treated, "beneficiary_id", "left").agg(
        n("total_enrolled"), n("ever_utilized", "_seen"), n_if(F.col("_seen").isNull(), "never_utilized"))
    out = out.withColumn("never_utilized_pct", pct("never_utilized", "total_enrolled", digits))
    return out if ever else out.drop("ever_utilized")


reg("D37", _UNUSED, "", lambda t, p: never_treated(t, t.table("bm_beneficiary"), ever=False, digits=2))
for _q, _lvl in (("T70", "district"), ("T100", "block")):
    reg(_q, _UNUSED, _lvl, lambda t, p, v=_lvl: never_treated(t, at(t.members, HOME[v], p[v]), True, 1), dated=None)

# -- funnel -----------------------------------------------------------------------------------

_FUNNEL = "enrolment_to_treatment_funnel"


def person_funnel(t: Model) -> DataFrame:
    """People at each step from enrolment to payment, against the first and the previous step."""
    def people(df):
        return df.agg(F.countDistinct("beneficiary_id").alias("c"))

    steps = [
        ("Step 1: Enrolled", people(t.table("bm_beneficiary"))),
        ("Step 2: Card Issued", people(t.table("bm_card"))),
        ("Step 3: Admitted", people(t.cases)),
        ("Step 4: Claimed", people(t.case_claims.where(F.col("claim_status") != "PENDING"))),
        ("Step 5: Paid", people(t.case_payments.where(F.col("payment_status") == "SUCCESS"))),
    ]
    rows = None
    for i, (label, counted) in enumerate(steps):
        row = counted.select(F.lit(label).alias("funnel_step"), F.col("c").alias("beneficiary_count"))
        if i == 0:
            row = row.withColumns({"pct_of_enrolled": F.lit(100.0), "pct_of_prev_step": F.lit(None).cast("double")})
        else:
            row = row.withColumns({
                "pct_of_enrolled": pct("beneficiary_count", steps[0][1].scalar(), 2),
                "pct_of_prev_step": pct("beneficiary_count", steps[i - 1][1].scalar(), 2)})
        rows = row if rows is None else rows.unionByName(row)
    return rows


def household_funnel(t: Model, column: str, value) -> DataFrame:
    """Households, cards, cases, claims and paid claims of one place."""
    people = at(t.members, column, value).select("beneficiary_id")
    its_cases = t.cases.join(people, "beneficiary_id").select("case_id")
    its_claims = t.claims.select("claim_id", "case_id").join(its_cases, "case_id")
    paid = t.table("cm_payment").where(F.col("payment_status") == "SUCCESS").select("claim_id")
    enrolled = at(t.households, column, value).agg(n("c"))
    steps = [
        ("enrolled_households", enrolled),
        ("cards_issued", t.table("bm_card").join(people, "beneficiary_id").agg(n("c"))),
        ("admitted", its_cases.agg(n("c"))),
        ("claimed", its_claims.agg(n("c"))),
        ("paid", its_claims.join(paid, "claim_id").agg(nd("claim_id", "c"))),
    ]
    rows = None
    for i, (label, counted) in enumerate(steps):
        row = counted.select(F.lit(label).alias("funnel_step"), F.lit(i + 1).alias("step_order"),
                             F.col("c").alias("count"))
        row = row.withColumn("pct_of_enrolled", F.lit(100.0) if i == 0 else pct("count", enrolled.scalar(), 1))
        rows = row if rows is None else rows.unionByName(row)
    return rows


reg("D95", _FUNNEL, "", lambda t, p: person_funnel(t))
for _q, _lvl in (("T99", "district"), ("T111", "block")):
    reg(_q, _FUNNEL, _lvl, lambda t, p, v=_lvl: household_funnel(t, HOME[v], p[v]), dated=None)


def people_by(t: Model, level: str, name: str, column: str = "beneficiaries", women: str | None = None) -> DataFrame:
    df = t.members if women is None else at(t.members, "gender", women)
    return agg_by(df, f"{HOME[level]} as {name}", n(column))


def conversion(t: Model) -> DataFrame:
    """Share of enrolled people that were ever admitted, per home district."""
    treated = t.cases.select("beneficiary_id").distinct().withColumn("_seen", F.lit(True))
    out = agg_by(t.members.join(treated, "beneficiary_id", "left"), "home_district_code as district",
                 n("enrolled"), n("treated", "_seen"))
    return ordered(out.withColumn("conversion_rate_pct", pct("treated", "enrolled", 2)),
                   "-conversion_rate_pct", "district")


def block_conversion(t: Model, p: dict) -> DataFrame:
    visits = t.cases.groupBy("beneficiary_id").agg(n("visits"))
    people = at(t.members, HOME["district"], p["district"]).join(visits, "beneficiary_id", "left")
    out = agg_by(people, "home_block_name as block", n("enrolled_count"),
                 F.coalesce(F.sum("visits"), F.lit(0)).alias("admitted_count"))
    return top(out.withColumn("conversion_rate_pct", pct("admitted_count", "enrolled_count", 2)), 10,
               "conversion_rate_pct", "block")


reg("D142", _FUNNEL, "", lambda t, p: conversion(t))
reg("T285", _FUNNEL, "district", lambda t, p: block_conversion(t, p), dated=None)
