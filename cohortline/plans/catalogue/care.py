"""What is treated and how it ends: specialties, procedures, diagnoses, stays, discharges, readmissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...operators.history import preceded_within, with_previous
from .base import (
    CARE, HOME, SITE, Model, agg_by, at, days, either, mean, month_of, n, n_if, named_hospital, nd, nd_if, ordered, pct,
    per, reg, rnd, share, top, total,
)
from .claims import line_claims, versus_state
from .enrolment import mix

_SPEC = ["specialty_code", "specialty_name"]
_DISTRICT = "hospital_district as district_name"


def amount() -> Column:
    return total("computed_final_amount", "total_amount")


# -- specialties and procedures ---------------------------------------------------------------


def priced_lines(t: Model) -> DataFrame:
    """Procedure lines with their procedure, whether or not the request behind them is known."""
    return t.table("cm_preauth_procedure_line").join(t.procedures, "hbp_procedure_code")


def home_lines(t: Model) -> DataFrame:
    return t.lines.join(t.home_cases, "case_id")


_SU = "specialty_utilization"
reg("D21", _SU, "", lambda t, p: ordered(
    agg_by(priced_lines(t), _SPEC, nd("preauth_id", "preauth_count"), amount()), "-preauth_count", "specialty_code"))
reg("T21", _SU, "specialty", lambda t, p: agg_by(
    at(t.case_lines, "specialty_code", p["specialty"]), _SPEC, nd("preauth_id", "preauth_count"),
    nd("case_id", "case_count"), amount()))
reg("T25", _SU, "specialty district", lambda t, p: agg_by(
    at(at(t.case_lines, "specialty_code", p["specialty"]), CARE["district"], p["district"]), [*_SPEC, _DISTRICT],
    nd("case_id", "case_count"), amount()))
reg("T159", _SU, "specialty block", lambda t, p: agg_by(
    at(at(home_lines(t), "specialty_code", p["specialty"]), HOME["block"], p["block"]),
    [*_SPEC, "home_block_name as block_name"], nd("case_id", "case_count"), amount()))
reg("T22", "specialty_by_district", "specialty", lambda t, p: ordered(
    agg_by(at(t.case_lines, "specialty_code", p["specialty"]), _DISTRICT, nd("case_id", "case_count"), amount()),
    "-case_count", "district_name"))
reg("T24", "top_hospitals_by_specialty", "specialty", lambda t, p: ordered(
    named_hospital(agg_by(at(t.case_lines, "specialty_code", p["specialty"]), "hospital_id", nd("case_id", "case_count"),
                          amount()), t, "hospital_name", "district_name", "hospital_type"),
    "-case_count", "hospital_id").drop("hospital_id"))

_TP = "top_procedures"


def procedure_use(df: DataFrame, label: str = "specialty_code") -> DataFrame:
    return agg_by(df, ["hbp_procedure_code", "procedure_name", label], n("usage_count"), amount())


_BY_USE = ("-usage_count", "hbp_procedure_code")
reg("D22", _TP, "", lambda t, p: ordered(procedure_use(priced_lines(t)), *_BY_USE))
reg("T44", _TP, "district", lambda t, p: ordered(
    procedure_use(at(t.case_lines, CARE["district"], p["district"])), *_BY_USE))
reg("T65", _TP, "block", lambda t, p: ordered(procedure_use(t.case_lines.join(
    at(t.hospitals, SITE["block"], p["block"]).select("hospital_id"), "hospital_id")), *_BY_USE))
reg("T137", _TP, "division", lambda t, p: top(
    procedure_use(at(t.case_lines, CARE["division"], p["division"]), "specialty_name"), 10, *_BY_USE))
reg("T166", _TP, "year", lambda t, p: top(
    procedure_use(t.case_lines.where(F.year("admission_datetime") == p["year"]), "specialty_name"), 10, *_BY_USE),
    dated=None)


def side_by_side(df: DataFrame, p: dict, keys: list[str], first_key: str) -> DataFrame:
    """The ten most frequent entries of each of two districts, one column per district."""
    counts = agg_by(either(df, CARE["district"], p), ["hospital_district", *keys], n("k"))
    order = Window.partitionBy("hospital_district").orderBy(F.col("k").desc(), F.col(first_key))
    best = counts.withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= 10)

    def of(district):
        return F.max(F.when(F.col("hospital_district") == district, F.col("k")))

    out = agg_by(best, keys, of(p["district"]).alias("district_1_count"), of(p["district_2"]).alias("district_2_count"))
    both = F.coalesce("district_1_count", F.lit(0)) + F.coalesce("district_2_count", F.lit(0))
    return ordered(out.withColumn("_both", both), "-_both", first_key).drop("_both")


reg("T125", _TP, "district district_2", lambda t, p: side_by_side(
    t.case_lines, p, ["hbp_procedure_code", "procedure_name"], "hbp_procedure_code"))


def spend_gap(df: DataFrame, by, count, limit: int, order: str, pct_digits: int | None, gap: str) -> DataFrame:
    """Claimed and approved amounts per procedure, over lines beside their claims."""
    out = agg_by(df, by, count, F.sum("amount_claimed").alias("c"), F.sum("amount_approved").alias("a"))
    out = out.withColumns({"total_claimed": rnd("c"), "total_approved": rnd("a"), gap: rnd(F.col("c") - F.col("a"))})
    if pct_digits is not None:
        out = out.withColumn("haircut_pct", pct(F.col("c") - F.col("a"), "c", pct_digits))
    key = by[0] if isinstance(by, list) else by
    return top(out.drop("c", "a"), limit, f"-{order}", key)


reg("D116", "procedure_financials", "", lambda t, p: spend_gap(
    line_claims(t), ["procedure_name", "specialty_code"], nd("preauth_id", "preauth_count"), 20, "total_approved", 1,
    "haircut_amount"))
reg("T196", "procedure_financials", "district", lambda t, p: spend_gap(
    at(line_claims(t), CARE["district"], p["district"]), ["hbp_procedure_code", "procedure_name", "specialty_name"],
    nd("case_id", "case_count"), 10, "total_gap", None, "total_gap"))

_PRR = "procedure_rejection_rates"


def procedure_status(df: DataFrame, by, counts: bool) -> DataFrame:
    status = F.col("claim_status")
    out = agg_by(df, by, nd("claim_id", "total_claims"), nd_if(status == "QUERY_RAISED", "claim_id", "query_count"),
                 nd_if(status == "REJECTED", "claim_id", "rejected_count"))
    out = out.withColumns({"query_rate_pct": pct("query_count", "total_claims", 1),
                           "rejection_rate_pct": pct("rejected_count", "total_claims", 1)})
    return out if counts else out.drop("query_count", "rejected_count")


reg("D117", _PRR, "", lambda t, p: top(
    procedure_status(line_claims(t), ["procedure_name", "specialty_code"], True).where(F.col("total_claims") >= 10),
    15, "-query_rate_pct", "procedure_name"))
reg("T197", _PRR, "district", lambda t, p: top(
    procedure_status(at(line_claims(t), CARE["district"], p["district"]), ["hbp_procedure_code", "procedure_name"], False)
    .withColumn("_both", rnd(F.col("query_rate_pct") + F.col("rejection_rate_pct"), 1)),
    15, "-_both", "hbp_procedure_code").drop("_both"))

_ADD = "addon_procedures"


def addon_rate(df: DataFrame, by, rate: str, digits: int) -> DataFrame:
    out = agg_by(df, by, n("total_procedures"), n_if(F.col("is_addon"), "addon_procedures"))
    return out.withColumn(rate, pct("addon_procedures", "total_procedures", digits))


def requested_lines(t: Model) -> DataFrame:
    return t.table("cm_preauth_procedure_line").join(t.preauths.select("preauth_id", "case_id"), "preauth_id")


def addon_overview(t: Model) -> DataFrame:
    money = F.col("computed_final_amount")
    cases = requested_lines(t).groupBy("case_id").agg(
        n("k"), F.sum(F.when(F.col("is_addon"), money).otherwise(0.0)).alias("extra"),
        F.sum(F.when(~F.col("is_addon"), money).otherwise(0.0)).alias("base"), F.sum(money).alias("whole"))
    out = cases.agg(n("total_cases"), mean("k", "avg_procedures_per_case", 2), total("extra", "total_addon_cost"),
                    total("base", "total_base_cost"), total("whole", "total_cost"),
                    pct(F.sum("extra"), F.sum("whole"), 2).alias("addon_cost_pct"))
    return out


reg("D68", _ADD, "", lambda t, p: addon_overview(t))
reg("D69", _ADD, "", lambda t, p: top(
    named_hospital(addon_rate(requested_lines(t).join(t.cases.select("case_id", "hospital_id"), "case_id"), "hospital_id",
                              "addon_rate_pct", 2).where(F.col("total_procedures") >= 10),
                   t, "hospital_name", "district_name", "hospital_type"),
    20, "-addon_rate_pct", "hospital_id").drop("hospital_id"))
reg("T142", _ADD, "hospital", lambda t, p: addon_rate(
    requested_lines(t).join(at(t.site_cases, "hospital_name", p["hospital"]).select("case_id", "hospital_name"), "case_id"),
    "hospital_name", "addon_pct", 1))

# -- diagnoses --------------------------------------------------------------------------------

_TD = "top_diagnoses"
_DX = ["icd_code", "diagnosis_text"]


def site_dx(t: Model) -> DataFrame:
    return t.case_dx.join(t.hospitals, "hospital_id")


def home_dx(t: Model) -> DataFrame:
    return t.primary_dx.join(t.home_cases, "case_id")


def dx_count(df: DataFrame, name: str = "count") -> DataFrame:
    return agg_by(df, _DX, n(name))


reg("D23", _TD, "", lambda t, p: ordered(dx_count(t.primary_dx), "-count", "icd_code"))
reg("T14", _TD, "block district", lambda t, p: ordered(
    dx_count(at(at(site_dx(t), SITE["block"], p["block"]), SITE["district"], p["district"])), "-count", "icd_code"))
for _q, _lvl in (("T20", "hospital"), ("T66", "block")):
    reg(_q, _TD, _lvl, lambda t, p, v=_lvl: ordered(dx_count(at(site_dx(t), SITE[v], p[v])), "-count", "icd_code"))
reg("T45", _TD, "district", lambda t, p: ordered(
    dx_count(at(t.case_dx, CARE["district"], p["district"])), "-count", "icd_code"))
reg("T138", _TD, "division", lambda t, p: top(
    dx_count(at(t.case_dx, CARE["division"], p["division"]), "case_count"), 10, "-case_count", "icd_code"))
reg("T126", _TD, "district district_2", lambda t, p: side_by_side(t.case_dx, p, _DX, "icd_code"))

_CAT = "disease_category_breakdown"
reg("D24", _CAT, "", lambda t, p: mix(t.primary_dx, "diagnosis_category", "case_count"))


def burden(df: DataFrame) -> DataFrame:
    return mix(df.withColumnRenamed("diagnosis_category", "disease_category"), "disease_category", "case_count")


reg("T04", _CAT, "district", lambda t, p: burden(at(t.case_dx, CARE["district"], p["district"])))
reg("T67", _CAT, "block", lambda t, p: burden(at(site_dx(t), SITE["block"], p["block"])))
_MIX = "disease_mix_by_geography"
reg("D90", _MIX, "", lambda t, p: ordered(
    share(agg_by(home_dx(t), ["home_division_name as division_name", "diagnosis_category"], nd("case_id", "case_count")),
          "case_count", "pct_within_division", 2, within="division_name"),
    "division_name", "-case_count", "diagnosis_category"))
reg("T93", _MIX, "district", lambda t, p: mix(
    at(t.case_dx, CARE["district"], p["district"]), "diagnosis_category", "case_count", 1))
reg("T109", _MIX, "block", lambda t, p: mix(
    at(home_dx(t), HOME["block"], p["block"]), "diagnosis_category", "case_count", 1))


def dx_trend(df: DataFrame) -> DataFrame:
    return ordered(agg_by(df, [month_of("admission_datetime").alias("month")], n("case_count")), "month")


def in_category(t: Model, category: str) -> DataFrame:
    return at(t.case_dx, "diagnosis_category", category)


_TREND = "disease_category_trend"
reg("T23", _TREND, "diagnosis_category", lambda t, p: dx_trend(in_category(t, p["diagnosis_category"])))
for _q, _lvl in (("T160", "district"), ("T161", "division")):
    reg(_q, _TREND, f"diagnosis_category {_lvl}",
        lambda t, p, v=_lvl: dx_trend(at(in_category(t, p["diagnosis_category"]), CARE[v], p[v])))


def dx_season(t: Model, p: dict) -> DataFrame:
    """Cases per calendar month; the yearly figure divides by ``years`` (three unless given)."""
    out = agg_by(in_category(t, p["diagnosis_category"]), [F.month("admission_datetime").alias("month")], n("case_count"))
    return ordered(out.withColumn("avg_annual_cases", per("case_count", F.lit(p.get("years", 3)), 1, 1)), "month")


reg("D93", "seasonal_pattern", "", lambda t, p: ordered(
    agg_by(in_category(t, "COMMUNICABLE").where(F.col("admission_datetime").isNotNull()),
           [F.month("admission_datetime").alias("month_number")], nd("case_id", "communicable_cases")), "month_number"))
reg("T35", "seasonal_pattern", "diagnosis_category", lambda t, p: dx_season(t, p))
reg("D92", "communicable_case_rate", "", lambda t, p: top(
    agg_by(in_category(t, "COMMUNICABLE"), _DISTRICT, nd("case_id", "communicable_case_count")), 20,
    "-communicable_case_count", "district_name"))
reg("D94", "injury_caseload", "", lambda t, p: ordered(
    share(agg_by(in_category(t, "INJURY"), _DISTRICT, nd("case_id", "injury_case_count")), "injury_case_count",
          "pct_of_total_injury", 2), "-injury_case_count", "district_name"))

_COMBO = "diagnosis_procedure_combos"


def combos(t: Model, lines: DataFrame, limit: int, outer: bool = False) -> DataFrame:
    """Diagnosis category and procedure pairs by approved amount (the amount of a case's claims repeats per line)."""
    pairs = lines.select("case_id", "procedure_name").join(
        t.primary_dx.select("case_id", "diagnosis_category"), "case_id")
    paid = pairs.join(t.claims.select("case_id", "amount_approved"), "case_id", "left" if outer else "inner")
    out = agg_by(paid, ["diagnosis_category", "procedure_name"], nd("case_id", "case_count"),
                 total("amount_approved", "total_approved"))
    return top(out, limit, "-total_approved", "diagnosis_category", "procedure_name")


reg("D119", _COMBO, "", lambda t, p: combos(t, t.case_lines, 20))
reg("T219", _COMBO, "district", lambda t, p: combos(t, at(t.case_lines, CARE["district"], p["district"]), 10))
reg("T248", _COMBO, "block", lambda t, p: combos(t, at(home_lines(t), HOME["block"], p["block"]), 15, outer=True))

# -- length of stay and kind of admission -----------------------------------------------------

_LOS = "average_length_of_stay"


def stay() -> Column:
    return days("admission_datetime", "discharge_datetime")


def stay_against_state(t: Model) -> DataFrame:
    """Mean stay per hospital and leading procedure beside the overall mean, largest difference first."""
    stays = t.case_lines.where((F.col("procedure_rank") == 1) & F.col("admission_datetime").isNotNull()
                               & F.col("discharge_datetime").isNotNull())
    state = agg_by(stays, "hbp_procedure_code", mean(stay(), "state_avg_los", 2))
    mine = agg_by(stays, ["hospital_id", "hbp_procedure_code", "procedure_name"], n("case_count"),
                  mean(stay(), "hosp_avg_los", 2)).where(F.col("case_count") >= 5)
    both = mine.join(state, "hbp_procedure_code").withColumn(
        "deviation_days", rnd(F.col("hosp_avg_los") - F.col("state_avg_los"), 2))
    out = named_hospital(both, t, "hospital_name", "district_name").withColumn("_size", F.abs("deviation_days"))
    return top(out, 20, "-_size", "hospital_id", "hbp_procedure_code").drop("_size", "hospital_id")


def ended(df: DataFrame) -> DataFrame:
    return df.where(F.col("discharge_datetime").isNotNull())


reg("D52", _LOS, "", lambda t, p: stay_against_state(t))
reg("T87", _LOS, "district", lambda t, p: top(
    agg_by(ended(at(t.case_lines, CARE["district"], p["district"])),
           ["hbp_procedure_code", "procedure_name", "specialty_name"], nd("case_id", "case_count"),
           mean(stay(), "avg_los_days")), 20, "-avg_los_days", "hbp_procedure_code"))
reg("T143", _LOS, "hospital", lambda t, p: versus_state(
    t, ended(at(t.site_cases, "hospital_name", p["hospital"])), ended(t.cases), stay(),
    ("hospital_avg_los_days", "state_avg_los_days"), 1))
reg("T156", _LOS, "specialty", lambda t, p: agg_by(
    ended(at(t.case_lines, "specialty_code", p["specialty"])), _SPEC, nd("case_id", "case_count"),
    mean(stay(), "avg_los_days")))
reg("T218", _LOS, "district", lambda t, p: ordered(
    agg_by(ended(at(t.case_dx, CARE["district"], p["district"])), "diagnosis_category", nd("case_id", "total_cases"),
           mean(stay(), "avg_los_days")), "-avg_los_days", "diagnosis_category"))
reg("T282", _LOS, "district district_2", lambda t, p: ordered(
    agg_by(ended(either(t.case_dx, CARE["district"], p)), ["hospital_district as district", "diagnosis_category"],
           nd("case_id", "case_count"), mean(stay(), "avg_los_days")), "district", "-avg_los_days", "diagnosis_category"))

_ADM = "admission_type_ratio"
reg("T86", _ADM, "district", lambda t, p: mix(
    at(t.cases, CARE["district"], p["district"]), "admission_type", "case_count", 1))
reg("T104", _ADM, "block", lambda t, p: mix(
    at(t.home_cases, HOME["block"], p["block"]), "admission_type", "case_count", 1))
reg("T146", _ADM, "hospital", lambda t, p: mix(
    at(t.site_cases, "hospital_name", p["hospital"]), "admission_type", "case_count", 1))
reg("T123", _ADM, "district district_2", lambda t, p: ordered(
    agg_by(either(t.cases, CARE["district"], p), _DISTRICT, n("total_cases"),
           n_if(F.col("admission_type") == "EMERGENCY", "emergency_cases"))
    .withColumn("emergency_pct", pct("emergency_cases", "total_cases", 1)), "-emergency_pct", "district_name"))

_DIS = "discharge_distribution"


def exit_kinds(df: DataFrame) -> DataFrame:
    return mix(df.where(F.col("discharge_type").isNotNull()), "discharge_type")


reg("D26", _DIS, "", lambda t, p: exit_kinds(t.cases))
reg("T46", _DIS, "district", lambda t, p: exit_kinds(at(t.cases, CARE["district"], p["district"])))
reg("T68", _DIS, "block", lambda t, p: exit_kinds(at(t.site_cases, SITE["block"], p["block"])))

# -- how stays end ----------------------------------------------------------------------------


def exit_rate(df: DataFrame, by, cond: str, names: tuple[str, str, str], digits: int) -> DataFrame:
    """Discharges, those that meet the SQL condition ``cond``, and the rate."""
    whole, hit, rate = names
    return agg_by(df, by, n(whole), n_if(F.expr(cond), hit)).withColumn(rate, pct(hit, whole, digits))


def hospital_exits(t: Model, df: DataFrame, cond, names, digits: int, columns: tuple[str, ...], limit: int | None = None,
                   at_least: int = 0) -> DataFrame:
    """Rate per hospital. With a minimum, the minimum and the rate are on distinct cases, else on discharges."""
    out = (case_exit_rate if at_least else exit_rate)(df, "hospital_id", cond, names, digits)
    if at_least:
        out = out.where(F.col(names[0]) >= at_least)
    out = named_hospital(out, t, *columns)
    order = (f"-{names[2]}", "hospital_id")
    return (top(out, limit, *order) if limit else ordered(out, *order)).drop("hospital_id")


def case_exit_rate(df: DataFrame, by, cond: str, names: tuple[str, str, str], digits: int) -> DataFrame:
    """As ``exit_rate`` on distinct cases, for inputs that repeat a case."""
    whole, hit, rate = names
    return agg_by(df, by, nd("case_id", whole), nd_if(F.expr(cond), "case_id", hit)).withColumn(rate, pct(hit, whole, digits))


DIED, LEFT = "death_date is not null", "lama_date is not null"
BIOMETRIC, MEDICINES = "biometric_auth_used", "provided_medicines_flag"
_HN = ("hospital_name", "hospital_type")
_HND = ("hospital_name", "district_name", "hospital_type")


def home_exits(t: Model) -> DataFrame:
    return t.case_exits.join(t.members, "beneficiary_id")


def site_exits(t: Model) -> DataFrame:
    return t.case_exits.join(t.hospitals, "hospital_id")


for _fam, _cond, _word, _d, _h, _b, _s in (
    ("mortality_rate", DIED, "death", "D86", "T89", "T107", "T145"),
    ("lama_dama_rate", LEFT, "lama", "D87", "T88", "T108", "T144"),
):
    _rate = "mortality_rate_pct" if _word == "death" else "lama_rate_pct"
    reg(_d, _fam, "", lambda t, p, c=_cond, w=_word, r=_rate: hospital_exits(
        t, t.case_exits, c, ("total_cases", f"{w}_cases", r), 2, _HND, 10 if w == "death" else 20, at_least=10))
    reg(_h, _fam, "district", lambda t, p, c=_cond, w=_word, r=_rate: hospital_exits(
        t, at(t.case_exits, CARE["district"], p["district"]), c, ("total_discharges", f"{w}_count", r), 2, _HN, 10),
        dated=None)
    reg(_b, _fam, "block", lambda t, p, c=_cond, w=_word, r=_rate: exit_rate(
        at(home_exits(t), HOME["block"], p["block"]), "home_block_name as block_name", c,
        ("total_discharges", f"{w}_count", r), 2), dated=None)
    reg(_s, _fam, "hospital", lambda t, p, c=_cond, w=_word, r=_rate: exit_rate(
        at(site_exits(t), "hospital_name", p["hospital"]), "hospital_name", c,
        ("total_discharges", f"{w}_count", r), 2), dated=None)

_MORT, _LAMA = "mortality_rate", "lama_dama_rate"


def dx_exits(t: Model, outer: bool) -> DataFrame:
    """Primary diagnoses with the discharge of their case."""
    return t.case_dx.join(t.exits, "case_id", "left" if outer else "inner")


reg("D131", _MORT, "", lambda t, p: ordered(
    case_exit_rate(dx_exits(t, False), "diagnosis_category", DIED, ("total_cases", "deaths", "mortality_rate_pct"), 2),
    "-mortality_rate_pct", "diagnosis_category"))
reg("T216", _MORT, "district", lambda t, p: ordered(
    case_exit_rate(at(dx_exits(t, True), CARE["district"], p["district"]), "diagnosis_category", DIED,
                   ("total_cases", "death_count", "mortality_rate_pct"), 2),
    "-mortality_rate_pct", "diagnosis_category"), dated=None)
reg("T217", _LAMA, "district", lambda t, p: ordered(
    case_exit_rate(at(dx_exits(t, True), CARE["district"], p["district"]), "diagnosis_category", LEFT,
                   ("total_cases", "lama_count", "lama_rate_pct"), 2), "-lama_rate_pct", "diagnosis_category"), dated=None)
reg("T281", _MORT, "district district_2", lambda t, p: ordered(
    case_exit_rate(either(dx_exits(t, False), CARE["district"], p), ["hospital_district as district", "diagnosis_category"],
                   DIED, ("total_cases", "deaths", "mortality_rate_pct"), 2),
    "district", "-mortality_rate_pct", "diagnosis_category"), dated=None)
reg("T157", _MORT, "specialty", lambda t, p: case_exit_rate(
    at(t.case_lines, "specialty_code", p["specialty"]).join(t.exits.select("case_id", "death_date"), "case_id", "left"),
    _SPEC, DIED, ("total_cases", "death_count", "mortality_rate_pct"), 2), dated=None)


def two_rates(df: DataFrame) -> DataFrame:
    out = agg_by(df, _DISTRICT, n("total_discharges"), n_if(F.expr(DIED), "_d"), n_if(F.expr(LEFT), "_l"))
    out = out.withColumns({"mortality_rate_pct": pct("_d", "total_discharges", 2),
                           "lama_rate_pct": pct("_l", "total_discharges", 2)}).drop("_d", "_l")
    return ordered(out, "-mortality_rate_pct", "district_name")


reg("T119", _LAMA, "district district_2", lambda t, p: two_rates(either(t.case_exits, CARE["district"], p)), dated=None)


def state_and_types(t: Model, cond, hit: str, rate: str) -> DataFrame:
    """The overall rate, then one row per hospital type."""
    names = ("total_discharges", hit, rate)
    state = exit_rate(t.exits, [F.lit("STATE_WIDE").alias("hospital_type")], cond, names, 2)
    return ordered(state.unionByName(exit_rate(site_exits(t), "hospital_type", cond, names, 2)), "hospital_type")


_BIO, _MED = "biometric_auth_discharge", "medicine_provision"
reg("D88", _BIO, "", lambda t, p: state_and_types(t, BIOMETRIC, "biometric_discharges", "biometric_pct"))
reg("D89", _MED, "", lambda t, p: state_and_types(t, MEDICINES, "medicines_provided_count", "medicines_provided_pct"))


def both_checks(t: Model) -> DataFrame:
    out = agg_by(t.case_exits, "hospital_district as district", nd("case_id", "total_discharges"),
                 nd_if(F.expr(BIOMETRIC), "case_id", "biometric_auth_count"),
                 nd_if(F.expr(MEDICINES), "case_id", "medicines_provided_count"))
    out = out.withColumns({"biometric_rate_pct": pct("biometric_auth_count", "total_discharges", 1),
                           "medicine_provision_rate_pct": pct("medicines_provided_count", "total_discharges", 1)})
    return ordered(out, "-total_discharges", "district")


reg("D133", _BIO, "", lambda t, p: both_checks(t))
for _q, _fam, _cond, _hit, _rate in (
    ("T97", _BIO, BIOMETRIC, "biometric_count", "biometric_rate_pct"),
    ("T198", _BIO, BIOMETRIC, "biometric_count", "biometric_rate_pct"),
    ("T98", _MED, MEDICINES, "medicines_provided_count", "medicine_provision_rate_pct"),
    ("T199", _MED, MEDICINES, "medicines_count", "medicine_rate_pct"),
):
    reg(_q, _fam, "district", lambda t, p, c=_cond, h=_hit, r=_rate: hospital_exits(
        t, at(t.case_exits, CARE["district"], p["district"]), c, ("total_discharges", h, r), 1, _HN), dated=None)
for _q, _fam, _cond, _hit, _rate in (
    ("T240", _BIO, BIOMETRIC, "biometric_auths", "biometric_rate_pct"),
    ("T241", _MED, MEDICINES, "medicine_provided", "medicine_provision_rate_pct"),
):
    reg(_q, _fam, "block", lambda t, p, c=_cond, h=_hit, r=_rate: exit_rate(
        at(home_exits(t), HOME["block"], p["block"]), None, c, ("total_discharges", h, r), 1), dated=None)
for _q, _fam, _cond, _hit, _rate in (
    ("T278", _BIO, BIOMETRIC, "biometric_auths", "biometric_rate_pct"),
    ("T279", _MED, MEDICINES, "medicine_provided", "medicine_provision_rate_pct"),
):
    reg(_q, _fam, "district district_2", lambda t, p, c=_cond, h=_hit, r=_rate: ordered(
        exit_rate(either(t.case_exits, CARE["district"], p), "hospital_district as district", c,
                  ("total_discharges", h, r), 1), f"-{r}", "district"), dated=None)

# -- who is treated ---------------------------------------------------------------------------


def gender_by_district(t: Model, male: str, female: str) -> DataFrame:
    g = F.col("gender")
    out = agg_by(t.home_cases, ["home_district_code as district_name", "home_division_name as division_name"],
                 n_if(g == male, "male_cases"), n_if(g == female, "female_cases"), n("total_cases"))
    out = out.withColumns({"male_pct": pct("male_cases", "total_cases", 2),
                           "female_pct": pct("female_cases", "total_cases", 2)})
    return ordered(out, "-total_cases", "district_name")


_GEN = "gender_treatment_ratio"
reg("D78", _GEN, "male female", lambda t, p: gender_by_district(t, p["male"], p["female"]))
reg("T90", _GEN, "district", lambda t, p: mix(
    at(t.cases, CARE["district"], p["district"]).join(t.table("bm_beneficiary").select("beneficiary_id", "gender"),
                                                      "beneficiary_id"), "gender", "case_count", 1))
reg("T103", _GEN, "block", lambda t, p: mix(at(t.home_cases, HOME["block"], p["block"]), "gender", "case_count", 1))


def gender_procedures(t: Model, male: str, female: str) -> DataFrame:
    """The ten leading procedures with most cases, split by gender."""
    people = t.table("bm_beneficiary").select("beneficiary_id", "gender")
    main = t.case_lines.where(F.col("procedure_rank") == 1).join(people, "beneficiary_id")
    keys = ["hbp_procedure_code", "procedure_name", "specialty_name"]
    k = agg_by(main, [*keys, "gender"], nd("case_id", "k"))

    def of(value):
        return F.sum(F.when(F.col("gender") == value, F.col("k")).otherwise(0))

    out = agg_by(k, keys, of(male).alias("male_cases"), of(female).alias("female_cases"), F.sum("k").alias("total_cases"))
    return top(out, 10, "-total_cases", "hbp_procedure_code")


reg("D85", "gender_procedure_disparity", "male female",
    lambda t, p: gender_procedures(t, p["male"], p["female"]))

_OLD = "elderly_utilization"


def is_elderly(as_of: str):
    return F.year(F.lit(as_of).cast("date")) - F.col("yob") >= 65


def elderly_overview(t: Model, as_of: str) -> DataFrame:
    """Share of people aged 65 or more among the enrolled and among the treated, and the difference."""
    known = t.table("bm_beneficiary").where(F.col("yob").isNotNull())
    treated = t.cases.select("beneficiary_id").distinct().withColumn("_seen", F.lit(True))
    old = is_elderly(as_of)
    seen = F.col("_seen").isNotNull()
    out = known.join(treated, "beneficiary_id", "left").agg(
        n("total_enrolled"), n_if(old, "elderly_enrolled"), n_if(seen, "total_treated"), n_if(seen & old, "elderly_treated"))
    ratio = {k: F.col(f"elderly_{k}") * 100.0 / F.when(F.col(f"total_{k}") != 0, F.col(f"total_{k}"))
             for k in ("enrolled", "treated")}
    return out.withColumns({
        "enrolment_elderly_pct": pct("elderly_enrolled", "total_enrolled", 2),
        "utilization_elderly_pct": pct("elderly_treated", "total_treated", 2),
        "utilization_vs_enrolment_gap_pp": rnd(ratio["treated"] - ratio["enrolled"], 2)})


def elderly_in(t: Model, district: str, as_of: str) -> DataFrame:
    people = at(t.members, HOME["district"], district).where(F.col("yob").isNotNull())
    treated = t.cases.select("beneficiary_id").distinct().withColumn("_seen", F.lit(True))
    group = F.when(is_elderly(as_of), "elderly").otherwise("non_elderly").alias("age_group")
    out = agg_by(people.join(treated, "beneficiary_id", "left"), [group], n("enrolled_count"), n("treated_count", "_seen"))
    out = share(share(out, "enrolled_count", "pct_of_enrolled", 1), "treated_count", "pct_of_treated", 1)
    return ordered(out, "age_group")


reg("D79", _OLD, "as_of", lambda t, p: elderly_overview(t, p["as_of"]))
reg("T91", _OLD, "district as_of", lambda t, p: elderly_in(t, p["district"], p["as_of"]), dated=None)

# -- readmissions -----------------------------------------------------------------------------

_READ = "readmission_rate"
_ORDER = ["admission_datetime", "case_id"]


def after_previous_exit(df: DataFrame, *partition: str) -> DataFrame:
    """Cases with the discharge time of the same person's case before."""
    return with_previous(df, ["beneficiary_id", *partition], _ORDER, {"prev_discharge": "discharge_datetime"})


def back_in_30() -> Column:
    return F.col("prev_discharge").isNotNull() & (days("prev_discharge", "admission_datetime") <= 30)


def readmissions(df: DataFrame, by, names=("total_cases", "readmission_count"), digits: int = 1) -> DataFrame:
    out = agg_by(df, by, n(names[0]), n_if(back_in_30(), names[1]))
    return out.withColumn("readmission_rate_pct", pct(names[1], names[0], digits))


def hospital_readmissions(t: Model, district: str) -> DataFrame:
    out = readmissions(after_previous_exit(at(t.cases, CARE["district"], district)), "hospital_id")
    return top(named_hospital(out, t, *_HN), 10, "-readmission_rate_pct", "hospital_id").drop("hospital_id")


def exit_to_exit(t: Model) -> DataFrame:
    """Hospitals with at least 50 cases by the share discharged within 30 days of the person's discharge before."""
    stays = after_previous_exit(ended(t.cases))
    back = F.col("prev_discharge").isNotNull() & (days("prev_discharge", "discharge_datetime") <= 30)
    out = agg_by(stays, "hospital_id", n("total_cases"), n_if(back, "readmissions")).where(F.col("total_cases") >= 50)
    out = out.withColumn("readmission_rate_pct", pct("readmissions", "total_cases", 1))
    return top(named_hospital(out, t, *_HND), 20, "-readmission_rate_pct", "hospital_id")


def same_diagnosis(t: Model) -> DataFrame:
    """Cases admitted 1 to 30 days after another discharge of the same person and diagnosis category."""
    stays = t.case_dx.where(F.col("admission_datetime").isNotNull()).join(
        t.exits.select("case_id", "discharge_date").where(F.col("discharge_date").isNotNull()), "case_id")
    again = preceded_within(stays, ["beneficiary_id", "diagnosis_category"], "case_id", "admission_datetime",
                            "discharge_date", 1, 30).withColumn("_again", F.lit(True))
    out = t.cases.select("case_id").join(again, "case_id", "left").agg(n("total_cases"), n("readmission_cases", "_again"))
    return out.withColumn("readmission_rate_pct", pct("readmission_cases", "total_cases", 2))


reg("D77", _READ, "", lambda t, p: same_diagnosis(t))
reg("D130", _READ, "", lambda t, p: exit_to_exit(t))
reg("T94", _READ, "district", lambda t, p: readmissions(
    after_previous_exit(at(t.cases, CARE["district"], p["district"])), None))
reg("T153", _READ, "hospital", lambda t, p: readmissions(
    after_previous_exit(t.cases.join(at(t.hospitals, "hospital_name", p["hospital"]).select("hospital_id"), "hospital_id")),
    None), dated=None)
reg("T195", _READ, "district", lambda t, p: hospital_readmissions(t, p["district"]), dated=None)
reg("T277", _READ, "district district_2", lambda t, p: ordered(
    readmissions(after_previous_exit(either(t.cases, CARE["district"], p), "hospital_district"),
                 "hospital_district as district", ("total_cases", "readmissions"), 2),
    "-readmission_rate_pct", "district"))


def several_hospitals(t: Model) -> DataFrame:
    """People admitted to another hospital within a week of the admission before."""
    stays = with_previous(t.cases.where(F.col("admission_datetime").isNotNull()), ["beneficiary_id"], _ORDER,
                          {"prev_admission": "admission_datetime", "prev_hospital": "hospital_id"})
    gap = days("prev_admission", "admission_datetime")
    pairs = stays.where((F.col("hospital_id") != F.col("prev_hospital")) & (gap >= 0) & (gap < 7))
    out = pairs.agg(nd("beneficiary_id", "beneficiaries_with_multi_admit"), F.sum(F.lit(1)).alias("total_suspicious_pairs"))
    out = out.withColumn("total_treated_beneficiaries", t.cases.agg(nd("beneficiary_id", "c")).scalar())
    return out.withColumn("pct_of_treated", pct("beneficiaries_with_multi_admit", "total_treated_beneficiaries", 2))


reg("D72", "multi_hospital_admissions", "", lambda t, p: several_hospitals(t))
