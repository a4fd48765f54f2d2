"""Where people are treated: flows, portability, capacity per enrolled person, gaps, and district rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import (
    CARE, HOME, SITE, Model, agg_by, at, days, either, mean, month_of, n, n_if, named_hospital, nd, nd_if, ordered, pct,
    per, reg, rnd, share, top, total,
)
from .claims import approved_share, home_claims, zero
from .enrolment import has_birth, people_by, request_cards
from .hospitals import home_district_of

_HDIST = "home_district_code as home_district"

# -- treatment away from home -----------------------------------------------------------------

_OUT = "out_of_district_treatment"


def away() -> Column:
    return F.col("hospital_district") != F.col("home_district_code")


def away_rate(df: DataFrame, by, names: tuple[str, str], cond=None, whole: str = "total_cases") -> DataFrame:
    out = agg_by(df, by, n(whole), n_if(away() if cond is None else cond, names[0]))
    return out.withColumn(names[1], pct(names[0], whole, 1))


reg("D107", _OUT, "", lambda t, p: ordered(
    away_rate(t.home_cases, _HDIST, ("out_of_district_cases", "out_of_district_pct")), "-out_of_district_pct",
    "home_district"))
reg("T92", _OUT, "district", lambda t, p: away_rate(
    at(t.home_cases, CARE["district"], p["district"]), "hospital_district",
    ("cross_district_cases", "cross_district_pct")))
_OOD = ("out_of_district", "out_of_district_pct")
for _q, _lvl in (("T175", "district"), ("T234", "block")):
    reg(_q, _OUT, _lvl, lambda t, p, v=_lvl: away_rate(at(t.home_cases, HOME[v], p[v]), None, _OOD))
reg("T226", _OUT, "district", lambda t, p: top(
    away_rate(at(t.home_cases, HOME["district"], p["district"]), "home_block_name as block_name", _OOD), 10,
    "-out_of_district_pct", "block_name"))
reg("T233", _OUT, "block", lambda t, p: away_rate(
    at(t.home_cases, HOME["block"], p["block"]).join(t.hospitals.select("hospital_id", "block_name"), "hospital_id"),
    None, ("out_of_block", "out_of_block_pct"), F.col("block_name") != F.col("home_block_name")))
reg("T262", _OUT, "district district_2", lambda t, p: ordered(
    away_rate(either(t.home_cases, HOME["district"], p), _HDIST, _OOD), "-out_of_district_pct", "home_district"))

_FLOW = "patient_flow"


def flow_matrix(t: Model) -> DataFrame:
    """Cases per home and treatment district where the two differ."""
    return agg_by(t.home_cases.where(away()), [_HDIST, "hospital_district as treatment_district"], n("case_count"))


def net_flow(t: Model) -> DataFrame:
    """In-flow and out-flow per district, from one pass: each case counts out at one end and in at the other."""
    moves = flow_matrix(t).select("case_count", F.explode(F.array(
        F.struct(F.col("treatment_district").alias("district"), F.lit(1).alias("i"), F.lit(0).alias("o")),
        F.struct(F.col("home_district").alias("district"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("m"))
    return agg_by(moves, "m.district as district", F.sum(F.col("m.i") * F.col("case_count")).alias("inflow"),
                  F.sum(F.col("m.o") * F.col("case_count")).alias("outflow")).withColumn(
        "net_flow", F.col("inflow") - F.col("outflow"))


def flow_balance(t: Model) -> DataFrame:
    kind = (F.when(F.col("net_flow") > 0, "NET_IMPORTER").when(F.col("net_flow") < 0, "NET_EXPORTER")
            .otherwise("BALANCED"))
    return ordered(net_flow(t).withColumn("flow_type", kind), "-net_flow", "district")


def district_flows(t: Model, district: str) -> DataFrame:
    """Where a district's incoming cases come from and its outgoing cases go to."""
    flows = flow_matrix(t)
    came = at(flows, "treatment_district", district).select(
        F.lit("INFLOW").alias("flow_type"), F.col("home_district").alias("other_district"), "case_count")
    went = at(flows, "home_district", district).select(
        F.lit("OUTFLOW").alias("flow_type"), F.col("treatment_district").alias("other_district"), "case_count")
    return ordered(came.unionByName(went), "flow_type", "-case_count", "other_district")


reg("D108", _FLOW, "", lambda t, p: flow_balance(t))
reg("D109", _FLOW, "", lambda t, p: top(flow_matrix(t), 30, "-case_count", "home_district", "treatment_district"))
reg("T176", _FLOW, "district", lambda t, p: top(
    share(agg_by(at(t.home_cases, CARE["district"], p["district"]).where(F.col(HOME["district"]) != p["district"]),
                 "home_district_code as source_district", n("case_count")), "case_count", "pct", 1),
    10, "-case_count", "source_district"))
reg("T186", _FLOW, "district", lambda t, p: district_flows(t, p["district"]))
reg("T235", _FLOW, "block", lambda t, p: top(
    named_hospital(at(t.home_cases, HOME["block"], p["block"]).groupBy("hospital_id").agg(n("case_count")), t,
                   "hospital_name", "hospital_type", "district_name"), 10, "-case_count", "hospital_id").drop("hospital_id"))
reg("T263", _FLOW, "district district_2", lambda t, p: ordered(
    either(net_flow(t), "district", p).select("district", F.col("inflow").alias("patient_inflow"),
                                              F.col("outflow").alias("patient_outflow"), "net_flow"),
    "-net_flow", "district"))

# -- portability ------------------------------------------------------------------------------


def portable(df: DataFrame) -> DataFrame:
    return df.where("is_portability")


def portable_home(t: Model) -> DataFrame:
    """Portability cases of known residents, with the totals of their claims."""
    return portable(t.claimed_cases).join(t.members, "beneficiary_id")


_PV, _PD = "portability_volume", "portability_detail"
_STATE = "hospital_state_code as destination_state"
reg("D28", _PV, "", lambda t, p: ordered(
    share(agg_by(portable(t.cases), _STATE, n("case_count")), "case_count", "pct", 2), "-case_count",
    "destination_state"))
reg("D30", "portability_trend", "", lambda t, p: ordered(
    agg_by(portable(t.cases), [month_of("admission_datetime").alias("month")], n("portability_cases")), "month"))
reg("T30", _PV, "district", lambda t, p: ordered(
    agg_by(at(portable_home(t), HOME["district"], p["district"]), _STATE,
           F.sum(F.greatest(F.coalesce("n_claims", zero()), F.lit(1))).alias("portability_cases"),
           total("claimed", "total_claimed")), "-portability_cases", "destination_state"))
reg("T110", _PV, "block", lambda t, p: ordered(
    agg_by(at(portable_home(t), HOME["block"], p["block"]), _STATE, n("portability_cases"),
           total("claimed", "total_claimed")), "-portability_cases", "destination_state"))
reg("T127", _PV, "district district_2", lambda t, p: ordered(
    agg_by(either(portable_home(t), HOME["district"], p), _HDIST, n("portability_cases"),
           total("approved", "total_approved")), "-portability_cases", "home_district"))
reg("D125", _PD, "", lambda t, p: ordered(
    share(agg_by(portable(t.home_cases), [_HDIST, "hospital_division as destination_division"], n("portability_cases")),
          "portability_cases", "pct_of_home_district_portability", 1, within="home_district"),
    "home_district", "-portability_cases", "destination_division"))
reg("D126", _PD, "", lambda t, p: ordered(
    agg_by(t.lines.join(portable(t.home_cases), "case_id").join(t.claims.select("case_id", "amount_approved"), "case_id"),
           [_HDIST, "specialty_code", "specialty_name"], nd("case_id", "portability_cases"),
           total("amount_approved", "spend_leakage")), "-spend_leakage", "home_district", "specialty_code"))
reg("T187", _PD, "district", lambda t, p: top(
    share(agg_by(at(portable(t.home_cases), HOME["district"], p["district"]), _STATE, n("portability_cases")),
          "portability_cases", "pct", 1), 10, "-portability_cases", "destination_state"))
reg("T212", _PD, "district", lambda t, p: top(
    named_hospital(
        at(t.cases, CARE["district"], p["district"]).groupBy("hospital_id")
        .agg(n("total_cases"), n_if(F.col("is_portability"), "portability_cases"))
        .withColumn("portability_pct", pct("portability_cases", "total_cases", 1)), t, "hospital_name", "hospital_type"),
    10, "-portability_pct", "hospital_id").drop("hospital_id"))
reg("T225", _PD, "district", lambda t, p: top(
    share(agg_by(at(portable(t.home_cases), HOME["district"], p["district"]), "home_block_name as block_name",
                 n("portability_cases")), "portability_cases", "pct", 1), 10, "-portability_cases", "block_name"))
reg("T247", _PD, "block", lambda t, p: top(
    named_hospital(at(portable(t.home_cases), HOME["block"], p["block"]).groupBy("hospital_id").agg(n("portability_cases")),
                   t, "hospital_name", "hospital_type", "district_name"),
    10, "-portability_cases", "hospital_id").drop("hospital_id"))
reg("T265", _PD, "district district_2", lambda t, p: ordered(
    agg_by(either(portable_home(t), HOME["district"], p), [_HDIST, "hospital_division as destination_division"],
           n("portability_cases"), total("approved", "total_approved")),
    "home_district", "-portability_cases", "destination_division"))

# -- per enrolled person ----------------------------------------------------------------------


def hospitals_by(t: Model, level: str, name: str) -> DataFrame:
    return agg_by(t.hospitals, f"{SITE[level]} as {name}", n("hospitals"), F.sum("total_bed_strength").alias("beds"))


_RATIO, _BEDS = "beneficiary_hospital_ratio", "bed_capacity_per_beneficiary"


def people_per_hospital(t: Model, name: str, people: str, sites: str) -> DataFrame:
    both = people_by(t, "district", name, people).join(hospitals_by(t, "district", name).drop("beds"), name, "left")
    both = both.withColumn("beneficiaries_per_hospital", per(people, "hospitals", 1, 1))
    return both.withColumn("hospitals", F.coalesce("hospitals", zero())).withColumnRenamed("hospitals", sites)


def one_place(t: Model, level: str, value) -> tuple[DataFrame, DataFrame]:
    """Head count and registry totals of one place, as one-row results."""
    people = at(t.members, HOME[level], value).agg(n("beneficiary_count"))
    sites = at(t.hospitals, SITE[level], value).agg(n("hospital_count"), F.sum("total_bed_strength").alias("total_beds"))
    return people, sites


def place_ratio(t: Model, level: str, value) -> DataFrame:
    people, sites = one_place(t, level, value)
    out = people.withColumn("hospital_count", sites.select("hospital_count").scalar())
    return out.withColumn("beneficiaries_per_hospital", per("beneficiary_count", "hospital_count", 1, 1))


def place_beds(t: Model, district: str) -> DataFrame:
    people, sites = one_place(t, "district", district)
    out = people.withColumn("total_beds", sites.select("total_beds").scalar())
    return out.withColumn("beds_per_1000_enrolled", per("total_beds", "beneficiary_count", 1000, 2))


def beds_by_district(t: Model) -> DataFrame:
    both = hospitals_by(t, "district", "district").drop("hospitals").join(people_by(t, "district", "district"),
                                                                          "district", "left")
    out = both.withColumnRenamed("beds", "total_beds").withColumn(
        "beds_per_1000_beneficiaries", per("total_beds", "beneficiaries", 1000, 2))
    return ordered(out, "-beds_per_1000_beneficiaries", "district")


def compare_beds(t: Model, p: dict) -> DataFrame:
    both = either(people_by(t, "district", "district", "beneficiary_count"), "district", p).join(
        hospitals_by(t, "district", "district").drop("hospitals"), "district", "left")
    both = both.withColumn("total_beds", F.coalesce("beds", zero())).drop("beds")
    return ordered(both.withColumn("beds_per_1000_enrolled", per("total_beds", "beneficiary_count", 1000, 1)),
                   "-beds_per_1000_enrolled", "district")


reg("D45", _RATIO, "", lambda t, p: top(
    people_per_hospital(t, "district_name", "beneficiary_count", "hospital_count"), 50, "-beneficiaries_per_hospital",
    "district_name"))
reg("D101", _RATIO, "", lambda t, p: top(
    people_per_hospital(t, "district", "beneficiaries", "hospitals"), 30, "-beneficiaries_per_hospital", "district"))
for _q, _lvl in (("T170", "district"), ("T229", "block")):
    reg(_q, _RATIO, _lvl, lambda t, p, v=_lvl: place_ratio(t, v, p[v]), dated=None)
reg("T257", _RATIO, "district district_2", lambda t, p: ordered(
    either(people_per_hospital(t, "district", "beneficiary_count", "hospital_count"), "district", p),
    "-beneficiaries_per_hospital", "district"), dated=None)
reg("D102", _BEDS, "", lambda t, p: beds_by_district(t))
reg("T171", _BEDS, "district", lambda t, p: place_beds(t, p["district"]), dated=None)
reg("T258", _BEDS, "district district_2", lambda t, p: compare_beds(t, p), dated=None)

_RATE = "case_rate_per_beneficiary"


def cases_by(t: Model, level: str, name: str, column: str, home: bool) -> DataFrame:
    if home:
        return agg_by(t.home_cases, f"{HOME[level]} as {name}", n(column))
    return agg_by(t.cases, f"{CARE[level]} as {name}", n(column))


def rate_table(people: DataFrame, cases: DataFrame, key: str, k: str, base: str, name: str, factor: float,
               digits: int) -> DataFrame:
    """Every place with people, its cases (zero where none) and the rate."""
    both = people.join(cases, key, "left").withColumn(k, F.coalesce(k, zero()))
    return both.withColumn(name, per(k, base, factor, digits))


def blocks_of(t: Model, district: str, women: str | None = None) -> DataFrame:
    """People per block of one district; every block with a household shows, people or not."""
    people = at(t.members, HOME["district"], district)
    if women is not None:
        return agg_by(at(people, "gender", women), "home_block_name as block", n("enrolled_count"))
    counts = agg_by(people, "home_block_name as block_name", n("k"))
    blocks = at(t.households, HOME["district"], district).select(F.col("home_block_name").alias("block_name")).distinct()
    return blocks.join(counts, "block_name", "left").select(
        "block_name", F.coalesce("k", zero()).alias("beneficiary_count"))


def block_rates(t: Model, district: str) -> DataFrame:
    cases = agg_by(at(t.home_cases, HOME["district"], district), "home_block_name as block_name", n("case_count"))
    return rate_table(blocks_of(t, district), cases, "block_name", "case_count", "beneficiary_count", "cases_per_1000",
                      1000, 1)


def place_rate(t: Model, level: str, value) -> DataFrame:
    cases = at(t.home_cases, HOME[level], value) if level == "block" else at(t.cases, CARE[level], value)
    out = cases.agg(n("case_count")).withColumn(
        "beneficiary_count", at(t.members, HOME[level], value).agg(n("c")).scalar())
    return out.withColumn("cases_per_1000_enrolled", per("case_count", "beneficiary_count", 1000, 1))


def compare_rates(t: Model, p: dict) -> DataFrame:
    cases = either(cases_by(t, "district", "district", "case_count", False), "district", p)
    people = either(people_by(t, "district", "district", "beneficiary_count"), "district", p)
    both = cases.join(people, "district", "full_outer").select(
        "district", F.coalesce("case_count", zero()).alias("case_count"),
        F.coalesce("beneficiary_count", zero()).alias("beneficiary_count"))
    return ordered(both.withColumn("cases_per_1000", per("case_count", "beneficiary_count", 1000, 1)),
                   "-cases_per_1000", "district")


reg("D103", _RATE, "", lambda t, p: ordered(
    rate_table(people_by(t, "district", "district"), cases_by(t, "district", "district", "total_cases", False),
               "district", "total_cases", "beneficiaries", "cases_per_1000_enrolled", 1000, 2),
    "-cases_per_1000_enrolled", "district"))
reg("D104", _RATE, "", lambda t, p: top(
    rate_table(people_by(t, "block", "block"), cases_by(t, "block", "block", "total_cases", True), "block",
               "total_cases", "beneficiaries", "cases_per_1000_enrolled", 1000, 2),
    30, "-cases_per_1000_enrolled", "block"))
for _q, _lvl in (("T172", "district"), ("T230", "block")):
    reg(_q, _RATE, _lvl, lambda t, p, v=_lvl: place_rate(t, v, p[v]))
reg("T259", _RATE, "district district_2", lambda t, p: compare_rates(t, p))
reg("T181", _RATE, "district",
    lambda t, p: top(block_rates(t, p["district"]), 15, "-cases_per_1000", "block_name"))
reg("T118", "claims_summary", "district district_2", lambda t, p: ordered(
    rate_table(either(people_by(t, "district", "district_name", "enrolled_count"), "district_name", p),
               cases_by(t, "district", "district_name", "case_count", False), "district_name", "case_count",
               "enrolled_count", "cases_per_1000_enrolled", 1000, 1), "-cases_per_1000_enrolled", "district_name"))

# -- disease rates per enrolled person --------------------------------------------------------


def dx_cases(t: Model, category: str, home: bool, women: str | None = None) -> DataFrame:
    """Cases with a primary diagnosis in the category, one row per case and diagnosis."""
    hit = at(t.primary_dx, "diagnosis_category", category).select("case_id")
    cases = t.home_cases if home or women is not None else t.cases
    if women is not None:
        cases = at(cases, "gender", women)
    return hit.join(cases, "case_id")


def district_dx_rate(t: Model, category: str, k: str, base: str, name: str, *, key: str = "district",
                     home: bool = False, women: str | None = None) -> DataFrame:
    geo = HOME["district"] if home else CARE["district"]
    cases = agg_by(dx_cases(t, category, home, women), f"{geo} as {key}", nd("case_id", k))
    people = people_by(t, "district", key, base, women)
    return ordered(rate_table(people, cases, key, k, base, name, 1000, 2), f"-{name}", key)


def place_dx_rate(t: Model, category: str, level: str, value, k: str, base: str, name: str, digits: int,
                  women: str | None = None) -> DataFrame:
    """One place: district rates count cases treated there, block rates cases of people living there."""
    home = level == "block"
    cases = at(dx_cases(t, category, home), HOME[level] if home else CARE[level], value)
    people = at(t.members, HOME[level], value)
    if women is not None:
        people = at(people, "gender", women)
    out = cases.agg(nd("case_id", k)).withColumn(base, people.agg(n("c")).scalar())
    return out.withColumn(name, per(k, base, 1000, digits))


def compare_dx_rate(t: Model, p: dict, category: str, k: str, base: str, name: str, women: str | None = None) -> DataFrame:
    cases = agg_by(either(dx_cases(t, category, False), CARE["district"], p), "hospital_district as district",
                   nd("case_id", k))
    both = cases.join(people_by(t, "district", "district", base, women), "district", "left")
    return ordered(both.withColumn(name, per(k, base, 1000, 2)), f"-{name}", "district")


_MAT, _NCD, _COM = "maternal_case_rate", "ncd_case_rate", "communicable_case_rate"
reg("D91", _MAT, "female", lambda t, p: district_dx_rate(
    t, "MATERNAL_NEONATAL", "maternal_case_count", "enrolled_female_count", "maternal_rate_per_1000_women",
    key="district_name", home=True, women=p["female"]))
reg("D120", _MAT, "female", lambda t, p: district_dx_rate(
    t, "MATERNAL_NEONATAL", "maternal_cases", "enrolled_women", "rate_per_1000_women", women=p["female"]))
reg("D121", _NCD, "", lambda t, p: district_dx_rate(t, "NCD", "ncd_cases", "beneficiaries", "ncd_rate_per_1000"))
reg("D122", _COM, "", lambda t, p: district_dx_rate(
    t, "COMMUNICABLE", "communicable_cases", "beneficiaries", "comm_rate_per_1000"))
reg("T183", _MAT, "district female", lambda t, p: place_dx_rate(
    t, "MATERNAL_NEONATAL", "district", p["district"], "maternal_neonatal_cases", "enrolled_women",
    "cases_per_1000_women", 1, p["female"]))
reg("T184", _NCD, "district", lambda t, p: place_dx_rate(
    t, "NCD", "district", p["district"], "ncd_cases", "beneficiary_count", "ncd_cases_per_1000", 1))
reg("T185", _COM, "district", lambda t, p: place_dx_rate(
    t, "COMMUNICABLE", "district", p["district"], "communicable_cases", "beneficiary_count", "comm_cases_per_1000", 1))
reg("T237", _MAT, "block female", lambda t, p: place_dx_rate(
    t, "MATERNAL_NEONATAL", "block", p["block"], "maternal_cases", "enrolled_women", "rate_per_1000_women", 2,
    p["female"]))
reg("T238", _NCD, "block", lambda t, p: place_dx_rate(
    t, "NCD", "block", p["block"], "ncd_cases", "enrolled_count", "rate_per_1000_enrolled", 2))
reg("T239", _COM, "block", lambda t, p: place_dx_rate(
    t, "COMMUNICABLE", "block", p["block"], "communicable_cases", "enrolled_count", "rate_per_1000_enrolled", 2))
reg("T267", _MAT, "district district_2 female", lambda t, p: compare_dx_rate(
    t, p, "MATERNAL_NEONATAL", "maternal_cases", "enrolled_women", "rate_per_1000_women", p["female"]))
reg("T268", _NCD, "district district_2", lambda t, p: compare_dx_rate(
    t, p, "NCD", "ncd_cases", "enrolled_count", "rate_per_1000_enrolled"))
reg("T269", _COM, "district district_2", lambda t, p: compare_dx_rate(
    t, p, "COMMUNICABLE", "communicable_cases", "enrolled_count", "rate_per_1000_enrolled"))


def maternal_blocks(t: Model, district: str, female: str) -> DataFrame:
    cases = agg_by(at(dx_cases(t, "MATERNAL_NEONATAL", True), HOME["district"], district), "home_block_name as block",
                   nd("case_id", "maternal_cases"))
    women = blocks_of(t, district, female).withColumnRenamed("enrolled_count", "enrolled_women")
    return top(rate_table(women, cases, "block", "maternal_cases", "enrolled_women", "rate_per_1000_women", 1000, 2), 10,
               "-rate_per_1000_women", "block")


reg("T291", _MAT, "district female", lambda t, p: maternal_blocks(t, p["district"], p["female"]))


def use_by_source(t: Model) -> DataFrame:
    """Cases with an approved amount per entitlement source, per 1,000 enrolled."""
    people = agg_by(t.members, "entitlement_source", n("enrolled_count"))
    used = agg_by(home_claims(t).where(F.col("amount_approved").isNotNull()), "entitlement_source",
                  nd("case_id", "total_cases"), nd("beneficiary_id", "treated_beneficiaries"),
                  mean("amount_approved", "avg_claim_value", 2))
    both = rate_table(people, used, "entitlement_source", "total_cases", "enrolled_count", "cases_per_1000_enrolled",
                      1000, 2)
    both = both.withColumns({"treated_beneficiaries": F.coalesce("treated_beneficiaries", zero()),
                             "avg_claim_value": F.coalesce("avg_claim_value", F.lit(0.0))})
    return ordered(both, "-cases_per_1000_enrolled", "entitlement_source")


reg("D84", "utilization_by_source", "", lambda t, p: use_by_source(t))

# -- places with little or no service ---------------------------------------------------------

_NOHOSP, _ZEROUSE = "blocks_without_hospitals", "zero_utilization_blocks"


def served_blocks(t: Model) -> DataFrame:
    return t.hospitals.where(F.col("block_name").isNotNull()).select("block_name").distinct()


def unserved_people(t: Model, more_than: int = 100) -> DataFrame:
    out = people_by(t, "block", "block_name").join(served_blocks(t), "block_name", "left_anti")
    return ordered(out.where(F.col("beneficiaries") > more_than), "-beneficiaries", "block_name")


def unserved_cases(t: Model) -> DataFrame:
    out = cases_by(t, "block", "block_name", "case_count", True).join(served_blocks(t), "block_name", "left_anti")
    return top(out, 20, "-case_count", "block_name")


def unserved_in(t: Model, district: str) -> DataFrame:
    blocks = at(t.table("ref_up_geography"), "district_name", district).select("block_name", "district_name")
    sites = t.hospitals.select("block_name", "district_name").distinct()
    return ordered(blocks.join(sites, ["block_name", "district_name"], "left_anti").select("block_name").distinct(),
                   "block_name")


def quiet_blocks(t: Model) -> DataFrame:
    """Blocks of the reference geography with fewer than five cases of their residents."""
    cases = agg_by(t.home_cases, ["home_block_name as block_name", "home_district_code as district_name"], n("k"))
    out = t.table("ref_up_geography").join(cases, ["block_name", "district_name"], "left").select(
        "block_name", "district_name", "division_name", F.coalesce("k", zero()).alias("case_count"))
    return top(out.where(F.col("case_count") < 5), 50, "case_count", "district_name", "block_name")


reg("D123", _NOHOSP, "", lambda t, p: unserved_people(t, p.get("more_than", 100)))
reg("D124", _NOHOSP, "", lambda t, p: unserved_cases(t))
reg("T179", _NOHOSP, "district", lambda t, p: unserved_in(t, p["district"]), dated=None)
reg("D80", _ZEROUSE, "", lambda t, p: quiet_blocks(t))
reg("T180", _ZEROUSE, "district",
    lambda t, p: top(block_rates(t, p["district"]), 15, "cases_per_1000", "block_name"))
reg("T182", _ZEROUSE, "district", lambda t, p: ordered(
    block_rates(t, p["district"]).where((F.col("case_count") < p.get("fewer_cases", 5))
                                        & (F.col("beneficiary_count") > p.get("more_people", 500)))
    .drop("cases_per_1000"), "-beneficiary_count", "block_name"), dated=None)


def access_profile(t: Model) -> DataFrame:
    """Blocks by hospitals present, use, and the share of cases treated outside the block."""
    sites = t.hospitals.select("hospital_id", F.col("block_name").alias("_site"))
    seen = t.home_cases.join(sites, "hospital_id", "left")
    # A hospital that is unknown or without a block lies outside; a case without a hospital is neither.
    outside = F.col("hospital_id").isNotNull() & ~F.coalesce(F.col("_site") == F.col("home_block_name"), F.lit(False))
    cases = agg_by(seen, "home_block_name as block", n("total_cases"), n_if(outside, "_out"))
    here = agg_by(t.hospitals, "block_name as block", n("hospitals_in_block"))
    out = people_by(t, "block", "block", "enrolled").join(cases, "block", "left").join(here, "block", "left")
    out = out.withColumns({c: F.coalesce(c, zero()) for c in ("total_cases", "_out", "hospitals_in_block")})
    out = out.withColumns({"case_rate_per_1000": per("total_cases", "enrolled", 1000, 2),
                           "pct_treated_outside_block": pct("_out", "total_cases", 1)}).drop("_out")
    return top(out, 20, "hospitals_in_block", "case_rate_per_1000", "-enrolled", "block")


reg("D141", "access_profile", "", lambda t, p: access_profile(t))

# -- districts and blocks against the rest ----------------------------------------------------

_UNDER = "underperforming_districts"


def people_with_use(t: Model) -> DataFrame:
    """One row per enrolled person with the sums over their cases' claims."""
    status = t.case_claims.where(F.col("claim_id").isNotNull())
    paid = status.groupBy("beneficiary_id").agg(
        F.sum(approved_share()).alias("share_sum"), F.count(approved_share()).alias("share_n"),
        F.sum("settlement_tat_days").alias("tat_sum"), F.count("settlement_tat_days").alias("tat_n"),
        F.countDistinct(F.when(F.col("settlement_tat_days").isNotNull(), F.col("case_id"))).alias("settled_cases"))
    visits = t.cases.groupBy("beneficiary_id").agg(n("visits"))
    return t.members.join(visits, "beneficiary_id", "left").join(paid, "beneficiary_id", "left")


def district_use(people: DataFrame, cases: str) -> DataFrame:
    out = agg_by(people, "home_district_code as district", n("enrolled"),
                 F.coalesce(F.sum(cases), zero()).alias("total_cases"),
                 per(F.sum("share_sum"), F.sum("share_n"), 1, 1).alias("avg_approval_rate_pct"),
                 per(F.sum("tat_sum"), F.sum("tat_n"), 1, 1).alias("avg_tat_days"))
    return out.withColumn("utilization_per_1000", per("total_cases", "enrolled", 1000, 2))


def busy_but_refused(t: Model) -> DataFrame:
    """Districts above the districts' mean use and below their mean approval."""
    d = district_use(people_with_use(t), "visits").drop("avg_tat_days")
    d = d.withColumns({"state_avg_utilization": rnd(d.agg(F.avg("utilization_per_1000")).scalar(), 6),
                       "state_avg_approval_rate": rnd(d.agg(F.avg("avg_approval_rate_pct")).scalar(), 6)})
    hit = (F.col("utilization_per_1000") > F.col("state_avg_utilization")) & (
        F.col("avg_approval_rate_pct") < F.col("state_avg_approval_rate"))
    return ordered(d.where(hit), "-utilization_per_1000", "district")


def quiet_and_slow(t: Model) -> DataFrame:
    """Districts below mean use and above mean settlement time, among people with settled claims."""
    d = district_use(people_with_use(t).where(F.col("tat_n") > 0), "settled_cases").drop("avg_approval_rate_pct")
    use, tat = d.agg(F.avg("utilization_per_1000")).scalar(), d.agg(F.avg("avg_tat_days")).scalar()
    d = d.withColumns({"_u": use, "_t": tat})
    d = d.where((F.col("utilization_per_1000") < F.col("_u")) & (F.col("avg_tat_days") > F.col("_t")))
    d = d.withColumns({"state_avg_utilization": rnd("_u", 2), "state_avg_tat": rnd("_t", 1)}).drop("_u", "_t")
    return ordered(d, "-avg_tat_days", "district")


reg("D139", _UNDER, "", lambda t, p: busy_but_refused(t))
reg("D140", _UNDER, "", lambda t, p: quiet_and_slow(t))


def three_metrics(cases: DataFrame, base) -> DataFrame:
    """Use per 1,000, mean approved share and mean settlement time, as one row."""
    return cases.agg(
        per(F.countDistinct("case_id"), base, 1000, 1).alias("utilization_per_1000"),
        mean(approved_share(), "approval_rate_pct", 1), mean("settlement_tat_days", "avg_tat_days", 1))


def district_against_state(t: Model, district: str) -> DataFrame:
    """Three figures of a district beside the state's; state use is per treated person, district use per enrolled."""
    claims = t.claims.select("case_id", "amount_approved", "amount_claimed", "settlement_tat_days")
    everything = t.cases.join(claims, "case_id", "left").join(
        t.table("bm_beneficiary").select(F.col("beneficiary_id"), F.col("beneficiary_id").alias("_known")),
        "beneficiary_id", "left")
    state = three_metrics(everything, F.countDistinct("_known"))
    enrolled = at(t.members, HOME["district"], district).agg(n("c")).scalar()
    local = three_metrics(at(t.cases, CARE["district"], district).join(claims, "case_id", "left"), enrolled)
    names = ["utilization_per_1000", "approval_rate_pct", "avg_tat_days"]
    mine = local.unpivot([], names, "metric", "district_value")
    out = mine.join(state.unpivot([], names, "metric", "state_avg"), "metric")
    return ordered(out.withColumn("difference", rnd(F.col("district_value") - F.col("state_avg"), 1)), "metric")


def block_against_district(t: Model, block: str) -> DataFrame:
    status = F.when(F.col("claim_status") == "REJECTED", 1.0).otherwise(0.0)

    def figures(df, prefix):
        return df.agg(nd("case_id", f"{prefix}_cases"), rnd(F.avg(status) * 100.0, 1).alias(f"{prefix}_rejection_rate"),
                      mean("settlement_tat_days", f"{prefix}_avg_tat", 1))

    mine = figures(at(home_claims(t), HOME["block"], block), "block")
    around = figures(home_claims(t).where(F.col(HOME["district"]) == home_district_of(t, block)), "district")
    return mine.withColumns({c: around.select(c).scalar() for c in around.columns})


reg("T206", _UNDER, "district", lambda t, p: district_against_state(t, p["district"]))
reg("T244", _UNDER, "block", lambda t, p: block_against_district(t, p["block"]))

_RANK = "multi_metric_rank"


def passed_flag() -> Column:
    return F.when(F.col("claim_status").isin("APPROVED", "SETTLED"), 1.0).otherwise(0.0)


def refused_flag() -> Column:
    return F.when(F.col("claim_status") == "REJECTED", 1.0).otherwise(0.0)


def district_ranks(t: Model, district: str) -> DataFrame:
    """A district's rank among all districts on volume, approval, rejection and speed."""
    d = agg_by(t.case_claims, "hospital_district as district", nd("case_id", "total_cases"),
               rnd(F.avg(passed_flag()) * 100.0, 1).alias("approval_rate"), rnd(F.avg(refused_flag()) * 100.0, 1).alias("rejection_rate"),
               mean("settlement_tat_days", "avg_tat", 1))

    def rank(column, descending):
        c = F.col(column)
        return F.rank().over(Window.partitionBy().orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last()))

    ranked = d.withColumns({"utilization_rank": rank("total_cases", True), "approval_rank": rank("approval_rate", True),
                            "rejection_rank": rank("rejection_rate", False), "tat_rank": rank("avg_tat", False)})
    return at(ranked, "district", district)


def best_blocks(t: Model, district: str) -> DataFrame:
    out = agg_by(at(home_claims(t), HOME["district"], district), "home_block_name as block", nd("case_id", "total_cases"),
                 rnd(F.avg(passed_flag()) * 100.0, 1).alias("approval_rate_pct"), mean("settlement_tat_days", "avg_tat_days", 1))
    return top(out.where(F.col("total_cases") >= 10), 10, "-approval_rate_pct", "avg_tat_days", "block")


def weakest_records(t: Model, district: str) -> DataFrame:
    """Blocks by completeness of birth and mobile data, with the mean days from request to card."""
    people = agg_by(at(t.members, HOME["district"], district), "home_block_name as block", n("total_beneficiaries"),
                    n_if(has_birth(), "_b"), n("_m", "mobile"))
    people = people.withColumns({"dob_pct": pct("_b", "total_beneficiaries", 1),
                                 "mobile_pct": pct("_m", "total_beneficiaries", 1)}).drop("_b", "_m")
    lag = agg_by(at(request_cards(t), HOME["district"], district), "home_block_name as block",
                 mean("lag_days", "avg_card_lag_days", 1))
    out = people.join(lag, "block", "left").withColumn("avg_card_lag_days", F.coalesce("avg_card_lag_days", F.lit(0.0)))
    return top(out, 10, "dob_pct", "mobile_pct", "block")


reg("T284", _RANK, "district", lambda t, p: district_ranks(t, p["district"]))
reg("T288", _RANK, "district", lambda t, p: best_blocks(t, p["district"]))
reg("T290", _RANK, "district", lambda t, p: weakest_records(t, p["district"]), dated=None)
