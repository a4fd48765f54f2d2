"""Demand and supply by block: four monthly intermediates, ten studies, and the roll-ups built on them."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import derive
from ..functions.numbers import rnd, safe_div
from ..operators.history import with_previous
from ..operators.quantiles import thresholds
from ..operators.select import latest_excluding, latest_per_key, worst
from ..runtime import cut_lineage

# Severity of claim statuses, and the facilities a disease class needs (any or all of them).
STATUS_PRIORITY = {"REJECTED": 5, "QUERY_RAISED": 4, "PENDING": 3, "APPROVED": 2, "SETTLED": 1}
FACILITIES = {
    "NCD": "has_icu_with_ac or has_hdu",
    "COMMUNICABLE": "has_general_ward or has_casualty",
    "MATERNAL_NEONATAL": "has_labour_room",
    "SURGICAL": "has_fully_equipped_ot",
    "INJURY": "has_casualty and has_fully_equipped_ot",
    "OTHER": "has_general_ward",
}
DECIDED = ("AUTO_APPROVED", "ISA_APPROVED", "SHA_APPROVED", "REJECTED")
BLOCK = ["block", "district"]
PLACE = ["block", "district", "division"]


def yes(cond: Column) -> Column:
    """A condition that is false where it cannot be decided."""
    return F.coalesce(cond, F.lit(False))


def hits(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def total(column) -> Column:
    """Sum that is 0 over nothing."""
    return F.coalesce(F.sum(column), F.lit(0))


def above_p75(df: DataFrame, **flags: str) -> DataFrame:
    """Per flag whether a row lies above the 75th percentile of its column; ``df`` is a written table with one row per block."""
    limits = thresholds(df, {flag: (c, 0.75) for flag, c in flags.items()})
    return df.withColumns({flag: yes(F.col(c) > limits[flag]) for flag, c in flags.items()})


class GapStudy:
    """Intermediates and studies over the operational model.

    The intermediates and the studies that others build on are written once each,
    as the tables they are meant to be; everything else is lazy.
    """

    def __init__(self, tables):
        self.t = tables

    # -- shared inputs

    @cached_property
    def people(self) -> DataFrame:
        """People with the place of their household."""
        home = self.t.bm_household.select(
            "household_id", F.col("home_block_name").alias("block"), F.col("home_district_code").alias("district"),
            F.col("home_division_name").alias("division"))
        return self.t.bm_beneficiary.select("beneficiary_id", "household_id", "created_at").join(home, "household_id", "left")

    @cached_property
    def sites(self) -> DataFrame:
        return self.t.hm_hospital.withColumnsRenamed(
            {"block_name": "block", "district_name": "district", "division_name": "division"})

    @cached_property
    def cases(self) -> DataFrame:
        """Cases with their month, whole days of stay, and the home of the person."""
        case = self.t.cm_case.drop("created_at").withColumns({
            "month": derive.month_text("admission_datetime"),
            "los_days": derive.whole_days("admission_datetime", "discharge_datetime")})
        return case.join(self.people.drop("created_at", "household_id"), "beneficiary_id", "left")

    @cached_property
    def claims_per_case(self) -> DataFrame:
        status = F.col("claim_status")
        ok = F.coalesce(F.bool_or(status.isin("APPROVED", "SETTLED")), F.lit(False))
        out = self.t.cm_claim.groupBy("case_id").agg(
            total("amount_claimed").cast("double").alias("total_amount_claimed"),
            total("amount_approved").cast("double").alias("total_amount_approved"),
            F.count("claim_id").alias("claim_count"), ok.alias("any_claim_approved"),
            *[F.coalesce(F.bool_or(status == s), F.lit(False)).alias(f"any_claim_{name}")
              for s, name in (("REJECTED", "rejected"), ("QUERY_RAISED", "queried"), ("PENDING", "pending"))],
            F.max("query_count").alias("max_query_count"), total("query_count").alias("total_query_count"),
            F.min("settlement_tat_days").alias("min_settlement_tat_days"),
            F.avg("settlement_tat_days").alias("avg_settlement_tat_days"),
            F.max("is_portability_claim").alias("is_portability_claim"),
            worst("claim_status", STATUS_PRIORITY).alias("worst_claim_status"))
        return out.withColumn("total_amount_approved", F.when(F.col("any_claim_approved"), F.col("total_amount_approved")))

    @cached_property
    def procedures(self) -> DataFrame:
        """The active request of a case and its leading procedure, written: three studies join it, and the lines are ranked only once."""
        request = latest_excluding(self.t.cm_preauth_request, ["case_id"], ["initiated_at", "preauth_id"], "status",
                                   ["REJECTED", "CANCELLED"], ["preauth_id", "status"])
        line = self.t.cm_preauth_procedure_line.where(F.col("procedure_rank") == 1).select("preauth_id", "hbp_procedure_code")
        return cut_lineage(request.withColumnRenamed("status", "preauth_status").join(line, "preauth_id", "left").select(
            "case_id", "preauth_status", "hbp_procedure_code"))

    @cached_property
    def master(self) -> DataFrame:
        """The procedure master, written: its size is then known, and no table of cases is shuffled by its few codes."""
        return cut_lineage(self.t.ref_hbp_procedure_master.select(
            "hbp_procedure_code", "procedure_name", "specialty_code", "specialty_name", "base_package_price"))

    @cached_property
    def diseases(self) -> DataFrame:
        return self.t.cm_case_diagnosis.where(F.col("diagnosis_rank") == 1).select(
            "case_id", derive.disease_class("icd_code").alias("disease_category"))

    # -- intermediates

    @cached_property
    def demand_supply(self) -> DataFrame:
        """Every block and month: demand of its residents, hospitals in it, people enrolled."""
        places = self.t.ref_up_geography.select(F.col("block_name").alias("block"), F.col("district_name").alias("district"),
                                                F.col("division_name").alias("division")).distinct()
        months = self.t.cm_case.select(derive.month_text("admission_datetime").alias("m")).agg(F.collect_set("m")).scalar()
        spine = places.withColumn("month", F.explode(months))
        kind, ended = F.col("admission_type"), F.col("discharge_type")
        demand = self.cases.join(self.claims_per_case, "case_id", "left").groupBy(*BLOCK, "month").agg(
            F.count("case_id").alias("total_cases"), hits(kind == "EMERGENCY").alias("emergency_cases"),
            hits(kind == "ELECTIVE").alias("elective_cases"), hits(F.col("is_portability")).alias("portability_out_cases"),
            F.countDistinct("beneficiary_id").alias("unique_beneficiaries"),
            total("total_amount_claimed").alias("total_amount_claimed"),
            total("total_amount_approved").alias("total_amount_approved"), hits(ended == "DEATH").alias("death_cases"),
            hits(ended.isin("LAMA", "DAMA")).alias("lama_dama_cases"))
        offered = self.t.hm_specialty_offered.join(self.sites.select("hospital_id", *BLOCK), "hospital_id").groupBy(*BLOCK).agg(
            F.countDistinct("specialty_code").alias("specialties_available"))
        supply = self.sites.groupBy(*BLOCK).agg(
            F.count("hospital_id").alias("total_hospitals"), hits(F.col("hospital_type") == "PUBLIC").alias("public_hospitals"),
            hits(F.col("hospital_type") == "PRIVATE").alias("private_hospitals"), total("total_bed_strength").alias("total_beds"),
            total("inpatient_beds").alias("total_inpatient_beds"), hits(F.col("has_icu_with_ac")).alias("hospitals_with_icu"),
            hits(F.col("has_fully_equipped_ot")).alias("hospitals_with_ot"),
            hits(F.col("delisted_from_gov_schemes")).alias("delisted_hospitals"),
            F.count("accreditation_board").alias("accredited_hospitals")).join(offered, BLOCK, "left")
        active = self.t.bm_card.where(F.col("card_status") == "ACTIVE").join(
            self.people.select("beneficiary_id", *BLOCK), "beneficiary_id").groupBy(*BLOCK).agg(
            F.count("card_id").alias("active_cards"))
        homes = self.t.bm_household.groupBy(F.col("home_block_name").alias("block"), F.col("home_district_code").alias("district")).agg(
            F.count("household_id").alias("total_households_enrolled"))
        heads = self.people.groupBy(*BLOCK).agg(F.count("beneficiary_id").alias("total_beneficiaries_enrolled"))
        enrolled = homes.join(heads, BLOCK, "left").join(active, BLOCK, "left")
        out = spine.join(demand, [*BLOCK, "month"], "left").join(supply, BLOCK, "left").join(enrolled, BLOCK, "left")
        return cut_lineage(out.withColumns({
            "cases_per_1000_enrolled": safe_div("total_cases", "total_beneficiaries_enrolled") * 1000.0,
            "cases_per_bed": safe_div("total_cases", "total_inpatient_beds"),
            "utilization_rate": safe_div("unique_beneficiaries", "total_beneficiaries_enrolled"),
            "portability_out_rate": safe_div("portability_out_cases", "total_cases"),
            "bed_density_per_1000": safe_div("total_inpatient_beds", "total_beneficiaries_enrolled") * 1000.0}))

    @cached_property
    def hospital_performance(self) -> DataFrame:
        """Hospital, leading procedure and month; unknown hospitals and procedures are groups of their own."""
        ended = F.col("discharge_type")
        exits = self.t.cm_discharge.select("case_id", "biometric_auth_used", "provided_medicines_flag")
        # Hardly two cases share a key, so nothing is combined before the shuffle: the rows themselves are dealt by key, once.
        rows = (
            self.cases.select("case_id", "hospital_id", "month", "discharge_type", "los_days")
            .join(self.procedures, "case_id", "left").join(exits, "case_id", "left").join(self.claims_per_case, "case_id", "left")
            .repartition("hospital_id", "hbp_procedure_code", "month").join(self.master, "hbp_procedure_code", "left"))
        key = ["hospital_id", "hbp_procedure_code", "month"]

        def rate(cond):
            return F.avg(F.when(cond, 1.0).otherwise(0.0))

        def known_rate(column):
            return F.avg(F.col(column).cast("int").cast("double"))

        ratio = safe_div("total_amount_approved", "total_amount_claimed")
        place = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("los_days").asc_nulls_last()))
        known = F.count("los_days").over(Window.partitionBy(*key))
        middle = F.abs(2 * F.col("_place") - F.col("_known") - 1) <= 1
        out = rows.withColumns({"_place": place, "_known": known}).groupBy(*key).agg(
            F.count("case_id").alias("case_count"), F.avg("los_days").alias("avg_los_days"),
            F.avg(F.when(middle, F.col("los_days"))).alias("median_los_days"),
            F.avg("total_amount_claimed").alias("avg_amount_claimed"),
            F.avg("total_amount_approved").alias("avg_amount_approved"), F.avg(ratio).alias("avg_approval_ratio"),
            total("total_amount_claimed").cast("double").alias("total_amount_claimed"),
            total("total_amount_approved").cast("double").alias("total_amount_approved"),
            known_rate("any_claim_approved").alias("claim_approval_rate"),
            known_rate("any_claim_rejected").alias("claim_rejection_rate"),
            known_rate("any_claim_queried").alias("claim_query_rate"), F.avg("total_query_count").alias("avg_query_count"),
            rate(ended.isin("NORMAL", "LIVE")).alias("normal_discharge_rate"),
            rate(ended.isin("LAMA", "DAMA")).alias("lama_dama_rate"), rate(ended == "DEATH").alias("mortality_rate"),
            F.avg("avg_settlement_tat_days").alias("avg_settlement_tat_days"),
            rate(F.col("preauth_status") == "AUTO_APPROVED").alias("preauth_auto_approval_rate"),
            known_rate("biometric_auth_used").alias("biometric_auth_rate"),
            known_rate("provided_medicines_flag").alias("medicines_provided_rate"),
            *[F.min(c).alias(c) for c in ("procedure_name", "specialty_code", "specialty_name", "base_package_price")])
        site = self.sites.select("hospital_id", "hospital_name", "hospital_type", "hospital_sub_type", *PLACE,
                                 derive.capacity_band("total_bed_strength").alias("capacity_band"))
        return cut_lineage(out.join(site, "hospital_id", "left"))

    @cached_property
    def enrolment_monthly(self) -> DataFrame:
        """New people and cards per block and month, with running totals over the months that had enrolments."""
        people = self.people.where(F.col("block").isNotNull() & F.col("created_at").isNotNull())
        new = people.groupBy(*PLACE, derive.month_text("created_at").alias("month")).agg(
            F.count("beneficiary_id").alias("new_beneficiaries_enrolled"))
        cards = self.t.bm_card.where(F.col("issued_at").isNotNull()).join(
            self.people.select("beneficiary_id", *BLOCK), "beneficiary_id").groupBy(
            *BLOCK, derive.month_text("issued_at").alias("month")).agg(F.count("card_id").alias("new_cards_issued"))
        out = new.join(cards, [*BLOCK, "month"], "left").withColumn(
            "new_cards_issued", F.coalesce("new_cards_issued", F.lit(0)))
        upto = Window.partitionBy(*BLOCK).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
        return out.withColumns({"cumulative_beneficiaries": F.sum("new_beneficiaries_enrolled").over(upto),
                                "cumulative_cards_issued": F.sum("new_cards_issued").over(upto)})

    @cached_property
    def specialty_gap(self) -> DataFrame:
        """Demand for a specialty by residents of a block against the hospitals of the block that offer it."""
        master = self.master.select("hbp_procedure_code", "specialty_code", "specialty_name")
        demand = (
            self.cases.select("case_id", "beneficiary_id", *PLACE).join(self.procedures.select("case_id", "hbp_procedure_code"),
                                                                        "case_id", "left")
            .join(master, "hbp_procedure_code", "left")
            .join(self.claims_per_case.select("case_id", "total_amount_claimed"), "case_id", "left")
            .groupBy(*PLACE, "specialty_code", "specialty_name").agg(
                F.count("case_id").alias("cases_demanding"), F.countDistinct("beneficiary_id").alias("unique_patients"),
                total("total_amount_claimed").cast("double").alias("amount_claimed")))
        supply = self.sites.select("hospital_id", *BLOCK).join(
            self.t.hm_specialty_offered.select("hospital_id", "specialty_code", "admissions_prev_fy"), "hospital_id").groupBy(
            *BLOCK, "specialty_code").agg(F.countDistinct("hospital_id").alias("hospitals_offering"),
                                          total("admissions_prev_fy").alias("total_prev_fy_admissions"))
        out = demand.join(supply, [*BLOCK, "specialty_code"], "full_outer")
        gap = yes((F.col("cases_demanding") > 0) & (F.coalesce("hospitals_offering", F.lit(0)) == 0))
        return cut_lineage(out.withColumns({
            "gap_flag": gap, "demand_supply_ratio": safe_div("cases_demanding", "hospitals_offering"), "unmet_demand": gap}))

    # -- studies

    @cached_property
    def utilisation(self) -> DataFrame:
        """One row per block: use against enrolment and beds, z-scores over the blocks, and four flags."""
        base = self.demand_supply.groupBy(*BLOCK).agg(
            F.min("division").alias("division"), F.max("total_hospitals").alias("total_hospitals"),
            F.max("total_inpatient_beds").alias("total_inpatient_beds"),
            F.max("total_beneficiaries_enrolled").alias("total_beneficiaries_enrolled"),
            total("total_cases").alias("total_cases_all_months"))
        used = self.cases.groupBy(*BLOCK).agg(F.countDistinct("beneficiary_id").alias("distinct_beneficiaries_with_cases"),
                                              total("los_days").alias("bed_days_consumed"))
        out = base.join(used, BLOCK, "left")
        people = "total_beneficiaries_enrolled"
        out = cut_lineage(out.withColumns({
            "overall_utilization_rate": safe_div("distinct_beneficiaries_with_cases", people),
            "cases_per_1000_enrolled": safe_div("total_cases_all_months", people) * 1000.0,
            "demand_intensity": safe_div("bed_days_consumed", people),
            "local_bed_availability": safe_div("total_inpatient_beds", people) * 1000.0}))
        scored = {"overall_utilization_rate": "z_utilization_rate", "cases_per_1000_enrolled": "z_cases_per_1000",
                  "local_bed_availability": "z_local_bed_availability"}
        moments = cut_lineage(out.agg(*[x for m in scored for x in (F.avg(m).alias(f"mean_{m}"), F.stddev(m).alias(f"sigma_{m}"))]))
        z = {}
        for metric, name in scored.items():
            mean, sigma = moments.select(f"mean_{metric}").scalar(), moments.select(f"sigma_{metric}").scalar()
            z[name] = F.when(sigma.isNull() | (sigma == 0), 0.0).otherwise((F.col(metric) - mean) / F.nullif(sigma, F.lit(0.0)))
        at = thresholds(out, {"many_people": (people, 0.5), "little_use": ("overall_utilization_rate", 0.25),
                              "many_cases": ("cases_per_1000_enrolled", 0.75), "few_beds": ("local_bed_availability", 0.25)})
        flags = {
            "high_enrolment_low_utilization": yes((F.col(people) >= at["many_people"]) & (F.col("overall_utilization_rate") < at["little_use"])),
            "high_demand_low_local_supply": yes((F.col("cases_per_1000_enrolled") > at["many_cases"]) & (F.col("local_bed_availability") < at["few_beds"])),
            "zero_supply": F.coalesce("total_hospitals", F.lit(0)) == 0,
            "single_hospital_dependency": yes(F.col("total_hospitals") == 1)}
        return cut_lineage(out.withColumns({**z, **flags}))

    @cached_property
    def specialty_matrix(self) -> DataFrame:
        """Severity of each gap, the money claimed where nothing is offered, and the next block that offers it."""
        sg = self.specialty_gap
        limit = thresholds(sg.where(F.col("demand_supply_ratio") > 0), {"limit": ("demand_supply_ratio", 0.75)})["limit"]
        severity = (F.when(F.coalesce("cases_demanding", F.lit(0)) == 0, "NO_DEMAND").when(F.col("gap_flag"), "NO_SUPPLY")
                    .when(F.col("demand_supply_ratio") > limit, "UNDERSUPPLIED").otherwise("ADEQUATE"))
        served = sg.where(F.col("hospitals_offering") > 0)
        near = served.groupBy("district", "specialty_code").agg(F.min("block").alias("near"))
        out = sg.withColumn("gap_severity", severity).join(near, ["district", "specialty_code"], "left")
        return cut_lineage(out.withColumns({
            "estimated_revenue_leakage": F.when(F.col("gap_severity") == "NO_SUPPLY", F.col("amount_claimed")),
            "nearest_block_with_supply": F.when(F.coalesce("hospitals_offering", F.lit(0)) == 0, F.col("near")),
            "nearest_block_same_district": F.col("near").isNotNull()}).drop("near", "unmet_demand"))

    @cached_property
    def disease_burden(self) -> DataFrame:
        """Share and deaths of each disease class in a block, and the hospitals equipped for it."""
        rows = self.cases.select("case_id", "discharge_type", *PLACE).join(self.diseases, "case_id", "left")
        burden = rows.groupBy(*PLACE, "disease_category").agg(
            F.count("case_id").alias("case_count"), hits(F.col("discharge_type") == "DEATH").alias("death_count"))
        whole = rows.groupBy(*BLOCK).agg(F.count("case_id").alias("all"))
        able = F.explode(F.filter(F.array(*[
            F.when(F.expr(rule), F.lit(name)) for name, rule in FACILITIES.items()]), lambda c: c.isNotNull()))
        equipped = self.sites.select("hospital_id", *BLOCK, able.alias("disease_category")).groupBy(
            *BLOCK, "disease_category").agg(F.countDistinct("hospital_id").alias("hospitals_with_required_facilities"))
        out = burden.join(whole, BLOCK).join(equipped, [*BLOCK, "disease_category"], "left")
        ready = "hospitals_with_required_facilities"
        return cut_lineage(out.withColumn(ready, F.coalesce(ready, F.lit(0))).withColumns({
            "proportion_of_block_cases": safe_div("case_count", "all"),
            "category_mortality_rate": safe_div("death_count", "case_count"),
            "infrastructure_mismatch": (F.col("case_count") > 0) & (F.col(ready) == 0),
            "infrastructure_strain": safe_div("case_count", ready)}).drop("all"))

    @cached_property
    def flows(self) -> DataFrame:
        """Each case with the kind of way from home to hospital. Out-of-state cases have no known block or division."""
        site = self.sites.select("hospital_id", F.col("block").alias("s_block"), F.col("district").alias("s_district"),
                                 F.col("division").alias("s_division"))
        rows = self.cases.join(site, "hospital_id", "left").join(
            self.claims_per_case.select("case_id", "total_amount_claimed"), "case_id", "left")
        away = yes(F.col("is_portability"))
        rows = rows.withColumns({
            "dest_district": F.when(away, F.col("hospital_district")).otherwise(F.col("s_district")),
            "dest_block": F.when(~away, F.col("s_block")), "dest_division": F.when(~away, F.col("s_division"))})
        same_district = yes(F.col("district") == F.col("dest_district"))
        kind = (F.when(away, "OUT_OF_STATE").when(F.col("dest_district").isNull(), "UNKNOWN")
                .when(same_district & yes(F.col("block") == F.col("dest_block")), "SAME_BLOCK")
                .when(same_district, "SAME_DISTRICT_DIFF_BLOCK")
                .when(yes(F.col("division") == F.col("dest_division")), "DIFF_DISTRICT_SAME_DIVISION").otherwise("DIFF_DIVISION"))
        return rows.withColumn("flow_category", kind)

    @cached_property
    def block_flows(self) -> DataFrame:
        kind = F.col("flow_category")
        out = self.flows.where(F.col("block").isNotNull()).groupBy(*PLACE).agg(
            F.count("case_id").alias("total_cases"), hits(kind == "SAME_BLOCK").alias("cases_same_block"),
            hits(kind == "SAME_DISTRICT_DIFF_BLOCK").alias("cases_same_district"),
            hits(kind.isin("DIFF_DISTRICT_SAME_DIVISION", "DIFF_DIVISION")).alias("cases_diff_district"),
            hits(kind == "OUT_OF_STATE").alias("cases_out_of_state"))
        return cut_lineage(out.withColumns({
            "local_retention_rate": safe_div(F.col("cases_same_block") + F.col("cases_same_district"), "total_cases"),
            "leakage_rate": safe_div(F.col("cases_diff_district") + F.col("cases_out_of_state"), "total_cases")}))

    @cached_property
    def district_flows(self) -> DataFrame:
        """Origin to destination district, with the origin's balance of incoming over outgoing cases."""
        rows = self.flows.where(F.col("district").isNotNull() & F.col("dest_district").isNotNull())
        pairs = rows.groupBy(F.col("district").alias("origin_district"), F.col("dest_district").alias("destination_district")).agg(
            F.count("case_id").alias("flow_count"), total("total_amount_claimed").alias("flow_amount_claimed"))
        # A case whose destination is unknown leaves its district but arrives nowhere.
        cross = self.flows.where(F.col("district").isNotNull() & ~yes(F.col("district") == F.col("dest_district")))
        ends = cross.select(F.explode(F.array(F.struct(F.col("district").alias("d"), F.lit(-1).alias("k")),
                                              F.struct(F.col("dest_district").alias("d"), F.lit(1).alias("k")))).alias("e"))
        net = ends.where(F.col("e.d").isNotNull()).groupBy(F.col("e.d").alias("origin_district")).agg(
            F.sum("e.k").alias("net_flow"))
        return cut_lineage(pairs.join(net, "origin_district", "left"))

    @cached_property
    def card_dropoff(self) -> DataFrame:
        """From enrolment to an active card, per block."""
        held = self.t.bm_card.groupBy("beneficiary_id").agg(
            F.lit(True).alias("has_card"), yes(F.bool_or(F.col("card_status") == "ACTIVE")).alias("active"))
        asked = self.t.bm_enrolment_request.groupBy("beneficiary_id").agg(
            yes(F.bool_or(F.col("status") == "REJECTED")).alias("rejected"))
        last = latest_per_key(self.t.bm_enrolment_request, ["beneficiary_id"], ["submitted_at", "enrolment_request_id"], ["status"])
        people = (self.people.where(F.col("block").isNotNull()).join(held, "beneficiary_id", "left")
                  .join(asked, "beneficiary_id", "left").join(last, "beneficiary_id", "left"))
        has, active = yes(F.col("has_card")), yes(F.col("active"))
        out = people.groupBy(*PLACE).agg(
            F.count("beneficiary_id").alias("total_beneficiaries"), hits(active).alias("beneficiaries_with_active_card"),
            hits(~has).alias("beneficiaries_no_card"), hits(has & ~active).alias("beneficiaries_inactive_card"),
            hits(F.col("rejected")).alias("enrolment_rejected_count"),
            hits(F.col("status").isNotNull() & ~F.col("status").isin(*DECIDED)).alias("enrolment_pending_count"))
        out = out.withColumns({
            "card_activation_rate": safe_div("beneficiaries_with_active_card", "total_beneficiaries"),
            "enrolment_rejection_rate": safe_div("enrolment_rejected_count", "total_beneficiaries")}).withColumn(
            "drop_off_rate", 1 - F.col("card_activation_rate"))
        return above_p75(cut_lineage(out), high_drop_off="drop_off_rate", high_rejection="enrolment_rejection_rate")

    @cached_property
    def repeat_use(self) -> DataFrame:
        """Consecutive admissions of a person by sameness of procedure and hospital, per block."""
        visits = self.cases.select("case_id", "beneficiary_id", "hospital_id", "admission_datetime", *PLACE).join(
            self.procedures.select("case_id", "hbp_procedure_code"), "case_id", "left").withColumn("_any", F.lit(1))
        pairs = with_previous(visits, ["beneficiary_id"], ["admission_datetime", "case_id"],
                              {"p_proc": "hbp_procedure_code", "p_hosp": "hospital_id", "p_any": "_any"})
        same = yes(F.col("p_proc") == F.col("hbp_procedure_code"))
        here = yes(F.col("p_hosp") == F.col("hospital_id"))
        paired = F.col("p_any").isNotNull()
        person = pairs.groupBy("beneficiary_id", *PLACE).agg(
            F.count(F.lit(1)).alias("n"), hits(paired & same & here).alias("ss"), hits(paired & same & ~here).alias("sd"),
            hits(paired & ~same).alias("dp"))
        out = person.where(F.col("block").isNotNull()).groupBy(*PLACE).agg(
            F.count("beneficiary_id").alias("total_beneficiaries_with_cases"), hits(F.col("n") > 1).alias("repeat_beneficiaries"),
            F.avg("n").alias("avg_admissions_per_patient"), F.sum("ss").alias("same_proc_same_hosp_pairs_total"),
            F.sum("sd").alias("same_proc_diff_hosp_pairs_total"), F.sum("dp").alias("diff_proc_pairs_total"))
        pairs_all = (F.col("same_proc_same_hosp_pairs_total") + F.col("same_proc_diff_hosp_pairs_total")
                     + F.col("diff_proc_pairs_total"))
        out = out.withColumns({"repeat_rate": safe_div("repeat_beneficiaries", "total_beneficiaries_with_cases"),
                               "possible_treatment_failure_rate": safe_div("same_proc_same_hosp_pairs_total", pairs_all)})
        return above_p75(cut_lineage(out), high_repeat_rate="repeat_rate").withColumn(
            "possible_treatment_failure", yes(F.col("possible_treatment_failure_rate") > 0.5) & (F.col("repeat_beneficiaries") >= 5))

    @cached_property
    def monthly(self) -> DataFrame:
        """Cases per block and month with the block's z-score and surge flag, where it has enough cases."""
        rows = self.demand_supply.select(*PLACE, "month", F.coalesce("total_cases", F.lit(0)).alias("total_cases"))
        k = F.col("total_cases")
        stats = rows.groupBy(*BLOCK).agg(
            F.sum(k).alias("sum"), hits(k > 0).alias("busy"), F.avg(k).alias("mean"), F.stddev(k).alias("sigma"),
            F.max(F.when(k > 0, k)).alias("peak"), F.min(F.when(k > 0, k)).alias("trough"))
        stats = stats.withColumn("meets_threshold", (F.col("sum") >= 12) & (F.col("busy") >= 6))
        z = F.when(F.col("meets_threshold") & (F.col("sigma") > 0), (k - F.col("mean")) / F.nullif("sigma", F.lit(0.0)))
        out = rows.join(stats, BLOCK).withColumn("z_score_monthly", z)
        return cut_lineage(out.withColumn("surge_month", yes(F.col("z_score_monthly") > 1.5)))

    @cached_property
    def surge_cases(self) -> DataFrame:
        """Cases of surge months per disease class."""
        rows = self.cases.select("case_id", *BLOCK, "month").join(self.diseases, "case_id", "left")
        surge = self.monthly.where("surge_month").select(*BLOCK, "month")
        return rows.join(surge, [*BLOCK, "month"], "left_semi").where(F.col("disease_category").isNotNull()).groupBy(
            *BLOCK, "month", "disease_category").agg(F.count("case_id").alias("n"))

    @cached_property
    def seasonal_patterns(self) -> DataFrame:
        leading = self.surge_cases.groupBy(*BLOCK, "month").agg(
            F.min_by("disease_category", F.struct(-F.col("n"), "disease_category")).alias("surge_dominant_disease"))
        return self.monthly.select(*PLACE, "month", "total_cases", "z_score_monthly", "surge_month").join(
            leading, [*BLOCK, "month"], "left")

    @cached_property
    def seasonal_summary(self) -> DataFrame:
        enough = F.max("meets_threshold")
        out = self.monthly.groupBy(*PLACE).agg(
            enough.alias("meets_threshold"),
            F.when(enough & (F.max("mean") > 0), F.max("sigma") / F.nullif(F.max("mean"), F.lit(0.0))).alias("seasonality_index"),
            F.when(enough & (F.max("busy") >= 2), F.max("peak") / F.nullif(F.max("trough"), F.lit(0))).alias("peak_to_trough_ratio"),
            F.array_join(F.transform(F.array_sort(F.collect_set(F.when(
                F.col("surge_month"), F.substring("month", 6, 2).cast("int")))), lambda m: m.cast("string")), ",").alias("months"))
        by_block = self.surge_cases.groupBy(*BLOCK, "disease_category").agg(F.sum("n").alias("n")).groupBy(*BLOCK).agg(
            F.min_by("disease_category", F.struct(-F.col("n"), "disease_category")).alias("leading"))
        out = out.join(by_block, BLOCK, "left").withColumn("is_seasonal", F.col("meets_threshold") & (F.col("months") != ""))
        return cut_lineage(out.withColumns({
            "peak_months": F.when(F.col("is_seasonal"), F.col("months")),
            "peak_disease_category": F.when(F.col("is_seasonal"), F.col("leading"))}).drop("months", "leading"))

    @cached_property
    def delisted(self) -> DataFrame:
        """What a block loses with each delisted hospital: beds, specialties nobody else there offers."""
        gone = self.sites.where("delisted_from_gov_schemes").select(
            "hospital_id", "hospital_name", *PLACE, F.col("inpatient_beds").alias("delisted_beds"))
        beds = self.sites.groupBy(*BLOCK).agg(total("inpatient_beds").alias("block_total_beds"), F.count("hospital_id").alias("sites"))
        offers = self.t.hm_specialty_offered.select("hospital_id", "specialty_code").distinct()
        own = offers.join(gone.select("hospital_id"), "hospital_id").groupBy("hospital_id").agg(
            F.array_sort(F.collect_set("specialty_code")).alias("own"))
        kept = self.sites.where(~yes(F.col("delisted_from_gov_schemes"))).select("hospital_id", *BLOCK).join(
            offers, "hospital_id").groupBy(*BLOCK).agg(F.collect_set("specialty_code").alias("kept"))
        none = F.array().cast("array<string>")
        out = gone.join(beds, BLOCK, "left").join(own, "hospital_id", "left").join(kept, BLOCK, "left").join(
            self.utilisation.select(*BLOCK, F.col("total_cases_all_months").alias("block_total_cases")), BLOCK, "left")
        out = out.withColumns({
            "delisted_specialties": F.array_join("own", ","), "bed_share_lost": safe_div("delisted_beds", "block_total_beds"),
            "block_remaining_beds": F.col("block_total_beds") - F.col("delisted_beds"),
            "sole_provider_delisted": F.col("sites") == 1,
            "specialties_lost": F.array_join(F.array_except(F.coalesce("own", none), F.coalesce("kept", none)), ",")})
        return out.withColumns({
            "majority_capacity_lost": yes(F.col("bed_share_lost") > 0.5), "specialty_lost": F.col("specialties_lost") != "",
            "block_cases_per_remaining_bed": safe_div("block_total_cases", "block_remaining_beds")}).drop("own", "kept", "sites")

    # -- roll-ups

    def _rollup(self, by: list[str], specialty_name: str) -> DataFrame:
        """Enrolment-weighted use, and the specialty most in demand without supply, per place."""
        level = by[0]
        u = self.utilisation.withColumn("w", F.col("overall_utilization_rate") * F.col("total_beneficiaries_enrolled"))
        flagged = (F.col("high_enrolment_low_utilization") | F.col("high_demand_low_local_supply") | F.col("zero_supply")
                   | F.col("single_hospital_dependency"))
        out = u.groupBy(*by).agg(
            total("total_beneficiaries_enrolled").alias("enrolled"), total("total_cases_all_months").alias("cases"),
            hits(F.col("zero_supply")).alias("zero_supply_blocks"), hits(flagged).alias("flagged_blocks"),
            rnd(F.sum("w") / F.sum("total_beneficiaries_enrolled") * 100.0, 1).alias("utilization_pct"))
        gaps = self.specialty_matrix.where("gap_flag").where(
            F.col(level).isNotNull() & F.col("specialty_name").isNotNull()).groupBy(level, "specialty_name").agg(
            F.sum("cases_demanding").alias("k"))
        best = gaps.groupBy(level).agg(F.min_by("specialty_name", F.struct(-F.col("k"), "specialty_name")).alias(specialty_name))
        return out.join(best, level, "left")

    def _cards(self, by: str) -> DataFrame:
        return self.card_dropoff.groupBy(by).agg(
            (F.sum(F.col("card_activation_rate") * F.col("total_beneficiaries")) / F.sum("total_beneficiaries") * 100.0).alias("rate"))

    @cached_property
    def division_rollup(self) -> DataFrame:
        leak = self.block_flows.groupBy("division").agg(
            rnd(F.sum(F.col("leakage_rate") * F.col("total_cases")) / F.sum("total_cases") * 100.0, 1).alias("leakage_pct"))
        cards = self._cards("division").select("division", rnd(100.0 - F.col("rate"), 1).alias("card_drop_off_pct"))
        season = self.seasonal_summary.groupBy("division").agg(hits(F.col("is_seasonal")).alias("seasonal_blocks"))
        return self._rollup(["division"], "top_specialty_gap").drop("cases", "flagged_blocks").join(
            leak, "division", "left").join(cards, "division", "left").join(season, "division", "left")

    @cached_property
    def district_rollup(self) -> DataFrame:
        flow = self.district_flows.where(F.col("origin_district") == F.col("destination_district")).select(
            F.col("origin_district").alias("district"), F.col("net_flow").alias("net_patient_flow"))
        cards = self._cards("district").select("district", rnd("rate", 1).alias("card_activation_pct"))
        return self._rollup(["district", "division"], "top_unmet_specialty").drop("zero_supply_blocks").join(
            flow, "district", "left").join(cards, "district", "left")

    @cached_property
    def priority_blocks(self) -> DataFrame:
        """Blocks with a flag, with what the other studies say about them."""
        gaps = self.specialty_matrix.where("gap_flag").groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("specialty_gaps"))
        lacking = self.disease_burden.where("infrastructure_mismatch").groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("infra_mismatches"))
        picked = self.utilisation.where(F.col("high_enrolment_low_utilization") | F.col("zero_supply")
                                        | F.col("single_hospital_dependency"))
        out = (picked.join(gaps, BLOCK, "left").join(lacking, BLOCK, "left")
               .join(self.card_dropoff.select(*BLOCK, "drop_off_rate"), BLOCK, "left")
               .join(self.block_flows.select(*BLOCK, "leakage_rate"), BLOCK, "left")
               .join(self.seasonal_summary.select(*BLOCK, "is_seasonal"), BLOCK, "left"))
        zero = F.lit(0)
        return out.select(
            *PLACE, F.col("total_beneficiaries_enrolled").alias("enrolled"),
            rnd(F.col("overall_utilization_rate") * 100.0, 1).alias("utilization_pct"),
            *[F.coalesce(c, zero).alias(n) for c, n in (("total_hospitals", "hospitals"), ("total_inpatient_beds", "beds"),
                                                        ("specialty_gaps", "specialty_gaps"), ("infra_mismatches", "infra_mismatches"))],
            rnd(F.col("drop_off_rate") * 100.0, 1).alias("drop_off_pct"), rnd(F.col("leakage_rate") * 100.0, 1).alias("leakage_pct"),
            "is_seasonal")

    @cached_property
    def gap_annex(self) -> DataFrame:
        return self.specialty_matrix.where("gap_flag").select(
            *BLOCK, "specialty_name", "cases_demanding", "hospitals_offering", "gap_severity", "estimated_revenue_leakage",
            "nearest_block_with_supply")

    @cached_property
    def headline(self) -> DataFrame:
        """The figures a summary opens with, as one row."""
        u = self.utilisation.agg(
            F.count(F.lit(1)).alias("blocks"), total("total_beneficiaries_enrolled").alias("enrolled"),
            total("total_cases_all_months").alias("cases"), total("total_inpatient_beds").alias("beds"),
            hits(F.col("high_enrolment_low_utilization")).alias("low_use_blocks"),
            total(F.when(F.col("zero_supply"), F.col("total_beneficiaries_enrolled"))).alias("enrolled_without_supply"),
            hits(F.col("zero_supply")).alias("zero_supply_blocks"),
            hits(F.col("single_hospital_dependency")).alias("single_hospital_blocks"))
        parts = {
            "specialty_gaps": self.specialty_matrix.agg(hits(F.col("gap_flag"))),
            "revenue_leakage": self.specialty_matrix.agg(total("estimated_revenue_leakage").cast("double")),
            "mismatches": self.disease_burden.agg(hits(F.col("infrastructure_mismatch"))),
            "retention_pct": self.block_flows.agg(rnd((F.sum("cases_same_block") + F.sum("cases_same_district"))
                                                      / F.sum("total_cases") * 100.0, 1)),
            "card_activation_pct": self.card_dropoff.agg(rnd(F.sum("beneficiaries_with_active_card")
                                                             / F.sum("total_beneficiaries") * 100.0, 1)),
            "repeat_pct": self.repeat_use.agg(rnd(F.sum("repeat_beneficiaries") / F.sum("total_beneficiaries_with_cases") * 100.0, 1)),
            "seasonal_blocks": self.seasonal_summary.agg(hits(F.col("is_seasonal")))}
        return u.withColumns({name: one.scalar() for name, one in parts.items()})

    @cached_property
    def leakage_by_specialty(self) -> DataFrame:
        return self.specialty_matrix.where("gap_flag").groupBy("specialty_code", "specialty_name").agg(
            F.sum("cases_demanding").alias("unmet_cases"), F.countDistinct("block").alias("blocks"),
            total("estimated_revenue_leakage").cast("double").alias("leakage"))

    def top_blocks(self, k: int = 10) -> DataFrame:
        """The blocks with most people among those enrolled but hardly treated."""
        return self.utilisation.where("high_enrolment_low_utilization").orderBy(
            F.col("total_beneficiaries_enrolled").desc(), F.col("block")).limit(k).select(
            *BLOCK, "total_beneficiaries_enrolled", rnd(F.col("overall_utilization_rate") * 100.0, 1).alias("utilization_pct"))
