"""SQL for the gap and peer studies."""

from __future__ import annotations

from cohortline.plans.gap import FACILITIES
from cohortline.plans.peers import TREND_METRICS, WEIGHTED

from .foundation import _class
from .model import complete, hits, rounded


def _div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / NULLIF({b}, 0))"


_PL = "block, district, division"
_BL = "block, district"
X: dict[str, str] = {
    "g_people": "SELECT beneficiary_id, household_id, b.created_at, home_block_name AS block, home_district_code AS district, home_division_name AS division FROM "
                "bm_beneficiary b LEFT JOIN (SELECT * EXCLUDE (created_at) FROM bm_household) h USING (household_id)",
    "g_sites": "SELECT * EXCLUDE (block_name, district_name, division_name), block_name AS block, district_name AS district, division_name AS division FROM hm_hospital",
    "g_cases": "SELECT c.*, strftime(admission_datetime, '%Y-%m') AS month, CAST(floor((epoch(discharge_datetime) - epoch(admission_datetime)) / 86400) AS BIGINT) AS los_days, "
               "p.block, p.district, p.division FROM (SELECT * EXCLUDE (created_at) FROM cm_case) c LEFT JOIN g_people p USING (beneficiary_id)",
    "g_cpc": "SELECT case_id, COALESCE(SUM(amount_claimed), 0) AS total_amount_claimed, CASE WHEN COUNT(CASE WHEN claim_status IN ('APPROVED', 'SETTLED') THEN 1 END) > 0 THEN "
             "COALESCE(SUM(amount_approved), 0) END AS total_amount_approved, COUNT(*) AS claim_count, COUNT(CASE WHEN claim_status IN ('APPROVED', 'SETTLED') THEN 1 END) > 0 AS "
             "any_claim_approved, COUNT(CASE WHEN claim_status = 'REJECTED' THEN 1 END) > 0 AS any_claim_rejected, COUNT(CASE WHEN claim_status = 'QUERY_RAISED' THEN 1 END) > 0 AS "
             "any_claim_queried, COUNT(CASE WHEN claim_status = 'PENDING' THEN 1 END) > 0 AS any_claim_pending, MAX(query_count) AS max_query_count, CAST(SUM(query_count) AS BIGINT) "
             "AS total_query_count, MIN(settlement_tat_days) AS min_settlement_tat_days, ROUND(AVG(settlement_tat_days), 6) AS avg_settlement_tat_days, BOOL_OR(is_portability_claim) "
             "AS is_portability_claim, CASE MAX(CASE claim_status WHEN 'REJECTED' THEN 5 WHEN 'QUERY_RAISED' THEN 4 WHEN 'PENDING' THEN 3 WHEN 'APPROVED' THEN 2 WHEN 'SETTLED' "
             "THEN 1 END) WHEN 5 THEN 'REJECTED' WHEN 4 THEN 'QUERY_RAISED' WHEN 3 THEN 'PENDING' WHEN 2 THEN 'APPROVED' WHEN 1 THEN 'SETTLED' END AS worst_claim_status FROM cm_claim "
             "GROUP BY 1",
    "g_active": "SELECT case_id, preauth_id, status AS preauth_status FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY case_id ORDER BY initiated_at DESC, preauth_id DESC) AS rn FROM "
                "cm_preauth_request WHERE status NOT IN ('REJECTED', 'CANCELLED')) z WHERE rn = 1",
    "g_proc": "SELECT case_id, preauth_status, hbp_procedure_code FROM g_active LEFT JOIN (SELECT preauth_id, hbp_procedure_code FROM cm_preauth_procedure_line WHERE procedure_rank = "
              "1) l USING (preauth_id)",
    "g_dis": f"SELECT case_id, {_class()} AS disease_category FROM (SELECT case_id, icd_code[1] AS l, CAST(icd_code[2:] AS INT) AS d FROM cm_case_diagnosis WHERE diagnosis_rank = 1) x",
}
_PUB, _PRI = "hospital_type = 'PUBLIC'", "hospital_type = 'PRIVATE'"
_EMERG, _ELECT, _DEATH, _LAMA = ("admission_type = 'EMERGENCY'", "admission_type = 'ELECTIVE'", "discharge_type = 'DEATH'",
                                 "discharge_type IN ('LAMA', 'DAMA')")
X["g_demand"] = (
    f"SELECT {_BL}, month, COUNT(*) AS total_cases, {hits(_EMERG)} AS emergency_cases, {hits(_ELECT)} AS elective_cases, {hits('is_portability')} AS portability_out_cases, "
    "COUNT(DISTINCT beneficiary_id) AS unique_beneficiaries, COALESCE(SUM(total_amount_claimed), 0) AS total_amount_claimed, COALESCE(SUM(total_amount_approved), 0) AS "
    f"total_amount_approved, {hits(_DEATH)} AS death_cases, {hits(_LAMA)} AS lama_dama_cases FROM g_cases LEFT JOIN g_cpc USING (case_id) GROUP BY 1, 2, 3")
X["g_supply"] = (
    f"SELECT {_BL}, COUNT(*) AS total_hospitals, {hits(_PUB)} AS public_hospitals, "
    f"{hits(_PRI)} AS private_hospitals, CAST(COALESCE(SUM(total_bed_strength), 0) AS BIGINT) AS total_beds, "
    f"CAST(COALESCE(SUM(inpatient_beds), 0) AS BIGINT) AS total_inpatient_beds, {hits('has_icu_with_ac')} AS hospitals_with_icu, {hits('has_fully_equipped_ot')} AS hospitals_with_ot, "
    f"{hits('delisted_from_gov_schemes')} AS delisted_hospitals, COUNT(accreditation_board) AS accredited_hospitals FROM g_sites GROUP BY 1, 2")
X["g_ds"] = (
    f"SELECT * FROM (SELECT * FROM (SELECT DISTINCT block_name AS block, district_name AS district, division_name AS division FROM ref_up_geography) p, (SELECT DISTINCT month FROM "
    f"g_cases) m) pm LEFT JOIN g_demand USING ({_BL}, month) LEFT JOIN g_supply USING ({_BL}) LEFT JOIN (SELECT {_BL}, COUNT(DISTINCT specialty_code) AS specialties_available FROM hm_specialty_offered JOIN "
    f"g_sites USING (hospital_id) GROUP BY 1, 2) o USING ({_BL}) LEFT JOIN (SELECT home_block_name AS block, home_district_code AS district, COUNT(*) AS total_households_enrolled FROM "
    f"bm_household GROUP BY 1, 2) h USING ({_BL}) LEFT JOIN (SELECT {_BL}, COUNT(*) AS total_beneficiaries_enrolled FROM g_people GROUP BY 1, 2) e USING ({_BL}) LEFT JOIN (SELECT {_BL}, "
    f"COUNT(*) AS active_cards FROM bm_card JOIN g_people USING (beneficiary_id) WHERE card_status = 'ACTIVE' GROUP BY 1, 2) a USING ({_BL})")
X["g_hp"] = (
    "SELECT c.hospital_id, hbp_procedure_code, month, COUNT(*) AS case_count, AVG(los_days) AS avg_los_days, quantile_cont(los_days, 0.5) AS median_los_days, AVG(total_amount_claimed) AS "
    "avg_amount_claimed, AVG(total_amount_approved) AS avg_amount_approved, AVG(total_amount_approved / NULLIF(total_amount_claimed, 0)) AS avg_approval_ratio, "
    "COALESCE(SUM(total_amount_claimed), 0) AS total_amount_claimed, COALESCE(SUM(total_amount_approved), 0) AS total_amount_approved, AVG(CAST(any_claim_approved AS INT)) AS "
    "claim_approval_rate, AVG(CAST(any_claim_rejected AS INT)) AS claim_rejection_rate, AVG(CAST(any_claim_queried AS INT)) AS claim_query_rate, AVG(total_query_count) AS avg_query_count, "
    f"AVG(CASE WHEN discharge_type IN ('NORMAL', 'LIVE') THEN 1 ELSE 0 END) AS normal_discharge_rate, AVG(CASE WHEN {_LAMA} THEN 1 ELSE 0 END) AS lama_dama_rate, AVG(CASE WHEN {_DEATH} "
    "THEN 1 ELSE 0 END) AS mortality_rate, AVG(avg_settlement_tat_days) AS avg_settlement_tat_days, AVG(CASE WHEN preauth_status = 'AUTO_APPROVED' THEN 1 ELSE 0 END) AS "
    "preauth_auto_approval_rate, AVG(CAST(biometric_auth_used AS INT)) AS biometric_auth_rate, AVG(CAST(provided_medicines_flag AS INT)) AS medicines_provided_rate, MIN(procedure_name) AS "
    "procedure_name, MIN(specialty_code) AS specialty_code, MIN(specialty_name) AS specialty_name, MIN(base_package_price) AS base_package_price, MIN(hospital_name) AS hospital_name, "
    "MIN(hospital_type) AS hospital_type, MIN(hospital_sub_type) AS hospital_sub_type, MIN(s.block) AS block, MIN(s.district) AS district, MIN(s.division) AS division, MIN(CASE WHEN "
    "total_bed_strength < 30 THEN 'Small (<30)' WHEN total_bed_strength < 100 THEN 'Medium (30-100)' WHEN total_bed_strength < 300 THEN 'Large (100-300)' WHEN total_bed_strength IS NOT "
    "NULL THEN 'Very Large (300+)' END) AS capacity_band FROM g_cases c LEFT JOIN g_proc USING (case_id) LEFT JOIN ref_hbp_procedure_master USING (hbp_procedure_code) LEFT JOIN cm_discharge "
    "USING (case_id) LEFT JOIN g_cpc USING (case_id) LEFT JOIN g_sites s ON s.hospital_id = c.hospital_id GROUP BY 1, 2, 3")
X["g_enr"] = (
    f"SELECT *, CAST(SUM(new_beneficiaries_enrolled) OVER w AS BIGINT) AS cumulative_beneficiaries, CAST(SUM(new_cards_issued) OVER w AS BIGINT) AS cumulative_cards_issued FROM (SELECT {_PL}, "
    f"month, n AS new_beneficiaries_enrolled, COALESCE(k, 0) AS new_cards_issued FROM (SELECT {_PL}, strftime(created_at, '%Y-%m') AS month, COUNT(*) AS n FROM g_people GROUP BY 1, 2, 3, 4) a "
    f"LEFT JOIN (SELECT {_BL}, strftime(issued_at, '%Y-%m') AS month, COUNT(*) AS k FROM bm_card JOIN g_people USING (beneficiary_id) WHERE issued_at IS NOT NULL GROUP BY 1, 2, 3) b USING "
    f"({_BL}, month)) x WINDOW w AS (PARTITION BY {_BL} ORDER BY month ROWS UNBOUNDED PRECEDING)")
X["g_sg"] = (
    f"SELECT *, COALESCE(cases_demanding > 0 AND COALESCE(hospitals_offering, 0) = 0, FALSE) AS gap_flag, {_div('cases_demanding', 'hospitals_offering')} AS demand_supply_ratio FROM (SELECT "
    f"{_PL}, specialty_code, specialty_name, COUNT(*) AS cases_demanding, COUNT(DISTINCT beneficiary_id) AS unique_patients, COALESCE(SUM(total_amount_claimed), 0) AS amount_claimed FROM g_cases "
    "LEFT JOIN g_proc USING (case_id) LEFT JOIN ref_hbp_procedure_master USING (hbp_procedure_code) LEFT JOIN g_cpc USING (case_id) GROUP BY 1, 2, 3, 4, 5) d FULL JOIN (SELECT "
    f"{_BL}, specialty_code, COUNT(DISTINCT hospital_id) AS hospitals_offering, CAST(COALESCE(SUM(admissions_prev_fy), 0) AS BIGINT) AS total_prev_fy_admissions FROM hm_specialty_offered JOIN "
    f"g_sites USING (hospital_id) GROUP BY 1, 2, 3) s USING ({_BL}, specialty_code)")
X["g_a1base"] = (
    f"SELECT *, {_div('distinct_beneficiaries_with_cases', 'total_beneficiaries_enrolled')} AS overall_utilization_rate, {_div('total_cases_all_months', 'total_beneficiaries_enrolled')} * 1000 AS "
    f"cases_per_1000_enrolled, {_div('bed_days_consumed', 'total_beneficiaries_enrolled')} AS demand_intensity, {_div('total_inpatient_beds', 'total_beneficiaries_enrolled')} * 1000 AS "
    f"local_bed_availability FROM (SELECT {_BL}, MIN(division) AS division, MAX(total_hospitals) AS total_hospitals, MAX(total_inpatient_beds) AS total_inpatient_beds, "
    f"MAX(total_beneficiaries_enrolled) AS total_beneficiaries_enrolled, CAST(COALESCE(SUM(total_cases), 0) AS BIGINT) AS total_cases_all_months FROM g_ds GROUP BY 1, 2) a LEFT JOIN (SELECT {_BL}, "
    f"COUNT(DISTINCT beneficiary_id) AS distinct_beneficiaries_with_cases, CAST(COALESCE(SUM(los_days), 0) AS BIGINT) AS bed_days_consumed FROM g_cases GROUP BY 1, 2) b USING ({_BL})")
X["g_a1st"] = (
    "SELECT quantile_cont(total_beneficiaries_enrolled, 0.5) AS e50, quantile_cont(overall_utilization_rate, 0.25) AS u25, quantile_cont(cases_per_1000_enrolled, 0.75) AS c75, "
    "quantile_cont(local_bed_availability, 0.25) AS b25, AVG(overall_utilization_rate) AS um, STDDEV(overall_utilization_rate) AS us, AVG(cases_per_1000_enrolled) AS cm, "
    "STDDEV(cases_per_1000_enrolled) AS cs, AVG(local_bed_availability) AS bm, STDDEV(local_bed_availability) AS bs FROM g_a1base")


def _z(x: str, m: str, s: str) -> str:
    return f"CASE WHEN {s} IS NULL OR {s} = 0 THEN 0 ELSE ({x} - {m}) / {s} END"


X["g_a1"] = (
    f"SELECT b.*, {_z('overall_utilization_rate', 'um', 'us')} AS z_utilization_rate, {_z('cases_per_1000_enrolled', 'cm', 'cs')} AS z_cases_per_1000, "
    f"{_z('local_bed_availability', 'bm', 'bs')} AS z_local_bed_availability, COALESCE(total_beneficiaries_enrolled >= e50 AND overall_utilization_rate < u25, FALSE) AS "
    "high_enrolment_low_utilization, COALESCE(cases_per_1000_enrolled > c75 AND local_bed_availability < b25, FALSE) AS high_demand_low_local_supply, COALESCE(total_hospitals, 0) = 0 AS "
    "zero_supply, COALESCE(total_hospitals = 1, FALSE) AS single_hospital_dependency FROM g_a1base b, g_a1st s")
X["g_a2"] = (
    "SELECT g.* EXCLUDE (near), CASE WHEN gap_severity = 'NO_SUPPLY' THEN amount_claimed END AS estimated_revenue_leakage, CASE WHEN COALESCE(hospitals_offering, 0) = 0 THEN near END AS "
    "nearest_block_with_supply, near IS NOT NULL AS nearest_block_same_district FROM (SELECT s.*, CASE WHEN COALESCE(cases_demanding, 0) = 0 THEN 'NO_DEMAND' WHEN gap_flag THEN 'NO_SUPPLY' WHEN "
    "demand_supply_ratio > (SELECT quantile_cont(demand_supply_ratio, 0.75) FROM g_sg WHERE demand_supply_ratio > 0) THEN 'UNDERSUPPLIED' ELSE 'ADEQUATE' END AS gap_severity, n.near FROM g_sg s "
    "LEFT JOIN (SELECT district, specialty_code, MIN(block) AS near FROM g_sg WHERE hospitals_offering > 0 GROUP BY 1, 2) n ON n.district = s.district AND n.specialty_code = s.specialty_code) g")
_FAC = " UNION ALL ".join(f"SELECT hospital_id, {_BL}, '{n}' AS disease_category FROM g_sites WHERE {r}" for n, r in FACILITIES.items())
X["g_a3"] = (
    f"SELECT b.* EXCLUDE (whole), {_div('case_count', 'whole')} AS proportion_of_block_cases, {_div('death_count', 'case_count')} AS category_mortality_rate, COALESCE(f.n, 0) AS "
    f"hospitals_with_required_facilities, case_count > 0 AND COALESCE(f.n, 0) = 0 AS infrastructure_mismatch, {_div('case_count', 'COALESCE(f.n, 0)')} AS infrastructure_strain FROM (SELECT {_PL}, "
    f"disease_category, COUNT(*) AS case_count, {hits(_DEATH)} AS death_count, SUM(COUNT(*)) OVER (PARTITION BY {_BL}) AS whole FROM g_cases LEFT JOIN g_dis USING (case_id) GROUP BY 1, 2, 3, 4) b "
    f"LEFT JOIN (SELECT {_BL}, disease_category, COUNT(DISTINCT hospital_id) AS n FROM ({_FAC}) u GROUP BY 1, 2, 3) f ON f.block = b.block AND f.district = b.district AND f.disease_category = "
    "b.disease_category")
X["g_flow"] = (
    "SELECT *, CASE WHEN is_portability THEN 'OUT_OF_STATE' WHEN dd IS NULL THEN 'UNKNOWN' WHEN district = dd AND block = db THEN 'SAME_BLOCK' WHEN district = dd THEN 'SAME_DISTRICT_DIFF_BLOCK' WHEN "
    "division = dv THEN 'DIFF_DISTRICT_SAME_DIVISION' ELSE 'DIFF_DIVISION' END AS kind FROM (SELECT c.*, CASE WHEN is_portability THEN hospital_district ELSE s.district END AS dd, CASE WHEN NOT "
    "is_portability THEN s.block END AS db, CASE WHEN NOT is_portability THEN s.division END AS dv, k.total_amount_claimed FROM g_cases c LEFT JOIN g_sites s ON s.hospital_id = c.hospital_id LEFT JOIN "
    "g_cpc k ON k.case_id = c.case_id) x")
_K = "kind = '{}'".format
_OUT = "kind IN ('DIFF_DISTRICT_SAME_DIVISION', 'DIFF_DIVISION')"
X["g_a4"] = (
    f"SELECT *, {_div('cases_same_block + cases_same_district', 'total_cases')} AS local_retention_rate, {_div('cases_diff_district + cases_out_of_state', 'total_cases')} AS leakage_rate FROM (SELECT "
    f"{_PL}, COUNT(*) AS total_cases, {hits(_K('SAME_BLOCK'))} AS cases_same_block, {hits(_K('SAME_DISTRICT_DIFF_BLOCK'))} AS cases_same_district, {hits(_OUT)} AS cases_diff_district, "
    f"{hits(_K('OUT_OF_STATE'))} AS cases_out_of_state FROM g_flow GROUP BY 1, 2, 3) x")
X["g_a4d"] = (
    "SELECT p.*, CAST(COALESCE(i.k, 0) - COALESCE(e.k, 0) AS BIGINT) AS net_flow FROM (SELECT district AS origin_district, dd AS destination_district, COUNT(*) AS flow_count, "
    "COALESCE(SUM(total_amount_claimed), 0) AS flow_amount_claimed FROM g_flow WHERE dd IS NOT NULL GROUP BY 1, 2) p LEFT JOIN (SELECT district AS d, COUNT(*) AS k FROM g_flow WHERE dd IS NULL OR "
    "district <> dd GROUP BY 1) e ON e.d = p.origin_district LEFT JOIN (SELECT dd AS d, COUNT(*) AS k FROM g_flow WHERE district <> dd GROUP BY 1) i ON i.d = p.origin_district")
X["g_a5base"] = (
    f"SELECT *, {_div('beneficiaries_with_active_card', 'total_beneficiaries')} AS card_activation_rate, {_div('enrolment_rejected_count', 'total_beneficiaries')} AS enrolment_rejection_rate, 1 - "
    f"{_div('beneficiaries_with_active_card', 'total_beneficiaries')} AS drop_off_rate FROM (SELECT {_PL}, COUNT(*) AS total_beneficiaries, {hits('act')} AS beneficiaries_with_active_card, "
    f"{hits('act IS NULL')} AS beneficiaries_no_card, {hits('NOT act')} AS beneficiaries_inactive_card, {hits('rej')} AS enrolment_rejected_count, COUNT(CASE WHEN st NOT IN ('AUTO_APPROVED', "
    "'ISA_APPROVED', 'SHA_APPROVED', 'REJECTED') THEN 1 END) AS enrolment_pending_count FROM g_people LEFT JOIN (SELECT beneficiary_id, BOOL_OR(card_status = 'ACTIVE') AS act FROM bm_card GROUP BY 1) c "
    "USING (beneficiary_id) LEFT JOIN (SELECT beneficiary_id, BOOL_OR(status = 'REJECTED') AS rej FROM bm_enrolment_request GROUP BY 1) r USING (beneficiary_id) LEFT JOIN (SELECT beneficiary_id, status "
    "AS st FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY beneficiary_id ORDER BY submitted_at DESC, enrolment_request_id DESC) AS rn FROM bm_enrolment_request) z WHERE rn = 1) l USING "
    "(beneficiary_id) GROUP BY 1, 2, 3) x")
X["g_a5"] = ("SELECT *, drop_off_rate > (SELECT quantile_cont(drop_off_rate, 0.75) FROM g_a5base) AS high_drop_off, enrolment_rejection_rate > (SELECT quantile_cont(enrolment_rejection_rate, 0.75) FROM "
             "g_a5base) AS high_rejection FROM g_a5base")
_W6 = "OVER (PARTITION BY beneficiary_id ORDER BY admission_datetime, case_id)"
X["g_a6base"] = (
    f"SELECT *, {_div('repeat_beneficiaries', 'total_beneficiaries_with_cases')} AS repeat_rate, {_div('ss', 'ss + sd + dp')} AS possible_treatment_failure_rate FROM (SELECT {_PL}, COUNT(*) AS "
    f"total_beneficiaries_with_cases, {hits('n > 1')} AS repeat_beneficiaries, AVG(n) AS avg_admissions_per_patient, CAST(SUM(ss) AS BIGINT) AS ss, CAST(SUM(sd) AS BIGINT) AS sd, CAST(SUM(dp) AS "
    f"BIGINT) AS dp FROM (SELECT beneficiary_id, {_PL}, COUNT(*) AS n, {hits('rn > 1 AND pp = hbp_procedure_code AND ph = hospital_id')} AS ss, COUNT(CASE WHEN rn > 1 AND pp = hbp_procedure_code AND "
    "NOT COALESCE(ph = hospital_id, FALSE) THEN 1 END) AS sd, COUNT(CASE WHEN rn > 1 AND NOT COALESCE(pp = hbp_procedure_code, FALSE) THEN 1 END) AS dp FROM (SELECT *, "
    f"LAG(hbp_procedure_code) {_W6} AS pp, LAG(hospital_id) {_W6} AS ph, ROW_NUMBER() {_W6} AS rn FROM g_cases LEFT JOIN g_proc USING (case_id)) v GROUP BY 1, 2, 3, 4) p GROUP BY 1, 2, 3) x")
X["g_a6"] = ("SELECT * EXCLUDE (ss, sd, dp), ss AS same_proc_same_hosp_pairs_total, sd AS same_proc_diff_hosp_pairs_total, dp AS diff_proc_pairs_total, repeat_rate > (SELECT quantile_cont(repeat_rate, "
             "0.75) FROM g_a6base) AS high_repeat_rate, COALESCE(possible_treatment_failure_rate > 0.5, FALSE) AND repeat_beneficiaries >= 5 AS possible_treatment_failure FROM g_a6base")
X["g_mon"] = (
    f"SELECT *, s >= 12 AND busy >= 6 AS ok, CASE WHEN s >= 12 AND busy >= 6 AND sd > 0 THEN (total_cases - av) / sd END AS z FROM (SELECT {_PL}, month, COALESCE(total_cases, 0) AS total_cases, "
    f"SUM(COALESCE(total_cases, 0)) OVER p AS s, COUNT(CASE WHEN total_cases > 0 THEN 1 END) OVER p AS busy, AVG(COALESCE(total_cases, 0)) OVER p AS av, STDDEV(COALESCE(total_cases, 0)) OVER p AS sd FROM "
    f"g_ds WINDOW p AS (PARTITION BY {_BL})) x")
X["g_surge"] = (f"SELECT {_BL}, month, disease_category, COUNT(*) AS n FROM g_cases JOIN g_dis USING (case_id) JOIN (SELECT {_BL}, month FROM g_mon WHERE z > 1.5) s USING ({_BL}, month) WHERE "
                "disease_category IS NOT NULL GROUP BY 1, 2, 3, 4")
X["g_a7s"] = (
    f"SELECT {_PL}, meets_threshold, seasonality_index, peak_to_trough_ratio, CASE WHEN sn THEN months END AS peak_months, CASE WHEN sn THEN dc END AS peak_disease_category, sn AS is_seasonal FROM (SELECT "
    f"a.*, d.dc, meets_threshold AND months IS NOT NULL AS sn FROM (SELECT {_PL}, BOOL_OR(ok) AS meets_threshold, CASE WHEN BOOL_OR(ok) AND MAX(av) > 0 THEN MAX(sd) / MAX(av) END AS seasonality_index, CASE "
    f"WHEN BOOL_OR(ok) AND MAX(busy) >= 2 THEN CAST(MAX(total_cases) AS DOUBLE) / MIN(CASE WHEN total_cases > 0 THEN total_cases END) END AS peak_to_trough_ratio, array_to_string([CAST(m AS VARCHAR) FOR m IN list_sort(list(DISTINCT CAST(month[6:7] AS INT)) FILTER (WHERE z > 1.5))], ',') AS months FROM g_mon GROUP BY 1, 2, 3) a LEFT JOIN (SELECT {_BL}, "
    f"disease_category AS dc FROM (SELECT {_BL}, disease_category, ROW_NUMBER() OVER (PARTITION BY {_BL} ORDER BY SUM(n) DESC, disease_category) AS rn FROM g_surge GROUP BY 1, 2, 3) q WHERE rn = 1) d USING "
    f"({_BL})) x")
X["g_a8"] = (
    "SELECT hospital_id, hospital_name, block, district, division, delisted_beds, block_total_beds, own AS delisted_specialties, "
    f"{_div('delisted_beds', 'block_total_beds')} AS bed_share_lost, block_total_beds - delisted_beds AS block_remaining_beds, sites = 1 AS sole_provider_delisted, lost AS specialties_lost, "
    f"COALESCE({_div('delisted_beds', 'block_total_beds')} > 0.5, FALSE) AS majority_capacity_lost, lost <> '' AS specialty_lost, total_cases_all_months AS block_total_cases, "
    f"{_div('total_cases_all_months', 'block_total_beds - delisted_beds')} AS block_cases_per_remaining_bed FROM (SELECT h.hospital_id, h.hospital_name, h.block, h.district, h.division, h.inpatient_beds AS "
    "delisted_beds, b.block_total_beds, b.sites, (SELECT string_agg(DISTINCT specialty_code, ',' ORDER BY specialty_code) FROM hm_specialty_offered o WHERE o.hospital_id = h.hospital_id) AS own, "
    "COALESCE((SELECT string_agg(DISTINCT specialty_code, ',' ORDER BY specialty_code) FROM hm_specialty_offered o WHERE o.hospital_id = h.hospital_id AND o.specialty_code NOT IN (SELECT q.specialty_code FROM "
    "hm_specialty_offered q JOIN g_sites k ON k.hospital_id = q.hospital_id WHERE NOT k.delisted_from_gov_schemes AND k.block = h.block AND k.district = h.district)), '') AS lost, u.total_cases_all_months FROM "
    f"g_sites h LEFT JOIN (SELECT {_BL}, CAST(COALESCE(SUM(inpatient_beds), 0) AS BIGINT) AS block_total_beds, COUNT(*) AS sites FROM g_sites GROUP BY 1, 2) b ON b.block = h.block AND b.district = h.district "
    "LEFT JOIN g_a1base u ON u.block = h.block AND u.district = h.district WHERE h.delisted_from_gov_schemes) x")


def _roll(by: str, top: str, extra: str) -> str:
    level = by.split(",")[0]
    flag = "high_enrolment_low_utilization OR high_demand_low_local_supply OR zero_supply OR single_hospital_dependency"
    return (f"SELECT {by}, CAST(COALESCE(SUM(total_beneficiaries_enrolled), 0) AS BIGINT) AS enrolled, {extra.format(flag=flag)}, ROUND(SUM(overall_utilization_rate * total_beneficiaries_enrolled) / "
            f"SUM(total_beneficiaries_enrolled) * 100, 1) AS utilization_pct, MIN(t.nm) AS {top} FROM g_a1 LEFT JOIN (SELECT {level}, specialty_name AS nm FROM (SELECT {level}, specialty_name, ROW_NUMBER() OVER "
            f"(PARTITION BY {level} ORDER BY SUM(cases_demanding) DESC, specialty_name) AS rn FROM g_a2 WHERE gap_flag AND specialty_name IS NOT NULL GROUP BY 1, 2) q WHERE rn = 1) t USING ({level}) GROUP BY "
            f"{by}")


X["g_div"] = _roll("division", "top_specialty_gap", "COUNT(CASE WHEN zero_supply THEN 1 END) AS zero_supply_blocks")
X["g_dist"] = _roll("district, division", "top_unmet_specialty", "CAST(SUM(total_cases_all_months) AS BIGINT) AS cases, COUNT(CASE WHEN {flag} THEN 1 END) AS flagged_blocks")
_CARD = "SUM(card_activation_rate * total_beneficiaries) / SUM(total_beneficiaries) * 100"
_N = ", ".join
X["g_sum"] = (
    "SELECT * FROM (SELECT hospital_id, hbp_procedure_code, CAST(SUM(case_count) AS BIGINT) AS total_cases, COUNT(*) AS active_months, MIN(month) AS first_month, MAX(month) AS last_month, "
    "SUM(total_amount_claimed) AS total_amount_claimed, SUM(total_amount_approved) AS total_amount_approved, "
    + _N(f"COALESCE(SUM({c} * case_count), 0) / SUM(case_count) AS {c}" for c in WEIGHTED)
    + ", SUM(total_amount_claimed) / SUM(case_count) AS avg_amount_claimed, SUM(total_amount_approved) / SUM(case_count) AS avg_amount_approved, SUM(total_amount_approved) / NULLIF(SUM(total_amount_claimed), "
    "0) AS avg_approval_ratio, " + _N(f"MIN({c}) AS {c}" for c in (
        "hospital_name", "hospital_type", "hospital_sub_type", "block", "district", "division", "capacity_band", "procedure_name", "specialty_code", "specialty_name", "base_package_price"))
    + " FROM g_hp GROUP BY 1, 2) x WHERE total_cases >= 5")
_PEER = "hbp_procedure_code, hospital_type"


def _stats(m: str, p: str) -> str:
    return (f"SELECT {_PEER}, AVG({m}) AS {p}_avg, STDDEV({m}) AS {p}_std, quantile_cont({m}, 0.5) AS {p}_median, quantile_cont({m}, 0.25) AS {p}_p25, quantile_cont({m}, 0.75) AS {p}_p75, COUNT({m}) AS "
            f"peer_hospital_count FROM g_sum WHERE hbp_procedure_code IS NOT NULL AND hospital_type IS NOT NULL GROUP BY 1, 2")


def _rank(m: str) -> str:
    return (f"CASE WHEN a.hospital_type IS NOT NULL AND a.hbp_procedure_code IS NOT NULL THEN (SELECT 50.0 * (COUNT(CASE WHEN b.{m} < a.{m} THEN 1 END) + COUNT(CASE WHEN b.{m} <= a.{m} THEN 1 END) + 1) / "
            f"COUNT(*) FROM g_sum b WHERE b.hbp_procedure_code = a.hbp_procedure_code AND b.hospital_type = a.hospital_type) END")


def _pz(m: str, p: str) -> str:
    return f"CASE WHEN {p}_std IS NULL OR {p}_std = 0 THEN 0 ELSE ({m} - {p}_avg) / {p}_std END"


def _f(cond: str) -> str:
    return f"COALESCE({cond}, FALSE)"


X["g_p1"] = (
    f"SELECT a.*, s.* EXCLUDE ({_PEER}), {_pz('avg_amount_claimed', 'peer_cost')} AS cost_z_score, {_rank('avg_amount_claimed')} AS cost_percentile_rank, avg_amount_claimed / NULLIF(base_package_price, 0) AS "
    f"cost_vs_package, avg_amount_claimed - avg_amount_approved AS approval_gap, 1 - avg_approval_ratio AS approval_gap_rate, {_f('peer_hospital_count < 3')} AS small_peer_group FROM g_sum a LEFT JOIN "
    f"({_stats('avg_amount_claimed', 'peer_cost')}) s USING ({_PEER})")
X["g_p2"] = (f"SELECT a.*, s.* EXCLUDE ({_PEER}), {_pz('avg_los_days', 'peer_los')} AS los_z_score, {_rank('avg_los_days')} AS los_percentile_rank, avg_los_days / NULLIF(peer_los_median, 0) AS "
             f"los_vs_peer_median, {_f('peer_hospital_count < 3')} AS small_peer_group FROM g_sum a LEFT JOIN ({_stats('avg_los_days', 'peer_los')}) s USING ({_PEER})")
X["g_p3"] = (f"SELECT a.*, m AS peer_avg_lama_dama_rate, nm AS peer_avg_normal_discharge_rate, CASE WHEN m >= 0.01 AND sd <> 0 THEN (lama_dama_rate - m) / sd END AS lama_dama_z_score, "
             f"{_rank('lama_dama_rate')} AS lama_dama_percentile_rank FROM g_sum a LEFT JOIN (SELECT {_PEER}, AVG(lama_dama_rate) AS m, STDDEV(lama_dama_rate) AS sd, AVG(normal_discharge_rate) AS nm FROM g_sum "
             f"GROUP BY 1, 2) s USING ({_PEER})")
_QM = (("claim_rejection_rate", "peer_rej", "rejection_z_score"), ("claim_query_rate", "peer_qry", "query_z_score"), ("avg_settlement_tat_days", "peer_tat", "settlement_tat_z_score"))
X["g_p4"] = (
    "SELECT a.*, " + _N(f"{p}_avg" for _, p, _ in _QM) + ", " + _N(f"{_pz(m, p)} AS {z}" for m, p, z in _QM) + ", ("
    + " + ".join(f"CASE WHEN {p}_min = {p}_max THEN 1.0 ELSE 1 - ({m} - {p}_min) / ({p}_max - {p}_min) END" for m, p, _ in _QM)
    + ") / 3 AS claims_quality_score FROM g_sum a LEFT JOIN (SELECT " + _PEER + ", "
    + _N(f"AVG({m}) AS {p}_avg, STDDEV({m}) AS {p}_std, MIN({m}) AS {p}_min, MAX({m}) AS {p}_max" for m, p, _ in _QM) + f" FROM g_sum GROUP BY 1, 2) s USING ({_PEER})")
X["g_tr0"] = ("SELECT *, DENSE_RANK() OVER (ORDER BY month) - 1 AS x FROM (SELECT h.* FROM g_hp h JOIN g_sum s ON s.hospital_id = h.hospital_id AND s.hbp_procedure_code = h.hbp_procedure_code WHERE "
              "s.active_months >= 4) y")
_SHORT = {m: m.replace("avg_", "").replace("claim_", "").replace("_days", "") for m in TREND_METRICS}


def _slope(m: str) -> str:
    ok = f"CASE WHEN {m} IS NOT NULL THEN"
    w = f"NULLIF(SUM({ok} case_count END), 0)"
    e = {k: f"(CAST(SUM({ok} {v} END) AS DOUBLE) / {w})" for k, v in (("x", "case_count * x"), ("y", f"case_count * {m}"), ("xx", "case_count * x * x"), ("xy", f"case_count * x * {m}"))}
    d = f"({e['xx']} - {e['x']} * {e['x']})"
    return (f"COUNT({m}) AS n_{_SHORT[m]}, {e['y']} AS my_{_SHORT[m]}, CASE WHEN COUNT({m}) >= 4 THEN CASE WHEN {d} IS NULL OR {d} = 0 THEN 0 ELSE ({e['xy']} - {e['x']} * {e['y']}) / {d} END END AS "
            f"{_SHORT[m]}_slope")


X["g_tr1"] = "SELECT hospital_id, hbp_procedure_code, " + _N(_slope(m) for m in TREND_METRICS) + " FROM g_tr0 GROUP BY 1, 2"
_TREND = _N(
    f"CASE WHEN n_{s} < 4 THEN 'INSUFFICIENT_DATA' WHEN NOT COALESCE(ABS({s}_slope) / NULLIF(ABS(my_{s}), 0) > 0.05, FALSE) THEN 'STABLE' WHEN {s}_slope {'<' if TREND_METRICS[m] == 'decreasing' else '>'} 0 "
    f"THEN 'IMPROVING' ELSE 'DECLINING' END AS {s}_trend" for m, s in _SHORT.items())
X["g_tr2"] = f"SELECT hospital_id, hbp_procedure_code, {_N(f'{s}_slope' for s in _SHORT.values())}, {_TREND} FROM g_tr1"


def _cnt(v: str) -> str:
    return "(" + " + ".join(f"CASE WHEN {s}_trend = '{v}' THEN 1 ELSE 0 END" for s in _SHORT.values()) + ")"


X["g_p5"] = (
    f"SELECT *, overall_trajectory = 'DECLINING' AS declining_hospital, overall_trajectory = 'IMPROVING' AS improving_hospital FROM (SELECT * EXCLUDE (u, d, v), CASE WHEN v = 0 THEN 'INSUFFICIENT_DATA' WHEN d "
    f"= 0 AND u > v / 2 THEN 'IMPROVING' WHEN u = 0 AND d > v / 2 THEN 'DECLINING' WHEN u = 0 AND d = 0 THEN 'STABLE' ELSE 'MIXED' END AS overall_trajectory FROM (SELECT *, {_cnt('IMPROVING')} AS u, "
    f"{_cnt('DECLINING')} AS d, {len(_SHORT)} - {_cnt('INSUFFICIENT_DATA')} AS v FROM g_tr2) x) y")
_HC, _AG, _LS = _f("cost_z_score > 1.5"), _f("approval_gap_rate > 0.2"), _f("los_z_score > 1.5")
_HL = _f("lama_dama_z_score > 1.5")
_Q3 = [_f(f"{z} > 1.5") for _, _, z in _QM]
_POOR = "(" + " + ".join(f"CAST({q} AS INT)" for q in _Q3) + ") >= 2"
_OVER = (("overall_lama_dama_rate", "lama_dama_rate"), ("overall_claim_rejection_rate", "claim_rejection_rate"), ("overall_claim_query_rate", "claim_query_rate"),
         ("overall_settlement_tat", "avg_settlement_tat_days"), ("weighted_avg_los", "avg_los_days"), ("weighted_avg_cost", "avg_amount_claimed"), ("biometric_auth_rate", "biometric_auth_rate"),
         ("medicines_provided_rate", "medicines_provided_rate"))
_PK = "hospital_id, hbp_procedure_code"
_FLAGSRC = " UNION ALL ".join(f"SELECT {_PK}, '{n}' AS mark, CAST({c} AS INT) AS v FROM {src}" for n, c, src in (
    ("hc", _HC, "g_p1"), ("ag", _AG, "g_p1"), ("ls", _LS, "g_p2"), ("hl", _HL, "g_p3"), ("pc", _POOR, "g_p4"), ("dh", "declining_hospital", "g_p5")))
X["g_flags"] = (f"SELECT *, hc + ag + ls + hl + pc + dh AS f FROM (SELECT {_PK}, " + _N(f"COALESCE(MAX(CASE WHEN mark = '{n}' THEN v END), 0) AS {n}" for n in ("hc", "ag", "ls", "hl", "pc", "dh"))
                + f" FROM ({_FLAGSRC}) u WHERE hospital_id IS NOT NULL GROUP BY 1, 2) x")
X["g_p6"] = (
    "SELECT *, CASE WHEN total_flags >= 3 OR max_flags_single_procedure >= 3 THEN 'NEEDS_REVIEW' WHEN total_flags >= 1 THEN 'WATCH' ELSE 'SATISFACTORY' END AS attention_level FROM (SELECT hospital_id, "
    + _N(f"MIN({c}) AS {c}" for c in ("hospital_name", "hospital_type", "hospital_sub_type", "block", "district", "division", "capacity_band"))
    + ", COUNT(DISTINCT hbp_procedure_code) AS procedures_performed, COUNT(DISTINCT specialty_code) AS specialties_covered, SUM(total_amount_approved) / NULLIF(SUM(total_amount_claimed), 0) AS "
    "overall_approval_ratio, " + _N(f"COALESCE(SUM({c} * total_cases), 0) / SUM(total_cases) AS {n}" for n, c in _OVER)
    + ", CAST(SUM(total_cases) AS BIGINT) AS total_cases FROM g_sum WHERE hospital_id IS NOT NULL GROUP BY 1) a LEFT JOIN (SELECT hospital_id, "
    + _N(f"CAST(SUM({c}) AS BIGINT) AS {n}" for c, n in (("hc", "cost_outlier_procedures"), ("ls", "los_outlier_procedures"), ("hl", "high_lama_dama_procedures"), ("pc", "poor_claims_procedures"),
                                                         ("dh", "declining_procedures"), ("f", "total_flags")))
    + ", MAX(f) AS max_flags_single_procedure, COUNT(CASE WHEN f = 0 THEN 1 END) AS clean_procedures FROM g_flags GROUP BY 1) b USING (hospital_id)")


SQL = {
    "G0a_claims_per_case": ("g_cpc", "*"),
    "G0b_demand_supply": ("g_ds", "*, " + _N(f"{e} AS {n}" for n, e in (
        ("cases_per_1000_enrolled", _div("total_cases", "total_beneficiaries_enrolled") + " * 1000"), ("cases_per_bed", _div("total_cases", "total_inpatient_beds")),
        ("utilization_rate", _div("unique_beneficiaries", "total_beneficiaries_enrolled")), ("portability_out_rate", _div("portability_out_cases", "total_cases")),
        ("bed_density_per_1000", _div("total_inpatient_beds", "total_beneficiaries_enrolled") + " * 1000")))),
    "G0c_hospital_performance": ("g_hp", "*"),
    "G0d_enrolment_monthly": ("g_enr", "*"),
    "G0e_specialty_gap": ("g_sg", "*, gap_flag AS unmet_demand"),
    "G1_utilisation_scores": ("g_a1", "*"),
    "G2_specialty_matrix": ("g_a2", "*"),
    "G3_disease_burden": ("g_a3", "*"),
    "G4a_block_flows": ("g_a4", "*"),
    "G4b_district_flows": ("g_a4d", "*"),
    "G5_card_dropoff": ("g_a5", "*"),
    "G6_repeat_use": ("g_a6", "*"),
    "G7a_seasonal_patterns": (f"g_mon LEFT JOIN (SELECT {_BL}, month, disease_category AS surge_dominant_disease FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {_BL}, month ORDER BY n DESC, disease_category) AS "
                              f"rn FROM g_surge) q WHERE rn = 1) d USING ({_BL}, month)",
                              f"{_PL}, month, total_cases, z AS z_score_monthly, COALESCE(z > 1.5, FALSE) AS surge_month, surge_dominant_disease"),
    "G7b_seasonal_summary": ("g_a7s", "*"),
    "G8_delisted_impact": ("g_a8", "*"),
    "G9_division_rollup": ("g_div LEFT JOIN (SELECT division, ROUND(SUM(leakage_rate * total_cases) / SUM(total_cases) * 100, 1) AS leakage_pct FROM g_a4 GROUP BY 1) l USING (division) LEFT JOIN (SELECT division, "
                           f"ROUND(100 - {_CARD}, 1) AS card_drop_off_pct FROM g_a5base GROUP BY 1) c USING (division) LEFT JOIN (SELECT division, {hits('is_seasonal')} AS seasonal_blocks FROM g_a7s GROUP BY 1) s "
                           "USING (division)", "*"),
    "G10_district_rollup": ("g_dist LEFT JOIN (SELECT origin_district AS district, net_flow AS net_patient_flow FROM g_a4d WHERE origin_district = destination_district) f USING (district) LEFT JOIN (SELECT "
                            f"district, ROUND({_CARD}, 1) AS card_activation_pct FROM g_a5base GROUP BY 1) c USING (district)", "*"),
    "G11_priority_blocks": (f"g_a1 LEFT JOIN (SELECT {_BL}, COUNT(*) AS g FROM g_a2 WHERE gap_flag GROUP BY 1, 2) s USING ({_BL}) LEFT JOIN (SELECT {_BL}, COUNT(*) AS m FROM g_a3 WHERE infrastructure_mismatch "
                            f"GROUP BY 1, 2) i USING ({_BL}) LEFT JOIN (SELECT {_BL}, drop_off_rate FROM g_a5base) c USING ({_BL}) LEFT JOIN (SELECT {_BL}, leakage_rate FROM g_a4) l USING ({_BL}) LEFT JOIN (SELECT "
                            f"{_BL}, is_seasonal FROM g_a7s) z USING ({_BL}) WHERE high_enrolment_low_utilization OR zero_supply OR single_hospital_dependency",
                            f"{_PL}, total_beneficiaries_enrolled AS enrolled, ROUND(overall_utilization_rate * 100, 1) AS utilization_pct, COALESCE(total_hospitals, 0) AS hospitals, "
                            "COALESCE(total_inpatient_beds, 0) AS beds, COALESCE(g, 0) AS specialty_gaps, COALESCE(m, 0) AS infra_mismatches, ROUND(drop_off_rate * 100, 1) AS drop_off_pct, ROUND(leakage_rate * "
                            "100, 1) AS leakage_pct, is_seasonal"),
    "G11_gap_annex": ("g_a2 WHERE gap_flag", f"{_BL}, specialty_name, cases_demanding, hospitals_offering, gap_severity, estimated_revenue_leakage, nearest_block_with_supply"),
    "G12_headline": (
        "g_a1", "COUNT(*) AS blocks, CAST(SUM(total_beneficiaries_enrolled) AS BIGINT) AS enrolled, CAST(SUM(total_cases_all_months) AS BIGINT) AS cases, CAST(SUM(total_inpatient_beds) AS BIGINT) AS beds, "
        f"{hits('high_enrolment_low_utilization')} AS low_use_blocks, CAST(COALESCE(SUM(CASE WHEN zero_supply THEN total_beneficiaries_enrolled END), 0) AS BIGINT) AS enrolled_without_supply, "
        f"{hits('zero_supply')} AS zero_supply_blocks, {hits('single_hospital_dependency')} AS single_hospital_blocks, (SELECT {hits('gap_flag')} FROM g_a2) AS specialty_gaps, (SELECT "
        f"COALESCE(SUM(estimated_revenue_leakage), 0) FROM g_a2) AS revenue_leakage, (SELECT {hits('infrastructure_mismatch')} FROM g_a3) AS mismatches, (SELECT ROUND((SUM(cases_same_block) + "
        "SUM(cases_same_district)) / SUM(total_cases) * 100.0, 1) FROM g_a4) AS retention_pct, (SELECT ROUND(SUM(beneficiaries_with_active_card) / SUM(total_beneficiaries) * 100.0, 1) FROM g_a5base) AS "
        "card_activation_pct, (SELECT ROUND(SUM(repeat_beneficiaries) / SUM(total_beneficiaries_with_cases) * 100.0, 1) FROM g_a6base) AS repeat_pct, "
        f"(SELECT {hits('is_seasonal')} FROM g_a7s) AS seasonal_blocks"),
    "G12_leakage_by_specialty": ("g_a2 WHERE gap_flag GROUP BY 1, 2", "specialty_code, specialty_name, CAST(SUM(cases_demanding) AS BIGINT) AS unmet_cases, COUNT(DISTINCT block) AS blocks, "
                                 "COALESCE(SUM(estimated_revenue_leakage), 0) AS leakage"),
    "G12_top_blocks": ("g_a1 WHERE high_enrolment_low_utilization ORDER BY total_beneficiaries_enrolled DESC, block LIMIT 10", f"{_BL}, total_beneficiaries_enrolled, "
                       "ROUND(overall_utilization_rate * 100, 1) AS utilization_pct"),
    "P0_pair_summary": ("g_sum", "*"),
    "P1_P4_cost": ("g_p1", f"{_PK}, hospital_name, hospital_type, procedure_name, specialty_code, base_package_price, total_cases, avg_amount_claimed, avg_amount_approved, avg_approval_ratio, peer_cost_avg, "
                   "peer_cost_median, peer_cost_p25, peer_cost_p75, peer_hospital_count, cost_z_score, cost_vs_package, cost_percentile_rank, approval_gap, approval_gap_rate, "
                   f"{_HC} AS high_cost_outlier, {_f('cost_z_score < -1.5')} AS low_cost_outlier, {_AG} AS high_approval_gap, {_f('cost_vs_package > 1.3')} AS above_package_rate, small_peer_group"),
    "P2_P5_stay": ("g_p2", f"{_PK}, hospital_name, hospital_type, procedure_name, total_cases, avg_los_days, peer_los_avg, peer_los_median, peer_los_p25, peer_los_p75, los_z_score, los_percentile_rank, "
                   f"los_vs_peer_median, {_LS} AS long_stay_outlier, {_f('los_z_score < -1.5')} AS short_stay_outlier, small_peer_group"),
    "P3_P6_outcomes": ("g_p3", f"{_PK}, hospital_name, hospital_type, procedure_name, total_cases, lama_dama_rate, normal_discharge_rate, peer_avg_lama_dama_rate, peer_avg_normal_discharge_rate, "
                       f"lama_dama_z_score, lama_dama_percentile_rank, {_HL} AS high_lama_dama, normal_discharge_rate > 0.95 AND total_cases >= 10 AS excellent_retention"),
    "P7_claims_quality": ("g_p4", f"{_PK}, hospital_name, hospital_type, procedure_name, total_cases, claim_rejection_rate, claim_query_rate, avg_query_count, avg_settlement_tat_days, peer_rej_avg, "
                          f"peer_qry_avg, peer_tat_avg, rejection_z_score, query_z_score, settlement_tat_z_score, claims_quality_score, {_Q3[0]} AS high_rejection, {_Q3[1]} AS high_query, {_Q3[2]} AS "
                          f"slow_settlement, {_POOR} AS poor_claims_quality, claim_rejection_rate = 0 AND claim_query_rate < 0.05 AND total_cases >= 10 AS clean_claims"),
    "P8_trends": ("g_p5", "*"),
    "P9_scorecard": ("g_p6", "*"),
}


def study_sql() -> dict[str, str]:
    return rounded({k: complete(f"SELECT {cols} FROM {source}", X) for k, (source, cols) in SQL.items()})
