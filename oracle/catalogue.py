"""SQL for every catalogue question, with the parameter values the registered queries use."""

from __future__ import annotations

from .model import best, complete, day_gap, hits, isum, lit, pct, per, q_at, query, ravg, rsum, share, uniq

PARAMS: dict[str, object] = {
    "district": "NATION_7", "district_2": "NATION_9", "block": "NATION_7 FURNITURE", "hospital": "Supplier#000000006",
    "division": "ASIA", "division_2": "EUROPE", "specialty": "SP2", "diagnosis_category": "NCD",
    "claim_status": "SETTLED", "year": 1998, "month": 3, "as_of": "2001-06-30", "male": "M", "female": "F",
    "query_action": "RAISE_QUERY", "first_day": "1996-01-01", "last_day": "1999-01-01",
    "more_than": 5, "fewer_cases": 200, "more_people": 5,
}
_P = {k: lit(v) for k, v in PARAMS.items()}
D1, D2, BLK, HOSP, DIV, DIV2, SPEC, CAT = (
    _P[k] for k in ("district", "district_2", "block", "hospital", "division", "division_2", "specialty",
                    "diagnosis_category"))
BOTH = f"IN ({D1}, {D2})"
ASOF = f"DATE {_P['as_of']}"
Y, MO = _P["year"], _P["month"]
HOME = {"district": f"home_district_code = {D1}", "block": f"home_block_name = {BLK}",
        "division": f"home_division_name = {DIV}"}
SITE = {"district": f"district_name = {D1}", "block": f"block_name = {BLK}", "hospital": f"hospital_name = {HOSP}"}
CARE = {"district": f"hospital_district = {D1}", "division": f"hospital_division = {DIV}"}
HD, HV, HB = ("home_district_code AS district_name", "home_division_name AS division_name",
              "home_block_name AS block_name")
CD, CV = "hospital_district AS district_name", "hospital_division AS division_name"
HNAME = "hospital_id, hospital_name, district_name, hospital_type"

SQL: dict[str, str] = {}
_REJECTED = "claim_status = 'REJECTED'"
HOME_BLOCK = HOME["block"]


def month(col: str) -> str:
    return f"strftime({col}, '%Y-%m-01')"


def mix(source: str, key: str, name: str, digits: int, where: str = "") -> str:
    return query(source, [key], {name: "COUNT(*)", "pct": share("COUNT(*)", digits)}, where)


# ---- enrolment
_cards = (
    "(SELECT h.*, b.beneficiary_id, c.card_id, c.card_status FROM bm_household h "
    "LEFT JOIN bm_beneficiary b ON h.household_id = b.household_id LEFT JOIN bm_card c ON b.beneficiary_id = c.beneficiary_id) e"
)
_heads = {"households": uniq("household_id"), "beneficiaries": uniq("beneficiary_id")}
_active = {"active_cards": uniq("card_id", "card_status = 'ACTIVE'")}
SQL["D01"] = query(_cards, [], {f"total_{k}": v for k, v in _heads.items()} | _active)
SQL["D02"] = query(_cards, [HD, HV], _heads | _active)
SQL["D03"] = query(_cards, [HV], _heads)
SQL["T01"] = query(_cards, [HD], _heads, HOME["district"])
SQL["T11"] = query(_cards, [HB, HD], _heads, f"{HOME['block']} AND {HOME['district']}")
SQL["T48"] = query(_cards, [HB], _heads, HOME["block"])
SQL["T112"] = query(_cards, [HD], _heads | _active, f"home_district_code {BOTH}")
SQL["T128"] = query(_cards, [HV], _heads | _active, HOME["division"])
_states = {"isa_approved": hits("status = 'ISA_APPROVED'"), "auto_approved": hits("status = 'AUTO_APPROVED'"),
           "rejected": hits("status = 'REJECTED'")}
SQL["T162"] = query("bm_enrolment_request", ["month(submitted_at) AS month"], {"enrolment_count": "COUNT(*)"} | _states,
                    f"year(submitted_at) = {Y}")
_range = "{c} >= TIMESTAMP " + _P["first_day"] + " AND {c} < TIMESTAMP " + _P["last_day"]
SQL["D44"] = query("bm_enrolment_request", [f"{month('submitted_at')} AS enrolment_month"],
                   {"new_enrolments": "COUNT(*)"} | _states, _range.format(c="submitted_at"))
SQL["D04"] = mix("bm_beneficiary", "gender", "count", 2)
SQL["D07"] = mix("bm_beneficiary", "bis_record_status", "count", 2)
SQL["D06"] = mix("bm_household", "entitlement_source", "households", 2)
SQL["D40"] = mix("bm_enrolment_request", "auth_mode", "count", 2)
SQL["D43"] = mix("bm_card", "card_status", "count", 2)
for _a, _b, _src, _key, _n in (("T09", "T49", "member", "gender", "count"),
                               ("T38", "T52", "member", "bis_record_status", "count"),
                               ("T37", "T51", "bm_household", "entitlement_source", "households"),
                               ("T73", "T101", "cd", "card_status", "card_count")):
    SQL[_a], SQL[_b] = (mix(_src, _key, _n, 2, HOME[v]) for v in ("district", "block"))
SQL["T168"], SQL["T227"] = (mix("cd", "card_status", "card_count", 1, HOME[v]) for v in ("district", "block"))
SQL["T75"] = mix("rq", "auth_mode", "request_count", 2, HOME["district"])
SQL["D99"] = query("cd", ["home_district_code AS district"], {
    "active": hits("card_status = 'ACTIVE'"), "inactive": hits("card_status = 'INACTIVE'"),
    "disabled": hits("card_status = 'DISABLED'"), "total": "COUNT(card_id)",
    "active_pct": pct(hits("card_status = 'ACTIVE'"), "COUNT(card_id)", 1)})
_act = uniq("card_id", "card_status = 'ACTIVE'")
SQL["T255"] = query("(SELECT * FROM member LEFT JOIN bm_card USING (beneficiary_id)) x", ["home_district_code AS district"], {
    "total_enrolled": uniq("beneficiary_id"), "active_cards": _act,
    "active_card_rate_pct": pct(_act, uniq("beneficiary_id"), 1)}, f"home_district_code {BOTH}")
_born = "COALESCE(yob, year(dob))"
_age = (f"CASE WHEN year({ASOF}) - {_born} < 18 THEN '0-17' WHEN year({ASOF}) - {_born} < 46 THEN '18-45' "
        f"WHEN year({ASOF}) - {_born} < 66 THEN '46-65' ELSE '65+' END AS age_bucket")
SQL["D05"] = mix("bm_beneficiary", _age, "count", 2, f"{_born} IS NOT NULL")
SQL["T36"], SQL["T50"] = (mix("member", _age, "count", 2, f"{_born} IS NOT NULL AND {HOME[v]}")
                          for v in ("district", "block"))
_mob = {"total_beneficiaries": "COUNT(*)", "with_mobile": "COUNT(mobile)", "mobile_pct": pct("COUNT(mobile)", "COUNT(*)", 2)}
SQL["D08"] = query("bm_beneficiary", [], _mob)
SQL["T39"], SQL["T53"] = (query("member", [], _mob, HOME[v]) for v in ("district", "block"))
_gap = {"missing_dob": "yob IS NULL AND dob IS NULL", "missing_mobile": "mobile IS NULL", "missing_photo": "photo_uri IS NULL"}
_gap["any_field_missing"] = " OR ".join(f"({c})" for c in _gap.values())
SQL["D41"] = query("bm_beneficiary", [], {"total_beneficiaries": "COUNT(*)"}
                   | {f"{k}_count": hits(c) for k, c in _gap.items()}
                   | {f"{k}_pct": pct(hits(c), "COUNT(*)", 2) for k, c in _gap.items()})


def held(names, birth: str = "yob IS NOT NULL") -> dict[str, str]:
    conds = (birth, "mobile IS NOT NULL", "photo_uri IS NOT NULL")
    return {"total_beneficiaries": "COUNT(*)"} | {k: pct(hits(c), "COUNT(*)", 1) for k, c in zip(names, conds)}


_birth = "yob IS NOT NULL OR dob IS NOT NULL"
_three = ("dob_pct", "mobile_pct", "photo_pct")
_rate3 = ("yob_completeness_pct", "mobile_completeness_pct", "photo_completeness_pct")
SQL["D100"] = query("member", ["home_district_code AS district"],
                    held(("dob_completeness_pct", "mobile_completeness_pct", "photo_completeness_pct")))
SQL["T169"] = query("member", [], held(_rate3) | {"with_yob": "COUNT(yob)", "with_mobile": "COUNT(mobile)",
                                                  "with_photo": "COUNT(photo_uri)"}, HOME["district"])
SQL["T228"] = query("member", [], held(_rate3), HOME["block"])
SQL["T211"] = query("member", ["entitlement_source"], held(("yob_pct", "mobile_pct", "photo_pct")) | {
    "overall_completeness_pct": pct("COUNT(yob) + COUNT(mobile) + COUNT(photo_uri)", "COUNT(*) * 3", 1)}, HOME["district"])
SQL["T251"] = query("member", ["entitlement_source"], held(_three, _birth), HOME["block"])
for _k in ("T256", "T272"):
    SQL[_k] = query("member", ["home_district_code AS district"], held(_three, _birth), f"home_district_code {BOTH}")


def dups(by: list[str], where: str, name: str, digits: int) -> str:
    return query("member", by, {"total_beneficiaries": "COUNT(*)", name: hits("is_duplicate"),
                                "duplicate_rate_pct": pct(hits("is_duplicate"), "COUNT(*)", digits)}, where)


SQL["D42"] = query("member", [HD, HV], {"duplicate_count": "COUNT(*)", "pct_of_all_dupes": share("COUNT(*)", 2)},
                   "is_duplicate", order="-duplicate_count district_name", limit=50)
SQL["T72"] = dups([HD], HOME["district"], "duplicate_count", 2)
SQL["T102"] = dups([HB], HOME["block"], "duplicate_count", 2)
SQL["T208"] = dups(["entitlement_source"], HOME["district"], "duplicate_count", 1)
SQL["T249"] = dups(["entitlement_source"], HOME["block"], "duplicates", 2)
SQL["T270"] = dups(["home_district_code AS district"], f"home_district_code {BOTH}", "duplicates", 2)


def refused(source: str, by: list[str], where: str, name: str = "rejected", digits: int = 2) -> str:
    k = hits("status = 'REJECTED'")
    return query(source, by, {"total_requests": "COUNT(*)", name: k, "rejection_rate_pct": pct(k, "COUNT(*)", digits)}, where)


SQL["D39"] = (
    f"WITH whole AS ({refused('bm_enrolment_request', [], '', 'rejected_count')}), reasons AS ("
    + query("bm_enrolment_request", ["COALESCE(rejection_reason, 'UNSPECIFIED') AS rejection_reason"],
            {"reason_count": "COUNT(*)", "reason_pct": share("COUNT(*)", 2)}, "status = 'REJECTED'",
            order="-reason_count rejection_reason", limit=15) + ") SELECT * FROM whole, reasons")
SQL["T74"] = refused("rq", [HD], HOME["district"])
SQL["T209"] = refused("rq", ["submitted_by_role"], HOME["district"], digits=1)
SQL["T210"] = refused("rq", ["auth_mode"], HOME["district"], digits=1)
SQL["T250"] = refused("rq", ["auth_mode"], HOME["block"], digits=1)
SQL["T271"] = refused("rq", ["home_district_code AS district", "auth_mode"], f"home_district_code {BOTH}", digits=1)
SQL["D137"] = best(
    "SELECT *, RANK() OVER (ORDER BY duplicate_rate_pct DESC NULLS LAST) AS dup_rank, RANK() OVER (ORDER BY "
    "rejection_rate_pct DESC NULLS LAST) AS rej_rank, ROUND(duplicate_rate_pct + COALESCE(rejection_rate_pct, 0), 1) AS s "
    f"FROM (SELECT district, total_beneficiaries, duplicate_rate_pct FROM ({dups(['home_district_code AS district'], '', 'd', 1)}) a) a "
    f"LEFT JOIN (SELECT district, rejection_rate_pct FROM ({refused('rq', ['home_district_code AS district'], '', digits=1)}) b) b "
    "USING (district)", "-s district", 20, "s")
_lag = day_gap("submitted_at", "issued_at")
SQL["D38"] = query("rc", [HD, HV], {"enrolments_with_card": uniq("beneficiary_id"), "avg_days_to_card": ravg(_lag),
                                    "median_days_to_card": q_at(_lag, 0.5)}, f"submitted_at IS NOT NULL AND {_lag} >= 0")
SQL["T71"] = query("rc", [HD], {"total_enrolments": uniq("enrolment_request_id"), "with_card": uniq("enrolment_request_id"),
                                "avg_days_to_card": ravg(_lag), "median_days_to_card": q_at(_lag, 0.5)}, HOME["district"])
for _k, _v in (("T173", "district"), ("T231", "block")):
    SQL[_k] = query("rc", [], {"total_enrolments": uniq("enrolment_request_id"),
                               "within_30_days": uniq("enrolment_request_id", f"{_lag} <= 30"),
                               "within_30_days_pct": pct(uniq("enrolment_request_id", f"{_lag} <= 30"),
                                                         uniq("enrolment_request_id"), 1)}, HOME[_v])
_okreq = ("(SELECT beneficiary_id, MIN(submitted_at) AS asked_at FROM bm_enrolment_request "
          "WHERE status IN ('ISA_APPROVED', 'AUTO_APPROVED') GROUP BY 1)")
_anyreq = "(SELECT beneficiary_id, MIN(submitted_at) AS asked_at FROM bm_enrolment_request GROUP BY 1)"
_adm = "(SELECT beneficiary_id, MIN(admission_datetime) AS came_at FROM cm_case GROUP BY 1)"
_issue = "(SELECT beneficiary_id, MIN(issued_at) AS got_at FROM bm_card GROUP BY 1)"
_g = day_gap("asked_at", "got_at")
SQL["D105"] = query(f"(SELECT * FROM {_okreq} a JOIN {_issue} i USING (beneficiary_id) JOIN member USING (beneficiary_id)) x",
                    ["home_district_code AS district"],
                    {"total_issued": "COUNT(*)", "issued_within_30d": hits(f"{_g} <= 30"),
                     "pct_within_30d": pct(hits(f"{_g} <= 30"), "COUNT(*)", 1)}, "got_at IS NOT NULL",
                    order="-pct_within_30d district", limit=30)
SQL["T260"] = query("(SELECT * FROM rq LEFT JOIN (SELECT beneficiary_id, issued_at FROM bm_card) k USING (beneficiary_id)) x",
                    ["home_district_code AS district"],
                    {"total_enrolments": uniq("beneficiary_id"),
                     "issued_within_30d": uniq("beneficiary_id", f"{_lag} <= 30"),
                     "pct_within_30d": pct(uniq("beneficiary_id", f"{_lag} <= 30"), uniq("beneficiary_id"), 1)},
                    f"home_district_code {BOTH}")


def early(first: str, by: list[str], where: str, names) -> str:
    g = f"{day_gap('asked_at', 'came_at')} <= 30"
    return query(f"(SELECT * FROM member JOIN {first} a USING (beneficiary_id) JOIN {_adm} c USING (beneficiary_id)) x", by,
                 {names[0]: uniq("beneficiary_id"), names[1]: uniq("beneficiary_id", g),
                  names[2]: pct(uniq("beneficiary_id", g), uniq("beneficiary_id"), 1)}, where)


SQL["D106"] = early(_okreq, ["home_district_code AS district"], "",
                    ("enrolled_with_case", "admitted_within_30d", "pct_admitted_within_30d"))
for _k, _v in (("T174", "district"), ("T232", "block")):
    SQL[_k] = early(_anyreq, [], HOME[_v], ("total_claimants", "within_30_days", "within_30_days_pct"))
SQL["T261"] = early(_anyreq, ["home_district_code AS district"], f"home_district_code {BOTH}",
                    ("ever_admitted", "admitted_within_30d", "pct_within_30d"))
_mc = "(SELECT * FROM member LEFT JOIN (SELECT beneficiary_id, card_id FROM bm_card) k USING (beneficiary_id)) x"
_none = uniq("beneficiary_id", "card_id IS NULL")
SQL["T223"] = query(_mc, [], {"total_enrolled": uniq("beneficiary_id"), "with_card": uniq("beneficiary_id", "card_id IS NOT NULL"),
                              "without_card": _none, "no_card_pct": pct(_none, uniq("beneficiary_id"), 1)}, HOME["district"])
SQL["T224"] = query(_mc, [HB], {"total_enrolled": uniq("beneficiary_id"), "without_card": _none,
                                "no_card_pct": pct(_none, uniq("beneficiary_id"), 1)}, HOME["district"],
                    order="-no_card_pct block_name", limit=10)
SQL["T246"] = query(_mc, [], {"total_enrolled": uniq("beneficiary_id"), "no_card": _none,
                              "no_card_pct": pct(_none, uniq("beneficiary_id"), 1)}, HOME["block"])
_nc = uniq("beneficiary_id", "case_id IS NULL")
SQL["D37"] = query("(SELECT beneficiary_id, case_id FROM bm_beneficiary LEFT JOIN cm_case USING (beneficiary_id)) x", [],
                   {"total_enrolled": uniq("beneficiary_id"), "never_utilized": _nc,
                    "never_utilized_pct": pct(_nc, uniq("beneficiary_id"), 2)})
for _k, _v in (("T70", "district"), ("T100", "block")):
    SQL[_k] = query("(SELECT m.*, case_id FROM member m LEFT JOIN cm_case USING (beneficiary_id)) x", [],
                    {"total_enrolled": uniq("beneficiary_id"), "ever_utilized": uniq("beneficiary_id", "case_id IS NOT NULL"),
                     "never_utilized": _nc, "never_utilized_pct": pct(_nc, uniq("beneficiary_id"), 1)}, HOME[_v])
_steps = [("Step 1: Enrolled", "SELECT COUNT(DISTINCT beneficiary_id) FROM bm_beneficiary"),
          ("Step 2: Card Issued", "SELECT COUNT(DISTINCT beneficiary_id) FROM bm_card"),
          ("Step 3: Admitted", "SELECT COUNT(DISTINCT beneficiary_id) FROM cm_case"),
          ("Step 4: Claimed", "SELECT COUNT(DISTINCT beneficiary_id) FROM cc WHERE claim_status <> 'PENDING'"),
          ("Step 5: Paid", "SELECT COUNT(DISTINCT beneficiary_id) FROM cp WHERE payment_status = 'SUCCESS'")]
SQL["D95"] = " UNION ALL ".join(
    f"SELECT '{s}' AS funnel_step, ({c}) AS beneficiary_count, "
    + ("CAST(100 AS DOUBLE) AS pct_of_enrolled, CAST(NULL AS DOUBLE) AS pct_of_prev_step" if i == 0 else
       f"{pct(f'({c})', f'({_steps[0][1]})', 2)}, {pct(f'({c})', f'({_steps[i - 1][1]})', 2)}")
    for i, (s, c) in enumerate(_steps))
for _k, _v in (("T99", "district"), ("T111", "block")):
    _w = HOME[_v]
    _st = [("enrolled_households", f"SELECT COUNT(DISTINCT household_id) FROM bm_household WHERE {_w}"),
           ("cards_issued", f"SELECT COUNT(DISTINCT card_id) FROM cd WHERE {_w}"),
           ("admitted", f"SELECT COUNT(DISTINCT case_id) FROM hc WHERE {_w}"),
           ("claimed", f"SELECT COUNT(DISTINCT claim_id) FROM hcc WHERE {_w}"),
           ("paid", f"SELECT COUNT(DISTINCT claim_id) FROM hcc JOIN cm_payment USING (claim_id) "
                    f"WHERE payment_status = 'SUCCESS' AND {_w}")]
    SQL[_k] = " UNION ALL ".join(
        f"SELECT '{s}' AS funnel_step, {i + 1} AS step_order, ({c}) AS count, "
        + ("CAST(100 AS DOUBLE)" if i == 0 else pct(f"({c})", f"({_st[0][1]})", 1)) + " AS pct_of_enrolled"
        for i, (s, c) in enumerate(_st))
_seen = "(SELECT m.*, case_id FROM member m LEFT JOIN cm_case USING (beneficiary_id)) x"
_tr = uniq("beneficiary_id", "case_id IS NOT NULL")
SQL["D142"] = query(_seen, ["home_district_code AS district"],
                    {"enrolled": uniq("beneficiary_id"), "treated": _tr,
                     "conversion_rate_pct": pct(_tr, uniq("beneficiary_id"), 2)})
SQL["T285"] = query(_seen, ["home_block_name AS block"],
                    {"enrolled_count": uniq("beneficiary_id"), "admitted_count": uniq("case_id"),
                     "conversion_rate_pct": pct(uniq("case_id"), uniq("beneficiary_id"), 2)}, HOME["district"],
                    order="conversion_rate_pct block", limit=10)

# ---- hospitals
SQL["D09"] = mix("hm_hospital", "hospital_type", "count", 2)
SQL["T06"] = query("hm_hospital", ["hospital_type", "hospital_sub_type"],
                   {"hospital_count": "COUNT(*)", "total_beds": isum("total_bed_strength")}, SITE["district"])
SQL["T13"] = f"SELECT hospital_name, hospital_type, district_name, total_bed_strength FROM hm_hospital WHERE {SITE['block']}"
SQL["D10"] = query("hm_hospital", ["district_name", "division_name"], {"hospital_count": "COUNT(*)"})
_ppl = "(SELECT home_district_code AS {k}, COUNT(DISTINCT beneficiary_id) AS {n} FROM member GROUP BY 1)"
_hos = "(SELECT district_name AS {k}, COUNT(DISTINCT hospital_id) AS {n}, CAST(SUM(total_bed_strength) AS BIGINT) AS beds FROM hm_hospital GROUP BY 1)"
SQL["D11"] = (f"SELECT district_name, hospital_count, beneficiary_count, {per('hospital_count', 'beneficiary_count', 100000, 2)} "
              f"AS hospitals_per_lakh FROM {_hos.format(k='district_name', n='hospital_count')} h "
              f"JOIN {_ppl.format(k='district_name', n='beneficiary_count')} p USING (district_name)")
_cov = {"hospital_count": uniq("hospital_id"), "admissions_prev_fy": isum("admissions_prev_fy")}
SQL["D12"] = query("hm_specialty_offered", ["specialty_code", "specialty_name"], _cov)
SQL["T40"], SQL["T54"] = (query("offer", ["specialty_code", "specialty_name"], _cov, SITE[v]) for v in ("district", "block"))
SQL["T16"] = f"SELECT specialty_code, specialty_name, admissions_prev_fy, admissions_before_last_year FROM offer WHERE {SITE['hospital']}"
SQL["T150"] = ("SELECT hospital_name, bank_name, ifsc_code, account_number_token, authorized_signatory_name FROM hm_hospital "
               f"JOIN hm_hospital_bank_account USING (hospital_id) WHERE {SITE['hospital']}")
SQL["T15"] = ("SELECT hospital_name, hospital_type, district_name, total_bed_strength, COUNT(DISTINCT case_id) AS total_cases, "
              "COUNT(DISTINCT claim_id) AS total_claims, ROUND(SUM(amount_claimed), 2) AS total_claimed, "
              f"ROUND(AVG(settlement_tat_days), 1) AS avg_tat, {hits(_REJECTED)} AS rejected_claims "
              "FROM hm_hospital LEFT JOIN (SELECT hospital_id, case_id FROM cm_case) c USING (hospital_id) "
              f"LEFT JOIN cm_claim USING (case_id) WHERE {SITE['hospital']} GROUP BY hospital_id, 1, 2, 3, 4")
_bed = {"hospital_count": "COUNT(*)", "total_beds": isum("total_bed_strength"), "inpatient_beds": isum("inpatient_beds"),
        "avg_beds_per_hospital": ravg("total_bed_strength", 0)}
SQL["D14"] = query("hm_hospital", ["hospital_type", "hospital_sub_type"], _bed)
SQL["T42"], SQL["T56"] = (query("hm_hospital", ["hospital_type", "hospital_sub_type"], _bed, SITE[v])
                          for v in ("district", "block"))
_stf = "(SELECT h.*, s.staff_id FROM hm_hospital h LEFT JOIN hm_staff s USING (hospital_id)) x"
_ratio = {"hospitals": uniq("hospital_id"), "total_beds": isum("total_bed_strength"), "total_staff": "COUNT(staff_id)",
          "staff_per_bed": per("COUNT(staff_id)", "SUM(total_bed_strength)", 1, 3)}
SQL["D15"] = query(_stf, ["hospital_type", "hospital_sub_type"], _ratio)
SQL["T43"] = query(_stf, ["hospital_type", "hospital_sub_type"], _ratio, SITE["district"])
SQL["T57"] = query(_stf, ["hospital_type"], _ratio, SITE["block"])
SQL["D47"] = best(
    "SELECT hospital_id, hospital_name, district_name, hospital_type, total_bed_strength, avg_monthly_cases, "
    f"{per('avg_monthly_cases', 'total_bed_strength', 1, 3)} AS cases_per_bed_per_month FROM (SELECT hospital_id, "
    "ROUND(AVG(k), 2) AS avg_monthly_cases FROM (SELECT hospital_id, date_trunc('month', admission_datetime) AS m, COUNT(*) AS k "
    "FROM cm_case WHERE admission_datetime IS NOT NULL GROUP BY 1, 2) a GROUP BY 1) b JOIN hm_hospital USING (hospital_id) "
    "WHERE total_bed_strength > 0 AND avg_monthly_cases > total_bed_strength", "-cases_per_bed_per_month hospital_id", 50,
    "hospital_id")
SQL["T83"] = ("SELECT hospital_name, hospital_type, inpatient_beds, case_count, cases_per_bed_ratio FROM ("
              + query("sc", ["hospital_id", "hospital_name", "hospital_type", "inpatient_beds"],
                      {"case_count": uniq("case_id"), "cases_per_bed_ratio": per(uniq("case_id"), "inpatient_beds", 1, 2)},
                      CARE["district"]) + ") x WHERE cases_per_bed_ratio > 0.5")
_hs = query("sc", ["hospital_id", "hospital_name", "hospital_type", "total_bed_strength"],
            {"case_count": uniq("case_id"), "cases_per_bed": per(uniq("case_id"), "total_bed_strength", 1, 2)}, CARE["district"])
SQL["T221"] = (f"WITH hs AS ({_hs}), av AS (SELECT AVG(cases_per_bed) AS a FROM hs) SELECT hospital_name, hospital_type, "
               "total_bed_strength, case_count, cases_per_bed, ROUND(a, 6) AS district_avg, ROUND(cases_per_bed / NULLIF(a, 0), 2) "
               "AS ratio_to_avg FROM hs, av WHERE cases_per_bed > a * 1.5")
SQL["T152"] = (f"SELECT hospital_name, inpatient_beds, (SELECT COUNT(*) FROM sc WHERE {SITE['hospital']} AND admission_datetime >= "
               f"CAST({ASOF} - INTERVAL '30 days' AS TIMESTAMP)) AS admissions_last_30_days, ROUND(100.0 * (SELECT COUNT(*) FROM sc WHERE "
               f"{SITE['hospital']} AND admission_datetime >= CAST({ASOF} - INTERVAL '30 days' AS TIMESTAMP)) / NULLIF(inpatient_beds * 30, 0), 1) "
               f"AS estimated_avg_daily_occupancy_pct FROM hm_hospital WHERE {SITE['hospital']}")
_lack = {"icu": "NOT has_icu_with_ac", "ot": "NOT has_fully_equipped_ot", "hdu": "NOT has_hdu"}
_all3 = " AND ".join(_lack.values())
SQL["D50"] = query("hm_hospital", [], {"total_hospitals": "COUNT(*)"} | {f"no_{k}": hits(c) for k, c in _lack.items()}
                   | {f"pct_no_{k}": pct(hits(c), "COUNT(*)", 2) for k, c in _lack.items()}
                   | {"missing_all_three": hits(_all3), "pct_missing_all_three": pct(hits(_all3), "COUNT(*)", 2)})
_exp = uniq("hospital_id", f"expiry_date < {ASOF}")
_lic = {"total_hospitals_with_licenses": uniq("hospital_id"), "expired": _exp, "pct_expired": pct(_exp, uniq("hospital_id"), 2)}
SQL["D13"] = query("hm_license_certificate", [], _lic)
SQL["T41"], SQL["T55"] = (query("lic", [], _lic, SITE[v]) for v in ("district", "block"))
SQL["T18"] = ("SELECT hospital_name, license_name, certificate_no, CAST(issue_date AS VARCHAR) AS issue_date, CAST(expiry_date AS VARCHAR) "
              f"AS expiry_date, CASE WHEN expiry_date >= {ASOF} THEN 'CURRENT' ELSE 'EXPIRED' END AS status FROM lic WHERE {SITE['hospital']}")
SQL["D48"] = mix("hm_hospital", "COALESCE(accreditation_board, 'NONE') AS accreditation_board", "hospital_count", 2)
_apr = "amount_approved / NULLIF(amount_claimed, 0) * 100.0"
SQL["D49"] = query("scc", ["CASE WHEN accreditation_board IS NOT NULL THEN 'Accredited' ELSE 'Not Accredited' END AS accreditation_status"],
                   {"hospital_count": uniq("hospital_id"), "total_claims": "COUNT(claim_id)", "avg_approval_rate_pct": ravg(_apr)},
                   "amount_claimed > 0")
SQL["T84"] = ("SELECT hospital_name, hospital_type, accreditation_board, accreditation_level, CAST(accreditation_valid_upto AS VARCHAR) AS "
              "accreditation_valid_upto, CASE WHEN accreditation_valid_upto IS NULL THEN 'NOT_ACCREDITED' WHEN accreditation_valid_upto "
              f">= {ASOF} THEN 'VALID' ELSE 'EXPIRED' END AS accreditation_status FROM hm_hospital WHERE {SITE['district']}")
SQL["T213"] = query("sc", [], {"total_cases": uniq("case_id"),
                               "accredited_hospital_cases": uniq("case_id", "accreditation_board IS NOT NULL"),
                               "accredited_share_pct": pct(uniq("case_id", "accreditation_board IS NOT NULL"), uniq("case_id"), 1)},
                    CARE["district"])
SQL["D51"] = best(query("sc", ["hospital_id", "hospital_name", "district_name", "hospital_type"],
                        {"recent_case_count": uniq("case_id"), "latest_admission": "CAST(CAST(MAX(admission_datetime) AS DATE) AS VARCHAR)"},
                        f"delisted_from_gov_schemes AND admission_datetime >= CAST({ASOF} - INTERVAL '12 months' AS TIMESTAMP)"),
                  "-recent_case_count hospital_id", 20, "hospital_id")
SQL["T190"] = best(
    "SELECT hospital_id, hospital_name, hospital_type, CAST(expiry_date AS VARCHAR) AS expiry_date, COUNT(DISTINCT case_id) AS recent_cases "
    "FROM lic JOIN (SELECT hospital_id, case_id FROM cm_case WHERE admission_datetime >= "
    f"CAST({ASOF} - INTERVAL '365 days' AS TIMESTAMP)) c USING (hospital_id) WHERE {SITE['district']} AND expiry_date < {ASOF} GROUP BY 1, 2, 3, 4",
    "-recent_cases hospital_id expiry_date", 10, "hospital_id")
_wl = "(SELECT clinician_staff_id, COUNT(DISTINCT case_id) AS case_count FROM asked JOIN (SELECT case_id, hospital_district FROM cm_case) c USING (case_id) WHERE clinician_staff_id IS NOT NULL{w} GROUP BY 1)"
SQL["D53"] = best(query(f"(SELECT h.*, staff_id, case_count FROM hm_staff s JOIN {_wl.format(w='')} w ON w.clinician_staff_id = s.staff_id "
                        "JOIN hm_hospital h ON h.hospital_id = s.hospital_id) x",
                        ["hospital_id", "hospital_name", "district_name", "hospital_type"],
                        {"doctor_count": uniq("staff_id"), "avg_cases_per_doctor": ravg("case_count"), "min_cases": "MIN(case_count)",
                         "max_cases": "MAX(case_count)", "p75_cases": q_at("case_count", 0.75), "p95_cases": q_at("case_count", 0.95)}),
                  "-avg_cases_per_doctor hospital_id", 50, "hospital_id")
SQL["D135"] = best(
    "SELECT clinician_staff_id, s.name AS clinician_name, s.hospital_id, h.hospital_name, case_count, top_procedure FROM "
    "(SELECT clinician_staff_id, COUNT(DISTINCT case_id) AS case_count FROM asked GROUP BY 1) a JOIN hm_staff s ON s.staff_id = clinician_staff_id "
    "JOIN hm_hospital h ON h.hospital_id = s.hospital_id LEFT JOIN (SELECT clinician_staff_id, procedure_name AS top_procedure FROM "
    "(SELECT clinician_staff_id, procedure_name, ROW_NUMBER() OVER (PARTITION BY clinician_staff_id ORDER BY COUNT(*) DESC, procedure_name) AS r "
    "FROM priced JOIN (SELECT preauth_id FROM cm_preauth_request) z USING (preauth_id) GROUP BY clinician_staff_id, hbp_procedure_code, procedure_name) t WHERE r = 1) t USING (clinician_staff_id)",
    "-case_count clinician_staff_id", 20)
SQL["T85"] = query(_wl.format(w=f" AND {CARE['district']}") + " x", [],
                   {"total_clinicians": "COUNT(*)", "avg_cases_per_clinician": ravg("case_count"),
                    "max_cases_per_clinician": "MAX(case_count)", "median_cases_per_clinician": q_at("case_count", 0.5)})
SQL["T148"] = ("SELECT hospital_name, COUNT(DISTINCT staff_id) AS total_clinicians, COUNT(DISTINCT case_id) AS total_cases, "
               f"{per('COUNT(DISTINCT case_id)', 'COUNT(DISTINCT staff_id)', 1, 1)} AS cases_per_clinician FROM hm_hospital LEFT JOIN "
               "(SELECT hospital_id, staff_id FROM hm_staff) s USING (hospital_id) LEFT JOIN (SELECT hospital_id, case_id FROM cm_case) c "
               f"USING (hospital_id) WHERE {SITE['hospital']} GROUP BY 1")
_docs = ("(SELECT a.*, s.name AS clinician_name, s.role_type, sc.hospital_name, sc.hospital_district FROM asked a "
         "JOIN sc USING (case_id) JOIN hm_staff s ON s.staff_id = a.clinician_staff_id)")
SQL["T202"] = best(query(f"{_docs} x", ["clinician_staff_id", "clinician_name", "role_type", "hospital_name"],
                         {"case_count": uniq("case_id")}, CARE["district"]),
                   "-case_count clinician_staff_id hospital_name", 10, "clinician_staff_id")
SQL["T203"] = best(query(f"(SELECT * FROM {_docs} y JOIN (SELECT case_id, amount_approved FROM cm_claim) k USING (case_id)) x",
                         ["clinician_staff_id", "clinician_name", "role_type", "hospital_name"],
                         {"case_count": uniq("case_id"), "avg_approved_amount": ravg("amount_approved", 2)}, CARE["district"]),
                   "-avg_approved_amount clinician_staff_id hospital_name", 10, "clinician_staff_id")
_noff = "NOT EXISTS (SELECT 1 FROM hm_specialty_offered o WHERE o.hospital_id = x.hospital_id AND o.specialty_code = x.specialty_code)"
SQL["D46"] = best(f"SELECT {HNAME}, specialty_code AS unauthorized_specialty_code, COUNT(*) AS procedure_count FROM sln x "
                  f"WHERE {_noff} GROUP BY hospital_id, hospital_name, district_name, hospital_type, specialty_code",
                  "-procedure_count hospital_id unauthorized_specialty_code", 50, "hospital_id")
SQL["T82"] = ("SELECT hospital_name, hospital_type, specialty_code AS treated_specialty, specialty_name AS treated_specialty_name, "
              f"COUNT(DISTINCT case_id) AS case_count FROM sln x WHERE {CARE['district']} AND {_noff} GROUP BY 1, 2, 3, 4")
_resv = "reserved_public_hospitals_only AND hospital_type = 'PRIVATE'"
SQL["D136"] = query("sln", ["hospital_district AS district", "hbp_procedure_code", "procedure_name"],
                    {"private_cases": uniq("case_id"), "private_hospitals_billing": uniq("hospital_id")}, _resv)
SQL["T204"] = ("SELECT hospital_name, hospital_type, hbp_procedure_code, procedure_name, COUNT(DISTINCT case_id) AS case_count FROM sln "
               f"WHERE {_resv} AND {CARE['district']} GROUP BY hospital_id, 1, 2, 3, 4")


def by_type(source: str, where: str, name: str, digits: int, share_name: str = "pct_cases", money: bool = True) -> str:
    cols = {name: uniq("case_id"), share_name: share(uniq("case_id"), digits)}
    return query(source, ["hospital_type"], cols | ({"total_claimed": rsum("amount_claimed")} if money else {}), where)


SQL["D25"] = by_type("sccl", "", "total_cases", 2)
SQL["T29"] = by_type("sccl", CARE["district"], "case_count", 2)
SQL["T63"] = by_type("sccl", SITE["block"], "case_count", 2)
SQL["T133"] = by_type("sccl", CARE["division"], "case_count", 1)
SQL["D82"] = query("scc", ["hospital_type"], {"hospital_count": uniq("hospital_id"), "total_claims": "COUNT(claim_id)",
                                              "avg_approval_rate_pct": ravg(_apr), "median_approval_rate_pct": q_at(_apr, 0.5)},
                   "amount_claimed > 0")
_t = "settlement_tat_days"
SQL["D83"] = query("scc", ["hospital_type"], {"hospital_count": uniq("hospital_id"), "settled_claims": "COUNT(claim_id)",
                                              "avg_tat_days": ravg(_t), "median_tat_days": q_at(_t, 0.5),
                                              "p90_tat_days": q_at(_t, 0.9), "max_tat_days": f"MAX({_t})"}, f"{_t} IS NOT NULL")
_hsc = "(SELECT hc.*, s.hospital_name, s.hospital_type, s.district_name, s.block_name FROM hc JOIN site s USING (hospital_id)) x"
for _k, _ty in (("D110", "PRIVATE"), ("D111", "PUBLIC")):
    _l = _ty.lower()
    SQL[_k] = query(_hsc, ["home_district_code AS home_district"],
                    {"total_cases": uniq("case_id"), f"{_l}_cases": uniq("case_id", f"hospital_type = '{_ty}'"),
                     f"{_l}_pct": pct(uniq("case_id", f"hospital_type = '{_ty}'"), uniq("case_id"), 1)},
                    order=f"-{_l}_pct home_district", limit=20)
SQL["T120"] = query("sc", [CD, "hospital_type"], {"case_count": uniq("case_id"),
                                                  "pct_of_district_cases": share(uniq("case_id"), 1, "hospital_district")},
                    f"hospital_district {BOTH}")
SQL["T207"] = (f"SELECT hospital_type, state_pct, COALESCE(district_pct, 0) AS district_pct, ROUND(COALESCE(district_pct, 0) - state_pct, 1) "
               f"AS difference FROM ({by_type('sc', '', 'k', 1, 'state_pct', False)}) a LEFT JOIN "
               f"({by_type('sc', CARE['district'], 'k2', 1, 'district_pct', False)}) b USING (hospital_type)")
_hdist = f"(SELECT MIN(home_district_code) FROM bm_household WHERE {HOME['block']})"
SQL["T245"] = (f"SELECT hospital_type, block_cases, block_pct, district_cases, district_pct FROM "
               f"({by_type(_hsc, HOME['block'], 'block_cases', 1, 'block_pct', False)}) a FULL OUTER JOIN "
               f"({by_type(_hsc, f'home_district_code = {_hdist}', 'district_cases', 1, 'district_pct', False)}) b USING (hospital_type)")
SQL["T252"] = by_type(_hsc, HOME["block"], "case_count", 1, "share_pct", False)
SQL["T266"] = query("sln", ["hospital_district", "hospital_type", "specialty_code"], {"case_count": uniq("case_id")},
                    f"hospital_district {BOTH}")
SQL["T220"] = ("SELECT hospital_type, procedure_name, usage_count FROM (SELECT hospital_type, procedure_name, COUNT(*) AS usage_count, "
               "ROW_NUMBER() OVER (PARTITION BY hospital_type ORDER BY COUNT(*) DESC, procedure_name) AS r FROM sln "
               f"WHERE {CARE['district']} GROUP BY 1, 2) x WHERE r <= 10")
SQL["T283"] = query("sln", ["hospital_district AS district", "hospital_type", "specialty_code", "procedure_name"],
                    {"case_count": uniq("case_id")}, f"hospital_district {BOTH}")

# ---- claims
_rej = hits("claim_status = 'REJECTED'")


def summary(source: str, by: list[str], where: str = "", names=("total_claimed", "total_approved"), tat=False, rejected=False) -> str:
    cols = {"total_cases": uniq("case_id"), "total_claims": uniq("claim_id"), names[0]: rsum("amount_claimed"),
            names[1]: rsum("amount_approved")}
    if tat:
        cols["avg_tat_days"] = ravg(_t)
    if rejected:
        cols["rejected_claims"] = _rej
    return query(source, by, cols, where)


SQL["D16"] = summary("ccl", [], names=("total_amount_claimed", "total_amount_approved"))
SQL["D18"] = summary("ccl", [CD, CV], names=("amount_claimed", "amount_approved"))
SQL["D19"] = summary("ccl", [CV], names=("amount_claimed", "amount_approved"))
SQL["T02"] = summary("ccl", [CD], CARE["district"], tat=True)
SQL["T129"] = summary("ccl", [CV], CARE["division"], tat=True)
SQL["T59"] = summary("sccl", ["block_name"], SITE["block"], tat=True)
SQL["T12"] = query("sccl", ["block_name", "district_name"], {"total_cases": uniq("case_id"), "total_claimed": rsum("amount_claimed")},
                   f"{SITE['block']} AND {SITE['district']}")
SQL["T26"] = summary("ccl", [CD], f"hospital_district {BOTH}", rejected=True)
SQL["T140"] = summary("ccl", [CV], f"hospital_division IN ({DIV}, {DIV2})", rejected=True)
_yr = f"year(admission_datetime) = {Y}"
_yk = "year(admission_datetime) AS year"
SQL["T31"] = summary("ccl", [CD, _yk], f"{CARE['district']} AND {_yr}")
SQL["T163"] = summary("ccl", [_yk], _yr, rejected=True)
SQL["T167"] = summary("ccl", [_yk, "quarter(admission_datetime) AS quarter"], _yr)
SQL["T33"] = query("ccl", [CD], {"case_count": "COUNT(*)", "claim_count": uniq("claim_id"), "total_claimed": rsum("amount_claimed")}, _yr)
SQL["T10"] = query("sccl", ["block_name", "district_name"], {"case_count": uniq("case_id"), "total_claimed": rsum("amount_claimed")},
                   SITE["district"])


def my(col: str) -> list[str]:
    return [f"month({col}) AS month", f"year({col}) AS year"]


def in_my(col: str) -> str:
    return f"month({col}) = {MO} AND year({col}) = {Y}"


SQL["T32"] = query("cm_claim", my("submitted_at"), {"total_claims": "COUNT(*)", "total_claimed": rsum("amount_claimed"),
                                                    "total_approved": rsum("amount_approved"), "rejected_claims": _rej},
                   in_my("submitted_at"))
SQL["D36"] = ("SELECT hospital_name, district_name, hospital_type, COUNT(DISTINCT claim_id) AS claim_count, ROUND(SUM(amount_claimed), 2) AS "
              "total_claimed, ROUND(SUM(amount_approved), 2) AS total_approved FROM scc GROUP BY hospital_id, 1, 2, 3")
_vol = "COUNT(DISTINCT case_id) AS case_count, ROUND(SUM(amount_claimed), 2) AS total_claimed"
for _k, _w in (("T03", CARE["district"]), ("T64", SITE["block"])):
    SQL[_k] = f"SELECT hospital_name, hospital_type, {_vol} FROM sccl WHERE {_w} GROUP BY hospital_id, 1, 2"
SQL["T136"] = best(f"SELECT hospital_id, hospital_name, hospital_type, district_name, {_vol} FROM sccl WHERE {CARE['division']} GROUP BY 1, 2, 3, 4",
                   "-case_count hospital_id", 10, "hospital_id")
_am = f"{month('admission_datetime')} AS month"
SQL["D17"] = query("cm_case", [_am], {"case_count": "COUNT(*)"}, _range.format(c="admission_datetime"))
SQL["T05"] = query("cm_case", [_am], {"case_count": "COUNT(*)"}, CARE["district"])
SQL["T135"] = query("cm_case", [_am], {"case_count": "COUNT(*)"}, CARE["division"])
SQL["T17"], SQL["T58"] = (query("sc", [_am], {"case_count": "COUNT(*)"}, SITE[v]) for v in ("hospital", "block"))
SQL["D27"] = query("cm_case", ["month(admission_datetime) AS month"], {"avg_monthly_cases": "ROUND(COUNT(*) * 1.0 / 3, 1)"},
                   _range.format(c="admission_datetime"))
SQL["D61"] = query("cc", [_am], {"claim_count": uniq("claim_id"), "monthly_paid": rsum("amount_approved"),
                                 "monthly_claimed": rsum("amount_claimed")},
                   f"admission_datetime >= TIMESTAMP {_P['first_day']}")
_sm = {"count": "COUNT(*)", "pct": share("COUNT(*)", 2), "total_claimed": rsum("amount_claimed")}
SQL["D20"] = query("cm_claim", ["claim_status"], _sm)
SQL["T27"] = query("cc", ["claim_status"], _sm, CARE["district"])
SQL["T60"] = query("scc", ["claim_status"], _sm, SITE["block"])
SQL["T28"] = ("SELECT claim_id, case_number, hospital_name, strftime(submitted_at, '%Y-%m-%d %H:%M:%S') AS submitted_at, amount_claimed, "
              f"amount_approved, settlement_tat_days FROM (SELECT * FROM scc WHERE claim_status = {_P['claim_status']} AND {CARE['district']} "
              "ORDER BY submitted_at DESC NULLS LAST, claim_id LIMIT 100) x")
_money = {"total_settled": rsum("CASE WHEN claim_status = 'SETTLED' THEN amount_approved ELSE 0 END"),
          "total_pending": rsum("CASE WHEN claim_status IN ('APPROVED', 'QUERY_RAISED', 'PENDING') THEN amount_approved ELSE 0 END"),
          "total_rejected": rsum("CASE WHEN claim_status = 'REJECTED' THEN amount_claimed ELSE 0 END"),
          "grand_total_claimed": rsum("COALESCE(amount_claimed, 0)")}
SQL["D35"] = query("cm_claim", [], _money)
SQL["T47"] = query("cc", [], _money, CARE["district"])
SQL["T69"] = query("scc", [], _money, SITE["block"])


def gap(digits: int) -> dict[str, str]:
    d = "SUM(amount_claimed) - SUM(amount_approved)"
    return {"total_claimed": rsum("amount_claimed"), "total_approved": rsum("amount_approved"), "gap_amount": f"ROUND({d}, 2)",
            "gap_pct": pct(d, "SUM(amount_claimed)", digits)}


_hair = ravg("(amount_claimed - amount_approved) / NULLIF(amount_claimed, 0) * 100.0")
SQL["D54"] = query("cm_claim", [], gap(2), "amount_claimed IS NOT NULL AND amount_approved IS NOT NULL")
SQL["T78"] = query("cc", [CD], gap(1), CARE["district"])
SQL["T214"] = query("scc", ["hospital_type"], {"total_claims": uniq("claim_id"), "avg_haircut_pct": _hair}, CARE["district"])
SQL["T273"] = query("cc", ["hospital_district AS district"],
                    {"avg_haircut_pct": _hair, "total_claimed": rsum("amount_claimed"), "total_approved": rsum("amount_approved"),
                     "total_haircut": rsum("amount_claimed - amount_approved")}, f"hospital_district {BOTH}")
_ok = "claim_status IN ('APPROVED', 'SETTLED')"
SQL["T19"] = query("scc", ["hospital_name"], {"total_claims": "COUNT(claim_id)", "approved": hits("claim_status = 'APPROVED'"),
                                              "settled": hits("claim_status = 'SETTLED'"), "rejected": _rej,
                                              "approval_rate_pct": pct(hits(_ok), "COUNT(claim_id)", 2)}, SITE["hospital"])
SQL["T113"] = query("cc", [CD], {"total_claims": "COUNT(claim_id)", "avg_approval_rate_pct": ravg(_apr)}, f"hospital_district {BOTH}")
SQL["T134"] = query("cc", [CV], {"total_claims": "COUNT(claim_id)", "avg_approval_rate_pct": ravg(_apr)}, CARE["division"])
_rejs = {"total_claims": "COUNT(claim_id)", "rejected_claims": _rej, "rejection_rate_pct": pct(_rej, "COUNT(claim_id)", 2)}
SQL["D34"] = query("cm_claim", [f"{month('submitted_at')} AS month"], _rejs)
SQL["T08"] = query("cc", [CD], _rejs, CARE["district"])
SQL["T62"] = query("scc", ["block_name"], _rejs, SITE["block"])
SQL["T34"] = query("cm_claim", my("submitted_at"), _rejs, in_my("submitted_at"))
SQL["T124"] = query("cc", [CD], _rejs, f"hospital_district {BOTH}")
_qr = "claim_status = 'QUERY_RAISED'"


def queried(name: str) -> dict[str, str]:
    return {"total_claims": uniq("claim_id"), name: uniq("claim_id", _qr), "query_rate_pct": pct(uniq("claim_id", _qr), uniq("claim_id"), 1)}


SQL["D128"] = query("scc", ["hospital_id", "hospital_name", "district_name", "hospital_type"], queried("query_claims"),
                    having=f"{uniq('claim_id')} >= 10", order="-query_rate_pct hospital_id", limit=20)
SQL["T192"] = best(query("scc", ["hospital_id", "hospital_name", "hospital_type"], queried("query_raised_claims"), CARE["district"]),
                   "-query_rate_pct hospital_id", 10, "hospital_id")
SQL["T276"] = query("cc", ["hospital_district AS district"], queried("query_raised"), f"hospital_district {BOTH}")
SQL["D59"] = (
    "WITH asked_of AS (SELECT DISTINCT claim_id FROM cm_adjudication_event WHERE action = " + _P["query_action"]
    + " OR reason_category IS NOT NULL), reasons AS ("
    + query("cm_adjudication_event", ["reason_category"], {"reason_claim_count": uniq("claim_id"), "reason_pct": share(uniq("claim_id"), 2)},
            "reason_category IS NOT NULL", order="-reason_claim_count reason_category", limit=10)
    + "), whole AS (SELECT COUNT(DISTINCT c.claim_id) AS total_claims, COUNT(DISTINCT a.claim_id) AS queried_claims, "
    + pct("COUNT(DISTINCT a.claim_id)", "COUNT(DISTINCT c.claim_id)", 2)
    + " AS query_rate_pct FROM cm_claim c LEFT JOIN asked_of a ON a.claim_id = c.claim_id) SELECT * FROM whole, reasons")
_dn = "COALESCE(k, 0)"
SQL["D58"] = query(
    "(SELECT * FROM cm_claim LEFT JOIN (SELECT claim_id, COUNT(*) AS k FROM cm_claim_document GROUP BY 1) d USING (claim_id)) x",
    [f"CASE WHEN {_dn} = 0 THEN '0 docs' WHEN {_dn} <= 2 THEN '1-2 docs' WHEN {_dn} <= 5 THEN '3-5 docs' WHEN {_dn} <= 10 THEN '6-10 docs' "
     "ELSE '11+ docs' END AS doc_bucket"],
    {"claim_count": "COUNT(*)", "avg_docs": ravg(_dn), "approval_rate_pct": f"ROUND(AVG(CAST({_ok} AS INT)) * 100.0, 2)",
     "avg_amount_approval_pct": ravg(_apr, 2)})
SQL["D60"] = query("(SELECT * FROM cm_adjudication_event JOIN (SELECT claim_id, claim_status FROM cm_claim) c USING (claim_id)) x",
                   ["COALESCE(reason_category, 'UNSPECIFIED') AS reason_category"],
                   {"rejected_claim_count": uniq("claim_id"), "pct": share(uniq("claim_id"), 2)}, "claim_status = 'REJECTED'",
                   order="-rejected_claim_count reason_category", limit=10)
_aes = "(SELECT ae.reason_category, scc.* FROM cm_adjudication_event ae JOIN scc USING (claim_id))"
_mm = "(reason_category ILIKE '%mismatch%' OR reason_category ILIKE '%diagnosis%')"
SQL["D129"] = best(
    f"WITH m AS (SELECT * FROM {_aes} x WHERE {_mm}) SELECT a.*, {pct('affected_claims', 'every_claim', 1)} AS pct_of_hospital_claims FROM ("
    + query("m", ["hospital_id", "hospital_name", "district_name", "hospital_type", "reason_category"], {"affected_claims": uniq("claim_id")})
    + ") a JOIN (SELECT hospital_id, COUNT(DISTINCT claim_id) AS every_claim FROM m GROUP BY 1) b USING (hospital_id)",
    "-affected_claims hospital_id reason_category", 20)
_cae = "(SELECT {s}.*, ae.reason_category FROM {s} LEFT JOIN cm_adjudication_event ae USING (claim_id)) x"


def mism(name: str, cond: str, digits: int) -> dict[str, str]:
    return {"total_claims": uniq("claim_id"), name: uniq("claim_id", cond),
            "mismatch_rate_pct": pct(uniq("claim_id", cond), uniq("claim_id"), digits)}


SQL["T191"] = best(query(_cae.format(s="scc"), ["hospital_id", "hospital_name", "hospital_type"],
                         mism("mismatch_claims", "reason_category ILIKE '%mismatch%'", 1), CARE["district"]),
                   "-mismatch_rate_pct hospital_id", 10, "hospital_id")
SQL["T275"] = query(_cae.format(s="cc"), ["hospital_district AS district"], mism("mismatch_queries", _mm, 2), f"hospital_district {BOTH}")


def tat(source: str, by: list[str], where: str = "", avg: str = "avg_tat", points=None, high=False, count: dict | None = None) -> str:
    cols = dict(count or {})
    if avg:
        cols[avg] = ravg(_t)
    cols |= {n: q_at(_t, p) for n, p in (points or {}).items()}
    if high:
        cols["max_tat"] = f"MAX({_t})"
    return query(source, by, cols, f"{_t} IS NOT NULL" + (f" AND {where}" if where else ""))


_p3 = {"median_tat": 0.5, "p65_tat": 0.65, "p95_tat": 0.95}
_p2 = {"median_tat": 0.5, "p95_tat": 0.95}
_md = {"median_tat_days": 0.5}
SQL["D31"] = tat("cm_claim", [], points=_p3, high=True)
SQL["D32"] = tat("cm_claim", ["is_portability_claim"], avg="", points=_p3, high=True)
SQL["D33"] = tat("cc", [CD], avg="avg_tat_days", points={"median_tat": 0.5}, count={"settled_claims": "COUNT(claim_id)"})
SQL["T07"] = tat("cc", [CD], CARE["district"], points=_p2, high=True)
SQL["T61"] = tat("scc", ["block_name"], SITE["block"], points=_p2, high=True)
SQL["T114"] = tat("cc", [CD], f"hospital_district {BOTH}", "avg_tat_days", _md)
SQL["T132"] = tat("cc", [CV], CARE["division"], "avg_tat_days", {"median_tat_days": 0.5, "p95_tat_days": 0.95})
SQL["T165"] = tat("cc", my("admission_datetime"), in_my("admission_datetime"), "avg_tat_days", _md, count={"total_claims": "COUNT(claim_id)"})
SQL["T215"] = tat("scc", ["hospital_type"], CARE["district"], "avg_tat_days", _md, count={"total_claims": uniq("claim_id")})
SQL["T158"] = tat("lcl", ["specialty_code", "specialty_name"], f"specialty_code = {SPEC}", "avg_tat_days", _md,
                  count={"claim_count": uniq("claim_id")})
SQL["D96"] = query("cc", [], {
    "avg_admission_to_discharge_days": ravg(day_gap("admission_datetime", "discharge_datetime")),
    "avg_discharge_to_submission_days": ravg(day_gap("discharge_datetime", "submitted_at")),
    "avg_submission_to_settlement_days": ravg(day_gap("submitted_at", "settled_at")),
    "avg_total_cycle_days": ravg(day_gap("admission_datetime", "settled_at"))},
    "admission_datetime IS NOT NULL AND discharge_datetime IS NOT NULL AND submitted_at IS NOT NULL AND settled_at IS NOT NULL")
_sl = day_gap("discharge_datetime", "submitted_at")
_slw = "discharge_datetime IS NOT NULL AND submitted_at IS NOT NULL"
SQL["D134"] = query("cc", ["hospital_district AS district"], {"claim_count": uniq("claim_id"), "avg_lag_days": ravg(_sl),
                                                             "median_lag_days": q_at(_sl, 0.5)}, _slw,
                    order="-avg_lag_days district", limit=30)
SQL["T200"] = query("cc", [CD], {"total_claims": uniq("claim_id"), "avg_lag_days": ravg(_sl)}, f"{_slw} AND {CARE['district']}")
SQL["T242"] = query("hcc", [], {"avg_lag_days": ravg(_sl), "median_lag_days": q_at(_sl, 0.5), "total_cases": uniq("case_id")},
                    f"{_slw} AND {HOME['block']}")
SQL["T201"] = query("cp", [CD], {"paid_claims": uniq("claim_id"), "avg_approval_to_payment_days": ravg(day_gap("settled_at", "payment_date"))},
                    f"{_ok} AND settled_at IS NOT NULL AND payment_date IS NOT NULL AND {CARE['district']}")
_agd = f"DATE_DIFF('day', CAST(submitted_at AS DATE), {ASOF})"
SQL["D56"] = query("cm_claim", [f"CASE WHEN {_agd} <= 7 THEN '0-7 days' WHEN {_agd} <= 14 THEN '7-14 days' WHEN {_agd} <= 30 THEN '14-30 days' "
                                "ELSE '30+ days' END AS age_bucket"],
                   {"claim_count": "COUNT(*)", "total_amount_claimed": rsum("amount_claimed"), "pct_of_pending": share("COUNT(*)", 2)},
                   "claim_status = 'PENDING' AND submitted_at IS NOT NULL")
SQL["T80"] = query("cc", [f"CASE WHEN {_agd} <= 30 THEN '0-30 days' WHEN {_agd} <= 60 THEN '31-60 days' WHEN {_agd} <= 90 THEN '61-90 days' "
                          f"WHEN {_agd} <= 180 THEN '91-180 days' ELSE '180+ days' END AS aging_bucket"],
                   {"claim_count": "COUNT(claim_id)", "total_claimed": rsum("amount_claimed")},
                   f"claim_status = 'PENDING' AND {CARE['district']}")
_fail = "payment_status = 'FAILED'"
SQL["D57"] = best(query("sp", ["hospital_id", "hospital_name", "district_name", "hospital_type"],
                        {"failed_payment_count": uniq("payment_id"), "total_failed_amount": rsum("amount_paid")}, _fail),
                  "-total_failed_amount hospital_id", 20, "hospital_id")
SQL["D127"] = query("sp", ["hospital_id", "hospital_name", "district_name", "hospital_type"],
                    {"failed_payment_count": uniq("claim_id"), "failed_amount": rsum("amount_paid")}, _fail,
                    order="-failed_payment_count hospital_id", limit=20)
SQL["T96"] = ("SELECT hospital_name, hospital_type, COUNT(claim_id) AS failed_payment_count, ROUND(SUM(amount_paid), 2) AS total_failed_amount "
              f"FROM sp WHERE {_fail} AND {CARE['district']} GROUP BY hospital_id, 1, 2")
SQL["T193"] = best(query("sp", ["hospital_id", "hospital_name", "hospital_type"],
                         {"failed_payment_count": uniq("claim_id"), "total_failed_amount": rsum("amount_paid")}, f"{_fail} AND {CARE['district']}"),
                   "-total_failed_amount hospital_id", 10, "hospital_id")
SQL["T151"] = query("sp", ["hospital_name"], {"failed_payment_count": "COUNT(claim_id)", "total_failed_amount": rsum("amount_paid")},
                    f"{_fail} AND {SITE['hospital']}")
SQL["T274"] = query("cp", ["hospital_district AS district"], {"failed_payments": uniq("payment_id"), "failed_amount": rsum("amount_paid")},
                    f"{_fail} AND hospital_district {BOTH}")
SQL["D63"] = best(query("sp", ["hospital_id", "hospital_name", "district_name", "hospital_type"],
                        {"payment_count": uniq("payment_id"), "total_payment_received": rsum("amount_paid")}, "payment_status = 'SUCCESS'"),
                  "-total_payment_received hospital_id", 20, "hospital_id")
SQL["D98"] = (
    "WITH p AS (SELECT hospital_id, SUM(amount_paid) AS paid FROM sp WHERE payment_status = 'SUCCESS' GROUP BY 1), r AS (SELECT *, RANK() OVER "
    "(ORDER BY paid DESC) AS rk, COUNT(*) OVER () AS sites, SUM(paid) OVER () AS grand FROM p) SELECT CASE WHEN rk <= CEIL(sites * 0.10) THEN "
    "'Top 10%' WHEN rk <= CEIL(sites * 0.20) THEN 'Next 10% (11-20%)' WHEN rk <= CEIL(sites * 0.50) THEN 'Middle 30% (21-50%)' ELSE 'Bottom 50%' "
    "END AS hospital_tier, COUNT(*) AS hospital_count, ROUND(SUM(paid), 2) AS tier_total_paid, ROUND(SUM(paid) * 100.0 / NULLIF(MAX(grand), 0), 2) "
    "AS share_of_total_pct FROM r GROUP BY 1")
_rk = ("(SELECT hospital_district AS district, hospital_id, SUM(amount_approved) AS spend, ROW_NUMBER() OVER (PARTITION BY hospital_district "
       "ORDER BY SUM(amount_approved) DESC NULLS LAST, hospital_id NULLS LAST) AS rn FROM cc{w} GROUP BY 1, 2)")
SQL["D138"] = ("SELECT district, ROUND(SUM(CASE WHEN rn <= 5 THEN spend ELSE 0 END), 2) AS top5_spend, ROUND(SUM(spend), 2) AS district_total_spend, "
               f"{pct('SUM(CASE WHEN rn <= 5 THEN spend ELSE 0 END)', 'SUM(spend)', 1)} AS top5_concentration_pct FROM {_rk.format(w='')} x GROUP BY 1")
SQL["D143"] = ("SELECT district, ROUND(SUM(spend), 2) AS district_total_spend, ROUND(MAX(spend), 2) AS top_hospital_spend, "
               f"{pct('MAX(spend)', 'SUM(spend)', 1)} AS top_hospital_concentration_pct FROM {_rk.format(w='')} x WHERE district IS NOT NULL GROUP BY 1 "
               "ORDER BY top_hospital_concentration_pct DESC NULLS LAST, district LIMIT 20")
_sp = ("(SELECT hospital_id, hospital_name, ROUND(SUM(amount_approved), 2) AS spend, ROW_NUMBER() OVER (ORDER BY SUM(amount_approved) DESC NULLS LAST, "
       f"hospital_id) AS rnk FROM sccl WHERE {CARE['district']} GROUP BY 1, 2)")
SQL["T178"] = (f"WITH s AS (SELECT * FROM {_sp} x), w AS (SELECT SUM(spend) AS total_spend FROM s) SELECT hospital_name, spend AS hospital_spend, "
               f"{pct('spend', 'total_spend', 1)} AS share_pct, total_spend FROM s, w WHERE rnk <= 5")
SQL["T205"] = (f"WITH s AS (SELECT * FROM {_sp} x), w AS (SELECT SUM(spend) AS total_spend FROM s) SELECT rnk, hospital_name, spend, "
               f"{pct('spend', 'total_spend', 1)} AS share_pct, ROUND(100.0 * SUM(spend) OVER (ORDER BY rnk) / NULLIF(total_spend, 0), 1) AS "
               "cumulative_share_pct FROM s, w WHERE rnk <= 10")
_hn3 = ["hospital_id", "hospital_name", "hospital_type", "district_name"]
SQL["T243"] = best(f"SELECT *, {pct('case_count', f'(SELECT COUNT(DISTINCT case_id) FROM hc WHERE {HOME_BLOCK})', 1)} AS share_pct FROM "
                   f"({query(_hsc, _hn3, {'case_count': uniq('case_id')}, HOME['block'])}) y", "-case_count hospital_id", 15, "hospital_id")
_hscl = ("(SELECT hccl.*, s.hospital_name, s.hospital_type, s.district_name FROM hccl JOIN site s USING (hospital_id)) x")
SQL["T253"] = best(query(_hscl, _hn3, {"case_count": uniq("case_id"), "total_approved": rsum("amount_approved"),
                                       "spend_share_pct": "ROUND(SUM(amount_approved) * 100.0 / NULLIF(SUM(SUM(amount_approved)) OVER (), 0), 1)"},
                         HOME["block"]), "-total_approved hospital_id", 15, "hospital_id")
SQL["T254"] = best(query(_hsc, _hn3, {"case_count": uniq("case_id"), "admission_share_pct": share(uniq("case_id"), 1)}, HOME["block"]),
                   "-case_count hospital_id", 15, "hospital_id")
_hv = ("(SELECT hospital_district AS district, hospital_id, COUNT(DISTINCT case_id) AS k, ROW_NUMBER() OVER (PARTITION BY hospital_district ORDER BY "
       "COUNT(DISTINCT case_id) DESC, hospital_id NULLS LAST) AS rn FROM cm_case{w} GROUP BY 1, 2)")
SQL["T264"] = (f"SELECT district, CAST(SUM(k) AS BIGINT) AS total_cases, CAST(SUM(CASE WHEN rn <= 5 THEN k END) AS BIGINT) AS top5_cases, "
               f"{pct('SUM(CASE WHEN rn <= 5 THEN k END)', 'SUM(k)', 1)} AS top5_share_pct FROM {_hv.format(w=f' WHERE hospital_district {BOTH}')} x GROUP BY 1")


def _upto(k: int) -> str:
    return f"SUM(CASE WHEN rn <= {k} THEN spend END)"


SQL["T280"] = (f"SELECT district, SUM(spend) AS total_spend, {_upto(1)} AS top1_spend, {_upto(3)} AS top3_spend, {_upto(5)} AS top5_spend, "
               f"{pct(_upto(5), 'SUM(spend)', 1)} AS top5_share_pct FROM {_rk.format(w=f' WHERE hospital_district {BOTH}')} x GROUP BY 1")
SQL["D112"] = (f"SELECT district, CAST(SUM(CASE WHEN rn <= 3 THEN k ELSE 0 END) AS BIGINT) AS top3_cases, CAST(SUM(k) AS BIGINT) AS district_total, "
               f"{pct('SUM(CASE WHEN rn <= 3 THEN k ELSE 0 END)', 'SUM(k)', 1)} AS top3_concentration_pct FROM {_hv.format(w='')} x GROUP BY 1 "
               "ORDER BY top3_concentration_pct DESC NULLS LAST, district NULLS LAST LIMIT 20")
SQL["D113"] = ("SELECT hospital_id, hospital_name, district, hospital_type, case_count, district_total, "
               f"{pct('case_count', 'district_total', 1)} AS intra_district_share_pct FROM (SELECT hospital_id, district, k AS case_count, "
               f"CAST(SUM(k) OVER (PARTITION BY district) AS BIGINT) AS district_total FROM {_hv.format(w='')} v) x JOIN site USING (hospital_id) "
               "WHERE district IS NOT NULL ORDER BY intra_district_share_pct DESC NULLS LAST, hospital_id, district LIMIT 20")
SQL["T177"] = query("sc", ["hospital_id", "hospital_name", "hospital_type"],
                    {"case_count": uniq("case_id"), "district_share_pct": share(uniq("case_id"), 1)}, CARE["district"],
                    order="-case_count hospital_id", limit=10)
_pr = ["hbp_procedure_code", "procedure_name", "specialty_name"]
SQL["D55"] = query("lcl", _pr, {"claim_count": uniq("claim_id"), "avg_approved": ravg("amount_approved", 2),
                                "min_approved": "ROUND(MIN(amount_approved), 2)", "max_approved": "ROUND(MAX(amount_approved), 2)",
                                "stddev_approved": "ROUND(STDDEV(amount_approved), 2)"},
                   "procedure_rank = 1 AND amount_approved IS NOT NULL", order="-avg_approved hbp_procedure_code", limit=20)
SQL["T79"] = query("lcl", _pr, {"claim_count": uniq("claim_id"), "avg_approved_amount": ravg("amount_approved", 2)}, CARE["district"],
                   order="-avg_approved_amount hbp_procedure_code", limit=20)
SQL["T106"] = query("hcc", [HB], {"total_claims": uniq("claim_id"), "avg_claimed": ravg("amount_claimed", 2),
                                  "avg_approved": ravg("amount_approved", 2), "total_approved": rsum("amount_approved")}, HOME["block"])
_avg2 = {"avg_approved_amount": ravg("amount_approved", 2), "avg_claimed_amount": ravg("amount_claimed", 2)}
SQL["T122"] = query("cc", [CD], {"total_claims": "COUNT(claim_id)"} | _avg2, f"hospital_district {BOTH}")
SQL["T147"] = ("SELECT hospital_name, a AS hospital_avg_claim, s AS state_avg_claim, ROUND(a - s, 2) AS diff_from_state_avg FROM (SELECT hospital_name, "
               f"ROUND(AVG(amount_approved), 2) AS a FROM scc WHERE {SITE['hospital']} GROUP BY 1) x, (SELECT ROUND(AVG(amount_approved), 2) AS s FROM cm_claim) y")
_sk = ["specialty_code", "specialty_name"]
_sw = f"specialty_code = {SPEC}"
SQL["T154"] = query("lcl", _sk, {"claim_count": uniq("claim_id")} | _avg2, _sw)
SQL["T155"] = query("lcl", _sk, {"total_claims": uniq("claim_id"), "avg_approval_rate_pct": ravg(_apr)}, _sw)
SQL["D118"] = query("lcl", _sk, {"total_claims": uniq("claim_id"), "approval_rate_pct": pct(uniq("claim_id", _ok), uniq("claim_id"), 1),
                                 "rejection_rate_pct": pct(uniq("claim_id", "claim_status = 'REJECTED'"), uniq("claim_id"), 1),
                                 "avg_tat_days": ravg(_t)})
SQL["D76"] = best(
    "WITH h AS (" + query("lcl", ["hospital_id", "hbp_procedure_code", "procedure_name"],
                          {"hosp_avg_approved": ravg("amount_approved", 2), "case_count": uniq("case_id")},
                          "procedure_rank = 1 AND amount_approved IS NOT NULL")
    + "), s AS (SELECT hbp_procedure_code, ROUND(AVG(hosp_avg_approved), 2) AS state_avg_approved FROM h GROUP BY 1) SELECT hospital_id, hospital_name, "
    "district_name, hospital_type, hbp_procedure_code, procedure_name, case_count, hosp_avg_approved, state_avg_approved, "
    "ROUND(hosp_avg_approved / NULLIF(state_avg_approved, 0), 3) AS ratio_to_state_avg FROM h JOIN s USING (hbp_procedure_code) JOIN site USING (hospital_id) "
    "WHERE case_count >= 5 AND hosp_avg_approved / NULLIF(state_avg_approved, 0) > 1.5", "-ratio_to_state_avg hospital_id hbp_procedure_code", 20, "hospital_id")
_spb = {"unique_beneficiaries": uniq("beneficiary_id"), "total_approved": rsum("amount_approved"),
        "spend_per_beneficiary": per("SUM(amount_approved)", uniq("beneficiary_id"), 1, 2)}
SQL["T81"] = query("ccl", [CD], _spb, CARE["district"])
SQL["T139"] = query("ccl", [CV], _spb, CARE["division"])
SQL["T115"] = query("ccl", [CD], _spb, f"hospital_district {BOTH}")
SQL["D62"] = query("hcc", [HD, HV], {"treated_beneficiaries": uniq("beneficiary_id"), "total_approved": rsum("amount_approved"),
                                     "spend_per_beneficiary": per("SUM(amount_approved)", uniq("beneficiary_id"), 1, 2)},
                   "amount_approved IS NOT NULL")
SQL["D64"] = mix("cm_preauth_request", "status", "count", 2)
_fa = "status = 'AUTO_APPROVED' AND auto_approval_type IS NOT NULL"
SQL["D66"] = ("SELECT f.*, total_force_approved, total_preauths, " + pct("total_force_approved", "total_preauths", 2) + " AS force_approved_pct FROM ("
              + query("cm_preauth_request", [f"{month('initiated_at')} AS month"], {"force_approved_count": "COUNT(*)"}, _fa)
              + f") f, (SELECT {hits(_fa)} AS total_force_approved, COUNT(*) AS total_preauths FROM cm_preauth_request) g")
SQL["T76"] = mix("pc", "status", "request_count", 2, CARE["district"])
SQL["T105"] = mix("(SELECT pc.status, member.* FROM pc JOIN member USING (beneficiary_id)) x", "status", "request_count", 2, HOME["block"])
_pr_rej = {"total_preauths": "COUNT(preauth_id)", "rejected_count": hits("status = 'REJECTED'"),
           "rejection_rate_pct": pct(hits("status = 'REJECTED'"), "COUNT(preauth_id)", 2)}
SQL["T121"] = query("pc", [CD], _pr_rej, f"hospital_district {BOTH}")
SQL["T149"] = query("(SELECT * FROM cm_preauth_request JOIN sc USING (case_id)) x", ["hospital_name"], _pr_rej, SITE["hospital"])
SQL["T164"] = query("cm_preauth_request", my("initiated_at"), _pr_rej, in_my("initiated_at"))
_dd = day_gap("initiated_at", "ppd_decision_at")
SQL["D65"] = query("cm_preauth_request", [], {"avg_tat_days": ravg(_dd), "median_tat_days": q_at(_dd, 0.5), "p90_tat_days": q_at(_dd, 0.9),
                                              "min_tat_days": f"MIN({_dd})", "max_tat_days": f"MAX({_dd})"},
                   "ppd_decision_at IS NOT NULL AND initiated_at IS NOT NULL")
SQL["T77"] = query("pc", [CD], {"total_preauths": "COUNT(preauth_id)", "avg_tat_days": ravg(_dd), "median_tat_days": q_at(_dd, 0.5)},
                   f"ppd_decision_at IS NOT NULL AND {CARE['district']}")
SQL["D97"] = query("cm_preauth_procedure_line", ["CAST(payout_factor AS DOUBLE) AS payout_factor"],
                   {"occurrence_count": "COUNT(*)", "pct": share("COUNT(*)", 2),
                                                                          "total_amount": rsum("computed_final_amount"),
                                                                          "avg_base_amount": ravg("base_amount", 2),
                                                                          "avg_final_amount": ravg("computed_final_amount", 2)},
                   "payout_factor IS NOT NULL")
SQL["D29"] = query("cm_claim", ["is_portability_claim"], {"claim_count": "COUNT(*)", "total_claimed": rsum("amount_claimed"),
                                                          "avg_claimed": ravg("amount_claimed", 2), "total_approved": rsum("amount_approved")})

# ---- care
_amt = {"total_amount": rsum("computed_final_amount")}
_kc = {"case_count": uniq("case_id")}
SQL["D21"] = query("priced", _sk, {"preauth_count": uniq("preauth_id")} | _amt)
SQL["T21"] = query("cln", _sk, {"preauth_count": uniq("preauth_id")} | _kc | _amt, _sw)
SQL["T25"] = query("cln", [*_sk, CD], _kc | _amt, f"{_sw} AND {CARE['district']}")
SQL["T159"] = query("hln", [*_sk, HB], _kc | _amt, f"{_sw} AND {HOME['block']}")
SQL["T22"] = query("cln", [CD], _kc | _amt, _sw)
SQL["T24"] = ("SELECT hospital_name, district_name, hospital_type, COUNT(DISTINCT case_id) AS case_count, ROUND(SUM(computed_final_amount), 2) AS "
              f"total_amount FROM sln WHERE {_sw} GROUP BY hospital_id, 1, 2, 3")
_use = {"usage_count": "COUNT(*)"} | _amt
_pk = ["hbp_procedure_code", "procedure_name"]
SQL["D22"] = query("priced", [*_pk, "specialty_code"], _use)
SQL["T44"] = query("cln", [*_pk, "specialty_code"], _use, CARE["district"])
SQL["T65"] = query("sln", [*_pk, "specialty_code"], _use, SITE["block"])
SQL["T137"] = query("cln", [*_pk, "specialty_name"], _use, CARE["division"], order="-usage_count hbp_procedure_code", limit=10)
SQL["T166"] = query("cln", [*_pk, "specialty_name"], _use, _yr, order="-usage_count hbp_procedure_code", limit=10)


def beside(source: str, keys: list[str]) -> str:
    ks = ", ".join(keys)
    return (f"SELECT {ks}, MAX(CASE WHEN hospital_district = {D1} THEN k END) AS district_1_count, MAX(CASE WHEN hospital_district = {D2} THEN k END) "
            f"AS district_2_count FROM (SELECT hospital_district, {ks}, COUNT(*) AS k, ROW_NUMBER() OVER (PARTITION BY hospital_district ORDER BY COUNT(*) "
            f"DESC, {keys[0]}) AS r FROM {source} WHERE hospital_district {BOTH} GROUP BY hospital_district, {ks}) x WHERE r <= 10 GROUP BY {ks}")


SQL["T125"] = beside("cln", _pk)
SQL["T126"] = beside("cdx", ["icd_code", "diagnosis_text"])
_dgap = "SUM(amount_claimed) - SUM(amount_approved)"
SQL["D116"] = query("lcl", ["procedure_name", "specialty_code"],
                    {"preauth_count": uniq("preauth_id"), "total_claimed": rsum("amount_claimed"), "total_approved": rsum("amount_approved"),
                     "haircut_amount": f"ROUND({_dgap}, 2)", "haircut_pct": pct(_dgap, "SUM(amount_claimed)", 1)},
                    order="-total_approved procedure_name", limit=20)
SQL["T196"] = query("lcl", _pr, _kc | {"total_claimed": rsum("amount_claimed"), "total_approved": rsum("amount_approved"),
                                       "total_gap": f"ROUND({_dgap}, 2)"}, CARE["district"], order="-total_gap hbp_procedure_code", limit=10)
_qn, _rn = uniq("claim_id", _qr), uniq("claim_id", "claim_status = 'REJECTED'")
SQL["D117"] = query("lcl", ["procedure_name", "specialty_code"],
                    {"total_claims": uniq("claim_id"), "query_count": _qn, "rejected_count": _rn,
                     "query_rate_pct": pct(_qn, uniq("claim_id"), 1), "rejection_rate_pct": pct(_rn, uniq("claim_id"), 1)},
                    having=f"{uniq('claim_id')} >= 10", order="-query_rate_pct procedure_name", limit=15)
SQL["T197"] = best("SELECT *, ROUND(query_rate_pct + rejection_rate_pct, 1) AS s FROM (" + query(
    "lcl", _pk, {"total_claims": uniq("claim_id"), "query_rate_pct": pct(_qn, uniq("claim_id"), 1),
                 "rejection_rate_pct": pct(_rn, uniq("claim_id"), 1)}, CARE["district"]) + ") y", "-s hbp_procedure_code", 15, "s")
SQL["D68"] = ("SELECT COUNT(*) AS total_cases, ROUND(AVG(k), 2) AS avg_procedures_per_case, ROUND(SUM(e), 2) AS total_addon_cost, ROUND(SUM(b), 2) AS "
              f"total_base_cost, ROUND(SUM(w), 2) AS total_cost, {pct('SUM(e)', 'SUM(w)', 2)} AS addon_cost_pct FROM (SELECT case_id, COUNT(*) AS k, "
              "SUM(CASE WHEN is_addon THEN computed_final_amount ELSE 0 END) AS e, SUM(CASE WHEN NOT is_addon THEN computed_final_amount ELSE 0 END) AS b, "
              "SUM(computed_final_amount) AS w FROM asked GROUP BY 1) x")
_add = hits("is_addon")
_asite = "(SELECT asked.*, hospital_id, hospital_name, district_name, hospital_type FROM asked JOIN sc USING (case_id)) x"
SQL["D69"] = best(query(_asite, ["hospital_id", "hospital_name", "district_name", "hospital_type"],
                        {"total_procedures": "COUNT(*)", "addon_procedures": _add, "addon_rate_pct": pct(_add, "COUNT(*)", 2)},
                        having="COUNT(*) >= 10"), "-addon_rate_pct hospital_id", 20, "hospital_id")
SQL["T142"] = query(_asite, ["hospital_name"], {"total_procedures": "COUNT(*)", "addon_procedures": _add, "addon_pct": pct(_add, "COUNT(*)", 1)},
                    SITE["hospital"])
_dk = ["icd_code", "diagnosis_text"]
SQL["D23"] = query("dx", _dk, {"count": "COUNT(*)"})
SQL["T14"] = query("sdx", _dk, {"count": "COUNT(*)"}, f"{SITE['block']} AND {SITE['district']}")
SQL["T20"], SQL["T66"] = (query("sdx", _dk, {"count": "COUNT(*)"}, SITE[v]) for v in ("hospital", "block"))
SQL["T45"] = query("cdx", _dk, {"count": "COUNT(*)"}, CARE["district"])
SQL["T138"] = query("cdx", _dk, {"case_count": "COUNT(*)"}, CARE["division"], order="-case_count icd_code", limit=10)
SQL["D24"] = mix("dx", "diagnosis_category", "case_count", 2)
SQL["T04"] = mix("cdx", "diagnosis_category AS disease_category", "case_count", 2, CARE["district"])
SQL["T67"] = mix("sdx", "diagnosis_category AS disease_category", "case_count", 2, SITE["block"])
SQL["D90"] = query("hdx", [HV, "diagnosis_category"], {"case_count": uniq("case_id"),
                                                       "pct_within_division": share(uniq("case_id"), 2, "home_division_name")})
SQL["T93"] = mix("cdx", "diagnosis_category", "case_count", 1, CARE["district"])
SQL["T109"] = mix("hdx", "diagnosis_category", "case_count", 1, HOME["block"])
_cw = f"diagnosis_category = {CAT}"
SQL["T23"] = query("cdx", [_am], {"case_count": "COUNT(*)"}, _cw)
SQL["T160"], SQL["T161"] = (query("cdx", [_am], {"case_count": "COUNT(*)"}, f"{_cw} AND {CARE[v]}") for v in ("district", "division"))
SQL["D93"] = query("cdx", ["month(admission_datetime) AS month_number"], {"communicable_cases": uniq("case_id")},
                   "diagnosis_category = 'COMMUNICABLE' AND admission_datetime IS NOT NULL")
SQL["T35"] = query("cdx", ["month(admission_datetime) AS month"], {"case_count": "COUNT(*)", "avg_annual_cases": "ROUND(COUNT(*) * 1.0 / 3, 1)"}, _cw)
SQL["D92"] = query("cdx", [CD], {"communicable_case_count": uniq("case_id")}, "diagnosis_category = 'COMMUNICABLE'",
                   order="-communicable_case_count district_name", limit=20)
SQL["D94"] = query("cdx", [CD], {"injury_case_count": uniq("case_id"), "pct_of_total_injury": share(uniq("case_id"), 2)},
                   "diagnosis_category = 'INJURY'")
_combo = "(SELECT d.diagnosis_category, l.* FROM dx d JOIN {l} l USING (case_id)) x"
_ck = {"case_count": uniq("case_id"), "total_approved": rsum("amount_approved")}
SQL["D119"] = query(_combo.format(l="lcl"), ["diagnosis_category", "procedure_name"], _ck,
                    order="-total_approved diagnosis_category procedure_name", limit=20)
SQL["T219"] = query(_combo.format(l="lcl"), ["diagnosis_category", "procedure_name"], _ck, CARE["district"],
                    order="-total_approved diagnosis_category procedure_name", limit=10)
SQL["T248"] = query("(SELECT d.diagnosis_category, l.*, k.amount_approved FROM dx d JOIN hln l USING (case_id) LEFT JOIN cm_claim k USING (case_id)) x",
                    ["diagnosis_category", "procedure_name"], _ck, HOME["block"],
                    order="-total_approved diagnosis_category procedure_name", limit=15)
_los = day_gap("admission_datetime", "discharge_datetime")
SQL["D52"] = best(
    f"WITH l AS (SELECT hospital_id, hbp_procedure_code, procedure_name, {_los} AS d FROM cln WHERE procedure_rank = 1 AND admission_datetime IS NOT NULL "
    "AND discharge_datetime IS NOT NULL) SELECT hospital_id, hospital_name, district_name, hbp_procedure_code, procedure_name, case_count, hosp_avg_los, "
    "state_avg_los, ROUND(hosp_avg_los - state_avg_los, 2) AS deviation_days, ABS(ROUND(hosp_avg_los - state_avg_los, 2)) AS s FROM (SELECT hospital_id, "
    "hbp_procedure_code, procedure_name, COUNT(*) AS case_count, ROUND(AVG(d), 2) AS hosp_avg_los FROM l GROUP BY 1, 2, 3 HAVING COUNT(*) >= 5) h JOIN "
    "(SELECT hbp_procedure_code, ROUND(AVG(d), 2) AS state_avg_los FROM l GROUP BY 1) w USING (hbp_procedure_code) JOIN site USING (hospital_id)",
    "-s hospital_id hbp_procedure_code", 20, "s, hospital_id")
_ended = "discharge_datetime IS NOT NULL"
SQL["T87"] = query("cln", _pr, _kc | {"avg_los_days": ravg(_los)}, f"{_ended} AND {CARE['district']}",
                   order="-avg_los_days hbp_procedure_code", limit=20)
SQL["T143"] = ("SELECT hospital_name, a AS hospital_avg_los_days, s AS state_avg_los_days, ROUND(a - s, 1) AS diff_from_state_avg FROM (SELECT "
               f"hospital_name, ROUND(AVG({_los}), 1) AS a FROM sc WHERE {SITE['hospital']} AND {_ended} GROUP BY 1) x, (SELECT ROUND(AVG({_los}), 1) AS s "
               f"FROM cm_case WHERE {_ended}) y")
SQL["T156"] = query("cln", _sk, _kc | {"avg_los_days": ravg(_los)}, f"{_ended} AND {_sw}")
SQL["T218"] = query("cdx", ["diagnosis_category"], {"total_cases": uniq("case_id"), "avg_los_days": ravg(_los)}, f"{_ended} AND {CARE['district']}")
SQL["T282"] = query("cdx", ["hospital_district AS district", "diagnosis_category"], _kc | {"avg_los_days": ravg(_los)},
                    f"{_ended} AND hospital_district {BOTH}")
SQL["T86"] = mix("cm_case", "admission_type", "case_count", 1, CARE["district"])
SQL["T104"] = mix("hc", "admission_type", "case_count", 1, HOME["block"])
SQL["T146"] = mix("sc", "admission_type", "case_count", 1, SITE["hospital"])
_em = hits("admission_type = 'EMERGENCY'")
SQL["T123"] = query("cm_case", [CD], {"total_cases": "COUNT(*)", "emergency_cases": _em, "emergency_pct": pct(_em, "COUNT(*)", 1)},
                    f"hospital_district {BOTH}")
_dt = "discharge_type IS NOT NULL"
SQL["D26"] = mix("cm_case", "discharge_type", "count", 2, _dt)
SQL["T46"] = mix("cm_case", "discharge_type", "count", 2, f"{_dt} AND {CARE['district']}")
SQL["T68"] = mix("sc", "discharge_type", "count", 2, f"{_dt} AND {SITE['block']}")


def exits(source: str, by: list[str], cond: str, names, digits: int, where: str = "", distinct: str = "", **kw) -> str:
    a, b = (uniq(distinct), uniq(distinct, cond)) if distinct else ("COUNT(*)", hits(cond))
    return query(source, by, {names[0]: a, names[1]: b, names[2]: pct(b, a, digits)}, where, **kw)


for _cond, _word, _rate, (_d, _h, _b, _s), _lim in (
    ("death_date IS NOT NULL", "death", "mortality_rate_pct", ("D86", "T89", "T107", "T145"), 10),
    ("lama_date IS NOT NULL", "lama", "lama_rate_pct", ("D87", "T88", "T108", "T144"), 20),
):
    _nm = ("total_discharges", f"{_word}_count", _rate)
    SQL[_d] = best(exits("se", ["hospital_id", "hospital_name", "district_name", "hospital_type"], _cond,
                         ("total_cases", f"{_word}_cases", _rate), 2, distinct="case_id", having="COUNT(DISTINCT case_id) >= 10"),
                   f"-{_rate} hospital_id", _lim, "hospital_id")
    SQL[_h] = best(exits("se", ["hospital_id", "hospital_name", "hospital_type"], _cond, _nm, 2, CARE["district"]),
                   f"-{_rate} hospital_id", 10, "hospital_id")
    SQL[_b] = exits("he", [HB], _cond, _nm, 2, HOME["block"])
    SQL[_s] = exits("se", ["hospital_name"], _cond, _nm, 2, SITE["hospital"])
_dxe = "(SELECT cdx.*, e.death_date, e.lama_date FROM cdx {j} JOIN cm_discharge e USING (case_id)) x"
SQL["D131"] = exits(_dxe.format(j=""), ["diagnosis_category"], "death_date IS NOT NULL", ("total_cases", "deaths", "mortality_rate_pct"), 2,
                    distinct="case_id")
SQL["T216"] = exits(_dxe.format(j="LEFT"), ["diagnosis_category"], "death_date IS NOT NULL", ("total_cases", "death_count", "mortality_rate_pct"),
                    2, CARE["district"], "case_id")
SQL["T217"] = exits(_dxe.format(j="LEFT"), ["diagnosis_category"], "lama_date IS NOT NULL", ("total_cases", "lama_count", "lama_rate_pct"),
                    2, CARE["district"], "case_id")
SQL["T281"] = exits(_dxe.format(j=""), ["hospital_district AS district", "diagnosis_category"], "death_date IS NOT NULL",
                    ("total_cases", "deaths", "mortality_rate_pct"), 2, f"hospital_district {BOTH}", "case_id")
SQL["T157"] = exits("(SELECT cln.*, e.death_date FROM cln LEFT JOIN cm_discharge e USING (case_id)) x", _sk, "death_date IS NOT NULL",
                    ("total_cases", "death_count", "mortality_rate_pct"), 2, _sw, "case_id")
SQL["T119"] = query("ce", [CD], {"total_discharges": "COUNT(*)", "mortality_rate_pct": pct(hits("death_date IS NOT NULL"), "COUNT(*)", 2),
                                 "lama_rate_pct": pct(hits("lama_date IS NOT NULL"), "COUNT(*)", 2)}, f"hospital_district {BOTH}")
for _k, _c, _hn, _rn2 in (("D88", "biometric_auth_used", "biometric_discharges", "biometric_pct"),
                          ("D89", "provided_medicines_flag", "medicines_provided_count", "medicines_provided_pct")):
    _nm = ("total_discharges", _hn, _rn2)
    SQL[_k] = (exits("cm_discharge", ["'STATE_WIDE' AS hospital_type"], _c, _nm, 2) + " UNION ALL "
               + exits("se", ["hospital_type"], _c, _nm, 2))
_bio, _med = uniq("case_id", "biometric_auth_used"), uniq("case_id", "provided_medicines_flag")
SQL["D133"] = query("ce", ["hospital_district AS district"], {
    "total_discharges": uniq("case_id"), "biometric_auth_count": _bio, "medicines_provided_count": _med,
    "biometric_rate_pct": pct(_bio, uniq("case_id"), 1), "medicine_provision_rate_pct": pct(_med, uniq("case_id"), 1)})
for _k, _c, _hn, _rn2 in (("T97", "biometric_auth_used", "biometric_count", "biometric_rate_pct"),
                          ("T198", "biometric_auth_used", "biometric_count", "biometric_rate_pct"),
                          ("T98", "provided_medicines_flag", "medicines_provided_count", "medicine_provision_rate_pct"),
                          ("T199", "provided_medicines_flag", "medicines_count", "medicine_rate_pct")):
    SQL[_k] = ("SELECT * EXCLUDE (hospital_id) FROM (" + exits("se", ["hospital_id", "hospital_name", "hospital_type"], _c,
                                                              ("total_discharges", _hn, _rn2), 1, CARE["district"]) + ") x")
for _k, _k2, _c, _hn, _rn2 in (("T240", "T278", "biometric_auth_used", "biometric_auths", "biometric_rate_pct"),
                               ("T241", "T279", "provided_medicines_flag", "medicine_provided", "medicine_provision_rate_pct")):
    SQL[_k] = exits("he", [], _c, ("total_discharges", _hn, _rn2), 1, HOME["block"], "discharge_id")
    SQL[_k2] = exits("ce", ["hospital_district AS district"], _c, ("total_discharges", _hn, _rn2), 1, f"hospital_district {BOTH}", "discharge_id")
_m, _f = f"gender = {_P['male']}", f"gender = {_P['female']}"
SQL["D78"] = query("hc", [HD, HV], {"male_cases": uniq("case_id", _m), "female_cases": uniq("case_id", _f), "total_cases": uniq("case_id"),
                                    "male_pct": pct(uniq("case_id", _m), uniq("case_id"), 2),
                                    "female_pct": pct(uniq("case_id", _f), uniq("case_id"), 2)})
SQL["T90"] = query("(SELECT c.*, b.gender FROM cm_case c JOIN bm_beneficiary b USING (beneficiary_id)) x", ["gender"],
                   {"case_count": uniq("case_id"), "pct": share(uniq("case_id"), 1)}, CARE["district"])
SQL["T103"] = query("hc", ["gender"], {"case_count": uniq("case_id"), "pct": share(uniq("case_id"), 1)}, HOME["block"])
SQL["D85"] = ("WITH k AS (SELECT hbp_procedure_code, procedure_name, specialty_name, gender, COUNT(DISTINCT case_id) AS k FROM cln JOIN (SELECT "
              "beneficiary_id, gender FROM bm_beneficiary) b USING (beneficiary_id) WHERE procedure_rank = 1 GROUP BY 1, 2, 3, 4) SELECT hbp_procedure_code, "
              f"procedure_name, specialty_name, CAST(SUM(CASE WHEN {_m} THEN k ELSE 0 END) AS BIGINT) AS male_cases, CAST(SUM(CASE WHEN {_f} THEN k ELSE 0 "
              "END) AS BIGINT) AS female_cases, CAST(SUM(k) AS BIGINT) AS total_cases FROM k GROUP BY 1, 2, 3 ORDER BY total_cases DESC, hbp_procedure_code LIMIT 10")
_old = f"year({ASOF}) - yob >= 65"
_ee, _tt = "100.0 * ee / NULLIF(te, 0)", "100.0 * et / NULLIF(tt, 0)"
SQL["D79"] = (f"SELECT te AS total_enrolled, ee AS elderly_enrolled, ROUND({_ee}, 2) AS enrolment_elderly_pct, tt AS total_treated, et AS elderly_treated, "
              f"ROUND({_tt}, 2) AS utilization_elderly_pct, ROUND(({_tt}) - ({_ee}), 2) AS utilization_vs_enrolment_gap_pp FROM (SELECT COUNT(*) AS te, "
              f"{hits(_old)} AS ee FROM bm_beneficiary WHERE yob IS NOT NULL) a, (SELECT COUNT(DISTINCT beneficiary_id) AS tt, {uniq('beneficiary_id', _old)} "
              "AS et FROM cm_case JOIN (SELECT beneficiary_id, yob FROM bm_beneficiary) b USING (beneficiary_id) WHERE yob IS NOT NULL) c")
_trt = uniq("beneficiary_id", "case_id IS NOT NULL")
SQL["T91"] = query(_seen, [f"CASE WHEN {_old} THEN 'elderly' ELSE 'non_elderly' END AS age_group"],
                   {"enrolled_count": uniq("beneficiary_id"), "pct_of_enrolled": share(uniq("beneficiary_id"), 1), "treated_count": _trt,
                    "pct_of_treated": f"ROUND({_trt} * 100.0 / NULLIF(SUM({_trt}) OVER (), 0), 1)"}, f"yob IS NOT NULL AND {HOME['district']}")


def lagged(source: str, where: str = "", part: str = "beneficiary_id") -> str:
    w = f"OVER (PARTITION BY {part} ORDER BY admission_datetime, case_id)"
    return (f"(SELECT *, LAG(discharge_datetime) {w} AS prev_out, LAG(admission_datetime) {w} AS prev_in, LAG(hospital_id) {w} AS prev_hosp "
            f"FROM {source}{f' WHERE {where}' if where else ''})")


_back = f"prev_out IS NOT NULL AND {day_gap('prev_out', 'admission_datetime')} <= 30"
_re = {"total_cases": "COUNT(*)", "readmission_count": hits(_back), "readmission_rate_pct": pct(hits(_back), "COUNT(*)", 1)}
SQL["T94"] = query(lagged("cm_case", CARE["district"]) + " x", [], _re)
SQL["T153"] = query(lagged("sc", SITE["hospital"]) + " x", [], _re)
SQL["T195"] = best(query(f"(SELECT l.*, s.hospital_name, s.hospital_type FROM {lagged('cm_case', CARE['district'])} l JOIN site s USING (hospital_id)) x",
                         ["hospital_id", "hospital_name", "hospital_type"], _re), "-readmission_rate_pct hospital_id", 10, "hospital_id")
SQL["T277"] = query(lagged("cm_case", f"hospital_district {BOTH}", "beneficiary_id, hospital_district") + " x", ["hospital_district AS district"],
                    {"total_cases": uniq("case_id"), "readmissions": uniq("case_id", _back),
                     "readmission_rate_pct": pct(uniq("case_id", _back), uniq("case_id"), 2)})
_bk2 = f"prev_out IS NOT NULL AND {day_gap('prev_out', 'discharge_datetime')} <= 30"
SQL["D130"] = query(f"(SELECT l.*, s.hospital_name, s.district_name, s.hospital_type FROM {lagged('cm_case', 'discharge_datetime IS NOT NULL')} l "
                    "JOIN site s USING (hospital_id)) x", ["hospital_id", "hospital_name", "district_name", "hospital_type"],
                    {"total_cases": uniq("case_id"), "readmissions": hits(_bk2), "readmission_rate_pct": pct(hits(_bk2), uniq("case_id"), 1)},
                    having="COUNT(DISTINCT case_id) >= 50", order="-readmission_rate_pct hospital_id", limit=20)
SQL["D77"] = (
    "WITH s AS (SELECT case_id, beneficiary_id, diagnosis_category, CAST(admission_datetime AS DATE) AS a, CAST(e.discharge_date AS DATE) AS d FROM cdx "
    "JOIN (SELECT case_id, discharge_date FROM cm_discharge) e USING (case_id) WHERE admission_datetime IS NOT NULL AND e.discharge_date IS NOT NULL), "
    "r AS (SELECT DISTINCT x.case_id FROM s x JOIN s y ON x.beneficiary_id = y.beneficiary_id AND x.diagnosis_category = y.diagnosis_category AND "
    "x.case_id <> y.case_id AND DATE_DIFF('day', y.d, x.a) BETWEEN 1 AND 30) SELECT COUNT(DISTINCT c.case_id) AS total_cases, COUNT(DISTINCT r.case_id) AS "
    f"readmission_cases, {pct('COUNT(DISTINCT r.case_id)', 'COUNT(DISTINCT c.case_id)', 2)} AS readmission_rate_pct FROM cm_case c LEFT JOIN r ON r.case_id = c.case_id")
_g7 = day_gap("prev_in", "admission_datetime")
SQL["D72"] = (f"SELECT COUNT(DISTINCT beneficiary_id) AS beneficiaries_with_multi_admit, COUNT(*) AS total_suspicious_pairs, "
              "(SELECT COUNT(DISTINCT beneficiary_id) FROM cm_case) AS total_treated_beneficiaries, "
              f"{pct('COUNT(DISTINCT beneficiary_id)', '(SELECT COUNT(DISTINCT beneficiary_id) FROM cm_case)', 2)} AS pct_of_treated FROM "
              f"{lagged('cm_case', 'admission_datetime IS NOT NULL')} x WHERE hospital_id <> prev_hosp AND {_g7} >= 0 AND {_g7} < 7")

# ---- access
_aw = "hospital_district <> home_district_code"


def away(by: list[str], where: str, names, cond: str = _aw, source: str = "hc", **kw) -> str:
    return query(source, by, {"total_cases": uniq("case_id"), names[0]: uniq("case_id", cond), names[1]: pct(uniq("case_id", cond), uniq("case_id"), 1)},
                 where, **kw)


_hk = "home_district_code AS home_district"
_ood = ("out_of_district", "out_of_district_pct")
SQL["D107"] = away([_hk], "", ("out_of_district_cases", "out_of_district_pct"))
SQL["T92"] = away(["hospital_district"], CARE["district"], ("cross_district_cases", "cross_district_pct"))
SQL["T175"], SQL["T234"] = (away([], HOME[v], _ood) for v in ("district", "block"))
SQL["T226"] = away([HB], HOME["district"], _ood, order="-out_of_district_pct block_name", limit=10)
SQL["T233"] = away([], HOME["block"], ("out_of_block", "out_of_block_pct"), "block_name <> home_block_name", _hsc)
SQL["T262"] = away([_hk], f"home_district_code {BOTH}", _ood)
_flows = (f"(SELECT COALESCE(i.district, o.district) AS district, COALESCE(i.k, 0) AS inflow, COALESCE(o.k, 0) AS outflow, COALESCE(i.k, 0) - "
          f"COALESCE(o.k, 0) AS net_flow FROM (SELECT hospital_district AS district, COUNT(*) AS k FROM hc WHERE {_aw} GROUP BY 1) i FULL OUTER JOIN "
          f"(SELECT home_district_code AS district, COUNT(*) AS k FROM hc WHERE {_aw} GROUP BY 1) o ON i.district = o.district)")
SQL["D108"] = (f"SELECT *, CASE WHEN net_flow > 0 THEN 'NET_IMPORTER' WHEN net_flow < 0 THEN 'NET_EXPORTER' ELSE 'BALANCED' END AS flow_type FROM {_flows} x")
SQL["T263"] = f"SELECT district, inflow AS patient_inflow, outflow AS patient_outflow, net_flow FROM {_flows} x WHERE district {BOTH}"
SQL["D109"] = query("hc", [_hk, "hospital_district AS treatment_district"], {"case_count": uniq("case_id")}, _aw,
                    order="-case_count home_district treatment_district", limit=30)
SQL["T176"] = query("hc", ["home_district_code AS source_district"], {"case_count": uniq("case_id"), "pct": share(uniq("case_id"), 1)},
                    f"{CARE['district']} AND home_district_code <> {D1}", order="-case_count source_district", limit=10)
SQL["T186"] = ("SELECT 'INFLOW' AS flow_type, home_district_code AS other_district, COUNT(DISTINCT case_id) AS case_count FROM hc WHERE "
               f"{CARE['district']} AND home_district_code <> {D1} GROUP BY 2 UNION ALL SELECT 'OUTFLOW', hospital_district, COUNT(DISTINCT case_id) "
               f"FROM hc WHERE {HOME['district']} AND hospital_district <> {D1} GROUP BY 2")
SQL["T235"] = best(query(_hsc, _hn3, {"case_count": uniq("case_id")}, HOME["block"]), "-case_count hospital_id", 10, "hospital_id")
_ds = "hospital_state_code AS destination_state"
_pt = "is_portability"
SQL["D28"] = mix("cm_case", _ds, "case_count", 2, _pt)
SQL["D30"] = query("cm_case", [_am], {"portability_cases": "COUNT(*)"}, _pt)
SQL["T30"] = query("hccl", [_ds], {"portability_cases": "COUNT(*)", "total_claimed": rsum("amount_claimed")}, f"{_pt} AND {HOME['district']}")
SQL["T110"] = query("hccl", [_ds], {"portability_cases": uniq("case_id"), "total_claimed": rsum("amount_claimed")}, f"{_pt} AND {HOME['block']}")
_pa = {"portability_cases": uniq("case_id"), "total_approved": rsum("amount_approved")}
SQL["T127"] = query("hccl", [_hk], _pa, f"{_pt} AND home_district_code {BOTH}")
SQL["D125"] = query("hc", [_hk, "hospital_division AS destination_division"],
                    {"portability_cases": uniq("case_id"), "pct_of_home_district_portability": share(uniq("case_id"), 1, "home_district_code")}, _pt)
SQL["D126"] = query("(SELECT hln.*, k.amount_approved FROM hln JOIN cm_claim k USING (case_id)) x", [_hk, *_sk],
                    {"portability_cases": uniq("case_id"), "spend_leakage": rsum("amount_approved")}, _pt)
SQL["T187"] = query("hc", [_ds], {"portability_cases": uniq("case_id"), "pct": share(uniq("case_id"), 1)}, f"{_pt} AND {HOME['district']}",
                    order="-portability_cases destination_state", limit=10)
SQL["T212"] = best(query("sc", ["hospital_id", "hospital_name", "hospital_type"],
                         {"total_cases": uniq("case_id"), "portability_cases": uniq("case_id", _pt),
                          "portability_pct": pct(uniq("case_id", _pt), uniq("case_id"), 1)}, CARE["district"]),
                   "-portability_pct hospital_id", 10, "hospital_id")
SQL["T225"] = query("hc", [HB], {"portability_cases": uniq("case_id"), "pct": share(uniq("case_id"), 1)}, f"{_pt} AND {HOME['district']}",
                    order="-portability_cases block_name", limit=10)
SQL["T247"] = best(query(_hsc, _hn3, {"portability_cases": uniq("case_id")}, f"{_pt} AND {HOME['block']}"), "-portability_cases hospital_id", 10,
                   "hospital_id")
SQL["T265"] = query("hccl", [_hk, "hospital_division AS destination_division"], _pa, f"{_pt} AND home_district_code {BOTH}")


def ratio(k: str, people: str, sites: str, where: str = "") -> str:
    return (f"SELECT {k}, {people}, COALESCE({sites}, 0) AS {sites}, {per(people, sites, 1, 1)} AS beneficiaries_per_hospital FROM "
            f"(SELECT {k}, {people} FROM {_ppl.format(k=k, n=people)} a) a LEFT JOIN (SELECT {k}, {sites} FROM {_hos.format(k=k, n=sites)} b) b USING ({k})"
            + (f" WHERE {where}" if where else ""))


SQL["D45"] = best(ratio("district_name", "beneficiary_count", "hospital_count"), "-beneficiaries_per_hospital district_name", 50)
SQL["D101"] = best(ratio("district", "beneficiaries", "hospitals"), "-beneficiaries_per_hospital district", 30)
SQL["T257"] = ratio("district", "beneficiary_count", "hospital_count", f"district {BOTH}")
for _k, _v in (("T170", "district"), ("T229", "block")):
    SQL[_k] = (f"SELECT beneficiary_count, hospital_count, {per('beneficiary_count', 'hospital_count', 1, 1)} AS beneficiaries_per_hospital FROM "
               f"(SELECT COUNT(DISTINCT beneficiary_id) AS beneficiary_count FROM member WHERE {HOME[_v]}) a, (SELECT COUNT(DISTINCT hospital_id) AS "
               f"hospital_count FROM hm_hospital WHERE {SITE[_v]}) b")
SQL["D102"] = (f"SELECT district, beds AS total_beds, beneficiaries, {per('beds', 'beneficiaries', 1000, 2)} AS beds_per_1000_beneficiaries FROM "
               f"{_hos.format(k='district', n='h')} a LEFT JOIN {_ppl.format(k='district', n='beneficiaries')} b USING (district)")
SQL["T171"] = (f"SELECT total_beds, beneficiary_count, {per('total_beds', 'beneficiary_count', 1000, 2)} AS beds_per_1000_enrolled FROM (SELECT "
               f"CAST(SUM(total_bed_strength) AS BIGINT) AS total_beds FROM hm_hospital WHERE {SITE['district']}) a, (SELECT COUNT(*) AS beneficiary_count "
               f"FROM member WHERE {HOME['district']}) b")
SQL["T258"] = (f"SELECT district, beneficiary_count, COALESCE(beds, 0) AS total_beds, {per('COALESCE(beds, 0)', 'beneficiary_count', 1000, 1)} AS "
               f"beds_per_1000_enrolled FROM {_ppl.format(k='district', n='beneficiary_count')} a LEFT JOIN {_hos.format(k='district', n='h')} b "
               f"USING (district) WHERE district {BOTH}")


def rates(people: str, cases: str, key: str, k: str, base: str, name: str, digits: int, factor: int = 1000, where: str = "") -> str:
    return (f"SELECT {key}, {base}, COALESCE({k}, 0) AS {k}, {per(f'COALESCE({k}, 0)', base, factor, digits)} AS {name} FROM ({people}) a LEFT JOIN "
            f"({cases}) b USING ({key})" + (f" WHERE {where}" if where else ""))


def heads(geo: str, key: str, n: str, where: str = "") -> str:
    return query("member", [f"{geo} AS {key}"], {n: uniq("beneficiary_id")}, where)


SQL["D103"] = rates(heads("home_district_code", "district", "beneficiaries"),
                    query("cm_case", ["hospital_district AS district"], {"total_cases": uniq("case_id")}), "district", "total_cases", "beneficiaries",
                    "cases_per_1000_enrolled", 2)
SQL["D104"] = best(rates(heads("home_block_name", "block", "beneficiaries"),
                         query("hc", ["home_block_name AS block"], {"total_cases": uniq("case_id")}), "block", "total_cases", "beneficiaries",
                         "cases_per_1000_enrolled", 2), "-cases_per_1000_enrolled block", 30)
for _k, _src, _w, _hw in (("T172", "cm_case", CARE["district"], HOME["district"]), ("T230", "hc", HOME["block"], HOME["block"])):
    SQL[_k] = (f"SELECT case_count, beneficiary_count, {per('case_count', 'beneficiary_count', 1000, 1)} AS cases_per_1000_enrolled FROM (SELECT "
               f"COUNT(DISTINCT case_id) AS case_count FROM {_src} WHERE {_w}) a, (SELECT COUNT(DISTINCT beneficiary_id) AS beneficiary_count FROM member "
               f"WHERE {_hw}) b")
SQL["T259"] = (f"SELECT district, COALESCE(case_count, 0) AS case_count, COALESCE(beneficiary_count, 0) AS beneficiary_count, "
               f"{per('COALESCE(case_count, 0)', 'beneficiary_count', 1000, 1)} AS cases_per_1000 FROM "
               f"({query('cm_case', ['hospital_district AS district'], {'case_count': uniq('case_id')}, f'hospital_district {BOTH}')}) a FULL OUTER JOIN "
               f"({heads('home_district_code', 'district', 'beneficiary_count', f'home_district_code {BOTH}')}) b USING (district)")
_bh = query("(SELECT h.*, beneficiary_id FROM bm_household h LEFT JOIN bm_beneficiary b USING (household_id)) x", [HB],
            {"beneficiary_count": uniq("beneficiary_id")}, HOME["district"])
_br = rates(_bh, query("hc", [HB], {"case_count": uniq("case_id")}, HOME["district"]), "block_name", "case_count", "beneficiary_count", "cases_per_1000", 1)
SQL["T181"] = best(_br, "-cases_per_1000 block_name", 15)
SQL["T180"] = best(_br, "cases_per_1000 block_name", 15)
SQL["T182"] = f"SELECT block_name, beneficiary_count, case_count FROM ({_br}) x WHERE case_count < {_P['fewer_cases']} AND beneficiary_count > {_P['more_people']}"
SQL["T118"] = rates(heads("home_district_code", "district_name", "enrolled_count", f"home_district_code {BOTH}"),
                    query("cm_case", [CD], {"case_count": uniq("case_id")}), "district_name", "case_count", "enrolled_count",
                    "cases_per_1000_enrolled", 1)


def cat(c: str) -> str:
    return f"diagnosis_category = '{c}'"


_gf = f"gender = {_P['female']}"
_mat = cat("MATERNAL_NEONATAL")
SQL["D91"] = rates(heads("home_district_code", "district_name", "enrolled_female_count", _gf),
                   query("hdx", [HD], {"maternal_case_count": uniq("case_id")}, f"{_mat} AND {_gf}"), "district_name", "maternal_case_count",
                   "enrolled_female_count", "maternal_rate_per_1000_women", 2)
SQL["D120"] = rates(heads("home_district_code", "district", "enrolled_women", _gf),
                    query("hdx", ["hospital_district AS district"], {"maternal_cases": uniq("case_id")}, f"{_mat} AND {_gf}"), "district",
                    "maternal_cases", "enrolled_women", "rate_per_1000_women", 2)
for _k, _c, _n, _r in (("D121", "NCD", "ncd_cases", "ncd_rate_per_1000"), ("D122", "COMMUNICABLE", "communicable_cases", "comm_rate_per_1000")):
    SQL[_k] = rates(heads("home_district_code", "district", "beneficiaries"),
                    query("cdx", ["hospital_district AS district"], {_n: uniq("case_id")}, cat(_c)), "district", _n, "beneficiaries", _r, 2)
for _k, _c, _src, _v, _n, _base, _r, _dg, _wf in (
    ("T183", "MATERNAL_NEONATAL", "cdx", "district", "maternal_neonatal_cases", "enrolled_women", "cases_per_1000_women", 1, True),
    ("T184", "NCD", "cdx", "district", "ncd_cases", "beneficiary_count", "ncd_cases_per_1000", 1, False),
    ("T185", "COMMUNICABLE", "cdx", "district", "communicable_cases", "beneficiary_count", "comm_cases_per_1000", 1, False),
    ("T237", "MATERNAL_NEONATAL", "hdx", "block", "maternal_cases", "enrolled_women", "rate_per_1000_women", 2, True),
    ("T238", "NCD", "hdx", "block", "ncd_cases", "enrolled_count", "rate_per_1000_enrolled", 2, False),
    ("T239", "COMMUNICABLE", "hdx", "block", "communicable_cases", "enrolled_count", "rate_per_1000_enrolled", 2, False),
):
    _w = CARE["district"] if _v == "district" else HOME["block"]
    SQL[_k] = (f"SELECT {_n}, {_base}, {per(_n, _base, 1000, _dg)} AS {_r} FROM (SELECT COUNT(DISTINCT case_id) AS {_n} FROM {_src} WHERE {cat(_c)} AND {_w}) "
               f"a, (SELECT COUNT(DISTINCT beneficiary_id) AS {_base} FROM member WHERE {HOME[_v]}{f' AND {_gf}' if _wf else ''}) b")
for _k, _c, _n, _base, _r, _wf in (("T267", "MATERNAL_NEONATAL", "maternal_cases", "enrolled_women", "rate_per_1000_women", _gf),
                                   ("T268", "NCD", "ncd_cases", "enrolled_count", "rate_per_1000_enrolled", ""),
                                   ("T269", "COMMUNICABLE", "communicable_cases", "enrolled_count", "rate_per_1000_enrolled", "")):
    SQL[_k] = (f"SELECT district, {_n}, {_base}, {per(_n, _base, 1000, 2)} AS {_r} FROM "
               f"({query('cdx', ['hospital_district AS district'], {_n: uniq('case_id')}, f'hospital_district {BOTH} AND {cat(_c)}')}) a LEFT JOIN "
               f"({heads('home_district_code', 'district', _base, _wf)}) b USING (district)")
SQL["T291"] = best(rates(heads("home_block_name", "block", "enrolled_women", f"{HOME['district']} AND {_gf}"),
                         query("hdx", ["home_block_name AS block"], {"maternal_cases": uniq("case_id")}, f"{HOME['district']} AND {_mat}"), "block",
                         "maternal_cases", "enrolled_women", "rate_per_1000_women", 2), "-rate_per_1000_women block", 10)
SQL["D84"] = ("SELECT entitlement_source, enrolled_count, COALESCE(total_cases, 0) AS total_cases, COALESCE(tb, 0) AS treated_beneficiaries, "
              f"{per('COALESCE(total_cases, 0)', 'enrolled_count', 1000, 2)} AS cases_per_1000_enrolled, COALESCE(av, 0) AS avg_claim_value FROM "
              f"({query('member', ['entitlement_source'], {'enrolled_count': uniq('beneficiary_id')})}) a LEFT JOIN "
              f"({query('hcc', ['entitlement_source'], {'total_cases': uniq('case_id'), 'tb': uniq('beneficiary_id'), 'av': ravg('amount_approved', 2)}, 'amount_approved IS NOT NULL')}) b "
              "USING (entitlement_source)")
SQL["D123"] = (f"SELECT * FROM ({heads('home_block_name', 'block_name', 'beneficiaries')}) a WHERE beneficiaries > {_P['more_than']} AND NOT EXISTS (SELECT 1 FROM "
               "hm_hospital h WHERE h.block_name = a.block_name)")
SQL["D124"] = best(f"SELECT * FROM ({query('hc', [HB], {'case_count': uniq('case_id')})}) a WHERE NOT EXISTS (SELECT 1 FROM hm_hospital h WHERE "
                   "h.block_name = a.block_name)", "-case_count block_name", 20)
SQL["T179"] = (f"SELECT DISTINCT block_name FROM ref_up_geography g WHERE {SITE['district']} AND NOT EXISTS (SELECT 1 FROM hm_hospital h WHERE "
               "h.block_name = g.block_name AND h.district_name = g.district_name)")
SQL["D80"] = best(f"SELECT block_name, district_name, division_name, COALESCE(k, 0) AS case_count FROM ref_up_geography LEFT JOIN "
                  f"({query('hc', [HB, HD], {'k': uniq('case_id')})}) a USING (block_name, district_name) WHERE COALESCE(k, 0) < 5",
                  "case_count district_name block_name", 50)
_out = ("COUNT(DISTINCT CASE WHEN hospital_id IS NOT NULL AND COALESCE(sb, '') <> home_block_name THEN case_id END)")
SQL["D141"] = best(
    f"SELECT block, enrolled, COALESCE(total_cases, 0) AS total_cases, COALESCE(hb, 0) AS hospitals_in_block, "
    f"{per('COALESCE(total_cases, 0)', 'enrolled', 1000, 2)} AS case_rate_per_1000, {pct('COALESCE(o, 0)', 'COALESCE(total_cases, 0)', 1)} AS "
    f"pct_treated_outside_block FROM ({heads('home_block_name', 'block', 'enrolled')}) a LEFT JOIN (SELECT home_block_name AS block, "
    f"COUNT(DISTINCT case_id) AS total_cases, {_out} AS o FROM hc LEFT JOIN (SELECT hospital_id, block_name AS sb FROM hm_hospital) h USING (hospital_id) "
    "GROUP BY 1) b USING (block) LEFT JOIN (SELECT block_name AS block, COUNT(DISTINCT hospital_id) AS hb FROM hm_hospital GROUP BY 1) c USING (block)",
    "hospitals_in_block case_rate_per_1000 -enrolled block", 20)
_mem_use = ("(SELECT m.home_district_code AS district, m.beneficiary_id, c.case_id, k.amount_approved, k.amount_claimed, k.settlement_tat_days FROM member m "
            "LEFT JOIN cm_case c USING (beneficiary_id) LEFT JOIN cm_claim k ON k.case_id = c.case_id)")
_u1000 = per(uniq("case_id"), uniq("beneficiary_id"), 1000, 2)
SQL["D139"] = ("WITH d AS (" + query(f"{_mem_use} x", ["district"], {"enrolled": uniq("beneficiary_id"), "total_cases": uniq("case_id"),
                                                                   "utilization_per_1000": _u1000,
                                                                   "avg_approval_rate_pct": ravg("amount_approved * 100.0 / NULLIF(amount_claimed, 0)")})
               + "), s AS (SELECT AVG(utilization_per_1000) AS u, AVG(avg_approval_rate_pct) AS r FROM d) SELECT d.*, ROUND(u, 6) AS state_avg_utilization, "
               "ROUND(r, 6) AS state_avg_approval_rate FROM d, s WHERE utilization_per_1000 > u AND avg_approval_rate_pct < r")
SQL["D140"] = ("WITH d AS (" + query(f"{_mem_use} x", ["district"], {"enrolled": uniq("beneficiary_id"), "total_cases": uniq("case_id"),
                                                                   "utilization_per_1000": _u1000, "avg_tat_days": ravg(_t)}, f"{_t} IS NOT NULL")
               + "), s AS (SELECT AVG(utilization_per_1000) AS u, AVG(avg_tat_days) AS r FROM d) SELECT d.*, ROUND(u, 2) AS state_avg_utilization, "
               "ROUND(r, 1) AS state_avg_tat FROM d, s WHERE utilization_per_1000 < u AND avg_tat_days > r")
_m3 = {"approval_rate_pct": ravg(_apr), "avg_tat_days": ravg(_t)}
SQL["T206"] = (
    "WITH s AS (" + query("(SELECT ccl.*, b.beneficiary_id AS known FROM ccl LEFT JOIN bm_beneficiary b USING (beneficiary_id)) x", [],
                          {"utilization_per_1000": per(uniq("case_id"), uniq("known"), 1000, 1)} | _m3)
    + "), d AS (" + query("ccl", [], {"utilization_per_1000": per(uniq("case_id"), f"(SELECT COUNT(*) FROM member WHERE {HOME['district']})", 1000, 1)} | _m3,
                          CARE["district"])
    + ") " + " UNION ALL ".join(f"SELECT '{m}' AS metric, s.{m} AS state_avg, d.{m} AS district_value, ROUND(d.{m} - s.{m}, 1) AS difference FROM s, d"
                                for m in ("utilization_per_1000", "approval_rate_pct", "avg_tat_days")))


def _bd(prefix: str, where: str) -> str:
    return query("hcc", [], {f"{prefix}_cases": uniq("case_id"),
                             f"{prefix}_rejection_rate": "ROUND(AVG(CASE WHEN claim_status = 'REJECTED' THEN 1 ELSE 0 END) * 100, 1)",
                             f"{prefix}_avg_tat": ravg(_t)}, where)


SQL["T244"] = f"SELECT * FROM ({_bd('block', HOME['block'])}) a, ({_bd('district', f'home_district_code = {_hdist}')}) b"
_ar = f"ROUND(AVG(CASE WHEN {_ok} THEN 1 ELSE 0 END) * 100, 1)"
SQL["T284"] = ("SELECT * FROM (SELECT *, RANK() OVER (ORDER BY total_cases DESC NULLS LAST) AS utilization_rank, RANK() OVER (ORDER BY approval_rate DESC "
               "NULLS LAST) AS approval_rank, RANK() OVER (ORDER BY rejection_rate ASC NULLS LAST) AS rejection_rank, RANK() OVER (ORDER BY avg_tat ASC NULLS "
               "LAST) AS tat_rank FROM (" + query("cc", ["hospital_district AS district"], {
                   "total_cases": uniq("case_id"), "approval_rate": _ar,
                   "rejection_rate": "ROUND(AVG(CASE WHEN claim_status = 'REJECTED' THEN 1 ELSE 0 END) * 100, 1)", "avg_tat": ravg(_t)})
               + f") x) y WHERE district = {D1}")
SQL["T288"] = query("hcc", ["home_block_name AS block"], {"total_cases": uniq("case_id"), "approval_rate_pct": _ar, "avg_tat_days": ravg(_t)},
                    HOME["district"], having="COUNT(DISTINCT case_id) >= 10", order="-approval_rate_pct avg_tat_days block", limit=10)
SQL["T290"] = best(
    "SELECT block, total_beneficiaries, dob_pct, mobile_pct, COALESCE(l, 0) AS avg_card_lag_days FROM ("
    + query("member", ["home_block_name AS block"], {"total_beneficiaries": uniq("beneficiary_id"), "dob_pct": pct(hits(_birth), "COUNT(*)", 1),
                                                     "mobile_pct": pct("COUNT(mobile)", "COUNT(*)", 1)}, HOME["district"])
    + f") a LEFT JOIN ({query('rc', ['home_block_name AS block'], {'l': ravg(_lag)}, HOME['district'])}) b USING (block)",
    "dob_pct mobile_pct block", 10)


def catalogue_sql() -> dict[str, str]:
    from cohortline.plans.catalogue import QUESTIONS

    return {f"{qid}_{QUESTIONS[qid].family}": complete(sql) for qid, sql in SQL.items()}
