"""SQL for sources, derived columns, selection, quality, repair and views."""

from __future__ import annotations

from cohortline.functions.derive import CLASS_BY_RANGE
from cohortline.sources import schema
from workload.foundation import ABBREVIATIONS, AS_OF, EXPECTED_ROWS, GIVEN, LEFT_OUT, SPOILT, TWICE

from .model import complete, hits, isum, lit

ASOF = f"DATE '{AS_OF}'"
_REFYEAR = "(SELECT MAX(year(admission_datetime)) FROM cm_case)"
_EPOCH_DAYS = "(epoch({b}) - epoch({a})) / 86400.0"


def _bands(x: str, limits, last: str, op: str = "<=", null: str = "NULL") -> str:
    whens = " ".join(f"WHEN {x} {op} {b} THEN '{n}'" for b, n in limits)
    return f"CASE WHEN {x} IS NULL THEN {null} {whens} ELSE '{last}' END"


AGE_GROUP = (f"CASE WHEN yob IS NULL THEN 'UNKNOWN' WHEN {_REFYEAR} - yob < 1 THEN 'INFANT' ELSE "
             + _bands(f"{_REFYEAR} - yob", [(5, "1-5"), (14, "6-14"), (25, "15-25"), (40, "26-40"), (60, "41-60")], "60+") + " END")
DISEASE = ("CASE WHEN icd_code IS NULL THEN 'UNKNOWN' WHEN icd_code[1] IN ('O', 'P') THEN 'MATERNAL_NEONATAL' WHEN icd_code[1] IN ('A', 'B') "
           "THEN 'COMMUNICABLE' WHEN icd_code[1] IN ('S', 'T') THEN 'INJURY' WHEN icd_code[1] IN ('I','E','J','N','C','D') THEN 'NCD' "
           "WHEN icd_code[1] IN ('K','H','G','M','L') THEN 'SURGICAL' ELSE 'OTHER' END")
BEDS = _bands("total_bed_strength", [(30, "SMALL (<=30)"), (100, "MEDIUM (31-100)"), (300, "LARGE (101-300)")], "VERY_LARGE (300+)",
              null="'UNKNOWN'")
EXPIRED = "CASE WHEN CAST(expiry_date AS TIMESTAMP) < (SELECT MAX(admission_datetime) FROM cm_case) THEN 1 ELSE 0 END"
_LOS = _EPOCH_DAYS.format(a="admission_datetime", b="discharge_datetime")
_EM, _DE, _LA = ("CASE WHEN admission_type = 'EMERGENCY' THEN 1 ELSE 0 END", "CASE WHEN discharge_type = 'DEATH' THEN 1 ELSE 0 END",
                 "CASE WHEN discharge_type IN ('LAMA', 'DAMA') THEN 1 ELSE 0 END")


def _class() -> str:
    out = "CASE"
    for letter, low, high, name in CLASS_BY_RANGE:
        cond = f"l = '{letter}'"
        if low is not None:
            cond += f" AND d >= {low}"
        if high is not None:
            cond += f" AND d <= {high}"
        out += f" WHEN {cond} THEN '{name}'"
    return out + " ELSE 'OTHER' END"


VIEW1 = f"""
SELECT c.case_id, h.home_division_name AS division, h.home_district_code AS district, c.hospital_division, c.hospital_district,
  s.hospital_type, s.hospital_sub_type, r.specialty_code, r.specialty_name, r.procedure_name, d.disease_category, d.icd_code, b.gender,
  b.age_group, c.admission_type, c.discharge_type, c.is_portability, k.claim_status, p.status AS preauth_status, y.payment_status,
  s.accreditation_level, s.bed_size_bucket, strftime(c.admission_datetime, '%Y-%m') AS admission_month,
  year(c.admission_datetime) || 'Q' || quarter(c.admission_datetime) AS admission_quarter,
  CAST(year(c.admission_datetime) AS VARCHAR) AS admission_year, {_LOS} AS length_of_stay, {_EM} AS is_emergency, {_DE} AS is_death,
  {_LA} AS is_lama_dama, l.base_amount, l.computed_final_amount, l.expected_payable_amount, k.amount_claimed, k.amount_approved,
  y.amount_paid, k.settlement_tat_days, k.query_count, 1 AS case_count
FROM cm_case c
LEFT JOIN (SELECT *, {AGE_GROUP} AS age_group FROM bm_beneficiary) b ON c.beneficiary_id = b.beneficiary_id
LEFT JOIN bm_household h ON b.household_id = h.household_id
LEFT JOIN (SELECT *, {BEDS} AS bed_size_bucket FROM hm_hospital) s ON c.hospital_id = s.hospital_id
LEFT JOIN (SELECT case_id, icd_code, {DISEASE} AS disease_category FROM cm_case_diagnosis WHERE diagnosis_rank = 1) d ON d.case_id = c.case_id
LEFT JOIN (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY case_id ORDER BY initiated_at DESC, preauth_id DESC) AS rn
  FROM cm_preauth_request) z WHERE rn = 1) p ON p.case_id = c.case_id
LEFT JOIN (SELECT * FROM cm_preauth_procedure_line WHERE procedure_rank = 1) l ON l.preauth_id = p.preauth_id
LEFT JOIN ref_hbp_procedure_master r ON r.hbp_procedure_code = l.hbp_procedure_code
LEFT JOIN (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY case_id ORDER BY submitted_at, claim_id) AS rn FROM cm_claim) z
  WHERE rn = 1) k ON k.case_id = c.case_id
LEFT JOIN (SELECT claim_id, SUM(n * amt) AS amount_paid, MIN(CASE WHEN rn = 1 THEN payment_status END) AS payment_status FROM (
  SELECT claim_id, payment_status, COUNT(*) AS c, 1 AS n, SUM(amount_paid) AS amt, ROW_NUMBER() OVER (PARTITION BY claim_id
  ORDER BY COUNT(*) DESC, payment_status) AS rn FROM cm_payment GROUP BY 1, 2) z GROUP BY 1) y ON y.claim_id = k.claim_id"""

_HOME = "(SELECT beneficiary_id, household_id, b.created_at, home_district_code AS district, home_division_name AS division FROM bm_beneficiary b LEFT JOIN bm_household h USING (household_id))"
VIEW2 = f"""
WITH g AS {_HOME},
e AS (SELECT division, district, strftime(created_at, '%Y-%m') AS month, COUNT(*) AS new_beneficiaries, COUNT(DISTINCT household_id) AS
  new_households FROM g GROUP BY 1, 2, 3),
m AS (SELECT district, MIN(division) AS division FROM e GROUP BY 1),
a AS (SELECT g.district, strftime(c.admission_datetime, '%Y-%m') AS month, COUNT(*) AS cases_admitted, SUM({_EM}) AS emergency_cases,
  SUM(CASE WHEN c.is_portability THEN 1 ELSE 0 END) AS portability_cases, SUM({_DE}) AS deaths, SUM({_LA}) AS lama_dama_cases,
  SUM(CASE WHEN s.hospital_type = 'PUBLIC' THEN 1 ELSE 0 END) AS public_cases, SUM(CASE WHEN s.hospital_type = 'PRIVATE' THEN 1 ELSE 0 END) AS
  private_cases, COUNT(DISTINCT c.hospital_id) AS unique_hospitals, AVG({_LOS}) AS avg_length_of_stay FROM cm_case c LEFT JOIN g
  ON g.beneficiary_id = c.beneficiary_id LEFT JOIN hm_hospital s ON s.hospital_id = c.hospital_id GROUP BY 1, 2),
d AS (SELECT g.district, strftime(issued_at, '%Y-%m') AS month, COUNT(*) AS cards_issued FROM bm_card k LEFT JOIN g ON
  g.beneficiary_id = k.beneficiary_id GROUP BY 1, 2),
l AS (SELECT g.district, strftime(k.submitted_at, '%Y-%m') AS month, COUNT(*) AS claims_submitted, SUM(CASE WHEN claim_status IN ('APPROVED',
  'SETTLED') THEN 1 ELSE 0 END) AS claims_approved, SUM(CASE WHEN claim_status = 'REJECTED' THEN 1 ELSE 0 END) AS claims_rejected,
  COALESCE(SUM(amount_claimed), 0) AS amount_claimed, COALESCE(SUM(amount_approved), 0) AS amount_approved, AVG(settlement_tat_days) AS
  avg_settlement_tat FROM cm_claim k LEFT JOIN cm_case c ON c.case_id = k.case_id LEFT JOIN g ON g.beneficiary_id = c.beneficiary_id GROUP BY 1, 2),
p AS (SELECT g.district, strftime(y.payment_date, '%Y-%m') AS month, COALESCE(SUM(amount_paid), 0) AS amount_paid, COUNT(*) AS payment_count,
  SUM(CASE WHEN payment_status = 'FAILED' THEN 1 ELSE 0 END) AS payment_failures FROM cm_payment y LEFT JOIN cm_claim k ON k.claim_id = y.claim_id
  LEFT JOIN cm_case c ON c.case_id = k.case_id LEFT JOIN g ON g.beneficiary_id = c.beneficiary_id GROUP BY 1, 2),
j AS (SELECT * FROM e FULL JOIN a USING (district, month) FULL JOIN d USING (district, month) FULL JOIN l USING (district, month)
  FULL JOIN p USING (district, month)),
f AS (SELECT COALESCE(j.division, m.division) AS dv, j.* EXCLUDE (division), SUM(COALESCE(new_beneficiaries, 0)) OVER (PARTITION BY j.district
  ORDER BY j.month NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM j LEFT JOIN m ON m.district = j.district)
SELECT dv AS division, district, month,
""" + ",\n".join(f"  CAST(COALESCE({c}, 0) AS DOUBLE) AS {c}" for c in (
    "new_beneficiaries", "new_households", "cases_admitted", "emergency_cases", "deaths", "lama_dama_cases", "public_cases", "private_cases",
    "unique_hospitals", "cards_issued", "claims_submitted", "claims_approved", "claims_rejected", "amount_claimed", "amount_approved",
    "amount_paid", "payment_count", "payment_failures")) + """,
  CAST(COALESCE(portability_cases, 0) AS BIGINT) AS portability_cases, avg_length_of_stay, avg_settlement_tat, CAST(cum AS DOUBLE) AS
  cumulative_beneficiaries, month[1:4] || 'Q' || quarter(CAST(month || '-01' AS DATE)) AS quarter, month[1:4] AS year,
  CAST(COALESCE(cases_admitted, 0) AS DOUBLE) / NULLIF(cum, 0) * 1000 AS claims_per_1000_beneficiaries,
  CAST(COALESCE(claims_approved, 0) AS DOUBLE) / NULLIF(COALESCE(claims_submitted, 0), 0) AS approval_rate,
  CAST(COALESCE(emergency_cases, 0) AS DOUBLE) / NULLIF(COALESCE(cases_admitted, 0), 0) AS emergency_share,
  CAST(COALESCE(deaths, 0) AS DOUBLE) / NULLIF(COALESCE(cases_admitted, 0), 0) AS death_rate,
  CAST(COALESCE(public_cases, 0) AS DOUBLE) / (COALESCE(private_cases, 0) + 1) AS public_private_ratio,
  COALESCE(amount_claimed, 0) / NULLIF(COALESCE(claims_submitted, 0), 0) AS avg_claim_amount
FROM f"""

VIEW3 = f"""
WITH raw AS (SELECT c.hospital_id, r.specialty_code, c.case_id, {_EM} AS em, {_DE} AS de, p.status, k.claim_status, k.amount_claimed,
  k.amount_approved, k.settlement_tat_days, y.amount_paid FROM cm_case c LEFT JOIN cm_preauth_request p ON p.case_id = c.case_id
  LEFT JOIN (SELECT preauth_id, hbp_procedure_code FROM cm_preauth_procedure_line WHERE procedure_rank = 1) l ON l.preauth_id = p.preauth_id
  LEFT JOIN ref_hbp_procedure_master r ON r.hbp_procedure_code = l.hbp_procedure_code LEFT JOIN cm_claim k ON k.case_id = c.case_id
  LEFT JOIN cm_payment y ON y.claim_id = k.claim_id),
a AS (SELECT hospital_id, specialty_code, COUNT(case_id) AS n, SUM(CASE WHEN status IN ('AUTO_APPROVED', 'APPROVED') THEN 1 ELSE 0 END) AS
  preauth_approved, SUM(CASE WHEN status = 'REJECTED' THEN 1 ELSE 0 END) AS preauth_rejected, SUM(CASE WHEN claim_status IN ('APPROVED',
  'SETTLED') THEN 1 ELSE 0 END) AS claims_approved, COALESCE(SUM(amount_claimed), 0) AS amount_claimed, COALESCE(SUM(amount_approved), 0) AS
  amount_approved, COALESCE(SUM(amount_paid), 0) AS amount_paid, AVG(settlement_tat_days) AS avg_settlement_tat, SUM(em) AS emergency_count,
  SUM(de) AS death_count FROM raw GROUP BY 1, 2),
st AS (SELECT hospital_id, COUNT(*) AS total_staff, AVG(experience_years) AS avg_experience_years FROM hm_staff GROUP BY 1),
li AS (SELECT hospital_id, COUNT(*) AS total_licenses, CAST(SUM(x) AS BIGINT) AS expired_licenses, CAST(SUM(1 - x) AS BIGINT) AS
  active_licenses FROM (SELECT hospital_id, {EXPIRED} AS x FROM hm_license_certificate) q GROUP BY 1)
SELECT o.hospital_specialty_id, o.hospital_id, o.specialty_code, o.specialty_name, o.admissions_prev_fy, o.admissions_before_last_year,
  h.division_name AS division, h.district_name AS district, h.hospital_type, h.hospital_sub_type, h.accreditation_level, {BEDS} AS
  bed_size_bucket, h.total_bed_strength, h.inpatient_beds, h.has_fully_equipped_ot AS has_ot, h.has_icu_with_ac AS has_icu,
  CAST(COALESCE(a.n, 0) AS DOUBLE) AS cases_treated, CAST(a.preauth_approved AS DOUBLE) AS preauth_approved, CAST(a.preauth_rejected AS DOUBLE)
  AS preauth_rejected, CAST(a.claims_approved AS DOUBLE) AS claims_approved, a.amount_claimed, a.amount_approved, a.amount_paid,
  a.avg_settlement_tat, CAST(a.emergency_count AS DOUBLE) AS emergency_count, CAST(a.death_count AS DOUBLE) AS death_count, st.total_staff,
  st.avg_experience_years, li.total_licenses, li.expired_licenses, li.active_licenses, CASE WHEN COALESCE(a.n, 0) = 0 THEN 1 ELSE 0 END AS
  zero_claim_flag, CAST(COALESCE(a.n, 0) AS DOUBLE) / NULLIF(h.total_bed_strength, 0) AS cases_per_bed
FROM hm_specialty_offered o LEFT JOIN hm_hospital h ON h.hospital_id = o.hospital_id
LEFT JOIN a ON a.hospital_id = o.hospital_id AND a.specialty_code = o.specialty_code
LEFT JOIN st ON st.hospital_id = o.hospital_id LEFT JOIN li ON li.hospital_id = o.hospital_id"""

_DOCN = "COALESCE(d.n, 0)"
VIEW4 = f"""
SELECT b.beneficiary_id, b.gender, b.age_group, b.bis_record_status, b.is_duplicate, h.home_division_name AS division, h.home_district_code AS
  district, h.entitlement_source, e.status AS enrolment_status, e.auth_mode, k.card_status, {_DOCN} AS document_count, COALESCE(d.aad, 0) AS
  has_aadhaar, COALESCE(u.n, 0) AS claim_count, u.total_amount_claimed, u.total_amount_approved, CASE WHEN COALESCE(u.n, 0) > 0 THEN 1 ELSE 0 END
  AS has_claim, {_bands(_DOCN, [(0, 'NO_DOCS'), (1, '1_DOC'), (3, '2-3_DOCS')], '4+_DOCS')} AS document_count_bucket,
  {_EPOCH_DAYS.format(a='b.created_at', b='k.issued_at')} AS days_enrolment_to_card,
  {_EPOCH_DAYS.format(a='k.issued_at', b='u.first_at')} AS days_card_to_first_claim, CASE WHEN COALESCE(u.n, 0) > 0 THEN 1 ELSE 0 END AS claim_rate
FROM (SELECT *, {AGE_GROUP} AS age_group FROM bm_beneficiary) b LEFT JOIN bm_household h ON h.household_id = b.household_id
LEFT JOIN (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY beneficiary_id ORDER BY submitted_at DESC, enrolment_request_id DESC) AS rn
  FROM bm_enrolment_request) z WHERE rn = 1) e ON e.beneficiary_id = b.beneficiary_id
LEFT JOIN (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY beneficiary_id ORDER BY issued_at DESC NULLS LAST, card_id DESC) AS rn FROM bm_card) z
  WHERE rn = 1) k ON k.beneficiary_id = b.beneficiary_id
LEFT JOIN (SELECT beneficiary_id, COUNT(*) AS n, MAX(CASE WHEN doc_type = 'AADHAAR' THEN 1 ELSE 0 END) AS aad FROM bm_id_document GROUP BY 1) d
  ON d.beneficiary_id = b.beneficiary_id
LEFT JOIN (SELECT beneficiary_id, COUNT(c.case_id) AS n, COALESCE(SUM(amount_claimed), 0) AS total_amount_claimed, COALESCE(SUM(amount_approved), 0)
  AS total_amount_approved, MIN(admission_datetime) AS first_at FROM cm_case c LEFT JOIN cm_claim k ON k.case_id = c.case_id GROUP BY 1) u
  ON u.beneficiary_id = b.beneficiary_id"""

_TREATED = ("(SELECT c.case_id, c.hospital_id, r.specialty_code FROM cm_preauth_procedure_line l JOIN cm_preauth_request p ON p.preauth_id = l.preauth_id "
            "JOIN ref_hbp_procedure_master r ON r.hbp_procedure_code = l.hbp_procedure_code JOIN cm_case c ON c.case_id = p.case_id "
            "WHERE l.procedure_rank = 1 AND c.hospital_id IS NOT NULL)")


def _last(table: str, key: str, order: str, cols: str, where: str = "") -> str:
    return (f"SELECT {key}, {cols} FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM {table}{where}) z "
            "WHERE rn = 1")


def _rows(check: str, subject: str, value: str, passed: str, source: str) -> str:
    return f"SELECT '{check}' AS \"check\", '{subject}' AS subject, CAST({value} AS DOUBLE) AS value, {passed} AS passed FROM {source}"


def _union(parts) -> str:
    return " UNION ALL ".join(parts)


def _unique(n: str, k: str) -> str:
    return _rows("unique_key", f"{n}.{k}", f"COUNT(*) - COUNT(DISTINCT {k})", f"COUNT(*) = COUNT(DISTINCT {k})", n)


def _domain(n: str, c: str, allowed) -> str:
    vals = ", ".join(lit(a) for a in allowed)
    bad = f"COUNT(DISTINCT CASE WHEN {c} NOT IN ({vals}) THEN {c} END)"
    return _rows("value_domain", f"{n}.{c}", bad, f"{bad} = 0", n)


def _orphan(c: str, cc: str, p: str, pc: str) -> str:
    base = f"(SELECT COUNT(*) AS n, COUNT(CASE WHEN {cc} NOT IN (SELECT {pc} FROM {p} WHERE {pc} IS NOT NULL) THEN 1 END) AS lost FROM {c} WHERE {cc} IS NOT NULL) x"
    return _union([_rows("orphans", f"{c}.{cc}", "lost", "lost = 0", base),
                   _rows("orphan_pct", f"{c}.{cc}", "CASE WHEN n > 0 THEN ROUND(CAST(lost AS DOUBLE) / n * 100.0, 6) ELSE 0 END", "lost = 0", base)])


def _null_rates() -> str:
    missing = r"(UNPIVOT (SELECT CAST(COLUMNS('(.*)') IS NULL AS INT) AS '\1' FROM {n}) ON COLUMNS(*) INTO NAME c VALUE v)"
    pct = "ROUND(CAST(SUM(v) AS DOUBLE) / COUNT(*) * 100.0, 6)"
    return _union(f"SELECT 'null_rate' AS \"check\", '{n}.' || c AS subject, {pct} AS value, {pct} <= 20 AS passed FROM {missing.format(n=n)} GROUP BY c"
                  for n in schema.PRIMARY_KEYS)


def _span(n: str, c: str) -> str:
    v = f"ROUND(floor((epoch(MAX({c})) - epoch(MIN({c}))) / 86400) / 365.0, 6)"
    return _rows("date_span", f"{n}.{c}", v, f"{v} BETWEEN 1 AND 10", n)


def _grain(name: str, sql: str, keys: str, expected=None, at_least=None) -> str:
    base = f"(SELECT COUNT(*) AS n, (SELECT COUNT(*) FROM (SELECT DISTINCT {keys} FROM ({sql}) a) b) AS d FROM ({sql}) c) x"
    out = [_rows("grain", name, "n - d", "n = d", base)]
    if expected:
        off = f"ROUND(ABS(n - {expected}) / CAST({expected} AS DOUBLE) * 100.0, 6)"
        out.append(_rows("row_count", name, off, f"{off} < 20", base))
    if at_least:
        out.append(_rows("min_rows", name, "n", f"n >= {at_least}", base))
    return _union(out)


_HCOLS = ("hospital_id hospital_name hospital_type hospital_sub_type district_name division_name block_name total_bed_strength inpatient_beds "
          "delisted_from_gov_schemes has_fully_equipped_ot has_icu_with_ac has_casualty has_opd has_hdu has_general_ward has_labour_room "
          "accreditation_board accreditation_level accreditation_valid_upto created_at updated_at").split()
_TOPCOLS = ("division", "hospital_type", "specialty_code", "age_group", "claim_status")
_STATCOLS = ("length_of_stay", "amount_claimed", "amount_paid", "settlement_tat_days")


def _expect(name: str, cond: str, source: str) -> str:
    return f"SELECT 'expectation' AS \"check\", '{name}' AS subject, CAST(({cond}) AS INT) * 1.0::DOUBLE AS value, ({cond}) AS passed FROM {source}"


_QUERIED = "claim_status = 'QUERY_RAISED'"
_NOT_NEG = "COUNT(CASE WHEN {c} < 0 THEN 1 END) = 0"
_rep = "p_name"
for _w, _f in ABBREVIATIONS.items():
    _rep = f"regexp_replace({_rep}, '\\b{_w}\\b', '{_f}', 'g')"

def _spoilt() -> str:
    """Every row against the row of its key, column by column."""
    copy = ", ".join(f"{x} AS {c}" for c, x in SPOILT.items())
    shared = [c for c in SPOILT if c not in ("claim_id", "batch")]
    numbers = ("amount_claimed", "amount_approved", "settlement_tat_days", "query_count")
    cells = ", ".join(f"CASE WHEN NOT isnan(CAST({a}.{c} AS DOUBLE)) THEN CAST({a}.{c} AS DOUBLE) END AS {a}_{c}" if c in numbers else f"{a}.{c} AS {a}_{c}" for c in shared for a in "om")
    bad = {c: f"alone OR (o_{c} IS DISTINCT FROM m_{c}" + (f" AND NOT COALESCE(abs(o_{c} - m_{c}) <= 1e-6 + 1e-9 * abs(m_{c}), FALSE)" if c in numbers else "") + ")" for c in shared}
    return (f"WITH c AS (SELECT {copy} FROM cm_claim WHERE NOT ({LEFT_OUT})), m AS (SELECT * FROM c UNION ALL SELECT * REPLACE (claim_id || 'n' AS claim_id) FROM c WHERE {TWICE}), "
            f"j AS (SELECT o.claim_id IS NULL OR m.claim_id IS NULL AS alone, {cells} FROM cm_claim o FULL JOIN m ON o.claim_id = m.claim_id), n AS (SELECT (SELECT COUNT(*) FROM cm_claim) - (SELECT COUNT(*) FROM m) AS d) "
            + _union([_rows("rows", "*", "d", "d = 0", "n")] + [f"SELECT '{k}', '{c}', CAST(1 AS DOUBLE), FALSE" for k, c in (("columns", "batch"), ("columns", "preauth_id"), ("type", "query_count"))]
                     + [_rows("value", c, f"COUNT(CASE WHEN {x} THEN 1 END)", f"COUNT(CASE WHEN {x} THEN 1 END) = 0", "j") for c, x in bad.items()]))


SQL: dict[str, str] = {
    "S1_raw_text": "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment FROM customer",
    "S2_declared_types": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, "
                         "o_orderpriority FROM orders",
    "S3_inferred_types": "SELECT * FROM customer",
    "S4_csv_to_parquet": "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment FROM customer",
    "S4_csv_folder": "SELECT name, 'ok' AS status, CAST(columns AS INT) AS columns, row_count FROM (SELECT 'region' AS name, 2 AS columns, (SELECT COUNT(*) FROM region) AS row_count UNION ALL "
                     "SELECT 'nation', 3, (SELECT COUNT(*) FROM nation) UNION ALL SELECT 'supplier', (SELECT COUNT(*) FROM (DESCRIBE supplier)), (SELECT COUNT(*) FROM supplier)) x",
    "S5_stored_types": "SELECT * FROM supplier",
    "S6_written_view": VIEW3,
    "S9_checked_loader": "SELECT r_name, COUNT(*) AS nations FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1",
    "S9_every_table": _union(f"SELECT '{n}' AS name, (SELECT COUNT(*) FROM {n}) AS row_count, CAST(COUNT(*) AS INT) AS column_count FROM (DESCRIBE {n}) d" for n in GIVEN),
    "B1_age_group": f"SELECT beneficiary_id, {AGE_GROUP} AS age_group FROM bm_beneficiary",
    "B1b_age_band": "SELECT beneficiary_id, " + _bands("2026 - yob", [(5, "0-5"), (14, "6-14"), (30, "15-30"), (45, "31-45"), (60, "46-60")], "60+")
                    + " AS age_band FROM bm_beneficiary",
    "B2_period_text": "SELECT case_id, strftime(admission_datetime, '%Y-%m') AS admission_month, year(admission_datetime) || 'Q' || "
                      "quarter(admission_datetime) AS admission_quarter, CAST(year(admission_datetime) AS VARCHAR) AS admission_year FROM cm_case",
    "B2b_length_of_stay": f"SELECT case_id, {_LOS} AS length_of_stay, CAST(floor({_LOS}) AS BIGINT) AS los_days FROM cm_case",
    "B2c_flags": f"SELECT case_id, {_EM} AS is_emergency, {_DE} AS is_death, {_LA} AS is_lama_dama FROM cm_case",
    "B3_disease_category": f"SELECT case_diagnosis_id, {DISEASE} AS disease_category FROM cm_case_diagnosis",
    "B3b_disease_class": f"SELECT case_diagnosis_id, {_class()} AS disease_class FROM (SELECT case_diagnosis_id, icd_code[1] AS l, "
                         "CAST(icd_code[2:] AS INT) AS d FROM cm_case_diagnosis) x",
    "B4_bed_buckets": f"SELECT hospital_id, {BEDS} AS bed_size_bucket, "
                      + _bands("total_bed_strength", [(30, "Small (<30)"), (100, "Medium (30-100)"), (300, "Large (100-300)")], "Very Large (300+)", "<")
                      + " AS capacity_band FROM hm_hospital",
    "B5_licence_expired": f"SELECT hospital_license_id, {EXPIRED} AS is_expired FROM hm_license_certificate",
    "B6_document_bucket": "SELECT beneficiary_id, " + _bands("n", [(0, "NO_DOCS"), (1, "1_DOC"), (3, "2-3_DOCS")], "4+_DOCS")
                          + " AS document_count_bucket FROM (SELECT b.beneficiary_id, COUNT(id_doc_id) AS n FROM bm_beneficiary b LEFT JOIN bm_id_document d "
                          "ON d.beneficiary_id = b.beneficiary_id GROUP BY 1) x",
    "B7_amounts": "SELECT claim_id, amount_claimed - amount_approved AS amount_diff, ROUND(amount_approved / NULLIF(amount_claimed, 0), 9) AS "
                  "approval_ratio FROM cm_claim",
    "B8_safe_div": "SELECT claim_id, ROUND(amount_claimed / NULLIF(query_count, 0), 6) AS ratio FROM cm_claim",
    "B9_aging_bucket": f"SELECT claim_id, " + _bands(f"DATE_DIFF('day', CAST(submitted_at AS DATE), {ASOF})",
                                                    [(30, "0-30 days"), (60, "31-60 days"), (90, "61-90 days"), (180, "91-180 days")], "180+ days")
                       + " AS bucket FROM cm_claim WHERE claim_status = 'PENDING'",
    "B10_age_bucket": "SELECT beneficiary_id, " + _bands(f"year({ASOF}) - COALESCE(yob, year(dob))", [(18, "0-17"), (46, "18-45"), (66, "46-65")],
                                                         "65+", "<") + " AS age_bucket FROM bm_beneficiary",
    "B11_validity": f"SELECT hospital_license_id, CASE WHEN expiry_date IS NULL THEN 'OPEN' WHEN expiry_date >= {ASOF} THEN 'CURRENT' ELSE 'EXPIRED' "
                    "END AS status FROM hm_license_certificate",
    "B12_normalise": f"SELECT p_partkey, 'what is ' || lower({_rep}) AS text FROM part",
    "B12_normalise_documents": "SELECT doc_id, md5(t) AS digest, CAST(length(t) AS INT) AS n FROM (SELECT doc_id, trim(regexp_replace(lower(trim("
                               "regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g'))), '[?.!]+$', '')) AS t FROM documents) x",
    "B13_parse_number": "SELECT o_orderkey, o_totalprice AS v FROM orders",
    "B14_scalar_builtins": f"SELECT o_orderkey, ROUND(o_totalprice, 0) AS rounded, ABS(-o_totalprice) AS absolute, CAST(CEIL(o_totalprice) AS BIGINT) AS "
                           "ceiling, NULLIF(o_orderstatus, 'F') AS not_f, COALESCE(NULLIF(o_orderstatus, 'F'), 'none') AS filled, "
                           f"DATE_DIFF('day', CAST(o_orderdate AS DATE), {ASOF}) AS days, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month, "
                           "quarter(o_orderdate) AS quarter, o_orderpriority ILIKE '%high%' AS is_high, upper(trim(o_orderpriority[3:22])) AS priority, "
                           "strftime(o_orderdate, '%Y-%m') AS ym, CAST(epoch(o_orderdate) AS BIGINT) AS epoch FROM orders",
    "D1_first_row": _last("cm_claim", "case_id", "submitted_at, claim_id", "claim_id, claim_status, amount_claimed"),
    "D2_latest_row": _last("bm_card", "beneficiary_id", "issued_at DESC NULLS LAST, card_id DESC", "card_id, card_status"),
    "D3_latest_excluding": _last("cm_preauth_request", "case_id", "initiated_at DESC, preauth_id DESC", "preauth_id, status",
                                 " WHERE status NOT IN ('REJECTED', 'PENDING')"),
    "D4_primary_row": "SELECT case_id, icd_code FROM cm_case_diagnosis WHERE diagnosis_rank = 1",
    "D5_modal_value": "SELECT claim_id, MIN(CASE WHEN rn = 1 AND k > 0 THEN reason_category END) AS reason_category FROM (SELECT claim_id, "
                      "reason_category, COUNT(reason_category) AS k, ROW_NUMBER() OVER (PARTITION BY claim_id ORDER BY COUNT(reason_category) DESC, "
                      "reason_category) AS rn FROM cm_adjudication_event GROUP BY 1, 2) x GROUP BY 1",
    "D6_worst_status": "SELECT case_id, CASE MAX(CASE claim_status WHEN 'REJECTED' THEN 5 WHEN 'QUERY_RAISED' THEN 4 WHEN 'PENDING' THEN 3 WHEN "
                       "'APPROVED' THEN 2 WHEN 'SETTLED' THEN 1 END) WHEN 5 THEN 'REJECTED' WHEN 4 THEN 'QUERY_RAISED' WHEN 3 THEN 'PENDING' WHEN 2 THEN "
                       "'APPROVED' WHEN 1 THEN 'SETTLED' END AS worst FROM cm_claim GROUP BY 1",
    "D7_first_non_null": "SELECT claim_id, MIN(reason_category) AS reason_category, MIN(actor_role) AS actor_role FROM cm_adjudication_event GROUP BY 1",
    "Q1_row_counts": _union(_rows("row_count", n, f"ROUND(ABS(COUNT(*) - {k}) / CAST({k} AS DOUBLE) * 100.0, 6)",
                                  f"ROUND(ABS(COUNT(*) - {k}) / CAST({k} AS DOUBLE) * 100.0, 6) < 20", n) for n, k in EXPECTED_ROWS.items()),
    "Q2_unique_keys": _union(_unique(n, k) for n, k in schema.PRIMARY_KEYS.items()),
    "Q3_orphans": _union(_orphan(*fk) for fk in schema.FOREIGN_KEYS),
    "Q4_null_rates": _null_rates(),
    "Q5_value_domains": _union(_domain(n, c, a) for (n, c), a in schema.DOMAINS.items()),
    "Q6_date_spans": _union(_span(n, c) for n, c in schema.DATE_SPANS),
    "Q7_view_grain": _union([_grain("view1", VIEW1, "case_id", 15000), _grain("view2", VIEW2, "district, month", at_least=1000),
                             _grain("view3", VIEW3, "hospital_id, specialty_code", at_least=200), _grain("view4", VIEW4, "beneficiary_id", 2000)]),
    "Q8_profile": _union(f"SELECT '{c}' AS \"column\", COUNT(DISTINCT {c}) AS n_distinct, COUNT(*) - COUNT({c}) AS n_null, CAST(MIN({c}) AS VARCHAR) AS "
                         f"min_value, CAST(MAX({c}) AS VARCHAR) AS max_value FROM hm_hospital" for c in _HCOLS),
    "Q8b_top_values": f"WITH v AS ({VIEW1}), u AS (" + _union(f"SELECT '{c}' AS \"column\", {c} AS value, COUNT(*) AS n FROM v GROUP BY 2" for c in _TOPCOLS)
                      + ") SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY \"column\" ORDER BY n DESC, value NULLS LAST) AS rank FROM u) x WHERE rank <= 5",
    "Q8b_measure_stats": f"WITH v AS ({VIEW1}) " + _union(
        f"SELECT '{c}' AS measure, ROUND(MIN({c}), 2) AS min, ROUND(AVG({c}), 2) AS mean, ROUND(quantile_cont({c}, 0.5), 2) AS median, ROUND(MAX({c}), 2) AS "
        f"max, ROUND(STDDEV({c}), 2) AS std, COUNT(*) - COUNT({c}) AS nulls FROM v" for c in _STATCOLS),
    "Q9_view_expectations": f"WITH v1 AS ({VIEW1}), v2 AS ({VIEW2}), v3 AS ({VIEW3}) " + _union(
        [_expect(f"{c} is not negative", _NOT_NEG.format(c=c), "v1") for c in ("amount_claimed", "amount_approved", "amount_paid")]
        + [_expect("gender balance", "AVG(CASE WHEN gender = 'M' THEN 1.0 WHEN gender IS NOT NULL THEN 0.0 END) BETWEEN 0.3 AND 0.7", "v1"),
           _expect("public hospitals present", "COUNT(CASE WHEN hospital_type = 'PUBLIC' THEN 1 END) > 0", "v1"),
           _expect("approval rate within 0 and 1", "COUNT(CASE WHEN approval_rate NOT BETWEEN 0 AND 1 THEN 1 END) = 0", "v2"),
           _expect("rate per 1000 is not negative", _NOT_NEG.format(c="claims_per_1000_beneficiaries"), "v2"),
           _expect("idle specialties present", "COUNT(CASE WHEN zero_claim_flag = 1 THEN 1 END) > 0", "v3"),
           _expect("used specialties present", "COUNT(CASE WHEN cases_treated > 0 THEN 1 END) > 0", "v3"),
           _expect("coverage of cases", "SUM(cases_treated) * 100.0 / (SELECT COUNT(*) FROM cm_case) > 20", "v3"),
           _expect("share of NCD", f"AVG(CASE WHEN {DISEASE} = 'NCD' THEN 1.0 ELSE 0.0 END) > 0.2", "cm_case_diagnosis")]),
    "Q10_time_order": _union([
        _rows("time_order", "household before person", hits("h.created_at > b.created_at"), f"{hits('h.created_at > b.created_at')} = 0",
              "bm_beneficiary b LEFT JOIN bm_household h ON h.household_id = b.household_id"),
        _rows("time_order", "person before card", hits("b.created_at > c.issued_at"), f"{hits('b.created_at > c.issued_at')} = 0",
              "bm_card c LEFT JOIN bm_beneficiary b ON b.beneficiary_id = c.beneficiary_id"),
        _rows("time_order", "card before admission", hits("c.issued_at >= a.at"), f"{hits('c.issued_at >= a.at')} = 0",
              "bm_card c LEFT JOIN (SELECT beneficiary_id, MIN(admission_datetime) AS at FROM cm_case GROUP BY 1) a ON a.beneficiary_id = c.beneficiary_id")]),
    "Q11_parity": "SELECT 'rows' AS \"check\", '*' AS subject, CAST(0 AS DOUBLE) AS value, TRUE AS passed UNION ALL " + _union(
        [_rows("value", c, "0 * COUNT(*)", "TRUE", "cm_claim") for c in ("claim_status", "amount_claimed", "amount_approved")]
        + [_rows("value", "query_count", hits(_QUERIED), f"{hits(_QUERIED)} = 0", "cm_claim")]),
    "Q11_parity_of_all_columns": _spoilt(),
    "Q12_strict": _union([_unique("cm_case", "case_id"), _domain("cm_case", "admission_type", ("EMERGENCY", "ELECTIVE"))]),
    "R1_date_into_window": "SELECT card_id, strftime(CASE WHEN bad AND lo < hi THEN make_timestamp(CAST(epoch_us(lo) + floor((epoch_us(hi) - epoch_us(lo)) / 2) AS "
                           "BIGINT)) WHEN bad THEN lo ELSE issued_at END, '%Y-%m-%d %H:%M:%S') AS issued_at FROM (SELECT card_id, issued_at, b.created_at + INTERVAL "
                           "1 DAY AS lo, first_at - INTERVAL 1 DAY AS hi, COALESCE(issued_at >= first_at, FALSE) AS bad FROM bm_card c JOIN bm_beneficiary b ON "
                           "b.beneficiary_id = c.beneficiary_id LEFT JOIN (SELECT beneficiary_id, MIN(admission_datetime) AS first_at FROM cm_case GROUP BY 1) a ON "
                           "a.beneficiary_id = c.beneficiary_id) x",
    "R2_missing_offers": f"SELECT hospital_id, specialty_code, case_count FROM (SELECT *, SUM(case_count) OVER (PARTITION BY hospital_id ORDER BY case_count DESC, "
                         "specialty_code ROWS UNBOUNDED PRECEDING) - case_count AS before, SUM(case_count) OVER (PARTITION BY hospital_id) AS whole FROM (SELECT "
                         f"hospital_id, specialty_code, COUNT(*) AS case_count FROM {_TREATED} t GROUP BY 1, 2) c) x WHERE before < whole * 0.95 AND NOT EXISTS "
                         "(SELECT 1 FROM hm_specialty_offered o WHERE o.hospital_id = x.hospital_id AND o.specialty_code = x.specialty_code)",
    "R3_offer_coverage": f"SELECT {isum('f')} AS covered, COUNT(*) AS cases, ROUND(CAST(SUM(f) AS DOUBLE) / COUNT(*) * 100.0, 4) AS coverage_pct FROM (SELECT CASE WHEN "
                         "EXISTS (SELECT 1 FROM hm_specialty_offered o WHERE o.hospital_id = t.hospital_id AND o.specialty_code = t.specialty_code) THEN 1 ELSE 0 END "
                         f"AS f FROM {_TREATED} t) x",
    "V1_claims_lifecycle": VIEW1,
    "V2_district_month_cube": VIEW2,
    "V3_hospital_performance": VIEW3,
    "V4_beneficiary_journey": VIEW4,
}
_CHECKED = ("Q1_row_counts", "Q2_unique_keys", "Q3_orphans", "Q4_null_rates", "Q5_value_domains", "Q6_date_spans", "Q10_time_order")
SQL["Q12_strict_run"] = ("WITH k AS (" + _union(f'SELECT "check", subject, value, passed FROM ({SQL[q]}) x' for q in _CHECKED)
                         + ") SELECT * FROM k WHERE NOT passed OR (SELECT bool_and(passed) FROM k)")


def foundation_sql() -> dict[str, str]:
    return {k: complete(v) for k, v in SQL.items()}
