"""Declared types, keys and references of the operational model.

Every column not listed under a table is text; identifiers are text.
"""

from __future__ import annotations

# Column casts per table.
CASTS: dict[str, dict[str, str]] = {
    "ref_up_geography": {},
    "ref_hbp_procedure_master": {
        "base_package_price": "float", "has_stratification": "bool", "has_implant_or_high_end": "bool",
        "reserved_public_hospitals_only": "bool"},
    "bm_household": {"created_at": "timestamp"},
    "bm_beneficiary": {"dob": "timestamp", "created_at": "timestamp", "updated_at": "timestamp", "yob": "int",
                       "is_duplicate": "bool"},
    "bm_id_document": {"created_at": "timestamp"},
    "bm_enrolment_request": {"submitted_at": "timestamp", "reviewed_at": "timestamp"},
    "bm_card": {"issued_at": "timestamp"},
    "hm_hospital": {
        "total_bed_strength": "int", "inpatient_beds": "int", "delisted_from_gov_schemes": "bool",
        "has_fully_equipped_ot": "bool", "has_icu_with_ac": "bool", "has_casualty": "bool", "has_opd": "bool",
        "has_hdu": "bool", "has_general_ward": "bool", "has_labour_room": "bool", "created_at": "timestamp",
        "updated_at": "timestamp"},
    "hm_hospital_bank_account": {"tds_exemption": "bool"},
    "hm_license_certificate": {"issue_date": "date", "expiry_date": "date"},
    "hm_specialty_offered": {"admissions_prev_fy": "int", "admissions_before_last_year": "int"},
    "hm_staff": {"experience_years": "float"},
    "cm_case": {"is_portability": "bool", "admission_datetime": "timestamp", "discharge_datetime": "timestamp",
                "created_at": "timestamp"},
    "cm_case_diagnosis": {"diagnosis_rank": "int"},
    "cm_preauth_request": {"initiated_at": "timestamp", "ppd_decision_at": "timestamp", "last_query_at": "timestamp",
                           "last_query_response_at": "timestamp", "cancelled_at": "timestamp"},
    "cm_preauth_procedure_line": {
        "procedure_rank": "int", "stratification_amount": "float", "implant_amount": "float",
        "incentive_amount": "float", "base_amount": "float", "computed_final_amount": "float",
        "expected_payable_amount": "float", "payout_factor": "float", "is_addon": "bool"},
    "cm_discharge": {"surgery_date": "timestamp", "discharge_date": "timestamp", "lama_date": "timestamp",
                     "death_date": "timestamp", "provided_medicines_flag": "bool", "biometric_auth_used": "bool"},
    "cm_claim": {"submitted_at": "timestamp", "settled_at": "timestamp", "hospital_bill_date": "date",
                 "amount_claimed": "float", "amount_approved": "float", "query_count": "int",
                 "settlement_tat_days": "float", "is_portability_claim": "bool"},
    "cm_claim_document": {"uploaded_at": "timestamp"},
    "cm_adjudication_event": {"event_time": "timestamp"},
    "cm_payment": {"payment_date": "timestamp", "amount_paid": "float"},
}

# Primary keys.
PRIMARY_KEYS: dict[str, str] = {
    "bm_household": "household_id",
    "bm_beneficiary": "beneficiary_id",
    "bm_id_document": "id_doc_id",
    "bm_enrolment_request": "enrolment_request_id",
    "bm_card": "card_id",
    "hm_hospital": "hospital_id",
    "hm_hospital_bank_account": "hospital_bank_id",
    "hm_license_certificate": "hospital_license_id",
    "hm_specialty_offered": "hospital_specialty_id",
    "hm_staff": "staff_id",
    "cm_case": "case_id",
    "cm_case_diagnosis": "case_diagnosis_id",
    "cm_preauth_request": "preauth_id",
    "cm_preauth_procedure_line": "preauth_proc_id",
    "cm_discharge": "discharge_id",
    "cm_claim": "claim_id",
    "cm_claim_document": "claim_doc_id",
    "cm_adjudication_event": "event_id",
    "cm_payment": "payment_id",
    "ref_hbp_procedure_master": "hbp_procedure_code",
}

# References, as (child, child column, parent, parent column).
FOREIGN_KEYS: list[tuple[str, str, str, str]] = [
    ("bm_beneficiary", "household_id", "bm_household", "household_id"),
    ("bm_id_document", "beneficiary_id", "bm_beneficiary", "beneficiary_id"),
    ("bm_enrolment_request", "beneficiary_id", "bm_beneficiary", "beneficiary_id"),
    ("bm_card", "beneficiary_id", "bm_beneficiary", "beneficiary_id"),
    ("hm_hospital_bank_account", "hospital_id", "hm_hospital", "hospital_id"),
    ("hm_license_certificate", "hospital_id", "hm_hospital", "hospital_id"),
    ("hm_specialty_offered", "hospital_id", "hm_hospital", "hospital_id"),
    ("hm_staff", "hospital_id", "hm_hospital", "hospital_id"),
    ("cm_case", "beneficiary_id", "bm_beneficiary", "beneficiary_id"),
    ("cm_case", "hospital_id", "hm_hospital", "hospital_id"),
    ("cm_case_diagnosis", "case_id", "cm_case", "case_id"),
    ("cm_preauth_request", "case_id", "cm_case", "case_id"),
    ("cm_preauth_procedure_line", "preauth_id", "cm_preauth_request", "preauth_id"),
    ("cm_preauth_procedure_line", "hbp_procedure_code", "ref_hbp_procedure_master", "hbp_procedure_code"),
    ("cm_preauth_procedure_line", "clinician_staff_id", "hm_staff", "staff_id"),
    ("cm_claim", "case_id", "cm_case", "case_id"),
    ("cm_claim", "preauth_id", "cm_preauth_request", "preauth_id"),
    ("cm_claim_document", "claim_id", "cm_claim", "claim_id"),
    ("cm_adjudication_event", "claim_id", "cm_claim", "claim_id"),
    ("cm_payment", "claim_id", "cm_claim", "claim_id"),
    ("cm_payment", "hospital_bank_id", "hm_hospital_bank_account", "hospital_bank_id"),
]

# Value domains.
DOMAINS: dict[tuple[str, str], list[str]] = {
    ("bm_beneficiary", "gender"): ["M", "F"],
    ("cm_case", "admission_type"): ["EMERGENCY", "ELECTIVE"],
    ("cm_case", "discharge_type"): ["NORMAL", "LIVE", "LAMA", "DAMA", "DEATH"],
    ("cm_claim", "claim_status"): ["APPROVED", "SETTLED", "QUERY_RAISED", "REJECTED", "PENDING"],
    ("hm_hospital", "hospital_type"): ["PUBLIC", "PRIVATE"],
}

# Columns whose span in years must be plausible.
DATE_SPANS: list[tuple[str, str]] = [
    ("cm_case", "admission_datetime"),
    ("cm_case", "discharge_datetime"),
    ("cm_claim", "submitted_at"),
    ("cm_claim", "settled_at"),
    ("bm_beneficiary", "created_at"),
    ("cm_payment", "payment_date"),
]
