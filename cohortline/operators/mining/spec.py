"""What to mine: the dimensions, time grains and measures of a view, and the thresholds."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations


@dataclass(frozen=True)
class Measure:
    name: str
    agg: str = "sum"


@dataclass(frozen=True)
class ViewSpec:
    name: str
    dimensions: tuple[str, ...]
    temporal: tuple[str, ...]
    measures: tuple[Measure, ...]
    impact: tuple[str, ...]
    depth: int = 2
    tau: float = 0.5
    min_impact: float = 0.01
    min_members: int = 3

    @property
    def columns(self) -> tuple[str, ...]:
        return self.dimensions + self.temporal

    def column_sets(self) -> list[frozenset[str]]:
        """Every set of columns some subspace and breakdown need, once, whichever column plays which part."""
        sets = {frozenset(c) for k in range(self.depth + 2) for c in combinations(self.dimensions, k)}
        sets |= {frozenset(c) | {t} for t in self.temporal for k in range(self.depth + 1)
                 for c in combinations(self.dimensions, k)}
        return sorted(sets, key=lambda s: (len(s), sorted(s)))

    def blocks(self, width: int, sets: list | None = None) -> list[tuple[list[str], list[list[str]]]]:
        """The column sets (all, or those given) in groups that fit into ``width`` columns: (columns, sets) per group.

        A group is grown from the largest set not yet placed, by the column that
        brings in most sets; each set is placed once, so a group of some sets has no other columns than theirs.
        """
        order = {c: i for i, c in enumerate(self.columns)}
        left = {frozenset(s) for s in (self.column_sets() if sets is None else sets)}
        known = {c for s in left for c in s}
        out = []
        while left:
            block = set(max(left, key=lambda s: (len(s), tuple(-order[c] for c in sorted(s, key=order.get)))))
            while len(block) < width:
                gain = {c: sum(s <= block | {c} for s in left) for c in self.columns if c in known and c not in block}
                if not gain:
                    break
                block.add(max(gain, key=lambda c: (gain[c], -order[c])))
            inside = {s for s in left if s <= block}
            left -= inside
            out.append((sorted(block, key=order.get),
                        [sorted(s, key=order.get) for s in sorted(inside, key=lambda s: (len(s), sorted(s)))]))
        return out


def _sum(*names: str) -> tuple[Measure, ...]:
    return tuple(Measure(n) for n in names)


def _avg(*names: str) -> tuple[Measure, ...]:
    return tuple(Measure(n, "avg") for n in names)


CLAIMS_LIFECYCLE = ViewSpec(
    "Claims Lifecycle",
    ("division", "district", "hospital_type", "hospital_sub_type", "specialty_code", "disease_category", "gender",
     "age_group", "admission_type", "discharge_type", "claim_status", "preauth_status", "bed_size_bucket"),
    ("admission_month", "admission_quarter", "admission_year"),
    _sum("case_count", "amount_claimed", "amount_approved", "amount_paid") + _avg("length_of_stay")
    + _sum("is_emergency", "is_death", "is_lama_dama") + _avg("settlement_tat_days")
    + _sum("query_count", "base_amount", "computed_final_amount"),
    ("case_count", "amount_claimed", "amount_paid"),
)

DISTRICT_MONTH_CUBE = ViewSpec(
    "District-Month Performance Cube",
    ("division", "district"),
    ("month", "quarter", "year"),
    _sum("new_beneficiaries", "new_households", "cases_admitted", "emergency_cases", "portability_cases", "deaths",
         "lama_dama_cases", "public_cases", "private_cases") + _avg("unique_hospitals")
    + _sum("cards_issued", "claims_submitted", "claims_approved", "claims_rejected", "amount_claimed", "amount_approved",
           "amount_paid", "payment_count", "payment_failures")
    + _avg("cumulative_beneficiaries", "claims_per_1000_beneficiaries", "approval_rate", "emergency_share", "death_rate",
           "public_private_ratio", "avg_claim_amount"),
    ("cases_admitted", "amount_claimed", "cumulative_beneficiaries"),
    depth=1,
)

HOSPITAL_PERFORMANCE = ViewSpec(
    "Hospital Performance",
    ("specialty_code", "division", "district", "hospital_type", "hospital_sub_type", "bed_size_bucket"),
    (),
    _sum("admissions_prev_fy", "admissions_before_last_year", "total_bed_strength", "inpatient_beds", "cases_treated",
         "preauth_approved", "preauth_rejected", "claims_approved", "amount_claimed", "amount_approved", "amount_paid",
         "emergency_count", "death_count")
    + _avg("total_staff", "avg_experience_years", "total_licenses", "expired_licenses", "active_licenses")
    + _sum("zero_claim_flag") + _avg("cases_per_bed"),
    ("total_bed_strength", "cases_treated", "amount_paid"),
)

BENEFICIARY_JOURNEY = ViewSpec(
    "Beneficiary Journey",
    ("division", "district", "gender", "age_group", "entitlement_source", "bis_record_status", "enrolment_status",
     "card_status", "document_count_bucket"),
    (),
    _avg("document_count", "has_aadhaar") + _sum("claim_count", "has_claim")
    + _avg("claim_rate", "days_enrolment_to_card", "days_card_to_first_claim"),
    ("has_claim", "claim_count"),
)
