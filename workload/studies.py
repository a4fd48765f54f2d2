"""Gap and peer studies; the study tables are written once per session, as the studies define them."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cohortline.functions.numbers import rnd
from cohortline.plans.gap import GapStudy
from cohortline.plans.peers import PeerStudy

from .common import Query, bound

_STUDIES: dict[tuple[str, str], dict[int, GapStudy | PeerStudy]] = {}
_LOCK = threading.RLock()


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to six places, so that sums in another order compare."""
    return df.withColumns({f.name: rnd(f.name, 6) for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)})


def study(kind: int, name: str) -> Query:
    """Only peer studies (kind 1) need the hospital performance table: it is not written for the others."""
    def build(t):
        key = (t.spark.sparkContext.applicationId, t.directory)
        with _LOCK:
            made = _STUDIES.setdefault(key, {})
            if 0 not in made:
                made[0] = GapStudy(t)
            if kind not in made:
                made[kind] = PeerStudy(made[0].hospital_performance)
            found = getattr(made[kind], name)
        return tidy(found() if callable(found) else found)

    return bound(build)


GAP = {
    "G0a_claims_per_case": "claims_per_case", "G0b_demand_supply": "demand_supply", "G0c_hospital_performance": "hospital_performance",
    "G0d_enrolment_monthly": "enrolment_monthly", "G0e_specialty_gap": "specialty_gap", "G1_utilisation_scores": "utilisation",
    "G2_specialty_matrix": "specialty_matrix", "G3_disease_burden": "disease_burden", "G4a_block_flows": "block_flows",
    "G4b_district_flows": "district_flows", "G5_card_dropoff": "card_dropoff", "G6_repeat_use": "repeat_use",
    "G7a_seasonal_patterns": "seasonal_patterns", "G7b_seasonal_summary": "seasonal_summary", "G8_delisted_impact": "delisted",
    "G9_division_rollup": "division_rollup", "G10_district_rollup": "district_rollup", "G11_priority_blocks": "priority_blocks",
    "G11_gap_annex": "gap_annex", "G12_headline": "headline", "G12_leakage_by_specialty": "leakage_by_specialty",
    "G12_top_blocks": "top_blocks",
}
PEERS = {
    "P0_pair_summary": "summary", "P1_P4_cost": "cost", "P2_P5_stay": "stay", "P3_P6_outcomes": "outcomes", "P7_claims_quality": "quality",
    "P8_trends": "trends", "P9_scorecard": "scorecard",
}


def study_queries() -> dict[str, Query]:
    return {**{k: study(0, v) for k, v in GAP.items()}, **{k: study(1, v) for k, v in PEERS.items()}}
