"""From a view to scored candidates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...runtime import cut_lineage
from . import groups, scopes, scoring
from .patterns import evaluate
from .spec import ViewSpec


@dataclass
class Mined:
    spec: ViewSpec
    cells: DataFrame
    spaces: DataFrame
    scopes: DataFrame
    evaluated: DataFrame
    members: DataFrame
    candidates: DataFrame


def mine(view: DataFrame, spec: ViewSpec, gamma: float = scoring.GAMMA, width: int = 6) -> Mined:
    """Evaluate everything: no time budget, so the result does not depend on the machine.

    What is read several times is written to the checkpoint folder once: the
    columns of the view that matter (one read per group of column sets), the
    cells, the evaluated scopes, and the candidates.
    """
    narrow = cut_lineage(view.select(*spec.columns, *dict.fromkeys(m.name for m in spec.measures)))
    cells = cut_lineage(scopes.cells(narrow, spec, width))
    spaces = scopes.subspaces(cells, spec)
    spread = scopes.distributions(cells, spec, scopes.live_filters(spaces, spec))
    evaluated = cut_lineage(evaluate(spread).drop("dist"))
    rows = groups.members(evaluated, spaces, spec)
    common = groups.triggered(groups.commonness(rows, spec), evaluated, spaces, spec)
    told = groups.exceptions(common, rows, spaces, spec)
    candidates = cut_lineage(scoring.scored(told, spaces, spec, gamma))
    return Mined(spec, cells, spaces, spread, evaluated, rows, candidates)


def flat(candidates: DataFrame) -> DataFrame:
    """Candidates with their nested parts as text and counts."""
    sets = F.array_join(F.transform("commonness", lambda s: F.concat(
        F.array_join(s["highlight"], ","), F.lit(":"), s["count"].cast("string"))), ";")
    return candidates.select(
        "strategy", "ext_dim", "pattern_type", "breakdown", "measure", scopes.subspace_text("base").alias("base"), "hdp_size",
        sets.alias("common"), *[groups.count_of(c).alias(f"n_{c.lower()}") for c in scoring.CATEGORIES],
        *[c for c in ("conciseness", "impact", "impact_measure", "score") if c in candidates.columns])
