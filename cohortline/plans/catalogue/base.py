"""Vocabulary shared by the question families: the joined model, aggregate shorthands, and the registry."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.numbers import pct, per, rnd
from ...runtime import cut_lineage

__all__ = [
    "Model", "StoredModel", "Question", "QUESTIONS", "reg", "at", "either", "HOME", "SITE", "CARE",
    "n", "n_if", "nd", "nd_if", "total", "mean", "quantile", "days", "month_of", "share",
    "top", "ordered", "pct", "per", "rnd", "agg_by", "named_hospital",
]

# Residence, hospital-registry and case-record geography, by level.
HOME = {"division": "home_division_name", "district": "home_district_code", "block": "home_block_name"}
SITE = {"division": "division_name", "district": "district_name", "block": "block_name", "hospital": "hospital_name"}
CARE = {"division": "hospital_division", "district": "hospital_district"}

_ADMISSION = ("cm_case", "admission_datetime")
DATE_COLUMNS = {
    "admission": _ADMISSION,
    "submission": ("cm_claim", "submitted_at"),
    "preauth": ("cm_preauth_request", "initiated_at"),
}


class Model:
    """The model tables plus the joins that most questions start from.

    ``dates`` restricts one date column of one base table to a closed range, so
    that the filter reaches the scan ahead of every join and branch.
    """

    def __init__(self, tables, dates: tuple[str, str, str, str] | None = None):
        self._tables = tables
        self._dates = dates

    def table(self, name: str) -> DataFrame:
        df = getattr(self._tables, name)
        if self._dates and self._dates[0] == name:
            _, column, first, last = self._dates
            df = df.where(F.to_date(column).between(F.lit(first).cast("date"), F.lit(last).cast("date")))
        return df

    def within(self, kind: str, first: str, last: str) -> Model:
        return Model(self._tables, (*DATE_COLUMNS[kind], first, last))

    @cached_property
    def households(self) -> DataFrame:
        return self.table("bm_household").drop("created_at")

    @cached_property
    def members(self) -> DataFrame:
        return self.table("bm_beneficiary").drop("created_at", "updated_at").join(self.households, "household_id")

    @cached_property
    def hospitals(self) -> DataFrame:
        return self.table("hm_hospital").drop("created_at", "updated_at")

    @cached_property
    def procedures(self) -> DataFrame:
        return self.table("ref_hbp_procedure_master")

    @cached_property
    def cases(self) -> DataFrame:
        return self.table("cm_case").drop("created_at")

    @cached_property
    def site_cases(self) -> DataFrame:
        return self.cases.join(self.hospitals, "hospital_id")

    @cached_property
    def home_cases(self) -> DataFrame:
        return self.cases.join(self.members, "beneficiary_id")

    @cached_property
    def claims(self) -> DataFrame:
        return self.table("cm_claim")

    @cached_property
    def case_claims(self) -> DataFrame:
        return self.claims.join(self.cases, "case_id")

    @cached_property
    def preauths(self) -> DataFrame:
        return self.table("cm_preauth_request")

    @cached_property
    def lines(self) -> DataFrame:
        """Procedure lines with their procedure and the case they belong to (no case columns but its id)."""
        return (
            self.table("cm_preauth_procedure_line")
            .join(self.preauths.select("preauth_id", "case_id"), "preauth_id")
            .join(self.procedures, "hbp_procedure_code")
        )

    @cached_property
    def case_lines(self) -> DataFrame:
        return self.lines.join(self.cases, "case_id")

    @cached_property
    def primary_dx(self) -> DataFrame:
        return self.table("cm_case_diagnosis").where(F.col("diagnosis_type") == "PRIMARY")

    @cached_property
    def case_dx(self) -> DataFrame:
        return self.primary_dx.join(self.cases, "case_id")

    @cached_property
    def exits(self) -> DataFrame:
        return self.table("cm_discharge")

    @cached_property
    def case_exits(self) -> DataFrame:
        return self.exits.join(self.cases, "case_id")

    @cached_property
    def payments(self) -> DataFrame:
        """Payments with the case of their claim."""
        return self.table("cm_payment").join(
            self.claims.select("claim_id", "case_id", "claim_status", "settled_at"), "claim_id"
        )

    @cached_property
    def case_payments(self) -> DataFrame:
        return self.payments.join(self.cases, "case_id")

    @cached_property
    def claim_totals(self) -> DataFrame:
        """One row per case that has claims: counts and sums, so that a case never fans out when joined."""
        status = F.col("claim_status")
        return self.claims.groupBy("case_id").agg(
            F.count(F.lit(1)).alias("n_claims"),
            F.sum("amount_claimed").alias("claimed"),
            F.sum("amount_approved").alias("approved"),
            F.sum("settlement_tat_days").alias("tat_sum"),
            F.count("settlement_tat_days").alias("tat_n"),
            F.count(F.when(status == "REJECTED", 1)).alias("n_rejected"),
            F.count(F.when(status.isin("APPROVED", "SETTLED"), 1)).alias("n_passed"),
        )

    @cached_property
    def claimed_cases(self) -> DataFrame:
        """Every case, with the totals of its claims where it has any."""
        return self.cases.join(self.claim_totals, "case_id", "left")


class StoredModel(Model):
    """The same for many questions at once: tables and joins that several of them start from are written when first asked for, and read from then on.

    Questions may be asked from several threads: each join is written by the first that needs it.
    """

    STORED = ("members", "cases", "home_cases", "case_claims", "case_lines", "case_dx", "case_exits", "case_payments", "claimed_cases")
    TABLES = ("cm_claim", "cm_preauth_request", "cm_preauth_procedure_line")

    def __init__(self, tables):
        super().__init__(tables)
        self._locks = {name: threading.Lock() for name in (*self.STORED, *self.TABLES)}
        self._written: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self._once(name, lambda: super(StoredModel, self).table(name)) if name in self.TABLES else super().table(name)

    def _stored(self, name: str) -> DataFrame:
        return self._once(name, lambda: Model.__dict__[name].func(self))

    def _once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        with self._locks[name]:
            if name not in self._written:
                self._written[name] = cut_lineage(build())
            return self._written[name]


for _name in StoredModel.STORED:
    setattr(StoredModel, _name, property(lambda self, name=_name: self._stored(name)))


@dataclass(frozen=True)
class Question:
    qid: str
    family: str
    params: tuple[str, ...]
    build: Callable = field(repr=False)
    dated: str | None

    def run(self, model: Model, **params) -> DataFrame:
        missing = [p for p in self.params if p not in params]
        if missing:
            raise ValueError(f"{self.qid} needs {', '.join(missing)}")
        return self.build(model, params)


QUESTIONS: dict[str, Question] = {}


def reg(qid: str, family: str, params: str, build: Callable, dated: str | None = "admission") -> None:
    """Register one question; ``params`` is a space-separated list of the names it needs."""
    if qid in QUESTIONS:
        raise ValueError(f"{qid} is registered twice")
    QUESTIONS[qid] = Question(qid, family, tuple(params.split()), build, dated if qid.startswith("T") else None)


def at(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(column) == F.lit(value))


def either(df: DataFrame, column: str, p: dict, name: str = "district") -> DataFrame:
    """Rows of the two entities under comparison."""
    return df.where(F.col(column).isin(p[name], p[f"{name}_2"]))


def agg_by(df: DataFrame, by, *aggs: Column) -> DataFrame:
    """Group by expressions such as ``"hospital_district as district"``; no keys means one overall row."""
    keys = [F.expr(k) if isinstance(k, str) else k for k in ([by] if isinstance(by, str) else by or [])]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def n(name: str, column=None) -> Column:
    return F.count(F.lit(1) if column is None else column).alias(name)


def n_if(cond: Column, name: str) -> Column:
    return F.count(F.when(cond, F.lit(1))).alias(name)


def nd(column: str, name: str) -> Column:
    return F.countDistinct(column).alias(name)


def nd_if(cond: Column, column: str, name: str) -> Column:
    return F.countDistinct(F.when(cond, F.col(column))).alias(name)


def total(column, name: str, digits: int = 2) -> Column:
    return rnd(F.sum(column), digits).alias(name)


def mean(column, name: str, digits: int = 1) -> Column:
    return rnd(F.avg(column), digits).alias(name)


def quantile(column, p: float, name: str, digits: int = 1) -> Column:
    """Exact percentile. The columns it serves are day counts and rates on small groups of distinct values,
    which is what bounds its value-to-count state."""
    return rnd(F.percentile(column, F.lit(p)), digits).alias(name)


def days(first: str, last: str) -> Column:
    return F.datediff(F.col(last), F.col(first))


def month_of(column: str) -> Column:
    return F.trunc(F.col(column), "month")


def share(df: DataFrame, column: str, name: str, digits: int = 2, within: str | None = None) -> DataFrame:
    """Add ``column`` as a percentage of its total, overall or per ``within`` key.

    The total is a second, one-row (or one-row-per-key) aggregate of the grouped
    result, so no window has to pull every group into one task.
    """
    if within is None:
        whole = df.agg(F.sum(column)).scalar()
        return df.withColumn(name, pct(F.col(column), whole, digits))
    sums = df.groupBy(F.col(within).alias("_k")).agg(F.sum(column).alias("_whole"))
    joined = df.join(sums, df[within].eqNullSafe(sums["_k"]))
    return joined.withColumn(name, pct(column, "_whole", digits)).drop("_k", "_whole")


def _direction(spec: str) -> Column:
    return F.col(spec[1:]).desc_nulls_last() if spec.startswith("-") else F.col(spec).asc_nulls_last()


def ordered(df: DataFrame, *order: str) -> DataFrame:
    """Sort by the named columns; a leading minus means descending. Nulls last."""
    return df.orderBy(*[_direction(o) for o in order])


def top(df: DataFrame, limit: int, *order: str) -> DataFrame:
    """The first ``limit`` rows in the given order; callers end the order on a key, so ties are settled."""
    return ordered(df, *order).limit(limit)


def named_hospital(df: DataFrame, t: Model, *columns: str) -> DataFrame:
    """Attach registry columns to rows already aggregated per hospital; unknown hospitals drop out."""
    keep = [c for c in df.columns if c != "hospital_id"]
    return df.join(t.hospitals.select("hospital_id", *columns), "hospital_id").select("hospital_id", *columns, *keep)
