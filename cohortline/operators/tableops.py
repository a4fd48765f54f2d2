"""Operations on a result table, with a guard against sums and averages that would not mean anything."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import parse_number, rnd
from .quantiles import exact_quantiles

ROLE = "role"

# Roles of result columns. Exact names first, then the patterns in order.
EXACT_ROLES = {
    "total_hospitals": "snapshot_stock",
    "empanelled_hospitals": "snapshot_stock",
    "public_hospitals": "snapshot_stock",
    "private_hospitals": "snapshot_stock",
    "total_beds": "snapshot_stock",
    "bed_capacity": "snapshot_stock",
    "total_staff": "snapshot_stock",
    "active_cards": "additive_count",
}
ROLE_PATTERNS = [
    (r"(^|_)(date|day|week|month|quarter|year|fy|period|time)$|_at$|^latest_", "temporal"),
    (r"(^|_)(id|code|number|reference_no|utr_no)$|_no$", "identifier"),
    (r"(pct|percent|percentage|rate|ratio|share|proportion|conversion|coverage|density|per_|_per_|average|avg_|mean|median|tat|days|lag|"
     r"length_of_stay|concentration|index|score|gap|factor|difference)", "ratio"),
    (r"(hospital_count|hospitals$|bed|staff|doctor|specialist|license|facility|capacity)", "snapshot_stock"),
    (r"(amount|value|spend|expenditure|payment|paid|payable|price|cost|financial|deduction|claimed)", "additive_value"),
    (r"(count|^total$|total_|number|cases|claims|beneficiaries|households|cards|admissions|discharges|procedures|patients|members|records|"
     r"documents|requests|events|episodes|units|(^|_)(with|without|no)_|enrol|utilized|expired|issued|admitted|treated|active$|inactive$|"
     r"disabled$|inflow|outflow|net_flow|death|duplicate|query_raised|missing|mismatch_queries|medicine_provided|male$|female$|other$|"
     r"public$|private$|urban$|rural$|approved$|rejected$|pending$|settled$|normal$|lama$)", "additive_count"),
    (r"(name|district|division|block|hospital|specialty|category|status|type|gender|age|group|source|mode|reason|diagnosis|procedure|"
     r"package|state|rank|bucket|band|accreditation|auth|role|label|outcome|^is_|step|metric|rnk|order)", "dimension"),
]
MEASURES = ("additive_count", "additive_value", "ratio", "snapshot_stock", "unclassified")
ADDITIVE_ONLY = ("sum", "average", "share_of_total")


class Refused(ValueError):
    """The operation would give a figure that means something else than asked."""


def role_of(name: str) -> str:
    if name in EXACT_ROLES:
        return EXACT_ROLES[name]
    for pattern, role in ROLE_PATTERNS:
        if re.search(pattern, name):
            return role
    return "unclassified"


def tagged(df: DataFrame, roles: dict[str, str] | None = None) -> DataFrame:
    """Put the role of every column into its metadata; given roles override the rules."""
    return df.select(*[F.col(c).alias(c, metadata={ROLE: (roles or {}).get(c, role_of(c))}) for c in df.columns])


def roles(df: DataFrame) -> dict[str, str]:
    return {f.name: f.metadata.get(ROLE) or role_of(f.name) for f in df.schema.fields}


def policy(operation: str, role: str, spans_time: bool) -> str:
    """client: fine on the table as shown; requery: ask the base data; invalid: not a measure."""
    if operation not in ADDITIVE_ONLY:
        return "client"
    if role not in MEASURES:
        return "invalid"
    if role in ("ratio", "unclassified") or (role == "snapshot_stock" and spans_time):
        return "requery"
    return "client"


def guard(df: DataFrame, operation: str, column: str) -> None:
    known = roles(df)
    if column not in known:
        raise Refused(f"no column {column}")
    verdict = policy(operation, known[column], "temporal" in known.values())
    if verdict != "client":
        raise Refused(f"{operation} of {column} ({known[column]}): {verdict}")


def number(df: DataFrame, column: str) -> Column:
    """The numeric value of a cell, formatted text included."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.BooleanType):
        return F.lit(None).cast("double")
    return F.col(column).cast("double") if isinstance(kind, T.NumericType) else parse_number(column)


def label_column(df: DataFrame) -> str | None:
    return next((c for c, r in roles(df).items() if r == "dimension"), None)


def matched_column(df: DataFrame, wanted: str) -> str | None:
    """A column by a loose name: exact but for case and spaces, else the first that contains it or is contained in it."""
    name = wanted.strip().lower().replace(" ", "_")
    exact = [c for c in df.columns if c.lower() == name]
    part = [c for c in df.columns if name in c.lower() or c.lower() in name]
    return (exact + part + [None])[0]


def resolved_column(df: DataFrame, wanted: str | None = None) -> str:
    """The column meant; without a name the first that holds numbers, amounts ahead of counts, stocks and ratios."""
    if wanted:
        found = matched_column(df, wanted)
        if found is None:
            raise Refused(f"no column like {wanted}")
        return found
    known = roles(df)
    order = ["additive_value", "additive_count", "snapshot_stock", "ratio"]
    ranked = sorted(df.columns, key=lambda c: order.index(known[c]) if known[c] in order else len(order))
    filled = df.agg(*[F.count(number(df, c)).alias(str(i)) for i, c in enumerate(ranked)]).first()
    for i, c in enumerate(ranked):
        if filled[str(i)]:
            return c
    raise Refused("the table has no numeric column")


def operate(df: DataFrame, operation: str, column: str | None = None, n: float | None = None) -> DataFrame:
    """One of the operations on a single table by its name. An empty table is refused, a column may be named loosely or left out."""
    if df.isEmpty():
        raise Refused("the table is empty")
    if operation == "count":
        return count_rows(df)
    if operation in ("mode", "count_distinct"):
        found = matched_column(df, column) if column else label_column(df)
        if found is None:
            raise Refused(f"no column like {column}")
        return frequencies(df, operation, found)
    many = 5 if n is None else int(n)
    run: dict[str, Callable[[str], DataFrame]] = {
        **{o: lambda c: scalar(df, operation, c) for o in ("sum", "average", "min", "max")},
        **{o: lambda c: spread(df, operation, c, n) for o in ("median", "stdev", "percentile", "range")},
        "share_of_total": lambda c: share_of_total(df, c), "percent_change": lambda c: percent_change(df, c),
        "sort": lambda c: sort_rows(df, c), "top_n": lambda c: first_rows(df, operation, c, many), "bottom_n": lambda c: first_rows(df, operation, c, many)}
    if operation not in run:
        raise Refused(f"{operation} is not an operation")
    return run[operation](resolved_column(df, column))


def scalar(df: DataFrame, operation: str, column: str) -> DataFrame:
    """sum, average, min or max as one row; min and max name the row they come from."""
    guard(df, operation, column)
    v = number(df, column)
    if operation == "sum":
        return df.agg(F.sum(v).alias("value"))
    if operation == "average":
        return df.agg(F.avg(v).alias("value"))
    label = label_column(df)
    named = F.col(label).cast("string") if label else F.lit(None).cast("string")
    order = F.struct(v if operation == "min" else -v, named)
    pick, end = (F.min_by, F.min) if operation == "min" else (F.min_by, F.max)
    return df.where(v.isNotNull()).agg(end(v).alias("value"), pick(named, order).alias("label"))


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).cast("double").alias("value"))


def spread(df: DataFrame, operation: str, column: str, n: float | None = None) -> DataFrame:
    """median, stdev (two values at least), percentile (linear) or range, with its ends and the rows they come from, of the rows shown."""
    guard(df, operation, column)
    v = number(df, column)
    if operation == "median":
        return exact_quantiles(df.select(v.alias("v")), [], "v", {"value": 0.5})
    if operation == "stdev":
        return df.agg(F.when(F.count(v) >= 2, F.stddev_samp(v)).alias("value"))
    if operation == "percentile":
        if n is None or not 0 <= n <= 100:
            raise Refused(f"{n} is not a percentile")
        return exact_quantiles(df.select(v.alias("v")), [], "v", {"value": n / 100.0})
    label = label_column(df)
    named = F.col(label).cast("string") if label else F.lit(None).cast("string")
    return df.where(v.isNotNull()).agg(
        (F.max(v) - F.min(v)).alias("value"), F.min(v).alias("low"), F.max(v).alias("high"),
        F.min_by(named, F.struct(v, named)).alias("low_label"), F.min_by(named, F.struct(-v, named)).alias("high_label"))


def frequencies(df: DataFrame, operation: str, column: str) -> DataFrame:
    """mode with its ties (none when every value is unique), or the number of distinct values."""
    text = F.trim(F.col(column).cast("string"))
    counts = df.where(F.col(column).isNotNull()).groupBy(text.alias("v")).agg(F.count(F.lit(1)).alias("k"))
    if operation == "count_distinct":
        return counts.agg(F.count(F.lit(1)).cast("double").alias("value"))
    top = counts.agg(F.max("k")).scalar()
    return counts.where((F.col("k") == top) & (F.col("k") > 1)).agg(
        F.array_join(F.array_sort(F.collect_list("v")), ";").alias("modes"), F.count(F.lit(1)).alias("ties"), F.max("k").alias("rows"))


def share_of_total(df: DataFrame, column: str, label: str | None = None) -> DataFrame:
    """Every row's share of the column's total; with a label, only that row. A zero total gives no shares."""
    guard(df, "share_of_total", column)
    v = number(df, column)
    whole = df.agg(F.sum(v)).scalar()
    out = df.withColumn(f"share_of_{column}_pct", rnd(v / F.nullif(whole, F.lit(0.0)) * 100.0, 2))
    if label is None:
        return out
    named = label_column(df)
    if named is None:
        raise Refused("the table has no label column")
    return out.where(F.lower(F.trim(F.col(named).cast("string"))) == label.strip().lower())


def percent_change(df: DataFrame, column: str) -> DataFrame:
    """Change from the first to the last value in time, in percent of the size of the first.

    ``refused`` tells why there is no value: fewer than two values, or a zero start.
    """
    time = next((c for c, r in roles(df).items() if r == "temporal"), None)
    if time is None:
        raise Refused("the table has no time column")
    v, t = number(df, column), F.col(time).cast("string")
    ends = df.where(v.isNotNull()).agg(F.min_by(v, t).alias("first"), F.max_by(v, t).alias("last"), F.count(v).alias("n"))
    refused = F.when(F.col("n") < 2, "too few values").when(F.col("first") == 0, "zero start")
    change = (F.col("last") - F.col("first")) / F.nullif(F.abs("first"), F.lit(0.0)) * 100.0
    return ends.select("first", "last", F.when(refused.isNull(), rnd(change, 2)).alias("value"), refused.alias("refused"))


def sort_rows(df: DataFrame, column: str, descending: bool = True) -> DataFrame:
    v = number(df, column)
    return df.orderBy(v.desc_nulls_last() if descending else v.asc_nulls_last())


def first_rows(df: DataFrame, operation: str, column: str, n: int = 5) -> DataFrame:
    """top_n or bottom_n rows by a column; the label settles ties."""
    v = number(df, column)
    order = [v.desc_nulls_last() if operation == "top_n" else v.asc_nulls_last()]
    label = label_column(df)
    return df.where(v.isNotNull()).orderBy(*order, *([F.col(label)] if label else [])).limit(n)


def filter_rows(df: DataFrame, column: str, operator: str, value) -> DataFrame:
    """Rows by a comparison of numbers, or of text regardless of case."""
    if column not in df.columns:
        raise Refused(f"no column {column}")
    if operator in (">", ">=", "<", "<="):
        try:
            bound = float(str(value).replace(",", "").replace("₹", "").strip())
        except ValueError:
            raise Refused(f"{value!r} is not a number") from None
        v = number(df, column)
        return df.where({">": v > bound, ">=": v >= bound, "<": v < bound, "<=": v <= bound}[operator])
    text = F.lower(F.trim(F.coalesce(F.col(column).cast("string"), F.lit("none"))))
    wanted = str(value).strip().lower()
    if operator in ("=", "=="):
        return df.where(text == wanted)
    if operator == "!=":
        return df.where(text != wanted)
    if operator == "contains":
        return df.where(F.contains(text, F.lit(wanted)))
    raise Refused(f"{operator} is not an operator")


def compare(ask: Callable[..., DataFrame], parameter: str, values: list, **params) -> DataFrame:
    """The same question for up to four values of one parameter, stacked and tagged."""
    if not 1 <= len(values) <= 4:
        raise Refused("one to four values can be compared")
    out = None
    for value in values:
        one = ask(**{**params, parameter: value}).withColumn("compared_value", F.lit(str(value)))
        out = one if out is None else out.unionByName(one)
    return out
