"""Derived columns of the operational model, as Column -> Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import col, safe_div

# Disease category by the first letter of the diagnosis code.
CATEGORY_BY_LETTER = {
    "MATERNAL_NEONATAL": "OP",
    "COMMUNICABLE": "AB",
    "INJURY": "ST",
    "NCD": "IEJNCD",
    "SURGICAL": "KHGML",
}

# Disease class by letter and number range; the first match counts, no range means any number.
CLASS_BY_RANGE = [
    ("I", None, None, "NCD"),
    ("E", 10, 14, "NCD"),
    ("J", 40, 47, "NCD"),
    ("C", None, 97, "NCD"),
    ("N", 17, 19, "NCD"),
    ("A", None, 9, "COMMUNICABLE"),
    ("A", 15, 19, "COMMUNICABLE"),
    ("A", 90, 99, "COMMUNICABLE"),
    ("B", 50, 54, "COMMUNICABLE"),
    ("J", 9, 18, "COMMUNICABLE"),
    ("O", None, None, "MATERNAL_NEONATAL"),
    ("P", None, None, "MATERNAL_NEONATAL"),
    ("Z", 37, 37, "MATERNAL_NEONATAL"),
    ("K", 35, 38, "SURGICAL"),
    ("K", 40, 46, "SURGICAL"),
    ("H", 25, 26, "SURGICAL"),
    ("N", 40, 40, "SURGICAL"),
    ("S", None, None, "INJURY"),
    ("T", None, 98, "INJURY"),
]


def steps(value, limits: list[tuple[float, str]], last: str, below: bool = False, null: str | None = None) -> Column:
    """Label of the first limit that ``value`` does not exceed (or stays below); ``last`` beyond all of them."""
    v = col(value)
    out = F.when(v.isNull(), F.lit(null).cast("string"))
    for bound, label in limits:
        out = out.when(v < bound if below else v <= bound, label)
    return out.otherwise(last)


def age_group(yob, ref_year) -> Column:
    """Age at a reference year, in groups; an unknown year of birth is a group of its own."""
    age = col(ref_year) - col(yob)
    limits = [(5, "1-5"), (14, "6-14"), (25, "15-25"), (40, "26-40"), (60, "41-60")]
    return F.when(col(yob).isNull(), "UNKNOWN").when(age < 1, "INFANT").otherwise(steps(age, limits, "60+"))


def age_band(yob, year: int = 2026) -> Column:
    limits = [(5, "0-5"), (14, "6-14"), (30, "15-30"), (45, "31-45"), (60, "46-60")]
    return steps(F.lit(year) - col(yob), limits, "60+")


def age_bucket(yob, dob, as_of) -> Column:
    """Four broad groups; the year of birth falls back on the date of birth."""
    age = F.year(as_of) - F.coalesce(col(yob), F.year(dob))
    return steps(age, [(18, "0-17"), (46, "18-45"), (66, "46-65")], "65+", below=True)


def month_text(ts) -> Column:
    return F.date_format(ts, "yyyy-MM")


def quarter_text(ts) -> Column:
    return F.concat(F.year(ts).cast("string"), F.lit("Q"), F.quarter(ts).cast("string"))


def year_text(ts) -> Column:
    return F.year(ts).cast("string")


def days_between(start, end) -> Column:
    """Elapsed days with their fraction."""
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(86400e6)


def whole_days(start, end) -> Column:
    """Elapsed full days, rounded towards the past."""
    return F.floor(days_between(start, end))


def flag(cond: Column) -> Column:
    """1 where true, else 0 (null counts as 0), as a number that can be summed."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0)).cast("long")


def disease_category(code) -> Column:
    first = F.substring(F.upper(F.trim(col(code))), 1, 1)
    out = F.when(col(code).isNull(), "UNKNOWN")
    for name, letters in CATEGORY_BY_LETTER.items():
        out = out.when(first.isin(*letters), name)
    return out.otherwise("OTHER")


def disease_class(code) -> Column:
    """Class by letter and number; codes whose number cannot be read are OTHER."""
    text = F.upper(F.trim(col(code)))
    letter = F.substring(text, 1, 1)
    digits = F.substring_index(F.substring_index(text.substr(F.lit(2), F.length(text)), ".", 1), " ", 1)
    number = F.when(digits == "", F.lit(0)).otherwise(digits.try_cast("int"))
    out = F.when(text.isNull() | (text == "") | ~digits.rlike("^[0-9]*$"), "OTHER")
    for key, low, high, name in CLASS_BY_RANGE:
        cond = letter == key
        if low is not None:
            cond = cond & (number >= low)
        if high is not None:
            cond = cond & (number <= high)
        out = out.when(cond, name)
    return out.otherwise("OTHER")


def bed_size_bucket(beds) -> Column:
    return steps(beds, [(30, "SMALL (<=30)"), (100, "MEDIUM (31-100)"), (300, "LARGE (101-300)")],
                 "VERY_LARGE (300+)", null="UNKNOWN")


def capacity_band(beds) -> Column:
    return steps(beds, [(30, "Small (<30)"), (100, "Medium (30-100)"), (300, "Large (100-300)")],
                 "Very Large (300+)", below=True)


def is_expired(expiry, ref) -> Column:
    """1 when the expiry lies before the reference time; an open expiry is not expired."""
    return flag(col(expiry) < col(ref))


def document_bucket(count) -> Column:
    return steps(count, [(0, "NO_DOCS"), (1, "1_DOC"), (3, "2-3_DOCS")], "4+_DOCS")


def amount_diff(claimed, approved) -> Column:
    return col(claimed) - col(approved)


def approval_ratio(claimed, approved) -> Column:
    return safe_div(approved, claimed)


def aging_bucket(day, as_of, limits: list[tuple[int, str]], last: str) -> Column:
    """Bucket of the whole days from ``day`` to ``as_of``."""
    return steps(F.datediff(col(as_of), col(day)), limits, last)


def validity(until, as_of, none: str, valid: str, lapsed: str) -> Column:
    """Status of something valid until a date."""
    return F.when(col(until).isNull(), none).when(col(until) >= col(as_of), valid).otherwise(lapsed)
