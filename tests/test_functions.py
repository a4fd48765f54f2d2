from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortline.functions import derive
from cohortline.functions.numbers import parse_number, pct, rnd, safe_div
from cohortline.functions.stats import best_splits, split_search_sql, t_pvalue_sql, t_two_sided
from cohortline.functions.text import normalise


def test_rounding_is_half_away_from_zero(spark):
    df = spark.createDataFrame([(0.125, -2.5, 1.0, 0.0)], "a double, b double, c double, z double")
    row = df.select(rnd("a", 2), rnd("b", 0), safe_div("c", "z"), pct("c", "z"), pct("a", "c", 1)).first()
    assert tuple(row) == (0.13, -3.0, None, None, 12.5)


def test_parse_number(spark):
    df = spark.createDataFrame([("₹1,234.50",), ("12 %",), (" 7 ",), (None,)], "t string")
    assert [r[0] for r in df.select(parse_number("t")).collect()] == [1234.5, None, 7.0, None]


def test_disease_class_first_match_and_unreadable_numbers(spark):
    codes = ["I10", "E11", "E20", "C98", "A09", "J10", "Z37", "N40", "T99", "I10A", None, "", "o80", "K36.1", "S"]
    df = spark.createDataFrame([(c,) for c in codes], "c string")
    got = [r[0] for r in df.select(derive.disease_class("c")).collect()]
    assert got == ["NCD", "NCD", "OTHER", "OTHER", "COMMUNICABLE", "COMMUNICABLE", "MATERNAL_NEONATAL", "SURGICAL", "OTHER",
                   "OTHER", "OTHER", "OTHER", "MATERNAL_NEONATAL", "SURGICAL", "INJURY"]


def test_bands_at_their_limits(spark):
    df = spark.createDataFrame([(29,), (30,), (31,), (300,), (301,), (None,)], "b long")
    got = [tuple(r) for r in df.select(derive.bed_size_bucket("b"), derive.capacity_band("b")).collect()]
    assert got == [("SMALL (<=30)", "Small (<30)"), ("SMALL (<=30)", "Medium (30-100)"), ("MEDIUM (31-100)", "Medium (30-100)"),
                   ("LARGE (101-300)", "Very Large (300+)"), ("VERY_LARGE (300+)", "Very Large (300+)"), ("UNKNOWN", None)]


def test_age_groups(spark):
    df = spark.createDataFrame([(2000,), (1999,), (1994,), (1939,), (None,)], "y long")
    got = [tuple(r) for r in df.select(derive.age_group("y", F.lit(2000)), derive.age_band("y")).collect()]
    assert got == [("INFANT", "15-30"), ("1-5", "15-30"), ("6-14", "31-45"), ("60+", "60+"), ("UNKNOWN", None)]


def test_normalise_replaces_whole_words_only(spark):
    df = spark.createDataFrame([("  What is the PVT share in pvtx?? ",)], "t string")
    assert df.select(normalise("t", {"pvt": "private"})).first()[0] == "what is the private share in pvtx"


def test_t_probabilities_against_known_values():
    p = t_two_sided([2.0, 1.0, 12.7062047, 4.0321430, np.inf, 0.0], [10, 5, 1, 5, 3, 4])
    assert p == pytest.approx([0.0733880, 0.3632175, 0.05, 0.01, 0.0, 1.0], abs=1e-6)


def test_best_split_matches_a_plain_search():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(40, 15))
    rows[::2, 7:] += 4
    at, p = best_splits(rows)
    for x, a, q in zip(rows, at, p):
        cand = []
        for s in range(3, len(x) - 2):
            u, v = x[:s], x[s:]
            vu, vv = u.var(ddof=1) / len(u), v.var(ddof=1) / len(v)
            t = (u.mean() - v.mean()) / np.sqrt(vu + vv)
            df = (vu + vv) ** 2 / (vu**2 / (len(u) - 1) + vv**2 / (len(v) - 1))
            cand.append((float(t_two_sided([t], [df])[0]), s))
        best = min(cand)
        if best[0] < 0.01:
            assert a == best[1] and q == pytest.approx(best[0], rel=1e-6)
        else:
            assert a == -1


def test_probabilities_and_splits_in_the_jvm(spark):
    rng = np.random.default_rng(1)
    t, df = rng.normal(0, 4, 500), rng.uniform(0.7, 90, 500)
    rows = [(float(a), float(b)) for a, b in zip(t, df)] + [(0.0, 3.0), (1e9, 2.0), (-1e9, 2.0)]
    got = np.array([r.p for r in spark.createDataFrame(rows, "t double, df double").selectExpr(f"{t_pvalue_sql('t', 'df')} AS p").collect()])
    assert np.allclose(got[:500], t_two_sided(t, df), rtol=1e-9, atol=0) and got[500] == 1 and (got[501:] < 1e-15).all()
    series = [(rng.normal(0, 1, n) + np.where(np.arange(n) > n // 2, rng.choice([0, 0, 2, 5]), 0)).tolist() for n in rng.integers(3, 60, 150)]
    series += [[1.0] * 10, [0.0] * 3 + [5.0] * 3, [0.0, 0.0, 0.0, 1.0, 3.0, 1.0, 0.0, 0.0, 0.0], [1.0] * 4 + [2.0] * 4 + [3.0], []]
    found = spark.createDataFrame([(x,) for x in series], "xs array<double>").selectExpr(f"{split_search_sql('xs')} AS c").collect()
    for x, r in zip(series, found):
        at, p = best_splits(np.array([x])) if len(x) >= 6 else ([-1], [1.0])
        assert (r.c is None and at[0] == -1) or (r.c["at"] == at[0] and abs(r.c["p"] - p[0]) < 1e-9)
