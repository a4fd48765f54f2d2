from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortline.operators.mining import engine, enrich, groups, patterns, ranking, scoring
from cohortline.operators.mining.spec import CLAIMS_LIFECYCLE, Measure, ViewSpec

SERIES = "name string, values array<double>"


def _hits(spark, cases: dict[str, list], temporal: bool) -> dict[str, dict[str, list[str]]]:
    rows = [(k, [None if v is None else float(v) for v in vs]) for k, vs in cases.items()]
    df = spark.createDataFrame(rows, SERIES).select(
        "name", F.lit(temporal).alias("is_temporal"),
        F.expr("transform(values, (v, i) -> struct(lpad(cast(i as string), 3, '0') as label, v as value))").alias("dist"))
    return {r["name"]: {h["type"]: list(h["highlight"]) for h in r["hits"]} for r in patterns.evaluate(df).collect()}


def test_categorical_patterns(spark):
    got = _hits(spark, {
        "outstanding": [100, 10, 11, 12, 9], "second_too_close": [100, 70, 11, 12, 9], "tie": [50, 50, 1, 1, 1],
        "lowest": [1, 30, 31, 29, 30], "two": [90, 88, 10, 11, 9], "two_low": [1, 2, 30, 31, 32], "even": [10, 10.5, 9.8, 10.1],
        "majority": [60, 20, 20], "half": [50, 25, 25], "short": [5, 1], "gaps": [None, 100, 10, 11, None], "zero": [0, 0, 0],
        "rest_equal": [9, 5, 5, 5], "nothing": [], "all_missing": [None, None, None]}, temporal=False)
    assert got["outstanding"]["OUTSTANDING_1"] == ["000"] and got["outstanding"]["ATTRIBUTION"] == ["000"]
    assert "OUTSTANDING_1" not in got["second_too_close"]
    assert got["tie"]["TOP_TWO"] == ["000", "001"] and "OUTSTANDING_1" not in got["tie"]
    assert got["lowest"]["OUTSTANDING_LAST"] == ["000"]
    assert got["two"]["TOP_TWO"] == ["000", "001"]
    assert got["two_low"]["LAST_TWO"] == ["000", "001"]
    assert got["even"] == {"EVENNESS": ["EVEN"]}
    assert got["majority"]["ATTRIBUTION"] == ["000"] and "ATTRIBUTION" not in got["half"]
    assert got["gaps"]["OUTSTANDING_1"] == ["001"]
    assert got["rest_equal"]["OUTSTANDING_1"] == ["000"]
    assert got["short"] == got["zero"] == got["nothing"] == got["all_missing"] == {}


def test_temporal_patterns(spark):
    wave = [10 + 5 * math.sin(2 * math.pi * i / 6) for i in range(24)]
    got = _hits(spark, {
        "up": range(10), "down": list(range(10, 0, -1)), "flat": [5] * 12, "noise": [3, 1, 2, 3, 1, 2],
        "outlier": [10, 11, 10, 9, 10, 11, 10, 9, 10, 11, 10, 90], "wave": wave,
        "step": [1, 1.2, 0.9, 1.1, 9, 9.1, 8.9, 9.2], "two_levels": [5] * 4 + [7] * 4, "peak": [1, 2, 4, 7, 5, 3, 1], "dip": [9, 6, 3, 1, 4, 7, 9],
        "edge": [9, 7, 5, 3, 1], "short": [1, 2, 3], "gaps": [None, 1, None, 2, 3, 4, 5]}, temporal=True)
    assert got["up"]["TREND"] == ["INCREASING"] and got["down"]["TREND"] == ["DECREASING"]
    assert got["flat"] == {} and got["short"] == {}
    assert got["outlier"]["OUTLIER"] == ["011 ABOVE"]
    assert got["wave"]["SEASONALITY"] in (["PERIOD_6"], ["PERIOD_12"])
    assert got["step"]["CHANGE_POINT"] == ["004"] and got["two_levels"]["CHANGE_POINT"] == ["004"]
    assert got["peak"]["UNIMODALITY"] == ["PEAK", "003"] and got["dip"]["UNIMODALITY"] == ["VALLEY", "003"]
    assert "UNIMODALITY" not in got["edge"] and got["gaps"]["TREND"] == ["INCREASING"]


def _spearman(values):
    x = np.asarray(values, dtype=float)
    rank = np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
    return np.corrcoef(rank, np.arange(len(x)))[0, 1]


def test_trend_and_seasonality_against_numpy(spark):
    rng = np.random.default_rng(4)
    cases = {f"s{i}": list(np.round(rng.normal(size=n) + i % 3 * 0.15 * np.arange(n), 1)) for i, n in enumerate([4, 6, 12, 13, 24, 30] * 5)}
    got = _hits(spark, cases, temporal=True)
    from cohortline.functions.stats import t_two_sided

    for name, values in cases.items():
        n, rho = len(values), _spearman(values)
        t = rho * np.sqrt((n - 2) / max((1 - rho) * (1 + rho), 1e-300))
        trend = float(t_two_sided([t], [n - 2])[0]) < 0.05 and abs(rho) >= 0.5
        assert (got[name].get("TREND") is not None) == trend, name
        x = np.asarray(values)
        acf = {k: np.corrcoef(x[:n - k], x[k:])[0, 1] for k in (3, 4, 6, 12) if n >= 12 and k <= n // 2}
        strong = {k: v for k, v in acf.items() if v > 0.4}
        want = [f"PERIOD_{max(strong, key=strong.get)}"] if strong else None
        assert got[name].get("SEASONALITY") == want, name


def test_column_sets_are_placed_exactly_once():
    sets = CLAIMS_LIFECYCLE.column_sets()
    for width in (5, 6, 8):
        blocks = CLAIMS_LIFECYCLE.blocks(width)
        placed = [frozenset(s) for _, inside in blocks for s in inside]
        assert sorted(placed, key=sorted) == sorted(sets, key=sorted)
        assert all(len(columns) <= width and set().union(*map(set, inside)) <= set(columns) for columns, inside in blocks)


@pytest.fixture(scope="module")
def planted(spark):
    """Region x product x channel: product A leads in every region but east, where B leads, and west, which is even."""
    rows = []
    for region in ("north", "south", "mid", "low", "high", "east", "west"):
        for product, base in (("A", 100), ("B", 10), ("C", 11), ("D", 9)):
            amount = base
            if region == "east":
                amount = {"A": 10, "B": 100, "C": 11, "D": 9}[product]
            if region == "west":
                amount = 30
            for channel in ("web", "shop", "phone"):
                rows.append((region, product, channel, float(amount), 1.0))
    rows.append((None, "A", "web", 5.0, 1.0))
    view = spark.createDataFrame(rows, "region string, product string, channel string, amount double, n double")
    spec = ViewSpec("planted", ("region", "product", "channel"), (), (Measure("amount"), Measure("n")), ("amount",), depth=2)
    return spec, engine.mine(view, spec, width=3)


def test_planted_exceptions_are_found(planted):
    spec, m = planted
    row = m.candidates.where(
        (F.col("ext_dim") == "region") & (F.col("breakdown") == "product") & (F.col("measure") == "amount")
        & (F.size("base") == 0) & (F.col("pattern_type") == "OUTSTANDING_1")).collect()
    assert len(row) == 1
    c = row[0]
    assert c["hdp_size"] == 7 and list(c["commonness"][0]["highlight"]) == ["A"] and c["commonness"][0]["count"] == 5
    assert {(e["member_label"], e["category"]) for e in c["exceptions"]} == {("east", "HIGHLIGHT_CHANGE"), ("west", "TYPE_CHANGE")}
    alpha, beta = round(5 / 7, 4), 1 / 7
    s = -alpha * math.log2(alpha) - 2 * beta * math.log2(beta)
    assert c["conciseness"] == pytest.approx(max(0.0, 1 - s / scoring.entropy_bound()))
    assert c["score"] == pytest.approx(c["conciseness"] * c["impact"]) and 0.9 < c["impact"] <= 1


def test_members_without_data_count_as_no_pattern(spark):
    rows = [(f"r{i}", p, 100.0 if p == "A" else 10.0 + j) for i in range(4) for j, p in enumerate("ABCD")] + [("gap", None, 1.0)]
    view = spark.createDataFrame(rows, "region string, product string, amount double")
    spec = ViewSpec("gap", ("region", "product"), (), (Measure("amount"),), ("amount",), depth=1)
    found = engine.mine(view, spec, width=2).candidates.where((F.col("ext_dim") == "region") & (F.col("pattern_type") == "OUTSTANDING_1")).collect()
    assert len(found) == 1 and found[0]["hdp_size"] == 5
    assert [(e["member_label"], e["category"]) for e in found[0]["exceptions"]] == [("gap", "NO_PATTERN")]


def test_entropy_bound():
    assert scoring.entropy_bound() == pytest.approx(1.792, abs=1e-3)
    assert scoring.entropy_bound(k=2) == pytest.approx(1.0 + 1.0 / math.e * math.log2(math.e), abs=1e-9)


def _overlap(a, b):
    if (a["strategy"], a["pattern_type"]) != (b["strategy"], b["pattern_type"]):
        return 0.0
    sa, sb = ({(p["dim"], p["value"]) for p in x["base"]} for x in (a, b))
    sub = 1.0 if not sa and not sb else 0.0 if not sa or not sb else len(sa & sb) / min(len(sa), len(sb))

    def same(c):
        return float(a[c] == b[c])

    if a["strategy"] == "subspace":
        return 0.4 * sub + 0.3 * same("ext_dim") + 0.15 * same("measure") + 0.15 * same("breakdown")
    return 0.6 * sub + 0.4 * same("breakdown" if a["strategy"] == "measure" else "measure")


def test_greedy_ranking_equals_a_plain_search(planted):
    _, m = planted
    pool = sorted(ranking.identified(m.candidates).collect(), key=lambda r: (-round(r["score"], 9), r["cid"]))
    chosen = [pool[0]]
    while len(chosen) < 6:
        rest = [r for r in pool if r not in chosen]
        gains = [(r["score"] - sum(min(r["score"], c["score"]) * _overlap(r, c) for c in chosen), r) for r in rest]
        best = max(g for g, _ in gains)
        if best <= 1e-12:
            break
        chosen.append(sorted((r for g, r in gains if abs(g - best) < 1e-12), key=lambda r: (-round(r["score"], 9), r["cid"]))[0])
    got = ranking.greedy_rank(m.candidates, k=len(chosen)).orderBy("rank").collect()
    total = sum(c["score"] for c in chosen) - sum(min(a["score"], b["score"]) * _overlap(a, b) for i, a in enumerate(chosen) for b in chosen[i + 1:])
    use = ranking.total_use(ranking.greedy_rank(m.candidates, k=len(chosen))).first()
    assert len(got) == len(chosen) and got[0]["cid"] == chosen[0]["cid"]
    assert use["total_use"] == pytest.approx(total)


def test_figures_and_sentences(planted):
    spec, m = planted
    one = m.candidates.where((F.col("ext_dim") == "region") & (F.col("breakdown") == "product") & (F.col("measure") == "amount")
                             & (F.size("base") == 0) & (F.col("pattern_type") == "OUTSTANDING_1"))
    text = enrich.with_summary(one).first()["summary"]
    assert text == ("Across most region values (5/7), A has the highest amount among product values. Exception: "
                    "east (B has the highest amount among product values); west (different pattern)")
    spec2 = ViewSpec("p", spec.dimensions, (), spec.measures + (Measure("n2", "avg"),), spec.impact)
    assert spec2.measures[-1].agg == "avg"


def test_groups_below_the_minimum_are_left_out(planted):
    spec, m = planted
    sizes = {r["ext_dim"]: r["hdp_size"] for r in m.members.select("ext_dim", "hdp_size").distinct().collect()}
    assert sizes == {"region": 7, "product": 4, "channel": 3}
    assert groups.domains(m.spaces, spec).count() == 3
