from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortline.operators import coverage, quality, repair, resolve, select, spelling
from cohortline.operators.history import preceded_within, with_previous
from cohortline.operators.quantiles import thresholds
from cohortline.sources import sinks
from cohortline.operators.quantiles import exact_quantiles

T0 = datetime(2020, 1, 1)


def test_first_and_latest_put_missing_times_last(spark):
    rows = [("a", T0, 2, "x"), ("a", T0, 1, "y"), ("a", None, 0, "z"), ("b", None, 5, None)]
    df = spark.createDataFrame(rows, "k string, t timestamp, id int, v string")
    first = {r["k"]: r["id"] for r in select.first_per_key(df, ["k"], ["t", "id"]).collect()}
    last = {r["k"]: r["id"] for r in select.latest_per_key(df, ["k"], ["t", "id"]).collect()}
    assert first == {"a": 1, "b": 5} and last == {"a": 2, "b": 5}


def test_modal_value_ties_and_empty_groups(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "a"), ("a", None), ("c", None)], "k string, v string")
    assert {r["k"]: r["v"] for r in select.modal_value(df, ["k"], "v").collect()} == {"a": "a", "c": None}


def test_exact_quantiles_equal_linear_interpolation(spark):
    rng = random.Random(3)
    data = {"hot": [rng.gauss(0, 100) for _ in range(900)], "few": [1.0, 1.0, 4.0], "one": [7.5], "same": [2.0] * 50}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs] + [("few", None)], "k string, v double")
    points = {"q1": 0.25, "q2": 0.5, "q9": 0.95}
    for r in exact_quantiles(df, ["k"], "v", points).collect():
        for name, p in points.items():
            assert r[name] == pytest.approx(float(np.quantile(data[r["k"]], p)), rel=1e-12), (r["k"], name)
    whole = [v for vs in data.values() for v in vs]
    assert exact_quantiles(df, [], "v", {"m": 0.5}).first()["m"] == pytest.approx(float(np.median(whole)))


def test_exact_quantiles_of_a_large_group_with_far_outliers(spark):
    rng = np.random.default_rng(8)
    values = np.concatenate([rng.lognormal(0, 3, 40_000), [1e15] * 3, np.round(rng.normal(5, 1, 20_000), 2)])
    rows = spark.createDataFrame([(float(v),) for v in values], "v double")
    points = {"a": 0.0, "b": 0.01, "c": 0.5, "d": 0.9, "e": 0.9999, "f": 1.0}
    got = exact_quantiles(rows.withColumn("k", F.lit("x")), ["k"], "v", points).first()
    for name, p in points.items():
        assert got[name] == pytest.approx(float(np.quantile(values, p)), rel=1e-12), name


def _visits(spark, n=400):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        who = "hot" if i % 3 == 0 else f"p{rng.randrange(12)}"
        start = T0 + timedelta(days=rng.randrange(60), hours=rng.randrange(3))
        rows.append((f"c{i:04d}", who, rng.choice("xy"), start, start + timedelta(days=rng.randrange(6))))
    return spark.createDataFrame(rows, "id string, who string, cat string, s timestamp, e timestamp"), rows


def test_previous_row_equals_a_window_over_the_whole_key(spark):
    df, _ = _visits(spark)
    got = with_previous(df, ["who"], ["s", "id"], {"prev": "e", "prev_id": "id"})
    w = Window.partitionBy("who").orderBy("s", "id")
    want = df.withColumns({"prev": F.lag("e").over(w), "prev_id": F.lag("id").over(w)})
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_preceded_within_equals_comparing_all_pairs(spark):
    df, rows = _visits(spark)
    got = {r[0] for r in preceded_within(df, ["who", "cat"], "id", "s", "e", 1, 10).collect()}
    want = {a[0] for a in rows for b in rows
            if a[0] != b[0] and a[1:3] == b[1:3] and 1 <= (a[3].date() - b[4].date()).days <= 10}
    assert got == want


def test_each_quality_check_finds_its_planted_fault(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", T0, None), (1, "b", T0 + timedelta(days=40), None), (2, "q", T0, 3)],
                               "id int, kind string, t timestamp, v int")
    parent = spark.createDataFrame([("a",), ("b",)], "kind string")
    checks = [
        quality.row_count(df, "t", 100), quality.unique_key(df, "t.id", ["id"]), quality.value_domain(df, "kind", ["a", "b"], "t.kind"),
        quality.date_span(df, "t", "t.t"), quality.null_rates(df.select("v"), "t"), quality.grain(df, "t", ["id"]),
        quality.order_violations(df, "t", F.col("t") > F.lit(T0)),
        quality.orphans(df, "kind", parent, "kind", "t.kind").where(F.col("check") == "orphans"),
        quality.expectations(df, {"small": quality.all_hold(F.col("id") < 2)}),
    ]
    for check in checks:
        assert check.where(~F.col("passed")).count() == 1, check.collect()
    with pytest.raises(quality.ChecksFailed, match="1 checks failed"):
        quality.require_passed(checks[1], str(tmp_path / "failed"))
    assert spark.read.parquet(str(tmp_path / "failed")).count() == 1
    quality.require_passed(quality.unique_key(parent, "p", ["kind"]), str(tmp_path / "none"))


def test_parity_tolerance(spark):
    a = spark.createDataFrame([(1, 10.0, "x"), (2, None, "y"), (3, float("nan"), None)], "id int, v double, s string")
    near = a.withColumn("v", F.col("v") * (1 + 1e-10))
    far = a.withColumn("v", F.when(F.col("id") == 1, 10.001).otherwise(F.col("v")))
    assert quality.parity(a, near, ["id"]).where(~F.col("passed")).isEmpty()
    bad = quality.parity(a, far, ["id"]).where(~F.col("passed")).collect()
    assert [(r["check"], r["subject"], r["value"]) for r in bad] == [("value", "v", 1.0)]
    fewer = quality.parity(a, a.where("id < 3").drop("s"), ["id"]).where(~F.col("passed"))
    assert {(r["check"], r["subject"]) for r in fewer.collect()} == {("rows", "*"), ("columns", "s"), ("value", "v")}


def test_parity_looks_closer_only_where_digests_differ(spark):
    rows = [(i, i / 7, None if i % 5 == 0 else f"t{i}", T0 + timedelta(days=i)) for i in range(300)]
    a = spark.createDataFrame(rows, "id int, v double, s string, at timestamp")
    for buckets in (1, 7, 65536):
        assert quality.parity(a, a.orderBy(F.desc("id")), ["id"], buckets=buckets).where(~F.col("passed")).isEmpty()
        b = a.where("id <> 9").withColumn("s", F.when(F.col("id") == 11, None).when(F.col("id") == 10, "t10").otherwise(F.col("s"))).withColumn(
            "v", F.when(F.col("id") == 12, 0.0).otherwise(F.col("v"))).unionByName(a.where("id = 1").withColumn("id", F.lit(None).cast("int")))
        got = {r["subject"]: r["value"] for r in quality.parity(a, b, ["id"], buckets=buckets).collect()}
        assert got == {"*": 0.0, "v": 3.0, "s": 4.0, "at": 2.0}


def test_thresholds_of_many_columns(spark):
    rows = [(i % 17 / 3, None if i % 4 else float(i), None) for i in range(101)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    at = thresholds(df, {"low": ("a", 0.25), "mid": ("b", 0.5), "high": ("a", 0.9), "none": ("c", 0.5)})
    got = df.limit(1).select(*[x.alias(n) for n, x in at.items()]).first()
    a, b = [r[0] for r in rows], [r[1] for r in rows if r[1] is not None]
    assert [got["low"], got["mid"], got["high"]] == pytest.approx([np.quantile(a, 0.25), np.quantile(b, 0.5), np.quantile(a, 0.9)])
    assert got["none"] is None


def test_digests_know_order_free_equality(spark):
    a = spark.createDataFrame([("x", None), ("x", None), (None, "x")], "p string, q string")
    def told(df):
        return sinks.digests(df, all=[F.col(c) for c in df.columns])
    assert told(a) == told(a.orderBy("p"))
    assert told(a) != told(a.distinct()) and told(a) != told(a.select(F.col("q").alias("p"), F.col("p").alias("q")))
    assert told(a.where("false")) == told(a.where("p = 'y'")) != told(a)


def test_repair_moves_late_cards_into_their_window(spark):
    day = timedelta(days=1)
    rows = [("ok", T0, T0 + 2 * day, T0 + 9 * day), ("late", T0, T0 + 9 * day, T0 + 5 * day), ("tight", T0, T0 + 3 * day, T0 + day),
            ("free", T0, T0 + 3 * day, None)]
    df = spark.createDataFrame(rows, "id string, created_at timestamp, issued_at timestamp, first_admission timestamp")
    got = {r["id"]: r["issued_at"] for r in repair.cards_before_admission(df).collect()}
    assert got == {"ok": T0 + 2 * day, "late": T0 + 2.5 * day, "tight": T0 + day, "free": T0 + 3 * day}


def test_nearest_site_by_rings_equals_brute_force(spark):
    rng = random.Random(9)
    cells = [(rng.uniform(-60, 60), rng.uniform(-150, 150)) for _ in range(150)]
    sites = [(rng.uniform(20, 24), rng.uniform(70, 76)) for _ in range(40)] + [(-50.0, -140.0)]
    c = spark.createDataFrame([(*p, 5) for p in cells], "lat double, lng double, pop int")
    s = spark.createDataFrame(sites, "lat double, lng double")

    def km(a, b):
        la, lb = np.radians(a[0]), np.radians(b[0])
        h = np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin(np.radians(b[1] - a[1]) / 2) ** 2
        return 6371 * 2 * np.arctan2(np.sqrt(h), np.sqrt(1 - h))

    for found in (coverage.nearest_by_rings(c, s), coverage.nearest_site(c, s)):
        got = {(r["lat"], r["lng"]): r["dist_km"] for r in found.collect()}
        assert len(got) == len(cells)
        for p in cells:
            assert got[p] == pytest.approx(min(km(p, q) for q in sites), rel=1e-9)
    strong = {q: 0.2 + 0.05 * (i % 15) for i, q in enumerate(sites)}
    held = spark.createDataFrame([(*q, v) for q, v in strong.items()], "lat double, lng double, strength double")
    for decay in (50.0, 5000.0):
        got = {(r["lat"], r["lng"]): r["coverage"] for r in coverage.coverage(c, held, decay).collect()}
        assert all(got[p] == pytest.approx(max(v * np.exp(-km(p, q) / decay) for q, v in strong.items()), rel=1e-9, abs=1e-300) for p in cells)
    assert {r["dist_km"] for r in coverage.nearest_site(c, s.where("false")).collect()} == {500.0}
    assert {r["coverage"] for r in coverage.coverage(c, held.where("false")).collect()} == {0.0}


def test_weak_sites_do_not_meet_far_cells(spark):
    """One strong site far from 900 weak ones among 900 cells: few of the 811,801 pairs are looked at, and the result is exact."""
    rng = random.Random(4)

    def place():
        return rng.uniform(0, 40), (rng.uniform(160, 220) + 180) % 360 - 180  # across the date line

    cells = [place() for _ in range(900)] + [(20.0, -175.0)]
    sites = [(*place(), 0.01 + 0.001 * (i % 7)) for i in range(900)] + [(80.0, 0.0, 1.0)]
    c = spark.createDataFrame(cells, "lat double, lng double")
    s = spark.createDataFrame(sites, "lat double, lng double, strength double")
    at, of, v = np.radians(cells), np.radians([x[:2] for x in sites]), np.array([x[2] for x in sites])
    h = np.sin((at[:, None, 0] - of[None, :, 0]) / 2) ** 2 + np.cos(at[:, None, 0]) * np.cos(of[None, :, 0]) * np.sin((at[:, None, 1] - of[None, :, 1]) / 2) ** 2
    want = (v * np.exp(-6371 * 2 * np.arcsin(np.sqrt(h)) / 50)).max(axis=1)
    got = {(r["lat"], r["lng"]): r["coverage"] for r in coverage.coverage(c, s).collect()}
    assert [got[p] for p in cells] == pytest.approx(list(want), rel=1e-9, abs=1e-300)
    met = coverage.squares_that_meet(c, s, lambda km, strength: F.log(strength) - km / 50)
    assert sum(pairs.agg(F.coalesce(F.sum(F.col("c_n") * F.col("p_n")), F.lit(0))).first()[0] for _, pairs in met) < len(cells) * len(sites) / 8


def test_sites_at_one_place_and_without_coordinates(spark):
    c = spark.createDataFrame([(10.0, 179.9), (10.0, 179.9), (None, 3.0), (-90.0, 0.0)], "lat double, lng double")
    s = spark.createDataFrame([(10.0, -179.9, 0.5)] * 3 + [(10.0, -179.9, None), (None, 1.0, 1.0), (0.0, 0.0, -1.0)], "lat double, lng double, strength double")
    got = sorted(((r["lat"] or 0.0, round(r["coverage"], 6)) for r in coverage.coverage(c, s).collect()))
    near = round(0.5 * float(np.exp(-2 * 6371 * np.arcsin(np.cos(np.radians(10.0)) * np.sin(np.radians(0.1))) / 50)), 6)
    assert got == [(-90.0, 0.0), (0.0, 0.0), (10.0, near), (10.0, near)]
    one = spark.createDataFrame([(5.0, 5.0)] * 50, "lat double, lng double")
    assert {r["dist_km"] for r in coverage.nearest_site(one, one).collect()} == {0.0}


def test_names_resolve_by_exact_alias_and_spelling(spark):
    raw = spark.createDataFrame([("Delhi",), (" delhi ",), ("dilli",), ("Dehli",), ("Mombai",), ("zzz",), (None,)], "n string")
    names = spark.createDataFrame([("Delhi",), ("Mumbai",), ("Pune",)], "value string")
    got = {r["raw"]: (r["resolved"], r["confidence"]) for r in resolve.resolve(raw, "n", names, {"Dilli": "Delhi"}, 0.6).collect()}
    assert got == {"Delhi": ("Delhi", "exact"), " delhi ": ("Delhi", "exact"), "dilli": ("Delhi", "alias"), "Dehli": ("Delhi", "fuzzy"),
                   "Mombai": ("Mumbai", "fuzzy"), "zzz": (None, "unmatched")}


def test_names_that_match_nothing_get_the_closest_names(spark, monkeypatch):
    monkeypatch.setattr(resolve, "BLOCK", 2)
    raw = spark.createDataFrame([("zzz",), ("pxnx",), ("Delhi",)], "n string")
    names = spark.createDataFrame([(v,) for v in ("Delhi", "Mumbai", "Pune", "pine", "Agra", None)], "value string")
    got = {r["raw"]: r["suggestions"] for r in resolve.resolve(raw, "n", names).collect()}
    assert got == {"zzz": "Agra;Delhi;Mumbai", "pxnx": "Pune;pine;Agra", "Delhi": None}


def test_entities_resolve_by_the_rules_of_their_type(spark):
    values = spark.createDataFrame([("district", "Agra"), ("district", "Meerut"), ("month", "11"), ("month", "12"), ("hospital", "City Care Hospital"),
                                    ("hospital_type", "PUBLIC")], "entity_type string, value string")
    raw = spark.createDataFrame([("district", "agra"), ("district", "Merut"), ("district", "UP"), ("district", "Mxrxxt"), ("month", "111"), ("month", "november"),
                                 ("hospital", "City Care Hosp"), ("hospital_type", "Publik"), ("hospital_type", "govt"), ("planet", "Mars"), ("block", None)],
                                "entity_type string, raw string")
    aliases = {"month": {"November": "11"}, "hospital_type": {"govt": "PUBLIC"}}
    rows = resolve.resolve_entities(raw, values, aliases).collect()
    got = {(r["entity_type"], r["raw"]): (r["resolved"], r["confidence"]) for r in rows}
    # Merut is 5 of 6 letters (83 %), below the 85 of a district; a hospital needs 72; months and types of hospital have no fuzzy step
    assert got == {("district", "agra"): ("Agra", "exact"), ("district", "Merut"): (None, "unmatched"), ("district", "UP"): (None, "refused"),
                   ("district", "Mxrxxt"): (None, "unmatched"), ("month", "111"): (None, "unmatched"), ("month", "november"): ("11", "alias"),
                   ("hospital", "City Care Hosp"): ("City Care Hospital", "fuzzy"), ("hospital_type", "Publik"): (None, "unmatched"),
                   ("hospital_type", "govt"): ("PUBLIC", "alias"), ("planet", "Mars"): (None, "unmatched")}
    assert {(r["entity_type"], r["raw"]): r["suggestions"] for r in rows if r["confidence"] == "unmatched"} == {
        ("district", "Merut"): "Meerut", ("district", "Mxrxxt"): "Meerut", ("month", "111"): "11;12", ("hospital_type", "Publik"): "PUBLIC", ("planet", "Mars"): ""}
    with pytest.raises(ValueError, match="50"):
        resolve.resolve_entities(raw, values, cutoffs={"district": 49})


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_names_of_one_template_do_not_all_meet(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("every name met the whole registry")

    monkeypatch.setattr(resolve, "_blockwise", refused)
    monkeypatch.setattr(resolve, "ASKED", 40)
    monkeypatch.setattr(resolve, "KNOWN", 200)
    held = [f"Supplier#{i * 37:06d}" for i in range(500)]
    asked = [f"The suplier#{i * 37 * 7:06d}" for i in range(60)] + [f"upplier#{i * 37 * 5:06d}" for i in range(60)] + [f"Clinic of Supplier#{i:06d}" for i in range(5)] + ["", "Supplier"]
    values = spark.createDataFrame([("hospital", v) for v in held] + [(None, "x"), ("hospital", None)], "entity_type string, value string")
    raw = spark.createDataFrame([("hospital", v) for v in asked] + [(None, "y")], "entity_type string, raw string")
    got = {r["raw"]: r for r in resolve.resolve_entities(raw, values).collect()}

    def pairs(text):
        return {f"^{text}$"[i:i + 2] for i in range(len(text) + 1)}

    known = {v: pairs(v.lower()) for v in held}
    for name in asked:
        low = name.lower()
        sim, best = min((-round(1 - edits(low, v.lower()) / max(len(low), len(v)), 9), v) for v in held)
        assert got[name]["resolved"] == (best if -sim * 100 >= 72 else None), name
        if -sim * 100 < 72:
            rare = sorted((n, g) for g in pairs(low) for n in [sum(g in k for k in known.values())] if n)[:3]
            met = [v for v in held if known[v] & {g for _, g in rare}]
            assert got[name]["suggestions"] == ";".join(sorted(met, key=lambda v: (-len(known[v] & pairs(low)), v))[:3]), name
    assert got["y"]["confidence"] == "unmatched" and got["y"]["suggestions"] == ""


def test_names_are_found_by_their_beginnings():
    rng = random.Random(3)
    names = list({"".join(rng.choices("abcé漢", k=rng.randint(1, 10))) for _ in range(300)})
    asked = ["".join(rng.choices("abcz漢", k=rng.randint(0, 12))) for _ in range(100)]
    values = [n.swapcase() for n in names]
    for lost in (0.5, 0.28, 0.1):
        got = spelling.nearest(asked, np.full(len(asked), lost), names, values)
        for a, k in zip(asked, got):
            near = [(-round(1 - edits(a, n) / max(len(a), len(n)), 9), v, i) for i, (n, v) in enumerate(zip(names, values)) if edits(a, n) <= lost * max(len(a), len(n)) + 1e-6]
            assert k == (min(near)[2] if near else -1)


def test_bigram_filter_misses_no_similar_name(spark):
    rng = random.Random(5)
    held = sorted({"".join(rng.choices("abc", k=rng.randint(0, 9))) for _ in range(150)})
    asked = sorted({"".join(rng.choices("abcd", k=rng.randint(0, 9))) for _ in range(150)} | {"", "d" * 40})
    values = spark.createDataFrame([("t", v) for v in held], "entity_type string, value string")
    raw = spark.createDataFrame([("t", v) for v in asked], "entity_type string, raw string")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for percent in (50, 72, 85, 95):
        got = {r["raw"]: r["resolved"] for r in resolve.resolve_entities(raw, values, cutoffs={"t": percent}).collect()}
        for name in asked:
            sim, best = min((-round(1 - distance(name, v) / max(len(name), len(v), 1), 9), v) for v in held)
            assert got[name] == (best if -sim * 100 >= percent else None), (percent, name)


def test_lineage_cuts_are_released(spark, tmp_path, monkeypatch):
    from cohortline import runtime

    assert runtime.cuts(spark) == runtime.cuts(spark)
    monkeypatch.setattr(runtime, "cuts", lambda _: str(tmp_path / "cuts"))
    assert runtime.cut_lineage(spark.range(3)).count() == 3 and len(list((tmp_path / "cuts").iterdir())) == 1
    runtime.release(spark)
    assert not (tmp_path / "cuts").exists()
