from __future__ import annotations

import random

import pytest

from cohortline.plans import peers


@pytest.mark.parametrize("large", [10_000, 40])
def test_percentile_of_score_counts_ties_half(spark, monkeypatch, large):
    """The same percentages whether a group is ranked whole or in slices."""
    monkeypatch.setattr(peers, "ACCURACY", large)
    rng = random.Random(2)
    rows = [("p1", "PUBLIC", float(rng.randrange(120)) ** 3) for _ in range(600)] + [("p2", "PUBLIC", 4.0), ("p2", None, 1.0), ("p1", "PUBLIC", None)]
    df = spark.createDataFrame(rows, "hbp_procedure_code string, hospital_type string, m double")
    group = [r[2] for r in rows if r[0] == "p1" and r[2] is not None]
    got = peers.percentile_of_score(df, "m", "share").collect()
    assert len(got) == len(rows)
    for r in got:
        if r["hospital_type"] is None or r["m"] is None:
            assert r["share"] is None
            continue
        peers_of = group if r["hbp_procedure_code"] == "p1" else [4.0]
        below, upto = sum(x < r["m"] for x in peers_of), sum(x <= r["m"] for x in peers_of)
        assert r["share"] == pytest.approx((below + upto + 1) * 50.0 / len(peers_of))
