"""Hospitals against their peers: the same procedure at the same type of hospital."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import safe_div
from ..operators.quantiles import ACCURACY, exact_quantiles
from ..runtime import cut_lineage
from .gap import yes

PAIR = ["hospital_id", "hbp_procedure_code"]
PEER = ["hbp_procedure_code", "hospital_type"]
SLICES = 256

# Metric and the direction that is an improvement.
TREND_METRICS = {
    "avg_amount_claimed": "decreasing",
    "avg_los_days": "decreasing",
    "claim_approval_rate": "increasing",
    "claim_query_rate": "decreasing",
    "lama_dama_rate": "decreasing",
    "normal_discharge_rate": "increasing",
    "avg_settlement_tat_days": "decreasing",
}
WEIGHTED = ("avg_los_days", "claim_approval_rate", "claim_rejection_rate", "claim_query_rate", "avg_query_count",
            "normal_discharge_rate", "lama_dama_rate", "avg_settlement_tat_days", "preauth_auto_approval_rate",
            "biometric_auth_rate", "medicines_provided_rate")
DESCRIPTORS = ("hospital_name", "hospital_type", "hospital_sub_type", "block", "district", "division", "capacity_band",
               "procedure_name", "specialty_code", "specialty_name", "base_package_price")


def peer_stats(df: DataFrame, metric: str, prefix: str) -> DataFrame:
    """Mean, deviation, quartiles and size of the peer group. A peer group has one row per hospital."""
    known = df.where(F.col("hbp_procedure_code").isNotNull() & F.col("hospital_type").isNotNull())
    quarters = exact_quantiles(known, list(PEER), metric, {f"{prefix}_median": 0.5, f"{prefix}_p25": 0.25, f"{prefix}_p75": 0.75})
    stats = known.groupBy(*PEER).agg(
        F.avg(metric).alias(f"{prefix}_avg"), F.stddev(metric).alias(f"{prefix}_std"), F.count(metric).alias("peer_hospital_count"))
    stats = cut_lineage(stats.join(quarters, list(PEER), "left"))
    return df.join(stats, PEER, "left").withColumn("small_peer_group", yes(F.col("peer_hospital_count") < 3))


def peer_z(metric: str, prefix: str) -> Column:
    """Distance from the peer mean in deviations; 0 where peers do not differ."""
    sigma = F.col(f"{prefix}_std")
    return F.when(sigma.isNull() | (sigma == 0), 0.0).otherwise(
        (F.col(metric) - F.col(f"{prefix}_avg")) / F.nullif(sigma, F.lit(0.0)))


def percentile_of_score(df: DataFrame, metric: str, name: str) -> DataFrame:
    """Percentage of the peer group below a value, ties counted half (mean of the strict and the weak rank).

    Ranks run over counts per distinct value: rows below, rows equal. A large
    group is cut by its own quantile sketch into slices of like size, ranked
    apart, and the slices are set off by the counts of the slices below.
    """
    known = df.where(F.col(metric).isNotNull() & F.col("hbp_procedure_code").isNotNull() & F.col("hospital_type").isNotNull())
    edges = F.percentile_approx(metric, [i / SLICES for i in range(1, SLICES)], ACCURACY)
    sizes = known.groupBy(*PEER).agg(F.count(F.lit(1)).alias("_n"), edges.alias("_edges"))
    sizes = sizes.withColumn("_edges", F.when(F.col("_n") > ACCURACY, F.col("_edges")).otherwise(F.array().cast("array<double>")))
    slice_of = F.size(F.filter("_edges", lambda e: e < F.col(metric)))
    counts = known.groupBy(*PEER, metric).agg(F.count(F.lit(1)).alias("_eq")).join(sizes, list(PEER)).withColumn(
        "_slice", slice_of).drop("_edges")
    lower = Window.partitionBy(*PEER).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = counts.groupBy(*PEER, "_slice").agg(F.sum("_eq").alias("_in")).withColumn(
        "_under", F.coalesce(F.sum("_in").over(lower), F.lit(0))).drop("_in")
    upto = Window.partitionBy(*PEER, "_slice").orderBy(metric).rowsBetween(Window.unboundedPreceding, 0)
    ranks = counts.join(slices, [*PEER, "_slice"]).withColumn("_le", F.col("_under") + F.sum("_eq").over(upto))
    below = F.col("_le") - F.col("_eq")
    share = (below + F.col("_le") + F.when(F.col("_eq") > 0, 1).otherwise(0)) * 50.0 / F.col("_n")
    return df.join(ranks.select(*PEER, metric, share.alias(name)), [*PEER, metric], "left")


class PeerStudy:
    """Benchmarks over the monthly hospital performance table."""

    def __init__(self, monthly: DataFrame):
        self.monthly = monthly

    @cached_property
    def summary(self) -> DataFrame:
        """Hospital and procedure over all months, rates weighted by cases; five cases at least."""
        k = F.col("case_count")
        sums = {c: F.coalesce(F.sum(F.col(c) * k), F.lit(0.0)) for c in WEIGHTED}
        out = self.monthly.groupBy(*PAIR).agg(
            F.sum(k).alias("total_cases"), F.count(F.when(k > 0, 1)).alias("active_months"), F.min("month").alias("first_month"),
            F.max("month").alias("last_month"), F.sum("total_amount_claimed").alias("total_amount_claimed"),
            F.sum("total_amount_approved").alias("total_amount_approved"), *[v.alias(c) for c, v in sums.items()],
            *[F.min(c).alias(c) for c in DESCRIPTORS])
        out = out.withColumns({c: safe_div(c, "total_cases") for c in WEIGHTED}).withColumns({
            "avg_amount_claimed": safe_div("total_amount_claimed", "total_cases"),
            "avg_amount_approved": safe_div("total_amount_approved", "total_cases"),
            "avg_approval_ratio": safe_div("total_amount_approved", "total_amount_claimed")})
        return cut_lineage(out.where(F.col("total_cases") >= 5))

    @cached_property
    def cost(self) -> DataFrame:
        out = percentile_of_score(peer_stats(self.summary, "avg_amount_claimed", "peer_cost"), "avg_amount_claimed",
                                  "cost_percentile_rank")
        out = out.withColumns({
            "cost_z_score": peer_z("avg_amount_claimed", "peer_cost"),
            "cost_vs_package": safe_div("avg_amount_claimed", "base_package_price"),
            "approval_gap": F.col("avg_amount_claimed") - F.col("avg_amount_approved"),
            "approval_gap_rate": 1 - F.col("avg_approval_ratio")})
        return out.select(
            *PAIR, "hospital_name", "hospital_type", "procedure_name", "specialty_code", "base_package_price", "total_cases",
            "avg_amount_claimed", "avg_amount_approved", "avg_approval_ratio", "peer_cost_avg", "peer_cost_median",
            "peer_cost_p25", "peer_cost_p75", "peer_hospital_count", "cost_z_score", "cost_vs_package", "cost_percentile_rank",
            "approval_gap", "approval_gap_rate", yes(F.col("cost_z_score") > 1.5).alias("high_cost_outlier"),
            yes(F.col("cost_z_score") < -1.5).alias("low_cost_outlier"),
            yes(F.col("approval_gap_rate") > 0.2).alias("high_approval_gap"),
            yes(F.col("cost_vs_package") > 1.3).alias("above_package_rate"), "small_peer_group")

    @cached_property
    def stay(self) -> DataFrame:
        out = percentile_of_score(peer_stats(self.summary, "avg_los_days", "peer_los"), "avg_los_days", "los_percentile_rank")
        out = out.withColumns({"los_z_score": peer_z("avg_los_days", "peer_los"),
                               "los_vs_peer_median": safe_div("avg_los_days", "peer_los_median")})
        return out.select(
            *PAIR, "hospital_name", "hospital_type", "procedure_name", "total_cases", "avg_los_days", "peer_los_avg",
            "peer_los_median", "peer_los_p25", "peer_los_p75", "los_z_score", "los_percentile_rank", "los_vs_peer_median",
            yes(F.col("los_z_score") > 1.5).alias("long_stay_outlier"),
            yes(F.col("los_z_score") < -1.5).alias("short_stay_outlier"), "small_peer_group")

    @cached_property
    def outcomes(self) -> DataFrame:
        """Leaving against advice; no z-score where the peers' rate is below one percent."""
        stats = self.summary.groupBy(*PEER).agg(
            F.avg("lama_dama_rate").alias("peer_avg_lama_dama_rate"), F.stddev("lama_dama_rate").alias("s"),
            F.avg("normal_discharge_rate").alias("peer_avg_normal_discharge_rate"))
        out = percentile_of_score(self.summary.join(stats, PEER, "left"), "lama_dama_rate", "lama_dama_percentile_rank")
        mean = F.col("peer_avg_lama_dama_rate")
        z = F.when((mean >= 0.01) & (F.col("s") != 0), (F.col("lama_dama_rate") - mean) / F.nullif("s", F.lit(0.0)))
        out = out.withColumn("lama_dama_z_score", z)
        return out.select(
            *PAIR, "hospital_name", "hospital_type", "procedure_name", "total_cases", "lama_dama_rate", "normal_discharge_rate",
            "peer_avg_lama_dama_rate", "peer_avg_normal_discharge_rate", "lama_dama_z_score", "lama_dama_percentile_rank",
            yes(F.col("lama_dama_z_score") > 1.5).alias("high_lama_dama"),
            ((F.col("normal_discharge_rate") > 0.95) & (F.col("total_cases") >= 10)).alias("excellent_retention"))

    @cached_property
    def quality(self) -> DataFrame:
        metrics = {"claim_rejection_rate": ("peer_rej", "rejection_z_score"), "claim_query_rate": ("peer_qry", "query_z_score"),
                   "avg_settlement_tat_days": ("peer_tat", "settlement_tat_z_score")}
        stats = self.summary.groupBy(*PEER).agg(*[
            f(c).alias(f"{p}_{s}") for c, (p, _) in metrics.items()
            for f, s in ((F.avg, "avg"), (F.stddev, "std"), (F.min, "min"), (F.max, "max"))])
        out = self.summary.join(stats, PEER, "left").withColumns({z: peer_z(c, p) for c, (p, z) in metrics.items()})

        def good(c, p):
            low, high = F.col(f"{p}_min"), F.col(f"{p}_max")
            return F.when(low == high, 1.0).otherwise(1 - (F.col(c) - low) / F.nullif(high - low, F.lit(0.0)))

        score = sum((good(c, p) for c, (p, _) in metrics.items()), F.lit(0.0)) / 3
        flags = {name: yes(F.col(z) > 1.5) for name, z in (
            ("high_rejection", "rejection_z_score"), ("high_query", "query_z_score"), ("slow_settlement", "settlement_tat_z_score"))}
        out = out.withColumns({"claims_quality_score": score, **flags})
        bad = sum((F.col(n).cast("int") for n in flags), F.lit(0))
        return out.select(
            *PAIR, "hospital_name", "hospital_type", "procedure_name", "total_cases", "claim_rejection_rate", "claim_query_rate",
            "avg_query_count", "avg_settlement_tat_days", "peer_rej_avg", "peer_qry_avg", "peer_tat_avg",
            *[z for _, z in metrics.values()], "claims_quality_score", *flags, (bad >= 2).alias("poor_claims_quality"),
            ((F.col("claim_rejection_rate") == 0) & (F.col("claim_query_rate") < 0.05) & (F.col("total_cases") >= 10)
             ).alias("clean_claims"))

    @cached_property
    def trends(self) -> DataFrame:
        """Direction of each metric by a case-weighted line over the months, and the overall verdict."""
        chosen = self.summary.where(
            (F.col("active_months") >= 4) & F.col("hospital_id").isNotNull() & F.col("hbp_procedure_code").isNotNull())
        rows = self.monthly.join(chosen.select(*PAIR), PAIR, "left_semi")
        months = rows.agg(F.array_sort(F.collect_set("month"))).scalar()
        rows = rows.withColumn("x", (F.array_position(months, F.col("month")) - 1).cast("double"))
        w, x = F.col("case_count").cast("double"), F.col("x")
        sums = []
        for i, m in enumerate(TREND_METRICS):
            have = F.col(m).isNotNull() & x.isNotNull()
            for name, v in (("n", F.lit(1)), ("w", w), ("wx", w * x), ("wy", w * F.col(m)), ("wxx", w * x * x), ("wxy", w * x * F.col(m))):
                sums.append(F.coalesce(F.sum(F.when(have, v)), F.lit(0)).alias(f"{name}_{i}"))
        out = rows.groupBy(*PAIR).agg(*sums)
        columns, verdicts = {}, []
        for i, (m, good) in enumerate(TREND_METRICS.items()):
            s = {k: F.col(f"{k}_{i}") / F.nullif(F.col(f"w_{i}"), F.lit(0.0)) for k in ("wx", "wy", "wxx", "wxy")}
            spread = s["wxx"] - s["wx"] * s["wx"]
            flat = spread.isNull() | (spread == 0)
            slope = F.when(F.col(f"n_{i}") >= 4, F.when(flat, 0.0).otherwise((s["wxy"] - s["wx"] * s["wy"]) / F.nullif(spread, F.lit(0.0))))
            material = yes((F.abs(slope) / F.nullif(F.abs(s["wy"]), F.lit(0.0))) > 0.05)
            better = slope < 0 if good == "decreasing" else slope > 0
            short = m.replace("avg_", "").replace("claim_", "").replace("_days", "")
            trend = (F.when(F.col(f"n_{i}") < 4, "INSUFFICIENT_DATA").when(~material, "STABLE").when(better, "IMPROVING")
                     .otherwise("DECLINING"))
            columns |= {f"{short}_trend": trend, f"{short}_slope": slope}
            verdicts.append(f"{short}_trend")
        out = out.withColumns(columns)

        def count(value):
            return sum((F.when(F.col(v) == value, 1).otherwise(0) for v in verdicts), F.lit(0))

        up, down, valid = count("IMPROVING"), count("DECLINING"), F.lit(len(verdicts)) - count("INSUFFICIENT_DATA")
        overall = (F.when(valid == 0, "INSUFFICIENT_DATA").when((down == 0) & (up > valid / 2), "IMPROVING")
                   .when((up == 0) & (down > valid / 2), "DECLINING").when((up == 0) & (down == 0), "STABLE").otherwise("MIXED"))
        out = out.withColumn("overall_trajectory", overall).select(*PAIR, *columns, "overall_trajectory")
        return out.withColumns({"declining_hospital": F.col("overall_trajectory") == "DECLINING",
                                "improving_hospital": F.col("overall_trajectory") == "IMPROVING"})

    @cached_property
    def scorecard(self) -> DataFrame:
        """One row per hospital: weighted figures, flags over its procedures, and the attention it needs."""
        parts = {"overall_lama_dama_rate": "lama_dama_rate", "overall_claim_rejection_rate": "claim_rejection_rate",
                 "overall_claim_query_rate": "claim_query_rate", "overall_settlement_tat": "avg_settlement_tat_days",
                 "weighted_avg_los": "avg_los_days", "weighted_avg_cost": "avg_amount_claimed",
                 "biometric_auth_rate": "biometric_auth_rate", "medicines_provided_rate": "medicines_provided_rate"}
        n = F.col("total_cases")
        known = self.summary.where(F.col("hospital_id").isNotNull())
        base = known.groupBy("hospital_id").agg(
            *[F.min(c).alias(c) for c in DESCRIPTORS[:7]], F.countDistinct("hbp_procedure_code").alias("procedures_performed"),
            F.countDistinct("specialty_code").alias("specialties_covered"),
            safe_div(F.sum("total_amount_approved"), F.sum("total_amount_claimed")).alias("overall_approval_ratio"),
            *[safe_div(F.coalesce(F.sum(F.col(src) * n), F.lit(0.0)), F.sum(n)).alias(name) for name, src in parts.items()],
            F.sum("total_cases").alias("total_cases"))
        marks = {"high_cost_outlier": self.cost, "high_approval_gap": self.cost, "long_stay_outlier": self.stay,
                 "high_lama_dama": self.outcomes, "poor_claims_quality": self.quality, "declining_hospital": self.trends}
        rows = None
        for name, df in marks.items():
            one = df.where(F.col("hospital_id").isNotNull()).select(*PAIR, F.lit(name).alias("mark"), F.col(name).cast("int").alias("on"))
            rows = one if rows is None else rows.unionByName(one)
        pairs = rows.groupBy(*PAIR).agg(*[
            F.coalesce(F.max(F.when(F.col("mark") == m, F.col("on"))), F.lit(0)).alias(m) for m in marks])
        pairs = pairs.withColumn("flags", sum((F.col(m) for m in marks), F.lit(0)))
        flags = pairs.groupBy("hospital_id").agg(
            *[F.sum(m).alias(name) for m, name in (
                ("high_cost_outlier", "cost_outlier_procedures"), ("long_stay_outlier", "los_outlier_procedures"),
                ("high_lama_dama", "high_lama_dama_procedures"), ("poor_claims_quality", "poor_claims_procedures"),
                ("declining_hospital", "declining_procedures"))],
            F.sum("flags").alias("total_flags"), F.max("flags").alias("max_flags_single_procedure"),
            F.count(F.when(F.col("flags") == 0, 1)).alias("clean_procedures"))
        out = base.join(flags, "hospital_id", "left").withColumns({
            c: F.coalesce(c, F.lit(0)) for c in ("total_flags", "max_flags_single_procedure")})
        level = (F.when((F.col("total_flags") >= 3) | (F.col("max_flags_single_procedure") >= 3), "NEEDS_REVIEW")
                 .when(F.col("total_flags") >= 1, "WATCH").otherwise("SATISFACTORY"))
        return out.withColumn("attention_level", level)
