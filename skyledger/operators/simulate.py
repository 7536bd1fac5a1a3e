"""Score stability: perturbed scenarios fanned out over the cluster, scored as columns and summarised per object."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyledger.functions.columns import band, bounded, number
from skyledger.functions.hashed import bits, normals
from skyledger.operators.score import MEASURES, scored
from skyledger.plans.shared import dropped, materialised, small_methods, spread

LOGNORMAL = {"diameter": 0.25, "moid": 0.25, "moid_ld": 0.25, "min_close_approach_dist": 0.20, "min_close_approach_dist_min": 0.20, "sentry_ip": 0.60,
             "arc_length": 0.25, "n_obs_used": 0.25}
VARIABLES = [*LOGNORMAL, "max_close_approach_v_rel", "sentry_ps_cum", "h", "condition_code", "rms"]
#: Scenarios that a task makes at most; it sorts their scores by object.
TASK_SCENARIOS = 1_000_000


def scale(variable: str, v: Column) -> Column:
    """Spread of a variable's noise."""
    if variable in LOGNORMAL:
        return F.lit(LOGNORMAL[variable])
    return {"max_close_approach_v_rel": F.greatest(F.abs(v) * 0.10, F.lit(0.25)), "sentry_ps_cum": F.lit(0.35), "h": F.lit(0.30),
            "condition_code": F.lit(0.75), "rms": F.greatest(F.abs(v) * 0.25, F.lit(0.05))}.get(variable, F.greatest(F.abs(v) * 0.10, F.lit(0.01)))


def perturbed(df: DataFrame, n: int = 1000, seed: Column | int = 42, key: str = "object_key") -> DataFrame:
    """``n`` scenarios of each row (simulation_index from 0), bounded, with derived features made anew.

    Noise is hashed from (key, variable, scenario, seed): the same in any partitioning. Null values stay null, and
    nothing is hashed for them.
    """
    seed = F.lit(seed) if isinstance(seed, int) else seed
    own = [v for v in VARIABLES if v in df.columns]
    if not own:
        return refreshed(df.withColumn("simulation_index", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))))
    whole = df.withColumns({v: number(v) for v in own})
    out = normals(whole, own, n, F.col(key), seed, bits([F.col(v).isNotNull() for v in own]), "simulation_index", "_z")
    made = {}
    for k, v in enumerate(own):
        x, z = F.col(v), F.col("_z")[k]
        noisy = F.when(x > 0, x * F.exp(scale(v, x) * z)).otherwise(x + F.greatest(scale(v, x), F.lit(0.01)) * z) if v in LOGNORMAL else x + scale(v, x) * z
        made[v] = noisy
    out = out.withColumns(made).drop("_z")
    low = {v: F.when(F.col(v).isNotNull(), F.greatest(F.col(v), F.lit(0.0))) for v in own if v not in ("sentry_ps_cum", "h", "sentry_ip", "condition_code")}
    if "sentry_ip" in own:
        low["sentry_ip"] = bounded(F.col("sentry_ip"))
    if "condition_code" in own:
        low["condition_code"] = F.when(F.col("condition_code").isNotNull(), F.least(F.greatest(F.rint("condition_code") + 0.0, F.lit(0.0)), F.lit(9.0)))
    if "n_obs_used" in own:
        low["n_obs_used"] = F.when(F.col("n_obs_used").isNotNull(), F.greatest(F.rint("n_obs_used") + 0.0, F.lit(0.0)))
    return refreshed(out.withColumns(low))


def refreshed(df: DataFrame) -> DataFrame:
    """Derived features of scenarios; they differ from the gold table's in size, uncertainty, velocity and flag rules."""
    made = {}
    if "diameter" in df.columns:
        made["log_diameter"] = F.when(F.col("diameter") > 0, F.log1p("diameter"))
        made["size_proxy_score"] = F.coalesce(bounded(F.log1p("diameter") / F.log1p(F.lit(10.0))), bounded((30.0 - F.col("h")) / 15.0) if "h" in df.columns else F.lit(None), F.lit(0.0))
    if "moid" in df.columns:
        made["inverse_moid"] = 1.0 / (1.0 + F.col("moid"))
    if "min_close_approach_dist" in df.columns:
        made["inverse_min_distance"] = 1.0 / (1.0 + F.col("min_close_approach_dist"))
    if "max_close_approach_v_rel" in df.columns:
        made["relative_velocity_score"] = bounded(F.col("max_close_approach_v_rel") / 50.0)
    if "sentry_ip" in df.columns:
        made["sentry_flag"] = F.coalesce(F.col("sentry_ip"), F.lit(0.0)) > 0
        made["sentry_presence_score"] = (F.coalesce(F.col("sentry_ip"), F.lit(0.0)) > 0).cast("double")
    if "condition_code" in df.columns:
        made["uncertainty_proxy_score"] = F.coalesce(bounded(F.col("condition_code").cast("double") / 9.0), F.lit(0.35))
    return df.withColumns(made)


def stability(shift: Column, std: Column) -> Column:
    return F.when(shift.isNull() & std.isNull(), "unknown").when((shift >= 0.35) | (std >= 15.0), "unstable").when((shift >= 0.10) | (std >= 7.5), "moderate").otherwise("stable")


def simulated(df: DataFrame, n: int = 500, seed: int = 42, limit: int | None = 50, key: str = "object_key") -> DataFrame:
    """Summary of each object's simulated scores: the best ``limit`` objects (all with None), each with seed + rank."""
    base = df if limit is None else df.orderBy(F.desc_nulls_last("risk_score_0_100"), key).limit(limit)
    place = F.row_number().over(W.orderBy(F.desc_nulls_last("risk_score_0_100"), key)) - 1 if limit is not None else F.lit(0)
    base = base.withColumns({"_seed": F.lit(seed) + place, "base_category": F.col("risk_category"), "base_score": F.col("risk_score_0_100")})
    used = [c for c in base.columns if c in {*MEASURES, *VARIABLES, "sentry_flag"} and c != key]
    base = materialised(base.select(key, *used, "_seed", "base_category", "base_score"), "simulated")
    dealt = spread(base, key, math.ceil(base.count() * n / TASK_SCENARIOS))  # the scenarios of a few best objects are made in many tasks
    runs = scored(perturbed(dealt, n, F.col("_seed"), key)).select(key, "base_category", "base_score", F.col("risk_score_0_100").alias("s"), "risk_category")
    q = F.percentile("s", F.array(*[F.lit(p) for p in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    out = runs.groupBy(key, "base_score", "base_category").agg(
        F.count(F.lit(1)).alias("n_simulations"), F.avg("s").alias("mean_score"), F.stddev_pop("s").alias("std_score"), F.min("s").alias("min_score"), q.alias("q"),
        F.max("s").alias("max_score"), F.avg((F.col("s") > 60).cast("double")).alias("probability_high"), F.avg((F.col("s") > 80).cast("double")).alias("probability_critical"),
        F.avg((F.col("risk_category") != F.col("base_category")).cast("double")).alias("category_shift_probability"),
    )
    with small_methods(df.sparkSession):
        out = materialised(out, "simulations")
    dropped(base)
    names = ["p05_score", "p25_score", "median_score", "p75_score", "p95_score"]
    out = out.withColumns({name: F.col("q")[k] for k, name in enumerate(names)}).drop("q")
    return out.withColumns({"p95_category": band(F.col("p95_score")), "stability": stability(F.col("category_shift_probability"), F.col("std_score"))})


def rollup(results: DataFrame) -> DataFrame:
    return results.agg(F.count(F.lit(1)).alias("n_objects"), F.avg("mean_score").alias("mean_of_means"), F.max("p95_score").alias("max_p95"))


def sensitivity(df: DataFrame, variables: list[str] = VARIABLES, share: float = 0.1, key: str = "object_key", limit: int | None = None) -> DataFrame:
    """Score with each variable lowered and raised by ``share``, alone; the greatest effects first (place)."""
    own = [v for v in variables if v in df.columns]
    signs = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(s).alias("s")) for v in own for s in (-1.0, 1.0)])
    runs = df.withColumn("_r", F.explode(signs))
    runs = runs.withColumns({v: F.when(F.col("_r.v") == v, number(v) * (1.0 + share * F.col("_r.s"))).otherwise(number(v)) for v in own})
    runs = scored(runs).withColumn("_has", F.coalesce(*[F.when(F.col("_r.v") == v, F.col(v)) for v in own]).isNotNull()).where("_has")
    out = runs.groupBy(key, F.col("_r.v").alias("variable")).agg(
        F.max(F.when(F.col("_r.s") < 0, F.col("risk_score_0_100"))).alias("score_low"), F.max(F.when(F.col("_r.s") > 0, F.col("risk_score_0_100"))).alias("score_high")
    )
    out = out.withColumns({"absolute_effect": F.round(F.abs(F.col("score_high") - F.col("score_low")), 6), "direction": F.when(F.col("score_low") > F.col("score_high"), "increases_risk_when_lower").when(F.col("score_high") > F.col("score_low"), "increases_risk_when_higher").otherwise("mixed_or_low_effect")})
    out = out.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(F.desc("absolute_effect"), "variable")))
    return out if limit is None else out.where(F.col("place") <= limit)
