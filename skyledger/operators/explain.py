"""Explanations of a score, and indicators of an object's parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.columns import bounded, log_share, mean_of, number, palermo_signal, probability_signal, staged, text
from skyledger.operators.gold import SENTRY
from skyledger.operators.score import DRIVERS

# Fields whose absence limits a score.
LIMITING = ["diameter", "h", "moid", "min_close_approach_dist", "max_close_approach_v_rel", "condition_code", "arc_length", "n_obs_used", "rms"]
PROTECTIVE = {"orbital_risk_component": "orbital_distance", "sentry_risk_component": "limited_sentry_signal", "physical_risk_component": "physical_size_signal"}


def explained(df: DataFrame) -> DataFrame:
    """``df`` with drivers (at least 0.45, else the greatest; four at most), protective factors, limitations, a sentence and all components as text.

    A column that isn't there counts as missing in every row. Numbers in texts are their six places rounded, halves up.
    """
    have = lambda c: F.col(c) if c in df.columns else F.lit(None)
    parts = F.array(*[F.struct((-F.col(c)).alias("order"), F.lit(k).alias("place"), F.lit(name).alias("factor"), F.round(c, 6).alias("value")) for k, (c, name) in enumerate(DRIVERS.items())])
    df = df.withColumn("_ranked", F.array_sort(F.filter(parts, lambda p: p["order"].isNotNull())))
    df = df.withColumn("_strong", F.filter("_ranked", lambda p: p["order"] <= -0.45))
    df = df.withColumn("_drivers", F.when(F.size("_strong") > 0, F.slice("_strong", 1, 4)).otherwise(F.slice("_ranked", 1, 1)))
    low = [F.when(F.col(c) <= 0.20, name) for c, name in PROTECTIVE.items()] + [F.when(F.col("feature_completeness_ratio") >= 0.75, "feature_completeness")]
    df = df.withColumn("_missing", F.filter(F.array(*[F.when(have(c).isNull(), c) for c in LIMITING]), lambda x: x.isNotNull()))
    limits = [F.when(F.size("_missing") >= 4, F.concat(F.lit("without "), F.array_join(F.slice("_missing", 1, 5), ", "))),
              F.when(F.col("feature_completeness_ratio") < 0.60, "completeness under 0.60"),
              F.when(number(have("arc_length")) < 30, "arc under 30 days"),
              F.when(number(have("n_obs_used")) < 20, "fewer than 20 observations"),
              F.lit(None if any(c in df.columns for c in SENTRY) else "no monitoring fields").cast("string")]
    present = lambda xs: F.slice(F.filter(F.array(*xs), lambda x: x.isNotNull()), 1, 4)
    out = df.withColumns({"drivers": F.transform("_drivers", lambda p: p["factor"]), "driver_values": F.transform("_drivers", lambda p: p["value"]),
                          "protective": present(low), "limitations": present(limits)})
    sentence = F.format_string("%s priority, score %.1f, led by %s", F.col("risk_category"), F.round("risk_score_0_100", 1), F.replace(F.coalesce(F.get("drivers", F.lit(0)), F.lit("none")), F.lit("_"), F.lit(" ")))
    shown = F.array_join(F.transform("_ranked", lambda p: F.format_string("%s %.2f", p["factor"], F.round(p["value"], 2))), ", ")
    return out.withColumns({"explanation": sentence, "technical": shown}).drop("_ranked", "_strong", "_drivers", "_missing")


def best_identifier(df: DataFrame, columns: list[str], default: str) -> Column:
    return F.coalesce(*[text(c) for c in columns if c in df.columns], F.lit(default))


# The columns that name an object, the most useful first.
NAMES = ["name", "full_name", "des", "spkid", "object_key"]


def display_name(df: DataFrame) -> Column:
    """The most useful label of an object; blanks and words for missing don't count."""
    return best_identifier(df, NAMES, "Unknown object")


def indicators(df: DataFrame) -> DataFrame:
    """``df`` with proximity, uncertainty, size, approach and sentry indicators and the has-data flags."""
    measures = ["moid", "moid_ld", "min_close_approach_dist", "min_close_approach_dist_min", "diameter", "log_diameter", "h", "condition_code", "rms",
                "arc_length", "n_obs_used", "max_close_approach_v_rel", "close_approach_count", "sentry_ip", "sentry_ps_cum", "sentry_ps_max", "sentry_ts_max", "sentry_n_imp"]
    clean = df.withColumns({f"_m_{c}": number(c) for c in measures})
    m = lambda c: F.col(f"_m_{c}")
    near, size = F.coalesce(m("min_close_approach_dist_min"), m("min_close_approach_dist")), F.log1p(F.lit(10.0))
    parts = {
        "uncertainty_indicator": [bounded(m("condition_code") / 9.0), bounded(m("rms") / 2.0), 1.0 - log_share(m("arc_length"), 3650.0), 1.0 - log_share(m("n_obs_used"), 1000.0)],
        "approach_indicator": [F.when(near >= 0, bounded(1.0 / (1.0 + near * 25.0))), bounded(m("max_close_approach_v_rel") / 50.0), log_share(m("close_approach_count"), 25.0)],
        "sentry_indicator": [F.col("sentry_flag").cast("double"), probability_signal(m("sentry_ip")), palermo_signal(m("sentry_ps_cum")), palermo_signal(m("sentry_ps_max")),
                             bounded(m("sentry_ts_max") / 10.0), log_share(m("sentry_n_imp"), 100.0)],
    }
    return staged(clean, parts, lambda _, cols: mean_of(cols)).withColumns({
        "proximity_indicator": F.coalesce(F.when(m("moid") >= 0, bounded(1.0 / (1.0 + m("moid") * 20.0))), F.when(m("moid_ld") >= 0, bounded(1.0 / (1.0 + m("moid_ld") / 10.0)))),
        "size_indicator": F.coalesce(F.when(m("diameter") > 0, bounded(F.log1p(m("diameter")) / size)), F.when(m("log_diameter") > 0, bounded(m("log_diameter") / size)), bounded((30.0 - m("h")) / 15.0)),
        "has_orbit": F.col("e").isNotNull() & F.col("a").isNotNull() & F.col("q").isNotNull() & F.col("i").isNotNull(),
        "has_size": F.col("h").isNotNull() | F.col("diameter").isNotNull(),
        "has_approach": F.coalesce(F.col("min_close_approach_dist").cast("string"), F.col("close_approach_count").cast("string")).isNotNull(),
        "has_sentry": F.coalesce("sentry_flag", F.lit(False)) | F.col("sentry_ip").isNotNull(),
    }).drop(*[f"_m_{c}" for c in measures])


def nested(df: DataFrame, *beside: str) -> DataFrame:
    """The object as structs: identity, orbit, physical, approach and sentry (null where they hold nothing), and columns ``beside``."""
    approach = F.struct("min_close_approach_dist", "max_close_approach_v_rel", "close_approach_count")
    return df.select(
        "object_key", F.struct("des", "spkid", "full_name").alias("identity"), F.struct("e", "a", "q", "i", "moid").alias("orbit"),
        F.struct("h", "diameter").alias("physical"), F.when(F.col("close_approach_count").isNotNull(), approach).alias("approach"),
        F.when(F.col("sentry_ip").isNotNull(), F.struct("sentry_ip", "sentry_ps_cum")).alias("sentry"), *beside,
    )
