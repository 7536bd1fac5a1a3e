"""Explainable weighted score: six components over whatever measures a row has."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.columns import TRUE_WORDS, band, in_unit

# Weights of the components.
WEIGHTS = {"physical_risk_component": 0.22, "orbital_risk_component": 0.25, "approach_risk_component": 0.18,
           "sentry_risk_component": 0.17, "uncertainty_risk_component": 0.13, "data_quality_component": 0.05}
MEASURES = ["diameter", "h", "log_diameter", "size_proxy_score", "moid", "moid_ld", "inverse_moid", "q", "e", "i", "min_close_approach_dist",
            "min_close_approach_dist_min", "inverse_min_distance", "max_close_approach_v_rel", "relative_velocity_score", "close_approach_count",
            "sentry_presence_score", "sentry_ip", "sentry_ps_cum", "sentry_ps_max", "sentry_ts_max", "sentry_n_imp", "condition_code", "rms",
            "arc_length", "n_obs_used", "uncertainty_proxy_score", "feature_completeness_ratio"]
DRIVERS = {"physical_risk_component": "physical", "orbital_risk_component": "orbital", "approach_risk_component": "approach",
           "sentry_risk_component": "sentry", "uncertainty_risk_component": "uncertainty", "data_quality_component": "data_quality"}


def weights_of(weights: dict[str, float] | None) -> dict[str, float]:
    """Checked weights that sum to one."""
    weights = WEIGHTS if weights is None else weights
    if missing := [c for c in WEIGHTS if c not in weights]:
        raise ValueError(f"weights are missing for {missing}")
    if any(not math.isfinite(weights[c]) or weights[c] < 0 for c in WEIGHTS) or not sum(weights[c] for c in WEIGHTS) > 0:
        raise ValueError("weights must be finite, not negative, and have a positive sum")
    total = sum(weights[c] for c in WEIGHTS)
    return {c: weights[c] / total for c in WEIGHTS} if abs(total - 1) > 1e-6 else {c: weights[c] for c in WEIGHTS}


def _share(x: str, top: float) -> str:
    return in_unit(f"log1p(greatest({x}, 0D * {x})) / log1p({top}D)")


def _near(x: str, k: float) -> str:
    """1 for 0 and below, falling with x."""
    return f"1D / (1D + greatest({x}, 0D * {x}) * {k}D)"


def _palermo(x: str) -> str:
    return in_unit(f"({x} + 8D) / 10D")


# Parts of each component with their weights, and its value without any; m_ marks a cleaned measure.
_ARC, _OBS, _SIZE = f"1D - {_share('m_arc_length', 3650.0)}", f"1D - {_share('m_n_obs_used', 1000.0)}", "log1p(10D)"
PARTS: dict[str, tuple[list[tuple[str, float]], float]] = {
    "physical_risk_component": ([(in_unit(f"log1p(nullif(m_diameter, 0D)) / {_SIZE}"), 0.35), (in_unit("(30D - m_h) / 15D"), 0.30),
                                 (in_unit(f"nullif(m_log_diameter, 0D) / {_SIZE}"), 0.15), (in_unit("m_size_proxy_score"), 0.20)], 0.0),
    "orbital_risk_component": ([(_near("m_moid", 20.0), 0.35), (_near("m_moid_ld", 0.1), 0.20), (in_unit("m_inverse_moid"), 0.15),
                                (in_unit("(1.3D - m_q) / 1.3D"), 0.10), (in_unit("m_e"), 0.12), (in_unit("m_i / 40D"), 0.08)], 0.0),
    "approach_risk_component": ([(_near("m_min_close_approach_dist", 25.0), 0.28), (_near("m_min_close_approach_dist_min", 25.0), 0.20), (in_unit("m_inverse_min_distance"), 0.14),
                                 (in_unit("m_max_close_approach_v_rel / 50D"), 0.16), (in_unit("m_relative_velocity_score"), 0.12), (_share("m_close_approach_count", 25.0), 0.10)], 0.0),
    "sentry_risk_component": ([("cast(m_sentry_flag as double)", 0.20), (in_unit("m_sentry_presence_score"), 0.15),
                               ("case when m_sentry_ip <= 1e-10D then 0D when m_sentry_ip >= 1D then 1D else (log10(m_sentry_ip) + 10D) / 10D end", 0.25),
                               (_palermo("m_sentry_ps_cum"), 0.13), (_palermo("m_sentry_ps_max"), 0.12), (in_unit("m_sentry_ts_max / 10D"), 0.10), (_share("m_sentry_n_imp", 100.0), 0.05)], 0.0),
    "uncertainty_risk_component": ([(in_unit("m_condition_code / 9D"), 0.28), (in_unit("m_rms / 2D"), 0.18), (_ARC, 0.22), (_OBS, 0.20), (in_unit("m_uncertainty_proxy_score"), 0.12)], 0.35),
    "data_quality_component": ([(f"1D - {in_unit('m_feature_completeness_ratio')}", 0.50), (_ARC, 0.25), (_OBS, 0.25)], 0.40),
}


def components(df: DataFrame) -> DataFrame:
    """``df`` with the six components, in the place of any it has; measures that the table lacks count as missing.

    Three projections as SQL text: the measures as finite numbers, the parts of all components (each a column, so that
    it is computed once), and their weighted means over the parts that are there.
    """
    columns = df.columns
    have, kept = set(columns), [f"`{c}`" for c in columns if c not in PARTS]
    measures = [f"case when abs(try_cast({c} as double)) < double('infinity') then try_cast({c} as double) end as m_{c}" if c in have else f"cast(null as double) as m_{c}" for c in MEASURES]
    flagged = "case when lower(trim(cast(sentry_flag as string))) in ('" + "', '".join(TRUE_WORDS) + "') then true else false end" if "sentry_flag" in have else "false"
    named = {name: [(f"p_{k}_{j}", part, w) for j, (part, w) in enumerate(parts)] for k, (name, (parts, _)) in enumerate(PARTS.items())}
    cells = [f"{part} as {p}" for parts in named.values() for p, part, _ in parts]
    made = []
    for name, parts in named.items():
        mean = " + ".join(f"coalesce({p} * {w}D, 0D)" for p, _, w in parts)
        total = " + ".join(f"if({p} is null, 0D, {w}D)" for p, _, w in parts)
        made.append(f"{in_unit(f'coalesce(try_divide({mean}, {total}), {PARTS[name][1]}D)')} as {name}")
    return df.selectExpr(*kept, *measures, f"{flagged} as m_sentry_flag").selectExpr(*kept, *cells).selectExpr(*kept, *made)


def scored(df: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``df`` with components, risk_score (0 to 1), risk_score_0_100 (six places) and risk_category, in the place of any it has."""
    own = weights_of(weights)
    total = " + ".join(f"{c} * {w!r}D" for c, w in own.items())
    out = components(df.drop("risk_score", "risk_score_0_100")).selectExpr("*", f"{in_unit(total)} as risk_score").selectExpr("*", "round(risk_score * 100D, 6) as risk_score_0_100")
    return out.withColumn("risk_category", band(F.col("risk_score_0_100")))


def dominant_driver(prefix: str = "") -> Column:
    """The component with the greatest value, the first of equals."""
    top = F.greatest(*[F.coalesce(F.col(prefix + c), F.lit(-1.0)) for c in DRIVERS])
    out = F.lit(None).cast("string")
    for c, name in reversed(DRIVERS.items()):
        out = F.when(F.col(prefix + c) == top, name).otherwise(out)
    return out
