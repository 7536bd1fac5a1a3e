"""Feature sets as a relation: which columns a set has, of what class, which are refused, and the leakage risk by name."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The features of each set, classes of columns, and the risk of sets by name (all others: low).
FULL = ["h", "diameter", "albedo", "e", "a", "q", "i", "om", "w", "ma", "n", "per", "ad", "moid", "moid_ld", "condition_code", "arc_length", "n_obs_used", "rms",
        "min_close_approach_dist", "min_close_approach_dist_min", "max_close_approach_v_rel", "close_approach_count", "sentry_flag", "sentry_ip", "sentry_ps_cum",
        "sentry_ps_max", "sentry_ts_max", "sentry_n_imp", "log_diameter", "inverse_moid", "inverse_min_distance", "relative_velocity_score", "observation_quality_score",
        "uncertainty_proxy_score", "size_proxy_score", "proximity_proxy_score", "sentry_presence_score", "feature_completeness_ratio"]
DEFINITION, PROXIES = ["h", "diameter", "moid", "moid_ld"], ["inverse_moid", "log_diameter", "size_proxy_score", "proximity_proxy_score"]
IDENTIFIERS = ["object_key", "spkid", "des", "full_name", "name", "raw_json", "built_at_utc", "source_availability_json", "next_close_approach_datetime", "neo", "orbit_class_code", "orbit_class_name"]
SETS = {
    "full_features": FULL,
    "definition_features_only": ["h", "moid", "moid_ld", "diameter", "inverse_moid", "size_proxy_score", "proximity_proxy_score"],
    "no_definition_features": [c for c in FULL if c not in DEFINITION + PROXIES],
    "orbital_only": ["e", "a", "q", "i", "om", "w", "ma", "n", "per", "ad"],
    "approach_and_quality": ["condition_code", "arc_length", "n_obs_used", "rms", "min_close_approach_dist", "min_close_approach_dist_min", "max_close_approach_v_rel", "close_approach_count", "feature_completeness_ratio"],
    "sentry_related": ["sentry_flag", "sentry_ip", "sentry_ps_cum", "sentry_ps_max", "sentry_ts_max", "sentry_n_imp", "sentry_presence_score"],
}
TARGET = "pha"
HIGH, MEDIUM = ["full_features", "definition_features_only", "risk_score_features", "graph_node_features"], ["sentry_related"]


def set_risk(name: Column) -> Column:
    """Leakage risk of a feature set by its name."""
    return F.when(name.isin(HIGH), "high").when(name.isin(MEDIUM), "medium").otherwise("low")


def feature_class(feature: Column, target: str = TARGET) -> Column:
    """direct, identifier, strong_proxy, definition or safe; the target comes before all lists."""
    classes = {"direct": [target, TARGET], "identifier": IDENTIFIERS, "strong_proxy": PROXIES, "definition": DEFINITION}
    out = F.lit("safe")
    for name, columns in reversed(classes.items()):
        out = F.when(feature.isin(columns), name).otherwise(out)
    return out


def resolved(columns: Iterable[str], name: str, target: str = TARGET, sets: dict[str, list[str]] = SETS) -> tuple[list[str], list[str], list[str]]:
    """(usable, missing, refused) features of a set for a table with ``columns``; targets and identifiers are refused."""
    if name not in sets:
        raise ValueError(f"no feature set {name}; there are {', '.join(sets)}")
    have, wanted = set(columns), list(dict.fromkeys(sets[name]))
    refused = [c for c in wanted if c in (target, TARGET, *IDENTIFIERS)]
    asked = [c for c in wanted if c not in refused]
    return [c for c in asked if c in have], [c for c in asked if c not in have], refused


def _filled(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, filled): values of each column, from one aggregate."""
    own = [c for c in dict.fromkeys(columns) if c in df.columns]
    wide = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(f"n{k}") for k, c in enumerate(own)])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"n{k}").alias("filled")) for k, c in enumerate(own)])
    return wide.select(F.explode(cells.cast("array<struct<feature:string,filled:bigint>>")).alias("f")).select("f.*")


def registry(df: DataFrame, target: str = TARGET, sets: dict[str, list[str]] = SETS) -> DataFrame:
    """(feature_set, place, feature, feature_class, state, filled, leakage_risk) of every set, for the table ``df``.

    state is used, missing (no such column) or refused (a target or an identifier); filled counts the column's values.
    """
    rows = []
    for name, wanted in sets.items():
        _, missing, refused = resolved(df.columns, name, target, sets)
        for place, c in enumerate(dict.fromkeys(wanted)):
            rows.append((name, place, c, "refused" if c in refused else "missing" if c in missing else "used"))
    listed = df.sparkSession.createDataFrame(rows, "feature_set string, place int, feature string, state string")
    out = listed.join(_filled(df, [r[2] for r in rows]), "feature", "left")
    return out.select("feature_set", "place", "feature", feature_class(F.col("feature"), target).alias("feature_class"), "state",
                      F.coalesce("filled", F.lit(0)).alias("filled"), set_risk(F.col("feature_set")).alias("leakage_risk"))


def inspected(df: DataFrame, target: str = TARGET) -> DataFrame:
    """(feature, feature_class, filled) of every column of ``df``."""
    return _filled(df, df.columns).withColumn("feature_class", feature_class(F.col("feature"), target))


def used(registry: DataFrame) -> DataFrame:
    """(feature, feature_class, n_sets, filled): each feature that any set uses, with its class, for a leakage report."""
    rows = registry.where("state = 'used'")
    return rows.groupBy("feature", "feature_class").agg(F.count_distinct("feature_set").alias("n_sets"), F.max("filled").alias("filled"))
