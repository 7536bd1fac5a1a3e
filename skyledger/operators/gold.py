"""Gold features: one row for each object, from objects, close approaches and impact-monitoring records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.functions.columns import in_unit

# Columns of each relation with their types, and the columns that completeness counts.
APPROACH = {"min_close_approach_dist": ("min", "dist", "double"), "min_close_approach_dist_min": ("min", "dist_min", "double"), "max_close_approach_v_rel": ("max", "v_rel", "double"),
            "next_close_approach_datetime": ("min", "close_approach_datetime", "string"), "close_approach_count": ("count", "*", "long")}
SENTRY = {f"sentry_{c}": ("max", c, t) for c, t in (("ip", "double"), ("ps_cum", "double"), ("ps_max", "double"), ("ts_max", "double"), ("n_imp", "int"))}
BASE = {"spkid": "string", "des": "string", "full_name": "string", "name": "string", "orbit_class_code": "string", "orbit_class_name": "string", "neo": "boolean", "pha": "boolean",
        "h": "double", "diameter": "double", "albedo": "double", "e": "double", "a": "double", "q": "double", "i": "double", "om": "double", "w": "double", "ma": "double", "n": "double",
        "per": "double", "ad": "double", "moid": "double", "moid_ld": "double", "condition_code": "string", "arc_length": "double", "n_obs_used": "int", "rms": "double"}
# Columns of each relation that may be the base, under the base's names, and the first keys that count.
SOURCES = {"objects": ({"des": "pdes"}, ["spkid", "des", "full_name"]), "sentry": ({"spkid": "spk", "full_name": "fullname"}, ["spkid", "des", "full_name"]),
           "approaches": ({"full_name": "fullname"}, ["des", "full_name"])}
COMPLETENESS = ["h", "diameter", "e", "a", "q", "i", "moid", "min_close_approach_dist", "max_close_approach_v_rel", "sentry_ip",
                "condition_code", "arc_length", "n_obs_used", "rms"]


def padded(df: DataFrame, columns: dict[str, tuple[str, str, str]]) -> DataFrame:
    """Typed nulls for the summary of a relation that isn't there."""
    have = set(df.columns)
    return df.selectExpr("*", *[f"cast(null as {t}) as {c}" for c, (_, _, t) in columns.items() if c not in have])


def summed(df: DataFrame, by: list[str], columns: dict[str, tuple[str, str, str]]) -> DataFrame:
    """The declared aggregates of a relation for each value of ``by``."""
    return df.groupBy(*by).agg(*[F.expr(f"cast({how}({c}) as {t})").alias(name) for name, (how, c, t) in columns.items()])


def base_relation(objects: DataFrame | None = None, sentry: DataFrame | None = None, approaches: DataFrame | None = None) -> DataFrame:
    """The base of the gold table from the first relation that is there: objects, impact records, else approaches.

    Which one is there is known without reading it (None: it isn't). Every base has the same typed columns; those that its
    source hasn't are nulls. Rows need a key, and one row of each key stays: the first by all columns.
    """
    for name, df in (("objects", objects), ("sentry", sentry), ("approaches", approaches)):
        if df is not None:
            own, keys = SOURCES[name]
            have = set(df.columns)
            of = {c: own[c] if own.get(c) in have else c if c in have and not (name != "objects" and c not in ("spkid", "des", "full_name", "h", "diameter")) else None for c in BASE}
            rows = df.selectExpr(*[f"cast({x if x else 'null'} as {BASE[c]}) as {c}" for c, x in of.items()])
            return base_objects(rows, keys)
    raise ValueError("there is neither objects, nor impact records, nor approaches")


def base_objects(objects: DataFrame, keys: list[str], newest: str | None = None) -> DataFrame:
    """Objects with object_key, the first of ``keys`` that isn't null; one row for each key, the newest (then by all columns)."""
    columns = objects.columns
    keyed = objects.selectExpr("*", f"coalesce({', '.join(f'cast({k} as string)' for k in keys)}) as object_key").where("object_key is not null")
    order = ", ".join([f"{newest} desc nulls last"] if newest else []) + (", " if newest else "") + ", ".join(f"`{c}`" for c in columns)
    return keyed.selectExpr("*", f"row_number() over (partition by object_key order by {order}) as _first").where("_first = 1").drop("_first")


def approach_summary(approaches: DataFrame) -> DataFrame:
    """Nearest, fastest, earliest (as text) and number of approaches of each designation."""
    return summed(approaches, ["des"], APPROACH)


def with_approaches(base: DataFrame, approaches: DataFrame | None) -> DataFrame:
    return padded(base, APPROACH) if approaches is None else base.join(approach_summary(approaches), "des", "left")


def sentry_summary(sentry: DataFrame) -> DataFrame:
    return summed(sentry, ["des", "spk"], SENTRY)


def with_sentry(base: DataFrame, sentry: DataFrame | None, unique: bool = False) -> DataFrame:
    """Left join on designation or SPK-ID, by equi-joins in place of the OR (no nested loop).

    An object keeps a row for each group that matches. ``unique`` takes the greatest values instead: a maximum for each
    designation and one for each SPK-ID are joined one after the other, so the base is read and shuffled once for each.
    """
    if sentry is None:
        return padded(base, SENTRY)
    if unique:
        by_des = summed(sentry.where("des is not null"), ["des"], SENTRY)
        by_spk = summed(sentry.where("spk is not null"), ["spk"], SENTRY).select(F.col("spk").alias("spkid"), *[F.col(c).alias(f"_{c}") for c in SENTRY])
        met = base.join(by_des, "des", "left").join(by_spk, "spkid", "left")
        return met.select(*base.columns, *[F.greatest(c, f"_{c}").alias(c) for c in SENTRY])
    groups = sentry_summary(sentry)
    values = groups.columns[2:]
    keys = base.select("object_key", "des", "spkid")
    by_des = keys.join(groups.withColumnRenamed("des", "_d"), F.col("des") == F.col("_d")).select("object_key", F.col("_d"), F.col("spk").alias("_s"), *values)
    by_spk = keys.join(groups.withColumnRenamed("des", "_d"), F.col("spkid") == F.col("spk")).select("object_key", F.col("_d"), F.col("spk").alias("_s"), *values)
    met = by_des.unionByName(by_spk).dropDuplicates(["object_key", "_d", "_s"])
    return base.join(met.drop("_d", "_s"), "object_key", "left")


def _log_share(c: str, top: float) -> str:
    return in_unit(f"log1p(coalesce(cast({c} as double), 0D)) / {top}D")


def _inverse(c: str) -> str:
    return f"case when {c} >= 0 then 1D / (1D + {c}) end"


# Flags, transformed measures and proxy scores.
DERIVED = {
    "sentry_flag": "sentry_ip is not null", "log_diameter": "case when diameter > 0 then log1p(diameter) end", "inverse_moid": _inverse("moid"), "inverse_min_distance": _inverse("min_close_approach_dist"),
    "relative_velocity_score": f"coalesce({in_unit('max_close_approach_v_rel / 50D')}, 0D)",
    "observation_quality_score": in_unit(f"0.45D * {_log_share('n_obs_used', 9.21)} + 0.45D * {_log_share('arc_length', 10.5)} + 0.10D * coalesce(1D / (1D + rms), 0D)"),
    "uncertainty_proxy_score": in_unit("coalesce(try_cast(condition_code as double), 9D) / 9D"),
    "size_proxy_score": f"coalesce(case when diameter > 0 then {in_unit('log1p(diameter) / 2.4D')} end, {in_unit('(30D - h) / 15D')}, 0D)",
    "feature_completeness_ratio": f"({' + '.join(f'if({c} is null, 0D, 1D)' for c in COMPLETENESS)}) / {len(COMPLETENESS)}D",
}
PROXIES = {"proximity_proxy_score": "greatest(coalesce(inverse_min_distance, 0D), coalesce(inverse_moid, 0D))", "sentry_presence_score": "cast(sentry_flag as double)"}


def derived(df: DataFrame) -> DataFrame:
    """Flags, transformed measures and proxy scores, as two projections of SQL text."""
    return df.selectExpr("*", *[f"{x} as {c}" for c, x in DERIVED.items()]).selectExpr("*", *[f"{x} as {c}" for c, x in PROXIES.items()])


def gold(objects: DataFrame | None, approaches: DataFrame | None = None, sentry: DataFrame | None = None, keys: list[str] | None = None, unique: bool = False) -> DataFrame:
    """The gold table as one lazy plan; absent relations become nulls, and without objects another relation is the base."""
    base = base_relation(None, sentry, approaches) if objects is None else base_objects(objects, keys or ["spkid", "des", "full_name"])
    return derived(with_sentry(with_approaches(base, approaches), sentry, unique))
