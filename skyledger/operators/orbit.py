"""Approximate orbital scenarios: clones of each object's elements on a day grid, two-body positions as columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.columns import bounded, normal, number
from skyledger.plans.shared import spread

ELEMENTS = ["a", "e", "i", "om", "w", "ma", "n"]
# Mean motion of a 1 AU orbit in degrees and radians a day.
DEGREES_A_DAY, EARTH_A_DAY = 0.9856076686, 0.017202098955


def uncertainty(df: DataFrame) -> Column:
    """Orbit-quality uncertainty in [0, 1]; missing values count as code 3, rms 0.4, arc 365 and 100 observations."""
    value = lambda c, default: F.greatest(F.coalesce(number(c) if c in df.columns else F.lit(None).cast("double"), F.lit(default)), F.lit(0.0))
    parts = 0.35 * F.least(value("condition_code", 3.0), F.lit(9.0)) / 9.0 + 0.25 * F.least(value("rms", 0.4), F.lit(2.0)) / 2.0
    return bounded(parts + 0.2 / (1.0 + value("arc_length", 365.0) / 365.0) + 0.2 / (1.0 + value("n_obs_used", 100.0) / 250.0))


def elements(df: DataFrame) -> DataFrame:
    """``df`` with complete elements (a to 1, e to 0 within [0, 0.98], angles to 0, n from the period or from a) and element_warnings."""
    have = lambda c: number(c) if c in df.columns else F.lit(None).cast("double")
    bad_a, per = have("a").isNull() | (have("a") <= 0), have("per")
    warnings = [F.when(bad_a, "semi-major axis defaults to 1 AU"), F.when(have("e").isNull(), "eccentricity defaults to 0"),
                *[F.when(have(c).isNull(), f"{c} defaults to 0 degrees") for c in ("i", "om", "w", "ma")],
                F.when((have("n").isNull() | (have("n") <= 0)) & (per.isNull() | (per <= 0)), "mean motion follows from the axis")]
    out = df.withColumns({
        "element_warnings": F.filter(F.array(*warnings), lambda x: x.isNotNull()), "a": F.when(bad_a, 1.0).otherwise(have("a")),
        "e": F.least(F.greatest(F.coalesce(have("e"), F.lit(0.0)), F.lit(0.0)), F.lit(0.98)), **{c: F.coalesce(have(c), F.lit(0.0)) for c in ("i", "om", "w", "ma")},
        "_n": have("n"), "_per": per, "orbital_uncertainty": uncertainty(df),
    })
    return out.withColumn("n", F.when(F.col("_n") > 0, F.col("_n")).when(F.col("_per") > 0, 360.0 / F.col("_per")).otherwise(DEGREES_A_DAY / F.pow("a", F.lit(1.5)))).drop("_n", "_per")


def _clone(clone: Column, seed: int, key: str) -> dict[str, Column]:
    """The elements of a clone of a row of ``elements``; clone -1 is the object itself."""
    own, wide = clone < 0, 0.5 + 4.0 * F.col("orbital_uncertainty")
    z = {c: F.when(~own, normal(F.col(key), F.lit(c), clone, F.lit(seed))).otherwise(0.0) for c in ELEMENTS}
    a, n = F.greatest(F.col("a"), F.lit(0.05)), F.greatest(F.col("n"), F.lit(1e-6))
    moved = {"a": a + F.greatest(F.lit(0.0005), a * 0.0025 * wide) * z["a"], "e": F.col("e") + 0.0015 * wide * z["e"],
             "n": n + F.greatest(F.lit(1e-6), n * 0.0015 * wide) * z["n"],
             **{c: F.col(c) + k * wide * z[c] for c, k in (("i", 0.04), ("om", 0.06), ("w", 0.06), ("ma", 0.08))}}
    return {c: moved[c] for c in ELEMENTS} | {
        "a": F.when(own, a).otherwise(F.least(F.greatest(moved["a"], F.lit(0.05)), F.lit(12.0))), "e": F.least(F.greatest(moved["e"], F.lit(0.0)), F.lit(0.98)), "n": F.greatest(moved["n"], F.lit(1e-6))
    }


def days(horizon: int, step: int) -> range:
    return range(0, (max(horizon, step) + step - 1) // step * step + 1, step)


def _flown(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    """``distances`` of elements (..., 7) on days t, as an array (..., days)."""
    a, e, i, om, w, ma, n = (x[..., k, None] for k in range(len(ELEMENTS)))
    mean = np.mod(np.radians(ma + n * t), 2.0 * np.pi)
    at = mean.copy()
    for _ in range(8):
        at = at - (at - e * np.sin(at) - mean) / np.maximum(1.0 - e * np.cos(at), 1e-9)
    px, py = a * (np.cos(at) - e), a * np.sqrt(np.maximum(0.0, 1.0 - e * e)) * np.sin(at)
    w, om, i, earth = np.radians(w), np.radians(om), np.radians(i), EARTH_A_DAY * t
    x1, y1 = np.cos(w) * px - np.sin(w) * py, np.sin(w) * px + np.cos(w) * py
    dx = np.cos(om) * x1 - np.sin(om) * y1 * np.cos(i) - np.cos(earth)
    dy = np.sin(om) * x1 + np.cos(om) * y1 * np.cos(i) - np.sin(earth)
    dz = y1 * np.sin(i)
    return np.sqrt(dx * dx + dy * dy + dz * dz)


def _quantiles(x: np.ndarray, shares: tuple[float, ...]) -> np.ndarray:
    """Exact quantiles along axis 1, between two places in proportion; the shares come last."""
    x = np.sort(x, axis=1)
    out = []
    for p in shares:
        place = (x.shape[1] - 1) * p
        low = int(place)
        high = min(low + 1, x.shape[1] - 1)
        out.append(x[:, low] if place == low else (high - place) * x[:, low] + (place - low) * x[:, high])
    return np.stack(out, axis=-1)


def _swarms(df: DataFrame, n_clones: int, horizon: int, step: int, seed: int, key: str, made: str, make: Callable) -> DataFrame:
    """(key, orbital_uncertainty, out): ``make`` of each object's distances (objects, clones and itself first, days).

    An object is one row with its clones as an array; its day grid lives only while a few objects are computed, and no
    row of it is sorted, shuffled or spilled.
    """
    if n_clones < 1:
        raise ValueError("at least one clone")
    t = np.array(days(horizon, step))
    base = spread(elements(df).select(key, *ELEMENTS, "orbital_uncertainty"), key)
    swarm = F.transform(F.sequence(F.lit(-1), F.lit(n_clones - 1)), lambda k: F.array(*_clone(k, seed, key).values()))
    wide = base.select(key, "orbital_uncertainty", F.flatten(swarm).alias("swarm"))
    own = wide.schema[key].dataType.simpleString()
    some = max(1, 400_000 // ((n_clones + 1) * len(t)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = part.column(2).flatten().to_numpy().reshape(part.num_rows, n_clones + 1, len(ELEMENTS))
                found = np.concatenate([make(_flown(x[s : s + some], t)) for s in range(0, len(x), some)])
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * found[0].size, pa.int32()), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), rows], [key, "orbital_uncertainty", made])

    return wide.mapInArrow(run, f"`{key}` {own}, orbital_uncertainty double, {made} array<double>")


def clones(df: DataFrame, n_clones: int, seed: int = 42, key: str = "object_key") -> DataFrame:
    """Clone -1 is the object itself; the others have noise by the object's uncertainty, hashed from key, element and clone."""
    out = spread(df, key).withColumn("clone", F.explode(F.sequence(F.lit(-1), F.lit(n_clones - 1))))
    return out.withColumns(_clone(F.col("clone"), seed, key))


def distances(df: DataFrame, horizon: int, step: int) -> DataFrame:
    """``df`` on the day grid with the distance from a body on a circle of 1 AU. Kepler's equation by eight staged Newton steps."""
    out = df.withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(days(horizon, step)[-1]), F.lit(step))))
    out = out.withColumn("_m", F.pmod(F.radians(F.col("ma") + F.col("n") * F.col("day")), F.lit(2.0) * F.pi())).withColumn("_ea", F.col("_m"))
    for _ in range(8):
        out = out.withColumn("_ea", F.col("_ea") - (F.col("_ea") - F.col("e") * F.sin("_ea") - F.col("_m")) / F.greatest(1.0 - F.col("e") * F.cos("_ea"), F.lit(1e-9)))
    out = out.withColumns({"_x": F.col("a") * (F.cos("_ea") - F.col("e")), "_y": F.col("a") * F.sqrt(F.greatest(F.lit(0.0), 1.0 - F.col("e") * F.col("e"))) * F.sin("_ea")})
    w, om, i, t = F.radians("w"), F.radians("om"), F.radians("i"), F.lit(EARTH_A_DAY) * F.col("day")
    out = out.withColumns({"_x1": F.cos(w) * F.col("_x") - F.sin(w) * F.col("_y"), "_y1": F.sin(w) * F.col("_x") + F.cos(w) * F.col("_y")})
    dx = F.cos(om) * F.col("_x1") - F.sin(om) * F.col("_y1") * F.cos(i) - F.cos(t)
    dy = F.sin(om) * F.col("_x1") + F.cos(om) * F.col("_y1") * F.cos(i) - F.sin(t)
    dz = F.col("_y1") * F.sin(i)
    return out.withColumn("distance", F.sqrt(dx * dx + dy * dy + dz * dz)).drop("_m", "_ea", "_x", "_y", "_x1", "_y1")


def category(p05: Column, dispersion: Column, score: Column) -> Column:
    return F.when((p05 <= 0.05) & ((dispersion > 0.35) | (score > 0.55)), "needs_review").when((dispersion > 0.75) | (score > 0.75), "uncertain").when(dispersion > 0.25, "variable").otherwise("stable")


def scenarios(df: DataFrame, n_clones: int = 300, horizon: int = 3650, step: int = 10, seed: int = 42, key: str = "object_key") -> DataFrame:
    """Baseline and clone minima of each object: mean, p05, p50, p95, closest days, dispersion and category."""
    t = np.array(days(horizon, step))

    def minima(far: np.ndarray) -> np.ndarray:
        at = far.argmin(axis=2)  # the first day of equals
        d, day = np.take_along_axis(far, at[..., None], axis=2)[..., 0], t[at].astype(float)
        of = [d[:, :1], day[:, :1], d[:, 1:].mean(axis=1, keepdims=True), _quantiles(d[:, 1:], (0.05, 0.5, 0.95)), day[:, 1:].mean(axis=1, keepdims=True), _quantiles(day[:, 1:], (0.05, 0.95))]
        return np.concatenate(of, axis=1)

    names = ["baseline_distance", "baseline_day", "mean_distance", "p05", "p50", "p95", "closest_mean", "closest_p05", "closest_p95"]
    near = _swarms(df, n_clones, horizon, step, seed, key, "_near", minima)
    out = near.select(key, "orbital_uncertainty", *[F.col("_near")[k].cast("int" if name == "baseline_day" else "double").alias(name) for k, name in enumerate(names)])
    out = out.withColumn("dispersion_index", (F.col("p95") - F.col("p05")) / F.greatest(F.abs("p50"), F.lit(1e-6)))
    return out.withColumn("scenario_category", category(F.col("p05"), F.col("dispersion_index"), F.col("orbital_uncertainty")))


def trace(df: DataFrame, n_clones: int, horizon: int, step: int, seed: int = 42, key: str = "object_key") -> DataFrame:
    """(key, day, p05, p50, p95) of the clones' distances."""
    found = _swarms(df, n_clones, horizon, step, seed, key, "_q", lambda far: _quantiles(far[:, 1:], (0.05, 0.5, 0.95)).reshape(len(far), -1))
    rows = found.select(key, "_q", F.posexplode(F.array(*[F.lit(x) for x in days(horizon, step)])).alias("_k", "day"))
    return rows.select(key, "day", *[F.col("_q")[F.col("_k") * 3 + k].alias(name) for k, name in enumerate(("p05", "p50", "p95"))])


def summary(results: DataFrame) -> DataFrame:
    """Objects of each category with mean and greatest dispersion and the least p05."""
    return results.groupBy("scenario_category").agg(F.count(F.lit(1)).alias("n"), F.avg("dispersion_index").alias("mean_dispersion"), F.max("dispersion_index").alias("max_dispersion"), F.min("p05").alias("min_p05"))
