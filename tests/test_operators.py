"""Fixtures with known values, and invariants where SQL can't tell."""

import math

import pytest
from pyspark.sql import functions as F

from skyledger import queries as q
from skyledger.functions import columns as c
from skyledger.operators import explain, gold, metrics, orbit, score, simulate
from skyledger.queries import QUERIES
from tests.conftest import SF


def test_gold_row_of_all_sources(spark):
    o = spark.createDataFrame([("2000433", "2026 AB", 10.4, 16.8, 0.22, 1.45, 1.13, 10.8, 0.15, 58.3, "0", 1000.0, 42, 0.12)],
                              "spkid string, des string, h double, diameter double, e double, a double, q double, i double, moid double, moid_ld double, condition_code string, arc_length double, n_obs_used int, rms double")
    a = spark.createDataFrame([("2026 AB", 0.05, 0.04, 11.0, "2026-Jan-01 01:43")], "des string, dist double, dist_min double, v_rel double, close_approach_datetime string")
    s = spark.createDataFrame([("2026 AB", "2000433", 1e-6, -3.2, -3.5, 0.0, 2)], "des string, spk string, ip double, ps_cum double, ps_max double, ts_max double, n_imp int")
    rows = gold.gold(o, a, s, keys=["spkid", "des"]).collect()
    assert len(rows) == 1
    r = rows[0]
    assert r.object_key == "2000433" and r.sentry_flag
    for name, want in {"log_diameter": 2.879198, "inverse_moid": 0.869565, "inverse_min_distance": 0.952381, "relative_velocity_score": 0.22, "observation_quality_score": 0.569147,
                       "uncertainty_proxy_score": 0.0, "size_proxy_score": 1.0, "proximity_proxy_score": 0.952381, "feature_completeness_ratio": 1.0}.items():
        assert math.isclose(r[name], want, abs_tol=1e-6), name


def test_or_join_keeps_each_group(spark):
    base = spark.createDataFrame([("k", "d1", "s1")], "object_key string, des string, spkid string")
    s = spark.createDataFrame([("d1", "s1", 0.1, 0.0, 0.0, 0.0, 1), ("d9", "s1", 0.2, 0.0, 0.0, 0.0, 1)], "des string, spk string, ip double, ps_cum double, ps_max double, ts_max double, n_imp int")
    assert gold.with_sentry(base, s).count() == 2
    assert gold.with_sentry(base, s, unique=True).first().sentry_ip == 0.2


def test_gold_without_relations(spark):
    a = spark.createDataFrame([("d1", 0.05, 0.04, 11.0, "2026-Jan-01 01:43"), (None, 0.1, 0.1, 1.0, "2027")], "des string, dist double, dist_min double, v_rel double, close_approach_datetime string")
    s = spark.createDataFrame([("d1", "s1", 0.1, 0.0, 0.0, 0.0, 1), ("d1", "s1", 0.3, 0.0, 0.0, 0.0, 1), (None, "s2", 0.2, 0.0, 0.0, 0.0, 1), (None, None, 0.9, 0.0, 0.0, 0.0, 1)], "des string, spk string, ip double, ps_cum double, ps_max double, ts_max double, n_imp int")
    of = lambda *frames: {r.object_key: r for r in gold.gold(*frames, keys=["spkid", "des"], unique=True).collect()}
    alone = spark.createDataFrame([("s1", "d1", *[None] * 9)], "spkid string, des string, h double, diameter double, e double, a double, q double, i double, moid double, condition_code string, rms double").withColumns({"arc_length": F.lit(1.0), "n_obs_used": F.lit(1)})
    assert of(alone)["s1"].sentry_ip is None and not of(alone)["s1"].sentry_flag and of(alone, a)["s1"].close_approach_count == 1 and of(alone, None, s)["s1"].sentry_ip == 0.3
    found = of(None, a, s)
    assert set(found) == {"s1", "s2"} and found["s1"].sentry_ip == 0.3 and found["s1"].close_approach_count == 1 and found["s2"].sentry_ip == 0.2 and found["s2"].e is None
    assert set(of(None, a)) == {"d1"} and of(None, a)["d1"].max_close_approach_v_rel == 11.0
    assert [c for c, t in gold.gold(None, a).dtypes if t in ("void", "null")] == []
    with pytest.raises(ValueError):
        gold.gold(None)


def test_score_without_measures(spark):
    r = score.scored(spark.createDataFrame([("x",)], "object_key string")).first()
    assert math.isclose(r.risk_score_0_100, 6.55) and r.risk_category == "low"


def test_weights():
    w = score.weights_of(dict.fromkeys(score.WEIGHTS, 2.0) | {"uncertainty_risk_component": 1.0, "data_quality_component": 1.0})
    assert math.isclose(w["physical_risk_component"], 0.2) and math.isclose(sum(w.values()), 1)
    with pytest.raises(ValueError):
        score.weights_of({"physical_risk_component": -1.0})


def test_lenient_values(spark):
    df = spark.createDataFrame([(" 1.5 ", "Y", " a  b "), ("NaN", "0", "None"), ("", "maybe", None)], "n string, f string, t string")
    rows = df.select(c.number("n"), c.flag("f"), c.designation("t"), c.slug("t")).collect()
    assert [tuple(r) for r in rows] == [(1.5, True, "a b", "a_b"), (None, False, None, "none"), (None, None, None, "sample")]


def test_metrics_of_four_rows(spark):
    df = spark.createDataFrame([("m", 0, 0, 0.1), ("m", 1, 1, 0.9), ("m", 1, 0, 0.4), ("m", 0, 0, 0.2)], "model string, label int, predicted int, score double")
    r = metrics.confusion(df, ["model"]).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.accuracy, r.precision, r.recall) == (1, 0, 1, 2, 0.75, 1.0, 0.5)
    r = metrics.ranked(df, ["model"]).first()
    assert r.roc_auc == 1 and r.average_precision == 1 and math.isclose(r.brier, 0.105)
    assert metrics.ranked(df.where("label = 1"), ["model"]).first().roc_auc is None


def test_simulation_is_reproducible_and_bounded(spark):
    df = spark.createDataFrame([("a", 1.0, 0.02, 1e-5, 20)], "object_key string, diameter double, moid double, sentry_ip double, n_obs_used int")
    one, two = (simulate.perturbed(df.repartition(p), 25).orderBy("simulation_index").collect() for p in (1, 3))
    assert one == two and len(one) == 25
    assert all(r.diameter >= 0 and 0 <= r.sentry_ip <= 1 for r in one) and len({r.moid for r in one}) == 25


def test_orbit_scenarios(spark):
    df = spark.createDataFrame([("A", 1.12, 0.18, 4.2, 80.0, 22.0, 18.0, None, "4", 0.4, 120.0, 35)],
                               "object_key string, a double, e double, i double, om double, w double, ma double, n double, condition_code string, rms double, arc_length double, n_obs_used int")
    e = orbit.elements(df).first()
    assert math.isclose(e.n, 0.831528, abs_tol=1e-6) and math.isclose(e.orbital_uncertainty, 0.531510, abs_tol=1e-6)
    r = orbit.scenarios(df, 12, 120, 30).first()
    assert r.p05 <= r.p50 <= r.p95 and r.scenario_category in ("stable", "variable", "uncertain", "needs_review")
    assert [x.day for x in orbit.trace(df, 3, 120, 30).orderBy("day").collect()] == [0, 30, 60, 90, 120]


@pytest.mark.parametrize("name", ["lr_predictions", "mlp_predictions"])
def test_models_give_probabilities(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert len(rows) == 200 and all(0 <= r.score <= 1 for r in rows) and {r.split for r in rows} == {"train", "test"}


def test_label_propagation_keeps_known(spark):
    rows = QUERIES["label_propagation"](spark, SF).collect()
    assert all(0 <= r.score <= 1 for r in rows) and all(r.score in (0, 1) for r in rows if r.vec_id % 3)


def test_column_builders_keep_null(spark):
    assert spark.range(1).select(c.bounded(F.lit(None).cast("double")), c.band(F.lit(None).cast("double"))).first() == (None, "low")


def test_a_scored_table_is_scored_anew(spark):
    once = QUERIES["risk_scores"](spark, SF).limit(0).columns
    whole = q.scores(spark, SF)
    again = score.scored(whole)
    assert sorted(again.columns) == sorted(whole.columns) and set(once) <= set(again.columns)
    pick = lambda df: {r.object_key: (r.risk_score_0_100, r.risk_category, r.physical_risk_component) for r in df.collect()}
    assert pick(again) == pick(whole)
    n = whole.count()
    runs = QUERIES["score_simulation"](spark, SF).collect()
    assert len(runs) == n and all(r.n_simulations == q.RUNS and r.p05_score <= r.median_score <= r.p95_score for r in runs)
    rolled = QUERIES["simulation_rollup"](spark, SF).first()
    assert rolled.n_objects == n and abs(rolled.mean_of_means - sum(r.mean_score for r in runs) / n) < 1e-3
    places = {}
    for r in QUERIES["sensitivity"](spark, SF).collect():
        places.setdefault(r.object_key, []).append(r.place)
    assert len(places) == n and all(sorted(p) == [1, 2, 3, 4, 5] for p in places.values())


def test_swarms_are_those_of_single_rows_and_nothing_is_sorted(spark):
    rows = [(f"K{k}", 0.7 + 0.4 * k, 0.2 * k, 4.2 * k, 80.0 - k, 22.0 + k, 18.0 * k, str(k), 0.4) for k in range(5)] + [("none", None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "object_key string, a double, e double, i double, om double, w double, ma double, condition_code string, rms double")
    grid = orbit.distances(orbit.clones(orbit.elements(df).select("object_key", *orbit.ELEMENTS, "orbital_uncertainty"), 7), 400, 30)
    q = lambda x, *p: F.percentile(x, F.array(*[F.lit(v) for v in p]))
    near = grid.groupBy("object_key", "clone").agg(F.min("distance").alias("d"), F.min_by("day", "distance").alias("t"))
    want = {r.object_key: r for r in near.where("clone >= 0").groupBy("object_key").agg(F.avg("d").alias("m"), q("d", 0.05, 0.5, 0.95).alias("q"), F.avg("t").alias("t"), q("t", 0.05, 0.95).alias("tq")).collect()}
    own = {r.object_key: r for r in near.where("clone < 0").collect()}
    found = orbit.scenarios(df, 7, 400, 30)
    trace = orbit.trace(df, 7, 400, 30)
    for out in (found, trace):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" not in plan and "Sort" not in plan
    same = lambda x, y: math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        w = want[r.object_key]
        assert all(map(same, (r.baseline_distance, r.baseline_day, r.mean_distance, r.p05, r.p50, r.p95, r.closest_mean, r.closest_p05, r.closest_p95), (own[r.object_key].d, own[r.object_key].t, w.m, *w.q, w.t, *w.tq)))
    by_day = {(r.object_key, r.day): r.q for r in grid.where("clone >= 0").groupBy("object_key", "day").agg(q("distance", 0.05, 0.5, 0.95).alias("q")).collect()}
    got = trace.collect()
    assert {(r.object_key, r.day) for r in got} == set(by_day) and all(all(map(same, (r.p05, r.p50, r.p95), by_day[r.object_key, r.day])) for r in got)


def test_halves_in_texts_go_up_in_sql_too(spark, duck):
    """0.285 is a little less as a double, so a product of doubles rounded it down."""
    values, total = [0.285, 0.145, 0.575, 0.125, 0.065, 0.0], 45.05
    names = dict(zip(score.DRIVERS, values))
    df = spark.createDataFrame([(*names.values(), total, 0.5, "moderate")], ", ".join(f"{c} double" for c in names) + ", risk_score_0_100 double, feature_completeness_ratio double, risk_category string")
    got = explain.explained(df).first()
    ranked = ", ".join(f"{{'o': -{v}e0, 'f': '{score.DRIVERS[c]}'}}" for c, v in sorted(names.items(), key=lambda x: -x[1]))
    (want, shown), = duck.sql(f"select {q._TEXT}, {q.half_up_sql('45.05e0', 1)} from (select [{ranked}] as ranked)").fetchall()
    assert got.technical == want and "physical 0.29" in want and "orbital 0.15" in want
    assert got.explanation.startswith(f"moderate priority, score {shown},") and shown == "45.1"


def test_noise_is_that_of_columns(spark):
    """Numbers hashed in batches are those of ``normal``: for runs of scenarios, long keys and null ones, seeds by row, nulls among values."""
    keys = ["a", "é", "k" * 45, "k" * 60, "x" * 130, None, "2000001", "2000002"]
    df = spark.createDataFrame([(k, 20.0 + i, None if i % 3 == 0 else 0.02 * i, 40 + i % 2 if i else None) for i, k in enumerate(keys)], "object_key string, h double, moid double, s int")
    out = simulate.perturbed(df, 60, F.col("s"))
    z = lambda v: c.normal(F.col("object_key"), F.lit(v), F.col("simulation_index"), F.col("s"))
    base = df.withColumnsRenamed({"h": "h0", "moid": "moid0"}).withColumnRenamed("object_key", "k0").drop("s")
    rows = out.withColumns({"zh": z("h"), "zm": z("moid")}).join(base, F.col("object_key").eqNullSafe(F.col("k0"))).collect()
    assert len(rows) == 60 * len(keys) and {r.simulation_index for r in rows} == set(range(60))
    for r in rows:
        assert math.isclose(r.h, r.h0 + 0.3 * r.zh, abs_tol=1e-12)
        assert r.moid is None if r.moid0 is None else math.isclose(r.moid, r.moid0 * math.exp(0.25 * r.zm), abs_tol=1e-12)


def test_scenarios_are_dealt_out_and_run_compiled(spark, monkeypatch):
    """A few objects stand for much work: their scenarios are made in tasks of a bounded number, in methods that the JVM compiles."""
    limit, seen, write, tasks, spread = "spark.sql.codegen.hugeMethodLimit", [], simulate.materialised, [], simulate.spread
    before = spark.conf.get(limit)
    monkeypatch.setattr(simulate, "materialised", lambda df, name: seen.append(spark.conf.get(limit)) or write(df, name))
    monkeypatch.setattr(simulate, "spread", lambda *a: tasks.append(spread(*a).rdd.getNumPartitions()) or spread(*a))
    monkeypatch.setattr(simulate, "TASK_SCENARIOS", 1000)
    out = simulate.simulated(q.scores(spark, SF), 50, limit=None)
    assert seen == [before, "8000"] and spark.conf.get(limit) == before
    assert tasks == [200 * 50 // 1000]
    assert out.count() == 200 and {r.n_simulations for r in out.collect()} == {50}
    best = simulate.simulated(q.scores(spark, SF), 60, limit=5)
    assert best.count() == 5 and best.agg(F.min("n_simulations")).first()[0] == 60


def test_a_rollup_reads_summaries(spark):
    """The scenarios are made once, when the query is built; what it returns is a sum over written summaries."""
    rolled = QUERIES["simulation_rollup"](spark, SF)
    assert "Generate" not in rolled._jdf.queryExecution().optimizedPlan().toString() and rolled.first().n_objects == 200
