"""Edge rows of sinks, reports and discovery."""

import pytest
from pyspark.sql import functions as F

from skyledger.operators import discovery, evidence, explain, metrics, quality, reports
from skyledger.queries import scores
from skyledger.sources import sinks
from tests.conftest import SF


def test_an_empty_overwrite_keeps_the_table(spark, tmp_path):
    df, path = spark.range(5), str(tmp_path / "t")
    assert sinks.write_table(df, path)["row_count"] == 5 and sinks.write_table(df.where("false"), path)["status"] == "skipped_empty"
    assert sinks.write_table(df, path, "append")["row_count"] == 5 and spark.read.parquet(path).count() == 10


def test_explained_without_columns(spark):
    whole = scores(spark, SF)
    row = explain.explained(whole.drop("moid", "rms")).first()
    assert row.explanation and len(row.drivers) >= 1


def test_dense_ids_and_batches(spark):
    df = spark.createDataFrame([(k * 7 % 251,) for k in range(251)], "k long").repartition(5)
    assert sorted((r.k, r.i) for r in reports.dense_ids(df, "k", "i").collect()) == [(k, k) for k in range(251)]
    assert reports.dense_ids(df.where("false"), "k", "i").isEmpty()
    got = {r.k: (r.batch, r.checkpoint) for r in reports.batches(df, "k").collect()}
    assert got[0] == (0, False) and got[49] == (0, True) and got[100] == (1, False) and got[250] == (2, False)


def test_experiments_are_skipped(spark):
    df = spark.createDataFrame([(k, float(k), k < 4) for k in range(120)], "id long, e double, pha boolean")
    grid = reports.experiment_grid(df, {"own": ["e"], "none": ["x"]}, ["m"], "pha")
    assert {r.feature_set: r.status for r in grid.collect()} == {"own": "insufficient_data", "none": "skipped_no_features"}
    assert reports.grid_status(grid).first().run_status == "nothing"
    assert reports.grid_status(reports.experiment_grid(df.withColumn("pha", F.col("id") < 9), {"own": ["e"]}, ["m"], "pha")).first().run_status == "complete"


def test_candidates_by_priority(spark):
    df = spark.createDataFrame([(1, " b ", "a"), (2, None, "433"), (3, "nan", "c")], "id long, x string, y string")
    got = discovery.extended([discovery.seed(spark, 2), discovery.from_columns(df, ["x", "y"], "id")]).orderBy("source", "place", "row").collect()
    assert [r.candidate for r in got] == ["99942", "433", "b", "a", "c"]
    assert [r.candidate for r in discovery.filled(discovery.extended([discovery.seed(spark, 2)]), spark.createDataFrame([("433",)], "k string"), "k", 9).collect()] == ["99942"]


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_ranked_by_brute_force(spark, scale):
    rows = [(k % 3 == 0, (k * k % 17) * scale) for k in range(60)]
    df = spark.createDataFrame([("m", int(y), s) for y, s in rows], "model string, label int, score double")
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert abs(metrics.ranked(df, ["model"]).first().roc_auc - want) < 1e-9
    assert metrics.ranked(df.where("label = 1"), ["model"]).first().roc_auc is None


def test_readiness_of_each_use(spark):
    rows = spark.createDataFrame([(k, k % 2 == 0, float(k), 1.0, 2.0) for k in range(350)], "id long, pha boolean, e double, a double, q double")
    of = lambda f, s: {r.consumer: r.status for r in quality.consumers(f, s).collect()}
    assert of(rows, rows) == {"overall": "usable", "models": "usable", "leakage": "usable", "ranking": "usable", "simulation": "usable", "graph": "usable", "reports": "usable"}
    one = rows.withColumn("pha", F.lit(True))
    assert of(one, one.limit(0))["models"] == of(one, one.limit(0))["graph"] == "minimal" and of(one, one.limit(0))["simulation"] == "not_ready"
    assert of(rows.drop("q"), rows)["graph"] == "minimal" and of(rows.limit(50), rows.limit(50))["graph"] == "not_ready"
    assert [(r.target, r.available) for r in quality.targets(rows, (10, 1000)).collect()] == [(10, True), (1000, False)]


def test_sources_add_what_is_new(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string")
    found = discovery.extended([discovery.from_columns(df, ["x"], "id"), discovery.from_columns(df, ["x"], "id"), discovery.seed(spark, 2)])
    assert [(r.source, r.n_new, r.n_so_far) for r in discovery.new_counts(found, 4).orderBy("source").collect()] == [(0, 2, 2), (1, 0, 2), (2, 2, 4), (3, 0, 4)]


def test_names_of_objects(spark):
    df = spark.createDataFrame([("nan", "Full", "d"), (None, " ", "d"), (None, None, None)], "name string, full_name string, des string")
    assert [r.n for r in df.select(explain.display_name(df).alias("n")).collect()] == ["Full", "d", "Unknown object"]


def test_rows_of_one_partition_are_dealt_out(spark, tmp_path):
    rows = [(k, m, k % 2, (k + m) % 2, "high" if k % 3 else "low", 0.5, "low", "full" if k % 4 else "eval") for k in range(400) for m in range(2)]
    df = spark.createDataFrame(rows, "object_key int, model int, label int, predicted int, confidence string, score double, leakage_risk string, prediction_mode string").coalesce(1)
    found, path = evidence.disagreements(df), str(tmp_path / "bundle")
    plan = found._jdf.queryExecution().sparkPlan().toString() + found._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.rindex("Aggregate") < plan.rindex("Exchange")  # no aggregate below the exchange
    assert sorted((r.object_key, r.labels, r.models) for r in found.collect()) == [(k, 2, 2) for k in range(400)]
    assert dict(found.dtypes)["labels"] == "bigint"
    assert sinks.write_bundle(df, path)["row_count"] == 800
    names = spark.read.parquet(f"{path}/predictions").inputFiles()
    assert len({x.rsplit("/part-", 1)[1][:5] for x in names}) > 1  # several tasks wrote it
