"""Sinks, captures, silver tables and composed runs: edge rows, counts of jobs, pruned folders."""

import uuid

import pytest
from pyspark.sql import functions as F

from skyledger import layer_queries
from skyledger.operators import quality, reports
from skyledger.plans import runs
from skyledger.queries import predictions
from skyledger.sources import bronze, silver, sinks
from tests.conftest import SF


def jobs(spark, f):
    name = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = f()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_rows_are_counted_by_the_write(spark, tmp_path):
    path = str(tmp_path / "t")
    done, n = jobs(spark, lambda: sinks.write_table(spark.range(1000, numPartitions=3), path))
    assert (done["row_count"], done["status"], n) == (1000, "written", 1)
    done, n = jobs(spark, lambda: sinks.write_table(spark.range(7), path, "append"))
    assert done["row_count"] == 7 and n == 1 and spark.read.parquet(path).count() == 1007
    done = sinks.write_table(spark.read.parquet(path).where("id < 5"), path)  # a table may be made from itself
    assert done["row_count"] == spark.read.parquet(path).count() == 10
    for empty in (spark.range(3).where("id > 5"), spark.range(3).where("false"), spark.range(3).limit(0)):
        assert sinks.write_table(empty, path)["status"] == "skipped_empty" and spark.read.parquet(path).count() == 10
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_bundle_reads_only_its_folders(spark, tmp_path):
    p, path = predictions(spark, SF), str(tmp_path)
    like = p.withColumn("error_kind", F.lit(""))
    assert sinks.read_bundle(spark, path, like).isEmpty() and sinks.read_disagreements(spark, path) is None
    assert sinks.write_bundle(p, path, "p_partkey")["row_count"] == p.count()
    subset = sinks.read_bundle(spark, path, like, "full", "high", "false_negative")
    plan = subset._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(prediction_mode" in plan and "error_kind" in plan.split("PartitionFilters")[1]
    want = p.where("prediction_mode = 'full' and confidence = 'high' and label = 1 and predicted = 0")
    assert subset.count() == want.count() and sinks.read_bundle(spark, path, like, "anything").count() == p.where("prediction_mode = 'full'").count()
    found = sinks.object_evidence(spark, path, like, spark.createDataFrame([(1,), (-5,)], "p_partkey long"), "p_partkey").collect()
    assert {r.p_partkey: (r.status, r.predictions is None) for r in found} == {1: ("success", False), -5: ("not_found", True)}


def test_scores_and_their_summary(spark, tmp_path):
    df = spark.createDataFrame([(f"k{i}", float(i), "low" if i < 5 else "high", [1]) for i in range(9)], "object_key string, risk_score_0_100 double, risk_category string, parts array<int>")
    assert sinks.write_scored(df, str(tmp_path), 3)["row_count"] == 9
    assert [r.object_key for r in spark.read.option("header", True).csv(f"{tmp_path}/top").collect()] == ["k8", "k7", "k6"]
    row = spark.read.json(f"{tmp_path}/summary").first()
    assert (row.n_rows, row.max_score, row.categories.asDict()) == (9, 8.0, {"high": 4, "low": 5})
    assert sinks.write_scored(df.where("false"), str(tmp_path / "none"))["status"] == "skipped_empty"
    assert "trace" not in spark.read.parquet(sinks.write_results(df.withColumn("trace", F.lit(1)), str(tmp_path / "r"), ("trace",))["path"]).columns


def test_first_of_the_tables_that_hold_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    none = spark.range(3).where("false")
    assert sinks.first_available(spark, [None, none, f"{tmp_path}/absent", path, spark.range(9)], "id long").count() == 3
    assert sinks.first_available(spark, [None, none], "id long").isEmpty()


def test_scores_are_attached_to_what_is_there(spark):
    gold = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "object_key string, h double")
    risk = spark.createDataFrame([("a", 50.0, "elevated")], "object_key string, risk_score_0_100 double, risk_category string")
    rows = {r.object_key: r.risk_category for r in reports.attach_scores(gold, risk).collect()}
    assert rows == {"a": "elevated", "b": None}
    assert reports.attach_scores(gold.where("false"), risk).count() == 1 and reports.attach_scores(None, risk).count() == 1
    assert reports.attach_scores(gold, risk.where("false")).columns == gold.columns and reports.attach_scores(gold, None).count() == 2


def landed(spark, root, source, payload, n=1):
    rows = spark.range(n).select(F.col("id").cast("string").alias("k"), F.expr(payload).alias("data"))
    bronze.land(bronze.landed(rows, source, "k", F.lit("2026-05-28 07:00:00"), F.col("data")), root)


def test_captures_without_fields(spark, tmp_path):
    root = str(tmp_path / "in")
    with pytest.raises(bronze.SourceNotFound, match="objects"):
        bronze.read(spark, root, source="objects")
    landed(spark, root, "objects", "named_struct('object', named_struct('spkid', '2', 'pha', 'Y', 'h', '9.5'))")
    captures = bronze.read(spark, root, source="objects")
    row = silver.objects(captures).first()
    assert len(row) == 38 and (row.object_id, row.spkid, row.pha, row.h, row.e, row.moid_ld) == ("0", "2", True, 9.5, None, None)
    assert silver.summaries(captures).isEmpty() and silver.impactors(captures).isEmpty() and silver.approaches(captures).isEmpty()
    assert len(silver.summaries(captures).columns) == 15 and len(silver.impactors(captures).columns) == 15
    event = silver.events(captures).first()
    assert (event.ingest_date, event.query_params_json, event.api_signature_version) == ("2026-05-28", "{}", "1") and "source=objects" in event.bronze_file_path
    with pytest.raises(bronze.SourceNotFound):
        bronze.read(spark, root, source="sentry")


def test_records_go_by_their_markers(spark, tmp_path):
    root = str(tmp_path)
    landed(spark, root, "sentry", "named_struct('data', array(named_struct('des', 'a', 'ps_cum', '-2.5', 'date', cast(null as string), 'sigma_vi', cast(null as string)), named_struct('des', 'b', 'ps_cum', cast(null as string), 'date', '2090', 'sigma_vi', '0.5')))")
    captures = bronze.read(spark, root, source="sentry")
    assert [(r.des, r.ps_cum, r.spk) for r in silver.summaries(captures).collect()] == [("a", -2.5, None)]
    assert [(r.des, r.sigma_imp, r.energy) for r in silver.impactors(captures).collect()] == [("b", 0.5, None)]


def test_columns_stand_where_each_header_says(spark):
    rows = [(["cd", "x", "des"], [["d1", "1", "a"], ["d2", None, "b"], ["short"]]), (["des", "dist", "v_rel", "cd"], [["c", "0.5", "none", "d3"]]), (["des", "des"], [["e", "e"]]), (["body", "des"], [["Moon", "f"]]), (None, [["g"]]), (["des"], None)]
    captures = spark.createDataFrame(rows, "fields array<string>, data array<array<string>>").selectExpr("named_struct('source', 's', 'query_params', map('body', 'Earth')) as metadata", "struct(fields, data) as data")
    got = silver.approaches(captures)
    assert {(r.des, r.cd, r.close_approach_datetime, r.dist, r.v_rel, r.body, r.raw_json) for r in got.collect()} == {
        ("a", "d1", "d1", None, None, "Earth", '{"cd":"d1","x":"1","des":"a"}'), ("b", "d2", "d2", None, None, "Earth", '{"cd":"d2","x":null,"des":"b"}'),
        ("c", "d3", "d3", 0.5, None, "Earth", '{"des":"c","dist":"0.5","v_rel":"none","cd":"d3"}'), ("f", None, None, None, None, "Moon", '{"body":"Moon","des":"f"}')}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "element_at(record" not in plan and plan.index("Generate explode") < plan.index("array_position")  # below it: once a capture


def test_lines_are_dealt_out_by_part_before_they_are_grouped(spark):
    plan = layer_queries._approach_captures(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("partial_collect_list") < plan.index("Exchange")


def test_runs_and_their_log(spark, tmp_path):
    root, out = str(tmp_path / "in"), str(tmp_path / "out")
    assert runs.run_all(spark, root, out)["status"] == "failed"
    landed(spark, root, "objects", "named_struct('object', named_struct('spkid', '2', 'des', 'a', 'pha', 'Y', 'h', '9.5'))", 3)
    second = runs.run_all(spark, root, out)
    assert second["status"] == "partial_success" and not second["errors"] and any("approaches" in w for w in second["warnings"]) and any("positives" in w for w in second["warnings"])
    log = sinks.runs(spark, f"{out}/runs")
    assert log.count() == 2 and reports.latest_runs(log).first().run_id == second["run_id"]
    layers = {r.layer: (r.n_tables, r.row_count) for r in runs.rollup(log).where(F.col("run_id") == second["run_id"]).collect()}
    assert layers["silver"] == (2, 6) and layers["gold"][0] == 3
    assert [runs.combined(a, b) for a, b in (("success", "failed"), ("success", "insufficient_data"), ("insufficient_data", "success"), ("success", "partial_success"), ("success", "success"))] == [
        "failed", "partial_success", "insufficient_data", "partial_success", "success"]


def test_verdicts(spark):
    of = lambda *s: quality.verdict(spark.createDataFrame([(x,) for x in s], "status string")).first().status
    assert of("pass", "warn", "fail") == "fail" and of("pass", "warn") == "warn" and of("pass") == "pass"
