"""Registered queries of discovery, reports and run logs, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger import queries as q
from skyledger.functions import columns as c
from skyledger.operators import discovery, evidence, explain, features, quality, rank, reports
from skyledger.plans import binding as b
from skyledger.plans.binding import GOLD_SQL, OBJECT_COLUMNS, OBJECTS_SQL, SCORE_SQL, table
from skyledger.queries import query
from skyledger.sources import bronze, sinks

_SEED = ", ".join(f"(0, {k}, '{x}')" for k, x in enumerate(discovery.SEED))
_FOUND = f"""a as (select * from (values {_SEED}) v(place, pos, candidate)),
t as (select 0 as place, c_custkey as pos, c_name as candidate from customer union all select 1, c_custkey, c_mktsegment from customer),
e as (select 0 as place, event_id as pos, event_type as candidate from events union all select 1, event_id, cast(user_id as varchar) from events),
u as (select 0 as source, * from a union all select 1, * from t union all select 2, * from e),
found as (select source, place, pos, candidate from (select *, row_number() over (partition by candidate order by source, place, pos) as n from u) x where n = 1)"""


def _candidates(spark, d):
    """Seeds, two columns of a table, and unpacked records, in this order."""
    packed = table(spark, d, "events").select("event_id", F.create_map(F.lit("type"), "event_type", F.lit("user"), F.col("user_id").cast("string")).alias("record"))
    return discovery.extended([discovery.seed(spark), discovery.from_columns(table(spark, d, "customer"), ["c_name", "c_mktsegment"], "c_custkey"), discovery.from_records(packed, ["type", "user"], "event_id")])


@query(f"with {_FOUND} select source, place, pos, candidate from found")
def discover_candidates(spark, d):
    return _candidates(spark, d).withColumnRenamed("row", "pos")


@query(f"with {_FOUND}, have as (select distinct cast(p_partkey as varchar) as candidate from part) select candidate from found where candidate not in (select candidate from have) order by source, place, pos limit 1000")
def fill_to_target(spark, d):
    parts = table(spark, d, "part")
    return discovery.filled(_candidates(spark, d), parts, "p_partkey", parts.select("p_partkey").distinct().count() + 1000).select("candidate")


@query("select event_id, coalesce(case when event_id % 3 = 0 then cast(user_id as varchar) end, case when event_id % 2 = 0 then event_type end, 'name') as candidate from events")
def preferred_identifiers(spark, d):
    record = F.create_map(F.lit("spkid"), F.when(F.col("event_id") % 3 == 0, F.col("user_id").cast("string")).otherwise(" "), F.lit("des"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")), F.lit("name"), F.lit("name"))
    return table(spark, d, "events").withColumn("record", record).select("event_id", discovery.preferred().alias("candidate"))


@query("select event_id, user_id, try_cast(json_extract_string(props, '$.k') as int) as k, null::double as absent from events")
def declared_schema(spark, d):
    df = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return reports.declared(df, {"event_id": "long", "user_id": "long", "k": "int", "absent": "double"})


@query("select c_custkey, case when c_custkey % 2 = 0 then c_acctbal else cast(c_nationkey as double) end as value from customer")
def two_place_element(spark, d):
    listed = F.when(F.col("c_custkey") % 2 == 0, F.array(F.struct(F.lit("e").alias("name"), F.col("c_acctbal").cast("string").alias("value"))))
    df = table(spark, d, "customer").select("c_custkey", F.struct(F.struct(F.col("c_nationkey").alias("e")).alias("orbit"), listed.alias("elements")).alias("data"))
    return df.select("c_custkey", bronze.element(df, "data.elements", "data.orbit", "e", "double").alias("value"))


@query("select c_custkey, case when c_nationkey is not null then '{\"n\":' || c_nationkey || '}' end as props, null::varchar as absent from customer")
def json_props(spark, d):
    df = table(spark, d, "customer").select("c_custkey", F.struct(F.col("c_nationkey").alias("n")).alias("data"))
    return df.select("c_custkey", bronze.as_json(df, "data").alias("props"), bronze.as_json(df, "data.absent.x").alias("absent"))


@query(f"with {SCORE_SQL} select object_key, des, case when p_partkey % 2 = 0 then round(risk_score, 6) end as risk_score, case when p_partkey % 2 = 0 then risk_category end as risk_category from scores join part on des = cast(p_partkey as varchar)")
def score_attachment(spark, d):
    gold = q.gold_table(spark, d)
    risk = q.scores(spark, d).where(F.col("des").cast("long") % 2 == 0)
    return reports.attach_scores(gold, risk).select("object_key", "des", F.round("risk_score", 6).alias("risk_score"), "risk_category")


@query(f"with {SCORE_SQL}, best as (select * from scores {q._RANK} limit 10), h as (select user_id, arg_max(value, (ts, event_id)) as last_value from events group by 1), n as (select l_partkey, count(*) as lines from lineitem group by 1) "
       "select object_key, round(risk_score, 6) as risk_score, round(last_value, 6) as last_value, lines from best left join h on cast(user_id as varchar) = des left join n on cast(l_partkey as varchar) = des")  # fmt: skip
def top_enriched(spark, d):
    history = rank.latest(table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select(F.col("user_id").cast("string").alias("des"), F.round("value", 6).alias("last_value"))
    lines = table(spark, d, "lineitem").groupBy(F.col("l_partkey").cast("string").alias("des")).agg(F.count(F.lit(1)).alias("lines"))
    return reports.enriched(q.scores(spark, d), 10, [history, lines], "des").select("object_key", F.round("risk_score", 6).alias("risk_score"), "last_value", "lines")


@query(f"with {SCORE_SQL} select object_key, 'object' as source_module, 'risk_score_0_100' as metric, round(coalesce(risk_score_0_100, 0), 5) as value, dominant_driver as text, case when risk_score_0_100 >= 40 then 'high' else 'medium' end as importance from scores")
def object_findings(spark, d):
    return reports.object_findings(q.scores(spark, d)).withColumn("value", F.round("value", 5))


_GRAPH_FOUND = f"{q._KNN}, v as (select count(*) as v from embeddings), e as (select count(*) as e from edges), k as (select case when distance <= 1e0 then 'near' else 'far' end as k, count(*) as n from edges group by 1)"
_GRAPH_ROWS = "select 'graph' as finding_group, 'nodes' as title, 'count' as metric, cast(v as double) as value from v union all select 'graph', 'edges', 'count', e from e union all select 'graph', 'density', 'ratio', round(2e0 * e / (v * (v - 1)), 6) from v, e union all select 'graph', 'edges of ' || k, 'count', n from k"


def _graph_findings(spark, d):
    return reports.graph_findings(table(spark, d, "embeddings"), q.embedding_edges(spark, d), F.when(F.col("distance") <= 1.0, "near").otherwise("far"))


@query(f"with {_GRAPH_FOUND} {_GRAPH_ROWS}")
def graph_findings(spark, d):
    return _graph_findings(spark, d)


_LOW, _HIGH = "orbital_only', 'no_definition_features", "', '".join(features.HIGH)
_MODEL_ROWS = f"""select 'model' as finding_group, 'defensible: ' || model || '/' || feature_set as title, 'pr_auc or f1' as metric, f1 as value from (select * from q where feature_set in ('{_LOW}') order by f1 desc, model || '/' || feature_set desc limit 1) a
union all select 'model', 'disagreements', 'count', (select count(*) from (select p_partkey from r group by 1 having count(distinct predicted) > 1 or count(*) filter (confidence = 'high' and label <> predicted) > 0) x)
union all select 'model', 'leakage-sensitive: ' || model || '/' || feature_set, 'pr_auc or f1', f1 from (select * from q where feature_set in ('{_HIGH}') order by model, feature_set limit 5) h"""


def _model_findings(spark, d):
    return reports.model_findings(q.model_metrics(spark, d), evidence.disagreements(q.predictions(spark, d), "p_partkey"))


@query(f"{q._MODELS}, {q._F1} {_MODEL_ROWS}")
def model_findings(spark, d):
    return _model_findings(spark, d)


@query(f"{q._MODELS}, {q._F1}, {_GRAPH_FOUND}, f as ({_MODEL_ROWS} union all {_GRAPH_ROWS}) select finding_group, title, value, place, total from (select *, cast(row_number() over (partition by finding_group order by title, metric) as int) as place, count(*) over (partition by finding_group) as total from f) t where place <= 2")
def findings_summary(spark, d):
    return reports.assembled(_model_findings(spark, d).unionByName(_graph_findings(spark, d))).select("finding_group", "title", "value", "place", "total")


_FAMILY = "case when feature_set = 'full_features' then 'graph' else 'tabular' end"
_CARDS = f"""cards as (select model, feature_set, {_FAMILY} as model_family, f1, case when feature_set in ('{_LOW}') then 'low' when feature_set in ('{_HIGH}') then 'high' else 'medium' end as leakage_risk from q),
coded as (select *, case when leakage_risk = 'low' then 'no_definition_variables' else 'baseline' end as strengths, case when model_family = 'graph' then 'depends_on_graph' when leakage_risk = 'low' then 'may_understate' else 'definition_inputs' end as weakness from cards)"""


def _family_metrics(spark, d):
    null = F.lit(None).cast("double")
    return q.model_metrics(spark, d).withColumns({"model_family": F.when(F.col("feature_set") == "full_features", "graph").otherwise("tabular"), "status": F.lit("success"), "roc_auc": null, "recall": null})


@query(f"{q._MODELS}, {q._F1}, {_CARDS} select model, feature_set, leakage_risk, strengths, weakness from coded")
def model_cards(spark, d):
    return reports.model_cards(_family_metrics(spark, d)).select("model", "feature_set", "leakage_risk", F.array_join("strengths", ",").alias("strengths"), "weakness")


@query(f"{q._MODELS}, {q._F1}, {_CARDS} select model, feature_set, f1, case when model <> 'm1' then leakage_risk end as leakage_risk, case when model <> 'm1' then weakness end as weakness from coded")
def metric_cards(spark, d):
    metrics = _family_metrics(spark, d)
    return reports.with_cards(metrics, reports.model_cards(metrics).where("model <> 'm1'")).select("model", "feature_set", "f1", "leakage_risk", "weakness")


@query(f"{q._MODELS}, {q._F1}, best as (select max(f1) filter (feature_set = 'full_features') as g, max(f1) filter (feature_set <> 'full_features') as n from q) select g as graph_f1, n as baseline_f1, case when g > n then 'exceeded' else 'not_exceeded' end as verdict from best")
def graph_against_baselines(spark, d):
    return reports.graph_against_baselines(_family_metrics(spark, d))


@query(f"{q._MODELS} select p_partkey, model, cast(p_partkey as varchar) as designation, case when leakage_risk = 'high' then 'diagnostic' when leakage_risk = 'low' then 'evidence' else 'context' end as evidence_role, case when prediction_mode = 'eval' then 'held_out' else 'all_objects' end as dataset_note from r")
def prediction_labels(spark, d):
    return reports.prediction_labels(q.predictions(spark, d), "p_partkey").select("p_partkey", "model", "designation", "evidence_role", "dataset_note")


_SETS = {**features.SETS, "none": ["no_such_column"]}
_SET_ROWS = ", ".join(f"('{k}', {sum(c in OBJECT_COLUMNS for c in v)}, '{','.join(c for c in v if c not in OBJECT_COLUMNS)}')" for k, v in _SETS.items())


@query(f"with {OBJECTS_SQL}, n as (select count(pha) as n, count(*) filter (pha) as p from objects), s(feature_set, own, missing) as (values {_SET_ROWS}), m(model) as (values ('mlp'), ('random_forest')) "
       "select feature_set, model, n as n_rows, p as n_positive, missing, case when own = 0 then 'skipped_no_features' when n < 100 or p < 5 then 'insufficient_data' when n = p then 'single_class' else 'ready' end as status from s, m, n")  # fmt: skip
def experiment_grid(spark, d):
    return reports.experiment_grid(b.objects(spark, d), _SETS, ["mlp", "random_forest"], "pha")


@query(f"{q._MODELS}, {q._F1} select model as model_name, 'graph' as feature_set, 'graph' as model_family, 'pha' as target, 'unknown' as status, f1 from q")
def metrics_normalised(spark, d):
    return reports.metric_records(q.model_metrics(spark, d).drop("feature_set")).select("model_name", "feature_set", "model_family", "target", "status", "f1")


@query(f"{q._MODELS}, {q._F1} select model, feature_set, f1 from q")
def sink_metrics_csv(spark, d):
    path = q.shared_folder(spark, "metrics")
    sinks.write_metrics(q.model_metrics(spark, d).select("model", "feature_set", F.struct("f1", "pr_auc").alias("metrics")), path)
    return spark.read.schema("model string, feature_set string, f1 double, pr_auc double").csv(path, header=True).select("model", "feature_set", "f1")


_NODE_FEATURES = ["e", "h", "moid", "diameter"]


@query(f"with {SCORE_SQL} select row_number() over (order by object_key) - 1 as node_id, object_key, cast(e is not null as int) + cast(h is not null as int) + cast(moid is not null as int) + cast(diameter is not null as int) as n_features, cast(coalesce(pha, false) as int) as label, risk_category from scores")
def graph_nodes(spark, d):
    q.shared_folder(spark, "nodes")
    return reports.node_table(q.scores(spark, d), features=_NODE_FEATURES).select("node_id", "object_key", F.size("features").alias("n_features"), "label", "risk_category")


@query(f"with {q._KNN} select 'nodes' as part, count(*) as n_rows from embeddings union all select 'edges', count(*) from edges")
def sink_graph(spark, d):
    path = q.shared_folder(spark, "graph")
    sinks.write_graph(table(spark, d, "embeddings").select("vec_id", "label"), q.embedding_edges(spark, d), path)
    sizes = [spark.read.parquet(f"{path}/{part}").agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(part).alias("part"), "n_rows") for part in ("nodes", "edges")]
    return sizes[0].union(sizes[1])


@query(f"with {GOLD_SQL}, n as (select count(e) as e, count(diameter) as diameter from gold) select 'e' as feature, e > 0 as kept from n union all select 'diameter', diameter > 0 from n union all select 'full_name', false union all select 'pha', false union all select 'no_such_column', false")
def numeric_features(spark, d):
    return reports.numeric_features(q.gold_table(spark, d), ["e", "diameter", "full_name", "pha", "no_such_column"])


@query("select o_orderpriority as run_type, o_orderkey as run_id, o_orderdate as started_at, o_orderstatus as status from (select *, row_number() over (partition by o_orderpriority order by o_orderdate desc, o_orderkey desc) as n from orders) t where n = 1")
def run_log_latest(spark, d):
    path = q.shared_folder(spark, "runs")
    runs = table(spark, d, "orders").select(F.col("o_orderpriority").alias("run_type"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started_at"), F.col("o_orderstatus").alias("status"))
    for k in range(2):
        runs.where(F.col("run_id") % 2 == k).write.mode("append").parquet(path)
    return reports.latest_runs(spark.read.schema(runs.schema).parquet(path)).select("run_type", "run_id", "started_at", "status")


@query("select o_orderkey, (n - 1) // 100 as batch, n % 50 = 0 as checkpoint from (select o_orderkey, row_number() over (order by o_orderkey) as n from orders) t")
def batch_numbers(spark, d):
    q.shared_folder(spark, "batches")
    return reports.batches(table(spark, d, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", "batch", "checkpoint")


@query(f"with {GOLD_SQL} select object_key, '{{\"approaches\": true, \"objects\": true, \"sentry\": false}}' as source_availability_json, true as stamped from gold")
def gold_availability(spark, d):
    out = reports.stamped(q.gold_table(spark, d), {"objects": True, "approaches": True, "sentry": False})
    return out.select("object_key", "source_availability_json", F.col("built_at_utc").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$").alias("stamped"))


@query(f"with {SCORE_SQL}, {q._KNN}, v as (select count(*) as v from embeddings), e as (select count(*) as e from edges), g as (select count(*) as n, count(*) filter (pha) as t, count(*) filter (not pha) as f, round(avg(case when diameter is null then 1e0 else 0 end), 6) as dia from scores) "
       "select 'gold_rows' as metric, cast(n as double) as value from g union all select 'target_true', t from g union all select 'target_false', f from g union all select 'missing_diameter', dia from g union all select 'risk_rows', n from g union all select 'category_' || risk_category, count(*) from scores group by risk_category "
       "union all select 'graph_nodes', v from v union all select 'graph_edges', e from e union all select 'graph_density', round(2e0 * e / (v * (v - 1)), 6) from v, e")  # fmt: skip
def dataset_scale(spark, d):
    nodes = table(spark, d, "embeddings").select("vec_id")
    return reports.dataset_scale(q.gold_table(spark, d), q.scores(spark, d), q.embedding_edges(spark, d), nodes, ["diameter"])


@query("select event_id, case when event_id % 5 = 0 then null else event_type = 'click' end as value from events")
def flag_to_bool(spark, d):
    raw = F.when(F.col("event_id") % 5 == 0, "maybe").when(F.col("event_type") == "click", " Y ").otherwise("0")
    return table(spark, d, "events").select("event_id", c.flag(raw).alias("value"))


@query("select event_id, case event_id % 7 when 0 then null else 'type ' || event_type end as value from events")
def clean_designation(spark, d):
    raw = F.expr("case event_id % 7 when 0 then ' NaN ' else concat('  type   ', event_type) end")
    return table(spark, d, "events").withColumn("raw", raw).select("event_id", c.designation("raw").alias("value"))


@query(f"with {SCORE_SQL} select object_key from scores {q._RANK} limit 50")
def sink_csv_top(spark, d):
    path = q.shared_folder(spark, "scored")
    sinks.write_scored(q.scores(spark, d).select("object_key", "risk_score", "risk_score_0_100", "risk_category", "uncertainty_risk_component", "sentry_risk_component"), path)
    return spark.read.option("header", True).csv(f"{path}/top").select("object_key")


@query(f"with {OBJECTS_SQL} select spkid, coalesce(full_name, des, 'unknown') as identifier from objects")
def best_identifiers(spark, d):
    df = b.objects(spark, d)
    return df.select("spkid", explain.best_identifier(df, ["full_name", "no_such_column", "des"], "unknown").alias("identifier"))


@query("select event_id from events")
def first_available(spark, d):
    return sinks.first_available(spark, [None, table(spark, d, "events").select("event_id"), None], "event_id long")


@query(f"with {SCORE_SQL}, n as (select count(*) as n, count(*) filter (pha) as t, count(*) filter (not pha) as f from scores), r as (select *, case when n >= 4000 then 'strong' when n >= 300 then 'usable' when n >= 100 then 'minimal' else 'not_ready' end as band from n), m as (select *, case when n < 100 then 'not_ready' when t = 0 or f = 0 then 'minimal' else band end as learn from r) "
       "select unnest(['overall', 'models', 'leakage', 'ranking', 'simulation', 'graph', 'reports']) as consumer, n as n_rows, unnest([band, learn, learn, band, band, learn, band]) as status from m")  # fmt: skip
def consumer_readiness(spark, d):
    scored = q.scores(spark, d)
    return quality.consumers(scored, scored)


@query("select target, n as n_rows, n >= target as available from (select count(*) as n from part) p, (values (1000), (4000)) t(target)")
def target_availability(spark, d):
    return quality.targets(table(spark, d, "part"))


@query(f"with {_FOUND}, s(source) as (values (0), (1), (2)) select source, count(found.candidate) as n_new, (sum(count(found.candidate)) over (order by source))::bigint as n_so_far from s left join found using (source) group by source")
def discovery_counts(spark, d):
    return discovery.new_counts(_candidates(spark, d), 3)
