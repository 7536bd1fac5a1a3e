"""Reports over scores, graphs and models: findings of each object, of graphs and models, cards, grids, runs and scale."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyledger.operators.evidence import finding
from skyledger.operators.features import set_risk
from skyledger.operators.rank import rank
from skyledger.operators.score import dominant_driver
from skyledger.plans.shared import materialised

# Columns attached to gold rows, columns that no graph may learn from, node features.
SCORE_COLUMNS = ["risk_score", "risk_score_0_100", "risk_category", "explanation"]
FORBIDDEN = ["pha", "neo", "object_key", "spkid", "des", "full_name", "name", "risk_category", "built_at_utc", "source_availability_json", "next_close_approach_datetime"]
NODE_FEATURES = ["e", "a", "q", "i", "om", "w", "ma", "n", "per", "ad", "moid", "moid_ld", "h", "diameter", "albedo", "min_close_approach_dist",
                 "max_close_approach_v_rel", "close_approach_count", "sentry_flag", "sentry_ip", "feature_completeness_ratio", "risk_score_0_100"]
# Findings shown of each group; least rows and positives of an experiment; batch of the run log.
SHOWN = {"dataset": 2, "risk": 3, "score_simulation": 2, "orbital_simulation": 2, "graph": 2, "model": 2}
MIN_ROWS, MIN_POSITIVE, BATCH = 100, 5, 100


def attach_scores(gold: DataFrame | None, risk: DataFrame | None, key: str = "object_key", columns: list[str] = SCORE_COLUMNS) -> DataFrame | None:
    """Gold rows with the score columns; whichever of the two is there and has rows, if the other hasn't."""
    gold, risk = (None if df is None or df.isEmpty() else df for df in (gold, risk))
    if gold is None or risk is None:
        return risk if gold is None else gold
    return gold.join(risk.select(key, *[c for c in columns if c in risk.columns]), key, "left")


def enriched(scored: DataFrame, n: int, beside: list[DataFrame], key: str) -> DataFrame:
    """The best ``n`` scores, then left-joined with each of ``beside`` (one row for each key)."""
    out = rank(scored, n)
    for df in beside:
        out = out.join(df, key, "left")
    return out


def object_findings(scored: DataFrame, key: str = "object_key") -> DataFrame:
    """(key, source_module, metric, value, text, importance) of every object: its leading driver and its score."""
    importance = F.when(F.col("risk_score_0_100") >= 40, "high").otherwise("medium")
    return scored.select(key, F.lit("object").alias("source_module"), F.lit("risk_score_0_100").alias("metric"), F.coalesce("risk_score_0_100", F.lit(0.0)).alias("value"), dominant_driver().alias("text"), importance.alias("importance"))


def graph_findings(nodes: DataFrame, edges: DataFrame, kind: Column | None = None) -> DataFrame:
    """(finding_group, title, metric, value): nodes, edges, density and the number of edges of each kind."""
    kinds = edges.select((F.lit("similarity") if kind is None else kind).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    sizes = nodes.agg(F.count(F.lit(1)).alias("v")).crossJoin(edges.agg(F.count(F.lit(1)).alias("e")))  # one row beside one row
    density = F.coalesce(F.try_divide(2.0 * F.col("e"), F.col("v") * (F.col("v") - 1)), F.lit(0.0))
    rows = [finding("graph", "nodes", "count", F.col("v")), finding("graph", "edges", "count", F.col("e")), finding("graph", "density", "ratio", F.round(density, 6))]
    whole = sizes.select(F.explode(F.array(*rows)).alias("f")).select("f.*")
    return whole.unionByName(kinds.select(F.lit("graph").alias("finding_group"), F.concat(F.lit("edges of "), "k").alias("title"), F.lit("count").alias("metric"), F.col("n").cast("double").alias("value")))


def model_findings(metrics: DataFrame, disagreements: DataFrame) -> DataFrame:
    """The best defensible model, the number of disagreements and the first five leakage-sensitive results."""
    value, name = F.coalesce("pr_auc", "f1"), F.concat_ws("/", "model", "feature_set")
    risk = set_risk(F.col("feature_set"))
    best = metrics.where(risk == "low").groupBy().agg(F.max_by(F.struct(name.alias("title"), value.alias("value")), F.struct(value, name)).alias("b")).where("b is not null")
    best = best.select(F.lit("model").alias("finding_group"), F.concat(F.lit("defensible: "), "b.title").alias("title"), F.lit("pr_auc or f1").alias("metric"), F.col("b.value").alias("value"))
    count = disagreements.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("model").alias("finding_group"), F.lit("disagreements").alias("title"), F.lit("count").alias("metric"), "value")
    order = metrics.where(risk == "high").select(name.alias("title"), value.alias("value")).orderBy("title").limit(5)
    leaks = order.select(F.lit("model").alias("finding_group"), F.concat(F.lit("leakage-sensitive: "), "title").alias("title"), F.lit("pr_auc or f1").alias("metric"), "value")
    return best.unionByName(count).unionByName(leaks)


def assembled(findings: DataFrame, shown: dict[str, int] = SHOWN) -> DataFrame:
    """The first findings of each group (as many as ``shown`` says, by title), with the number that the group has."""
    w = W.partitionBy("finding_group")
    most = F.coalesce(F.create_map(*[F.lit(x) for kv in shown.items() for x in kv])[F.col("finding_group")], F.lit(2))
    out = findings.withColumns({"place": F.row_number().over(w.orderBy("title", "metric")), "total": F.count(F.lit(1)).over(w)})
    return out.where(F.col("place") <= most)


def model_cards(metrics: DataFrame) -> DataFrame:
    """``metrics`` with leakage risk, strengths, weakness, recommended use (codes) and status, by family and leakage."""
    risk = set_risk(F.col("feature_set"))
    graph = F.col("model_family").isin("graph", "gnn")
    skipped = (F.col("model_family") == "gnn") & (F.col("status") == "skipped_missing_dependency")
    pick = lambda a, b, c, d: F.when(skipped, a).when(graph, b).when(risk == "low", c).otherwise(d)
    strong = F.filter(F.array(F.when(F.col("roc_auc").isNotNull(), "ranks"), F.when(F.col("recall").isNotNull(), "retrieval"), F.when(risk == "low", "no_definition_variables")), lambda x: x.isNotNull())
    return metrics.withColumns({
        "leakage_risk": risk, "strengths": F.when(F.size(strong) > 0, strong).otherwise(F.array(F.lit("baseline"))),
        "weakness": pick("no_metrics", "depends_on_graph", "may_understate", "definition_inputs"), "recommended_use": pick("readiness", "consistency", "evidence", "diagnostic"),
    })


def with_cards(metrics: DataFrame, cards: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Metrics left-joined with the first card of each (model, feature set, family)."""
    keys = keys or ["model", "feature_set", "model_family"]
    first = cards.groupBy(*keys).agg(F.min(F.struct("leakage_risk", "weakness", "recommended_use")).alias("card"))
    return metrics.join(first, keys, "left").select(*[metrics[c] for c in metrics.columns], "card.*")


def prediction_labels(df: DataFrame, key: str = "object_key", name: str = "des") -> DataFrame:
    """Predictions with designation (else the key), evidence role and note (codes)."""
    role = F.when(F.col("leakage_risk") == "high", "diagnostic").when(F.col("leakage_risk") == "low", "evidence").otherwise("context")
    note = F.when(F.col("prediction_mode") == "eval", "held_out").otherwise("all_objects")
    have = F.col(name) if name in df.columns else F.lit(None).cast("string")
    return df.withColumns({"designation": F.coalesce(have, F.col(key).cast("string")), "evidence_role": role, "dataset_note": note})


def experiment_grid(df: DataFrame, feature_sets: dict[str, list[str]], models: list[str], label: str) -> DataFrame:
    """(feature_set, model, n_rows, n_positive, missing, status): which experiments may run, from one pass over ``df``."""
    have = df.agg(F.count(label).alias("n_rows"), F.count_if(F.col(label).cast("int") == 1).alias("n_positive"))
    sets = F.array(*[F.struct(F.lit(k).alias("feature_set"), F.lit(len([c for c in v if c in df.columns])).alias("own"), F.array(*[F.lit(c) for c in v if c not in df.columns]).cast("array<string>").alias("missing")) for k, v in feature_sets.items()])
    out = have.withColumn("s", F.explode(sets)).withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    enough = (F.col("n_rows") >= MIN_ROWS) & (F.col("n_positive") >= MIN_POSITIVE)
    status = F.when(F.col("s.own") == 0, "skipped_no_features").when(~enough, "insufficient_data").when((F.col("n_rows") == F.col("n_positive")), "single_class").otherwise("ready")
    return out.select("s.feature_set", "model", "n_rows", "n_positive", F.array_join("s.missing", ",").alias("missing"), status.alias("status"))


def grid_status(grid: DataFrame) -> DataFrame:
    """Counts of each status and the run's own: complete, partial or nothing."""
    ready = F.count_if(F.col("status") == "ready")
    run = F.when(ready == F.count(F.lit(1)), "complete").when(ready > 0, "partial").otherwise("nothing")
    return grid.agg(F.count(F.lit(1)).alias("n_experiments"), ready.alias("n_ready"), run.alias("run_status"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("status") != "ready", F.concat_ws(":", "feature_set", "status")))), ",").alias("warnings"))


def graph_against_baselines(metrics: DataFrame) -> DataFrame:
    """(graph_f1, baseline_f1, verdict): the best F1 of either side."""
    graph = F.col("model_family").isin("graph", "gnn")
    out = metrics.agg(F.max(F.when(graph, F.col("f1"))).alias("graph_f1"), F.max(F.when(~graph, F.col("f1"))).alias("baseline_f1"))
    verdict = F.when(F.col("graph_f1").isNull(), "no_graph_metrics").when(F.col("baseline_f1").isNull(), "no_baseline_metrics").when(F.col("graph_f1") > F.col("baseline_f1"), "exceeded").otherwise("not_exceeded")
    return out.withColumn("verdict", verdict)


def metric_records(df: DataFrame, target: str = "pha") -> DataFrame:
    """Metrics of any source with model name, family (tabular, graph or gnn), feature set, target and status filled in."""
    text = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) if c in df.columns else F.lit(None).cast("string")
    family, own = F.coalesce(text("family"), F.lit("graph")), F.coalesce(text("feature_set"), F.lit("graph"))
    names = ["accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc", "false_negative_rate"]
    return df.select(
        F.coalesce(text("model_name"), text("model"), F.lit("graph_model")).alias("model_name"), own.alias("feature_set"),
        F.when(family == "gnn", "gnn").when((family == "baseline") & (own != "graph_node_features"), "tabular").otherwise("graph").alias("model_family"),
        F.coalesce(text("target"), F.lit(target)).alias("target"), F.coalesce(text("status"), F.lit("unknown")).alias("status"),
        *[(F.col(c).try_cast("double") if c in df.columns else F.lit(None).cast("double")).alias(c) for c in names],
    )


def dense_ids(df: DataFrame, key: str | list[str], name: str) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2 ... in the order of ``key``. Ranges are numbered apart, then moved by the counts before.

    The ranges are fixed by a table in the shared folder, so a task that runs again numbers the same rows.
    """
    keys = [key] if isinstance(key, str) else key
    ranged = materialised(df.repartitionByRange(*[F.col(k) for k in keys]).withColumn("_range", F.spark_partition_id()), "ranges")
    before = F.sum("n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1))  # one row for each range
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(W.partitionBy("_range").orderBy(*keys))
    return ranged.withColumn("_own", own).join(F.broadcast(sizes), "_range").withColumn(name, F.col("_before") + F.col("_own") - 1).drop("_range", "_own", "_before")


def node_table(df: DataFrame, key: str = "object_key", target: str = "pha", features: list[str] = NODE_FEATURES) -> DataFrame:
    """(node_id, key, features, label, risk_score_0_100, risk_category): the map holds the numbers that are there."""
    own = [c for c in features if c in df.columns]
    cells = F.create_map(*[x for c in own for x in (F.lit(c), F.col(c).cast("double"))])
    rows = df.select(key, F.map_filter(cells, lambda _, v: v.isNotNull()).alias("features"), F.coalesce(F.col(target).cast("int"), F.lit(0)).alias("label"), "risk_score_0_100", "risk_category")
    return dense_ids(rows, key, "node_id")


def numeric_features(df: DataFrame, requested: list[str], forbidden: list[str] = FORBIDDEN) -> DataFrame:
    """(feature, kept) of the requested columns: those that are there, allowed and hold a number somewhere; one aggregate."""
    own = [c for c in dict.fromkeys(requested) if c in df.columns and c not in forbidden]
    held = df.agg(*[F.count(F.col(c).try_cast("double")).alias(c) for c in own]) if own else df.sparkSession.range(1)
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), (F.col(c) > 0 if c in own else F.lit(False)).alias("kept")) for c in dict.fromkeys(requested)])
    return held.select(F.explode(rows).alias("f")).select("f.*")


def latest_runs(log: DataFrame, kind: str = "run_type", started: str = "started_at", run: str = "run_id") -> DataFrame:
    """The latest run of each type (ties by run id)."""
    rest = [c for c in log.columns if c != kind]
    return log.groupBy(kind).agg(F.max_by(F.struct(*rest), F.struct(started, run)).alias("r")).select(kind, "r.*")


def batches(attempts: DataFrame, order: str, size: int = BATCH) -> DataFrame:
    """``attempts`` with batch (every ``size`` in order) and whether a checkpoint follows (every half batch)."""
    out = dense_ids(attempts, order, "_place")
    return out.withColumns({"batch": F.floor(F.col("_place") / size), "checkpoint": (F.col("_place") + 1) % (size // 2) == 0}).drop("_place")


def stamped(df: DataFrame, available: dict[str, bool]) -> DataFrame:
    """``df`` with built_at_utc and source_availability_json."""
    built = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return df.withColumns({"built_at_utc": built, "source_availability_json": F.lit(json.dumps(available, sort_keys=True))})


def dataset_scale(gold: DataFrame, scored: DataFrame, edges: DataFrame, nodes: DataFrame, watched: list[str], target: str = "pha") -> DataFrame:
    """(metric, value): rows of each layer, share of nulls of ``watched``, categories, labels and the graph's density."""
    g = gold.agg(F.count(F.lit(1)).alias("gold_rows"), F.count_if(F.col(target)).alias("target_true"), F.count_if(~F.col(target)).alias("target_false"), *[F.round(F.avg(F.col(c).isNull().cast("double")), 6).alias(f"missing_{c}") for c in watched])
    n = nodes.agg(F.count(F.lit(1)).alias("graph_nodes")).crossJoin(edges.agg(F.count(F.lit(1)).alias("graph_edges")))  # one row beside one row
    n = n.withColumn("graph_density", F.round(F.coalesce(F.try_divide(2.0 * F.col("graph_edges"), F.col("graph_nodes") * (F.col("graph_nodes") - 1)), F.lit(0.0)), 6))
    long = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns])).alias("f")).select("f.*")
    kinds = scored.groupBy("risk_category").agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.concat(F.lit("category_"), "risk_category").alias("metric"), "value")
    return long(g).unionByName(long(scored.agg(F.count(F.lit(1)).alias("risk_rows")))).unionByName(kinds).unionByName(long(n))


def declared(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Exactly the declared columns, cast; what is missing or can't be cast is null."""
    return df.select(*[(F.col(c).try_cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in schema.items()])
