"""Registered queries of feature sets, experiments and their evidence, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger import queries as q
from skyledger.operators import adjacency, experiments, features
from skyledger.plans.binding import GOLD_SQL, SCORE_SQL, table
from skyledger.queries import query

#: Features that no relation of the binding has.
_ABSENT = ["albedo", "ad"]


def _class(c: str) -> str:
    return "strong_proxy" if c in features.PROXIES else "definition" if c in features.DEFINITION else "safe"


_LISTED = ", ".join(
    f"('{name}', {k}, '{c}', '{_class(c)}', '{'missing' if c in _ABSENT else 'used'}', '{'high' if name in features.HIGH else 'medium' if name in features.MEDIUM else 'low'}')"
    for name, own in features.SETS.items() for k, c in enumerate(own)
)
_COUNTED = ", ".join(f"count({c}) as {c}" for c in features.FULL if c not in _ABSENT)


@query(f"""with {GOLD_SQL}, n as (select {_COUNTED} from gold), f as (unpivot n on columns(*) into name feature value filled)
select feature_set, place, s.feature, feature_class, state, coalesce(filled, 0) as filled, leakage_risk from (values {_LISTED}) s(feature_set, place, feature, feature_class, state, leakage_risk) left join f on s.feature = f.feature""")
def feature_sets(spark, d):
    return features.registry(q.gold_table(spark, d))


@query(f"""with {GOLD_SQL}, n as (select {_COUNTED} from gold), f as (unpivot n on columns(*) into name feature value filled)
select s.feature, feature_class, count(distinct feature_set) as n_sets, max(filled) as filled from (values {_LISTED}) s(feature_set, place, feature, feature_class, state, leakage_risk) join f on s.feature = f.feature where state = 'used' group by all""")
def leakage_report(spark, d):
    return features.used(features.registry(q.gold_table(spark, d)))


_INSPECTED = ["pha", "object_key", "des", "full_name", "orbit_class_code", "next_close_approach_datetime", *features.DEFINITION, *features.PROXIES, "e", "rms", "sentry_ip"]
_CLASSES = "case when feature = 'pha' then 'direct' when feature in ('object_key', 'des', 'full_name', 'orbit_class_code', 'next_close_approach_datetime') then 'identifier' " + " ".join(
    f"when feature in ({', '.join(repr(c) for c in columns)}) then '{name}'" for name, columns in (("strong_proxy", features.PROXIES), ("definition", features.DEFINITION))
) + " else 'safe' end"


@query(f"with {GOLD_SQL}, n as (select {', '.join(f'count({c}) as {c}' for c in _INSPECTED)} from gold), f as (unpivot n on columns(*) into name feature value filled) select feature, {_CLASSES} as feature_class, filled from f")
def leakage_classes(spark, d):
    return features.inspected(q.gold_table(spark, d).select(*_INSPECTED))


_SPLIT = f"""{SCORE_SQL}, r as (select object_key, pha::int as label, count(*) over (partition by pha) as n, row_number() over (partition by pha order by md5(concat_ws(':', object_key, '42')), object_key) as k from scores where pha is not null),
split as (select object_key, label, case when n > 1 and k <= round(n * 25e-2) then 'test' else 'train' end as split from r)"""
_CELLS = ", ".join(f"('{m}', '{s}', {2 if m == experiments.RULE else sum(c not in _ABSENT for c in features.SETS[s])})" for m, s in experiments.grid())


@query(f"""with {_SPLIT}, n as (select count(*) filter (split = 'train') as n_train, count(*) filter (split = 'test') as n_test, count(*) filter (split = 'test' and label = 1) as test_positive, count(*) filter (label = 1) as p from split)
select model, feature_set, case when n_train + n_test < {experiments.MIN_ROWS} or p < {experiments.MIN_POSITIVE} then 'insufficient_data' else 'success' end as status, n_features, n_train, n_test, test_positive, n_test as n_evaluated, true as plausible from (values {_CELLS}) c(model, feature_set, n_features), n""")
def experiment_results(spark, d):
    """Every cell of the grid is fitted; ``plausible`` says that its metrics are there and within [0, 1]."""
    out = experiments.run(q.scores(spark, d), experiments.grid()).results
    ranges = [F.col(m).between(0, 1) for m in ("accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc", "brier", "recall_at_10", "recall_at_50")]
    plausible = F.coalesce(ranges[0] & ranges[1] & ranges[2] & ranges[3] & ranges[4] & ranges[5] & ranges[6] & ranges[7] & ranges[8], F.lit(False))
    evaluated = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return out.select("model", "feature_set", "status", "n_features", "n_train", "n_test", "test_positive", evaluated.alias("n_evaluated"), plausible.alias("plausible"))


_EVIDENCE = ", ".join(f"('{m}', '{s}', '{'high' if s in features.HIGH else 'low'}', '{'diagnostic' if s in features.HIGH else 'secondary_evidence'}')" for m, s in experiments.EVIDENCE)


@query(f"""with {_SPLIT}, c(model, feature_set, leakage_risk, evidence_role) as (values {_EVIDENCE})
select object_key, label, model, feature_set, mode as prediction_mode, leakage_risk, evidence_role, case mode when 'eval' then 'holdout_train_test_split' else 'full_labeled_dataset_after_holdout_evaluation' end as training_strategy
from split, c, (values ('eval'), ('full')) m(mode) where mode = 'full' or split = 'test'""")
def full_predictions(spark, d):
    """Held-out and full predictions of the five evidence cells; scores differ between optimisers, so SQL has the rest.

    Labelled rows that a cell can't predict (too few, or of one label) are an error, not a table without them.
    """
    run = experiments.run(q.scores(spark, d), experiments.EVIDENCE, modes=("eval", "full"), min_rows=experiments.MIN_EVIDENCE, min_positive=1)
    if run.lost:
        raise ValueError(f"there are no predictions by {'; '.join(run.lost)}")
    return run.predictions.select("object_key", "label", "model", "feature_set", "prediction_mode", "leakage_risk", "evidence_role", "training_strategy")


@query(f"""with {q._KNN}, node as (select vec_id, row_number() over (order by vec_id) - 1 as node_id from embeddings), e as (select a.node_id as x, b.node_id as y from edges join node a on a.vec_id = edges.a join node b on b.vec_id = edges.b where edges.distance <= 115e-2),
ends as (select x as src, y as dst from e union all select y, x from e), deg as (select node_id, count(dst) as degree, coalesce(list(dst order by dst) filter (dst is not null), []) as neighbours from node left join ends on src = node_id group by 1)
select node_id, (coalesce(sum(degree) over (order by node_id rows between unbounded preceding and 1 preceding), 0))::bigint as offset, degree, 0 as part, array_to_string(neighbours, ',') as neighbours from deg""")
def edge_index(spark, d):
    nodes = adjacency.dense_ids(table(spark, d, "embeddings").select("vec_id"), "vec_id", "node_id")
    index = adjacency.edge_index(nodes, q.embedding_edges(spark, d).where("distance <= 1.15"), "vec_id")
    return index.withColumn("neighbours", F.array_join("neighbours", ","))


_MATRIX = [c for c in adjacency.NODE_FEATURES if c not in (*_ABSENT, "risk_score_0_100")]


@query(f"""with {SCORE_SQL}, z as (select row_number() over (order by object_key) - 1 as node_id, object_key, coalesce(pha::int, -1) as label, {', '.join(f"coalesce({c}::double, 0) as {c}" for c in _MATRIX)} from scores),
m as (select *, count(*) over (partition by label) as of_label, row_number() over (partition by label order by md5(concat_ws(':', node_id::varchar, '42')), node_id) as place from z)
select node_id, object_key, label, case when label < 0 then null when of_label = 1 or place <= round(of_label * 6e-1) then 'train' when place <= round(of_label * 8e-1) then 'val' else 'test' end as mask,
round(({' + '.join(f"{i + 1} * coalesce(({c} - avg({c}) over ()) / nullif(stddev_pop({c}) over (), 0), 0)" for i, c in enumerate(_MATRIX))}), 4) as weighed, {len(_MATRIX)} as width from m""")
def node_matrix(spark, d):
    """``weighed`` is the sum of a row's features times their place, so that all of them are compared."""
    matrix, names = adjacency.node_matrix(q.scores(spark, d), features=_MATRIX)
    sums = F.aggregate(F.transform("features", lambda x, k: x * (k + 1)), F.lit(0.0), lambda s, x: s + x)
    return matrix.select("node_id", "object_key", "label", "mask", F.round(sums, 4).alias("weighed"), F.lit(len(names)).alias("width"))
