"""Feature sets, experiment grids, exact medians and components, against plain computations."""

import random
import statistics

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from skyledger import queries as q
from skyledger.operators import experiments, features, graph, metrics, models, neighbours, quality, quantiles
from skyledger.queries import QUERIES
from skyledger.sources import sinks
from tests.conftest import SF


def objects(spark, n=240):
    rng = random.Random(3)
    rows = [(f"k{i}", i % 3 == 0, *(rng.gauss(i % 3, 1) if rng.random() > 0.1 else None for _ in range(4)), 20.0 + i % 5, 0.02 * (i % 5)) for i in range(n)]
    return spark.createDataFrame(rows, "object_key string, pha boolean, e double, a double, q double, i double, h double, moid double").withColumn("albedo", F.lit(None).cast("double"))


def test_sets_refuse_targets_and_identifiers():
    sets = {"x": ["e", "pha", "des", "label", "albedo"]}
    assert features.resolved(["e", "pha", "des", "label"], "x", "label", sets) == (["e"], ["albedo"], ["pha", "des", "label"])
    with pytest.raises(ValueError, match="full_features"):
        features.resolved(["e"], "nonsense")


def test_risk_by_name(spark):
    names = ["full_features", "definition_features_only", "risk_score_features", "graph_node_features", "sentry_related", "orbital_only", "no_definition_features", "approach_and_quality", "other"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.r for r in df.select(features.set_risk(F.col("n")).alias("r")).collect()] == ["high"] * 4 + ["medium"] + ["low"] * 4


def test_grid_against_a_plain_fit(spark):
    df = objects(spark)
    run = experiments.run(df, [("logistic_regression", "orbital_only"), ("dummy_most_frequent", "orbital_only"), (experiments.RULE, "full_features"), ("random_forest", "sentry_related")], modes=("eval", "full"))
    rows = {r.model: r for r in run.results.collect()}
    assert run.status == "partial_success" and rows["random_forest"].status == "skipped" and rows["random_forest"].accuracy is None
    split = metrics.stratified(df.select("object_key", F.col("pha").cast("int").alias("label")), "label", "object_key")
    own = ["e", "a", "q", "i"]
    whole = df.join(split, "object_key").toPandas()
    train = whole[whole.split == "train"]
    filled = whole[own].fillna(train[own].median())
    base = filled[whole.split == "train"]
    whole[own] = (filled - base.mean()) / base.std(ddof=0)
    n = train.label.value_counts()
    whole["weight"] = whole.label.map(lambda y: len(train) / (2 * n[y]))
    frame = VectorAssembler(inputCols=own, outputCol="features").transform(spark.createDataFrame(whole[[*own, "object_key", "label", "split", "weight"]]))
    model = LogisticRegression(maxIter=1000, regParam=1e-4, standardization=False, weightCol="weight").fit(frame.where("split = 'train'"))
    models.without_summary(PipelineModel([model]))
    want = {r.object_key: r.prediction for r in model.transform(frame.where("split = 'test'")).collect()}
    got = {r.object_key: r.predicted for r in run.predictions.where("model = 'logistic_regression' and prediction_mode = 'eval'").collect()}
    assert got == want
    assert rows["dummy_most_frequent"].recall == 0 and rows["dummy_most_frequent"].n_test == 60 and rows["logistic_regression"].roc_auc > 0.6
    hit = df.where("moid <= 0.05 and h <= 22").select("object_key")
    assert set(run.predictions.where(f"model = '{experiments.RULE}' and prediction_mode = 'full' and predicted = 1").select("object_key").collect()) == set(hit.collect())
    assert run.predictions.where("prediction_mode = 'full'").groupBy("model").count().where("count <> 240").isEmpty()
    assert {r.metric for r in experiments.summary(run.results).collect()} == {"pr_auc", "f1"}


def test_grids_that_cannot_run(spark):
    df, cells = objects(spark), [("dummy_most_frequent", "orbital_only")]
    for rows, status in ((df.limit(50), "insufficient_data"), (df.withColumn("pha", F.lit(True)), "single_class"), (df.where("false"), "insufficient_data")):
        run = experiments.run(rows, cells)
        assert run.status == status and run.results.first().status == status and run.predictions.isEmpty()


def test_medians_by_sorting(spark):
    rng = random.Random(1)
    n = 3001
    cols = {
        "a": [rng.gauss(0, 1) for _ in range(n)], "b": [rng.choice([1.0, 1.0, 1.0, 2.0, 5.5]) for _ in range(n)], "c": [None] * n, "d": [10.0 ** rng.randint(-300, 300) for _ in range(n)],
        "e": [7.0] * 1500 + [8.0] * 1500 + [None], "f": [None] * (n - 2) + [3.0, 4.0], "g": [float("nan")] * (n - 1) + [1.0],
    }
    df = spark.createDataFrame(list(zip(*cols.values())), ", ".join(f"{c} double" for c in cols)).repartition(5)
    got = quantiles.medians(df, list(cols))
    for c, v in cols.items():
        held = [x for x in v if x is not None and x == x]
        assert got[c] == (statistics.median(held) if held else None)
    assert quantiles.medians(df.where("false"), ["a"]) == {"a": None} and quantiles.medians(df, []) == {}
    assert quality.impute_scale(df.withColumn("k", F.monotonically_increasing_id()), ["c", "e"], "k").columns == ["k", "e"]


def test_a_chain_in_few_rounds(spark, monkeypatch):
    rng = random.Random(2)
    ids = list(range(10_000))
    rng.shuffle(ids)
    rounds = []
    kept = graph.materialised
    monkeypatch.setattr(graph, "materialised", lambda df, name: (rounds.append(name), kept(df, name))[1])
    nodes = spark.range(10_003).withColumnRenamed("id", "k")
    edges = spark.createDataFrame([*zip(ids, ids[1:]), (10_001, 10_002), (10_000, 10_000)], "a long, b long")
    got = {r.k: r.component for r in graph.components(nodes, edges, "k").collect()}
    assert got == {**dict.fromkeys(range(10_000), 0), 10_000: 10_000, 10_001: 10_001, 10_002: 10_001}
    assert rounds.count("edges") <= 16


def test_components_by_union_find(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(900), rng.randrange(900)) for _ in range(500)] + [(5, k) for k in range(600, 900)]
    root = list(range(900))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = graph.components(spark.range(900).withColumnRenamed("id", "k"), spark.createDataFrame(pairs, "a long, b long"), "k").collect()
    assert {r.k: r.component for r in got} == {k: find(k) for k in range(900)}
    named = graph.components(spark.createDataFrame([("b",), ("c",), ("d",)], "k string"), spark.createDataFrame([("c", "b")], "a string, b string"), "k").collect()
    assert {r.k: r.component for r in named} == {"b": "b", "c": "b", "d": "d"}


def plain_nearest(rows, k):
    out = {}
    for i, x in rows:
        out[i] = sorted((sum((a - b) ** 2 for a, b in zip(x, y)) ** 0.5, j) for j, y in rows if j != i)[:k]
    return out


def clusters(n, seed, spread=0.05):
    rng = random.Random(seed)
    centres = [[rng.uniform(-10, 10) for _ in range(4)] for _ in range(12)]
    return [(i, [c + rng.gauss(0, spread) for c in centres[i % 12]]) for i in range(n)]


def test_nearest_by_brute_force(spark):
    rows = clusters(300, 5) + [(1000 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(60)] + [(2000 + i, [float(i), 0.0, 0.0, 0.0]) for i in range(20)]
    df = spark.createDataFrame([*rows, (1, rows[1][1]), (5000, None), (5001, [1.0, float("nan"), 0.0, 0.0])], "k long, v array<double>")
    want = plain_nearest(rows, 4)
    found = neighbours.nearest(df, "k", "v", 4, leaf=20)
    got = {}
    for r in found.rows.orderBy("src", "place").collect():
        got.setdefault(r.src, []).append((r.distance, r.dst))
        assert r.place == len(got[r.src])
    assert set(got) == set(want)
    for i, near in got.items():
        assert [j for _, j in near] == [j for _, j in want[i]] and all(abs(a - b) < 1e-12 for (a, _), (b, _) in zip(near, want[i]))
    few = neighbours.nearest(df.where("k < 3"), "k", "v", 4)
    assert few.rows.count() == 6 and neighbours.nearest(df.where("false"), "k", "v").rows.isEmpty()
    pairs = {(r.src, r.dst) for r in neighbours.within(df, "k", "v", 1.0, leaf=20).rows.collect()}
    assert pairs == {(i, j) for i, x in rows for j, y in rows if i < j and sum((a - b) ** 2 for a, b in zip(x, y)) <= 1.0}
    assert neighbours.within(df.where("false"), "k", "v", 1.0).rows.isEmpty()


def test_copies_are_linked_through_one_of_them(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1), rng.gauss(0, 1), 0.0]) for i in range(120)] + [(1000 + i, [0.0, 0.0, -0.0]) for i in range(300)] + [(2000 + i, [0.0, 0.0, 0.2]) for i in range(300)]
    rows += [(3000, None), (3001, [0.0, float("nan"), 0.0]), (3002, [9.0, 9.0, 9.0]), (2999, [9.0, 9.0, 9.0])]
    df = spark.createDataFrame(rows, "k long, v array<double>")
    links = neighbours.linked(df, "k", "v", 0.25, leaf=20).rows
    plain = neighbours.within(df, "k", "v", 0.25, leaf=20).rows
    assert plain.count() > 600 * 599 // 2 and links.count() < 2000
    want = {tuple(r) for r in graph.components(df.select("k"), graph.undirected(plain), "k").collect()}
    assert {tuple(r) for r in graph.radius_components(df, "k", "v", 0.25).collect()} == want
    assert neighbours.linked(df, "k", "v", -1.0).rows.isEmpty()


def test_links_within_a_radius_are_not_held_back(monkeypatch):
    monkeypatch.setattr(neighbours, "HELD", 500)
    node, v = np.arange(40), np.linspace(0, 0.1, 40)[:, None]
    leaf = neighbours._Leaf(pa.table({"d": v[:, 0], "v": neighbours._lists(v), "node": node, "ids": neighbours._lists(node[:, None])}))
    ask, sent = neighbours._Asking(node + 100, v, np.full(40, 1.0), None), []
    for _ in range(3):
        ask.meet(leaf, node, None, np.zeros(40))
        sent += list(ask.sent())
        assert not len(ask.row)
    found = [r for b in [*sent, ask.answers()] for r in b.to_pylist()]
    assert sum(r["id"] is not None for r in found) == sum(r["compared"] or 0 for r in found) == 3 * 1600


def test_clustered_rows_compare_few_pairs(spark):
    n = 4000
    df = spark.createDataFrame(clusters(n, 9), "k long, v array<double>")
    found = neighbours.nearest(df, "k", "v", 5, leaf=50)
    assert found.rows.count() == 5 * n
    assert sum(r.pairs for r in found.compared.collect()) < n * n / 12 * 0.7  # well below the pairs within the clusters


def test_propagation_by_plain_rounds(spark):
    rng = random.Random(8)
    fixed = {k: float(rng.random() < 0.5) if k % 4 == 0 else None for k in range(120)}
    pairs = {tuple(sorted((rng.randrange(110), rng.randrange(110)))): rng.random() for _ in range(260)}
    edges = [(a, b, w) for (a, b), w in pairs.items() if a != b]
    score = {k: 0.5 if v is None else v for k, v in fixed.items()}
    for _ in range(500):
        near = {k: [(w, score[a if b == k else b]) for a, b, w in edges if k in (a, b)] for k, v in fixed.items() if v is None}
        score |= {k: sum(w * x for w, x in n) / sum(w for w, _ in n) for k, n in near.items() if n}
    nodes = spark.createDataFrame(list(fixed.items()), "k long, y double")
    got = models.label_propagation(nodes, spark.createDataFrame(edges, "a long, b long, similarity double"), "k", "y", tolerance=1e-5).collect()
    assert len(got) == 120 and all(abs(r.score - score[r.k]) < 1e-3 for r in got)


def test_models_after_an_observed_write(spark, tmp_path):
    """A session that has observed a write still sends fitted models to tasks."""
    assert sinks.write_table(spark.range(3), str(tmp_path / "t"))["row_count"] == 3
    df = objects(spark).select("object_key", F.col("pha").cast("int").alias("label"), "e", "a")
    for model in ("logistic_regression", "random_forest", "mlp"):
        assert models.predictions(df, model, ["e", "a"]).count() == 240
        assert models.predictions(df, model, ["e", "a"]).where("score > 2").isEmpty()


def _tasks_of_fits(monkeypatch):
    """Tasks of the tables that pipelines are fitted to, as they come."""
    seen, fit = [], Pipeline.fit
    monkeypatch.setattr(Pipeline, "fit", lambda self, df, *a: seen.append(df.rdd.getNumPartitions()) or fit(self, df, *a))
    return seen


def test_fits_have_a_task_for_each_core(spark, monkeypatch):
    seen, cores = _tasks_of_fits(monkeypatch), spark.sparkContext.defaultParallelism
    monkeypatch.setattr(models, "FIT_ROWS", 30, raising=False)  # 240 rows: 180 to learn from
    df = objects(spark).withColumn("label", F.col("pha").cast("int"))
    out = models.predictions(df, "random_forest", ["e", "a"])
    assert out.count() == 240 and seen == [cores * -(-180 // (cores * 30))]


def test_cells_learn_from_rows_dealt_out_once(spark, monkeypatch):
    seen, cores = _tasks_of_fits(monkeypatch), spark.sparkContext.defaultParallelism
    run = experiments.run(objects(spark), [("random_forest", "orbital_only"), ("logistic_regression", "orbital_only")], modes=("eval", "full"))
    assert run.status == "success" and seen == [cores] * 4
    assert run.predictions.where("prediction_mode = 'full'").count() == 480


def test_rows_without_clusters_visit_shelves_once(spark, monkeypatch):
    """Without clusters nothing is ruled out: a row is sent once for each shelf, and results are those of all pairs."""
    rng, n, k = np.random.default_rng(3), 3000, 4
    v = rng.normal(size=(n, 16))
    v[2990:] = v[:10]  # equal rows
    v[2980] *= 1e200  # whose square is no number
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "k long, v array<double>")
    monkeypatch.setattr(neighbours, "SHELF", n * (16 * 8 + 64) // 5)
    index = neighbours.built(neighbours._entries(neighbours._points(df, "k", "v"), k + 1), 20)
    members, tasks, visitors = neighbours._grid(index, k + 1, False)
    assert 5 <= tasks <= 12 and len(index.parts) > 40
    sent = visitors(index.placed.withColumn("u", F.lit(1e6))).groupBy("node").count().agg(F.max("count")).first()[0]
    assert sent <= 6 and members.count() == index.placed.count() * (tasks // 6 if tasks % 6 == 0 else tasks // 5)
    with np.errstate(over="ignore"):
        far = np.stack([np.sqrt(((v - x) ** 2).sum(axis=1)) for x in v])
    np.fill_diagonal(far, np.nan)
    got = {}
    for r in neighbours.nearest(df, "k", "v", k, leaf=20).rows.orderBy("src", "place").collect():
        got.setdefault(r.src, []).append(r.dst)
    for i in range(n):
        assert got[i] == np.lexsort((np.arange(n), far[i]))[:k].tolist(), i
    pairs = {(r.src, r.dst) for r in neighbours.within(df, "k", "v", 3.0, leaf=20).rows.collect()}
    assert pairs == {(i, j) for i, j in zip(*np.nonzero(far <= 3.0)) if i < j}


def test_a_cell_that_fails_ends_the_grid(spark, monkeypatch):
    def broken(p, model, *rest):
        if model == "logistic_regression":
            raise MemoryError("no room")
        return fits(p, model, *rest)

    fits = experiments._scores
    monkeypatch.setattr(experiments, "_scores", broken)
    with pytest.raises(RuntimeError, match="logistic_regression on orbital_only failed: no room"):
        experiments.run(objects(spark), [("dummy_most_frequent", "orbital_only"), ("logistic_regression", "orbital_only")])


def test_rows_that_no_cell_predicts_are_an_error(spark, monkeypatch):
    df = objects(spark)
    for rows, says in ((df.limit(15), "random_forest on orbital_only: insufficient_data"), (df.withColumn("pha", F.lit(True)), "single_class"), (df.drop("e", "a", "q", "i"), "logistic_regression on orbital_only: skipped")):
        monkeypatch.setattr(q, "scores", lambda *_, rows=rows: rows)
        monkeypatch.setattr(experiments, "EVIDENCE", [(m, s) for m, s in experiments.EVIDENCE if s == "orbital_only"])
        with pytest.raises(ValueError, match=says):
            QUERIES["full_predictions"](spark, SF)
    monkeypatch.setattr(q, "scores", lambda *_: df.where("false"))
    assert QUERIES["full_predictions"](spark, SF).isEmpty()
