"""Exact quantiles, samples with budgets and the vector index, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import bridges, descent, labels, metrics, neighbors, order_stats, samplers, vector_index
from folioscope.sources.corpus import Corpus


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(g, float(v)) for g in ("a", "b", None) for v in rng.integers(0, 40, 301)] + [("one", 3.5), ("none", None), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = {"p10": 0.1, "p50": 0.5, "p99": 0.99, "top": 1.0}
    got = {r["g"]: r for r in order_stats.quantiles(df, "v", shares, "g").collect()}
    assert set(got) == {"a", "b", None, "one"}
    for g, r in got.items():
        values = [v for h, v in rows if h == g and v is not None]
        assert [r[n] for n in shares] == pytest.approx([np.quantile(values, p) for p in shares.values()])
    whole = order_stats.quantiles(df, "v", {"m": 0.5}).first()
    assert whole["m"] == np.median([v for _, v in rows if v is not None])


def test_auc_without_groups(spark):
    rng = np.random.default_rng(2)
    rows = [(float(s), bool(y)) for s, y in zip(rng.integers(0, 50, 400) / 50, rng.random(400) < 0.4, strict=True)]
    df = spark.createDataFrame(rows, "s double, y boolean")
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg])
    assert metrics.roc_auc(df, "s", "y").first()["roc_auc"] == pytest.approx(want)


@pytest.mark.parametrize("k", [3, 7])
def test_folds_of_any_number_are_even(spark, k):
    df = spark.createDataFrame([(i * i, i % 5 == 0) for i in range(100)], "key long, y boolean")
    got = labels.stratified_folds(df, "y", "key", k).collect()
    for y in (True, False):
        assert [r["fold"] for r in sorted((r for r in got if r["y"] == y), key=lambda r: r["key"])] == [i % k for i in range(sum(r["y"] == y for r in got))]
    fitted = descent.by_descent(labels.stratified_folds(df, "y", "key", k).withColumn("x", F.col("key") / 1000.0).withColumn("t", F.col("y").cast("double")), ["x"], "t", "fold", epochs=5)
    assert sorted(r["test"] for r in fitted.collect()) == list(range(k))


def test_min_max_of_a_constant_and_of_null_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", 2.0), (None, 5.0), (None, 5.0)], "g string, v double")
    assert sorted(r["x"] for r in order_stats.min_max(df, "v", "x", "g").collect()) == [0.0, 0.5, 0.5, 0.5, 1.0]


def sampled_plainly(rows, total, budgets, seed):
    import hashlib

    h = lambda key: hashlib.md5(f"{seed}:{key}".encode()).hexdigest()
    left, out, carry = list(rows), [], 0
    for (name, _, stratum, ok), quota in zip(budgets, samplers.quotas(total, [samplers.Budget(n, s, ()) for n, s, *_ in budgets]), strict=True):
        strata = {}
        for r in sorted((r for r in left if ok(r)), key=lambda r: (h(r[0]), r[0])):
            strata.setdefault(r[stratum], []).append(r)
        placed = sorted((nth, g is not None, g or "", h(r[0]), r[0]) for g, members in strata.items() for nth, r in enumerate(members, 1))
        got = placed[: quota + carry]
        carry += quota - len(got)
        out += [(key, name, nth) for nth, *_, key in got]
        taken = {key for *_, key in got}
        left = [r for r in left if r[0] not in taken]
    return sorted(out)


def test_budgets_are_spread_and_carried_on(spark):
    rows = [(i, ("x", "y", None, "z")[i % 4 if i % 3 else 0], "hot" if i % 3 else f"c{i % 11}") for i in range(400)]
    df = spark.createDataFrame(rows, "key long, a string, b string")
    budgets = [("first", 0.8, 1, lambda r: r[0] < 60), ("second", 0.2, 2, lambda r: True)]
    got = samplers.sample_with_budgets(df, "key", "s", 101, [samplers.Budget("first", 0.8, ("a",), F.col("key") < 60), samplers.Budget("second", 0.2, ("b",))])
    assert sorted((r["key"], r["bucket"], r["nth"]) for r in got.collect()) == sampled_plainly(rows, 101, budgets, "s")
    assert samplers.quotas(10, [samplers.Budget(n, 1.0, ()) for n in "abc"]) == [4, 3, 3]
    assert samplers.sample_with_budgets(df.limit(0), "key", "s", 10, [samplers.Budget("first", 1.0, ("a",))]).count() == 0


def test_index_recall_and_exact_way(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 24))
    points = [(i, (centres[i % 40 if i % 3 else 0] + 0.6 * rng.normal(size=24)).tolist(), f"c{i % 40}") for i in range(3000)]
    vectors = spark.createDataFrame([*points, (9000, [0.0] * 24, "none")], "work_id long, vector array<double>, cluster_id string")
    queries = vectors.where("work_id % 100 = 0")
    exact = {(r["query_id"], r["work_id"]) for r in neighbors.nearest(vectors, queries, 10).collect()}
    index = vector_index.build_vector_index(vectors, sample_rows=1000)
    assert index.rows.count() == 3000  # every vector with a direction
    got = {(r["query_id"], r["work_id"]) for r in vector_index.nearest_by_index(index, queries, 10, vector_index.probes_for(index, 10), block=64).collect()}
    assert len(got & exact) / len(exact) >= 0.9
    every = {(r["query_id"], r["work_id"]) for r in vector_index.nearest_by_index(index, queries, 10, probes=10_000).collect()}
    assert every == exact
    assert vector_index.build_vector_index(vectors.limit(0)) is None


def test_index_recall_on_the_embeddings(spark, sf_dir):
    from folioscope.plans import queries
    from folioscope.sources.corpus import Corpus

    v = Corpus(spark, sf_dir).vectors
    exact = {(r["query_id"], r["work_id"]) for r in neighbors.nearest(v, v.where("work_id % 100 = 0"), 15).collect()}
    got = {(r["query_id"], r["work_id"]) for r in queries.queries()["neighbors_by_index"](spark, sf_dir).collect()}
    assert len(got & exact) / len(exact) >= 0.9


def test_blocks_of_vectors_grow_with_the_table():
    assert neighbors.deal(100, 40, block=16) == (7, 3)
    for n in (10_000, 100_000, 500_000):
        queries, rows = neighbors.deal(n, n)
        assert queries * rows <= neighbors.GROUPS and queries + rows <= 40  # so often is a vector shuffled, whatever the size
    assert neighbors.deal(6_000, 600_000)[0] * 600_000 <= 4_000_000
    for n in (600_000, 5_000_000):
        assert -(-n // min(neighbors.deal(n, n))) <= neighbors.MOST_ROWS


def test_a_vector_is_sent_as_often_from_a_large_table_as_from_a_small_one():
    often = [sum(neighbors.deal(n, n)) for n in (10_256, 51_282, 102_560, 500_000)]
    assert set(often) == {19}
    assert sum(neighbors.deal(615_360, 615_360)) <= 20


def test_the_neighbour_search_stands_once_behind_a_cutoff(spark, sf_dir):
    rows = bridges.eligibility(bridges.bridge_rows(Corpus(spark, sf_dir).vectors))
    assert "FlatMapGroups" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_nearest_of_copies_ties_by_id_in_any_blocks(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(40, 24))
    x = np.concatenate([base[rng.integers(0, 40, 300)], np.tile(base[0], (200, 1)), 3 * base[:20]])
    ids = rng.permutation(len(x)) + 1000
    points = spark.createDataFrame([(int(i), v.tolist(), f"c{i % 7}") for i, v in zip(ids, x, strict=True)] + [(1, [0.0] * 24, "none")], "work_id long, vector array<double>, cluster_id string")
    want = set()
    for i, v in zip(ids, x, strict=True):
        dot, left, right = (sum(a) for a in zip(*((p * q, p * p, q * q) for p, q in zip(x.T, v, strict=True)), strict=True))
        s = np.clip(dot / np.sqrt(left * right), -1, 1)
        found = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:6]
        want |= {(int(i), int(ids[j]), f"c{ids[j] % 7}", n) for n, j in enumerate(found, 1)}
    for block in (32, 1024):
        got = neighbors.nearest(points, points, 6, block=block)
        assert {(r["query_id"], r["work_id"], r["cluster_id"], r["nth"]) for r in got.collect()} == want


def test_vectors_go_to_cells_in_bounded_batches(spark, monkeypatch):
    points = spark.createDataFrame([(i, [float(i % 7 + 1), float(i % 5), 1.0], "c") for i in range(90)], "work_id long, vector array<double>, cluster_id string")
    centroids = np.eye(3)
    want = sorted(tuple(r)[:2] for r in vector_index._celled(points, centroids, 2).collect())
    assert len(want) == 180
    monkeypatch.setattr(vector_index, "CELLED_NUMBERS", 60)
    seen = []
    monkeypatch.setattr(type(points), "mapInPandas", lambda self, run, schema: seen.append(run))
    vector_index._celled(points, centroids, 2)
    parts = list(seen[0](iter([points.toPandas()])))
    assert max(len(p) for p in parts) <= 20
    assert sorted((int(c), int(w)) for p in parts for c, w in zip(p["cell"], p["work_id"], strict=True)) == want
