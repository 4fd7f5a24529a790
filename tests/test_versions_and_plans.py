"""Descent over folds, label versions, candidate plans, the paged source and compaction, against plain versions."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import descent, lineage, metrics
from folioscope.sources import paged, plan_checks
from folioscope.sources.files import page_plan
from folioscope.streaming import ingest


def plain_descent(x, y, epochs, rate=0.15, penalty=1e-3):
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(epochs):
        error = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y
        w, b = w - rate * (x.T @ error / len(y) + penalty * w), b - rate * error.mean()
    return w, b


@pytest.mark.parametrize("k", [3, 7])
def test_descent_and_its_optimum(spark, k):
    rng = np.random.default_rng(k)
    x = rng.normal(size=(210, 2))
    y = (rng.random(210) < 1 / (1 + np.exp(-(x @ [1.0, -0.5] + 0.3)))).astype(float)
    fold = np.arange(210) % k
    df = spark.createDataFrame([(float(a), float(b), float(v), int(f)) for (a, b), v, f in zip(x, y, fold, strict=True)], "a double, b double, y double, fold int").repartition(3)
    for rows, epochs in ((descent.by_descent(df, ["a", "b"], "y", "fold", epochs=5), 5), (descent.optimum(df, ["a", "b"], "y", "fold"), 6000)):
        got = {r["test"]: (r["weights"], r["bias"]) for r in rows.collect()}
        assert sorted(got) == list(range(k))
        for t, (weights, bias) in got.items():
            w, b = plain_descent(x[fold != t], y[fold != t], epochs)
            assert weights == pytest.approx(w, abs=2e-4) and bias == pytest.approx(b, abs=2e-4)


def test_descent_of_one_class_and_of_nothing(spark):
    one = spark.createDataFrame([(1.0, 1.0, i % 2) for i in range(6)], "a double, y double, fold int")
    assert all(np.isfinite(r["bias"]) for r in descent.optimum(one, ["a"], "y", "fold").collect())
    assert descent.optimum(one.limit(0), ["a"], "y", "fold").count() == 0


def test_a_changed_row_shows_in_every_later_version(spark):
    rows = [(v, i, f"t{i}" if i % 5 else None, i % 2) for v in (1, 2, 3) for i in range(v * 20)]
    shape = "version int, id int, text string, y int"
    base = spark.createDataFrame(rows, shape)

    def chained(df):
        return {r["version"]: r for r in lineage.chain(df, "version", ["id", "text", "y"]).collect()}

    a, b = chained(base), chained(base.repartition(5, "y"))
    assert a == b and [a[v]["rows"] for v in (1, 2, 3)] == [20, 40, 60]
    c = chained(base.withColumn("y", F.when((F.col("version") == 2) & (F.col("id") == 7), 9).otherwise(F.col("y"))))
    assert c[1] == a[1] and c[2]["content_hash"] != a[2]["content_hash"]
    assert c[3]["content_hash"] == a[3]["content_hash"] and c[3]["chain_hash"] != a[3]["chain_hash"]
    twice = chained(base.union(base.where("version = 3 and id = 1")))
    assert twice[3]["content_hash"] != a[3]["content_hash"] and twice[2] == a[2]
    assert lineage.chain(base.limit(0), "version", ["id"]).count() == 0
    # the text "1:x" cannot be told for a length and a text
    odd = spark.createDataFrame([(1, "a|1:b", None), (2, "a", "1:b"), (3, None, "-"), (4, "-", None), (5, "", None)], "version int, s string, t string")
    assert len({r["content_hash"] for r in lineage.chain(odd, "version", ["s", "t"]).collect()}) == 5


def test_faults_between_versions(spark):
    d = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, None), (3, 1, "a"), (3, 2, "B"), (3, 4, "n"), (3, 4, "n"), (3, None, "x"), (None, 5, "q")], "v int, id int, t string")
    got = {tuple(r) for r in lineage.faults(d, "v", "id", ["t"]).collect()}
    assert got == {(3, 2, "altered"), (3, 3, "lost"), (3, 4, "repeated"), (3, None, "keyless")}


def test_sheet_against_template(spark):
    sheet = spark.createDataFrame([(1, "a", "x"), (2, "b", None), (4, "d", "z")], "id int, t string, u string")
    template = spark.createDataFrame([(1, "a", "x"), (2, "B", None), (3, "c", "y")], "id int, t string, u string")
    got = {tuple(r) for r in lineage.template_faults(sheet, template, "id", ["t", "u"]).collect()}
    assert got == {(2, "changed", "t"), (3, "missing", None), (4, "unexpected", None)}


def good_plan(**changes):
    rows = [{"openalex_id": "W1", "title": "one", "year": 2001}, {"id": "W2", "title": "two", "year": 0, "publication_year": 2002}]
    plan = {"selected_total": 2, "target_min": 1, "target_max": 3, "auth_mode": "api_key", "api_key_provided": True, "caveats": ["Dry-run output", "no Postgres writes"], "selected_candidates": rows}
    return json.dumps({k: v for k, v in (plan | changes).items() if v != "gone"})


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (good_plan(), set()),
        (None, {(None, "not_json")}), ("", {(None, "not_json")}), ("{", {(None, "not_json")}), ("[1]", {(None, "not_object")}), ("null", {(None, "not_object")}),
        (good_plan(selected_total="2"), {(None, "selected_total_not_integer")}), (good_plan(selected_total=True), {(None, "selected_total_not_integer")}),
        (good_plan(selected_total=0, selected_candidates=[], target_min=0), {(None, "selected_total_not_positive")}),
        (good_plan(selected_total=3), {(None, "candidates_count")}), (good_plan(selected_candidates={}), {(None, "candidates_not_list")}),
        (good_plan(target_min="gone"), {(None, "target_min_not_integer")}), (good_plan(target_max=0), {(None, "target_range_reversed"), (None, "outside_target_range")}),
        (good_plan(auth_mode=None), {(None, "auth_mode")}), (good_plan(api_key_provided="true"), {(None, "key_not_provided")}),
        (good_plan(caveats="gone"), {(None, "caveats_not_list")}), (good_plan(caveats=["dry-run"]), {(None, "caveats_without_dry_run")}),
        (good_plan(a={"b": [{"my_API_key": "s"}]}), {(None, "secret_field")}), (good_plan(mailto=""), set()), (good_plan(note='"email": "x"'), set()),
        (good_plan(contact_list=["x", "a@b.org"]), {(None, "contact_address")}), (good_plan(note="a@b.org"), set()),
        (good_plan(selected_candidates=[7, {"id": " ", "title": 5, "year": "2001"}]), {(1, "candidate_not_object"), (2, "candidate_without_id"), (2, "candidate_year_not_integer")}),
        (good_plan(selected_candidates=[{"id": "W1", "year": 2001.5}, {"openalex_id": 5, "id": "W", "title": "\t", "year": True}]),
         {(1, "candidate_without_title"), (1, "candidate_year_not_integer"), (2, "candidate_without_id"), (2, "candidate_without_title"), (2, "candidate_year_not_integer")}),
    ],
)
def test_plan_rules(spark, body, want):
    plans = spark.createDataFrame([(1, body, "clash")], "k int, body string, _v string").select("k", "body")
    assert {(r["position"], r["rule"]) for r in plan_checks.violations(plans, "k", "body").collect()} == want


def fetcher(calls):
    """Pages of two works; source ``a`` has three pages, ``b`` an empty last page that still names a cursor, ``c`` no results at all."""

    def fetch(source, params, cursor):
        with open(calls, "a") as f:
            f.write(f"{source} {cursor} {params['per_page']}\n")
        at = 0 if cursor == "*" else int(cursor)
        if source == "c":
            return {"meta": {}}
        last = 2
        works = [] if source == "b" and at == last else [{"id": f"{source}{at}{i}"} for i in range(2)]
        return {"meta": {"next_cursor": None if source == "a" and at == last else str(at + 1)}, "results": works}

    return fetch


def test_paged_source_stops_and_goes_on(spark, tmp_path):
    plans = {s: page_plan(s, 2000, "en", ("article",)) for s in "abc"}
    fetch = fetcher(str(tmp_path / "calls"))
    everything = paged.read_paged(spark, plans, fetch).drop("payload").collect()
    assert sorted((r["source_slug"], r["page_index"], r["page_cursor"], r["works"]) for r in everything) == [("a", 0, "*", 2), ("a", 1, "1", 2), ("a", 2, "2", 2), ("b", 0, "*", 2), ("b", 1, "1", 2), ("b", 2, "2", 0), ("c", 0, "*", 0)]
    # a page a run, each run going on where the landed pages end, gives the same pages
    landed, mark = None, None
    for run in range(5):
        got = paged.read_paged(spark, plans, fetch, max_pages=1, watermarks=mark)
        got.write.parquet(f"{tmp_path}/run{run}")
        got = spark.read.parquet(f"{tmp_path}/run{run}")
        landed = got if landed is None else landed.union(got)
        mark = paged.cursors(landed)
    assert sorted(tuple(r) for r in landed.drop("payload").collect()) == sorted(tuple(r) for r in everything)
    assert spark.read.parquet(f"{tmp_path}/run4").count() == 0
    assert {r["source_slug"]: (r["next_cursor"], r["pages"]) for r in mark.collect()} == {"a": (None, 3), "b": (None, 3), "c": (None, 1)}


def test_cursor_that_stands_still():
    with pytest.raises(ValueError, match="does not move"):
        list(paged.pages_of("s", {}, "x", 0, None, lambda *_: {"meta": {"next_cursor": "x"}, "results": [1]}))


def test_compaction_keeps_the_state(spark, tmp_path):
    pages, table = tmp_path / "pages", f"{tmp_path}/table"
    pages.mkdir()

    def add(i):
        works = [{"id": f"W{i}", "title": f"own {i}"}, {"id": "W99", "title": f"shared {i}"}]
        (pages / f"{i}.json").write_text(json.dumps({"source_slug": "s", "page_index": i, "results": works}))
        ingest.ingest_pages(spark, str(pages), table, f"{tmp_path}/check", files_per_batch=1).awaitTermination(120)

    def state():
        return {r["paper_id"]: r["title"] for r in ingest.current_works(spark, table).collect()}

    for i in range(6):
        add(i)
        if i in (1, 3, 4):
            reader = ingest.current_works(spark, table)
            assert ingest.compact(spark, table) == i
            assert ingest.compact(spark, table) == i
            assert reader.count() == i + 2
        assert state() == {f"W{n}": f"own {n}" for n in range(i + 1)} | {"W99": f"shared {i}"}
    left = sorted(p.name for p in (tmp_path / "table").glob("batch=*"))
    assert left == ["batch=4", "batch=5"]
    # a compaction that broke off has no mark and does not count
    (tmp_path / "table-base" / "upto=5").mkdir()
    assert state()["W99"] == "shared 5"
    assert ingest.compact(spark, table) == 5 and state()["W99"] == "shared 5"
    assert ingest.current_works(spark, table).count() == 7


def test_family_context_by_hand(spark):
    rows = [("f", 0.5, 1, True), ("f", 0.4, 2, False), ("f", 0.2, 5, True), ("f", None, None, True), ("f", 0.1, 9, None), ("g", None, None, None)]
    d = spark.createDataFrame(rows, "fam string, s double, r int, y boolean")
    got = {r["fam"]: r for r in metrics.family_context(d, "fam", "s", "r", ["y"]).collect()}
    f = got["f"]
    assert (f["positive_count"], f["negative_count"], f["null_count"], f["rows_with_score"], f["rows_with_rank"]) == (3, 1, 1, 4, 4)
    assert (f["mean_score_positive"], f["mean_score_negative"], f["median_rank_positive"], f["median_rank_negative"], f["roc_auc"]) == (0.35, 0.4, 3.0, 2.0, 0.5)
    assert got["g"]["null_count"] == 1 and got["g"]["roc_auc"] is None and got["g"]["mean_score_positive"] is None
