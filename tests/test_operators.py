"""Hand-computed expectations and edge cases."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions import numeric, policy, text, vectors
from folioscope.operators import bridges, experiments, labels, metrics, neighbors, ranks
from folioscope.plans import ranking
from folioscope.sources import files, upsert
from folioscope.streaming import ingest


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("x")])
    return df.select(column.alias("v")).first()["v"]


def frame(spark, ddl, *rows):
    return spark.createDataFrame(list(rows), ddl)


def by(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


# Scores


def partial(spark, w, sem, vel, gro, bri, pen):
    c = [F.lit(x).cast("double") for x in (sem, vel, gro, bri, pen)]
    return one(spark, ranking.partial_score(w, *c))


def test_partial_score(spark):
    w = ranking.Weights(0.3, 0.3, 0.2, 0.1, 0.1)
    assert partial(spark, w, None, 0.5, 0.5, None, 0.1) == pytest.approx(0.49)
    assert partial(spark, w, None, None, None, None, None) == 0.0
    assert partial(spark, ranking.Weights(0.5, 0.5, 0.0, 0.0, 0.0), None, 1.0, None, None, None) == pytest.approx(1.0)
    assert partial(spark, ranking.Weights(0.5, 0.0, 0.0, 0.0, 0.0), None, 1.0, None, None, None) == 0.0


def test_bridge_weight_is_bounded():
    assert ranking.family_weights(0.25)["bridge"].bridge == 0.25
    with pytest.raises(ValueError):
        ranking.family_weights(0.3)


def test_signals_by_hand(spark):
    ddl = "work_id long, year int, citation_count int, topic_ids array<int>, is_core_corpus boolean, title string, abstract string"
    rows = [(10, 2026, 8, [1, 2, 3], True, "t", "a"), (20, 2026, 1, [1], True, "t", "a"), (30, 2024, 20, [2], True, "t", "a"), (40, 2024, 20, [], True, " ", "a")]
    s = {r["work_id"]: r for r in ranking.signals(frame(spark, ddl, *rows[:3])).collect()}
    assert [s[i]["velocity"] for i in (10, 20, 30)] == [1.0, 0.125, 0.833333]
    assert [s[i]["growth"] for i in (10, 20, 30)] == [0.833333, 1.0, 0.5]
    assert [s[i]["breadth_penalty"] for i in (10, 20, 30)] == [0.0, 0.666667, 0.666667]
    assert [s[i]["popularity_penalty"] for i in (10, 20, 30)] == [0.721698, 0.22767, 1.0]
    t = {r["work_id"]: r for r in ranking.signals(frame(spark, ddl, *rows)).collect()}
    assert t[40]["growth"] == 0.0 and t[40]["popularity_penalty"] is None and not t[40]["in_pool"]
    assert ranking.signals(frame(spark, ddl)).count() == 0


def test_rank_percentiles(spark):
    df = frame(spark, "w string, g int, x double", ("W1", 1, 0.9), ("W2", 1, 0.8), ("W3", 1, 0.8), ("W4", 1, 0.1), ("solo", 2, 0.5))
    p = ranks.percentiles(df, "x", "a", "b", ("g",))
    a, b = by(p, "w", "a"), by(p, "w", "b")
    assert a == {"W1": 1.0, "W2": 0.5, "W3": 0.5, "W4": 0.0, "solo": 1.0}
    assert b == {"W1": 0.875, "W2": 0.5, "W3": 0.5, "W4": 0.125, "solo": 0.5}


def test_min_max_of_constants(spark):
    df = frame(spark, "g int, x double", (1, 3.0), (1, 3.0))
    assert {r["v"] for r in df.select(numeric.min_max(F.col("x"), F.col("g")).alias("v")).collect()} == {0.5}


# Metrics


SCORED = [("W1", 0.9, True), ("W2", 0.8, False), ("W3", 0.8, True), ("W4", 0.1, False)]


def test_metrics_by_hand(spark):
    df = frame(spark, "w string, s double, y boolean", *SCORED)
    assert metrics.roc_auc(df, "s", "y").first()["roc_auc"] == pytest.approx(0.875)
    assert metrics.average_precision(df.withColumn("g", F.lit(1)), "s", "y", "w", "g").first()["average_precision"] == pytest.approx(0.833333)
    p = metrics.precision_at(df.withColumn("g", F.lit(1)), "s", "y", "w", [1, 2, 3, 5], "g").first()
    assert [p[f"precision_at_{k}"] for k in (1, 2, 3, 5)] == [1.0, 0.5, pytest.approx(0.666667), None]


def test_auc_needs_both_labels(spark):
    assert metrics.roc_auc(frame(spark, "s double, y boolean", (0.5, True)), "s", "y").first()["roc_auc"] is None


def test_sets(spark):
    o = lambda a, b, e=1.0: one(spark, bridges.overlap(F.lit(a).cast("array<int>") if a else F.array().cast("array<int>"), F.lit(b).cast("array<int>") if b else F.array().cast("array<int>"), e))
    assert o([1, 2], [2, 3])["jaccard"] == pytest.approx(0.333333)
    assert o([], [])["jaccard"] == 1.0 and o([], [], None)["jaccard"] is None


# Vectors


def test_vector_expressions(spark):
    assert one(spark, vectors.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0)))) is None
    assert one(spark, vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None
    assert one(spark, vectors.cosine(F.array(F.lit(2.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(0.70710678)
    assert not one(spark, vectors.finite(F.array(F.lit(float("nan")))))


def points(spark, *rows):
    return frame(spark, "work_id long, vector array<double>, cluster_id string", *rows)


def test_kmeans(spark):
    p = points(spark, (10, [0.0, 0.0], ""), (11, [0.1, 0.0], ""), (20, [10.0, 10.0], ""), (21, [10.2, 10.1], ""))
    assert by(neighbors.kmeans(p, 2), "work_id", "cluster_id") == {10: "c000", 11: "c000", 20: "c001", 21: "c001"}
    assert neighbors.kmeans(p.limit(0), 2).count() == 0


def test_boundary(spark):
    p = points(spark, (1, [0.0, 0.0], "a"), (2, [10.0, 0.0], "b"), (3, [4.0, 0.0], "b"))
    assert by(neighbors.bridge_boundary(p), "work_id", "boundary") == {1: 0.0, 2: pytest.approx(0.09), 3: pytest.approx(0.5625)}
    assert by(neighbors.bridge_boundary(p.where("cluster_id = 'b'")), "work_id", "boundary") == {2: None, 3: None}


def test_neighbor_mix(spark):
    p = points(spark, (1, [1.0, 0.0], "a"), (2, [1.0, 0.1], "a"), (3, [1.0, 0.2], "b"), (4, [0.0, 0.0], "b"))
    got = {r["work_id"]: r for r in neighbors.neighbor_mix(p, 2).collect()}
    assert got[1]["mix_score"] == 0.5 and got[1]["eligible"]
    assert not got[4]["eligible"] and got[4]["mix_score"] is None
    assert not any(r["eligible"] for r in neighbors.neighbor_mix(p, 3).collect())


def test_nearest_in_blocks_is_exact(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 4))
    p = points(spark, *[(i, v.tolist(), "a") for i, v in enumerate(x)])
    got = {(r["query_id"], r["nth"]): r["work_id"] for r in neighbors.nearest(p, p.where("work_id % 10 = 0"), 5, block=16).collect()}
    n = x / np.linalg.norm(x, axis=1)[:, None]
    for q in range(0, 60, 10):
        s = n @ n[q]
        s[q] = -9
        assert [got[q, k] for k in range(1, 6)] == np.argsort(-s)[:5].tolist()


def test_slice_fit_of_opposite_vectors(spark):
    p = points(spark, (1, [1.0, 0.0], "a"), (2, [-1.0, 0.0], "a"))
    assert by(neighbors.slice_fit(p), "work_id", "fit") == {1: 0.5, 2: 0.5}


# Text


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("Fooâ\u0080\u0093Bar", "Foo-Bar"), ("modelâs output", "model's output"), ("a &amp;amp; b", "a & b"), ("  x \n y ", "x y"), ("“q”", '"q"'), (None, ""), ("cafÃ©", "café"),
    ],
)
def test_cleaning(spark, raw, clean):
    df = frame(spark, "t string", (raw,))
    assert df.select(text.cleaned(F.col("t")).alias("v")).first()["v"] == clean


def test_text_keys(spark):
    assert one(spark, text.doi_key(F.lit(" HTTPS://doi.org/10.1/AB "))) == "10.1/ab"
    assert one(spark, text.doi_key(F.lit("  "))) is None
    assert one(spark, text.work_token(F.lit("https://x/w42"))) == "W42"
    assert one(spark, text.work_token(F.lit("none"))) is None
    assert one(spark, text.preview(F.lit("a" * 300))) == "a" * 239 + "..."
    assert one(spark, text.preview(F.lit("a" * 240))) == "a" * 240
    assert one(spark, text.terms(F.lit("The study of Bach, a fugue"))) == ["bach", "fugue"]
    assert one(spark, text.text_from_positions(F.create_map(F.lit("b"), F.array(F.lit(1), F.lit(3)), F.lit("a"), F.array(F.lit(0))))) == "a b b"
    assert one(spark, text.embedding_text(F.lit("T"), F.lit(None).cast("string"))) == "Title: T"
    a, b = (frame(spark, "d string", (d,)).select(text.canonical_json_hash("d").alias("v")).first()["v"] for d in ('{"b":1,"a":2}', '{"a": 2, "b": 1}'))
    assert a == b


# Policy


def decide(spark, **over):
    p = policy.Policy(min_year=2016, types=("article",), exclusion_terms=("speech recognition",), strong_terms=("music tagging",), edge_terms=("music generation",), sources={"s": "core"})
    v = {"title": "Music tagging", "year": 2020, "lang": "en", "kind": "article", "retracted": False, "abstract": "x", "source": "s", "curated": False, "connected": False} | over
    df = frame(spark, "title string, year int, lang string, kind string, retracted boolean, abstract string, source string, curated boolean, connected boolean", tuple(v.values()))
    d = policy.decide(p, policy.blob("title", "abstract"), *[F.col(c) for c in ("year", "lang", "kind", "retracted", "abstract", "source", "curated", "connected")])
    return df.select(d.alias("d")).first()["d"]["reason"]


@pytest.mark.parametrize(
    ("over", "reason"),
    [
        ({}, "core_source_topic_match"), ({"year": None}, "before_year_floor"), ({"lang": "de"}, "language_mismatch"), ({"kind": None}, "document_type_excluded"), ({"retracted": True}, "retracted"),
        ({"abstract": " "}, "missing_abstract"), ({"title": "Speech recognition"}, "explicit_exclusion_term"), ({"source": "z"}, "source_not_allowed"), ({"source": None, "curated": True}, "curated_edge_allowlist"),
        ({"source": None, "connected": True}, "citation_connected_edge"), ({"title": "Music generation"}, "edge_term_without_core_signal"), ({"title": "Bees"}, "topic_gate_failed"),
    ],
)
def test_policy_names_the_first_failing_gate(spark, over, reason):
    assert decide(spark, **over) == reason


# Labels


def test_label_maps(spark):
    assert one(spark, labels.good_or_acceptable(F.lit(" Good "))) is True
    assert one(spark, labels.good_or_acceptable(F.lit("weird"))) is None
    assert one(spark, labels.bridge_like(F.lit("not_applicable"))) is None
    n = F.lit(None).cast("boolean")
    assert one(spark, labels.recommendable(F.lit(True), n)) is None
    assert one(spark, labels.recommendable(F.lit(False), n)) is False
    assert one(spark, labels.recommendable(F.lit(True), F.lit(True))) is True


def test_sequential_dedup(spark):
    df = frame(spark, "o long, id string, doi string, title string", (1, "a", "d1", "t1"), (2, "b", "d1", "t2"), (3, "c", None, "t2"), (4, "a", "d9", "t9"), (5, "e", "d9", None), (6, "f", None, "t2"))
    got = by(labels.sequential_dedup(df, "o", ["id", "doi", "title"]), "o", "dropped_by")
    # row 2 falls to row 1 and doesn't reserve its title; row 4 falls and doesn't reserve d9
    assert got == {1: None, 2: "doi", 3: None, 4: "id", 5: None, 6: "title"}


def test_first_bucket(spark):
    df = spark.range(10)
    got = labels.first_bucket(df, "id", [("even", F.col("id") % 2 == 0, F.desc("id"), 2), ("any", F.lit(True), F.asc("id"), 3)])
    assert sorted((r["bucket"], r["id"]) for r in got.collect()) == [("any", 0), ("any", 1), ("any", 2), ("even", 6), ("even", 8)]


def test_embed_missing(spark):
    got = labels.embed_missing(frame(spark, "k long, t string", (1, "a"), (2, None), (3, "ccc")), frame(spark, "k long", (1,)), lambda ts: [[float(len(t))] for t in ts], "k", "t")
    assert by(got, "k", "vector") == {2: [0.0], 3: [3.0]}


# Stored tables


def test_upserts(spark):
    stored = frame(spark, "k long, v string, home string, q long", (1, "a", "h1", 1), (2, "b", "h1", 1))
    changes = frame(spark, "k long, v string, home string, q long", (1, "x", "h2", 5), (1, "y", "h2", 6), (3, "z", "h2", 7))
    got = {r["k"]: (r["v"], r["home"]) for r in upsert.upsert(stored, changes, ["k"], "q", sticky=("home",)).collect()}
    assert got == {1: ("y", "h1"), 2: ("b", "h1"), 3: ("z", "h2")}
    c = upsert.upsert_coalesce(stored.drop("q"), frame(spark, "k long, v string, home string", (1, None, "h9")), ["k"])
    assert {(r["v"], r["home"]) for r in c.where("k = 1").collect()} == {("a", "h9")}
    assert upsert.insert_absent(stored, changes, ["k"]).count() == 3
    e = frame(spark, "w long, t long", (1, 1), (1, 2), (2, 1))
    assert sorted(map(tuple, upsert.rewrite_edges(e, frame(spark, "w long, t long", (1, 9)), "w", frame(spark, "w long", (1,))).collect())) == [(1, 9), (2, 1)]


def test_replace_partitions(spark, tmp_path):
    path = f"{tmp_path}/t"
    upsert.replace_partitions(frame(spark, "run string, x int", ("a", 1), ("b", 2)), path, ["run"])
    upsert.replace_partitions(frame(spark, "run string, x int", ("b", 3)), path, ["run"])
    assert {(r["run"], r["x"]) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 3)}


def test_match_in_order(spark):
    stored = frame(spark, "work_id long, id string, doi string", (1, "a", "d1"), (2, "b", "d2"))
    got = upsert.match_in_order(frame(spark, "id string, doi string", ("a", "d2"), ("z", "d2"), ("z", None)), stored, ["id", "doi"], "work_id")
    assert sorted((r["work_id"] or 0) for r in got.collect()) == [0, 1, 2]


def test_worksheet_and_guard(spark, tmp_path):
    (tmp_path / "s.csv").write_text("paper_id,relevance_label,novelty_label,bridge_like_label\nW1,good,,\n,good,,\nW2,,,\n")
    ok, rejected = files.read_worksheet(spark, f"{tmp_path}/s.csv", ["paper_id", *files.LABEL_COLUMNS])
    assert [r["paper_id"] for r in ok.collect()] == ["W1"] and rejected.count() == 1
    assert files.check_select("SELECT 1 FROM works", {"works"})
    for bad in ("DELETE FROM works", "SELECT 1 FROM secrets", "SELECT 1 FROM works; DROP TABLE works"):
        with pytest.raises(ValueError):
            files.check_select(bad, {"works"})


def page(slug, index, *works):
    return json.dumps({"source_slug": slug, "page_index": index, "next_cursor": None, "results": list(works)})


def test_streaming_ingest_upserts_once(spark, tmp_path):
    pages, table, check = tmp_path / "pages", f"{tmp_path}/table", f"{tmp_path}/check"
    pages.mkdir()
    (pages / "1.json").write_text(page("s", 1, {"id": "https://x/W1", "title": "old", "abstract_inverted_index": {"b": [1], "a": [0]}}, {"id": "https://x/W1", "title": "new", "abstract": "kept"}))
    ingest.ingest_pages(spark, str(pages), table, check).awaitTermination(120)
    (pages / "2.json").write_text(page("s", 2, {"id": "https://x/W2", "title": "two"}, {"title": "no id"}))
    ingest.ingest_pages(spark, str(pages), table, check).awaitTermination(120)
    got = {r["paper_id"]: (r["title"], r["abstract"]) for r in ingest.current_works(spark, table).collect()}
    assert got == {"W1": ("new", "kept"), "W2": ("two", "")}


def test_ten_batches_of_pages(spark, tmp_path):
    pages, table = tmp_path / "pages", f"{tmp_path}/table"
    pages.mkdir()
    for i in range(10):
        (pages / f"{i}.json").write_text(page("s", i, {"id": f"W{i}", "title": f"own {i}"}, {"id": "W99", "title": f"shared {i}"}))
        ingest.ingest_pages(spark, str(pages), table, f"{tmp_path}/check", files_per_batch=1).awaitTermination(120)
    got = {r["paper_id"]: r["title"] for r in ingest.current_works(spark, table).collect()}
    assert got == {f"W{i}": f"own {i}" for i in range(10)} | {"W99": "shared 9"}


def test_casefold_keys_and_prefixes(spark):
    assert one(spark, text.title_key(F.lit(" Die  STRASSE Straße "))) == "die strasse strasse"
    assert one(spark, text.doi_key(F.lit("https://DOI.org/10.1/Straße"))) == "10.1/strasse"
    assert one(spark, text.prefix_match(F.lit("The  QUICK fox..."), F.lit("the quick fox... and more"))) is True
    assert one(spark, text.prefix_match(F.lit("the quick cat"), F.lit("the quick fox"))) is False
    assert one(spark, text.prefix_match(F.lit(" "), F.lit("x"))) is None


def test_folds_by_label_and_work(spark):
    d = spark.createDataFrame([(f"w{i // 2}", float(i // 2 % 4 == 0), i) for i in range(80)], "work string, label double, row int")
    got = experiments.grouped_folds(d, "work", "label", 5, "s").collect()
    assert len(got) == 80 and all(len({r["fold"] for r in got if r["work"] == w}) == 1 for w in {r["work"] for r in got})
    for y in (0.0, 1.0):
        n = [len({r["work"] for r in got if r["fold"] == f and r["label"] == y}) for f in range(5)]
        assert max(n) - min(n) <= 1


def test_places_over_ranges(spark):
    d = spark.createDataFrame([(g, i * 7 % 100, i) for g in ("a", "b", None) for i in range(100)], "g string, v int, i int")
    got = ranks.numbered(d, [F.desc("v"), F.asc("i")], by=("g",)).collect()
    assert all(r["rank"] == 100 - r["v"] for r in got) and len(got) == 300


def test_normalized_works(spark, tmp_path):
    (tmp_path / "p.json").write_text(page("s", 1, {"id": "W5", "abstract_inverted_index": {"b": [1], "a": [0]}, "topics": [{"id": "t1", "display_name": "n", "score": 0.5}], "authorships": [{"author": {"id": None}}, {"author": {"id": "a2", "display_name": "A"}}], "referenced_works": ["W5", "https://x/W6"]}))
    w = files.normalized(files.read_pages(spark, f"{tmp_path}/p.json"))
    assert w.first()["abstract"] == "a b"
    assert files.work_topics(w).first()["level"] == 0
    assert files.work_authors(w).first()["author_position"] == 2
    assert [(r["citing"], r["cited"]) for r in files.citation_edges(w).collect()] == [("W5", "W6")]


def test_windowed_stream(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.coalesce(1).write.parquet(f"{tmp_path}/e")
    stream = ingest.windowed_counts(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e"))
    stream.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start().awaitTermination(120)
    assert spark.table("w").agg(F.sum("n")).first()[0] == events.count()


def test_empty_tables(spark):
    schema = T.StructType([T.StructField("work_id", T.LongType()), T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("cluster_id", T.StringType())])
    empty = spark.createDataFrame([], schema)
    assert neighbors.neighbor_mix(empty, 3).count() == 0 and neighbors.bridge_boundary(empty).count() == 0


# Reports, search, experiments


def test_search_words_phrases_and_exclusions(spark):
    from folioscope.plans import search

    p = frame(spark, "id long, title string, abstract string", (1, "Deep music tagging", "We tag music."), (2, "Music", "tagging speech"), (3, None, "music tagging of birds"), (4, "tagging", None))
    assert [r["id"] for r in search.search(p, "id", ["music", "Tagging"]).collect()] == [1, 2, 3]
    assert [r["id"] for r in search.search(p, "id", ["music"], none_of=["speech", "birds"]).collect()] == [1]
    assert {r["id"] for r in search.search(p, "id", [], phrase=["music", "tagging"]).collect()} == {1, 3}
    assert search.search(p, "id", ["absent"]).count() == 0
    marked = p.select(search.fragments(["music"], 3, 1)("abstract").alias("f")).collect()
    assert [r["f"] for r in marked] == ["We tag [[music.]]", None, "[[music]] tagging of", None] or marked[1]["f"] is None
    assert {r["term"]: r["positions"] for r in search.postings(p.where("id = 2"), "id").collect()} == {"music": [0], "tagging": [0], "speech": [1]}


def test_caller_order_needs_one_row_for_each_id(spark):
    from folioscope.plans import reports

    rows = frame(spark, "k long, v string", (1, "a"), (2, "b"), (3, "c"), (3, "d"))
    assert [r["v"] for r in reports.in_caller_order([2, 1], rows, "k").collect()] == ["b", "a"]
    for ids in ([1, 3], [9]):
        with pytest.raises(ValueError):
            reports.in_caller_order(ids, rows, "k")


def test_review_summary_without_applicable_rows(spark):
    from folioscope.plans import reports

    r = reports.review_summary(frame(spark, "relevance_label string, novelty_label string, bridge_like_label string", ("good", None, "not_applicable"), (None, "useful", "not_applicable"))).first()
    assert (r["good_only"], r["surprising_or_useful"], r["bridge_like"]) == (0.5, 0.5, None)


def test_holdout_does_not_leak(spark):
    from folioscope.operators import experiments

    rows = experiments.holdout(frame(spark, "w string, r long", ("a", 1), ("a", 2), ("b", 3)), frame(spark, "w string", ("a",)), "w")
    assert experiments.leaked(rows, "w").count() == 0
    assert sorted(r["split"] for r in rows.collect()) == ["eval", "eval", "train"]


def test_transfer_between_pools(spark):
    from folioscope.operators import experiments

    rows = frame(spark, "pool string, x double, label double", *[(p, float(i) + (i % 3), float(i > 5)) for p in "ab" for i in range(12)])
    got = {(r["trained_on"], r["tested_on"]): r["roc_auc"] for r in experiments.transfer_matrix(rows, experiments.scorer(["x"]), "pool").collect()}
    assert set(got) == {(a, b) for a in "ab" for b in "ab"} and all(v > 0.9 for v in got.values())


def test_explanations_leave_out_null_signals(spark):
    s = frame(spark, "work_id long, family string, semantic double, velocity double, growth double, bridge double, penalty double", (1, "bridge", None, 1.0, None, 0.5, 0.5))
    got = {r["signal"]: (r["role"], r["contribution"]) for r in ranking.explanations(s).collect()}
    assert got == {"semantic": ("not_computed", None), "velocity": ("used", 1.0), "growth": ("not_computed", None), "bridge": ("measured", 0.0), "penalty": ("penalty", -0.1)}


def test_trends_and_sources(spark):
    from folioscope.plans import reports

    p = frame(spark, "g string, x int, y double", ("up", 1, 1.0), ("up", 2, 2.0), ("flat", 1, 1.0), ("flat", 2, 1.0), ("mix", 1, 1.0), ("mix", 2, 0.0), ("mix", 3, 2.0), ("one", 1, 1.0))
    assert by(reports.response_trend(p, "x", "y", "g"), "g", "trend") == {"up": "rising", "flat": "flat", "mix": "mixed", "one": "too_few"}
    known = frame(spark, "source_id string, display_name string, aliases array<string>", ("S1", "Journal of  Sound", ["JoS"]), ("S2", "Other", None))
    assert by(files.source_ids(frame(spark, "name string", (" jos ",), ("journal of sound",), ("none",)), known), "name", "source_id") == {" jos ": "S1", "journal of sound": "S1", "none": None}


# Runs and curation


def test_runs_and_their_log(spark, tmp_path, sf_dir):
    from folioscope.plans import runs
    from folioscope.sources.corpus import Corpus

    store, c = runs.RunStore(spark, f"{tmp_path}/runs"), Corpus(spark, sf_dir)
    counts = runs.ranking_run(store, c, "r1", "v1", clustered=True, semantic=True, bridge_weight=0.1)
    assert counts["emerging"] == counts["bridge"] > counts["undercited"] and store.newest("scores") == "r1"
    with pytest.raises(ZeroDivisionError):
        store.execute("r2", "scores", "v1", {}, lambda: 1 / 0)
    states = {r["run_id"]: (r["status"], r["error"]) for r in store.runs().collect()}
    assert states["r1"][0] == "succeeded" and states["r2"] == ("failed", "division by zero")
    runs.ranking_run(store, c, "r3", "v2")
    assert store.newest("scores") == "r3" and store.newest("scores", "v1") == "r1" and store.newest("clusters") is None
    head = runs.served(store, "bridge", 5, "v1")
    assert [r["rank"] for r in head.collect()] == [1, 2, 3, 4, 5]
    assert runs.clustering_run(store, c.vectors, "k1", "v1", 3)["rows"] == c.vectors.count()
    with pytest.raises(LookupError):
        runs.served(store, "bridge", 5, "none")


def test_music_buckets(spark):
    blob = F.lit("a study of chord and harmony in music tagging")
    assert one(spark, policy.bucket_allows("symbolic_music_and_harmony", blob)) is True
    assert one(spark, policy.bucket_allows("music_recommender_systems", blob)) is False
    assert one(spark, policy.bucket_allows("core_mir_existing_sources", blob)) is True
    assert one(spark, policy.bucket_allows("unknown", blob)) is False
    p, b = policy.MUSIC_POLICY, next(x for x in policy.BUCKETS if x.name == "ethics_law_fairness_user_studies")
    none = F.lit(None).cast("string")
    reason = lambda t: one(spark, policy.plan_candidate(p, policy.NOISE_RULES, b, F.lit(t), none))["reason"]
    assert reason("knn of images") == "noise_generic_database_without_music_hook"
    assert reason("whale song") == "noise_animal_or_non_music_biology"
    assert reason("music tagging fairness") == "strong_topic_and_bucket_allow"
    assert reason("music and bias") == "defer_bucket_requires_strong_topic_signal"
    assert reason("bees") == "no_strong_topic_or_bucket_allow_signal"


@pytest.mark.parametrize(("name", "match"), [("Proceedings of the 24th International Society for Music Information Retrieval Conference", True), ("Transactions of the ISMIR", False), ("ISMIR 2020", True), ("Music Information Retrieval", False), (None, False)])
def test_conference_names(spark, name, match):
    from folioscope.operators import curation

    assert one(spark, curation.conference_name(F.lit(name).cast("string"))) is match


def test_venue_and_audit_rows(spark):
    from folioscope.operators import curation

    d = frame(spark, "id long, locations array<struct<source_id string, name string, raw_name string>>", (1, [("S9", "x", None)]), (2, [("S1", None, "ISMIR 2019")]), (3, []), (4, None))
    got = by(d.select("id", curation.venue_match(F.col("locations"), "S9", curation.conference_name).alias("m")), "id", "m")
    assert got == {1: "source_id", 2: "location_name", 3: None, 4: None}
    rows = frame(spark, "row_id string, split string, ranking_run_id string, n long", ("a", "audit_only", "r", 2), ("a", "audit_only", "r", 1), (None, "audit_only", "r", 3), (None, "audit_only", "r", 4), ("b", "train", "r", 5))
    kept, dropped = curation.audit_rows(rows, "r", "row_id", "n")
    assert sorted(r["n"] for r in kept.collect()) == [1, 3, 4] and dropped.first()["dropped"] == 1
    fixed = curation.repaired(frame(spark, "k long, t string", (1, "a  b"), (2, "ok"), (3, None)), ["t"])
    assert tuple(curation.repair_counts(fixed).first()) == (3, 1)


def test_registered_descent_takes_all_steps(spark, sf_dir):
    """Against plain descent of 6,000 steps over every row, without grouping."""
    from folioscope.plans import queries
    from folioscope.sources.corpus import Corpus

    c = Corpus(spark, sf_dir)
    rows = labels.stratified_folds(c.labels.select("doc_id", "good", "n_chars"), "good", "doc_id", 5).toPandas()
    got = {r["test"]: (r["weights"], r["bias"]) for r in queries.queries()["logistic_gd"](spark, sf_dir).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4]
    for test, (weights, bias) in got.items():
        part = rows[rows["fold"] != test]
        x, y, w, b = part["n_chars"].to_numpy(float) / 1000, part["good"].to_numpy(float), 0.0, 0.0
        for _ in range(6000):
            error = 1 / (1 + np.exp(-np.clip(x * w + b, -30, 30))) - y
            w, b = w - 0.15 * ((x * error).mean() + 1e-3 * w), b - 0.15 * error.mean()
        assert abs(weights[0] - w) < 2e-4 and abs(bias - b) < 2e-4


def test_only_the_beginning_of_a_text_is_folded(spark, monkeypatch):
    from folioscope.functions import text

    df = frame(spark, "a string, b string", ("  STRASSE  ß" + " Ω" * 400, "strasse ss" + "\t ω" * 400), ("x", "xy"), (None, "a"), ("ß" * 300, "s" * 700))
    got = df.select(text.title_key(F.col("a")).alias("k"), text.prefix_match(F.col("b"), F.col("a")).alias("same")).collect()
    assert got[0]["k"] == ("strasse ss" + " ω" * 400)[:280] and got[3]["k"] == "s" * 280
    assert [r["same"] for r in got] == [True, False, None, True]
    monkeypatch.setattr(text, "casefolded", F.pandas_udf(lambda s: s.str.len().astype(str), "string"))
    assert max(int(r[0]) for r in df.select(text.title_key(F.col("a"))).collect()) == 280


def test_rewrites_deal_edges_by_rows(spark, monkeypatch):
    from folioscope.sources import upsert

    monkeypatch.setattr(upsert, "TASK_ROWS", 50)
    edges = spark.range(1000).selectExpr("id % 100 as citing", "id as cited")
    got = upsert.rewrite_edges(edges, edges.where("cited < 200").selectExpr("citing", "-cited as cited"), "citing", edges.where("citing < 10").select("citing"))
    assert got.rdd.getNumPartitions() >= 20
    assert sorted((r["citing"], r["cited"]) for r in got.collect()) == sorted([(i % 100, i) for i in range(1000) if i % 100 >= 10] + [(i % 100, -i) for i in range(200) if i % 100 < 10])


def test_fits_read_stored_rows_in_few_tasks(spark):
    rows = spark.range(300).selectExpr("id", "cast(id % 2 as double) as label", "cast(id % 7 as double) as x", "cast(id % 3 as int) as fold").repartition(50, "id")
    got = experiments.out_of_fold(rows, experiments.scorer(["x"]), 3)
    assert got.count() == 300 and got.rdd.getNumPartitions() < 50


def test_family_ranks_carry_columns(spark):
    scores = frame(spark, "work_id long, family string, final_score double", (1, "bridge", 0.5), (2, "bridge", 0.7))
    works = frame(spark, "work_id long, core boolean", (1, True), (2, None))
    got = ranking.family_ranks(scores, works, ("final_score",), ("core",)).where("family in ('bridge', 'emerging')")
    assert sorted((r["work_id"], r["family"], r["rank"], r["final_score"], r["core"]) for r in got.collect()) == [(1, "bridge", 2, 0.5, True), (1, "emerging", None, None, True), (2, "bridge", 1, 0.7, None), (2, "emerging", None, None, None)]
