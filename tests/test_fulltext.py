"""Query strings over the index, against a search that looks at every word of every text."""

import random
import re

from folioscope.plans import fulltext

VOCABULARY = ["graph", "graphs", "running", "runs", "hopped", "hoping", "studies", "study", "agreed", "the", "of", "Straße", "net"]
STEMS = {"graphs": "graph", "running": "run", "runs": "run", "hopped": "hop", "hoping": "hope", "studies": "studi", "study": "studi", "agreed": "agree"}
QUERIES = ["graph or studi study", "\"running of graphs\"", "-graph", "graph \"study hoping\" or net -hope", "the of"]


def stem(word):
    return STEMS.get(word, word)


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(papers, asked):
    """key -> rank, from all pairs of a begin and an end."""
    clauses = fulltext.parse(asked)
    out = {}
    for key, title, abstract in papers:
        t = tokens(title)
        ws = t + tokens(abstract)
        at = {i: stem(w) for i, w in enumerate(ws) if w not in fulltext.STOP_WORDS}
        places = lambda unit: [(b, b + unit.words[-1][0]) for b in range(len(ws)) if all(at.get(b + o) == stem(w) for o, w in unit.words)]
        found = [[places(u) for u in units] for units in clauses]
        met = [c for c, units in enumerate(clauses) if all(bool(f) != u.excluded for u, f in zip(units, found[c], strict=True))]
        if not met:
            continue
        runs, entries = set(), set()
        for c in met:
            wanted = [f for u, f in zip(clauses[c], found[c], strict=True) if not u.excluded]
            entries |= {x for f in wanted for be in f for x in be}
            if wanted:
                ends = {e for f in wanted for _, e in f}
                for b in {b for f in wanted for b, _ in f}:
                    good = [e for e in ends if all(any(b <= x and y <= e for x, y in f) for f in wanted)]
                    if good:
                        runs.add((b, min(good)))
        runs = {r for r in runs if not any(o != r and o[0] >= r[0] and o[1] <= r[1] for o in runs)}
        x = 0.0
        for b, e in runs:
            inside = [i for i in entries if b <= i <= e]
            x += len(inside) / sum(1.0 if i < len(t) else 2.5 for i in inside) / (1 + e - b + 1 - len(inside))
        out[key] = round(x / (x + 1), 6)
    return out


def papers():
    rng = random.Random(12)
    some = [(i, " ".join(rng.choices(VOCABULARY, k=rng.randint(0, 5))), " ".join(rng.choices(VOCABULARY, k=rng.randint(0, 30)))) for i in range(120)]
    return [*some, (200, None, None), (201, "", "graph"), (202, "Graph; runs!", None), (203, "net " * 40 + "graph", "running " * 30)]


def test_search_equals_brute_force(spark):
    rows = papers()
    index = fulltext.build_index(spark.createDataFrame(rows, "id long, title string, abstract string"), "id")
    for asked in QUERIES:
        got = {r["id"]: r["rank"] for r in fulltext.ranked(index, asked)[0].collect()}
        want = brute(rows, asked)
        assert got.keys() == want.keys(), asked
        assert all(abs(got[k] - want[k]) < 2e-6 for k in want), asked


def test_postings_are_filtered_in_the_scan(spark):
    index = fulltext.build_index(spark.createDataFrame(papers(), "id long, title string, abstract string"), "id")
    plan = fulltext.occurrences(index, fulltext._units(spark, fulltext.parse("graph -net")))._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term, [graph,net])" in plan or "PushedFilters: [IsNotNull(term), In(term, [graph,net])" in plan


def test_parse():
    unit = lambda *w, excluded=False: fulltext.Unit(tuple(w), excluded)
    assert fulltext.parse('Graph -"of nets" or x "a b c"') == [[unit((0, "graph")), unit((0, "nets"), excluded=True)], [unit((0, "x")), unit((0, "b"), (1, "c"))]]
    assert fulltext.parse("") == fulltext.parse("the or of") == []


def test_headlines_show_covers(spark):
    rows = papers()
    given = spark.createDataFrame(rows, "id long, title string, abstract string")
    index = fulltext.build_index(given, "id")
    words_of = {k: re.findall(r"[^\W_]+", f"{t or ''} {a or ''}") for k, t, a in rows}
    got = fulltext.headlines(index, given, '"graph run" or net hope', limit=200, most_words=8).collect()
    assert {r["id"] for r in got} == set(brute(rows, '"graph run" or net hope'))
    for r in got:
        pieces = r["headline"].split(" ... ")
        assert 1 <= len(pieces) <= 2
        for piece in pieces:
            shown = piece.split(" ")
            plain = [w.strip("[]") for w in shown]
            assert len(shown) == min(8, len(words_of[r["id"]])) and any(w.startswith("[[") for w in shown)
            text = words_of[r["id"]]
            assert any(text[i : i + len(plain)] == plain for i in range(len(text)))


def test_index_groups_where_a_text_is_read(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = [*papers(), (200, "runs net", "graphs"), (204, "Seeing fed bleed y sky ies flies", "sized hopping falling filing trying")]
    words = sorted({w for r in rows for w in tokens(r[1]) + tokens(r[2])} | {"s", "ss", "ed", "ing", "eed", "by", "yes", "x9ing", "controlling", "created"})
    want = fulltext.stemmed(spark.createDataFrame([(w,) for w in words], "w string"), "w", "term").collect()
    assert {r["w"]: fulltext.stem(r["w"]) for r in want} == {r["w"]: r["term"] for r in want}
    df = spark.createDataFrame(rows, "paper_id long, title string, abstract string")
    monkeypatch.setattr(fulltext, "BATCH_WORDS", 40)
    kept = []
    monkeypatch.setattr(fulltext, "stored", lambda df, name: (kept.append((name, df)), df)[1])
    index = fulltext.build_index(df, "paper_id")
    assert "Exchange" not in kept[0][1]._jdf.queryExecution().executedPlan().toString()  # no word is shuffled before it is grouped
    got = sorted((r["key"], r["term"], r["at"], r["title"]) for r in index.postings.select("term", F.inline("hits")).collect())
    each = [(k, fulltext.stem(w), i, i < len(tokens(t))) for k, t, a in rows for i, w in enumerate(tokens(t) + tokens(a)) if w not in fulltext.STOP_WORDS]
    assert got == sorted(each)
