"""License scan, language id, quality, toxicity and repetition: rows judged one by one."""

import collections
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from helpers import CASES, docs, lower, plain, rows, spaced, table

from folioscope.llm import language_id, license_scan, quality, queries, repetition, toxicity, words


def texts_of(sf_dir):
    return pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pydict()


# Words


def test_words_and_hashes_are_those_of_the_pattern():
    texts = ["", "Ab, cd-é1  x", None, "x", "Straße über", "\x7f", "a" * 3000, "tail "]
    for kind, rule in ((words.PLAIN, plain), (words.SPACED, spaced)):
        got = []
        for lo, hi, data, offsets in words.blocks(pa.array(texts), limit=16):
            low = words.LOWER[data] if kind is words.PLAIN else data
            w = words.Words(low, offsets, kind)
            h = w.hashes(low)
            for d in range(hi - lo):
                a, b = w.first[d], w.first[d + 1]
                got.append([low[s:e].tobytes().decode() for s, e in zip(w.start[a:b], w.end[a:b], strict=True)])
                assert h[a:b].tolist() == [words.word_hash(x.encode()) for x in got[-1]]
        assert got == [rule(t) for t in texts]


def test_hash_is_no_linear_function_of_the_bytes():
    """A Thue-Morse word and its complement have equal polynomial hashes modulo a power of two."""
    a = bytes(97 + bin(i).count("1") % 2 for i in range(1024))
    b = bytes(97 + 98 - x for x in a)
    for n in (1024, 256, 64):
        assert words.word_hash(a[:n]) != words.word_hash(b[:n])
    rng = np.random.default_rng(1)
    some = {bytes(rng.integers(97, 99, int(n), dtype=np.uint8)) for n in rng.integers(1, 40, 5000)}
    assert len({words.word_hash(x) for x in some}) == len(some)


def test_same_words():
    data = np.frombuffer(b"abcdefghijk abcdefghijk abcdefghijz abc", np.uint8)
    got = words.same_words(data, np.array([0, 0, 0, 0]), np.array([12, 24, 0, 36]), np.array([11, 11, 11, 3]))
    assert got.tolist() == [True, False, True, True]


# License scan


def test_whole_license_texts_from_a_folder(spark, tmp_path):
    (tmp_path / "own.txt").write_text("own-whole\nThis work may be used by anyone [[ at all ]] for {{use:3}} purposes only")
    templates = license_scan.read_templates(spark, str(tmp_path))
    d = docs(spark, "This work may be used by anyone, for good purposes only.", "This work may be used by anyone for one two three four purposes only")
    assert [r[0] for r in rows(license_scan.scan_licenses(d, templates), "labels")] == ["", "own-whole"]


def test_whole_texts_accept_no_change_of_wording(spark):
    for label, wording in license_scan.TEMPLATES:
        if label == "bsd-3-whole":
            text = wording.replace("[[", "").replace("]]", "")
            text = __import__("re").sub(r"\{\{\w+:\d+\}\}", "THE OWNERS", text)
    good, bad = rows(license_scan.scan_licenses(docs(spark, text, text.replace("PROCUREMENT", "PURCHASE"))), "doc_id", "labels")
    assert "bsd-3-whole" in good[1].split(",") and "bsd-3-whole" not in bad[1].split(",") and "bsd-text" in bad[1].split(",")


def test_template_regions():
    a = license_scan.compile_template("t", "foo bar [[ baz {{n:2}} ]] end")

    def accepts(s):
        return a.accepts([words.word_hash(w.encode()) for w in s.split()], 0)

    assert [accepts(s) for s in ("foo bar end", "foo bar baz end x", "foo bar baz a b end", "foo bar baz a b c end", "foo bar", "foo bar x end")] == [3, 4, 6, 0, 0, 0]
    for bad in ("[[ a ]] b", "a b [[ c", "a b ]]", "a"):
        with pytest.raises(ValueError):
            license_scan.compile_template("t", bad)


def test_every_template_accepts_its_own_wording():
    import re

    for label, wording in license_scan.TEMPLATES:
        whole = re.sub(r"\[\[|\]\]", " ", re.sub(r"\{\{\w+:\d+\}\}", " filler ", wording))
        short = re.sub(r"\{\{\w+:\d+\}\}", " ", wording)
        while "[[" in short:
            short = re.sub(r"\[\[[^\[\]]*\]\]", " ", short)
        scanner = license_scan.Scanner()
        for text in (whole, short):
            data = np.frombuffer(f"Intro. {text} and so on".encode(), np.uint8)
            assert label in scanner.scan(data, np.array([0, len(data)]))[0][5].split(",")


def brute_base(text):
    w, found, names = plain(text), [], set()
    for phrase, label in license_scan.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        found += at
        names |= {label} if at else set()
    return len(w), len(found), min(found, default=None), max(found, default=None), ",".join(sorted(names))


def test_license_base_columns_equal_brute_force(spark, sf_dir):
    t = texts_of(sf_dir)
    got = {r["doc_id"]: r for r in queries.op1_license_scan(spark, sf_dir).collect()}
    for doc_id, text in zip(t["doc_id"], t["text"], strict=True):
        r = got[doc_id]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_base(text)
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_license_cases(spark):
    d = license_scan.scan_licenses(table(spark, CASES))
    assert d.count() == len(CASES)
    texts = ["Under the MIT\nLicense, or the Apache  LICENSE. MIT license!", "mit licenses", "Licensed under the Apache License, Version 3.0"]
    got = rows(license_scan.scan_licenses(docs(spark, *texts)), "doc_id", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert got == [(0, 3, 2, 8, "apache,mit", "apache,mit", 0.5), (1, 0, None, None, "", "", 0.0), (2, 1, 3, 3, "apache", "apache", 0.5)]
    assert license_scan.scan_licenses(docs(spark)).count() == 0


# Repetition


def brute_repetition(text):
    w = spaced(text)
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    inside = {p for v in at.values() if len(v) > 1 for i in v for p in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if spaced(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


def brute_longest(w):
    best = [0] * len(w)
    for i in range(len(w)):
        for j in range(len(w)):
            k = 0
            while i != j and max(i, j) + k < len(w) and w[i + k] == w[j + k]:
                k += 1
            best[i] = max(best[i], k)
    return [b if b >= 5 else 0 for b in best]


def test_repetition_equals_brute_force(spark, sf_dir):
    t = texts_of(sf_dir)
    got = {r["doc_id"]: r for r in queries.op10_repetition_rules(spark, sf_dir).collect()}
    for doc_id, text in zip(t["doc_id"], t["text"], strict=True):
        r, want = got[doc_id], brute_repetition(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_longest_repeats_equal_brute_force():
    rng = random.Random(3)
    for _ in range(40):
        texts = [[rng.randrange(rng.choice((2, 3, 40))) for _ in range(rng.randrange(0, 60))] for _ in range(4)]
        flat = np.array([x for t in texts for x in t], np.uint64)
        first = np.cumsum([0] + [len(t) for t in texts])
        got = repetition.longest_repeats(words.mix(flat + np.uint64(9)), first)
        assert got.tolist() == [b for t in texts for b in brute_longest(t)]


def test_repetition_cases(spark):
    d = {r["doc_id"]: r for r in repetition.repetition_rules(table(spark, CASES)).collect()}
    assert d[2]["n_words"] == d[3]["n_words"] == d[4]["n_words"] == 0 and d[2]["base_failed"] and not d[2]["kept"]
    assert d[1]["kept"] and d[7]["kept"] and d[7]["n_words"] == 60_000
    again = " ".join(f"a{i}" for i in range(100))
    long_copy = f"{again} {' '.join(f'b{i}' for i in range(1000))} {again}"
    r = repetition.repetition_rules(docs(spark, long_copy)).first()
    assert r["longest_repeat"] == 100 and r["n_repeat_words"] == 200
    assert repetition.repetition_rules(docs(spark)).count() == 0


def test_one_long_passage_twice_fails_a_long_text(spark):
    def text(repeat):
        again = " ".join(f"a{i}" for i in range(repeat))
        return f"{again} {' '.join(f'b{i}' for i in range(10_000 - 2 * repeat))} {again}"

    d = {r["doc_id"]: r for r in repetition.repetition_rules(docs(spark, text(60), text(61), text(300), text(900))).collect()}
    assert not any(r["base_failed"] for r in d.values()) and [d[i]["longest_repeat"] for i in range(4)] == [60, 61, 300, 900]
    assert [d[i]["kept"] for i in range(4)] == [True, False, False, False]


# Language


def test_language_held_out_accuracy(spark):
    from pathlib import Path

    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op4_language_id(spark, sf).collect()
    assert len(got) == len(truth) and Path(sf).exists()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_numbers_and_fractions_are_no_letters(spark):
    model = language_id.train(["the cat and the dog"] * 5 + ["der hund und die katze"] * 5, ["en"] * 5 + ["de"] * 5)
    d = docs(spark, "½ ②", "²", "12 -- 3", "ª", "é", "猫")
    assert [r[1] == "und" for r in rows(language_id.identify_languages(d, model), "doc_id", "lang_pred")] == [True, True, True, False, False, False]


def test_language_scores_equal_brute_force(spark):
    """Counts by a dictionary of n-grams, TF-IDF and softmax one text at a time."""
    import math

    texts = ["The cat sat on the mat.", "Der Hund, die Katze & ein Fuß", "le chat é", "x"]
    model = language_id.train(["the cat and the dog"] * 6 + ["der hund und die katze"] * 6 + ["le chat et le chien"] * 6, ["en"] * 6 + ["de"] * 6 + ["fr"] * 6)

    def bucket(gram):
        factor, c = [int(x) for x in language_id._FACTOR], len(gram) * 0x9E3779B1 & 0xFFFFFFFF
        for k, point in enumerate(gram):
            c = (c ^ point) * factor[k] & 0xFFFFFFFF
            c ^= c >> 15
        return (c * 2654435769 & 0xFFFFFFFF) >> 32 - language_id.BUCKET_BITS

    def one(text):
        points = [ord(c.lower() if "A" <= c <= "Z" else c) for c in text]
        points = [32 if p < 97 or 122 < p < 128 else p for p in points]
        count = collections.Counter(bucket(points[i : i + n]) for n in (1, 2, 3) for i in range(len(points) - n + 1))
        x = {b: math.log1p(n) * model.idf[b] for b, n in count.items()}
        size = math.sqrt(sum(v * v for v in x.values()))
        z = [sum(v / size * float(model.weights[b][k]) for b, v in x.items()) + model.bias[k] for k in range(3)]
        e = [math.exp(v / model.temperature) for v in z]
        return model.languages[int(np.argmax(e))], max(e) / sum(e)

    got = rows(language_id.identify_languages(docs(spark, *texts), model), "doc_id", "lang_pred", "score")
    for (_, name, score), text in zip(got, texts, strict=True):
        assert (name, pytest.approx(score, abs=1e-4)) == one(text)


def test_rows_without_an_id_are_not_held_out(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    t = table(spark, CASES)
    for got in (language_id.language_query(t), quality.quality_query(t, none), toxicity.toxicity_query(t, none)):
        assert got.where("held_out is null").count() == 0 and not got.where("doc_id is null").first()["held_out"]


def test_language_cases(spark):
    t = table(spark, CASES)
    model = language_id.train(["the cat and the dog"] * 5 + ["der hund und die katze"] * 5, ["en"] * 5 + ["de"] * 5)
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify_languages(t, model).collect()}
    assert {got[i] for i in (2, 3, 4, 8)} == {"und"} and got[1] == "en"
    assert {r["lang_pred"] for r in language_id.identify_languages(t, None).collect()} == {"und"}
    assert language_id.fit_language_model(table(spark, [])) is None
    assert language_id.language_query(t).count() == len(CASES)
    assert (model.weights == 0).mean() > 0.5


# Quality and toxicity


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    for v in np.unique(s):
        at = np.flatnonzero(np.asarray(s) == v)
        rank[at] = (np.searchsorted(np.asarray(s)[order], v, "left") + np.searchsorted(np.asarray(s)[order], v, "right") + 1) / 2
    y = np.asarray(y)
    p, n = (y == 1).sum(), (y == 0).sum()
    return (rank[y == 1].sum() - p * (p + 1) / 2) / (p * n)


@pytest.mark.parametrize(("name", "label", "least", "threshold"), [("op6_quality", "quality", 0.95, 0.5), ("op2_toxicity", "toxic", 0.75, 0.7)])
def test_classifiers_on_held_out_rows(spark, name, label, least, threshold):
    sf = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = getattr(queries, name)(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= threshold) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert auc([truth[r["doc_id"]] for r in held], [r["score"] for r in held]) > least


def test_toxicity_scores_equal_brute_force():
    """Windows, cells and attention one number at a time."""
    import math

    rng = np.random.default_rng(4)
    vocabulary = np.sort(np.array([words.word_hash(w) for w in (b"you", b"idiot", b"the")], np.uint64))
    net = toxicity.new_network(vocabulary, 3)
    net.p["words"][:-1] = rng.standard_normal((3, toxicity.DIM)) * 0.5
    net.slope, net.offset, net.base_rate = 1.3, -0.2, 0.07
    texts = ["You IDIOT the end", "", "a " * 45 + "idiot", "one", "The the you " * 30]
    h = toxicity.HIDDEN
    sig = lambda v: 1 / (1 + math.exp(-v))

    def vector(w):
        b = w.encode()
        total = np.zeros(toxicity.DIM)
        for i, c in enumerate(b):
            left, right = (b[i - 1] if i else 0), (b[i + 1] if i + 1 < len(b) else 0)
            code = (left * 65599 + c) * 40503 + right * 2654435761 & 0xFFFFFFFF
            code ^= code >> 15
            total += net.p["chars"][(code * 2246822519 & 0xFFFFFFFF) >> 19]
        known = words.word_hash(b)
        own = net.p["words"][vocabulary.tolist().index(known)] if known in vocabulary.tolist() else 0
        return own + total / len(b)

    def window(ws):
        states = []
        for d in (0, 1):
            at, out = np.zeros(h), []
            for w in ws if d == 0 else ws[::-1]:
                g = (vector(w) @ net.p["w_in"] + net.p["b_in"])[d * 3 * h : (d + 1) * 3 * h]
                u = at @ net.p["u"][d]
                z, r = [sig(v) for v in (g + u)[:h]], np.array([sig(v) for v in (g + u)[h : 2 * h]])
                c = np.tanh(g[2 * h :] + r * u[2 * h :])
                at = c + np.array(z) * (at - c)
                out.append(at)
            states.append(out if d == 0 else out[::-1])
        look = [np.tanh(sum(states[d][t] @ net.p["w_att"][d] for d in (0, 1))) @ net.p["v_att"] for t in range(len(ws))]
        weight = np.exp(look) / np.exp(look).sum()
        return sum(weight[t] * sum(states[d][t] @ net.p["w_out"][d] for d in (0, 1)) for t in range(len(ws))) + net.p["b_out"][0]

    def text(t):
        ws = plain(t)
        if not ws:
            return net.base_rate
        starts = range(0, max(1, len(ws) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE)
        best = max(window(ws[i : i + toxicity.WINDOW]) for i in starts)
        return sig(net.slope * best + net.offset)

    raw = [t.encode() for t in texts]
    got = toxicity.text_scores(net, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw]))
    assert got == pytest.approx([text(t) for t in texts], abs=1e-4)


def test_toxicity_cut_on_planted_texts(spark):
    """Texts with and without a word of abuse, learned from two folds: the cut of 0.7 tells the third apart."""
    rng = random.Random(2)
    vocabulary = [f"word{i}" for i in range(300)]

    def text(toxic):
        t = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 120))]
        if toxic:
            for _ in range(3):
                t[rng.randrange(len(t))] = rng.choice(["idiotic", "scumbag", "moron"])
        return " ".join(t)

    marks = [int(rng.random() < 0.2) for _ in range(900)]
    d = spark.createDataFrame([(i, text(y)) for i, y in enumerate(marks)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, y in enumerate(marks)], "doc_id long, toxic int")
    held = [r for r in toxicity.toxicity_query(d, labels).collect() if r["held_out"]]
    assert np.mean([r["predicted"] for r in held if marks[r["doc_id"]]]) > 0.9
    assert np.mean([r["predicted"] for r in held if not marks[r["doc_id"]]]) < 0.03


def test_classifier_cases(spark):
    t, none = table(spark, CASES), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for query in (quality.quality_query, toxicity.toxicity_query):
        got = query(t, none).collect()
        assert len(got) == len(CASES) and all(0 <= r["score"] <= 1 for r in got)
        assert query(docs(spark), none).count() == 0
    some = spark.createDataFrame([(1, 1, 0), (6, 1, 1), (7, 0, 0), (9, 1, 0), (None, 1, 1), (10, None, None)], "doc_id long, quality int, toxic int")
    for query in (quality.quality_query, toxicity.toxicity_query):
        assert query(t, some).count() == len(CASES)


def test_windows_overlap_and_reach_the_end():
    doc, start, size = toxicity.windows_of(np.array([0, 0, 5, 5 + 32, 37 + 33]))
    assert list(zip(doc.tolist(), start.tolist(), size.tolist(), strict=True)) == [(1, 0, 5), (2, 5, 32), (3, 37, 32), (3, 53, 17)]


def test_network_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.new_network(np.array([5], np.uint64), 1)
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.standard_normal((7, toxicity.DIM))
    index = np.array([[0, 1, 2, 3], [4, 5, 6, 6]])
    mask = np.array([[True] * 4, [True, True, False, False]])

    def score(q):
        return toxicity.forward(q, toxicity.gates_of(q, x), index, mask)

    kept = toxicity.forward(p, toxicity.gates_of(p, x), index, mask, keep=True)
    grad, _ = toxicity.backward(p, index, mask, kept, np.array([1.0, 1.0]))
    for name in ("u", "w_att", "v_att", "w_out"):
        at = tuple(0 for _ in p[name].shape)
        up, down = {**p, name: p[name].copy()}, {**p, name: p[name].copy()}
        up[name][at] += 1e-2
        down[name][at] -= 1e-2
        assert (score(up).sum() - score(down).sum()) / 2e-2 == pytest.approx(grad[name][at], rel=0.02, abs=2e-3)


def test_quality_risk_learns_from_positives_and_mixture_only():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 1, (800, 4)), rng.normal(-1, 1, (800, 4))
    m = quality.train(good[:400], np.concatenate([good[400:], bad[:400]]), 0.5)
    assert (m.scores(good) > 0.5).mean() > 0.9 and (m.scores(bad) < 0.5).mean() > 0.9


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.85])
def test_prior_comes_from_the_mixture(prior):
    rng = np.random.default_rng(1)
    n = 4000
    good, mixed = rng.normal(2, 1, (2000, 4)), np.concatenate([rng.normal(2, 1, (int(n * prior), 4)), rng.normal(-2, 1, (n - int(n * prior), 4))])
    m = quality.fit(good, mixed)
    assert abs(m.prior - prior) < 0.06
    assert (m.scores(rng.normal(2, 1, (500, 4))) > 0.5).mean() > 0.95 and (m.scores(rng.normal(-2, 1, (500, 4))) < 0.5).mean() > 0.95


def test_quality_where_every_document_has_a_label(spark):
    rng = random.Random(3)
    fine = lambda: " ".join(rng.choice("the river house walks over green hills and small birds sing".split()) for _ in range(60)) + "."
    junk = lambda: " ".join(rng.choice("click $$$ buy now !!! free ### win".split()) for _ in range(60))
    marks = [int(rng.random() < 0.6) for _ in range(600)]
    d = spark.createDataFrame([(i, fine() if y else junk()) for i, y in enumerate(marks)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, y in enumerate(marks)], "doc_id long, quality int")
    held = [r for r in quality.quality_query(d, labels).collect() if r["held_out"]]
    assert np.mean([r["predicted"] == marks[r["doc_id"]] for r in held]) > 0.95


def test_lower_is_ascii_only():
    assert lower("ÄB") == "Äb"


# Samples for fitting


def test_samples_are_bounded_in_rows(spark):
    """One id with 200,000 texts, and repeated labels, leave no more rows than the bound says."""
    from pyspark.sql import functions as F

    from folioscope.llm.common import bounded_sample, one_text_each

    hot = spark.range(200_000, numPartitions=8).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    got = bounded_sample(hot, ("doc_id", "text"), 1000, 4)
    assert 800 < got.count() < 1200
    same = spark.range(50_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one text").alias("text"))
    assert bounded_sample(same, ("doc_id", "text"), 1000, 4).count() <= 1
    known = spark.createDataFrame([(7, 1)] * 500 + [(7, 0)] * 500, "doc_id long, toxic int").distinct()
    assert one_text_each(hot.join(bounded_sample(known, ("doc_id", "toxic"), 1500, 21), "doc_id"), "doc_id", "toxic").count() == 2


def test_fitting_with_one_hot_id(spark):
    """Fits get one text of an id that repeats, so a hot id can't fill the sample; repeated labels count once."""
    good, bad = "a calm and useful text about maps number {}", "you stupid idiot number {}"
    texts = [(i, (bad if i % 4 == 0 else good).format(i)) for i in range(400)] + [(0, bad.format(f"x{i}")) for i in range(3000)]
    d = table(spark, [(i, t, "en", "s", 0) for i, t in texts])
    labels = spark.createDataFrame([(i, int(i % 4 != 0), int(i % 4 == 0)) for i in range(400)] * 2, "doc_id long, quality int, toxic int")
    assert toxicity.fit_toxicity(d, labels, fold=None, sample=(50, 100)) is not None
    assert quality.fit_quality(d, labels, fold=None, sample=(100, 200)) is not None
    assert language_id.fit_language_model(d, fold=None, sample_rows=200) is not None


def test_training_texts_are_read_in_little_memory():
    """The driver holds the words of the sample about once, and each text's words stay its own."""
    rng = random.Random(4)
    raw = [" ".join(f"w{rng.randrange(9000)}é" for _ in range(rng.randrange(0, 600))).encode() for _ in range(300)]
    net = toxicity.new_network(np.zeros(0, np.uint64), 1)
    tracemalloc.start()
    b = toxicity.read_blocks(raw, net)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    one = [toxicity.read_block(np.frombuffer(r, np.uint8), np.array([0, len(r)]), net) for r in raw]
    assert np.diff(b.first).tolist() == [len(x.rows) for x in one]
    assert np.array_equal(b.buckets, np.concatenate([x.buckets for x in one])) and np.array_equal(np.diff(b.bytes_at), np.concatenate([np.diff(x.bytes_at) for x in one]))
    assert b.buckets.itemsize == 2 and peak < 20 * sum(len(r) for r in raw)
