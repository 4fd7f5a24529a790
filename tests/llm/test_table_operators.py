"""Near duplicates, sharding, token files, decontamination, mixing and the pipeline."""

import collections
import hashlib
import random
import time
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from helpers import CASES, docs, lower, plain, rows, spaced, table
from pyspark.sql import functions as F

from folioscope.llm import common, components, decontaminate, jaccard_join, mixing, queries, sharding, token_orc

# Near duplicates


def brute_components(texts):
    """texts: list of (doc_id, text). {doc_id: (set size, component)}."""
    sets = {}
    for d, t in texts:
        w = spaced(lower(t))
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = collections.defaultdict(list)
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    shared = collections.Counter((a, b) for ds in where.values() for a in ds for b in ds if a < b)
    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def check_components(spark, texts, **options):
    d = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicate_components(d, **options).collect()}
    assert got == brute_components(texts)


def test_near_duplicates_equal_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op3_ngram_jaccard(spark, sf).collect()}
    assert got == brute_components(texts)


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"frequent": 16, "filter_bits": 1 << 8})])
def test_edited_copies_and_shared_passages(spark, seed, options):
    """Chains of edits around the threshold, and one passage in many texts."""
    rng = random.Random(seed)
    word = lambda: f"v{rng.randrange(4000)}"
    texts, passage = [], [word() for _ in range(30)]
    for _ in range(4):
        base = [word() for _ in range(rng.choice((8, 60, 150)))]
        current = base
        for _ in range(14):
            current = list(current if rng.random() < 0.5 else base)
            for _ in range(rng.randrange(0, 4)):
                current[rng.randrange(len(current))] = word()
            texts.append(" ".join(current))
            if rng.random() < 0.3:
                texts.append(" ".join(current).upper())
    texts += [" ".join([word() for _ in range(12)] + passage + [word() for _ in range(12)]) for _ in range(20)] + [" ".join(passage)] * 2
    rng.shuffle(texts)
    check_components(spark, list(enumerate(texts)), **options)


@pytest.mark.parametrize("seed", [1, 2])
def test_growing_chains_with_a_hub(spark, seed):
    """Each text is the one before with new words; links stand at 0.8 exactly, and a third text is the hub."""
    rng = random.Random(seed)
    texts = []
    for c in range(12):
        words = [f"c{c}x{i}x{rng.randrange(10**6)}" for i in range(300)]
        texts += [" ".join(words[: n + 4]) for n in (64, 80, 100, 125)]
        texts += [" ".join(words[: n + 4] + [f"o{c}x{i}" for i in range(own)]) for n, own in ((60, 15), (50, 30), (8, 92))]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicate_components(d).collect()}
    assert got == brute_components(list(enumerate(texts)))


def test_very_frequent_shingles_are_salted(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "VERY_FREQUENT", 4)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    texts = []
    for _ in range(60):
        t = list(base)
        for _ in range(rng.randrange(0, 5)):
            t[rng.randrange(60)] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    check_components(spark, list(enumerate(texts)))


def test_hubs_of_salts_are_compared_once(spark):
    """Plans that read the hubs hold no aggregate over salts, so they stay small on the driver."""
    hub = lambda c, k: (c, k, 10)
    found = [(1, 0, 5, 10, hub(3, 5)), (1, 0, 6, 10, hub(3, 5)), (2, 1, 7, 10, hub(4, 7)), (2, 2, 8, 10, hub(9, 8)), (2, 2, 9, 10, hub(9, 8))]
    hubs = jaccard_join._one_hub(spark.createDataFrame(found, jaccard_join._SHARED_DDL))
    assert {tuple(r) for r in hubs.collect()} == {(1, 5, 10, 5, 10), (1, 6, 10, 5, 10), (2, 7, 10, 8, 10), (2, 8, 10, 8, 10), (2, 9, 10, 8, 10)}
    assert "Aggregate" not in hubs._jdf.queryExecution().optimizedPlan().toString()


def _prefix(value):
    return bytearray(np.array([value], np.uint16).tobytes())


@pytest.mark.parametrize("broken", [0, 1])
def test_each_order_filters(spark, monkeypatch, broken):
    """A candidate without a common prefix shingle under one of the further orders is no candidate."""
    texts = [(i, " ".join(f"w{k}" for k in range(i, 60 + i))) for i in range(3)]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r["component_id"] for r in jaccard_join.near_duplicate_components(d).collect()} == {0}
    sets = spark.createDataFrame(
        [(k, 10, k, bytearray(8), _prefix(k if i == broken else 7), _prefix(k if i == 1 - broken else 7)) for k, i in ((1, 0), (2, 0), (3, 2), (4, 2))],
        "key long, n long, row long, sketch binary, second binary, third binary",
    )
    pairs = spark.createDataFrame([(1, 2), (3, 4)], "a long, b long")
    assert [(r["a"], r["b"]) for r in jaccard_join.in_all_orders(pairs, sets).collect()] == [(3, 4)]


def test_large_groups_meet_in_blocks(spark, monkeypatch):
    """Texts that are mostly one passage, in several components: more members than a block holds."""
    monkeypatch.setattr(jaccard_join, "X_BLOCK", 4)
    monkeypatch.setattr(jaccard_join, "Y_BLOCK", 3)
    monkeypatch.setattr(jaccard_join, "VERY_FREQUENT", 4)
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for group in range(6):
        own = [f"g{group}x{i}" for i in range(16)]
        for _ in range(7):
            t = passage + own
            t[rng.randrange(len(t))] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(t))
    rng.shuffle(texts)
    check_components(spark, list(enumerate(texts)), frequent=64)


def test_one_of_each_goes_by_row(spark):
    a, b, c, d_, e = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcde")
    rows_ = [(1, a, "k"), (2, a, "k"), (2, b, "k"), (3, c, "k"), (3, d_, "k"), (None, e, "z"), (None, e, "y"), (None, a, "k"), (None, None, "k"), (4, "", "k"), (4, "", "k"), (5, b + " more", "k")]
    d = spark.createDataFrame(rows_, "doc_id long, text string, row_mark string")
    kept = sorted(map(tuple, jaccard_join.one_of_each(d).collect()), key=repr)
    assert kept == sorted([(1, a, "k"), (2, b, "k"), (3, c, "k"), (3, d_, "k"), (None, e, "y"), (None, None, "k"), (4, "", "k"), (4, "", "k")], key=repr)


def test_near_duplicate_cases(spark):
    got = rows(jaccard_join.near_duplicate_components(table(spark, CASES)), "doc_id", "n_shingles", "component_id")
    by_id = {r[0]: r for r in got}
    assert len(got) == len(CASES)
    assert by_id[5][2] == 1 and by_id[6][2] == 1 and by_id[2] == (2, 0, 2) and by_id[4] == (4, 0, 4) and by_id[10] == (10, 1, 10)
    assert jaccard_join.near_duplicate_components(docs(spark)).count() == 0
    kept = jaccard_join.one_of_each(table(spark, CASES))
    assert kept.columns == table(spark, CASES).columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 1, 2, 3, 4, 7, 8, 9, 10]


def test_filters_lose_no_link():
    rng = np.random.default_rng(2)
    linked = 0
    for _ in range(300):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        keep = a[rng.random(len(a)) > rng.random() * 0.2]
        b = np.unique(np.concatenate([keep, rng.integers(0, 2**64, int(rng.integers(0, 1 + n // 8)), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        is_link = len(b) > 0 and 100 * both >= 80 * (len(a) + len(b) - both)
        differ = len(a) + len(b) - 2 * both
        assert jaccard_join.may_link(differ, len(a), len(b)) == is_link or not len(b)
        if is_link:
            linked += 1
            sa, sb = (np.frombuffer(jaccard_join.odd_sketch(x), np.uint8) for x in (a, b))
            assert jaccard_join.sketch_distance(sa, sb) <= differ
            pa_, pb = (jaccard_join._unpacked(jaccard_join._packed(x)) for x in (a, b))
            assert jaccard_join.shared_elements(pa_, pb) == both
            for factor in jaccard_join.ORDERS:
                assert jaccard_join.prefixes_meet(jaccard_join.order_prefix(a, factor), len(a), jaccard_join.order_prefix(b, factor), len(b))
    assert linked > 50


def test_prefix_values_are_read_back():
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 80, 5000):
        t = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        p = jaccard_join.prefix_length(len(t))
        for factor in jaccard_join.ORDERS:
            want = np.sort(t * factor)[:p] >> np.uint64(64 - jaccard_join.order_bits(len(t)))
            assert jaccard_join.prefix_values(jaccard_join.order_prefix(t, factor)).tolist() == want.astype(np.int64).tolist()
        # sets without a common shingle seldom meet
        other = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        met = sum(jaccard_join.prefixes_meet(jaccard_join.order_prefix(t, f), len(t), jaccard_join.order_prefix(other, f), len(other)) for f in jaccard_join.ORDERS)
        assert met < 2


def test_packed_prefixes_are_read_back():
    rng = np.random.default_rng(8)
    sets = [np.sort(rng.choice(60, rng.integers(1, 20), replace=False)) for _ in range(50)]
    token = np.concatenate(sets).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    owner = np.repeat(np.arange(50), [len(s) for s in sets])
    salt = np.where(token % np.uint64(7) == 0, 1 + owner % 4, 0)
    key, n, central = rng.integers(-(2**63), 2**63, 50), rng.integers(1, 10**6, 50), rng.integers(0, 64_000, 50)
    batch = jaccard_join.pack_parts(token, salt, owner, key, n, central, 5)
    assert sorted(set(batch.column(0).to_pylist())) == batch.column(0).to_pylist()
    got = [r for body in batch.column(1) for r in zip(*(x.tolist() for x in jaccard_join.unpack_part(body.as_py())), strict=True)]
    want = zip((token >> np.uint64(16)).tolist(), salt.tolist(), key[owner].tolist(), n[owner].tolist(), central[owner].tolist(), strict=True)
    assert sorted(got) == sorted(want)


def test_packed_prefixes_are_small():
    """Steps of tokens and keys, compressed: before, a row had 14 bytes and a set 14 more in each part."""
    rng = np.random.default_rng(9)
    token, owner = rng.integers(0, 2**64, 40_000, dtype=np.uint64), np.repeat(np.arange(400), 100)
    key, n, central, salt = rng.integers(-(2**63), 2**63, 400), rng.integers(300, 700, 400), np.zeros(400, np.int64), np.zeros(40_000, np.int64)
    bodies = jaccard_join.pack_parts(token, salt, owner, key, n, central, 20).column(1)
    assert sum(len(b.as_py()) for b in bodies) < 9 * len(token)
    # a part has a range of images, so parts are of like size
    assert len(bodies) == 20 and max(len(b.as_py()) for b in bodies) < 1.5 * min(len(b.as_py()) for b in bodies)


def test_sizes_that_cannot_link_part_a_shingle():
    """Each range of sizes has its own hub; a set alone in its range is gone, and two sets are marked as one pair."""
    n = np.array([1000, 110, 10, 100, 11, 111, 7, 200])
    token, key = np.array([5 << 20] * 7 + [9 << 20], np.uint64), np.arange(8) - 4
    batch = jaccard_join.pack_parts(token, np.zeros(8, np.int64), np.arange(8), key, n, np.array([9, 3, 0, 0, 0, 0, 9, 9]), 1)
    got = jaccard_join.shared_in_part(pa.Table.from_batches([batch, batch])).to_pylist()
    assert sorted((r["n"], r["key"], r["salt"], r["hub"]["n"]) for r in got) == [(10, -2, -1, 11), (11, 0, -1, 11), (100, -1, 0, 110), (110, -3, 0, 110), (111, 1, 0, 110)]
    assert len({r["token"] for r in got}) == 2


def test_very_frequent_shingles_keep_all_sizes():
    """Sets of a salt may have partners under other salts, so none is dropped and no pair is marked."""
    n, one = np.array([10, 1000, 11]), np.ones(3, np.int64)
    batch = jaccard_join.pack_parts(np.full(3, 5 << 20, np.uint64), one, np.arange(3), np.arange(3), n, one, 1)
    got = jaccard_join.shared_in_part(pa.Table.from_batches([batch])).to_pylist()
    assert sorted(r["n"] for r in got) == [10, 11, 1000] and {(r["salt"], r["hub"]["n"]) for r in got} == {(1, 1000)} and len({r["token"] for r in got}) == 1


def test_rows_without_a_partner_stay_where_they_are(spark):
    """Keys too many to broadcast: their bits leave the partners and a few others."""
    rows = spark.range(-50_000, 50_000).select(F.col("id").alias("key"), F.col("id").alias("row"))
    some = rows.where("key % 100 = 0").select("key")
    got = {r["key"] for r in jaccard_join._maybe_among(rows, some, "key").collect()}
    assert got >= set(range(-50_000, 50_000, 100)) and len(got) < 4000
    assert jaccard_join._maybe_among(rows, some.limit(0), "key").count() == 0
    # the bits come before the shuffle: no semi join is taken ahead of them
    facts = jaccard_join._facts(rows, some, ("row",))
    assert "LeftSemi" not in facts._jdf.queryExecution().optimizedPlan().toString() and facts.count() == 1000


def test_what_is_stored_on_the_way_goes(spark):
    """Tables of a round go with it, and the shuffle files of a write at its end."""
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.rglob("jaccard-*"))
    d = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(i, 60 + i))) for i in range(20)], "doc_id long, text string")
    assert {r["component_id"] for r in jaccard_join.near_duplicate_components(d).collect()} == {0}
    assert {p.name.rsplit("-", 1)[0] for p in set(shared.rglob("jaccard-*")) - before} == {"jaccard-profile", "jaccard-shared", "jaccard-salts", "jaccard-checked", "jaccard-roots", "jaccard-more"}
    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    many, setting = files(), spark.conf.get(common.CLEAN_UP)
    common.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "test-shuffled")
    for _ in range(50):
        if files() <= many:
            break
        time.sleep(0.2)
    assert files() <= many and spark.conf.get(common.CLEAN_UP) == setting


def test_frequent_counts_keep_what_is_frequent():
    f = jaccard_join.Frequent(most=8)
    rng = np.random.default_rng(0)
    for _ in range(50):
        f.add(np.unique(np.append(rng.integers(100, 10**9, 5, dtype=np.uint64), np.uint64(7))))
    f.settle()
    assert 7 in f.token.tolist() and len(f.token) <= 8


def test_components_of_a_long_path(spark):
    edges = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.createDataFrame([(100, 101), (5, 5), (None, 3)], "a long, b long"))
    got = dict((r["node"], r["root"]) for r in components.components(edges).collect())
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert components.components(edges.limit(0)).count() == 0


# Sharding


def test_sharding_contract(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in d.collect()}
    got = queries.op5_jump_sharding(spark, sf_dir).collect()
    slots = collections.defaultdict(list)
    for r in got:
        raw = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert r["grown_shard"] in (r["shard"], 24) and 0 <= r["shard"] < 24
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(got) == len(text)


def test_jump_walk_moves_only_what_it_must(spark):
    n = 20_000
    d = spark.range(n).select(*[sharding.jump_shard(F.col("id"), k).alias(f"s{k}") for k in range(1, 9)]).toPandas()
    for k in range(2, 9):
        moved = d[d[f"s{k}"] != d[f"s{k - 1}"]]
        assert (moved[f"s{k}"] == k - 1).all() and abs(len(moved) - n / k) < 5 * np.sqrt(n / k)
        assert d[f"s{k}"].value_counts().min() > 0.9 * n / k


def plain_walk(key, n):
    """The jump walk by Spark's hash in plain Python: (shard of n, shard of n + 1)."""
    import struct

    import xxhash

    def draw(bucket):
        seed = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
        return (xxhash.xxh64_intdigest(struct.pack("<q", bucket), seed) >> 33) + 1

    at, following = 0, int((0 + 1.0) * 2.0**31 / draw(0))
    while following < n:
        at, following = following, int((following + 1.0) * 2.0**31 / draw(following))
    return at, following if following < n + 1 else at


def test_shards_equal_a_plain_walk(spark):
    ids = [*range(3000), -5, 2**62, None]
    got = {r["doc_id"]: (r["shard"], r["grown_shard"]) for r in sharding.assign_shards(spark.createDataFrame([(i, "t") for i in ids], "doc_id long, text string")).collect()}
    assert got == {i: plain_walk(i, 24) for i in ids}
    assert 3000 / 25 / 2 < sum(g == 24 for _, g in got.values()) < 3000 / 25 * 2


def test_copies_of_one_row_and_of_one_id(spark):
    rows_ = [(7, "same")] * 50 + [(None, f"t{i}") for i in range(60)] + [(i, "x") for i in range(20)]
    got = sharding.assign_shards(spark.createDataFrame(rows_, "doc_id long, text string"), 3, rows_per_block=4).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(i for i, _ in rows_)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_cases(spark):
    got = sharding.assign_shards(table(spark, CASES), 3, rows_per_block=1).collect()
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(got) == len(CASES)
    assert {(r["size"], r["text_crc32"]) for r in got if r["doc_id"] in (2, 3)} == {(8, 0)}
    assert sharding.assign_shards(docs(spark)).count() == 0


# Token files


def check_tokens(spark, d, got):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_orc.tokenizer_path())
    start = 0
    want = []
    for r in d.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("h")).orderBy("doc_id", "h").collect():
        ids = [*t.encode(r["text"], add_special_tokens=False).ids, 2]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda x: x[1]) == want


def test_tokens_equal_the_library(spark, sf_dir):
    check_tokens(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), queries.op7_token_orc(spark, sf_dir))


def test_token_cases(spark, tmp_path):
    odd = ["a b  \x1cc <|endoftext|>x it's 'll É́ \x0b q", "don't  DON'T 12a\n\n", "<|ENDOFTEXT|> THE", "x.\ty, z.,. é. a.", "日本語 テスト。 Σας ΣΑΣ İstanbul x y ŒUVRE ﬁn", "😀 ok", None, ""]
    for d in (table(spark, CASES), docs(spark, *odd)):
        check_tokens(spark, d, token_orc.token_query(d))
    token_orc.write_tokens(docs(spark, *odd), f"{tmp_path}/t", partitions=3)
    tokens = token_orc.read_tokens(spark, f"{tmp_path}/t")
    assert [r["doc_id"] for r in token_orc.lookup(tokens, [4]).collect()] == [4]
    plan = token_orc.lookup(tokens, [4])._jdf.queryExecution().toString()
    assert "PushedFilters: [In(doc_id, [4])]" in plan or "EqualTo(doc_id,4)" in plan
    assert token_orc.token_query(docs(spark)).count() == 0


def test_pieces_with_one_hash_stay_apart(spark, monkeypatch):
    from folioscope.llm.words import Words

    monkeypatch.setattr(Words, "hashes", lambda self, data: np.zeros(len(self), np.uint64))
    e = token_orc.Encoder(token_orc.tokenizer_path())
    text = "one two Three one, two. four"
    data = np.frombuffer(text.encode(), np.uint8)
    ids, _ = e.encode(data, np.array([0, len(data)]))
    assert ids.tolist() == [*e.tokenizer.encode(text, add_special_tokens=False).ids, 2]


def test_a_hot_id_fills_several_files(spark, tmp_path):
    d = spark.createDataFrame([(5, "same text")] * 300 + [(5, f"t{i}") for i in range(300)] + [(i, "x") for i in range(10)], "doc_id long, text string")
    token_orc.write_tokens(d, f"{tmp_path}/hot", partitions=6)
    tokens = token_orc.read_tokens(spark, f"{tmp_path}/hot")
    sizes = [r["count"] for r in tokens.groupBy("part").count().collect()]
    assert max(sizes) < 300 and sum(sizes) == 610
    check_tokens_sorted = token_orc.with_positions(tokens).orderBy("start").select("doc_id", "start", "n_tokens").collect()
    at = 0
    for r in check_tokens_sorted:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in check_tokens_sorted]
    assert ids == sorted(ids)


def test_file_footers(spark, tmp_path):
    """Stripes, integer run-length encoding, row index and Bloom filter, as the ORC library reads them."""
    token_orc.write_tokens(docs(spark, *[f"word{i} and {i} more" for i in range(3000)]), f"{tmp_path}/f", partitions=1)
    path = next(Path(f"{tmp_path}/f").glob("*.orc"))
    orc = spark.sparkContext._jvm.org.apache.orc
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    reader = orc.OrcFile.createReader(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(path)), orc.OrcFile.readerOptions(conf))
    assert reader.getRowIndexStride() == token_orc.ROW_INDEX_STRIDE and reader.getNumberOfRows() == 3000
    assert reader.getCompressionKind().toString() == "ZSTD" and reader.getStripes().size() >= 1
    # the stripe footer follows index and data of the stripe
    stripe = reader.getStripes().get(0)
    rows_ = reader.rows()
    footer = rows_.readStripeFooter(stripe)
    column = reader.getSchema().findSubtype("doc_id").getId()
    assert footer.getColumns(column).getKind().toString() == "DIRECT_V2"
    kinds = {(s.getColumn(), s.getKind().toString()) for s in footer.getStreamsList()}
    assert (column, "ROW_INDEX") in kinds and (column, "BLOOM_FILTER_UTF8") in kinds
    ids = reader.getSchema().findSubtype("ids").getId()
    assert footer.getColumns(ids + 1).getKind().toString() == "DIRECT_V2" and not any(c == ids and k.startswith("BLOOM") for c, k in kinds)


def test_encoder_forgets_what_does_not_fit(monkeypatch):
    import pyarrow as pa

    from folioscope.llm.words import blocks

    monkeypatch.setattr(token_orc, "REMEMBERED", 3)
    e = token_orc.Encoder(token_orc.tokenizer_path())
    texts = [f"one two three four five{i} six, seven." for i in range(20)]
    got = []
    for _, _, data, offsets in blocks(pa.array(texts), limit=64):
        ids, bounds = e.encode(data, offsets)
        got += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert got == [[*x.ids, 2] for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


# Decontamination


def test_decontamination_equals_sql(spark, sf_dir):
    c = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = sorted(c.sql(f"SELECT {', '.join(columns)} FROM ({queries.OP8_SQL})").fetchall())
    got = rows(queries.op8_winnowing(spark, sf_dir), *columns)
    assert sorted(got) == want and any(r[5] for r in got)


def brute_hits(texts, items):
    windows = []
    for item_id, t in items:
        w = plain(t)
        n = min(10, len(w))
        windows += [(item_id, tuple(w[i : i + n])) for i in range(len(w) - n + 1)] if n else []
    out = []
    for doc_id, t in texts:
        w = plain(t)
        hit, found = set(), set()
        for item_id, x in windows:
            for i in range(len(w) - len(x) + 1):
                if tuple(w[i : i + len(x)]) == x:
                    hit |= set(range(i, i + len(x)))
                    found.add(str(item_id))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def test_short_items_overlaps_and_repeats(spark):
    rng = random.Random(8)
    run = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(1, run(14)), (2, run(10)), (30, "a b c"), (4, "b"), (5, ""), (6, None), (7, "a b C!"), (100, run(12))]
    texts = [(i, run(rng.randrange(0, 80))) for i in range(30)] + [(40, None), (41, "A, b; c"), (42, "B" * 3), (43, items[0][1].upper() + " zz " + items[1][1])]
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, key string")
    for chosen in (b, b.where("item_id in (1, 2, 5, 100)")):
        d = spark.createDataFrame([(i, t, 1, 2) for i, t in texts], "doc_id long, text string, key int, words int")
        got = rows(decontaminate.find_contamination(d, chosen), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
        assert sorted(got) == sorted(brute_hits(texts, [(r["item_id"], r["text"]) for r in chosen.collect()]))


def test_items_without_an_id_and_ids_with_two_texts(spark):
    ten, other = " ".join(f"a{i}" for i in range(10)), " ".join(f"b{i}" for i in range(14))
    items = [(None, ten), (None, ten + " x"), (1, "short one"), (1, other), (2, other), (3, other)]
    b = spark.createDataFrame(items, "item_id long, text string")
    texts = [(1, ten), (2, "x " + other), (3, "a short one here"), (4, "b0 b1"), (None, ten), (None, "clean"), (5, "clean")]
    got = rows(decontaminate.find_contamination(spark.createDataFrame(texts, "doc_id long, text string"), b), "doc_id", "n_hit", "n_items", "items_sha256", "contaminated")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(1, 10, 1, sha(""), True), (2, 14, 3, sha("1,2,3"), True), (3, 2, 1, sha("1"), True), (4, 0, 0, sha(""), False), (None, 10, 1, sha(""), True), (None, 0, 0, sha(""), False), (5, 0, 0, sha(""), False)]
    assert got == sorted(want, key=repr)


def test_clean_documents_goes_by_row(spark):
    ten = " ".join(f"a{i}" for i in range(10))
    d = spark.createDataFrame([(1, ten, 1), (1, "other words", 2), (None, ten, 3), (None, None, 4), (2, "", 5), (2, "", 5)], "doc_id long, text string, key int")
    b = spark.createDataFrame([(1, ten)], "item_id long, text string")
    assert rows(decontaminate.clean_documents(d, b), "doc_id", "key") == sorted([(1, 2), (None, 4), (2, 5), (2, 5)], key=repr)


def test_decontamination_of_a_very_long_contaminated_text(spark):
    """Places of fingerprints come from a join, so a text made of items alone costs no more than its words."""
    rng = random.Random(4)
    items = [" ".join(f"w{rng.randrange(3000)}" for _ in range(30)) for _ in range(500)]
    text = " ".join(rng.choice(items) for _ in range(2500))
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontaminate.find_contamination(spark.createDataFrame([(1, text), (2, "no such words here at all " * 3)], "doc_id long, text string"), b)
    assert rows(got, "doc_id", "n_words", "n_hit") == [(1, 75_000, 75_000), (2, 18, 0)]


def test_decontamination_cases(spark):
    t = table(spark, CASES)
    b = spark.createDataFrame([(1, CASES[0][1])], "item_id long, text string")
    got = rows(decontaminate.find_contamination(t, b), "doc_id", "contaminated")
    assert len(got) == len(CASES) and {r[0] for r in got if r[1]} == {1, 5, 6}
    clean = decontaminate.clean_documents(t, b)
    assert clean.columns == t.columns and clean.count() == len(CASES) - 4
    for empty in (b.limit(0), spark.createDataFrame([(1, None), (2, " . ")], "item_id long, text string")):
        assert not any(r["contaminated"] for r in decontaminate.find_contamination(t, empty).collect())
    assert decontaminate.find_contamination(docs(spark), b).count() == 0


# Mixing


def brute_targets(sizes):
    """sizes: {source: words}. Water-filling by rounds."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, target, open_ = float(sum(sizes.values())), {}, set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mixing_contract(spark):
    sf = "/root/testdata/sf0.01"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    source = {r["doc_id"]: r["source"] for r in d.collect()}
    size = {r["doc_id"]: len(spaced(r["text"])) for r in d.collect()}
    words = collections.Counter()
    for i, n in size.items():
        words[source[i]] += n
    want = brute_targets(words)
    got = queries.op9_pivotal_mixing(spark, sf).collect()
    taken = collections.Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == words[s] and r["target"] == pytest.approx(want[s])
        assert r["taken"] in {k * r["size"] for k in range(4)}
        taken[s] += r["taken"]
    assert len(got) == len(size)
    assert max(abs(taken[s] / want[s] - 1) for s in want) < 0.01
    assert rows(queries.op9_pivotal_mixing(spark, sf), "doc_id", "taken") == sorted(((r["doc_id"], r["taken"]) for r in got), key=repr)


def test_targets_stop_and_share_again(spark):
    sizes = {"a": 10, "b": 1000, "c": 20, "d": 5, "é": 700, None: 3}
    d = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(d).collect()}
    assert got == {s: pytest.approx(t) for s, t in brute_targets(sizes).items()}
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def rounded(size, part, seed):
    order = np.argsort(-np.array(size), kind="stable")
    back = np.empty(len(size), int)
    _, extra = mixing.round_chunk([(i, "") for i in range(len(size))], np.array(size)[order], np.array(part)[order], seed, last=True)
    back[order] = extra
    return back


@pytest.mark.parametrize(
    ("size", "part"),
    [([5 + i % 7 for i in range(50)], [0.3] * 50), ([20_000] * 10 + [5] * 30, [0.9] * 40), ([9000] * 3 + [7] * 20, [0.3] * 23), ([50, 3, 40, 2, 9, 1], [0.2, 0.7, 0.5, 0.5, 0.9, 0.1])],
)
def test_rounding_keeps_words_and_chances(size, part):
    sums, taken, runs = [], np.zeros(len(size)), 2000
    for seed in range(runs):
        done = rounded(size, part, seed)
        sums.append((done * size).sum())
        taken += done
    exact = float(np.dot(size, part))
    assert max(abs(s - exact) for s in sums) <= max(size)
    p = np.array(part)
    assert (np.abs(taken / runs - p) < 4.5 * np.sqrt(p * (1 - p) / runs)).all()


def test_copies_of_one_row_in_two_sources(spark):
    d = spark.createDataFrame([(1, "w w w", s, i) for s in ("a", "b") for i in range(100)], "doc_id long, text string, source string, mix_plan int")
    mixed = mixing.mixed_documents(d)
    assert mixed.columns == d.columns
    got = {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert abs(got["a"] - 66.7) < 1 and abs(got["b"] - 133.3) < 1
    assert {r["n"] for r in mixing.mix_sources(d).groupBy("copies").agg(F.count("*").alias("n")).collect()} and mixing.mix_sources(d, chunk_rows=8).count() == 200


def test_mixing_keeps_large_ids_beside_nulls(spark):
    d = spark.createDataFrame([(2**62 + 1, "a b"), (None, "c d"), (2**62 + 3, None)], "doc_id long, text string").withColumn("source", F.lit("s"))
    assert {r["doc_id"] for r in mixing.mix_sources(d).collect()} == {2**62 + 1, None, 2**62 + 3}


def test_mixing_through_the_tree(spark):
    d = spark.createDataFrame([(i, "w " * (1 + i % 9), "ab"[i % 2] if i % 5 else None) for i in range(600)], "doc_id long, text string, source string")
    got = mixing.mix_sources(d, chunk_rows=8, fan_in=3)
    g = got.groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect()
    assert len(g) == 3 and all(abs(r["t"] - r["target"]) <= 20 for r in g)


def test_mixing_cases(spark):
    t = table(spark, CASES)
    got = mixing.mix_sources(t).collect()
    assert len(got) == len(CASES) and all(r["taken"] == 0 for r in got if r["doc_id"] in (2, 3, 4))
    mixed = mixing.mixed_documents(t)
    assert mixed.columns == t.columns
    assert mixed.count() == sum(r["copies"] for r in got)
    assert mixing.mix_sources(docs(spark)).count() == 0 and mixing.mixed_documents(docs(spark)).count() == 0
    assert mixing.mix_sources(docs(spark, None, "")).count() == 2


# Pipeline


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in b.collect()]
    for name, stage in p.STAGES:
        before = d
        d = stage(spark, d, sf_dir).cache()
        if name != "sharding":
            assert d.columns == before.columns
        ids = {r["doc_id"] for r in d.select("doc_id").collect()}
        texts = [(r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect()]
        if name == "near_duplicates":
            assert ids == {c for _, c in brute_components(texts).values()}
        if name == "decontamination":
            assert ids == {r[0] for r in brute_hits(texts, items) if not r[5]}
        if name == "sharding":
            assert d.count() == before.count() and ids == {i for i, _ in texts}
        assert ids


def test_pipeline_runs_whole(spark, sf_dir):
    import corpus_pipeline as p
    from folioscope.llm.common import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file://"))
    out = p.run(spark, sf_dir)
    assert not list(folder.glob("scratch-*/*"))
    assert out.count() > 0 and {"doc_id", "shard", "slot"} <= set(out.columns)


def test_scratch_tables_are_each_block_s_own(spark):
    from folioscope.llm.common import scratch_tables, written

    with scratch_tables(spark):
        outer = written(spark.range(3), "a")
        with scratch_tables(spark):
            assert written(spark.range(5), "a").count() == 5
        assert outer.count() == 3


def test_pipeline_stages_with_odd_rows(spark, sf_dir):
    """Nulls in every column, empty and long texts, repeated ids and rows, an empty table."""
    import corpus_pipeline as p

    d = table(spark, CASES)
    for name, stage in p.STAGES:
        out = stage(spark, d, sf_dir)
        if name != "sharding":
            assert out.columns == d.columns
        assert stage(spark, d.limit(0), sf_dir).count() == 0
        if name in ("toxicity", "decontamination"):
            assert out.count() == len(CASES)


def test_links_of_rows_without_an_id(spark):
    """A set that only rows without an id have still links others."""
    base = [f"w{i}" for i in range(60)]
    a, b, c = base[:], base[3:], base[6:]
    d = spark.createDataFrame([(7, " ".join(a)), (None, " ".join(b)), (9, " ".join(c)), (11, "alone")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicate_components(d).collect()}
    assert got == {7: 7, None: 7, 9: 7, 11: 11}
