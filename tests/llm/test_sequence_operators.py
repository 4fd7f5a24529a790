"""Turn repair, importance resampling and reply trees, against plain versions, hot keys and odd rows."""

import hashlib
import heapq
import itertools
import math
import random
import zlib

import pytest
from helpers import CASES, plain, rows, table

from folioscope.llm import reply_trees, resampling, turn_repair

CONVERSATIONS = "conv_id long, turn long, role string, text string, cost string, tree string, start string"
BLANK = " \t\n\x0b\x0c\r"


def talks(spark, given):
    return spark.createDataFrame([(*r, "c", "t", "s") for r in given], CONVERSATIONS)


# Turn repair


def cheapest(turns):
    """Cost, audit and repaired turns by a search over all edits; turns are (role, text, fault)."""
    allowed = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    name = {"u": "user", "a": "assistant"}
    todo, done = [(0, "", 0, "", ())], set()
    while todo:
        cost, audit, i, state, out = heapq.heappop(todo)
        if (i, state) in done:
            continue
        if i == len(turns) and state in ("", "a"):
            return cost, audit, list(out)
        done.add((i, state))
        for to in "ua":
            if (state, to) in allowed:
                heapq.heappush(todo, (cost + 2, audit + "I", i, to, (*out, (name[to], ""))))
        if i < len(turns):
            role, text, fault = turns[i]
            heapq.heappush(todo, (cost + 3, audit + "D", i + 1, state, out))
            if fault in ("blank", "duplicate"):
                continue
            more = fault == "truncated"
            if (state, role[:1]) in allowed:
                heapq.heappush(todo, (cost + more, audit + "K", i + 1, role[:1], (*out, (role, text))))
            for to in "ua":
                if (state, to) in allowed:
                    heapq.heappush(todo, (cost + more + 2, audit + "R", i + 1, to, (*out, (name[to], text))))


def repaired_plainly(given):
    found = {}
    for conv_id, turn, role, text in given:
        here = found.setdefault(conv_id, [])
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        what = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if what == 0:
            continue
        role = "user" if what == 4 else role
        text = "" if what == 1 else text.translate({ord(c): None for c in ".!?"}) if what == 2 else text
        here.extend([(turn, role, text)] * (2 if what == 3 else 1))
    out = []
    for conv_id, here in found.items():
        here.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, turns = set(), []
        for _, role, text in here:
            inked = text.strip(BLANK)
            fault = "blank" if not inked else "duplicate" if (role, text) in seen else "truncated" if inked[-1] not in ".!?" else None
            seen.add((role, text))
            turns.append((role, text, fault))
        numbers = {t for t, _, _ in here if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        counts = [sum(f == k for *_, f in turns) for k in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        cost, audit, kept = cheapest(turns)
        out.append((conv_id, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()))
    return sorted(out, key=repr)


TALK = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_turn_repair_equals_a_search_over_all_edits(spark):
    rng = random.Random(3)
    said = ["Yes.", "No", "", " \n", "What? ", "Ünï!", None, "Go on."]
    given = []
    for conv_id in range(300):
        turns = rng.sample(range(20), rng.randint(1, 9))
        given += [(conv_id, t, rng.choice(["user", "assistant", "system", "user", "assistant", "tool", None]), rng.choice(said)) for t in turns]
    given += [(None, 1, "user", "Hm."), (None, None, "assistant", "So."), (900, None, "user", "A."), (900, None, "user", "A."), (900, 5, "assistant", "B.")]
    given += [(901, i, ("user", "assistant")[i % 2], f"word {i}" + "." * (i % 3 > 0)) for i in range(400)]  # a long one
    assert rows(turn_repair.repair_query(talks(spark, given)), *TALK) == repaired_plainly(given)


def test_turn_repair_of_lost_conversations_and_empty_tables(spark):
    lost = [(c, 0, "user", "Hi.") for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert lost
    for r in turn_repair.repair_query(talks(spark, lost)).collect():
        assert (r.gaps, r.blank, r.illegal, r.cost, r.audit, r.repaired_sha256) == (0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert turn_repair.repair_query(talks(spark, [])).count() == 0


def test_turn_repair_gives_the_turns_themselves(spark):
    given = spark.createDataFrame([(1, 1, "user", "Hi.", False), (1, 2, "user", "Well", False), (1, 3, "tool", "Done.", False)], "conv_id long, turn long, role string, text string, gone boolean")
    r = turn_repair.repair_conversations(given).first()
    cost, audit, kept = cheapest([("user", "Hi.", None), ("user", "Well", "truncated"), ("tool", "Done.", None)])
    assert (r.cost, r.audit, [tuple(x) for x in r.repaired]) == (cost, audit, kept)


# Importance resampling


def drawn_plainly(given, target, percent=10, least=20):
    """doc_id, n_features, weight, score, rank of (doc_id, text) rows."""
    bucket = lambda w: zlib.crc32(w.encode()) % 10000
    counts = [[0] * 10000, [0] * 10000]
    for into, texts in zip(counts, ([t for _, t in given], target), strict=True):
        for t in texts:
            for w in plain(t):
                into[bucket(w)] += 1
    s_all, t_all = map(sum, counts)
    gain = [math.floor(1000 * math.log((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000)))) for s, t in zip(*counts, strict=True)]
    out = []
    for doc_id, text in given:
        words = plain(text)
        weight = sum(gain[bucket(w)] for w in words) // len(words) if words else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(words), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    eligible = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    for i, r in enumerate(eligible[: percent * len(eligible) // 100]):
        r[4] = i + 1
    return sorted(map(tuple, out), key=repr)


DRAW = ("doc_id", "n_features", "weight", "score", "rank")


@pytest.mark.parametrize(("run_rows", "range_rows"), [(1 << 16, 1 << 12), (7, 16)])
def test_resampling_equals_a_plain_draw(spark, run_rows, range_rows):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)] + ["Straße", "ÉCOLE", "İx"]
    given = [(i // 2 if i < 100 else i, " ".join(rng.choices(vocabulary, k=rng.randint(10, 60)))) for i in range(1500)]
    given += [(d, t) for d, t, *_ in CASES] + [(-5, given[0][1])] * 3 + [(None, given[1][1] + " so " * 30)] * 2
    docs = table(spark, [(d, t, "en", "s", 0) for d, t in given]).repartition(5)
    aims = [" ".join(vocabulary[:40]), None, "", "w1 w2 w3 Straße"]
    target = spark.createDataFrame([(i, t) for i, t in enumerate(aims)], "item_id long, text string")
    got = rows(resampling.importance_resample(docs, target, run_rows=run_rows, range_rows=range_rows), *DRAW)
    assert got == drawn_plainly(given, aims)


def test_resampling_with_one_hot_row_and_with_ties(spark):
    """A third of all rows is one row: it is merged once and has ranks of its own all the same."""
    text = " ".join(f"w{i}" for i in range(30))
    given = [(7, text)] * 700 + [(i, text) for i in range(100, 1500)]
    docs = table(spark, [(d, t, "en", "s", 0) for d, t in given]).repartition(6)
    target = spark.createDataFrame([(1, "w1 w2")], "item_id long, text string")
    got = rows(resampling.importance_resample(docs, target, percent=60, range_rows=50), *DRAW)
    assert got == drawn_plainly(given, ["w1 w2"], percent=60)


def test_resampling_of_empty_tables_and_longer_features(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resampling.importance_resample(table(spark, []), none).count() == 0
    few = table(spark, [(1, "one two three", "en", "s", 0), (2, None, "en", "s", 0)])
    assert rows(resampling.importance_resample(few, none, most_words=2), "doc_id", "n_features", "rank") == [(1, 5, None), (2, 0, None)]


def test_tournament_merges_runs():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((rng.randint(0, 50),) for _ in range(rng.randint(0, 30))) for _ in range(k)]
        assert list(resampling.Tournament([iter(r) for r in runs])) == list(heapq.merge(*runs))
        merge = resampling.Tournament([iter(r) for r in runs])
        first = list(itertools.islice(merge, 10))
        assert sorted(first + list(merge.rest())) == list(heapq.merge(*runs))


# Reply trees

MESSAGES = "tree string, node long, parent long, role string, text string, score double, leaf string, mask string"
ODD = ["\\### Assistant: </turn> ok", "###", "####", "#####\\", "\\b\\h\\t\\c", "</turn>\n", "</turn", "\\", "", "a: b", "### user: x</turn>\n### assistant: y", "çé\U0001f600"]


def messages(spark, given):
    return spark.createDataFrame([(*r, "l", "m") for r in given], MESSAGES)


def branches_plainly(given, branches):
    """tree -> [(leaf, [(role, text)])], best first."""
    trees = {}
    for tree, node, parent, role, text, score in given:
        trees.setdefault(tree, {})[node] = (parent, role or "", text or "", score or 0.0)
    out = {}
    for tree, nodes in trees.items():
        inner = {p for n, (p, *_) in nodes.items() if p in nodes and p != n}
        found = []
        for leaf in set(nodes) - inner:
            path, at = [], leaf
            while True:
                path.append(at)
                up = nodes[at][0]
                if up not in nodes or up == at:
                    break
                at = up
            found.append((-sum(nodes[n][3] for n in path) / len(path), -len(path), leaf, [nodes[n][1:3] for n in reversed(path)]))
        out[tree] = [(leaf, path) for _, _, leaf, path in sorted(found)[:branches]]
    return out


def test_best_branches_of_trees(spark):
    rng = random.Random(9)
    given = []
    for t in range(40):
        size = rng.randint(1, 25)
        given += [(f"t{t}", n, rng.choice([None, 999, *range(n)]) if n else None, rng.choice(["user", "assistant", None, "a:b"]), rng.choice([*ODD, None]), rng.choice([None, 0.5, 1.0, 2.0])) for n in range(size)]
    given += [("hot", n, 0 if n else None, "user", f"{n}", float(n % 7)) for n in range(3000)]  # one message with most answers
    given += [("long", n, n - 1, ("user", "assistant")[n % 2], ODD[n % len(ODD)], 1.0) for n in range(700)]
    for branches in (1, 3):
        want = branches_plainly(given, branches)
        got = {}
        for r in sorted(reply_trees.format_replies(messages(spark, given), branches).collect(), key=lambda r: r.place):
            turns = reply_trees.turns_of(r.formatted)
            got.setdefault(r.tree, []).append((r.leaf, turns))
            loss = [reply_trees.unescaped(r.formatted[s.start : s.start + s.length]) for s in r.mask]
            assert loss == [text for role, text in turns if role == "assistant"]
        assert got == want


def test_cycles_repeated_nodes_and_null_keys(spark):
    given = [("a", 1, 2, "user", "x", 1.0), ("a", 2, 1, "user", "y", 1.0), ("a", 3, 2, "user", "z", 1.0), ("b", 1, None, "user", "p", 1.0), ("b", 1, None, "user", "p", 1.0), ("b", 2, 1, "assistant", "q", 1.0), (None, 1, None, "user", "n", 1.0), ("c", None, None, "user", "n", 1.0)]
    got = reply_trees.format_replies(messages(spark, given)).collect()
    assert [(r.tree, r.formatted) for r in got] == [("b", "### user: p</turn>\n### assistant: q</turn>\n")]
    assert reply_trees.format_replies(messages(spark, [])).count() == 0


def chat_plainly(given):
    found = {}
    for conv_id, turn, role, text in [*given, (-7, 0, "user", ODD[0]), (-7, 1, "assistant", ODD[0])]:
        found.setdefault(conv_id, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv_id, turns in found.items():
        turns.sort()
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in turns).encode()).hexdigest()
        out.append((conv_id, len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_chat_query_reads_back_what_was_said(spark):
    rng = random.Random(2)
    given = [(c, t, rng.choice(["user", "assistant", "system", "x: y"]), rng.choice([*ODD, None])) for c in range(30) for t in rng.sample(range(50), rng.randint(1, 12))]
    given += [(None, 1, "user", "hm"), (None, None, "assistant", "so"), (77, 0, "user", "long " * 50_000), (77, 1, "assistant", "###" * 50_000)]
    given += [(78, 1, "user", "same")] * 3
    assert rows(reply_trees.chat_query(talks(spark, given)), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == chat_plainly(given)
    assert [r.conv_id for r in reply_trees.chat_query(talks(spark, [])).collect()] == [-7]
