"""Chat formatting of reply trees: root-to-leaf paths by iterative self-joins, the best branches as conversations.

Messages point to the message that they answer. Pointers are doubled by joining the table with itself:
after round k a message knows its ancestor 2^k steps up and the sum of the scores between, so paths of any length are
ranked after logarithmically many joins, and no text moves. The messages of the chosen paths are listed
by the same pointers, again doubling in each round; only then the texts are fetched, once for each path.

The template writes a turn as ``### role: text</turn>`` and a newline. Control strings inside roles and
texts are escaped by codes that begin with a backslash, so no text can hold a control string, and
nothing else reads as a code: the output reads back to exactly what was written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.llm.common import small_batches, written

#: The template: before a role, after it, and after a text.
OPEN, SPEAKS, CLOSE = "### ", ": ", "</turn>\n"
#: Control strings and their codes, in the order of escaping; the backslash is first, and last when read back.
CODES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t"))
#: In a role the colon is a control string too.
ROLE_CODES = (*CODES, (":", "\\c"))


def escaped(text: Column, codes: tuple = CODES) -> Column:
    for plain, code in codes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: str, codes: tuple = CODES) -> str:
    for plain, code in reversed(codes):
        text = text.replace(code, plain)
    return text


def _version(text: Column) -> list[Column]:
    """What decides among rows with one node: parent, role and a hash of the text, so that no text need move."""
    return [F.coalesce("parent", F.lit(-1)), F.col("role"), F.xxhash64(text)]


def linked(messages: DataFrame) -> DataFrame:
    """tree, node, parent, score with one row for each message, without texts.

    Of repeated nodes of a tree the one with the least parent, role and hash of the text counts.
    """
    first = F.min(F.struct(*_version(F.col("text")), "parent", "score")).alias("m")
    nodes = messages.where("tree is not null and node is not null").groupBy("tree", "node").agg(first)
    return written(nodes.select("tree", "node", "m.parent", F.coalesce("m.score", F.lit(0.0)).cast("double").alias("score")), "reply-nodes")


def ancestors(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, node, depth, total) of each message with a root, and tables of pointers (tree, node, up) by distance 1, 2, 4, ...

    A message whose parent is null, missing in its tree or itself is a root. Each round joins the open pointers
    with all; those that reach a root are settled and join no more. Above a message at depth d stand messages of every
    smaller depth, so each round settles some as long as any has a root; what is left is in a cycle or hangs
    from one, has no root and is on no path.
    """
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    met = nodes.join(known, ["tree", "parent"], "left").withColumn("up", F.when(F.col("known") & (F.col("parent") != F.col("node")), F.col("parent")))
    last = written(met.select("tree", "node", "up", F.lit(1).cast("long").alias("depth"), F.col("score").alias("total")), "reply-up")
    settled, jumps, before = last.where("up is null"), [], None
    while True:
        open_ = last.where("up is not null")
        left = open_.count()
        if left in (0, before):
            break
        before = left
        jumps.append(open_.select("tree", "node", "up"))
        above = settled.unionByName(open_).select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("total").alias("above"))
        went = open_.join(above, ["tree", "up"]).select("tree", "node", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("total") + F.col("above")).alias("total"))
        last = written(went, "reply-up")
        settled = settled.unionByName(last.where("up is null"))
    return settled.select("tree", "node", "depth", "total"), jumps


def ranked_branches(nodes: DataFrame, reached: DataFrame) -> DataFrame:
    """tree, leaf, depth, score and place of each root-to-leaf path, the best of a tree first.

    The score of a branch is the mean score of its messages; ties go to the longer branch, then to the smaller leaf.
    A limit on the place is applied before the shuffle too, so a tree with many leaves sends few.
    """
    parents = nodes.where("parent <> node").select("tree", F.col("parent").alias("node")).distinct()
    leaves = reached.join(parents, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "depth", (F.col("total") / F.col("depth")).alias("score"))
    best = W.partitionBy("tree").orderBy(F.col("score").desc(), F.col("depth").desc(), "leaf")
    return leaves.withColumn("place", F.row_number().over(best))


def path_messages(chosen: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """tree, leaf, node, back of every message on the paths to the leaves: ``back`` is 0 at the leaf.

    Round k adds to each listed message the one 2^k steps further up, so each is listed once.
    """
    found = written(chosen.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("back")), "reply-path")
    for k, jump in enumerate(jumps):
        further = found.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("back") + (1 << k)).alias("back"))
        found = found.unionByName(written(further, "reply-path"))
    return found


def format_replies(messages: DataFrame, branches: int = 1, loss_role: str = "assistant") -> DataFrame:
    """The ``branches`` best paths of each tree of ``messages`` (tree, node, parent, role, text, score), each as one conversation.

    Returns tree, leaf, place, score, formatted and mask: the (start, length) in characters of each text of
    ``loss_role`` in ``formatted``, as it stands there, escaped. Null roles and texts are empty, null scores 0.
    An empty table gives an empty result; other columns are ignored. A message without a tree or node is on no path.
    """
    messages = messages.select("tree", "node", "parent", "role", "text", "score")
    nodes = linked(messages)
    reached, jumps = ancestors(nodes)
    chosen = ranked_branches(nodes, reached).where(F.col("place") <= branches)
    said = F.min_by(F.struct("role", "text"), F.struct(*_version(F.col("text")))).alias("said")
    path = path_messages(chosen, jumps).join(messages, ["tree", "node"]).groupBy("tree", "node", "leaf", "back").agg(said).select("tree", "leaf", "back", "said.*")
    head = F.concat(F.lit(OPEN), escaped(F.coalesce("role", F.lit("")), ROLE_CODES), F.lit(SPEAKS))
    turns = path.select("tree", "leaf", "back", F.coalesce(F.col("role") == loss_role, F.lit(False)).alias("loss"), head.alias("head"), escaped(F.coalesce("text", F.lit(""))).alias("body"))
    long = F.length("head") + F.length("body") + len(CLOSE)
    earlier = W.partitionBy("tree", "leaf").orderBy(F.col("back").desc()).rowsBetween(W.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum(long).over(earlier), F.lit(0)) + F.length("head"))
    turn = F.struct((-F.col("back")).alias("at"), F.concat("head", "body", F.lit(CLOSE)).alias("whole"), F.when(F.col("loss"), F.struct("start", F.length("body").cast("long").alias("length"))).alias("span"))
    whole = turns.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    spans = F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull())
    formatted = whole.select("tree", "leaf", F.array_join(F.transform("turns", lambda t: t["whole"]), "").alias("formatted"), spans.alias("mask"))
    return formatted.join(chosen.select("tree", "leaf", "place", "score"), ["tree", "leaf"]).select("tree", "leaf", "place", "score", "formatted", "mask")


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted conversation."""
    found = []
    for turn in formatted.split(CLOSE)[:-1]:
        role, _, text = turn[len(OPEN) :].partition(SPEAKS)
        found.append((unescaped(role, ROLE_CODES), unescaped(text)))
    return found


_DIGEST = "tree string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["tree", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    for batch in batches:
        rows = []
        for tree, formatted, mask in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            written_as = formatted.as_py()
            turns = turns_of(written_as)
            loss = "".join(unescaped(written_as[s["start"] : s["start"] + s["length"]]) for s in mask.as_py())
            digest = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode()).hexdigest()
            rows.append((tree.as_py(), len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(written_as)))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def read_back(formatted: DataFrame) -> DataFrame:
    """What formatted conversations (tree, formatted, mask) say, read from them alone: digests of the turns and of the text under the mask."""
    small_batches(formatted.sparkSession)
    return formatted.select("tree", "formatted", "mask").mapInArrow(_digested, _DIGEST)


def as_replies(conversations: DataFrame) -> DataFrame:
    """The rows of conversations as messages, each the answer to the row before by turn (null turns first, ties by role
    and a hash of the text).

    The score of a message is its number of characters. A null conv_id is a conversation of its own.
    """
    order = W.partitionBy("conv_id", "planted").orderBy(F.col("turn").asc_nulls_first(), "role", F.xxhash64("text"))
    placed = conversations.withColumn("node", F.row_number().over(order).cast("long"))
    tree = F.concat(F.when(F.col("planted"), "+").otherwise(""), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))
    return placed.select(tree.alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.length("text").cast("double").alias("score"))


#: The conversation that the contract adds: an id and what both of its turns say.
PLANTED = (-7, "\\### Assistant: </turn> ok")


def chat_query(conversations: DataFrame) -> DataFrame:
    """All conversations and the planted one, formatted, written, and read back from the written table."""
    spark = conversations.sparkSession
    rows = conversations.select("conv_id", "turn", "role", "text", F.lit(False).alias("planted"))
    conv_id, says = PLANTED
    extra = spark.range(2).select(F.lit(conv_id).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(says).alias("text"), F.lit(True).alias("planted"))
    output = written(format_replies(as_replies(rows.unionByName(extra))), "chat-output")
    found = read_back(output)
    conv = F.when(F.col("tree") != "null", F.ltrim(F.col("tree"), F.lit("+")).cast("long"))
    return found.select(conv.alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
