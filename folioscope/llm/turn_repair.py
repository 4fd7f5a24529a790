"""Conversation structure repair: the cheapest edits that make roles alternate, by a fold in Spark SQL.

Windows flag the faults of each turn (blank, duplicate, truncated). The turns of a conversation are
collected in order, and ``aggregate`` folds over them with four (cost, audit) structs, one for each
state of the role sequence ``(s?(ua)+)?``:

    0 nothing yet    1 after the system turn    2 after a user turn    3 after an assistant turn

``least`` on structs takes the smaller cost, and of equal costs the ASCII-least audit. That is right
before the end too: two audits that lead to one state at one cost differ at some letter (one can't be
the beginning of the other, as each further edit without a turn costs something), and what follows
does not change which is smaller. The audit fixes the repaired conversation, as every state has one
role that can be inserted or given.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Costs of the edits, fixed by the contract; a kept or reroled turn that breaks off costs CUT more.
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
#: A cost that no conversation reaches: the state can't be reached.
_NEVER = 1 << 50
#: Characters that are no blanks, and those that end a sentence.
_INK, _ENDS = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after a damage that crc32 of ``conv_id:turn`` decides, as conv_id, turn, role, text, gone.

    Of twenty remainders 0 drops the row (it stays as ``gone``, so that its conversation is not lost),
    1 empties its text, 2 takes away its ``.!?``, 3 repeats it and 4 makes it a user's. Null ids and turns
    count as one space in the key, and null roles and texts are one space.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = conversations.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), what.alias("what"))
    rows = rows.select("conv_id", "turn", F.when(F.col("what") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "what")
    return rows.select("conv_id", "turn", "role", "text", (F.col("what") == 0).alias("gone"), F.explode(F.sequence(F.lit(1), F.when(F.col("what") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _edit(state: Column, cost: Column, letter: Column) -> Column:
    return F.struct((state["cost"] + cost).alias("cost"), F.concat(state["audit"], letter).alias("audit"))


def _inserted(at: Column) -> Column:
    """The four states after any number of inserted turns."""
    put = lambda s: _edit(s, F.lit(INSERT), F.lit("I"))
    user = F.least(at["s2"], put(at["s0"]), put(at["s1"]), put(at["s3"]))
    return _let(user, lambda u: F.struct(at["s0"].alias("s0"), at["s1"].alias("s1"), u.alias("s2"), F.least(at["s3"], put(u)).alias("s3")))


def _taken(at: Column, turn: Column) -> Column:
    """The four states after one turn is kept, reroled or deleted."""
    drop = lambda s: _edit(s, F.lit(DELETE), F.lit("D"))
    system = lambda s: _edit(s, turn["system_cost"], F.lit("K"))
    user = lambda s: _edit(s, turn["user_cost"], turn["user_edit"])
    assistant = lambda s: _edit(s, turn["assistant_cost"], turn["assistant_edit"])
    s0, s1, s2, s3 = (at[f"s{k}"] for k in range(4))
    return F.struct(
        drop(s0).alias("s0"), F.least(drop(s1), system(s0)).alias("s1"), F.least(drop(s2), user(s0), user(s1), user(s3)).alias("s2"), F.least(drop(s3), assistant(s2)).alias("s3")
    )


def flagged(rows: DataFrame) -> DataFrame:
    """Adds to each row its place ``at``, the initial of its role, its first fault, whether the pair with the row
    before is illegal, and whether it is the first row of its turn.

    Rows that are gone come last and have no faults. One shuffle by conv_id serves both windows.
    """
    ordered = W.partitionBy("conv_id").orderBy("gone", F.col("turn").asc_nulls_first(), "role", "text")
    placed = rows.withColumn("initial", F.substring("role", 1, 1)).withColumn("at", F.row_number().over(ordered)).withColumn("last", F.lag("initial").over(ordered)).withColumn("first", ~F.coalesce(F.lag("turn").over(ordered) == F.col("turn"), F.lit(False)))
    seen = F.row_number().over(W.partitionBy("conv_id", "gone", "role", "text").orderBy("at")) > 1
    fault = F.when(~F.col("text").rlike(_INK), "blank").when(seen, "duplicate").when(~F.col("text").rlike(_ENDS), "truncated")
    illegal = ~F.concat("last", "initial").isin("su", "ua", "au")
    return placed.select("*", F.when(~F.col("gone"), fault).alias("fault"), (~F.col("gone") & F.coalesce(illegal, F.lit(False))).alias("illegal"))


def _turn() -> Column:
    """What the fold needs of a turn, in the order of places."""
    dead, cut, never = F.col("fault").isin("blank", "duplicate"), F.when(F.col("fault") == "truncated", CUT).otherwise(0), F.lit(_NEVER)
    gone = F.coalesce(dead, F.lit(False))

    def to(initial: str) -> list[Column]:
        own = F.col("initial") == initial
        cost = F.when(gone, never).when(own, cut).otherwise(cut + REROLE).cast("long")
        name = {"u": "user", "a": "assistant"}[initial]
        return [cost.alias(f"{name}_cost"), F.when(own, "K").otherwise("R").alias(f"{name}_edit")]

    system = F.when(gone | (F.col("initial") != "s"), never).otherwise(cut).cast("long").alias("system_cost")
    return F.struct("at", "role", "text", system, *to("u"), *to("a"))


def repair_conversations(rows: DataFrame) -> DataFrame:
    """One row for each conv_id of ``rows`` (conv_id, turn, role, text, gone): faults, cost, audit and ``repaired``.

    ``repaired`` is an array of struct(role, text). gaps counts the turns that lack between the least and the
    largest turn. A conversation all of whose rows are gone has zeros, an empty audit and no repaired turns.
    Rows are taken by turn, null turns first, ties by role and text; a null id is a conversation of its own.
    Roles count by their first character; a role without one can't be kept. Other columns are ignored, and
    an empty table gives an empty result. A repeated row is a duplicate.

    The result has a conversation in one row, so one conversation is folded in one task.
    """
    here = ~F.col("gone")
    turn = F.when(here, F.col("turn"))
    per = flagged(rows.select("conv_id", "turn", "role", "text", "gone")).groupBy("conv_id").agg(
        F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_if(F.col("first") & turn.isNotNull()), F.lit(0)).cast("long").alias("gaps"),
        *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")], F.count_if(F.col("illegal")).alias("illegal"), F.sort_array(F.collect_list(F.when(here, _turn()))).alias("turns"),
    )
    start = F.struct(*[F.struct(F.lit(0 if k == 0 else _NEVER).cast("long").alias("cost"), F.lit("").alias("audit")).alias(f"s{k}") for k in range(4)])
    folded = F.aggregate("turns", _inserted(start), lambda at, turn: _let(_taken(at, turn), _inserted), lambda at: F.least(at["s0"], at["s3"]))
    per = per.withColumn("best", folded).select("*", "best.cost", "best.audit").drop("best")
    return per.withColumn("repaired", _repaired(F.col("audit"), F.col("turns"))).drop("turns")


def _repaired(audit: Column, turns: Column) -> Column:
    """The turns that the edits leave. Each piece of the audit is the insertions before a turn and the edit of that turn."""
    pieces = F.regexp_extract_all(audit, F.lit("I*[KRD]|I+"), F.lit(0))
    item = lambda role, text: F.struct(role.cast("string").alias("role"), text.alias("text"))
    none = F.lit(None)

    def left(piece: Column, i: Column) -> Column:
        turn, edit = F.get(turns, i), F.right(piece, F.lit(1))
        own = F.when(edit == "K", F.array(item(turn["role"], turn["text"]))).when(edit == "R", F.array(item(none, turn["text"])))
        own = F.coalesce(own, F.slice(F.array(item(none, F.lit(""))), 1, 0))
        return F.concat(F.array_repeat(item(none, F.lit("")), F.length(piece) - F.when(edit == "I", 0).otherwise(1)), own)

    def named(items: Column) -> Column:
        system = F.coalesce(F.substring(F.get(items, F.lit(0))["role"], 1, 1) == "s", F.lit(False)).cast("int")
        even = lambda j: (j - system) % 2 == 0
        return F.transform(items, lambda x, j: item(F.coalesce(x["role"], F.when(even(j), "user").otherwise("assistant")), x["text"]))

    return _let(F.flatten(F.transform(pieces, left)), named)


def repair_query(conversations: DataFrame) -> DataFrame:
    """The repair of the damaged conversations, with the repaired turns as a digest of ``role:text`` lines."""
    found = repair_conversations(damaged(conversations))
    lines = F.array_join(F.transform("repaired", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(lines, 256).alias("repaired_sha256"))
