"""Chat formatting in budgeted windows, in DataFrame operations only.

A turn is written as `### <role>:\n<text>\n</turn>\n`. Inside roles and texts the control strings
`</turn>` and `###`, the `:` of a role and the escape character itself are escaped with a backslash,
so that parsing gives back every character.

Windows: prefix sums of the turns' tokens divide a conversation into cells. A cell is what the system
turn and the history leave of the budget; where the system turn leaves little, history gets half of that at most.
The turns that lie inside a cell make one window, a turn that crosses a cell's end makes its own. So
windows consist of whole turns and follow from sums alone (no turn waits for the choice of the one
before it). Each window starts with the conversation's first system turn, if it doesn't hold it, and
repeats the turns that begin at most `history` tokens before it, as far as the budget goes: history gives way
first. A window exceeds the budget only where the system turn and one own turn do. Repeated
turns are never under the loss mask; every assistant turn is under the mask of one window exactly.

The prefix sums are taken in two levels (blocks of turn numbers, then blocks of a conversation), so a
conversation with a third of all rows isn't summed in one task. Turns that share a number, or have none, share a block.

Null texts and roles count as empty, null conversations form one of their own, turns are ordered by
(turn, role, text) with nulls first, repeated rows stay repeated turns. An empty table gives none.
`digests` hashes a conversation as one value, which Spark bounds by 2 GB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

#: Tokens of a window, and of the history that a window repeats.
BUDGET, HISTORY = 1024, 128
#: Turn numbers that make one block of the prefix sums.
BLOCK_TURNS = 64
#: A token, as far as budgets are concerned: a run of letters and digits, or another visible character.
TOKEN = r"[\p{L}\p{N}]+|[^\x09-\x0D\x20\p{L}\p{N}]"
#: Tokens of the marks around a turn.
MARKS = 8


def escape(col: Column, role: bool = False) -> Column:
    """Escape control strings; `unescape` gives the text back."""
    out = F.replace(col, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("</turn>"), F.lit("<\\/turn>"))
    out = F.regexp_replace(out, F.lit("#(?=##)"), F.lit("#\\\\"))
    return F.replace(out, F.lit(":"), F.lit("\\:")) if role else out


def unescape(col: Column) -> Column:
    return F.regexp_replace(col, F.lit(r"\\([\\/#:])"), F.lit("$1"))


def turn_piece(role: Column, text: Column) -> Column:
    return F.concat(F.lit("### "), escape(role, role=True), F.lit(":\n"), escape(text), F.lit("\n</turn>\n"))


def parse_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted window."""
    pieces = F.split(formatted, F.lit("\n</turn>\n"))
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    head = r"(?s)^### ([^\\:]*(?:\\.[^\\:]*)*):\n(.*)\z"
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.regexp_extract(p, head, 1)).alias("role"), unescape(F.regexp_extract(p, head, 2)).alias("text")
        ),
    )


def _measured(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, role, text, ord (place in the conversation), tok, upto (tokens before the turn)."""
    rows = df.select(
        F.col(conv).alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("tok", (F.regexp_count("text", F.lit(TOKEN)) + MARKS).cast("long"))
    rows = rows.withColumn("block", F.floor(F.col("turn") / BLOCK_TURNS))
    local = Window.partitionBy("conv", "block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ord", F.count(F.lit(1)).over(local)).withColumn("upto", F.coalesce(F.sum("tok").over(local), F.lit(0)))
    across = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("tok").alias("t"))
    blocks = blocks.select(
        F.col("conv").alias("c"),
        F.col("block").alias("b"),
        F.coalesce(F.sum("n").over(across), F.lit(0)).alias("n0"),
        F.coalesce(F.sum("t").over(across), F.lit(0)).alias("t0"),
    )
    both = rows.join(blocks, rows.conv.eqNullSafe(blocks.c) & rows.block.eqNullSafe(blocks.b))
    return both.select("conv", "role", "text", "tok", (F.col("ord") + F.col("n0")).alias("ord"), (F.col("upto") + F.col("t0")).alias("upto"))


def windows(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", budget: int = BUDGET, history: int = HISTORY, target: str = "assistant"
) -> DataFrame:
    """One row per window: conv, window (order of its first own turn), formatted, n_context (leading repeated turns),
    loss array<struct<from, to>> (code-point spans of formatted, from 0, to exclusive), tokens."""
    turns = cut(_measured(df, conv, turn, role, text))
    system = turns.where("role = 'system'").groupBy("conv").agg(F.min(F.struct("ord", "tok", "text")).alias("sys"))
    system = system.select(F.col("conv").alias("sc"), "sys")
    turns = turns.join(system, turns.conv.eqNullSafe(system.sc), "left").drop("sc")
    # What the system turn leaves of the budget, and the part of it that a cell's own turns may fill.
    left = F.greatest(F.lit(0), F.lit(budget) - F.coalesce(F.col("sys.tok"), F.lit(0)))
    room = F.greatest(F.lit(1), left - F.least(F.lit(history), F.floor(left / 2)))
    turns = turns.withColumn("left", left.cast("long")).withColumn("room", room.cast("long"))
    cell, end = F.floor(F.col("upto") / F.col("room")), F.floor((F.col("upto") + F.col("tok") - 1) / F.col("room"))
    turns = turns.withColumn("cell", cell).withColumn("across", end > cell)
    starts = turns.groupBy("conv", "cell", "across").agg(
        F.min("ord").alias("window"),
        F.min("upto").alias("start"),
        # Tokens of history that fit beside the system turn, which counts once, and the own turns.
        (F.max("left") - F.sum("tok") + F.coalesce(F.max(F.when(F.col("ord") == F.col("sys.ord"), F.col("tok"))), F.lit(0))).alias("spare"),
    )
    starts = cut(starts.withColumn("spare", F.least(F.lit(history), F.col("spare"))))

    own = turns.join(
        starts.select(F.col("conv").alias("c"), F.col("cell").alias("l"), F.col("across").alias("a"), "window"),
        turns.conv.eqNullSafe(F.col("c")) & (turns.cell == F.col("l")) & (turns.across == F.col("a")),
    ).select("conv", "window", "ord", "role", "text", "tok", F.lit(2).alias("kind"), (F.col("ord") == F.col("sys.ord")).alias("holds"))

    # A repeated turn begins at most `history` tokens before the windows that repeat it: they start in these cells.
    past = turns.where((F.col("tok") <= history) & (F.col("tok") < F.col("left"))).withColumn("past", F.col("upto") + F.col("tok"))
    reach = F.sequence(F.floor(F.col("past") / F.col("room")), F.floor((F.col("upto") + history) / F.col("room")))
    past = past.withColumn("at", F.explode(reach))
    marks = starts.where("spare > 0").select(F.col("conv").alias("c"), F.col("cell").alias("l"), F.col("window").alias("w"), "start", "spare")
    again = past.join(
        marks,
        past.conv.eqNullSafe(marks.c) & (past["at"] == marks.l) & (marks.start >= past.past) & (marks.start <= past.upto + marks.spare),
    )
    again = again.where(F.col("sys.ord").isNull() | (F.col("ord") != F.col("sys.ord")))
    again = again.select("conv", F.col("w").alias("window"), "ord", "role", "text", "tok", F.lit(1).alias("kind"))

    # The system turn heads every window but the one whose own turn it is.
    place = ["conv", "window", F.col("sys.ord").alias("ord"), F.lit("system").alias("role"), F.col("sys.text").alias("text"), F.col("sys.tok").alias("tok")]
    heads = starts.join(system, starts.conv.eqNullSafe(system.sc)).select(*place, F.lit(0).alias("kind"))
    held = own.where(F.col("holds")).select(F.col("conv").alias("hc"), F.col("window").alias("hw"))
    heads = heads.join(held, heads.conv.eqNullSafe(held.hc) & (heads.window == held.hw), "left_anti")
    return _assembled(own.drop("holds").unionByName(again).unionByName(heads), target)


def _assembled(rows: DataFrame, target: str) -> DataFrame:
    """Windows from their turns. kind 0: system turn in front, 1: repeated, 2: the window's own."""
    rows = rows.withColumn("piece", turn_piece(F.col("role"), F.col("text")))
    order = Window.partitionBy("conv", "window").orderBy("kind", "ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(order), F.lit(0)))
    begin = F.col("at") + F.length(F.concat(F.lit("### "), escape(F.col("role"), role=True), F.lit(":\n")))
    span = F.struct(begin.cast("long").alias("from"), (begin + F.length(escape(F.col("text")))).cast("long").alias("to"))
    learnt = (F.col("kind") == 2) & (F.col("role") == target)
    out = rows.groupBy("conv", "window").agg(
        F.array_sort(F.collect_list(F.struct("kind", "ord", "piece"))).alias("pieces"),
        F.array_sort(F.collect_list(F.when(learnt, span))).alias("loss"),
        F.count_if(F.col("kind") < 2).cast("int").alias("n_context"),
        F.sum("tok").alias("tokens"),
    )
    formatted = F.array_join(F.transform("pieces", lambda p: p["piece"]), "")
    return out.select("conv", "window", formatted.alias("formatted"), "n_context", "loss", "tokens")


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows: turns and loss text, counted and hashed."""
    own = F.expr("slice(turns, n_context + 1, size(turns) - n_context)")
    df = formatted.withColumn("turns", parse_turns(F.col("formatted"))).withColumn("turns", own)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    under = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["from"] + 1).cast("int"), (s["to"] - s["from"]).cast("int"))))
    df = df.select(
        "conv", "window", F.size("turns").alias("n"), said.alias("said"), F.array_join(under, "").alias("learnt"), F.length("formatted").alias("chars")
    )
    df = df.groupBy("conv").agg(
        F.sum("n").alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("window", "said", "learnt"))).alias("parts"),
        F.sum("chars").alias("formatted_chars"),
    )
    learnt = F.array_join(F.transform("parts", lambda p: p["learnt"]), "")
    said = F.array_join(F.transform("parts", lambda p: p["said"]), "")
    return df.select(
        F.col("conv").alias("conv_id"),
        F.col("n_turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt.cast("binary"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
