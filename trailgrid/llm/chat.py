"""Chat formatting in budgeted windows, with DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BEGIN, END = "<|im_start|>", "<|im_end|>\n"
BUDGET = 1024
HISTORY = 192
TURN_TOKENS = 4
WORD = r"[^\x20\x09-\x0D]+"
SYSTEM, TARGET = "system", "assistant"
#: Control strings and their escapes; the backslash first, so that it always starts one.
ESCAPES = (("\\", "\\b"), ("<|", "\\c"), ("</s>", "\\e"), ("<s>", "\\s"), ("[INST]", "\\i"), ("[/INST]", "\\j"))
LINE_ESCAPE = ("\n", "\\n")


def escaped(text: Column, escapes=ESCAPES) -> Column:
    """``text`` without any control string; ``unescaped`` gives it back."""
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), escapes, text)


def unescaped(text: Column, escapes=ESCAPES) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[1]), F.lit(e[0])), reversed(escapes), text)


ROLE_ESCAPES = (*ESCAPES, LINE_ESCAPE)


def token_count(text: Column) -> Column:
    """Words and the marks of a turn: what a window's budget is counted in."""
    return F.regexp_count(text, F.lit(WORD)) + TURN_TOKENS


def placed_turns(turns: DataFrame, conv: str, turn: str, role: str, text: str, budget: int, history: int) -> DataFrame:
    """(conv, pos, role, text, head, begin, window): every turn in its window.

    ``begin`` is the running sum of tokens before a turn, the leading system turn left out. The
    room of a window, which is the budget less the system turn and the history, cuts the running
    sum into blocks. A turn that begins and ends in one block belongs to its window, and one that
    runs over the end has a window of its own. So every window is turn-aligned and within the
    budget unless one turn alone is not; turns are never cut.
    """
    rows = turns.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    whole = Window.partitionBy("conv")
    rows = rows.withColumn("pos", F.row_number().over(order)).withColumn("tokens", token_count(F.col("text")).cast("long"))
    rows = rows.withColumn("head", (F.col("pos") == 1) & (F.col("role") == SYSTEM))
    rows = rows.withColumn("fixed", F.sum(F.when(F.col("head"), F.col("tokens")).otherwise(0)).over(whole))
    through = F.sum(F.when(F.col("head"), 0).otherwise(F.col("tokens"))).over(Window.partitionBy("conv").orderBy("pos"))
    rows = rows.withColumn("through", through).withColumn("begin", F.col("through") - F.when(F.col("head"), 0).otherwise(F.col("tokens")))
    room = F.greatest(F.lit(budget) - F.col("fixed") - F.lit(history), F.lit(1))
    block = F.floor(F.col("begin") / room)
    own = 2 * block + (F.col("through") > (block + 1) * room).cast("long")
    rows = rows.withColumn("at", F.when(~F.col("head"), own))
    rows = rows.withColumn("at", F.coalesce("at", F.min("at").over(whole), F.lit(0).cast("long")))
    return rows.withColumn("window", F.dense_rank().over(Window.partitionBy("conv").orderBy("at")))


def windows(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
            budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv, window, formatted, loss, repeated): the training texts of every conversation.

    Each window shows the system turn, then as many whole turns before its first as fit in
    ``history`` tokens, then its own turns. ``repeated`` counts the leading turns that stand in an
    earlier window already. ``loss`` lists (start, end) in code points of the assistant texts to
    learn; repeated ones are masked, so each is learnt once. Turns go by ``turn``, ties by role and
    text; null roles and texts count as empty; repeated rows are turns of their own; a null
    conversation id is one conversation. A conversation's turns meet in one task, since its texts
    form one sequence; the history before a turn is bounded by its tokens.
    """
    rows = placed_turns(turns, conv, turn, role, text, budget, history)
    kept = F.struct("pos", "role", "text", F.lit(False).alias("target"))
    before = Window.partitionBy("conv").orderBy("begin").rangeBetween(-history, -1)
    rows = rows.withColumn("past", F.collect_list(F.when(~F.col("head"), kept)).over(before))
    rows = rows.withColumn("system", F.max(F.when(F.col("head"), kept)).over(Window.partitionBy("conv")))
    own = F.struct("pos", "role", "text", (F.col("role") == TARGET).alias("target"), "past", "system", "head")
    grouped = rows.groupBy("conv", "window").agg(F.sort_array(F.collect_list(own)).alias("own"))
    first = F.col("own")[0]
    lead = F.when(first["head"], F.array().cast("array<struct<pos:int,role:string,text:string,target:boolean>>")).otherwise(
        F.concat(F.filter(F.array(first["system"]), lambda t: t.isNotNull()), F.sort_array(first["past"])))
    shown = F.transform("own", lambda t: F.struct(t["pos"].alias("pos"), t["role"].alias("role"), t["text"].alias("text"), t["target"].alias("target")))
    listed = grouped.select("conv", "window", F.concat(lead, shown).alias("turns"), F.size(lead).alias("repeated"))
    parts = listed.select("conv", "window", "repeated", F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(BEGIN), escaped(t["role"], ROLE_ESCAPES), F.lit("\n")).alias("opening"), escaped(t["text"]).alias("body"), t["target"].alias("target"),
    )).alias("parts"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss"))

    def step(acc, p):
        begin = acc["at"] + F.length(p["opening"])
        end = begin + F.length(p["body"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + len(END)).alias("at"), F.when(p["target"], F.concat(acc["loss"], span)).otherwise(acc["loss"]).alias("loss"))

    return parts.select(
        F.col("conv").alias(conv), "window",
        F.array_join(F.transform("parts", lambda p: F.concat(p["opening"], p["body"], F.lit(END))), "").alias("formatted"),
        F.aggregate("parts", start, step)["loss"].alias("loss"), "repeated",
    )


def read_back(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, turns, learnt, chars): what the windows say, read from their text and masks alone.

    ``turns`` lists (role, text) once each in order, ``learnt`` all text under the mask, unescaped,
    ``chars`` the length of all windows.
    """
    pieces = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda p: p != "")
    new = F.slice(pieces, F.col("repeated") + 1, F.greatest(F.size(pieces) - F.col("repeated"), F.lit(0)))
    parsed = F.transform(new, lambda p: F.struct(
        unescaped(F.substring_index(p, "\n", 1), ROLE_ESCAPES).alias("role"),
        unescaped(F.substr(p, F.instr(p, "\n") + 1, F.length(p) - F.instr(p, "\n") - len(END))).alias("text"),
    ))
    learnt = F.array_join(F.transform("loss", lambda s: unescaped(F.substr(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))), "")
    rows = formatted.select(F.col(conv).alias("conv"), "window", parsed.alias("turns"), learnt.alias("learnt"), F.length("formatted").cast("long").alias("chars"))
    gathered = rows.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("window", "turns", "learnt"))).alias("w"), F.sum("chars").alias("chars"))
    return gathered.select(F.col("conv").alias(conv), F.flatten(F.col("w.turns")).alias("turns"), F.array_join(F.col("w.learnt"), "").alias("learnt"), "chars")
