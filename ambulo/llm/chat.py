"""Chat formatting with Spark expressions only.

Template: ``<s>``, then one block for each run of turns of one role, in order:
``[SYS]...[/SYS]``, ``[INST]...[/INST]`` (user), ``[ANS]...</s>`` (assistant)
or ``[ROLE]name[SAYS]...[/ROLE]`` (any other role).  Turns merged in a block
stand apart by ``[NEXT]``.  A control string inside a text, or such a string
that is already escaped, gets one more backslash behind its first bracket, so
escaping can be undone.  Loss is taken on the texts of assistant turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ambulo.llm.common import once

#: The control strings, once with room for backslashes behind the bracket.
SQUARE = r"\[(\\*)(/?(?:SYS|INST|ROLE)|ANS|SAYS|NEXT)\]"
ANGLE = r"<(\\*)(/?s)>"
SQUARE_ESCAPED = r"\[\\(\\*)(/?(?:SYS|INST|ROLE)|ANS|SAYS|NEXT)\]"
ANGLE_ESCAPED = r"<\\(\\*)(/?s)>"
BLOCK = r"(?s)\[(?:SYS|INST|ANS|ROLE)\].*?(?:\[/SYS\]|\[/INST\]|\[/ROLE\]|</s>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, SQUARE, r"[\\$1$2]"), ANGLE, r"<\\$1$2>")


def unescape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, SQUARE_ESCAPED, "[$1$2]"), ANGLE_ESCAPED, "<$1$2>")


def opening(role: Column) -> Column:
    """role is escaped already."""
    return (
        F.when(role == "user", "[INST]").when(role == "assistant", "[ANS]").when(role == "system", "[SYS]").otherwise(F.concat(F.lit("[ROLE]"), role, F.lit("[SAYS]")))
    )


def closing(role: Column) -> Column:
    return F.when(role == "user", "[/INST]").when(role == "assistant", "</s>").when(role == "system", "[/SYS]").otherwise("[/ROLE]")


def format_chats(turns: DataFrame) -> DataFrame:
    """One formatted text for each conversation of turns (conv_id, turn, role, text, ...).

    Returns conv_id, n_turns, formatted and segments, an array of (text, loss)
    whose texts make up formatted; loss marks what is trained on: the text of
    each assistant turn, escaped, one segment a turn.

    Turns are sorted by turn, then role, then text, nulls first; repeated rows
    stay.  A null text counts as empty, a null role as the role named by the
    empty string, null conv_ids as one conversation.  An empty table gives an
    empty result; other columns are ignored.  A conversation is one value of
    the result, so its rows meet in one task; it can't exceed Spark's 2 GB for
    a value.
    """
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    collected = rows.groupBy("conv_id").agg(F.collect_list("t").alias("t"))
    escaped = F.transform(F.sort_array("t"), lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text")))
    sorted_turns = once(collected, "turns", escaped).drop("t")
    n = F.size("turns")
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]))
    runs = once(sorted_turns.withColumn("n_turns", n.cast("long")), "starts", starts)

    def block(i: Column, k: Column) -> Column:
        """The segments of the k-th run, which starts at turn i."""
        size = F.coalesce(F.get("starts", k + 1), F.size("turns")) - i
        role = F.get("turns", i)["role"]
        loss = role == "assistant"
        texts = F.transform(
            F.slice("turns", i + 1, size),
            lambda t, j: F.array(F.struct(F.when(j > 0, "[NEXT]").otherwise("").alias("text"), F.lit(False).alias("loss")), F.struct(t["text"].alias("text"), loss.alias("loss"))),
        )
        edge = lambda x: F.array(F.struct(x.alias("text"), F.lit(False).alias("loss")))
        return F.concat(edge(opening(role)), F.flatten(texts), edge(closing(role)))

    start = F.array(F.struct(F.lit("<s>").alias("text"), F.lit(False).alias("loss")))
    segments = F.filter(F.concat(start, F.flatten(F.transform("starts", block))), lambda s: (s["text"] != "") | s["loss"])
    formed = once(runs, "segments", segments)
    return formed.select("conv_id", "n_turns", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_chats(formatted: DataFrame) -> DataFrame:
    """The turns of formatted texts: keeps all columns and adds read_turns, an array of (role, text)."""

    def turns_of(b: Column) -> Column:
        body = F.regexp_replace(b, r"(?s)\A\[(?:SYS|INST|ANS)\]|\A\[ROLE\].*?\[SAYS\]|(?:\[/SYS\]|\[/INST\]|\[/ROLE\]|</s>)\z", "")
        role = (
            F.when(b.startswith("[INST]"), "user").when(b.startswith("[ANS]"), "assistant").when(b.startswith("[SYS]"), "system").otherwise(unescape(F.regexp_extract(b, r"(?s)\A\[ROLE\](.*?)\[SAYS\]", 1)))
        )
        return F.transform(F.split(body, r"\[NEXT\]", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    blocks = F.regexp_extract_all("formatted", F.lit(BLOCK), F.lit(0))
    return once(formatted, "read_turns", F.flatten(F.transform(blocks, turns_of)))


def chat_digests(formatted: DataFrame) -> DataFrame:
    """Digests of what is read back from formatted texts and their loss masks."""
    # Each segment is unescaped by itself: two texts that meet could form a control string.
    loss = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    read = read_chats(formatted).withColumn("loss_text", F.array_join(loss, ""))
    lines = F.array_join(F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("read_turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
