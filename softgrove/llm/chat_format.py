"""Chat formatting by prefix-target expansion, in DataFrame functions only.

A turn is written ``<s>[INST]role[/INST]text</s>``. Inside roles and texts the
control strings are escaped: a backslash is put after the first character of
``<s>``, ``</s>``, ``[INST]`` and ``[/INST]``, and one more where backslashes
stand there already, so a control string of the output is always one of the
template's, and taking one backslash away gives the text back.

Every assistant turn becomes an example of its own: all preceding turns and
the turn's head are its context, and only the (escaped) reply is trainable.
A conversation that ends in other turns, or has no assistant turn, gets one
example more, all context and nothing to train on, so that no turn is lost.

A conversation is held once, as its formatted text with the places of its
replies; contexts are cut from it when the examples are exploded, so shuffles
carry each turn once. One conversation's text has to fit into a row.

Order: by turn, then role, then text (NULLs first); repeated rows are repeated
turns. A NULL role or text is empty. Rows whose conv_id is NULL are one
conversation. An empty table gives an empty result; other columns are passed by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, MIDDLE, END = "<s>[INST]", "[/INST]", "</s>"
_CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\]))"
_ESCAPED = r"([<\[])\\(\\*)(/?(?:s>|INST\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_CONTROL), F.lit(r"$1\\$2$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_ESCAPED), F.lit("$1$2$3"))


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, and replies: the place
    (start and end, code points) of each assistant text in it."""
    col = lambda c: F.col(f"`{c}`")
    rows = turns.select(col(conv_col).alias("conv_id"), F.struct(
        col(turn_col).alias("turn"), F.coalesce(col(role_col), F.lit("")).alias("role"),
        F.coalesce(col(text_col), F.lit("")).alias("text")).alias("t"))
    conv = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    parts = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(HEAD), escape(t.role), F.lit(MIDDLE)).alias("head"), escape(t.text).alias("body"),
        (t.role == trained_role).alias("trained")))
    conv = conv.select("conv_id", parts.alias("parts"))
    # running place of each body: one pass over the turns' lengths
    state = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start:int,end:int>>)").alias("replies"))

    def add(a, p):
        start = a.at + F.length(p.head)
        end = start + F.length(p.body)
        place = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + len(END)).alias("at"),
                        F.when(p.trained, F.concat(a.replies, place)).otherwise(a.replies).alias("replies"))

    return conv.select(
        "conv_id", F.array_join(F.transform("parts", lambda p: F.concat(p.head, p.body, F.lit(END))), "").alias("formatted"),
        F.aggregate("parts", state, add).replies.alias("replies"))


def explode_examples(formatted: DataFrame) -> DataFrame:
    """One row per example: conv_id, example (from 0), context, target (NULL
    in one without a reply), last (whether it holds all turns)."""
    size = F.length("formatted")
    tail = (F.size("replies") == 0) | (F.coalesce(F.try_element_at("replies", F.lit(-1)).end, F.lit(0)) + len(END) < size)
    none = F.struct(size.alias("start"), F.lit(None).cast("int").alias("end"))
    places = F.when(tail, F.concat("replies", F.array(none))).otherwise(F.col("replies"))
    rows = formatted.select("conv_id", "formatted", F.size(places).alias("n"), F.posexplode(places).alias("example", "place"))
    return rows.select(
        "conv_id", "example", F.expr("substring(formatted, 1, place.start)").alias("context"),
        F.expr("substring(formatted, place.start + 1, place.end - place.start)").alias("target"),
        (F.col("example") == F.col("n") - 1).alias("last"))


def example_text(context: Column, target: Column) -> Column:
    """The whole text of an example, closed where it has a reply."""
    return F.when(target.isNull(), context).otherwise(F.concat(context, target, F.lit(END)))


def read_turns(text: Column) -> Column:
    """The turns (role, text) of a formatted text."""
    pieces = F.split(text, F.lit(END), -1)
    own = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    return F.transform(own, lambda p: F.struct(
        unescape(F.substring_index(F.substr(p, F.lit(len(HEAD) + 1)), MIDDLE, 1)).alias("role"),
        unescape(F.substr(p, F.instr(p, F.lit(MIDDLE)) + len(MIDDLE))).alias("text")))


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation: its turns, the text under the loss mask (unescaped)
    and the characters of all examples, read from the examples."""
    text = example_text(F.col("context"), F.col("target"))
    rows = examples.select("conv_id", "example", "target", F.length(text).cast("long").alias("chars"),
                           F.when(F.col("last"), text).alias("whole"))
    conv = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("target").isNotNull(), F.struct("example", "target")))).alias("t"),
        F.sum("chars").alias("formatted_chars"), F.max("whole").alias("whole"))
    return conv.select("conv_id", read_turns(F.col("whole")).alias("turns"),
                       F.array_join(F.transform("t", lambda x: unescape(x.target)), "").alias("loss"), "formatted_chars")
