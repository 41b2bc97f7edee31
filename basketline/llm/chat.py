"""Chat formatting by prefix-target expansion.

Every assistant turn of a conversation becomes an example of its own: all turns up to it, in
order, of which only its text is trainable. Turns after the last assistant turn, and
conversations without one, are kept in one more example, of which nothing is trainable.

A turn is written as <|role|>, a line break, its text, </s> and a line break. Control strings
inside a text get a backslash after their first character, and those that look like an escape
already get one more, so that the text can be read back. In a role, the characters \\ | and line
breaks are escaped.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN_END = "</s>\n"
#: Control strings: <| <s> </s> [INST] [/INST], with the backslashes of earlier escapes.
_CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\])|\|)"
_ESCAPED = r"([<\[])\\(\\*)(/?(?:s>|INST\])|\|)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _escape_role(role: Column) -> Column:
    for plain, escaped in (("\\", "\\\\"), ("|", "\\p"), ("\n", "\\n")):
        role = F.replace(role, F.lit(plain), F.lit(escaped))
    return role


def _unescape_role(role: Column) -> Column:
    # An escaped backslash is two of them, and no other escape ends with one, so the pieces between are safe.
    def plain(piece: Column) -> Column:
        for escaped, own in (("\\p", "|"), ("\\n", "\n")):
            piece = F.replace(piece, F.lit(escaped), F.lit(own))
        return piece

    return F.array_join(F.transform(F.split(role, r"\\\\", -1), plain), "\\")


def examples(turns: DataFrame) -> DataFrame:
    """One row per assistant turn: conv_id, example (from 1), turns in it, formatted,
    loss_start and loss_length (code points of formatted, 0 long where nothing is trainable),
    whole (it holds every turn of the conversation).

    turns has conv_id, turn, role and text; other columns are not read. Turns come by turn, then
    role, then text, nulls first, so ties and repeated rows have one order and are all kept.
    Null roles and texts are empty; a null conv_id is a conversation like another. Without rows
    there are no examples. A conversation is one row here, so it must fit into a task's memory;
    its examples are made one by one.
    """
    given = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = given.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    heads = F.transform("turns", lambda t: F.concat(F.lit("<|"), _escape_role(t["role"]), F.lit("|>\n")))
    bodies = F.transform("turns", lambda t: escape(t["text"]))
    last = F.size("turns")
    targets = F.filter(F.sequence(F.lit(1), last), lambda i: (F.element_at("turns", i)["role"] == "assistant") | (i == last))
    parts = whole.select(
        "conv_id",
        heads.alias("heads"),
        bodies.alias("bodies"),
        F.transform("turns", lambda t: t["role"] == "assistant").alias("replies"),
        F.posexplode(targets).alias("place", "at"),
    )
    turn = F.transform(
        F.slice(F.arrays_zip("heads", "bodies"), F.lit(1), F.col("at")),
        lambda t: F.concat(t["heads"], t["bodies"], F.lit(TURN_END)),
    )
    body = F.element_at("bodies", F.col("at"))
    reply = F.element_at("replies", F.col("at"))
    rows = parts.select(
        "conv_id",
        (F.col("place") + 1).cast("long").alias("example"),
        F.col("at").cast("long").alias("turns"),
        F.array_join(turn, "").alias("formatted"),
        F.when(reply, F.length(body)).otherwise(0).cast("long").alias("loss_length"),
        (F.length(body) + len(TURN_END)).alias("_tail"),
        (F.col("at") == F.size("heads")).alias("whole"),
    )
    start = (F.length("formatted") - F.col("_tail")).cast("long")
    return rows.withColumn("loss_start", start).drop("_tail")


def read_turns(formatted: Column) -> Column:
    """The turns of an example: an array of structs with role and text."""
    pieces = F.split(formatted, TURN_END, -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        end = F.instr(piece, "|>\n")
        role = _unescape_role(F.substring(piece, F.lit(3), end - 3))
        return F.struct(role.alias("role"), unescape(F.substring(piece, end + 3, F.length(piece))).alias("text"))

    return F.transform(pieces, turn)


def read_target(formatted: Column, start: Column, length: Column) -> Column:
    """The trainable text of an example."""
    return unescape(F.substring(formatted, (start + 1).cast("int"), length.cast("int")))


def digests(rows: DataFrame) -> DataFrame:
    """Per conversation, read back from the examples: its turns and its trainable texts."""
    turns = F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = rows.select(
        "conv_id",
        "example",
        F.length("formatted").cast("long").alias("chars"),
        F.when(F.col("whole"), F.size(read_turns(F.col("formatted")))).cast("long").alias("n_turns"),
        F.when(F.col("whole"), F.sha2(F.encode(F.array_join(turns, ""), "UTF-8"), 256)).alias("turns_sha256"),
        read_target(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("loss"),
    )
    whole = read.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"),
        F.max("turns_sha256").alias("turns_sha256"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda e: e["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    return whole.select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
