"""Chat formatting by prefix-target expansion (operator 2).

Every assistant turn becomes an example of its own: all turns before it as
context, its reply as the only trainable text. A conversation that does not end
with an assistant turn gives one more example, with all turns and nothing to
train on, so that no turn is lost.

A turn is ``<|role|>`` newline, text, ``<|end|>`` newline. Inside a text a
backslash is doubled and ``<|`` becomes ``<\\|``, so no text can look like a
mark; both are undone when read back. In a role every bar and newline is
escaped as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
BACKSLASH, DOUBLED = "\\", "\\\\"
ESCAPED_OPEN = "<\\|"
ESCAPED_BAR, ESCAPED_NEWLINE = "\\p", "\\n"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit(BACKSLASH), F.lit(DOUBLED))
    return F.replace(doubled, F.lit(OPEN), F.lit(ESCAPED_OPEN))


def unescape(text: Column) -> Column:
    opened = F.replace(text, F.lit(ESCAPED_OPEN), F.lit(OPEN))
    return F.replace(opened, F.lit(DOUBLED), F.lit(BACKSLASH))


def escape_role(role: Column) -> Column:
    doubled = F.replace(role, F.lit(BACKSLASH), F.lit(DOUBLED))
    barred = F.replace(doubled, F.lit("|"), F.lit(ESCAPED_BAR))
    return F.replace(barred, F.lit("\n"), F.lit(ESCAPED_NEWLINE))


def unescape_role(role: Column) -> Column:
    """Doubled backslashes are set apart first, so that ``\\\\p`` is not taken for a bar."""
    pieces = F.split(role, r"\\\\", -1)
    plain = F.transform(
        pieces,
        lambda p: F.replace(F.replace(p, F.lit(ESCAPED_BAR), F.lit("|")), F.lit(ESCAPED_NEWLINE), F.lit("\n")),
    )
    return F.array_join(plain, BACKSLASH)


def conversations(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turns``: the turns of each conversation in order.

    Ties of the turn number are ordered by role, then text; a null turn number
    comes first; null roles and texts are empty. Rows without a conversation id
    belong together with nothing: each is a conversation of one turn.
    """
    one = F.struct(
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    rows = turns.select(F.col(conversation).cast("long").alias("conv_id"), one.alias("one"))
    named = rows.filter(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.array_sort(F.collect_list("one")).alias("turns"))
    return named.unionByName(rows.filter(F.col("conv_id").isNull()).select("conv_id", F.array("one").alias("turns")))


def expand(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Formatted examples: ``conv_id, example, n_turns, last, formatted, loss_start, loss_end``.

    ``example`` is the number of the target turn; the characters from
    ``loss_start`` up to ``loss_end`` (code points) are trainable; both are
    null for the example without a target. ``last`` marks the example that
    holds the whole conversation. No turns give no rows. A conversation of n
    turns gives up to n examples of up to n turns: the square is the method's.
    """
    formed = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit(CLOSE)).alias("head"),
            escape(t["text"]).alias("body"),
            (t["role"] == "assistant").alias("target"),
        ),
    )
    held = conversations(turns, conversation, turn, role, text).select("conv_id", formed.alias("turns"), F.size("turns").alias("n"))
    targets = F.filter(
        F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("turns", i)["target"] | (i == F.col("n") - 1)
    )
    each = held.select("conv_id", "turns", "n", F.explode(targets).alias("example"))
    before = F.array_join(
        F.transform(F.slice("turns", 1, F.col("example")), lambda t: F.concat(t["head"], t["body"], F.lit(END))), ""
    )
    own = F.get("turns", F.col("example"))
    placed = each.select(
        "conv_id",
        "example",
        (F.col("example") + 1).alias("n_turns"),
        (F.col("example") == F.col("n") - 1).alias("last"),
        F.concat(before, own["head"]).alias("context"),
        own["body"].alias("body"),
        own["target"].alias("target"),
    )
    start = F.when(F.col("target"), F.length("context").cast("long"))
    return placed.select(
        "conv_id",
        "example",
        "n_turns",
        "last",
        F.concat("context", "body", F.lit(END)).alias("formatted"),
        start.alias("loss_start"),
        (start + F.length("body")).alias("loss_end"),
    )


def read_turns(formatted: Column) -> Column:
    """Turns of a formatted text, as an array of ``role, text``."""
    pieces = F.split(formatted, r"<\|end\|>\n", -1)
    filled = F.slice(pieces, 1, F.size(pieces) - 1)
    cut = F.lit(len(OPEN) + 1)

    def turn(piece: Column) -> Column:
        at = F.locate(CLOSE, piece)
        return F.struct(
            unescape_role(F.substring(piece, cut, at - cut)).alias("role"),
            unescape(F.substring(piece, at + len(CLOSE), F.length(piece))).alias("text"),
        )

    return F.transform(filled, turn)


def read_back(examples: DataFrame) -> DataFrame:
    """``conv_id, turns, replies, formatted_chars`` of each conversation, read from its examples.

    Rows without a conversation id stay one row each.
    """
    masked = F.substring("formatted", F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int"))
    parsed = examples.select(
        "conv_id",
        "example",
        F.when(F.col("last"), read_turns(F.col("formatted"))).alias("turns"),
        unescape(masked).alias("reply"),
        F.length("formatted").cast("long").alias("chars"),
    )
    replies = F.array_sort(F.collect_list(F.when(F.col("reply").isNotNull(), F.struct("example", "reply"))))
    named = (
        parsed.filter(F.col("conv_id").isNotNull())
        .groupBy("conv_id")
        .agg(F.max("turns").alias("turns"), replies.alias("replies"), F.sum("chars").alias("formatted_chars"))
        .withColumn("replies", F.transform("replies", lambda r: r["reply"]))
    )
    single = parsed.filter(F.col("conv_id").isNull()).select(
        "conv_id", "turns", F.filter(F.array("reply"), lambda r: r.isNotNull()).alias("replies"), F.col("chars").alias("formatted_chars")
    )
    return named.unionByName(single)
