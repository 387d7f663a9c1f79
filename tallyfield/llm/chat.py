r"""Chat formatting with a grammar round trip.

Grammar (deterministic: both marks are control strings wherever they stand)::

    conversation = *turn
    turn         = "### " role ": " text "</turn>" LF

Control strings inside a role or text are escaped by one more backslash within
them (``</turn>`` -> ``<\/turn>``, ``### `` -> ``#\## ``, and in a role ``: `` ->
``:\ ``; ones that hold backslashes already get one more), and the parser takes
one away.  A turn is first rendered as it is and parsed again.  Only where that
doesn't give back its role and text is it escaped, and the escaped form must
then give them back: if any doesn't, the query fails rather than return it.

Only DataFrame functions: each turn is rendered on its own row, offsets come
from a running sum, and a conversation is put together once.

Behaviour: null roles and texts count as empty; rows with an equal turn number
are ordered by role, then text, and all kept; rows with a null conv_id form one
conversation; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

END = "</turn>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"<(\\*)/turn>", r"<\\$1/turn>"), r"#(\\*)## ", r"#\\$1## ")


def unescape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"#\\(\\*)## ", r"#$1## "), r"<\\(\\*)/turn>", r"<$1/turn>")


def escape_role(role: Column) -> Column:
    return F.regexp_replace(escape(role), r":(\\*) ", r":\\$1 ")


def unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, r":\\(\\*) ", r":$1 "))


def _rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("### "), role, F.lit(": "), text, F.lit(END))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>."""
    # what stands between marks: nothing, a turn, a line feed, a turn, ...
    turns = F.filter(F.split(formatted, "### |</turn>", -1), lambda x, i: i % 2 == 1)

    def turn(x: Column) -> Column:
        cut = F.instr(x, ": ")
        return F.struct(unescape_role(F.substring(x, F.lit(1), cut - 1)).alias("role"), unescape(F.substring(x, cut + 2, F.length(x))).alias("text"))

    return F.transform(turns, turn)


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """turns to (conv_id, formatted, loss_spans, n_escaped): one row a conversation; spans are (start from 0, length) of the loss role's texts in code points."""
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    raw = _rendered(F.col("role"), F.col("text"))
    source = F.array(F.struct("role", "text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("plain", parse(raw) == source)
    rows = rows.withColumn("role_out", F.when(F.col("plain"), F.col("role")).otherwise(escape_role(F.col("role")))).withColumn("text_out", F.when(F.col("plain"), F.col("text")).otherwise(escape(F.col("text"))))
    rows = rows.withColumn("out", _rendered(F.col("role_out"), F.col("text_out")))
    rows = rows.withColumn("out", F.when(F.col("plain") | (parse(F.col("out")) == source), F.col("out")).otherwise(F.raise_error(F.concat(F.lit("a turn does not survive the round trip in conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))))
    ends = F.sum(F.length("out")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    size = F.length("text_out")
    rows = rows.withColumn("span", F.when(F.col("role") == loss_role, F.struct((ends - len(END) - size).cast("long").alias("start"), size.cast("long").alias("length"))))
    parts = F.sort_array(F.collect_list(F.struct("place", "out", "span")))
    return (
        rows.groupBy("conv_id").agg(parts.alias("parts"), F.count_if(~F.col("plain")).alias("n_escaped"))
        .select("conv_id", F.array_join(F.transform("parts", lambda x: x["out"]), "").alias("formatted"), F.filter(F.transform("parts", lambda x: x["span"]), lambda x: x.isNotNull()).alias("loss_spans"), "n_escaped")
    )


def parse_conversations(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, ...) with turns: array<struct<role, text>>."""
    return formatted.withColumn("turns", parse(F.col("formatted")))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted text and its spans hold: the parsed turns, and the text under the loss mask."""
    under = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parse_conversations(formatted).withColumn("under", under).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode(lines, "UTF-8"), 256).alias("turns_sha256"),
        F.length("under").cast("long").alias("loss_chars"), F.sha2(F.encode("under", "UTF-8"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
