r"""Chat formatting with a grammar round trip.

A turn is rendered as `<|im_start|>role`, a line end, the text, `<|im_end|>` and a line end.  A text
or role may itself hold these control strings.  It is escaped by doubling every backslash and
putting one inside every control opening (`<|` becomes `<\|`), which no unescaped text can undo, so
`<|` in a rendered conversation is always a control string.  A role's line end is escaped as `\n`.

The rendered conversation is parsed again: split at `<|im_start|>`, each piece at its first line
end into role and text, the text ended by `<|im_end|>`.  Texts are escaped only where the parse of
the plain rendering differs from the source, so ordinary conversations are rendered as they are;
a second parse of what was escaped must give the source again, and the column identical says so.

The loss mask is written in runs over the rendered string, one struct a turn: `skip` code points
without loss, then `take` with loss (an assistant's text as rendered), then `rest` without.  The runs
add up to the length of the string.  `under_mask` reads the texts with loss from string and mask alone.

Defined results: null texts and roles are empty; turns are ordered by turn (nulls first), then
role, then text; repeated rows are turns of their own; a null conv_id is a conversation; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"
#: Control strings begin with this pair.
OPENING = "<|"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(OPENING), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _plain_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def escape_role(role: Column) -> Column:
    return F.replace(_plain_role(role), F.lit(OPENING), F.lit("<\\|"))


def unescape_role(role: Column) -> Column:
    # "\\n" after an escaped backslash is not a line end: split at escaped backslashes first
    parts = F.split(role, r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\"), F.lit(""))), "\\")


def render(turns: Column) -> Column:
    """One string from an array of structs (role, text)."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END + "\n"))), "")


def pieces_of(rendered: Column) -> Column:
    """What follows each turn's start, in order."""
    return F.filter(F.split(rendered, r"<\|im_start\|>"), lambda p: p != "")


def loss_mask(source: Column, rendered: Column) -> Column:
    """Runs (skip, take, rest) of each turn; rendered: the turns of source as they are written."""

    def runs(turn: Column, written: Column) -> Column:
        trained, chars = turn["role"] == TRAINED, F.length(written["text"])
        return F.struct(
            (F.length(written["role"]) + len(START) + 1 + F.when(trained, 0).otherwise(chars)).alias("skip"),
            F.when(trained, chars).otherwise(0).alias("take"),
            F.lit(len(END) + 1).alias("rest"),
        )

    return F.zip_with(source, rendered, runs)


def under_mask(rendered: Column, mask: Column) -> Column:
    """The unescaped text under the loss mask of each turn, empty for a turn without loss."""
    return F.zip_with(pieces_of(rendered), mask, lambda p, m: unescape(F.substr(p, m["skip"] - len(START) + 1, m["take"])))


def parse(rendered: Column) -> Column:
    """The turns a reader of the format sees: array of structs (role, text)."""
    pieces = pieces_of(rendered)

    def turn(piece: Column) -> Column:
        at = F.locate("\n", piece)
        body = F.substr(piece, at + F.lit(1))
        return F.struct(
            F.when(at > 0, F.substr(piece, F.lit(1), at - 1)).otherwise(piece).alias("role"),
            F.when(at > 0, F.split(body, r"<\|im_end\|>", 2)[0]).otherwise(F.lit("")).alias("text"),
        )

    return F.transform(pieces, turn)


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_mask, escaped, turns (parsed back from formatted, unescaped), identical."""
    source = turns.select(
        "conv_id",
        F.struct(
            "turn",
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    grouped = source.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    pairs = grouped.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    plain = pairs.withColumn("plain", render(F.col("source")))
    # The plain rendering stands if it parses to the source and reading it as escaped text changes nothing.
    conflict = F.contains(F.array_join(F.flatten(F.transform("source", lambda t: F.array(t["role"], t["text"]))), ""), F.lit("\\")) | (
        parse(F.col("plain")) != F.col("source")
    )
    tried = plain.withColumn("escaped", conflict)
    escaped = F.transform("source", lambda t: F.struct(escape_role(t["role"]).alias("role"), escape(t["text"]).alias("text")))
    written = tried.withColumn("written", F.when(F.col("escaped"), escaped).otherwise(F.col("source")))
    formatted = written.withColumn("formatted", render(F.col("written"))).withColumn("loss_mask", loss_mask(F.col("source"), F.col("written")))
    back = formatted.withColumn("parsed", parse(F.col("formatted")))
    unescaped = F.transform("parsed", lambda t: F.struct(unescape_role(t["role"]).alias("role"), unescape(t["text"]).alias("text")))
    # A plain rendering holds no backslash, so unescaping leaves it alone: a reader needs no flag.
    read = back.withColumn("turns", unescaped)
    return read.select("conv_id", "formatted", "loss_mask", "escaped", "turns", (F.col("turns") == F.col("source")).alias("identical"))
