"""Chat formatting with a grammar that is parsed back until it returns the source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: conversation := "<s>" turn* "</s>"
#: turn := "[" NAME "]" text "[/" NAME "]" for the roles below, else "[ROLE]" role "[TEXT]" text "[/ROLE]"
#: Neither text nor role holds a control string; an escaped one has a backslash behind its first character.
BEGIN, END = "<s>", "</s>"
NAMES = {"user": "INST", "assistant": "ANS", "system": "SYS"}
OTHER, SPLIT = "ROLE", "[TEXT]"
_MARK = "(?:INST|ANS|SYS|ROLE)"
#: All control strings, by what follows their first character.
_TAILS = (("<", r"/?s>"), ("[", rf"(?:/?{_MARK}|TEXT)\]"))
CONTROL = "|".join(rf"\{first}{tail}" for first, tail in _TAILS)
_CLOSE, _OPEN = rf"\[/{_MARK}\]", rf"^\[({_MARK[3:-1]})\]"


def escape(text: Column) -> Column:
    """One more backslash in each control string and in each that looks like an escaped one."""
    for first, tail in _TAILS:
        text = F.regexp_replace(text, rf"\{first}(\\*{tail})", rf"\{first}\\$1")
    return text


def unescape(text: Column) -> Column:
    for first, tail in _TAILS:
        text = F.regexp_replace(text, rf"\{first}\\(\\*{tail})", rf"\{first}$1")
    return text


def render(role: Column, text: Column, code=lambda x: x) -> tuple[Column, Column, Column]:
    """A turn's head, body and tail."""
    head, tail = F.concat(F.lit(f"[{OTHER}]"), code(role), F.lit(SPLIT)), F.lit(f"[/{OTHER}]")
    for name, mark in NAMES.items():
        head = F.when(role == name, F.lit(f"[{mark}]")).otherwise(head)
        tail = F.when(role == name, F.lit(f"[/{mark}]")).otherwise(tail)
    return head, code(text), tail


def parse(text: Column) -> Column:
    """The turns (role, text) that a rendered conversation holds.

    Turns end at the first closing string; what precedes it is an opening
    string and an escaped text. What doesn't fit, be it for a control string
    where a text should be, has a null role, which no source has.
    """
    inner = F.substr(text, F.lit(len(BEGIN) + 1), F.char_length(text) - len(BEGIN) - len(END))
    pieces = F.split(inner, _CLOSE)
    # The piece behind the last closing string must be empty.
    whole = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    turns = F.when(F.element_at(pieces, -1) == "", whole).otherwise(pieces)

    def one(piece: Column) -> Column:
        name = F.regexp_extract(piece, _OPEN, 1)
        rest = F.substr(piece, F.char_length(name) + 3)
        role: Column = F.lit(None).cast("string")
        for known, mark in NAMES.items():
            role = F.when(name == mark, F.lit(known)).otherwise(role)
        cut = F.when(name == OTHER, F.instr(rest, SPLIT)).otherwise(F.lit(0))
        shown = F.substr(rest, F.lit(1), cut - 1)
        role = F.when((cut > 0) & ~F.rlike(shown, F.lit(CONTROL)), unescape(shown)).otherwise(role)
        body = F.when(cut > 0, F.substr(rest, cut + len(SPLIT))).otherwise(rest)
        return F.struct(F.when(~F.rlike(body, F.lit(CONTROL)), role).alias("role"), unescape(body).alias("text"))

    return F.transform(turns, one)


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, escaped, loss_spans, round_trip) of each conversation of ``rows`` (conv_id, turn, role, text).

    Turns are in order of turn (null first), role and text; repeated rows are
    turns of their own. Null texts and roles count as empty. Each turn is
    rendered as it is and parsed back; where that doesn't return the turn, its
    control strings are escaped, and those alone, so that no text or role in
    the output holds one. ``escaped`` says that some turn was. Then the whole
    is parsed: ``round_trip`` says that it returns the source. One round of
    escaping always does, since unescaping takes away what escaping adds.
    ``loss_spans`` are (start, chars) of the assistants' texts, from 1.

    Rows with a null conv_id are one conversation. Turns are rendered row by
    row, wherever they lie; one output string holds one conversation, whatever
    its length, and the time it takes grows in proportion to it. Columns
    other than the four are not read. An empty table gives no rows.
    """
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")}
    source = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), text["role"], text["text"])
    role, body = F.col("role"), F.col("text")
    plain = F.concat(F.lit(BEGIN), *render(role, body), F.lit(END))
    fits = parse(plain) == F.array(F.struct("role", "text"))
    tried = source.withColumn("escaped", ~F.coalesce(fits, F.lit(False)))
    parts = [F.when(F.col("escaped"), e).otherwise(p).alias(n) for n, e, p in zip(("head", "body", "tail"), render(role, body, escape), render(role, body))]
    rendered = tried.select("*", *parts).withColumn("chars", F.char_length("body")).withColumn("before", F.char_length("head"))
    long = F.col("before") + F.col("chars") + F.char_length("tail")
    ahead = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = rendered.withColumn("at", F.coalesce(F.sum(long).over(ahead), F.lit(0)) + F.lit(len(BEGIN) + 1)).select(
        "conv_id", "escaped", F.struct("at", F.concat("head", "body", "tail").alias("shown"), "role", "text", (F.col("at") + F.col("before")).alias("start"), "chars").alias("turn")
    )
    grouped = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"), F.max("escaped").alias("escaped"))
    own = F.filter("turns", lambda t: t["role"] == "assistant")
    whole = grouped.select(
        "conv_id",
        F.concat(F.lit(BEGIN), F.array_join(F.col("turns.shown"), ""), F.lit(END)).alias("formatted"),
        "escaped",
        F.transform(own, lambda t: F.struct(t["start"].alias("start"), t["chars"].alias("chars"))).alias("loss_spans"),
        F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"),
    )
    same = F.coalesce(parse(F.col("formatted")) == F.col("turns"), F.lit(False))
    return whole.select("conv_id", "formatted", "escaped", "loss_spans", same.alias("round_trip"))


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and hashes of what the formatted conversations hold, read back by the parser and through the loss spans."""
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    # Four bytes a character, so that a span is found without counting from the beginning.
    cut = lambda s: F.substring(F.col("wide"), (4 * s["start"] - 3).cast("int"), (4 * s["chars"]).cast("int"))
    under = F.transform("loss_spans", lambda s: unescape(F.decode(cut(s), "UTF-32")))
    read = formatted.withColumn("wide", F.encode("formatted", "UTF-32")).withColumn("turns", parse(F.col("formatted"))).withColumn("loss", F.array_join(under, ""))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "round_trip",
    )
