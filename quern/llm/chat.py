"""Chat formatting: conversations as text with control strings, and one example for each reply.

Prefix-target expansion: every assistant turn gives an example that ends with it. All turns before
it are context; only the reply is trainable, and its place in the text is the loss mask. Since an
example is a prefix of its conversation, a conversation is put together once and cut at the end of
each reply. A conversation that goes on after its last reply, or has none, gives one more example
that holds all of it, with an empty mask, so that no turn is lost.

Template: `<s>`, then for each turn `[SYSTEM_PROMPT] text[/SYSTEM_PROMPT]`, `[INST] text [/INST]`,
` text</s>` for an assistant, and `[TURN] role[SEP]text[/TURN]` for any other role. A control string
inside a text or role gets a backslash after its first character, one more if backslashes stand
there already; reading takes one away. Texts without control strings stay as they are.

Cases. Turns go in the order of turn, role and text; a null turn is last. Null or empty text: an
empty turn. A null role is the empty role. Rows that repeat are turns of their own. Rows without a
conv_id are one conversation. A conversation is one row (its last example holds all of it), so the
examples of one with n turns hold about n times its length; conversations are spread by id. Empty
tables give no rows. Other columns are ignored. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import chosen

BEGIN, END, SEP = "<s>", "</s>", "[SEP]"
#: What stands before and after a text of each role; others are named between TURN and SEP.
MARKS = {"system": ("[SYSTEM_PROMPT] ", "[/SYSTEM_PROMPT]"), "user": ("[INST] ", " [/INST]"), "assistant": (" ", END)}
TURN = ("[TURN] ", "[/TURN]")
_CONTROL = r"/?(?:INST|SYSTEM_PROMPT|TURN)\]|SEP\]|/?s>"
_AFTER = r"(?<=</s>|\[/INST\]|\[/TURN\]|\[/SYSTEM_PROMPT\])"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([\[<])(\\*)({_CONTROL})", r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([\[<])\\(\\*)({_CONTROL})", "$1$2$3")


def marked(role: Column, text: Column) -> Column:
    """A turn (escaped text) in the template."""
    out = F
    for name, (a, z) in MARKS.items():
        out = out.when(role == name, F.concat(F.lit(a), text, F.lit(z)))
    return out.otherwise(F.concat(F.lit(TURN[0]), escaped(role), F.lit(SEP), text, F.lit(TURN[1])))


def examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example (from 0), n_turns, text, loss_start, loss_chars (code points of text from 0
    that are trained; null without), whole (the example holds all turns)."""
    said = chosen(conversations, conv_id="long", turn="long", role="string", text="string")
    said = said.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), escaped(F.coalesce("text", F.lit(""))).alias("said"))
    order = W.partitionBy("conv_id").orderBy(F.asc_nulls_last("turn"), "role", "said")
    turns = said.withColumn("piece", marked(F.col("role"), F.col("said")))
    turns = turns.select("conv_id", F.row_number().over(order).alias("place"), "piece", (F.col("role") == "assistant").alias("reply"), F.length("said").alias("size"), F.sum(F.length("piece")).over(order.rowsBetween(W.unboundedPreceding, 0)).alias("end"))
    talk = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "piece", "reply", "size", "end"))).alias("t"))
    cut = F.filter("t", lambda x: x["reply"] | (x["place"] == F.size("t")))
    talk = talk.select("conv_id", F.size("t").alias("n"), F.concat(F.lit(BEGIN), F.array_join("t.piece", "")).alias("all"), F.posexplode(cut).alias("example", "x"))
    end = F.col("x.end") + len(BEGIN)
    start = F.when(F.col("x.reply"), end - len(END) - F.col("x.size"))
    return talk.select("conv_id", F.col("example").cast("long").alias("example"), F.col("x.place").cast("long").alias("n_turns"), F.substring("all", F.lit(1), end.cast("int")).alias("text"), start.alias("loss_start"), F.when(F.col("x.reply"), F.col("x.size").cast("long")).alias("loss_chars"), (F.col("x.place") == F.col("n")).alias("whole"))


def trained(start: Column, chars: Column, text: Column) -> Column:
    """The text under an example's mask, without escapes."""
    return unescaped(F.substring(text, (start + 1).cast("int"), chars.cast("int")))


def turns_of(text: Column) -> Column:
    """Role and text of each turn of an example, read from its text alone."""
    pieces = F.filter(F.split(F.substring(text, F.lit(len(BEGIN) + 1), F.length(text)), _AFTER), lambda p: p != "")

    def read(p: Column) -> Column:
        inside = lambda a, z: F.substring(p, F.lit(len(a) + 1), F.length(p) - len(a) - len(z))
        role, said = F.lit(None).cast("string"), F.lit(None).cast("string")
        for name, (a, z) in MARKS.items():
            role, said = F.when(F.endswith(p, F.lit(z)), name).otherwise(role), F.when(F.endswith(p, F.lit(z)), inside(a, z)).otherwise(said)
        other = F.split(inside(*TURN), r"\[SEP\]")
        named = F.endswith(p, F.lit(TURN[1]))
        return F.struct(unescaped(F.when(named, other[0]).otherwise(role)).alias("role"), unescaped(F.when(named, other[1]).otherwise(said)).alias("text"))

    return F.transform(pieces, read)


def digest(found: DataFrame) -> DataFrame:
    """A row for each conversation of examples, read back from their texts and masks."""
    lines = F.array_join(F.transform(turns_of(F.col("text")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    each = found.select("conv_id", F.length("text").cast("long").alias("size"), F.when(F.col("loss_start").isNotNull(), F.struct("example", trained(F.col("loss_start"), F.col("loss_chars"), F.col("text")).alias("loss"))).alias("loss"), F.when(F.col("whole"), F.size(turns_of(F.col("text"))).cast("long")).alias("n"), F.when(F.col("whole"), F.sha2(lines, 256)).alias("sha"))
    by = each.groupBy("conv_id").agg(F.max("n").alias("n_turns"), F.max("sha").alias("turns_sha256"), F.array_join(F.transform(F.array_sort(F.collect_list("loss")), lambda x: x["loss"]), "").alias("loss"), F.sum("size").alias("formatted_chars"), F.count("*").alias("n_examples"))
    return by.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples")
