r"""Chat formatting of conversations with typed content parts, in DataFrame expressions only.

A turn's content is an array of parts (type, text, ref, size). A visitor flattens the parts in order: text is escaped,
an image, audio or document part becomes a placeholder such as `<image:1>`, numbered within its conversation, its
reference is recorded as an attachment, and its expanded token count follows from its size and the rule of its type.

The template puts `<turn:role>`, a line feed, the content and `</turn>` with a line feed around each turn. In texts and
roles `\` becomes `\b` and `<` becomes `\l`; in roles `>` becomes `\g` and a line feed `\n`. So no `<` of a text can be
taken for markup, and the escapes are undone without loss. The loss mask lists the spans (code points) of assistant
text.

Turns are ordered by turn (null first); ties by role, then text. Null texts and roles count as empty; a null conv_id
makes a conversation of its own rows. Repeated rows are turns each. Empty tables give empty results. A conversation is
one output row, so its own length bounds what a task holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

PART = "struct<type:string,text:string,ref:string,size:bigint>"
#: type -> (least tokens, size units for one token more): image in pixels, audio in milliseconds, document in characters.
EXPANSION = {"image": (85, 784), "audio": (1, 40), "document": (1, 4)}


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit(">"), F.lit("\\g")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\g"), F.lit(">")))


def text_parts(text: str = "text") -> Column:
    """A text column as content of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("size"))).cast(f"array<{PART}>")


def expanded(part: Column) -> Column:
    """Tokens that an attachment stands for; 0 for text."""
    out = F.lit(0).cast("long")
    for kind, (least, unit) in EXPANSION.items():
        out = F.when(part["type"] == kind, F.lit(least) + F.ceil(F.coalesce(part["size"], F.lit(0)) / unit)).otherwise(out)
    return out.cast("long")


ITEM = "struct<shown:string,type:string,ref:string,tokens:bigint,train:boolean>"


def format_chat(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, content) -> conv_id, n_turns, formatted, loss_mask, attachments, expanded_tokens.

    The visitor makes one list of items (marks, texts, attachments) of all turns; numbers and places of items are
    running sums over it, so the time hardly grows faster than the conversation.
    """
    content = F.coalesce("content", F.array().cast(f"array<{PART}>"))
    gathered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), content.alias("content")))).alias("_t"))

    def item(shown: Column, kind: Column, ref: Column, tokens: Column, train: Column) -> Column:
        return F.struct(shown.alias("shown"), kind.alias("type"), ref.alias("ref"), tokens.alias("tokens"), train.alias("train"))

    def mark(text: Column) -> Column:
        return item(text, F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(0).cast("long"), F.lit(False))

    def visit_part(p: Column, train: Column) -> Column:
        attached = F.coalesce(p["type"], F.lit("text")) != "text"
        return item(F.when(~attached, escape(F.coalesce(p["text"], F.lit("")))), F.when(attached, p["type"]), p["ref"], expanded(p), train & ~attached)

    def visit_turn(t: Column) -> Column:
        head = mark(F.concat(F.lit("<turn:"), escape_role(t["role"]), F.lit(">\n")))
        return F.concat(F.array(head), F.transform(t["content"], lambda p: visit_part(p, t["role"] == "assistant")), F.array(mark(F.lit("</turn>\n")))).cast(f"array<{ITEM}>")

    def out(items: Column, numbers: Column, shown: Column, ends: Column) -> Column:
        span = lambda x, i: F.struct((F.get(ends, i) - F.length(F.get(shown, i))).alias("start"), F.get(ends, i).alias("end"), x["train"].alias("train"))
        spans = F.filter(F.transform(items, span), lambda s: s["train"] & (s["end"] > s["start"]))
        record = lambda x, i: F.struct(F.get(numbers, i).cast("bigint").alias("n"), x["type"].alias("type"), x["ref"].alias("ref"), x["tokens"].alias("tokens"))
        return F.struct(
            F.array_join(shown, "").alias("formatted"),
            F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("loss_mask"),
            F.filter(F.transform(items, record), lambda r: r["type"].isNotNull()).alias("attachments"),
            F.aggregate(items, F.lit(0).cast("long"), lambda acc, x: acc + x["tokens"]).alias("expanded_tokens"),
        )

    add = lambda a, b: a + b
    number = lambda items: common.running(F.transform(items, lambda x: F.when(x["type"].isNotNull(), 1).otherwise(0)), add, F.lit(0))
    show = lambda items, n: F.transform(items, lambda x, i: F.coalesce(x["shown"], F.concat(F.lit("<"), escape_role(x["type"]), F.lit(":"), F.get(n, i).cast("string"), F.lit(">"))))
    place = lambda shown: common.running(F.transform(shown, F.length), add, F.lit(0))
    visited = common.bind(
        F.flatten(F.transform("_t", visit_turn)),
        lambda items: common.bind(number(items), lambda n: common.bind(show(items, n), lambda shown: common.bind(place(shown), lambda ends: out(items, n, shown, ends)))),
    )
    done = gathered.select("conv_id", F.size("_t").cast("long").alias("n_turns"), visited.alias("_v"))
    return done.select("conv_id", "n_turns", "_v.formatted", "_v.loss_mask", "_v.attachments", "_v.expanded_tokens")


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted text; placeholders stay as they stand in texts."""
    shown = F.filter(F.split(formatted, "</turn>\n", -1), lambda x: x != "")
    return F.transform(
        shown,
        lambda x: F.struct(
            unescape_role(F.substring_index(F.substring(x, 7, F.length(x)), ">\n", 1)).alias("role"),
            unescape(F.substring(x, F.instr(x, ">\n") + 2, F.length(x))).alias("text"),
        ),
    )


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return common.bind(common.blocks(formatted), lambda b: F.array_join(F.transform(mask, lambda s: unescape(common.cut(b, s["start"], s["end"]))), ""))


def digests(out: DataFrame) -> DataFrame:
    """What the formatted output holds, read back from it."""
    read = out.withColumn("_r", read_turns(F.col("formatted"))).withColumn("_l", masked_text(F.col("formatted"), F.col("loss_mask")))
    return read.select(
        "conv_id",
        F.size("_r").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("_r", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("_l").cast("long").alias("loss_chars"),
        F.sha2(F.col("_l").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "expanded_tokens",
    )
