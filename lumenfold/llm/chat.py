"""Chat formatting: a state machine over roles and segments with loss flags."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.llm.common import require, text_or_empty


@dataclass(frozen=True)
class ChatTemplate:
    """What surrounds a turn, which roles carry loss, and which turn may follow which.

    ``order`` maps a role (and "" for the start) to the roles that may come next;
    ``final`` has the roles that may end a conversation. Control strings start with
    ``mark`` ("<|"): inside texts and roles a backslash is put between its
    characters, and one more where there were some already, so unescaping is exact.
    """

    start: str = "<|im_start|>"
    end: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    order: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user", "tool"),
            "tool": ("assistant", "tool"),
        }
    )
    final: tuple[str, ...] = ("assistant",)


TEMPLATE = ChatTemplate()


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """Roles end at the line's end, so their own line feeds are escaped too."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    parts = F.transform(F.split(unescape(role), r"\\\\", -1), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


def segments(turns: DataFrame, template: ChatTemplate = TEMPLATE) -> DataFrame:
    """One row a segment: conv_id, turn_no, n_turns, valid, seg, text, loss.

    Turns go by turn, then role, then text, nulls first; null roles and texts count
    as empty. A turn has three segments: 0 start mark, role and line feed; 1 the
    escaped text; 2 end mark. Only texts of ``loss_roles`` carry loss. valid (the same
    for all rows of a conversation) says whether its turns are accepted by the
    machine: each role may follow the one before and the last may end it. All
    conversations are formatted, valid or not. A null conv_id is a conversation of
    its own. Other columns aren't read.
    """
    require(turns, "conv_id", "turn", "role", "text")
    rows = turns.select("conv_id", "turn", text_or_empty("role").alias("role"), text_or_empty("text").alias("text"))
    by = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    whole = W.partitionBy("conv_id")
    moves = F.lit(False)
    before = F.coalesce(F.lag("role").over(by), F.lit(""))
    for role, following in template.order.items():
        moves = moves | ((F.col("before") == role) & F.col("role").isin(*following))
    rows = rows.withColumns({"turn_no": F.row_number().over(by), "before": before, "last": F.lead("role").over(by).isNull()})
    good = moves & (~F.col("last") | F.col("role").isin(*template.final))
    rows = rows.withColumn("good", good).withColumns({"valid": F.min("good").over(whole), "n_turns": F.count(F.lit(1)).over(whole)})
    made = F.array(
        F.struct(F.lit(0).alias("seg"), F.concat(F.lit(template.start), escape_role(F.col("role")), F.lit("\n")).alias("text"), F.lit(False).alias("loss")),
        F.struct(F.lit(1).alias("seg"), escape(F.col("text")).alias("text"), F.col("role").isin(*template.loss_roles).alias("loss")),
        F.struct(F.lit(2).alias("seg"), F.lit(template.end).alias("text"), F.lit(False).alias("loss")),
    )
    return rows.select("conv_id", "turn_no", "n_turns", "valid", F.inline(made))


def formatted(segs: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, valid, segments (text, loss), in order.

    A conversation is one training text and so one value.
    """
    parts = F.array_sort(F.collect_list(F.struct("turn_no", "seg", "text", "loss")))
    return segs.groupBy("conv_id").agg(F.first("valid").alias("valid"), parts.alias("segments"))


def joined(segs: Column) -> Column:
    return F.array_join(F.transform(segs, lambda s: s["text"]), "")


def parse_turns(text: Column, template: ChatTemplate = TEMPLATE) -> Column:
    """Reads a formatted conversation back: array of (role, text)."""
    turns = F.slice(F.split(text, F.lit(f"\\Q{template.start}\\E"), F.lit(-1)), F.lit(2), F.greatest(F.size(F.split(text, F.lit(f"\\Q{template.start}\\E"), F.lit(-1))) - 1, F.lit(0)))

    def one(turn: Column) -> Column:
        cut = F.instr(turn, "\n")
        body = F.substring(turn, cut + 1, F.length(turn) - cut - F.lit(len(template.end)))
        return F.struct(unescape_role(F.substring(turn, F.lit(1), cut - 1)).alias("role"), unescape(body).alias("text"))

    return F.transform(turns, one)


def chat_digests(turns: DataFrame, template: ChatTemplate = TEMPLATE) -> DataFrame:
    """Formats ``turns`` and reads the result back: one row a conversation."""
    whole = formatted(segments(turns, template)).select("conv_id", "valid", joined(F.col("segments")).alias("chat"), F.col("segments"))
    read = whole.select(
        "conv_id",
        "valid",
        F.length("chat").cast("long").alias("formatted_chars"),
        parse_turns(F.col("chat"), template).alias("turns"),
        F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "").alias("learnt"),
    )
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
    )
