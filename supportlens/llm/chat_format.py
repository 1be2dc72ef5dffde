"""Chat formatting: a finite-state machine over roles and a declarative template.

Each turn becomes three text segments (mark, text, mark) with a loss flag each. The state of
the machine is the role of the turn before, so a conversation of any length is checked in
blocks. Control strings inside a text are escaped one level, reversibly.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from supportlens.llm.common import text_of


class Marks(NamedTuple):
    before: str
    after: str
    loss: bool


#: Marks and loss flag of each role.
TEMPLATE = {
    "system": Marks("<<SYS>>", "<</SYS>>", False),
    "user": Marks("[INST]", "[/INST]", False),
    "assistant": Marks("<s>", "</s>", True),
}
#: Any other role is written out: before, role, between, text, after.
OTHER = ("<|role|>", "<|text|>", "<|end|>")
#: Allowed roles after each state; "" is the start.
TRANSITIONS = {
    "": ("system", "user"),
    "system": ("user",),
    "user": ("assistant",),
    "assistant": ("user",),
}
ESCAPE = "␛"
BLOCK = 1000


def controls(template: dict[str, Marks]) -> list[str]:
    marks = [*(m for t in template.values() for m in (t.before, t.after)), *OTHER]
    if any(a != b and a in b for a in marks for b in marks):
        raise ValueError("a control string is part of another")
    return marks


def _first_and_rest(template) -> tuple[str, str]:
    marks = controls(template)
    first = "".join(sorted({re.escape(m[0]) for m in marks}))
    return f"([{first}])({ESCAPE}*)", "(?=" + "|".join(re.escape(m[1:]) for m in marks) + ")"


def escaped(text: Column, template=TEMPLATE) -> Column:
    """One more escape sign after the first character of whatever looks like a control string."""
    first, rest = _first_and_rest(template)
    return F.regexp_replace(text, F.lit(first + rest), F.lit(f"$1$2{ESCAPE}"))


def unescaped(text: Column, template=TEMPLATE) -> Column:
    first, rest = _first_and_rest(template)
    return F.regexp_replace(text, F.lit(first + ESCAPE + rest), F.lit("$1$2"))


def _marks(role: Column, template, part: str, other: Column) -> Column:
    chosen = other
    for name, marks in template.items():
        chosen = F.when(role == name, F.lit(getattr(marks, part))).otherwise(chosen)
    return chosen


def format_turns(turns: DataFrame, template=TEMPLATE, transitions=TRANSITIONS) -> DataFrame:
    """One row per turn of ``turns`` (conv_id, turn, role, text) with its segments.

    Returns conv_id, turn, role, text, state (role before, "" at the start), in_order (the
    machine allows the role in that state) and segments, an array of (text, loss). Null
    roles and texts count as empty; turns of a null conv_id form one conversation, and a
    null turn comes first. Equal turn numbers are ordered by role and text; repeated rows
    stay. Further columns are ignored, an empty table gives an empty result.

    A conversation is cut into blocks of turn numbers; only the last role of a block is
    carried to the next, so one huge conversation is spread over many tasks.
    """
    block = F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62)))
    plain = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text_of().alias("text"), block.alias("block")
    )
    ends = plain.groupBy("conv_id", "block").agg(F.max_by("role", F.struct("turn", "role")).alias("last"))
    carried = ends.select(
        F.col("conv_id").alias("_conv"),
        F.col("block").alias("_block"),
        F.lag("last").over(Window.partitionBy("conv_id").orderBy("block")).alias("carried"),
    ).where(F.col("carried").isNotNull())
    in_block = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    before = F.coalesce(F.lag("role").over(in_block), F.col("carried"), F.lit(""))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block"))
    role = F.col("role")
    allowed = F.lit(False)
    for state, following in transitions.items():
        allowed = allowed | ((F.col("state") == state) & role.isin(*following))
    opening = _marks(role, template, "before", F.concat(F.lit(OTHER[0]), escaped(role, template), F.lit(OTHER[1])))
    closing = _marks(role, template, "after", F.lit(OTHER[2]))
    loss = role.isin(*[name for name, marks in template.items() if marks.loss])
    segment = lambda text, flag: F.struct(text.alias("text"), flag.alias("loss"))
    return (
        plain.join(carried, same, "left")
        .withColumn("state", before)
        .select(
            "conv_id", "turn", "role", "text", "state", allowed.alias("in_order"),
            F.array(
                segment(opening, F.lit(False)),
                segment(escaped(F.col("text"), template), loss),
                segment(closing, F.lit(False)),
            ).alias("segments"),
        )
    )


def conversations(formatted: DataFrame) -> DataFrame:
    """One row per conversation: its segments in order, and whether all turns are in order.

    This gathers a conversation in one row; use the rows of ``format_turns`` where
    conversations have no bound.
    """
    turn = F.struct("turn", "role", "text", "segments", "in_order")
    gathered = formatted.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return gathered.select(
        "conv_id",
        F.flatten("turns.segments").alias("segments"),
        F.forall("turns.in_order", lambda ok: ok).alias("in_order"),
    ).withColumn("formatted", F.array_join("segments.text", ""))


def read_back(formatted: Column, template=TEMPLATE) -> Column:
    """Array of (role, text) that a formatted conversation was made from."""
    opening = "|".join([*(re.escape(t.before) for t in template.values()), f"{re.escape(OTHER[0])}.*?{re.escape(OTHER[1])}"])
    closing = "|".join([*(re.escape(t.after) for t in template.values()), re.escape(OTHER[2])])
    pattern = F.lit(f"(?s)({opening})(.*?)(?:{closing})")
    named = lambda mark: unescaped(
        F.substring(mark, F.lit(len(OTHER[0]) + 1), F.length(mark) - len(OTHER[0]) - len(OTHER[1])), template
    )

    def role(mark: Column) -> Column:
        found = named(mark)
        for name, marks in template.items():
            found = F.when(mark == marks.before, F.lit(name)).otherwise(found)
        return found

    return F.zip_with(
        F.regexp_extract_all(formatted, pattern, F.lit(1)),
        F.regexp_extract_all(formatted, pattern, F.lit(2)),
        lambda mark, text: F.struct(role(mark).alias("role"), unescaped(text, template).alias("text")),
    )
