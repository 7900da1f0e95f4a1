"""Chat formatting from a declarative template, with loss flags, all in Catalyst.

A template gives each role an opening mark, a closing mark and a loss flag, and a
finite-state machine over roles.  ``format_conversations`` returns one row per
conversation: its segments (text and loss flag), their concatenation, and whether
the machine accepted the order of turns.  ``read_back`` recovers roles and texts
from the concatenation alone.

Control strings inside texts are replaced by an escape sign and a letter, the sign
itself by the sign and ``0``; so a formatted text holds a mark only where the
template put one, and unescaping restores every text exactly.

Defined cases: a null text or role counts as empty; a null turn sorts first; equal
turns sort by role, then text; repeated rows are repeated turns; roles that the
template doesn't list use its ``other`` marks and no loss; a null ``conv_id`` is
one conversation; conversations in a wrong order are formatted with ``valid`` false;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEMPLATE = {
    "begin": "<s>",
    "roles": {
        "system": {"open": "[SYS]", "close": "[/SYS]", "loss": False},
        "user": {"open": "[INST]", "close": "[/INST]", "loss": False},
        "assistant": {"open": "[ANS]", "close": "</s>", "loss": True},
    },
    "other": {"open": "[ROLE]", "named": "[AS]", "close": "[/ROLE]"},
    "escape": "\\",
    "start": "start",
    "accept": ["assistant"],
    "next": {
        "start": ["system", "user"],
        "system": ["user"],
        "user": ["assistant"],
        "assistant": ["user"],
    },
}


def control_strings(template: dict = TEMPLATE) -> list[str]:
    """All marks, after checking that none can arise across a text's edge."""
    other = template["other"]
    marks = [template["begin"], other["open"], other["named"], other["close"]]
    for role in template["roles"].values():
        marks += [role["open"], role["close"]]
    marks = sorted(set(marks), key=lambda m: (-len(m), m))
    heads = {m[0] for m in marks}
    if any(h in m[1:] for h in heads for m in marks) or any(a != b and a.startswith(b) for a in marks for b in marks):
        raise ValueError("a mark may hold no mark's first character but its own, nor start another mark")
    if any(template["escape"] in m for m in marks) or len(marks) > 26:
        raise ValueError("marks may not hold the escape sign; 26 at most")
    return marks


def _codes(template: dict) -> list[tuple[str, str]]:
    return [(m, template["escape"] + chr(97 + i)) for i, m in enumerate(control_strings(template))]


def escape(text: Column, template: dict = TEMPLATE) -> Column:
    sign = template["escape"]
    steps = [(sign, sign + "0"), *_codes(template)]
    return reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), steps, text)


def unescape(text: Column, template: dict = TEMPLATE) -> Column:
    sign = template["escape"]
    steps = [*((b, a) for a, b in _codes(template)), (sign + "0", sign)]
    return reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), steps, text)


def _segments(role: Column, text: Column, template: dict) -> Column:
    def seg(value: Column, loss: bool) -> Column:
        return F.struct(value.alias("text"), F.lit(loss).alias("loss"))

    other = template["other"]
    head = F.concat(F.lit(other["open"]), escape(role, template), F.lit(other["named"]))
    out = F.array(seg(head, False), seg(escape(text, template), False), seg(F.lit(other["close"]), False))
    for name, marks in template["roles"].items():
        own = F.array(seg(F.lit(marks["open"]), False), seg(escape(text, template), marks["loss"]), seg(F.lit(marks["close"]), False))
        out = F.when(role == name, own).otherwise(out)
    return out


def _accepts(roles: Column, template: dict) -> Column:
    known = [F.lit(x) for state, then in template["next"].items() for role in then for x in (f"{state}>{role}", role)]
    moves = F.create_map(*known)
    last = F.aggregate(roles, F.lit(template["start"]), lambda state, role: F.coalesce(F.try_element_at(moves, F.concat(state, F.lit(">"), role)), F.lit("")))
    return last.isin(template["accept"])


def format_conversations(df: DataFrame, template: dict = TEMPLATE, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, valid, segments array<struct<text, loss>>, formatted) per conversation."""
    rows = df.select(
        F.col(conv).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("said"),
    )
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("turns"))
    begin = F.array(F.struct(F.lit(template["begin"]).alias("text"), F.lit(False).alias("loss")))
    made = turns.select(
        F.col("conv_id").alias(conv),
        _accepts(F.transform("turns", lambda t: t["role"]), template).alias("valid"),
        F.concat(begin, F.flatten(F.transform("turns", lambda t: _segments(t["role"], t["text"], template)))).alias("segments"),
    )
    return made.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: Column, template: dict = TEMPLATE) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    other = template["other"]
    closes = [m["close"] for m in template["roles"].values()] + [other["close"]]
    body = F.substring(formatted, len(template["begin"]) + 1, 2**31 - 1)
    parts = F.split(body, "|".join(re.escape(c) for c in sorted(set(closes), key=len, reverse=True)), -1)

    def turn(part: Column) -> Column:
        named = F.instr(part, other["named"])
        n = len(other["open"])
        who = unescape(F.substr(part, F.lit(n + 1), named - F.lit(n + 1)), template)
        what = F.substr(part, named + F.lit(len(other["named"])))
        for name, marks in template["roles"].items():
            own = F.startswith(part, F.lit(marks["open"]))
            who = F.when(own, F.lit(name)).otherwise(who)
            what = F.when(own, F.substr(part, F.lit(len(marks["open"]) + 1))).otherwise(what)
        return F.struct(who.alias("role"), unescape(what, template).alias("text"))

    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)


def loss_text(segments: Column, template: dict = TEMPLATE) -> Column:
    """The unescaped text under the loss mask."""
    kept = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(kept, lambda s: unescape(s["text"], template)), "")
