"""Chat formatting from a declarative template, with DataFrame functions only.

A template names, for each role, the marks around a turn and whether its text carries loss. A finite-state
machine over the roles tells whether the turns follow the allowed order. The result is a list of text
segments, each with a loss flag; joined, they are the formatted conversation. Marks that occur inside texts
are broken by a backslash behind their first character, backslashes are doubled, so `parse` restores every text.

Null texts and roles count as empty; roles that the template doesn't name get a generic mark that holds the
name in hexadecimal, carry no loss and make the conversation invalid. Rows of equal turn are ordered by role and
text, null turns come first. A conversation with no rows doesn't occur; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Role:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks by role, and the machine: state -> role -> next state. Accepting states may end a conversation."""

    roles: dict[str, Role] = field(
        default_factory=lambda: {
            "system": Role("<<SYS>>", "<</SYS>>"),
            "user": Role("[INST]", "[/INST]"),
            "assistant": Role("<s>", "</s>", loss=True),
        }
    )
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "briefed", "user": "asked"},
            "briefed": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    accepting: tuple[str, ...] = ("asked", "answered")


OTHER_OPEN, OTHER_OPEN_END, OTHER_CLOSE = "<<ROLE ", ">>", "<</ROLE>>"


def _quoted(text: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() and c not in " _" else c for c in text)


def _marks(template: Template) -> list[str]:
    return [*(m for r in template.roles.values() for m in (r.open, r.close)), OTHER_OPEN, OTHER_CLOSE]


def escape(text: Column, template: Template) -> Column:
    r"""Backslashes doubled, and a backslash behind the first character of each mark."""
    first = "|".join(f"{_quoted(m[0])}(?={_quoted(m[1:])})" for m in sorted(_marks(template), key=len, reverse=True))
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), f"({first})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _segments(turn: Column, template: Template) -> Column:
    """The marks and the text of a turn, as (text, loss)."""
    opened, closed, loss = F.concat(F.lit(OTHER_OPEN), F.hex(turn["role"].cast("binary")), F.lit(OTHER_OPEN_END)), F.lit(OTHER_CLOSE), F.lit(False)
    for name, role in template.roles.items():
        is_role = turn["role"] == name
        opened, closed = F.when(is_role, role.open).otherwise(opened), F.when(is_role, role.close).otherwise(closed)
        loss = F.when(is_role, role.loss).otherwise(loss)
    part = lambda text, flag: F.struct(text.alias("text"), flag.alias("loss"))
    return F.array(part(opened, F.lit(False)), part(turn["text"], loss), part(closed, F.lit(False)))


def _state(roles: Column, template: Template) -> Column:
    def step(state: Column, role: Column) -> Column:
        out = F.lit("invalid")
        for source, by_role in template.moves.items():
            for name, target in by_role.items():
                out = F.when((state == source) & (role == name), target).otherwise(out)
        return out

    return F.aggregate(roles, F.lit("start"), step)


def format_chats(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conv_id: conv_id, valid, segments (array of text and loss), formatted."""
    template = template or Template()
    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # Equal turns go by their text as it is; it is escaped only then, which could change the order.
    raw = clean.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    ordered = raw.withColumn("turns", F.transform("turns", lambda t: t.withField("text", escape(t["text"], template))))
    return ordered.select(
        "conv_id",
        _state(F.transform("turns", lambda t: t["role"]), template).isin(*template.accepting).alias("valid"),
        F.flatten(F.transform("turns", lambda t: _segments(t, template))).alias("segments"),
    ).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def parse(formatted: Column, template: Template | None = None) -> Column:
    """The turns of a formatted conversation, as an array of (role, text)."""
    template = template or Template()
    opens = "|".join([*(_quoted(r.open) for r in template.roles.values()), f"{_quoted(OTHER_OPEN)}[0-9A-F]*{_quoted(OTHER_OPEN_END)}"])
    closes = "|".join([*(_quoted(r.close) for r in template.roles.values()), _quoted(OTHER_CLOSE)])
    found = F.regexp_extract_all(formatted, F.lit(f"(?s)({opens})(.*?)({closes})"), F.lit(0))

    def turn(raw: Column) -> Column:
        opened = F.regexp_extract(raw, f"^({opens})", 1)
        role = F.unhex(F.regexp_extract(opened, f"^{_quoted(OTHER_OPEN)}([0-9A-F]*)", 1)).cast("string")
        for name, marks in template.roles.items():
            role = F.when(opened == marks.open, name).otherwise(role)
        body = F.regexp_extract(raw, f"(?s)^(?:{opens})(.*?)(?:{closes})$", 1)
        return F.struct(role.alias("role"), unescape(body).alias("text"))

    return F.transform(found, turn)


def loss_text(segments: Column) -> Column:
    """The text under the loss mask, unescaped and joined."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
