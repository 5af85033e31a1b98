"""Chat formatting from a declarative template, with turn order checked by a finite-state machine over roles.

Only DataFrame expressions are used. A conversation's turns are put in order, each turn becomes the template's segments
(text and loss flag), and the machine walks over the roles. Control strings inside texts are escaped reversibly: a
backslash is doubled, then one is put between ``<`` and ``|``, so that ``<|`` occurs in the output at template marks only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks around a turn, the roles whose text is learned, and the machine: (state, role) -> state."""

    begin: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>"
    after_turn: str = "\n"
    learned: tuple[str, ...] = ("assistant",)
    start: str = "start"
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )
    final: tuple[str, ...] = ("user", "assistant")


CHAT = Template()
BROKEN = "broken"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def role_escaped(role: Column) -> Column:
    """Also keeps a role on one line: a line break becomes ``<``, one backslash, ``>``, which no escaped text holds."""
    return F.replace(escaped(role), F.lit("\n"), F.lit("<\\>"))


def role_unescaped(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("<\\>"), F.lit("\n")))


def last_state(roles: Column, template: Template) -> Column:
    """The machine's state after ``roles``; broken once a role has no move."""
    pairs = [x for (state, role), to in template.moves.items() for x in (F.lit(f"{state}\0{role}"), F.lit(to))]
    moves = F.create_map(*pairs)
    step = lambda state, role: F.coalesce(F.try_element_at(moves, F.concat(state, F.lit("\0"), role)), F.lit(BROKEN))
    return F.aggregate(roles, F.lit(template.start), step)


def format_conversations(turns: DataFrame, template: Template = CHAT) -> DataFrame:
    """(conv_id, valid, state, segments, formatted), one row per conv_id of ``turns`` (conv_id, turn, role, text).

    ``segments`` is an array of (text, loss) whose texts joined are ``formatted``; under the loss flag lie the escaped
    texts of learned roles and nothing else. ``valid`` is false where the machine breaks or stops in a state that is not
    final; such conversations are formatted all the same. A null text or role is empty, rows of one turn number go by role
    and text, a null turn comes first, a null conv_id is a conversation, repeated rows are turns of their own. A
    conversation is one value of the result, so its rows meet in one row whatever their number.
    """
    filled = lambda name: F.coalesce(F.col(f"`{name}`"), F.lit(""))
    rows = turns.select("conv_id", F.struct("turn", filled("role").alias("role"), filled("text").alias("text")).alias("row"))
    talks = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("turns"))
    learned = lambda role: role.isin(*template.learned)
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                part(F.concat(F.lit(template.begin), role_escaped(t["role"]), F.lit(template.after_role)), F.lit(False)),
                part(escaped(t["text"]), learned(t["role"])),
                part(F.lit(template.end + template.after_turn), F.lit(False)),
            ),
        )
    )
    state = last_state(F.transform("turns", lambda t: t["role"]), template)
    return talks.select(
        "conv_id",
        state.isin(*template.final).alias("valid"),
        state.alias("state"),
        segments.alias("segments"),
    ).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: Column, template: Template = CHAT) -> Column:
    """The turns of a formatted conversation as an array of (role, text), from its text alone."""
    end = template.end + template.after_turn
    parts = F.filter(F.split(formatted, "\\Q" + template.begin + "\\E"), lambda p: p != "")

    def turn(piece: Column) -> Column:
        body = F.left(piece, F.length(piece) - F.lit(len(end)))
        cut = F.locate(template.after_role, body)
        return F.struct(role_unescaped(F.left(body, cut - 1)).alias("role"), unescaped(F.substring(body, cut + len(template.after_role), F.length(body))).alias("text"))

    return F.transform(parts, turn)


def digests(formatted: DataFrame, template: Template = CHAT) -> DataFrame:
    """Digest columns of the output of ``format_conversations``, read back from its text and its loss flags."""
    told = formatted.select(
        "conv_id",
        "valid",
        read_back(F.col("formatted"), template).alias("turns"),
        F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "").alias("learned"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return told.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
    )
