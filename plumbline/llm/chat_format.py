"""Chat formatting by a declarative template: turn order checked by a state machine, loss flags a segment.

Everything is a column expression. A template names for each role its opening and closing control
string and whether its text carries loss; a table of allowed transitions is the state machine. Texts
cannot forge a turn: inside a text the escape sign goes after the first character of every control
string and is doubled where it stood before, so control strings occur only where the template put
them, and reading the output back is exact.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """Control strings, loss roles and allowed turn orders.

    A control string begins with a character that stands nowhere else in any control string and has no
    escape sign. ``other`` frames turns of roles that the template does not name, with the role between
    the first two strings.
    """

    marks: dict[str, tuple[str, str]] = field(
        default_factory=lambda: {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
    )
    other: tuple[str, str, str] = ("[ROLE]", "[SAYS]", "[/ROLE]")
    loss: frozenset[str] = frozenset({"assistant"})
    start: str = "start"
    # (state, role) -> state; the state after the last turn must be one of ``final``.
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "open", ("start", "user"): "asked", ("open", "user"): "asked",
            ("asked", "assistant"): "answered", ("answered", "user"): "asked",
        }
    )
    final: frozenset[str] = frozenset({"answered"})

    def controls(self) -> list[str]:
        return [c for pair in self.marks.values() for c in pair] + list(self.other)

    def __post_init__(self):
        controls = self.controls()
        heads = {c[0] for c in controls}
        if len(set(controls)) < len(controls) or any(len(c) < 2 or ESCAPE in c or heads & set(c[1:]) for c in controls):
            raise ValueError("control strings must differ, have two characters or more, no escape sign, and their first characters nowhere else")


def escaped(text: Column, template: Template) -> Column:
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    return reduce(lambda c, mark: F.replace(c, F.lit(mark), F.lit(mark[0] + ESCAPE + mark[1:])), template.controls(), out)


def unescaped(text: Column) -> Column:
    """A sign before another stands for itself, a single one was put there; pairs are read from the left."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def final_state(roles: Column, template: Template) -> Column:
    """The state after all turns; ``wrong`` from the first turn that no move allows."""

    def step(state: Column, role: Column) -> Column:
        out = F.lit("wrong")
        for (frm, by), to in template.moves.items():
            out = F.when((state == frm) & (role == by), F.lit(to)).otherwise(out)
        return out

    return F.aggregate(roles, F.lit(template.start), step)


def formatted(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text): (conv_id, n_turns, valid, segments, formatted).

    ``segments`` are (text, loss) in order and joined make ``formatted``. Turns are sorted by turn, role
    and text, nulls first; a null role or text is empty; rows without a conv_id form one conversation;
    repeated rows are turns of their own. A conversation whose turn order the template does not allow
    is formatted too and marked not ``valid``. Other columns are ignored. The turns of one conversation
    come together in one row, since their joined text is the result.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    talks = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def segment(text: Column, loss: Column | bool) -> Column:
        return F.struct(text.alias("text"), (loss if isinstance(loss, Column) else F.lit(loss)).alias("loss"))

    def framed(t: Column) -> Column:
        opening = F.concat(F.lit(template.other[0]), escaped(t["role"], template), F.lit(template.other[1]))
        closing = F.lit(template.other[2])
        for role, (begin, end) in template.marks.items():
            opening = F.when(t["role"] == role, F.lit(begin)).otherwise(opening)
            closing = F.when(t["role"] == role, F.lit(end)).otherwise(closing)
        return F.array(segment(opening, False), segment(escaped(t["text"], template), t["role"].isin(*template.loss)), segment(closing, False))

    segments = F.flatten(F.transform("turns", framed))
    state = final_state(F.transform("turns", lambda t: t["role"]), template)
    out = talks.select("conv_id", F.size("turns").cast("long").alias("n_turns"), state.isin(*template.final).alias("valid"), segments.alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(texts: Column, template: Template = Template()) -> Column:
    """The turns (role, text) that a formatted text holds."""
    either = lambda marks: "|".join(map(re.escape, marks))
    openings = [m[0] for m in template.marks.values()] + [template.other[0]]
    closings = [m[1] for m in template.marks.values()] + [template.other[2]]
    pattern = F.lit(f"(?s)({either(openings)})(.*?)(?:{either(closings)})")
    pairs = F.arrays_zip(F.regexp_extract_all(texts, pattern, F.lit(1)).alias("mark"), F.regexp_extract_all(texts, pattern, F.lit(2)).alias("body"))

    def turn(p: Column) -> Column:
        role = F.substring_index(p["body"], template.other[1], 1)
        text = F.substr(p["body"], F.length(role) + len(template.other[1]) + 1)
        role = unescaped(role)
        for name, (begin, _) in template.marks.items():
            text = F.when(p["mark"] == begin, p["body"]).otherwise(text)
            role = F.when(p["mark"] == begin, F.lit(name)).otherwise(role)
        return F.struct(role.alias("role"), unescaped(text).alias("text"))

    return F.transform(pairs, turn)


def digests(talks: DataFrame, template: Template = Template()) -> DataFrame:
    """What ``formatted`` conversations hold, read back from their text and their loss flags."""
    turns = read_back(F.col("formatted"), template)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
    read = talks.select("conv_id", "valid", "formatted", turns.alias("turns"), learned.alias("learned"))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2(F.encode("learned", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )
