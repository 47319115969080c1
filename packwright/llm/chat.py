"""Chat formatting by grammar round trip, on DataFrame functions only.

A conversation is rendered as turns of ``open role middle text close``. A deterministic
parser reads the rendered text back; where the recovered turns differ from the source,
conflicting content is escaped and rendered again, until they are identical.

The escape puts one backslash behind the first character of a control string, also where
backslashes stand there already (``</s>`` to ``<\\/s>``, ``<\\/s>`` to ``<\\\\/s>``); the
parser takes one away. This is one to one, and no escaped text holds a control string.
"""

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = "struct<role:string,text:string>"


@dataclass(frozen=True)
class Template:
    """What stands before the role, between role and text, and after the text.

    ``controls`` are never left as they are inside a role or text.
    """

    open: str = "<s>[INST]"
    middle: str = "[/INST]"
    close: str = "</s>"
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]")

    def places(self, backslashes: str) -> str:
        """A pattern for what stands behind the first character of a control string."""
        return "|".join(
            rf"(?<={re.escape(c[0])}){backslashes}(?=\\*{re.escape(c[1:])})" for c in self.controls
        )

    @property
    def control_pattern(self) -> str:
        return "|".join(re.escape(c) for c in self.controls)


def escape(text: Column, template: Template) -> Column:
    return F.regexp_replace(text, template.places(""), r"\\")


def unescape(text: Column, template: Template) -> Column:
    return F.regexp_replace(text, template.places(r"\\"), "")


def render(turns: Column, template: Template) -> Column:
    """Turns, escaped already where needed, as one text."""
    return F.array_join(
        F.transform(
            turns,
            lambda t: F.concat(
                F.lit(template.open), t["role"], F.lit(template.middle), t["text"], F.lit(template.close)
            ),
        ),
        "",
    )


def parse(formatted: Column, template: Template) -> Column:
    """The turns of a rendered text; a turn that breaks the grammar is null."""

    def turn(piece: Column) -> Column:
        halves = F.split(piece, re.escape(template.middle), -1)
        body = F.get(halves, F.lit(1))
        text = F.left(body, F.length(body) - F.lit(len(template.close)))
        sound = (
            (F.size(halves) == 2)
            & body.endswith(template.close)
            & ~halves[0].rlike(template.control_pattern)
            & ~text.rlike(template.control_pattern)
        )
        return F.when(
            sound,
            F.struct(unescape(halves[0], template).alias("role"), unescape(text, template).alias("text")),
        )

    pieces = F.split(formatted, re.escape(template.open), -1)
    turns = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), turn)
    return F.when(pieces[0] == "", turns)


def format_chats(turns: DataFrame, template: Template = Template(), loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_id, formatted, segments, escaped_turns``.

    ``segments`` cuts ``formatted`` into pieces ``(text, loss)``; those with ``loss`` are
    the texts of ``loss_role``. Turns are in order of (turn, role, text), null first. A
    null role or text is empty; rows without ``conv_id`` are one conversation; repeated
    rows are repeated turns. A conversation is one row of the result, so it is the unit
    that has to fit a task; conversations share nothing.
    """
    source = turns.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    ordered = source.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("ordered")
    )
    plain = ordered.select(
        "conv_id",
        F.transform("ordered", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"),
    )
    # First round: as it is, turn by turn. Second: conflicting turns escaped. Third: all.
    alone = lambda t: F.get(parse(render(F.array(t), template), template), F.lit(0))
    both = lambda t: F.struct(
        escape(t["role"], template).alias("role"), escape(t["text"], template).alias("text")
    )
    tried = plain.select(
        "*",
        F.transform("turns", lambda t: ~alone(t).eqNullSafe(t)).alias("conflicts"),
    ).select(
        "*",
        F.zip_with("turns", "conflicts", lambda t, c: F.when(c, both(t)).otherwise(t)).alias("second"),
    )
    tried = tried.select("*", render(F.col("second"), template).alias("rendered"))
    tried = tried.select("*", parse(F.col("rendered"), template).eqNullSafe(F.col("turns")).alias("same"))
    final = tried.select(
        "conv_id",
        "turns",
        F.when(F.col("same"), F.col("second")).otherwise(F.transform("turns", both)).alias("written"),
        F.when(F.col("same"), F.col("rendered"))
        .otherwise(render(F.transform("turns", both), template))
        .alias("formatted"),
        F.when(F.col("same"), F.size(F.filter("conflicts", lambda c: c))).otherwise(F.size("turns")).alias("escaped_turns"),
        "same",
    )
    checked = F.when(
        F.col("same") | parse(F.col("formatted"), template).eqNullSafe(F.col("turns")), F.col("formatted")
    ).otherwise(F.raise_error(F.concat(F.lit("no round trip: conversation "), F.col("conv_id").cast("string"))))
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(
        F.zip_with(
            "written",
            "turns",
            lambda w, t: F.array(
                piece(F.concat(F.lit(template.open), w["role"], F.lit(template.middle)), F.lit(False)),
                piece(w["text"], t["role"] == F.lit(loss_role)),
                piece(F.lit(template.close), F.lit(False)),
            ),
        )
    )
    return final.select("conv_id", checked.alias("formatted"), segments.alias("segments"), "escaped_turns")


def read_chats(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Digests of what the formatted rows hold, read back from ``formatted`` and ``segments``."""
    turns = parse(F.col("formatted"), template)
    under_loss = F.array_join(
        F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], template)), ""
    )
    read = formatted.select("conv_id", "formatted", turns.alias("turns"), under_loss.alias("loss_text"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
