"""Chat formatting with DataFrame expressions only.

``format_chats`` collects a conversation's turns as structs, sorts them,
merges adjacent turns of one role into a block and concatenates the blocks
under a template.  ``read_back`` undoes it.

Template: a block is ``open role close text (join text)* end``.  Inside roles
and texts every control string is broken up by backslashes after its first
character (one more than it already has there), so no control string is left
in an escaped text and ``unescape`` gives the text back exactly.

Defined results:

* a null text or role counts as empty; an empty text is a turn of its own;
* turns are ordered by (turn, role, text), a null turn first: ties and
  repeated rows are all kept, in that order;
* rows with a null conv_id form one conversation;
* an empty table gives no rows; other columns are ignored, whatever their
  names;
* a conversation is one row by nature: its text must fit into one (2 GB).
  All steps are linear in its length, and turns are collected with a partial
  aggregation before the shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Control strings of at least two characters, none of which begins within another."""

    open: str = "[INST]"
    close: str = "[/INST]"
    join: str = "<s>"
    end: str = "</s>"
    #: Control strings that the template does not write but that texts must not hold either.
    reserved: tuple[str, ...] = ("<<SYS>>", "<</SYS>>")
    #: Roles whose texts are trained on.
    trained: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        return [self.open, self.close, self.join, self.end, *self.reserved]

    def _pattern(self, slashes: str) -> str:
        by_first: dict[str, list[str]] = {}
        for c in self.controls():
            by_first.setdefault(c[0], []).append(re.escape(c[1:]))
        ways = [rf"(?<={re.escape(a)}){slashes}(?={{}}(?:{'|'.join(rest)}))" for a, rest in sorted(by_first.items())]
        return "|".join(ways)

    def escape(self, text: Column) -> Column:
        """One backslash more between a control string's first character and its rest."""
        return F.regexp_replace(text, self._pattern("").replace("{}", r"\\*"), r"\\")

    def unescape(self, text: Column) -> Column:
        """One backslash less there."""
        return F.regexp_replace(text, self._pattern(r"\\").replace("{}", r"\\*"), "")


def format_chats(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, formatted, segments): the text of each conversation, and the same text as segments with a loss mask.

    The segments' texts, concatenated, are ``formatted``; ``loss`` is true
    for the (escaped) texts of trained roles.
    """
    t = template
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select("conv_id", F.struct("turn", text("role").alias("role"), text("text").alias("text")).alias("turn"))
    talks = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    # places of turns whose role differs from the one before; a block reaches to the next such place
    places = F.sequence(F.lit(1), F.size("turns"))
    first = F.filter(places, lambda i: (i == 1) | (F.element_at("turns", i)["role"] != F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"]))
    talks = talks.withColumn("first", first)
    ends = F.concat(F.slice("first", F.lit(2), F.greatest(F.size("first") - 1, F.lit(0))), F.array(F.size("turns") + 1))
    blocks = F.transform(
        F.arrays_zip(F.col("first").alias("a"), ends.alias("b")),
        lambda x: F.struct(F.element_at("turns", x["a"])["role"].alias("role"), F.transform(F.slice("turns", x["a"], x["b"] - x["a"]), lambda u: u["text"]).alias("texts")),
    )
    talks = talks.select("conv_id", blocks.alias("blocks"))
    mark = lambda c: F.struct(c.alias("text"), F.lit(False).alias("loss"))

    def segments(b: Column) -> Column:
        body = F.flatten(
            F.transform(
                b["texts"],
                lambda x, i: F.array(
                    mark(F.when(i > 0, F.lit(t.join)).otherwise(F.lit(""))),
                    F.struct(t.escape(x).alias("text"), b["role"].isin(*t.trained).alias("loss")),
                ),
            )
        )
        return F.concat(F.array(mark(F.concat(F.lit(t.open), t.escape(b["role"]), F.lit(t.close)))), body, F.array(mark(F.lit(t.end))))

    out = talks.select("conv_id", F.flatten(F.transform("blocks", segments)).alias("segments"))
    return out.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Adds ``turns`` (role, text), read from ``formatted``, and ``loss_text``, the unescaped text under the loss mask."""
    t = template
    cut = lambda c, by: F.split(c, re.escape(by), -1)
    blocks = cut(F.col("formatted"), t.end)  # what follows the last end is empty
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)

    def turns(b: Column) -> Column:
        role = t.unescape(F.substring_index(F.substring_index(b, t.close, 1), t.open, -1))
        return F.transform(cut(F.element_at(cut(b, t.close), 2), t.join), lambda x: F.struct(role.alias("role"), t.unescape(x).alias("text")))

    under = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: t.unescape(s["text"]))
    return formatted.withColumns({"turns": F.flatten(F.transform(blocks, turns)), "loss_text": F.array_join(under, "")})
