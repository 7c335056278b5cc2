"""Reasoning steps behind one interface.

The steps that need judgement ask a ``Reasoner``. The default, ``RuleReasoner``, answers
by deterministic rules written as columns, so plans stay inside the JVM and can be tested.
These rules are this library's own; they do not stand for what a language model would say.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import text as t


class Reasoner(Protocol):
    def lists_contents(self, page: Column) -> Column: ...
    def has_page_numbers(self, contents: Column) -> Column: ...
    def on_page(self, title: Column, page: Column) -> Column: ...
    def starts_page(self, title: Column, page: Column) -> Column: ...
    def heading(self, page: Column) -> Column: ...
    def summary(self, text: Column) -> Column: ...


#: A contents line: an optional number, a title, and dots or space before a page number.
CONTENTS_LINE = r"^\s*(?:(\d+(?:\.\d+)*)\.?\s+)?(\S.*?)\s*(?:(?:\.\s?){3,}|\s{2,}|:\s)\s*(\d+)?\s*$"
_NUMBERED = r"^\s*\S.*?(?:(?:\.\s?){3,}|\s{2,}|:\s)\s*\d+\s*$"


def leading_sentences(text: Column, n: int = 2) -> Column:
    """The first sentences of a text."""
    x = t.collapse(text)
    cut = F.regexp_extract(x, rf"^((?:[^.!?]*[.!?]+(?:\s|$)){{1,{n}}})", 1)
    return F.when(cut != "", t.strip(cut)).otherwise(x)


def contents_lines(contents: Column) -> Column:
    """``array<struct<structure, title, page_raw>>`` of contents text, in order."""
    lines = F.filter(F.split(t.dot_leaders(contents), "\n"), lambda x: F.trim(x) != "")
    pick = lambda x, k: F.regexp_extract(x, CONTENTS_LINE, k)
    return F.transform(
        F.filter(lines, lambda x: x.rlike(CONTENTS_LINE) & ~F.lower(F.trim(x)).isin("contents", "table of contents")),
        lambda x: F.struct(F.nullif(pick(x, 1), F.lit("")).alias("structure"), F.regexp_replace(F.trim(pick(x, 2)), r"\s*:$", "").alias("title"), F.nullif(pick(x, 3), F.lit("")).alias("page_raw")),
    )


class RuleReasoner:
    """Deterministic answers: squashed containment, contents patterns, leading sentences."""

    #: Answers are columns that cost little, so any page may be asked where it is.
    plain = True

    def __init__(self, min_lines: int = 3, heading_words: int = 8, summary_sentences: int = 2):
        self.min_lines, self.heading_words, self.summary_sentences = min_lines, heading_words, summary_sentences

    def lists_contents(self, page: Column) -> Column:
        """``yes`` or ``no``: enough lines that end in a page number, or a contents heading with one (L3)."""
        lines = F.split(page, "\n")
        numbered = F.size(F.filter(lines, lambda x: x.rlike(_NUMBERED)))
        heading = F.exists(lines, lambda x: F.lower(F.trim(x)).isin("contents", "table of contents"))
        return F.when((numbered >= self.min_lines) | (heading & (numbered > 0)), "yes").otherwise("no")

    def has_page_numbers(self, contents: Column) -> Column:
        """``yes`` if at least half of the contents lines end in a number."""
        lines = F.filter(F.split(contents, "\n"), lambda x: F.trim(x) != "")
        numbered = F.size(F.filter(lines, lambda x: x.rlike(r"\d+\s*$")))
        return F.when((F.size(lines) > 0) & (2 * numbered >= F.size(lines)), "yes").otherwise("no")

    def complete(self, raw: Column, cleaned_items: Column) -> Column:
        """``yes`` if as many items came out as contents lines went in."""
        return F.when(F.size(contents_lines(raw)) == cleaned_items, "yes").otherwise("no")

    def on_page(self, title: Column, page: Column) -> Column:
        """Whether a title appears on a page, whatever its case and spaces; null is no."""
        return F.coalesce(F.contains(t.squash(page), t.squash(title)) & (t.squash(title) != ""), F.lit(False))

    def starts_page(self, title: Column, page: Column) -> Column:
        """Whether a page begins with a title; null is no."""
        return F.coalesce(F.startswith(t.squash(page), t.squash(title)) & (t.squash(title) != ""), F.lit(False))

    def heading(self, page: Column) -> Column:
        """A section title that begins on a page, or null: its first words up to a full stop.

        The rule sees one page, so earlier chunks influence nothing but the numbering.
        """
        first = F.element_at(F.split(t.strip(page), "\n"), 1)
        sentence = t.collapse(F.regexp_extract(first, r"^([^.!?]{3,80})[.!?]?", 1))
        few = F.size(t.words(sentence)) <= self.heading_words
        return F.when((sentence != "") & few, sentence)

    def summary(self, text: Column) -> Column:
        return leading_sentences(text, self.summary_sentences)


class ScriptedReasoner(RuleReasoner):
    """A reasoner for tests: given answers of ``on_page`` by title, rules for the rest."""

    def __init__(self, wrong_titles: list[str], **rules):
        super().__init__(**rules)
        self.wrong_titles = wrong_titles

    def on_page(self, title: Column, page: Column) -> Column:
        return ~title.isin(*self.wrong_titles) & super().on_page(title, page) if self.wrong_titles else super().on_page(title, page)
