"""A reasoner that asks a model client (L3, L5, L7, L10, L13, L14, L17; U3).

Every question is a prompt: an instruction and one line of JSON with what is asked about.
Replies are JSON, repaired where need be; a reply that says nothing usable counts as the
answer that changes least (no, or no heading). Calls are made on executors, each task with
its own client, and are marked as not deterministic so that a plan asks each question once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import text as t
from quire.plans.reasoner import RuleReasoner
from quire.plans.transport import ATTEMPTS, Client, retried

#: Instructions, one for each question; the words are this library's own.
INSTRUCTIONS = {
    "lists_contents": 'Does this page hold a table of contents? Lists of figures or symbols are none. Reply {"answer": "yes" or "no"}.',
    "has_page_numbers": 'Does this table of contents give page numbers? Reply {"answer": "yes" or "no"}.',
    "complete": 'Was every line of this table of contents taken over? Reply {"answer": "yes" or "no"}.',
    "on_page": 'Does a section with this title appear or begin on the page? Ignore spaces. Reply {"answer": "yes" or "no"}.',
    "starts_page": 'Does the section with this title begin at the very top of the page? Ignore spaces. Reply {"answer": "yes" or "no"}.',
    "heading": 'Give the title of the section that begins on this page, or null. Reply {"answer": title or null}.',
    "summary": "Describe the main points of this text in a short paragraph. Reply with the paragraph only.",
}


class ModelReasoner(RuleReasoner):
    """``factory`` makes a client (prompt -> text, finish reason, usage) in each task.

    ``at_once`` bounds the calls of a task; calls that keep failing answer ``Error``, which is no.
    """

    plain = False

    def __init__(self, factory: Callable[[], Client], at_once: int = 8, attempts: int = ATTEMPTS, instructions: dict[str, str] | None = None):
        super().__init__()
        self.instructions = INSTRUCTIONS | (instructions or {})

        @F.pandas_udf("string")
        def ask(prompts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            client = factory()
            with ThreadPoolExecutor(at_once) as pool:
                for p in prompts:
                    yield pd.Series(list(pool.map(lambda x: None if x is None else retried(client, x, attempts)[0], p)), dtype=object)

        self._ask = ask.asNondeterministic()

    def _reply(self, task: str, **about: Column) -> Column:
        subject = F.to_json(F.struct(F.lit(task).alias("task"), *(c.alias(n) for n, c in about.items())))
        return self._ask(F.concat(F.lit(self.instructions[task] + "\n"), subject))

    def _answer(self, task: str, **about: Column) -> Column:
        return F.get_json_object(t.repaired_json(F.coalesce(self._reply(task, **about), F.lit(""))), "$.answer")

    def _yes(self, task: str, **about: Column) -> Column:
        return F.lower(t.strip(F.coalesce(self._answer(task, **about), F.lit("no")))) == "yes"

    def lists_contents(self, page: Column) -> Column:
        return F.when(self._yes("lists_contents", page=page), "yes").otherwise("no")

    def has_page_numbers(self, contents: Column) -> Column:
        return F.when(self._yes("has_page_numbers", contents=contents), "yes").otherwise("no")

    def complete(self, raw: Column, cleaned_items: Column) -> Column:
        return F.when(self._yes("complete", contents=raw, items=cleaned_items), "yes").otherwise("no")

    def on_page(self, title: Column, page: Column) -> Column:
        return self._yes("on_page", title=title, page=page)

    def starts_page(self, title: Column, page: Column) -> Column:
        return self._yes("starts_page", title=title, page=page)

    def heading(self, page: Column) -> Column:
        return F.nullif(t.collapse(self._answer("heading", page=page)), F.lit(""))

    def summary(self, text: Column) -> Column:
        return self._reply("summary", text=text)
