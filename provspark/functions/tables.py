"""Table functions for SQL: what a text holds, as rows for a lateral join. `register` gives a session all of them.

    select p.id, l.line from patches p, lateral changed_lines(p.patch) l
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from provspark.functions import text
from provspark.operators import bind, records


@udtf(returnType="line int")
class ChangedLines:
    """Numbers, in the new file, of the lines that a patch of one file adds; a null patch has none."""

    def eval(self, patch: str) -> Iterator[tuple[int]]:
        yield from ((line,) for line in bind.lines_added(patch))


@udtf(returnType="nth int, sentence string")
class Sentences:
    """Sentences and lines of a text without their bullets, in order from 0."""

    def eval(self, said: str) -> Iterator[tuple[int, str]]:
        yield from enumerate(text.sentences_of(said))


@udtf(returnType="nth int, title string, item string")
class ChangelogItems:
    """Bullets of a changelog with the heading that they stand under, in order from 0."""

    def eval(self, said: str) -> Iterator[tuple[int, str, str]]:
        yield from ((n, *found) for n, found in enumerate(records.changelog_items(said or "")))


@udtf(returnType="nth int, content string, reason string, alternatives array<string>, tier string")
class Decisions:
    """Sentences of a text that look like decisions, in parts."""

    def eval(self, said: str) -> Iterator[tuple[int, str, str, list[str], str]]:
        for n, s in enumerate(x for x in text.sentences_of(said) if text.says_decision(x)):
            content, reason, alternatives = text.parts_of_sentence(s)
            yield n, content, reason, alternatives, "decision" if reason.strip() or alternatives else "event"


FUNCTIONS = {"changed_lines": ChangedLines, "sentences": Sentences, "changelog_items": ChangelogItems, "decisions_in": Decisions}


def register(spark: SparkSession) -> None:
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)
