"""Regular expressions for assignments, call chains and calls in script text.

They use no look-around. ``Patterns(possessive=True)`` is for Spark: possessive loops never backtrack, so
they are linear and need no stack, also on very long texts. ``Patterns(possessive=False)`` matches the
same texts in engines whose expressions are automata. Parentheses may nest ``depth`` levels deep.
"""

from __future__ import annotations

from functools import cached_property

NAME = r"[A-Za-z_]\w*"
HEAD = r"\bval\s+\w+(?:\s*:\s*[\w.\[\]]+)?\s*="
QUOTED = r'"([^"\n]*)"'

# The calls that the SQL form knows.
KNOWN_CALLS = (
    "read",
    "table",
    "select",
    "filter",
    "where",
    "join",
    "groupBy",
    "agg",
    "count",
    "orderBy",
    "distinct",
    "limit",
    "withColumn",
    "withColumnRenamed",
)

# Orders of calls whose meaning one query block would change, over " call call ... ".
ORDER_CHANGES_MEANING = (
    r" limit (?:.* )?(?:filter|where|join|groupBy|orderBy|distinct) "
    r"| groupBy (?:.* )?(?:join|groupBy) "
    r"| withColumn(?:Renamed)? (?:.* )?groupBy "
    r"| withColumnRenamed (?:.* )?select "
    r"| distinct (?:.* )?(?:join|groupBy|select|withColumn) "
    r"| orderBy (?:.* )?groupBy "
)
GROUPED_CALLS = r" groupBy (?:agg|count) "
LOOSE_GROUPING = r" (?:groupBy|agg|count) "

# Spelled join types (any case) that have an SQL keyword.
JOIN_SPELLING = (
    r"(?i:inner|cross|(?:left|right|full)(?:[\s_]*outer)?|outer|(?:left[\s_]*)?(?:semi|anti))(?i:[\s_]+join)?"
)


class Patterns:
    def __init__(self, possessive: bool, depth: int = 8):
        self.any, self.some, self.maybe = ("*+", "++", "?+") if possessive else ("*", "+", "?")
        self.depth = depth

    @cached_property
    def comment(self) -> str:
        """A string (group 1) or a comment (no group): replacing by group 1 removes comments only."""
        return rf'("[^"\n]{self.any}")|//[^\n]{self.any}|/\*[\s\S]*?\*/'

    @cached_property
    def arguments(self) -> str:
        text, string = r'[^()"]' + ("++" if self.any == "*+" else ""), rf'"[^"\n]{self.any}"'
        nested = rf"(?:{text}|{string}){self.any}"
        for _ in range(self.depth - 1):
            nested = rf"(?:{text}|{string}|\({nested}\)){self.any}"
        return nested

    @cached_property
    def call(self) -> str:
        return rf"\.\s*{NAME}(?:\s*\({self.arguments}\)){self.maybe}"

    @cached_property
    def chain(self) -> str:
        """An assigned chain. A closing bracket opener marks arguments that could not be read whole."""
        return rf"{HEAD}\s*{NAME}(?:\s*{self.call}){self.some}(?:[ \t]*[({{\[])?"

    @cached_property
    def assignment(self) -> str:
        """An assigned chain, or the head of an assignment that holds none."""
        return rf"{self.chain}|{HEAD}"

    @cached_property
    def readable_call(self) -> str:
        """Known calls with arguments that the SQL form understands."""
        string = r'"[^"\n]*"'
        strings = self._list(string)
        sort = r'(?:(?:asc|desc)\s*\(\s*"[^",\n]*"\s*\)|"[^",\n]*")'
        aggregate = rf"\w+\s*\(\s*{string}\s*\)(?:\s*\.\s*as\s*\(\s*{string}\s*\))?"
        shapes = {
            "table|filter|where": string,
            "select|groupBy": strings,
            "join": rf'{string}\s*,\s*{string}(?:\s*,\s*"{JOIN_SPELLING}")?',
            "agg": self._list(aggregate),
            "orderBy": self._list(sort),
            "limit": r"\d+",
            "count|distinct": "",
            "withColumn": rf"{string}\s*,[\s\S]+",
            "withColumnRenamed": rf"{string}\s*,\s*{string}",
        }
        calls = "|".join(rf"(?:{names})\s*\(\s*{shape}\s*\)" for names, shape in shapes.items())
        return rf"^\.\s*(?:read|{calls})$"

    def _list(self, item: str) -> str:
        return rf"{item}(?:\s*,\s*{item}){self.any}"


SPARK = Patterns(possessive=True)
