"""Names as people write them: dotted, with blanks, packed in one string, with a sort direction."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings (blanks, underscores and a closing "join" removed) -> Spark's name.
JOIN_TYPES = {
    "inner": "inner",
    "cross": "cross",
    "left": "left",
    "leftouter": "left",
    "right": "right",
    "rightouter": "right",
    "full": "full",
    "outer": "full",
    "fullouter": "full",
    "semi": "left_semi",
    "leftsemi": "left_semi",
    "anti": "left_anti",
    "leftanti": "left_anti",
}

_SORT = re.compile(
    r"^(?P<name>.*?)(?:\s+(?P<direction>asc|desc))?(?:\s+nulls\s+(?P<nulls>first|last))?$",
    re.IGNORECASE | re.DOTALL,
)
_SORT_CALL = re.compile(r"""^(?P<direction>asc|desc)\(\s*["']?(?P<name>.*?)["']?\s*\)$""", re.IGNORECASE | re.DOTALL)
_KEYS = re.compile(r"""(?:[^,()'"`]|'[^']*'|"[^"]*"|`[^`]*`|\((?:[^()]|\([^()]*\))*\))+""")
_PLAIN = re.compile(r"^[\w\s.`]+$")


def quote(name: str) -> str:
    """Back-tick every dotted part of ``name``; text that already has back-ticks and ``*`` stay."""
    if "`" in name:
        return name
    return ".".join(part if part == "*" else f"`{part}`" for part in name.split("."))


def column(name: str | Column) -> Column:
    """A column by its written name, which may be dotted or contain blanks."""
    return F.col(quote(name.strip())) if isinstance(name, str) else name


def last_part(name: str) -> str:
    """The column part of a possibly qualified name, without back-ticks."""
    if name.endswith("`"):
        return name[name.rindex("`", 0, -1) + 1 : -1]
    return name.rsplit(".", 1)[-1]


def split_names(names: str | Iterable[str | Column]) -> list[str | Column]:
    """Flatten names of which several may be packed in one string: ``"a, b"`` -> ``["a", "b"]``."""
    flat: list[str | Column] = []
    for name in [names] if isinstance(names, (str, Column)) else names:
        if isinstance(name, Column) or "`" in name:
            flat.append(name)
        else:
            flat.extend(part.strip() for part in name.split(",") if part.strip())
    return flat


def split_sorts(keys: str | Iterable[str | Column]) -> list[str | Column]:
    """Flatten sort keys of which several may be packed in one text: ``"a DESC, b"`` -> ``["a DESC", "b"]``.

    Commas in parentheses, quotes or back-ticks belong to a key.
    """
    flat: list[str | Column] = []
    for key in [keys] if isinstance(keys, (str, Column)) else keys:
        if isinstance(key, Column):
            flat.append(key)
        else:
            flat.extend(part.strip() for part in _KEYS.findall(key) if part.strip())
    return flat


def sort_name(text: str) -> str:
    """The column that a plain sort text names, without its direction."""
    match = _SORT_CALL.match(text.strip()) or _SORT.match(text.strip())
    return match["name"].strip().strip("`")


def reversed_sort(text: str) -> Column:
    """The opposite order of a sort text, NULLs included."""
    match = _SORT_CALL.match(text.strip()) or _SORT.match(text.strip())
    parts = match.groupdict()
    up = (parts["direction"] or "asc").lower() == "asc"
    nulls = (parts.get("nulls") or ("first" if up else "last")).lower()
    key = column(parts["name"].strip()) if _PLAIN.match(parts["name"].strip()) else F.expr(parts["name"])
    return getattr(key, f"{'desc' if up else 'asc'}_nulls_{'last' if nulls == 'first' else 'first'}")()


def sort_column(text: str | Column) -> Column:
    """A sort key from ``"c"``, ``"c DESC"``, ``"c ASC NULLS LAST"`` or ``"desc(c)"``."""
    if isinstance(text, Column):
        return text
    match = _SORT_CALL.match(text.strip()) or _SORT.match(text.strip())
    parts = match.groupdict()
    name = parts["name"].strip()
    key = column(name) if _PLAIN.match(name) else F.expr(name)
    order = (parts["direction"] or "asc").lower()
    nulls = parts.get("nulls")
    return getattr(key, f"{order}_nulls_{nulls.lower()}" if nulls else order)()


def join_type(text: str) -> str:
    """Spark's join type for any accepted spelling, such as ``"LEFT OUTER JOIN"`` or ``"leftanti"``."""
    key = re.sub(r"[\s_]+", "", text.lower()).removesuffix("join")
    if key not in JOIN_TYPES:
        raise ValueError(f"unknown join type {text!r}")
    return JOIN_TYPES[key]


def base_of(select: Iterable[str | Column] | None) -> str:
    """The table named by the first qualified column of a select list."""
    for name in select or ():
        if isinstance(name, str) and "." in name:
            return name.split(".", 1)[0].strip("` ")
    raise ValueError("no base table given and no qualified column to take it from")
