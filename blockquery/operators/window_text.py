"""Windows written as SQL text, computed so that no task sorts a hot key.

``function(arguments) OVER (PARTITION BY keys ORDER BY order frame)`` is read into its parts, wherever it stands in
an expression. Keys are counted when the query is built, one pass over the key columns. Where none has more than
``hot_rows`` rows, the text is Spark's own window. Else the rows of hot keys take the split ways of
``operators/windows.py``, and all others the text. A call that cannot be read or split is refused above that size:
it would sort all rows of a hot key in one task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockquery.functions.names import last_part, sort_name, split_sorts
from blockquery.operators import windows as win
from blockquery.operators.clauses import derive_columns

_NESTED = r"(?:[^()']|'[^']*'|\((?:[^()']|'[^']*'|\([^()]*\))*\))*"
_CALL = re.compile(rf"(?is)\b(?P<function>\w+)\s*\((?P<arguments>{_NESTED})\)\s*OVER\s*\((?P<window>{_NESTED})\)")
_WINDOW = re.compile(r"(?is)\s*(?:PARTITION\s+BY\s+(?P<keys>.+?))?\s*(?:\bORDER\s+BY\s+(?P<order>.+?))?\s*(?P<frame>\b(?:ROWS|RANGE)\b.*)?")
_ROWS = re.compile(r"(?is)ROWS\s+BETWEEN\s+(\w+)\s+(PRECEDING|ROW|FOLLOWING)\s+AND\s+(\w+)\s+(PRECEDING|ROW|FOLLOWING)")
_FROM_START = re.compile(r"(?is)ROWS\s+(?:UNBOUNDED\s+PRECEDING|BETWEEN\s+UNBOUNDED\s+PRECEDING\s+AND\s+CURRENT\s+ROW)")
_NAME = re.compile(r"`[^`]+`|\w+(?:\.(?:\w+|`[^`]+`))*")
_OVER = re.compile(r"(?i)\bOVER\b")
_QUOTED = re.compile(r"'[^']*'|`[^`]*`")


@dataclass(frozen=True)
class WindowCall:
    """One window call: where it stands in its text, and its parts; ``keys`` and ``order`` name columns."""

    text: str
    function: str
    arguments: tuple[str, ...]
    keys: tuple[str, ...]
    order: tuple[str, ...]
    frame: str


def read_calls(text: str) -> list[WindowCall] | None:
    """The window calls of an expression, none if it has none; None if one of them cannot be read."""
    calls = []
    for m in _CALL.finditer(text):
        parts = _WINDOW.fullmatch(m["window"])
        if parts is None:
            return None
        keys, order = ([k.strip() for k in split_sorts(parts[p])] if parts[p] else [] for p in ("keys", "order"))
        arguments = [a.strip() for a in split_sorts(m["arguments"])] if m["arguments"].strip() else []
        try:
            sorts = [(o, sort_name(o)) for o in order]
        except TypeError:  # a sort text that names no column
            return None
        if not all(map(_NAME.fullmatch, keys)) or not all(_NAME.fullmatch(n) or f"`{n}`" in o for o, n in sorts):
            return None
        frame = " ".join((parts["frame"] or "").split())
        calls.append(WindowCall(m[0], m["function"].lower(), tuple(arguments), tuple(_plain(k) for k in keys), tuple(map(_plain_sort, order)), frame))
    left = _QUOTED.sub("", _CALL.sub("", text))
    return None if _OVER.search(left) else calls


def _plain(name: str) -> str:
    return last_part(name).strip("`")


def _plain_sort(text: str) -> str:
    name = sort_name(text)
    return text.replace(name, _plain(name), 1)


def split_way(call: WindowCall, name: str) -> Callable[[win.Hot], DataFrame] | None:
    """How the rows of hot keys get the call as column ``name``; None if there is no split way for it."""
    fn, order = call.function, list(call.order)
    value = F.lit(1) if call.arguments in ((), ("*",)) else F.expr(call.arguments[0])
    running = fn in win.TOTAL and len(call.arguments) == 1
    if not order and not call.frame and call.arguments:
        whole = {name: F.expr(f"{fn}({', '.join(call.arguments)})")}
        return lambda hot: win.partition_totals(hot.rows, hot.keys, whole)
    if not order:
        return None
    if fn == "row_number" and not call.arguments:
        return lambda hot: win._running_chunked(hot, hot.keys, order, {name: ("count", F.lit(1))})
    if running and _FROM_START.fullmatch(call.frame):
        return lambda hot: win._running_chunked(hot, hot.keys, order, {name: (fn, value)})
    if running and not call.frame:  # rows that tie see each other: totals of counted values, then running ones
        return lambda hot: _with_ties(hot, order, fn, value, name)
    if fn in ("rank", "dense_rank") and not call.arguments:
        other = f"{name}_other"
        names = (name, other) if fn == "rank" else (other, name)
        return lambda hot: win.ranks(hot.rows, hot.keys, order, *names, hot.hot_rows).drop(other)
    if fn == "ntile" and len(call.arguments) == 1 and call.arguments[0].isdigit():
        return lambda hot: win.ntiles(hot.rows, hot.keys, order, int(call.arguments[0]), name, hot.hot_rows)
    if fn in ("lag", "lead") and not call.frame and (len(call.arguments) == 1 or len(call.arguments) == 2 and call.arguments[1].isdigit()):
        far = int(call.arguments[1]) if len(call.arguments) == 2 else 1
        column = {name: lambda w: getattr(F, fn)(value, far).over(w)}
        return lambda hot: win.neighbours(hot.rows, hot.keys, order, column, **{"before" if fn == "lag" else "after": far}, hot_rows=hot.hot_rows)
    bounds = _bounds(call.frame)
    if bounds and fn in (*win.TOTAL, "avg") and len(call.arguments) == 1:
        column = {name: lambda w: getattr(F, fn)(value).over(w.rowsBetween(*bounds))}
        return lambda hot: win.neighbours(hot.rows, hot.keys, order, column, max(0, -bounds[0]), max(0, bounds[1]), hot.hot_rows)
    return None


def _bounds(frame: str) -> tuple[int, int] | None:
    m = _ROWS.fullmatch(frame)
    if not m:
        return None
    out = []
    for amount, side in ((m[1], m[2]), (m[3], m[4])):
        if side.lower() == "row" and amount.lower() == "current":
            out.append(0)
        elif amount.isdigit() and side.lower() != "row":
            out.append(int(amount) * (-1 if side.lower() == "preceding" else 1))
        else:
            return None
    return out[0], out[1]


def _with_ties(hot: win.Hot, order: list[str], fn: str, value: Column, name: str) -> DataFrame:
    values = [v for o in order if (v := sort_name(o)) not in hot.keys]
    counted = hot.rows.groupBy(*hot.keys, *values).agg(getattr(F, fn)(value).alias(f"_{name}"))
    total = "sum" if fn == "count" else fn
    upto = win.running(counted, hot.keys, order, {name: (total, f"_{name}")}, hot.hot_rows)
    return win.attach(hot.rows, upto.select(*hot.keys, *values, name), [*hot.keys, *values])


def window_columns(df: DataFrame, expressions: Mapping[str, str | Column], alias: str | None = None, hot_rows: int | None = None) -> DataFrame:
    """``df`` with window expressions as new columns; see the module for what happens to hot keys.

    ``alias`` is the name that qualifies the columns of ``df`` before and after. Rows of hot keys cannot be split
    where several columns share a name, as after a join; that is refused too. Windows given as ``Column`` are
    Spark's own.
    """
    read = {n: read_calls(e) for n, e in expressions.items() if isinstance(e, str)}
    limit = hot_rows or win.HOT_ROWS
    if None in read.values() and df.limit(limit + 1).count() > limit:
        unread = [expressions[n] for n, calls in read.items() if calls is None]
        raise ValueError(f"cannot split windows of {unread} over more than {limit} rows; write them as fn(..) OVER (PARTITION BY names ORDER BY names), or raise hot_rows")
    calls = list(dict.fromkeys(c for found in read.values() for c in found or ()))
    hot_keys = {}
    for keys in dict.fromkeys(c.keys for c in calls):
        hot_keys[keys] = _has_hot(df, next(c for c in calls if c.keys == keys), limit)
    todo = [c for c in calls if hot_keys[c.keys]]
    if not todo:
        return derive_columns(df, expressions)
    names = [c.lower() for c in df.columns]
    for call in todo:
        if split_way(call, "_") is None or len(set(names)) < len(names):
            raise ValueError(f"a key of {call.text!r} has more than {limit} rows, and this window cannot be split here; raise hot_rows to let one task sort them")
    out, columns = df, {}
    for i, call in enumerate(todo):
        columns[call.text] = f"_window_{i}"
        out = _split(out, call, columns[call.text], limit)
        out = out.alias(alias) if alias else out
    done = {}
    for name, e in expressions.items():
        if isinstance(e, str):
            for text, column in columns.items():
                e = e.replace(text, column)
        done[name] = e
    return derive_columns(out, done).drop(*columns.values())


def _has_hot(df: DataFrame, call: WindowCall, limit: int) -> bool:
    if not call.keys:
        return df.limit(limit + 1).count() > limit
    keys = [F.expr(k) for k in split_sorts(_WINDOW.fullmatch(_CALL.search(call.text)["window"])["keys"])]
    return not df.groupBy(*keys).count().filter(F.col("count") > limit).isEmpty()


def _split(df: DataFrame, call: WindowCall, name: str, limit: int) -> DataFrame:
    def cold_way(part: DataFrame) -> DataFrame:
        return part.withColumn(name, F.expr(plain))

    plain = call.text
    for qualified in re.findall(r"\b\w+\.(?=[\w`])", call.text):  # the split rows have lost their table's name
        plain = plain.replace(qualified, "") if qualified[0].isalpha() else plain
    bare = read_calls(plain)[0]
    keys = list(call.keys) or [win.ALL]
    rows = df if call.keys else df.withColumn(win.ALL, F.lit(0))
    out = win._both(*win.split_hot(rows, keys, limit), cold_way, split_way(bare, name))
    return out if call.keys else out.drop(win.ALL)
