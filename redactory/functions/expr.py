"""Building blocks for larger expressions, as Spark SQL text.

Detection and rewriting are long nested expressions.  They are composed as SQL
text and handed to Spark in one ``F.expr``: the JVM parses the text once, where
thousands of single Column calls would each cross from Python to the JVM.

All helpers take and return SQL text.  Lambda variables get fresh names.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

_fresh = itertools.count(1)


def quoted(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def raw(pattern: str) -> str:
    """A regular expression literal; backslashes are taken as written."""
    if "'" in pattern:
        return quoted(pattern)
    return f"r'{pattern}'"


def fn(body: Callable[..., str], *prefixes: str) -> str:
    """A lambda function with freshly named variables."""
    n = next(_fresh)
    names = [f"{p}{n}" for p in prefixes]
    head = names[0] if len(names) == 1 else "(" + ", ".join(names) + ")"
    return f"{head} -> {body(*names)}"


def let(value: str, body: Callable[[str], str], name: str = "v") -> str:
    """``body(value)`` with ``value`` evaluated once per row."""
    return f"element_at(transform(array({value}), {fn(body, name)}), 1)"


def transform(items: str, body: Callable[..., str], *names: str) -> str:
    return f"transform({items}, {fn(body, *(names or ('x',)))})"


def keep(items: str, body: Callable[[str], str]) -> str:
    return f"filter({items}, {fn(body, 'x')})"


def any_of(items: str, body: Callable[[str], str]) -> str:
    return f"exists({items}, {fn(body, 'x')})"


def fold(items: str, zero: str, step: Callable[[str, str], str],
         finish: Callable[[str], str] | None = None) -> str:
    tail = f", {fn(finish, 'a')}" if finish else ""
    return f"aggregate({items}, {zero}, {fn(step, 'a', 'x')}{tail})"


def record(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def empty(ddl: str) -> str:
    return f"cast(array() as {ddl})"


def cases(*branches: tuple[str, str], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in branches) + f" ELSE {other} END"


def in_list(value: str, items) -> str:
    return f"{value} IN ({', '.join(quoted(i) for i in items)})"


def sorted_by(items: str, **keys: Callable[[str], str] | str) -> str:
    """Items ordered by computed keys, first key first."""

    def keyed(x: str, i: str) -> str:
        return record(**{k: body(x, i) for k, body in keys.items()}, item=x)

    return transform(f"array_sort({transform(items, keyed, 'x', 'i')})", lambda k: f"{k}.item")


BLOCK = 256


def blocked_fold(items: str, state: str, step: Callable[[str, str], tuple[str, str]], out_ddl: str,
                 finish: Callable[[str], str] | None = None) -> str:
    """Left fold that emits rows along the way, in time linear in the input.

    ``step(state, item)`` gives ``(new state, array of emitted rows)``.  Appending
    to one growing array would copy it at every step, so rows are gathered per
    block of items and the blocks are flattened once.
    """
    def inner(acc: str, item: str) -> str:
        new, rows = step(f"{acc}.state", item)
        return record(state=new, rows=f"concat({acc}.rows, {rows})")

    def outer(acc: str, block: str) -> str:
        zero = record(state=f"{acc}.state", rows=empty(f"array<{out_ddl}>"))
        done = fold(f"slice({items}, {block} * {BLOCK} + 1, {BLOCK})", zero, inner)
        return let(done, lambda d: record(state=f"{d}.state", outs=f"concat({acc}.outs, array({d}.rows))"))

    def result(acc: str) -> str:
        rows = f"flatten({acc}.outs)"
        return f"concat({rows}, {finish(acc + '.state')})" if finish else rows

    zero = record(state=state, outs=empty(f"array<array<{out_ddl}>>"))
    return fold(f"sequence(0, (size({items}) - 1) div {BLOCK})", zero, outer, result)


NON_SPACE = r"[^ \t\r\n\f]"


def is_blank(c: str) -> str:
    """Null, empty or white space only."""
    return f"({c} IS NULL OR NOT rlike({c}, {raw(NON_SPACE)}))"
