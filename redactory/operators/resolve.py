"""Merging and overlap resolution of span arrays, as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.expr import any_of, blocked_fold, cases, empty, fold, keep, let, record, sorted_by
from ..schema import SPAN_DDL, SPANS_DDL

NONE = empty(SPANS_DDL)


def by_position(spans: str) -> str:
    """Order by start, end, type."""
    return sorted_by(spans, a=lambda s, i: f"{s}.start", b=lambda s, i: f"{s}.`end`",
                     c=lambda s, i: f"{s}.entity_type")


def in_position(spans: str) -> str:
    """The spans ordered by start, end, type; sorted only if they are not yet."""
    def late(i: str) -> str:
        a, b = f"{spans}[{i} - 1]", f"{spans}[{i}]"
        return (f"{a}.start > {b}.start OR ({a}.start = {b}.start AND ({a}.`end` > {b}.`end` "
                f"OR ({a}.`end` = {b}.`end` AND {a}.entity_type > {b}.entity_type)))")

    return f"IF({any_of(f'sequence(1, size({spans}) - 1)', late)}, {by_position(spans)}, {spans})"


def merge_spans(first: str, second: str) -> str:
    """Union on (type, start, end); the first list wins."""

    def same(a: str, b: str) -> str:
        return (f"{a}.entity_type = {b}.entity_type AND {a}.start = {b}.start AND {a}.`end` = {b}.`end`")

    def body(p: str) -> str:
        fresh = keep(f"{p}.b", lambda s: "NOT " + any_of(f"{p}.a", lambda k: same(k, s)))
        return f"IF(size({p}.b) = 0, {p}.a, concat({p}.a, {fresh}))"

    return let(record(a=first, b=second), body)


def keep_best(spans: str) -> str:
    """Spans to rewrite: greedy by score, then length, then start, then type.

    Spans are first cut into runs that overlap each other, because a span can
    only lose to one in its own run.  The cost is then linear in the number of
    spans and quadratic only inside a run.
    """

    def winners(run: str) -> str:
        ranked = sorted_by(run, a=lambda s, i: f"-{s}.score", b=lambda s, i: f"{s}.start - {s}.`end`",
                           c=lambda s, i: f"{s}.start", d=lambda s, i: f"{s}.entity_type")

        def take(kept: str, s: str) -> str:
            clash = any_of(kept, lambda k: f"{k}.start < {s}.`end` AND {s}.start < {k}.`end`")
            return f"IF({clash}, {kept}, concat({kept}, array({s})))"

        return f"IF(size({run}) < 2, {run}, {by_position(fold(ranked, NONE, take))})"

    def step(state: str, s: str) -> tuple[str, str]:
        joins = f"{s}.start < {state}.reach"
        run = f"IF({joins}, concat({state}.run, array({s})), array({s}))"
        return (record(run=run, reach=f"greatest({state}.reach, {s}.`end`)"),
                f"IF({joins}, {NONE}, {winners(state + '.run')})")

    zero = record(run=NONE, reach="0")
    def resolved(o: str) -> str:
        folded = blocked_fold(o, zero, step, SPAN_DDL, finish=lambda state: winners(f"{state}.run"))
        # In order, spans overlap if and only if two neighbours do.
        overlap = any_of(f"sequence(1, size({o}) - 1)", lambda i: f"{o}[{i}].start < {o}[{i} - 1].`end`")
        return f"IF({overlap}, {folded}, {o})"

    return f"IF(size({spans}) < 2, {spans}, {let(in_position(spans), resolved)})"


def keep_for_display(spans: str) -> str:
    """Spans to show: left to right, a later span replaces the one it overlaps
    only when its score is higher."""
    ordered = sorted_by(spans, a=lambda s, i: f"{s}.start", b=lambda s, i: f"-{s}.score",
                        c=lambda s, i: f"{s}.`end`", d=lambda s, i: f"{s}.entity_type")

    # Only the newest shown span can still change, so it is the state of the fold.
    def step(last: str, s: str) -> tuple[str, str]:
        empty_yet = f"size({last}) = 0"
        clear = f"{s}.start >= {last}[0].`end`"
        better = f"{s}.score > {last}[0].score"
        new = cases((empty_yet, f"array({s})"), (f"{clear} OR {better}", f"array({s})"), other=last)
        out = cases((empty_yet, NONE), (clear, last), other=NONE)
        return new, out

    return let(ordered, lambda o: blocked_fold(o, NONE, step, SPAN_DDL, finish=lambda last: last))


def merge_rows(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Row form of ``merge_spans``: dedupe two detection tables, the first wins.

    An aggregate with partial combine, so a hot key costs one row per task.
    """
    columns = first.columns
    rest = [c for c in columns if c not in keys]
    both = first.withColumn("_side", F.lit(0)).unionByName(second.withColumn("_side", F.lit(1)))
    picked = both.groupBy(*keys).agg(F.min_by(F.struct(*rest), "_side").alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*columns)
