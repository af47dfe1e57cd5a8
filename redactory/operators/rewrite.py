"""Rewriting: spans -> new text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from .. import fixed_values as fv
from ..functions import text as tx
from ..functions.expr import cases, fold, in_list, let, quoted, record, sorted_by, transform
from ..policy import Policy
from .resolve import keep_best, keep_for_display
from .synth import fake_value


def rebuild(text: str, spans: str, replacement: Callable[[str], str],
            plain: Callable[[str], str] = lambda c: c) -> str:
    """Text with each span replaced; spans must be disjoint, sorted and not empty.

    Pieces are built by index (gap, replacement, gap, ...) and joined once; gaps are read from the text's chunks,
    so the time is linear in the text and its spans.
    """
    def pieces(cut: str) -> str:
        def piece(s: str, i: str) -> str:
            past = f"IF({i} = 0, 0, get({spans}, {i} - 1).`end`)"
            gap = let(past, lambda p: tx.part(text, cut, p, f"{s}.start - {p}"))
            return f"concat({plain(gap)}, {replacement(s)})"

        return f"array_join({transform(spans, piece, 's', 'i')}, '')"

    tail = f"substring({text}, element_at({spans}, -1).`end` + 1)"
    return f"concat({let(tx.chunks(text), pieces)}, {plain(tail)})"


def replacement_for(operator: str, policy: Policy, span: str) -> str:
    covered = f"{span}.text"
    if operator == "replace":
        return f"concat('<', {span}.entity_type, '>')"
    if operator == "redact":
        return "''"
    if operator == "mask":
        return (f"concat(repeat('*', least({fv.MASK_CHARS}, length({covered}))), "
                f"substring({covered}, {fv.MASK_CHARS + 1}))")
    if operator == "hash":
        return f"sha2(concat({quoted(policy.salt)}, {covered}), 256)"
    if operator == "synthesize":
        return fake_value(f"{span}.entity_type", covered, policy.seed)
    raise ValueError(f"unknown operator: {operator}")


def span_replacement(policy: Policy, span: str) -> str:
    """One CASE over the entity types whose operator differs from the default."""
    default = replacement_for(policy.operator, policy, span)
    by_operator: dict[str, list[str]] = {}
    for entity, operator in policy.operators.items():
        if operator != policy.operator:
            by_operator.setdefault(operator, []).append(entity)
    if not by_operator:
        return default
    return cases(*((in_list(f"{span}.entity_type", entities), replacement_for(operator, policy, span))
                   for operator, entities in by_operator.items()), other=default)


def rewrite_sql(text: str, kept: str, policy: Policy) -> str:
    """Apply the policy's operators to resolved spans; untouched text passes through."""
    return f"IF(size({kept}) > 0, {rebuild(text, kept, lambda s: span_replacement(policy, s))}, {text})"


def rewrite(df: DataFrame, text_col: str, spans_col: str, policy: Policy,
            out_col: str = "anonymized_text", resolved: bool = False) -> DataFrame:
    """Add the rewritten text; ``resolved`` spans are those to rewrite, in order (``detect`` with ``best``)."""
    kept = f"`{spans_col}`" if resolved else keep_best(f"`{spans_col}`")
    return df.withColumn(out_col, F.expr(let(kept, lambda k: rewrite_sql(f"`{text_col}`", k, policy))))


def rewrite_given_spans(text: str, spans: str, operator: str) -> str:
    """Rewrite from caller-supplied spans: right to left, each against the text as
    it stands, so a span that no longer fits is skipped.  Used for literal lists.

    mask keeps between 4 and 20 stars, hash leaves a <TYPE_HASH> tag.
    """
    if operator not in ("replace", "redact", "mask", "hash"):
        raise ValueError(f"unknown operator: {operator}")
    ordered = sorted_by(spans, a=lambda s, i: f"-{s}.start", b=lambda s, i: i)

    def stand_in(s: str) -> str:
        if operator == "redact":
            return "''"
        if operator == "mask":
            return f"repeat('*', greatest(4, least(20, {s}.`end` - {s}.start)))"
        return f"concat('<', {s}.entity_type, '{'_HASH>' if operator == 'hash' else '>'}')"

    def step(out: str, s: str) -> str:
        fits = f"{s}.start >= 0 AND {s}.`end` > {s}.start AND {s}.`end` <= length({out})"
        new = f"concat(substring({out}, 1, {s}.start), {stand_in(s)}, substring({out}, {s}.`end` + 1))"
        return f"IF({fits}, {new}, {out})"

    return fold(ordered, text, step)


def annotate_sql(text: str, spans: str) -> str:
    """Text for reviewers: plain parts escaped, spans as `text` *(Label · 85%)*."""

    def mark(s: str) -> str:
        return (f"concat('`', {tx.escape_markup(s + '.text')}, '` *(', {tx.entity_label(s + '.entity_type')}, "
                f"' · ', format_string('%.0f%%', bround({s}.score * 100, 0)), ')*')")

    shown = let(keep_for_display(spans), lambda k: rebuild(text, k, mark, tx.escape_markup))
    return f"IF(size({spans}) > 0, {shown}, '*No PII detected.*')"


def counts_sql(spans: str) -> str:
    """map<entity type, count>, types in first-seen order."""
    types = f"array_distinct({transform(spans, lambda s: s + '.entity_type')})"
    entry = lambda t: record(
        key=t, value=f"cast(size(filter({spans}, c -> c.entity_type = {t})) as bigint)")
    return f"map_from_entries({transform(types, entry)})"


def summary_sql(counts: str) -> str:
    """n× TYPE, ... in map order."""
    parts = transform(f"map_entries({counts})", lambda e: f"concat(cast({e}.value as string), '× ', {e}.key)")
    return f"IF(size({counts}) = 0, 'No PII detected', array_join({parts}, ', '))"


def annotate(df: DataFrame, text_col: str, spans_col: str = "spans", out_col: str = "annotated") -> DataFrame:
    return df.withColumn(out_col, F.expr(annotate_sql(f"`{text_col}`", f"`{spans_col}`")))


def result_record(df: DataFrame, text_col: str, policy: Policy, spans_col: str = "spans") -> DataFrame:
    """Everything known about one analysed text, next to the input columns.

    ``detected_counts`` counts every span, ``rewritten_counts`` only those kept.
    """
    return (df.withColumn("kept", F.expr(keep_best(f"`{spans_col}`")))
            .withColumn("detected_counts", F.expr(counts_sql(f"`{spans_col}`")))
            .withColumns({
                "rewritten_counts": F.expr(counts_sql("kept")),
                "total_found": F.size(spans_col),
                "entity_summary": F.expr(summary_sql("detected_counts")),
                "anonymized_text": F.expr(rewrite_sql(f"`{text_col}`", "kept", policy)),
                "operator_used": F.lit(policy.operator)}))
