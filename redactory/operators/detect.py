"""Detection: text column -> array of typed, scored, explainable spans."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from .. import registry as reg
from ..functions import text as tx
from ..functions.checks import VALIDATORS
from ..functions.expr import empty, in_list, is_blank, keep, let, quoted, raw, record, sorted_by, transform
from ..plans.sizing import small_side
from ..plans.unnest import inline_rows
from ..policy import Policy
from ..schema import SPANS_DDL
from .resolve import by_position, keep_best, merge_spans
from .scan import scanned

NONE = empty(SPANS_DDL)

# More literal terms than this go through the dictionary join instead.
MAX_INLINE_TERMS = 20


def rationale(recogniser: str, pattern_name: str, raw_score: str, score: str, extra: str) -> str:
    """recogniser; pattern=...; raw_score=0.00 when it changed; free text."""
    return (
        "concat_ws('; ', "
        f"nullif({recogniser}, ''), "
        f"concat('pattern=', nullif({pattern_name}, '')), "
        f"IF({raw_score} <> {score}, concat('raw_score=', format_string('%.2f', {raw_score})), NULL), "
        f"nullif({extra}, ''))")


def make_span(entity: str, hit: str, score: str, recogniser: str, why: str) -> str:
    return record(entity_type=entity, start=f"{hit}.start", end=f"{hit}.`end`",
                  score=f"round({score}, 3)", text=f"{hit}.text", recognizer=recogniser, rationale=why)


def recogniser_spans(text: str, cut: str, r: reg.Recogniser, policy: Policy) -> str:
    """Spans of one recogniser, validated and scored; ``cut`` is the text's ``chunks``."""

    guard = f"contains({text}, {quoted(r.guard)})" if r.guard else None
    if r.score < policy.threshold and r.validator not in reg.SCORE_LIFTING_VALIDATORS:
        # Too weak alone: without one of its context words in the text no span can survive.
        guard = f"rlike(lower({text}), {raw('|'.join(r.context))})"

    def to_span(hit: str) -> str:
        base = f"{float(r.score)}D"
        if r.validator in reg.SCORE_LIFTING_VALIDATORS:
            score = "1.0D"
        elif r.context:
            near = tx.word_nearby(text, cut, f"{hit}.start", r.context, reg.CONTEXT_WORDS, reg.CONTEXT_CHARS)
            score = f"IF({near}, {min(1.0, round(r.score + reg.CONTEXT_BOOST, 3))}D, {base})"
        else:
            score = base

        def finish(s: str) -> str:
            if not policy.explain:
                return make_span(f"'{r.entity}'", hit, s, "''", "''")
            extra = f"'validator={r.validator}'" if r.validator else "''"
            why = rationale(f"'{r.name}'", f"'{r.pattern_name}'", base, s, extra)
            return make_span(f"'{r.entity}'", hit, s, f"'{r.name}'", why)

        return let(score, finish) if policy.explain and score.startswith("IF") else finish(score)

    def usable(hit: str) -> str:
        ok = tx.edges_clear(text, cut, hit)
        return f"{ok} AND {VALIDATORS[r.validator](hit + '.text')}" if r.validator else ok

    def build(hits: str) -> str:
        spans = transform(keep(hits, usable), to_span)
        if r.validator not in reg.SCORE_LIFTING_VALIDATORS and r.score < policy.threshold:
            spans = keep(spans, lambda s: f"{s}.score >= {float(policy.threshold)}D")
        return f"IF(size({hits}) > 0, {spans}, {NONE})"

    return let(tx.located(text, r.jvm_pattern or r.pattern, guard), build)


def deny_spans(text: str, terms: tuple[str, ...], explain: bool = True) -> str:
    """Whole-word, case-insensitive literal hits of each term, score 1.0.

    One pattern per term: a single alternation would lose overlapping terms.
    """
    if len(terms) > MAX_INLINE_TERMS:
        raise ValueError(f"more than {MAX_INLINE_TERMS} terms: use operators.dictionary")
    name = quoted("DenyListRecogniser" if explain else "")

    def of_term(term: str) -> str:
        literal = re.sub(r"([^\w ])", r"\\\1", term)
        pattern = rf"(?iu)(?<![\p{{L}}\p{{N}}_]){literal}(?![\p{{L}}\p{{N}}_])"
        hits = tx.located(text, pattern, f"contains(lower({text}), {quoted(term.lower())})", lookaround=True)
        return transform(hits, lambda h: make_span(f"'{fv.DENY_ENTITY}'", h, "1.0D", name, name))

    parts = [of_term(t) for t in terms]
    return f"concat({', '.join(parts)})" if parts else NONE


def first_literal_spans(text: str, pairs: list[tuple[str, str]], score: float = 0.99) -> str:
    """One hit per listed literal: the first, or for a repeated literal the next
    one after its previous hit, falling back to the first.  Sorted by start."""
    name = "'LiteralListRecogniser'"
    parts, previous = [], {}
    for term, entity in pairs:
        key = quoted(term.lower())
        at = f"locate({key}, lower({text}))"
        if key in previous:
            later = f"locate({key}, lower({text}), {previous[key]} + {len(term)})"
            at = f"coalesce(nullif({later}, 0), {at})"
        previous[key] = at
        hit = let(at, lambda p, n=len(term): record(
            start=f"{p} - 1", end=f"{p} - 1 + {n}", text=f"substring({text}, {p}, {n})"))
        parts.append(let(hit, lambda h, e=entity: (
            f"IF({h}.start >= 0, {make_span(quoted(e), h, f'{score}D', name, quoted(''))}, NULL)")))
    found = keep(f"array({', '.join(parts)})", lambda s: f"{s} IS NOT NULL")
    return sorted_by(found, a=lambda s, i: f"{s}.start", b=lambda s, i: i)


def drop_allowed(spans: str, allow: tuple[str, ...]) -> str:
    """Drop spans whose trimmed, lower-cased text is listed."""
    if not allow:
        return spans
    return keep(spans, lambda s: "NOT " + in_list(f"lower(trim({s}.text))", [t.lower() for t in allow]))


def spans_sql(text: str, policy: Policy, extra: str | None = None, recognised: str | None = None) -> str:
    """All spans of a text: recognisers, then ``extra`` spans (for example from a
    dictionary), allow-list, and last the deny-list, which no other rule limits.
    ``recognised`` names a column of the recognisers' spans where they are known."""
    chosen = reg.select(policy.entities, policy.threshold)

    def searched(cut: str) -> str:
        parts = [recogniser_spans(text, cut, r, policy) for r in chosen if not r.needs_digits]
        numeric = [recogniser_spans(text, cut, r, policy) for r in chosen if r.needs_digits]
        if numeric:
            parts.append(f"IF(rlike({text}, {raw(reg.DIGIT_PAIR)}), concat({', '.join(numeric)}), {NONE})")
        return f"concat({', '.join(parts)})" if parts else NONE

    found = recognised or let(tx.chunks(text), searched)
    if extra is not None:
        ok = lambda s: f"{s}.score >= {float(policy.threshold)}D" + (
            " AND " + in_list(f"{s}.entity_type", policy.entities) if policy.entities else "")
        found = merge_spans(found, keep(f"coalesce({extra}, {NONE})", ok))
    found = drop_allowed(found, policy.allow)
    if policy.deny:
        found = merge_spans(found, deny_spans(text, policy.deny, policy.explain))
    if recognised and extra is None and not policy.deny:
        return found  # in order, and none in a blank text
    ordered = let(found, lambda s: f"IF(size({s}) < 2, {s}, {by_position(s)})")
    return f"IF({is_blank(text)}, {NONE}, {ordered})"


def spans_of(text: str, policy: Policy | None = None, extra: str | None = None) -> Column:
    """``spans_sql`` as a Column; ``text`` and ``extra`` are column names or SQL expressions."""
    return F.expr(spans_sql(text, policy or Policy(), extra))


def detect(df: DataFrame, text_col: str, policy: Policy | None = None, spans_col: str = "spans",
           extra: str | None = None, dense: bool = False, best: bool = False) -> DataFrame:
    """Add the span array of a text column; with ``best`` only the spans to rewrite (``resolve.keep_best``).

    With ``dense`` the recognisers run over Arrow batches: the same spans, faster where most texts hold several, slower
    where most hold none."""
    policy = policy or Policy()
    text, known = f"`{text_col}`", None
    if dense:
        # Lists are applied before spans are resolved.
        early = best and extra is None and not (policy.allow or policy.deny)
        df, known = df.withColumn("_recognised", scanned(F.col(text), policy, early)), "_recognised"
        best = best and not early
    out = df.withColumn(spans_col, F.expr(spans_sql(text, policy, extra, known)))
    if best:
        out = out.withColumn(spans_col, F.expr(keep_best(f"`{spans_col}`")))
    return out.drop("_recognised") if dense else out


def detections(df: DataFrame, key: str | list[str], spans_col: str = "spans") -> DataFrame:
    """Span arrays as rows, one per span."""
    keys = [key] if isinstance(key, str) else list(key)
    return inline_rows(df, keys, F.col(spans_col), "start")


def filter_allowed_rows(rows: DataFrame, allow: DataFrame, term_col: str = "term") -> DataFrame:
    """Row form of the allow-list for long lists: left-anti join on the text."""
    terms = allow.select(F.lower(F.trim(F.col(term_col))).alias("_term")).where("_term <> ''").distinct()
    keyed = rows.withColumn("_term", F.lower(F.trim(F.col("text"))))
    return keyed.join(small_side(terms), "_term", "left_anti").drop("_term")


def norm_term_rows(terms: DataFrame, order_col: str, term_col: str = "term") -> DataFrame:
    """Row form of term-list normalisation: trim, drop blanks, keep the first spelling."""
    clean = terms.select(F.col(order_col).alias("pos"), F.trim(F.col(term_col)).alias("term")).where("term <> ''")
    return (clean.groupBy(F.lower("term").alias("term_key"))
            .agg(F.min_by("term", "pos").alias("term"), F.min("pos").alias("pos")))


