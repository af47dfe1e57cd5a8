"""DuckDB statements for span detection and rewriting, built from the registry.

The statements follow the same rules as the Spark operators but are worked out
differently: offsets per unnested match, and set operations instead of folds.
"""

from __future__ import annotations

from .. import registry as reg
from ..policy import Policy


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def validator(kind: str | None, x: str) -> str:
    d = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    if kind is None:
        return "true"
    if kind == "luhn":
        return (f"(length({d}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length({d}) + 1), "
                f"lambda i: CASE WHEN (length({d}) - i) % 2 = 0 THEN CAST(substr({d}, i, 1) AS INTEGER) "
                f"ELSE (CAST(substr({d}, i, 1) AS INTEGER) * 2) // 10 + (CAST(substr({d}, i, 1) AS INTEGER) * 2) % 10 END)) % 10 = 0)")
    if kind == "iban":
        turned = f"(substr({x}, 5) || substr({x}, 1, 4))"
        digits = (f"list_aggregate(list_transform(string_split({turned}, ''), lambda c: CASE WHEN ascii(c) < 58 THEN c "
                  "ELSE CAST(ascii(c) - 55 AS VARCHAR) END), 'string_agg', '')")
        return (f"list_reduce(list_transform(string_split({digits}, ''), lambda c: CAST(c AS BIGINT)), "
                "lambda a, b: (a * 10 + b) % 97) = 1")
    if kind == "octets":
        return f"list_bool_and(list_transform(string_split({x}, '.'), lambda p: CAST(p AS INTEGER) <= 255))"
    if kind == "ssn":
        return f"(substr({d}, 1, 3) <> '000' AND substr({d}, 4, 2) <> '00' AND substr({d}, 6, 4) <> '0000')"
    if kind == "dea":
        p = lambda i: f"CAST(substr({x}, {i}, 1) AS INTEGER)"
        return f"(({p(3)} + {p(5)} + {p(7)} + 2 * ({p(4)} + {p(6)} + {p(8)})) % 10 = {p(9)})"
    if kind == "date":
        return f"(contains({x}, '/') OR TRY_CAST({x} AS DATE) IS NOT NULL)"
    raise ValueError(kind)


def _edges(t: str = "t", s: str = "s", e: str = "e", x: str = "x") -> str:
    return (f"NOT ({s} > 0 AND regexp_matches(substr({x}, 1, 1), '[A-Za-z0-9]') AND regexp_matches(substr({t}, {s}, 1), '[A-Za-z0-9_]')) "
            f"AND NOT (regexp_matches(right({x}, 1), '[A-Za-z0-9]') AND regexp_matches(substr({t}, {e} + 1, 1), '[A-Za-z0-9_]'))")


def _score(r: reg.Recogniser) -> str:
    if r.validator in reg.SCORE_LIFTING_VALIDATORS:
        return "1.0::DOUBLE"
    if not r.context:
        return f"{float(r.score)}::DOUBLE"
    first = f"greatest(1, s - {reg.CONTEXT_CHARS - 1})"
    words = (f"list_filter(string_split_regex(lower(substr(t, {first}, s - {first} + 1)), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')")
    listed = "[" + ", ".join(lit(w) for w in r.context) + "]"
    boosted = min(1.0, round(r.score + reg.CONTEXT_BOOST, 3))
    return (f"CASE WHEN list_has_any(list_slice({words}, greatest(1, len({words}) - {reg.CONTEXT_WORDS - 1}), len({words})), {listed}) "
            f"THEN {boosted}::DOUBLE ELSE {float(r.score)}::DOUBLE END")


def match_ctes(prefix: str, src: str, pattern: str, where: str = "true") -> str:
    """CTE ``<prefix>`` (k, t, s, e, x): all matches of a pattern with code-point offsets."""
    return f"""{prefix}_raw AS (SELECT k, t, regexp_extract_all(t, {lit(pattern)}) AS h, string_split_regex(t, {lit(pattern)}) AS g
  FROM {src} WHERE {where}),
{prefix}_pos AS (SELECT k, t, g, h, unnest(range(1, len(h) + 1)) AS i FROM {prefix}_raw WHERE len(h) > 0),
{prefix}_at AS (SELECT k, t, h[i] AS x, CAST(list_sum(list_transform(g[1:i], lambda v: length(v)))
  + coalesce(list_sum(list_transform(h[1:i-1], lambda v: length(v))), 0) AS INTEGER) AS s FROM {prefix}_pos),
{prefix} AS (SELECT k, t, s, CAST(s + length(x) AS INTEGER) AS e, x FROM {prefix}_at)"""


def spans_ctes(table: str, key: str, text: str, policy: Policy, where: str = "true") -> str:
    """CTEs up to ``spans`` (k, entity_type, s, e, score, x, recognizer, rationale) and ``src`` (k, t)."""
    parts = [f"src AS (SELECT {key} AS k, {text} AS t FROM {table} WHERE {where})"]
    unions = []
    for n, r in enumerate(reg.select(policy.entities, policy.threshold)):
        p = f"m{n}"
        parts.append(match_ctes(p, "src", r.pattern, f"contains(t, {lit(r.guard)})" if r.guard else "true"))
        extra = f"'validator={r.validator}'" if r.validator else "NULL"
        unions.append(
            f"SELECT k, t, '{r.entity}' AS entity_type, s, e, round(sc, 3) AS score, x, '{r.name}' AS recognizer, "
            f"concat_ws('; ', '{r.name}', 'pattern={r.pattern_name}', CASE WHEN sc <> {float(r.score)} "
            f"THEN 'raw_score={r.score:.2f}' END, {extra}) AS rationale FROM (SELECT *, {_score(r)} AS sc FROM {p} "
            f"WHERE {_edges()} AND {validator(r.validator, 'x')}) q WHERE sc >= {float(policy.threshold)}")
    parts.append("pattern_spans AS (" + "\nUNION ALL ".join(unions) + ")")
    allowed = ""
    if policy.allow:
        allowed = " WHERE lower(trim(x)) NOT IN (" + ", ".join(lit(a.lower()) for a in policy.allow) + ")"
    parts.append(f"allowed_spans AS (SELECT * FROM pattern_spans{allowed})")
    last = "SELECT * FROM allowed_spans"
    for n, term in enumerate(policy.deny):
        p = f"d{n}"
        low = lit(term.lower())
        parts.append(f"""{p}_raw AS (SELECT k, t, string_split(lower(t), {low}) AS g FROM src WHERE contains(lower(t), {low})),
{p}_pos AS (SELECT k, t, CAST(list_sum(list_transform(g[1:i], lambda v: length(v))) + (i - 1) * {len(term)} AS INTEGER) AS s
  FROM (SELECT k, t, g, unnest(range(1, len(g))) AS i FROM {p}_raw)),
{p} AS (SELECT k, t, s, CAST(s + {len(term)} AS INTEGER) AS e, substr(t, s + 1, {len(term)}) AS x FROM {p}_pos
  WHERE NOT (s > 0 AND regexp_matches(substr(t, s, 1), '[\\p{{L}}\\p{{N}}_]')) AND NOT regexp_matches(substr(t, s + {len(term)} + 1, 1), '[\\p{{L}}\\p{{N}}_]'))""")
        last += (f"\nUNION ALL SELECT k, t, 'CUSTOM_DENYLIST', s, e, 1.0::DOUBLE, x, 'DenyListRecogniser', 'DenyListRecogniser' FROM {p}")
    parts.append(f"spans AS (SELECT DISTINCT ON (k, entity_type, s, e) * FROM ({last}))" if policy.deny
                 else f"spans AS ({last})")
    return "WITH " + ",\n".join(parts)


def kept_ctes(spans: str = "spans") -> str:
    """CTE ``kept`` (k, t, entity_type, s, e, score, x): greedy winners per text."""
    item = "{'s': s, 'e': e, 'ty': entity_type, 'sc': score, 'x': x}"
    kind = "STRUCT(s INTEGER, e INTEGER, ty VARCHAR, sc DOUBLE, x VARCHAR)[]"
    return f""",
ranked AS (SELECT k, any_value(t) AS t, list({item} ORDER BY score DESC, e - s DESC, s, entity_type) AS l FROM {spans} GROUP BY k),
winners AS (SELECT k, t, unnest(list_reduce(l, lambda acc, n: CASE WHEN len(list_filter(acc, lambda o: o.s < n.e AND n.s < o.e)) = 0
  THEN list_append(acc, n) ELSE acc END, CAST([] AS {kind}))) AS w FROM ranked),
kept AS (SELECT k, t, w.ty AS entity_type, w.s AS s, w.e AS e, w.sc AS score, w.x AS x FROM winners)"""


def replacement(operator: str, salt: str = "", seed: str = "") -> str:
    if operator == "replace":
        return "'<' || entity_type || '>'"
    if operator == "redact":
        return "''"
    if operator == "mask":
        return "repeat('*', least(20, length(x))::BIGINT) || substr(x, 21)"
    if operator == "hash":
        return f"sha256({lit(salt)} || x)"
    raise ValueError(operator)


def rewritten_ctes(repl: str, kept: str = "kept", out: str = "rewritten") -> str:
    """CTE ``rewritten`` (k, new_text) for texts with at least one kept span."""
    return f""",
{out}_gaps AS (SELECT k, t, s, e, {repl} AS r, lag(e, 1, 0) OVER (PARTITION BY k ORDER BY s) AS p FROM {kept}),
{out} AS (SELECT k, string_agg(substr(t, p + 1, s - p) || r, '' ORDER BY s) || substr(any_value(t), CAST(max(e) AS BIGINT) + 1) AS new_text
  FROM {out}_gaps GROUP BY k)"""
