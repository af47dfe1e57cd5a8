"""Detection and rewriting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as fv
from .. import registry as reg
from ..functions import text as tx
from ..functions.expr import let
from ..operators import dictionary as dic
from ..operators.detect import (deny_spans, detect, detections, filter_allowed_rows, first_literal_spans,
                                norm_term_rows, recogniser_spans)
from ..operators.resolve import keep_best, keep_for_display, merge_rows
from ..operators.rewrite import (annotate, counts_sql, result_record, rewrite, rewrite_given_spans)
from ..operators.synth import synthesize_placeholders
from ..plans.unnest import rows_with_any
from ..policy import Policy
from . import duck
from .base import STATEMENTS, query
from .derived import document_spans, documents, table
from .planted import PLANTED_SQL, planted

ALL = Policy()
SPAN_COLS = ["entity_type", "start", "end", "score", "text"]
SPAN_SQL = 'entity_type, s AS "start", e AS "end", score, x AS "text"'


def long_form(df, key):
    return detections(df, key).select(key, *SPAN_COLS)


# --- spans in documents ----------------------------------------------------

@query("detect_documents", lambda: duck.spans_ctes("documents", "doc_id", "text", ALL)
       + f" SELECT k AS doc_id, {SPAN_SQL}, recognizer, rationale FROM spans")
def _(spark, d):
    return detections(document_spans(spark, d, ALL), "doc_id")


def _per_recogniser(r: reg.Recogniser) -> None:
    any_score = Policy(entities=(r.entity,), threshold=0.0)

    @query(f"recognise_{r.entity.lower()}", lambda: duck.spans_ctes("planted", "order_id", "note", any_score).replace(
        "WITH src", f"WITH {PLANTED_SQL}, src") + f" SELECT k AS order_id, {SPAN_SQL} FROM spans")
    def _(spark, d):
        spans = planted(spark, d).select("order_id", F.expr(let(tx.chunks("note"), lambda cut: recogniser_spans("note", cut, r, any_score))).alias("spans"))
        return long_form(spans, "order_id")


for _r in reg.REGISTRY:
    _per_recogniser(_r)


def _planted_sql(policy: Policy, tail: str) -> str:
    ctes = duck.spans_ctes("planted", "order_id", "note", policy)
    return ctes.replace("WITH src", f"WITH {PLANTED_SQL}, src", 1) + tail


@query("detect_planted", lambda: _planted_sql(ALL, f" SELECT k AS order_id, {SPAN_SQL}, recognizer, rationale FROM spans"))
def _(spark, d):
    return detections(detect(planted(spark, d), "note", ALL, dense=True), "order_id")


@query("detect_pages", lambda: duck.spans_ctes("pages", "page_id", "html", ALL)
       + f" SELECT k AS page_id, {SPAN_SQL} FROM spans")
def _(spark, d):
    pages = table(spark, d, "pages").select("page_id", "html")
    return long_form(detect(pages, "html", ALL), "page_id")


SUBSET = Policy(entities=("EMAIL_ADDRESS", "IP_ADDRESS"), threshold=0.6)


@query("detect_entity_subset", lambda: duck.spans_ctes("documents", "doc_id", "text", SUBSET)
       + f" SELECT k AS doc_id, {SPAN_SQL} FROM spans")
def _(spark, d):
    return long_form(document_spans(spark, d, SUBSET), "doc_id")


STRICT = Policy(threshold=0.8)


@query("detect_high_threshold", lambda: _planted_sql(STRICT, f" SELECT k AS order_id, {SPAN_SQL} FROM spans"))
def _(spark, d):
    return long_form(detect(planted(spark, d), "note", STRICT.but(explain=False), dense=True), "order_id")


LISTED = Policy(entities=("EMAIL_ADDRESS", "DATE_TIME"), allow=(" 1950-01-01 ", "c7@mail7.example.org", "C8@MAIL8.example.org"),
                deny=("New York", "york city", "driver license", " NEW YORK "))


@query("detect_allow_and_deny", lambda: _planted_sql(LISTED, f" SELECT k AS order_id, {SPAN_SQL} FROM spans"))
def _(spark, d):
    return long_form(detect(planted(spark, d), "note", LISTED.but(explain=False), dense=True), "order_id")


@query("allow_list_rows", lambda: duck.spans_ctes("documents", "doc_id", "text", ALL)
       + f", terms AS (SELECT DISTINCT lower(trim(x)) AS term FROM spans WHERE k % 2 = 0)"
       f" SELECT k AS doc_id, {SPAN_SQL} FROM spans WHERE lower(trim(x)) NOT IN (SELECT term FROM terms)")
def _(spark, d):
    rows = long_form(document_spans(spark, d, ALL), "doc_id")
    allow = rows.where("doc_id % 2 = 0").select(F.col("text").alias("term"))
    return filter_allowed_rows(rows, allow)


@query("deny_terms_inline", """WITH t AS (SELECT doc_id, lower(text) AS low FROM documents),
p AS (SELECT doc_id, string_split_regex(low, '[^\\p{L}\\p{N}_]+') AS w FROM t)
SELECT doc_id, CAST(list_sum(list_transform(w, lambda v: CASE WHEN v IN ('the', 'les', 'und') THEN 1 ELSE 0 END)) AS INTEGER) AS n_hits
FROM p WHERE list_has_any(w, ['the', 'les', 'und'])""")
def _(spark, d):
    spans = documents(spark, d).select("doc_id", F.expr(
        f"size({deny_spans('text', ('the', 'les', 'und'), explain=False)})").alias("n_hits"))
    return spans.where("n_hits > 0")


@query("normalise_terms", """SELECT lower(trim(s_name || c)) AS term_key, arg_min(trim(s_name || c), pos) AS term, min(pos) AS pos
FROM (SELECT CASE WHEN s_suppkey % 2 = 0 THEN upper(s_name) ELSE s_name END AS s_name, ' ' AS c, s_suppkey * 2 AS pos FROM supplier
UNION ALL SELECT lower(s_name), '', s_suppkey * 2 + 1 FROM supplier UNION ALL SELECT ' ', '', s_suppkey FROM supplier) q
WHERE trim(s_name || c) <> '' GROUP BY 1""")
def _(spark, d):
    s = table(spark, d, "supplier")
    terms = (s.selectExpr("IF(s_suppkey % 2 = 0, upper(s_name), s_name) || ' ' AS term", "s_suppkey * 2 AS pos")
             .unionByName(s.selectExpr("lower(s_name) AS term", "s_suppkey * 2 + 1 AS pos"))
             .unionByName(s.selectExpr("'  ' AS term", "s_suppkey AS pos")))
    return norm_term_rows(terms, "pos")


@query("merge_span_rows", lambda: duck.spans_ctes("documents", "doc_id", "text", ALL) + """
SELECT doc_id, entity_type, "start", "end", CASE WHEN max(side) = 1 AND min(side) = 1 THEN 0.5 ELSE max(CASE WHEN side = 0 THEN score END) END::DOUBLE AS score
FROM (SELECT k AS doc_id, entity_type, s AS "start", e AS "end", score, 0 AS side FROM spans WHERE entity_type <> 'IP_ADDRESS'
UNION ALL SELECT k, entity_type, s, e, 0.5, 1 FROM spans WHERE entity_type <> 'EMAIL_ADDRESS') GROUP BY 1, 2, 3, 4""")
def _(spark, d):
    rows = long_form(document_spans(spark, d, ALL), "doc_id").drop("text")
    first = rows.where("entity_type <> 'IP_ADDRESS'")
    second = rows.where("entity_type <> 'EMAIL_ADDRESS'").withColumn("score", F.lit(0.5))
    return merge_rows(first, second, ["doc_id", "entity_type", "start", "end"])


@query("resolve_for_rewrite", lambda: _planted_sql(ALL, duck.kept_ctes()
       + ' SELECT k AS order_id, entity_type, s AS "start", e AS "end", score FROM kept'))
def _(spark, d):
    spans = detect(planted(spark, d), "note", ALL.but(explain=False), dense=True, best=True).select("order_id", "spans")
    return long_form(spans, "order_id").drop("text")


@query("resolve_for_display", lambda: _planted_sql(ALL, """,
o AS (SELECT k, list({'s': s, 'e': e, 'ty': entity_type, 'sc': score} ORDER BY s, score DESC, e, entity_type) AS l FROM spans GROUP BY k),
f AS (SELECT k, unnest(list_reduce(l, lambda acc, n: CASE WHEN len(acc) = 0 THEN [n] WHEN n.s >= acc[len(acc)].e THEN list_append(acc, n)
  WHEN n.sc > acc[len(acc)].sc THEN list_append(acc[1:len(acc) - 1], n) ELSE acc END,
  CAST([] AS STRUCT(s INTEGER, e INTEGER, ty VARCHAR, sc DOUBLE)[]))) AS w FROM o)
SELECT k AS order_id, w.ty AS entity_type, w.s AS "start", w.e AS "end", w.sc AS score FROM f"""))
def _(spark, d):
    spans = detect(planted(spark, d), "note", ALL.but(explain=False), dense=True).select("order_id", F.expr(keep_for_display("spans")).alias("spans"))
    return long_form(spans, "order_id").drop("text")


# --- dictionaries ----------------------------------------------------------

def _tokens_sql(src: str) -> str:
    """Token n-grams (1..2) of src(k, t) with offsets, normalised."""
    return duck.match_ctes("tok", src, r"[\p{L}\p{N}]+") + """,
tokn AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s) AS n FROM tok),
grams AS (SELECT k, s, e, lower(x) AS gram, x FROM tokn
  UNION ALL SELECT a.k, a.s, b.e, lower(a.x || ' ' || b.x), substr(a.t, a.s + 1, b.e - a.s) FROM tokn a JOIN tokn b ON a.k = b.k AND b.n = a.n + 1)"""


GAZETTEER_TERMS = """terms AS (SELECT c_name AS term, 'PERSON' AS ty FROM customer UNION ALL SELECT n_name, 'LOCATION' FROM nation),
dict AS (SELECT DISTINCT lower(replace(replace(term, '#', ' '), '_', ' ')) AS gram, ty FROM terms)"""


def name_dictionary(spark, d):
    return (table(spark, d, "customer").select(F.col("c_name").alias("term"), F.lit("PER").alias("entity_type"))
            .unionByName(table(spark, d, "nation").select(F.col("n_name").alias("term"), F.lit("GPE").alias("entity_type"))))


@query("dictionary_hits", lambda: f"WITH {PLANTED_SQL}, src AS (SELECT order_id AS k, note AS t FROM planted), "
       + _tokens_sql("src") + f", {GAZETTEER_TERMS}"
       + ' SELECT k AS order_id, ty AS entity_type, s AS "start", CAST(e AS INTEGER) AS "end", x AS "text" FROM grams JOIN dict USING (gram)')
def _(spark, d):
    hits = dic.gazetteer(planted(spark, d).select("order_id", "note"), "order_id", "note", name_dictionary(spark, d))
    return hits.select("order_id", "entity_type", "start", "end", "text")


@query("dictionary_redaction", lambda: f"WITH {PLANTED_SQL}, src AS (SELECT order_id AS k, note AS t FROM planted), "
       + _tokens_sql("src") + f""", {GAZETTEER_TERMS},
hits AS (SELECT g.k, src.t, ty AS entity_type, s, CAST(e AS INTEGER) AS e, 0.85::DOUBLE AS score, x FROM grams g JOIN dict USING (gram) JOIN src ON src.k = g.k)"""
       + duck.kept_ctes("hits") + duck.rewritten_ctes(duck.replacement("replace"))
       + " SELECT src.k AS order_id, coalesce(new_text, t) AS anonymized_text FROM src LEFT JOIN rewritten r ON r.k = src.k")
def _(spark, d):
    notes = planted(spark, d).select("order_id", "note")
    only = Policy(entities=("PERSON", "LOCATION"), explain=False)
    spotted = dic.with_dictionary_spans(notes, "order_id", "note", name_dictionary(spark, d))
    found = detect(spotted, "note", only, extra="dictionary_spans")
    return rewrite(found, "note", "spans", only).select("order_id", "anonymized_text")


@query("dictionary_redaction_large", lambda: STATEMENTS["dictionary_redaction"])
def _(spark, d):
    """The plan for large dictionaries, with keys that many texts share."""
    notes = planted(spark, d).selectExpr("order_id", "order_id % 50 AS k", "note")
    only = Policy(entities=("PERSON", "LOCATION"), explain=False)
    spotted = dic.with_dictionary_spans(notes, "k", "note", name_dictionary(spark, d), max_rows=0)
    found = detect(spotted, "note", only, extra="dictionary_spans")
    return rewrite(found, "note", "spans", only).select("order_id", "anonymized_text")


@query("dictionary_hits_large", lambda: f"WITH {PLANTED_SQL}, src AS (SELECT order_id AS k, note AS t FROM planted), "
       + _tokens_sql("src") + f", {GAZETTEER_TERMS}"
       + ' SELECT k AS order_id, ty AS entity_type, s AS "start", CAST(e AS INTEGER) AS "end", x AS "text" FROM grams JOIN dict USING (gram)')
def _(spark, d):
    """The plan for dictionaries beyond the broadcast bound: here the bound is zero."""
    hits = dic.gazetteer(planted(spark, d).select("order_id", "note"), "order_id", "note", name_dictionary(spark, d),
                         max_rows=0)
    return hits.select("order_id", "entity_type", "start", "end", "text")


@query("deny_terms_joined", lambda: f"WITH {PLANTED_SQL}, src AS (SELECT order_id AS k, note AS t FROM planted), "
       + _tokens_sql("src") + ", dict AS (SELECT DISTINCT lower(replace(c_name, '#', ' ')) AS gram FROM customer WHERE c_acctbal < 0)"
       + ' SELECT k AS order_id, s AS "start", CAST(e AS INTEGER) AS "end", x AS "text" FROM grams JOIN dict USING (gram)')
def _(spark, d):
    terms = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_name").alias("term"))
    hits = dic.deny_terms(planted(spark, d).select("order_id", "note"), "order_id", "note", terms)
    return hits.select("order_id", "start", "end", "text")


def _fragile_model(texts):
    """Finds the order's number; fails on notes of nation 7."""
    if any("NATION_7," in t for t in texts):
        raise ValueError("no model for this nation")
    return [[("order_number", 6, t.index(" for "), 0.9)] for t in texts]


@query("guarded_model", f"WITH {PLANTED_SQL} SELECT order_id, CASE WHEN contains(note, 'NATION_7,') THEN 'ValueError: no model for this nation' END AS error,"
       " CASE WHEN NOT contains(note, 'NATION_7,') THEN CAST(order_id AS VARCHAR) END AS \"text\" FROM planted")
def _(spark, d):
    """A model that raises on some texts: the others keep their spans, and those come out with the error."""
    return dic.guarded_model_spans(planted(spark, d).select("order_id", "note"), "order_id", "note", _fragile_model).select(
        "order_id", "error", "text")


LITERALS = [("order", "LOCATION"), ("York", "LOCATION"), ("ORDER", "NRP"), ("seattle", "LOCATION"), ("mail", "URL")]


@query("first_literals", lambda: f"WITH {PLANTED_SQL}, l AS (SELECT order_id, note, lower(note) AS low FROM planted)," + """
p AS (SELECT order_id, note, instr(low, 'order') AS o1, instr(low, 'york') AS y, instr(low, 'seattle') AS c, instr(low, 'mail') AS m,
  CASE WHEN instr(substr(low, instr(low, 'order') + 5), 'order') > 0 THEN instr(substr(low, instr(low, 'order') + 5), 'order') + instr(low, 'order') + 4
       ELSE instr(low, 'order') END AS o2 FROM l),
u AS (SELECT order_id, note, unnest([{'a': o1, 'n': 5, 'ty': 'LOCATION'}, {'a': y, 'n': 4, 'ty': 'LOCATION'}, {'a': o2, 'n': 5, 'ty': 'NRP'},
  {'a': c, 'n': 7, 'ty': 'LOCATION'}, {'a': m, 'n': 4, 'ty': 'URL'}]) AS z FROM p)
SELECT order_id, z.ty AS entity_type, CAST(z.a - 1 AS INTEGER) AS "start", CAST(z.a - 1 + z.n AS INTEGER) AS "end", 0.99::DOUBLE AS score,
  substr(note, z.a, z.n) AS "text" FROM u WHERE z.a > 0""")
def _(spark, d):
    spans = planted(spark, d).select("order_id", F.expr(first_literal_spans("note", LITERALS)).alias("spans"))
    return long_form(spans, "order_id")


# --- rewriting -------------------------------------------------------------

def _rewrite_query(operator: str) -> None:
    policy = Policy(operator=operator, salt="pepper", explain=False)

    @query(f"rewrite_{operator}", lambda: _planted_sql(policy, duck.kept_ctes() + duck.rewritten_ctes(
        duck.replacement(operator, "pepper")) + " SELECT src.k AS order_id, coalesce(new_text, t) AS anonymized_text "
        "FROM src LEFT JOIN rewritten r ON r.k = src.k"))
    def _(spark, d):
        spans = detect(planted(spark, d), "note", policy, dense=True, best=True)
        return rewrite(spans, "note", "spans", policy, resolved=True).select("order_id", "anonymized_text")


for _o in ("replace", "redact", "mask", "hash"):
    _rewrite_query(_o)

MIXED = Policy(operator="replace", operators={"EMAIL_ADDRESS": "hash", "IP_ADDRESS": "redact", "DATE_TIME": "mask",
                                              fv.DENY_ENTITY: "redact"},
               deny=("New York",), salt="pepper", explain=False)


@query("rewrite_per_type", lambda: _planted_sql(MIXED, duck.kept_ctes() + duck.rewritten_ctes(
    f"CASE WHEN entity_type = 'EMAIL_ADDRESS' THEN {duck.replacement('hash', 'pepper')} "
    f"WHEN entity_type IN ('IP_ADDRESS', 'CUSTOM_DENYLIST') THEN '' WHEN entity_type = 'DATE_TIME' THEN {duck.replacement('mask')} "
    "ELSE '<' || entity_type || '>' END")
    + " SELECT src.k AS order_id, coalesce(new_text, t) AS anonymized_text FROM src LEFT JOIN rewritten r ON r.k = src.k"))
def _(spark, d):
    return rewrite(detect(planted(spark, d), "note", MIXED, dense=True), "note", "spans", MIXED).select("order_id", "anonymized_text")


SYNTH = Policy(operator="synthesize", seed="s1", entities=("EMAIL_ADDRESS", "IP_ADDRESS", "PHONE_NUMBER"), explain=False)


def _synth_sql() -> str:
    from ..operators.synth import FAMILY, GIVEN
    part = lambda at: f"CAST('0x' || substr(sha256('s1|' || entity_type || '|' || x), {at}, 8) AS BIGINT)"
    a, b, c = part(1), part(9), part(17)
    pick = lambda vals, n: "([" + ", ".join(duck.lit(v) for v in vals) + f"])[{n} % {len(vals)} + 1]"
    digits = lambda n, w: f"lpad(CAST({n} % {10 ** w} AS VARCHAR), {w}, '0')"
    value = (f"CASE entity_type WHEN 'EMAIL_ADDRESS' THEN lower({pick(GIVEN, a)}) || '.' || lower({pick(FAMILY, b)}) || {digits(c, 4)} || '@example.org' "
             f"WHEN 'PHONE_NUMBER' THEN '555-01' || {digits(a, 2)} || '-' || {digits(b, 4)} "
             f"ELSE '198.51.' || ({a} % 256) || '.' || ({b} % 256) END")
    return (duck.spans_ctes("documents", "doc_id", "text", SYNTH) + duck.kept_ctes() + duck.rewritten_ctes(value)
            + " SELECT src.k AS doc_id, sha256(coalesce(new_text, t)) AS text_hash FROM src LEFT JOIN rewritten r ON r.k = src.k")


@query("rewrite_synthesize", _synth_sql)
def _(spark, d):
    out = rewrite(detect(documents(spark, d), "text", SYNTH), "text", "spans", SYNTH)
    return out.select("doc_id", F.sha2("anonymized_text", 256).alias("text_hash"))


@query("synthesize_placeholders", lambda: duck.spans_ctes("documents", "doc_id", "text", SYNTH) + duck.kept_ctes()
       + """, r AS (SELECT k, count(*) AS n FROM kept GROUP BY k)
SELECT src.k AS doc_id, CASE WHEN n > 0 THEN 'seeded' ELSE 'none' END AS backend, 0 AS left_over FROM src LEFT JOIN r ON r.k = src.k""")
def _(spark, d):
    tagged = Policy(entities=SYNTH.entities, explain=False)
    out = rewrite(detect(documents(spark, d), "text", tagged), "text", "spans", tagged)
    filled = out.select("doc_id", F.expr(synthesize_placeholders("anonymized_text", "doc_id", "s1")).alias("r"))
    return filled.select("doc_id", "r.backend", F.expr(f"size({tx.placeholders('r.text')})").alias("left_over"))


@query("rewrite_given_spans", lambda: f"WITH {PLANTED_SQL}" + """, g AS (SELECT order_id, note, instr(lower(note), 'order') AS o, instr(lower(note), 'seattle') AS c FROM planted),
a AS (SELECT order_id, o, CASE WHEN c > 0 THEN substr(note, 1, c - 1) || '<LOCATION_HASH>' || substr(note, c + 7) ELSE note END AS t FROM g)
SELECT order_id, substr(t, 1, o - 1) || '<NRP_HASH>' || substr(t, o + 5) AS anonymized_text FROM a""")
def _(spark, d):
    def body(spans):
        # One span out of range, which must be skipped.
        wild = "named_struct('entity_type', 'URL', 'start', 100000, 'end', 100005)"
        slim = f"transform({spans}, s -> named_struct('entity_type', s.entity_type, 'start', s.start, 'end', s.`end`))"
        return rewrite_given_spans("note", f"concat({slim}, array({wild}))", "hash")
    spans = first_literal_spans("note", [("order", "NRP"), ("seattle", "LOCATION")])
    return planted(spark, d).select("order_id", F.expr(let(spans, body)).alias("anonymized_text"))


@query("placeholder_tokens", lambda: _planted_sql(ALL, duck.kept_ctes() + duck.rewritten_ctes(duck.replacement("replace"))
       + """ SELECT k AS order_id, array_to_string(regexp_extract_all(new_text, '<([A-Z_]+)>', 1), ',') AS tokens,
 regexp_replace(new_text, '<([A-Z_]+)>', '`\\1`', 'g') AS tagged FROM rewritten"""))
def _(spark, d):
    spans = detect(planted(spark, d), "note", ALL.but(explain=False), dense=True, best=True)
    out = rewrite(spans, "note", "spans", ALL, resolved=True)
    return out.select("order_id", F.expr(f"array_join({tx.placeholders('anonymized_text')}, ',')").alias("tokens"),
                      F.expr(tx.tag_placeholders("anonymized_text")).alias("tagged"))


ANNOTATED = Policy(entities=("EMAIL_ADDRESS", "IP_ADDRESS", "URL"), explain=False)


def _annotate_sql() -> str:
    esc = lambda c: (f"replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')")
    label = "CASE entity_type WHEN 'EMAIL_ADDRESS' THEN 'Email Address' WHEN 'IP_ADDRESS' THEN 'Ip Address' ELSE 'Url' END"
    mark = f"'`' || {esc('x')} || '` *(' || {label} || ' · ' || CAST(CAST(round_even(score * 100, 0) AS INTEGER) AS VARCHAR) || '%)*'"
    return (duck.spans_ctes("pages", "page_id", "html", ANNOTATED) + """,
o AS (SELECT k, any_value(t) AS t, list({'s': s, 'e': e, 'ty': entity_type, 'sc': score, 'x': x} ORDER BY s, score DESC, e, entity_type) AS l FROM spans GROUP BY k),
f AS (SELECT k, t, unnest(list_reduce(l, lambda acc, n: CASE WHEN len(acc) = 0 THEN [n] WHEN n.s >= acc[len(acc)].e THEN list_append(acc, n)
  WHEN n.sc > acc[len(acc)].sc THEN list_append(acc[1:len(acc) - 1], n) ELSE acc END,
  CAST([] AS STRUCT(s INTEGER, e INTEGER, ty VARCHAR, sc DOUBLE, x VARCHAR)[]))) AS w FROM o),
kept AS (SELECT k, t, w.ty AS entity_type, w.s AS s, w.e AS e, w.sc AS score, w.x AS x FROM f),
""" + f"""gaps AS (SELECT *, lag(e, 1, 0) OVER (PARTITION BY k ORDER BY s) AS p FROM kept),
marked AS (SELECT k, string_agg({esc('substr(t, p + 1, s - p)')} || {mark}, '' ORDER BY s) || {esc('substr(any_value(t), CAST(max(e) AS BIGINT) + 1)')} AS a FROM gaps GROUP BY k)
SELECT src.k AS page_id, sha256(coalesce(a, '*No PII detected.*')) AS annotated_hash FROM src LEFT JOIN marked m ON m.k = src.k""")


@query("annotate_pages", _annotate_sql)
def _(spark, d):
    pages = table(spark, d, "pages").select("page_id", "html")
    return annotate(detect(pages, "html", ANNOTATED), "html").select("page_id", F.sha2("annotated", 256).alias("annotated_hash"))


@query("result_record", lambda: duck.spans_ctes("documents", "doc_id", "text", ALL) + duck.kept_ctes()
       + duck.rewritten_ctes(duck.replacement("replace")) + """,
firsts AS (SELECT k, entity_type, count(*) AS n, min(s) AS at, arg_min(e, s) AS ate, list((s, e, entity_type) ORDER BY s, e, entity_type)[1] AS pos FROM spans GROUP BY 1, 2),
sums AS (SELECT k, CAST(sum(n) AS INTEGER) AS total, string_agg(n || '× ' || entity_type, ', ' ORDER BY pos) AS summary FROM firsts GROUP BY k),
keptn AS (SELECT k, CAST(count(*) AS INTEGER) AS n_kept FROM kept GROUP BY k)
SELECT src.k AS doc_id, coalesce(total, 0) AS total_found, coalesce(n_kept, 0) AS total_kept, coalesce(summary, 'No PII detected') AS entity_summary,
 sha256(coalesce(new_text, t)) AS text_hash FROM src LEFT JOIN sums ON sums.k = src.k LEFT JOIN keptn ON keptn.k = src.k LEFT JOIN rewritten r ON r.k = src.k""")
def _(spark, d):
    r = result_record(document_spans(spark, d, ALL.but(explain=False)), "text", ALL)
    return r.select("doc_id", "total_found", F.size("kept").alias("total_kept"), "entity_summary",
                    F.sha2("anonymized_text", 256).alias("text_hash"))


@query("documents_with_pii", lambda: duck.spans_ctes("documents", "doc_id", "text", ALL) + duck.kept_ctes()
       + duck.rewritten_ctes(duck.replacement("replace")) + """,
c AS (SELECT k, entity_type, count(*) AS n FROM spans GROUP BY 1, 2),
l AS (SELECT k, string_agg(entity_type || '=' || n, ',' ORDER BY entity_type) AS entity_counts FROM c GROUP BY k)
SELECT l.k AS doc_id, entity_counts, new_text AS redacted_text FROM l JOIN rewritten r ON r.k = l.k""")
def documents_with_pii(spark, d):
    """Which documents hold personal data, how much of which kind, and the redacted text."""
    fast = ALL.but(explain=False)
    found = rows_with_any(document_spans(spark, d, fast), "spans")
    listed = ("array_join(array_sort(transform(map_entries(" + counts_sql("spans")
              + "), e -> concat(e.key, '=', cast(e.value as string)))), ',')")
    return rewrite(found.withColumn("entity_counts", F.expr(listed)), "text", "spans", fast, "redacted_text").select(
        "doc_id", "entity_counts", "redacted_text")
