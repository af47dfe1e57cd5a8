"""DuckDB statements equal to those registered queries that SQL can express."""

LINE_DEDUP = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT k.doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE r.key IS NOT NULL AND k.doc_id <> r.last) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos)
                       FILTER (WHERE r.key IS NULL OR k.doc_id = r.last), '')) AS kept_sha256
FROM k LEFT JOIN r ON k.key = r.key
GROUP BY k.doc_id
"""

_SECOND_LEVEL = """('co.uk', 'org.uk', 'ac.uk', 'gov.uk', 'com.au', 'net.au', 'org.au', 'co.nz', 'co.jp', 'or.jp', 'com.br', 'com.cn', 'co.in', 'co.za', 'com.mx', 'com.tr', 'co.kr', 'com.sg', 'com.ar')"""
_LAST = """array_to_string(list_slice(string_split(host, '.'), greatest(1, len(string_split(host, '.')) - {n} + 1),
                                   len(string_split(host, '.'))), '.')"""
_TWO, _THREE = _LAST.format(n=2), _LAST.format(n=3)
_STRENGTH = """
  SELECT CASE WHEN sum(n * up * (1 - up) * (n - 1)) > 0 AND sum((good - n * up) ** 2 - n * up * (1 - up)) > 0
         THEN least(1e6, greatest(1.0, sum(n * up * (1 - up) * (n - 1)) / sum((good - n * up) ** 2 - n * up * (1 - up)) - 1))
         ELSE 1e6 END FROM {level}"""

URL_FILTER = rf"""
WITH p AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
placed AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
once AS (SELECT page_id, min(host) AS host FROM placed WHERE page_id IS NOT NULL GROUP BY page_id),
outcome AS (
  SELECT host, NULL::BIGINT AS good FROM placed
  UNION ALL SELECT host, quality::BIGINT FROM once JOIN labels ON page_id = doc_id WHERE quality IS NOT NULL),
h AS (
  SELECT host, CASE WHEN {_TWO} IN {_SECOND_LEVEL} THEN {_THREE} ELSE {_TWO} END AS domain,
         CASE WHEN {_TWO} IN {_SECOND_LEVEL} THEN {_TWO} ELSE {_LAST.format(n=1)} END AS suffix,
         count(good) AS n, coalesce(sum(good), 0) AS good
  FROM outcome GROUP BY host),
s0 AS (SELECT suffix, sum(n) AS n, sum(good) AS good, (SELECT (sum(good) + 1.0) / (sum(n) + 2.0) FROM h) AS up FROM h GROUP BY suffix),
s1 AS (SELECT suffix, (good + ({_STRENGTH.format(level="s0")}) * up) / (n + ({_STRENGTH.format(level="s0")})) AS up FROM s0),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good, any_value(up) AS up FROM h JOIN s1 USING (suffix) GROUP BY domain, suffix),
d1 AS (SELECT domain, suffix, (good + ({_STRENGTH.format(level="d0")}) * up) / (n + ({_STRENGTH.format(level="d0")})) AS up FROM d0),
h0 AS (SELECT host, n, good, up FROM h JOIN d1 USING (domain, suffix)),
hs AS (SELECT ({_STRENGTH.format(level="h0")}) AS s),
h1 AS (SELECT host, n, s, (good + s * up) / (n + s) AS rate FROM h0, hs),
r AS (SELECT *, least(1.0, rate + 1.645 * sqrt(rate * (1 - rate) / (n + s + 1))) AS high FROM h1),
judged AS (
  SELECT page_id, host, path, rate, high,
         CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
              WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
              WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
              WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
              WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule
  FROM placed JOIN r USING (host))
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN high < 0.5 THEN 'block' ELSE 'allow' END AS verdict,
       round(rate, 6) AS rate
FROM judged
"""

SUBSTRING_DEDUP = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
f AS (SELECT win, min(doc_id) AS first FROM p GROUP BY win),
gone AS (
  SELECT DISTINCT doc_id, i + k AS pos
  FROM (SELECT doc_id, i, unnest(range(0, 13)) AS k FROM p JOIN f USING (win) WHERE first < doc_id)),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w WHERE len(ws) > 0),
kept AS (
  SELECT words.doc_id, count(gone.pos) AS n_removed,
         string_agg(word, ' ' ORDER BY words.pos) FILTER (WHERE gone.pos IS NULL) AS kept
  FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.pos = gone.pos GROUP BY words.doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

JACCARD_JOIN = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS shingle
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
reach AS (
  SELECT a AS doc_id, a AS other FROM links
  UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.other = links.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(min(other), w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN reach ON reach.doc_id = w.doc_id
GROUP BY w.doc_id, n.n
"""


def license_scan(templates, size: int = 5, containment: float = 0.8) -> str:
    """Exact containment of every template around every shingle it shares with a document."""
    rows = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(templates))
    shingles = f"array_to_string(ws[i:i + {size - 1}], ' ')"
    return rf"""
WITH t(template, license, text) AS (VALUES {rows}),
tw AS (SELECT template, license, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM t),
ts AS (
  SELECT DISTINCT template, license, {shingles} AS shingle
  FROM (SELECT template, license, ws, unnest(range(1, len(ws) - {size - 2})) AS i FROM tw)),
tk AS (SELECT template, count(*) AS k FROM ts GROUP BY template),
dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS ws FROM documents),
ds AS (
  SELECT doc_id, i, {shingles} AS shingle
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {size - 2})) AS i FROM dw WHERE len(ws) >= {size})),
hits AS (SELECT doc_id, template, license, i, shingle, k FROM ds JOIN ts USING (shingle) JOIN tk USING (template)),
around AS (
  SELECT a.doc_id, a.template, a.license, a.i, count(DISTINCT b.shingle) / any_value(a.k)::DOUBLE AS share
  FROM hits a JOIN hits b ON a.doc_id = b.doc_id AND a.template = b.template AND b.i BETWEEN a.i - a.k AND a.i + a.k
  GROUP BY a.doc_id, a.template, a.license, a.i)
SELECT documents.doc_id, coalesce(string_agg(DISTINCT license, ',' ORDER BY license), '') AS licenses,
       CAST(count(DISTINCT template) AS INTEGER) AS n_templates, max(share) AS containment
FROM documents LEFT JOIN around ON documents.doc_id = around.doc_id AND share >= {containment}
GROUP BY documents.doc_id
"""
