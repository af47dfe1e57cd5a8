"""Dictionary detection: token n-grams of a text looked up in a term table.

A dictionary that is measured small travels to the tasks once, as a broadcast
variable, and texts are matched where they are: no shuffle, no join back.  For a
larger one, words are joined to the first words of its terms, and only n-grams that can still match are made and
joined to the terms.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from .. import registry as reg
from ..functions import text as tx
from ..functions.expr import quoted, raw, record, transform
from ..plans.sizing import measured_small
from ..plans.spread import spread
from ..plans.unnest import inline_rows
from ..schema import SPAN_DDL

# Words and gaps of a text that are worked on together.
SEGMENT = 64

TOKEN = re.compile(r"[^\W_]+")


def tokens_of(text: str) -> list[tuple[str, int, int]]:
    """Lower-cased words with their offsets."""
    return [(m.group().lower(), m.start(), m.end()) for m in TOKEN.finditer(text)]


def fold_label(column: str = "entity_type") -> Column:
    """PER -> PERSON, ORG -> ORGANIZATION, LOC and GPE -> LOCATION."""
    table = F.create_map(*[F.lit(v) for pair in fv.LABEL_FOLD.items() for v in pair])
    return F.coalesce(F.element_at(table, F.upper(F.col(column))), F.upper(F.col(column)))


def term_grams(dictionary: DataFrame) -> DataFrame:
    """Dictionary rows (term, entity_type) as (gram, n, types), one row per gram."""
    words = f"regexp_extract_all(term, {raw(tx.WORD)}, 0)"
    typed = dictionary.where(F.col("term").isNotNull()).select(
        F.expr(f"array_join(transform({words}, w -> lower(w)), ' ')").alias("gram"), F.expr(f"size({words})").alias("n"),
        fold_label().alias("entity_type"))
    return typed.where("gram <> ''").groupBy("gram").agg(
        F.max("n").alias("n"), F.array_sort(F.collect_set("entity_type")).alias("types"))


def first_words(terms: DataFrame) -> DataFrame:
    """The root of a trie over the terms: each first word with the lengths of the terms that it begins."""
    return terms.groupBy(F.substring_index("gram", " ", 1).alias("_word")).agg(F.collect_set("n").alias("_lengths"))


# Bits for the first words of a large dictionary, 64 to a row of a table that is broadcast.
WORD_BITS = 1 << 22


def _possible(words: DataFrame, first: DataFrame) -> DataFrame:
    """Words that may be among the first words, told where the text is by one bit of their hash.

    The table has at most ``WORD_BITS`` / 64 rows however many words there are; the join that follows is exact.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(WORD_BITS))
    held = first.select(bit("_word").alias("_bit")).groupBy(F.expr("_bit div 64").alias("_slot")).agg(
        F.expr("bit_or(shiftleft(1L, cast(_bit % 64 as int)))").alias("_held"))
    marked = words.withColumn("_bit", bit("_word")).withColumn("_slot", F.expr("_bit div 64"))
    return marked.join(F.broadcast(held), "_slot").where("getbit(_held, cast(_bit % 64 as int)) = 1").drop(
        "_slot", "_bit", "_held")


def _matcher(terms: DataFrame):
    """A function text column -> flat array of (start, end, type number), and the type names."""
    rows = terms.collect()  # measured small before
    names = sorted({t for r in rows for t in r["types"]})
    lookup = {r["gram"]: [names.index(t) for t in r["types"]] for r in rows}
    by_first: dict[str, int] = {}
    for gram in lookup:
        first, n = gram.split(" ", 1)[0], gram.count(" ") + 1
        by_first[first] = max(n, by_first.get(first, 0))
    shared = terms.sparkSession.sparkContext.broadcast((lookup, by_first))

    @F.pandas_udf("array<int>")
    def match(texts: pd.Series) -> pd.Series:
        grams, longest = shared.value

        def one(text):
            if not text:
                return []
            words, out = tokens_of(text), []
            for i, (word, start, end) in enumerate(words):
                most = longest.get(word)
                if not most:
                    continue
                gram = word
                for j in range(i, min(i + most, len(words))):
                    if j > i:
                        gram = gram + " " + words[j][0]
                    for kind in grams.get(gram, ()):
                        out += (start, words[j][2], kind)
            return out

        return texts.map(one, na_action="ignore")

    return match, names


def _in_row_spans(df: DataFrame, text_col: str, terms: DataFrame, score: float, name: str, out_col: str) -> DataFrame:
    match, names = _matcher(terms)
    listed = "array(" + ", ".join(quoted(n) for n in names) + ")" if names else "array('')"
    span = lambda i: record(
        entity_type=f"{listed}[_m[3 * {i} + 2]]", start=f"_m[3 * {i}]", end=f"_m[3 * {i} + 1]", score=f"{float(score)}D",
        text=f"substring(`{text_col}`, _m[3 * {i}] + 1, _m[3 * {i} + 1] - _m[3 * {i}])",
        recognizer=quoted(name), rationale=quoted(name))
    spans = f"IF(size(_m) > 0, {transform('sequence(0, size(_m) div 3 - 1)', span, 'i')}, cast(array() as array<{SPAN_DDL}>))"
    return df.withColumn("_m", match(F.col(text_col))).withColumn(out_col, F.expr(spans)).drop("_m")


def _joined_rows(df: DataFrame, keys: list[str], text_col: str, terms: DataFrame, score: float, name: str,
                 **bounds) -> DataFrame:
    """Hit rows by joins: words with the first words of terms, and then only those n-grams that a first word's lengths
    allow with the terms.

    A word's row carries as many following words as the longest term has.  Sides measured small are broadcast; others are
    shuffled as they are, once, and Spark splits a word that most texts have.  Words that no term begins with stay behind
    before that.
    """
    most = terms.agg(F.max("n")).first()[0] or 1
    found = df.select(*keys, text_col).where(F.col(text_col).isNotNull())
    parts = inline_rows(found, keys, F.expr(tx.segments(f"`{text_col}`", SEGMENT, 2 * most)), "_base")
    words = parts.select(*keys, "_base", "_pieces", F.posexplode("_pieces").alias("_at", "_piece")).where(
        (F.col("_at") < SEGMENT) & F.expr(f"rlike(_piece, {raw('^' + tx.WORD)})")).select(
        *keys, "_base", "_pieces", "_at", F.lower("_piece").alias("_word"))

    def placed(found: DataFrame, *more: str) -> DataFrame:
        # Only for words that may begin a term.
        return found.select(
            *keys, *more, F.expr("_base + length(array_join(slice(_pieces, 1, _at), ''))").alias("_start"), "_word",
            F.expr(f"slice(_pieces, _at + 1, {2 * most - 1})").alias("_pieces"))

    first = first_words(terms)
    if measured_small(first, **bounds):
        begun = placed(words.join(F.broadcast(first), "_word"), "_lengths")
    else:
        begun = placed(_possible(words, first)).join(first.hint("merge"), "_word")
    begun = begun.withColumn("_n", F.explode("_lengths")).where("size(_pieces) >= 2 * _n - 1")
    # Words and what lies between them take turns.
    grams = begun.withColumn("_pieces", F.expr("slice(_pieces, 1, 2 * _n - 1)")).select(
        *keys, "_start", F.expr("array_join(_pieces, '')").alias("_text"),
        F.expr("IF(_n = 1, _word, array_join(transform(filter(_pieces, (x, i) -> i % 2 = 0), w -> lower(w)), ' '))").alias("gram"))
    known = terms.select("gram", "types")
    hits = grams.join(F.broadcast(known) if measured_small(known, **bounds) else known.hint("merge"), "gram")
    return hits.withColumn("entity_type", F.explode("types")).select(
        *keys, "entity_type", F.col("_start").alias("start"), F.expr("_start + length(_text)").alias("end"),
        F.lit(float(score)).alias("score"), F.col("_text").alias("text"), F.lit(name).alias("recognizer"),
        F.lit(name).alias("rationale"))


def gazetteer(df: DataFrame, key: str | list[str], text_col: str, dictionary: DataFrame,
              score: float = reg.DICTIONARY_SCORE, name: str = "DictionaryRecogniser", **bounds) -> DataFrame:
    """One row per dictionary hit: key columns and the span columns."""
    keys = [key] if isinstance(key, str) else list(key)
    terms = term_grams(dictionary)
    texts = spread(df.select(*keys, text_col))
    if measured_small(terms, **bounds):
        found = _in_row_spans(texts, text_col, terms, score, name, "_spans")
        return inline_rows(found, keys, F.col("_spans"), "start")
    return _joined_rows(texts, keys, text_col, terms, score, name, **bounds)


def with_dictionary_spans(df: DataFrame, key: str | list[str], text_col: str, dictionary: DataFrame,
                          score: float = reg.DICTIONARY_SCORE, name: str = "DictionaryRecogniser",
                          out_col: str = "dictionary_spans", **bounds) -> DataFrame:
    """The same hits as an array next to their text.

    In place for a small dictionary; for a large one hits are gathered by the text's
    digest and joined back on it, so keys may repeat or be null.  The text itself is
    shuffled once, and Spark splits one that many rows have.  A null text has no
    spans; ``key`` spreads the rows of such.
    """
    terms = term_grams(dictionary)
    if measured_small(terms, **bounds):
        return _in_row_spans(df, text_col, terms, score, name, out_col)
    keys = [key] if isinstance(key, str) else list(key)
    digested = df.withColumn("_digest", F.unhex(F.sha2(text_col, 256)))
    hits = _joined_rows(digested, ["_digest"], text_col, terms, score, name, **bounds)
    # Rows of equal texts give equal hits.  What the text or a constant tells is added behind the join.
    slim = F.struct("entity_type", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))
    found = hits.groupBy("_digest").agg(F.array_sort(F.collect_set(slim)).alias("_found"))
    apart = F.coalesce("_digest", F.unhex(F.hex(F.xxhash64(*keys))))
    span = lambda s: record(
        entity_type=f"{s}.entity_type", start=f"{s}.start", end=f"{s}.`end`", score=f"{float(score)}D",
        text=f"substring(`{text_col}`, {s}.start + 1, {s}.`end` - {s}.start)", recognizer=quoted(name), rationale=quoted(name))
    spans = f"cast({transform('coalesce(_found, array())', span)} as array<{SPAN_DDL}>)"
    return digested.withColumn("_digest", apart).join(found.hint("merge"), "_digest", "left").select(
        *[c for c in df.columns if c != out_col], F.expr(spans).alias(out_col))


def deny_terms(df: DataFrame, key: str | list[str], text_col: str, terms: DataFrame, **bounds) -> DataFrame:
    """Deny-list hits for long term tables (column ``term``), as rows."""
    typed = terms.select("term", F.lit(fv.DENY_ENTITY).alias("entity_type"))
    return gazetteer(df, key, text_col, typed, score=1.0, name="DenyListRecogniser", **bounds)


def spans_by_key(rows: DataFrame, key: str | list[str], out_col: str = "dictionary_spans") -> DataFrame:
    """Hit rows gathered per text; a text's hits are bounded by its length."""
    keys = [key] if isinstance(key, str) else list(key)
    span = F.struct("entity_type", F.col("start").cast("int").alias("start"),
                    F.col("end").cast("int").alias("end"), "score", "text", "recognizer", "rationale")
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(span.cast(SPAN_DDL))).alias(out_col))


def attach_spans(df: DataFrame, rows: DataFrame, key: str | list[str],
                 out_col: str = "dictionary_spans") -> DataFrame:
    """Put hit rows next to their text; ``key`` must be unique in ``df``."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.join(spans_by_key(rows, keys, out_col), keys, "left")


def model_spans(df: DataFrame, key: str, text_col: str,
                model: Callable[[pd.Series], list[list[tuple[str, int, int, float]]]],
                name: str = "ModelRecogniser") -> DataFrame:
    """Hook for a caller's recogniser: batches of texts in, (label, start, end, score) lists out."""
    key_type = df.schema[key].dataType.simpleString()
    out = (f"`{key}` {key_type}, entity_type string, start int, `end` int, score double, "
           "text string, recognizer string, rationale string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [key, "entity_type", "start", "end", "score", "text", "recognizer", "rationale"]
        for batch in batches:
            found = model(batch[text_col])
            rows = [(k, label, s, e, score, t[s:e], name, name)
                    for k, t, spans in zip(batch[key], batch[text_col], found)
                    for label, s, e, score in spans]
            yield pd.DataFrame(rows, columns=names)

    texts = df.select(key, text_col).where(F.col(text_col).isNotNull())
    return texts.mapInPandas(run, out).withColumn("entity_type", fold_label())


def guarded_model_spans(df: DataFrame, key: str, text_col: str,
                        model: Callable[[pd.Series], list[list[tuple[str, int, int, float]]]],
                        name: str = "ModelRecogniser") -> DataFrame:
    """As ``model_spans``, for models that may raise: a row of spans, or a row with ``error``, a text.

    A batch that raises is tried text by text, so one bad text costs its own spans only.  Spans that do not lie in
    their text are errors of that text as well.  ``error`` is null in rows of spans; in others only the key is set.
    """
    key_type = df.schema[key].dataType.simpleString()
    fields = ["entity_type", "start", "end", "score", "text", "recognizer", "rationale", "error"]
    out = (f"`{key}` {key_type}, entity_type string, start int, `end` int, score double, "
           "text string, recognizer string, rationale string, error string")

    def of_text(k, text, spans):
        rows = []
        for label, start, end, score in spans:
            if not 0 <= start < end <= len(text):
                raise ValueError(f"span {start}-{end} is not in the text")
            rows.append((k, str(label), int(start), int(end), float(score), text[start:end], name, name, None))
        return rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                every = model(batch[text_col])
                if len(every) != len(batch):
                    raise ValueError("the model gave another number of texts")
                rows = [r for k, t, spans in zip(batch[key], batch[text_col], every) for r in of_text(k, t, spans)]
            except Exception:  # whichever text it was: each by itself
                rows = []
                for i in range(len(batch)):
                    one = batch.iloc[i:i + 1]
                    k, t = one[key].iloc[0], one[text_col].iloc[0]
                    try:
                        rows += of_text(k, t, model(one[text_col])[0])
                    except Exception as error:
                        rows.append((k, *[None] * 7, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=[key, *fields])

    texts = df.select(key, text_col).where(F.col(text_col).isNotNull())
    return texts.mapInPandas(run, out).withColumn("entity_type", fold_label())
