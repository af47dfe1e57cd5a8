"""Document fingerprints: one-permutation MinHash with optimal densification and packed low bits.

Every shingle of five words is hashed once.  The high bits of a hash choose one of ``BINS``
bins, each bin keeps its smallest hash, and an empty bin borrows from a bin drawn anew for every
attempt until it hits a filled one, in the same way for all texts.  Only the low
``BITS`` bits of each bin are kept, one hexadecimal digit a bin; the likeness of two fingerprints
is the share of equal digits, freed of the digits that agree by chance.

All of it is DataFrame and SQL expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import WORD, shuffle_partitions

SHINGLE = 5
BINS, BITS = 256, 4
PROBES = 4
BIN = "shiftright({}, 56)"  # -128..127, in the order of the hashes


def with_digits(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: the low bits of all bins, an array of ``BINS`` numbers.

    Words are runs free of ASCII white space, in lower case.  Fewer than five words are one
    shingle; texts without words (null and empty ones too) have zeros everywhere.
    """
    keep = df.columns
    bin_x, bin_before = BIN.format("x"), BIN.format("get(_sorted, i - 1)")
    words = F.expr(f"transform(regexp_extract_all(lower({text}), r'{WORD}', 0), w -> xxhash64(w))")
    df = df.select(*keep, words.alias("_h"))
    others = ", ".join(f"get(_h, i + {k})" for k in range(1, SHINGLE))
    df = df.select(*keep, F.expr(
        f"sort_array(transform(slice(_h, 1, greatest(size(_h) - {SHINGLE - 1}, 1)), (x, i) -> xxhash64(x, {others})))"
    ).alias("_sorted"))
    df = df.select(*keep, F.expr(
        f"filter(_sorted, (x, i) -> i = 0 OR {bin_x} <> {bin_before})").alias("_first"))
    gap = f"CAST({bin_x} - IF(i = 0, -129, {BIN.format('get(_first, i - 1)')}) - 1 AS INT)"
    last = f"CAST(127 - coalesce({BIN.format('element_at(_first, -1)')}, -129) AS INT)".replace(
        "element_at(_first, -1)", "get(_first, size(_first) - 1)")
    none = "CAST(NULL AS TINYINT)"
    low = f"CAST(x & {(1 << BITS) - 1} AS TINYINT)"
    df = df.select(*keep, "_first", F.expr(
        f"concat(flatten(transform(_first, (x, i) -> concat(array_repeat({none}, {gap}), array({low})))), "
        f"array_repeat({none}, {last}))").alias("_bins"))
    # A few draws first; where all hit empty bins, the filled bin drawn earliest in the bin's own order of all
    # bins.  Both choose evenly among the filled bins, and the same for any two texts that have them filled alike.
    draws = ", ".join(f"get(_bins, CAST(xxhash64(j, {t}) & {BINS - 1} AS INT))" for t in range(PROBES))
    rest = (f"array_min(transform(_first, x -> named_struct('draw', xxhash64(j, {bin_x}), 'low', {low}))).low")
    return df.select(*keep, F.expr(
        f"transform(_bins, (b, j) -> coalesce(b, {draws}, {rest}, CAST(0 AS TINYINT)))").alias(out))


def packed(digits: str) -> Column:
    """One hexadecimal digit a bin."""
    return F.expr(f"array_join(transform({digits}, d -> substring('0123456789abcdef', d + 1, 1)), '')")


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of the shingle sets; the share of equal digits without chance."""
    equal = F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> IF(x = y, 1, 0)), 0, (n, x) -> n + x)")
    chance = 1 / (1 << BITS)
    return F.greatest(F.lit(0.0), (equal / F.lit(float(BINS)) - chance) / (1 - chance))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a column ``fingerprint``; equal texts have equal fingerprints.

    Null text counts as empty.  Every row is worked on by itself, so null ids, repeated rows and
    empty tables need no rule.  A column named ``fingerprint`` is replaced.
    """
    own = [c for c in docs.columns if c != "fingerprint"]
    rows = docs.select(F.struct(*own).alias("own"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    done = with_digits(rows, "text", "digits")
    return done.select(*[F.col("own")[c].alias(c) for c in own], packed("digits").alias("fingerprint"))


def id_bounds(docs: DataFrame, parts: int) -> list[int]:
    """Upper bounds of ranges of doc_id with about as many rows each: ``parts`` numbers at most.

    They are ids of the table, and the last is the largest one.
    """
    shares = [k / parts for k in range(1, parts + 1)]
    row = docs.agg(F.percentile_approx("doc_id", shares, 20_000).alias("b"), F.max("doc_id").alias("m")).first()
    return sorted({*(row["b"] or []), row["m"]} - {None})


def neighbours(docs: DataFrame, values: list[str], parts: int) -> DataFrame:
    """``docs`` with ``next_<value>``: the values of the next row in descending doc_id; the first row's after the last.

    Rows with equal ids come in the order of their text; rows without id come last, and null text is
    first.  No task holds more than a range of ids: each range also gets the rows just below it, that is those
    with the upper bound of the range before.
    """
    bounds = id_bounds(docs, parts)
    if not bounds:
        bounds = [0]
    table = "array(" + ", ".join(f"{b}L" for b in bounds) + ")"
    part = F.expr(f"size(filter({table}, b -> b < doc_id))")
    part = F.when(F.col("doc_id").isNull(), 0).otherwise(part)
    copies = F.when(F.expr(f"array_contains({table}, doc_id)"),
                    F.array(F.struct(part.alias("p"), F.lit(0).alias("ghost")),
                            F.struct(F.pmod(part + 1, F.lit(len(bounds))).alias("p"), F.lit(1).alias("ghost")))
                    ).otherwise(F.array(F.struct(part.alias("p"), F.lit(0).alias("ghost"))))
    spread = docs.withColumn("_at", F.explode_outer(copies))
    order = W.partitionBy("_at.p").orderBy("_at.ghost", F.desc_nulls_last("doc_id"), *values)
    return spread.select("*", *[F.lead(v).over(order).alias(f"next_{v}") for v in values]).where(
        "_at.ghost = 0").drop("_at")


def edit_and_compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of an edited text, and how alike they are.

    Gives ``(doc_id, n_chars, text, edited, fingerprint, edited_fingerprint, near_edited, near_next)``.
    The edited text has its last third (rounded down) replaced by as many first code points of the next
    document in descending doc_id, or all it has.  ``near_next`` compares with the next document itself.
    A table of one row is its own next document.
    """
    parts = 4 * shuffle_partitions(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    both = neighbours(with_digits(base, "text", "digits"), ["text", "digits"], parts)
    third = F.floor(F.char_length("text") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.char_length("text") - third),
                      F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), third))
    both = both.select("doc_id", "text", "digits", "next_digits", edited.alias("edited"))
    both = with_digits(both, "edited", "edited_digits")
    return both.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), "text", "edited",
        packed("digits").alias("fingerprint"), packed("edited_digits").alias("edited_fingerprint"),
        likeness("digits", "edited_digits").alias("near_edited"),
        F.coalesce(likeness("digits", "next_digits"), F.lit(0.0)).alias("near_next"))
