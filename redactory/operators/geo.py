"""Place mentions in text and in location entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import fixed_values as fv
from ..functions import text as tx
from ..functions.expr import quoted
from ..plans.salting import lookup_join, salted_join
from ..plans.sizing import measured_small, small_side
from .dictionary import gazetteer


def cities(spark) -> DataFrame:
    rows = [(i, c, lat, lon) for i, (c, lat, lon) in enumerate(fv.CITIES)]
    return spark.createDataFrame(rows, "pos int, city string, lat double, lon double")


def aliases(spark) -> DataFrame:
    return spark.createDataFrame(fv.CITY_ALIASES, "alias string, city string")


def text_mentions(texts: DataFrame, key: str, text_col: str, places: DataFrame) -> DataFrame:
    """Whole-word hits of each place name in the normalised text: n-gram join."""
    plain = texts.select(key, F.expr(tx.place_token(f"`{text_col}`")).alias("_token"))
    terms = places.select(F.col("city").alias("term"), F.lit("LOCATION").alias("entity_type"))
    hits = gazetteer(plain, key, "_token", terms)
    return hits.select(key, F.col("text").alias("city"))


# Place tables up to this size become part of the expression.
MAX_INLINE_PLACES = 2_000


def resolve_city(df: DataFrame, value_col: str, places: DataFrame, alias_table: DataFrame,
                 out_col: str = "city", max_rows: int = MAX_INLINE_PLACES) -> DataFrame:
    """City of a place text: exact name, alias, first word, contained name in table order.

    With a small place table rows are resolved where they are.  With a larger one
    the distinct texts are resolved by joins and the answers joined back.  Null
    means no city.
    """
    # A repeated alias or place counts once, whichever way rows are resolved.
    alias_table = alias_table.groupBy("alias").agg(F.min("city").alias("city"))
    places = places.groupBy("city").agg(F.min("pos").alias("pos"))
    if not (measured_small(places, max_rows) and measured_small(alias_table, max_rows)):
        return _resolve_by_joins(df, value_col, places, alias_table, out_col)
    names = [r["city"] for r in places.orderBy("pos").collect()]  # the dimension, not the facts
    pairs = [(r["alias"], r["city"]) for r in alias_table.collect()]
    listed = "array(" + ", ".join(quoted(n) for n in names) + ")"
    alias_map = "map(" + ", ".join(f"{quoted(a)}, {quoted(c)}" for a, c in pairs) + ")"
    token = "_token"
    first_word = f"split({token}, ' ')[0]"
    contained = f"get(filter({listed}, c -> contains(concat(' ', {token}, ' '), concat(' ', c, ' '))), 0)"
    rule = (f"CASE WHEN {token} = '' THEN NULL "
            f"WHEN array_contains({listed}, {token}) THEN {token} "
            f"WHEN map_contains_key({alias_map}, {token}) THEN element_at({alias_map}, {token}) "
            f"WHEN array_contains({listed}, {first_word}) THEN {first_word} "
            f"ELSE {contained} END")
    return (df.withColumn(token, F.expr(tx.place_token(f"`{value_col}`")))
            .withColumn(out_col, F.expr(rule)).drop(token))


def _resolve_by_joins(df: DataFrame, value_col: str, places: DataFrame, alias_table: DataFrame, out_col: str) -> DataFrame:
    values = df.select(F.col(value_col).alias("_v")).where(F.col("_v").isNotNull()).distinct()
    tokens = values.withColumn("_t", F.expr(tx.place_token("_v"))).where("_t <> ''")
    named = places.select(F.col("city").alias("_t"), "city", "pos")
    other = alias_table.select(F.col("alias").alias("_t"), "city", F.lit(0).alias("pos"))
    first = tokens.select("_v", F.split("_t", " ")[0].alias("_t"))
    terms = places.select(F.col("city").alias("term"), F.lit("LOCATION").alias("entity_type"))
    inside = gazetteer(tokens, "_v", "_t", terms).select("_v", F.col("text").alias("_t"))
    found = None
    for rule, (texts, table) in enumerate([(tokens, named), (tokens, other), (first, named), (inside, named)]):
        hits = lookup_join(texts.select("_v", "_t"), table, "_t", "_v").select(
            "_v", "city", F.struct(F.lit(rule).alias("rule"), F.col("pos").cast("int").alias("pos")).alias("rank"))
        found = hits if found is None else found.unionByName(hits)
    answers = found.groupBy("_v").agg(F.min_by("city", "rank").alias(out_col)).withColumnRenamed("_v", value_col)
    spread = df.withColumn("_spread", F.xxhash64(value_col, F.to_json(F.struct(*df.columns))))  # any column type
    return salted_join(spread, answers, value_col, "_spread", "left").select(*df.columns, out_col)


def entity_mentions(detections: DataFrame, places: DataFrame, alias_table: DataFrame) -> DataFrame:
    """Location entities with their city, null when it cannot be mapped; blank texts are left out."""
    located = detections.where(F.upper("entity_type").isin(fv.LOCATION_ENTITIES) & (F.trim("text") != ""))
    return resolve_city(located, "text", places, alias_table)


def geo_counts(text_hits: DataFrame, entity_hits: DataFrame) -> DataFrame:
    """Mentions per city: from text, from entities, together; the row with a null
    city counts the entities that could not be mapped."""
    both = (text_hits.select("city", F.lit(1).alias("t"), F.lit(0).alias("e"))
            .unionByName(entity_hits.select("city", F.lit(0).alias("t"), F.lit(1).alias("e"))))
    return both.groupBy("city").agg(F.sum("t").alias("text_mentions"), F.sum("e").alias("entity_mentions"),
                                    (F.sum("t") + F.sum("e")).alias("mentions"))


def map_rows(counts: DataFrame, places: DataFrame) -> DataFrame:
    """Mapped cities with coordinates."""
    return counts.where(F.col("city").isNotNull()).join(small_side(places.drop("pos")), "city").select(
        "city", "lat", "lon", "mentions")


def map_view(rows: DataFrame) -> DataFrame:
    """Bounding box and centre of all mapped cities."""
    return rows.agg(F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.min("lon").alias("min_lon"),
                    F.max("lon").alias("max_lon")).select(
        "*", ((F.col("min_lat") + F.col("max_lat")) / 2).alias("center_lat"),
        ((F.col("min_lon") + F.col("max_lon")) / 2).alias("center_lon"))


