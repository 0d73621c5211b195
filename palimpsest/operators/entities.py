"""Entities of the index that a text mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import cleaned, is_stop_entity, long_words

#: Characters by which entities and texts are joined.
HEAD = 8


def mentioned(texts: DataFrame, entities: DataFrame, key: str, text: str) -> DataFrame:
    """``key, entity``: entities whose lower-case form is a substring of the cleaned text, stop entities left out.

    Substrings of up to :data:`HEAD` characters are equi-joined with the heads of
    the entities, so that a text gives rows in proportion to its length, and meets
    only entities whose head it holds; longer ones are then looked for in the
    text. Null texts mention nothing; an empty entity is no entity.
    """
    names = entities.select("entity").where((F.col("entity") != "") & ~is_stop_entity(F.col("entity"))).distinct().withColumn("_low", F.lower("entity")).withColumn("_head", F.substring("_low", 1, HEAD))
    clean = texts.where(F.col(text).isNotNull()).select(key, cleaned(F.col(text)).alias("_c"))
    begin = clean.select(key, F.explode(F.expr(f"transform(sequence(1, greatest(length(_c), 1)), i -> substring(_c, i, {HEAD}))")).alias("_g")).where("_g <> ''").distinct()
    heads = begin.select(key, F.explode(F.expr("transform(sequence(1, length(_g)), n -> substring(_g, 1, n))")).alias("_head")).distinct()
    met = heads.join(names, "_head").select(key, "entity", "_low")
    short = F.length("_low") <= HEAD
    whole = met.where(~short).join(clean, key).where(F.contains("_c", F.col("_low")))
    return met.where(short).select(key, "entity").unionByName(whole.select(key, "entity")).distinct()


def hinted_predicates(texts: DataFrame, predicates: DataFrame, key: str, text: str) -> DataFrame:
    """``key, entity``: predicates held by the text, or of which a part of more than 3 letters has its first 4 inside a word of the text."""
    preds = predicates.select(F.col("pred").alias("entity")).where((F.col("entity") != "") & ~is_stop_entity(F.col("entity"))).distinct()
    whole = mentioned(texts, preds, key, text)
    roots = preds.select("entity", F.explode(F.split(F.replace(F.lower("entity"), F.lit("_"), F.lit(" ")), r"\s+")).alias("_p")).where(F.length("_p") > 3).select("entity", F.substring("_p", 1, 4).alias("_root")).distinct()
    words = texts.where(F.col(text).isNotNull()).select(key, F.explode(long_words(cleaned(F.col(text)))).alias("_w")).where(F.length("_w") >= 4)
    grams = words.select(key, F.explode(F.expr("transform(sequence(1, length(_w) - 3), i -> substring(_w, i, 4))")).alias("_root")).distinct()
    return whole.unionByName(grams.join(roots, "_root").select(key, "entity")).distinct()


def extract_entities(texts: DataFrame, index: DataFrame, predicates: DataFrame, key: str, text: str) -> DataFrame:
    """Both passes together: ``key, entity``."""
    return mentioned(texts, index, key, text).unionByName(hinted_predicates(texts, predicates, key, text)).distinct()
