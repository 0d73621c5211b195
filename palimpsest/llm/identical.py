"""Records that say the same in another formatting, collapsed into one each.

Columns (here: the fields of a payload) are dictionary-encoded. Every distinct
raw value is canonicalised once; canonical values and field names get dense
integer ids; a record becomes the sorted tuple of its (field id, value id)
pairs; and equal tuples are one record. Only digests and integers move between
tasks, apart from one copy of each distinct raw value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.payload import json_fields, json_scalar, letters_digits
from palimpsest.session import cut

#: The field name under which a payload that is one text, not an object, is kept; no canonical field name is empty.
WHOLE = ""


def _digest(c: Column) -> Column:
    return F.unhex(F.sha2(c, 256))


def _entries(payload: Column) -> Column:
    """Fields of a payload as an array of (key, value); a plain text is one field :data:`WHOLE`."""
    objects = json_fields(payload)
    text = F.when(payload.rlike(r'^\s*"'), F.coalesce(json_scalar(payload), payload)).otherwise(payload)
    whole = F.array(F.struct(F.lit(WHOLE).alias("key"), text.alias("value")))
    return F.when(objects.isNotNull(), F.map_entries(objects)).otherwise(whole)


def _plain(value: Column) -> Column:
    """What counts of a value: its letters and digits; the fields of objects inside it in order of their names."""
    nested = F.when(value.rlike(r"^\s*[\[{]"), F.to_json(F.try_parse_json(F.lower(F.upper(value)))))
    return letters_digits(F.coalesce(nested, value))


def fields_of(atoms: DataFrame, id_col: str = "id", payload: str = "payload") -> DataFrame:
    """``rec, pkey, size, field, raw``: one row per field of a record, with the payload's digest and number of fields.

    Objects keep all fields, also empty ones. Null payloads have no rows.
    """
    p = F.col(payload)
    return (
        atoms.where(p.isNotNull())
        .select(F.col(id_col).alias("rec"), F.unhex(F.md5(p)).alias("pkey"), _entries(p).alias("es"))
        .select("rec", "pkey", F.size("es").alias("size"), F.explode("es").alias("e"))
        .select("rec", "pkey", "size", F.col("e.key").alias("field"), F.coalesce(F.col("e.value"), F.lit("")).alias("raw"))
    )


def formatting_records(atoms: DataFrame, id_col: str = "id", payload: str = "payload") -> DataFrame:
    """``rec, tuple, copies``: the sorted tuple of integers of every record with a letter or digit in a value; see :func:`formatting_classes`."""
    rows = fields_of(atoms, id_col, payload).select("rec", "pkey", "size", "field", "raw", _digest(F.concat_ws("\u0001", "field", "raw")).alias("raw_key"))
    # one copy of each distinct raw (field, value) is canonicalised
    distinct = rows.groupBy("raw_key").agg(F.first("field").alias("field"), F.first("raw").alias("raw"))
    canon = distinct.select(
        "raw_key",
        letters_digits(F.col("field")).alias("name"),
        _plain(F.col("raw")).alias("value"),
    ).select("raw_key", _digest(F.concat_ws("\u0001", "name", "value")).alias("canon_key"), (F.length("value") > 0).alias("has_value"))
    canon = cut(canon)
    ids = cut(canon.groupBy("canon_key").agg(F.max("has_value").alias("has_value")).withColumn("pair_id", F.monotonically_increasing_id()))
    dictionary = canon.select("raw_key", "canon_key").join(ids, "canon_key").select("raw_key", "pair_id", "has_value")
    # a row gives each of its fields once, so that rows of one id and payload are as many as their field rows by their fields
    records = (
        rows.select("rec", "pkey", "size", "raw_key")
        .join(dictionary, "raw_key")
        .groupBy("rec", "pkey")
        .agg(F.array_sort(F.collect_set("pair_id")).alias("tuple"), F.max("has_value").alias("has_value"), (F.count(F.lit(1)) / F.first("size")).cast("long").alias("copies"))
        .where("has_value")
        .select("rec", "tuple", "copies")
    )
    return cut(records)


def formatting_classes(atoms: DataFrame, id_col: str = "id", payload: str = "payload") -> DataFrame:
    """``rec, class_id, class_size, class_key`` for every record with at least one letter or digit in a value.

    Two records share a class exactly if they have the same set of field names
    and values once only letters and digits count, without letter case; fields of
    objects inside a value may stand in any order too. Null and empty payloads
    and those without letters or digits have no class. Rows of one id are separate
    records, each with its class; ``class_id`` is the least id of a class, and
    ``class_key`` tells classes apart where an id is repeated. An empty table gives
    no rows; further columns of ``atoms`` are not read.
    """
    records = formatting_records(atoms, id_col, payload)
    sizes = records.groupBy("tuple").agg(F.sum("copies").alias("class_size"), F.min("rec").alias("class_id"))
    key = F.xxhash64("tuple").alias("class_key")
    return records.join(sizes, "tuple").select("rec", "class_id", "class_size", key, F.explode(F.sequence(F.lit(1), "copies")).alias("_c")).drop("_c")


def collapsed(classes: DataFrame) -> DataFrame:
    """One row per class with the number of copies: ``class_id, copies``; the least id stands for its class."""
    return classes.groupBy("class_id", "class_key").agg(F.count(F.lit(1)).alias("copies")).select("class_id", "copies")


def pairs_within(classes: DataFrame) -> DataFrame:
    """All pairs ``id_a < id_b`` of one class. Their number is the square of the class size; prefer the classes themselves."""
    several = classes.where(F.col("class_size") > 1).select("class_id", "class_key", "rec").distinct()
    a = several.select("class_id", "class_key", F.col("rec").alias("id_a"))
    b = several.select("class_id", "class_key", F.col("rec").alias("id_b"))
    return a.join(b, ["class_id", "class_key"]).where(F.col("id_a") < F.col("id_b")).select("id_a", "id_b")


def formatting_key(payload: Column) -> Column:
    """A digest that is equal for payloads of one formatting class, computed row by row; null payloads give null.

    The same canonical form as :func:`formatting_classes`, for operators that
    only need to know whether two given records are such copies.
    """
    canon = F.transform(_entries(payload), lambda e: F.concat_ws("\u0001", letters_digits(e["key"]), _plain(F.coalesce(e["value"], F.lit("")))))
    return F.unhex(F.md5(F.concat_ws("\u0002", F.array_sort(F.array_distinct(canon)))))
