"""The entity index: which atoms mention an entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An entity with more index rows than this is broad.
BROAD_DEGREE = 5


def entity_index(atoms: DataFrame) -> DataFrame:
    """``entity, atom_id, epoch_id``: each subject, predicate and object once per atom; null and empty names are left out."""
    parts = F.explode(F.expr("flatten(transform(triples, t -> array(t.subj, t.pred, t.obj)))")).alias("entity")
    rows = atoms.select(parts, F.col("id").alias("atom_id"), "epoch_id")
    return usable_index(rows)


def usable_index(index: DataFrame) -> DataFrame:
    """Index rows once each, without null and empty entities or atoms."""
    return index.where((F.col("entity") != "") & F.col("atom_id").isNotNull()).select("entity", "atom_id", "epoch_id").distinct()


def pairs(index: DataFrame) -> DataFrame:
    """``entity, atom_id`` once each, whatever the epoch."""
    return index.where((F.col("entity") != "") & F.col("atom_id").isNotNull()).select("entity", "atom_id").distinct()


def merged_index(index: DataFrame, more: DataFrame) -> DataFrame:
    """Insert-or-ignore of further index rows."""
    return usable_index(index.select("entity", "atom_id", "epoch_id").unionByName(more.select("entity", "atom_id", "epoch_id")))


def entity_degree(index: DataFrame) -> DataFrame:
    """``entity, degree``: index rows per entity."""
    return usable_index(index).groupBy("entity").agg(F.count(F.lit(1)).alias("degree"))


def lookup(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``wanted`` (column ``entity``, any further columns) with the atoms indexed under the entity; case counts."""
    return wanted.join(pairs(index), "entity")


def subject_object(atoms: DataFrame, id_col: str = "id") -> DataFrame:
    """``atom_id, entity``: distinct subjects and objects of each atom, predicates left out."""
    both = F.explode(F.expr("array_distinct(flatten(transform(triples, t -> array(t.subj, t.obj))))")).alias("entity")
    return atoms.select(F.col(id_col).alias("atom_id"), both).where(F.col("entity") != "")
