"""Text expressions of entity extraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are never entities.
STOP_ENTITIES = ["user", "agent", "the", "this", "that", "it", "i", "my", "me", "they", "their", "who", "what", "where", "when", "how"]
# What is deleted from a text before it is searched.
DELETED = ["'s", "?", ".", ","]


def cleaned(text: Column) -> Column:
    """Lower case, without possessives and the signs in :data:`DELETED`."""
    return reduce(lambda c, s: F.replace(c, F.lit(s), F.lit("")), DELETED, F.lower(text))


def long_words(clean: Column, longer_than: int = 2) -> Column:
    """Distinct words of more than ``longer_than`` characters."""
    return F.array_distinct(F.filter(F.split(F.trim(clean), r"\s+"), lambda w: F.length(w) > longer_than))


def is_stop_entity(entity: Column) -> Column:
    return F.lower(entity).isin(STOP_ENTITIES)


def capitalized(text: Column) -> Column:
    """Words that begin with a capital, without signs around them: a cheap guess at entities."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w.rlike(r"^[A-Z]"))
    return F.array_distinct(F.transform(words, lambda w: F.regexp_replace(w, r"^[.,?!]+|[.,?!]+$", "")))


def rule_triples(text: Column, rules: list[tuple[list[str], tuple[str, str, str]]]) -> Column:
    """Triples whose rule's terms all occur in the text, letter case ignored, in the order of the rules."""
    low = F.lower(text)

    def one(terms: list[str], triple: tuple[str, str, str]) -> Column:
        held = reduce(lambda a, b: a & b, [F.contains(low, F.lit(t.lower())) for t in terms])
        s, p, o = triple
        return F.when(held, F.struct(F.lit(s).alias("subj"), F.lit(p).alias("pred"), F.lit(o).alias("obj")))

    return F.array_compact(F.array(*[one(t, x) for t, x in rules]))


def holds_all(text: Column, terms: Column) -> Column:
    """Whether the text holds every term, letter case ignored."""
    return F.forall(terms, lambda t: F.contains(F.lower(text), F.lower(t)))
