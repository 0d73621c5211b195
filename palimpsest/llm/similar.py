"""Near-duplicate records: an exact prefix join of word sets, and fast similarity sketches.

Words are put in one order, rare ones first. Two sets of similarity ``t`` or more
share so many words that the first few of each (a third of the longer, a sixth of
the shorter at t = 0.7) have a word in common, so that only postings of these
prefixes meet; sizes, positions and the parities of hashed words then drop pairs
that cannot be similar enough, before anything is moved. None of these bounds
drops a pair that is: whatever the words of a pair are, it reaches the exact
verification. The order is by counts of hashed words in a fixed number of
buckets; any order gives the same pairs, a good one fewer candidates.

A record's set of words is sketched by hashed bin placement: in round ``r`` of
the first ``t`` rounds every element is thrown into a random bin, in the next
``t`` rounds all elements are thrown into bin ``r - t``; a bin keeps the least
value it saw, and earlier rounds always win. After at most ``2 t`` rounds every
bin is filled, and equal sets agree in every bin, whatever their size. Sketches
estimate similarities; the pairs do not depend on them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.session import cut

#: Bins of a sketch.
BINS = 160
#: Bits of a word's bucket: the order of words is by how many distinct sets hold words of the bucket.
BUCKET_BITS = 20

WORD = re.compile(r"[^\W_]+")

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with full avalanche."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def word_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word hashes of all texts, sorted within a text, and where each text's begin (one more at the end).

    A word is an unbroken run of letters or digits, letter case ignored.
    """
    words = [WORD.findall(t.lower()) if t else [] for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = [w for ws in words for w in ws]
    if not flat:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    codes, uniques = pd.factorize(np.array(flat, dtype=object))
    hashes = pd.util.hash_array(np.asarray(uniques, dtype=object), categorize=False)[codes]
    doc = np.repeat(np.arange(len(texts)), sizes)
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    keep = np.r_[True, (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])]
    doc, hashes = doc[keep], hashes[keep]
    return hashes, np.searchsorted(doc, np.arange(len(texts) + 1))


def sketches(elements: np.ndarray, starts: np.ndarray, t: int = BINS) -> np.ndarray:
    """One sketch of ``t`` 64-bit bins for every non-empty set; sets are given back to back, ``starts`` as in :func:`word_sets`."""
    n = len(starts) - 1
    sizes = np.diff(starts)
    out = np.full(n * t, np.iinfo(np.uint64).max, np.uint64)
    doc = np.repeat(np.arange(n), sizes)
    live = np.ones(len(elements), bool)
    empty = np.full(n, t)
    with np.errstate(over="ignore"):
        for r in range(2 * t):
            if r and r % 4 == 0:
                filled = (out.reshape(n, t) != np.iinfo(np.uint64).max).sum(1)
                empty = np.where(sizes > 0, t - filled, 0)
                live = empty[doc] > 0
                if not live.any():
                    break
            e, d = elements[live], doc[live]
            h = mix(e + _STEP * np.uint64(2 * r + 1))
            where = d * t + ((h >> np.uint64(40)) % np.uint64(t)).astype(np.int64) if r < t else d * t + (r - t)
            # the round is the leading part of the value, so that bins filled in an earlier round stand
            value = (np.uint64(r) << np.uint64(54)) | (mix(h) >> np.uint64(10))
            np.minimum.at(out, where, value)
    return out.reshape(n, t)


def _sets(text_rows: DataFrame) -> DataFrame:
    """``rec, grp, word_set, words``: digest of the word set and the hashes themselves; texts without words are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, s = word_sets(b.column(2).to_pylist())
            rows = np.flatnonzero(np.diff(s) > 0)
            raw = [h[s[i] : s[i + 1]].tobytes() for i in rows]
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(raw, pa.binary())], names=["rec", "grp", "words"])

    hashed = text_rows.mapInArrow(run, "rec string, grp binary, words binary")
    return hashed.withColumn("word_set", F.unhex(F.md5("words")))


def _spread(sets: DataFrame) -> np.ndarray:
    """How many words of the distinct sets fall into each bucket of word hashes, over all sets; a table of fixed size."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for b in batches:
            words = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint64)
            total += np.bincount(_bucket(words), minlength=len(total))
        got = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(got, pa.int64()), pa.array(total[got], pa.int64())], names=["bucket", "n"])

    counted = sets.select("words").mapInArrow(fold, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    spread = np.zeros(1 << BUCKET_BITS, np.int64)
    spread[np.asarray(counted.column(0).combine_chunks())] = np.asarray(counted.column(1).combine_chunks())
    return spread


def _bucket(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def prefixes(elements: np.ndarray, starts: np.ndarray, spread: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Postings of the first words of every non-empty set: set, word, position, and whether the set is found by it as the shorter of a pair; and two columns of parities a set.

    Two sets x, y, the longer first, with similarity of at least ``least`` share
    ``least / (1 + least) * (|x| + |y|)`` words, which is at least
    ``least * |x|`` and at least ``2 * least / (1 + least) * |y|``; so the rarest
    shared word is among the first of both. Words that stand in one set only are
    counted, but have no posting.
    """
    sizes = np.diff(starts)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    count = spread[_bucket(elements)]
    order = np.lexsort((elements, count, doc))
    at = np.arange(len(elements)) - np.repeat(starts[:-1], sizes)
    probe = sizes - np.ceil(least * sizes - 1e-9) + 1
    index = sizes - np.ceil(2 * least / (1 + least) * sizes - 1e-9) + 1
    keep = (at < probe[doc]) & (count[order] > 1)
    bit = mix(elements) & np.uint64(127)
    one = np.uint64(1) << (bit & np.uint64(63))
    zero = np.uint64(0)
    parity = np.stack([np.bitwise_xor.reduceat(np.where((bit < 64) == low, one, zero), starts[:-1]) if len(sizes) else np.empty(0, np.uint64) for low in (True, False)], axis=1)
    return doc[keep], elements[order][keep], at[keep], (at < index[doc])[keep], parity


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def _verified(pairs: DataFrame, least: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sim = [_jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            s = pa.array(sim, pa.float64())
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), s], names=["a", "b", "similarity"])
            yield out.filter(pa.array(np.asarray(sim, np.float64) >= least, pa.bool_()))

    return pairs.select("a", "b", "words_a", "words_b").mapInArrow(run, "a long, b long, similarity double")


def similar_sets(rows: DataFrame, least: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Members and links: ``(rec, grp, node)`` and ``(a, b, similarity)``; a node is a distinct word set.

    ``rows`` has ``rec STRING, grp BINARY, text STRING``. Copies, and texts with
    the same words, are one word set, so any number of them is joined once; links
    are all pairs of different word sets, ``a < b``, with exact Jaccard
    similarity of at least ``least`` (above 0). Null texts and texts without
    words take no part. An empty table gives no rows. A word shared by very many
    different sets is not expanded in one task: the pairs come from an equi-join
    that adaptive execution splits.
    """
    sets = cut(_sets(rows))  # texts are read into words once
    distinct = cut(sets.groupBy("word_set").agg(F.first("words").alias("words")).withColumn("node", F.monotonically_increasing_id()))
    members = cut(sets.select("rec", "grp", "word_set").join(distinct.select("word_set", "node"), "word_set").select("rec", "grp", "node"))
    spread = rows.sparkSession.sparkContext.broadcast(_spread(distinct))

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                raw = part.column(1).to_pylist()
                starts = np.r_[0, np.cumsum([len(x) // 8 for x in raw])]
                doc, word, at, index, parity = prefixes(np.frombuffer(b"".join(raw), np.uint64), starts, spread.value, least)
                nodes = np.asarray(part.column(0))[doc]
                cols = [pa.array(word.view(np.int64)), pa.array(nodes, pa.int64()), pa.array(np.diff(starts)[doc], pa.int32()), pa.array(at, pa.int32()), pa.array(index, pa.bool_()), *[pa.array(parity[doc, k].view(np.int64)) for k in (0, 1)]]
                yield pa.RecordBatch.from_arrays(cols, names=["word", "node", "size", "at", "index", "p0", "p1"])

    postings = distinct.select("node", "words").mapInArrow(posted, "word long, node long, size int, at int, index boolean, p0 long, p1 long")
    longer = postings.drop("index").toDF("word", "x", "nx", "ix", "x0", "x1")
    shorter = postings.where("index").drop("index").toDF("word", "y", "ny", "iy", "y0", "y1")
    # words that both share at least; what stands before the first shared word, and an odd parity, is not shared
    shared = F.ceil(F.lit(least / (1 + least)) * (F.col("nx") + F.col("ny")) - F.lit(1e-9))
    apart = F.bit_count(F.col("x0").bitwiseXOR(F.col("y0"))) + F.bit_count(F.col("x1").bitwiseXOR(F.col("y1")))
    may = (
        ((F.col("ny") < F.col("nx")) | ((F.col("ny") == F.col("nx")) & (F.col("y") < F.col("x"))))
        & (F.col("ny") >= F.lit(least) * F.col("nx") - F.lit(1e-9))
        & (F.least(F.col("nx") - F.col("ix"), F.col("ny") - F.col("iy")) >= shared)
        & (apart <= F.col("nx") + F.col("ny") - 2 * shared)
    )
    joined = longer.join(shorter, (longer["word"] == shorter["word"]) & may)
    pairs = cut(joined.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    needed = distinct.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi").select("node", "words")
    both = pairs.join(needed.toDF("a", "words_a"), "a").join(needed.toDF("b", "words_b"), "b")
    return members, cut(_verified(both, least))


def near_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs ``id_a < id_b`` of records with similar word sets, but not of the same ``grp`` (formatting class)."""
    linked = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    mixed = members.groupBy("node").agg(F.min("grp").alias("_lo"), F.max("grp").alias("_hi")).where("_lo <> _hi").select(F.col("node").alias("a"), F.col("node").alias("b"))
    arcs = linked.unionByName(mixed)
    left = members.select(F.col("rec").alias("id_a"), F.col("grp").alias("grp_a"), F.col("node").alias("a"))
    right = members.select(F.col("rec").alias("id_b"), F.col("grp").alias("grp_b"), F.col("node").alias("b"))
    return arcs.join(left, "a").join(right, "b").where("id_a < id_b and grp_a <> grp_b").select("id_a", "id_b")


def classes(members: DataFrame, links: DataFrame) -> DataFrame:
    """``rec, class_id, n_links``: connected groups of similar word sets, every record with the least id of its group.

    Labels spread along the links and jump to their label's label, until nothing
    changes; the rounds grow with the logarithm of a chain's length, and only
    word sets with a link take part.
    """
    least = members.groupBy("node").agg(F.min("rec").alias("label"))
    edges = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    degree = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n_links")).withColumnRenamed("a", "node")
    nodes = cut(edges.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("label")))
    while True:
        near = edges.join(nodes.toDF("b", "near"), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        stepped = nodes.join(near, "node", "left").select("node", F.least("label", F.coalesce("near", "label")).alias("next"), "label")
        jumped = stepped.join(stepped.select(F.col("node").alias("next"), F.col("next").alias("far")), "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("new"), "label")
        jumped = cut(jumped)
        moved = jumped.where("new <> label").limit(1).count()
        nodes = jumped.select("node", F.col("new").alias("label"))
        if not moved:
            break
    rooted = nodes.toDF("node", "root").join(least, "node")
    roots = rooted.groupBy("root").agg(F.min("label").alias("class_id"))
    grouped = nodes.toDF("node", "root").join(roots, "root").select("node", "class_id").join(degree, "node")
    return (
        members.select("rec", "node")
        .join(grouped, "node", "left")
        .join(least, "node")
        .select("rec", F.coalesce("class_id", "label").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    )
