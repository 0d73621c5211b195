"""Hybrid recall for a set of queries: candidates, ranks, fused score.

Candidates are sets of queries per atom (:mod:`frontier`), so a query that
reaches nearly every atom costs a bit an atom and no row. What a rank depends on
is computed task by task over those sets; only the heads of each order are
gathered, and counted against all candidates in a second pass. A bound tells
whether any other candidate could still be among the best; if so, longer heads
are taken, and in the end every candidate is ranked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators import frontier, kg, lifecycle, whole
from palimpsest.operators.frontier import BOOTSTRAP_COSINE, BOOTSTRAP_HITS, Block, Expansion, names, unpacked
from palimpsest.operators.skew import range_laid, running, running_total
from palimpsest.operators.vectors import matrix, query_blocks, similarity_matrix, topk_per_epoch
from palimpsest.schema import ACTIVE_EPOCH
from palimpsest.session import broadcast_if_small, cut, shuffle_width

#: Candidates per source for each wanted result.
OVERFETCH = 10
#: Queries that share one plan.
BLOCK = 256
#: Heads of each order that are counted beyond twice the wanted results; how often they are lengthened, and by what factor.
HEADS, LENGTHENED, LONGER = 64, 2, 8
#: A larger top_k is ranked in full.
MOST_HEADS = 1_000
#: Fixed values of the score: rank offset, weights, topic boost, penalties.
RANK_OFFSET, SEMANTIC_WEIGHT, TOPIC_BOOST, SUPERSEDED_FACTOR, NOISE_FACTOR = 60, 2, 20.0, 1e-4, 1e-7
#: Candidate rows of one step of a task.
STEP_CELLS = 1 << 19


def prepared(queries: DataFrame) -> DataFrame:
    """Queries with defaults: no entities is an empty list, top_k 5, one hop; null entities are left out."""
    return queries.select(
        "query_id",
        "query_emb",
        F.coalesce("top_k", F.lit(5)).alias("top_k"),
        F.coalesce("expand_hops", F.lit(1)).alias("hops"),
        F.coalesce(F.array_distinct(F.filter("query_entities", lambda e: e.isNotNull())), F.array().cast("array<string>")).alias("qe"),
        (F.coalesce("top_k", F.lit(5)) * OVERFETCH).cast("int").alias("pool"),
    ).withColumn("low", F.transform("qe", F.lower))


def vector_pool(atoms: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, atom_id, epoch_id, sim, epoch_rank``: over-fetched nearest atoms of every epoch, the active one included."""
    return topk_per_epoch(atoms, queries)


def bootstrapped(pool: DataFrame, queries: DataFrame, atom_entities: DataFrame) -> DataFrame:
    """``query_id, entity``: subjects and objects of the best active hits, for queries that name no entity."""
    bare = queries.where(F.size("qe") == 0).select("query_id")
    best = pool.where((F.col("epoch_id") == ACTIVE_EPOCH) & (F.col("epoch_rank") <= BOOTSTRAP_HITS) & (F.col("sim") > BOOTSTRAP_COSINE))
    return best.join(bare, "query_id", "left_semi").join(atom_entities, "atom_id").select("query_id", "entity").distinct()


def seeds(known: DataFrame, index: DataFrame) -> DataFrame:
    """``query_id, atom_id``: atoms indexed under an entity the query knows.

    Of the entities that lead a query to one atom the least yields the pair, so
    pairs, which number queries times atoms, are not shuffled to be made distinct.
    """
    named = known.groupBy("query_id").agg(F.collect_set("entity").alias("_named"))
    asking = cut(named.select("query_id", "_named", F.explode("_named").alias("entity")))
    index = kg.pairs(index.join(asking.select("entity").distinct(), "entity", "left_semi"))
    under = index.repartition(4 * shuffle_width(index.sparkSession), "atom_id").groupBy("atom_id").agg(F.collect_set("entity").alias("_under"))
    pairs = under.select("atom_id", "_under", F.explode("_under").alias("entity")).join(broadcast_if_small(asking), "entity")
    return pairs.where(F.col("entity") == F.array_min(F.array_intersect("_named", "_under"))).select("query_id", "atom_id")


def expansions(atoms: DataFrame, index: DataFrame, queries: DataFrame, max_hops: int | None = None) -> Iterator[Expansion]:
    """Candidates of :func:`prepared` queries, a block of queries at a time.

    A hop goes from the subjects and objects of the atoms found last to every
    atom indexed under them; atoms found before are taken out.
    """
    base = None
    for rows in query_blocks(queries, BLOCK):
        if not rows:
            continue
        base = frontier.base_rows(atoms) if base is None else base
        yield frontier.expand(atoms, base, index, Block(rows), max_hops)


def _united(parts: list[DataFrame], like: DataFrame, shape: str) -> DataFrame:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return like.sparkSession.createDataFrame([], shape) if out is None else out


def hops(atoms: DataFrame, index: DataFrame, queries: DataFrame, max_hops: int | None = None) -> DataFrame:
    """``query_id, atom_id, hop`` of all candidates; query by query where a worker can hold the store."""
    path, queries = whole.lay_out(atoms, index, queries)
    if path:
        return whole.hops(path, queries, max_hops)
    return _united([frontier.hops_of(e) for e in expansions(atoms, index, queries, max_hops)], atoms, "query_id string, atom_id string, hop long")


def known(atoms: DataFrame, index: DataFrame, queries: DataFrame, max_hops: int | None = None) -> DataFrame:
    """``query_id, entity``: everything each query came to know."""
    return _united([frontier.known_of(e) for e in expansions(atoms, index, queries, max_hops)], atoms, "query_id string, entity string")


def payload_dedup(rows: DataFrame) -> DataFrame:
    """One candidate per query and payload: the first found. Ties of a stage go by similarity, recency, id."""
    seq = F.struct("stage", (-F.col("sim")).alias("_far"), (-F.unix_micros("created_at")).alias("_age"), "atom_id")
    kept = [c for c in rows.columns if c != "query_id"]
    first = rows.groupBy("query_id", F.md5(F.coalesce("payload", F.lit("None")))).agg(F.min_by(F.struct(*kept), seq).alias("_v"))
    return first.select("query_id", *[F.col(f"_v.{c}").alias(c) for c in kept])


def topic_locked(triples: Column, qe: Column) -> Column:
    """Whether a triple matches an original query entity.

    ``qe`` holds structs of ``low`` (lower case) and ``broad``. A predicate matches
    whole, as a superstring, or through the first four letters; subjects and
    objects match whole, unless the entity is broad.
    """

    def match(t: Column, e: Column) -> Column:
        pred, low = F.lower(t["pred"]), e["low"]
        ends = (F.lower(t["subj"]) == low) | (F.lower(t["obj"]) == low)
        root = (F.length(low) >= 4) & F.contains(pred, F.substring(low, 1, 4))
        return F.coalesce(F.contains(pred, low), F.lit(False)) | F.coalesce(ends & ~e["broad"], F.lit(False)) | F.coalesce(root, F.lit(False))

    return F.exists(qe, lambda e: F.exists(triples, lambda t: match(t, e)))


@dataclass
class Topics:
    """The queries' entities in lower case, each with the queries that name it, and those for which it is not broad."""

    named: dict[str, np.ndarray]
    narrow: dict[str, np.ndarray]
    none: np.ndarray

    def of_predicate(self, pred: str) -> np.ndarray:
        out = self.none.copy()
        for low, queries in self.named.items():
            if low in pred or (len(low) >= 4 and low[:4] in pred):
                out |= queries
        return out

    def of_end(self, end: str) -> np.ndarray:
        return self.narrow.get(end, self.none)


def _topics(index: DataFrame, block: Block) -> Topics:
    """The topics of a block; how broad an entity is, is counted in the index for the block's entities only."""
    asked = {q for r in block.rows for q in r["qe"]}
    wanted = F.broadcast(index.sparkSession.createDataFrame([(q,) for q in asked], "entity string"))
    degrees = {r["entity"]: r["degree"] for r in kg.entity_degree(index.join(wanted, "entity", "left_semi")).collect()} if asked else {}
    none = np.zeros(len(block.rows), bool)
    named: dict[str, np.ndarray] = {}
    narrow: dict[str, np.ndarray] = {}
    for no, r in enumerate(block.rows):
        for entity, low in zip(r["qe"], r["low"]):
            named.setdefault(low, none.copy())[no] = True
            if degrees.get(entity, 0) <= kg.BROAD_DEGREE:
                narrow.setdefault(low, none.copy())[no] = True
    return Topics(named, narrow, none)


@dataclass
class Held:
    """Candidates of a block with all that ranks depend on, one row an atom; and which queries know an entity."""

    rows: DataFrame
    block: Block
    topics: Topics
    stages: list[str]
    knows: np.ndarray


def _stage_and_sim(b: pa.RecordBatch, block: Block, stages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Stage (255: no candidate) and similarity of every atom for every query."""
    n = len(block.rows)
    stage = np.full((b.num_rows, n), 255, np.uint8)
    for k in range(len(stages) - 1, -1, -1):
        stage[unpacked(b, names(stages[k], block.words), n)] = k
    sim = np.zeros((b.num_rows, n))
    for at, mat in block.groups:
        rows, x = matrix(b.column("embedding"), mat.shape[1])
        sim[np.ix_(rows, at)] = similarity_matrix(mat, x).T
    return stage, sim


def _steps(batches: Iterator[pa.RecordBatch], block: Block) -> Iterator[pa.RecordBatch]:
    step = max(64, STEP_CELLS // max(1, len(block.rows)))
    for b in batches:
        for lo in range(0, b.num_rows, step):
            yield b.slice(lo, step)


def _first_copies(block: Block, stages: list[str]):
    """Arrow function: of a task's atoms, the first found of every query and payload."""

    def run(batches):
        for b in _steps(batches, block):
            stage, sim = _stage_and_sim(b, block, stages)
            row, no = np.nonzero(stage < 255)
            code = np.asarray(b.column("digest").dictionary_encode().indices)[row]
            ids = b.column("atom_id").to_numpy(zero_copy_only=False)
            rank = np.empty(len(ids), np.int64)
            rank[np.argsort(ids)] = np.arange(len(ids))
            age = -np.asarray(b.column("created_us"))
            order = np.lexsort((rank[row], age[row], -sim[row, no], stage[row, no], code, no))
            lead = order[np.r_[True, (np.diff(no[order]) != 0) | (np.diff(code[order]) != 0)]] if len(order) else order
            r, q = pa.array(row[lead]), no[lead]
            yield pa.RecordBatch.from_arrays(
                [pa.array(q.astype(np.int32)), b.column("digest").take(r), pa.array(stage[row[lead], q].astype(np.int32)), pa.array(-sim[row[lead], q]), pa.array(age[row[lead]]), b.column("atom_id").take(r)],
                names=["no", "digest", "stage", "far", "age", "atom_id"],
            )

    return run


def held(atoms: DataFrame, index: DataFrame, found: Expansion) -> Held:
    """Candidates of a block after payloads were made distinct, with overlap, topic words and supersession.

    Of the candidates of a query that share a payload the first found stands;
    only atoms whose payload is repeated are compared. Which (subject, predicate)
    a newer candidate owns is a running ``bit_or`` from the newest statement on.
    """
    block, w = found.block, found.block.words
    n = len(block.rows)
    sets = [c for s in found.stages for c in names(s, w)]
    live, e, old = names("live", w), names("e", w), names("old", w)
    state = found.state.where(frontier.any_bit(sets))
    info = atoms.select(F.col("id").alias("atom_id"), F.md5(F.coalesce("payload", F.lit("None"))).alias("digest"), "embedding", "triples")
    # payloads that more than one candidate atom has
    seen = state.select("atom_id").join(info.select("atom_id", "digest"), "atom_id")
    several = seen.groupBy("digest").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("digest")
    copies = state.join(info.select("atom_id", "digest", "embedding").join(several, "digest", "left_semi"), "atom_id").select("atom_id", "digest", "created_us", "embedding", *sets)
    first = copies.mapInArrow(_first_copies(block, found.stages), "no int, digest string, stage int, far double, age long, atom_id string")
    first = first.groupBy("no", "digest").agg(F.min(F.struct("stage", "far", "age", "atom_id")).alias("v")).select("no", F.col("v.atom_id").alias("atom_id"))
    first = cut(first.groupBy("atom_id").agg(*frontier.folded("live", w)))
    every = [c for i in range(w) for c in [_or([f"{s}_{i}" for s in found.stages]).alias(f"all_{i}")]]
    narrow = state.select("atom_id", "created_us", "place", "ents", *sets, *every).join(info.select("atom_id", "digest"), "atom_id")
    narrow = narrow.join(several.withColumn("_again", F.lit(True)), "digest", "left").join(first, "atom_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    narrow = cut(narrow.select("atom_id", "created_us", "place", "ents", *sets, *[F.when(F.col("_again"), zero(F.col(x))).otherwise(F.col(f"all_{i}")).alias(x) for i, x in enumerate(live)]).where(frontier.any_bit(live)))
    # statements of candidates, newest first: what a newer one owned before is superseded
    said = narrow.select("atom_id", "place", *live).join(atoms.select(F.col("id").alias("atom_id"), F.explode("triples").alias("t")), "atom_id")
    said = said.where(F.col("t.subj").isNotNull() & F.col("t.pred").isNotNull()).select("atom_id", "place", F.lower("t.subj").alias("_s"), F.lower("t.pred").alias("_p"), *live).distinct()
    order = [F.col("place").asc()]
    newer = running(range_laid(said, ["_s", "_p"], order), ["_s", "_p"], order, {o: F.col(x) for o, x in zip(old, live)}, F.bit_or, own=False)
    newer = newer.groupBy("atom_id").agg(*frontier.united(old, old))
    overlap = narrow.select("atom_id", F.explode("ents").alias("entity")).join(found.known, "entity").groupBy("atom_id").agg(*[F.collect_list(c).alias(c) for c in e])
    words = atoms.select(
        F.col("id").alias("atom_id"), "embedding",
        F.expr("array_distinct(transform(triples, t -> lower(t.pred)))").alias("preds"),
        F.expr("array_distinct(flatten(transform(triples, t -> array(lower(t.subj), lower(t.obj)))))").alias("ends"),
    )
    rows = narrow.drop("ents").join(words, "atom_id").join(newer, "atom_id", "left").join(overlap, "atom_id", "left")
    knows = found.known.agg(*frontier.united(e, e)).toArrow().to_batches()
    knows = unpacked(knows[0], e, n)[0] if knows else np.zeros(n, bool)
    return Held(cut(rows), block, _topics(index, block), found.stages, knows)


def _or(cols: list[str]) -> Column:
    out = F.col(cols[0])
    for c in cols[1:]:
        out = out.bitwiseOR(F.col(c))
    return out


class Features:
    """A step's candidates, one entry per atom and query."""

    def __init__(self, b: pa.RecordBatch, kept: tuple[Block, Topics, list[str]], memo: dict, wanted: np.ndarray | None = None):
        block, topics, stages = kept
        n, w = len(block.rows), block.words
        alive = unpacked(b, names("live", w), n)
        if wanted is not None:
            alive &= wanted[None, :]
        self.row, self.no = np.nonzero(alive)
        at = (self.row, self.no)
        stage, sim = _stage_and_sim(b, block, stages)
        self.stage, self.sim = stage[at].astype(np.int32), sim[at]
        self.old = unpacked(b, names("old", w), n)[at]
        self.place = np.asarray(b.column("place"))[self.row]
        self.created = np.asarray(b.column("created_us"))[self.row]
        self.overlap = self._counts(b, w, n)[at]
        self.boost = (self._topics(b.column("preds"), topics.of_predicate, memo, "p", n) | self._topics(b.column("ends"), topics.of_end, memo, "e", n))[at]
        self.kind = np.where(self.boost, 0, 1) + np.where(self.old, 2, 0)

    @staticmethod
    def _counts(b: pa.RecordBatch, w: int, n: int) -> np.ndarray:
        lists = [b.column(c) for c in names("e", w)]
        owner = np.repeat(np.arange(b.num_rows), np.asarray(lists[0].value_lengths().fill_null(0)))
        out = np.zeros((b.num_rows, n), np.int32)
        if len(owner):
            flat = pa.RecordBatch.from_arrays([x.flatten() for x in lists], names=names("e", w))
            begin = np.flatnonzero(np.r_[True, np.diff(owner) != 0])
            out[owner[begin]] = np.add.reduceat(unpacked(flat, names("e", w), n).astype(np.int32), begin, axis=0)
        return out

    @staticmethod
    def _topics(column: pa.Array, match, memo: dict, kind: str, n: int) -> np.ndarray:
        owner = np.repeat(np.arange(len(column)), np.asarray(column.value_lengths().fill_null(0)))
        out = np.zeros((len(column), n), bool)
        coded = column.flatten().dictionary_encode()
        known = []
        for x in coded.dictionary.to_pylist():
            if (kind, x) not in memo:
                if len(memo) > 100_000:
                    memo.clear()
                memo[kind, x] = match(x)
            known.append(memo[kind, x])
        code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        good = np.flatnonzero(code >= 0)
        if len(good):
            table = np.stack(known)
            begin = np.flatnonzero(np.r_[True, np.diff(owner[good]) != 0])
            out[owner[good][begin]] = np.logical_or.reduceat(table[code[good]], begin, axis=0)
        return out


def _orders(f, group: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Sort keys (last is first) of the semantic, recency and entity order. At one instant ids ascend in the first, descend in the others."""
    return [(-f.place, -f.created, f.stage, -f.sim, group), (f.place, group), (f.place, -f.overlap, group)]


def _within(order: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Rank of each entry within its group, given the order."""
    g = group[order]
    start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.empty(0, np.int64)
    rank = np.empty(len(g), np.int64)
    rank[order] = np.arange(len(g)) - np.repeat(start, np.diff(np.r_[start, len(g)]))
    return rank


_FIELDS = ["no", "kind", "stage", "created", "place", "overlap", "sim"]
_SHAPE = "no long, kind long, stage long, created long, place long, overlap long, sim double"


def _heads(h: Held, most: int, wanted: np.ndarray) -> DataFrame:
    """The first ``most`` candidates of every query and kind in each of the three orders, with their rank in that kind."""
    kept = h.rows.sparkSession.sparkContext.broadcast((h.block, h.topics, h.stages))

    def run(batches):
        memo: dict = {}
        for b in _steps(batches, kept.value[0]):
            f = Features(b, kept.value, memo, wanted)
            group = f.no * 4 + f.kind
            keep = np.zeros(len(group), bool)
            for keys in _orders(f, group):
                keep |= _within(np.lexsort(keys), group) < most
            yield pa.RecordBatch.from_arrays([b.column("atom_id").take(pa.array(f.row[keep])), *[pa.array(np.asarray(getattr(f, c)[keep], np.float64 if c == "sim" else np.int64)) for c in _FIELDS]], names=["atom_id", *_FIELDS])

    rows = h.rows.mapInArrow(run, f"atom_id string, {_SHAPE}")
    by = Window.partitionBy("no", "kind")
    semantic = by.orderBy(F.col("sim").desc(), "stage", F.col("created").desc(), F.col("place").desc())
    rows = rows.withColumn("in_semantic", F.row_number().over(semantic)).withColumn("in_recency", F.row_number().over(by.orderBy("place"))).withColumn("in_entity", F.row_number().over(by.orderBy(F.col("overlap").desc(), "place")))
    return cut(rows.where((F.col("in_semantic") <= most) | (F.col("in_recency") <= most) | (F.col("in_entity") <= most)))


def _counted(h: Held, heads: DataFrame, wanted: np.ndarray) -> DataFrame:
    """``no, place`` of the heads with the number of candidates that stand before them in each order."""

    class Both:
        pass

    got = heads.select(*_FIELDS).toArrow()  # bounded: heads of a block
    kept = h.rows.sparkSession.sparkContext.broadcast(((h.block, h.topics, h.stages), {c: np.asarray(got.column(c).combine_chunks()) for c in _FIELDS}))

    def run(batches):
        setting, head = kept.value
        memo: dict = {}
        m = len(head["no"])
        total = np.zeros((3, m), np.int64)
        for b in _steps(batches, setting[0]):
            f = Features(b, setting, memo, wanted)
            both = Both()
            for c in _FIELDS:
                setattr(both, c, np.concatenate([head[c], getattr(f, c)]))
            is_head = np.arange(len(both.no)) < m
            for k, keys in enumerate(_orders(both, both.no)):
                order = np.lexsort((~is_head, *keys))  # a head stands before itself as a candidate
                ahead = np.cumsum(~is_head[order])
                group = both.no[order]
                start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
                base = np.repeat(np.r_[0, ahead[start[1:] - 1]], np.diff(np.r_[start, len(group)]))
                mine = is_head[order]
                total[k, order[mine]] += (ahead - base)[mine]
        yield pa.RecordBatch.from_arrays([pa.array(head["no"]), pa.array(head["place"]), *[pa.array(t) for t in total]], names=["no", "place", "semantic_rank", "recency_rank", "entity_rank"])

    rows = h.rows.mapInArrow(run, "no long, place long, semantic_rank long, recency_rank long, entity_rank long")
    return rows.groupBy("no", "place").agg(*[F.sum(c).alias(c) for c in ("semantic_rank", "recency_rank", "entity_rank")])


def _rrf(semantic: Column, recency: Column, entity: Column) -> Column:
    return F.lit(float(SEMANTIC_WEIGHT)) / (semantic + RANK_OFFSET) + F.lit(1.0) / (recency + RANK_OFFSET) + F.lit(1.0) / (entity + RANK_OFFSET)


def _score(rrf: Column, boosted: Column, old: Column, signal: Column) -> Column:
    raw = (rrf + F.when(boosted, F.lit(TOPIC_BOOST)).otherwise(F.lit(0.0))) * F.when(old, F.lit(SUPERSEDED_FACTOR)).otherwise(F.lit(1.0))
    return F.when(signal & (raw < TOPIC_BOOST), raw * NOISE_FACTOR).otherwise(raw)


def _placed(rows: DataFrame, block: Block, knows: np.ndarray, extra: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Heads with score and position; and the block's queries with ``knows`` and ``top_k``."""
    spark = rows.sparkSession
    about = F.broadcast(spark.createDataFrame([(i, r["query_id"], int(r["top_k"]), bool(knows[i])) for i, r in enumerate(block.rows)], "no long, query_id string, top_k long, _knows boolean"))
    rows = rows.join(about, "no")
    rows = rows.withColumn("entity_rank", F.when(F.col("_knows"), F.col("entity_rank")).otherwise(F.lit(0)))
    rows = rows.withColumn("rrf", _rrf(F.col("semantic_rank"), F.col("recency_rank"), F.col("entity_rank")))
    signal = F.min("kind").over(Window.partitionBy("no")) == 0
    rows = rows.withColumn("_signal", signal).withColumn("score", _score(F.col("rrf"), F.col("kind").isin(0, 2), F.col("kind") >= 2, F.col("_signal")))
    final = Window.partitionBy("no").orderBy(F.round("score", 15).desc(), F.when(F.col("_knows"), F.col("overlap")).otherwise(F.lit(0)).desc(), "place")
    return rows.withColumn("position", F.row_number().over(final)).select("*", *extra), about


def _best_of(h: Held, most: int, wanted: np.ndarray) -> tuple[DataFrame, list[int]]:
    """The top of every wanted query by its heads, and the queries for which a candidate beyond the heads might be among the best."""
    heads = _heads(h, most, wanted)
    rows, _ = _placed(heads.join(_counted(h, heads, wanted), ["no", "place"]), h.block, h.knows, [])
    rows = cut(rows)
    # beyond the last head of an order every rank is greater
    last = lambda place, rank: F.max(F.when(F.col(place) == most, F.col(rank)))
    edge = rows.groupBy("no", "kind").agg(last("in_semantic", "semantic_rank").alias("s"), last("in_recency", "recency_rank").alias("r"), last("in_entity", "entity_rank").alias("e"), F.first("_signal").alias("_signal"), F.first("_knows").alias("_knows"))
    edge = edge.where(F.col("s").isNotNull())
    bound = _score(_rrf(F.col("s") + 1, F.col("r") + 1, F.when(F.col("_knows"), F.col("e") + 1).otherwise(F.lit(0))), F.col("kind").isin(0, 2), F.col("kind") >= 2, F.col("_signal"))
    edge = edge.groupBy("no").agg(F.max(F.round(bound, 15)).alias("bound"))
    kth = rows.where("position = top_k").select("no", F.round("score", 15).alias("kth"))
    doubt = edge.join(kth, "no", "left").where(F.col("kth").isNull() | (F.col("bound") >= F.col("kth")))
    return rows.where("position <= top_k").select("no", "query_id", "position", "atom_id", "score"), [r["no"] for r in doubt.select("no").collect()]


def candidate_rows(h: Held, wanted: np.ndarray | None = None) -> DataFrame:
    """Every candidate as a row: ``no, kind, stage, created, place, overlap, sim, atom_id``."""
    kept = h.rows.sparkSession.sparkContext.broadcast((h.block, h.topics, h.stages))

    def run(batches):
        memo: dict = {}
        for b in _steps(batches, kept.value[0]):
            f = Features(b, kept.value, memo, wanted)
            yield pa.RecordBatch.from_arrays([b.column("atom_id").take(pa.array(f.row)), *[pa.array(np.asarray(getattr(f, c), np.float64 if c == "sim" else np.int64)) for c in _FIELDS]], names=["atom_id", *_FIELDS])

    return h.rows.mapInArrow(run, f"atom_id string, {_SHAPE}")


def ranked_rows(h: Held, wanted: np.ndarray | None = None) -> DataFrame:
    """Every candidate with its ranks, score and position; a query's candidates are spread over all tasks."""
    rows = candidate_rows(h, wanted)
    for out, order in (
        ("semantic_rank", [F.col("sim").desc(), F.col("stage").asc(), F.col("created").desc(), F.col("place").desc()]),
        ("recency_rank", [F.col("place").asc()]),
        ("entity_rank", [F.col("overlap").desc(), F.col("place").asc()]),
    ):
        rows = running_total(range_laid(rows, ["no"], order), ["no"], order, F.lit(1).cast("long"), out).withColumn(out, F.col(out) - 1).drop("_part")
    about = [(i, r["query_id"], int(r["top_k"]), bool(h.knows[i])) for i, r in enumerate(h.block.rows)]
    rows = cut(rows.join(F.broadcast(rows.sparkSession.createDataFrame(about, "no long, query_id string, top_k long, _knows boolean")), "no"))
    signal = rows.groupBy("no").agg((F.min("kind") == 0).alias("_signal"))
    rows = rows.join(F.broadcast(signal), "no")  # one row a query of the block
    rows = rows.withColumn("entity_rank", F.when(F.col("_knows"), F.col("entity_rank")).otherwise(F.lit(0)))
    rows = rows.withColumn("rrf", _rrf(F.col("semantic_rank"), F.col("recency_rank"), F.col("entity_rank")))
    rows = rows.withColumn("score", _score(F.col("rrf"), F.col("kind").isin(0, 2), F.col("kind") >= 2, F.col("_signal")))
    rows = rows.withColumn("_s", F.round("score", 15)).withColumn("_o", F.when(F.col("_knows"), F.col("overlap")).otherwise(F.lit(0)))
    order = [F.col("_s").desc(), F.col("_o").desc(), F.col("place").asc()]
    return running_total(range_laid(rows, ["no"], order), ["no"], order, F.lit(1).cast("long"), "position").drop("_part", "_s", "_o")


_COLUMNS = ["sim", "overlap", "semantic_rank", "recency_rank", "entity_rank", "boost", "is_superseded", "rrf", "score", "position"]


def _scores(semantic: np.ndarray, recency: np.ndarray, entity: np.ndarray, boosted: np.ndarray, old: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`_rrf` and :func:`_score` of all candidates of one query."""
    rrf = float(SEMANTIC_WEIGHT) / (semantic + RANK_OFFSET) + 1.0 / (recency + RANK_OFFSET) + 1.0 / (entity + RANK_OFFSET)
    raw = (rrf + np.where(boosted, TOPIC_BOOST, 0.0)) * np.where(old, SUPERSEDED_FACTOR, 1.0)
    return rrf, np.where((boosted & ~old).any() & (raw < TOPIC_BOOST), raw * NOISE_FACTOR, raw)


def ranked(atoms: DataFrame, index: DataFrame, queries: DataFrame, max_hops: int | None = None, columns: list[str] = _COLUMNS) -> DataFrame:
    """Candidates with their ranks and score: the full table from which a result is cut.

    Columns: query_id, atom_id, and of sim, overlap, semantic_rank, recency_rank,
    entity_rank, boost, is_superseded, rrf, score, position those asked for. Rows
    come query by query out of the tasks; only a store that a worker can't hold
    has its candidates laid out and sorted.
    """
    path, queries = whole.lay_out(atoms, index, queries)
    if path:
        return whole.ranked(path, queries, _scores, TOPIC_BOOST, columns, max_hops)
    parts = []
    for found in expansions(atoms, index, queries, max_hops):
        rows = ranked_rows(held(atoms, index, found))
        rows = rows.withColumn("boost", F.when(F.col("kind").isin(0, 2), F.lit(TOPIC_BOOST)).otherwise(F.lit(0.0))).withColumn("is_superseded", F.col("kind") >= 2)
        parts.append(rows.select("query_id", "atom_id", *columns))
    return _united(parts, atoms, ", ".join(["query_id string", "atom_id string", *[f"{c} {whole._TYPES[c]}" for c in columns]]))


def _best(h: Held) -> DataFrame:
    """The top of every query of a block: ``no, query_id, position, atom_id, score``."""
    size = max(int(r["top_k"]) for r in h.block.rows)
    wanted, parts = np.ones(len(h.block.rows), bool), []
    most = HEADS + 2 * size
    for _ in range(LENGTHENED if size <= MOST_HEADS else 0):
        rows, doubt = _best_of(h, most, wanted)
        parts.append(rows.where(~F.col("no").isin(doubt)) if doubt else rows)
        wanted = np.isin(np.arange(len(wanted)), doubt)
        if not doubt:
            break
        most *= LONGER
    if wanted.any() and (size > MOST_HEADS or doubt):
        parts.append(ranked_rows(h, wanted).where("position <= top_k").select("no", "query_id", "position", "atom_id", "score"))
    return _united(parts, h.rows, "no long, query_id string, position int, atom_id string, score double")


def recall(atoms: DataFrame, index: DataFrame, queries: DataFrame, deltas: DataFrame | None = None, max_hops: int | None = None) -> DataFrame:
    """``query_id, position, atom_id, score, access_count``: the top_k of every query, with the access count after this access.

    Pure: the accesses themselves are given by :func:`access_bumps`.
    """
    parts = [_best(held(atoms, index, found)) for found in expansions(atoms, index, prepared(queries), max_hops)]
    top = _united([p.drop("no") for p in parts], atoms, "query_id string, position int, atom_id string, score double")
    counted = lifecycle.with_deltas(atoms, deltas) if deltas is not None else atoms
    counts = counted.select(F.col("id").alias("atom_id"), (F.coalesce("access_count", F.lit(0)) + 1).alias("access_count"))
    return top.join(counts, "atom_id").select("query_id", "position", "atom_id", "score", "access_count")


def access_bumps(results: DataFrame) -> DataFrame:
    """``atom_id, delta``: one access per returned row, summed per atom."""
    return results.groupBy("atom_id").agg(F.count(F.lit(1)).alias("delta"))
