"""Approximate vector search: a hierarchical k-means tree, searched best bin first, as a stored index.

The tree is fitted on a bounded sample; every vector is put into the leaf its
descent ends in, and the index keeps the vectors by epoch, ordered by leaf, so
that a search reads the row groups of the leaves it visits. A priority queue over
tree nodes, keyed by how far a node falls behind its siblings, yields leaves until
the key exceeds a limit; the limit is the least at which the recall measured
against exact search reaches what was asked for. Similarities are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.operators import vectors
from palimpsest.session import shuffle_width

#: Most vectors the tree is fitted on, most queries its widening is calibrated with.
FIT_ROWS, CALIBRATION_ROWS = 40_000, 1_024
#: Children of a tree node, aimed-at rows of a leaf and of a cell, sampled vectors that a leaf keeps at least.
BRANCH, LEAF_ROWS, CELL_ROWS, LEAF_SAMPLE = 16, 256, 16_384, 12
#: Most rows of an epoch that a search works off at once; a larger epoch is worked off in pieces, spread over tasks.
PIECE_ROWS = 1 << 17


@dataclass
class Tree:
    """Node centres and children; leaves are numbered in tree order, so that a subtree is a range of leaves."""

    centre: np.ndarray
    first_child: np.ndarray
    n_children: np.ndarray
    leaf: np.ndarray
    cell_of_leaf: np.ndarray
    roots: int = 1
    _kids: np.ndarray = field(default=None, repr=False)

    @property
    def leaves(self) -> int:
        return len(self.cell_of_leaf)

    def kids(self) -> np.ndarray:
        if self._kids is None:
            k = self.first_child[:, None] + np.arange(BRANCH)[None, :]
            self._kids = np.where(np.arange(BRANCH)[None, :] < self.n_children[:, None], k, -1)
        return self._kids

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: from the root to the most similar child, down to a leaf."""
        node = np.zeros(len(x), np.int64)
        scores = x @ self.centre.T
        while True:
            inner = np.flatnonzero(self.leaf[node] < 0)
            if not len(inner):
                return self.leaf[node]
            kids = self.kids()[node[inner]]
            s = np.where(kids >= 0, scores[inner[:, None], np.maximum(kids, 0)], -np.inf)
            node[inner] = kids[np.arange(len(inner)), s.argmax(1)]

    def visits(self, x: np.ndarray, widen: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves visited, best bin first.

        A bin's key is the greatest amount by which it, or a node above it, falls
        behind its most similar sibling. The queue yields bins in the order of
        their keys; a row is done when the next key exceeds ``widen``.
        """
        scores = x @ self.centre.T
        queue = np.full(scores.shape, np.inf, np.float32)
        queue[:, 0] = 0
        live = np.arange(len(x))
        rows, leaves = [], []
        while len(live):
            top = queue[live].argmin(1)
            key = queue[live, top]
            go_on = (key <= widen) & np.isfinite(key)  # an exhausted queue yields no bin
            live, top, key = live[go_on], top[go_on], key[go_on]
            queue[live, top] = np.inf
            is_leaf = self.leaf[top] >= 0
            rows.append(live[is_leaf])
            leaves.append(self.leaf[top[is_leaf]])
            inner = live[~is_leaf]
            if len(inner):
                kids = self.kids()[top[~is_leaf]]
                s = np.where(kids >= 0, scores[inner[:, None], np.maximum(kids, 0)], -np.inf)
                keys = np.maximum(key[~is_leaf][:, None], s.max(1, keepdims=True) - s)
                r, c = np.nonzero(kids >= 0)
                queue[inner[r], kids[r, c]] = keys[r, c]
        return np.concatenate(rows), np.concatenate(leaves)

    def keys(self, x: np.ndarray) -> np.ndarray:
        """The key of every leaf for every row: what the queue would have to be widened to."""
        scores = x @ self.centre.T
        key = np.zeros(scores.shape, np.float32)
        for n in np.flatnonzero(self.n_children):
            kids = slice(self.first_child[n], self.first_child[n] + self.n_children[n])
            key[:, kids] = np.maximum(key[:, n : n + 1], scores[:, kids].max(1, keepdims=True) - scores[:, kids])
        leaf = np.flatnonzero(self.leaf >= 0)
        out = np.empty((len(x), self.leaves), np.float32)
        out[:, self.leaf[leaf]] = key[:, leaf]
        return out


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        a = (x @ c.T).argmax(1)
        s = np.zeros_like(c)
        np.add.at(s, a, x)
        n = np.linalg.norm(s, axis=1, keepdims=True)
        c = np.where(n > 1e-12, s / np.maximum(n, 1e-12), c).astype(np.float32)
    return c, (x @ c.T).argmax(1)


def fit_tree(sample: np.ndarray, rows: int, leaf_rows: int = LEAF_ROWS, cell_rows: int = CELL_ROWS, seed: int = 7) -> Tree:
    """A tree over unit vectors; ``rows`` is the size of the whole collection the sample stands for."""
    rng = np.random.default_rng(seed)
    share = max(1.0, rows / max(1, len(sample)))
    dim = sample.shape[1] if sample.ndim == 2 else 1
    centre, first, count, leaf, members, cell = [np.zeros(dim, np.float32)], [0], [0], [-1], [np.arange(len(sample))], [-1]
    at = 0
    while at < len(centre):
        m = members[at]
        size = len(m) * share
        if size > leaf_rows and len(m) >= 2 * LEAF_SAMPLE:
            k = int(min(BRANCH, max(2, len(m) // LEAF_SAMPLE), max(2, np.ceil(size / leaf_rows))))
            c, a = _kmeans(sample[m], k, rng)
            used = np.unique(a)
            if len(used) > 1:
                first[at], count[at] = len(centre), len(used)
                for u in used:
                    centre.append(c[u])
                    first.append(0), count.append(0), leaf.append(-1), members.append(m[a == u])
                    cell.append(at if cell[at] < 0 and size <= cell_rows else cell[at])
        at += 1
    order, stack = [], [0]
    while stack:
        n = stack.pop()
        if count[n]:
            stack.extend(range(first[n] + count[n] - 1, first[n] - 1, -1))
        else:
            leaf[n] = len(order)
            order.append(cell[n] if cell[n] >= 0 else n)
    _, cells = np.unique(order, return_inverse=True)
    return Tree(np.array(centre, np.float32), np.array(first), np.array(count), np.array(leaf), cells.astype(np.int64))


def unit_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and unit vectors of the usable entries: ``dim`` finite values, not all zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
    starts = np.asarray(column.offsets)[:-1].astype(np.int64)
    rows = np.flatnonzero(lengths == dim)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    x = values[starts[rows][:, None] + np.arange(dim)[None, :]] if len(rows) else np.empty((0, dim))
    norm = np.sqrt((x * x).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    return rows[good], (x[good] / norm[good][:, None]).astype(np.float32)


def calibrate(tree: Tree, q: np.ndarray, rows: np.ndarray, found: np.ndarray, recall: float) -> float:
    """The least widening at which the queries ``q[rows]`` visit the leaves of their true neighbours ``found`` with the asked recall; all leaves without any."""
    if not len(rows) or tree.leaves <= 1:
        return float("inf")
    need = np.sort(tree.keys(q)[rows, tree.assign(found)])
    return float(need[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)]) + 1e-6


_INDEX = "id string, epoch_id string, leaf int, embedding array<float>"


def _sampled(rows: DataFrame, most: int, total: int, seed: int) -> DataFrame:
    """About ``most`` rows, chosen by a hash of their id."""
    share = int(min(1.0, most / max(1, total)) * (1 << 20))
    return rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < share)


def build_index(atoms: DataFrame, path: str, dim: int, k: int = 10, recall: float = 0.95) -> None:
    """Write an index of all atoms with a usable vector: ``tree`` (one row), ``vectors`` by epoch, in order of leaf.

    Vectors of another length, with values that are not finite, or all zero, are
    not indexed. The widening is calibrated with indexed vectors as queries.
    """
    usable = F.col("embedding").isNotNull() & (F.size("embedding") == dim) & F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = atoms.where(usable).select("id", F.coalesce("epoch_id", F.lit("")).alias("epoch_id"), "embedding")
    total = rows.count()
    sample = _sampled(rows, FIT_ROWS, total, 1).select("embedding").toArrow().column(0).combine_chunks()
    tree = fit_tree(unit_rows(sample, dim)[1], total)
    trial = _sampled(rows, CALIBRATION_ROWS, total, 2).select(F.col("id").alias("query_id"), F.col("embedding").alias("query_emb"), F.lit(k).alias("pool")).toArrow().to_pylist()
    truth = vectors.topk_of(rows.withColumn("epoch_id", F.lit("")), trial).join(rows.select(F.col("id").alias("atom_id"), "embedding"), "atom_id").select("query_id", "embedding").toArrow()
    number = {r["query_id"]: i for i, r in enumerate(trial)}
    queries = unit_rows(pa.array([r["query_emb"] for r in trial], pa.list_(pa.float32())), dim)[1]
    asked = np.array([number[x] for x in truth.column(0).to_pylist()], np.int64)
    widen = calibrate(tree, queries, asked, unit_rows(truth.column(1).combine_chunks(), dim)[1], recall) if len(asked) else float("inf")
    kept = rows.sparkSession.sparkContext.broadcast(tree)  # bounded by the fit sample

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = unit_rows(b.column(2), dim)
            b = b.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(kept.value.assign(x).astype(np.int32)), b.column(2)], names=["id", "epoch_id", "leaf", "embedding"])

    homes = rows.mapInArrow(placed, _INDEX)
    homes.repartition("epoch_id", F.floor(F.col("leaf") / 64)).sortWithinPartitions("epoch_id", "leaf").write.mode("overwrite").option("compression", "zstd").partitionBy("epoch_id").parquet(f"{path}/vectors")
    stored = [(dim, k, float(widen), *[bytearray(np.ascontiguousarray(a).tobytes()) for a in (tree.centre, tree.first_child.astype(np.int64), tree.n_children.astype(np.int64), tree.leaf.astype(np.int64), tree.cell_of_leaf.astype(np.int64))])]
    rows.sparkSession.createDataFrame(stored, "dim int, k int, widen double, centre binary, first_child binary, n_children binary, leaf binary, cell binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/tree")


def load_tree(spark: SparkSession, path: str) -> tuple[Tree, int, float]:
    """The tree of an index, its dimension and its widening."""
    r = spark.read.parquet(f"{path}/tree").first()
    whole = lambda c: np.frombuffer(bytes(r[c]), np.int64)
    return Tree(np.frombuffer(bytes(r["centre"]), np.float32).reshape(-1, r["dim"]), whole("first_child"), whole("n_children"), whole("leaf"), whole("cell")), r["dim"], r["widen"]


def search(spark: SparkSession, path: str, queries: DataFrame, widen: float | None = None) -> DataFrame:
    """``query_id, atom_id, epoch_id, sim, epoch_rank``: as :func:`vectors.topk_per_epoch`, from the leaves that each query visits.

    Queries of another dimension, or without a direction, find nothing. An
    epoch's vectors go to one task, which ranks its hits, so hits, which number
    queries times epochs, are not shuffled; only epochs of more than
    :data:`PIECE_ROWS` rows have the hits of their pieces ranked once more.
    """
    tree, dim, stored = load_tree(spark, path)
    held = spark.read.schema(_INDEX).parquet(f"{path}/vectors").withColumn("epoch_id", F.coalesce("epoch_id", F.lit("")))
    large = {r["epoch_id"]: -(-r["n"] // PIECE_ROWS) for r in held.groupBy("epoch_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PIECE_ROWS).collect()}  # at most a row for PIECE_ROWS of the index
    width = shuffle_width(spark)
    best = Window.partitionBy("query_id", "epoch_id").orderBy(F.col("sim").desc(), "atom_id")
    shape = "query_id string, atom_id string, epoch_id string, sim double, epoch_rank int, pool int"
    out = None
    for rows in vectors.query_blocks(queries.select("query_id", "query_emb", "pool")):
        for at, q in vectors.by_length(rows):
            norm = np.linalg.norm(q, axis=1)
            at, q, norm = at[norm > 0], q[norm > 0], norm[norm > 0]
            if not len(at) or q.shape[1] != dim:
                continue
            no, leaf = tree.visits((q / norm[:, None]).astype(np.float32), stored if widen is None else widen)
            wants = {int(x): np.sort(no[leaf == x]) for x in np.unique(leaf)}
            kept = spark.sparkContext.broadcast(([rows[i]["query_id"] for i in at], q, np.array([rows[i]["pool"] for i in at]), wants))  # a block of queries
            wanted = spark.createDataFrame([(x,) for x in wants], "leaf int")
            mine = held.where(F.col("leaf").between(min(wants), max(wants))).join(F.broadcast(wanted), "leaf", "left_semi")  # at most as many as the tree has leaves
            mine = mine.select("id", "epoch_id", "leaf", "embedding")
            whole = mine.where(~F.col("epoch_id").isin(list(large))) if large else mine
            part = whole.withColumn("piece", F.lit(0)).repartition(width, "epoch_id").sortWithinPartitions("epoch_id", "leaf").mapInArrow(_searched(kept), shape).drop("pool")
            if large:
                pieces = F.create_map(*[F.lit(x) for e in large.items() for x in e])[F.col("epoch_id")]
                split = mine.where(F.col("epoch_id").isin(list(large))).withColumn("piece", F.pmod(F.xxhash64("id"), pieces).cast("int"))
                again = split.repartition(width, "epoch_id", "piece").sortWithinPartitions("epoch_id", "piece", "leaf").mapInArrow(_searched(kept), shape)
                part = part.unionByName(again.withColumn("epoch_rank", F.row_number().over(best)).where(F.col("epoch_rank") <= F.col("pool")).drop("pool"))
            out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "query_id string, atom_id string, epoch_id string, sim double, epoch_rank int")
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one epoch and piece at a time; they stand together."""
    kept: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        epoch, piece = b.column(1).dictionary_encode().indices.to_numpy(), b.column(4).to_numpy()
        edges = np.flatnonzero((np.diff(epoch) != 0) | (np.diff(piece) != 0)) + 1
        for lo, hi in zip(np.r_[0, edges], np.r_[edges, b.num_rows]):
            part = b.slice(lo, hi - lo)
            if kept and (kept[-1].column(1)[0].as_py(), kept[-1].column(4)[0].as_py()) != (part.column(1)[0].as_py(), part.column(4)[0].as_py()):
                yield pa.Table.from_batches(kept)
                kept = []
            kept.append(part)
    if kept:
        yield pa.Table.from_batches(kept)


def _searched(kept):
    """Arrow function over rows in order of epoch, piece and leaf: each query's best of an epoch's piece, ranked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, mat, most, wants = kept.value
        named = pa.array(names, pa.string())
        step = max(64, vectors.CELLS // len(names))
        deepest = int(most.max())
        for t in _runs(batches):
            ids, epoch = t.column(0).combine_chunks(), t.column(1)[0].as_py()
            leaf = t.column(2).to_numpy()
            at, x = vectors.matrix(t.column(3).combine_chunks(), mat.shape[1])
            by_id = np.empty(len(ids), np.int64)
            by_id[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
            found = []
            for lo in range(0, len(at), step):
                rows, own = at[lo : lo + step], x[lo : lo + step]
                sims = np.full((len(names), len(rows)), -np.inf)
                edges = np.flatnonzero(np.diff(leaf[rows])) + 1
                for a, b in zip(np.r_[0, edges], np.r_[edges, len(rows)]):
                    who = wants.get(int(leaf[rows[a]]))
                    if who is not None:
                        sims[who, a:b] = vectors.similarity_matrix(mat[who], own[a:b])
                keep = sims > -np.inf
                if len(rows) > deepest > 0:  # all that tie with the last stay until ids decide
                    keep &= sims >= np.partition(sims, len(rows) - deepest, axis=1)[:, len(rows) - deepest][:, None]
                q, c = np.nonzero(keep)
                top = vectors._leading(q, most[q], sims[q, c], by_id[rows[c]])
                found.append((q[top], rows[c[top]], sims[q[top], c[top]]))
            if not found:
                continue
            q, r, s = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((by_id[r], -s, q))
            q, r, s = q[order], r[order], s[order]
            start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
            rank = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)])) + 1
            top = np.flatnonzero(rank <= most[q])
            for lo in range(0, len(top), 1 << 16):
                i = top[lo : lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [named.take(pa.array(q[i])), ids.take(pa.array(r[i])), pa.repeat(pa.scalar(epoch, pa.string()), len(i)), pa.array(s[i]), pa.array(rank[i].astype(np.int32)), pa.array(most[q[i]].astype(np.int32))],
                    names=["query_id", "atom_id", "epoch_id", "sim", "epoch_rank", "pool"],
                )

    return run


def recall_of(found: DataFrame, truth: DataFrame) -> DataFrame:
    """``pairs, found, recall``: the share of true (``query_id, atom_id``) pairs that were found."""
    hit = truth.select("query_id", "atom_id").join(found.select("query_id", "atom_id").distinct().withColumn("_hit", F.lit(1)), ["query_id", "atom_id"], "left")
    return hit.agg(F.count(F.lit(1)).alias("pairs"), F.count("_hit").alias("found")).withColumn("recall", F.col("found") / F.greatest("pairs", F.lit(1)))
