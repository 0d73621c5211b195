"""Queries of the core over the store tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import clock, text, vector
from palimpsest.functions.payload import decoded_text
from palimpsest.operators import ann, entities, history, kg, lifecycle, metrics, recall, skew, vectors
from palimpsest.plans import recall_sql
from palimpsest.session import cut
from palimpsest.sources import checkpoints, epoch_files
from palimpsest.sources.tables import table
from palimpsest.streaming import epochs

HEAVY_SHARE = 0.02


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    kg = table(spark, d, "kg_index")
    keys = {"entity": F.col("entity"), "atom_id": F.col("atom_id")}
    return skew.heavy_keys(kg, keys, HEAVY_SHARE).select("key_kind", "key_value")


def p4_entities(spark: SparkSession, d: str) -> DataFrame:
    return skew.degree(table(spark, d, "kg_index"), "entity", "atom_id")


def p4_atoms(spark: SparkSession, d: str) -> DataFrame:
    return skew.degree(table(spark, d, "kg_index"), "atom_id", "entity")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    said = history.statements(table(spark, d, "atoms"), table(spark, d, "functional_preds"))
    return history.versions(said)


def _all_atoms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "atoms").unionByName(table(spark, d, "pinned_atoms"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return cut(recall.prepared(table(spark, d, "recall_queries")))


# ---- vectors


def vector_normalize(spark: SparkSession, d: str) -> DataFrame:
    unit = vector.normalized(F.col("embedding"))
    return _all_atoms(spark, d).select("id", F.size("embedding").cast("long").alias("dim"), F.round(vector.norm(unit), 5).alias("norm"), (F.round(F.try_element_at(unit, F.lit(1)).cast("double"), 4) + F.lit(0.0)).alias("first"), (F.round(F.try_element_at(unit, F.lit(-1)).cast("double"), 4) + F.lit(0.0)).alias("last"))


def vector_dim_check(spark: SparkSession, d: str) -> DataFrame:
    """Atoms whose embedding has not the store's dimension."""
    meta = table(spark, d, "store_metadata").select("dim")
    return table(spark, d, "atoms").join(F.broadcast(meta)).where(F.size("embedding") != F.col("dim")).select("id", F.size("embedding").cast("long").alias("dim"))


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    found = vectors.topk(_all_atoms(spark, d), _asked(spark, d))
    return found.select("query_id", "atom_id", F.round("sim", 6).alias("sim"), F.col("rank").cast("long").alias("rank"))


def vector_topk_per_epoch(spark: SparkSession, d: str) -> DataFrame:
    found = vectors.topk_per_epoch(_all_atoms(spark, d), _asked(spark, d))
    return found.select("query_id", "epoch_id", "atom_id", F.round("sim", 6).alias("sim"), F.col("epoch_rank").cast("long").alias("epoch_rank"))


def _index(spark: SparkSession, d: str) -> str:
    path = epochs.work_folder(spark)
    dim = int(table(spark, d, "store_metadata").first()["dim"])
    ann.build_index(_all_atoms(spark, d), path, dim)
    return path


def epoch_ann_topk(spark: SparkSession, d: str) -> DataFrame:
    """Nearest atoms of every epoch from a stored index, visiting the leaves that its calibration asks for."""
    found = ann.search(spark, _index(spark, d), _asked(spark, d))
    return found.select("query_id", "epoch_id", "atom_id", F.round("sim", 6).alias("sim"), F.col("epoch_rank").cast("long").alias("epoch_rank"))


def epoch_index_topk(spark: SparkSession, d: str) -> DataFrame:
    """The same with all leaves visited, which is exact."""
    found = ann.search(spark, _index(spark, d), _asked(spark, d), widen=float("inf"))
    return found.select("query_id", "epoch_id", "atom_id", F.round("sim", 6).alias("sim"), F.col("epoch_rank").cast("long").alias("epoch_rank"))


def candidate_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of every recall candidate, 0 where it is undefined."""
    pairs = table(spark, d, "recall_candidates").select("query_id", "atom_id").distinct()
    return vectors.pair_similarity(pairs, table(spark, d, "atoms"), _asked(spark, d)).withColumn("sim", F.round("sim", 6))


def int8_dequant(spark: SparkSession, d: str) -> DataFrame:
    """Largest error of the INT8 round trip per atom stays below half a step."""
    q = table(spark, d, "atoms").where(F.size("embedding") > 0).where(F.forall("embedding", lambda x: ~F.isnan(x))).select("id", "embedding", vector.quantized(F.col("embedding")).alias("q"))
    err = F.array_max(F.zip_with(vector.dequantized(F.col("q.codes"), F.col("q.top")), F.col("embedding"), lambda a, b: F.abs(a - b)))
    codes = F.aggregate(F.transform("q.codes", lambda c: c.cast("long")), F.lit(0).cast("long"), lambda s, c: s + c)
    return q.select("id", F.size("q.codes").cast("long").alias("dim"), codes.alias("code_sum"), (err <= F.col("q.top") / 127 * 0.501).alias("within"))


# ---- entity index


def entity_index(spark: SparkSession, d: str) -> DataFrame:
    return kg.entity_index(_all_atoms(spark, d))


def entity_merge(spark: SparkSession, d: str) -> DataFrame:
    """The stored index with the rows derived from the triples, each once."""
    return kg.merged_index(table(spark, d, "kg_index"), kg.entity_index(_all_atoms(spark, d)))


def entity_degree(spark: SparkSession, d: str) -> DataFrame:
    return kg.entity_degree(table(spark, d, "kg_index"))


def broad_entities(spark: SparkSession, d: str) -> DataFrame:
    return entity_degree(spark, d).where(F.col("degree") > kg.BROAD_DEGREE)


def distinct_entities(spark: SparkSession, d: str) -> DataFrame:
    return kg.usable_index(table(spark, d, "kg_index")).select("entity").distinct()


def entity_lookup(spark: SparkSession, d: str) -> DataFrame:
    asked = _asked(spark, d).select("query_id", F.explode("qe").alias("entity"))
    return kg.lookup(table(spark, d, "kg_index"), asked).select("query_id", "entity", "atom_id")


def entity_seed(spark: SparkSession, d: str) -> DataFrame:
    asked = _asked(spark, d).select("query_id", F.explode("qe").alias("entity"))
    return recall.seeds(asked, table(spark, d, "kg_index"))


def bootstrap_entities(spark: SparkSession, d: str) -> DataFrame:
    """Every active atom with a vector asks, naming no entity, for what its nearest active atoms are about."""
    atoms = _all_atoms(spark, d)
    asks = table(spark, d, "atoms").where((F.col("epoch_id") == "active") & (F.size("embedding") > 0))
    q = cut(recall.prepared(asks.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_emb"), F.lit(1).alias("top_k"), F.lit(0).alias("expand_hops"), F.array().cast("array<string>").alias("query_entities"))))
    return recall.bootstrapped(recall.vector_pool(atoms, q), q, kg.subject_object(atoms))


# ---- recall


def hop_n(spark: SparkSession, d: str) -> DataFrame:
    """The least hop at which every candidate was reached."""
    found = recall.hops(_all_atoms(spark, d), table(spark, d, "kg_index"), _asked(spark, d))
    return found.select("query_id", "atom_id", F.col("hop").alias("min_hop"))


def known_entities(spark: SparkSession, d: str) -> DataFrame:
    return recall.known(_all_atoms(spark, d), table(spark, d, "kg_index"), _asked(spark, d))


def _rounded(x: Column, digits: int) -> Column:
    """Rounded as SQL does it: the product with a power of ten, half away from zero."""
    unit = 10.0**digits
    return F.signum(x) * F.floor(F.abs(x) * unit + 0.5) / unit


def _ranked(spark: SparkSession, d: str, columns: list[str]) -> DataFrame:
    return recall.ranked(_all_atoms(spark, d), table(spark, d, "kg_index"), _asked(spark, d), columns=columns)


def recall_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Semantic, recency and entity rank, overlap, topic lock and supersession of every candidate."""
    long = [F.col(c).cast("long").alias(c) for c in ("overlap", "semantic_rank", "recency_rank", "entity_rank")]
    found = _ranked(spark, d, ["sim", "overlap", "semantic_rank", "recency_rank", "entity_rank", "boost", "is_superseded", "rrf"])
    return found.select("query_id", "atom_id", _rounded(F.col("sim"), 6).alias("sim"), *long, "boost", "is_superseded", _rounded(F.col("rrf"), 12).alias("rrf"))


def recall_scores(spark: SparkSession, d: str) -> DataFrame:
    """Position and score of every candidate after penalty and signal filter."""
    return _ranked(spark, d, ["position", "score"]).select("query_id", "atom_id", F.col("position").cast("long").alias("position"), _rounded(F.col("score"), 12).alias("score"))


def recall_fused(spark: SparkSession, d: str) -> DataFrame:
    found = recall.recall(_all_atoms(spark, d), table(spark, d, "kg_index"), table(spark, d, "recall_queries"), table(spark, d, "access_deltas"))
    return found.select("query_id", F.col("position").cast("long").alias("position"), "atom_id", F.round("score", 12).alias("score"), "access_count")


def access_bumps(spark: SparkSession, d: str) -> DataFrame:
    return recall.access_bumps(recall_fused(spark, d))


def payload_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Of the candidates of a query that share a payload, the newest (least id at ties)."""
    atoms = table(spark, d, "atoms").select(F.col("id").alias("atom_id"), "payload", "created_at")
    pairs = table(spark, d, "recall_candidates").select("query_id", "atom_id").distinct()
    rows = pairs.join(atoms, "atom_id").withColumn("stage", F.lit(0)).withColumn("sim", F.lit(0.0))
    return recall.payload_dedup(rows).select("query_id", "atom_id")


def superseded_flags(spark: SparkSession, d: str) -> DataFrame:
    """Atoms that a newer one supersedes, over the whole table."""
    rows = _all_atoms(spark, d).select(F.col("id").alias("atom_id"), "created_at", "triples")
    return lifecycle.superseded(rows, [])


def active_state(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.active_state(_all_atoms(spark, d))


# ---- text


def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "recall_queries").select("query_id", text.cleaned(F.col("query_text")).alias("clean"))


def tokenize(spark: SparkSession, d: str) -> DataFrame:
    words = text.long_words(text.cleaned(F.col("query_text")))
    return table(spark, d, "recall_queries").select("query_id", F.explode(words).alias("word"))


def _preds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "atoms").select(F.explode("triples").alias("t")).select(F.col("t.pred").alias("pred")).distinct()


def extract_entities_exact(spark: SparkSession, d: str) -> DataFrame:
    return entities.mentioned(table(spark, d, "recall_queries"), table(spark, d, "kg_index"), "query_id", "query_text")


def extract_entities_predicate(spark: SparkSession, d: str) -> DataFrame:
    return entities.hinted_predicates(table(spark, d, "recall_queries"), _preds(spark, d), "query_id", "query_text")


def extract_entities(spark: SparkSession, d: str) -> DataFrame:
    return entities.extract_entities(table(spark, d, "recall_queries"), table(spark, d, "kg_index"), _preds(spark, d), "query_id", "query_text")


def capitalized_entities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "recall_queries").select("query_id", F.explode(text.capitalized(F.col("query_text"))).alias("word"))


#: Rules of our own for the demonstration query.
RULES = [
    (["booked"], ("room", "is", "booked")),
    (["status", "open"], ("status", "is", "open")),
    (["user", "prefers"], ("user", "has", "preference")),
    (["moved", "by courier"], ("goods", "sent_by", "courier")),
]


def rule_triples(spark: SparkSession, d: str) -> DataFrame:
    found = F.explode(text.rule_triples(decoded_text(F.col("payload")), RULES)).alias("t")
    return table(spark, d, "atoms").select("id", found).select("id", "t.subj", "t.pred", "t.obj")


# ---- storage and lifecycle


def epoch_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Epochs with their number of atoms and the span they cover."""
    at = F.unix_micros("created_at")
    return _all_atoms(spark, d).groupBy("epoch_id").agg(F.count(F.lit(1)).alias("atoms"), F.min(at).alias("first_us"), F.max(at).alias("last_us"))


def epoch_scan(spark: SparkSession, d: str) -> DataFrame:
    """One epoch of a store written by epoch; the other directories are not read."""
    path = f"{epochs.work_folder(spark)}/atoms"
    epoch_files.write_epochs(_all_atoms(spark, d), path)
    return epoch_files.read_epoch(spark, path, "active").select("id", "payload", F.size("triples").cast("long").alias("n_triples"))


def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Atoms that an access delta names, by a left-semi join."""
    return table(spark, d, "atoms").join(table(spark, d, "access_deltas"), F.col("id") == F.col("atom_id"), "left_semi").select("id", "epoch_id")


def epoch_assign(spark: SparkSession, d: str) -> DataFrame:
    """The hour-long epoch of each atom, and whether it had expired at the newest atom's time."""
    atoms = table(spark, d, "atoms")
    now = atoms.agg(F.max("created_at").alias("now"))
    return atoms.join(F.broadcast(now)).select("id", clock.epoch_of(F.col("created_at"), 3600).alias("epoch_no"), clock.expired(F.col("created_at"), F.col("now"), 3600).alias("expired"))


def idempotent_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Atoms and pinned atoms appended twice to the closed epochs: every id once."""
    rows = _all_atoms(spark, d).select("id", "epoch_id")
    stored = rows.where("epoch_id <> 'active'")
    return lifecycle.idempotent_append(stored, rows.unionByName(rows))


def monotonic_ts(spark: SparkSession, d: str) -> DataFrame:
    """Strictly increasing event times per user in order of event id."""
    rows = table(spark, d, "events").select("event_id", "user_id", (F.floor(clock.wall_micros("ts") / 3_600_000_000) * 3_600_000_000).cast("long").alias("clock_us"))
    return clock.monotonic_micros(rows, "clock_us", "event_id", "user_id").select("event_id", "ts_us")


def _wal(spark: SparkSession, d: str) -> DataFrame:
    """A log made of the events: some ids roll back, some commit, all others add."""
    op = F.when(F.col("event_id") % 97 == 3, "ROLLBACK").when(F.col("event_id") % 61 == 5, "COMMIT").otherwise("ADD")
    return table(spark, d, "events").select(F.col("event_id").alias("lsn"), op.alias("op"), F.col("props").alias("data"))


def wal_pending(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.wal_pending(_wal(spark, d))


def wal_recoverable(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.wal_recoverable(_wal(spark, d)).select("lsn", "op", "data")


def access_delta_merge(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.with_deltas(table(spark, d, "atoms"), table(spark, d, "access_deltas")).select("id", "access_count")


#: The present, for queries that need one.
NOW = "2025-03-01 00:00:00"


def saliency(spark: SparkSession, d: str) -> DataFrame:
    now = F.to_timestamp(F.lit(f"{NOW}Z"))
    return table(spark, d, "atoms").select("id", F.round(clock.saliency(F.col("access_count"), F.col("created_at"), now), 9).alias("saliency"))


def payload_json(spark: SparkSession, d: str) -> DataFrame:
    """The text of every payload: decoded JSON strings, content fields, or the payload itself."""
    return table(spark, d, "atoms").select("id", decoded_text(F.col("payload")).alias("text"))


def triples_json(spark: SparkSession, d: str) -> DataFrame:
    """Triples of old rows, JSON lists of lists of text, null objects and special characters included."""
    listed = F.to_json(F.transform("triples", lambda t: F.array(t["subj"], t["pred"], t["obj"])))
    old = table(spark, d, "atoms").withColumn("triples", listed).withColumn("created_at", F.unix_micros("created_at") / 1_000_000)
    return epoch_files.decode_legacy(old).select("id", F.posexplode("triples").alias("pos", "t")).select("id", F.col("pos").cast("long").alias("pos"), "t.subj", "t.pred", "t.obj")


# ---- agent checkpoints


def _checkpoints(spark: SparkSession, d: str) -> DataFrame:
    """Events as agent checkpoints: the user is the thread, the zero-padded event the checkpoint."""
    blob = F.struct(F.lit("json").alias("type"), F.encode("props", "utf-8").alias("data"))
    return table(spark, d, "events").select(
        F.concat(F.lit("user_"), F.col("user_id")).alias("thread_id"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("checkpoint_id"),
        blob.alias("checkpoint"), F.col("event_type").alias("metadata"), F.lit(None).cast("string").alias("parent_config"), F.col("ts").alias("timestamp"), F.col("event_id").alias("version"),
    )


def checkpoint_latest(spark: SparkSession, d: str) -> DataFrame:
    found = checkpoints.latest(_checkpoints(spark, d))
    return found.select("thread_id", "checkpoint_id", "metadata", checkpoints.envelope(F.col("checkpoint")).alias("checkpoint"))


def checkpoint_list(spark: SparkSession, d: str) -> DataFrame:
    """The five newest checkpoints of every thread, newest first."""
    found = checkpoints.newest(_checkpoints(spark, d), 5)
    return found.select("thread_id", "checkpoint_id", F.col("position").cast("long").alias("position"))


def checkpoint_writes(spark: SparkSession, d: str) -> DataFrame:
    """Pending writes of each checkpoint, one row per channel."""
    writes = F.array(*[F.struct(F.lit(c).alias("channel"), F.struct(F.lit("str").alias("type"), F.encode(F.col(c).cast("string"), "utf-8").alias("data")).alias("value")) for c in ("event_type", "user_id")])
    rows = table(spark, d, "events").select(F.concat(F.lit("user_"), F.col("user_id")).alias("thread_id"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("checkpoint_id"), F.lit("task").alias("task_id"), writes.alias("writes"), F.lit(0).cast("long").alias("version"))
    return checkpoints.write_rows(rows).select("thread_id", "checkpoint_id", "task_id", F.col("idx").cast("long").alias("idx"), "channel", F.decode("value.data", "utf-8").alias("value"))


# ---- evaluation


def _results(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    found = vectors.topk(table(spark, d, "atoms"), _asked(spark, d)).select("query_id", F.col("atom_id").alias("item"), "rank")
    relevant = table(spark, d, "recall_candidates").select("query_id", F.col("atom_id").alias("item"))
    return found, relevant


def precision_recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    """Of the ten nearest atoms of each query, those that are among its candidates."""
    return metrics.precision_recall_at_k(*_results(spark, d), 10).select("query_id", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


def chain_recall(spark: SparkSession, d: str) -> DataFrame:
    return metrics.mean_recall(metrics.precision_recall_at_k(*_results(spark, d), 10)).select(F.round("mean_recall", 9).alias("mean_recall"))


def answer_hit(spark: SparkSession, d: str) -> DataFrame:
    """Whether a candidate's payload holds all long words of the query that are letters only."""
    words = F.filter(text.long_words(text.cleaned(F.col("query_text"))), lambda w: w.rlike("^[a-z]+$"))
    questions = table(spark, d, "recall_queries").where(F.col("query_text").isNotNull()).select("query_id", words.alias("terms"))
    results = table(spark, d, "recall_candidates").distinct().join(table(spark, d, "atoms"), F.col("atom_id") == F.col("id")).select("query_id", "payload")
    return metrics.answer_hit(results, questions)


# ---- streaming


def stream_epoch_flush(spark: SparkSession, d: str) -> DataFrame:
    """Atoms streamed into an epoch-partitioned store; what its catalog lists afterwards."""
    store = epochs.flush_available(spark, d)
    return store.groupBy("epoch_id").agg(F.count(F.lit(1)).alias("atoms"))


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling event-time windows of a day over the event stream."""
    return epochs.windowed_available(spark, d)


def stream_latest_state(spark: SparkSession, d: str) -> DataFrame:
    """The newest event of each user and type, kept up by a streaming aggregate."""
    return epochs.latest_available(spark, d)


_QUERIES = [
    p4_found, p4_entities, p4_atoms, p7_found,
    vector_normalize, vector_dim_check, vector_topk, vector_topk_per_epoch, epoch_ann_topk, epoch_index_topk, candidate_cosine, int8_dequant,
    entity_index, entity_merge, entity_degree, broad_entities, distinct_entities, entity_lookup, entity_seed, bootstrap_entities,
    hop_n, known_entities, recall_ranks, recall_scores, recall_fused, access_bumps, payload_dedup, superseded_flags, active_state,
    clean_text, tokenize, extract_entities_exact, extract_entities_predicate, extract_entities, capitalized_entities, rule_triples,
    epoch_catalog, epoch_scan, point_lookup, epoch_assign, idempotent_upsert, monotonic_ts, wal_pending, wal_recoverable, access_delta_merge, saliency, payload_json, triples_json,
    checkpoint_latest, checkpoint_list, checkpoint_writes, precision_recall_at_k, chain_recall, answer_hit,
    stream_epoch_flush, stream_windows, stream_latest_state,
]

_SQL = {
    "p4_found": """
        WITH t AS (SELECT count(*) AS total FROM kg_index),
        k AS (SELECT 'entity' AS key_kind, entity AS key_value FROM kg_index UNION ALL SELECT 'atom_id', atom_id FROM kg_index)
        SELECT key_kind, key_value FROM k, t WHERE key_value IS NOT NULL AND key_value <> ''
        GROUP BY key_kind, key_value, total HAVING count(*) >= 0.02 * total""",
    "p4_entities": "SELECT entity, count(*) AS n_rows, count(DISTINCT atom_id) AS n_partners FROM kg_index GROUP BY entity",
    "p4_atoms": "SELECT atom_id, count(*) AS n_rows, count(DISTINCT entity) AS n_partners FROM kg_index GROUP BY atom_id",
    "p7_found": r"""
        WITH e AS (SELECT id, created_at, unnest(triples) AS t FROM atoms WHERE created_at IS NOT NULL),
        s AS (SELECT id, epoch_us(created_at) AS said_us, lower(trim(regexp_replace(t.subj, '\s+', ' ', 'g'))) AS subj,
          lower(trim(regexp_replace(t.pred, '\s+', ' ', 'g'))) AS pred, lower(trim(regexp_replace(t.obj, '\s+', ' ', 'g'))) AS obj FROM e),
        w AS (SELECT * FROM s WHERE obj IS NOT NULL AND subj IS NOT NULL AND pred IN (SELECT lower(trim(pred)) FROM functional_preds)
          QUALIFY row_number() OVER (PARTITION BY subj, pred, said_us ORDER BY id DESC, obj DESC) = 1),
        c AS (SELECT *, lag(obj) OVER (PARTITION BY subj, pred ORDER BY said_us) AS was FROM w),
        b AS (SELECT * FROM c WHERE was IS DISTINCT FROM obj)
        SELECT subj, pred, obj, said_us AS valid_from_us, coalesce(lead(said_us) OVER (PARTITION BY subj, pred ORDER BY said_us), -1) AS valid_to_us FROM b""",
}


_CLEAN = "replace(replace(replace(replace(lower(query_text), '''s', ''), '?', ''), '.', ''), ',', '')"
_STOPS = "('user','agent','the','this','that','it','i','my','me','they','their','who','what','where','when','how')"
_EXACT = f"SELECT DISTINCT query_id, entity FROM (SELECT query_id, {_CLEAN} AS c FROM recall_queries WHERE query_text IS NOT NULL) q JOIN (SELECT DISTINCT entity FROM kg_index WHERE entity <> '' AND lower(entity) NOT IN {_STOPS}) e ON contains(q.c, lower(e.entity))"
_PREDS = f"""WITH p AS (SELECT DISTINCT t.pred AS entity FROM (SELECT unnest(triples) AS t FROM atoms) WHERE t.pred <> '' AND lower(t.pred) NOT IN {_STOPS}),
  q AS (SELECT query_id, {_CLEAN} AS c FROM recall_queries WHERE query_text IS NOT NULL),
  w AS (SELECT query_id, unnest(regexp_split_to_array(trim(c), '\\s+')) AS w FROM q), r AS (SELECT entity, unnest(regexp_split_to_array(replace(lower(entity), '_', ' '), '\\s+')) AS p FROM p)
  SELECT query_id, entity FROM q JOIN p ON contains(c, lower(entity)) UNION SELECT query_id, entity FROM w JOIN r ON length(p) > 3 AND length(w) > 2 AND contains(w, p[1:4])"""
_POOLS = recall_sql.BASE
_TOPK = f"WITH {recall_sql.ATOMS}, good AS (SELECT * FROM a0 WHERE len(embedding) > 0 AND isfinite(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))))), s AS (SELECT q.query_id, a.id AS atom_id, {recall_sql._SIM} AS sim, coalesce(q.top_k, 5) * 10 AS k FROM recall_queries q JOIN good a ON len(a.embedding) = len(q.query_emb)), t AS (SELECT query_id, atom_id, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, atom_id) AS rank, k FROM s)"
_TOP10 = _TOPK.replace("UNION ALL SELECT id, payload, embedding, triples, created_at, access_count, epoch_id FROM pinned_atoms", "") + ", top AS (SELECT query_id, atom_id FROM t WHERE rank <= 10), rel AS (SELECT DISTINCT query_id, atom_id FROM recall_candidates), h AS (SELECT query_id, count(*) AS hits FROM top JOIN rel USING (query_id, atom_id) GROUP BY query_id), n AS (SELECT query_id, count(*) AS returned FROM top GROUP BY query_id), m AS (SELECT query_id, count(*) AS total FROM rel GROUP BY query_id), pr AS (SELECT query_id, coalesce(hits, 0) / greatest(coalesce(returned, 0), 1) AS precision, coalesce(hits, 0) / total AS recall FROM n FULL JOIN m USING (query_id) LEFT JOIN h USING (query_id))"
_DECODED = "CASE WHEN json_valid(payload) AND json_type(payload) = 'OBJECT' THEN payload ->> '$.content' WHEN json_valid(payload) AND json_type(payload) = 'VARCHAR' THEN payload ->> '$' ELSE payload END"
_WAL = "WITH wal AS (SELECT event_id AS lsn, CASE WHEN event_id % 97 = 3 THEN 'ROLLBACK' WHEN event_id % 61 = 5 THEN 'COMMIT' ELSE 'ADD' END AS op, props AS data FROM events)"
_NORM = "sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))"

_SQL |= {
    "vector_normalize": f"WITH {recall_sql.ATOMS}, n AS (SELECT id, embedding, {_NORM} AS n FROM a0) SELECT id, len(embedding) AS dim, CASE WHEN isnan(n) THEN n WHEN n > 1e-10 THEN 1.0::DOUBLE ELSE round(n, 5) END AS norm, round((CASE WHEN n > 1e-10 THEN embedding[1]::DOUBLE / n ELSE embedding[1] END)::FLOAT::DOUBLE, 4) + 0.0::DOUBLE AS first, round((CASE WHEN n > 1e-10 THEN embedding[-1]::DOUBLE / n ELSE embedding[-1] END)::FLOAT::DOUBLE, 4) + 0.0::DOUBLE AS last FROM n",
    "vector_dim_check": "SELECT id, len(embedding) AS dim FROM atoms, store_metadata WHERE len(embedding) <> store_metadata.dim",
    "vector_topk": _TOPK + " SELECT query_id, atom_id, round(sim, 6) AS sim, rank FROM t WHERE rank <= k",
    "vector_topk_per_epoch": _POOLS + " SELECT query_id, epoch_id, atom_id, round(sim, 6) AS sim, row_number() OVER (PARTITION BY query_id, epoch_id ORDER BY pool.sim DESC, atom_id) AS epoch_rank FROM pool",
    "epoch_index_topk": _POOLS.replace("FROM a0 WHERE len(embedding) > 0", "FROM a0 WHERE len(embedding) = 64 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0") + " SELECT query_id, coalesce(epoch_id, '') AS epoch_id, atom_id, round(sim, 6) AS sim, row_number() OVER (PARTITION BY query_id, epoch_id ORDER BY pool.sim DESC, atom_id) AS epoch_rank FROM pool",
    "candidate_cosine": f"WITH p AS (SELECT DISTINCT query_id, atom_id FROM recall_candidates) SELECT query_id, atom_id, round(coalesce(CASE WHEN len(a.embedding) = len(q.query_emb) AND isfinite(list_sum(list_transform(a.embedding, lambda x: abs(x::DOUBLE)))) THEN {recall_sql._SIM} END, 0.0), 6) AS sim FROM p JOIN recall_queries q USING (query_id) JOIN atoms a ON a.id = p.atom_id",
    "int8_dequant": "SELECT id, len(embedding) AS dim, list_sum(list_transform(embedding, lambda x: CASE WHEN list_max(list_transform(embedding, lambda y: abs(y))) > 0 THEN round(x::DOUBLE / list_max(list_transform(embedding, lambda y: abs(y)))::DOUBLE * 127)::BIGINT ELSE 0 END))::BIGINT AS code_sum, true AS within FROM atoms WHERE len(embedding) > 0 AND NOT isnan(list_sum(embedding))",
    "entity_index": f"WITH {recall_sql.ATOMS} SELECT DISTINCT entity, id AS atom_id, epoch_id FROM (SELECT id, epoch_id, unnest([t.subj, t.pred, t.obj]) AS entity FROM (SELECT id, epoch_id, unnest(triples) AS t FROM a0)) WHERE entity <> ''",
    "entity_merge": f"WITH {recall_sql.ATOMS} SELECT entity, atom_id, epoch_id FROM kg_index WHERE entity <> '' UNION SELECT entity, id, epoch_id FROM (SELECT id, epoch_id, unnest([t.subj, t.pred, t.obj]) AS entity FROM (SELECT id, epoch_id, unnest(triples) AS t FROM a0)) WHERE entity <> ''",
    "entity_degree": "SELECT entity, count(*) AS degree FROM (SELECT DISTINCT * FROM kg_index WHERE entity <> '') GROUP BY entity",
    "broad_entities": "SELECT entity, count(*) AS degree FROM (SELECT DISTINCT * FROM kg_index WHERE entity <> '') GROUP BY entity HAVING count(*) > 5",
    "distinct_entities": "SELECT DISTINCT entity FROM kg_index WHERE entity <> ''",
    "entity_lookup": "SELECT q.query_id, e.entity, e.atom_id FROM (SELECT DISTINCT query_id, unnest(query_entities) AS entity FROM recall_queries) q JOIN (SELECT DISTINCT entity, atom_id FROM kg_index WHERE entity <> '') e USING (entity)",
    "entity_seed": "SELECT DISTINCT q.query_id, e.atom_id FROM (SELECT query_id, unnest(query_entities) AS entity FROM recall_queries) q JOIN kg_index e USING (entity) WHERE entity <> ''",
    "bootstrap_entities": _POOLS.replace("FROM recall_queries)", "FROM (SELECT id AS query_id, embedding AS query_emb, 1 AS top_k, 0 AS expand_hops, []::VARCHAR[] AS query_entities FROM atoms WHERE epoch_id = 'active' AND len(embedding) > 0 AND isfinite(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))))))") + " SELECT query_id, entity FROM boot",
    "hop_n": recall_sql.CANDIDATES + f" SELECT query_id, atom_id, greatest(stage - 2, 0) AS min_hop FROM v{recall_sql.MAX_HOPS}",
    "known_entities": recall_sql.CANDIDATES + " SELECT query_id, entity FROM known",
    "recall_ranks": recall_sql.RANKED + " SELECT query_id, atom_id, round(sim, 6) AS sim, overlap, semantic_rank, recency_rank, entity_rank, boost, is_superseded, round(rrf, 12) AS rrf FROM z",
    "recall_scores": recall_sql.RANKED + " SELECT query_id, atom_id, position, round(score, 12) AS score FROM z",
    "recall_fused": recall_sql.RANKED + ", d AS (SELECT atom_id, sum(coalesce(delta, 0)) AS delta FROM access_deltas GROUP BY atom_id) SELECT z.query_id, z.position, z.atom_id, round(z.score, 12) AS score, (coalesce(a.access_count, 0) + coalesce(d.delta, 0) + 1)::BIGINT AS access_count FROM z JOIN q USING (query_id) JOIN a0 a ON a.id = z.atom_id LEFT JOIN d ON d.atom_id = z.atom_id WHERE z.position <= q.top_k",
    "access_bumps": recall_sql.RANKED + " SELECT z.atom_id, count(*) AS delta FROM z JOIN q USING (query_id) WHERE z.position <= q.top_k GROUP BY z.atom_id",
    "payload_dedup": "SELECT query_id, atom_id FROM (SELECT DISTINCT query_id, atom_id FROM recall_candidates) c JOIN atoms a ON a.id = c.atom_id QUALIFY row_number() OVER (PARTITION BY query_id, coalesce(payload, 'None') ORDER BY created_at DESC, atom_id) = 1",
    "superseded_flags": f"WITH {recall_sql.ATOMS}, t AS (SELECT id, created_at, unnest(triples) AS t FROM a0), o AS (SELECT id, first_value(id) OVER (PARTITION BY lower(t.subj), lower(t.pred) ORDER BY created_at DESC, id DESC) AS owner FROM t WHERE t.subj IS NOT NULL AND t.pred IS NOT NULL) SELECT DISTINCT id AS atom_id FROM o WHERE owner <> id",
    "active_state": f"WITH {recall_sql.ATOMS}, t AS (SELECT id, created_at, unnest(triples) AS t FROM a0) SELECT lower(t.subj) AS subj, lower(t.pred) AS pred, coalesce(t.obj, '') AS obj, id AS atom_id FROM t WHERE t.subj IS NOT NULL AND t.pred IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lower(t.subj), lower(t.pred) ORDER BY created_at DESC, id DESC, coalesce(t.obj, '') DESC) = 1",
    "clean_text": f"SELECT query_id, {_CLEAN} AS clean FROM recall_queries",
    "tokenize": f"SELECT DISTINCT query_id, word FROM (SELECT query_id, unnest(regexp_split_to_array(trim({_CLEAN}), '\\s+')) AS word FROM recall_queries WHERE query_text IS NOT NULL) WHERE length(word) > 2",
    "extract_entities_exact": _EXACT,
    "extract_entities_predicate": _PREDS,
    "extract_entities": f"SELECT * FROM ({_EXACT}) UNION SELECT * FROM ({_PREDS})",
    "capitalized_entities": "SELECT DISTINCT query_id, regexp_replace(w, '^[.,?!]+|[.,?!]+$', '', 'g') AS word FROM (SELECT query_id, unnest(regexp_split_to_array(query_text, '\\s+')) AS w FROM recall_queries) WHERE regexp_matches(w, '^[A-Z]')",
    "rule_triples": f"WITH d AS (SELECT id, lower({_DECODED}) AS x FROM atoms) SELECT id, 'room' AS subj, 'is' AS pred, 'booked' AS obj FROM d WHERE contains(x, 'booked') UNION ALL SELECT id, 'status', 'is', 'open' FROM d WHERE contains(x, 'status') AND contains(x, 'open') UNION ALL SELECT id, 'user', 'has', 'preference' FROM d WHERE contains(x, 'user') AND contains(x, 'prefers') UNION ALL SELECT id, 'goods', 'sent_by', 'courier' FROM d WHERE contains(x, 'moved') AND contains(x, 'by courier')",
    "epoch_catalog": f"WITH {recall_sql.ATOMS} SELECT epoch_id, count(*) AS atoms, min(epoch_us(created_at)) AS first_us, max(epoch_us(created_at)) AS last_us FROM a0 GROUP BY epoch_id",
    "epoch_scan": f"WITH {recall_sql.ATOMS} SELECT id, payload, len(triples) AS n_triples FROM a0 WHERE epoch_id = 'active'",
    "point_lookup": "SELECT id, epoch_id FROM atoms WHERE id IN (SELECT atom_id FROM access_deltas)",
    "epoch_assign": "SELECT id, floor(epoch_us(created_at) / 3600000000)::BIGINT AS epoch_no, (SELECT max(epoch_us(created_at)) FROM atoms) - epoch_us(created_at) > 3600000000 AS expired FROM atoms",
    "idempotent_upsert": "SELECT id, epoch_id FROM atoms UNION SELECT id, epoch_id FROM pinned_atoms",
    "monotonic_ts": "WITH e AS (SELECT event_id, user_id, epoch_us(date_trunc('hour', ts)) AS c, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) SELECT event_id, n + max(c - n) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS ts_us FROM e",
    "wal_pending": _WAL + " SELECT lsn, op, data FROM wal WHERE op = 'ADD' AND lsn > coalesce((SELECT max(lsn) FROM wal WHERE op IN ('COMMIT', 'ROLLBACK')), -1)",
    "wal_recoverable": _WAL + " SELECT lsn, op, data FROM wal a WHERE op = 'ADD' AND coalesce((SELECT min_by(b.op, b.lsn) FROM wal b WHERE b.op <> 'ADD' AND b.lsn > a.lsn), 'COMMIT') <> 'ROLLBACK'",
    "access_delta_merge": "SELECT id, (coalesce(access_count, 0) + coalesce(delta, 0))::BIGINT AS access_count FROM atoms LEFT JOIN (SELECT atom_id, sum(coalesce(delta, 0)) AS delta FROM access_deltas GROUP BY atom_id) ON atom_id = id",
    "saliency": f"SELECT id, round(coalesce(access_count, 0) / ((epoch_us(TIMESTAMPTZ '{NOW}+00') - epoch_us(created_at)) / 3600000000.0::DOUBLE + 1.0), 9) AS saliency FROM atoms",
    "payload_json": f"SELECT id, {_DECODED} AS text FROM atoms",
    "triples_json": "SELECT id, pos - 1 AS pos, t.subj AS subj, t.pred AS pred, t.obj AS obj FROM (SELECT id, unnest(triples) AS t, generate_subscripts(triples, 1) AS pos FROM atoms)",
    "checkpoint_latest": "SELECT 'user_' || user_id AS thread_id, lpad(event_id::VARCHAR, 12, '0') AS checkpoint_id, event_type AS metadata, {'type': 'json', 'data': base64(encode(props))} AS checkpoint FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "checkpoint_list": "SELECT 'user_' || user_id AS thread_id, lpad(event_id::VARCHAR, 12, '0') AS checkpoint_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS position FROM events QUALIFY position <= 5",
    "checkpoint_writes": "SELECT 'user_' || user_id AS thread_id, lpad(event_id::VARCHAR, 12, '0') AS checkpoint_id, 'task' AS task_id, i::BIGINT AS idx, CASE i WHEN 0 THEN 'event_type' ELSE 'user_id' END AS channel, CASE i WHEN 0 THEN event_type ELSE user_id::VARCHAR END AS value FROM events, (VALUES (0), (1)) AS v(i)",
    "precision_recall_at_k": _TOP10 + " SELECT query_id, round(precision, 9) AS precision, round(recall, 9) AS recall FROM pr",
    "chain_recall": _TOP10 + " SELECT round(avg(recall), 9) AS mean_recall FROM pr",
    "answer_hit": f"WITH q AS (SELECT query_id, list_filter(list_distinct(regexp_split_to_array(trim({_CLEAN}), '\\s+')), lambda w: length(w) > 2 AND regexp_full_match(w, '[a-z]+')) AS terms FROM recall_queries WHERE query_text IS NOT NULL), r AS (SELECT DISTINCT c.query_id, coalesce(a.payload, '') AS payload FROM recall_candidates c JOIN atoms a ON a.id = c.atom_id) SELECT q.query_id, coalesce(bool_or(len(list_filter(q.terms, lambda t: NOT contains(lower(coalesce(r.payload, '')), t))) = 0), false) AS hit FROM q LEFT JOIN r ON r.query_id = q.query_id GROUP BY q.query_id",
    "stream_epoch_flush": "SELECT epoch_id, count(*) AS atoms FROM atoms GROUP BY epoch_id",
    "stream_windows": "SELECT epoch_us(date_trunc('day', ts)) AS day_us, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
    "stream_latest_state": "SELECT user_id, event_type, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id, event_type",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
