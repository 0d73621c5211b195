"""The pN_ queries of this subpackage, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.payload import decoded_text
from palimpsest.llm import identical, language, leakage, neighbours, personal, ranking, similar, tokens
from palimpsest.sources.tables import table


def _classes(spark: SparkSession, d: str) -> DataFrame:
    return identical.formatting_classes(table(spark, d, "atoms"))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    return _classes(spark, d).drop("class_key")


def p1_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return identical.collapsed(_classes(spark, d))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return identical.pairs_within(_classes(spark, d))


def _dim(spark: SparkSession, d: str) -> int:
    return int(table(spark, d, "store_metadata").first()["dim"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = neighbours.neighbours(table(spark, d, "atoms"), _dim(spark, d), k=5, least=0.90)
    return neighbours.pairs(found)


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Queries: the rows whose id's hash is divisible by 50; searched over all rows."""
    atoms = table(spark, d, "atoms")
    asked = atoms.where(F.pmod(F.crc32("id"), F.lit(50)) == 0).select(F.col("id").alias("rec"))
    return neighbours.neighbours(atoms, _dim(spark, d), k=5, recall=0.95, queries=asked).withColumn("similarity", F.round("similarity", 6))


def p2_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the search, on queries that took no part in its calibration."""
    return neighbours.measured(table(spark, d, "atoms"), _dim(spark, d), k=5, recall=0.95)


def _personal(spark: SparkSession, d: str) -> DataFrame:
    return personal.personal_spans(table(spark, d, "atoms"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _personal(spark, d).select(F.col("rec").alias("atom_id"), "kind", F.col("span").alias("span_text")).distinct()


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    return personal.redacted(table(spark, d, "atoms"), personal.text_spans(table(spark, d, "atoms")))


SCORES = ["access", "created", "likeness"]


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return ranking.recall_scores(table(spark, d, "atoms"), table(spark, d, "recall_queries"), table(spark, d, "recall_candidates"))


def p5_ranking(spark: SparkSession, d: str) -> DataFrame:
    placed = ranking.fused_ranking(_scores(spark, d), "query_id", "atom_id", SCORES)
    return placed.withColumn("likeness", F.round("likeness", 6)).withColumn("projection", F.round("projection", 6))


def p5_loadings(spark: SparkSession, d: str) -> DataFrame:
    """Weights of the scores, and whether each agrees with its declared direction."""
    return ranking.loadings(_scores(spark, d), "query_id", "atom_id", SCORES).withColumn("loading", F.round("loading", 6))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Heads on every score: fewer than 5 candidates are strictly better."""
    return ranking.heads(_scores(spark, d), "query_id", "atom_id", SCORES, 5)


def _similar(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    atoms = table(spark, d, "atoms").where(F.col("payload").isNotNull())
    p = F.col("payload")
    return similar.similar_sets(atoms.select(F.col("id").alias("rec"), identical.formatting_key(p).alias("grp"), decoded_text(p).alias("text")), least=0.70)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return similar.near_pairs(*_similar(spark, d))


def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    return similar.classes(*_similar(spark, d))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encoded(table(spark, d, "documents"))


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_leaks(spark, d).select("doc_id", "item_id").distinct()


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """The test items that leaked, with the number of pages that carry them."""
    return p9_leaks(spark, d).groupBy("item_id").agg(F.countDistinct("doc_id").alias("pages"))


def p10_passages(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return language.passages(docs, language.fit_on(docs)).withColumn("confidence", F.round("confidence", 4))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return language.unnamed(docs, language.passages(docs, language.fit_on(docs)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_classes, p1_collapsed, p2_found, p2_neighbours, p2_recall, p3_found, p3_redacted, p5_found, p5_ranking, p5_loadings, p6_found, p6_classes, p8_ids, p9_found, p9_leaks, p9_items, p10_found, p10_passages)}


_P1_CANON = r"""
WITH t AS (SELECT id, payload, CASE WHEN json_valid(payload) THEN json_type(payload) END AS kind FROM atoms WHERE payload IS NOT NULL),
f AS (
  SELECT id, '' AS k, CASE WHEN kind = 'VARCHAR' THEN payload ->> '$' ELSE payload END AS v FROM t WHERE kind IS NULL OR kind <> 'OBJECT'
  UNION ALL
  SELECT t.id, j.key AS k, coalesce(j.value ->> '$', '') AS v FROM t, json_each(t.payload) j WHERE kind = 'OBJECT'),
c AS (SELECT id, regexp_replace(lower(upper(k)), '[^\p{L}\p{N}]+', '', 'g') || chr(1) || regexp_replace(lower(upper(v)), '[^\p{L}\p{N}]+', '', 'g') AS p,
  regexp_replace(v, '[^\p{L}\p{N}]+', '', 'g') <> '' AS has FROM f),
r AS (SELECT id, list_sort(list(DISTINCT p)) AS canon FROM c GROUP BY id HAVING bool_or(has))"""

_P6_PAIRS = _P1_CANON + r""",
d AS (SELECT id, CASE WHEN kind = 'OBJECT' THEN payload ->> '$.content' WHEN kind = 'VARCHAR' THEN payload ->> '$' ELSE payload END AS txt FROM t),
w AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(txt), '[\p{L}\p{N}]+')) AS word FROM d),
n AS (SELECT id, count(*) AS n FROM w GROUP BY id),
m AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS n_shared FROM w a JOIN w b ON a.word = b.word AND a.id < b.id GROUP BY a.id, b.id),
g AS (SELECT id_a, id_b FROM m JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE n_shared >= 0.70 * (x.n + y.n - n_shared))"""

# groups of similar word sets: the least id of every set stands for it, and is spread along the links
_P6_CLASSES = _P1_CANON.replace("WITH t AS", "WITH RECURSIVE t AS", 1) + r""",
d AS (SELECT id, CASE WHEN kind = 'OBJECT' THEN payload ->> '$.content' WHEN kind = 'VARCHAR' THEN payload ->> '$' ELSE payload END AS txt FROM t),
w AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(txt), '[\p{L}\p{N}]+')) AS word FROM d),
s AS (SELECT id, list_sort(list(word)) AS ws FROM w GROUP BY id),
nd AS (SELECT ws, min(id) AS lab FROM s GROUP BY ws),
nw AS (SELECT lab, len(ws) AS n, unnest(ws) AS word FROM nd),
lk AS (SELECT a.lab AS a, b.lab AS b FROM nw a JOIN nw b ON a.word = b.word AND a.lab <> b.lab GROUP BY a.lab, b.lab, a.n, b.n HAVING count(*) >= 0.70 * (a.n + b.n - count(*))),
cc AS (SELECT lab AS x, lab AS y FROM nd UNION SELECT cc.x, lk.b FROM cc JOIN lk ON lk.a = cc.y),
ci AS (SELECT x, min(y) AS class_id FROM cc GROUP BY x),
dg AS (SELECT a, count(*) AS n_links FROM lk GROUP BY a)"""

_COSINE = "CASE WHEN len(a.embedding) = len(q.query_emb) AND list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) > 0 THEN list_dot_product(a.embedding::DOUBLE[], q.query_emb::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(q.query_emb::DOUBLE[], q.query_emb::DOUBLE[])) END"


_P5 = f"""
WITH RECURSIVE p AS (SELECT DISTINCT query_id, atom_id FROM recall_candidates WHERE query_id IS NOT NULL AND atom_id IS NOT NULL),
s AS (SELECT p.query_id, p.atom_id, coalesce(a.access_count, 0) AS access, epoch_us(a.created_at) AS created, {_COSINE} AS c
  FROM p JOIN atoms a ON a.id = p.atom_id JOIN recall_queries q ON q.query_id = p.query_id),
f AS (SELECT *, CASE WHEN isnan(c) THEN NULL ELSE c END AS likeness FROM s),
r AS (SELECT query_id, atom_id, access, created, likeness, rank() OVER (PARTITION BY query_id ORDER BY access DESC) AS ra,
  rank() OVER (PARTITION BY query_id ORDER BY created DESC NULLS LAST) AS rb,
  rank() OVER (PARTITION BY query_id ORDER BY likeness DESC NULLS LAST) AS rc, count(*) OVER (PARTITION BY query_id) AS n FROM f)"""

# the first eigenvector of the 3 x 3 correlation matrix, by squaring the matrix again and again
_P5_WEIGHTS = """,
u AS (SELECT *, 1 - (ra - 1) / n AS x, 1 - (rb - 1) / n AS y, 1 - (rc - 1) / n AS z FROM r),
m(k, a, b, c, d, e, f) AS (SELECT 0, 1.0::DOUBLE, corr(x, y), corr(x, z), 1.0::DOUBLE, corr(y, z), 1.0::DOUBLE FROM u
  UNION ALL SELECT k + 1, (a*a + b*b + c*c) / t, (a*b + b*d + c*e) / t, (a*c + b*e + c*f) / t, (b*b + d*d + e*e) / t, (b*c + d*e + e*f) / t, (c*c + e*e + f*f) / t
    FROM (SELECT *, a*a + d*d + f*f + 2 * (b*b + c*c + e*e) AS t FROM m) WHERE k < 40),
v AS (SELECT CASE WHEN a >= d AND a >= f THEN [a, b, c] WHEN d >= f THEN [b, d, e] ELSE [c, e, f] END AS v FROM m WHERE k = 40),
w AS (SELECT v[1] / l AS x0, v[2] / l AS x1, v[3] / l AS x2 FROM (SELECT v, sqrt(list_dot_product(v, v)) * CASE WHEN list_sum(v) < 0 THEN -1 ELSE 1 END AS l FROM v))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1_CANON + " SELECT a.id AS id_a, b.id AS id_b FROM r a JOIN r b ON a.canon = b.canon AND a.id < b.id",
        "p1_classes": _P1_CANON + " SELECT id AS rec, min(id) OVER (PARTITION BY canon) AS class_id, count(*) OVER (PARTITION BY canon) AS class_size FROM r",
        "p1_collapsed": _P1_CANON + " SELECT min(id) AS class_id, count(*) AS copies FROM r GROUP BY canon",
        "p2_found": """
            WITH u AS (SELECT id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM atoms WHERE len(embedding) = 64),
            v AS (SELECT id, e, n FROM u WHERE isfinite(n) AND n > 0),
            s AS (SELECT a.id AS x, b.id AS y, list_dot_product(a.e, b.e) / (a.n * b.n) AS c FROM v a JOIN v b ON a.id <> b.id),
            k AS (SELECT x, y FROM s WHERE c >= 0.9 QUALIFY row_number() OVER (PARTITION BY x ORDER BY c DESC, y) <= 5)
            SELECT DISTINCT least(x, y) AS id_a, greatest(x, y) AS id_b FROM k""",
        "p6_found": _P6_PAIRS + " SELECT id_a, id_b FROM g LEFT JOIN r a ON a.id = id_a LEFT JOIN r b ON b.id = id_b WHERE a.canon IS DISTINCT FROM b.canon",
        "p6_classes": _P6_CLASSES + " SELECT s.id AS rec, ci.class_id, coalesce(dg.n_links, 0) AS n_links FROM s JOIN nd USING (ws) JOIN ci ON ci.x = nd.lab LEFT JOIN dg ON dg.a = nd.lab",
        "p5_found": _P5 + " SELECT query_id, atom_id FROM r WHERE ra <= 5 AND rb <= 5 AND rc <= 5",
        "p5_ranking": _P5 + _P5_WEIGHTS + """
            SELECT query_id, atom_id, access, created, round(likeness, 6) AS likeness, ra AS access_rank, rb AS created_rank, rc AS likeness_rank, round(p, 6) AS projection,
              row_number() OVER (PARTITION BY query_id ORDER BY p DESC, atom_id) AS position
            FROM (SELECT u.*, round(x * w.x0 + y * w.x1 + z * w.x2, 9) AS p FROM u, w)""",
        "p5_loadings": _P5 + _P5_WEIGHTS + """
            SELECT 'access' AS score, round(x0, 6) AS loading, x0 >= 0 AS agrees FROM w UNION ALL SELECT 'created', round(x1, 6), x1 >= 0 FROM w UNION ALL SELECT 'likeness', round(x2, 6), x2 >= 0 FROM w""",
    }
