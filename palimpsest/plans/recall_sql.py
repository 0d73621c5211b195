"""The recall pipeline in SQL, put together from named steps."""

from __future__ import annotations

MAX_HOPS = 3

_SIM = """round(list_dot_product(a.embedding::DOUBLE[], q.query_emb::DOUBLE[]) /
  (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(q.query_emb::DOUBLE[], q.query_emb::DOUBLE[])) + 1e-10), 9)"""

ATOMS = "a0 AS (SELECT id, payload, embedding, triples, created_at, access_count, epoch_id FROM atoms UNION ALL SELECT id, payload, embedding, triples, created_at, access_count, epoch_id FROM pinned_atoms)"

BASE = f"""WITH {ATOMS},
i0 AS (SELECT DISTINCT entity, atom_id, epoch_id FROM kg_index WHERE entity <> '' AND atom_id IS NOT NULL),
ix AS (SELECT DISTINCT entity, atom_id FROM i0),
q AS (SELECT query_id, query_emb, coalesce(top_k, 5) AS top_k, coalesce(expand_hops, 1) AS hops,
  coalesce(list_distinct(list_filter(query_entities, lambda e: e IS NOT NULL)), []) AS qe FROM recall_queries),
tr AS (SELECT id, created_at, unnest(triples) AS t FROM a0),
en AS (SELECT DISTINCT id AS atom_id, entity FROM (SELECT id, t.subj AS entity FROM tr UNION ALL SELECT id, t.obj FROM tr) WHERE entity <> ''),
good AS (SELECT id, epoch_id, embedding FROM a0 WHERE len(embedding) > 0 AND isfinite(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))))),
pool AS (SELECT q.query_id, a.id AS atom_id, a.epoch_id, {_SIM} AS sim FROM q JOIN good a ON len(a.embedding) = len(q.query_emb)
  QUALIFY row_number() OVER (PARTITION BY q.query_id, a.epoch_id ORDER BY sim DESC, a.id) <= q.top_k * 10),
boot AS (SELECT DISTINCT b.query_id, en.entity FROM (SELECT query_id, atom_id, sim FROM pool WHERE epoch_id = 'active'
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, atom_id) <= 2) b JOIN q USING (query_id) JOIN en USING (atom_id) WHERE b.sim > 0.5 AND len(q.qe) = 0),
named AS (SELECT query_id, unnest(qe) AS entity FROM q UNION SELECT query_id, entity FROM boot),
seed AS (SELECT DISTINCT n.query_id, ix.atom_id FROM named n JOIN ix USING (entity) WHERE ix.atom_id IN (SELECT id FROM a0)),
v0 AS (SELECT query_id, atom_id, min(stage) AS stage FROM (SELECT query_id, atom_id, CASE WHEN epoch_id = 'active' THEN 0 ELSE 2 END AS stage FROM pool
  UNION ALL SELECT query_id, atom_id, 1 FROM seed) GROUP BY query_id, atom_id),
f0 AS (SELECT query_id, atom_id FROM v0)"""


def _hops() -> str:
    steps, known = [], ["SELECT query_id, entity FROM named"]
    for h in range(1, MAX_HOPS + 1):
        p = h - 1
        steps.append(f"""e{h} AS (SELECT DISTINCT f.query_id, en.entity FROM f{p} f JOIN q ON q.query_id = f.query_id AND q.hops >= {h} JOIN en ON en.atom_id = f.atom_id),
f{h} AS (SELECT DISTINCT e.query_id, ix.atom_id FROM e{h} e JOIN ix USING (entity) WHERE ix.atom_id IN (SELECT id FROM a0)
  AND NOT EXISTS (SELECT 1 FROM v{p} v WHERE v.query_id = e.query_id AND v.atom_id = ix.atom_id)),
v{h} AS (SELECT * FROM v{p} UNION ALL SELECT query_id, atom_id, {2 + h} FROM f{h})""")
        known.append(f"SELECT query_id, entity FROM e{h}")
    steps.append("known AS (" + " UNION ".join(known) + ")")
    return ",\n" + ",\n".join(steps)


CANDIDATES = BASE + _hops()

RANKED = CANDIDATES + f""",
c0 AS (SELECT v.query_id, v.atom_id, v.stage, a.payload, a.created_at, a.triples,
  coalesce(CASE WHEN g.id IS NOT NULL AND len(a.embedding) = len(q.query_emb) THEN {_SIM} END, 0.0) AS sim
  FROM v{MAX_HOPS} v JOIN a0 a ON a.id = v.atom_id JOIN q ON q.query_id = v.query_id LEFT JOIN good g ON g.id = v.atom_id),
c AS (SELECT * FROM c0 QUALIFY row_number() OVER (PARTITION BY query_id, coalesce(payload, 'None') ORDER BY stage, sim DESC, created_at DESC, atom_id) = 1),
ct AS (SELECT query_id, atom_id, created_at, unnest(triples) AS t FROM c),
own AS (SELECT query_id, atom_id, first_value(atom_id) OVER (PARTITION BY query_id, lower(t.subj), lower(t.pred) ORDER BY created_at DESC, atom_id DESC) <> atom_id AS old
  FROM ct WHERE t.subj IS NOT NULL AND t.pred IS NOT NULL),
old AS (SELECT query_id, atom_id FROM own GROUP BY query_id, atom_id HAVING bool_or(old)),
ov AS (SELECT c.query_id, c.atom_id, count(*) AS overlap FROM c JOIN en USING (atom_id) JOIN known k ON k.query_id = c.query_id AND k.entity = en.entity GROUP BY c.query_id, c.atom_id),
dg AS (SELECT entity, count(*) AS degree FROM i0 GROUP BY entity),
ql AS (SELECT u.query_id, lower(u.entity) AS low, coalesce(dg.degree, 0) > 5 AS broad FROM (SELECT query_id, unnest(qe) AS entity FROM q) u LEFT JOIN dg USING (entity)),
lock AS (SELECT DISTINCT ct.query_id, ct.atom_id FROM ct JOIN ql ON ql.query_id = ct.query_id
  WHERE contains(lower(t.pred), low) OR (NOT broad AND (lower(t.subj) = low OR lower(t.obj) = low)) OR (length(low) >= 4 AND contains(lower(t.pred), low[1:4]))),
r AS (SELECT c.query_id, c.atom_id, c.sim, c.created_at, coalesce(ov.overlap, 0) AS overlap, old.atom_id IS NOT NULL AS is_superseded,
  CASE WHEN lock.atom_id IS NOT NULL THEN 20.0::DOUBLE ELSE 0.0::DOUBLE END AS boost,
  row_number() OVER (PARTITION BY c.query_id ORDER BY c.sim DESC, c.stage, c.created_at DESC, c.atom_id) - 1 AS semantic_rank,
  row_number() OVER (PARTITION BY c.query_id ORDER BY c.created_at DESC, c.atom_id DESC) - 1 AS recency_rank,
  c.query_id IN (SELECT query_id FROM known) AS knows,
  CASE WHEN c.query_id IN (SELECT query_id FROM known) THEN row_number() OVER (PARTITION BY c.query_id ORDER BY coalesce(ov.overlap, 0) DESC, c.created_at DESC, c.atom_id DESC) - 1 ELSE 0 END AS entity_rank
  FROM c LEFT JOIN ov ON ov.query_id = c.query_id AND ov.atom_id = c.atom_id LEFT JOIN old ON old.query_id = c.query_id AND old.atom_id = c.atom_id
  LEFT JOIN lock ON lock.query_id = c.query_id AND lock.atom_id = c.atom_id),
s AS (SELECT *, 2.0::DOUBLE / (semantic_rank + 60) + 1.0::DOUBLE / (recency_rank + 60) + 1.0::DOUBLE / (entity_rank + 60) AS rrf FROM r),
s1 AS (SELECT *, (rrf + boost) * CASE WHEN is_superseded THEN 1e-4 ELSE 1.0::DOUBLE END AS raw FROM s),
s2 AS (SELECT *, CASE WHEN max(raw) OVER (PARTITION BY query_id) >= 20 AND raw < 20 THEN raw * 1e-7 ELSE raw END AS score FROM s1),
z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 15) DESC, CASE WHEN knows THEN overlap ELSE 0 END DESC, created_at DESC, atom_id DESC) AS position FROM s2)"""
