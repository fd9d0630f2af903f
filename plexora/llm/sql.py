"""SQL twins of the llm queries, where SQL can express them on whole tables."""

_P4 = """
WITH every AS (
  SELECT track_id AS id, coalesce(meta.version, -1) AS o, embedding AS v FROM bundle_points WHERE snapshot_no = 5
  UNION ALL SELECT id, coalesce(shard, -1), vector FROM cdn_points
), latest AS (SELECT id, arg_max(struct_pack(v := v), o).v AS v FROM every WHERE id IS NOT NULL GROUP BY id
), vecs AS (
  SELECT id, CAST(v AS DOUBLE[64]) AS v FROM latest
  WHERE len(v) = 64 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), sims AS (SELECT a.id AS a, b.id AS b, array_cosine_similarity(a.v, b.v) AS s FROM vecs a, vecs b WHERE a.id <> b.id
), top AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS rn FROM sims WHERE s >= 0.85) WHERE rn <= 5)
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM top
"""

SQL = {"p4_found": _P4}
