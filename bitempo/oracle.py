"""The test data's graph in DuckDB SQL, for the oracles."""

BASE = """
WITH pref AS (
  SELECT o_custkey AS c, o_orderkey AS k, o_orderpriority AS value, previous, o_orderdate AS begin_at,
         lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS end_at
  FROM (SELECT *, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM orders)
  WHERE previous IS NULL OR previous <> o_orderpriority
),
usr AS (SELECT user_id, count(*) AS n, max(ts) AS seen FROM events GROUP BY user_id),
raw_nodes AS (
  SELECT 'region:' || r_regionkey AS id, 'REGION' AS type, r_name AS name, NULL::VARCHAR AS owner_id, 'shared' AS scope, 'hot' AS tier, 0.5::DOUBLE AS importance,
         TIMESTAMP '1990-01-01' AS valid_from, NULL::TIMESTAMP AS valid_until, TIMESTAMP '1990-01-01' AS learned_at, TIMESTAMP '1990-01-01' AS last_accessed_at, 0::BIGINT AS access_count, '{}' AS attrs_json FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'NATION', n_name, NULL, 'shared', 'hot', 0.5, TIMESTAMP '1990-01-01', NULL, TIMESTAMP '1990-01-01', TIMESTAMP '1990-01-01', 0, '{}' FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'CUSTOMER', c_name, CASE WHEN c_custkey % 5 = 0 THEN 'u' || (c_custkey % 3) END, CASE WHEN c_custkey % 5 = 0 THEN 'private' ELSE 'shared' END,
         CASE WHEN c_custkey % 4 = 0 THEN 'warm' ELSE 'hot' END, round(least(1.0, greatest(0.0, (c_acctbal + 1000) / 11000)), 6), TIMESTAMP '1990-01-01', CASE WHEN c_custkey % 7 = 0 THEN TIMESTAMP '1998-01-01' END, TIMESTAMP '1990-01-01',
         CASE WHEN c_custkey % 8 = 0 THEN TIMESTAMP '2023-12-01' ELSE TIMESTAMP '2024-01-15' END, 0, '{"segment":"' || c_mktsegment || '","level":' || (c_custkey % 10) || '}' FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'SUPPLIER', s_name, NULL, 'shared', 'hot', 0.5, TIMESTAMP '1990-01-01', NULL, TIMESTAMP '1990-01-01', TIMESTAMP '1990-01-01', 0, '{}' FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'PART', p_name, CASE WHEN p_partkey % 5 = 0 THEN 'u' || (p_partkey % 3) END, CASE WHEN p_partkey % 5 = 0 THEN 'private' ELSE 'shared' END, 'hot', 0.5, TIMESTAMP '1990-01-01', NULL, TIMESTAMP '1990-01-01', TIMESTAMP '1990-01-01', 0,
         '{"brand":"' || p_brand || '","size":' || p_size || '}' FROM part
  UNION ALL SELECT 'order:' || o_orderkey, 'ORDER', 'o' || o_orderkey, NULL, 'shared', 'hot', 0.5, o_orderdate, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 120 DAY END, o_orderdate + INTERVAL 30 DAY, o_orderdate, 0, '{}' FROM orders
  UNION ALL SELECT 'user:' || user_id, 'USER', 'user' || user_id, NULL, 'shared', CASE WHEN seen < TIMESTAMP '2024-01-29' THEN 'warm' ELSE 'hot' END, 0.5, TIMESTAMP '1990-01-01', NULL, TIMESTAMP '1990-01-01', seen, n, '{}' FROM usr
  UNION ALL SELECT DISTINCT 'priority:' || o_orderpriority, 'PRIORITY', o_orderpriority, NULL, 'shared', 'hot', 0.5, TIMESTAMP '1990-01-01', NULL::TIMESTAMP, TIMESTAMP '1990-01-01', TIMESTAMP '1990-01-01', 0, '{}' FROM orders
),
nodes AS (SELECT *, lower(trim(name)) AS canonical_name, valid_from AS created_at FROM raw_nodes),
links AS (
  SELECT 'LOCATED_IN:c' || c_custkey AS id, 'customer:' || c_custkey AS source_id, 'nation:' || c_nationkey AS target_id, 'LOCATED_IN' AS relation_type, 'doc:' || (c_custkey % 200) AS source_ref, 1.0::DOUBLE AS confidence_score,
         'source_grounded' AS confidence_class, TIMESTAMP '1990-01-01' AS valid_from, NULL::TIMESTAMP AS valid_until, TIMESTAMP '1990-01-01' AS learned_at, c_custkey % 5 = 0 AS cross_scope FROM customer
  UNION ALL SELECT 'LOCATED_IN:s' || s_suppkey, 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'LOCATED_IN', 'doc:' || (s_suppkey % 200), 1.0, 'source_grounded', TIMESTAMP '1990-01-01', NULL, TIMESTAMP '1990-01-01', false FROM supplier
  UNION ALL SELECT 'PART_OF:' || n_nationkey, 'nation:' || n_nationkey, 'region:' || n_regionkey, 'PART_OF', 'doc:' || (n_nationkey % 200), 1.0, 'source_grounded', TIMESTAMP '1990-01-01', NULL, TIMESTAMP '1990-01-01', false FROM nation
  UNION ALL SELECT 'PLACED:' || o_orderkey, 'customer:' || o_custkey, 'order:' || o_orderkey, 'PLACED', 'doc:' || (o_orderkey % 200), 1.0, 'source_grounded', o_orderdate, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 120 DAY END, o_orderdate, o_custkey % 5 = 0 FROM orders
  UNION ALL SELECT 'CONTAINS:' || l_orderkey || ':' || l_linenumber, 'order:' || l_orderkey, 'part:' || l_partkey, 'CONTAINS', 'doc:' || (l_orderkey % 200), round(1 - l_discount, 6), 'source_grounded', l_shipdate - INTERVAL 60 DAY, NULL, l_shipdate, l_partkey % 5 = 0 FROM lineitem
  UNION ALL SELECT 'SUPPLIES:' || l_suppkey || ':' || l_partkey, 'supplier:' || l_suppkey, 'part:' || l_partkey, 'SUPPLIES', 'doc:' || (l_partkey % 200), 0.8, 'source_grounded', min(l_shipdate), NULL, min(l_shipdate), l_partkey % 5 = 0 FROM lineitem GROUP BY l_suppkey, l_partkey
  UNION ALL SELECT 'PREFERS:' || c || ':' || k, 'customer:' || c, 'priority:' || value, 'PREFERS', 'doc:' || (k % 200), 0.8, 'source_grounded', begin_at, end_at, begin_at, c % 5 = 0 FROM pref
  UNION ALL SELECT 'CONTRADICTS:' || c || ':' || k, 'priority:' || value, 'priority:' || previous, 'CONTRADICTS', 'doc:' || (k % 200), 0.9, 'inferred', begin_at, NULL, begin_at, false FROM pref WHERE previous IS NOT NULL
),
edges AS (SELECT *, learned_at AS detected_at FROM links),
sources AS (SELECT 'doc:' || doc_id AS id, text AS content, sha256(text) AS content_hash FROM documents),
vectors AS (SELECT 'customer:' || (vec_id + 1) AS entity_id, embedding AS vector FROM embeddings),
triples AS (SELECT 't:' || c || ':' || k AS id, 'customer:' || c AS subject_id, 'PREFERS' AS predicate, 'priority:' || value AS object_id, 'PREFERS:' || c || ':' || k AS edge_id, lower(c_name) || '|PREFERS|' || lower(value) AS fingerprint, begin_at AS valid_from FROM pref JOIN customer ON c = c_custkey)
"""


def with_base(sql: str) -> str:
    """A query over the graph's tables; further WITH clauses of the query follow the base's."""
    sql = sql.strip()
    return BASE.rstrip() + (",\n" + sql[4:].lstrip() if sql[:5].upper() == "WITH " else "\n" + sql)
