"""A query for each operator over the test tables, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import numbers as N
from .functions import text as T
from .functions.embed import bag_of_words, reembed
from .model import SCHEMAS, at, empty, identity, in_scope, moment, same
from .operators import catalog as C
from .operators import code as CO
from .operators import dml as D
from .operators import graph as G
from .operators import ingest as I
from .operators import lifecycle as L
from .operators import maintain as M
from .operators import retrieval as R
from .operators import scans as S
from .operators import vectors as V
from .oracle import with_base
from .plans.cypher import cypher
from .plans.views import Views
from .snapshot import Snapshot
from .sources import files, testdata
from .sources.store import Store, cut, open_readonly, shared_folder
from .sources.testdata import NOW
from .streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def on_graph(name: str, sql: str | None = None):
    """Register a function of the graph; its SQL stands on the graph's tables."""

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(testdata.graph(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = with_base(sql)
        return f

    return put


def on_tables(name: str, sql: str | None = None):
    """Register a function of (table reader); its SQL stands on the test tables."""

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(lambda t: testdata.table(spark, sf_dir, t))
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


def text(c: str):
    return F.col(c).cast("string").alias(c)


# --- scans ------------------------------------------------------------------------------------------------

on_graph("sc1_list_entities", "SELECT id, type, name FROM nodes WHERE valid_until IS NULL AND (scope = 'shared' OR (scope = 'private' AND owner_id = 'u1'))")(lambda g: S.list_entities(g.seen_by("all", "u1")).select("id", "type", "name"))
on_graph("sc2_entity_ids", "SELECT id FROM nodes WHERE scope = 'private' AND owner_id = 'u2'")(lambda g: S.entity_ids(g.seen_by("private", "u2").with_retired()))
on_graph("sc3_get_entity", "SELECT id, name, importance, attrs_json FROM nodes WHERE id = 'customer:7'")(lambda g: S.get_entity(g, "customer:7").select("id", "name", "importance", "attrs_json"))
on_graph("sc4_entities_at_valid", "SELECT id, name FROM nodes WHERE valid_from <= TIMESTAMP '1997-06-01' AND (valid_until IS NULL OR valid_until > TIMESTAMP '1997-06-01') AND scope = 'shared'")(
    lambda g: S.entities_at(g.seen_by("shared"), "1997-06-01").select("id", "name")
)
on_graph("sc4_entities_at_learned", "SELECT id, name FROM nodes WHERE learned_at <= TIMESTAMP '1996-03-01'")(lambda g: S.entities_at(g, "1996-03-01", "learned").select("id", "name"))
on_graph("sc5_edges_from", "SELECT id, target_id FROM edges WHERE source_id = 'customer:3' AND relation_type = 'PLACED' AND valid_until IS NULL")(lambda g: S.edges_from(g, "customer:3", "PLACED").select("id", "target_id"))
on_graph("sc6_edges_to", "SELECT id, source_id FROM edges WHERE target_id = 'nation:3' AND valid_until IS NULL")(lambda g: S.edges_to(g, "nation:3").select("id", "source_id"))
on_graph(
    "sc7_edges_in_scope",
    "WITH seen AS (SELECT id FROM nodes WHERE valid_until IS NULL AND scope = 'shared') SELECT id, relation_type FROM edges WHERE valid_until IS NULL AND relation_type <> 'CONTRADICTS' AND source_id IN (SELECT id FROM seen) AND target_id IN (SELECT id FROM seen)",
)(lambda g: S.edges_in_scope(g.seen_by("shared")).select("id", "relation_type"))
on_graph(
    "sc7_edges_in_scope_with_retired",
    "WITH seen AS (SELECT id FROM nodes WHERE scope = 'shared') SELECT relation_type, count(*) AS n FROM edges WHERE relation_type <> 'CONTRADICTS' AND source_id IN (SELECT id FROM seen) AND target_id IN (SELECT id FROM seen) GROUP BY 1",
)(lambda g: S.edges_in_scope(g.seen_by("shared").with_retired()).groupBy("relation_type").agg(F.count("*").alias("n")))
on_graph("sc8_model_embeddings", "SELECT entity_id, len(vector)::INTEGER AS dim FROM vectors")(lambda g: S.model_embeddings(g, "given", "1").select("entity_id", "dim"))
on_graph("sc9_get_embedding", "SELECT entity_id, round(vector[1]::DOUBLE, 6) AS x FROM vectors WHERE entity_id = 'customer:5'")(lambda g: S.get_embedding(g, "customer:5", "given", "1").select("entity_id", F.round(F.get("vector", F.lit(0)).cast("double"), 6).alias("x")))
on_graph("sc10_find_entity", "SELECT id FROM nodes WHERE canonical_name = lower(trim(' Nation_3 ')) AND type = 'NATION' AND valid_until IS NULL ORDER BY created_at, id LIMIT 1")(lambda g: S.find_code_entity(g, " Nation_3 ", kind="NATION").select("id"))
on_graph("sc11_find_anchor", "SELECT id, access_count FROM nodes WHERE canonical_name = 'user7' AND valid_until IS NULL ORDER BY access_count DESC, importance DESC, created_at, id LIMIT 1")(lambda g: S.find_anchor(g, "USER7").select("id", "access_count"))
on_graph("sc12_known_fingerprints", "SELECT DISTINCT fingerprint FROM triples WHERE fingerprint LIKE '%|PREFERS|1-urgent'")(
    lambda g: S.known_fingerprints(g.entities.where("type = 'CUSTOMER'").select(F.concat(F.lower("name"), F.lit("|PREFERS|1-urgent")).alias("fingerprint")), g.triples).distinct()
)
on_graph("sc13_source_by_hash", "SELECT s.id FROM sources s WHERE s.content_hash = (SELECT content_hash FROM sources WHERE id = 'doc:3')")(lambda g: g.sources.join(g.sources.where("id = 'doc:3'").select("content_hash"), "content_hash", "left_semi").select("id"))
on_graph("sc19_tables", "SELECT * FROM (VALUES ('entities', 20), ('edges', 15), ('sources', 6)) t(name, columns)")(
    lambda g: g.entities.sparkSession.createDataFrame([(n, len(df.columns)) for n, df in (("entities", g.entities), ("edges", g.edges), ("sources", g.sources))], "name string, columns int")
)
on_tables("sc20_latest_first", "SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, max(ts) AS last_ts, row_number() OVER (ORDER BY max(ts) DESC NULLS LAST, user_id, event_type) AS k FROM events GROUP BY 1, 2) WHERE k <= 20")(
    lambda t: t("events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts")).orderBy(F.desc_nulls_last("last_ts"), "user_id", "event_type").limit(20).drop("last_ts")
)

# --- writes -----------------------------------------------------------------------------------------------

on_graph("dm1_new_sources", "SELECT content_hash, 'text/plain' AS mime_type FROM sources WHERE regexp_matches(id, '[5-9]$') AND content_hash NOT IN (SELECT content_hash FROM sources WHERE regexp_matches(id, '[0-4]$')) GROUP BY content_hash")(
    lambda g: D.new_sources(g.sources.where("id rlike '[0-4]$'"), g.sources.where("id rlike '[5-9]$'").select("content"), NOW).select("content_hash", "mime_type")
)
on_graph("dm2_new_entities", "SELECT lower(name) AS canonical_name, 'CUSTOMER' AS type FROM nodes WHERE type = 'CUSTOMER' AND (valid_until IS NOT NULL OR scope = 'private') GROUP BY 1")(
    lambda g: D.new_entities(g.entities.where("scope = 'shared'"), g.entities.where("type = 'CUSTOMER'").select(F.upper("name").alias("name"), "type", F.lit("shared").alias("scope")), NOW).select("canonical_name", "type")
)


@on_graph("dm3_checked_edges", "SELECT source_id, target_id, cross_scope, NULL::VARCHAR AS reason FROM edges WHERE relation_type = 'LOCATED_IN' UNION ALL SELECT source_id, 'nation:none', NULL::BOOLEAN, 'no target entity' FROM edges WHERE relation_type = 'PART_OF'")
def _(g: Snapshot) -> DataFrame:
    cols = ["source_id", "target_id", "relation_type", "source_ref"]
    more = g.edges.where("relation_type = 'PART_OF'").withColumn("target_id", F.lit("nation:none"))
    good, bad = D.checked_edges(g.edges.where("relation_type = 'LOCATED_IN'").select(cols).unionAll(more.select(cols)), g.entities, g.sources, NOW)
    none = F.lit(None).cast("string").alias("reason")
    return good.select("source_id", "target_id", "cross_scope", none).unionAll(bad.select("source_id", "target_id", F.lit(None).cast("boolean"), "reason"))


on_graph("dm4_new_triples", "SELECT subject_id, object_id FROM triples WHERE valid_from >= TIMESTAMP '2000-01-01'")(lambda g: D.new_triples(g.triples.where("valid_from < timestamp_ntz'2000-01-01'"), g.triples).select("subject_id", "object_id"))
on_graph("dm5_supersede_entities", "SELECT id, CASE WHEN id = 'customer:1' THEN '1999-05-05 00:00:00' ELSE strftime(valid_until, '%Y-%m-%d %H:%M:%S') END AS until FROM nodes WHERE type = 'CUSTOMER'")(
    lambda g: D.supersede(g.entities, g.edges, "customer:1", "customer:2", "doc:1", "1999-05-05 00:00:00")[0].where("type = 'CUSTOMER'").select("id", F.date_format("valid_until", "yyyy-MM-dd HH:mm:ss").alias("until"))
)
on_graph("dm5_supersede_edges", "SELECT 'customer:2' AS source_id, 'customer:1' AS target_id, 1.0::DOUBLE AS confidence_score, false AS cross_scope")(
    lambda g: D.supersede(g.entities, g.edges, "customer:1", "customer:2", "doc:1", "1999-05-05 00:00:00")[1].where("relation_type = 'SUPERSEDES'").select("source_id", "target_id", "confidence_score", "cross_scope")
)
on_graph("dm6_forget", "SELECT id FROM nodes WHERE valid_until IS NULL AND (scope = 'shared' OR owner_id = 'u0') AND canonical_name LIKE 'customer%1'")(
    lambda g: D.forget(g.entities, "customer%1", "all", "u0", NOW)[1].select(F.col("target_id").alias("id"))
)
on_graph("dm7_put_embeddings", "SELECT entity_id, CASE WHEN entity_id LIKE '%9' THEN 2 ELSE len(vector) END::INTEGER AS dim FROM vectors")(
    lambda g: D.put_embeddings(g.embeddings, g.embeddings.where("entity_id like '%9'").withColumns({"vector": F.slice("vector", 1, 2), "dim": F.lit(2), "created_at": F.lit(NOW).cast("timestamp_ntz")})).select("entity_id", "dim")
)
on_graph("dm8_set_tier", "SELECT tier, count(*) AS n FROM (SELECT CASE WHEN type = 'SUPPLIER' THEN 'cold' ELSE tier END AS tier FROM nodes) GROUP BY 1")(lambda g: D.set_tier(g.entities, g.entities.where("type = 'SUPPLIER'"), "cold").groupBy("tier").agg(F.count("*").alias("n")))


@on_graph("dm9_touch", "SELECT id, access_count + CASE WHEN id = 'nation:1' THEN 2 WHEN id = 'nation:2' THEN 1 ELSE 0 END AS access_count FROM nodes WHERE type = 'NATION'")
def _(g: Snapshot) -> DataFrame:
    touches = g.entities.sparkSession.createDataFrame([("nation:1",), ("nation:1",), ("nation:2",)], "id string").withColumn("ts", F.lit(NOW).cast("timestamp_ntz"))
    return R.touched(g.entities, touches).where("type = 'NATION'").select("id", "access_count")


@on_tables("dm10_agents", "SELECT * FROM (VALUES ('ann', 'new'), ('bob', 'old'), ('eve', NULL)) t(name, description)")
def _(t) -> DataFrame:
    spark = t("region").sparkSession
    first = spark.createDataFrame([("ann", "old"), ("bob", "old")], "name string, description string").withColumn("capabilities", F.lit(None).cast("array<string>"))
    then = spark.createDataFrame([("ann", "new"), ("bob", None), ("eve", None)], "name string, description string").withColumn("capabilities", F.lit(None).cast("array<string>"))

    return D.put_agents(D.put_agents(empty(spark, "agents"), first, NOW), then, NOW).select("name", "description")


def _tables(g: Snapshot) -> dict[str, DataFrame]:
    return {"entities": g.entities, "edges": g.edges, "sources": g.sources, "embeddings": g.embeddings, "triples": g.triples}


def _sizes(t: dict[str, DataFrame], names=("entities", "edges", "sources")) -> DataFrame:
    out = None
    for n in names:
        c = t[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
        out = c if out is None else out.unionAll(c)
    return out


_KEPT = """WITH n AS (SELECT * FROM nodes WHERE {n}),
e AS (SELECT * FROM edges WHERE {n} AND source_id IN (SELECT id FROM n) AND target_id IN (SELECT id FROM n)),
s AS (SELECT * FROM sources WHERE id IN (SELECT source_ref FROM e))
SELECT 'entities' AS name, (SELECT count(*) FROM n) AS n UNION ALL SELECT 'edges', (SELECT count(*) FROM e) UNION ALL SELECT 'sources', (SELECT count(*) FROM s)"""
on_graph("dm12_flush_window", _KEPT.format(n="NOT (valid_from < TIMESTAMP '1997-01-01' AND valid_from >= TIMESTAMP '1995-06-01')"))(lambda g: _sizes(L.flush(_tables(g), "1997-01-01", "1995-06-01")))
on_graph("dm13_flush_all", "SELECT * FROM (VALUES ('entities', 0::BIGINT), ('edges', 0), ('sources', 0)) t(name, n)")(lambda g: _sizes(L.flush(_tables(g))))
on_graph("dm14_backup_window", _KEPT.format(n="learned_at < TIMESTAMP '1996-01-01'"))(lambda g: _sizes(L.backup(_tables(g), "1996-01-01", axis="learned")))
on_graph(
    "dm15_merge",
    """WITH n AS (SELECT * FROM nodes WHERE valid_from >= TIMESTAMP '1999-01-01'),
s AS (SELECT * FROM edges WHERE valid_from < TIMESTAMP '1999-01-01' AND source_id IN (SELECT id FROM nodes WHERE valid_from < TIMESTAMP '1999-01-01') AND target_id IN (SELECT id FROM nodes WHERE valid_from < TIMESTAMP '1999-01-01')),
have AS (SELECT DISTINCT source_ref AS id FROM s)
SELECT 'entities' AS "table", (SELECT count(*) FROM n) AS n UNION ALL SELECT 'sources', (SELECT count(*) FROM sources WHERE id NOT IN (SELECT id FROM have))
UNION ALL SELECT 'edges', (SELECT count(*) FROM edges WHERE id NOT IN (SELECT id FROM s) AND source_id IN (SELECT id FROM nodes) AND target_id IN (SELECT id FROM nodes) AND source_ref IN (SELECT id FROM sources))""",
)(lambda g: L.merge_from(L.backup(_tables(g), "1999-01-01"), _tables(g))[1])
on_graph("dm17_inspect", "SELECT 'entities' AS kind, type AS name, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'edges', relation_type, count(*) FROM edges GROUP BY relation_type UNION ALL SELECT 'table', 'entities', (SELECT count(*) FROM nodes) UNION ALL SELECT 'table', 'edges', (SELECT count(*) FROM edges) UNION ALL SELECT 'table', 'sources', (SELECT count(*) FROM sources) UNION ALL SELECT 'table', 'triples', (SELECT count(*) FROM triples) UNION ALL SELECT 'table', 'embeddings', (SELECT count(*) FROM vectors)")(lambda g: L.inspect(_tables(g)))
# --- patterns ---------------------------------------------------------------------------------------------

_CYPHER = {
    "jn1_forward_hop": ("MATCH (c:CUSTOMER)-[:LOCATED_IN]->(n:NATION) WHERE n.name = 'NATION_1' RETURN c.name AS customer, n.name AS nation", "SELECT DISTINCT c.name AS customer, n.name AS nation FROM nodes c JOIN edges e ON e.source_id = c.id JOIN nodes n ON n.id = e.target_id WHERE c.type = 'CUSTOMER' AND n.type = 'NATION' AND e.relation_type = 'LOCATED_IN' AND n.name = 'NATION_1' AND c.valid_until IS NULL AND e.valid_until IS NULL AND n.valid_until IS NULL"),
    "pf1_label": ("MATCH (n:NATION) RETURN n.name AS name", "SELECT DISTINCT name FROM nodes WHERE type = 'NATION' AND valid_until IS NULL"),
    "pf2_property_map": ("MATCH (p:PART {brand: 'Brand#1'}) RETURN p.name AS name", "SELECT DISTINCT name FROM nodes WHERE type = 'PART' AND json_extract_string(attrs_json, '$.brand') = 'Brand#1'"),
    "pf2_property_map_tail": ("MATCH (s:SUPPLIER)-[:SUPPLIES]->(p:PART {scope: 'private', owner_id: 'u1'}) RETURN s.id AS s, p.id AS p", "SELECT DISTINCT s.id AS s, p.id AS p FROM nodes s JOIN edges e ON e.source_id = s.id AND e.relation_type = 'SUPPLIES' JOIN nodes p ON p.id = e.target_id WHERE s.type = 'SUPPLIER' AND p.type = 'PART' AND p.scope = 'private' AND p.owner_id = 'u1'"),
    "pf3_compare": ("MATCH (c:CUSTOMER) WHERE c.importance >= 0.5 AND c.importance < 0.75 AND c.tier <> 'hot' AND c.level > 3 RETURN c.id AS id", "SELECT DISTINCT id FROM nodes WHERE type = 'CUSTOMER' AND valid_until IS NULL AND importance >= 0.5 AND importance < 0.75 AND tier <> 'hot' AND json_extract_string(attrs_json, '$.level')::DOUBLE > 3"),
    "pf3_compare_reversed": ("MATCH (c:CUSTOMER) WHERE 0.9 < c.importance RETURN c.id AS id", "SELECT DISTINCT id FROM nodes WHERE type = 'CUSTOMER' AND valid_until IS NULL AND importance > 0.9"),
    "pf4_contains": ("MATCH (c:CUSTOMER) WHERE c.name CONTAINS 'MER_1' RETURN c.name AS name", "SELECT DISTINCT name FROM nodes WHERE type = 'CUSTOMER' AND valid_until IS NULL AND contains(lower(name), 'mer_1')"),
    "pf4_starts_with": ("MATCH (n:NATION) WHERE n.name STARTS WITH 'nation_2' RETURN n.name AS name", "SELECT DISTINCT name FROM nodes WHERE type = 'NATION' AND starts_with(lower(name), 'nation_2')"),
    "pf4_ends_with": ("MATCH (o:ORDER) WHERE o.name ENDS WITH '77' RETURN o.name AS name", "SELECT DISTINCT name FROM nodes WHERE type = 'ORDER' AND valid_until IS NULL AND name LIKE '%77'"),
    "pf5_in": ("MATCH (n:NATION) WHERE n.name IN ['NATION_1', 'NATION_5', 'nowhere'] RETURN n.id AS id", "SELECT DISTINCT id FROM nodes WHERE name IN ('NATION_1', 'NATION_5', 'nowhere') AND type = 'NATION'"),
    "pf6_not": ("MATCH (c:CUSTOMER) WHERE NOT c.owner_id = 'u1' RETURN c.id AS id", "SELECT DISTINCT id FROM nodes WHERE type = 'CUSTOMER' AND valid_until IS NULL AND NOT (owner_id = 'u1')"),
    "pf7_and_or": ("MATCH (c:CUSTOMER) WHERE c.tier = 'warm' AND (c.segment = 'BUILDING' OR c.importance > 0.9) RETURN c.id AS id", "SELECT DISTINCT id FROM nodes WHERE type = 'CUSTOMER' AND valid_until IS NULL AND tier = 'warm' AND (json_extract_string(attrs_json, '$.segment') = 'BUILDING' OR importance > 0.9)"),
    "pf8_current_guard": ("MATCH (c:CUSTOMER)-[:PLACED]->(o:ORDER) RETURN c.id AS c, o.id AS o", "SELECT DISTINCT c.id AS c, o.id AS o FROM nodes c JOIN edges e ON e.source_id = c.id AND e.relation_type = 'PLACED' JOIN nodes o ON o.id = e.target_id WHERE c.type = 'CUSTOMER' AND c.valid_until IS NULL AND e.valid_until IS NULL AND o.valid_until IS NULL"),
    "pf10_as_of": ("MATCH (c:CUSTOMER)-[:PREFERS]->(p:PRIORITY) RETURN c.id AS c, p.name AS p AS_OF '1997-03-15T02:00:00+02:00'", "SELECT DISTINCT c.id AS c, p.name AS p FROM nodes c JOIN edges e ON e.source_id = c.id AND e.relation_type = 'PREFERS' JOIN nodes p ON p.id = e.target_id WHERE c.type = 'CUSTOMER' AND c.valid_from <= TIMESTAMP '1997-03-15' AND (c.valid_until IS NULL OR c.valid_until > TIMESTAMP '1997-03-15') AND e.valid_from <= TIMESTAMP '1997-03-15' AND (e.valid_until IS NULL OR e.valid_until > TIMESTAMP '1997-03-15')"),
    "pf11_return_columns": ("MATCH (p:PART) WHERE p.size >= 45 RETURN p.name, p.brand AS brand, p.scope AS scope, p.access_count AS uses", "SELECT DISTINCT name AS \"p.name\", json_extract_string(attrs_json, '$.brand') AS brand, scope, access_count AS uses FROM nodes WHERE type = 'PART' AND json_extract_string(attrs_json, '$.size')::DOUBLE >= 45"),
    "pf13_distinct": ("MATCH (c:CUSTOMER)-[:LOCATED_IN]->(n:NATION) RETURN n.name AS nation", "SELECT DISTINCT n.name AS nation FROM nodes c JOIN edges e ON e.source_id = c.id JOIN nodes n ON n.id = e.target_id WHERE c.type = 'CUSTOMER' AND e.relation_type = 'LOCATED_IN' AND c.valid_until IS NULL"),
    "pf14_where_times": ("MATCH (o:ORDER) WHERE o.valid_from >= '2000-01-01' AND o.access_count = 0 RETURN o.id AS id", "SELECT DISTINCT id FROM nodes WHERE type = 'ORDER' AND valid_until IS NULL AND valid_from >= TIMESTAMP '2000-01-01'"),
    "jn2_reverse_hop": ("MATCH (r:REGION)<-[:PART_OF]-(n:NATION) RETURN r.name AS region, n.name AS nation", "SELECT DISTINCT r.name AS region, n.name AS nation FROM nodes r JOIN edges e ON e.target_id = r.id JOIN nodes n ON n.id = e.source_id WHERE r.type = 'REGION' AND n.type = 'NATION' AND e.relation_type = 'PART_OF'"),
    "jn3_three_hops": ("MATCH (s:SUPPLIER)-[:LOCATED_IN]->(n:NATION)-[:PART_OF]->(r:REGION)<-[:PART_OF]-(m:NATION) WHERE r.name = 'ASIA' RETURN s.name AS s, m.name AS m", "SELECT DISTINCT s.name AS s, m.name AS m FROM nodes s JOIN edges a ON a.source_id = s.id AND a.relation_type = 'LOCATED_IN' JOIN nodes n ON n.id = a.target_id JOIN edges b ON b.source_id = n.id AND b.relation_type = 'PART_OF' JOIN nodes r ON r.id = b.target_id JOIN edges d ON d.target_id = r.id AND d.relation_type = 'PART_OF' JOIN nodes m ON m.id = d.source_id WHERE s.type = 'SUPPLIER' AND r.name = 'ASIA'"),
    "jn4_comma_shared": ("MATCH (s:SUPPLIER)-[:LOCATED_IN]->(n:NATION), (c:CUSTOMER)-[:LOCATED_IN]->(n) WHERE n.name = 'NATION_2' RETURN s.id AS s, c.id AS c", "SELECT DISTINCT s.source_id AS s, c.source_id AS c FROM edges s JOIN edges c ON s.target_id = c.target_id JOIN nodes n ON n.id = s.target_id JOIN nodes x ON x.id = c.source_id WHERE s.source_id LIKE 'supplier:%' AND c.source_id LIKE 'customer:%' AND s.relation_type = 'LOCATED_IN' AND c.relation_type = 'LOCATED_IN' AND n.name = 'NATION_2' AND x.valid_until IS NULL"),
    "jn4_comma_cross": ("MATCH (r:REGION), (p:PRIORITY) RETURN r.name AS r, p.name AS p", "SELECT DISTINCT r.name AS r, p.name AS p FROM nodes r, nodes p WHERE r.type = 'REGION' AND p.type = 'PRIORITY'"),
    "jn4_two_matches": ("MATCH (a:NATION)-[:PART_OF]->(r:REGION) MATCH (b:NATION)-[:PART_OF]->(r) WHERE a.name < b.name RETURN a.name AS a, b.name AS b", "SELECT DISTINCT a.name AS a, b.name AS b FROM edges x JOIN edges y ON x.target_id = y.target_id JOIN nodes a ON a.id = x.source_id JOIN nodes b ON b.id = y.source_id WHERE x.relation_type = 'PART_OF' AND y.relation_type = 'PART_OF' AND a.name < b.name"),
    "jn5_cycle": ("MATCH (a:PRIORITY)-[:CONTRADICTS]->(b:PRIORITY)-[:CONTRADICTS]->(a) RETURN a.name AS a, b.name AS b", "SELECT DISTINCT a.name AS a, b.name AS b FROM edges x JOIN edges y ON x.target_id = y.source_id AND y.target_id = x.source_id JOIN nodes a ON a.id = x.source_id JOIN nodes b ON b.id = x.target_id WHERE x.relation_type = 'CONTRADICTS' AND y.relation_type = 'CONTRADICTS'"),
    "jn6_untyped_edge": ("MATCH (s:SUPPLIER)-[e]->(x) WHERE e.confidence_score < 1 AND s.name = 'Supplier#000000005' RETURN e.relation_type AS relation, x.id AS x", "SELECT DISTINCT e.relation_type AS relation, x.id AS x FROM nodes s JOIN edges e ON e.source_id = s.id JOIN nodes x ON x.id = e.target_id WHERE s.type = 'SUPPLIER' AND s.name = 'Supplier#000000005' AND e.confidence_score < 1"),
    "jn6_arrow": ("MATCH (n:NATION)-->(r) RETURN n.id AS n, r.id AS r", "SELECT DISTINCT n.id AS n, e.target_id AS r FROM nodes n JOIN edges e ON e.source_id = n.id WHERE n.type = 'NATION'"),
    "sl1_skip_limit": ("MATCH (n:NATION) RETURN n.name AS name SKIP 5 LIMIT 7", "SELECT name FROM (SELECT DISTINCT name FROM nodes WHERE type = 'NATION') ORDER BY name LIMIT 7 OFFSET 5"),
    "sl1_limit_zero": ("MATCH (n:NATION) RETURN n.name AS name LIMIT 0", "SELECT name FROM nodes WHERE false"),
    "ex1_order_by": ("MATCH (u:USER) RETURN u.name AS name, u.access_count AS uses ORDER BY u.access_count DESC, u.name LIMIT 10", "SELECT name, access_count AS uses FROM nodes WHERE type = 'USER' ORDER BY access_count DESC, name LIMIT 10"),
}
for _name, (_source, _sql) in _CYPHER.items():
    on_graph(_name, _sql)(lambda g, source=_source: cypher(g, source))

on_graph(
    "pf9_scope_guard",
    "SELECT DISTINCT c.id AS c, p.id AS p FROM nodes c JOIN edges a ON a.source_id = c.id AND a.relation_type = 'PLACED' JOIN nodes o ON o.id = a.target_id JOIN edges b ON b.source_id = o.id AND b.relation_type = 'CONTAINS' JOIN nodes p ON p.id = b.target_id WHERE c.valid_until IS NULL AND a.valid_until IS NULL AND o.valid_until IS NULL AND (c.scope = 'shared' OR c.owner_id = 'u2') AND (p.scope = 'shared' OR p.owner_id = 'u2')",
)(lambda g: cypher(g.seen_by("all", "u2"), "MATCH (c:CUSTOMER)-[:PLACED]->(o)-[:CONTAINS]->(p:PART) RETURN c.id AS c, p.id AS p"))
on_graph("pf12_return_node", "SELECT id, type, name, scope, strftime(valid_from, '%Y-%m-%d') AS since FROM nodes WHERE type = 'REGION'")(lambda g: cypher(g, "MATCH (r:REGION) RETURN r").select("r.id", "r.type", "r.name", "r.scope", F.date_format("r.valid_from", "yyyy-MM-dd").alias("since")))
on_graph("pf15_scope_private", "SELECT id FROM nodes WHERE scope = 'private' AND owner_id = 'u0'")(lambda g: g.entities.where(in_scope("private", "u0")).select("id"))
on_graph("pf15_scope_private_nobody", "SELECT id FROM nodes WHERE false")(lambda g: g.entities.where(in_scope("private")).select("id"))
on_graph("pf15_scope_shared", "SELECT id FROM nodes WHERE scope = 'shared'")(lambda g: g.entities.where(in_scope("all")).select("id"))

# --- joins and sets ---------------------------------------------------------------------------------------

on_graph("jn7_provenance", "SELECT DISTINCT s.id, s.content_hash FROM sources s JOIN edges e ON e.source_ref = s.id WHERE e.source_id IN ('customer:1', 'nation:2') OR e.target_id IN ('customer:1', 'nation:2')")(
    lambda g: S.provenance(g.edges, g.sources, g.entities.where("id in ('customer:1', 'nation:2')")).select("id", "content_hash")
)
on_graph("jn8_semi", "SELECT id FROM edges WHERE source_id IN (SELECT id FROM nodes WHERE type = 'NATION')")(lambda g: g.edges.join(g.entities.where("type = 'NATION'").select(F.col("id").alias("source_id")), "source_id", "left_semi").select("id"))
on_graph("jn9_anti_unconfirmed", "SELECT id FROM nodes n WHERE tier = 'warm' AND valid_until IS NULL AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.target_id = n.id AND e.detected_at > TIMESTAMP '2024-01-02')")(lambda g: M.unconfirmed(g.entities, g.edges, NOW).select("id"))
on_graph("jn10_orphan_sources", "SELECT id FROM sources WHERE id NOT IN (SELECT source_ref FROM edges)")(lambda g: g.sources.join(g.edges.select(F.col("source_ref").alias("id")), "id", "left_anti").select("id"))
on_tables("jn11_diff", "SELECT 'added' AS change, user_id FROM (SELECT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-29' EXCEPT SELECT user_id FROM events WHERE ts < TIMESTAMP '2024-01-29') UNION ALL SELECT 'removed', user_id FROM (SELECT user_id FROM events WHERE ts < TIMESTAMP '2024-01-29' EXCEPT SELECT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-29')")(
    lambda t: _changed(*(t("events").where(f"ts {op} timestamp_ntz'2024-01-29'").select("user_id").distinct() for op in ("<", ">=")))
)


def _changed(a: DataFrame, b: DataFrame) -> DataFrame:
    return b.join(a, "user_id", "left_anti").select(F.lit("added").alias("change"), "user_id").unionAll(a.join(b, "user_id", "left_anti").select(F.lit("removed").alias("change"), "user_id"))


on_graph("jn12_membership", "SELECT entity_id FROM vectors WHERE entity_id IN (SELECT id FROM nodes WHERE scope = 'shared' AND valid_until IS NULL)")(lambda g: V._visible(g.seen_by("shared")).select("entity_id"))
on_graph("jn13_conflicts", "SELECT DISTINCT a.subject_id AS subject, a.predicate, a.object_id AS object, b.object_id AS prior_object FROM triples a JOIN triples b ON a.subject_id = b.subject_id AND a.predicate = b.predicate AND a.object_id <> b.object_id")(
    lambda g: I.conflicting(*[g.triples.select(F.col("subject_id").alias("subject"), "predicate", F.col("object_id").alias("object"))] * 2)
)
on_graph(
    "jn14_point_in_time",
    "SELECT DISTINCT e.source_id, e.target_id FROM edges e JOIN nodes s ON s.id = e.source_id JOIN nodes t ON t.id = e.target_id WHERE e.relation_type = 'PREFERS' AND e.valid_from <= TIMESTAMP '1998-06-01' AND (e.valid_until IS NULL OR e.valid_until > TIMESTAMP '1998-06-01') AND s.valid_from <= TIMESTAMP '1998-06-01' AND (s.valid_until IS NULL OR s.valid_until > TIMESTAMP '1998-06-01')",
)(lambda g: _point(g.seen_at("1998-06-01")))


def _point(g: Snapshot) -> DataFrame:
    s, t = (g.nodes().select(F.col("id").alias(c)) for c in ("source_id", "target_id"))
    return g.links().where("relation_type = 'PREFERS'").join(s, "source_id").join(t, "target_id").select("source_id", "target_id").distinct()


on_tables("jn15_unique_suffix", "SELECT suffix, max(c_name) AS name FROM (SELECT c_name, right(c_name, 3) AS suffix FROM customer) GROUP BY suffix HAVING count(*) = 1")(
    lambda t: t("customer").select("c_name", F.expr("right(c_name, 3)").alias("suffix")).groupBy("suffix").agg(F.max("c_name").alias("name"), F.count("*").alias("n")).where("n = 1").drop("n")
)
on_graph("st1_contradictions_of", "SELECT DISTINCT id, source_id, target_id FROM edges WHERE relation_type = 'CONTRADICTS' AND (source_id = 'priority:1-URGENT' OR target_id = 'priority:1-URGENT')")(lambda g: G.contradictions_for(g, "priority:1-URGENT").select("id", "source_id", "target_id"))
on_graph("st3_token_sets", "SELECT id, round(len(list_intersect(list_distinct(string_split(lower(name), '#')), ['customer', '000000007']))::DOUBLE / len(list_distinct(list_concat(string_split(lower(name), '#'), ['customer', '000000007']))), 6) AS j FROM nodes WHERE type = 'CUSTOMER'")(
    lambda g: g.entities.where("type = 'CUSTOMER'").select("id", F.round(T.jaccard(F.array_distinct(F.split(F.lower("name"), "#")), F.array(F.lit("customer"), F.lit("000000007"))), 6).alias("j"))
)

# --- aggregation, windows, order --------------------------------------------------------------------------

on_graph("ag1_count_by_type", "SELECT type, count(*) AS n FROM nodes WHERE valid_until IS NULL AND scope = 'shared' GROUP BY type")(lambda g: C.count_by_type(g.seen_by("shared")))
on_graph("ag2_schema_summary", "SELECT 'entity' AS kind, type AS name, count(*) AS n FROM nodes WHERE valid_until IS NULL GROUP BY type UNION ALL SELECT 'relation', relation_type, count(*) FROM edges WHERE valid_until IS NULL GROUP BY relation_type")(lambda g: C.schema_summary(g))
on_graph(
    "ag3_stats",
    "SELECT 'entities' AS name, (SELECT count(*) FROM nodes) AS n UNION ALL SELECT 'current_entities', (SELECT count(*) FROM nodes WHERE valid_until IS NULL) UNION ALL SELECT 'hot', (SELECT count(*) FROM nodes WHERE tier = 'hot') UNION ALL SELECT 'warm', (SELECT count(*) FROM nodes WHERE tier = 'warm') UNION ALL SELECT 'cold', 0 UNION ALL SELECT 'edges', (SELECT count(*) FROM edges) UNION ALL SELECT 'current_edges', (SELECT count(*) FROM edges WHERE valid_until IS NULL) UNION ALL SELECT 'contradictions', (SELECT count(*) FROM edges WHERE relation_type = 'CONTRADICTS')",
)(lambda g: C.stats(g))
on_graph("ag3_most_used", "SELECT id, access_count FROM nodes WHERE valid_until IS NULL ORDER BY access_count DESC, importance DESC, created_at, id LIMIT 10")(lambda g: C.most_used(g).select("id", "access_count"))
on_graph("ag4_duplicate_groups", "SELECT type, canonical_name, n, keeper FROM (SELECT type, canonical_name, scope, owner_id, count(*) AS n, arg_min(id, (created_at, id)) AS keeper FROM nodes WHERE valid_until IS NULL GROUP BY ALL) WHERE n > 1")(
    lambda g: M.duplicate_groups(g.entities).select("type", "canonical_name", "n", "keeper")
)
on_graph("ag5_topics", "SELECT type, max(n) AS n, string_agg(name, '|' ORDER BY k) AS examples FROM (SELECT type, name, count(*) OVER (PARTITION BY type) AS n, row_number() OVER (PARTITION BY type ORDER BY access_count DESC, importance DESC, created_at, id) AS k FROM nodes WHERE valid_until IS NULL) WHERE k <= 3 GROUP BY type")(lambda g: C.topics(g))
on_graph("ag6_best_per_entity", "SELECT target_id, max(confidence_score) AS score FROM edges WHERE relation_type = 'CONTAINS' GROUP BY target_id")(lambda g: g.edges.where("relation_type = 'CONTAINS'").groupBy("target_id").agg(F.max_by("confidence_score", F.struct("confidence_score", "id")).alias("score")))
on_graph("ag7_delta", "SELECT 'entities' AS \"table\", (SELECT count(*) FROM nodes WHERE valid_from >= TIMESTAMP '2000-01-01') AS n UNION ALL SELECT 'edges', (SELECT count(*) FROM edges WHERE id NOT IN (SELECT id FROM edges WHERE valid_from < TIMESTAMP '2000-01-01'))")(
    lambda g: C.delta({n: df.where("valid_from < timestamp_ntz'2000-01-01'") for n, df in (("entities", g.entities), ("edges", g.edges))}, {"entities": g.entities, "edges": g.edges})
)
on_tables("ag8_language_histogram", "SELECT lang AS code_language, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang")(lambda t: t("documents").where("lang is not null").groupBy(F.col("lang").alias("code_language")).agg(F.count("*").alias("n")))
on_graph("ag9_out_weights", "SELECT id, round(sum(w), 6) AS weight FROM (SELECT source_id AS id, greatest(confidence_score, 0.001) AS w FROM edges UNION ALL SELECT target_id, greatest(confidence_score, 0.001) / 2 FROM edges) GROUP BY id")(
    lambda g: G.out_weights(g.edges).select("id", F.round("weight", 6).alias("weight"))
)
on_tables("ag10_last_turns", "SELECT conv_id, substr(arg_max(text, turn) FILTER (WHERE role = 'user'), 1, 8000) AS \"user\", substr(arg_max(text, turn) FILTER (WHERE role = 'assistant'), 1, 8000) AS assistant FROM conversations WHERE trim(text) <> '' GROUP BY conv_id")(lambda t: I.last_turns(t("conversations")))


on_graph("wn1_top_per_type", "SELECT type, id, k FROM (SELECT type, id, row_number() OVER (PARTITION BY type ORDER BY importance DESC, id) AS k FROM nodes WHERE valid_until IS NULL) WHERE k <= 2")(
    lambda g: g.nodes().select("type", "id", F.row_number().over(Window.partitionBy("type").orderBy(F.desc("importance"), "id")).cast("bigint").alias("k")).where("k <= 2")
)
on_tables(
    "wn3_validity_chain",
    "SELECT c, value, previous, strftime(begin_at, '%Y-%m-%d') AS begins, strftime(end_at, '%Y-%m-%d') AS ends FROM (SELECT o_custkey AS c, o_orderpriority AS value, previous, o_orderdate AS begin_at, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS end_at FROM (SELECT *, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM orders) WHERE previous IS NULL OR previous <> o_orderpriority)",
)(lambda t: I.chain(t("orders"), ["o_custkey"], "o_orderpriority", "o_orderdate", "o_orderkey").select(F.col("o_custkey").alias("c"), F.col("o_orderpriority").alias("value"), "previous", F.date_format("o_orderdate", "yyyy-MM-dd").alias("begins"), F.date_format("ends", "yyyy-MM-dd").alias("ends")))
on_graph("wn4_budget", "SELECT id, used::BIGINT AS used FROM (SELECT id, sum(length(name)) OVER (ORDER BY importance DESC, id ROWS UNBOUNDED PRECEDING) AS used FROM nodes WHERE type = 'CUSTOMER') WHERE used <= 400")(
    lambda g: C.within_budget(g.entities.where("type = 'CUSTOMER'"), F.length("name"), 100, [F.desc("importance"), F.asc("id")]).select("id", "used")
)
on_graph("sl2_bounded", "SELECT id FROM (SELECT id, row_number() OVER (ORDER BY importance DESC, id) AS k FROM nodes WHERE type = 'CUSTOMER') WHERE k <= 10")(lambda g: g.entities.where("type = 'CUSTOMER'").orderBy(F.desc("importance"), "id").limit(R.bounded(99)).select("id"))
on_graph("sl5_browse_type", "SELECT id FROM nodes WHERE lower(type) = 'user' AND valid_until IS NULL ORDER BY access_count DESC, importance DESC, created_at, id LIMIT 15")(lambda g: C.browse_type(g, "User", 15).select("id"))
on_graph("sl6_batch_limit", "SELECT id FROM nodes WHERE tier = 'warm' AND last_accessed_at < TIMESTAMP '2024-01-02' ORDER BY last_accessed_at, id LIMIT 100")(lambda g: M.stale_warm(g.entities, NOW).limit(100).select("id"))
on_graph("sl7_recent_contradictions", "SELECT id, source_id, target_id FROM edges WHERE relation_type = 'CONTRADICTS' ORDER BY detected_at DESC, id LIMIT 5")(lambda g: C.recent_contradictions(g).select("id", "source_id", "target_id"))

# --- scalar functions -------------------------------------------------------------------------------------

on_tables("fn1_canonical", "SELECT doc_id, lower(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS c FROM documents")(lambda t: t("documents").select("doc_id", T.canonical(F.col("text")).alias("c")))
on_tables("fn2_sha256", "SELECT doc_id, sha256(text) AS h FROM documents")(lambda t: t("documents").select("doc_id", F.sha2("text", 256).alias("h")))
on_tables("fn3_sentences", "SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')) AS n FROM documents")(lambda t: t("documents").select("doc_id", F.size(T.sentences(F.col("text"))).cast("bigint").alias("n")))
on_tables("fn4_nouns", "SELECT doc_id, array_to_string(list_filter(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_-]*'), lambda w: regexp_matches(w, '^[A-Z].') AND lower(w) NOT IN ('the', 'a', 'an', 'this', 'that', 'these', 'those')), ' ') AS nouns FROM documents")(lambda t: t("documents").select("doc_id", F.array_join(T.nouns(F.col("text")), " ").alias("nouns")))
on_tables("fn5_predicate", "SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)\\bowns\\b') THEN 'OWNS' WHEN regexp_matches(text, '(?i)\\bprefers?\\b') THEN 'PREFERS' WHEN regexp_matches(text, '(?i)\\bworks (at|for)\\b') THEN 'WORKS_AT' ELSE 'RELATED_TO' END AS p FROM documents")(
    lambda t: t("documents").select("doc_id", T.predicate(F.col("text")).alias("p"))
)
on_graph("fn6_fingerprint", "SELECT id, fingerprint FROM triples")(
    lambda g: g.triples.join(g.entities.select(F.col("id").alias("subject_id"), F.col("name").alias("s")), "subject_id").join(g.entities.select(F.col("id").alias("object_id"), F.col("name").alias("o")), "object_id").select("id", T.fingerprint(F.col("s"), F.col("predicate"), F.col("o")).alias("fingerprint"))
)
on_tables("fn7_jaccard", "SELECT doc_id, round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) AS j FROM (SELECT d.doc_id, list_distinct(string_split(d.text, ' ')) AS a, list_distinct(string_split(e.text, ' ')) AS b FROM documents d JOIN documents e ON e.doc_id = d.doc_id + 1)")(lambda t: _words_with_next(t("documents")))


def _words_with_next(d: DataFrame) -> DataFrame:
    words = F.array_distinct(F.split("text", " "))
    after = d.select((F.col("doc_id") - 1).alias("doc_id"), words.alias("b"))
    return d.select("doc_id", words.alias("a")).join(after, "doc_id").select("doc_id", F.round(T.jaccard(F.col("a"), F.col("b")), 6).alias("j"))


on_graph("fn8_overlap", "SELECT id, round((len(list_intersect(['nation_1', 'or', 'nation_2'], string_split(lower(name), ' '))) + 1)::DOUBLE / 4, 6) AS score FROM nodes")(lambda g: g.entities.select("id", F.round(T.overlap(F.lit("Nation_1 or  NATION_2"), F.col("name")), 6).alias("score")))
_PAIR = "FROM (SELECT a.vec_id AS a, b.vec_id AS b, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"
on_tables("fn9_cosine", f"SELECT a, b, round(list_dot_product(x::DOUBLE[], y::DOUBLE[]) / (sqrt(list_dot_product(x::DOUBLE[], x::DOUBLE[])) * sqrt(list_dot_product(y::DOUBLE[], y::DOUBLE[])) + 1e-12), 6) AS score {_PAIR}")(lambda t: _pairs(t).select("a", "b", F.round(N.cosine(F.col("x"), F.col("y")), 6).alias("score")))
on_tables("fn11_hamming", f"SELECT a, b, round(1 - len(list_filter(list_zip(x, y), lambda p: (p[1] >= 0) <> (p[2] >= 0)))::DOUBLE / 64, 6) AS score {_PAIR}")(lambda t: _pairs(t).select("a", "b", F.round(1 - N.hamming(N.sign_words(F.col("x"), 64), N.sign_words(F.col("y"), 64)) / 64, 6).alias("score")))
on_tables("fn13_prefix", f"SELECT a, round(list_dot_product(x[1:16]::DOUBLE[], y[1:16]::DOUBLE[]), 6) AS d {_PAIR}")(lambda t: _pairs(t).select("a", F.round(N.dot(N.prefix(F.col("x"), N.coarse_dim(64)), N.prefix(F.col("y"), N.coarse_dim(64))), 6).alias("d")))


def _pairs(t) -> DataFrame:
    e = t("embeddings")
    return e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"), (F.col("vec_id") + 1).alias("b")).join(e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y")), "b")


on_tables("fn10_l2_score", f"SELECT a, b, round(greatest(0, 1 - list_aggregate(list_transform(list_zip(x::DOUBLE[], y::DOUBLE[]), lambda p: (p[1] - p[2]) * (p[1] - p[2])), 'sum') / 4), 6) AS score {_PAIR}")(
    lambda t: _pairs(t).select("a", "b", F.round(N.l2_score(F.sqrt(F.aggregate(F.zip_with(F.col("x").cast("array<double>"), F.col("y").cast("array<double>"), lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))), 6).alias("score"))
)
on_tables("fn12_sign_words", "SELECT vec_id, list_aggregate(list_transform(range(0, 64), lambda i: CASE WHEN embedding[i + 1] >= 0 THEN 1 ELSE 0 END), 'sum')::BIGINT AS ones, (embedding[1] >= 0) AS first FROM embeddings")(
    lambda t: t("embeddings").select("vec_id", F.bit_count(F.get(N.sign_words(F.col("embedding"), 64), F.lit(0))).cast("bigint").alias("ones"), (F.get(N.sign_words(F.col("embedding"), 64), F.lit(0)) < 0).alias("first"))
)
on_graph("fn14_strength", "SELECT id, round(importance * exp(-ln(2) / 30 * greatest(0, (epoch(TIMESTAMP '2024-02-01') - floor(epoch(last_accessed_at))) / 86400.0)) * (1 + 0.2 * access_count), 4) AS s FROM nodes WHERE valid_until IS NULL")(
    lambda g: M.strengths(g.entities.withColumn("last_accessed_at", F.date_trunc("second", "last_accessed_at").cast("timestamp_ntz")), NOW).select(F.col("entity_id").alias("id"), F.round("strength", 4).alias("s"))
)
on_tables("fn15_json_extract", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")(lambda t: t("events").select("event_id", F.get_json_object("props", "$['k']").alias("k")))
on_tables("fn16_json_object", "SELECT r_regionkey, '{\"r_name\":\"' || r_name || '\",\"n\":null}' AS j FROM region")(lambda t: t("region").select("r_regionkey", F.to_json(F.struct("r_name", F.lit(None).cast("int").alias("n")), {"ignoreNullFields": "false"}).alias("j")))
on_graph("fn17_json_set", "SELECT id, CASE WHEN attrs_json = '{}' THEN '{\"stale\":1}' ELSE substr(attrs_json, 1, length(attrs_json) - 1) || ',\"stale\":1}' END AS attrs_json FROM nodes n WHERE tier = 'warm' AND valid_until IS NULL AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.target_id = n.id AND e.detected_at > TIMESTAMP '2024-01-02')")(
    lambda g: M.flag_stale(g.entities, g.edges, NOW, "r")[0].where("attrs_json like '%stale%'").select("id", "attrs_json")
)
on_graph("fn18_null_safe", "SELECT count(*) AS n FROM nodes a JOIN nodes b ON a.canonical_name = b.canonical_name AND coalesce(a.owner_id, '') = coalesce(b.owner_id, '')")(
    lambda g: g.entities.alias("a").join(g.entities.alias("b"), (F.col("a.canonical_name") == F.col("b.canonical_name")) & same(F.col("a.owner_id"), F.col("b.owner_id"))).agg(F.count("*").alias("n"))
)
on_graph("fn19_like", "SELECT id FROM nodes WHERE name ILIKE 'NATION\\_1%' ESCAPE '\\'")(lambda g: g.entities.where(F.col("name").ilike(T.like_pattern("nation_1") + "%")).select("id"))
on_tables("fn20_iso_time", "SELECT '1997-03-15 00:30:00' AS a, '1997-03-15 02:30:00' AS b")(lambda t: t("region").limit(1).select(*(F.lit(moment(x)).alias(n) for n, x in (("a", "1997-03-15T02:30:00+02:00"), ("b", "1997-03-15T02:30:00")))))
on_tables("fn21_module_name", "SELECT * FROM (VALUES ('a.b.c'), ('pkg'), ('web.app'), ('go.x')) t(m)")(
    lambda t: t("region").sparkSession.createDataFrame([("a/b/c.py",), ("pkg/__init__.py",), ("web/app/index.ts",), ("src/go/internal/x.go",)], "p string").select(T.module_name(F.col("p"), T.language_of(F.col("p"))).alias("m"))
)
on_tables("fn22_visibility", "SELECT r_name, CASE WHEN r_name LIKE '\\_%' ESCAPE '\\' THEN 'private' ELSE 'public' END AS py, CASE WHEN regexp_matches(r_name, '^[A-Z]') THEN 'public' ELSE 'private' END AS go FROM region")(lambda t: t("region").select("r_name", T.visibility(F.col("r_name"), F.lit("python")).alias("py"), T.visibility(F.col("r_name"), F.lit("go")).alias("go")))
on_tables("fn24_turn_cut", "SELECT conv_id, turn, length(substr(text, 1, 8000)) AS n FROM conversations")(lambda t: t("conversations").select("conv_id", "turn", F.length(F.substring("text", 1, T.TURN_CHARS)).cast("bigint").alias("n")))
on_tables("fn27_rule_counts", "SELECT conv_id, turn, " + ", ".join("(" + " + ".join(f"regexp_matches(text, '(?i){r.replace(chr(39), chr(39) * 2)}')::INTEGER" for r in rules) + f") AS {k.lower()}" for k, rules in T.QUESTION_RULES.items()) + " FROM conversations")(
    lambda t: t("conversations").select("conv_id", "turn", *(c.alias(k.lower()) for k, c in T.rule_counts(F.col("text")).items()))
)
on_tables("fn28_code_names", "SELECT conv_id, turn, array_to_string(list_filter(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]+'), lambda w: length(w) >= 3 AND lower(w) NOT IN (" + ", ".join(f"'{w}'" for w in T.NOT_NAMES) + ")), ' ') AS names FROM conversations")(lambda t: t("conversations").select("conv_id", "turn", F.array_join(T.code_names(F.col("text")), " ").alias("names")))
on_tables("fn26_identity", "SELECT r_regionkey, sha256('entity|' || r_name || '|') AS id FROM region")(lambda t: t("region").select("r_regionkey", identity(F.lit("entity"), F.col("r_name"), F.lit(None)).alias("id")))
def _bag_sql(key: str, text: str, table: str, dim: int) -> str:
    words = f"regexp_extract_all(lower({text}), '[a-z0-9_]+')"
    return f"""WITH w AS (SELECT {key}, md5(unnest({words})) AS h FROM {table} WHERE {text} IS NOT NULL),
c AS (SELECT {key}, ('0x' || substr(h, 1, 7))::BIGINT % {dim} AS slot, sum(CASE WHEN substr(h, 9, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') THEN 1 ELSE -1 END)::DOUBLE AS n FROM w GROUP BY 1, 2),
u AS (SELECT {key}, slot, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS x FROM c QUALIFY sum(n * n) OVER (PARTITION BY {key}) > 0)
SELECT {key}, slot::INTEGER AS slot, round(x::FLOAT::DOUBLE, 4) AS x FROM u WHERE x <> 0 UNION ALL SELECT {key}, 0, 1.0 FROM {table} WHERE {text} IS NOT NULL AND {key} NOT IN (SELECT {key} FROM u)"""


def _bag(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.select(key, F.posexplode(vector).alias("slot", "x")).where("x <> 0").select(key, "slot", F.round(F.col("x").cast("double"), 4).alias("x"))


on_tables("ve8_bag_of_words", _bag_sql("doc_id", "text", "documents", 64))(lambda t: _bag(t("documents").withColumn("v", bag_of_words(F.col("text"))), "doc_id", "v"))

on_graph("dm20_reembed", _bag_sql("entity_id", "name", "(SELECT id AS entity_id, name FROM nodes WHERE valid_until IS NULL)", 16))(lambda g: _bag(reembed(g.entities, NOW, "bow", "1", 16), "entity_id", "vector"))

# --- graph ------------------------------------------------------------------------------------------------

on_graph(
    "gr1_neighbours",
    "WITH l AS (SELECT source_id, target_id FROM edges WHERE valid_until IS NULL AND relation_type <> 'CONTRADICTS'), h1 AS (SELECT DISTINCT target_id AS id FROM l WHERE source_id = 'supplier:3'), h2 AS (SELECT DISTINCT target_id AS id FROM l WHERE source_id IN (SELECT id FROM h1) AND target_id <> 'supplier:3' AND target_id NOT IN (SELECT id FROM h1)) SELECT x.id, x.hops FROM (SELECT id, 1 AS hops FROM h1 UNION ALL SELECT id, 2 FROM h2) x JOIN nodes n ON n.id = x.id WHERE n.valid_until IS NULL AND n.scope = 'shared'",
)(lambda g: G.neighbours(g.seen_by("shared"), "supplier:3", 2))


def _walk(seeds: str, rounds: int, seen: str = "valid_until IS NULL") -> str:
    """CTEs of a PageRank by ``rounds``: t(src, dst, p), the seeds v(id, v) that ``seeds`` selects, and p1, p2 and so on (id, s)."""
    ends = f"(SELECT id FROM nodes WHERE {seen})"
    step = "p{k} AS MATERIALIZED (SELECT id, sum(x) AS s FROM (SELECT dst AS id, s * p * 0.85 AS x FROM {before} f JOIN t ON f.id = t.src UNION ALL SELECT id, v * 0.15 FROM v) GROUP BY id)"
    return f"""l AS (SELECT source_id, target_id, greatest(confidence_score, 0.001) AS w FROM edges WHERE valid_until IS NULL AND relation_type <> 'CONTRADICTS' AND source_id IN {ends} AND target_id IN {ends}),
m AS (SELECT src, dst, sum(w) AS w FROM (SELECT source_id AS src, target_id AS dst, w FROM l UNION ALL SELECT target_id, source_id, w / 2 FROM l) GROUP BY src, dst),
t AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM m),
v AS MATERIALIZED ({seeds}),
""" + ",\n".join(step.format(k=k, before=f"p{k - 1}" if k > 1 else "(SELECT id, v AS s FROM v)") for k in range(1, rounds + 1))


_TWO = "SELECT * FROM (VALUES ('nation:1', 0.5::DOUBLE), ('supplier:2', 0.5::DOUBLE)) v(id, v)"
for _rounds in (3, 12):
    on_graph(f"gr2_pagerank_{_rounds}_rounds", f"WITH {_walk(_TWO, _rounds)} SELECT id, round(s, 9) AS score FROM p{_rounds} WHERE s > 0")(lambda g, rounds=_rounds: G.pagerank(g, ["nation:1", "supplier:2"], rounds=rounds, tolerance=None).select("id", F.round("score", 9).alias("score")))
_ONE = "SELECT '{}' AS id, 1.0::DOUBLE AS v"
on_graph("gr2_pagerank", f"WITH {_walk(_ONE.format('nation:1'), 30)} SELECT id, round(s, 6) AS score FROM p30 WHERE s > 0")(lambda g: G.pagerank(g, ["nation:1"]).select("id", F.round("score", 6).alias("score")))
on_graph("gr3_push_pagerank")(lambda g: G.push_pagerank(g, ["nation:1"], epsilon=1e-3).select("id", F.round("score", 6).alias("score")))
on_graph("gr4_transitions", f"WITH {_walk(_TWO, 1)} SELECT src, dst, round(p, 9) AS p FROM t")(lambda g: G.transitions(g.inner_links()).select("src", "dst", F.round("p", 9).alias("p")))
on_graph("gr5_contradictions_for", "SELECT id FROM edges WHERE relation_type = 'CONTRADICTS' AND (source_id = 'priority:5-LOW' OR target_id = 'priority:5-LOW')")(lambda g: G.contradictions_for(g, "priority:5-LOW").select("id"))
on_graph("gr6_browse_topic", "SELECT id, name, 'type' AS via FROM nodes WHERE type = 'REGION' ORDER BY access_count DESC, importance DESC, created_at, id LIMIT 3")(lambda g: G.browse_topic(g, "region", limit=3))
_NEAR = f"WITH {_walk(_ONE.format('nation:4'), 30)}, near AS (SELECT id, name FROM p30 JOIN nodes n USING (id) WHERE id <> 'nation:4' AND valid_until IS NULL ORDER BY round(s, 9) DESC, id LIMIT 20)"
on_graph("gr6_browse_name", _NEAR + " SELECT id, name, 'pagerank' AS via FROM near")(lambda g: G.browse_topic(g, "NATION_4"))
on_graph(
    "gr7_working_context",
    _NEAR + """ SELECT 'anchor' AS part, id, name FROM nodes WHERE id = 'nation:4' UNION ALL SELECT 'neighbour', id, name FROM near UNION ALL SELECT 'contradiction', id, source_id || ' ' || target_id
FROM (SELECT * FROM edges WHERE relation_type = 'CONTRADICTS' AND valid_until IS NULL ORDER BY detected_at DESC, id LIMIT 5)""",
)(lambda g: G.working_context(g, "nation:NATION_4").select("part", "id", "name"))

# --- vectors ----------------------------------------------------------------------------------------------

Q = [0.1 if i % 3 == 0 else -0.07 if i % 3 == 1 else 0.02 for i in range(64)]
_QSQL = "[" + ", ".join(map(str, Q)) + "]::DOUBLE[]"
_COS = "round(list_dot_product({a}::DOUBLE[], {b}) / (sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_dot_product({b}, {b})) + 1e-12), 9)"
_SEEN = "(SELECT v.* FROM vectors v JOIN nodes n ON n.id = v.entity_id WHERE n.valid_until IS NULL AND n.scope = 'shared')"
on_graph("ve1_knn", f"SELECT entity_id AS id, {_COS.format(a='vector', b=_QSQL)} AS score FROM {_SEEN} ORDER BY score DESC, id LIMIT 10")(lambda g: V.knn(g.seen_by("shared"), Q))
on_graph(
    "ve2_two_pass",
    f"SELECT entity_id AS id, {_COS.format(a='vector', b=_QSQL)} AS score FROM (SELECT *, {_COS.format(a='vector[1:16]', b=f'({_QSQL})[1:16]')} AS near FROM {_SEEN} ORDER BY near DESC, entity_id LIMIT 100) ORDER BY score DESC, id LIMIT 10",
)(lambda g: V.knn_two_pass(g.seen_by("shared"), Q))
on_graph("ve3_l2", f"SELECT entity_id AS id, round(greatest(0, 1 - list_aggregate(list_transform(list_zip(vector::DOUBLE[], {_QSQL}), lambda p: (p[1] - p[2]) * (p[1] - p[2])), 'sum') / 4), 9) AS score FROM {_SEEN} ORDER BY score DESC, id LIMIT 10")(lambda g: V.knn_l2(g.seen_by("shared"), Q))
on_graph("ve4_signs", f"SELECT entity_id AS id, round(1 - len(list_filter(list_zip(vector, {_QSQL}), lambda p: (p[1] >= 0) <> (p[2] >= 0)))::DOUBLE / 64, 9) AS score FROM {_SEEN} ORDER BY score DESC, id LIMIT 10")(lambda g: V.knn_signs(g.seen_by("shared"), Q))
_SEEDS = f"s AS (SELECT entity_id AS id, {_COS.format(a='vector', b=_QSQL)} AS score FROM {_SEEN} ORDER BY score DESC, id LIMIT 10), l AS (SELECT source_id, target_id, confidence_score FROM edges WHERE valid_until IS NULL AND relation_type <> 'CONTRADICTS' AND target_id IN (SELECT id FROM nodes WHERE valid_until IS NULL AND scope = 'shared'))"
on_graph("ve5_expand", f"WITH {_SEEDS} SELECT target_id AS id, round(max(score * 0.5 * confidence_score), 9) AS score FROM s JOIN l ON l.source_id = s.id GROUP BY target_id")(lambda g: V.expand(g.seen_by("shared"), V.knn(g.seen_by("shared"), Q)).select("id", F.round("score", 9).alias("score")))
on_graph("ve6_evidence", "SELECT n.id, CASE WHEN bool_or(e.relation_type NOT IN ('CONTRADICTS', 'SUPERSEDES')) THEN 'source_grounded' WHEN count(e.id) > 0 THEN 'inferred' ELSE 'source_grounded' END AS confidence_class FROM nodes n LEFT JOIN edges e ON e.target_id = n.id GROUP BY n.id UNION ALL SELECT 'nobody', 'hallucination_risk'")(
    lambda g: V.evidence(g, g.entities.select("id").unionAll(g.entities.sparkSession.createDataFrame([("nobody",)], "id string")))
)
_WIDE = f"""s AS (SELECT entity_id AS id, {_COS.format(a='vector', b=_QSQL)} AS score FROM (SELECT *, {_COS.format(a='vector[1:16]', b=f'({_QSQL})[1:16]')} AS near FROM {_SEEN} ORDER BY near DESC, entity_id LIMIT 100) ORDER BY score DESC, id LIMIT 25),
l AS (SELECT source_id, target_id, confidence_score FROM edges WHERE valid_until IS NULL AND relation_type <> 'CONTRADICTS' AND target_id IN (SELECT id FROM nodes WHERE valid_until IS NULL AND scope = 'shared')),
top AS (SELECT id, round(max(score), 9) AS score FROM (SELECT id, score FROM s UNION ALL SELECT target_id, score * 0.5 * confidence_score FROM s JOIN l ON l.source_id = s.id) GROUP BY id ORDER BY score DESC, id LIMIT 10)"""
_CLASS = "CASE WHEN bool_or(e.relation_type NOT IN ('CONTRADICTS', 'SUPERSEDES')) THEN 'source_grounded' WHEN count(e.id) > 0 THEN 'inferred' ELSE 'source_grounded' END"
on_graph("ve7_search", f"WITH {_WIDE} SELECT top.id, top.score, {_CLASS} AS confidence_class FROM top LEFT JOIN edges e ON e.target_id = top.id GROUP BY top.id, top.score")(lambda g: V.search(g.seen_by("shared"), Q, 10, depth=1))
on_graph("ve7_knn_batch", "SELECT query, id, score FROM (SELECT q.entity_id AS query, v.entity_id AS id, " + _COS.format(a="v.vector", b="(q.vector::DOUBLE[])") + " AS score, row_number() OVER (PARTITION BY q.entity_id ORDER BY " + _COS.format(a="v.vector", b="(q.vector::DOUBLE[])") + " DESC, v.entity_id) AS k FROM vectors v JOIN nodes n ON n.id = v.entity_id AND n.valid_until IS NULL, vectors q WHERE split_part(q.entity_id, ':', 2)::BIGINT % 100 = 0) WHERE k <= 3")(
    lambda g: V.knn_batch(g, g.embeddings.where("cast(substring_index(entity_id, ':', -1) as bigint) % 100 = 0").select(F.col("entity_id").alias("query"), "vector"), 3)
)

# --- time, retrieval --------------------------------------------------------------------------------------

on_graph("te1_valid_at", "SELECT type, count(*) AS n FROM nodes WHERE valid_from <= TIMESTAMP '1996-01-01' AND (valid_until IS NULL OR valid_until > TIMESTAMP '1996-01-01') GROUP BY type")(lambda g: g.entities.where(at("1996-01-01")).groupBy("type").agg(F.count("*").alias("n")))
on_graph("te2_stale_warm", "SELECT id FROM nodes WHERE tier = 'warm' AND last_accessed_at < TIMESTAMP '2024-01-02'")(lambda g: M.stale_warm(g.entities, NOW).select("id"))
_CLASS = "SELECT conv_id, turn, CASE WHEN vibe + fact + change + code = 0 THEN 'VIBE' WHEN code > 0 AND change > 0 THEN 'HYBRID' WHEN (vibe > 0)::INT + (fact > 0)::INT + (change > 0)::INT + (code > 0)::INT >= 2 AND code = 0 THEN 'HYBRID' WHEN vibe = greatest(vibe, fact, change, code) THEN 'VIBE' WHEN fact = greatest(vibe, fact, change, code) THEN 'FACT' WHEN change = greatest(vibe, fact, change, code) THEN 'CHANGE' ELSE 'CODE' END AS class FROM ("
on_tables("rc1_classify", _CLASS + ORACLE_SQL["fn27_rule_counts"] + ")")(lambda t: R.classify(t("conversations").withColumnRenamed("text", "query")).select("conv_id", "turn", "class"))
on_graph("rc2_vibe", f"WITH {_WIDE} SELECT id, score, 'vector' AS layer FROM top")(lambda g: R.vibe(g.seen_by("shared"), Q))
_SHARED = "valid_until IS NULL AND scope = 'shared'"
_TOP5 = f"""s5 AS (SELECT entity_id AS id, {_COS.format(a='vector', b=_QSQL)} AS score FROM (SELECT *, {_COS.format(a='vector[1:16]', b=f'({_QSQL})[1:16]')} AS near FROM {_SEEN} ORDER BY near DESC, entity_id LIMIT 100) ORDER BY score DESC, id LIMIT 5),
good AS (SELECT id FROM s5 WHERE score >= greatest(0.05, 0.3 * (SELECT max(score) FROM s5)) OR (SELECT max(score) FROM s5) < 0.05 AND id = (SELECT id FROM s5 ORDER BY score DESC, id DESC LIMIT 1))"""
_FACT = f"{_TOP5}, {_walk('SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM good) AS v FROM good', 30, _SHARED)}, facts AS (SELECT id, round(s, 9) AS score, 'graph' AS layer FROM p30 WHERE s > 0 ORDER BY score DESC, id LIMIT 10)"
on_graph("rc3_fact", f"WITH {_FACT} SELECT * FROM facts")(lambda g: R.fact(g.seen_by("shared"), Q))


def _changes(words: list[str], name: str) -> str:
    """CTEs up to then_hits(id, score, layer) of a question's words, of which one names an entity."""
    other = ", ".join(f"'{w}'" for w in words if w != name)
    then = "valid_from <= TIMESTAMP '1997-06-01' AND (valid_until IS NULL OR valid_until > TIMESTAMP '1997-06-01')"
    return f"""then_nodes AS (SELECT * FROM nodes WHERE scope = 'shared' AND {then}),
then_links AS (SELECT * FROM edges WHERE relation_type <> 'CONTRADICTS' AND {then}),
named AS (SELECT id, round(CASE WHEN lower(name) = '{name}' OR lower(name) IN ({other}) THEN 2 ELSE 1 END / {len(words) + 1}.0, 9) AS score, lower(name) = '{name}' AS hit FROM then_nodes),
obj AS (SELECT e.target_id AS id, round(max(0.95 * e.confidence_score), 9) AS score FROM then_links e JOIN named s ON s.id = e.source_id AND s.hit JOIN then_nodes n ON n.id = e.target_id GROUP BY 1),
then_hits AS (SELECT id, max(score)::DOUBLE AS score, 'temporal' AS layer FROM (SELECT id, score FROM named UNION ALL SELECT id, score FROM obj) GROUP BY id ORDER BY score DESC, id LIMIT 10)"""


on_graph("rc4_change", f"WITH {_changes(['what', 'did', 'customer#000000012', 'prefer'], 'customer#000000012')} SELECT * FROM then_hits")(lambda g: R.change(g.seen_by("shared"), "what did Customer#000000012 prefer", "1997-06-01"))
on_graph("rc6_merge", f"WITH a AS (SELECT entity_id AS id, {_COS.format(a='vector', b=_QSQL)} AS score FROM {_SEEN} ORDER BY score DESC, id LIMIT 10), b AS (SELECT entity_id AS id, 0.3 AS score FROM {_SEEN} ORDER BY id LIMIT 10) SELECT id, max(score)::DOUBLE AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id ORDER BY score DESC, id LIMIT 10")(
    lambda g: R.merge(V.knn(g.seen_by("shared"), Q).withColumn("layer", F.lit("vector")), V._visible(g.seen_by("shared")).orderBy("entity_id").limit(10).select(F.col("entity_id").alias("id"), F.lit(0.3).alias("score"), F.lit("graph").alias("layer"))).select("id", "score")
)
on_graph(
    "rc6_hybrid",
    f"WITH {_FACT}, {_changes(['when', 'did', 'nation_1', 'change'], 'nation_1')}, {_WIDE.replace('l AS (', 'near_links AS (').replace('JOIN l ON l.source_id', 'JOIN near_links ON near_links.source_id')}, every AS (SELECT id, score, 'vector' AS layer FROM top UNION ALL SELECT * FROM facts UNION ALL SELECT * FROM then_hits) SELECT id, score, layer FROM every QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, layer DESC) = 1 ORDER BY score DESC, id LIMIT 10",
)(lambda g: R.hybrid(g.seen_by("shared"), "when did NATION_1 change", Q, "1997-06-01"))
on_graph("rc7_low_confidence", f"SELECT coalesce(max(score), 0) < 0.2 AS low_confidence FROM (SELECT {_COS.format(a='vector', b=_QSQL)} AS score FROM {_SEEN} ORDER BY 1 DESC LIMIT 10)")(lambda g: R.low_confidence(V.knn(g.seen_by("shared"), Q)))
on_graph("rc8_provenance_of_hits", f"WITH h AS (SELECT entity_id AS id, {_COS.format(a='vector', b=_QSQL)} AS score FROM {_SEEN} ORDER BY score DESC, id LIMIT 3) SELECT DISTINCT s.id FROM sources s JOIN edges e ON e.source_ref = s.id WHERE e.source_id IN (SELECT id FROM h) OR e.target_id IN (SELECT id FROM h)")(lambda g: S.provenance(g.edges, g.sources, V.knn(g.seen_by("shared"), Q, 3)).select("id"))
on_graph("rc9_access_touch", "SELECT n.id, n.access_count + u.n AS access_count FROM nodes n JOIN usr u ON n.id = 'user:' || u.user_id")(
    lambda g: R.touched(g.entities, g.entities.where("type = 'USER'").select("id", "access_count", F.col("last_accessed_at").alias("ts")).withColumn("x", F.explode(F.sequence(F.lit(1), F.col("access_count").cast("int"))))).where("type = 'USER'").select("id", "access_count")
)
on_graph("rc11_as_of", f"SELECT entity_id AS id, {_COS.format(a='vector', b=_QSQL)} AS score FROM vectors v JOIN nodes n ON n.id = v.entity_id WHERE n.valid_from <= TIMESTAMP '1997-01-01' AND (n.valid_until IS NULL OR n.valid_until > TIMESTAMP '1997-01-01') ORDER BY score DESC, id LIMIT 10")(lambda g: V.knn(g.seen_at("1997-01-01"), Q))
on_graph("rc13_rendered", f"SELECT row_number() OVER (ORDER BY score DESC, id)::INTEGER AS line, '- ' || name || ' (' || type || ', score ' || printf('%.2f', score) || ')' AS text FROM (SELECT entity_id AS id, n.name, n.type, {_COS.format(a='vector', b=_QSQL)} AS score FROM vectors v JOIN nodes n ON n.id = v.entity_id AND n.scope = 'shared' AND n.valid_until IS NULL ORDER BY score DESC, id LIMIT 5)")(lambda g: R.rendered(g, V.knn(g.seen_by("shared"), Q, 5)))

# --- ingest -----------------------------------------------------------------------------------------------

_NOUNS = """s AS (SELECT doc_id, unnest(list_filter(string_split(regexp_replace(trim(text), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')) AS sentence, generate_subscripts(list_filter(string_split(regexp_replace(trim(text), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> ''), 1) AS i FROM documents),
n AS (SELECT doc_id, i, sentence, list_filter(regexp_extract_all(sentence, '[A-Za-z][A-Za-z0-9_-]*'), lambda w: regexp_matches(w, '^[A-Z].') AND lower(w) NOT IN ('the', 'a', 'an', 'this', 'that', 'these', 'those')) AS nouns FROM s)"""


def _documents(t) -> DataFrame:
    return t("documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"))


on_tables("in1_extract_entities", f"WITH {_NOUNS}, w AS (SELECT doc_id, i, unnest(nouns) AS name, generate_subscripts(nouns, 1) AS j FROM n) SELECT doc_id::VARCHAR AS id, arg_min(name, i * 100000 + j) AS name FROM w GROUP BY doc_id, lower(name)")(lambda t: I.extract_entities(_documents(t)).select("id", "name"))
on_tables("in1_extract_triples", f"WITH {_NOUNS} SELECT doc_id::VARCHAR AS id, lower(nouns[1]) || '|RELATED_TO|' || lower(o) AS fingerprint, count(*) AS n FROM (SELECT doc_id, nouns, unnest(nouns[2:]) AS o FROM n WHERE len(nouns) >= 2) GROUP BY 1, 2")(
    lambda t: I.extract_triples(_documents(t)).withColumn("fingerprint", T.fingerprint(F.col("subject"), F.lit("RELATED_TO"), F.col("object"))).groupBy("id", "fingerprint").agg(F.count("*").alias("n"))
)
on_tables("in3_first_of_subject", f"WITH {_NOUNS}, x AS (SELECT doc_id, i, lower(nouns[1]) AS s, unnest(nouns[2:]) AS o, generate_subscripts(nouns[2:], 1) AS j FROM n WHERE len(nouns) >= 2) SELECT doc_id::VARCHAR AS id, s AS subject, arg_min(o, i * 100000 + j) AS object FROM x GROUP BY doc_id, s")(
    lambda t: I.first_of_subject(I.extract_triples(_documents(t)).withColumn("predicate", F.lit("RELATED_TO"))).select("id", F.lower("subject").alias("subject"), "object")
)


on_tables("in2_ingest_documents")(lambda t: _edges_of(t("documents").sparkSession, t("documents").select(F.col("text").alias("content"), F.timestamp_seconds("doc_id").cast("timestamp_ntz").alias("ts"))))


@on_tables("in2_ingest", "SELECT * FROM (VALUES ('kendra', 'PREFERS', 'adidas', true), ('kendra', 'PREFERS', 'nike', false), ('nike', 'CONTRADICTS', 'adidas', false), ('bob', 'OWNS', 'acme', false)) t(subject, relation, object, closed)")
def _(t) -> DataFrame:
    return _ingested(t, [("Kendra prefers Adidas.", "2025-01-01 00:00:00"), ("Bob owns Acme.", "2025-01-02 00:00:00"), ("Kendra prefers Nike.", "2025-04-01 00:00:00"), ("Bob owns Acme.", "2025-05-01 00:00:00")])


@on_tables("in4_contradictions_return", "SELECT * FROM (VALUES ('kendra', 'PREFERS', 'adidas', true), ('kendra', 'PREFERS', 'nike', true), ('kendra', 'PREFERS', 'adidas', false), ('nike', 'CONTRADICTS', 'adidas', false), ('adidas', 'CONTRADICTS', 'nike', false)) t(subject, relation, object, closed)")
def _(t) -> DataFrame:
    return _ingested(t, [("Kendra prefers Adidas.", "2025-01-01 00:00:00"), ("Kendra prefers Nike.", "2025-04-01 00:00:00"), ("Kendra prefers Adidas again.", "2025-05-01 00:00:00")])


def _ingested(t, rows: list[tuple[str, str]]) -> DataFrame:
    spark = t("region").sparkSession
    items = spark.createDataFrame(rows, "content string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return _edges_of(spark, items)


def _edges_of(spark: SparkSession, items: DataFrame) -> DataFrame:
    out = I.ingest({n: empty(spark, n) for n in SCHEMAS}, items, NOW, unique=I.UNIQUE)
    names = out["entities"].select("id", "canonical_name")
    e = out["edges"].join(names.withColumnsRenamed({"id": "source_id", "canonical_name": "subject"}), "source_id").join(names.withColumnsRenamed({"id": "target_id", "canonical_name": "object"}), "target_id")
    return e.select("subject", F.col("relation_type").alias("relation"), "object", F.col("valid_until").isNotNull().alias("closed"))


on_tables("in6_turns_to_items", "SELECT conv_id, text AS content FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS k FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> '') WHERE k = 1")(lambda t: I.turns_to_items(t("conversations")))

# --- code -------------------------------------------------------------------------------------------------

_FILES = [
    ("app.py", '"""App."""\nimport os\nfrom lib import helper\n\n\ndef main(n: int) -> int:\n    """Run."""\n    helper(n)\n    w = build()\n    w.render()\n    return len(str(n))\n\n\ndef build():\n    return Widget()\n\n\nclass Base:\n    pass\n\n\nclass Widget(Base):\n    def render(self):\n        return self._escape("x")\n\n    def _escape(self, s):\n        return s.replace("<", "")\n'),
    ("lib/__init__.py", "def helper(n):\n    return validate(n)\n\n\ndef validate(n):\n    return mystery(n)\n"),
]


def _files(t) -> DataFrame:
    return t("region").sparkSession.createDataFrame(_FILES, "path string, content string")


def _code(t) -> Snapshot:
    spark = t("region").sparkSession
    out = CO.ingest({n: empty(spark, n) for n in SCHEMAS}, _files(t), NOW)
    return Snapshot(cut(out["entities"]), cut(out["edges"]), out["sources"])


on_tables("co2_extract_entities", "SELECT * FROM (VALUES ('module', 'app', 'public'), ('function', 'main', 'public'), ('function', 'build', 'public'), ('class', 'Base', 'public'), ('class', 'Widget', 'public'), ('method', 'Widget.render', 'public'), ('method', 'Widget._escape', 'private'), ('module', 'lib', 'public'), ('function', 'helper', 'public'), ('function', 'validate', 'public')) t(type, name, visibility)")(lambda t: CO.extract_entities(_files(t)).select("type", "name", "visibility"))
_OTHER_FILES = [
    ("cat.go", 'package pets\nimport "fmt"\ntype Cat struct { Name string }\nfunc (c *Cat) Meow() string { return c.Name }\nfunc run() { fmt.Println("}") }\n'),
    ("cat.rs", "use std::io;\npub struct Cat { n: u8 }\nimpl Animal for Cat { pub fn meow(&self) -> u8 { help(self.n) } }\n"),
    ("Cat.java", "package com.acme;\nimport java.util.List;\npublic class Cat extends Animal { public String meow() { return purr(); } }\n"),
    ("cat.php", "<?php\nnamespace App;\nclass Cat extends Animal { function meow() { return purr(); } }\nfunction hi() {}\n"),
    ("cat.ts", "import { a } from './x'\nclass Cat extends Animal { meow() { return purr() } }\nconst go = () => { run() }\n"),
]
_OTHER_ROWS = ", ".join(f"('{p}', '{n}', '{k}')" for p, n, k in [
    ("cat.go", "pets", "module"), ("cat.go", "Cat", "class"), ("cat.go", "Cat.Meow", "method"), ("cat.go", "run", "function"), ("cat.rs", "cat", "module"), ("cat.rs", "Cat", "class"), ("cat.rs", "Cat.meow", "method"),
    ("Cat.java", "com.acme", "module"), ("Cat.java", "Cat", "class"), ("Cat.java", "Cat.meow", "method"), ("cat.php", "App", "module"), ("cat.php", "Cat", "class"), ("cat.php", "Cat.meow", "method"), ("cat.php", "hi", "function"),
    ("cat.ts", "cat", "module"), ("cat.ts", "Cat", "class"), ("cat.ts", "Cat.meow", "method"), ("cat.ts", "go", "function"),
])
_OTHER_LINKS = ", ".join(f"('{p}', '{s}', '{r}', '{o}')" for p, s, r, o in [
    ("cat.go", "pets", "IMPORTS", "fmt"), ("cat.go", "run", "CALLS", "Println"), ("cat.rs", "cat", "IMPORTS", "std::io"), ("cat.rs", "Cat", "INHERITS_FROM", "Animal"), ("cat.rs", "Cat.meow", "CALLS", "help"),
    ("Cat.java", "com.acme", "IMPORTS", "java.util.List"), ("Cat.java", "Cat", "INHERITS_FROM", "Animal"), ("Cat.java", "Cat.meow", "CALLS", "purr"), ("cat.php", "Cat", "INHERITS_FROM", "Animal"), ("cat.php", "Cat.meow", "CALLS", "purr"),
    ("cat.ts", "cat", "IMPORTS", "./x"), ("cat.ts", "Cat", "INHERITS_FROM", "Animal"), ("cat.ts", "Cat.meow", "CALLS", "purr"), ("cat.ts", "go", "CALLS", "run"),
])


def _other_files(t) -> DataFrame:
    return t("region").sparkSession.createDataFrame(_OTHER_FILES, "path string, content string")


on_tables("co3_languages", f"SELECT * FROM (VALUES {_OTHER_ROWS}) t(path, name, type)")(lambda t: CO.extract_entities(_other_files(t)).select("path", "name", "type"))
on_tables("co3_language_links", f"SELECT * FROM (VALUES {_OTHER_LINKS}) t(path, source, relation, target)")(lambda t: CO.extract_links(_other_files(t)).where("relation <> 'DEFINES'").select("path", "source", "relation", "target"))
on_tables("co4_structure", "SELECT * FROM (VALUES ('app', 'os', 'IMPORTS'), ('app', 'lib', 'IMPORTS'), ('app', 'main', 'DEFINES'), ('app', 'build', 'DEFINES'), ('app', 'Base', 'DEFINES'), ('app', 'Widget', 'DEFINES'), ('Widget', 'Base', 'INHERITS_FROM'), ('Widget', 'Widget.render', 'DEFINES'), ('Widget', 'Widget._escape', 'DEFINES'), ('lib', 'helper', 'DEFINES'), ('lib', 'validate', 'DEFINES')) t(source, target, relation)")(
    lambda t: CO.extract_links(_files(t)).where("relation <> 'CALLS'").select("source", "target", "relation")
)


@on_tables("co5_resolve_calls", "SELECT * FROM (VALUES ('main', 'helper'), ('main', 'build'), ('main', 'widget.render'), ('build', 'widget'), ('widget.render', 'widget._escape'), ('helper', 'validate'), ('validate', 'mystery')) t(caller, callee)")
def _(t) -> DataFrame:
    g = _code(t)
    names = g.entities.select("id", "canonical_name")
    calls = g.edges.where("relation_type = 'CALLS'").join(names.withColumnsRenamed({"id": "source_id", "canonical_name": "caller"}), "source_id").join(names.withColumnsRenamed({"id": "target_id", "canonical_name": "callee"}), "target_id")
    return calls.select("caller", "callee")


on_tables("co7_callers", "SELECT * FROM (VALUES ('main')) t(name)")(lambda t: CO.callers(_code(t), "build", rounds=6).select("name"))
on_tables("co8_callees", "SELECT * FROM (VALUES ('helper', 1.0::DOUBLE), ('build', 1.0), ('Widget.render', 1.0)) t(name, confidence_score)")(lambda t: CO.callees(_code(t), "main").select("name", "confidence_score"))
on_tables("co9_impact")(lambda t: CO.impact(_code(t), "helper", rounds=6).select("type", "name"))
on_tables("co10_defined_in", "SELECT * FROM (VALUES ('function', 'helper'), ('function', 'validate'), ('module', 'lib')) t(type, name)")(lambda t: CO.defined_in(_code(t), "lib/__init__.py").select("type", "name"))
on_tables("gr8_codebase_map")(lambda t: G.codebase_map(_code(t), budget=20, rounds=6).select("type", "name", "used"))


@on_tables("co11_diff", "SELECT * FROM (VALUES ('added', 'logout'), ('changed', 'login')) t(change, canonical_name)")
def _(t) -> DataFrame:
    spark = t("region").sparkSession
    files = spark.createDataFrame([("c1", "auth.py", "def login(user):\n    pass\n"), ("c2", "auth.py", "def login(user, password):\n    pass\n\n\ndef logout():\n    pass\n")], "commit string, path string, content string")
    out = CO.ingest({n: empty(spark, n) for n in SCHEMAS}, files, NOW)
    return CO.diff(out["entities"], "c1", "c2")


# --- maintenance ------------------------------------------------------------------------------------------

on_graph("mt1_demote", "SELECT tier, count(*) AS n FROM (SELECT CASE WHEN tier = 'warm' AND last_accessed_at < TIMESTAMP '2024-01-02' THEN 'cold' ELSE tier END AS tier FROM nodes) GROUP BY tier")(lambda g: M.demote(g.entities, NOW, "r")[0].groupBy("tier").agg(F.count("*").alias("n")))
on_graph("mt2_stale_audit", "SELECT 'STALE_FLAG' AS op, id AS target_id FROM nodes n WHERE tier = 'warm' AND valid_until IS NULL AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.target_id = n.id AND e.detected_at > TIMESTAMP '2024-01-02')")(lambda g: M.flag_stale(g.entities, g.edges, NOW, "r")[1].select("op", "target_id"))


@on_graph(
    "mt3_merge_duplicates",
    """WITH c AS (SELECT id, scope, coalesce(owner_id, '') AS owner, substr(id, 10)::BIGINT // 10 AS twins FROM nodes WHERE type = 'CUSTOMER' AND valid_until IS NULL),
k AS (SELECT twins, scope, owner, min(id) AS keeper FROM c GROUP BY ALL),
m AS (SELECT c.id, k.keeper FROM c JOIN k ON c.twins = k.twins AND c.scope = k.scope AND c.owner = k.owner)
SELECT coalesce(m.keeper, e.source_id) AS id, count(*) AS n FROM edges e LEFT JOIN m ON m.id = e.source_id WHERE e.relation_type = 'PLACED' GROUP BY 1""",
)
def _(g: Snapshot) -> DataFrame:
    """Every ten customers have one name and vector."""
    twins = F.expr("cast(substr(id, 10) as bigint) div 10")
    e = g.entities.where("type = 'CUSTOMER'").withColumn("canonical_name", F.concat(F.lit("twin"), twins.cast("string")))
    v = e.select(F.col("id").alias("entity_id"), F.lit("given").alias("model_name"), F.lit("1").alias("model_version"), F.lit(2).alias("dim"), F.array(F.lit(1.0), twins.cast("double")).cast("array<float>").alias("vector"), "created_at")
    _, edges, _ = M.merge_duplicates(e, g.edges.where("relation_type = 'PLACED'"), v, NOW, "r")
    return edges.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("n"))


on_graph("mt4_strengths", "SELECT id AS entity_id, round(importance * exp(-ln(2) / 30 * greatest(0, (epoch(TIMESTAMP '2024-02-01') - epoch(last_accessed_at)) / 86400.0)) * (1 + 0.2 * access_count), 6) AS strength FROM nodes WHERE valid_until IS NULL")(lambda g: M.strengths(g.entities, NOW).select("entity_id", F.round("strength", 6).alias("strength")))
on_graph("mt5_audit", "SELECT 'DEMOTE' AS op, id AS target_id, '{\"tier\":\"warm\"}' AS before_json, '{\"tier\":\"cold\"}' AS after_json, 'consolidator' AS actor FROM nodes WHERE tier = 'warm' AND last_accessed_at < TIMESTAMP '2024-01-02'")(lambda g: M.demote(g.entities, NOW, "r")[1].select("op", "target_id", "before_json", "after_json", "actor"))


# --- stores, sources, views, streams ----------------------------------------------------------------------


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/bitempo-{uuid.uuid4().hex}/{name}"


def _nations(g: Snapshot) -> DataFrame:
    return g.entities.where("type = 'NATION'")


@on_graph("dm16_load_replace", "SELECT id FROM nodes")
def _(g: Snapshot) -> DataFrame:
    spark = g.entities.sparkSession
    one, two = (Store(spark, _place(spark, n)) for n in ("one", "two"))
    one.write({"entities": g.entities})
    two.write({"entities": _nations(g)})
    L.load_from(two, one, "replace")
    return two.read("entities").select("id")


@on_graph("dm16_load_merge", "SELECT id FROM nodes")
def _(g: Snapshot) -> DataFrame:
    spark = g.entities.sparkSession
    one, two = (Store(spark, _place(spark, n)) for n in ("one", "two"))
    one.write({"entities": g.entities})
    two.write({"entities": _nations(g)})
    L.load_from(two, one)
    return two.read("entities").select("id")


@on_graph("dm18_versions", "SELECT 1 AS version, count(*) FILTER (type <> 'REGION') AS n FROM nodes UNION ALL SELECT 2, count(*) FROM nodes")
def _(g: Snapshot) -> DataFrame:
    spark = g.entities.sparkSession
    store = Store(spark, _place(spark, "db"))
    seen = [(store.write({"entities": g.entities.where("type <> 'REGION'")}), store.read("entities").count()), (store.append("entities", g.entities.where("type = 'REGION'")), store.read("entities").count())]
    return spark.createDataFrame(seen, "version int, n long")


@on_graph("dm19_sizes", "SELECT 'entities' AS name, true AS some")
def _(g: Snapshot) -> DataFrame:
    spark = g.entities.sparkSession
    store = Store(spark, _place(spark, "db"))
    store.write({"entities": g.entities})
    return spark.createDataFrame([(k, v > 0) for k, v in store.sizes().items()], "name string, some boolean")


@on_graph("sc14_open_readonly", "SELECT count(*) AS n FROM nodes")
def _(g: Snapshot) -> DataFrame:
    spark = g.entities.sparkSession
    path = _place(spark, "db")
    Store(spark, path).write({"entities": g.entities})
    return open_readonly(spark, path).read("entities").agg(F.count("*").alias("n"))


on_tables("dm11_scan_record", "SELECT '/r' AS repo_path, 3::BIGINT AS files_scanned, NULL::VARCHAR AS agent_id")(lambda t: D.scan_record(t("region").sparkSession, NOW, repo_path="/r", files_scanned=3).select("repo_path", "files_scanned", "agent_id"))


@on_tables("sc15_lines", "SELECT r_name AS content FROM region")
def _(t) -> DataFrame:
    path = _place(t("region").sparkSession, "lines")
    t("region").select("r_name").union(t("region").limit(1).select(F.lit("  "))).write.text(path)
    return files.lines(t("region").sparkSession, path).select("content")


@on_tables("sc16_turns", "SELECT role, text FROM (VALUES ('user', 'hi'), ('assistant', 'a' || chr(10) || 'b')) t(role, text)")
def _(t) -> DataFrame:
    spark = t("region").sparkSession
    path = _place(spark, "turns")
    spark.createDataFrame([('{"role":"user","content":"hi"}',), ("not json",), ('{"role":"assistant","content":[{"type":"text","text":"a"},{"type":"x"},{"type":"text","text":"b"}]}',)], "v string").coalesce(1).write.text(path)
    return files.turns(spark, path).select("role", "text")


@on_graph("vw3_run_view", "SELECT DISTINCT name FROM nodes WHERE type = 'REGION'")
def _(g: Snapshot) -> DataFrame:
    v = Views(g.entities.sparkSession)
    v.save("regions", "MATCH (r:REGION) RETURN r.name AS name", NOW)
    return v.run("regions", g, now=NOW)


@on_graph("vw2_list_views", "SELECT * FROM (VALUES ('a'), ('c')) t(name)")
def _(g: Snapshot) -> DataFrame:
    v = Views(g.entities.sparkSession)
    for n in "cba":
        v.save(n, "MATCH (r:REGION) RETURN r.name AS name", NOW)
    v.delete("b")
    return v.list().select("name")


on_graph("rc12_ask", "SELECT DISTINCT name FROM nodes WHERE type = 'REGION'")(lambda g: R.ask(g, "which regions are there", lambda q: "MATCH (r:REGION) RETURN r.name AS name", lambda q: C.browse_type(g, "REGION").select("name")))
on_graph("rc12_ask_fallback", "SELECT DISTINCT name FROM nodes WHERE type = 'REGION'")(lambda g: R.ask(g, "which regions are there", lambda q: "no query", lambda q: C.browse_type(g, "REGION").select("name")))
on_tables("rc5_code")(lambda t: R.code(_code(t), "who calls helper", rounds=6))


@on_tables("co13_scan", "SELECT * FROM (VALUES ('app.py', 'changed'), ('new.py', 'added'), ('lib/__init__.py', 'removed')) t(path, change)")
def _(t) -> DataFrame:
    spark = t("region").sparkSession
    now = spark.createDataFrame([("app.py", "x = 1\n"), ("new.py", "y = 2\n")], "path string, content string")
    return CO.changed_files(_files(t), now).select("path", "change")


@on_tables("co13_scan_entities", "SELECT * FROM (VALUES ('app', 'module'), ('f', 'function')) t(name, type)")
def _(t) -> DataFrame:
    spark = t("region").sparkSession
    first = CO.ingest({n: empty(spark, n) for n in SCHEMAS}, _files(t), NOW)
    now = spark.createDataFrame([("app.py", "def f():\n    pass\n")], "path string, content string")
    out, _ = CO.scan({n: cut(df) for n, df in first.items()}, _files(t), now, "2024-03-01 00:00:00")
    return out["entities"].where("valid_until is null and code_file is not null").select("name", "type")


@on_tables("st_c_supersession", "SELECT c, value, previous FROM (" + ORACLE_SQL["wn3_validity_chain"] + ")")
def _(t) -> DataFrame:
    spark = t("region").sparkSession
    src, out, ck = (_place(spark, n) for n in ("in", "out", "ck"))
    o = t("orders").select(F.col("o_custkey").cast("string").alias("subject"), F.lit("PREFERS").alias("predicate"), F.col("o_orderpriority").alias("object"), F.expr("cast(o_orderdate as timestamp) + make_interval(0, 0, 0, 0, 0, 0, o_orderkey / 1000000)").alias("ts"))
    o.write.parquet(src)
    jobs.drain(jobs.supersessions(jobs.incremental_files(spark, src, "subject string, predicate string, object string, ts timestamp")), out, ck)
    return spark.read.parquet(out).select(F.col("subject").cast("long").alias("c"), F.col("object").alias("value"), "previous")


@on_tables("st_a_once_by_content", "SELECT DISTINCT sha256(text) AS content_hash FROM documents")
def _(t) -> DataFrame:
    spark = t("region").sparkSession
    src, out, ck = (_place(spark, n) for n in ("in", "out", "ck"))
    t("documents").select(F.col("text").alias("content"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts")).write.parquet(src)
    jobs.drain(jobs.once_by_content(jobs.incremental_files(spark, src, "content string, ts timestamp")).select("content_hash"), out, ck)
    return spark.read.parquet(out)


@on_tables("st_b_touches", "SELECT start, id, count(*) AS n, max(ts) AS last_at FROM (SELECT date_trunc('hour', ts) AS start, user_id::VARCHAR AS id, ts FROM events) GROUP BY start, id HAVING start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)")
def _(t) -> DataFrame:
    spark = t("region").sparkSession
    src, out, ck = (_place(spark, n) for n in ("in", "out", "ck"))
    t("events").select(F.col("user_id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("ts")).write.parquet(src)
    jobs.drain(jobs.touches(jobs.incremental_files(spark, src, "id string, ts timestamp")).select("window.start", "id", "n", "last_at"), out, ck)
    return spark.read.parquet(out).select(F.col("start").cast("timestamp_ntz").alias("start"), "id", "n", F.col("last_at").cast("timestamp_ntz").alias("last_at"))


on_graph(
    "mt6_consolidate",
    "SELECT 'DEMOTE' AS op, count(*) AS n FROM nodes WHERE tier = 'warm' AND last_accessed_at < TIMESTAMP '2024-01-02' UNION ALL SELECT 'STALE_FLAG', count(*) FROM nodes n WHERE tier = 'warm' AND last_accessed_at >= TIMESTAMP '2024-01-02' AND valid_until IS NULL AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.target_id = n.id AND e.detected_at > TIMESTAMP '2024-01-02')",
)(lambda g: M.consolidate(_tables(g) | {"consolidation_log": empty(g.entities.sparkSession, "consolidation_log")}, NOW, "r")["consolidation_log"].where("op <> 'MERGE'").groupBy("op").agg(F.count("*").alias("n")))
