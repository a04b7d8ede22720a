"""Steps that grew faster than their input, or left rows out."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F
from test_operators import links, nodes
from test_whole import same_rows

from bitempo.functions.embed import bag_of_words
from bitempo.operators import blocks, dml, vectors
from bitempo.operators import graph as G
from bitempo.plans.cypher import cypher
from bitempo.snapshot import Snapshot


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranks_of_many_blocks(spark, monkeypatch):
    """Blocks of few entities, packed few links at a time, give what SQL and the one block give."""
    name = "gr2_pagerank_3_rounds"
    monkeypatch.setattr(blocks, "BLOCK", 400)
    monkeypatch.setattr(blocks, "PACKED", 500)
    assert len(same_rows(spark, name)) > 1000


def test_seeds_alone_and_push_over_blocks(spark, monkeypatch):
    rows = [("seed", "x", "R", 0.9), ("x", "hub", "R", 0.9), ("y", "hub", "R", 0.5), ("seed", "y", "R", 0.2), ("hub", "hub", "R", 0.4), ("x", "y", "CONTRADICTS", 0.9), ("x", "hub", "R", 0.3)]
    g = Snapshot(nodes(spark, [(x, x, "shared", None) for x in ("seed", "x", "y", "hub", "lone")]), links(spark, rows))
    ranks = lambda: [{r.id: r.score for r in df.collect()} for df in (G.pagerank(g, ["seed", "lone"]), G.push_pagerank(g, ["seed", "lone"], epsilon=0.05))]
    one = ranks()
    monkeypatch.setattr(blocks, "BLOCK", 1)
    many = ranks()
    assert one[0].keys() == {"seed", "x", "y", "hub", "lone"} and sum(one[0].values()) == pytest.approx(1)
    for a, b in zip(one, many):
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-12) for k in a)


def test_a_round_exchanges_no_links(spark):
    g = Snapshot(nodes(spark, [(x, x, "shared", None) for x in "ab"]), links(spark, [("a", "b", "R", 0.9)]))
    b = blocks.Blocks(g.nodes().select("id"), G._weighted(g))
    spread = plan(b.spread(b.out.withColumnRenamed("x", "z")))
    assert "CartesianProduct" in spread and "hashpartitioning" not in spread


def test_cycle_of_many_edges_side_by_side(spark):
    """Edges between the same entities count once before they are joined: 3,000 each way would make 9,000,000 pairs."""
    rows = [("a", "b", "R", 0.5), ("b", "a", "R", 0.5)] * 3000
    g = Snapshot(nodes(spark, [(x, x, "shared", None) for x in "ab"]), links(spark, rows))
    df = cypher(g, "MATCH (x)-[:R]->(y)-[:R]->(x) RETURN x.name AS x, y.name AS y")
    assert sorted(map(tuple, df.collect())) == [("a", "b"), ("b", "a")]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") >= 3
    named = cypher(g, "MATCH (x)-[e:R]->(y)-[:R]->(x) WHERE e.confidence_score > 0.4 RETURN x.name AS x, e.confidence_score AS c")
    assert sorted(map(tuple, named.collect())) == [("a", 0.5), ("b", 0.5)]


def test_triples_with_ids_of_one_fact(spark):
    t = F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")
    rows = spark.createDataFrame([("t1", "a", "P", "b"), ("t2", "a", "P", "b"), ("t2", "a", "P", "b"), ("t3", "a", "P", "c")], "id string, subject_id string, predicate string, object_id string").withColumns({"valid_from": t, "edge_id": F.col("id"), "fingerprint": F.lit("f")})
    assert sorted(r.id for r in dml.new_triples(rows.where("id = 't3'"), rows).collect()) == ["t1", "t2"]
    assert dml.new_triples(rows.where("id = 't3'"), rows.drop("id")).count() == 1


def test_batch_search_by_blocks(spark, monkeypatch):
    """Ties, vectors of another length and blocks smaller than k, against every pair."""
    ids = [f"v{i:02}" for i in range(40)]
    vector = lambda i: [float((i * 7 + d * d) % 11 - 5) for d in range(3)] if i % 13 else [1.0, 2.0]
    g = Snapshot(nodes(spark, [(x, x, "shared", None) for x in ids]), links(spark, [("v01", "v02", "R", 0.9)]), embeddings=spark.createDataFrame([(x, vector(i)) for i, x in enumerate(ids)], "entity_id string, vector array<float>"))
    queries = g.embeddings.where("entity_id in ('v03', 'v05', 'v13')").withColumnRenamed("entity_id", "query")
    df = vectors.knn_batch(g, queries, 4, block=1)
    got = sorted((r.query, r.id, r.score) for r in df.collect())
    want = []
    for q in ("v03", "v05", "v13"):
        a, scored = vector(int(q[1:])), []
        for i, x in enumerate(ids):
            b = vector(i)
            scored.append((x, round(sum(m * n for m, n in zip(a, b)) / (math.dist(a, [0] * len(a)) * math.dist(b, [0] * len(b)) + 1e-12), 9) if len(a) == len(b) else None))
        scored.sort(key=lambda s: (s[1] is None, -(s[1] or 0), s[0]))
        want += [(q, *s) for s in scored[:4]]
    assert got == sorted(want, key=lambda r: r[:2])
    assert "MapInArrow" in plan(df)


def test_bag_of_words_counts_a_word_once(spark):
    """Work that grows with the words and not with words times dimensions; nulls and texts without words as ever."""
    df = spark.createDataFrame([("b a A",), ("",), (None,), ("...",)], "t string").coalesce(1).select(bag_of_words(F.col("t"), 16).alias("v"))
    a, empty, null, dots = (r.v for r in df.collect())
    assert sum(x * x for x in a) == pytest.approx(1, abs=1e-6) and empty == dots == [1.0] + [0.0] * 15 and null is None
    assert "ArrowEvalPython" in plan(df)


def test_stream_keys_share_groups(spark, tmp_path):
    """Many keys in one group, over two runs with a late fact, as each key alone."""
    from bitempo.streaming import jobs

    schema, src, out, ck = "subject string, predicate string, object string, ts timestamp", *(str(tmp_path / n) for n in ("in", "out", "ck"))
    seen = {}
    for batch in ([("a", "P", "x", 1), ("b", "P", "x", 1), ("a", "P", "y", 5), (None, "P", "x", 2)], [("a", "P", "z", 3), ("b", "Q", "x", 9), ("b", "P", "x", 4), (None, "P", "y", 3)]):
        spark.createDataFrame(batch, "subject string, predicate string, object string, t long").selectExpr("subject", "predicate", "object", "timestamp_seconds(t) as ts").coalesce(1).write.mode("append").parquet(src)
        before = {tuple(r) for r in spark.read.parquet(out).collect()} if seen else set()
        jobs.drain(jobs.supersessions(jobs.incremental_files(spark, src, schema), groups=1), out, ck)
        for r in set(map(tuple, spark.read.parquet(out).collect())) - before:
            seen[r[:2] + (int(r[3].timestamp()), r[2])] = r[4]
    assert {k: v for k, v in seen.items() if v != k[3]} == {("a", "P", 1, "x"): None, ("a", "P", 3, "z"): "x", ("a", "P", 5, "y"): "z", ("b", "P", 1, "x"): None, ("b", "Q", 9, "x"): None, (None, "P", 2, "x"): None, (None, "P", 3, "y"): "x"}


def test_transitions_take_one_exchange(spark):
    df = G.transitions(links(spark, [("a", "b", "R", 0.8), ("a", "b", "R", 0.4), ("a", "c", "R", 0.4)]))
    assert {(r.src, r.dst): round(r.p, 6) for r in df.collect()} == {("a", "b"): 0.75, ("a", "c"): 0.25, ("b", "a"): 1.0, ("c", "a"): 1.0}
    assert plan(df).split("== Initial Plan ==")[-1].count("Exchange") == 1


def test_texts_are_read_once_for_an_ingest(spark):
    from bitempo.model import SCHEMAS, empty
    from bitempo.operators import ingest

    items = spark.createDataFrame([("Kendra prefers Adidas.",)], "content string")
    out = ingest.ingest({n: empty(spark, n) for n in SCHEMAS}, items, "2025-01-01 00:00:00", unique=ingest.UNIQUE)
    assert out["edges"].count() == 1 and "regexp_extract_all" not in out["edges"]._jdf.queryExecution().optimizedPlan().toString()
