import pytest
from pyspark.sql import functions as F

from bitempo.model import conform
from bitempo.plans.cypher import CypherSyntaxError, UnsupportedCypher, cypher, parse
from bitempo.plans.views import ViewError, Views
from bitempo.snapshot import Snapshot

T0 = "2025-01-01 00:00:00"


@pytest.fixture(scope="module")
def people(spark):
    e = spark.createDataFrame([("a", "PERSON", "Alice", "shared", None), ("b", "PERSON", "Bob", "shared", None), ("c", "ORGANIZATION", "Acme", "shared", None), ("s", "PERSON", "Secret", "private", "alice")], "id string, type string, name string, scope string, owner_id string")
    e = conform(e.withColumns({"canonical_name": F.lower("name"), "valid_from": F.lit(T0).cast("timestamp_ntz"), "learned_at": F.lit(T0).cast("timestamp_ntz"), "attrs_json": F.lit('{"age":7,"x_y":"q"}')}), "entities")
    l = spark.createDataFrame([("1", "a", "c", "WORKS_AT", 0.9, None), ("2", "b", "c", "WORKS_AT", 0.9, "2025-02-01 00:00:00")], "id string, source_id string, target_id string, relation_type string, confidence_score double, valid_until string")  # noqa: E741
    l = conform(l.withColumn("valid_from", F.lit(T0).cast("timestamp_ntz")), "edges")  # noqa: E741
    return Snapshot(e, l).seen_by("all")


def names(df, *cols):
    return {tuple(r) if len(r) > 1 else r[0] for r in df.collect()}


def test_match_and_hop(people):
    assert names(cypher(people, "MATCH (p:PERSON) RETURN p.name")) == {"Alice", "Bob"}
    assert names(cypher(people, "MATCH (p:PERSON)-[:WORKS_AT]->(o) RETURN p.name, o.name")) == {("Alice", "Acme")}
    assert names(cypher(people, 'MATCH (p) WHERE p.name STARTS WITH "Al" RETURN p.name')) == {"Alice"}


def test_time_travel_sees_retired_edges(people):
    q = "MATCH (p:PERSON)-[:WORKS_AT]->(o) RETURN p.name AS_OF '2025-01-15'"
    assert names(cypher(people, q)) == {"Alice", "Bob"}
    assert names(cypher(people, q.replace("01-15", "02-01"))) == {"Alice"}  # the end is exclusive


def test_owner_sees_own(people):
    assert names(cypher(people.seen_by("all", "alice"), "MATCH (p:PERSON) RETURN p.name")) == {"Alice", "Bob", "Secret"}
    assert names(cypher(people.seen_by("all", "bob"), "MATCH (p:PERSON) RETURN p.name")) == {"Alice", "Bob"}


def test_wildcards_are_text_and_case(people):
    assert names(cypher(people, "MATCH (p) WHERE p.name CONTAINS '%' RETURN p.name")) == set()
    assert names(cypher(people, "MATCH (p) WHERE p.name CONTAINS 'ALI' RETURN p.name")) == {"Alice"}
    assert names(cypher(people, "MATCH (p) WHERE p.name CONTAINS 'ALI' RETURN p.name", strict=True)) == set()
    assert names(cypher(people, "MATCH (p) WHERE p.age = 7 AND p.x_y = 'q' AND p.name IN ['Bob'] RETURN p.name")) == {"Bob"}


def test_pages(people):
    assert [r[0] for r in cypher(people, "MATCH (p) RETURN p.name AS n ORDER BY p.name DESC SKIP 1 LIMIT 1").collect()] == ["Alice"]
    assert cypher(people, "MATCH (p) RETURN p.name LIMIT 0").count() == 0


@pytest.mark.parametrize("text", ["RETURN x", "MATCH (a RETURN a", "MATCH (a) RETURN b", "MATCH (a) WHERE a.x RETURN a", "MATCH (a) RETURN a LIMIT x", "MATCH (a) RETURN a AS_OF 3", "MATCH (a)-[r]-(b) RETURN a.%"])
def test_syntax_errors(people, text):
    with pytest.raises(CypherSyntaxError):
        cypher(people, text)


@pytest.mark.parametrize("text", ["MATCH (a)-[:R*1..3]->(b) RETURN a", "OPTIONAL MATCH (a) RETURN a", "MATCH (a) RETURN count(a)", "CREATE (a) RETURN a", "MATCH p = (a)-[:R]->(b) RETURN a", "MATCH (a) WITH a RETURN a"])
def test_unsupported(text):
    with pytest.raises(UnsupportedCypher):
        parse(text)


def test_parity_refuses_or():
    parse("MATCH (a) WHERE a.x = 1 OR a.y = 2 RETURN a")
    with pytest.raises(UnsupportedCypher):
        parse("MATCH (a) WHERE a.x = 1 OR a.y = 2 RETURN a", parity=True)


def test_views(spark, people):
    v = Views(spark)
    v.save("people", "MATCH (p:PERSON) RETURN p.name AS name", T0)
    assert names(v.run("people", people, now=T0)) == {"Alice", "Bob"}
    assert v.list().first().last_run_count == 2
    with pytest.raises(ViewError):
        v.save("people", "MATCH (p) RETURN p", T0, replace=False)
    with pytest.raises(ViewError):
        v.save("1x", "MATCH (p) RETURN p", T0)
    assert v.delete("people") and not v.delete("people")
    with pytest.raises(ViewError):
        v.show("people")
