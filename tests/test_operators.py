import pytest
from pyspark.sql import functions as F

from bitempo.functions import text as T
from bitempo.model import SCHEMAS, conform, empty, in_scope, moment
from bitempo.operators import code, dml, ingest, lifecycle, maintain, retrieval, vectors
from bitempo.operators import graph as G
from bitempo.snapshot import Snapshot
from bitempo.sources.store import Store, StoreError

T0 = "2025-01-01 00:00:00"


def nodes(spark, rows):
    """(id, name, scope, owner)"""
    df = spark.createDataFrame(rows, "id string, name string, scope string, owner_id string")
    t = F.lit(T0).cast("timestamp_ntz")
    return conform(df.withColumns({"type": F.lit("CONCEPT"), "canonical_name": F.lower("name"), "tier": F.lit("hot"), "importance": F.lit(0.5), "valid_from": t, "learned_at": t, "created_at": t, "last_accessed_at": t, "access_count": F.lit(0).cast("bigint"), "attrs_json": F.lit("{}")}), "entities")


def links(spark, rows):
    """(source, target, relation, confidence)"""
    df = spark.createDataFrame(rows, "source_id string, target_id string, relation_type string, confidence_score double")
    t = F.lit(T0).cast("timestamp_ntz")
    return conform(df.withColumns({"id": F.concat_ws(">", "source_id", "relation_type", "target_id"), "source_ref": F.lit("s"), "valid_from": t, "learned_at": t, "detected_at": t}), "edges")


def graph(spark, names, edges):
    return Snapshot(nodes(spark, [(n, n, "shared", None) for n in names]), links(spark, [(a, b, "R", w) for a, b, w in edges])).seen_by("all")


def test_neighbours_by_depth(spark):
    g = graph(spark, "abc", [("a", "b", 0.9), ("b", "c", 0.9)])
    assert {r.id for r in G.neighbours(g, "a", 1).collect()} == {"b"}
    assert {(r.id, r.hops) for r in G.neighbours(g, "a", 2).collect()} == {("b", 1), ("c", 2)}
    assert G.neighbours(g, "a", 0).count() == 0


def test_pagerank_prefers_hub_and_keeps_mass(spark):
    g = graph(spark, ["seed", "x", "y", "hub", "tail", "lone"], [("seed", "x", 0.9), ("seed", "y", 0.9), ("x", "hub", 0.9), ("y", "hub", 0.9), ("hub", "tail", 0.9)])
    p = {r.id: r.score for r in G.pagerank(g, ["seed", "lone"]).collect()}
    assert p["hub"] > p["tail"] and sum(p.values()) == pytest.approx(1)
    one = {r.id: r.score for r in G.pagerank(g, ["seed"]).collect()}
    local = {r.id: r.score for r in G.push_pagerank(g, ["seed"], epsilon=1e-4).collect()}
    top = lambda s: sorted(s, key=s.get)[-3:]
    assert len(set(top(one)) & set(top(local))) >= 2
    batch = {r.id: r.score for r in G.pagerank_batch(g, g.edges.sparkSession.createDataFrame([("q", "seed")], "query string, id string")).collect()}
    assert batch["hub"] == pytest.approx(one["hub"], abs=1e-3)
    assert G.pagerank(g, ["nobody"]).count() == 0


def test_private_stays_private(spark):
    e = nodes(spark, [("seed", "seed", "private", "alice"), ("a", "a", "private", "alice"), ("b", "b", "private", "bob")])
    g = Snapshot(e, links(spark, [("seed", "a", "R", 0.9), ("seed", "b", "R", 0.9)])).seen_by("all", "alice")
    assert {r.id for r in G.neighbours(g, "seed", 2).collect()} == {"a"}
    assert "b" not in {r.id for r in G.pagerank(g, ["seed"]).collect()}
    assert e.where(in_scope("private")).count() == 0
    with pytest.raises(ValueError):
        in_scope("nonsense")


def test_moment():
    assert moment("2025-01-01T02:00:00+02:00") == "2025-01-01 00:00:00" == moment("2025-01-01")


def _fresh(spark):
    return {n: empty(spark, n) for n in SCHEMAS}


def _items(spark, *rows):
    return spark.createDataFrame(rows, "content string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_ingest_is_idempotent_and_supersedes(spark):
    t = ingest.ingest(_fresh(spark), _items(spark, ("Kendra prefers Adidas.", T0)), T0, unique=["PREFERS"])
    t = {n: df.cache() for n, df in t.items()}
    again = ingest.ingest(t, _items(spark, ("Kendra prefers Adidas.", T0)), T0, unique=["PREFERS"])
    assert again["edges"].count() == 1 and again["entities"].count() == 2
    t2 = ingest.ingest(t, _items(spark, ("Kendra prefers Nike.", "2025-04-01 00:00:00")), T0, unique=["PREFERS"])
    g = Snapshot(t2["entities"], t2["edges"]).seen_by("all")
    at = lambda when: {r.name for r in g.seen_at(when).links().where("relation_type = 'PREFERS'").join(t2["entities"].select(F.col("id").alias("target_id"), "name"), "target_id").collect()}
    assert at("2025-02-10") == {"Adidas"} and at("2025-05-10") == {"Nike"}
    assert t2["edges"].where("relation_type = 'CONTRADICTS'").count() == 1


def test_first_triple_of_a_subject_is_kept(spark):
    t = ingest.ingest(_fresh(spark), _items(spark, ("Alice owns Acme Corp.", T0)), T0)
    assert t["edges"].count() == 1 and t["entities"].count() == 3


@pytest.mark.parametrize("q, c", [("find something similar to apples", "VIBE"), ("who owns Acme", "FACT"), ("what did Kendra prefer in 2024", "CHANGE"), ("", "VIBE"), ("what changed in this function since v1", "HYBRID"), ("callers of parse", "CODE")])
def test_classes(spark, q, c):
    assert retrieval.classify(spark.createDataFrame([(q,)], "query string")).first()["class"] == c


def test_strength_decays(spark):
    e = nodes(spark, [("a", "a", "shared", None), ("b", "b", "shared", None)]).withColumn("last_accessed_at", F.expr("CASE WHEN id = 'a' THEN timestamp_ntz'2025-01-01' ELSE timestamp_ntz'2024-06-15' END"))
    s = {r.entity_id: r.strength for r in maintain.strengths(e, T0).collect()}
    assert s["a"] > s["b"] and s["a"] == pytest.approx(0.5)


def test_flush_and_merge_by_window(spark):
    e = nodes(spark, [(str(i), str(i), "shared", None) for i in range(9)]).withColumn("valid_from", F.expr("CASE WHEN id < '2' THEN timestamp_ntz'2024-12-01' WHEN id < '5' THEN timestamp_ntz'2024-12-10' ELSE timestamp_ntz'2024-12-20' END"))
    t = _fresh(spark) | {"entities": e}
    assert lifecycle.flush(t, "2024-12-11", "2024-12-05")["entities"].count() == 6
    assert lifecycle.backup(t, "2024-12-11", "2024-12-05")["entities"].count() == 3
    merged, counts = lifecycle.merge_from(lifecycle.backup(t, "2024-12-05"), t)
    assert {r.table: r.n for r in counts.collect()} == {"sources": 0, "entities": 7, "edges": 0}
    assert {r.n for r in lifecycle.merge_from(merged, t)[1].collect()} == {0}
    with pytest.raises(ValueError):
        lifecycle.window("2024-01-01", None, "nonsense")


def test_edges_need_both_ends(spark):
    e = nodes(spark, [("a", "a", "shared", None), ("p", "p", "private", "u")])
    s = conform(spark.createDataFrame([("s",)], "id string"), "sources")
    rows = spark.createDataFrame([("a", "p", "R", "s"), ("a", "x", "R", "s"), ("a", "p", "R", "none")], "source_id string, target_id string, relation_type string, source_ref string")
    good, bad = dml.checked_edges(rows, e, s, T0)
    assert [r.cross_scope for r in good.collect()] == [True]
    assert {r.reason for r in bad.collect()} == {"no target entity", "no source"}


def test_store_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    assert store.version == 0 and store.read("entities").count() == 0
    e = nodes(spark, [("a", "a", "shared", None)])
    assert store.write({"entities": e}) == 1
    assert store.write({"entities": store.read("entities").unionByName(nodes(spark, [("b", "b", "shared", None)]))}) == 2
    assert store.read("entities").count() == 2 and store.tables() == ["entities"] and store.vacuum() == 1
    with pytest.raises(StoreError):
        Store(spark, str(tmp_path / "db"), read_only=True).write({"entities": e})
    other = Store(spark, str(tmp_path / "other"))
    assert lifecycle.load_from(other, store, "replace") == 1 and other.read("entities").count() == 2
    assert store.sizes()["entities"] > 0


def test_call_graph(spark):
    src = "def main():\n    helper()\n    w = build_widget()\n    w.render()\n\ndef helper():\n    return validate()\n\ndef validate():\n    return len('x')\n\ndef build_widget():\n    return Widget()\n\nclass Widget:\n    def render(self):\n        self.format()\n        return format_html()\n    def format(self):\n        return escape()\n\ndef format_html():\n    return escape()\n\ndef escape():\n    pass\n"
    files = spark.createDataFrame([("calls.py", src)], "path string, content string")
    t = code.ingest(_fresh(spark), files, T0)
    names = t["entities"].select("id", "name")
    calls = t["edges"].where("relation_type = 'CALLS'").join(names.withColumnsRenamed({"id": "source_id", "name": "a"}), "source_id").join(names.withColumnsRenamed({"id": "target_id", "name": "b"}), "target_id")
    assert {(r.a, r.b) for r in calls.collect()} == {("main", "helper"), ("main", "build_widget"), ("main", "Widget.render"), ("helper", "validate"), ("Widget.render", "Widget.format"), ("Widget.render", "format_html"), ("Widget.format", "escape"), ("format_html", "escape"), ("build_widget", "Widget")}
    assert code.ingest({n: df.cache() for n, df in t.items()}, files, T0)["edges"].count() == t["edges"].count()


def test_expand_and_search(spark):
    g = graph(spark, "abc", [("a", "b", 0.9)])
    v = spark.createDataFrame([("a", [1.0, 0.0] * 8), ("b", [0.0, 1.0] * 8), ("c", [0.6, 0.8] * 8)], "entity_id string, vector array<float>")
    g = Snapshot(**{**g.__dict__, "embeddings": conform(v, "embeddings")})
    q = [1.0, 0.0] * 8
    assert [r.id for r in vectors.knn(g, q, 2).collect()] == ["a", "c"]
    for mode in ("exact", "two_pass", "l2", "signs"):
        assert vectors.search(g, q, 1, mode=mode).first().id in ("a", "b", "c")
    assert {r.id: r.score for r in vectors.search(g, q, 3, depth=1).collect()}["b"] == pytest.approx(0.45, abs=1e-6)


def test_text_functions(spark):
    df = spark.createDataFrame([("The Alice met Bob. And then? ok!  Yes",)], "t string")
    r = df.select(T.sentences(F.col("t")).alias("s"), T.nouns(F.col("t")).alias("n"), T.language_of(F.lit("a/B.PY")).alias("l")).first()
    assert r.s == ["The Alice met Bob.", "And then?", "ok!", "Yes"] and r.n == ["Alice", "Bob", "And", "Yes"] and r.l == "python"
