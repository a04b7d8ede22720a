"""Queries over whole tables, against their SQL or brute force on the smallest tables."""

import duckdb
import pytest

from bitempo.queries import ORACLE_SQL, QUERIES
from bitempo.sources import testdata

SF = "/root/testdata/sf0.001"


def same_rows(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    flat = lambda rows: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=str)
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLE_SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    want, got = flat(cur.fetchall()), flat(df.select(*[f"`{c}`" for c in cols]).collect())
    assert len(want) == len(got) and all(a == pytest.approx(b, abs=2e-6) if all(isinstance(x, float) for x in a) else [x if not isinstance(x, float) else pytest.approx(x, abs=2e-6) for x in a] == list(b) for a, b in zip(want, got))
    return got


@pytest.mark.parametrize("name", ["gr2_pagerank_3_rounds", "gr2_pagerank_12_rounds", "gr4_transitions"])
def test_all_edges(spark, name):
    got = same_rows(spark, name)
    assert any(str(x).startswith("order:") for r in got for x in r)


def test_pagerank_of_all_edges(spark):
    links = testdata.graph(spark, SF).inner_links().collect()
    w = {}
    for e in links:
        c = max(e.confidence_score, 1e-3)
        for a, b, x in ((e.source_id, e.target_id, c), (e.target_id, e.source_id, c / 2)):
            w.setdefault(a, {})[b] = w.get(a, {}).get(b, 0) + x
    p = {"nation:1": 1.0}
    for _ in range(30):
        new = {"nation:1": 0.15}
        for a, s in p.items():
            of = sum(w[a].values())
            for b, x in w[a].items():
                new[b] = new.get(b, 0) + 0.85 * s * x / of
        p = new
    got = {r.id: r.score for r in QUERIES["gr2_pagerank"](spark, SF).collect()}
    assert got.keys() == p.keys() and all(abs(got[k] - p[k]) < 1e-5 for k in p)
    assert {k.split(":")[0] for k in got} >= {"order", "priority", "part"}


@pytest.mark.parametrize("name", ["fn1_canonical", "fn7_jaccard"])
def test_whole_texts(spark, name):
    assert len(same_rows(spark, name)) >= 199


def test_bag_of_words_takes_the_whole_text(spark, tmp_path):
    from hashlib import md5
    from pyspark.sql import functions as F

    text = "the same start " * 20 + "and another end"
    from bitempo.functions.embed import bag_of_words

    want = [0.0] * 64
    for w in text.split():
        h = md5(w.encode()).hexdigest()
        want[int(h[:7], 16) % 64] += 1 if int(h[8], 16) % 2 == 0 else -1
    size = sum(x * x for x in want) ** 0.5
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert df.select(bag_of_words(F.col("text"))).first()[0] == pytest.approx([x / size for x in want], abs=1e-6)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    plan = QUERIES["ve8_bag_of_words"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "substring(text" not in plan


@pytest.mark.parametrize("name", ["jn11_diff", "dm1_new_sources", "jn14_point_in_time", "wn4_budget", "mt3_merge_duplicates", "ag4_duplicate_groups", "ag7_delta", "ag9_out_weights", "fn5_predicate", "fn8_overlap", "fn14_strength", "mt4_strengths", "ve6_evidence", "ve8_bag_of_words", "dm20_reembed", "rc3_fact", "rc6_hybrid", "gr6_browse_name", "gr7_working_context"])
def test_whole_tables(spark, name):
    same_rows(spark, name)


def test_batch_search_grows_with_the_input(spark):
    assert {r[0] for r in same_rows(spark, "ve7_knn_batch")} == {f"customer:{i}" for i in range(100, 501, 100)}


@pytest.mark.parametrize("name", ["fn3_sentences", "in1_extract_entities", "in1_extract_triples", "in3_first_of_subject"])
def test_every_language(spark, name):
    same_rows(spark, name)


def test_ingest_of_documents(spark, tmp_path):
    """One document after the other, by hand."""
    import re
    from collections import Counter

    rows = [(1, "Kendra prefers Adidas. Bob owns Acme.", "en"), (2, "Kendra prefers Adidas. Bob owns Acme.", "fr"), (3, "Kendra prefers Nike! The Bob works at Zeta.", None), (4, "Bob owns Acme. Ann meets Bob and Kendra.", "de"), (5, "Ann meets Bob again. Kendra prefers Adidas.", "en"), (6, "no names here", "en"), (7, "Bob works for Zeta. Bob owns Gamma.", "es")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    says = (("OWNS", r"\bowns\b"), ("PREFERS", r"\bprefers?\b"), ("WORKS_AT", r"\bworks (at|for)\b"))
    seen, now, edges, against = set(), {}, [], Counter()
    for _, text, _ in rows:
        if text in seen:
            continue
        seen.add(text)
        done = set()
        for sentence in re.split(r"(?<=[.!?])\s+", text):
            nouns = [w.lower() for w in re.findall(r"[A-Z][A-Za-z0-9_-]+", sentence) if w.lower() not in ("the", "a", "an", "this", "that", "these", "those")]
            p = next((p for p, r in says if re.search(r, sentence)), "RELATED_TO")
            if len(nouns) < 2 or (nouns[0], p) in done:
                continue
            done.add((nouns[0], p))
            if p == "RELATED_TO":
                if [nouns[0], p, nouns[1], False] not in edges:
                    edges.append([nouns[0], p, nouns[1], False])
                continue
            old = now.get((nouns[0], p))
            if old is not None and old[2] == nouns[1]:
                continue
            if old is not None:
                old[3] = True
                against[(nouns[1], "CONTRADICTS", old[2], False)] += 1
            now[(nouns[0], p)] = edge = [nouns[0], p, nouns[1], False]
            edges.append(edge)
    want = Counter(map(tuple, edges)) + against
    assert Counter(map(tuple, QUERIES["in2_ingest_documents"](spark, str(tmp_path)).collect())) == want
