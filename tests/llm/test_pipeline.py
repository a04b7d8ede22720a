import random
import sys


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as C

    r = random.Random(11)
    syl = {"en": "the and ing er on th".split(), "fr": "le que ment eau oi tre".split()}
    prose = lambda lang, n: " ".join("".join(r.choice(syl[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))
    rows = [(i, prose("en" if i % 2 else "fr", 80), "en" if i % 2 else "fr") for i in range(40)]
    item = prose("en", 40)
    rows += [(50, rows[3][1], "en"), (51, rows[3][1] + " extra", "en"), (52, "12 34 !!", None), (53, prose("en", 30) + " " + item + " " + prose("en", 30), "en"), (54, prose("en", 40) + " mail me@x.org", None), (55, None, "en")]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {x.doc_id: x for x in C.run(spark, str(tmp_path)).collect()}
    assert set(out) == {*range(40), 54}
    assert out[54].text.endswith("mail [EMAIL]") and all(len(x.ids) == x.n_tokens for x in out.values())
    assert out[0].text == rows[0][1] and len(C.STAGES) == 5


def test_entry_registers_all():
    sys.modules.pop("__spark_entry__", None)
    import __spark_entry__ as e

    assert {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in e.queries()} and "pipeline" in e.queries()
    assert set(e.oracle_sql()) <= set(e.queries())
