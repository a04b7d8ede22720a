import pytest
from pyspark.sql import functions as F

from bitempo.streaming import jobs


def test_once_by_content_and_supersession(spark, tmp_path):
    rows = [("Kendra", "PREFERS", "Adidas", "2025-01-01 00:00:00"), ("Kendra", "PREFERS", "Nike", "2025-04-01 00:00:00"), ("Kendra", "PREFERS", "Nike", "2025-05-01 00:00:00")]
    df = spark.createDataFrame(rows, "subject string, predicate string, object string, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = jobs.incremental_files(spark, str(tmp_path / "in"), "subject string, predicate string, object string, ts timestamp")
    jobs.drain(jobs.supersessions(stream), str(tmp_path / "out"), str(tmp_path / "ck"))
    out = spark.read.parquet(str(tmp_path / "out")).orderBy("ts").collect()
    assert [(r.object, r.previous) for r in out] == [("Adidas", None), ("Nike", "Adidas")]


def test_touches_match_batch(spark, tmp_path):
    e = spark.createDataFrame([("a", "2025-01-01 00:10:00"), ("a", "2025-01-01 00:20:00"), ("b", "2025-01-01 00:30:00"), ("z", "2025-01-09 00:00:00")], "id string, ts string").withColumn("ts", F.to_timestamp("ts"))
    e.write.parquet(str(tmp_path / "ev"))
    seen = []
    q = jobs.apply_touches(lambda df: seen.extend((r.id, r.n) for r in df.collect()), jobs.touches(jobs.incremental_files(spark, str(tmp_path / "ev"), "id string, ts timestamp")), str(tmp_path / "ck2"))
    q.awaitTermination()
    assert {("a", 2), ("b", 1)} <= set(seen)


def test_contents_come_once(spark, tmp_path):
    d = spark.createDataFrame([("x", "2025-01-01 00:00:00"), ("x", "2025-01-01 01:00:00"), ("y", "2025-01-01 02:00:00")], "content string, ts string").withColumn("ts", F.to_timestamp("ts"))
    d.write.parquet(str(tmp_path / "d"))
    jobs.drain(jobs.once_by_content(jobs.incremental_files(spark, str(tmp_path / "d"), "content string, ts timestamp")), str(tmp_path / "once"), str(tmp_path / "ck3"))
    assert spark.read.parquet(str(tmp_path / "once")).count() == 2


def test_late_facts_are_chained_as_in_the_batch(spark, tmp_path):
    facts = [("k", "P", v, f"2025-01-{d:02d} 00:00:00") for d, v in ((1, "a"), (3, "b"), (5, "a"), (7, "a"), (9, "c"), (11, "b"))]
    for batch in ([4, 0], [2, 3], [1], [5, 0]):  # late, repeated and again
        df = spark.createDataFrame([facts[i] for i in batch], "subject string, predicate string, object string, ts string").withColumn("ts", F.to_timestamp("ts"))
        df.repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.incremental_files(spark, str(tmp_path / "in"), "subject string, predicate string, object string, ts timestamp")
        jobs.drain(jobs.supersessions(stream).withColumn("at", F.current_timestamp()), str(tmp_path / "out"), str(tmp_path / "ck"))
    last = {}
    for r in spark.read.parquet(str(tmp_path / "out")).orderBy("at").collect():
        last[r.ts.day, r.object] = r.previous
    got = [(d, o, p) for (d, o), p in sorted(last.items()) if p != o]
    assert got == [(1, "a", None), (3, "b", "a"), (5, "a", "b"), (9, "c", "a"), (11, "b", "c")]
