import random

import pytest
from pyspark.sql import functions as F

from bitempo.llm import sharding as S


@pytest.mark.parametrize("bucket_rows", [4096, 5])
def test_ranks_against_sorting_in_one_place(spark, bucket_rows):
    r = random.Random(6)
    rows = [(i if i % 3 else None, f"text {i} " * r.randint(0, 4) + str(i), r.choice(["a", "a", "a", "b", "c", None])) for i in range(311)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    seen = df.select("text", "source", F.xxhash64(F.lit(S.SEED), "doc_id", F.crc32("text")).alias("h"), F.crc32("text").alias("crc"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")).alias("src"))
    seen = seen.withColumn("phase", (F.pmod(F.xxhash64(F.lit(S.SEED), F.lit("phase"), "src"), F.lit(1 << 20)) + 0.5) / (1 << 20)).collect()
    line = []
    for src in {x.src for x in seen}:  # the shuffled rows of a source are spread evenly
        own = sorted((x for x in seen if x.src == src), key=lambda x: x.h & (1 << 64) - 1 if bucket_rows < 4096 else x.h)
        line += [((k + 1 - x.phase) / len(own), x.crc) for k, x in enumerate(own)]
    line.sort()
    want = {}
    for at, (_, crc) in enumerate(line):
        shard = at * S.SHARDS // len(line)
        want[crc] = (shard, at - -(-shard * len(line) // S.SHARDS))
    got = S.interleave(df, bucket_rows=bucket_rows).collect()
    assert {x.text_crc32: (x.shard, x.slot) for x in got} == want
    assert max(sum(1 for x in got if x.shard == k) for k in range(S.SHARDS)) - min(sum(1 for x in got if x.shard == k) for k in range(S.SHARDS)) <= 1
