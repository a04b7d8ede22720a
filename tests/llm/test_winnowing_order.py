import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from bitempo.llm import winnowing as W

WORDS = re.compile(r"[^\s\x00-\x20]+")


def grams(text, k=W.GRAM):
    own = WORDS.findall(text.lower())
    return {tuple(own[i : i + k]) for i in range(max(1, len(own) - k + 1)) if own}


@pytest.mark.parametrize("ids", ["extreme", "outlier", "repeated", "null"])
def test_the_next_row_whatever_the_ids(docs, ids):
    r = random.Random(7)
    n = 150
    own = {"extreme": [-(1 << 63), (1 << 63) - 1, *range(n)], "outlier": [*range(n), 10**15], "repeated": [5] * n + [1, 9], "null": [None] * n + [3]}[ids]
    rows = [(i, " ".join(r.choice("abcdefghij") * 2 for _ in range(r.randint(0, 40)))) for i in own]
    got = W.fingerprints(docs(rows)).collect()
    assert len(got) == len(rows)
    ties = {x.text: x.h for x in docs(rows).select("text", F.xxhash64("text").alias("h")).collect()}
    texts = [t for _, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, ties[x[1]]), reverse=True)]
    want = []
    for a, b in zip(texts, texts[1:] + texts[:1], strict=True):
        h = len(a) // 2
        want.append(hashlib.sha256((a[: len(a) - h] + b[:h]).encode()).hexdigest())
    assert sorted(x.edited_sha256 for x in got) == sorted(want)


def test_buckets_are_alike(docs):
    rows = [(i, f"t{i}") for i in [*range(2000), 10**15, -(10**15)]]
    base = docs(rows, extra=False).withColumn("tie", F.xxhash64("text"))
    sizes = [x["count"] for x in W.ordered(base).groupBy("b").count().collect()]
    assert len(sizes) > 30 and max(sizes) < 5 * 2002 / len(sizes)
    assert W.ordered(base).groupBy("b").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).orderBy("b").agg(F.count("*")).first()[0] == len(sizes)


def test_likeness_against_sets_of_grams(docs):
    r = random.Random(8)
    rows = [(i, " ".join(r.choice("abc") for _ in range(n))) for i, n in enumerate((0, 3, 5, 30, 60, 61))]
    rows += [(10, rows[4][1]), (11, rows[4][1] + " a b c")]
    got = {x.doc_id: x for x in W.fingerprints(docs(rows), window=1).collect()}  # every gram is kept
    order = sorted(rows, reverse=True)
    for (i, a), (_, b) in zip(order, order[1:] + order[:1], strict=True):
        x, y = grams(a), grams(b)
        assert got[i].near_next == pytest.approx(len(x & y) / len(x | y) if x | y else 1.0)
