import random

import pytest

from bitempo.llm.common import connected


@pytest.mark.parametrize("order", ["downwards", "shuffled"])
def test_long_chains(spark, order):
    n, r = 300, random.Random(3)
    ids = [0, *range(n - 1, 0, -1)]
    if order == "shuffled":
        r.shuffle(ids)
    links = list(zip(ids, ids[1:])) + [(1000, 1001), (1002, 1001), (2000, 2000)]
    got = {x.doc_id: x.label for x in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(n), 0) | {1000: 1000, 1001: 1000, 1002: 1000, 2000: 2000}
