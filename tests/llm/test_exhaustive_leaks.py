import random

import numpy as np
import pytest

from bitempo.llm import decontaminate as D


def words(r, n):
    return ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(n)]


def edited(r, w, k):
    w = list(w)
    for _ in range(k):
        x = r.randrange(len(w))
        w[x : x + 1] = r.choice([[], ["zz"], [w[x], "qq"]])
    return w


def flat(texts):
    raw = [t.encode() for t in texts]
    return D.words_of(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)], dtype=np.int64))


@pytest.mark.parametrize("m", [5, 6, 9, 20, 45, 100])
def test_finds_what_a_search_of_every_passage_finds(m):
    r = random.Random(m)
    items = tuple((i, " ".join(words(r, m))) for i in range(20))
    index = D.Index(items, dict(D.plan_of(items)))
    texts = []
    for n in range(160):  # at the start, the end, alone or within
        w = edited(r, items[n % 20][1].split(), r.randint(0, D.allowed(m) + 2))
        texts.append(" ".join(words(r, r.choice((0, 0, 15))) + w + words(r, r.choice((0, 0, 15)))))
    text_words, text = flat(texts)
    want = set()
    for d in range(len(texts)):
        own = text_words[text == d]
        want |= {(d, i) for i, item in enumerate(index.words) if D.best_match(item, own)[0] <= D.allowed(m)}
    got = {(d, i) for d, i, *_ in index.search(text_words, text)}
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) > 60


def test_answers_do_not_depend_on_neighbours(spark, docs):
    r = random.Random(2)
    item = words(r, 20)
    bench = spark.createDataFrame([(7, " ".join(item)), (4, " ".join(item).upper()), (9, None)], "item_id long, text string")
    rows = [(1, " ".join(item[:19])), (2, " ".join(words(r, 40))), (3, " ".join(item[2:])), (4, " ".join(item[:15])), (5, " ".join(item[4:])), (6, " ".join(item))]
    want = {(1, 4, 2, 1), (3, 4, 2, 2), (5, 4, 2, 4), (6, 4, 2, 0)}
    for parts in (1, 2, 6):
        out = D.leaks(docs(rows).repartition(parts), bench).collect()
        assert {(x.doc_id, x.item_id, x.n_items, x.edits) for x in out} == want
