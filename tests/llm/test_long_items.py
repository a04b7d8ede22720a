import random

import numpy as np

from bitempo.llm import decontaminate as D


def test_deletions_in_long_items():
    r = random.Random("1120del")
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(120))) for i in range(60)]
    index, texts = D.Index(tuple(items), dict(D.plan_of(tuple(items)))), []
    for _, t in items:
        w = t.split()
        for _ in range(D.allowed(120)):
            del w[r.randrange(len(w))]
        texts.append(" ".join([word() for _ in range(40)] + w + [word() for _ in range(40)]).encode())
    offsets = np.cumsum([0, *map(len, texts)], dtype=np.int64)
    found = {x[0] for x in index.search(*D.words_of(np.frombuffer(b"".join(texts), np.uint8), offsets)) if x[0] == x[1]}
    assert len(found) >= 58
