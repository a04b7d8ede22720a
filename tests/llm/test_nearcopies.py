import random
import re

import numpy as np
import pytest

from bitempo.llm import nearcopies as N

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t, k):
    w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, num, den):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, shingles(t, k))
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and den * both >= num * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def corpus():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    line = " ".join(word() for _ in range(30))
    base = [word() for _ in range(120)]
    rows = [(1, None), (2, ""), (3, "one two"), (4, "ONE  two"), (5, "one two three"), (6, " ".join(base)), (7, " ".join(base)), (8, " ".join(base).upper())]
    for i in range(10, 40):  # near copies with more and more edits
        w = list(base)
        for _ in range(i // 6):
            w[r.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    rows += [(i, line + "\n" + " ".join(word() for _ in range(r.randint(5, 200)))) for i in range(50, 80)]  # a line that many share
    rows += [(i, " ".join(base[: 60 + i % 60])) for i in range(90, 120)]
    rows += [(None, "one two"), (None, None), (6, " ".join(base))]
    return rows


@pytest.mark.parametrize("k, num, rounds", [(4, 85, 4), (5, 80, 0)])
def test_matches_brute_force(docs, monkeypatch, k, num, rounds):
    monkeypatch.setattr(N, "ROUNDS", rounds)  # 0: everything through the last step
    rows = corpus()
    want = brute(rows, k, num, 100)
    got = N.classes(docs(rows), k, num, 100).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id] if r.doc_id is not None else r.component_id is None


def test_distinct_keeps_one_of_each(docs):
    out = N.distinct(docs([(1, "a b c d e f"), (2, "A b c d e f"), (3, "z"), (3, "z"), (None, "z"), (5, None)]))
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "3", "5", "None"]
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_empty_table(docs):
    assert N.classes(docs([])).count() == 0


@pytest.mark.parametrize("held", [1 << 22, 3000])
def test_frequent_shingles_are_of_all_documents(spark, monkeypatch, held):
    monkeypatch.setattr(N, "HELD", held)
    ids = spark.range(0, 24000, 1, 4).selectExpr("id AS doc_id", "CASE WHEN id < 20000 THEN concat('g', id % 1000, ' x y z') ELSE concat('p', id DIV 10, ' x y z') END AS text")
    raw = [f"g{g} x y z".encode() for g in range(1000)]
    every, _ = N.shingles(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw]))), 4)
    assert N.frequent_of(ids, 4).tolist() == sorted(every.tolist())  # 20 documents each; 12 make the share, 10 do not


@pytest.mark.parametrize("share", [0.0, 0.5, 1.0])
def test_frequent_shingles_change_no_result(docs, monkeypatch, share):
    def some(src, k):
        raw = [(r.text or "").encode() for r in src.collect()]
        h, _ = N.shingles(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw]))), k)
        every = np.unique(h)
        return np.sort(np.random.default_rng(1).choice(every, int(share * len(every)), replace=False))

    monkeypatch.setattr(N, "frequent_of", some)
    rows = corpus()
    want = brute(rows, 4, 85, 100)
    got = N.classes(docs(rows), 4, 85, 100).where("doc_id is not null").collect()
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got)
