"""Rankings of code, by brute force on the files of the queries; answers that are remembered."""

import pytest

from bitempo import queries
from bitempo.operators import code as CO
from bitempo.operators import graph as G
from bitempo.operators import retrieval as R
from bitempo.sources import testdata

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def g(spark):
    return queries._code(lambda t: testdata.table(spark, SF, t))


def ranks(g, seeds, rounds):
    w = {}
    for e in g.inner_links().collect():
        c = max(e.confidence_score, 1e-3)
        for a, b, x in ((e.source_id, e.target_id, c), (e.target_id, e.source_id, c / 2)):
            w.setdefault(a, {})[b] = w.get(a, {}).get(b, 0) + x
    v = {s: 1 / len(seeds) for s in seeds}
    p = dict(v)
    for _ in range(rounds):
        new, lost = {s: 0.15 * x for s, x in v.items()}, 0.0
        for a, s in p.items():
            if a not in w:
                lost += 0.85 * s
            for b, x in w.get(a, {}).items():
                new[b] = new.get(b, 0) + 0.85 * s * x / sum(w[a].values())
        p = {a: new.get(a, 0) + lost * v.get(a, 0) for a in new}
    return p


def by_rank(p):
    return sorted(p, key=lambda i: (-round(p[i], 9), i))


def test_impact_map_and_code_recall(g):
    nodes = {r.id: r for r in g.nodes().collect()}
    code = {i for i, r in nodes.items() if r.type in ("module", "function", "class", "method")}
    helper = next(i for i, r in nodes.items() if r.name == "helper" and r.type == "function")
    p = ranks(g, [helper], 6)
    assert [r.id for r in CO.impact(g, "helper", rounds=6).collect()] == [i for i in by_rank(p) if i in code and i != helper][:20]
    hits = R.code(g, "who calls helper", rounds=6).collect()
    assert [r.id for r in hits] == [i for i in by_rank(p) if i in code][:10]
    assert all(r.score == pytest.approx(p[r.id], abs=1e-6) for r in hits)
    assert R.code(g, "nobody has these words").count() == 0
    every = ranks(g, sorted(code), 6)
    used, want = 0, []
    for i in by_rank({i: s for i, s in every.items() if i in code}):
        used += len(nodes[i].type) + len(nodes[i].name) + 4
        if used > 80:
            break
        want.append((i, used))
    assert [(r.id, r.used) for r in G.codebase_map(g, budget=20, rounds=6).collect()] == want


def test_answers_are_remembered_by_version(spark, monkeypatch):
    g = testdata.graph(spark, SF).seen_by("shared")
    made = []
    real = R.recall
    monkeypatch.setattr(R, "recall", lambda *a, **k: made.append(a) or real(*a, **k))
    cache, q = R.RecallCache(size=2), "tell me about things"
    kind, hits = cache.recall(g, 1, q, queries.Q, now=testdata.NOW)
    again = cache.recall(g, 1, q, queries.Q, now=testdata.NOW)
    assert kind == again[0] and hits.collect() == again[1].collect() and len(made) == 1
    cache.recall(g, 2, q, queries.Q, now=testdata.NOW)
    assert len(made) == 2
    cache.recall(testdata.graph(spark, SF).seen_by("all", "u1"), 2, q, queries.Q, now=testdata.NOW)
    assert len(made) == 3
    cache.recall(g, 1, q, queries.Q, now=testdata.NOW)  # was the oldest of three
    assert len(made) == 4
