"""The verdicts of the trees: rows that no rule decides, and statistics that leave a row's own fold out."""

import random

from bitempo.llm import urlfilter


def test_rates_leave_the_own_fold_out():
    rng = random.Random(5)
    rows = [(rng.randrange(urlfilter.SUFFIX_BUCKETS), rng.randrange(urlfilter.FOLDS), rng.randrange(3), 3) for _ in range(300)]
    without, whole = urlfilter.rates(rows)
    for b in range(urlfilter.SUFFIX_BUCKETS):
        mine = [r for r in rows if r[0] == b]
        assert whole[b] == (sum(r[2] for r in mine) + 1) / (sum(r[3] for r in mine) + 2)
        for f in range(urlfilter.FOLDS):
            left = [r for r in mine if r[1] != f]
            assert without[f * urlfilter.SUFFIX_BUCKETS + b] == (sum(r[2] for r in left) + 1) / (sum(r[3] for r in left) + 2)
    assert urlfilter.rates([]) == ([0.5] * len(without), [0.5] * len(whole))


def _url(rng, host, bad):
    if bad:
        return f"http://{host}/{rng.randrange(10**9)}/a{rng.randrange(10**6)}.php?" + "&".join(f"p{i}={rng.randrange(10**6)}" for i in range(4))
    return f"http://{host}/{rng.choice(['news', 'about', 'story'])}/{rng.choice(['one', 'two', 'three'])}-text.html"


def test_verdicts_of_hosts_without_rules(spark):
    """Accuracy over URLs of hosts that no rule names, blocked ones by digits and parameters: 0.95 at least."""
    rng = random.Random(9)
    rules = [("block" if i % 2 else "allow", f"h{i}.net", "/") for i in range(40)]
    rows = [(j, _url(rng, f"h{j % 120}.net", bool(j % 2))) for j in range(2400)]
    got = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()
    free = [r for r in got if r.rule is None]
    assert len(got) == 2400 and len(free) == 1600
    assert sum(r.verdict == ("block" if r.page_id % 2 else "allow") for r in free) / len(free) >= 0.95


def test_held_out_hosts(spark):
    """Scores of hosts whose labels were not learned from, against their rules."""
    rng = random.Random(3)
    rules = [("block" if i % 2 else "allow", f"h{i}.net", "/") for i in range(120)]
    rows = [(j, _url(rng, f"h{j % 120}.net", bool(j % 2))) for j in range(2400)]
    import zlib

    held = [r for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string"), rules, hold=1).collect() if zlib.crc32(r.host.encode()) % urlfilter.FOLDS == 1]
    assert held and sum((r.score > 0) == (r.page_id % 2 == 1) for r in held) / len(held) >= 0.95
