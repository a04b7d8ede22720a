"""URL filter (operator 4): rules first, gradient-boosted trees on lexical features for the rest.

The trees are trained from the URLs that the rules decide. Statistics of suffixes come, for a URL that is learned
from, from the labels of other folds of hosts, so that no URL's own label is among its features. Features are binned, so the labelled rows
shrink to counts of binned vectors (at most ``MOST_VECTORS``, whatever the table's size), which one
aggregation over all rows gives; trees are fitted to these counts on the driver and become one SQL
expression. Nothing but DataFrame and SQL functions touches rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
TREES, DEPTH, RATE, SMOOTH = 24, 3, 0.3, 4.0
SUFFIX_BUCKETS, FOLDS = 64, 5
#: Upper edges of the bins of each feature.
BINS: dict[str, tuple[float, ...]] = {
    "length": (30, 40, 55, 80),
    "depth": (1, 2, 4),
    "digits": (0.02, 0.06, 0.15),
    "entropy": (3.2, 3.9),
    "params": (0, 1, 3),
    "marks": (0, 1),
    "host_suffix": (0.25, 0.5, 0.75),
    "file_suffix": (0.25, 0.5, 0.75),
    "top_segment": (0.25, 0.5, 0.75),
}
MOST_VECTORS = math.prod(len(v) + 1 for v in BINS.values())
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise("")


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, its verdict); null where none fits. The longest rule that fits wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the last one put around is looked at first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def entropy(text: Column) -> Column:
    """Bits a character."""
    n = F.length(text)
    chars = F.array_distinct(F.split(text, ""))
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    return F.when(n > 0, F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))).otherwise(0.0)


def suffixes(host: Column, path: Column) -> dict[str, Column]:
    """Hash buckets of the host's last label, of the path's ending and of its first segment."""
    bucket = lambda c: F.pmod(F.crc32(F.coalesce(c, F.lit(""))), F.lit(SUFFIX_BUCKETS)).cast("int")
    return {"host_suffix": bucket(F.substring_index(host, ".", -1)), "file_suffix": bucket(F.regexp_extract(path, r"(\.[A-Za-z0-9]{1,8}|/)$", 1)), "top_segment": bucket(F.regexp_extract(path, r"^/([^/]*)", 1))}


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    u = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    count = lambda text, pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    return {
        "length": F.length(u).cast("double"),
        "depth": F.size(F.filter(F.split(path, "/"), lambda s: s != "")).cast("double"),
        "digits": count(u, "[0-9]") / F.greatest(F.length(u), F.lit(1)),
        "entropy": entropy(F.concat(host, path)),
        "params": F.when(query == "", 0.0).otherwise(1.0 + count(query, "[&;]")),
        "marks": count(host, "[-_]").cast("double"),
    }


def binned(values: dict[str, Column]) -> dict[str, Column]:
    return {k: sum((F.when(v > e, 1).otherwise(0) for e in BINS[k]), F.lit(0)) for k, v in values.items()}


def fit(counts: list[tuple[tuple[int, ...], float, float]], names: Sequence[str], trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> list:
    """Boosted trees for (bins, blocked, allowed) counts by second-order log-loss.

    A tree is a leaf's value or (feature, bin, left, right): left where the feature's bin is at most ``bin``.
    """
    margin = [0.0] * len(counts)

    def grow(rows: list[int], left: int):
        grad, hess = [], []
        for i in rows:
            p = 1 / (1 + math.exp(-margin[i]))
            pos, neg = counts[i][1], counts[i][2]
            grad.append(pos - (pos + neg) * p)
            hess.append((pos + neg) * p * (1 - p))
        g, h = sum(grad), sum(hess)
        best = (1e-6, None, None)
        for f in range(len(names)) if left else ():
            sums: dict[int, list[float]] = {}
            for i, a, b in zip(rows, grad, hess, strict=True):
                s = sums.setdefault(counts[i][0][f], [0.0, 0.0])
                s[0] += a
                s[1] += b
            lg = lh = 0.0
            for at in sorted(sums)[:-1]:
                lg, lh = lg + sums[at][0], lh + sums[at][1]
                gain = lg**2 / (lh + SMOOTH) + (g - lg) ** 2 / (h - lh + SMOOTH) - g**2 / (h + SMOOTH)
                if gain > best[0]:
                    best = (gain, f, at)
        if best[1] is None:
            value = rate * g / (h + SMOOTH)
            for i in rows:
                step[i] = value
            return value
        _, f, at = best
        return (names[f], at, grow([i for i in rows if counts[i][0][f] <= at], left - 1), grow([i for i in rows if counts[i][0][f] > at], left - 1))

    out = []
    for _ in range(trees):
        step = [0.0] * len(counts)
        out.append(grow(list(range(len(counts))), depth))
        margin = [m + s for m, s in zip(margin, step, strict=True)]
    return out


def as_column(tree) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    name, at, left, right = tree
    return F.when(F.col(name) <= at, as_column(left)).otherwise(as_column(right))


def rates(rows: Sequence[tuple[int, int, int, int]]) -> tuple[list[float], list[float]]:
    """Smoothed shares of blocked URLs of (bucket, fold, blocked, all): without each fold, and over all of them.

    The first list has the share of bucket b without fold f at f * SUFFIX_BUCKETS + b. A bucket without labels has 0.5.
    """
    sums = [[0, 0] for _ in range((FOLDS + 1) * SUFFIX_BUCKETS)]
    for bucket, fold, pos, n in rows:
        for f in range(FOLDS + 1):
            if f != fold:
                sums[f * SUFFIX_BUCKETS + bucket][0] += pos
                sums[f * SUFFIX_BUCKETS + bucket][1] += n
    share = [(p + 1) / (n + 2) for p, n in sums]
    return share[: FOLDS * SUFFIX_BUCKETS], share[FOLDS * SUFFIX_BUCKETS :]


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, hold: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and score (margin for ``block``) of every row.

    A null url, or one without ``://``, has an empty host and path, so no rule fits; the trees judge it by its
    text. Where the rules decide no row, or all alike, there is nothing to learn and the rest is allowed. A
    margin of 0 allows. The labels of the hosts of fold ``hold`` are not learned from, so that the scores of these
    rows can be held against their rules. Repeated rows are judged each; other columns of ``pages`` are not read.
    """
    src = pages.select("page_id", F.col("url").cast("string").alias("url"))
    parts = src.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    parts = parts.select("*", rule.alias("rule"), verdict.alias("by_rule"), F.pmod(F.crc32("host"), F.lit(FOLDS)).cast("int").alias("fold"))
    bucket = suffixes(F.col("host"), F.col("path"))
    plain = binned(lexical(F.col("url"), F.col("host"), F.col("path")))
    parts = parts.select("*", *(c.alias(f"{k}_bucket") for k, c in bucket.items()), *(c.alias(k) for k, c in plain.items()))

    labelled = parts.where("by_rule is not null")
    if hold is not None:
        labelled = labelled.where(F.col("fold") != hold)
    keys = ["fold", *plain, *(f"{k}_bucket" for k in bucket)]
    blocked = F.sum(F.when(F.col("by_rule") == "block", 1).otherwise(0))
    seen = labelled.groupBy(*keys).agg(blocked.alias("pos"), F.count("*").alias("n"))
    # Statistics of suffixes: at most SUFFIX_BUCKETS x FOLDS rows each, by a second aggregation of the counts.
    others, score = {}, {}
    for k in bucket:
        without, whole = rates(seen.groupBy(f"{k}_bucket", "fold").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")).collect())
        others[k] = F.get(F.lit(without), F.col("fold") * SUFFIX_BUCKETS + F.col(f"{k}_bucket"))
        score[k] = F.get(F.lit(whole), F.col(f"{k}_bucket"))
    names = [*plain, *score]
    vectors = seen.select(*plain, *(c.alias(k) for k, c in binned(others).items()), "pos", "n").groupBy(*names).agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    counts = sorted((tuple(r[:-2]), float(r.pos), float(r.n - r.pos)) for r in vectors.collect())
    both = sum(c[1] for c in counts) and sum(c[2] for c in counts)
    trees = fit(counts, names) if both else []
    parts = parts.select("page_id", "host", "path", "rule", "by_rule", *plain, *(c.alias(k) for k, c in binned(score).items()))
    margin = F.round(sum((as_column(t) for t in trees), F.lit(0.0)), 6)
    parts = parts.select("page_id", "host", "path", "rule", "by_rule", margin.alias("score"))
    return parts.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
