"""Traversal and personalised PageRank.

Iterations are joins and aggregations of DataFrames; the plan is cut by writing to the shared folder every
few rounds, so lineage stays short and a lost executor costs a round at most.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..snapshot import Snapshot
from ..sources.store import cut, drop
from .blocks import Blocks

LEAST_WEIGHT, BACK_SHARE = 1e-3, 0.5


def neighbours(g: Snapshot, id_: str, depth: int = 1, relations: Sequence[str] | None = None) -> DataFrame:
    """(id, hops) of visible entities that out-edges reach within ``depth`` hops, without the start.

    The walk goes through entities that the reader can't see; only the result leaves them out. An entity's hops
    are the fewest.
    """
    links = g.links().where(F.col("relation_type") != "CONTRADICTS")
    if relations:
        links = links.where(F.col("relation_type").isin(*relations))
    links = links.select(F.col("source_id").alias("at"), F.col("target_id").alias("id"))
    spark = g.edges.sparkSession
    seen = spark.createDataFrame([(id_, 0)], "id string, hops int")
    frontier = seen
    for hop in range(1, depth + 1):
        frontier = links.join(frontier.select(F.col("id").alias("at")), "at", "left_semi").select("id").distinct()
        frontier = frontier.join(seen, "id", "left_anti").withColumn("hops", F.lit(hop))
        if hop % 3 == 0:
            frontier = cut(frontier)
        seen = seen.unionByName(frontier)
    return seen.where("hops > 0").join(g.nodes().select("id"), "id", "left_semi")


def transitions(links: DataFrame) -> DataFrame:
    """(src, dst, p): where a walk goes from each entity. An edge also leads back with half its weight."""
    w = F.greatest(F.col("confidence_score"), F.lit(LEAST_WEIGHT))
    both = links.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), w.alias("w")).unionAll(links.select(F.col("target_id").alias("src"), F.col("source_id").alias("dst"), (w * BACK_SHARE).alias("w")))
    merged = both.repartition("src").groupBy("src", "dst").agg(F.sum("w").alias("w"))  # one exchange for both sums
    return merged.select("src", "dst", (F.col("w") / F.sum("w").over(Window.partitionBy("src"))).alias("p"))


def out_weights(links: DataFrame) -> DataFrame:
    """(id, weight): what ``transitions`` divides by."""
    w = F.greatest(F.col("confidence_score"), F.lit(LEAST_WEIGHT))
    both = links.select(F.col("source_id").alias("id"), w.alias("w")).unionAll(links.select(F.col("target_id").alias("id"), (w * BACK_SHARE).alias("w")))
    return both.groupBy("id").agg(F.sum("w").alias("weight"))


def _weighted(g: Snapshot) -> DataFrame:
    """(source_id, target_id, weight) of links that hold; ``Blocks`` keeps those between visible entities."""
    links = g.links().where(F.col("relation_type") != "CONTRADICTS")
    return links.select("source_id", "target_id", F.greatest(F.col("confidence_score"), F.lit(LEAST_WEIGHT)).alias("weight"))


def _seeded(g: Snapshot, seeds: DataFrame | Sequence[str]) -> tuple[DataFrame, int]:
    """(id, v) of the visible ones of the seeds, each with its share of one, and their number."""
    if not isinstance(seeds, DataFrame):
        seeds = g.edges.sparkSession.createDataFrame([(s,) for s in dict.fromkeys(seeds)], "id string")
    seeds = cut(seeds.select("id").distinct().join(g.nodes().select("id"), "id", "left_semi"))
    n = seeds.count()
    return seeds.withColumn("v", F.lit(1.0 / max(1, n))), n


def _updates(damping: float, epsilon: float = 0.0) -> tuple:
    """What a round makes of a block, as functions of arrays that workers get by value: start and round of a PageRank, round of a push."""

    def over(x, out):
        return np.divide(x, out, out=np.zeros(len(x)), where=out > 0)

    def first(a, at, v):
        x = np.zeros(len(a["out"]))
        x[at] = v
        return over(x, a["out"]), x, 0.0, int((a["out"][at] > 0).sum())

    def walk(a, at, v, share, before, measured, last):
        out, gap = a["out"], 0.0
        x = a["moved"] * damping
        x[at] += v * share
        if measured:
            old = a["old"] * out
            alone = out[at] == 0
            old[at[alone]] = v[alone] * before
            gap = float(np.abs(x - old).sum())
        return over(x, out), x if measured or last else None, gap, 0

    def push(a, at, v, back, more):
        out, p = a["out"], a["p"]
        r = a["r"] + a["moved"] * damping
        r[at] += v * back
        pushed = np.where((r >= epsilon * out) & (r > 1e-12) & more, r, 0.0)
        p, r = p + pushed * (1 - damping), np.where(pushed > 0, 0.0, r)
        return over(pushed, out), p, r, int((pushed > 0).sum()), float(pushed[out == 0].sum())

    return first, walk, push


def pagerank(g: Snapshot, seeds: DataFrame | Sequence[str], *, damping: float = 0.85, rounds: int = 30, tolerance: float | None = 1e-6) -> DataFrame:
    """(id, score) of a personalised PageRank from visible seeds; no seed, no rows.

    Mass can only get lost at seeds without edges; it is known beforehand, so no round needs a sum over all. With
    ``tolerance=None`` all ``rounds`` are made. What goes on from round to round is each entity's score by its weight.
    """
    seeds, n = _seeded(g, seeds)
    if not n:
        return g.edges.sparkSession.createDataFrame([], "id string, score double")
    blocks = Blocks(g.nodes().select("id"), _weighted(g))
    start = blocks.start(seeds)
    first, walk, _ = _updates(damping)

    def plan(linked):
        """(how much of the seeds' values comes back, the same a round before, whether the change is measured, whether it is the last) by round."""
        lone = 1 - linked / n  # share of the seeds that has no edges
        held, share = lone, 1.0
        for k in range(1, rounds + 1):
            before, share = share, 1 - damping + damping * held
            held = lone * share
            yield share, before, tolerance is not None and k % 3 == 0, k == rounds

    if blocks.alone:

        def whole(out, at, v, spread):
            z, x, _, linked = first({"out": out}, at, v)
            for now in plan(linked):
                z, x, gap, _ = walk({"out": out, "moved": spread(z), "old": z}, at, v, *now)
                if now[2] and gap < tolerance:
                    break
            return x

        return blocks.named(blocks.at_once(start, whole), "score")
    schema = "z binary, x binary, gap double, linked long"
    state = cut(blocks.round({"out": blocks.out}, start, first, schema))
    for now in plan(state.agg(F.sum("linked")).first()[0]):
        parts = {"out": blocks.out, "moved": blocks.spread(state)} | ({"old": state.select("j", F.col("z").alias("x"))} if now[2] else {})
        state, old = cut(blocks.round(parts, start, walk, schema, *now)), state
        drop(old)
        if now[2] and state.agg(F.sum("gap")).first()[0] < tolerance:
            break
    drop(blocks.packed)
    return blocks.named(state, "score")


def push_pagerank(g: Snapshot, seeds: Sequence[str], *, damping: float = 0.85, epsilon: float = 1e-3, rounds: int = 200) -> DataFrame:
    """(id, score) by local push: all entities whose residual is at least epsilon times their weight push at once.

    Rounds go on until none has; what stays unpushed is below that bound everywhere.
    """
    seeds, n = _seeded(g, seeds)
    if not n:
        return g.edges.sparkSession.createDataFrame([], "id string, score double")
    blocks = Blocks(g.nodes().select("id"), _weighted(g))
    start = blocks.start(seeds)
    push = _updates(damping, epsilon)[2]
    if blocks.alone:

        def whole(out, at, v, spread):
            none, back = np.zeros(len(out)), 1.0
            a = {"out": out, "p": none, "r": none, "moved": none}
            for k in range(rounds + 1):
                z, p, r, due, lone = push(a, at, v, back, k < rounds)
                if not due:
                    break
                a, back = {"out": out, "p": p, "r": r, "moved": spread(z)}, lone * damping
            return p

        return blocks.named(blocks.at_once(start, whole), "score")
    none = blocks.out.where(F.lit(False))
    parts, state, back = {"out": blocks.out, "p": none, "r": none, "moved": none}, None, 1.0
    for k in range(rounds + 1):
        state, old = cut(blocks.round(parts, start, push, "z binary, p binary, r binary, due long, lone double", back, k < rounds)), state
        if old is not None:
            drop(old)
        now = state.agg(F.sum("due").alias("due"), F.sum("lone").alias("lone")).first()
        if not now.due:
            break
        parts |= {name: state.select("j", F.col(name).alias("x")) for name in "pr"} | {"moved": blocks.spread(state.where("due > 0"))}
        back = now.lone * damping
    drop(blocks.packed)
    return blocks.named(state.select("j", F.col("p").alias("x")), "score")


def pagerank_batch(g: Snapshot, queries: DataFrame, *, damping: float = 0.85, rounds: int = 30) -> DataFrame:
    """(query, id, score) for many seed sets (query, id) at once: the rounds are shared."""
    steps = cut(transitions(g.inner_links()))
    seeds = queries.select("query", "id").distinct().join(g.nodes().select("id"), "id", "left_semi")
    start = cut(seeds.withColumn("v", 1 / F.count("*").over(Window.partitionBy("query"))))
    p = start.withColumnRenamed("v", "score")
    for k in range(1, rounds + 1):
        moved = p.join(steps, p.id == steps.src).select("query", F.col("dst").alias("id"), (F.col("score") * F.col("p") * damping).alias("x"))
        p = moved.unionAll(start.select("query", "id", (F.col("v") * (1 - damping)).alias("x"))).groupBy("query", "id").agg(F.sum("x").alias("score"))
        if k % 3 == 0:
            p = cut(p)
    of = p.groupBy("query").agg(F.sum("score").alias("of"))  # mass lost at seeds without edges goes back to the seeds
    lost = start.join(of, "query").select("query", "id", (F.col("v") * F.greatest(F.lit(0.0), 1 - F.col("of"))).alias("score"))
    return p.unionByName(lost).groupBy("query", "id").agg(F.sum("score").alias("score")).where("score > 0")


def contradictions_for(g: Snapshot, id_: str) -> DataFrame:
    c = g.links().where(F.col("relation_type") == "CONTRADICTS")
    return c.where(F.col("source_id") == id_).unionByName(c.where(F.col("target_id") == id_)).dropDuplicates(["id"])


def browse_topic(g: Snapshot, name: str, *, depth: int = 2, limit: int = 20, rounds: int = 30) -> DataFrame:
    """(id, name, via): a type's entities, else what ranks highest around an entity of that name."""
    from .catalog import browse_type
    from .scans import find_anchor

    kind = browse_type(g, name, limit)
    if kind.limit(1).count():
        return kind.select("id", "name", F.lit("type").alias("via"))
    anchor = find_anchor(g, name).select("id").first()
    if anchor is None:
        return kind.select("id", "name", F.lit("type").alias("via"))
    near = pagerank(g, [anchor.id], rounds=rounds).where(F.col("id") != anchor.id)
    via = "pagerank"
    if not near.limit(1).count():
        near, via = neighbours(g, anchor.id, depth).select("id", (-F.col("hops")).cast("double").alias("score")), "walk"
    top = near.join(g.nodes().select("id", "name"), "id").orderBy(F.desc(F.round("score", 9)), "id").limit(limit)
    return top.select("id", "name", F.lit(via).alias("via"))


def working_context(g: Snapshot, target: str, *, budget: int = 2000, k: int = 20, rounds: int = 30) -> DataFrame:
    """(part, id, name, score): anchor, its nearest entities within a budget of tokens, and contradictions.

    ``target`` is a name or ``type:name``.
    """
    from .catalog import recent_contradictions, within_budget
    from .scans import find_anchor

    kind, _, name = target.rpartition(":")
    seen = g if not kind else Snapshot(**{**g.__dict__, "entities": g.entities.where(F.lower("type") == kind.lower())})
    anchor = find_anchor(seen, name).select(F.lit("anchor").alias("part"), "id", "name", F.lit(None).cast("double").alias("score"))
    first = anchor.first()
    if first is None:
        return anchor
    score = F.round("score", 9)
    near = pagerank(g, [first.id], rounds=rounds).where(F.col("id") != first.id).join(g.nodes().select("id", "name"), "id").orderBy(F.desc(score), "id").limit(k)
    near = within_budget(near, F.length("name") + F.length("id") + 32, budget, [F.desc(score), F.asc("id")]).select(F.lit("neighbour").alias("part"), "id", "name", "score")
    against = recent_contradictions(g).select(F.lit("contradiction").alias("part"), "id", F.concat_ws(" ", "source_id", "target_id").alias("name"), F.col("confidence_score").alias("score"))
    return anchor.unionAll(near).unionAll(against)


def codebase_map(g: Snapshot, *, budget: int = 1000, k: int = 500, rounds: int = 30) -> DataFrame:
    """(id, type, name, score, used): the highest ranked code entities that fit a budget of tokens."""
    from ..model import CODE_TYPES
    from .catalog import within_budget

    code = g.nodes().where(F.col("type").isin(*CODE_TYPES))
    ranked = pagerank(g, code.select("id"), rounds=rounds).join(code.select("id", "type", "name"), "id").orderBy(F.desc(F.round("score", 9)), "id").limit(k)
    return within_budget(ranked, F.length("type") + F.length("name") + 4, budget, [F.desc(F.round("score", 9)), F.asc("id")])
