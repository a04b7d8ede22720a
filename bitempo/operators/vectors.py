"""Nearest neighbours: exact, coarse to fine, by signs; expansion over the graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numbers as N
from ..model import META_RELATIONS
from ..snapshot import Snapshot
from ..sources.store import cut

COARSE = 100


def _vector(v: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in v))


def _visible(g: Snapshot) -> DataFrame:
    """Embeddings of visible entities: scope comes before ranking, so a result is never short of rows."""
    ids = g.nodes().select(F.col("id").alias("entity_id"))
    return g.embeddings.join(ids, "entity_id", "left_semi")


def knn(g: Snapshot, query: Sequence[float], k: int = 10) -> DataFrame:
    """(id, score): the k nearest by cosine."""
    scored = _visible(g).select(F.col("entity_id").alias("id"), F.round(N.cosine(F.col("vector"), _vector(query)), 9).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(k)


def knn_two_pass(g: Snapshot, query: Sequence[float], k: int = 10, coarse: int = COARSE) -> DataFrame:
    """(id, score): the best ``coarse`` by the first quarter of the dimensions, reranked by all."""
    n = N.coarse_dim(len(query))
    first = _visible(g).withColumn("near", F.round(N.cosine(N.prefix(F.col("vector"), n), _vector(query[:n])), 9)).orderBy(F.desc("near"), "entity_id").limit(coarse)
    return first.select(F.col("entity_id").alias("id"), F.round(N.cosine(F.col("vector"), _vector(query)), 9).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def knn_l2(g: Snapshot, query: Sequence[float], k: int = 10) -> DataFrame:
    """(id, score): by Euclidean distance d, score max(0, 1 - d*d/4)."""
    q = _vector(query)
    gap = F.aggregate(F.zip_with(F.col("vector").cast("array<double>"), q, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return _visible(g).select(F.col("entity_id").alias("id"), F.round(N.l2_score(F.sqrt(gap)), 9).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def knn_signs(g: Snapshot, query: Sequence[float], k: int = 10) -> DataFrame:
    """(id, score): by the share of dimensions of equal sign."""
    dim = len(query)
    words = [0] * (-(-dim // 64))
    for i, x in enumerate(query):
        words[i // 64] |= (x >= 0) << (63 - i % 64)
    q = F.array(*(F.lit(w - (1 << 64) if w >= 1 << 63 else w).cast("bigint") for w in words))
    gap = N.hamming(N.sign_words(F.col("vector"), dim), q)
    return _visible(g).select(F.col("entity_id").alias("id"), F.round(1 - gap / dim, 9).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def knn_batch(g: Snapshot, queries: DataFrame, k: int = 10, block: int = 1024) -> DataFrame:
    """(query, id, score) for many query vectors (query, vector).

    Every vector is compared with every query, a block of either at a time, by products of matrices. Of each pair of
    blocks the k best of a query go on, and what lies so near the last of them that rounding may tell.
    """
    n = max(1, -(-queries.count() // block))
    blocks = queries.withColumn("b", F.pmod(F.xxhash64("query"), F.lit(n))).groupBy("b").agg(F.collect_list("query").alias("query"), F.collect_list(F.coalesce("vector", F.array())).alias("q")).drop("b")
    own = _visible(g).select(F.col("entity_id").alias("id"), F.coalesce("vector", F.array()).alias("vector")).mapInArrow(_blocks_of_rows(8 * block), "id array<string>, v array<array<float>>")
    best = own.crossJoin(blocks.coalesce(1).hint("shuffle_replicate_nl")).select("id", "v", "query", "q").mapInArrow(_best_of_blocks(k), f"query {queries.schema['query'].dataType.simpleString()}, id string, score double")
    first = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return best.withColumn("score", F.round("score", 9)).withColumn("k", first).where(F.col("k") <= k).drop("k")


def _blocks_of_rows(size: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, size):
                part = b.slice(at, size)
                wrap = lambda c: pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c)
                yield pa.RecordBatch.from_arrays([wrap(pa.concat_arrays([part.column(0)])), wrap(pa.concat_arrays([part.column(1)]))], ["id", "v"])

    return run


def _best_of_blocks(k: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        def by_dim(ids, vectors):
            """{dimension: (ids, matrix)}; a vector with a null in it counts as one of no dimension."""
            rows, lengths = vectors.to_numpy(zero_copy_only=False), {}
            for r, v in enumerate(rows):
                lengths.setdefault(len(v) if not np.isnan(v).any() else 0, []).append(r)
            return {d: ([ids[r] for r in at], np.stack([rows[r] for r in at]).astype(np.float64) if d else None) for d, at in lengths.items()}

        def dots(a, b):
            out = np.zeros(len(a))
            for d in range(a.shape[1]):  # in the order in which expressions add, so digits are theirs
                out += a[:, d] * b[:, d]
            return out

        for batch in batches:
            for r in range(batch.num_rows):
                ids, v, queries, q = (batch.column(c)[r].values for c in range(4))
                own, asked = by_dim(ids.to_pylist(), v), by_dim(queries.to_pylist(), q)
                out = []
                for dim, (names, m) in asked.items():
                    unlike = sorted(i for d, (other, _) in own.items() if d != dim or not d for i in other)[:k]
                    out += [(name, i, None) for name in names for i in unlike]
                    if not dim or dim not in own:
                        continue
                    mine, x = own[dim]
                    xs, ms = np.sqrt(dots(x, x)), np.sqrt(dots(m, m))
                    near = (x @ m.T) / (xs[:, None] * ms[None, :] + 1e-12)
                    least = np.partition(near, len(x) - k, axis=0)[len(x) - k] if len(x) > k else np.full(len(m), -np.inf)
                    a, c = np.nonzero(near >= least[None, :] - 2e-9)
                    score = dots(x[a], m[c]) / (xs[a] * ms[c] + 1e-12)
                    equal = {}
                    for i, j, s in zip(a.tolist(), c.tolist(), score.tolist()):
                        equal.setdefault((j, s), []).append(mine[i])
                    out += [(names[j], i, s) for (j, s), some in equal.items() for i in (sorted(some)[:k] if len(some) > k else some)]
                if out:
                    name, i, s = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(name, queries.type), pa.array(i, pa.string()), pa.array(s, pa.float64())], ["query", "id", "score"])

    return run


def expand(g: Snapshot, seeds: DataFrame, depth: int = 1, decay: float = 0.5) -> DataFrame:
    """(id, score) that seeds (id, score) lend over out-edges: score * decay**(hop + 1) * confidence, the best of several.

    An entity lends on only where its score grew.
    """
    links = g.inner_links().select("source_id", "target_id", "confidence_score")
    out = None
    front = seeds.select("id", "score")
    best = seeds.select("id", F.col("score").alias("had")).where(F.lit(False))
    for hop in range(depth):
        lent = front.join(links, front.id == links.source_id).select(F.col("target_id").alias("id"), (F.col("score") * decay ** (hop + 1) * F.col("confidence_score")).alias("score"))
        front = lent.groupBy("id").agg(F.max("score").alias("score"))
        if hop:
            front = front.join(best, "id", "left").where(F.col("had").isNull() | (F.col("score") > F.col("had"))).select("id", "score")
        out = front if out is None else out.unionByName(front).groupBy("id").agg(F.max("score").alias("score"))
        best = out.withColumnRenamed("score", "had")
    return out if out is not None else front.where(F.lit(False))


def evidence(g: Snapshot, ids: DataFrame) -> DataFrame:
    """(id, confidence_class): source_grounded, inferred if only meta edges come in, hallucination_risk if there is no such entity."""
    wanted = ids.select("id").distinct()
    inbound = g.edges.withColumn("id", F.col("target_id")).join(wanted, "id", "left_semi").groupBy("id").agg(F.max(~F.col("relation_type").isin(*META_RELATIONS)).alias("plain"))
    there = g.entities.join(wanted, "id", "left_semi").select("id", F.lit(True).alias("there"))
    out = ids.select("id").join(inbound, "id", "left").join(there, "id", "left")
    kind = F.when(F.col("plain"), "source_grounded").when(F.col("there").isNull(), "hallucination_risk").when(F.col("plain") == F.lit(False), "inferred").otherwise("source_grounded")
    return out.select("id", kind.alias("confidence_class"))


def search(g: Snapshot, query: Sequence[float], k: int = 10, *, mode: str = "two_pass", depth: int = 0) -> DataFrame:
    """(id, score, confidence_class): nearest entities and what they lend their neighbours, the best score of each."""
    passes = {"exact": knn, "two_pass": knn_two_pass, "l2": knn_l2, "signs": knn_signs}
    seeds = passes[mode](g, query, max(k, COARSE // 4))
    hits = seeds
    if depth:
        hits = seeds.unionByName(expand(g, seeds, depth)).groupBy("id").agg(F.max("score").alias("score"))
    top = cut(hits.withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "id").limit(k))  # k rows, read several times
    return top.join(evidence(g, top), "id").orderBy(F.desc("score"), "id")
