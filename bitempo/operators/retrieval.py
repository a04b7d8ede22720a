"""Questions to ranked hits: classes, and what each class does."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import QUESTION_RULES, code_names, overlap, question_class, rule_counts, word_set
from ..model import CODE_TYPES
from ..snapshot import Snapshot
from . import graph as G
from . import vectors as V

MOST, LOW = 10, 0.2
SEEDS, SEED_FLOOR, SEED_SHARE = 5, 0.05, 0.3
COLUMNS = ("id", "score", "layer")


def bounded(limit: int) -> int:
    return min(max(limit, 1), MOST)


def classify(queries: DataFrame, rules: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """The queries (column query) with counts of matching rules and a class; a null one is as an empty one.

    ``rules`` replace those of their class.
    """
    unknown = set(rules or {}) - set(QUESTION_RULES)
    if unknown:
        raise ValueError(f"no such class of questions: {sorted(unknown)}")
    counted = queries.select("*", *(c.alias(k.lower()) for k, c in rule_counts(F.coalesce("query", F.lit("")), rules).items()))
    return counted.withColumn("class", question_class({k: F.col(k.lower()) for k in ("VIBE", "FACT", "CHANGE", "CODE")}))


def class_of(g: Snapshot, query: str) -> str:
    return classify(g.entities.sparkSession.createDataFrame([(query,)], "query string")).first()["class"]


def vibe(g: Snapshot, vector: Sequence[float], k: int = MOST) -> DataFrame:
    """Nearest vectors and their neighbours."""
    return V.search(g, vector, k, depth=1).select("id", "score", F.lit("vector").alias("layer"))


def fact_seeds(g: Snapshot, vector: Sequence[float]) -> DataFrame:
    """Nearest vectors that stand out: a score of 0.05 and 0.3 of the best one's, else the best one alone."""
    near = V.search(g, vector, SEEDS).select("id", "score")
    best = near.agg(F.max("score").alias("best"), F.max_by("id", F.struct("score", F.col("id"))).alias("first"))
    near = near.crossJoin(best)  # five rows and one
    good = F.col("score") >= F.greatest(F.lit(SEED_FLOOR), SEED_SHARE * F.col("best"))
    return near.withColumn("good", good).where(F.col("good") | ((F.col("best") < SEED_FLOOR) & (F.col("id") == F.col("first")))).select("id", "score")


def fact(g: Snapshot, vector: Sequence[float], k: int = MOST, rounds: int = 30) -> DataFrame:
    """What ranks highest around the seeds."""
    ranked = G.pagerank(g, fact_seeds(g, vector), rounds=rounds)
    return ranked.select("id", F.round("score", 9).alias("score"), F.lit("graph").alias("layer")).orderBy(F.desc("score"), "id").limit(k)


def change(g: Snapshot, query: str, when: str, axis: str = "valid", k: int = MOST) -> DataFrame:
    """Entities that hold at a time, by the words they share with the question, and what matches then point to."""
    then = g.seen_at(when, axis)
    q = F.lit(query)
    nodes = then.nodes()
    named = nodes.select("id", F.round(overlap(q, F.col("name")), 9).alias("score"), (F.size(F.array_intersect(word_set(q), word_set(F.col("name")))) > 0).alias("match"))
    subjects = named.where("match").select(F.col("id").alias("source_id"))
    links = then.links().where(F.col("relation_type") != "CONTRADICTS")
    objects = links.join(subjects, "source_id", "left_semi").join(nodes.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    objects = objects.groupBy(F.col("target_id").alias("id")).agg(F.round(F.max(0.95 * F.col("confidence_score")), 9).alias("score"))
    both = named.select("id", "score").unionByName(objects).groupBy("id").agg(F.max("score").alias("score"))
    return both.select("id", "score", F.lit("temporal").alias("layer")).orderBy(F.desc("score"), "id").limit(k)


def code(g: Snapshot, query: str, k: int = MOST, rounds: int = 30) -> DataFrame:
    """Code entities around those that the question names; no rows if it names none."""
    spark = g.entities.sparkSession
    names = spark.createDataFrame([(query,)], "query string").select(F.explode(code_names(F.col("query"))).alias("n")).select(F.lower("n").alias("canonical_name")).distinct()
    nodes = g.nodes().where(F.col("type").isin(*CODE_TYPES))
    seeds = nodes.join(F.broadcast(names), "canonical_name", "left_semi").groupBy("canonical_name").agg(F.min_by("id", F.struct("created_at", "id")).alias("id")).select("id")  # names of one question
    ranked = G.pagerank(g, seeds, rounds=rounds).join(nodes.select("id"), "id", "left_semi")
    return ranked.select("id", F.round("score", 9).alias("score"), F.lit("code").alias("layer")).orderBy(F.desc("score"), "id").limit(k)


def merge(*hits: DataFrame, k: int = MOST) -> DataFrame:
    """The best hit of each entity."""
    both = hits[0]
    for h in hits[1:]:
        both = both.unionByName(h)
    best = both.groupBy("id").agg(F.max_by(F.struct("score", "layer"), F.struct("score", "layer")).alias("b"))
    return best.select("id", "b.score", "b.layer").orderBy(F.desc("score"), "id").limit(k)


def hybrid(g: Snapshot, query: str, vector: Sequence[float], when: str, axis: str = "valid", k: int = MOST, rounds: int = 30) -> DataFrame:
    return merge(vibe(g, vector, k), fact(g, vector, k, rounds), change(g, query, when, axis, k), k=k)


def recall(g: Snapshot, query: str, vector: Sequence[float], *, now: str, as_of: str | None = None, axis: str = "valid", limit: int = MOST, rounds: int = 30) -> tuple[str, DataFrame]:
    """(class, hits). A time holds for every class: it is applied to the snapshot."""
    k = bounded(limit)
    if as_of is not None:
        g = g.seen_at(as_of, axis)
    kind = class_of(g, query)
    if kind == "CODE":
        hits = code(g, query, k, rounds)
        if not hits.limit(1).count():
            hits = vibe(g, vector, k)
    elif kind == "HYBRID":
        hits = hybrid(g, query, vector, as_of or now, axis, k, rounds)
    elif kind == "CHANGE":
        hits = change(g, query, as_of or now, axis, k)
    else:
        hits = fact(g, vector, k, rounds) if kind == "FACT" else vibe(g, vector, k)
    return kind, hits


class RecallCache:
    """Answers of the last ``size`` questions, of at most ten rows each.

    A store's version is part of the key, so what was answered before a write isn't given after it; so are the
    reader and the time of the snapshot.
    """

    def __init__(self, size: int = 256) -> None:
        self.size = size
        self._known: OrderedDict[tuple, tuple[str, list, StructType]] = OrderedDict()

    def recall(self, g: Snapshot, version: int, query: str, vector: Sequence[float], **how) -> tuple[str, DataFrame]:
        """As ``recall``, for a snapshot of that version."""
        key = (version, g.scope, g.owner, g.as_of, g.axis, g.current_only, query, tuple(vector), tuple(sorted(how.items())))
        if key not in self._known:
            kind, hits = recall(g, query, vector, **how)
            self._known[key] = kind, hits.collect(), hits.schema  # ten rows at most
            while len(self._known) > self.size:
                self._known.popitem(last=False)
        self._known.move_to_end(key)
        kind, rows, schema = self._known[key]
        return kind, g.entities.sparkSession.createDataFrame(rows, schema)


def low_confidence(hits: DataFrame) -> DataFrame:
    """One row: whether there is no hit or none scores LOW."""
    return hits.agg((F.coalesce(F.max("score"), F.lit(0.0)) < LOW).alias("low_confidence"))


def rendered(g: Snapshot, hits: DataFrame, chars: int = 8000) -> DataFrame:
    """(line, text): a bullet for each hit, up to a number of characters; nothing if confidence is low."""
    from pyspark.sql.window import Window

    order = Window.orderBy(F.desc("score"), "id")  # ten hits
    lines = hits.join(g.entities.select("id", "name", "type"), "id").withColumn("line", F.row_number().over(order))
    lines = lines.withColumn("text", F.format_string("- %s (%s, score %.2f)", "name", "type", "score"))
    lines = lines.withColumn("used", F.sum(F.length("text") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0))).crossJoin(low_confidence(hits))
    return lines.where(~F.col("low_confidence") & (F.col("used") <= chars)).select("line", "text")


def ask(g: Snapshot, question: str, translate: Callable[[str], str] | None, fallback: Callable[[str], DataFrame]) -> DataFrame:
    """Rows of the query that ``translate`` makes of a question; the fallback's where it makes none that parses."""
    from ..plans.cypher import CypherError, cypher, parse

    if translate is not None:
        source = translate(question)
        try:
            parse(source)
        except CypherError:
            return fallback(question)
        return cypher(g, source)
    return fallback(question)


def touched(entities: DataFrame, touches: DataFrame) -> DataFrame:
    """Entities with touches (id, ts) counted in: access_count by each, last_accessed_at to the latest."""
    seen = touches.groupBy(F.col("id").alias("_id")).agg(F.count("*").alias("_n"), F.max("ts").alias("_at"))
    out = entities.join(seen, entities.id == seen["_id"], "left")
    changed = {"access_count": F.col("access_count") + F.coalesce("_n", F.lit(0)), "last_accessed_at": F.greatest("last_accessed_at", "_at")}
    return out.withColumns(changed).select(entities.columns)


