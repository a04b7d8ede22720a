"""Counts, topics and browsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..snapshot import Snapshot



def _use() -> list[Column]:
    return [F.desc("access_count"), F.desc("importance"), F.asc("created_at"), F.asc("id")]


def count_by_type(g: Snapshot) -> DataFrame:
    return g.nodes().groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")


def schema_summary(g: Snapshot) -> DataFrame:
    """(kind, name, n) of entity and relation types."""
    nodes = g.nodes().groupBy("type").agg(F.count("*").alias("n")).select(F.lit("entity").alias("kind"), F.col("type").alias("name"), "n")
    links = g.links().groupBy("relation_type").agg(F.count("*").alias("n")).select(F.lit("relation").alias("kind"), F.col("relation_type").alias("name"), "n")
    return nodes.unionAll(links)


def stats(g: Snapshot) -> DataFrame:
    """(name, n): one pass over each table."""
    e = g.entities.agg(F.count("*").alias("entities"), F.count_if(F.col("valid_until").isNull()).alias("current_entities"), F.count_if(F.col("tier") == "hot").alias("hot"), F.count_if(F.col("tier") == "warm").alias("warm"), F.count_if(F.col("tier") == "cold").alias("cold"))
    l = g.edges.agg(F.count("*").alias("edges"), F.count_if(F.col("valid_until").isNull()).alias("current_edges"), F.count_if(F.col("relation_type") == "CONTRADICTS").alias("contradictions"))  # noqa: E741
    long = lambda df: df.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, df.columns)), F.array(*df.columns))).alias("name", "n"))
    return long(e).unionAll(long(l))


def most_used(g: Snapshot, k: int = 10) -> DataFrame:
    return g.nodes().orderBy(*_use()).limit(k)


def topics(g: Snapshot, min_count: int = 1, examples: int = 3) -> DataFrame:
    """type, n, and names of its most used entities joined by |. Examples are cut before they are gathered."""
    nodes = g.nodes()
    counts = nodes.groupBy("type").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    top = nodes.withColumn("k", F.row_number().over(Window.partitionBy("type").orderBy(*_use()))).where(F.col("k") <= examples)
    names = top.groupBy("type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]), "|").alias("examples"))
    return counts.join(names, "type").orderBy(F.desc("n"), "type")


def browse_type(g: Snapshot, kind: str, limit: int = 20) -> DataFrame:
    return g.nodes().where(F.lower("type") == kind.lower()).orderBy(*_use()).limit(limit)


def recent_contradictions(g: Snapshot, k: int = 5) -> DataFrame:
    """The latest contradictions between visible entities."""
    return g.inner_links(exclude=()).where(F.col("relation_type") == "CONTRADICTS").orderBy(F.desc("detected_at"), "id").limit(k)


def language_histogram(g: Snapshot) -> DataFrame:
    return g.nodes().where(F.col("code_language").isNotNull()).groupBy("code_language").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code_language")


def within_budget(ranked: DataFrame, size: Column, budget_tokens: int, order: list[Column]) -> DataFrame:
    """The first rows of a ranking whose sizes fit ``budget_tokens * 4`` characters. The ranking is short (top k)."""
    total = F.sum(size).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("used", total).where(F.col("used") <= budget_tokens * 4)


def delta(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """(table, n): rows that are new in ``after`` by id."""
    out = None
    for name in before:
        new = after[name].join(before[name].select("id"), "id", "left_anti").agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        out = new if out is None else out.unionAll(new)
    return out
