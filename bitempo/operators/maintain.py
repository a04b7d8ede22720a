"""Tiers, staleness, duplicates, strength and the audit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..model import at, conform

ALIKE = 0.95


def _time(now: str) -> Column:
    return F.lit(now).cast("timestamp_ntz")


def _ago(now: str, days: int) -> Column:
    return _time(now) - F.expr(f"INTERVAL {days} DAYS")


def audit(rows: DataFrame, run: str, op: str, now: str, before: Column, after: Column, kind: str = "entity", actor: str = "consolidator") -> DataFrame:
    out = rows.select(F.lit(run).alias("run_id"), F.lit(op).alias("op"), F.lit(kind).alias("target_kind"), F.col("id").alias("target_id"), F.to_json(before).alias("before_json"), F.to_json(after).alias("after_json"), _time(now).alias("occurred_at"), F.lit(actor).alias("actor"))
    return conform(out, "consolidation_log")


def stale_warm(entities: DataFrame, now: str, days: int = 30) -> DataFrame:
    """Warm entities that were not used for so long, the longest first."""
    return entities.where((F.col("tier") == "warm") & (F.col("last_accessed_at") < _ago(now, days))).orderBy("last_accessed_at", "id")


def demote(entities: DataFrame, now: str, run: str, days: int = 30) -> tuple[DataFrame, DataFrame]:
    """(entities, audit): those become cold."""
    hit = (F.col("tier") == "warm") & (F.col("last_accessed_at") < _ago(now, days))
    log = audit(entities.where(hit), run, "DEMOTE", now, F.struct("tier"), F.struct(F.lit("cold").alias("tier")))
    return entities.withColumn("tier", F.when(hit, "cold").otherwise(F.col("tier"))), log


def unconfirmed(entities: DataFrame, edges: DataFrame, now: str, days: int = 30) -> DataFrame:
    """Current warm entities to which no edge was detected for so long."""
    recent = edges.where(F.col("detected_at") > _ago(now, days)).select(F.col("target_id").alias("id"))
    return entities.where((F.col("tier") == "warm") & at(None)).join(recent, "id", "left_anti").select(entities.columns)


def flag_stale(entities: DataFrame, edges: DataFrame, now: str, run: str, days: int = 30) -> tuple[DataFrame, DataFrame]:
    """(entities with ``stale`` in their attributes, audit)."""
    stale = unconfirmed(entities, edges, now, days)
    hit = stale.select(F.col("id").alias("_id"))
    flagged = F.regexp_replace(F.regexp_replace("attrs_json", r"\}\s*$", ',"stale":1}'), r"^\{\s*,", "{")
    out = entities.join(hit, entities.id == hit["_id"], "left").withColumn("attrs_json", F.when(F.col("_id").isNotNull() & F.get_json_object("attrs_json", "$.stale").isNull(), flagged).otherwise(F.col("attrs_json"))).select(entities.columns)
    return out, audit(stale, run, "STALE_FLAG", now, F.struct("attrs_json"), F.struct(F.lit(1).alias("stale")))


def duplicate_groups(entities: DataFrame) -> DataFrame:
    """(canonical_name, type, scope, owner, n, keeper, ids): current hot or warm entities of one name; the oldest is kept.

    Versions of code in different files or commits are no duplicates.
    """
    key = ["canonical_name", "type", "scope", F.coalesce("owner_id", F.lit("")).alias("owner"), F.coalesce("code_file", F.lit("")).alias("file"), F.coalesce("code_commit_sha", F.lit("")).alias("commit")]
    rows = entities.where(at(None) & F.col("tier").isin("hot", "warm"))
    out = rows.groupBy(*key).agg(F.count("*").alias("n"), F.min_by("id", F.struct("created_at", "id")).alias("keeper")).where("n > 1")
    return out


def duplicate_pairs(entities: DataFrame, embeddings: DataFrame, threshold: float = ALIKE) -> DataFrame:
    """(keeper, duplicate): duplicates whose vector is alike the kept one's; without a vector, none."""
    names = ["canonical_name", "type", "scope", "owner", "file", "commit"]
    groups = duplicate_groups(entities)
    rows = entities.where(at(None) & F.col("tier").isin("hot", "warm")).select("canonical_name", "type", "scope", F.coalesce("owner_id", F.lit("")).alias("owner"), F.coalesce("code_file", F.lit("")).alias("file"), F.coalesce("code_commit_sha", F.lit("")).alias("commit"), F.col("id").alias("duplicate"))
    pairs = rows.join(groups.select(*names, "keeper"), names).where("duplicate <> keeper").select("keeper", "duplicate")
    a = embeddings.select(F.col("entity_id").alias("keeper"), "model_name", "model_version", F.col("vector").alias("va"))
    b = embeddings.select(F.col("entity_id").alias("duplicate"), "model_name", "model_version", F.col("vector").alias("vb"))
    both = pairs.join(b, "duplicate").join(a, ["keeper", "model_name", "model_version"])
    return both.where(N.cosine(F.col("va"), F.col("vb")) >= threshold).select("keeper", "duplicate").distinct()


def merge_duplicates(entities: DataFrame, edges: DataFrame, embeddings: DataFrame, now: str, run: str, threshold: float = ALIKE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, edges, audit): duplicates are closed, their edges go to the kept one."""
    pairs = duplicate_pairs(entities, embeddings, threshold)
    gone = pairs.select(F.col("duplicate").alias("_d"), F.col("keeper").alias("_k"))
    out = entities.join(gone, entities.id == gone["_d"], "left")
    out = out.withColumn("valid_until", F.when(F.col("_d").isNotNull(), _time(now)).otherwise(F.col("valid_until"))).select(entities.columns)
    moved = edges
    for end in ("source_id", "target_id"):
        moved = moved.join(gone, moved[end] == gone["_d"], "left").withColumn(end, F.coalesce("_k", end)).select(edges.columns)
    log = audit(pairs.select(F.col("duplicate").alias("id"), "keeper"), run, "MERGE", now, F.struct("id"), F.struct("keeper"))
    return out, moved, log


def strengths(entities: DataFrame, now: str) -> DataFrame:
    """The strength of every current entity at a time."""
    s = N.strength(F.col("importance"), N.days_between(_time(now), F.col("last_accessed_at")), F.col("access_count"))
    return conform(entities.where(at(None)).select(F.col("id").alias("entity_id"), s.alias("strength"), _time(now).alias("last_computed_at")), "strength_cache")


def consolidate(t: dict[str, DataFrame], now: str, run: str) -> dict[str, DataFrame]:
    """All jobs one after the other; the tables that they change."""
    entities, log1 = demote(t["entities"], now, run)
    entities, log2 = flag_stale(entities, t["edges"], now, run)
    entities, edges, log3 = merge_duplicates(entities, t["edges"], t["embeddings"], now, run)
    log = t["consolidation_log"].unionByName(log1).unionByName(log2).unionByName(log3)
    return {"entities": entities, "edges": edges, "strength_cache": strengths(entities, now), "consolidation_log": log}
