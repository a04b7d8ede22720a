"""Tables of the bi-temporal graph: types, identity, scope and time predicates.

Times are TIMESTAMP_NTZ in UTC. World time is ``valid_from`` / ``valid_until``, transaction time ``learned_at`` /
``unlearned_at``; both are half-open and an open end is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCHEMAS = {
    "sources": "id string, content string, content_hash string, mime_type string, ingested_at timestamp_ntz, context_summary string",
    "entities": "id string, type string, name string, canonical_name string, owner_id string, scope string, tier string, importance double, valid_from timestamp_ntz, valid_until timestamp_ntz, learned_at timestamp_ntz, unlearned_at timestamp_ntz, created_at timestamp_ntz, last_accessed_at timestamp_ntz, access_count bigint, attrs_json string, code_file string, code_language string, code_commit_sha string, agent_id string",
    "edges": "id string, source_id string, target_id string, relation_type string, source_ref string, confidence_score double, confidence_class string, valid_from timestamp_ntz, valid_until timestamp_ntz, learned_at timestamp_ntz, unlearned_at timestamp_ntz, detected_at timestamp_ntz, cross_scope boolean, attrs_json string, agent_id string",
    "triples": "id string, subject_id string, predicate string, object_id string, edge_id string, fingerprint string, valid_from timestamp_ntz",
    "embeddings": "entity_id string, model_name string, model_version string, dim int, vector array<float>, created_at timestamp_ntz",
    "strength_cache": "entity_id string, strength double, last_computed_at timestamp_ntz",
    "consolidation_log": "run_id string, op string, target_kind string, target_id string, before_json string, after_json string, occurred_at timestamp_ntz, actor string",
    "saved_views": "name string, cypher_source string, created_at timestamp_ntz, last_run_at timestamp_ntz, last_run_ms double, last_run_count bigint, scope string, owner_id string",
    "agents": "id string, name string, description string, capabilities array<string>, created_at timestamp_ntz, last_seen_at timestamp_ntz",
    "scan_log": "id string, agent_id string, started_at timestamp_ntz, finished_at timestamp_ntz, repo_path string, since string, head_sha string, files_scanned bigint, files_changed bigint, entities_added bigint, entities_retired bigint, edges_added bigint, edges_retired bigint, duration_ms double, note string",
}
TABLES = tuple(SCHEMAS)
META_RELATIONS = ("CONTRADICTS", "SUPERSEDES")
CODE_TYPES = ("module", "function", "class", "method")
#: What identifies an entity among current ones; null and '' are the same.
ENTITY_KEY = ("canonical_name", "type", "scope", "owner_id", "code_file", "code_commit_sha")


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def schema(name: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """The table's columns in order; those that ``df`` lacks are null."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(name)))


def moment(when: str) -> str:
    """An ISO time as UTC without an offset; one that has none is UTC already."""
    from datetime import UTC, datetime

    t = datetime.fromisoformat(when)
    return (t if t.tzinfo is None else t.astimezone(UTC).replace(tzinfo=None)).isoformat(sep=" ")


def identity(*cols: Column) -> Column:
    """A deterministic id of identity columns, so that retried tasks and re-runs agree."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in cols)), 256)


def in_scope(scope: str = "all", owner: str | None = None, alias: str = "") -> Column:
    """Rows that a reader may see. Private rows are never seen without their owner."""
    p = f"{alias}." if alias else ""
    shared = F.col(f"{p}scope") == "shared"
    own = (F.col(f"{p}scope") == "private") & (F.col(f"{p}owner_id") == owner) if owner is not None else F.lit(False)
    try:
        return {"shared": shared, "private": own, "all": shared | own}[scope]
    except KeyError:
        raise ValueError(f"scope must be shared, private or all, not {scope!r}") from None


AXES = {"valid": ("valid_from", "valid_until"), "learned": ("learned_at", "unlearned_at")}


def at(when: str | None, axis: str = "valid", alias: str = "") -> Column:
    """Rows that hold at a time on an axis; without a time, current rows (open on the valid axis)."""
    if axis not in AXES:
        raise ValueError(f"axis must be valid or learned, not {axis!r}")
    p = f"{alias}." if alias else ""
    begin, end = (F.col(p + c) for c in AXES[axis])
    if when is None:
        return F.col(f"{p}valid_until").isNull()
    t = F.lit(moment(when)).cast("timestamp_ntz")
    return (begin <= t) & (end.isNull() | (end > t))


def same(a: Column, b: Column) -> Column:
    """Equality in which null and '' are the same."""
    return F.coalesce(a, F.lit("")) == F.coalesce(b, F.lit(""))
