"""Lookups and scans of the graph's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical
from ..model import same
from ..snapshot import Snapshot


def list_entities(g: Snapshot) -> DataFrame:
    return g.nodes().orderBy("created_at", "id")


def entity_ids(g: Snapshot) -> DataFrame:
    return g.nodes().select("id")


def get_entity(g: Snapshot, id_: str) -> DataFrame:
    return g.entities.where(F.col("id") == id_)


def entities_at(g: Snapshot, when: str, axis: str = "valid") -> DataFrame:
    return g.seen_at(when, axis).nodes()


def edges_from(g: Snapshot, id_: str, relation: str | None = None) -> DataFrame:
    out = g.links().where(F.col("source_id") == id_)
    return out.where(F.col("relation_type") == relation) if relation else out


def edges_to(g: Snapshot, id_: str, relation: str | None = None) -> DataFrame:
    out = g.links().where(F.col("target_id") == id_)
    return out.where(F.col("relation_type") == relation) if relation else out


def edges_in_scope(g: Snapshot, exclude: tuple[str, ...] = ("CONTRADICTS",)) -> DataFrame:
    return g.inner_links(exclude)


def model_embeddings(g: Snapshot, model: str, version: str) -> DataFrame:
    return g.embeddings.where((F.col("model_name") == model) & (F.col("model_version") == version))


def get_embedding(g: Snapshot, id_: str, model: str, version: str) -> DataFrame:
    return model_embeddings(g, model, version).where(F.col("entity_id") == id_)


def find_code_entity(g: Snapshot, name: str, *, file: str | None = None, kind: str | None = None, commit: str | None = None) -> DataFrame:
    """The oldest current entity of a name that meets what is given: one row at most."""
    out = g.nodes().where(F.col("canonical_name") == canonical(F.lit(name)))
    for column, value in (("code_file", file), ("type", kind), ("code_commit_sha", commit)):
        if value is not None:
            out = out.where(F.col(column) == value)
    return out.orderBy("created_at", "id").limit(1)


def find_anchor(g: Snapshot, name: str) -> DataFrame:
    """The most used current entity of a name: one row at most."""
    return g.nodes().where(F.col("canonical_name") == canonical(F.lit(name))).orderBy(F.desc("access_count"), F.desc("importance"), "created_at", "id").limit(1)


def known_fingerprints(candidates: DataFrame, triples: DataFrame) -> DataFrame:
    return candidates.join(triples.select("fingerprint"), "fingerprint", "left_semi")


def source_by_content(g: Snapshot, content: str) -> DataFrame:
    return g.sources.where(F.col("content_hash") == F.sha2(F.lit(content), 256)).select("id")


def provenance(edges: DataFrame, sources: DataFrame, hits: DataFrame) -> DataFrame:
    """Sources of the edges that touch the hits (column id), each once.

    Two semi joins in place of an OR over both ends, which would leave no key to join on.
    """
    ids = hits.select(F.col("id").alias("_id"))
    touch = edges.join(ids, edges.source_id == ids["_id"], "left_semi").unionByName(edges.join(ids, edges.target_id == ids["_id"], "left_semi"))
    refs = touch.select(F.col("source_ref").alias("_ref")).distinct()
    return sources.join(refs, sources.id == refs["_ref"], "left_semi")


def agents_by_use(agents: DataFrame) -> DataFrame:
    return agents.orderBy(F.desc_nulls_last("last_seen_at"), "name")


def scans_by_time(scans: DataFrame, agent: str | None = None, limit: int | None = None) -> DataFrame:
    out = scans.where(same(F.col("agent_id"), F.lit(agent))) if agent is not None else scans
    out = out.orderBy(F.desc_nulls_last("finished_at"), "id")
    return out.limit(limit) if limit is not None else out
