"""A graph as of a time, for a reader: scope and time are applied once, at the base of every plan."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .model import at, in_scope


@dataclass(frozen=True)
class Snapshot:
    """Tables and how they are seen. ``current_only=False`` without ``as_of`` sees retired rows too."""

    entities: DataFrame
    edges: DataFrame
    sources: DataFrame | None = None
    embeddings: DataFrame | None = None
    triples: DataFrame | None = None
    scope: str | None = None
    owner: str | None = None
    as_of: str | None = None
    axis: str = "valid"
    current_only: bool = True
    more: dict[str, DataFrame] = field(default_factory=dict)

    def seen_by(self, scope: str = "all", owner: str | None = None) -> Snapshot:
        return replace(self, scope=scope, owner=owner)

    def seen_at(self, when: str | None, axis: str = "valid") -> Snapshot:
        return replace(self, as_of=when, axis=axis, current_only=True)

    def with_retired(self) -> Snapshot:
        return replace(self, as_of=None, current_only=False)

    def nodes(self) -> DataFrame:
        """Visible entities."""
        out = self.entities
        if self.scope is not None:
            out = out.where(in_scope(self.scope, self.owner))
        if self.as_of is not None or self.current_only:
            out = out.where(at(self.as_of, self.axis))
        return out

    def links(self) -> DataFrame:
        """Edges that hold at the time; both ends are not looked at."""
        return self.edges.where(at(self.as_of, self.axis)) if self.as_of is not None or self.current_only else self.edges

    def inner_links(self, exclude: tuple[str, ...] = ("CONTRADICTS",)) -> DataFrame:
        """Edges between visible entities, without the relations in ``exclude``."""
        ids = self.nodes().select(F.col("id").alias("_id"))
        out = self.links()
        if exclude:
            out = out.where(~F.col("relation_type").isin(*exclude))
        out = out.join(ids, out.source_id == ids["_id"], "left_semi")
        return out.join(ids, out.target_id == ids["_id"], "left_semi")
