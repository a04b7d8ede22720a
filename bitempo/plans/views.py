"""Saved queries: kept as text, checked when saved, evaluated anew at each run."""

from __future__ import annotations

import re
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import conform, empty, schema
from ..snapshot import Snapshot
from .cypher import cypher, parse

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,63}")


class ViewError(Exception):
    """A view that can't be saved or found."""


class Views:
    """A catalogue of saved queries as a DataFrame (``saved_views``)."""

    def __init__(self, spark: SparkSession, rows: DataFrame | None = None):
        self.spark = spark
        self.rows = rows if rows is not None else empty(spark, "saved_views")

    def save(self, name: str, source: str, now: str, *, scope: str = "all", owner: str | None = None, replace: bool = True) -> None:
        if not NAME.fullmatch(name):
            raise ViewError(f"{name!r} is no name for a view")
        parse(source)
        if not replace and self.rows.where(F.col("name") == name).limit(1).count():
            raise ViewError(f"there is a view {name!r} already")
        row = self.spark.createDataFrame([(name, source, scope, owner)], "name string, cypher_source string, scope string, owner_id string")
        self._put(name, row.withColumn("created_at", F.lit(now).cast("timestamp_ntz")))

    def _put(self, name: str, row: DataFrame | None) -> None:
        kept = self.rows.where(F.col("name") != name)
        data = [tuple(r) for r in (kept.unionByName(conform(row, "saved_views")) if row is not None else kept).collect()]  # a catalogue of names, not data
        self.rows = self.spark.createDataFrame(data, schema("saved_views"))

    def list(self) -> DataFrame:
        return self.rows.orderBy("name")

    def show(self, name: str) -> str:
        found = self.rows.where(F.col("name") == name).select("cypher_source").first()
        if found is None:
            raise ViewError(f"no view {name!r}")
        return found[0]

    def delete(self, name: str) -> bool:
        there = self.rows.where(F.col("name") == name).limit(1).count() > 0
        self._put(name, None)
        return there

    def run(self, name: str, graph: Snapshot, *, now: str | None = None) -> DataFrame:
        """The view's rows; with ``now``, the run is recorded, which evaluates it once more."""
        source = self.show(name)
        row = self.rows.where(F.col("name") == name)
        first = row.first()
        out = cypher(graph.seen_by(first.scope, first.owner_id), source)
        if now is not None:
            began = time.perf_counter()
            n = out.count()
            took = (time.perf_counter() - began) * 1000
            row = row.withColumns({"last_run_at": F.lit(now).cast("timestamp_ntz"), "last_run_ms": F.lit(took), "last_run_count": F.lit(n).cast("bigint")})
            self._put(name, row)
        return out

    def register(self, name: str, graph: Snapshot) -> None:
        """The view as a temporary one for SQL."""
        self.run(name, graph).createOrReplaceTempView(name)
