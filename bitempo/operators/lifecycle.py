"""Flush, backup, merge, load and inspection of snapshots, by a window of time on an axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import AXES, SCHEMAS, empty
from ..sources.store import Store

Tables = dict[str, DataFrame]


def window(before: str | None, since: str | None, axis: str = "valid") -> Column:
    """Rows with since <= start < before."""
    if axis not in AXES:
        raise ValueError(f"axis must be valid or learned, not {axis!r}")
    start = F.col(AXES[axis][0])
    out = F.lit(True)
    if before is not None:
        out = out & (start < F.lit(before).cast("timestamp_ntz"))
    if since is not None:
        out = out & (start >= F.lit(since).cast("timestamp_ntz"))
    return out


def _cascade(t: Tables, entities: DataFrame, edges: DataFrame) -> Tables:
    """Edges keep both ends; what hangs on entities follows them; sources keep at least one edge."""
    ids = entities.select(F.col("id").alias("_id"))
    edges = edges.join(ids, F.col("source_id") == F.col("_id"), "left_semi").join(ids, F.col("target_id") == F.col("_id"), "left_semi")
    out = dict(t) | {"entities": entities, "edges": edges}
    for name, key in (("embeddings", "entity_id"), ("strength_cache", "entity_id")):
        if name in t:
            out[name] = t[name].join(ids, F.col(key) == F.col("_id"), "left_semi")
    if "triples" in t:
        out["triples"] = t["triples"].join(ids, F.col("subject_id") == F.col("_id"), "left_semi").join(ids, F.col("object_id") == F.col("_id"), "left_semi")
    if "sources" in t:
        refs = edges.select(F.col("source_ref").alias("_ref")).distinct()
        out["sources"] = t["sources"].join(refs, F.col("id") == F.col("_ref"), "left_semi")
    return out


def flush(t: Tables, before: str | None = None, since: str | None = None, axis: str = "valid") -> Tables:
    """Without what starts in the window; without a window, empty but for views, agents and scans."""
    if before is None and since is None:
        spark = t["entities"].sparkSession
        return {n: df if n in ("saved_views", "agents", "scan_log") else empty(spark, n) for n, df in t.items()}
    inside = window(before, since, axis)
    return _cascade(t, t["entities"].where(~inside), t["edges"].where(~inside))


def backup(t: Tables, before: str | None = None, since: str | None = None, axis: str = "valid") -> Tables:
    """Only what starts in the window."""
    inside = window(before, since, axis)
    return _cascade(t, t["entities"].where(inside), t["edges"].where(inside))


def removed(before: Tables, after: Tables, names: tuple[str, ...] = ("entities", "edges", "sources")) -> DataFrame:
    """(table, n): rows of ``before`` that ``after`` lacks."""
    out = None
    for n in names:
        gone = before[n].select("id").join(after[n].select("id"), "id", "left_anti").agg(F.count("*").alias("n")).select(F.lit(n).alias("table"), "n")
        out = gone if out is None else out.unionAll(gone)
    return out


def merge_from(live: Tables, other: Tables, before: str | None = None, since: str | None = None, axis: str = "valid") -> tuple[Tables, DataFrame]:
    """(tables, counts of new rows): rows of the other snapshot whose ids are new; live ones win.

    Edges come only with both ends and their source; embeddings and triples come with their entities.
    """
    inside = window(before, since, axis)
    out = dict(live)
    fresh = {}
    for n, rows in (("sources", other["sources"]), ("entities", other["entities"].where(inside)), ("edges", other["edges"].where(inside))):
        new = rows.join(live[n].select("id"), "id", "left_anti").select(live[n].columns)
        if n == "edges":
            ids = out["entities"].select(F.col("id").alias("_id"))
            refs = out["sources"].select(F.col("id").alias("_ref"))
            new = new.join(ids, F.col("source_id") == F.col("_id"), "left_semi").join(ids, F.col("target_id") == F.col("_id"), "left_semi").join(refs, F.col("source_ref") == F.col("_ref"), "left_semi")
        fresh[n] = new
        out[n] = live[n].unionByName(new)
    ids = out["entities"].select(F.col("id").alias("_id"))
    for n, key, own in (("embeddings", ["entity_id", "model_name", "model_version"], "entity_id"), ("triples", ["subject_id", "predicate", "object_id", "valid_from"], "subject_id")):
        if n in live and n in other:
            new = other[n].join(live[n].select(key), key, "left_anti").join(ids, F.col(own) == F.col("_id"), "left_semi").select(live[n].columns)
            out[n] = live[n].unionByName(new)
    counts = None
    for n, new in fresh.items():
        c = new.agg(F.count("*").alias("n")).select(F.lit(n).alias("table"), "n")
        counts = c if counts is None else counts.unionAll(c)
    return out, counts


def load_from(live: Store, other: Store, mode: str = "merge") -> int:
    """The live store's new version. A store written by a newer format is refused when its manifest is read."""
    other.manifest()
    if mode == "replace":
        return live.write(other.all())
    if mode != "merge":
        raise ValueError(f"mode must be merge or replace, not {mode!r}")
    return live.write(merge_from(live.all(), other.all())[0])


def inspect(t: Tables) -> DataFrame:
    """(kind, name, n): rows of each table, entities by type and edges by relation."""
    out = None
    for n in SCHEMAS:
        if n in t:
            c = t[n].agg(F.count("*").alias("n")).select(F.lit("table").alias("kind"), F.lit(n).alias("name"), "n")
            out = c if out is None else out.unionAll(c)
    for n, key in (("entities", "type"), ("edges", "relation_type")):
        out = out.unionAll(t[n].groupBy(key).agg(F.count("*").alias("n")).select(F.lit(n).alias("kind"), F.col(key).alias("name"), "n"))
    return out


def open_tables(spark: SparkSession, path: str) -> Tables:
    return Store(spark, path, read_only=True).all()
