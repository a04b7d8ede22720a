"""Streams: idempotent ingest, access touches, supersession, incremental scans. Each has a batch twin."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGES = "subject string, predicate string, object string, ts timestamp, previous string, previous_ts timestamp"


def once_by_content(items: DataFrame, ts: str = "ts", within: str = "1 day") -> DataFrame:
    """Items with content_hash, each content once within a time."""
    hashed = items.withColumn("content_hash", F.sha2("content", 256))
    return hashed.withWatermark(ts, within).dropDuplicatesWithinWatermark(["content_hash"])


def touches(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window, id, n, last_at): touches of each entity by window of event time; later events than ``late`` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "id").agg(F.count("*").alias("n"), F.max("ts").alias("last_at"))


def apply_touches(merge: Callable[[DataFrame], None], stream: DataFrame, checkpoint: str) -> StreamingQuery:
    """Closed windows of touches, handed to ``merge`` batch by batch."""
    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _: merge(df)).start()


def changes(facts: list[tuple]) -> dict[tuple, tuple]:
    """(ts, object) of each change in facts that are in order, with what held before: (previous, its ts)."""
    out, held = {}, (None, None)
    for ts, value in facts:
        if value != held[0]:
            out[ts, value] = held
            held = (value, ts)
    return out


#: Groups that keys are dealt to; one holds the state of all of its keys, for a call costs more than a key's few facts.
GROUPS = 1 << 13


def _superseder() -> Callable:
    def run(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for subject, predicate, ts, value in zip(*state.get, strict=True) if state.exists else ():
            held.setdefault((subject, predicate), []).append((ts, value))
        came: dict = {}
        for part in parts:
            for subject, predicate, ts, value in zip(*(part[c] for c in ("subject", "predicate", "ts", "object"))):
                came.setdefault((subject, predicate), []).append((ts, value))
        out = []
        for key, facts in came.items():
            own = held.get(key, [])
            held[key] = facts = sorted(set(own).union(facts))
            old, new = of(sorted(own)), of(facts)
            out += [(*key, value, ts, *before) for (ts, value), before in new.items() if old.get((ts, value)) != before]
            out += [(*key, value, ts, value, ts) for ts, value in old if (ts, value) not in new]
        rows = [(*key, *fact) for key, facts in held.items() for fact in facts]
        state.update(tuple(list(c) for c in zip(*rows)))
        yield pd.DataFrame(out, columns=["subject", "predicate", "object", "ts", "previous", "previous_ts"])

    of = changes
    return run


def supersessions(facts: DataFrame, groups: int = GROUPS) -> DataFrame:
    """Changes of the one value of (subject, predicate): the new object, and the one that it closes and contradicts.

    A late fact takes its place: it comes as a change of its own, the change after it comes again with its new
    predecessor, and a change that is none any more comes with itself as the predecessor. The last row of a (subject,
    predicate, ts, object) holds. The state keeps each key's distinct facts, since any may matter to a later one.
    """
    dealt = facts.withColumn("_group", F.pmod(F.xxhash64("subject", "predicate"), F.lit(groups)))
    return dealt.groupBy("_group").applyInPandasWithState(_superseder(), CHANGES, "subjects array<string>, predicates array<string>, times array<timestamp>, objects array<string>", "append", GroupStateTimeout.NoTimeout)


def incremental_files(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """A file source whose checkpoint is the scan's cursor: each run reads what has come since the last one."""
    return spark.readStream.schema(schema).format(kind).load(path)


def drain(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Run a stream over all that is there, to Parquet."""
    q = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
