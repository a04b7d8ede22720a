"""Texts to sources, entities, edges and triples; contradictions of predicates that have one value at a time.

Items are taken in the order of (ts, position): a batch gives what taking them one by one would.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..model import conform, empty, identity
from ..sources.store import cut
from . import dml

CONFIDENCE, AGAINST = 0.8, 0.9
UNIQUE = ("PREFERS", "WORKS_AT", "OWNS", "REPORTS_TO")


def sentences_of(texts: DataFrame) -> DataFrame:
    """The texts (columns id, content) by sentence: id, s (from 0), sentence, nouns, predicate."""
    cut = texts.select("id", F.posexplode(T.sentences(F.col("content"))).alias("s", "sentence"))
    return cut.withColumns({"nouns": T.nouns(F.col("sentence")), "predicate": T.predicate(F.col("sentence"))})


def extract_entities(texts: DataFrame) -> DataFrame:
    """(id, name, at): names of each text, the first spelling of each by lower case."""
    return _entities_of(sentences_of(texts))


def _entities_of(sentences: DataFrame) -> DataFrame:
    words = sentences.select("id", "s", F.posexplode("nouns").alias("w", "name"))
    return words.groupBy("id", F.lower("name").alias("key")).agg(F.min_by("name", F.struct("s", "w")).alias("name"), F.min(F.struct("s", "w")).alias("at")).drop("key")


def extract_triples(texts: DataFrame) -> DataFrame:
    """(id, s, w, subject, predicate, object, fingerprint): a sentence's first noun with each later one."""
    return _triples_of(sentences_of(texts))


def _triples_of(sentences: DataFrame) -> DataFrame:
    said = sentences.where(F.size("nouns") >= 2)
    pairs = said.select("id", "s", F.get("nouns", F.lit(0)).alias("subject"), "predicate", F.posexplode(F.expr("slice(nouns, 2, size(nouns))")).alias("w", "object"))
    return pairs.withColumn("fingerprint", T.fingerprint(F.col("subject"), F.col("predicate"), F.col("object")))


def first_of_subject(triples: DataFrame, object_aware: bool = False) -> DataFrame:
    """The first triple of each (text, subject, predicate), which is what near-duplicate removal within a text
    keeps; with ``object_aware``, of each object too."""
    keys = ["id", F.lower("subject"), "predicate"] + ([F.lower("object")] if object_aware else [])
    return triples.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("s", "w"))).where("_k = 1").drop("_k")


def new_by_fingerprint(triples: DataFrame, known: DataFrame) -> DataFrame:
    return triples.join(known.select("fingerprint"), "fingerprint", "left_anti")


def chain(facts: DataFrame, keys: Sequence[str], value: str, begin: str, tie: str) -> DataFrame:
    """Facts with one value at a time: repeats of the current value go, each one ends where the next begins."""
    by = Window.partitionBy(*keys).orderBy(begin, tie)
    changes = facts.withColumn("previous", F.lag(value).over(by)).where(F.col("previous").isNull() | (F.col("previous") != F.col(value)))
    return changes.withColumn("ends", F.lead(begin).over(by))


def conflicting(triples: DataFrame, prior: DataFrame) -> DataFrame:
    """(subject, predicate, object, prior_object) of facts that say another object of the same subject and predicate."""
    p = prior.select("subject", "predicate", F.col("object").alias("prior_object"))
    return triples.join(p, ["subject", "predicate"]).where(F.col("object") != F.col("prior_object")).select("subject", "predicate", "object", "prior_object").distinct()


def ingest(tables: dict[str, DataFrame], items: DataFrame, now: str, *, unique: Sequence[str] = (), object_aware: bool = False) -> dict[str, DataFrame]:
    """New versions of the tables after items (content, scope, owner_id, ts; columns beside content may lack).

    A content that is known adds nothing. A subject has one current object for each ``unique`` predicate: a later
    one closes the earlier edge and contradicts it. A fact is known only to the readers of its scope, and one
    that was superseded can be said again.
    """
    have = set(items.columns)
    defaults = {"scope": F.lit("shared"), "owner_id": F.lit(None).cast("string"), "ts": F.lit(now).cast("timestamp_ntz")}
    items = items.withColumns({k: v for k, v in defaults.items() if k not in have}).withColumn("content_hash", F.sha2("content", 256))
    first = Window.partitionBy("content_hash").orderBy("ts", F.coalesce("owner_id", F.lit("")), "scope")
    items = items.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")
    items = items.join(tables["sources"].select("content_hash"), "content_hash", "left_anti")
    items = items.withColumn("id", identity(F.lit("source"), F.col("content_hash")))
    sources = tables["sources"].unionByName(conform(items.withColumns({"mime_type": F.lit("text/plain"), "ingested_at": F.lit(now).cast("timestamp_ntz")}), "sources"))
    about = items.select("id", "scope", "owner_id", "ts")

    # What the texts say is read from them once, and found entities and facts are found once, for all that follows.
    sentences = cut(sentences_of(items).select("id", "s", "nouns", "predicate").where(F.size("nouns") > 0))
    named = _entities_of(sentences).join(about, "id")
    drafts = named.select("name", F.lit("CONCEPT").alias("type"), "scope", "owner_id", F.col("ts").alias("valid_from"), F.col("ts").alias("learned_at"))
    entities = tables["entities"].unionByName(cut(dml.new_entities(tables["entities"], drafts, now)))

    said = first_of_subject(_triples_of(sentences), object_aware).join(about, "id")
    names = entities.where("valid_until is null and type = 'CONCEPT'").select("canonical_name", "scope", F.coalesce("owner_id", F.lit("")).alias("owner"), F.col("id").alias("eid"))
    said = said.withColumn("owner", F.coalesce("owner_id", F.lit("")))
    for column in ("subject", "object"):
        said = said.join(names.withColumnsRenamed({"canonical_name": f"_{column}", "eid": f"{column}_id"}), (F.lower(column) == F.col(f"_{column}")) & (said.scope == names.scope) & (said.owner == names.owner)).drop(names.scope, names.owner, f"_{column}")
    said = cut(said.select("id", "ts", "predicate", "subject_id", "object_id", "fingerprint", F.format_string("%s:%06d:%06d", "id", "s", "w").alias("position")))
    single = chain(said.where(F.col("predicate").isin(*unique)), ["subject_id", "predicate"], "object_id", "ts", "position") if unique else None
    plain = said.where(~F.col("predicate").isin(*unique)) if unique else said
    plain = plain.withColumn("_k", F.row_number().over(Window.partitionBy("subject_id", "predicate", "object_id").orderBy("ts", "position"))).where("_k = 1")
    old = tables["triples"].join(tables["edges"].where("valid_until is null").select(F.col("id").alias("edge_id")), "edge_id", "left_semi").select("subject_id", "predicate", "object_id")
    plain = plain.join(old, ["subject_id", "predicate", "object_id"], "left_anti")

    def rows(df: DataFrame, end: Column) -> DataFrame:
        return df.select(
            identity(F.lit("edge"), F.col("subject_id"), F.col("predicate"), F.col("object_id"), F.col("id"), F.col("ts"), F.col("position")).alias("id"), F.col("subject_id").alias("source_id"), F.col("object_id").alias("target_id"), F.col("predicate").alias("relation_type"),
            F.col("id").alias("source_ref"), F.lit(CONFIDENCE).alias("confidence_score"), F.lit("source_grounded").alias("confidence_class"), F.col("ts").alias("valid_from"), end.alias("valid_until"), F.col("ts").alias("learned_at"), F.col("ts").alias("detected_at"), F.lit(False).alias("cross_scope"), F.lit("{}").alias("attrs_json"), "fingerprint",
        )

    none = F.lit(None).cast("timestamp_ntz")
    new = rows(plain, none)
    against = empty(items.sparkSession, "edges")
    edges = tables["edges"]
    if single is not None:
        # The open edge of a subject and predicate is the fact before the first new one.
        begin = single.groupBy("subject_id", "predicate").agg(F.min_by(F.struct("object_id", "ts", "id"), F.struct("ts", "position")).alias("n"))
        opened = edges.where(F.col("valid_until").isNull() & F.col("relation_type").isin(*unique)).select(F.col("id").alias("open_id"), F.col("source_id").alias("subject_id"), F.col("relation_type").alias("predicate"), F.col("target_id").alias("open_object"))
        meets = begin.join(opened, ["subject_id", "predicate"])
        closes = meets.where("n.object_id <> open_object").select(F.col("open_id").alias("_id"), F.col("n.ts").alias("_at"))
        again = meets.where("n.object_id = open_object").select("subject_id", "predicate", F.col("n.ts").alias("ts"))
        edges = edges.join(closes, edges.id == closes["_id"], "left").withColumn("valid_until", F.coalesce("valid_until", "_at")).select(tables["edges"].columns)
        single_new = single.join(again, ["subject_id", "predicate", "ts"], "left_anti")
        new = new.unionByName(rows(single_new, F.col("ends")))
        pairs = single.where("previous is not null").select("object_id", F.col("previous").alias("old"), "ts", "id").unionByName(meets.where("n.object_id <> open_object").select(F.col("n.object_id").alias("object_id"), F.col("open_object").alias("old"), F.col("n.ts").alias("ts"), F.col("n.id").alias("id")))
        against = conform(
            pairs.select(
                identity(F.lit("edge"), F.col("object_id"), F.lit("CONTRADICTS"), F.col("old"), F.col("id"), F.col("ts")).alias("id"), F.col("object_id").alias("source_id"), F.col("old").alias("target_id"), F.lit("CONTRADICTS").alias("relation_type"), F.col("id").alias("source_ref"),
                F.lit(AGAINST).alias("confidence_score"), F.lit("inferred").alias("confidence_class"), F.col("ts").alias("valid_from"), F.col("ts").alias("learned_at"), F.col("ts").alias("detected_at"), F.lit(False).alias("cross_scope"), F.lit("{}").alias("attrs_json"),
            ).dropDuplicates(["id"]),
            "edges",
        )
    triples = dml.new_triples(tables["triples"], new.select(F.col("source_id").alias("subject_id"), F.col("relation_type").alias("predicate"), F.col("target_id").alias("object_id"), F.col("id").alias("edge_id"), "fingerprint", "valid_from"))
    return dict(tables) | {"sources": sources, "entities": entities, "edges": edges.unionByName(conform(new, "edges")).unionByName(against), "triples": tables["triples"].unionByName(triples)}


def last_turns(turns: DataFrame, chars: int = T.TURN_CHARS) -> DataFrame:
    """(conv_id, user, assistant): the last non-empty message of each, cut to a number of characters."""
    said = turns.where(F.trim("text") != "")
    last = lambda role: F.substring(F.max_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn"))), 1, chars).alias(role)
    return said.groupBy("conv_id").agg(last("user"), last("assistant"))


def turns_to_items(turns: DataFrame) -> DataFrame:
    """Contents to ingest of the last turns of conversations."""
    last = last_turns(turns)
    return last.select("conv_id", F.explode(F.array("user", "assistant")).alias("content")).where("content is not null")
