"""The star-schema test tables as a bi-temporal graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import canonical
from ..model import conform
from ..snapshot import Snapshot

EPOCH = "1990-01-01 00:00:00"
NOW = "2024-02-01 00:00:00"


def ts(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _node(df: DataFrame, kind: str, key: str, name: Column, *, private: bool = False, valid_from: Column | None = None, valid_until: Column | None = None, learned_at: Column | None = None, importance: Column | None = None, tier: Column | None = None, accessed: Column | None = None, count: Column | None = None, attrs: Column | None = None) -> DataFrame:
    begin = valid_from if valid_from is not None else ts(EPOCH)
    hidden = F.col(key) % 5 == 0 if private else F.lit(False)
    return conform(
        df.select(
            F.concat(F.lit(kind.lower() + ":"), F.col(key).cast("string")).alias("id"),
            F.lit(kind).alias("type"),
            name.alias("name"),
            canonical(name).alias("canonical_name"),
            F.when(hidden, F.concat(F.lit("u"), (F.col(key) % 3).cast("string")) if private else F.lit(None)).alias("owner_id"),
            F.when(hidden, "private").otherwise("shared").alias("scope"),
            (tier if tier is not None else F.lit("hot")).alias("tier"),
            (importance if importance is not None else F.lit(0.5)).alias("importance"),
            begin.alias("valid_from"),
            (valid_until if valid_until is not None else F.lit(None)).cast("timestamp_ntz").alias("valid_until"),
            (learned_at if learned_at is not None else begin).alias("learned_at"),
            begin.alias("created_at"),
            (accessed if accessed is not None else begin).alias("last_accessed_at"),
            (count if count is not None else F.lit(0)).cast("bigint").alias("access_count"),
            (attrs if attrs is not None else F.lit("{}")).alias("attrs_json"),
        ),
        "entities",
    )


def _text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    c = F.col
    orders = t("orders")
    users = t("events").groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("seen"))
    parts = [
        _node(t("region"), "REGION", "r_regionkey", c("r_name")),
        _node(t("nation"), "NATION", "n_nationkey", c("n_name")),
        _node(
            t("customer"), "CUSTOMER", "c_custkey", c("c_name"), private=True,
            valid_until=F.when(c("c_custkey") % 7 == 0, ts("1998-01-01 00:00:00")),
            importance=F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (c("c_acctbal") + 1000) / 11000)), 6),
            tier=F.when(c("c_custkey") % 4 == 0, "warm").otherwise("hot"),
            accessed=F.when(c("c_custkey") % 8 == 0, ts("2023-12-01 00:00:00")).otherwise(ts("2024-01-15 00:00:00")),
            attrs=_text('{"segment":"', c("c_mktsegment"), '","level":', (c("c_custkey") % 10).cast("string"), "}"),
        ),
        _node(t("supplier"), "SUPPLIER", "s_suppkey", c("s_name")),
        _node(t("part"), "PART", "p_partkey", c("p_name"), private=True, attrs=_text('{"brand":"', c("p_brand"), '","size":', c("p_size"), "}")),
        _node(orders, "ORDER", "o_orderkey", _text("o", c("o_orderkey")), valid_from=c("o_orderdate"), valid_until=F.when(c("o_orderstatus") == "F", c("o_orderdate") + F.expr("INTERVAL 120 DAYS")), learned_at=c("o_orderdate") + F.expr("INTERVAL 30 DAYS")),
        _node(users, "USER", "user_id", _text("user", c("user_id")), tier=F.when(c("seen") < ts("2024-01-29 00:00:00"), "warm").otherwise("hot"), accessed=c("seen"), count=c("n")),
        _node(orders.select("o_orderpriority").distinct(), "PRIORITY", "o_orderpriority", c("o_orderpriority")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of each customer's order priority: c, k (order), value, previous, begin, end."""
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders").withColumn("previous", F.lag("o_orderpriority").over(by))
    o = o.where(F.col("previous").isNull() | (F.col("previous") != F.col("o_orderpriority")))
    return o.select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("value"), "previous", F.col("o_orderdate").alias("begin"), F.lead("o_orderdate").over(by).alias("end"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    c = F.col

    def edge(df, relation, key, source, target, ref, *, confidence=F.lit(1.0), begin=ts(EPOCH), end=F.lit(None), learned=None, crossing=F.lit(False), kind="source_grounded"):
        learned = begin if learned is None else learned
        return conform(
            df.select(
                _text(relation + ":", key).alias("id"), source.alias("source_id"), target.alias("target_id"), F.lit(relation).alias("relation_type"), _text("doc:", ref % 200).alias("source_ref"),
                confidence.alias("confidence_score"), F.lit(kind).alias("confidence_class"), begin.alias("valid_from"), end.cast("timestamp_ntz").alias("valid_until"), learned.alias("learned_at"), learned.alias("detected_at"),
                crossing.alias("cross_scope"), F.lit("{}").alias("attrs_json"),
            ),
            "edges",
        )

    hidden = lambda key: c(key) % 5 == 0
    supplies = t("lineitem").groupBy("l_suppkey", "l_partkey").agg(F.min("l_shipdate").alias("begin"))
    prefers = preferences(spark, sf_dir)
    closed = F.when(c("o_orderstatus") == "F", c("o_orderdate") + F.expr("INTERVAL 120 DAYS"))
    parts = [
        edge(t("customer"), "LOCATED_IN", _text("c", c("c_custkey")), _text("customer:", c("c_custkey")), _text("nation:", c("c_nationkey")), c("c_custkey"), crossing=hidden("c_custkey")),
        edge(t("supplier"), "LOCATED_IN", _text("s", c("s_suppkey")), _text("supplier:", c("s_suppkey")), _text("nation:", c("s_nationkey")), c("s_suppkey")),
        edge(t("nation"), "PART_OF", c("n_nationkey"), _text("nation:", c("n_nationkey")), _text("region:", c("n_regionkey")), c("n_nationkey")),
        edge(t("orders"), "PLACED", c("o_orderkey"), _text("customer:", c("o_custkey")), _text("order:", c("o_orderkey")), c("o_orderkey"), begin=c("o_orderdate"), end=closed, crossing=hidden("o_custkey")),
        edge(t("lineitem"), "CONTAINS", _text(c("l_orderkey"), ":", c("l_linenumber")), _text("order:", c("l_orderkey")), _text("part:", c("l_partkey")), c("l_orderkey"), confidence=F.round(1 - c("l_discount"), 6), begin=c("l_shipdate") - F.expr("INTERVAL 60 DAYS"), learned=c("l_shipdate"), crossing=hidden("l_partkey")),
        edge(supplies, "SUPPLIES", _text(c("l_suppkey"), ":", c("l_partkey")), _text("supplier:", c("l_suppkey")), _text("part:", c("l_partkey")), c("l_partkey"), confidence=F.lit(0.8), begin=c("begin"), crossing=hidden("l_partkey")),
        edge(prefers, "PREFERS", _text(c("c"), ":", c("k")), _text("customer:", c("c")), _text("priority:", c("value")), c("k"), confidence=F.lit(0.8), begin=c("begin"), end=c("end"), crossing=hidden("c")),
        edge(prefers.where("previous is not null"), "CONTRADICTS", _text(c("c"), ":", c("k")), _text("priority:", c("value")), _text("priority:", c("previous")), c("k"), confidence=F.lit(0.9), begin=c("begin"), kind="inferred"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return conform(d.select(_text("doc:", F.col("doc_id")).alias("id"), F.col("text").alias("content"), F.sha2("text", 256).alias("content_hash"), F.lit("text/plain").alias("mime_type"), ts("2023-01-01 00:00:00").alias("ingested_at")), "sources")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return conform(e.select(_text("customer:", F.col("vec_id") + 1).alias("entity_id"), F.lit("given").alias("model_name"), F.lit("1").alias("model_version"), F.size("embedding").alias("dim"), F.col("embedding").alias("vector"), ts(EPOCH).alias("created_at")), "embeddings")


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = preferences(spark, sf_dir)
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"), "c_name")
    p = p.join(names, "c")
    return conform(
        p.select(
            _text("t:", F.col("c"), ":", F.col("k")).alias("id"), _text("customer:", F.col("c")).alias("subject_id"), F.lit("PREFERS").alias("predicate"), _text("priority:", F.col("value")).alias("object_id"),
            _text("PREFERS:", F.col("c"), ":", F.col("k")).alias("edge_id"), F.concat_ws("|", F.lower("c_name"), F.lit("PREFERS"), F.lower("value")).alias("fingerprint"), F.col("begin").alias("valid_from"),
        ),
        "triples",
    )


_PLANS: dict[tuple[str, str], Snapshot] = {}


def graph(spark: SparkSession, sf_dir: str) -> Snapshot:
    """The whole graph, for a reader that sees every row (``seen_by`` narrows it).

    Its plans are analysed once for a session and folder; no data is kept.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _PLANS:
        _PLANS.clear()
        _PLANS[key] = Snapshot(entities(spark, sf_dir), edges(spark, sf_dir), sources(spark, sf_dir), embeddings(spark, sf_dir), triples(spark, sf_dir))
    return _PLANS[key]
