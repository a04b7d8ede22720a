"""Document fingerprints by winnowing (operator 9), in DataFrame operations only.

Every run of ``GRAM`` words is hashed; of each window of ``WINDOW`` hashes the smallest is kept, the
rightmost one of equal ones, with its position. Two texts that share a passage of GRAM + WINDOW - 1 words
share a kept hash. The kept hashes are the fingerprint; likeness is their Jaccard similarity.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

GRAM, WINDOW = 5, 6
#: Bits for a position in a packed key: 2**28 words, more than half a gigabyte of text.
POSITION_BITS = 28
#: Buckets of rows in order: the square root of the rows up to this, and rows sampled for a bucket's bounds.
MOST_BUCKETS, SAMPLED = 1 << 17, 16
_MASK = (1 << POSITION_BITS) - 1


def selected(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """Packed (hash, position from the right) keys that winnowing keeps of a text, in order of position.

    A key is ``hash << 28 | (2**28 - 1 - position)``: the smallest key of a window is its smallest hash, the
    rightmost of equal ones. Positions count words. A text of fewer than ``gram`` words has one gram of all
    its words; a text without words has none.
    """
    words = F.filter(F.split(F.lower(text), r"[\s\x00-\x20]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def of_grams(h: Column) -> Column:
        n = F.greatest(F.size(h) - gram, F.lit(0))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(
            F.transform(
                F.sequence(F.lit(0), n),
                lambda i: F.shiftrightunsigned(F.xxhash64(*(F.get(h, i + k) for k in range(gram))), 64 - 35) * (1 << POSITION_BITS) + (_MASK - i),
            )
        )

    def of_windows(keys: Column) -> Column:
        if window == 1:
            return keys
        n = F.greatest(F.size(keys) - window, F.lit(0))
        return F.when(F.size(keys) == 0, keys).otherwise(F.transform(F.sequence(F.lit(0), n), lambda i: F.least(*(F.coalesce(F.get(keys, i + k), F.get(keys, i)) for k in range(window)))))

    # transform over one-element arrays names an intermediate value without computing it again
    grams = F.transform(F.array(hashes), of_grams)
    return F.array_distinct(F.get(F.transform(grams, of_windows), F.lit(0)))


def hashes_of(keys: Column) -> Column:
    return F.array_distinct(F.transform(keys, lambda k: F.shiftrightunsigned(k, POSITION_BITS)))


def positions_of(keys: Column) -> Column:
    return F.transform(keys, lambda k: (F.lit(_MASK) - k.bitwiseAND(_MASK)).cast("int"))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes; two empty ones are alike."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def fingerprint(keys: Column) -> Column:
    """A text form: positions and hashes of what was kept."""
    return F.array_join(F.transform(keys, lambda k: F.concat(F.hex(F.shiftrightunsigned(k, POSITION_BITS)), F.lit("@"), (F.lit(_MASK) - k.bitwiseAND(_MASK)).cast("string"))), ",")


def ordered(docs: DataFrame) -> DataFrame:
    """Column b: the row's bucket, in order of (doc_id, tie), of which a null doc_id is the least.

    Bounds are quantiles of a sample by hash, so buckets are alike in size whatever the ids' values are. A row finds
    its bucket by binary search in them.
    """
    rows = docs.count()
    buckets = min(MOST_BUCKETS, max(1, math.isqrt(rows)))
    key = F.struct(F.col("doc_id").isNotNull().alias("named"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "tie")
    every = max(1, rows // (buckets * SAMPLED))
    own = sorted(tuple(r[0]) for r in docs.where(F.pmod(F.xxhash64("tie", "doc_id"), F.lit(every)) == 0).select(key).collect())
    bounds = sorted({own[len(own) * i // buckets] for i in range(1, buckets)}) if own else []
    text = json.dumps([{"named": x, "doc_id": d, "tie": t} for x, d, t in bounds])
    kind = "array<struct<named:boolean,doc_id:bigint,tie:bigint>>"
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(max(1, len(bounds).bit_length())))))

    def halve(at: Column, step: Column) -> Column:  # bounds[: at] are at most the key
        to = at + step
        return F.when((to <= len(bounds)) & (F.get(F.col("_bounds"), to - 1) <= F.col("_key")), to).otherwise(at)

    put = docs.withColumns({"_key": key, "_bounds": F.from_json(F.lit(text), kind)})
    return put.withColumn("b", F.aggregate(steps, F.lit(0), halve)).drop("_key", "_bounds")


def with_next(docs: DataFrame, made: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Columns of ``made``, from the text, and next_text and next_ of each: of the following row in descending doc_id.

    After the last row comes the first. Rows are dealt into buckets of ids; the first row of each bucket, and its copies,
    also visit the bucket before it, so that every bucket finds its followers at home, the texts are shuffled once
    and what is made from them is made once for both uses.
    """
    docs = ordered(docs)
    # of each bucket its first row in descending order; at most MOST_BUCKETS rows of two numbers
    heads = docs.select("b", "doc_id", "tie").groupBy("b").agg(F.max(F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "tie")).alias("head"))
    every = Window.orderBy("b")
    heads = heads.select(F.col("head.doc_id").alias("hd"), F.col("head.tie").alias("ht"), F.coalesce(F.lead("b").over(every), F.first("b").over(every)).alias("visits"))
    visits = F.broadcast(heads)
    match = F.col("doc_id").eqNullSafe(F.col("hd")) & (F.col("tie") == F.col("ht"))
    docs = docs.join(visits, match, "left").drop("hd", "ht")
    home = F.struct(F.col("b").alias("at"), F.lit(0).alias("guest"))
    guest = F.struct(F.col("visits").alias("at"), F.lit(1).alias("guest"))
    docs = docs.select("doc_id", "tie", "text", F.explode(F.when(F.col("visits").isNull(), F.array(home)).otherwise(F.array(home, guest))).alias("place"))
    docs = docs.select("doc_id", "tie", "text", F.col("place.at").alias("at"), F.col("place.guest").alias("guest")).repartition("at")
    docs = docs.withColumns({c: make(F.col("text")) for c, make in made.items()})
    order = Window.partitionBy("at").orderBy("guest", F.desc_nulls_last("doc_id"), F.desc("tie"))
    docs = docs.withColumns({f"next_{c}": F.lead(c).over(order) for c in ("text", *made)})
    return docs.where("guest = 0").drop("tie", "at", "guest")


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    A null text counts as empty; an empty text has an empty fingerprint, and two empty ones are alike (1).
    Rows of one doc_id follow each other by a hash of their text; repeated rows are each other's next row, a
    row that is alone is its own. A null doc_id comes last. Other columns are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    base = base.withColumn("tie", F.xxhash64("text"))
    half = F.expr("length(text) div 2").cast("int")
    both = with_next(base, {"keys": lambda t: selected(t, gram, window)})  # texts alone are shuffled
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(length(text) div 2 as int))"), F.substring(F.col("next_text"), F.lit(1), half))
    both = both.withColumn("edited", edited)
    both = both.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "keys",
        "next_keys",
        selected(F.col("edited"), gram, window).alias("edited_keys"),
    )
    both = both.select("*", *(hashes_of(F.col(k)).alias(k.replace("keys", "hashes")) for k in ("keys", "next_keys", "edited_keys")))
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("keys")).alias("fingerprint"),
        fingerprint(F.col("edited_keys")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"),
        likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
    )


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
