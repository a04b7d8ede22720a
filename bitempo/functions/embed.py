"""Embedders. The bag-of-words one needs no model: a worker counts a batch of texts at once, each word once; others plug in as callables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Words whose places a worker remembers.
WORDS = 200_000


def bag_of_words(text: Column, dim: int = 64) -> Column:
    """Words hashed to dimensions with a sign, of length one; a text without words is the first unit vector."""

    def run(texts: pa.Array) -> pa.Array:
        import re
        from hashlib import md5

        import numpy as np
        import pyarrow as pa

        find, codes, owners = re.compile("[a-z0-9_]+").findall, [], []
        given = texts.to_pylist()
        for t in given:
            words = find(t) if t else ()
            owners.append(len(words))
            for w in words:
                c = known.get(w)
                if c is None:
                    h = md5(w.encode()).hexdigest()
                    c = int(h[:7], 16) % dim * 2 + int(h[8], 16) % 2
                    if len(known) < WORDS:
                        known[w] = c
                codes.append(c)
        at = np.repeat(np.arange(len(given)) * (2 * dim), owners) + np.asarray(codes, np.int64)
        hits = np.bincount(at, minlength=2 * dim * len(given)).reshape(len(given), dim, 2)
        v = (hits[:, :, 0] - hits[:, :, 1]).astype(np.float64)
        norm = np.sqrt((v * v).sum(axis=1))  # of whole numbers, so the order of adding doesn't matter
        v[norm == 0, 0] = 1.0
        v /= np.where(norm == 0, 1.0, norm)[:, None]
        flat = pa.array(v.astype(np.float32).ravel())
        null = np.array([t is None for t in given], dtype=bool)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(given) + 1) * dim, pa.int32()), flat, mask=pa.array(null))

    known: dict[str, int] = {}  # a worker's own
    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<float>")(F.lower(text))


def embed_with(df: DataFrame, text: str, embed_many: Callable[[Sequence[str]], Sequence[Sequence[float]]], out: str = "vector") -> DataFrame:
    """``df`` with vectors of a text column by any embedder, a batch at a time."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(**{out: [list(map(float, v)) for v in embed_many(part[text].fillna("").tolist())]})

    return df.mapInPandas(run, _ddl(df) + f", {out} array<float>")


def contextual(name: Column, context: Column) -> Column:
    """What is embedded of a name: its context on a line before it, if it has one."""
    return F.when(F.coalesce(context, F.lit("")) != "", F.concat(context, F.lit("\n"), name)).otherwise(name)


Embedder = Callable[[DataFrame, str], DataFrame]
#: Embedders by name; each takes (df, name of a text column) and gives df with a column vector.
EMBEDDERS: dict[str, Callable[[int], Embedder]] = {"deterministic": lambda dim: lambda df, text: df.withColumn("vector", bag_of_words(F.coalesce(F.col(text), F.lit("")), dim))}


def register(name: str, embed_many: Callable[[Sequence[str]], Sequence[Sequence[float]]]) -> None:
    """Make an embedder known by a name: a function of a batch of texts, which runs on the executors."""
    EMBEDDERS[name] = lambda dim: lambda df, text: embed_with(df, text, embed_many)


def embedder(choice: str = "auto", dim: int = 64) -> Embedder:
    """The embedder of a name; ``auto`` is the one registered last, else the deterministic one."""
    name = list(EMBEDDERS)[-1] if choice == "auto" else choice
    if name not in EMBEDDERS:
        raise ValueError(f"unknown embedder: {choice}; known: {sorted(EMBEDDERS)}")
    return EMBEDDERS[name](dim)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def reembed(entities: DataFrame, now: str, model: str, version: str, dim: int = 64) -> DataFrame:
    """Embeddings of the names of all current entities."""
    return entities.where("valid_until is null").select(F.col("id").alias("entity_id"), F.lit(model).alias("model_name"), F.lit(version).alias("model_version"), F.lit(dim).alias("dim"), bag_of_words(F.col("name"), dim).alias("vector"), F.lit(now).cast("timestamp_ntz").alias("created_at"))
