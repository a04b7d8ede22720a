"""Links of a graph as arrays: what entities hold goes over every link in one pass, without a shuffle of the links.

Entities are numbered, and a block is a range of numbers. A round reads the links, which were dealt to the block that
they lead to and packed once, beside the values of all blocks (eight bytes an entity), and exchanges and writes one
array for each block; so what it writes grows with the entities and not with the links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import cut

#: Entities in a block, if they are not more than MOST_BLOCKS of them; links that a worker packs at once.
BLOCK, MOST_BLOCKS, PACKED = 1 << 18, 32, 1 << 23
PLACE = 33  # bits of a number that tell the place in its block


def block_of(n: Column) -> Column:
    return F.shiftright(n, PLACE)


class Blocks:
    """Links (source_id, target_id, weight) between the entities ``ids`` (id); each also leads back with half its weight.

    ``ids``: (id, n). ``steps``: (j, i, src, dst, w), arrays of steps from block i to block j by places in the blocks.
    ``out``: (j, x), the weight of the steps out of each entity of a block. An entity without links may lie
    beyond the end of its block's array.
    """

    def __init__(self, ids: DataFrame, links: DataFrame):
        size = ids.count()
        parts = max(1, min(MOST_BLOCKS, -(-size // BLOCK)))
        self.ids = cut(ids.repartition(parts, "id").dropDuplicates(["id"]).withColumn("n", F.monotonically_increasing_id()))
        end = lambda c: self.ids.select(F.col("id").alias(f"{c}_id"), F.col("n").alias(c)).hint("shuffle_hash")
        links = links.join(end("source"), "source_id").drop("source_id").join(end("target"), "target_id").select("source", "target", "weight")
        # The weight of a step back goes below nought, which tells it from one along a link until it is packed.
        both = F.array(F.struct(F.col("source").alias("s"), F.col("target").alias("t"), F.col("weight").alias("w")), F.struct(F.col("target").alias("s"), F.col("source").alias("t"), (F.col("weight") / -2).alias("w")))
        steps = links.select(F.inline(both))
        self.packed = cut(steps.repartitionById(parts, block_of(F.col("t")).cast("int")).mapInArrow(_packer(), "j long, i long, src binary, dst binary, w binary"))
        self.steps, self.out = self.packed.where("i >= 0"), self.packed.where("i < 0").select("j", F.col("w").alias("x"))
        few = self.packed.agg(F.coalesce(F.max("j"), F.lit(0)).alias("j"), F.coalesce(F.sum(F.length("dst")), F.lit(0)).alias("b")).first()
        #: Whether all is one block of links that a worker takes at once.
        self.alone = parts == 1 and few.j == 0 and few.b <= 4 * PACKED

    def spread(self, values: DataFrame) -> DataFrame:
        """(j, x): what values (j, z) give over the steps, to be added up for each block."""
        # One side is a few rows, an array each: every task reads them from their files, which takes no exchange.
        pairs = self.steps.join(values.select(F.col("j").alias("i"), "z").coalesce(1).hint("shuffle_replicate_nl"), "i")
        return pairs.select("j", "src", "dst", "w", "z").mapInArrow(_spreader(), "j long, x binary")

    def start(self, seeds: DataFrame) -> DataFrame:
        """(j, x, at): values (id, v) by block, as arrays of values and of places."""
        own = seeds.join(self.ids, "id").select(block_of(F.col("n")).alias("j"), F.col("n").bitwiseAND((1 << PLACE) - 1).alias("at"), "v")
        return cut(own.groupBy("j").agg(F.collect_list(F.struct("at", "v")).alias("a")).select("j", F.col("a.v").alias("v"), F.col("a.at").alias("at")))

    def round(self, parts: dict[str, DataFrame], start: DataFrame, make: Callable, schema: str, *how) -> DataFrame:
        """What ``make`` gives of each block: make(arrays by name, places of seeds, values of seeds, *how) -> a row after j.

        ``parts`` are DataFrames (j, x) of arrays, of which those of one name are added up.
        """
        rows = start.select("j", F.lit("").alias("part"), F.lit(None).cast("binary").alias("x"), "at", "v")
        for name, df in parts.items():
            rows = rows.unionByName(df.select("j", F.lit(name).alias("part"), "x"), allowMissingColumns=True)

        def of_block(key, pdf):
            import pandas as pd

            full, at, v, _ = read(pdf, names)
            return pd.DataFrame([(int(key[0]), *(c.tobytes() if hasattr(c, "tobytes") else c for c in make(full, at, v, *how)))], columns=columns)

        names, columns, read = list(parts), ["j", *(c.strip().split()[0] for c in schema.split(","))], _reader()
        return rows.groupBy("j").applyInPandas(of_block, f"j long, {schema}")

    def at_once(self, start: DataFrame, make: Callable) -> DataFrame:
        """(j, x) of the one block: make(weights out, places of seeds, values of seeds, spread), where spread takes and gives an array."""
        rows = self.steps.select("j", F.lit("steps").alias("part"), F.lit(None).cast("binary").alias("x"), "src", "dst", "w")
        rows = rows.unionByName(self.out.select("j", F.lit("out").alias("part"), "x"), allowMissingColumns=True)
        rows = rows.unionByName(start.select("j", F.lit("").alias("part"), "at", "v"), allowMissingColumns=True)

        def of_block(key, pdf):
            import numpy as np
            import pandas as pd

            full, at, v, steps = read(pdf, ["out"])
            out = full["out"]

            def spread(z):
                x = np.zeros(len(out))
                for src, dst, w in steps:
                    x += np.bincount(dst, z[src] * w, minlength=len(out))
                return x

            return pd.DataFrame([(int(key[0]), make(out, at, v, spread).tobytes())], columns=["j", "x"])

        read = _reader()
        return rows.groupBy("j").applyInPandas(of_block, "j long, x binary")

    def named(self, values: DataFrame, name: str) -> DataFrame:
        """(id, value) of the values (j, x) above nought."""

        def run(batches: Iterator) -> Iterator:
            import numpy as np
            import pyarrow as pa

            for b in batches:
                for j, x in zip(b.column(0).to_pylist(), b.column(1)):
                    x = np.frombuffer(x.as_buffer())
                    at = np.flatnonzero(x > 0)
                    for k in range(0, len(at), 1 << 16):
                        some = at[k : k + (1 << 16)]
                        yield pa.RecordBatch.from_arrays([pa.array(some + (j << PLACE)), pa.array(x[some])], ["n", "x"])

        found = values.select("j", "x").mapInArrow(run, "n long, x double")
        return self.ids.join(found, "n").select("id", F.col("x").alias(name))


def _reader() -> Callable:
    def read(pdf, names):
        """(arrays by name, places, values, steps) of the rows of a block."""
        import numpy as np

        arrays, at, v, steps = {}, np.zeros(0, np.int64), np.zeros(0), []
        size = 0
        for k, part in enumerate(pdf["part"]):
            row = pdf.iloc[k]
            if part == "steps":
                steps.append([np.frombuffer(row[c], t) for c, t in (("src", np.int32), ("dst", np.int32), ("w", np.float64))])
            elif part:
                arrays.setdefault(part, []).append(np.frombuffer(row["x"]))
                size = max(size, len(row["x"]) // 8)
            else:
                at, v = np.asarray(row["at"], np.int64), np.asarray(row["v"], np.float64)
                size = max(size, int(at.max()) + 1)
        full = {name: np.zeros(size) for name in names}
        for name in names:
            for x in arrays.get(name, ()):
                full[name][: len(x)] += x
        return full, at, v, steps

    return read


def _packer() -> Callable:
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        mask = (1 << PLACE) - 1
        out: dict = {}

        def row(j, i, src, dst, w):
            binary = lambda a: pa.array([None if a is None else a.tobytes()], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([j], pa.int64()), pa.array([i], pa.int64()), binary(src), binary(dst), binary(w)], ["j", "i", "src", "dst", "w"])

        def pack(held):
            s, t, w = (np.concatenate(c) for c in zip(*held))
            blocks = (t >> PLACE).astype(np.uint16)
            for j in np.flatnonzero(np.bincount(blocks)).tolist():
                own = slice(None) if (blocks == j).all() else blocks == j
                a, at, x = s[own], (t[own] & mask).astype(np.int32), w[own]
                # A link's weight is half given back by where it leads to; a step back has half the link's.
                weight = np.bincount(at, np.where(x < 0, -2 * x, x / 2))
                x = np.abs(x)
                old = out.get(j)
                if old is not None and len(old) > len(weight):
                    old, weight = weight, old
                if old is not None:
                    weight[: len(old)] += old
                out[j] = weight
                i = (a >> PLACE).astype(np.uint16)
                order = np.argsort(i, kind="stable")
                a, at, x, i = (a[order] & mask).astype(np.int32), at[order], x[order], i[order]
                ends = [*np.flatnonzero(np.diff(i)) + 1, len(i)]
                for p, q in zip([0, *ends[:-1]], ends):
                    yield row(j, int(i[p]), a[p:q], at[p:q], x[p:q])

        held, n = [], 0
        for b in batches:
            held.append([b.column(k).to_numpy(zero_copy_only=False) for k in range(3)])
            n += b.num_rows
            if n >= PACKED:
                yield from pack(held)
                held, n = [], 0
        if n:
            yield from pack(held)
        for j, weight in out.items():
            yield row(j, -1, None, None, weight)

    return run


def _spreader() -> Callable:
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        sums: dict = {}
        for b in batches:
            for j, *arrays in zip(b.column(0).to_pylist(), *(b.column(k) for k in range(1, 5))):
                src, dst, w, z = (np.frombuffer(x.as_buffer(), t) for x, t in zip(arrays, (np.int32, np.int32, np.float64, np.float64)))
                x = np.bincount(dst, z[src] * w)
                old = sums.get(j)
                if old is not None and len(old) > len(x):
                    old, x = x, old
                if old is not None:
                    x[: len(old)] += old
                sums[j] = x
        for j, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([j], pa.int64()), pa.array([x.tobytes()], pa.binary())], ["j", "x"])

    return run

