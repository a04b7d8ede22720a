"""N-gram Jaccard join by parity sketches (operator 2).

Word shingles of a document are hashed and dealt into blocks; XOR makes one parity word of each block. Two sets
whose symmetric difference is at most t differ in at most t blocks: the sketches' Hamming distance in blocks
is a lower bound of it. Size bands bound t (a link allows sizes within the threshold of each other and a share
of their sum to differ), so of t + 1 + e blocks at least 1 + e agree, and a join on (band, block, parity word)
finds every link. Shingles that many documents share would fill buckets with strangers, so they all go to a
block of their own that isn't joined on; they are counted over all documents, and which ones they are only moves
work, never results. A block without shingles says nothing; e spare blocks make up for them. Documents with
more empty blocks than that are dealt once more with all their shingles, and those with too many empty
blocks even then meet under one key of their band.

Equal sets (told by a 128-bit digest) count as one from then on. A document meets its own band and, as a guest, the
one below; a bucket of guests only says nothing, for they meet at home. Members of a bucket are compared with one of
them first, which joins large groups in linear time. Buckets that still hold several components are
compared in blocks of bounded size by parity sketches of one bit a shingle, whose length follows the
difference that their sizes allow (``SHARP`` bits for each of t), so that the Hamming distance rejects nearly all that is no
link at every size. A block hands on a spanning forest of what its sketches allow; only where a pair of it turns out
to be no link are all allowed pairs between components handed on. Every candidate is verified on whole shingle
sets, which are made once for the documents that share a bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, Rolling, connected, discard, grams, keep, mix, prepare, release, rows, runs, slices, table, texts_of, tidily, tokens

#: Share of all documents that makes a shingle frequent, and how many are told; the rest stay in the blocks.
FREQUENT, MOST_FREQUENT = 0.0005, 100_000
#: Shingles that a worker holds to count them, and documents and bytes of text that make a task of it.
HELD, TASK_DOCS, TASK_BYTES = 1 << 22, 8000, 1 << 26
#: Rounds of comparing a bucket's members with one of them.
ROUNDS = 1
#: Bits of a sketch for each shingle that may differ, and members of a bucket that are compared in one go.
SHARP, BLOCK = 16, 2048
GUEST = 1 << 62
WORD = np.ones(256, bool)
WORD[[32, *range(9, 14)]] = False


def shingles(buf: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the distinct shingles of each text, in order of text and hash."""
    n = len(offsets) - 1
    start, end, text = tokens(buf, offsets, WORD)
    words = Rolling(LOWER[buf], 2).spans(start, end)
    h, at = grams(words, text, k)
    owner = text[at]
    counts = np.bincount(text, minlength=n)
    for d in np.flatnonzero((counts > 0) & (counts < k)):  # all words as one
        a = np.searchsorted(text, d)
        x = counts[d : d + 1].astype(np.uint64)
        for w in words[a : a + counts[d]]:
            x = mix(x * np.uint64(0x9E3779B97F4A7C15) + w)
        h, owner = np.append(h, x), np.append(owner, d)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[first], owner[first]


class Bands:
    """Size bands and their numbers of blocks for a threshold num/den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.low = [1]
        self.blocks: list[int] = []
        self.spare: list[int] = []

    def upto(self, n: int) -> None:
        while self.low[-1] <= n or len(self.low) < 3:
            self.low.append(self.low[-1] * self.den // self.num + 1)
        while len(self.blocks) < len(self.low) - 1:
            b = len(self.blocks)
            t = (self.low[b + 1] - 1) * (self.den - self.num) // self.num
            e = 0
            while t:
                empty = (t + 1 + e) * math.exp(-self.low[b] / (t + 1 + e))
                if e >= empty + 4 * math.sqrt(empty) or e >= 3 + t // 4:
                    break
                e += 1
            self.blocks.append(t + 1 + e if t else 0)  # equal sets are found by their own key
            self.spare.append(e)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        self.upto(int(sizes.max(initial=1)))
        return np.searchsorted(self.low, sizes, side="right") - 1


@lru_cache(maxsize=4)
def bands(num: int, den: int) -> Bands:
    return Bands(num, den)


def _dealt(h: np.ndarray, owner: np.ndarray, n: int, group: np.ndarray, bands: Bands, asked: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, their texts, texts with too many empty blocks) of the texts that are asked for, in their group of bands."""
    blocks, spare = np.array(bands.blocks), np.array(bands.spare)
    b = np.where(asked & (group >= 0), blocks[np.maximum(group, 0)], 0)
    live = b[owner] > 0
    h, owner = h[live], owner[live]
    block = owner * (1 << 32) + (h >> np.uint64(20)).astype(np.int64) % b[owner]
    order = np.argsort(block, kind="stable")
    block = block[order]
    edge = runs(block)
    text, keys = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(block):
        word = np.bitwise_xor.reduceat(mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5))[order], edge[:-1])
        text = block[edge[:-1]] >> 32
        at = (block[edge[:-1]] & 0xFFFFFFFF).astype(np.uint64)
        keys = mix(word + mix(group[text].astype(np.uint64) << np.uint64(32) | at) + np.uint64(salt))
    empty = b - np.bincount(text, minlength=n)
    return keys, text, (b > 0) & (empty > spare[np.maximum(group, 0)])


def keys_of(h: np.ndarray, owner: np.ndarray, n: int, bands: Bands, frequent: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, text) of the blocks of the texts that are asked for; the lowest bit of a key tells guests."""
    sizes = np.bincount(owner, minlength=n)
    band = bands.of(sizes)
    rare = ~np.isin(h, frequent) if len(frequent) else np.ones(len(h), bool)
    asked = asked & (sizes > 0)
    keys, texts = [], []
    for guest, group in enumerate((band, band - 1)):
        key, text, many = _dealt(h[rare], owner[rare], n, group, bands, asked, 0)
        more, again, still = _dealt(h, owner, n, group, bands, many, 0x5555555500000000)
        last = np.flatnonzero(still)
        own = np.concatenate((key, more, mix(group[last].astype(np.uint64) + np.uint64(0x7777777700000000))))
        keys.append(own >> np.uint64(1) << np.uint64(1) | np.uint64(guest))
        texts += [text, again, last]
    return np.concatenate(keys), np.concatenate(texts)


def digests(h: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """128 bits of each set, the same for equal ones."""
    out = np.zeros((2, n), np.uint64)
    cut = runs(owner)
    some = owner[cut[:-1]]
    if len(some):
        out[0, some] = np.add.reduceat(mix(h), cut[:-1])
        out[1, some] = np.add.reduceat(mix(h ^ np.uint64(0x6A09E667F3BCC908)), cut[:-1])
    return out


def sketch_bits(sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """A power of two, ``SHARP`` times what a set of that size may differ by at least."""
    most = np.maximum(4, SHARP * (sizes * (den - num) // num + 1))
    return 1 << np.ceil(np.log2(np.maximum(64, most))).astype(np.int64)


def sketches(h: np.ndarray, owner: np.ndarray, sizes: np.ndarray, num: int, den: int) -> list[bytes]:
    """One parity bit a shingle: bit ``h mod bits`` is flipped. A longer sketch folds to a shorter one by XOR."""
    bits = sketch_bits(sizes, num, den)
    base = np.concatenate(([0], np.cumsum(bits)))
    at = base[owner] + ((h >> np.uint64(7)).astype(np.int64) & (bits[owner] - 1))
    flat = np.packbits((np.bincount(at, minlength=base[-1]) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [flat[a // 8 : b // 8] for a, b in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]


def folded(sketch: bytes, words: int) -> np.ndarray:
    """A sketch as ``words`` words of 64 bits."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint64).reshape(-1, words), 0)


def _keying(k: int, num: int, den: int, frequent: np.ndarray):
    """Set size, digest and keys of each document. Of equal sets in a task one has keys, the others none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            named = rows(batch, "doc_id").is_valid().to_numpy(zero_copy_only=False)
            buf, offsets = texts_of(rows(batch, "text"))
            for i, j in slices(np.diff(offsets)):
                h, owner = shingles(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                both = digests(h, owner, j - i)
                asked = named[i:j].copy()
                for x, d in enumerate(np.ascontiguousarray(both.T).view("V16").ravel().tolist()):
                    if asked[x]:
                        asked[x] = d not in seen
                        seen.add(d)
                keys, texts = keys_of(h, owner, j - i, bands(num, den), frequent, asked)
                order = np.argsort(texts, kind="stable")
                ends = np.concatenate(([0], np.cumsum(np.bincount(texts, minlength=j - i)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[order].view(np.int64)))
                cols = [rows(batch, c).slice(i, j - i) for c in ("rid", "doc_id", "th")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.bincount(owner, minlength=j - i), pa.int64()), *(pa.array(x.view(np.int64)) for x in both), lists], ["rid", "doc_id", "th", "n", "w1", "w2", "keys"])

    return run


def _setting(k: int, num: int, den: int):
    """Sketch and set (its hashes in order, eight bytes each) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = texts_of(rows(batch, "text"))
            for i, j in slices(np.diff(offsets)):
                h, owner = shingles(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                sizes = np.bincount(owner, minlength=j - i)
                raw, ends = h.tobytes(), np.concatenate(([0], 8 * np.cumsum(sizes))).tolist()
                sets = [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([rows(batch, "rid").slice(i, j - i), pa.array(sizes, pa.int64()), pa.array(sketches(h, owner, sizes, num, den), pa.binary()), pa.array(sets, pa.binary())], ["rid", "n", "sketch", "members"])

    return run


def _could(num: int, den: int):
    """The pairs whose sizes and sketches allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (rows(batch, c).to_numpy() for c in ("n_a", "n_b"))
            fits = np.minimum(n_a, n_b) * den >= np.maximum(n_a, n_b) * num
            left, right = rows(batch, "sketch_a"), rows(batch, "sketch_b")
            for x in np.flatnonzero(fits):
                a, b = left[int(x)].as_py(), right[int(x)].as_py()
                words = min(len(a), len(b)) // 8
                gap = int(np.bitwise_count(folded(a, words) ^ folded(b, words)).sum())
                fits[x] = gap * (den + num) <= (n_a[x] + n_b[x]) * (den - num)
            yield pa.RecordBatch.from_arrays([rows(batch, c).filter(pa.array(fits)) for c in "ab"], ["a", "b"])

    return run


def _judge(num: int, den: int):
    """Verification of the pairs on whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = np.zeros(batch.num_rows, bool)
            left, right = rows(batch, "members_a"), rows(batch, "members_b")
            for x in range(batch.num_rows):
                mine, other = (np.frombuffer(c[x].as_buffer(), np.uint64) for c in (left, right))
                every = np.sort(np.concatenate((mine, other)), kind="stable")  # two ordered runs are merged
                both = int((every[1:] == every[:-1]).sum())
                linked[x] = both * den >= num * (len(every) - both) and both > 0
            yield pa.RecordBatch.from_arrays([rows(batch, "a"), rows(batch, "b"), pa.array(linked)], ["a", "b", "linked"])

    return run


def _blockwise(num: int, den: int, forest: bool):
    """Rows come by (key, x, y): pairs of different labels, one of block x and one of block y, that the sketches allow.

    With ``forest`` a pair is handed on only if those before it leave its ends apart.
    """

    def group(t: pa.Table, x: int, y: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        rid, n, block, guest = (t.column(c).to_numpy() for c in ("rid", "n", "block", "guest"))
        label = np.unique(t.column("label").to_numpy(), return_inverse=True)[1]
        raw = t.column("sketch").to_pylist()
        words = min(map(len, raw)) // 8
        sketch = np.stack([folded(s, words) for s in raw])
        own = np.arange(len(rid))
        left, right = own[block == x], own[block == y]
        for i in left:
            other = right[right > i] if x == y else right
            other = other[(label[other] != label[i]) & ((guest[other] == 0) | (guest[i] == 0))]
            other = other[np.minimum(n[other], n[i]) * den >= np.maximum(n[other], n[i]) * num]
            if not len(other):
                continue
            gap = np.bitwise_count(sketch[other] ^ sketch[i]).sum(1, dtype=np.int64)
            near = other[gap * (den + num) <= (n[other] + n[i]) * (den - num)]
            if forest and len(near):
                hit, first = np.unique(label[near], return_index=True)
                near = near[first]
                label[np.isin(label, hit)] = label[i]
            yield np.minimum(rid[i], rid[near]), np.maximum(rid[i], rid[near])

    def solve(t: pa.Table) -> pa.RecordBatch:
        key, x, y = (t.column(c).to_numpy() for c in ("key", "x", "y"))
        cut = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1, [len(key)]))
        found = [p for a, z in zip(cut[:-1], cut[1:], strict=True) for p in group(t.slice(a, z - a), x[a], y[a])]
        none = np.zeros(0, np.int64)
        pairs = np.unique(np.stack([np.concatenate([none, *(p[c] for p in found)]) for c in (0, 1)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, c])) for c in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            whole = pa.Table.from_batches(held)
            same = np.ones(whole.num_rows, bool)
            for c in ("key", "x", "y"):
                v = whole.column(c).to_numpy()
                same &= v == v[-1]
            stop = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if stop:
                yield solve(whole.slice(0, stop))
                held = whole.slice(stop).combine_chunks().to_batches()
        if held:
            yield solve(pa.Table.from_batches(held))

    return run


def _counter(k: int, held: int, few: int):
    """(shingle, documents) of each chunk of about ``held`` shingles, but for those of few of its documents.

    A chunk loses counts up to half of ``FREQUENT`` of its documents, the last one of a task up to ``few`` at least.
    """

    def counted(parts: list[np.ndarray], loss: int) -> pa.RecordBatch:
        h = np.sort(np.concatenate(parts))
        cut = runs(h)
        n = np.diff(cut)
        more = n > loss
        return pa.RecordBatch.from_arrays([pa.array(h[cut[:-1]][more].view(np.int64)), pa.array(n[more], pa.int64())], ["h", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        size = docs = 0
        for batch in batches:
            buf, offsets = texts_of(rows(batch, "text"))
            for i, j in slices(np.diff(offsets)):
                h, _ = shingles(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                parts.append(h)
                size, docs = size + len(h), docs + j - i
                if size >= held:
                    yield counted(parts, int(FREQUENT / 2 * docs))
                    parts, size, docs = [], 0, 0
        if size:
            yield counted(parts, max(few, int(FREQUENT / 2 * docs)))

    return run


def frequent_of(src: DataFrame, k: int) -> np.ndarray:
    """Shingles of many documents, in order, counted over every row of ``src``; ``MOST_FREQUENT`` at most, the most frequent first.

    None is of fewer than ``least`` documents; all of ``least`` and ``FREQUENT`` of the rows more are told.
    """
    docs, size = src.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    least = max(4, FREQUENT * docs)
    tasks = max(1, docs // TASK_DOCS, size // TASK_BYTES)
    few = int(FREQUENT / 2 * docs / tasks)  # small tasks are put together: what they lose adds up
    counted = src.select("text").coalesce(tasks).mapInArrow(tidily(_counter(k, HELD, few)), "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    often = counted.where(F.col("n") >= least).orderBy(F.desc("n"), "h").limit(MOST_FREQUENT)
    out = np.array([r.h for r in often.collect()], np.int64).view(np.uint64)
    out.sort()
    return out


def links_of(members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) pairs whose links join every component of the sets that meet in buckets.

    members: (key, guest, rid) of buckets of two sets at least; sets: (rid, n, sketch, members).
    """

    def compare(pairs: DataFrame) -> DataFrame:
        """(a, b, linked) of the pairs that the sketches allow."""
        left, right = (sets.select(F.col("rid").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("n", "sketch"))) for c in "ab")
        near = keep(pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(tidily(_could(num, den)), "a bigint, b bigint"), "near")
        return judged(near)

    def judged(near: DataFrame) -> DataFrame:
        left, right = (sets.select(F.col("rid").alias(c), F.col("members").alias(f"members_{c}")) for c in "ab")
        both = near.join(left, "a").join(right, "b").select("a", "b", "members_a", "members_b")
        return keep(both.mapInArrow(tidily(_judge(num, den)), "a bigint, b bigint, linked boolean"), "judged")

    def apart(labels: DataFrame | None) -> DataFrame:
        """(key, guest, rid, label, hub, hub_label, m) of the buckets whose members are in several components."""
        if labels is None:
            rest = members.select("key", "guest", "rid", F.col("rid").alias("label"))
        else:
            rest = members.join(labels.withColumnRenamed("doc_id", "rid"), "rid", "left").select("key", "guest", "rid", F.coalesce("label", "rid").alias("label"))
        hub = F.min(F.struct("guest", "rid", "label"))
        mixed = rest.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("m"), hub.alias("hub")).where("low <> high")
        return keep(rest.join(mixed.select("key", "m", F.col("hub.rid").alias("hub"), F.col("hub.label").alias("hub_label")), "key"), "rest")

    def blocks(rest: DataFrame, forest: bool) -> DataFrame:
        of = F.ceil(F.col("m") / BLOCK).cast("int")
        cut = rest.select("key", "guest", "rid", "label", F.pmod(F.xxhash64("rid"), of).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), of - 1)).alias("other"))
        cut = cut.select("key", "guest", "rid", "label", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
        cut = cut.join(sets.select("rid", "n", "sketch"), "rid").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
        return cut.mapInArrow(tidily(_blockwise(num, den, forest)), "a bigint, b bigint").distinct()

    spark = members.sparkSession
    links = labels = tried = None
    for step in range(ROUNDS + 2):
        rest = apart(labels)
        if step and rest.isEmpty():
            break
        if step < ROUNDS:
            ends = (F.least("hub", "rid").alias("a"), F.greatest("hub", "rid").alias("b"))
            got = compare(rest.where("hub <> rid and label <> hub_label").select(*ends).distinct())
        elif step == ROUNDS:
            got = judged(keep(blocks(rest, True), "near"))
        else:
            got = judged(keep(blocks(rest, False).join(tried, ["a", "b"], "left_anti"), "near"))
        discard(rest)
        release(spark)
        wrong, more = (got.where(c).select("a", "b") for c in ("not linked", "linked"))
        tried = wrong if tried is None else tried.union(wrong)
        if links is None or not more.isEmpty():
            links = more if links is None else links.union(more)
            labels = connected(links)
        if step == ROUNDS and wrong.isEmpty():  # the whole forest is links: nothing is left that sketches allow
            break
    return links


def classes(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    Words are lower-cased in A-Z and split at ASCII white space. A set is the distinct ``k``-word shingles, all
    words as one shingle where there are fewer, empty without words or text; an empty set links with nothing.
    Sets link when ``den * intersection >= num * union``. Rows of one doc_id are one document that links by any of
    its texts; each row has its own n_shingles. A null doc_id is in no component (null), and a row of an empty set in
    that of its doc_id alone. An empty table gives no rows. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    often = frequent_of(src, k)
    base = keep(
        src.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(tidily(_keying(k, num, den, often)), "rid bigint, doc_id bigint, th bigint, n bigint, w1 bigint, w2 bigint, keys array<bigint>"),
        "base",
    )
    # One row stands for all of an equal set; its rid is the set's name.
    sets_of = keep(base.where("n > 0 and doc_id is not null").groupBy("w1", "w2").agg(F.min("rid").alias("rep"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")), "sets_of")
    release(spark)

    # A member is its rid, with GUEST added for a guest: the least of a bucket's members is a guest if all of them are.
    own_key = base.select("rid", F.explode("keys").alias("key"))
    keyed = own_key.select(F.shiftright("key", 1).alias("key"), (F.col("rid") + F.col("key").bitwiseAND(1) * GUEST).alias("member"))
    shared = keep(keyed.groupBy("key").agg(F.min("member").alias("low"), F.max("member").alias("high")).where((F.col("low") < F.col("high")) & (F.col("low") < GUEST)).select("key"), "shared")
    release(spark)
    raw = keep(keyed.join(shared, "key").select("key", F.pmod("member", F.lit(GUEST)).alias("rid"), (F.col("member") >= GUEST).cast("int").alias("guest")), "raw")
    light = keep(base.drop("keys"), "light")
    discard(base, shared)
    release(spark)
    own = light.where("n > 0 and doc_id is not null").join(sets_of.select("w1", "w2", "rep"), ["w1", "w2"])
    named = keep(raw.select("rid").distinct().join(own.select("rid", "rep", "doc_id", "th"), "rid"), "named")
    met = raw.join(named.select("rid", "rep"), "rid").groupBy("key", "rep").agg(F.min("guest").alias("guest"))
    several = met.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.min("guest").alias("home")).where("low <> high and home = 0").select("key")
    members = keep(met.join(several, "key").select("key", "guest", F.col("rep").alias("rid")), "members")
    discard(raw)
    # Copies of a row are dropped where the join has put them; the texts are shuffled once.
    needed = members.select("rid").distinct().join(light.select("rid", "doc_id", "th"), "rid")
    texts = src.join(needed.hint("shuffle_hash"), ["doc_id", "th"]).dropDuplicates(["doc_id", "th"]).select("rid", "text")
    sets = keep(texts.mapInArrow(tidily(_setting(k, num, den)), "rid bigint, n bigint, sketch binary, members binary"), "sets")
    release(spark)
    links = links_of(members, sets, num, den)

    # Rows of one doc_id with different sets belong together.
    split = own.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("doc_id", "a")
    split = split.join(own.select("doc_id", F.col("rep").alias("b")), "doc_id").where("a <> b").select("a", "b").distinct()
    labels = connected(links.union(split))
    by_set = sets_of.join(labels.withColumnRenamed("doc_id", "rep"), "rep", "left").select("w1", "w2", "low", "high", F.coalesce("label", "rep").alias("label"), F.col("label").isNotNull().alias("joined"))
    least = by_set.where("joined").groupBy("label").agg(F.min("low").alias("least"))
    answer = by_set.where("joined").join(least, "label").select("w1", "w2", F.col("least").alias("component"))
    answer = keep(answer.union(by_set.where("not joined and low <> high").select("w1", "w2", "low")), "answer")
    discard(sets, members, named)
    out = light.select("doc_id", "n", "w1", "w2").join(answer, ["w1", "w2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def distinct(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One document of each class stays, the one of the smallest doc_id; columns as they are.

    Of repeated rows of a doc_id one stays, the first by hashes of the text and of all columns; rows without doc_id
    are in no class and all stay.
    """
    judged = keep(classes(docs, k, num, den).where("doc_id is not null"), "judged")
    gone = judged.where("component_id <> doc_id").select("doc_id").distinct()
    again = judged.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("component_id").alias("least")).where("rows > 1")
    once = docs.join(gone.union(again.select("doc_id")), "doc_id", "left_anti")
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), F.xxhash64(*docs.columns))
    first = docs.join(again.where("least = doc_id"), "doc_id", "left_semi").withColumn("_first", F.row_number().over(order)).where("_first = 1").drop("_first")
    return once.select(docs.columns).union(first.select(docs.columns))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
