"""Removal of repeated byte strings by suffix sorting (operator 1).

Suffixes that start at every byte would be compared with a shuffle of several times the text. Instead each
string of ``SIZE`` bytes belongs to its anchor, the smallest ``GRAM``-byte hash among its first ``SPAN`` ones
(the leftmost of equal ones): equal strings have equal anchors at the same distance, so only strings whose
anchors start the same bytes have to be sorted together. Neighbouring strings share an anchor, so there is about
one anchor in ``SPAN / 2`` bytes, and copies of an anchor's whole context count as one.

What is left is sorted in bounded chunks by deep-shallow sorting: multikey quicksort on words of eight
bytes down to ``SHALLOW`` bytes, then blind tries order the groups that still share a prefix: a string is compared
with one leaf only and placed by the length of their common prefix and its next byte. Strings that stay
together over ``SIZE`` bytes are repeated. Classes of more than ``HOT`` anchors are not gathered: their strings
are dealt by a 128-bit hash of the whole string, so equal ones meet and others spread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rolling, keep, mix, prepare, release, rows, slices, table, texts_of, tidily

SIZE, GRAM, SPAN = 400, 24, 160
#: Bytes after an anchor that all of its strings hold.
SURE = SIZE - SPAN + 1
SHALLOW = 32
HOT = 2048
STRETCH = 40
#: Bytes of contexts that are sorted at once, classes being kept whole.
CHUNK = 2_000_000
#: Bytes of a long text that are searched for anchors at once; places within it fit 28 bits.
PIECE = 1 << 24
RID = ["rid_a", "rid_b"]


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    n = len(v) - width + 1
    if n <= 0:
        return v[:0]
    pad = -len(v) % width
    blocks = np.concatenate((v, np.full(pad, v.max(), v.dtype))).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, first start, last start, anchor, class, context) of every anchor; places from the buffer's first byte."""
    n = len(buf)
    lengths = np.diff(offsets)
    begin = np.repeat(offsets[:-1], np.maximum(0, lengths - SIZE + 1))
    if not len(begin):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    owner = np.repeat(np.arange(len(lengths)), np.maximum(0, lengths - SIZE + 1))
    edge = np.concatenate(([True], owner[1:] != owner[:-1]))
    place = np.arange(len(begin))
    start = begin + place - place[edge][np.cumsum(edge) - 1]
    one, two = Rolling(buf, 11), Rolling(buf, 12)
    at = np.arange(n - GRAM + 1)
    keyed = one.spans(at, at + GRAM) >> np.uint64(28) << np.uint64(28) | at.astype(np.uint64)
    least = (sliding_min(keyed, SPAN)[start] & np.uint64((1 << 28) - 1)).astype(np.int64)
    head = np.flatnonzero(edge | np.concatenate(([True], least[1:] != least[:-1])))
    tail = np.append(head[1:], len(start)) - 1
    first, last, anchor = start[head], start[tail], least[head]
    klass = one.spans(anchor, anchor + SURE)
    context = mix(two.spans(first, last + SIZE) + mix(((anchor - first) << 20 | (anchor - last)).astype(np.uint64)) ^ one.spans(first, last + SIZE))
    return owner[head], first, last, anchor, klass, context


def _fresh(labels: np.ndarray) -> np.ndarray:
    """Numbers of the runs of equal labels."""
    return np.cumsum(np.concatenate(([True], labels[1:] != labels[:-1]))) - 1 if len(labels) else labels


def _cuts(seg: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.flatnonzero(seg[1:] != seg[:-1]) + 1, [len(seg)]))


def deep_shallow(buf: np.ndarray, start: np.ndarray, group: np.ndarray, size: int = SIZE, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(rank, repeated) of the ``size`` bytes from each start (a multiple of 8), sorted within each group.

    Equal strings of a group have equal ranks; repeated ones have an equal string beside them in the order.
    """
    rank, repeated = np.zeros(len(start), np.int64), np.zeros(len(start), bool)
    words = np.ndarray((max(0, len(buf) - 7),), np.dtype(">u8"), buffer=np.ascontiguousarray(buf), strides=(1,))
    order = np.argsort(group, kind="stable")
    seg, depth = _fresh(group[order]), np.zeros(len(order), np.int64)
    at = _cuts(seg)[seg]  # where the group of a string begins in the order
    rank[order] = at

    def split(code: np.ndarray) -> np.ndarray:
        """The way to sort the active strings by code; their groups' places follow."""
        nonlocal order, seg, at
        cut = _cuts(seg)
        by = np.argsort(code, kind="stable")
        order, code, begin = order[by], code[by], np.repeat(cut[:-1], np.diff(cut))
        seg = _fresh(code)
        at = at - begin + _cuts(seg)[seg]  # groups stay where they were, so ``begin`` and ``at`` are those of the old group
        rank[order] = at
        return by

    def alone() -> None:
        """Strings that are alone in their group have their place."""
        nonlocal order, seg, depth, at
        more = np.bincount(seg)[seg] > 1 if len(seg) else np.zeros(0, bool)
        order, seg, depth, at = order[more], _fresh(seg[more]), depth[more], at[more]

    later: list[tuple[np.ndarray, ...]] = []
    alone()
    while len(order):  # multikey quicksort: each group around the word of its middle member
        cut = _cuts(seg)
        word = words[start[order] + depth].astype(np.uint64)
        pivot = np.repeat(word[(cut[:-1] + cut[1:]) // 2], np.diff(cut))
        side = np.where(word < pivot, 0, np.where(word == pivot, 1, 2))
        by = split(seg * 3 + side)
        depth = depth[by] + 8 * (side[by] == 1)
        alone()
        deep = depth >= shallow
        if deep.any():
            later.append((order[deep], at[deep]))
            order, seg, depth, at = order[~deep], _fresh(seg[~deep]), depth[~deep], at[~deep]
    if not later:
        return rank, repeated
    order, at = (np.concatenate(x) for x in zip(*later, strict=True))
    by = np.argsort(at, kind="stable")
    order, at = order[by], at[by]
    seg, depth = _fresh(at), np.full(len(order), shallow, np.int64)
    while len(order):  # blind tries: a leaf's path is walked, and the others branch off where they differ from it
        cut = _cuts(seg)
        leaf = np.repeat(cut[:-1], np.diff(cut))
        mine, other = start[order], start[order[leaf]]
        common = depth // 8 * 8  # whole words; those before are known to be equal
        less = np.zeros(len(order), bool)
        live = np.flatnonzero(common < size)
        while len(live):
            a, b = words[mine[live] + common[live]].astype(np.uint64), words[other[live] + common[live]].astype(np.uint64)
            same = a == b
            ends = live[~same]
            x = a[~same] ^ b[~same]
            less[ends] = a[~same] < b[~same]
            for byte in range(1, 8):  # leading bytes that agree
                common[ends] += x >> np.uint64(64 - 8 * byte) == 0
            live = live[same]
            common[live] += 8
            live = live[common[live] < size]
        full = common >= size
        is_leaf = leaf == np.arange(len(order))
        twin = full & ~is_leaf
        repeated[order[twin]] = True
        repeated[order[leaf[twin]]] = True
        # in order: smaller strings, the deeper the nearer to the leaf; the leaf and its equals; greater ones
        place = np.where(full, size, np.where(less, common, 2 * size - common))
        branch = np.where(full, 0, buf[mine + np.minimum(common, size - 1)]).astype(np.int64)
        by = split((seg * (2 * size + 1) + place) * 256 + branch)
        depth = np.minimum(common[by] + 1, size)
        depth[full[by]] = size
        stay = ~full[by]
        order, seg, depth, at = order[stay], _fresh(seg[stay]), depth[stay], at[stay]
        alone()
    return rank, repeated


def pieces(offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bytes before, offsets) of what is searched for anchors at once: some texts, or a piece of a long one.

    Pieces overlap by ``SIZE - 1`` bytes, so every string lies in one of them; its anchor is the same in any piece.
    """
    if len(offsets) > 2 or offsets[-1] - offsets[0] <= PIECE:
        yield 0, offsets
        return
    for low in range(int(offsets[0]), max(int(offsets[0]) + 1, int(offsets[1]) - SIZE + 1), PIECE):
        yield low - int(offsets[0]), np.array([low, min(int(offsets[1]), low + PIECE + SIZE - 1)])


def _anchoring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [*RID, "class", "context", "first", "last", "anchor"]
    for batch in batches:
        rid = [rows(batch, c).to_numpy(zero_copy_only=False) for c in RID]
        buf, offsets = texts_of(rows(batch, "text"))
        for i, j in slices(np.diff(offsets)):
            for low, ends in pieces(offsets[i : j + 1]):
                own = ends - ends[0]
                text, first, last, anchor, klass, context = anchors(buf[ends[0] : ends[-1]], own)
                base = own[text] - low  # of a piece of a text: what lies before it
                cols = [*(r[i + text] for r in rid), klass.view(np.int64), context.view(np.int64), *(x - base for x in (first, last, anchor))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)


def _cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the contexts that a document is asked for."""
    names = [*RID, "class", "n", "copies", "first", "last", "anchor", "bytes"]
    for batch in batches:
        rid = [rows(batch, c).to_pylist() for c in RID]
        texts, asked = rows(batch, "text"), rows(batch, "asked")
        out: list[tuple] = []
        size = 0
        for d in range(batch.num_rows):
            raw = texts[d].as_py().encode("utf-8", "surrogatepass")
            for x in asked[d].as_py():
                out.append((rid[0][d], rid[1][d], x["class"], x["n"], x["copies"], x["first"], x["last"], x["anchor"], raw[x["first"] : x["last"] + SIZE]))
                size += len(out[-1][-1])
            if size > 4_000_000 or d == batch.num_rows - 1:
                cols = list(zip(*out, strict=True)) or [()] * len(names)
                kinds = [pa.int64()] * 8 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)
                out, size = [], 0


def _windows(first: np.ndarray, last: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, start in the buffer) of every string of contexts that lie at ``at``."""
    n = last - first + 1
    owner = np.repeat(np.arange(len(n)), n)
    return owner, at[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)


def _sorting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by class: (rid, start, end) of what is repeated in contexts that have no copies."""
    held: list[pa.RecordBatch] = []

    def solve(part: pa.Table) -> pa.RecordBatch:
        klass, copies, first, last, anchor = (part.column(c).to_numpy() for c in ("class", "copies", "first", "last", "anchor"))
        buf, at = texts_of(part.column("bytes"))
        first, last, anchor = (x.astype(np.int64) for x in (first, last, anchor))
        owner, start = _windows(first, last, at[:-1])
        distance = (anchor - first)[owner] - (start - at[:-1][owner])
        rank = np.cumsum(np.concatenate(([True], klass[1:] != klass[:-1]))) if len(klass) else klass
        _, hit = deep_shallow(buf, start, rank[owner] * SPAN + distance)
        return spans(part, owner[hit], (start - at[:-1][owner] + first[owner])[hit], copies)

    def spans(part: pa.Table, owner: np.ndarray, begin: np.ndarray, copies: np.ndarray) -> pa.RecordBatch:
        low = np.full(len(copies), np.iinfo(np.int64).max)
        high = np.full(len(copies), -1)
        np.minimum.at(low, owner, begin)
        np.maximum.at(high, owner, begin)
        own = np.flatnonzero((high >= 0) & (copies == 1))
        cols = [pa.array(part.column(c).to_numpy()[own]) for c in RID]
        return pa.RecordBatch.from_arrays([*cols, pa.array(low[own], pa.int64()), pa.array(high[own] + SIZE, pa.int64())], [*RID, "begin", "end"])

    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size < CHUNK:
            continue
        whole = pa.Table.from_batches(held)
        klass = whole.column("class").to_numpy()
        stop = int(np.flatnonzero(klass != klass[-1])[-1]) + 1 if klass[0] != klass[-1] else 0
        if stop:
            yield solve(whole.slice(0, stop))
            held = whole.slice(stop).combine_chunks().to_batches()
            size = sum(b.nbytes for b in held)
    if held:
        yield solve(pa.Table.from_batches(held))


def _dealt(part: np.ndarray, start: np.ndarray, size: int | np.ndarray, klass: np.ndarray, distance: np.ndarray) -> list[np.ndarray]:
    """128-bit hashes of strings with their class and distance from the anchor."""
    one, two = (Rolling(part, seed).spans(start, start + size) for seed in (11, 12))
    salt = mix(klass + distance.astype(np.uint64))
    return [mix(one ^ salt).view(np.int64), mix(two + salt).view(np.int64)]


def _coring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each stretch of a context's strings, by distance from the anchor, a hash of what they all share."""
    for batch in batches:
        buf, at = texts_of(rows(batch, "bytes"))
        klass = rows(batch, "class").to_numpy().view(np.uint64)
        rid = [rows(batch, c).to_numpy() for c in RID]
        copies = rows(batch, "copies").to_numpy()
        first, last, anchor = (rows(batch, c).to_numpy().astype(np.int64) for c in ("first", "last", "anchor"))
        low, high = (anchor - last) // STRETCH, (anchor - first) // STRETCH
        owner = np.repeat(np.arange(len(low)), high - low + 1)
        stretch = np.arange(len(owner)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1) + low[owner]
        # strings at distances [d, d + STRETCH) share the bytes from the last start to the first end; a context that
        # holds any of them holds these
        begin = anchor[owner] - stretch * STRETCH - first[owner] + at[owner]
        end = begin + SIZE - STRETCH + 1
        w1, w2 = _dealt(buf, begin, end - begin, klass[owner], stretch)
        cols = [*(r[owner] for r in rid), first[owner], copies[owner], stretch.astype(np.int32), w1, w2]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], [*RID, "first", "copies", "stretch", "w1", "w2"])


def _dealing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each string of the stretches that are left, with a 128-bit hash of its bytes, class and distance."""
    for batch in batches:
        buf, at = texts_of(rows(batch, "bytes"))
        klass = rows(batch, "class").to_numpy().view(np.uint64)
        rid = [rows(batch, c).to_numpy() for c in RID]
        copies = rows(batch, "copies").to_numpy()
        alive = np.zeros((len(klass), SPAN // STRETCH), bool)
        for i, x in enumerate(rows(batch, "alive").to_pylist()):
            alive[i, x] = True
        first, last, anchor = (rows(batch, c).to_numpy().astype(np.int64) for c in ("first", "last", "anchor"))
        for i, j in slices(np.diff(at), CHUNK // 4):
            base = at[i:j] - at[i]
            owner, start = _windows(first[i:j], last[i:j], base)
            begin = start - base[owner] + first[i:j][owner]
            distance = anchor[i:j][owner] - begin
            live = alive[i:j][owner, distance // STRETCH]
            owner, start, begin, distance = owner[live], start[live], begin[live], distance[live]
            w1, w2 = _dealt(buf[at[i] : at[j]], start, SIZE, klass[i:j][owner], distance)
            cols = [*(r[i:j][owner] for r in rid), copies[i:j][owner], begin, w1, w2]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], [*RID, "copies", "begin", "w1", "w2"])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _removing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(rows(batch, "text"), rows(batch, "spans"), strict=True):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            cut = merged([(x["begin"], x["end"]) for x in spans.as_py() or ()])
            left = hashlib.sha256()
            at = 0
            for a, b in [*cut, (len(raw), len(raw))]:
                left.update(raw[at:a])
                at = b
            out.append((len(raw), sum(b - a for a, b in cut), len(cut), left.hexdigest(), cut))
        cols = list(zip(*out, strict=True)) or [()] * 5
        runs = pa.array([[{"begin": a, "end": b} for a, b in x] for x in cols[4]], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))
        arrays = [rows(batch, "doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), runs]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and removed (byte spans) of every document.

    Removed is every byte within a string of ``SIZE`` bytes that also starts anywhere else, in the same
    document or another one; overlaps count. A null text counts as empty; texts shorter than ``SIZE`` bytes
    lose nothing. Repeated rows are documents of their own, so they lose what is long enough in them, all of
    it. A null doc_id is allowed. An empty table gives no rows; other columns of ``docs`` are not read.
    """
    prepare(docs.sparkSession)
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    src = src.withColumns({"rid_a": F.coalesce("doc_id", F.lit(-(1 << 63))), "rid_b": F.xxhash64("text")})
    found = keep(
        src.where(F.octet_length("text") >= SIZE).select(*RID, "text").mapInArrow(tidily(_anchoring), "rid_a bigint, rid_b bigint, class bigint, context bigint, first bigint, last bigint, anchor bigint"),
        "anchors",
    )
    shared = found.groupBy("class").agg(F.count("*").alias("n"), (F.min("context") == F.max("context")).alias("alike")).where("n > 1")
    shared = keep(shared, "classes")
    release(spark)
    members = keep(found.join(shared, "class"), "members")
    release(spark)
    whole = [F.col("first").cast("long").alias("begin"), (F.col("last") + SIZE).cast("long").alias("end")]
    alike = members.where("alike").select(*RID, *whole)

    mixed = members.where("not alike")
    place = F.struct(*RID, "first", "last", "anchor", "n")
    contexts = mixed.groupBy("class", "context").agg(F.count("*").alias("copies"), F.min(place).alias("at"))
    contexts = keep(contexts.select("class", "context", "copies", "at.*"), "contexts")
    copied = mixed.join(contexts.where("copies > 1").select("class", "context"), ["class", "context"], "left_semi").select(*RID, *whole)

    asked = contexts.groupBy(*RID).agg(F.collect_list(F.struct("class", "n", "copies", "first", "last", "anchor")).alias("asked"))
    wanted = src.join(asked, RID).dropDuplicates(RID)
    cut = keep(wanted.select(*RID, "text", "asked").mapInArrow(tidily(_cutting), "rid_a bigint, rid_b bigint, class bigint, n bigint, copies bigint, first bigint, last bigint, anchor bigint, bytes binary"), "cut")
    release(spark)
    sortable = cut.where(F.col("n") <= HOT).repartition("class").sortWithinPartitions("class")
    ordered = sortable.mapInArrow(tidily(_sorting), "rid_a bigint, rid_b bigint, begin bigint, end bigint")
    crowded = cut.where(F.col("n") > HOT)
    cores = crowded.mapInArrow(tidily(_coring), "rid_a bigint, rid_b bigint, first bigint, copies bigint, stretch int, w1 bigint, w2 bigint")
    shared_cores = cores.groupBy("w1", "w2").agg(F.sum("copies").alias("of")).where("of > 1").select("w1", "w2")
    alive = cores.join(shared_cores, ["w1", "w2"]).groupBy(*RID, "first").agg(F.collect_set("stretch").alias("alive"))
    strings = crowded.join(alive, [*RID, "first"]).mapInArrow(tidily(_dealing), "rid_a bigint, rid_b bigint, copies bigint, begin bigint, w1 bigint, w2 bigint")
    twice = strings.groupBy("w1", "w2").agg(F.sum("copies").alias("of")).where("of > 1").select("w1", "w2")
    hot = strings.where("copies = 1").join(twice, ["w1", "w2"]).groupBy(*RID, "begin").agg(F.lit(1)).select(*RID, "begin", (F.col("begin") + SIZE).alias("end"))

    spans = alike.unionByName(copied).unionByName(ordered).unionByName(hot).distinct()  # repeated rows share their spans
    spans = spans.groupBy(*RID).agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    spans = keep(spans, "spans")
    release(spark)
    both = src.join(spans, RID, "left").select("doc_id", "text", "spans")
    return both.mapInArrow(tidily(_removing), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, removed array<struct<begin:bigint,end:bigint>>")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))
