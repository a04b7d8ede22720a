"""Benchmark decontamination by CGK embedding and bit-sampling LSH (operator 8).

Texts and benchmark items are sequences of words (letters and digits, A-Z lowered). A leak is a passage of a
document within ``TOLERANCE`` of an item's words by edit distance. The CGK walk turns edit distance into
Hamming distance: at each of three steps a word it writes the current word down and moves on or stays by a
random bit that depends on the step and the word, so two sequences that differ by few edits fall into step
again. Tables of sampled steps of several walks collide for near sequences; windows as long as the items are
looked up in them, and what collides is verified by an exact edit distance. How many walks items of a length
get follows from ``RECALL``: as many as find that share of simulated leaks at the most edits that are allowed.

Windows that can't hold a leak are skipped first, which loses none: k edits leave at least m - q + 1 - qk of the
m - q + 1 runs of q words of an item whole. q is three, or two where three would leave none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, Rolling, grams, mix, prepare, rows, slices, table, texts_of, tidily, tokens

#: Edits a word of an item; the fewest words of an item that may be edited.
TOLERANCE, MIN_WORDS = 0.2, 5
Q, TABLES, SAMPLED = 3, 9, 4
#: Share of the leaks that the walks over an item are to find, simulated leaks, and the most walks.
RECALL, TRIALS, MOST_WALKS = 0.99, 300, 48
#: Benchmark text that one pass over the documents searches for.
BLOCK_BYTES = 8_000_000
SCHEMA = "doc_id bigint, item_id bigint, n_items int, edits int, item_words int, start_word int, end_word int"
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def characters(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the letters of scripts without spaces: Thai, Lao, Burmese, Khmer, kana and Han, in UTF-8."""
    a, b = buf, np.append(buf[1:], 0).astype(np.uint8)
    three = ((a == 0xE0) & (b >= 0xB8) & (b <= 0xBB)) | ((a == 0xE1) & (((b >= 0x80) & (b <= 0x82)) | (b == 0x9E) | (b == 0x9F))) | ((a == 0xE3) & ((b == 0x81) | (b == 0x82) | (b == 0x83) | (b >= 0x90))) | ((a >= 0xE4) & (a <= 0xE9)) | ((a == 0xEF) & (b >= 0xA4) & (b <= 0xAB))
    four = (a == 0xF0) & (b >= 0xA0) & (b <= 0xB3)
    at = np.flatnonzero(three | four)
    return at, np.minimum(at + np.where(four[at], 4, 3), len(buf))


def words_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each word; a letter of a script without spaces is a word."""
    start, end, text = tokens(buf, offsets, WORD)
    own, past = characters(buf)
    if len(own):  # words are cut before and after each such letter
        more = np.setdiff1d(np.concatenate((own, past)), np.concatenate((start, end)))
        start, end = np.sort(np.concatenate((start, more))), np.sort(np.concatenate((end, more)))
        text = np.searchsorted(offsets, start, side="right") - 1
    return Rolling(LOWER[buf], 8).spans(start, end), text


def cgk(words: np.ndarray, start: np.ndarray, length: np.ndarray | int, size: int, walk: int) -> np.ndarray:
    """The walks over windows of ``length`` words, as long as those over ``size`` words: one row a step."""
    at = np.zeros(len(start), np.int64)
    out = np.zeros((3 * size, len(start)), np.uint64)
    for j in range(3 * size):
        live = at < length
        w = np.where(live, words[start + np.minimum(at, np.maximum(length, 1) - 1)], 0)
        out[j] = w
        at += live & ((mix(w ^ np.uint64((walk * 1_000_003 + j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(40)) & np.uint64(1)).astype(bool)
    return out


def keys_of(steps: np.ndarray, walk: int) -> Iterator[np.ndarray]:
    """The key of each table: a hash of its sampled steps."""
    rng = np.random.default_rng([walk, len(steps)])
    for t in range(TABLES):
        key = np.full(steps.shape[1], t + 1, np.uint64)
        for j in rng.integers(0, len(steps), SAMPLED):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + steps[j])
        yield key


def allowed(m: int) -> int:
    """Edits that are allowed within an item of m words."""
    return int(TOLERANCE * m) if m >= MIN_WORDS else 0


def run_of(m: int) -> int:
    """Words of the runs of which one at least stays whole."""
    return Q if m - Q + 1 > Q * allowed(m) else 2


@lru_cache(maxsize=4096)
def walks_of(m: int) -> int:
    """Walks over items of m words: as many as find ``RECALL`` of simulated leaks with the most edits allowed.

    A leak lies between strange words; a third of the trials each has deletions, insertions and substitutions only.
    Windows begin at most four words from the leak, and one more walk is added for what the simulation doesn't show.
    """
    rng = np.random.default_rng(m)
    k, lead = allowed(m), 4
    items = rng.integers(1, 1 << 62, (TRIALS, m)).astype(np.uint64)
    flat = []
    for t, item in enumerate(items):
        own = item.tolist()
        for _ in range(k):
            x = int(rng.integers(0, len(own)))
            strange = [int(rng.integers(1, 1 << 62))]
            own[x : x + (t % 3 != 1)] = [] if t % 3 == 0 else strange
        around = rng.integers(1, 1 << 62, 2 * (m + lead)).tolist()
        flat.append((around[:lead] + own + around[lead:])[: 2 * m + 2 * lead])
    text = np.array(flat, np.uint64).ravel()
    width = 2 * m + 2 * lead
    missing = np.arange(TRIALS)
    for walk in range(MOST_WALKS):
        sought = list(keys_of(cgk(items[missing].ravel(), np.arange(len(missing)) * m, m, m, walk), walk))
        hit = np.zeros(len(missing), bool)
        for off in range(2 * lead + 1):  # the windows that begin near the leak
            got = keys_of(cgk(text, missing * width + off, m, m, walk), walk)
            for a, b in zip(sought, got, strict=True):
                hit |= a == b
        missing = missing[~hit]
        if len(missing) <= (1 - RECALL) * TRIALS:
            return min(MOST_WALKS, walk + 2)
    return MOST_WALKS


def best_match(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end) of the passage nearest to the item, the first of equal ones."""
    n = len(words)
    cost, origin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    steps = np.arange(n + 1)
    for i, w in enumerate(item, 1):
        diagonal, up = cost[:-1] + (words != w), cost[1:] + 1
        new = np.concatenate(([i], np.minimum(diagonal, up)))
        source = np.concatenate(([0], np.where(diagonal <= up, origin[:-1], origin[1:])))
        low = np.minimum.accumulate(new - steps)  # insertions: from the cheapest place to the left
        lead = np.maximum.accumulate(np.where(new - steps == low, steps, 0))
        cost, origin = low + steps, source[lead]
    end = int(cost.argmin())
    return int(cost[end]), int(origin[end]), end


def item_words(items: tuple[tuple[int, str], ...]) -> list[np.ndarray]:
    raw = [t.encode("utf-8", "surrogatepass") for _, t in items]
    words, text = words_of(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64))
    cut = np.searchsorted(text, np.arange(len(items) + 1))
    return [words[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


class Index:
    """LSH tables of a block of items; items of equal words are one, under the smallest of their ids."""

    def __init__(self, items: tuple[tuple[int, str], ...], walks: dict[int, int]):
        equal: dict[bytes, list[int]] = {}
        for (i, _), w in zip(items, item_words(items), strict=True):
            equal.setdefault(w.tobytes(), []).append(i)
        self.ids, self.copies = [min(own) for own in equal.values()], [len(own) for own in equal.values()]
        self.words, self.walks = [np.frombuffer(w, np.uint64) for w in equal], walks
        self.by_size: dict[int, list[int]] = {}
        for i, w in enumerate(self.words):
            if len(w) >= MIN_WORDS:
                self.by_size.setdefault(len(w), []).append(i)
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for m in range(1, MIN_WORDS):  # found where all their words are, in order
            own = np.array([i for i, w in enumerate(self.words) if len(w) == m], np.int64)
            if len(own):
                key = grams(np.concatenate([self.words[i] for i in own]), np.repeat(np.arange(len(own)), m), m)[0]
                order = np.argsort(key, kind="stable")
                self.short[m] = key[order], own[order]
        self.seeds, self.tables, self.every, self.maybe = {}, {}, {}, {}
        for m, own in self.by_size.items():
            flat = np.concatenate([self.words[i] for i in own])
            start = np.arange(len(own)) * m
            self.seeds[m] = np.unique(grams(flat, np.repeat(np.arange(len(own)), m), run_of(m))[0])
            for walk in range(walks[m]):
                for t, key in enumerate(keys_of(cgk(flat, start, m, m, walk), walk)):
                    order = np.argsort(key, kind="stable")
                    self.tables[m, walk, t] = key[order], np.array(own)[order]
        for q in {run_of(m) for m in self.by_size}:
            self.every[q] = np.unique(np.concatenate([self.seeds[m] for m in self.by_size if run_of(m) == q]))
            self.maybe[q] = np.zeros(1 << 20, bool)  # a first look by 20 bits of the hash
            self.maybe[q][(self.every[q] >> np.uint64(44)).astype(np.int64)] = True

    def search(self, words: np.ndarray, text: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, edits, start, end) of every leak, with words counted from the text's first."""
        return self._exact(words, text) + self._near(words, text)

    def _collide(self, words: np.ndarray, text: np.ndarray, q: int, h: np.ndarray, at: np.ndarray, found: dict[tuple[int, int], list[int]]) -> None:
        """Adds the starts of windows that collide with an item, by text and item. A window ends with its text."""
        for m in self.by_size:
            own = at[np.isin(h, self.seeds[m])] if run_of(m) == q else at[:0]
            need = m - q + 1 - q * allowed(m)
            if len(own) < need:
                continue
            # starts of windows of m words that hold `need` whole runs at least; near a text's end the last m words
            mine = np.repeat(text[own], m - q + 1)
            begin, end = np.searchsorted(text, mine), np.searchsorted(text, mine, side="right")
            first = np.minimum((own[:, None] - np.arange(m - q + 1)).ravel(), end - m)
            first, which = np.unique(np.maximum(first, begin), return_index=True)
            length = np.minimum(end[which] - first, m)  # a text of fewer words is one window
            inside = np.searchsorted(own, first + length - q, side="right") - np.searchsorted(own, first)
            fits = (inside >= need) & (length >= m - allowed(m))
            first, length = first[fits], length[fits]
            for walk in range(self.walks[m] if len(first) else 0):
                for t, key in enumerate(keys_of(cgk(words, first, length, m, walk), walk)):
                    keys, items = self.tables[m, walk, t]
                    a, b = np.searchsorted(keys, key), np.searchsorted(keys, key, side="right")
                    for x in np.flatnonzero(b > a):
                        for i in items[a[x] : b[x]]:
                            found.setdefault((int(text[first[x]]), int(i)), []).append(int(first[x]))

    def _exact(self, words: np.ndarray, text: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        out = []
        for m, (keys, items) in self.short.items():
            h, at = grams(words, text, m)
            seen = np.flatnonzero(np.isin(h, keys))
            pair, first = np.unique(np.stack((text[at[seen]].astype(np.uint64), h[seen])), axis=1, return_index=True)
            for (doc, key), x in zip(pair.T, first, strict=True):
                s = int(at[seen[x]] - np.searchsorted(text, int(doc)))
                out += [(int(doc), int(i), 0, s, s + m) for i in items[np.searchsorted(keys, key) : np.searchsorted(keys, key, side="right")]]
        return out

    def _near(self, words: np.ndarray, text: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        found: dict[tuple[int, int], list[int]] = {}
        for q in self.every:
            h, at = grams(words, text, q)
            hit = np.flatnonzero(self.maybe[q][(h >> np.uint64(44)).astype(np.int64)])
            hit = hit[np.isin(h[hit], self.every[q])]
            if len(hit):
                self._collide(words, text, q, h[hit], at[hit], found)
        out = []
        for (doc, i), starts in found.items():
            low, high = (int(x) for x in np.searchsorted(text, [doc, doc + 1]))
            item = self.words[i]
            m, k = len(item), allowed(len(item))
            starts = sorted(set(starts))
            best, a = None, 0
            for z in range(1, len(starts) + 1):
                if z == len(starts) or starts[z] - starts[z - 1] > m:  # windows that overlap are verified together
                    lo, hi = max(low, starts[a] - m), min(high, starts[z - 1] + 2 * m)
                    edits, s, e = best_match(item, words[lo:hi])
                    if edits <= k and (best is None or edits < best[0]):
                        best = (edits, lo + s - low, lo + e - low)
                    a = z
            if best:
                out.append((doc, i, *best))
        return out


@lru_cache(maxsize=2)
def _index(items: tuple[tuple[int, str], ...], walks: tuple[tuple[int, int], ...]) -> Index:
    return Index(items, dict(walks))


def plan_of(items: tuple[tuple[int, str], ...]) -> tuple[tuple[int, int], ...]:
    """(words, walks) of each length of an item that may be edited; simulated once, on the driver."""
    return tuple((m, walks_of(m)) for m in sorted({len(w) for w in item_words(items)}) if m >= MIN_WORDS)


def blocks_of(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[tuple[int, str], ...]]:
    """The items in blocks of about ``block_bytes``; one empty block if there is none."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    for b in range(blocks):
        yield tuple(sorted(((r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()), key=str))


def leaks(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, n_items, edits, item_words, start_word, end_word: a row for every document and item it holds.

    Items of equal words are one item, under the smallest of their ids (``n_items`` tells how many they are). The
    nearest passage of the document is given, the first of equal ones, in words from 0, end exclusive; it may reach to
    either end of the text, and a text that is shorter than the item by no more words than edits are allowed can be a
    leak as a whole. The benchmark is searched for in blocks of ``block_bytes``, each in its own pass; equal items of
    different blocks are told apart. Null or empty texts and items match nothing; items of fewer than ``MIN_WORDS`` words
    are found where all their words are, in order. Repeated documents are answered each.
    """
    prepare(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for block in blocks_of(benchmark, block_bytes):
        found = src.mapInArrow(tidily(_searcher(block)), SCHEMA)
        out = found if out is None else out.unionAll(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without a leak, columns as they are; documents with null or empty texts stay."""
    prepare(docs.sparkSession)
    for block in blocks_of(benchmark, block_bytes):
        docs = docs.mapInArrow(tidily(_cleaner(block)), docs.schema)
    return docs


def _cleaner(block: tuple[tuple[int, str], ...]):
    walks = plan_of(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(block, walks)
        for batch in batches:
            buf, offsets = texts_of(rows(batch, "text"))
            stays = np.ones(batch.num_rows, bool)
            for i, j in slices(np.diff(offsets)):
                part = buf[offsets[i] : offsets[j]]
                if len(part):
                    words, text = words_of(part, offsets[i : j + 1] - offsets[i])
                    stays[[i + d for d, *_ in index.search(words, text)]] = False
            yield batch.filter(pa.array(stays))

    return run


def _searcher(block: tuple[tuple[int, str], ...]):
    walks = plan_of(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(block, walks)
        for batch in batches:
            ids = rows(batch, "doc_id").to_pylist()
            buf, offsets = texts_of(rows(batch, "text"))
            got = []
            for i, j in slices(np.diff(offsets)):
                part = buf[offsets[i] : offsets[j]]
                if len(part):
                    words, text = words_of(part, offsets[i : j + 1] - offsets[i])
                    got += [(ids[i + d], index.ids[x], index.copies[x], edits, len(index.words[x]), s, e) for d, x, edits, s, e in index.search(words, text)]
            cols = list(zip(*got, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "n_items", "edits", "item_words", "start_word", "end_word"])

    return run


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
