"""SentencePiece encoding and decoding by vectorised merge rounds (operator 7).

A text is normalised as the model says (space to U+2581, one dummy space in front) and cut into words, a
run of U+2581 and what follows: no piece spans a cut, which ``Pieces`` checks, so words merge on their own.
The symbols of all words not met before lie in one flat numpy array. A round looks up the rank of each
adjacent pair, takes the minimum of each word by segments, merges that pair at its leftmost place in every
word at once, and compacts the array; rounds go on until no pair is left. Where no better-ranked piece
could arise from the merged one, all of a word's leftmost non-overlapping places of the pair merge in one
round, which gives what merging them one by one gives. Long words are cut further, wherever no occurrence of a
piece spans two characters, since nothing can merge there.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, rows, slices, table, tidily

SPACE = "▁"
MODEL = "piece_bpe_32k.model"
#: Words that a Python worker remembers.
CACHE_WORDS = 200_000
#: Characters from which a word is cut where no piece can span.
LONG_WORD = 48
NONE = np.iinfo(np.int32).max
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Pieces:
    """A BPE model: encoding and decoding of words."""

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.eos, self.unk = sp.eos_id(), sp.unk_id()
        names = [sp.id_to_piece(i) for i in range(n)]
        if any(sp.is_unused(i) for i in range(n)):
            raise ValueError("models with unused pieces are not supported")
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(n)]
        self.byte = {int(names[i][1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.value = {i: b for b, i in self.byte.items()}
        normal = {names[i]: i for i in range(n) if not special[i]}
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("a piece goes on after a word's end; words can't be encoded on their own")
        self.text = {i: p.replace(SPACE, " ") for p, i in normal.items()}
        # Symbols: pieces by their ids, then characters that only occur inside pieces.
        self.symbol = dict(normal)
        for c in sorted({c for p in normal for c in p} - set(normal)):
            self.symbol[c] = n + len(self.symbol)
        self.size, self.inner = n, {i: c for c, i in self.symbol.items() if i >= n}
        self.code = np.full(0x110000, -1, np.int32)
        for p, i in self.symbol.items():
            if len(p) == 1:
                self.code[ord(p)] = i
        levels = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in normal.values()}, reverse=True))}
        rank = {p: levels[sp.get_score(i)] for p, i in normal.items()}
        keys, made, ranks = [], [], []
        unsafe = set()
        for p, i in normal.items():
            for k in range(1, len(p)):
                a, b = self.symbol.get(p[:k]), self.symbol.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    made.append(i)
                    ranks.append(rank[p])
                    unsafe |= {x for x in (p[:k], p[k:]) if x in rank and rank[p] <= rank[x]}
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.made, self.ranks = (np.array(x, t)[order] for x, t in ((keys, np.int64), (made, np.int32), (ranks, np.int32)))
        self.safe = np.ones(n + 1, bool)
        self.safe[[normal[x] for x in unsafe]] = False
        self.name = [str(i) for i in range(n)]
        by_length: dict[int, list[int]] = {}
        for p in normal:
            h = 0
            for c in p:
                h = (h * int(_BASE) + ord(c)) & (1 << 64) - 1
            by_length.setdefault(len(p), []).append(h)
        self.hashes = {k: np.unique(np.array(v, np.uint64)) for k, v in by_length.items()}
        self.known: dict[str, tuple[int, str, str]] = {}

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged piece) of adjacent symbols; NONE where they don't merge."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], NONE), np.where(hit, self.made[at], -1)

    def merge(self, words: list[str]) -> list[list[int]]:
        """Ids of each word's pieces, by merge rounds over all words at once."""
        text = "".join(words)
        sym = self.code[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        strange = np.flatnonzero(sym < 0)
        sym[strange] = -1 - strange  # below 0: a character, by its place
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        last = np.ones(len(sym), bool)
        last[:-1] = word[1:] != word[:-1]
        rank = np.full(len(sym), NONE, np.int32)
        made = np.full(len(sym), -1, np.int32)
        rank[:-1], made[:-1] = self._pairs(sym[:-1], sym[1:])
        rank[last] = NONE
        out: list[list[int]] = [[]] * len(words)
        while len(sym):
            starts = np.flatnonzero(np.concatenate(([True], last[:-1])))
            sizes = np.diff(np.append(starts, len(sym)))
            least = np.minimum.reduceat(rank, starts)
            done = least == NONE
            if done.any():  # compaction: finished words leave
                gone = np.repeat(done, sizes)
                own = sym[gone]
                odd = np.flatnonzero((own < 0) | (own >= self.size))
                flat, at, strange = own.tolist(), 0, set(odd.tolist())
                for w, k in zip(word[starts[done]].tolist(), sizes[done].tolist(), strict=True):
                    got = flat[at : at + k]
                    if strange and not strange.isdisjoint(range(at, at + k)):
                        got = [i for s in got for i in self._ids(s, text)]
                    out[w] = got
                    at += k
                sym, word, rank, made, last = (x[~gone] for x in (sym, word, rank, made, last))
                if not len(sym):
                    break
                starts = np.flatnonzero(np.concatenate(([True], last[:-1])))
                sizes, least = sizes[~done], least[~done]
            at = np.flatnonzero(rank == np.repeat(least, sizes))
            first = np.ones(len(at), bool)
            first[1:] = word[at[1:]] != word[at[:-1]]
            lead = at[first][np.cumsum(first) - 1]  # each place's leftmost one in its word
            same = (made[at] == made[lead]) & (sym[at] == sym[lead])
            at, first = at[same], first[same]
            touching = np.zeros(len(at), bool)
            touching[1:] = at[1:] == at[:-1] + 1
            begin = np.maximum.accumulate(np.where(touching, 0, np.arange(len(at))))
            odd = (np.arange(len(at)) - begin) % 2 == 1  # xx x: the second place overlaps the first
            at = at[first | (self.safe[made[at]] & ~odd)]
            sym[at] = made[at]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            last[at] = last[at + 1]
            place = (np.cumsum(stay) - 1)[at]
            sym, word, rank, made, last = (x[stay] for x in (sym, word, rank, made, last))
            new = np.zeros(len(sym) + 1, bool)  # only pairs beside a merged one are new
            new[place] = new[place - 1] = True
            fresh = np.flatnonzero(new[: len(sym) - 1] & ~last[:-1])
            rank[place] = NONE
            rank[fresh], made[fresh] = self._pairs(sym[fresh], sym[fresh + 1])
        return out

    def _ids(self, s: int, text: str) -> list[int]:
        if 0 <= s < self.size:
            return [s]
        c = text[-1 - s] if s < 0 else self.inner[s]
        return [self.byte[b] for b in c.encode("utf-8", "surrogatepass")] if self.byte else [self.unk]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the dummy space; bytes that are no UTF-8 become U+FFFD."""
        try:
            return "".join([self.text[i] for i in ids])
        except KeyError:
            pass
        out: list[str] = []
        raw = bytearray()
        for i in [*ids, -1]:
            if i in self.value:
                raw.append(self.value[i])
                continue
            if raw:
                out.append(_utf8(bytes(raw)))
                raw.clear()
            out.append(self.text.get(i, ""))
        return "".join(out)

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
            new = list(words)
        name = self.name
        for w, ids in zip(new, self.merge(new), strict=True):
            self.known[w] = (len(ids), " ".join([name[i] for i in ids]), self.decode(ids))

    def parts(self, word: str) -> list[str]:
        """A word, cut wherever no piece that occurs in it spans."""
        chars = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        spans = np.zeros(len(chars) + 1, np.int64)
        h = chars
        for k in range(2, min(len(chars), max(self.hashes)) + 1):
            h = h[: len(chars) - k + 1] * _BASE + chars[k - 1 :]
            if k in self.hashes:
                own = self.hashes[k]
                at = np.flatnonzero(own[np.minimum(np.searchsorted(own, h), len(own) - 1)] == h)
                np.add.at(spans, at + 1, 1)
                np.add.at(spans, at + k, -1)
        cut = [0, *(np.flatnonzero(np.cumsum(spans)[1:-1] == 0) + 1).tolist(), len(chars)]
        return [word[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def words(self, text: str) -> list[str]:
        own = _WORD.findall(SPACE + text.replace(" ", SPACE)) if text else []
        if max(map(len, own), default=0) < LONG_WORD:
            return own
        return [p for w in own for p in (self.parts(w) if len(w) >= LONG_WORD else (w,))]

    def encode(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(tokens, ids in decimal joined by spaces with the end id, decoded text) of each text."""
        cut = [self.words(t) for t in texts]
        self.learn({w for ws in cut for w in ws})
        out = []
        for ws in cut:
            n, ids, decoded = zip(*[self.known[w] for w in ws], strict=True) if ws else ((), (), ())
            out.append((sum(n) + 1, " ".join((*ids, str(self.eos))), "".join(decoded)[1:]))
        return out


def _utf8(raw: bytes) -> str:
    """One U+FFFD for each byte that begins no whole character."""
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


@lru_cache(maxsize=2)
def load(model_file: str) -> Pieces:
    return Pieces(model_file)


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by spaces, the end id last), decoded, of every document.

    A null or empty text has the end id alone and decodes to an empty text. Characters outside the
    vocabulary become bytes. Repeated rows are answered each; other columns of ``docs`` are not read.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model_file or model_path())
        for batch in batches:
            ids, texts = rows(batch, "doc_id"), rows(batch, "text")
            lengths = np.asarray(pa.compute.fill_null(pa.compute.utf8_length(texts), 0).to_numpy(zero_copy_only=False), np.int64)
            for i, j in slices(lengths + 64, 1 << 20):
                got = pieces.encode([t or "" for t in texts.slice(i, j - i).to_pylist()])
                n, coded, decoded = zip(*got, strict=True)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])
        pieces.known.clear()

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(tidily(run), "doc_id bigint, n_tokens bigint, ids string, decoded string")


def digests(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """What ``encode`` gives, with SHA-256 digests in place of ids and text, taken in the worker."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model_file or model_path())
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            ids, texts = rows(batch, "doc_id"), rows(batch, "text")
            lengths = np.asarray(pa.compute.fill_null(pa.compute.utf8_length(texts), 0).to_numpy(zero_copy_only=False), np.int64)
            for i, j in slices(lengths + 64, 1 << 20):
                got = pieces.encode([t or "" for t in texts.slice(i, j - i).to_pylist()])
                cols = [pa.array([x[0] for x in got], pa.int64()), *(pa.array([sha(x[k]) for x in got], pa.string()) for k in (1, 2))]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), *cols], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        pieces.known.clear()

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(tidily(run), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
