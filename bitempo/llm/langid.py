"""Language identification by cross-parsing entropy (operator 10).

Every language gets a suffix automaton of a bounded sample of labelled text. A document is parsed
greedily against each automaton: a phrase is the longest match, and the next one starts where it broke.
The language that needs the fewest phrases, normalised by the log of its sample's length (the bits of a
phrase), wins. A text is parsed in blocks of ``BLOCK`` letters, so that a batch of documents of any
lengths walks all automata in step as flat numpy arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import prepare, rows, slices, table, tidily

#: Bound of the sample: documents of a language that are read, and characters of them that are kept.
SAMPLE_DOCS, SAMPLE_CHARS = 80, 24_000
BLOCK = 192
#: A document of this many bits more for the second language is counted as certain by half.
TEMPERATURE = 8.0
SCHEMA = "doc_id bigint, lang_pred string, score double"


def suffix_automaton(codes: list[int], width: int) -> np.ndarray:
    """Transitions of the suffix automaton of a text (classes below ``width``): a row a state, -1 for none; state 0 is the root."""
    to = np.full((2 * len(codes) + 2, width), -1, np.int32)
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(link)
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and to[p, c] < 0:
            to[p, c] = new
            p = link[p]
        if p >= 0:
            q = int(to[p, c])
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(link)
                to[clone] = to[q]
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and to[p, c] == q:
                    to[p, c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return to[: len(link)]


def normal(text: str) -> str:
    """Lower case; whatever is between letters becomes one space."""
    return "".join(c if c.isalpha() else " " for c in text.lower())


def squeeze(text: str) -> str:
    return " ".join(normal(text).split())


class CrossParser:
    """The automata of all languages as one dense transition table."""

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        self.langs = [lang for lang, _ in samples]
        letters = sorted({c for _, text in samples for c in text if c != " "})
        self.width = len(letters) + 3  # space, letters, a letter never seen, padding
        self.other, self.pad = self.width - 2, self.width - 1
        self.code = np.zeros(0x110000, np.int32)
        self.code[[i for i in range(0x110000) if chr(i).isalpha()]] = self.other
        for i, c in enumerate(letters):
            self.code[ord(c)] = i + 1
        tables, self.root, base = [], [], 1  # state 0 stands for "no transition"
        for _, text in samples:
            t = suffix_automaton([0 if c == " " else int(self.code[ord(c)]) for c in text], self.width) + np.int32(base)
            t[t < base] = 0
            t[:, self.pad] = base + np.arange(len(t))
            self.root.append(base)
            base += len(t)
            tables.append(t)
        self.table = np.concatenate([np.zeros((1, self.width), np.int32), *tables]).ravel()
        self.bits = np.array([np.log2(max(2, len(text))) for _, text in samples])

    def letters(self, text: str) -> np.ndarray:
        """Classes of a text's letters, with one 0 for whatever is between them."""
        codes = self.code[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = codes != 0
        keep[1:] |= codes[:-1] != 0
        return codes[keep]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases of each text in each language, whether the text has a letter)."""
        codes = [self.letters(t) for t in texts]
        has = np.array([bool((c != 0).any()) for c in codes], bool)
        blocks = [-(-len(c) // BLOCK) if h else 0 for c, h in zip(codes, has, strict=True)]
        owner = np.repeat(np.arange(len(texts)), blocks)
        lanes = np.full((len(owner), BLOCK), self.pad, np.int32)
        flat, at = lanes.ravel(), 0
        for c, k in zip(codes, blocks, strict=True):
            if k:
                flat[at : at + len(c)] = c
                at += k * BLOCK
        steps = np.ascontiguousarray(lanes.T)
        out = np.zeros((len(texts), len(self.langs)))
        for lang, root in enumerate(self.root):
            state = np.full(len(owner), root, np.int32)
            start = self.table[root * self.width : (root + 1) * self.width].copy()
            start[start == 0] = root  # a letter that the sample lacks is a phrase of its own
            start[self.pad] = root
            count = np.ones(len(owner), np.int32)
            for c in steps:
                state = self.table.take(state * self.width + c)
                broke = np.flatnonzero(state == 0)
                count[broke] += 1
                state[broke] = start[c[broke]]
            out[:, lang] = np.bincount(owner, count, len(texts))
        return out, has

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        counts, has = self.phrases(texts)
        bits = counts * self.bits
        best = bits.argmin(1)
        gap = np.minimum(60.0, (bits - bits.min(1, keepdims=True)) / TEMPERATURE)
        score = np.where(has, 1 / np.exp(-gap).sum(1), 0.0)
        return [self.langs[b] if h else "und" for b, h in zip(best, has, strict=True)], score


@lru_cache(maxsize=1)
def _parser(samples: tuple[tuple[str, str], ...]) -> CrossParser:
    return CrossParser(samples)


def learn(docs: DataFrame, *, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> tuple[tuple[str, str], ...]:
    """(language, sample) of each label of the documents outside the held-out fold, in order of the label.

    The sample of a label: at most ``sample_docs`` documents, by a hash of doc_id, cut at ``sample_chars``.
    """
    own = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (_fold() != 0))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = own.select("lang", "doc_id").withColumn("k", F.row_number().over(first)).where(F.col("k") <= sample_docs).collect()
    if not chosen:
        return ()
    read = own.where(F.col("doc_id").isin([r.doc_id for r in chosen])).groupBy("lang", "doc_id").agg(F.min(F.substring("text", 1, sample_chars)).alias("text"))
    texts = {(r.lang, r.doc_id): r.text for r in read.collect()}
    out: dict[str, list[str]] = {}
    for r in sorted(chosen, key=lambda r: r.k):
        out.setdefault(r.lang, []).append(squeeze(texts[r.lang, r.doc_id]))
    joined = {lang: " ".join(dict.fromkeys(own))[:sample_chars] for lang, own in out.items()}
    return tuple((lang, text) for lang, text in sorted(joined.items()) if text.strip())


def _fold() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5


def identify(docs: DataFrame, samples: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document.

    A null, empty or letterless text gives ``und`` with score 0, as do all documents where nothing is
    labelled. Equal texts get equal answers; a tie goes to the first language by name; a null doc_id is in
    no fold (held_out null). Other columns of ``docs`` are not read, repeated rows are answered each.
    """
    prepare(docs.sparkSession)
    samples = learn(docs) if samples is None else samples

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(samples) if samples else None
        for batch in batches:
            ids, texts = rows(batch, "doc_id"), rows(batch, "text")
            lengths = np.array([len(t) if t else 0 for t in texts.to_pylist()], np.int64)
            for i, j in slices(lengths + 64, 1 << 20):
                part = [t or "" for t in texts.slice(i, j - i).to_pylist()]
                lang, score = parser.predict(part) if parser else (["und"] * len(part), np.zeros(len(part)))
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidily(run), SCHEMA)
    return out.select("doc_id", (_fold() == 0).alias("held_out"), "lang_pred", "score")


#: A document whose best language is less likely than this is in none of them.
LEAST_SCORE = 0.3


def keep_known(docs: DataFrame, samples: tuple[tuple[str, str], ...] | None = None, least: float = LEAST_SCORE) -> DataFrame:
    """The documents in one of the learned languages; a null ``lang`` takes the predicted one.

    A document goes if its text is null or has no letter, or if no language stands out (score below
    ``least``). Where nothing is labelled no document can be told, and all with a letter stay. Columns
    pass through as they are.
    """
    prepare(docs.sparkSession)
    samples = learn(docs) if samples is None else samples
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(samples) if samples else None
        for batch in batches:
            texts = [t or "" for t in rows(batch, "text").to_pylist()]
            for i, j in slices(np.array([len(t) + 64 for t in texts], np.int64), 1 << 20):
                part = texts[i:j]
                if parser:
                    langs, score = parser.predict(part)
                    stays = [p != "und" and s >= least for p, s in zip(langs, score, strict=True)]
                else:
                    langs, stays = [None] * len(part), [any(c.isalpha() for c in t) for t in part]
                out = batch.slice(i, j - i)
                if "lang" in names and parser:
                    at = names.index("lang")
                    out = out.set_column(at, out.schema.field(at), pa.array([a if a is not None else b for a, b in zip(out.column(at).to_pylist(), langs, strict=True)], out.schema.field(at).type))
                yield out.filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(tidily(run), docs.schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
