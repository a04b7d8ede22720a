"""Personal data by weak supervision (operator 3).

Four base kinds are found by their definitions (``base_spans``). Further candidates come from wide patterns;
labelers vote on each: strict patterns, checksums, gazetteers, words of the context. Expectation-maximisation
over the counts of vote patterns estimates how reliable each labeler is, and with it how likely a candidate
is personal data; a logistic span classifier is trained on these soft labels and decides. Vote patterns are
counted over all documents; their number has a bound that does not depend on the input (``MOST_PATTERNS``).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, rows, table, tidily

BASE = ("email", "ip", "card", "phone")
ADDED = ("obfuscated_email", "local_phone", "ssn", "iban", "ip6", "mac", "secret", "name")
KINDS = (*BASE, *ADDED)
RANK = {k: i for i, k in enumerate(KINDS)}
LABELERS = ("strict", "checksum", "gazetteer", "context", "against", "shape")
#: Votes are -1, 0 or 1; a pattern also has the kind and a bin of the length.
MOST_PATTERNS = len(KINDS) * 3 ** len(LABELERS) * 4
ROUNDS, THRESHOLD = 30, 0.5

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_DIGITS = str.maketrans("", "", " -().+")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(c)] for c in digits[-2::-2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, by their @: a match has one only, and starts as far left of it as it can."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        start = free + len(before.rstrip(_LOCAL))
        free = at  # no local part reaches beyond an @
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(free, at + 1))
    return out


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base kinds, by start, then kind as listed."""
    out = [(s, "email", e) for s, e in emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append((m.start(), "ip", m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := m[0].translate(_DIGITS)) <= 19 and luhn(d):
                out.append((m.start(), "card", m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(m[0].translate(_DIGITS)) <= 15:
                    out.append((m.start(), "phone", m.end()))
    return sorted(out, key=lambda x: (x[0], RANK[x[1]]))


# --- candidates -------------------------------------------------------------------------------------------

_AT = re.compile(r" ?[\[({] ?(?:at|AT) ?[\])}] ?")
_DOTTED = re.compile(r"[A-Za-z0-9-]++(?: ?[\[({] ?(?:dot|DOT) ?[\])}] ?[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)++")
_LOCAL_PHONE = re.compile(r"(?<![0-9+])(?<![0-9][.-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])(?![.-][0-9])")
_SSN = re.compile(r"(?<![0-9])(?<![0-9]-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])(?!-[0-9])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_IP6 = re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])")
_MAC = re.compile(r"(?<![0-9A-Fa-f:-])[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:-])")
_SECRET = re.compile(r"""[:=] ?["']?([A-Za-z0-9_+/.-]{16,}+)""")
_TITLES = "Mr Mrs Ms Dr Prof Herr Frau Mme Mlle Sr Sra Señor Señora Monsieur Madame".split()
_TITLED = re.compile(rf"(?<!\w)(?:{'|'.join(_TITLES)})\.? [A-ZÀ-Ý][a-zà-ÿ]+(?: [A-ZÀ-Ý][a-zà-ÿ]+)?")
FIRST_NAMES = frozenset(
    "Alice Anna Anne Antonio Barbara Carlos Carmen Charles Christine Claire Claudia David Elena Elizabeth Emily Emma Eva Fernando Francisco Hans Helen Isabel James Jane Javier Jean Jennifer John José Juan Julia Karl Klaus Laura Linda Lucia Luis Manuel Maria Marie Martin Mary Michael Michel Miguel Nicolas Olivia Pablo Patricia Paul Pedro Peter Philippe Pierre Robert Rosa Sarah Sophie Stefan Susan Thomas Ursula Werner William Wolfgang".split()
)
_FIRST = re.compile(rf"(?<!\w)(?:{'|'.join(sorted(FIRST_NAMES))}) [A-ZÀ-Ý][a-zà-ÿ]+(?!\w)")
TOP_LEVEL = frozenset("com org net edu gov mil int info io co uk de fr es it nl eu us ca au ch at be pt pl".split())
_FOR = re.compile(r"\b(?:e-?mail|mail|contact|phone|tel|telephone|call|mobile|cell|fax|ssn|social security|iban|account|konto|cuenta|compte|mac|address|host|server|token|secret|password|passwd|pwd|api[ _-]?key|key|credential|auth|bearer|name|card|visa|credit|teléfono|téléphone|telefon|correo)\W{0,4}\w{0,12}\W{0,4}$", re.I)
_AGAINST = re.compile(r"\b(?:version|v|isbn|issn|order|invoice|page|pages|figure|fig|table|section|chapter|build|release|serial|sku|item|lot|ratio|score|sha|commit|revision|checksum|digest|hash)\W{0,4}$", re.I)


def obfuscated(text: str) -> list[tuple[int, int]]:
    """Addresses with a bracketed "at", by that word: a local part of any length before it, a domain after it."""
    out, free = [], 0
    for m in _AT.finditer(text):
        start = free + len(text[free : m.start()].rstrip(_LOCAL))
        free = m.start()
        if start < m.start() and (d := _DOTTED.match(text, m.end())):
            out.append((start, d.end()))
            free = d.end()
    return out


def candidates(text: str) -> list[tuple[int, str, int]]:
    out = []
    found = lambda kind, pattern, group=0: out.extend((m.start(group), kind, m.end(group)) for m in pattern.finditer(text))
    if "at" in text or "AT" in text:
        if "[" in text or "(" in text or "{" in text:
            out += [(s, "obfuscated_email", e) for s, e in obfuscated(text)]
    if _DIGIT.search(text):
        for kind, pattern in (("local_phone", _LOCAL_PHONE), ("ssn", _SSN), ("iban", _IBAN)):
            found(kind, pattern)
        if ":" in text or "-" in text:
            found("ip6", _IP6)
            found("mac", _MAC)
    if ":" in text or "=" in text:
        found("secret", _SECRET, 1)
    found("name", _TITLED)
    found("name", _FIRST)
    return sorted(set(out))


def _iban(value: str) -> bool:
    value = value.replace(" ", "")
    return 15 <= len(value) <= 34 and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _entropy(value: str) -> float:
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values())


def votes(text: str, start: int, kind: str, end: int) -> tuple[int, ...]:
    """The labelers' votes for a candidate, in the order of LABELERS: 1 personal, -1 not, 0 no opinion."""
    value, before = text[start:end], text[max(0, start - 40) : start]
    digits = value.translate(_DIGITS)
    strict = checksum = gazetteer = shape = 0
    if kind in ("email", "obfuscated_email"):
        strict = 1 if re.fullmatch(r"[A-Za-z0-9].*[A-Za-z]", value, re.S) else -1
        gazetteer = 1 if re.split(r"[^A-Za-z]+", value)[-1].lower() in TOP_LEVEL else -1
    elif kind in ("phone", "local_phone"):
        strict = 1 if re.search(r"[ ().-]", value) else 0
        gazetteer = 1 if kind == "phone" or digits[0] not in "01" and digits[3] not in "01" else -1
        shape = -1 if len(set(digits)) <= 2 else 1
    elif kind == "card":
        strict = checksum = 1
        gazetteer = 1 if digits[0] in "3456" else -1
        shape = -1 if len(set(digits)) <= 2 else 1
    elif kind == "ip":
        strict = 1 if all(p == "0" or p[0] != "0" for p in value.split(".")) else -1
        shape = -1 if value.split(".")[0] == "0" else 1
    elif kind == "ssn":
        checksum = 1 if value[:3] not in ("000", "666") and value[0] != "9" and value[4:6] != "00" and value[7:] != "0000" else -1
        shape = -1 if len(set(digits)) <= 2 else 1
    elif kind == "iban":
        checksum = 1 if _iban(value) else -1
        shape = 1 if any(c.isdigit() for c in value[4:]) else -1
    elif kind in ("mac", "ip6"):
        strict = 1
        shape = 1 if len(set(value)) > 4 else -1
    elif kind == "secret":
        strict = 1 if re.search(r"[0-9]", value) and re.search(r"[A-Za-z]", value) else -1
        shape = 1 if _entropy(value) >= 3.2 and "/" not in value[:2] and ".." not in value else -1
    else:
        strict = 1 if value.split(" ")[0].rstrip(".") in _TITLES else 0
        gazetteer = 1 if not FIRST_NAMES.isdisjoint(value.split(" ")) else -1
    context = 1 if _FOR.search(before) else (-1 if kind == "secret" else 0)
    against = -1 if _AGAINST.search(before) else 0
    return strict, checksum, gazetteer, context, against, shape


def pattern_of(text: str, start: int, kind: str, end: int) -> str:
    """Kind, bin of the length, and votes."""
    return "|".join((kind, str(min(3, (end - start) // 12)), *map(str, votes(text, start, kind, end))))


def expect(counts: dict[str, int], rounds: int = ROUNDS) -> dict[str, float]:
    """How likely a candidate of each pattern is personal data: expectation-maximisation.

    Labelers vote independently given the truth; a labeler's chances of each vote are shared by all kinds,
    the share of personal data among candidates is each kind's own. Starts from the votes' majority.
    """
    cases = [(k.split("|")[0], tuple(map(int, k.split("|")[2:])), n, k) for k, n in sorted(counts.items())]
    soft = [1 / (1 + math.exp(-1.5 * sum(v))) for _, v, _, _ in cases]
    for _ in range(rounds):
        prior: dict[str, list[float]] = {}
        chance = [[{-1: 1.0, 0: 1.0, 1: 1.0} for _ in LABELERS] for _ in range(2)]
        for (kind, v, n, _), p in zip(cases, soft, strict=True):
            at = prior.setdefault(kind, [1.0, 1.0])
            for truth, w in ((0, n * (1 - p)), (1, n * p)):
                at[truth] += w
                for labeler, vote in enumerate(v):
                    chance[truth][labeler][vote] += w
        # A labeler is taken to be no worse than chance: its vote for never speaks against.
        soft = []
        for kind, v, _, _ in cases:
            z = math.log(prior[kind][1] / prior[kind][0])
            for labeler, vote in enumerate(v):
                share = [chance[t][labeler][vote] / sum(chance[t][labeler].values()) for t in range(2)]
                step = math.log(share[1] / share[0])
                z += max(0.0, step) if vote > 0 else min(0.0, step) if vote < 0 else 0.0
            soft.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
    return {k: p for (_, _, _, k), p in zip(cases, soft, strict=True)}


def features(pattern: str) -> dict[str, float]:
    kind, size, *v = pattern.split("|")
    out = {"bias": 1.0, f"kind={kind}": 1.0, f"size={size}": 1.0}
    for name, vote in zip(LABELERS, map(int, v), strict=True):
        if vote:
            out[f"{name}{vote:+d}"] = 1.0
    return out


def train(counts: dict[str, int], rounds: int = 300, rate: float = 0.5, penalty: float = 0.01) -> dict[str, float]:
    """Weights of the span classifier: logistic regression on the soft labels, patterns weighted by log counts."""
    soft = expect(counts)
    cases = [(features(k), soft[k], math.log1p(n)) for k, n in sorted(counts.items())]
    total = sum(w for _, _, w in cases) or 1.0
    weights: dict[str, float] = {}
    for _ in range(rounds):
        slope: dict[str, float] = {}
        for x, y, w in cases:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights.get(f, 0.0) for f in x)))))
            for f in x:
                slope[f] = slope.get(f, 0.0) + w * (y - p)
        for f, g in slope.items():
            weights[f] = weights.get(f, 0.0) + rate * (8 * g / total - penalty * weights.get(f, 0.0))
    return {f: round(w, 9) for f, w in weights.items()}


def accepts(weights: dict[str, float], pattern: str) -> bool:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights.get(f, 0.0) for f in features(pattern)))))) >= THRESHOLD


def added(text: str, base: list[tuple[int, str, int]]) -> Iterator[tuple[int, str, int]]:
    """The candidates that overlap no base span."""
    taken, at = [(s, e) for s, _, e in base], 0
    for s, kind, e in candidates(text):
        while at < len(taken) and taken[at][1] <= s:
            at += 1
        z = at
        while z < len(taken) and taken[z][0] < e and taken[z][1] <= s:
            z += 1
        if z == len(taken) or taken[z][0] >= e:
            yield s, kind, e


def learn(docs: DataFrame) -> dict[str, float]:
    """The span classifier's weights from the vote patterns of all documents."""
    prepare(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for x in rows(batch, "text"):
                if text := x.as_py():
                    base = base_spans(text)
                    seen.update(pattern_of(text, *c) for c in (*base, *added(text, base)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["pattern", "n"])

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(tidily(count), "pattern string, n bigint")
    return train({r.pattern: r.n for r in counted.groupBy("pattern").agg(F.sum("n").alias("n")).collect()})


def spans_of(text: str, weights: dict[str, float], known: dict[str, bool]) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """(base spans, all spans). An added span overlaps neither a base one nor one added before it."""
    base = base_spans(text)
    out, end = [], -1
    for s, kind, e in added(text, base):
        if s < end:
            continue
        pattern = pattern_of(text, s, kind, e)
        if pattern not in known:
            known[pattern] = accepts(weights, pattern)
        if known[pattern]:
            out.append((s, kind, e))
            end = e
    return base, sorted(base + out, key=lambda x: (x[0], RANK[x[1]], x[2]))


def show(spans: list[tuple[int, str, int]]) -> str:
    return ",".join([f"{k}:{s}:{e}" for s, k, e in spans])


def find(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every document; spans in code points.

    A null or empty text has no spans (the digest of an empty string). Repeated rows are answered each; other
    columns of ``docs`` are not read.
    """
    weights = learn(docs) if weights is None else weights
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}
        for batch in batches:
            counts: list[list[int]] = [[] for _ in BASE]
            digest, every = [], []
            for x in rows(batch, "text"):
                base, spans = spans_of(x.as_py() or "", weights, known)
                for kind, out in zip(BASE, counts, strict=True):
                    out.append(sum(k == kind for _, k, _ in base))
                digest.append(hashlib.sha256(show(base).encode()).hexdigest())
                every.append(show(spans))
            cols = [rows(batch, "doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array(every, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(tidily(run), "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def mask_text(text: str, spans: list[tuple[int, str, int]]) -> str:
    """The text with every span, or run of spans that overlap, replaced by the first one's kind in brackets."""
    out, at, i = [], 0, 0
    while i < len(spans):
        s, kind, e = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] < e:
            i += 1
            e = max(e, spans[i][2])
        out += [text[at:s], f"[{kind.upper()}]"]
        at, i = e, i + 1
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The documents with masked texts; ``n_chars``, where there is such a column, follows the text.

    A null text stays null, an empty one empty. Every row stays, repeated ones too, and equal texts are masked alike;
    an empty table gives no rows. Other columns pass through as they are.
    """
    weights = learn(docs) if weights is None else weights
    prepare(docs.sparkSession)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}
        for batch in batches:
            texts = [None if (t := x.as_py()) is None else mask_text(t, spans_of(t, weights, known)[1]) for x in rows(batch, "text")]
            cols = {n: rows(batch, n) for n in names} | {"text": pa.array(texts, pa.string())}
            if "n_chars" in names:
                cols["n_chars"] = pa.array([None if t is None else len(t) for t in texts], rows(batch, "n_chars").type)
            yield pa.RecordBatch.from_arrays([cols[n] for n in names], names)

    return docs.mapInArrow(tidily(run), docs.schema)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
