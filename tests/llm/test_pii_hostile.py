import random
import time

from pyspark.sql import functions as F

from bitempo.llm import pii


def test_long_numbers_and_tokens(docs):
    key = "ab1" * 300
    rows = [(1, "0" * 5000 + "1.1.1.1"), (2, "1" * 5000 + ".1.1.1"), (3, f"token: {key}"), (4, "x" * 300 + " [at] host [dot] org"), (5, None), (6, ""), (6, "")]
    got = {r.doc_id: r for r in pii.find(docs(rows)).collect()}
    assert (got[1].n_ip, got[2].n_ip) == (1, 0) and f"ip:0:{5000 + 7}" in got[1].spans
    spans = [(4, "obfuscated_email", 0), (3, "secret", 7)]
    for i, kind, start in spans:
        assert (start, kind) in {c[:2] for c in pii.candidates(dict(rows)[i])}
    assert pii.candidates(dict(rows)[3])[0][2] == len(dict(rows)[3])
    masked = pii.mask(docs(rows)).select("doc_id", "text", F.length("text").alias("n"), F.col("n_chars").alias("same")).collect()
    assert len(masked) == len(rows) and all(r.n == r.same for r in masked if r.text is not None) and sum(r.text is None for r in masked) == 1
    assert pii.mask(docs([])).count() == pii.find(docs([])).count() == 0


def test_long_texts_take_linear_time():
    for unit in ("a", "a@", "1.", "a [at] ", "key=", "12 ", ":", "+1 "):
        began = time.perf_counter()
        pii.spans_of(unit * (400_000 // len(unit)), {}, {})
        assert time.perf_counter() - began < 20, unit


def test_precision_and_recall_of_added_spans(docs):
    r = random.Random(12)
    prose = lambda n: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n))
    digits = lambda n: "".join(r.choice("23456789") for _ in range(n))
    token = lambda: "".join(r.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(32))
    made = {
        "obfuscated_email": lambda: f"{prose(1)} [at] {prose(1)} [dot] org",
        "ssn": lambda: f"{r.randint(100, 600)}-{digits(2)}-{digits(4)}",
        "secret": lambda: token(),
        "name": lambda: f"Dr. {r.choice(sorted(pii.FIRST_NAMES))} {prose(1).title()}",
        "mac": lambda: ":".join(f"{r.randint(16, 255):02x}" for _ in range(6)),
    }
    before = {"secret": "api key: ", "ssn": "ssn "}
    rows, want = [], set()
    for i in range(400):
        kind = sorted(made)[i % 5]
        head, value = f"{prose(12)} {before.get(kind, '')}", made[kind]()
        rows.append((i, f"{head}{value} {prose(10)}"))
        want.add((i, f"{kind}:{len(head)}:{len(head) + len(value)}"))
    rows += [(1000 + i, f"{prose(8)} version {digits(3)}-{digits(2)} and section: {prose(3)} ratio={digits(4)} {prose(6)}") for i in range(200)]
    got = {(x.doc_id, s) for x in pii.find(docs(rows)).collect() for s in x.spans.split(",") if s and s.split(":")[0] in pii.ADDED}
    assert len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.9 * len(got)
