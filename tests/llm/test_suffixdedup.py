import hashlib
import random

import numpy as np
import pytest

from bitempo.llm import suffixdedup as S

SIZE = 400


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for r in raw:
        for i in range(len(r) - SIZE + 1):
            seen[r[i : i + SIZE]] = seen.get(r[i : i + SIZE], 0) + 1
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - SIZE + 1):
            if seen[r[i : i + SIZE]] > 1:
                gone[i : i + SIZE] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([False], gone[:-1], [False])).astype(int)) == 1)
        out.append((len(r), int(gone.sum()), len(edges), hashlib.sha256(bytes(b for b, g in zip(r, gone, strict=False) if not g)).hexdigest()))
    return out


def corpus():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, other = prose(130), prose(300)
    texts = [prose(200), None, "", "short", passage, passage + prose(50), prose(20) + passage + prose(60), prose(90) + passage[:405] + prose(80), prose(9) + passage[30:], "a" * 1500, prose(30) + "a" * 700, "ab" * 600, other, other, other[:200] + "X" + other[201:]]
    texts += [prose(r.randint(0, 40)) + passage[r.randint(0, 60) :] + prose(r.randint(0, 30)) for _ in range(25)]
    return texts


@pytest.mark.parametrize("hot", [2048, 2])
def test_matches_brute_force(spark, docs, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)
    texts = corpus()
    rows = [(i if i else None, t) for i, t in enumerate(texts)] + [(12, texts[12])]  # a null id, a repeated row
    want = sorted(zip((str(i) for i, _ in rows), brute([t for _, t in rows]), strict=True))
    got = sorted((str(r.doc_id), (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in S.repeats(docs(rows)).collect())
    assert got == want


def test_empty_table(docs):
    assert S.repeats(docs([])).count() == 0


def held_against_sorting(raw: bytes, start, group, size, shallow):
    rank, repeated = S.deep_shallow(np.frombuffer(raw, np.uint8), np.array(start), np.array(group), size=size, shallow=shallow)
    keys = [(g, raw[s : s + size]) for s, g in zip(start, group, strict=True)]
    assert repeated.tolist() == [keys.count(k) > 1 for k in keys]
    assert rank.tolist() == [sorted(keys).index(k) for k in keys]


def test_deep_shallow_sorts():
    r = random.Random(1)
    raw = bytes(r.choice(b"ab") for _ in range(30)) * 40
    start = [r.randrange(len(raw) - 72) for _ in range(500)]
    held_against_sorting(raw, start, [r.randrange(3) for _ in range(500)], 64, 16)
    raw = bytes(r.choice(b"ab\xff") for _ in range(900)) * 2
    held_against_sorting(raw, [r.randrange(len(raw) - 64) for _ in range(700)], [0] * 700, 64, 32)


@pytest.mark.parametrize("size", [64, 400])
def test_strings_that_differ_in_their_last_byte(size):
    raw = b"".join(b"x" * (size - 1) + c for c in (b"a", b"b", b"b", b"a", b"c"))
    held_against_sorting(raw, [k * size for k in range(5)], [0] * 5, size, 32)
    held_against_sorting(raw[: 3 * size], [0, size, 2 * size], [0] * 3, size, 32)


def test_last_bytes_in_documents(docs):
    texts = ["x" * 150 + "y" * 249 + c for c in "abbac"] + [None]
    got = sorted((r.doc_id, r.n_removed, r.kept_sha256) for r in S.repeats(docs(list(enumerate(texts)))).collect())
    assert got == [(i, w[1], w[3]) for i, w in enumerate(brute(texts))]


def test_pieces_of_long_texts(docs, monkeypatch):
    monkeypatch.setattr(S, "PIECE", 700)
    monkeypatch.setattr(S, "slices", lambda lengths, most=0: ((i, i + 1) for i in range(len(lengths))))
    texts = corpus()
    raw = [(t or "").encode() for t in texts]
    for r in raw:
        ends = np.array([0, len(r)])
        whole = S.anchors(np.frombuffer(r, np.uint8), ends)
        starts = [(s, a) for f, z, a in zip(whole[1], whole[2], whole[3], strict=True) for s in range(f, z + 1)]
        cut = []
        for low, own in S.pieces(ends):
            part = S.anchors(np.frombuffer(r[own[0] : own[-1]], np.uint8), own - own[0])
            cut += [(s + low, a + low) for f, z, a in zip(part[1], part[2], part[3], strict=True) for s in range(f, z + 1)]
        assert cut == starts
