import random
import time

import sentencepiece

from bitempo.llm import langid, pieces


def test_long_words_match_the_library():
    r = random.Random(3)
    own, lib = pieces.load(pieces.model_path()), sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    texts = ["".join(r.choice(a) for _ in range(n)) for a in (letters, "acgt", "ab", "a", "日本語中文字", "a\u0301é€😀z") for n in (47, 48, 300, 4000)]
    texts += [f"x {t} y" for t in texts] + ["the" * 500, "https://example.org/" + "a1B2-" * 400]
    for text, (n, ids, decoded) in zip(texts, own.encode(texts), strict=True):
        want = [*lib.encode(text), lib.eos_id()]
        assert (n, ids, decoded) == (len(want), " ".join(map(str, want)), lib.decode(want))
    own.known.clear()


def test_a_long_word_takes_little_time():
    r = random.Random(4)
    own = pieces.load(pieces.model_path())
    word = "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(300_000))
    began = time.perf_counter()
    own.encode([word])
    assert time.perf_counter() - began < 30
    own.known.clear()


def test_blocks_rank_languages_as_whole_parses(monkeypatch):
    r = random.Random(5)
    syl = {"de": "der sch ein ung ich en".split(), "en": "the and ing er on th".split(), "fr": "le que ment eau oi tre".split()}
    prose = lambda lang, n: " ".join("".join(r.choice(syl[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))
    parser = langid.CrossParser(tuple((k, prose(k, 2000)) for k in sorted(syl)))
    texts = [prose(k, n) for k in syl for n in (3, 30, 300, 1500)]
    blocks = parser.predict(texts)[0]
    monkeypatch.setattr(langid, "BLOCK", 1 << 16)
    assert parser.predict(texts)[0] == blocks
