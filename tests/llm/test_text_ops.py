import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bitempo.llm import decontaminate, html, langid, pieces, pii, sharding, urlfilter, winnowing

# --- personal data ---


def brute(t):
    out = [(m.start(), "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), "card", m.end()))
    out += [(m.start(), "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda x: (x[0], pii.BASE.index(x[1])))


@settings(max_examples=2000, deadline=None)
@given(st.text("ab0123456789999@@..-+ ()_é", max_size=70))
def test_base_spans(t):
    assert pii.base_spans(t) == brute(t)


def test_base_spans_of_long_texts():
    for t in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "+1" * 100_000, "1.2." * 50_000, "- " * 100_000):
        pii.base_spans(t)


def test_pii_rows(docs):
    rows = [(1, None), (2, ""), (3, "mail é a.b@x.org or +1 (555) 555-0100 now"), (4, 'call (415) 555-2671 or token = "0a1b2c3d4e5f60718293a4b5c6d7"'), (4, "see 10.0.0.1, card 4111 1111 1111 1111"), (None, "x@y.zz")]
    got = sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.spans) for r in pii.find(docs(rows)).collect())
    none = hashlib.sha256(b"").hexdigest()
    assert ("1", 0, 0, 0, 0, "") in got and ("3", 1, 0, 0, 1, "email:7:16,phone:20:37") in got and ("None", 1, 0, 0, 0, "email:0:6") in got
    assert next(g for g in got if g[0] == "4" and g[2])[3:5] == (1, 0)
    assert {r.base_sha256 for r in pii.find(docs(rows[:2])).collect()} == {none}
    masked = {str(r.doc_id): r for r in pii.mask(docs(rows)).collect()}
    assert masked["3"].text == "mail é [EMAIL] or [PHONE] now" and masked["3"].n_chars == len(masked["3"].text) and masked["1"].text is None
    assert pii.find(docs([])).count() == 0


def test_em_trusts_agreeing_labelers():
    p = pii.expect({"ssn|0|0|1|0|1|0|1": 50, "ssn|0|0|-1|0|0|-1|-1": 50})
    assert p["ssn|0|0|1|0|1|0|1"] > 0.9 > 0.1 > p["ssn|0|0|-1|0|0|-1|-1"]


# --- pieces ---


def test_pieces_match_the_library():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    own = pieces.load(pieces.model_path())
    r = random.Random(2)
    texts = ["", " ", "  a ", "▁", "a▁b", "\n\t", "xyxyxyx" * 40, "a" * 3000, "-" * 999, "中文字 😀\x00", "\u200b\ufeff", "<s></s><0x0A>"]
    texts += ["".join(r.choice("aab  \n▁ÿ中文😀theiń=-_<s>") for _ in range(r.randint(0, 80))) for _ in range(1500)]
    for t, (n, ids, decoded) in zip(texts, own.encode(texts), strict=True):
        want = sp.encode(t, add_eos=True)
        assert ids == " ".join(map(str, want)) and n == len(want) and decoded == sp.decode(want)


def test_pieces_rows(docs):
    got = pieces.digests(docs([(1, None), (2, "a b"), (2, "a b"), (None, "")])).collect()
    end = hashlib.sha256(b"2").hexdigest()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == [("1", 1), ("2", 3), ("2", 3), ("None", 1)]
    assert [r.ids_sha256 for r in got if r.doc_id == 1] == [end]
    assert pieces.encode(docs([])).count() == 0


# --- language ---


def test_automaton_has_all_substrings():
    text = [ord(c) - 97 for c in "abcabxabcdzab"]
    to = langid.suffix_automaton(text, 26)

    def walks(s):
        at = 0
        for c in s:
            at = to[at, c]
            if at < 0:
                return False
        return True

    assert all(walks(text[i:j]) for i in range(len(text)) for j in range(i, len(text) + 1)) and not walks([1, 0]) and not walks([23, 23])


def test_language_rows(spark):
    en, fr = "the cat sat on the mat and the dog ran to the house with an old hat ", "le chat est sur la table et le chien dort dans la maison avec un vieux "
    rows = [(i, en * 3 if i % 2 else fr * 3, "en" if i % 2 else "fr") for i in range(30)] + [(100, None, "en"), (101, "123 !", "en"), (102, "", None), (103, "the dog and the cat", None), (103, "the dog and the cat", None), (None, "le chien dort", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    out = langid.identify(df).collect()
    got = {(r.doc_id, r.lang_pred) for r in out}
    assert len(out) == len(rows) and (103, "en") in got and (None, "fr") in got and {(100, "und"), (101, "und"), (102, "und")} <= got
    assert all(0 <= r.score <= 1 for r in out)
    assert {r.doc_id for r in langid.keep_known(df).collect()} == {*range(30), 103, None}
    assert {r.lang_pred for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(df.limit(0)).count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert out > 0.98


# --- html ---


def test_main_text():
    good = "The cat sat on the mat and it was the best of all of the days that we had ever been in the town, and the sun was out for a good long while so that the people of the town were glad of it and ran about."
    page = f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><a href=x>Home</a></nav><div class='cookie-notice'><p>{good}</p></div><article><h1>A &amp; B</h1><p>{good}<br>\n  x&nbsp;y<p>Short.</p><script>var a='</p>{good}'</script><!-- {good} --><div class=comments><p>{good}</p></div></article><footer>&copy; z</footer>"
    assert html.main_text(page) == f"A & B\n{good} x y\nShort."
    plain = f"<body><div><a href=1>one</a> <a href=2>two</a></div><h2>Title</h2><p>{good}</p><p>Short.</p><p>{good}</p><p>all <a>rights reserved here</a></p>"
    assert html.main_text(plain) == f"Title\n{good}\nShort.\n{good}"
    assert html.main_text(None) == html.main_text("") == html.main_text("<nav>x") == ""
    html.main_text("<" * 50_000 + "<p a='" * 3000)


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>a  b</p></article>", "x"), (1, "u", "<article><p>a  b</p></article>", "x"), (None, None, None, "x")], "page_id long, url string, html string, text string")
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in html.extract(df).collect()) == [("1", "a b", 3), ("1", "a b", 3), ("None", "", 0)]


# --- decontamination ---


def _item(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(n))


def test_leaks(spark, docs):
    r = random.Random(4)
    items = [(i, _item(r, 30 + i)) for i in range(12)]
    clean = [(i, _item(r, 150)) for i in range(20)]
    planted, want = [], set()
    for i, t in items:
        w = t.split()
        for _ in range(i % 5):  # up to four edits of thirty words and more
            w[r.randrange(len(w))] = "zzzz"
        planted.append((100 + i, f"{_item(r, 40)}. {' '.join(w).upper()} {_item(r, 30)}"))
        want.add((100 + i, i))
    planted.append((200, items[3][1]))
    want.add((200, 3))
    bench = spark.createDataFrame([*items, (50, None), (51, ""), (52, "two words")], "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    out = decontaminate.leaks(docs([*clean, *planted, (300, None), (301, "")]), bench)
    assert {(x.doc_id, x.item_id) for x in out.collect()} == want
    assert {x.doc_id for x in decontaminate.clean(docs([*clean, *planted, (300, None)]), bench).collect()} == {*range(20), 300}
    assert {(x.doc_id, x.item_id) for x in decontaminate.leaks(docs(planted), bench, block_bytes=700).collect()} == want
    assert decontaminate.leaks(docs([]), bench).count() == 0 == decontaminate.leaks(docs(clean), bench.limit(0)).count()


def test_best_match_is_the_edit_distance():
    import numpy as np

    def slow(a, b):
        cost = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(cost[j - 1] + (x != y), cost[j] + 1, new[j - 1] + 1))
            cost = new
        return min(cost)

    r = random.Random(6)
    for _ in range(300):
        a, b = ([r.randrange(4) for _ in range(r.randint(1, 12))] for _ in range(2))
        edits, s, e = decontaminate.best_match(np.array(a), np.array(b))
        assert edits == slow(a, b) and 0 <= s <= e <= len(b)


def test_recall_of_edited_items():
    import numpy as np

    r = random.Random(8)
    items = tuple((i, _item(r, r.randint(15, 60))) for i in range(40))
    index = decontaminate.Index(items, dict(decontaminate.plan_of(items)))
    found = 0
    for n in range(200):
        i = n % 40
        w = items[i][1].split()
        for _ in range(decontaminate.allowed(len(w)) * (n % 4) // 3):
            k = r.randrange(len(w))
            w[k : k + 1] = r.choice([[], ["zz"], [w[k], "qq"]])
        raw = f"{_item(r, 20)} {' '.join(w)} {_item(r, 20)}".encode()
        words, text = decontaminate.words_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        found += i in {x[1] for x in index.search(words, text)}
    assert found >= 195


# --- URLs ---


def test_url_rules(spark):
    rows = [(1, None), (2, "foo"), (3, "HTTP://A.ORG"), (4, "x://ORG/?a://b/c"), (5, "://Example.ORG/es/\nx?y"), (6, "h://a.b/#"), (7, ""), (8, "http://x.example.org/en/12"), (9, "http://notexample.org/es/"), (10, "http://com/de/x"), (10, "http://com/de/x"), (None, "http://q.com/fr/")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit("clash"), "score": F.lit("clash")})
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in urlfilter.judge(df).collect()}
    assert got == {
        (1, "", "", None, None), (2, "", "", None, None), (3, "a.org", "", None, None), (4, "org", "/", "org/", "allow"), (5, "example.org", "/es/\nx", "example.org/es/", "block"), (6, "a.b", "/", None, None), (7, "", "", None, None),
        (8, "x.example.org", "/en/12", "example.org/en/1", "block"), (9, "notexample.org", "/es/", "org/", "allow"), (10, "com", "/de/x", "com/de/", "block"), (None, "q.com", "/fr/", "com/fr/", "allow"),
    }
    assert urlfilter.judge(df.limit(0)).count() == 0
    assert {r.verdict for r in urlfilter.judge(df.where("page_id = 2")).collect()} == {"allow"}


def test_trees_learn():
    counts = [((a, b), 50.0 * (a == 1 and b == 0), 50.0 * (not (a == 1 and b == 0))) for a in range(2) for b in range(2)]
    trees = urlfilter.fit(counts, ["length", "depth"])

    def value(t, x):
        return t if not isinstance(t, tuple) else value(t[2] if x[t[0]] <= t[1] else t[3], x)

    for (a, b), pos, _ in counts:
        assert (sum(value(t, {"length": a, "depth": b}) for t in trees) > 0) == (pos > 0)


# --- shards, fingerprints ---


@pytest.mark.parametrize("bucket", [4096, 4])
def test_shards(spark, bucket):
    rows = [(i, "t" * (i % 7), "hot" if i % 3 else f"s{i % 5}") for i in range(213)] + [(None, None, None), (5, "ttttt", "hot"), (5, "ttttt", "hot")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"shard": F.lit("clash"), "n": F.lit("clash"), "h": F.lit(1)})
    out = sharding.interleave(df, bucket_rows=bucket).collect()
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r)
    sizes = [len(x) for x in by.values()]
    assert len(out) == len(rows) and set(by) == set(range(40)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    hot = [sum(r.source == "hot" for r in x) for x in by.values()]
    assert max(hot) - min(hot) <= 4
    assert next(r for r in out if r.doc_id is None).size == 16
    assert sharding.interleave(df.limit(0)).count() == 0


def winnowed(t, k=winnowing.GRAM, w=winnowing.WINDOW):
    """Positions that winnowing keeps, from the hashes that Spark gave."""
    out = []
    for i in range(max(1, len(t) - w + 1)):
        part = list(enumerate(t[i : i + w], i))
        if part:
            out.append(min(part, key=lambda x: (x[1], -x[0]))[0])
    return sorted(set(out))


def test_fingerprints(docs):
    r = random.Random(9)
    long = [" ".join(r.choice("abcdefg") * r.randint(1, 3) for _ in range(80)) for _ in range(6)]
    rows = [(10, None), (9, ""), (8, "one two"), (7, long[0]), (6, long[0]), (5, long[1]), (4, long[2]), (4, long[2]), (3, "x" * 50_000), (2, long[0][:200] + long[3])]
    out = winnowing.fingerprints(docs(rows)).collect()
    assert len(out) == len(rows)
    texts = sorted([(i, t or "") for i, t in rows], key=lambda x: -x[0])
    for k, (i, t) in enumerate(texts):
        nxt, h = texts[(k + 1) % len(texts)][1], len(t) // 2
        want = hashlib.sha256((t[: len(t) - h] + nxt[:h]).encode()).hexdigest()
        assert want in {x.edited_sha256 for x in out if x.doc_id == i}
    by = {x.doc_id: x for x in out}
    assert by[7].fingerprint == by[6].fingerprint and by[7].near_next == 1.0 and by[10].fingerprint == "" and by[10].near_next == 1.0 and by[8].fingerprint.count("@") == 1
    assert all(0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1 for x in out)
    assert winnowing.fingerprints(docs([])).count() == 0
    one = winnowing.fingerprints(docs([(1, long[0])])).collect()
    assert one[0].near_next == 1.0


def test_windows_keep_the_rightmost_smallest(spark, docs):
    r = random.Random(10)
    text = " ".join(r.choice("ab") for _ in range(120))
    df = docs([(1, text)])
    every = df.select(winnowing.selected(F.col("text"), winnowing.GRAM, 1).alias("k")).select(winnowing.hashes_of(F.col("k")).alias("h"), F.transform("k", lambda x: F.shiftrightunsigned(x, winnowing.POSITION_BITS)).alias("all")).first()
    kept = df.select(winnowing.positions_of(winnowing.selected(F.col("text"))).alias("p")).first().p
    assert sorted(kept) == winnowed(every.all)
