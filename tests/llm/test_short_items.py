from bitempo.llm import decontaminate


def test_short_and_unspaced_items(spark, docs):
    han = "今天天气很好我们一起去公园散步然后回家吃饭"
    items = spark.createDataFrame([(1, "two words"), (2, "solo"), (3, han), (4, "สวัสดี"), (5, "!?")], "item_id long, text string")
    rows = [(10, "here are Two  words, twice: two words"), (11, "words two"), (12, "a solo, solo"), (13, "昨天" + han + "了"), (14, "x" + han[:8] + "又" + han[9:]), (15, "ok สวัสดีครับ"), (16, "soloist two. wordsmith"), (17, None), (18, "")]
    got = {(r.doc_id, r.item_id, r.edits, r.start_word, r.end_word) for r in decontaminate.leaks(docs(rows), items).collect()}
    assert got == {(10, 1, 0, 2, 4), (12, 2, 0, 1, 2), (13, 3, 0, 2, 2 + len(han)), (14, 3, 1, 1, 1 + len(han)), (15, 4, 0, 1, 7)}
