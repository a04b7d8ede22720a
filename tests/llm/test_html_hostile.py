import time

import pytest

from bitempo.llm import html

POLISH = "Wczoraj rano pojechaliśmy do miasta, żeby odwiedzić stary rynek. Pogoda była piękna, a ludzie siedzieli przed kawiarniami. Wróciliśmy dopiero wieczorem."
CHINESE = "昨天早上我们去了城里的老市场。天气很好，人们坐在咖啡馆前面聊天。我们一直到晚上才回家。孩子们在路上睡着了。"
ENGLISH = "The cat sat on the mat and it was the best of all of the days that we had ever been in the town, and the sun was out for a good long while so that the people were glad of it."


@pytest.mark.parametrize("text", [POLISH, CHINESE])
def test_pages_of_other_languages(text):
    menu = "<ul>" + "".join(f"<li><a href=/{i}>{text[:9]}</a></li>" for i in range(6)) + "</ul>"
    assert html.main_text(f"<body>{menu}<p>{text}</p><p>{text}</p><div class=sidebar><p>{text}</p></div></body>") == f"{text}\n{text}"


def test_nothing_else_is_dropped_within_an_article():
    page = f"<article><p>{ENGLISH}</p><div class='share-price'><p>Shares 12 34 56</p></div><p>Let <math>E=mc^2</math> and <button>press</button> be.</p><div class='share-buttons'><p>Tell all</p></div><div class='comment-list'><p>{ENGLISH}</p></div><section id='cookieBanner'>ok</section><p>12 34 56 78 {'90 ' * 30}</p></article>"
    assert html.main_text(page).split("\n") == [ENGLISH, "Shares 12 34 56", "Let E=mc^2 and press be.", "12 34 56 78 " + "90 " * 29 + "90"]


@pytest.mark.parametrize("unit", ["<div>|</p2>", '<a b="', "<a b='x", "<", "<!--", "<p class=x>", "</div>", "<b><div>|</b>", "&amp", "<script>", "<span class=ad>|</span>", "<li><a href=x>"])
def test_long_pages_take_linear_time(unit):
    parts = unit.split("|")
    took = []
    for n in (8_000, 32_000):
        began = time.perf_counter()
        html.main_text("".join(p * n for p in parts) + (">" if n % 2 else ""))
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 1


def test_empty_table(spark):
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string, text long, n_chars string")).count() == 0
