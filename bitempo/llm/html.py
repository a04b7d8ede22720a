"""Main text of web pages by two-pass block rules (operator 5).

The page is cut into blocks at block-level tags. In the first pass stop-word density, length and link
density call a block good, near good, short or bad; menus, footers, adverts, comments and the like, which
tags, roles, classes and ids name, are bad at once. Within ``article`` or ``main`` the page itself speaks for a block, so
that only its links make it bad there. In the second pass near-good and short blocks take the labels of their nearest
decided neighbours. On a page in a language whose stop words aren't listed, sentence marks take the place of stop
words; letters of scripts that write words without spaces count threefold for a block's length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, rows, table, tidily

#: Thresholds of the first pass; a block longer than SHORT characters is judged by its stop words.
SHORT, LONG = 70, 140
LOW_STOPS, HIGH_STOPS = 0.15, 0.25
MOST_LINKS = 0.33
#: The commonest function words of the languages that are looked for.
STOP_WORDS = frozenset(
    "the of and to in a is that for it was on are as with his they be at this have from or one had by not but what all were we when your can said there an which their if do will each how she he"
    " der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über"
    " de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec son ou aux elle"
    " que el y los del se las por con no una su para es al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre"
    " het een van is op te dat die niet zijn da di il che e per una sono con non do os as um uma não".split()
)
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What these hold is no text of the page: code, styles, fields of forms, other pages.
RAW = frozenset("script style textarea title noscript template iframe xmp noembed select datalist".split())
BOILERPLATE = frozenset("nav footer aside form head menu dialog header".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NAMED = frozenset(
    "ad ads adv advert advertisement advertising adverts advertorial sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices notification notifications alert comment comments commentlist disqus reply replies respond discussion"
    " sidebar side rail nav navbar navigation menu menus breadcrumb breadcrumbs crumbs footer header masthead topbar toolbar related recommended recommendations share sharing social newsletter subscribe subscription signup login popup modal overlay widget pagination pager copyright legal".split()
)
#: Parts that come after the name of such a thing: within an article ``share-buttons`` is one, ``share-price`` isn't.
GENERIC = frozenset("area bar block box button buttons container content count form group holder icon icons inner item items left link links list main message panel right row section text title top bottom wrap wrapper".split())
_SENTENCE = re.compile(r"[.!?…](?=[\s\"'”’»)]|$)|[。！？｡।؟۔።]")
#: Scripts without spaces: Thai, Lao, Burmese, Khmer, kana and Han.
_DENSE = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>|<[!?][^>]*+>""", re.S)
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
_NAMES = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_WORD = re.compile(r"[^\W\d_]+")


class Block(NamedTuple):
    text: str
    linked: int
    heading: bool
    vetoed: bool
    inside: bool


def _names_boilerplate(value: str, inside: bool) -> bool:
    """Whether a class or id names something that is no main text; within an article by its last telling part."""
    if not inside:
        return not NAMED.isdisjoint(p.lower() for p in _PARTS.findall(value))
    for name in value.split():
        parts = [p.lower() for p in _PARTS.findall(name)]
        while len(parts) > 1 and parts[-1] in GENERIC and parts[-1] not in NAMED:
            parts.pop()
        if parts and parts[-1] in NAMED:
            return True
    return False


def _named(attributes: str, inside: bool) -> tuple[bool, bool]:
    """(whether class, id or role names something that is no main text, whether they name the article)."""
    bad = good = False
    for name, value in _NAMES.findall(attributes):
        value = value.strip("\"'")
        name = name.lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            bad = True
        elif name == "role":
            bad |= value.lower() in ROLES
            good |= value.lower() in ("main", "article")
        elif name in ("class", "id"):
            bad |= _names_boilerplate(value, inside)
    return bad and not good, good


def blocks_of(html: str) -> tuple[list[Block], bool]:
    """(blocks in page order, whether the page marks its article)."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # open tags that matter: name, vetoed, article
    vetoed = inside = marked = False
    links = 0
    pieces: list[str] = []
    linked: list[str] = []
    heading = False

    def flush() -> None:
        nonlocal heading
        text = " ".join(unescape("".join(pieces)).split())
        if text:
            out.append(Block(text, len(" ".join(unescape("".join(linked)).split())), heading, vetoed, inside))
        pieces.clear()
        linked.clear()
        heading = False

    pos, n = 0, len(html)
    last = html.rfind(">")
    opened: Counter[str] = Counter()  # names on the stack
    while pos < n:
        at = html.find("<", pos)
        if at < 0:
            at = n
        if at > pos:
            pieces.append(html[pos:at])
            if links:
                linked.append(html[pos:at])
        if at == n:
            break
        if at > last:  # no tag ends any more; only a comment can still begin
            stop = html.find("<!--", at)
            pieces.append(html[at : stop if stop >= 0 else n].replace("<", "&lt;"))
            break
        tag = _TAG.match(html, at) or _LOOSE.match(html, at)
        if not tag:
            pieces.append("&lt;")
            pos = at + 1
            continue
        pos = tag.end()
        if not tag.lastindex:
            continue
        close, name, attributes = tag[1], tag[2].lower(), tag[3]
        if name in RAW and not close:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(html, pos)
                pos = end.end() if end else n
            if name in BLOCKS:
                flush()
            continue
        if name == "a":
            links = 0 if close else 1
        elif name == "br":
            pieces.append(" ")
        if name in BLOCKS:
            flush()
            links = 0
            heading = not close and name in ("h1", "h2", "h3", "h4", "h5", "h6")
        if name in VOID or (name == "p" and not attributes):
            continue
        if close:
            for k in range(len(stack) - 1, -1, -1) if opened[name] else ():
                if stack[k][0] == name:
                    if name not in BLOCKS and any(vetoed != s[1] or inside != s[2] for s in stack[k:]):
                        flush()
                    _, vetoed, inside = stack[k]
                    opened.subtract(s[0] for s in stack[k:])
                    del stack[k:]
                    break
        elif not attributes.endswith("/"):
            bad, good = _named(attributes, inside) if attributes else (False, False)
            bad = bad and name not in ("html", "body") or name in BOILERPLATE and not (name == "header" and inside)
            good = good or name in ("article", "main")
            if bad or good or name in BLOCKS or name in ("span", "ins", "small", "label"):
                if (bad or good) and name not in BLOCKS:
                    flush()
                stack.append((name, vetoed, inside))
                opened[name] += 1
                if bad:
                    vetoed = True
                if good:
                    inside, marked = not vetoed, marked or not vetoed
    flush()
    return out, marked


def size_of(text: str) -> int:
    """Characters, those of scripts without spaces threefold."""
    return len(text) if text.isascii() else len(text) + 2 * len(_DENSE.findall(text))


def stops_of(text: str) -> tuple[int, int]:
    """(stop words, words)."""
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words), len(words)


def familiar(blocks: list[Block]) -> bool:
    """Whether the page has stop words in its running text, so that they can tell good blocks from others."""
    seen = [stops_of(b.text) for b in blocks if not b.vetoed and b.linked <= MOST_LINKS * len(b.text) and size_of(b.text) >= SHORT]
    return sum(s for s, _ in seen) >= LOW_STOPS * sum(n for _, n in seen)


def first_pass(b: Block, marked: bool, known: bool = True) -> str:
    """known: whether stop words of the page's language are listed."""
    if b.vetoed or marked and not b.inside:
        return "bad"
    n = size_of(b.text)
    if b.linked > MOST_LINKS * len(b.text):
        return "bad"
    if n < SHORT:
        return "near" if b.inside and not b.linked else "short"
    if known:
        stops, words = stops_of(b.text)
        density = stops / max(1, words)
    else:  # a sentence mark in two hundred characters is dense
        density = HIGH_STOPS * min(1.0, 200 * len(_SENTENCE.findall(b.text)) / n)
    if b.inside:
        return "good" if density >= LOW_STOPS or not b.linked else "near"
    if density >= HIGH_STOPS:
        return "good" if n > LONG else "near"
    return "near" if density >= LOW_STOPS else "bad"


def neighbours(blocks: list[Block], labels: list[str], marked: bool) -> list[tuple[str, str]]:
    """The labels of the nearest decided blocks before and after each block; "edge" where there is none.

    Within a marked article its bounds are no neighbours.
    """
    found = [["edge", "edge"] for _ in labels]
    for side, order in ((0, range(len(labels))), (1, range(len(labels) - 1, -1, -1))):
        last = "edge"
        for i in order:
            found[i][side] = last
            if labels[i] in ("good", "bad") and (blocks[i].inside or not marked):
                last = labels[i]
    return [(a, z) for a, z in found]


def main_blocks(blocks: list[Block], marked: bool) -> list[str]:
    """The texts that both passes keep: near-good blocks are decided first, then short ones.

    A near-good block is bad between two bad ones; a short one needs two good neighbours, a heading a good one
    after it.
    """
    known = familiar(blocks)
    labels = [first_pass(b, marked, known) for b in blocks]
    for kind in ("near", "short"):
        beside = neighbours(blocks, labels, marked)
        for i, (b, sides) in enumerate(zip(blocks, beside, strict=True)):
            if labels[i] == kind == "near":
                labels[i] = "bad" if sides == ("bad", "bad") else "good"
            elif labels[i] == kind:
                labels[i] = "good" if sides == ("good", "good") or b.heading and sides[1] == "good" else "bad"
    return [b.text for b, label in zip(blocks, labels, strict=True) if label == "good"]


def main_text(html: str | None) -> str:
    blocks, marked = blocks_of(html or "")
    return "\n".join(main_blocks(blocks, marked))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    A null or empty page, and one without main text, has an empty text. A page that breaks off is read as far
    as it goes; tags left open end with the page. Repeated rows are answered each; other columns of ``pages``
    are not read.
    """
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in rows(batch, "html")]
            cols = [rows(batch, "page_id"), rows(batch, "url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "text", "n_chars"])

    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return src.mapInArrow(tidily(run), "page_id bigint, url string, text string, n_chars bigint")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
