"""Main text of web pages by two passes of block rules.

The first pass cuts a page into blocks at block-level tags and decides each by where it stands, its length, its
share of stop words and its share of linked characters. Short blocks stay open; the second pass gives them the
label of the nearest decided block beside them, and so do long ones of few stop words. Where no block of a page has its
share of stop words, the language is another and length and links decide.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tags that begin and end a block.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search "
    "section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
# Elements whose content is no text of the page, and those without content.
RAW_TAGS = frozenset("script style template noscript iframe svg math canvas object audio video map textarea title noframes noembed xmp".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE_TAGS = frozenset("head nav aside footer button select option dialog menu fieldset label datalist".split())
#: A closing tag is implied by the next of these.
SELF_CLOSING = {"p": BLOCK_TAGS - {"body", "html", "head"}, "li": frozenset({"li"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "tr": frozenset({"tr"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "option": frozenset({"option"})}
# Words of class, id and role names of parts that are not the article.
OUTSIDE_NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar sidebars rail footer foot masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup "
    "modal overlay newsletter subscribe subscription signup login signin register share sharing social follow comment comments "
    "commentlist discussion disqus replies reply respond related recommended recommendations teaser teasers trending popular pagination pager "
    "widget widgets search searchbox form skip copyright legal disclaimer imprint contentinfo complementary dialog alertdialog "
    "tags taglist toc".split()
)
HEADER_NAMES = frozenset("header pageheader siteheader head hero".split())
MAIN_TAGS = frozenset(("article", "main"))
MAIN_NAMES = frozenset("articlebody entrycontent postcontent postbody maincontent articlecontent".split())
# Frequent words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    "a an and are as at be been but by can did do for from had has have he her his if in into is it its not of on or our she so that the "
    "their them then there these they this to was we were what when which who will with would you your "
    "au aux avec ce ces dans de des du elle en est et il je la le les leur mais ne nous on ou par pas pour qu que qui sa se ses son sur un une vous "
    "aber als am auch auf aus bei das dem den der des die ein eine einen einer es für hat ich ihr im ist mit nach nicht oder sich sie sind und von "
    "vor war wie wir zu zum zur "
    "al como con del el ella es esta este fue ha la las lo los más muy no para pero por se sin sobre su sus una uno y ya".split()
)

LENGTH_LOW, LENGTH_HIGH = 70, 200
STOPS_LOW, STOPS_HIGH = 0.10, 0.20
MOST_LINKED = 0.4

_TOKEN = re.compile(r"""<!--(?:>|->|.*?--!?>)|<!--.*\Z|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*+(?:"[^"]*"|'[^']*')?)*+)>|</?[a-zA-Z][^>]*>|<[!?/][^>]*>""", re.S)
_OPEN = re.compile(r"<[a-zA-Z/!?]")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_WORD = re.compile(r"[^\W\d_]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass(slots=True)
class Block:
    """Text of one block, characters of it inside links, and where it stands; ``mark`` is the innermost element around
    it whose names (or a form) speak against it, -1 if there is none."""

    text: str
    linked: int
    outside: bool
    region: int
    heading: bool
    mark: int = -1
    title: bool = False


@dataclass(slots=True)
class _Open:
    tag: str
    outside: bool
    region: int
    link: bool
    mark: int = -1


def _place(tag: str, attributes: str, parent: _Open, regions: int, place: int) -> _Open:
    outside, region = parent.outside or tag in OUTSIDE_TAGS, parent.region
    outside = outside or (tag == "header" and not region)
    names: set[str] = set()
    marked = tag == "form"
    if attributes:
        for key, *values in _ATTRIBUTE.findall(attributes):
            value, key = "".join(values), key.lower()
            if key in ("class", "id", "role", "itemprop"):
                for name in value.split():
                    names.add(re.sub(r"[^a-z]", "", name.lower()))
                    names.update(w.lower() for w in _NAME_WORD.findall(name))
            elif (key == "hidden" and "hidden" in attributes.lower().split()) or (key == "aria-hidden" and value == "true") or (key == "style" and _HIDDEN.search(value)):
                outside = True
        if tag not in ("body", "html") and tag not in MAIN_TAGS | MAIN_NAMES and names & OUTSIDE_NAMES or tag in MAIN_TAGS and names & {"comment", "comments", "teaser", "related", "ad", "advert", "promo", "sponsored"}:
            marked = True
        if not region and names & HEADER_NAMES and tag not in ("body", "html", "h1", "h2", "h3"):
            marked = True
    if tag in MAIN_TAGS or names & MAIN_NAMES or "main" in names and "role" in attributes.lower():
        region = regions + 1
    mark = place if marked else -1 if tag == "main" else parent.mark
    return _Open(tag, outside, region, parent.link or tag == "a", mark)


def _settle(found: list[Block], around: dict[int, int]) -> None:
    """Marked blocks are outside, unless every marked element around them is a wrapper of the page: it holds most of the
    unlinked text and either the title or all text that looks good, or it holds the title and an article.

    ``around`` gives the marked element around each one, -1 for none; inner ones have higher numbers. What an element
    holds is summed up once, from the inner ones to the outer.
    """
    if not around:
        return
    unlinked = [0 if b.outside else max(0, len(b.text.replace(" ", "")) - b.linked) for b in found]
    stop_words = knows_stop_words(found)
    looks_good = lambda b: first_pass(b, False, stop_words) == GOOD
    held = {mark: [0, False, False] for mark in around}  # unlinked text, a title, a region
    directly: dict[int, list[Block]] = {}
    good = False
    for block, size in zip(found, unlinked, strict=True):
        if block.outside:
            continue
        if block.mark < 0:
            good = good or looks_good(block)
            continue
        directly.setdefault(block.mark, []).append(block)
        sums = held[block.mark]
        held[block.mark] = [sums[0] + size, sums[1] or block.title, sums[2] or bool(block.region)]
    for mark in sorted(around, reverse=True):
        outer, own = held.get(around[mark]), held[mark]
        if outer:
            held[around[mark]] = [outer[0] + own[0], outer[1] or own[1], outer[2] or own[2]]
    total = sum(unlinked)
    wrapper: dict[int, bool] = {-1: True}
    for mark in sorted(around):
        size, title, region = held[mark]
        void = 2 * size > total and (title or not good) or title and region
        wrapper[mark] = void and wrapper[around[mark]]
        if void:
            good = good or wrapper[mark] and any(map(looks_good, directly.get(mark, ())))
    for block in found:
        block.outside = block.outside or not wrapper[block.mark]


def blocks(page: str) -> list[Block]:
    """Blocks of a page in page order, without markup; character references are decoded, white space is one blank."""
    out: list[Block] = []
    stack = [_Open("", False, 0, False)]
    opened: Counter[str] = Counter()
    pieces: list[str] = []
    linked = regions = 0
    # no tag ends after the last bracket; one that is open there is dropped
    heading, title, at, size, last, places = False, False, 0, len(page), page.rfind(">") + 1, 0
    around: dict[int, int] = {}
    closed: dict[str, re.Pattern] = {}

    def end_block() -> None:
        nonlocal linked, heading, title
        text = " ".join("".join(pieces).split())
        if text:
            out.append(Block(text, linked, stack[-1].outside, stack[-1].region, heading, stack[-1].mark, title))
        pieces.clear()
        linked, heading, title = 0, False, False

    def add(text: str) -> None:
        nonlocal linked
        if text:
            text = html.unescape(text) if "&" in text else text
            pieces.append(text)
            if stack[-1].link:
                linked += len("".join(text.split()))

    def close_to(depth: int) -> None:
        for closed in stack[depth:]:
            opened[closed.tag] -= 1
        del stack[depth:]

    while at < size:
        found = _TOKEN.search(page, at, last)
        if found is None:
            add(_OPEN.split(page[at:], maxsplit=1)[0])
            break
        add(page[at : found.start()])
        if found[0].startswith("<!--") and not found[0].endswith(">"):
            break
        at, tag = found.end(), (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            if opened[tag]:
                if tag in BLOCK_TAGS:
                    end_block()
                close_to(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            elif tag in ("p", "br"):
                end_block()
            continue
        if tag == "br":
            pieces.append(" ")
        if tag in BLOCK_TAGS:
            end_block()
            while stack[-1].tag in SELF_CLOSING and tag in SELF_CLOSING[stack[-1].tag]:
                close_to(len(stack) - 1)
            # an unclosed paragraph under inline tags ends too
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == "p" or stack[k].tag in BLOCK_TAGS), 0)
            if depth and stack[depth].tag == "p" and tag in SELF_CLOSING["p"]:
                close_to(depth)
            heading = len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
            title = tag == "h1"
        if tag in RAW_TAGS:
            # drawings may close themselves; others do by mistake, and then have no end
            if tag not in closed:
                closed[tag] = re.compile(rf"</{tag}\b[^>]*>", re.I)
            itself = (found[3] or "").endswith("/")
            close = None if itself and tag in ("svg", "math") else closed[tag].search(page, at)
            at = close.end() if close else at if itself else size
        elif tag not in VOID_TAGS and not (found[3] or "").endswith("/"):
            stack.append(_place(tag, found[3] or "", stack[-1], regions, places))
            if stack[-1].mark == places:
                around[places] = -1 if tag == "main" else stack[-2].mark
            places += 1
            opened[tag] += 1
            regions = max(regions, stack[-1].region)
    end_block()
    _settle(out, around)
    return out


GOOD, BAD, SHORT = 1, 0, -1


def _stops(block: Block) -> float:
    words = _WORD.findall(block.text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def _mostly_linked(block: Block) -> bool:
    return block.linked > MOST_LINKED * len(block.text.replace(" ", ""))


def knows_stop_words(found: list[Block]) -> bool:
    """Whether some block that may be text has its share of stop words; if none has, the language is another."""
    return any(not b.outside and len(b.text) >= LENGTH_LOW and not _mostly_linked(b) and _stops(b) >= STOPS_LOW for b in found)


def first_pass(block: Block, region_only: bool, stop_words: bool = True) -> int:
    """GOOD, BAD, or SHORT for what the block alone can't tell: short ones and long ones of few stop words, such as
    code or names. Without ``stop_words`` length and links decide."""
    if block.outside or region_only and not block.region:
        return BAD
    size = len(block.text)
    if _mostly_linked(block):
        return BAD
    if size < LENGTH_LOW:
        return SHORT
    if not stop_words:
        return GOOD if size >= LENGTH_HIGH else SHORT
    stops = _stops(block)
    if block.region:
        return GOOD if stops >= STOPS_LOW or size >= LENGTH_HIGH else SHORT
    if stops >= STOPS_HIGH:
        return GOOD
    if stops >= STOPS_LOW:
        return GOOD if size >= LENGTH_HIGH else SHORT
    return SHORT


def second_pass(found: list[Block], labels: list[int]) -> list[int]:
    """Open blocks take the label of the nearest decided block of their region; ties go to the one after for
    headings, to the good one otherwise. In an article without any decided block they are kept."""
    out = list(labels)

    def decided(order: range) -> list[int | None]:
        """The last decided block met in that order: of the own region, or of any for blocks outside regions."""
        last: dict[int, int] = {}
        near: list[int | None] = [None] * len(labels)
        for k in order:
            near[k] = last.get(found[k].region)
            if labels[k] != SHORT:
                last[found[k].region] = last[0] = k
        return near

    befores, afters = decided(range(len(labels))), decided(range(len(labels) - 1, -1, -1))
    for k, label in enumerate(labels):
        if label != SHORT:
            continue
        region, before, after = found[k].region, befores[k], afters[k]
        near = [j for j in (before, after) if j is not None]
        if region and not any(labels[j] == GOOD for j in near):
            out[k] = GOOD
        elif not near:
            out[k] = BAD
        elif found[k].heading and after is not None:
            out[k] = labels[after]
        else:
            least = min(abs(j - k) for j in near)
            out[k] = max(labels[j] for j in near if abs(j - k) == least)
    return out


def main_text(page: str | None) -> str:
    """The blocks of the article joined by line ends; null, empty and markup-only pages give the empty text."""
    if not page:
        return ""
    found = blocks(page)
    region_only = any(b.region and not b.outside for b in found)
    stop_words = knows_stop_words(found)
    labels = second_pass(found, [first_pass(b, region_only, stop_words) for b in found])
    return "\n".join(b.text for b, label in zip(found, labels, strict=True) if label == GOOD)


def article_text(page: Column) -> Column:
    @F.arrow_udf("string")
    def texts(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py()) for p in pages], pa.string())

    return texts(page)


def extract(pages: DataFrame, html_col: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with the main text of each row; rows stay as they are, whatever their ids, nulls included. A column of the
    name asked for, in any case, is replaced."""
    return pages.withColumn(name, article_text(F.col(html_col)))
