"""Main text of web pages by two passes over their blocks.

A page is cut into blocks at block-level tags.  The first pass gives each block a label
from what holds it, its length, the share of its characters in links and the share of
its words that are stop words:

- *bad*: inside a menu, header, footer, sidebar, form, notice, advert or comment section
  (by element, role, class or id), or mostly links; outside an article's element where
  articles hold at least half of the text not yet bad; elsewhere long without stop words,
- *good*: in an article and not short, or long with many stop words,
- *short*: too short to tell, or in an article a sentence with much of it in links.

An article inside a menu, sidebar or footer element is part of that.  Inside what is only
named like one (a page may be wrapped in ``with-sidebar``), a form or something hidden, it
is an article if it alone has more text than all that is not bad elsewhere.  Inside an article
an element named like a side part is one if it is mostly links, holds controls of a form or
has no block of a sentence's length; sections and tables go by no such name.

Stop words are asked only where they are frequent in the page's longest blocks, and of
blocks in Latin script; elsewhere length and links decide.

The second pass gives short blocks the label of their nearest decided neighbours in the
same surroundings: good if one of the two is good and nearer or as near, and in an
article without any decided block.  Blocks labelled good make up the text, one a line.

``<br>`` is white space; character references are decoded once; script, style, markup and
comments in the markup are never text.  Broken markup does not fail: unclosed elements
end with what holds them, and a tag that never ends is dropped.  Null html has no text.
Every row is judged on its own, repeated ones too; an empty table gives none.  Time grows in
proportion to a page's length, however deep it nests.  Other columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

#: Tags that begin or end a block; fixed values of the language.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol "
    "p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style noscript template textarea title iframe svg annotation annotation-xml object select option button head".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SIDE_TAGS = frozenset("nav footer aside dialog menu search".split())
FORM_TAGS = frozenset(("form", "fieldset"))
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())

#: Parts of class and id names, as whole words or as beginnings of words.
SIDE_WORDS = frozenset("ad ads adv advert adverts sponsor sponsored promo promotion side nav menu tags alert gdpr login signup search form skip".split())
SIDE_STARTS = (
    "advert", "banner", "breadcrumb", "consent", "cookie", "disclaimer", "footer", "header", "masthead", "modal", "navbar",
    "navigation", "newsletter", "notice", "notification", "paginat", "popup", "promo", "recommend", "related",
    "share", "sharing", "sidebar", "social", "sponsor", "subscri", "toolbar", "widget",
)
ARTICLE_WORDS = frozenset("article content post story entry".split())

#: Frequent words of English, French, German and Spanish; fixed values.
STOP_WORDS = frozenset(
    "a an and are as at be by for from has have he in is it not of on or that the this to was were which with you "
    "au aux avec ce dans de des du elle en est et il la le les ne on par pas pour que qui se son sur un une "
    "auf das dem den der des die ein eine einem einen er es für im ist mit nicht sich sie sind und von werden wie zu zum "
    "al como con del el ella es esta la las lo los más no para pero por que se sin su una y".split()
)
SHORT_CHARS, LONG_CHARS = 70, 200
MOST_LINKS = 0.33
LOW_STOPS, HIGH_STOPS = 0.10, 0.20
#: Blocks whose words tell whether the stop words are of the page's language.
LONGEST = 10

_MARK = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.DOTALL,
)
_NAMES = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_WORD = re.compile(r"[^\W\d_]+")
_PART = re.compile(r"[a-z]+")
#: Letters outside Latin script, and characters of Chinese, Japanese and Korean.
_OTHER = re.compile(r"[^\W\d_\u0000-\u024F\u1E00-\u1EFF]+")
_WIDE = re.compile(r"[\u3040-\u30FF\u3400-\u9FFF\uAC00-\uD7AF\uF900-\uFAFF]+")
#: Whole names of comment sections; ``comments-open``, ``commentary`` and ``discussion`` are none.
_COMMENTS = re.compile(
    r"(?:(?:article|blog|facebook|fb|post|reader|user)[-_])?comments?(?:[-_]?(?:area|block|body|box|container|content|form|item|list|respond"
    r"|section|text|thread|tree|wrap|wrapper|\d+))?|disqus(?:[-_]thread)?|respond|reply|replies"
)

#: Beginnings of names that mean a side part also inside an article, where others, such as
#: ``related-work``, ``social-history`` or ``notice-of-motion``, may name a part of its subject.
STRONG_STARTS = (
    "advert", "banner", "breadcrumb", "consent", "cookie", "gdpr", "login", "masthead", "modal", "navbar", "navigation",
    "newsletter", "paginat", "popup", "promo", "sidebar", "signup", "sponsor", "subscri", "toolbar", "widget",
)
STRONG_WORDS = frozenset("ad ads adv nav skip".split())
#: Elements of an article that are named after what they are about.
TITLED_TAGS = frozenset(("section", "table", "thead", "tbody", "tr", "td", "th", *HEADINGS))
CONTROLS = frozenset("input button select textarea form".split())

#: ``LIKELY`` is at the side by name, form or being hidden, ``NESTED`` an article in that, and
#: ``DOUBT`` in an article but named like a side part.
NEITHER, ARTICLE, NESTED, LIKELY, SIDE, COMMENT, DOUBT = range(7)


@dataclass
class Block:
    place: int
    heading: bool
    number: int = 0
    parts: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    plain: list[str] = field(default_factory=list)
    text: str = ""
    label: str = ""
    second: str = ""


def _place(tag: str, attributes: str, inside: int) -> int:
    """What an element that opens is part of."""
    found: dict[str, str] = {}
    if attributes:
        for m in _NAMES.finditer(attributes):
            found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    names = [re.sub(r"([a-z])([A-Z])", r"\1-\2", found.get(k, "")).lower() for k in ("class", "id")]
    words = _PART.findall(" ".join(names))
    # A section of an article has its id from its title.
    tokens = names[0].split() + ([] if tag == "section" and inside in (ARTICLE, NESTED, DOUBT) else names[1].split())
    if inside == COMMENT or (tag not in HEADINGS and any(map(_COMMENTS.fullmatch, tokens))):
        return COMMENT if tag not in ("body", "html", "main") else inside
    if tag == "main":
        return ARTICLE
    if inside == SIDE or tag in ("body", "html"):
        return inside
    if tag == "article":
        return NESTED if inside in (LIKELY, NESTED) else ARTICLE
    if tag in SIDE_TAGS or found.get("role", "").lower() in SIDE_ROLES:
        return SIDE
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
    if inside == LIKELY or tag in FORM_TAGS or hidden:
        return LIKELY
    if tag == "header":
        return inside if inside in (ARTICLE, NESTED, DOUBT) else LIKELY
    if inside in (ARTICLE, NESTED, DOUBT):
        # The first part of a whole name counts; an id of a section comes from its title.
        firsts = [t.replace("_", "-").split("-")[0] for t in names[0].split() + ([] if tag in TITLED_TAGS else names[1].split())]
        if any(w in STRONG_WORDS or w.startswith(STRONG_STARTS) for w in firsts):
            return LIKELY
        named = any(w in SIDE_WORDS or w.startswith(SIDE_STARTS) for w in firsts)
        return DOUBT if inside == ARTICLE and named and tag not in TITLED_TAGS else inside
    if tag not in HEADINGS and any(w in SIDE_WORDS or w.startswith(SIDE_STARTS) for w in words):
        return LIKELY
    if inside == NEITHER and (found.get("role") == "main" or ARTICLE_WORDS & set(words)):
        return ARTICLE
    return inside


def blocks(html: str) -> list[Block]:
    """The page's blocks that have text, in order."""
    out: list[Block] = []
    stack: list[tuple[str, int, int]] = [("", NEITHER, 0)]
    opened: dict[str, int] = {}
    controls: set[int] = set()
    links = nested = 0
    current = Block(NEITHER, False)

    def add(text: str) -> None:
        if text:
            current.parts.append(text)
            (current.linked if links else current.plain).append(text)

    def cut(heading: bool = False) -> None:
        nonlocal current
        if current.parts:
            out.append(current)
            current = Block(stack[-1][1], heading, stack[-1][2])
        else:
            _, current.place, current.number = stack[-1]
            current.heading = heading

    def enter(tag: str, place: int) -> None:
        nonlocal nested
        _, around, number = stack[-1]
        if place in (NESTED, DOUBT) and place != around:
            nested += 1
            number = nested
        stack.append((tag, place, number))
        opened[tag] = opened.get(tag, 0) + 1

    def leave() -> str:
        tag = stack.pop()[0]
        opened[tag] -= 1
        return tag

    def close(tag: str) -> None:
        # Only what is open is looked for, so that every element is passed once.
        if opened.get(tag):
            while leave() != tag:
                pass

    at = 0
    while True:
        m = _MARK.search(html, at)
        if not m:
            add(html[at:])
            break
        add(html[at : m.start()])
        at = m.end()
        if m[0].startswith("<![CDATA["):
            continue
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing = bool(m[1] or m[4])
        if tag in CONTROLS and stack[-1][1] == DOUBT:
            controls.add(stack[-1][2])
        if tag in RAW_TAGS:
            # The raw element's content is passed over; a head may lack its end tag.
            if not closing and not (m[3] or "").endswith("/"):
                end = re.compile(r"<body\b|</head\b[^>]*>" if tag == "head" else rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(html, at)
                if end:
                    at = end.start() if end[0].lower() == "<body" else end.end()
                elif tag in ("script", "style", "textarea", "title"):
                    at = len(html)
            continue
        if tag == "br":
            add(" ")
            continue
        if tag == "a":
            links = 0 if closing else 1
            continue
        if tag in VOID_TAGS and tag != "hr":
            continue
        if tag not in BLOCK_TAGS:
            # Inline elements matter only if they hold something apart.
            if not closing and m[3] and _place(tag, m[3], stack[-1][1]) != stack[-1][1]:
                enter(tag, _place(tag, m[3], stack[-1][1]))
                cut()
            elif closing and opened.get(tag):
                close(tag)
                cut()
            continue
        links = 0
        if closing:
            close(tag)
            cut()
        else:
            if tag in ("p", *HEADINGS) or (tag == "li" and stack[-1][0] == "p"):
                # A paragraph ends where the next one or a heading begins.
                if stack[-1][0] == "p" or (tag in HEADINGS and stack[-1][0] in HEADINGS):
                    leave()
            elif stack[-1][0] == "p":
                leave()
            if tag not in VOID_TAGS:
                enter(tag, _place(tag, m[3] or m[6] or "", stack[-1][1]))
            cut(tag in HEADINGS)
    cut()
    for b in out:
        b.text = _joined(b.parts)
    out = [b for b in out if b.text]
    _settle(out, controls)
    return out


def _settle(found: list[Block], controls: set[int]) -> None:
    """A part of an article named like a side part is one if it is mostly links, or has controls
    of a form, or no sentence; otherwise it belongs to the article."""
    parts: dict[int, list[Block]] = {}
    for b in found:
        if b.place == DOUBT:
            parts.setdefault(b.number, []).append(b)
    for number, part in parts.items():
        size, linked = sum(len(b.text) for b in part), sum(len(_joined(b.linked)) for b in part)
        side = number in controls or linked > MOST_LINKS * size or all(len(b.text) < SHORT_CHARS for b in part)
        for b in part:
            b.place = SIDE if side else ARTICLE


def _joined(parts: list[str]) -> str:
    return " ".join(unescape("".join(parts)).split())


def _has_stops(found: list[Block]) -> bool:
    """Whether the stop words are of the page's language: they are frequent in its longest blocks."""
    longest = sorted((b.text for b in found if b.place not in (SIDE, COMMENT)), key=len, reverse=True)[:LONGEST]
    counts = [_stops(t) for t in longest]
    return sum(s for s, _ in counts) >= LOW_STOPS * max(1, sum(n for _, n in counts))


def _is_latin(text: str) -> bool:
    others = 0 if text.isascii() else sum(map(len, _OTHER.findall(text)))
    return not others or 2 * others <= sum(map(len, _WORD.findall(text)))


def _measure(text: str) -> int:
    """Length in characters of an alphabet: those of East Asian scripts stand for several."""
    return len(text) if text.isascii() else len(text) + 2 * sum(map(len, _WIDE.findall(text)))


@lru_cache(64)
def _stops(text: str) -> tuple[int, int]:
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words), len(words)


def _label(block: Block, has_article: bool, has_stops: bool) -> str:
    if block.place in (SIDE, LIKELY, COMMENT) or (has_article and block.place != ARTICLE):
        return "bad"
    # Stop words say nothing about a block in another script.
    has_stops = has_stops and _is_latin(block.text)
    size = _measure(block.text)
    links = _measure(_joined(block.linked)) / size
    if links > MOST_LINKS:
        if block.place != ARTICLE:
            return "bad"
        plain = _joined([f"{p} " for p in block.plain])
        prose = _stops(plain)[0] >= LOW_STOPS * max(1, _stops(block.text)[1]) if has_stops else 3 * len(plain) >= size
        return "short" if prose or len(plain) >= SHORT_CHARS else "bad"
    if block.place == ARTICLE:
        return "good" if size >= SHORT_CHARS else "short"
    if size < SHORT_CHARS:
        return "bad" if links else "short"
    found, words = _stops(block.text)
    stops = found / max(1, words)
    if not has_stops or stops >= HIGH_STOPS:
        return "good" if size >= LONG_CHARS or stops >= HIGH_STOPS else "short"
    return "short" if stops >= LOW_STOPS else "bad"


def _has_article(found: list[Block], has_stops: bool) -> bool:
    """Whether articles hold at least half of the page's text that is not bad; settles nested ones."""
    article = sum(len(b.text) for b in found if b.place == ARTICLE)
    rest = sum(len(b.text) for b in found if b.place == NEITHER and _label(b, False, has_stops) != "bad")
    nested: dict[int, int] = {}
    for b in found:
        if b.place == NESTED:
            nested[b.number] = nested.get(b.number, 0) + len(b.text)
    for b in found:
        if b.place == NESTED:
            b.place = ARTICLE if nested[b.number] > article + rest else SIDE
    return 0 < article >= rest


def main_text(html: str | None) -> str:
    found = blocks(html) if html else []
    has_stops = _has_stops(found)
    has_article = _has_article(found, has_stops)
    for b in found:
        b.label = _label(b, has_article, has_stops)
    decided = [i for i, b in enumerate(found) if b.label != "short"]
    before = _nearest(found, range(len(found)))
    after = _nearest(found, range(len(found) - 1, -1, -1))
    for i, b in enumerate(found):
        if b.label != "short":
            continue
        if b.place == ARTICLE:
            # Bad blocks of other surroundings say nothing about an article's own.
            labels = [found[j].label for j in (before[i], after[i]) if j is not None and found[j].place == ARTICLE]
            good = not labels or "good" in labels or b.heading
        elif not decided:
            good = True
        else:
            near = [(abs(i - j), found[j].label != "good") for j in (before[i], after[i]) if j is not None]
            good = not min(near)[1]
        b.second = "good" if good else "bad"
    return "\n".join(b.text for b in found if (b.second or b.label) == "good")


def _nearest(found: list[Block], order: range) -> list[int | None]:
    """For each block the nearest decided one among those before it in ``order``."""
    out: list[int | None] = [None] * len(found)
    last: int | None = None
    for i in order:
        out[i] = last
        if found[i].label != "short":
            last = i
    return out


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages(page_id, url, html)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.selectExpr("CAST(page_id AS LONG) page_id", "CAST(url AS STRING) url", "CAST(html AS STRING) html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
