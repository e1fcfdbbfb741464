"""Main text of web pages by tag-path ratios.

A page is a row of blocks of text, each with the path of block elements from the root.  Per
path, the length of text and the number of punctuation marks are divided by the number of
nodes; the two ratios are smoothed along the page and fused, discounted by the share of text
inside links.  Paths above a share of the best fused value hold content, on every page.  In the
element around the best path a far smaller share is enough, so short paragraphs and headings stay.

Names and tags that mark menus, notices, adverts, comments and the like leave a block out where no
<article> or <main> is around it; inside one they only weigh on its path, as <article> and <main>
themselves do.  Links never leave a single block out; they count for its path.

Null and empty pages, and pages without text, have an empty text and 0 characters.  Nothing is
cut or dropped for length; repeated rows are extracted each.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from concordat.llm.common import text_blocks

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>|"
                    r"<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)>", re.S)
_NAMES = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|visibility\s*:\s*hidden|aria-hidden\s*=\s*[\"']?true", re.I)
#: Elements whose content is not text.
RAW = {"script", "style", "template", "noscript", "iframe", "svg", "math", "object", "canvas", "textarea", "select", "option", "datalist", "head", "audio", "video", "button"}
BLOCKS = {
    "html", "body", "address", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "legend", "li", "main", "menu", "nav", "ol", "p", "pre",
    "search", "section", "summary", "table", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: An element that ends an open one of these kinds, looked for up to the given containers.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
}
#: Elements and names that mark what stands around the main text.
ASIDE = {"nav", "footer", "aside", "form", "header", "menu", "dialog", "search", "fieldset"}
NAMED = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertisements", "sponsor", "sponsored", "banner", "promo", "promotion", "nav", "navbar", "navigation",
    "menu", "breadcrumb", "breadcrumbs", "sidebar", "side", "aside", "widget", "footer", "masthead", "topbar", "header", "toolbar", "cookie", "cookies", "consent", "gdpr",
    "notice", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "form", "search", "share", "sharing", "social", "follow",
    "related", "recommended", "recommendations", "trending", "pagination", "pager", "comment", "comments", "commentlist", "disqus", "discussion", "reply", "replies", "respond",
    "copyright", "legal", "skip", "tags", "contentinfo", "complementary", "privacy", "outbrain", "taboola",
}
_MARKS = re.compile(r"[.,;:!?…。，、！？；：]")


@dataclass
class Element:
    tag: str
    parent: Element | None
    label: str  # path from the root
    outside: bool  # it or an element around it is hidden, or marked as not the main text and not in an article
    article: bool
    marked: bool = False  # it or an element around it, inside the article, is marked as not the main text


@dataclass
class Block:
    element: Element
    text: str
    linked: int


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order, with white space made plain."""
    root = Element("", None, "", False, False)
    at, found, parts, linked, links, place, skip = root, [], [], 0, 0, 0, None


    def close() -> None:
        nonlocal parts, linked
        text = " ".join(html_lib.unescape("".join(parts)).split()) if parts else ""
        if text:
            found.append(Block(at, text, linked))
        parts, linked = [], 0

    while token := _TOKEN.search(page, place):
        if skip is None and token.start() > place:
            text = page[place : token.start()]
            parts.append(text)
            linked += len(text) if links else 0
        place = token.end()
        ending, tag, attributes = (token[1], token[2], token[3]) if token[2] else (token[4], token[5], token[6] or "")
        tag = (tag or "").lower()
        if skip is not None:  # inside an element without text, up to its end
            if not (ending and tag == skip or skip == "head" and tag == "body" and not ending):
                continue
            skip = None
            if ending:
                continue
        if not tag:
            continue
        if tag in RAW and not ending:
            if attributes.endswith("/") and tag in ("svg", "math", "object", "canvas"):
                continue
            if tag in ("script", "style", "textarea"):  # what looks like a tag inside is text
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, place)
                place = end.end() if end else len(page)
            else:
                skip = tag
            continue
        if tag == "br" or tag == "hr":
            parts.append(" ")
        elif tag == "a":
            links = 0 if ending else 1
        if tag not in BLOCKS:
            continue
        close()
        links = 0
        if ending:
            open_one = at
            while open_one.parent is not None and open_one.tag != tag:
                open_one = open_one.parent
            if open_one.parent is not None:
                at = open_one.parent
            continue
        if at.tag == "p" or at.tag in ("h1", "h2", "h3", "h4", "h5", "h6") and tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            at = at.parent
        if tag in ENDS:
            kinds, limits = ENDS[tag]
            open_one = at
            while open_one.parent is not None and open_one.tag not in limits and open_one.tag not in kinds:
                open_one = open_one.parent
            if open_one.tag in kinds:
                at = open_one.parent
        names = [m[1] or m[2] or m[3] or "" for m in _NAMES.finditer(attributes)]
        words = {w.lower() for name in names for w in _WORDS.findall(name)}
        whole = {w for name in names for w in name.lower().split()}
        named = NAMED & (words | whole)
        if at.article:  # there, a header is the article's own
            named = named - {"header"}
        marked = tag in ASIDE and not (tag == "header" and at.article) or bool(named) and tag not in ("html", "body", "article", "main")
        hidden = bool(attributes) and bool(_HIDDEN.search(attributes))
        main = tag in ("article", "main") or "main" in words and "role" in attributes
        at = Element(tag, at, f"{at.label}/{tag}" + "".join(f".{w}" for w in sorted(whole)), at.outside or hidden or marked and not at.article,
                     at.article or main, at.marked or marked and at.article)
    if skip is None and place < len(page):
        parts.append(page[place:])
    close()
    return found


def main_blocks(blocks: list[Block], share: float = 0.2, around_share: float = 0.02, article: float = 1.5, marked: float = 0.3) -> list[Block]:
    """The blocks of the main text, by smoothed and fused ratios of their tag paths.

    ``article`` and ``marked`` weigh on the value of paths inside <article> or <main>, and of those marked inside it.
    """
    inside = [b for b in blocks if not b.element.outside]
    if not inside:
        return []
    sums: dict[str, list[float]] = {}
    for b in inside:
        s = sums.setdefault(b.element.label, [0, 0, 0, 0])
        for k, v in enumerate((len(b.text), len(_MARKS.findall(b.text)), b.linked, 1)):
            s[k] += v
    ratios = [(s[0] / s[3], s[1] / s[3], 1 - s[2] / max(1, s[0])) for s in (sums[b.element.label] for b in inside)]
    weights = (0.25, 0.5, 0.25)

    def smoothed(values: list[float]) -> list[float]:
        padded = [values[0], *values, values[-1]]
        return [sum(w * padded[i + k] for k, w in enumerate(weights)) for i in range(len(values))]

    length, marks, plain = (smoothed([r[k] for r in ratios]) for k in range(3))
    fused: dict[str, list[float]] = {}
    for b, n, m, p in zip(inside, length, marks, plain):
        fused.setdefault(b.element.label, []).append(math.sqrt(n * (1 + m)) * p)
    weight = {b.element.label: (article if b.element.article else 1) * (marked if b.element.marked else 1) for b in inside}
    value = {path: weight[path] * sum(v) / len(v) * math.log(2 + sums[path][0]) for path, v in fused.items()}
    best = max(value, key=lambda path: (value[path], path))
    if not value[best]:  # nothing but links
        return []
    # around the best path: its container, so that headings and short paragraphs stay
    holder = {id(b.element.parent) for b in inside if b.element.label == best}
    around = {id(b.element) for b in inside if b.element.label == best and b.element.tag not in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6")}

    def within(element: Element) -> bool:
        step = element
        while step is not None:
            if id(step) in around or id(step.parent) in holder and step.parent is not None:
                return True
            step = step.parent
        return False

    def holds(b: Block) -> bool:
        least = around_share if not b.element.marked and within(b.element) else share
        return value[b.element.label] >= least * value[best]

    return [b for b in inside if holds(b)]


def main_text(page: str | None) -> str:
    return "\n\n".join(b.text for b in main_blocks(blocks_of(page))) if page else ""


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row; reads page_id, url and html only."""
    id_type = pages.schema["page_id"].dataType.simpleString()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "html"):
            texts = [main_text(h) for h in block.column("html").to_pylist()]
            yield pa.RecordBatch.from_pydict({"page_id": block.column("page_id"), "url": block.column("url"), "text": pa.array(texts, pa.string()),
                                              "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return pages.select("page_id", "url", "html").mapInArrow(extract, f"page_id {id_type}, url string, text string, n_chars long")
