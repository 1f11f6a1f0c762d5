"""Main text of web pages as a maximum-scoring subsequence of words and tags.

A page is read into a sequence of units: words, and opening or closing tags. Words score positive and tags
negative; one linear scan finds the contiguous run with the largest sum. The weights are log odds counted on
labelled pages: pages that mark their content with exactly one ``article`` or ``main`` element label every unit
as inside or outside of it. The run is then widened to the innermost content container around it (``article``,
``main``, or a ``div``/``section``/``td`` that is not boilerplate), so that short blocks at its edges are not lost. Articles beside
that one are taken too if they score above zero. Where no
``article`` or ``main`` is around it, every block beside it or beside an element around it that scores above zero is taken too.

Boilerplate elements (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments)
are known by tag name, role or words in class, id and aria-label (fixed lists: where they stand in labelled pages says nothing about
adverts inside an article). Words that may name a subject, such as "legal", mark blocks only, never a paragraph. Their text scores strongly negative and never reaches the
output, also inside the run. Character references are decoded, white space inside a block becomes one space, and
blocks are joined in page order by one space. Nothing else is dropped, whatever the length.

Edge cases: a null, empty or tag-only page gives ''; a page without any tag is all content; unclosed and
stray tags are tolerated (an unclosed boilerplate element ends with the element around it); equal scores take the
earlier run; without labelled pages fixed weights apply; repeated rows are extracted each; other columns do not matter,
but one with the result's name is replaced. The work is linear in the page's length and depth.
"""

from __future__ import annotations

import bisect
import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<(?:[a-zA-Z/!?])(?:[^<>"']|"[^"]*"|'[^']*')*>|<[a-zA-Z/!?][^<>]*>|[^<]+|<""", re.S)
NAME = re.compile(r"</?\s*([a-zA-Z][a-zA-Z0-9:-]*)")
ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?|"[^"]*"|'[^']*'""")      # in order, so that values are never read as names
# fixed values of HTML
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label",
          "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
BOILERPLATE = {"nav", "header", "footer", "aside", "form", "button", "select", "option", "dialog", "menu", "head", "fieldset", "audio", "video", "canvas",
               "input"} | RAW
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form", "toolbar", "status"}
MARKED = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "breadcrumb", "breadcrumbs", "comment",
          "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation",
          "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo", "promoted", "recommended", "related", "replies", "respond",
          "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget", "login", "search", "alert",
          "feedback", "discussion", "reactions", "skip", "topbar", "copyright", "legal", "disclaimer", "paywall", "teaser", "author-box", "tags"}
# words of MARKED that may as well name what a text is about: they mark blocks, not paragraphs, headings, items or parts of a line
TOPICS = {"legal", "search", "tags", "feedback", "discussion", "disclaimer", "alert", "notice", "notices", "social", "share", "related", "skip", "teaser",
          "reactions", "recommended", "replies", "login", "banner", "menu", "comment", "header"}
ABOUT = {"article", "body", "content", "entry", "main", "page", "post", "text"}     # before "header": the content's own title
LAYOUT = {"has", "no", "with", "without", "not"}                                    # a layout beside something, such as "content-with-sidebar"
CONTENT = {"article", "main"}
CONTAINERS = CONTENT | {"div", "section", "td", "body"}
KNOWN = INLINE | BOILERPLATE | CONTAINERS | VOID | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "tr", "th",
                                                    "tbody", "thead", "tfoot", "blockquote", "pre", "figure", "figcaption", "html", "center", "address"}
PROSE = INLINE | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "tr", "blockquote", "pre", "figcaption"}
# closing rules for elements whose end tag may be missing
ENDS = {"p": {"p", "div", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "main", "aside", "footer", "header", "nav", "form",
              "blockquote", "pre", "dl", "figure"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"},
        "th": {"td", "th", "tr"}, "option": {"option"}}
DEFAULT = {"word": 1.0, "link": 0.1, "tag": -2.0}
HIDDEN = -4.0        # a word or tag in boilerplate


class Unit:
    """One word run or tag: what it is, where it stands, and the element path around it."""

    __slots__ = ("text", "kind", "hidden", "box", "breaks", "words")

    def __init__(self, text: str, kind: str, hidden: bool, box: int, breaks: bool, words: int):
        self.text, self.kind, self.hidden, self.box, self.breaks, self.words = text, kind, hidden, box, breaks, words


def _marks(word: str, name: str) -> bool:
    """Whether a word of class, id or label marks an element of that name as boilerplate.

    Any part of a compound does, so that "post-comments", "article-footer" and "sidebar-content" are known.
    """
    parts = re.split(r"[-_:]+", word)
    if LAYOUT & set(parts) or parts[-1] == "header" and ABOUT & set(parts[:-1]):
        return False
    found = {p for p in [word, *parts] if p in MARKED}
    return bool(found) and not (name in PROSE and found <= TOPICS)


def _is_boilerplate(name: str, tag: str) -> bool:
    if name in BOILERPLATE:
        return True
    if name in {"html", "body"} | CONTENT:
        return False
    for m in ATTR.finditer(tag, len(name) + 1):
        key = (m.group(1) or "").lower()
        value = (m.group(2) or "").strip("\"'").lower()
        if key == "role" and value in ROLES or key == "hidden" and value in ("", "hidden", "true"):
            return True
        if key in ("class", "id", "aria-label") and any(_marks(word, name) for word in value.split()):
            return True
    return False


def units(page: str) -> tuple[list[Unit], list[tuple[str, int, bool]]]:
    """The page's units, and its elements as (name, parent, boilerplate)."""
    boxes: list[tuple[str, int, bool]] = [("", -1, False)]
    stack, out, pos = [0], [], 0
    opened: Counter = Counter()                                   # how many elements of a name are open
    n = len(page)
    while pos < n:
        m = TOKEN.match(page, pos)
        token, pos = m.group(), m.end()
        name = NAME.match(token) if token[0] == "<" and len(token) > 1 else None
        if name is None:
            if token.startswith("<![CDATA["):
                token = token[9:-3]
            elif token[0] == "<" and len(token) > 1:
                continue                                      # comment, doctype, processing instruction
            else:
                token = html.unescape(token)
            words = len(token.split())
            link = any(boxes[b][0] == "a" for b in stack[-4:])
            if token:
                out.append(Unit(token, "link" if link else "word", boxes[stack[-1]][2], stack[-1], False, words))
            continue
        tag = name.group(1).lower()
        if token[1] != "/":
            while boxes[stack[-1]][0] in ENDS and tag in ENDS[boxes[stack[-1]][0]]:
                opened[boxes[stack.pop()][0]] -= 1
            hidden = boxes[stack[-1]][2] or _is_boilerplate(tag, token)
            out.append(Unit("", tag if tag in KNOWN else "other", hidden, stack[-1], tag not in INLINE, 0))
            if tag in RAW:
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, pos)
                pos = end.end() if end else n
            elif tag not in VOID and not token.endswith("/>"):
                boxes.append((tag, stack[-1], hidden))
                stack.append(len(boxes) - 1)
                opened[tag] += 1
        else:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if boxes[stack[k]][0] == tag), 0) if opened[tag] else 0
            hidden = boxes[stack[-1]][2]
            # an inline end tag does not close blocks around it
            if depth and not (tag in INLINE and any(boxes[b][0] not in INLINE for b in stack[depth + 1:])):
                opened.subtract(boxes[b][0] for b in stack[depth:])
                del stack[depth:]
            out.append(Unit("", tag if tag in KNOWN else "other", hidden, stack[-1], tag not in INLINE, 0))
    return out, boxes


def _lasts(boxes: list[tuple[str, int, bool]]) -> list[int]:
    """The last element inside each. Elements are numbered as they open, so what is inside one is a range."""
    last = list(range(len(boxes)))
    for b in range(len(boxes) - 1, 0, -1):
        last[boxes[b][1]] = max(last[boxes[b][1]], last[b])
    return last


def counts(page: str) -> Counter:
    """Units inside and outside the one content element of a labelled page; nothing for other pages."""
    seq, boxes = units(page or "")
    marked = [i for i, b in enumerate(boxes) if b[0] in CONTENT and not b[2]]
    if len(marked) != 1:
        return Counter()
    out: Counter = Counter()
    low, high = marked[0], _lasts(boxes)[marked[0]]
    for u in seq:
        if u.kind not in CONTENT:
            inside = not u.hidden and low <= u.box <= high
            out[u.kind, inside] += u.words if u.kind in ("word", "link") else 1
    return out


def weights(table: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log odds of a unit in content; words are kept positive and tags negative."""
    if not table:
        return dict(DEFAULT)
    total = {s: sum(n for (_, inside), n in table.items() if inside == s) + 20 for s in (True, False)}
    out = dict(DEFAULT)
    for kind in {k for k, _ in table}:
        odds = _log((table.get((kind, True), 0) + 1) / total[True]) - _log((table.get((kind, False), 0) + 1) / total[False])
        out[kind] = max(0.2, odds) if kind == "word" else max(-2.0, min(0.5, odds)) if kind == "link" else min(-0.2, max(-4.0, odds))
    return out


def _log(x: float) -> float:
    from math import log
    return log(x)


def _score(u: Unit, weight: dict[str, float]) -> float:
    w = weight.get(u.kind, weight["tag"])
    return w * u.words if u.kind in ("word", "link") else w


def _without_content(seq: list[Unit], boxes: list[tuple[str, int, bool]], box: int, end: int, low: int, high: int, weight: dict[str, float]) -> list[Unit]:
    """The run to the ends of its blocks, and every other block beside it or beside an element around it that scores above zero.

    A block is an element that is not inline, or the text between such elements; boilerplate neither counts nor costs.
    """
    path = [box]
    while path[-1] > 0:
        path.append(boxes[path[-1]][1])
    around, last = set(path), path[-1]
    block: list[tuple[int, int]] = []
    top = {b: b for b in around}                       # outermost element that is not inline and not around the run
    for b in range(len(boxes)):
        if b not in around:
            up = top[boxes[b][1]]
            top[b] = up if up not in around or boxes[b][0] in INLINE else b
    stretch = 0
    for i, u in enumerate(seq):
        at = top[u.box]
        if i and (at in around) and (u.breaks or top[seq[i - 1].box] != at):
            stretch += 1
        block.append((at, stretch if at in around else 0))
    total: dict[tuple[int, int], float] = {}
    for i, u in enumerate(seq):
        if not u.hidden:
            inside = box != last and boxes[box][0] != "body" and box <= u.box <= end
            total[block[i]] = total.get(block[i], 0.0) + (float("inf") if inside or low <= i < high and u.words else _score(u, weight))
    return [u for i, u in enumerate(seq) if u.hidden or u.breaks or total.get(block[i], 0.0) > 0]


def best_run(seq: list[Unit], weight: dict[str, float]) -> tuple[int, int]:
    """Bounds of the contiguous run with the largest score; (0, 0) if none is positive."""
    best, at, run, start = 0.0, (0, 0), 0.0, 0
    for i, u in enumerate(seq):
        score = HIDDEN * max(1, u.words) if u.hidden else _score(u, weight)
        if run <= 0:
            run, start = 0.0, i
        run += score
        if run > best:
            best, at = run, (start, i + 1)
    return at


def main_text(page: str | None, weight: dict[str, float]) -> str:
    """The page's content as one line of text."""
    if not page:
        return ""
    seq, boxes = units(page)
    low, high = best_run(seq, weight)
    if low == high:
        return ""
    # the innermost container that holds the whole run
    last = _lasts(boxes)
    held = [u.box for u in seq[low:high] if u.words and not u.hidden]
    first, final, box = min(held), max(held), held[0]
    while box > 0 and not (boxes[box][0] in CONTAINERS and box <= first and final <= last[box]):
        box = boxes[box][1]
    around = box
    while around > 0 and boxes[around][0] not in CONTENT:
        around = boxes[around][1]
    if around > 0:
        # with the elements of the same kind beside it, as far as they score above zero
        total = {b: 0.0 for b, (name, parent, hidden) in enumerate(boxes) if not hidden and (name, parent) == boxes[around][:2]}
        starts = sorted(total)
        total[around] = float("inf")
        spans = []
        for u in seq:
            at = bisect.bisect_right(starts, u.box) - 1
            if at >= 0 and u.box <= last[starts[at]]:
                spans.append((starts[at], u))
                total[starts[at]] += 0.0 if u.hidden else _score(u, weight)
        spans = [u for b, u in spans if total[b] > 0]
    elif not any(b[0] for b in boxes[1:]):
        spans = seq
    else:
        spans = _without_content(seq, boxes, box, last[box], low, high, weight)
    parts = []
    for u in spans:
        if u.hidden:
            parts.append(" ")
        elif u.breaks:
            parts.append(" ")
        elif u.text:
            parts.append(u.text)
    return " ".join("".join(parts).split())


def fit(pages: DataFrame, column: str = "html") -> dict[str, float]:
    """Weights from all labelled pages; the counts form one row per unit kind."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            total: Counter = Counter()
            for page in f["page"]:
                total.update(counts(page))
            yield pd.DataFrame([(k, s, n) for (k, s), n in total.items()], columns=["kind", "inside", "n"]).astype({"kind": object, "inside": bool, "n": "int64"})

    rows = (pages.select(F.col(column).alias("page")).where(F.col("page").isNotNull())
            .mapInPandas(count, "kind string, inside boolean, n long").groupBy("kind", "inside").agg(F.sum("n").alias("n")).collect())
    return weights({(r["kind"], r["inside"]): r["n"] for r in rows})


def extract(pages: DataFrame, weight: dict[str, float], column: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with the main text in ``name``."""

    @F.pandas_udf("string")
    def text(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, weight) for p in pages], dtype=object)

    return pages.withColumn(name, text(F.col(column)))
