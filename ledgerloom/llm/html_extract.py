"""Main-text extraction by tag-path ratios.

A page is read as text nodes with their root-to-leaf tag paths. For each path, text length and punctuation over its nodes give two ratios; both are
smoothed along the page, fused and thresholded, which marks the content nodes wherever they stand. Short nodes such as headings, list items and cells are
kept beside content nodes of their container. Tags and names are an extra signal: nodes outside article and main count half (on pages
without those, nodes outside the element that holds nearly all content), and elements named as page furniture (menus, adverts, forms, comments and the like) are dropped unless they hold the article.
"""

from __future__ import annotations

import bisect
import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# Element names and the words that name page furniture in class, id and role.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
FURNITURE = {"aside", "button", "dialog", "footer", "form", "head", "menu", "nav", "object", "search", "select"}
NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "adsense", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "copyright", "dialog", "disclaimer", "discuss", "discussion", "discussions", "disqus", "feedback", "guestbook", "footer", "form", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "pager", "pagination", "popup", "promo", "promotion", "reactions", "recommended", "related", "replies", "reply", "respond", "responses", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
#: Start tags that end an open element of the second set, no further out than the third.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
}
PUNCTUATION, QUOTES = ".,;:!?。，！？", "\"'"
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements whose text may be short by nature; those that belong to their place even in a container of their own; and what is passed on the way to the container.
TEXTUAL = {"p", "li", "dt", "dd", "td", "th", "caption", "figcaption", "pre", "blockquote", "summary", "legend"} | HEADINGS
FIXED = {"td", "th", "caption", "figcaption", "pre"}
WRAPPERS = {"ul", "ol", "dl", "dir", "li", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "figure", "figcaption", "blockquote", "header", "hgroup", "details", "center"}
#: Mean characters and punctuation marks from which a path is prose in full; share of the page's best node that content reaches; factor outside the main container.
PROSE, SHARE, OUTSIDE = (200.0, 4.0), 0.4, 0.5

_RAW = re.compile(r"<(script|style|noscript|template|textarea|title|iframe|annotation-xml|annotation)\b", re.IGNORECASE)
_SVG = re.compile(r"<svg\b", re.IGNORECASE)
# A drawing ends at its end tag or at an HTML element, which can't stand in it.
_DRAWN = re.compile(r"</svg|</?(?:p|div|h[1-6]|ul|ol|li|dl|dd|dt|table|pre|blockquote|center|body|article|section|main|span|b|i|em|strong|br|img)\b", re.IGNORECASE)
_NAME = re.compile(r"</?[a-z][^\s/>]*+", re.IGNORECASE)
_COMMENT_END = re.compile(r"--!?>")
_ATTR = re.compile(r"""\b(class|id|role|style|aria-hidden|hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_CLASS = re.compile(r"""\bclass\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
# How reader comments are dated and what they offer, in English, German, French and Spanish.
_DATED = re.compile(r"\d{4}-\d\d-\d\d|\d{1,2}[./]\d{1,2}[./]\d{2,4}|\b\d{1,2}:\d\d\b|\bago\b|\bvor \d|\bil y a\b|\bhace \d|\b\d{1,2}\.? (?:de )?(?:jan|feb|mar|mär|apr|abr|avr|may|mai|jun|jui|jul|aug|ago|aoû|sep|oct|okt|nov|dec|dez|déc|dic)", re.IGNORECASE)
_ANSWERED = re.compile(r"\b(?:reply|replies|report|like|upvote|permalink|antworten|melden|gefällt|répondre|signaler|j'aime|responder|denunciar|me gusta)\b", re.IGNORECASE)


class _Scanner:
    """The tags, comments, scripts and drawings of a page in linear time: whether a quote or tag is ever closed is looked up, and no stretch is searched again for each tag before it."""

    def __init__(self, source: str):
        self.source = source
        self._marks = [m.start() for m in re.finditer("['\">]", source)]
        self._each = {c: [p for p in self._marks if source[p] == c] for c in "'\">"}
        self._known: dict[int, int] = {}  # mark met outside of quotes -> end of the tag, or -1

    def _next(self, marks: list[int], at: int) -> int:
        n = bisect.bisect_left(marks, at)
        return marks[n] if n < len(marks) else -1

    def _attrs_end(self, at: int) -> int:
        """The `>` that ends a tag whose attributes begin here, or -1 if a quote or the tag isn't closed."""
        met, end = [], -1
        while (p := self._next(self._marks, at)) >= 0:
            if p in self._known:
                end = self._known[p]
                break
            met.append(p)
            if self.source[p] == ">":
                end = p
                break
            q = self._next(self._each[self.source[p]], p + 1)
            if q < 0:
                break
            at = q + 1
        for p in met:
            self._known[p] = end
        return end

    def _token(self, i: int):
        """(end, kind, name, attributes) of what begins at a `<`, or None."""
        source = self.source
        if source.startswith("<!--", i):
            if source.startswith((">", "->"), i + 4):
                return source.index(">", i) + 1, "comment", "", ""
            m = _COMMENT_END.search(source, i + 4)
            return (m.end() if m else len(source)), "comment", "", ""
        if m := _RAW.match(source, i):
            end = self._attrs_end(m.end())
            if end >= 0:
                close = re.compile(f"</{m[1]}", re.IGNORECASE).search(source, end + 1)
                last = self._next(self._each[">"], close.end()) if close else -1
                return (last + 1 if last >= 0 else len(source)), "hidden", "", ""
        elif m := _SVG.match(source, i):
            end = self._attrs_end(m.end())
            if end >= 0:
                if source[end - 1] == "/":
                    return end + 1, "hidden", "", ""
                close = _DRAWN.search(source, end + 1)
                if close and close[0].lower() != "</svg":
                    return close.start(), "hidden", "", ""
                last = self._next(self._each[">"], close.end()) if close else -1
                return (last + 1 if last >= 0 else len(source)), "hidden", "", ""
        closing = self._next(self._each[">"], i)
        if closing < 0:
            return None
        if m := _NAME.match(source, i):
            end = self._attrs_end(m.end())
            end = end if end >= 0 else self._next(self._each[">"], m.end())
            return (end + 1, "tag", m[0][1:].lower(), source[m.end() : end]) if end >= 0 else None
        return (closing + 1, "comment", "", "") if source[i + 1 : i + 2] in ("!", "?", "/") else None

    def tokens(self):
        i, last = self.source.find("<"), self._each[">"][-1] if self._each[">"] else -1
        while i >= 0:
            token = self._token(i)
            if token:
                yield i, *token
                i = self.source.find("<", token[0])
            else:
                i = self.source.find("<", i + 1) if i < last else self.source.find("<!--", i + 1)


def _is_furniture(tag: str, attrs: str, inside: bool) -> bool:
    """inside: the element stands in an article or main element, where a header is the article's own."""
    if tag in FURNITURE or tag == "header" and not inside:
        return True
    if tag in ("html", "body", "main", "article") or "=" not in attrs and "hidden" not in attrs.lower():
        return False
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE):
            return True
        if name in ("class", "id", "role"):
            words = {w.lower() for w in _NAME_WORD.findall(value)}
            if words & NAMES or "header" in words and not inside:
                return True
    return False


class _Page:
    """Blocks of a page: raw text, element number, characters in links; and per element its parent, tag and path."""

    def __init__(self, source: str):
        self.parent, self.tag, self.named, self.path, self.inside = [-1], ["#"], [False], [0], [False]
        self._numbers: dict[tuple[int, str], int] = {}  # a path is the number of its parent's path and a tag
        self.blocks: list[tuple[str, int, int]] = []
        self.look = ["#"]  # tag and class
        self._stack, self._text, self._linked, self._owner, self._in_link = [0], [], 0, 0, 0
        self._inline: Counter[str] = Counter()
        self._where: dict[str, list[int]] = {}  # places of open elements in the stack, by tag
        at = 0
        for start, end, kind, name, attrs in _Scanner(source).tokens():
            self._add(source[at:start])
            at = end
            if kind == "tag":
                if name[0] == "/":
                    self._close(name[1:])
                else:
                    self._open(name, attrs)
            elif kind == "hidden":
                self._text.append(" ")
        self._add(source[at:])
        self._flush()
        self._mark_conversations()

    def _add(self, text: str) -> None:
        if text:
            self._text.append(text)
            self._linked += len(text) * bool(self._in_link)

    def _flush(self) -> None:
        if self._text:
            text = " ".join(html.unescape("".join(self._text)).split())
            if text:
                self.blocks.append((text, self._stack[-1], min(self._linked, len(text))))
        self._text, self._linked = [], 0

    def _open(self, tag: str, attrs: str) -> None:
        if tag == "br" or tag in BLOCKS:
            self._flush()
        if tag in VOID:
            return
        if tag not in BLOCKS and not _is_furniture(tag, attrs, True):
            self._in_link += tag == "a"
            self._inline[tag] += 1
            return
        if tag in CLOSES:
            self._end(*CLOSES[tag])
        elif self.tag[self._stack[-1]] == "p":
            self._pop()
        above = self._stack[-1]
        inside = self.inside[above]
        self._flush()
        self.parent.append(above)
        self.tag.append(tag)
        self.named.append(_is_furniture(tag, attrs, inside))
        self.path.append(self._numbers.setdefault((self.path[above], tag), len(self._numbers) + 1))
        self.inside.append(inside or tag in ("article", "main"))
        named = _CLASS.search(attrs) if "=" in attrs else None
        self.look.append(f"{tag} {named[1].strip(QUOTES).lower()}" if named else tag)
        self._where.setdefault(tag, []).append(len(self._stack))
        self._stack.append(len(self.tag) - 1)
        self._inline, self._in_link = Counter(), 0

    def _mark_conversations(self) -> None:
        """Reader comments go by their shape, whatever their names: like elements side by side, each with a dated line and one that offers an answer, after other text of at least a third of theirs."""
        n = len(self.tag)
        dated, answered, size, free = [0] * n, [0] * n, [0] * n, [0] * n
        for text, e, linked in self.blocks:
            size[e] += len(text) - linked
            if len(text) <= 120:
                dated[e] += bool(_DATED.search(text))
                answered[e] += bool(_ANSWERED.search(text))
        if not any(dated) or not any(answered):
            return
        for e in range(n - 1, 0, -1):
            dated[self.parent[e]] += dated[e]
            answered[self.parent[e]] += answered[e]
        hidden, before = [False] * n, 0
        for e in range(1, n):
            hidden[e] = self.named[e] or hidden[self.parent[e]]
            free[e] = before  # text outside furniture in elements that begin further up
            before += size[e] * (not hidden[e])
        for e in range(n - 1, 0, -1):
            size[self.parent[e]] += size[e]
        groups: dict[tuple[int, str], list[int]] = {}
        for e in range(1, n):
            if dated[e] and answered[e] and self.tag[e] not in ("html", "body", "main", "article", "tr", "td"):
                groups.setdefault((self.parent[e], self.look[e]), []).append(e)
        for alike in groups.values():
            if len(alike) > 1 and 3 * free[alike[0]] >= sum(size[e] for e in alike):
                for e in alike:
                    self.named[e] = True

    def dropped(self) -> list[bool]:
        """Elements that are furniture by name or lie in such an element.

        A name says nothing about an element that holds more article or main text than stands free, or half of the text of a page without those.
        """
        size, inside = range(len(self.tag)), self.inside
        text, told = [0] * len(self.tag), [0] * len(self.tag)
        for t, e, linked in self.blocks:
            text[e] += len(t) - linked
            told[e] += (len(t) - linked) * inside[e]
        free = told[:]  # without what lies in furniture further in
        for e in reversed(size[1:]):
            text[self.parent[e]] += text[e]
            told[self.parent[e]] += told[e]
            free[self.parent[e]] += free[e] * (not self.named[e])
        out, standing = [False] * len(self.tag), free[0]
        for e in size[1:]:
            out[e] = out[self.parent[e]]
            if self.named[e] and not out[e]:
                if told[e] > standing if told[0] else text[e] and 2 * text[e] >= text[0]:
                    standing += free[e]
                else:
                    out[e] = True
        return out

    def _pop(self) -> None:
        self._flush()
        self._where[self.tag[self._stack.pop()]].pop()
        if self._inline or self._in_link:
            self._inline, self._in_link = Counter(), 0

    def _last(self, tags: set[str]) -> int:
        """Place of the innermost open element of these tags, 0 if there is none."""
        return max((places[-1] for t in tags if (places := self._where.get(t))), default=0)

    def _end(self, tags: set[str], stop: set[str]) -> None:
        while (at := self._last(tags)) > self._last(stop):
            while len(self._stack) > at:
                self._pop()

    def _close(self, tag: str) -> None:
        if tag in BLOCKS:
            self._flush()
        if self._inline and tag not in BLOCKS:
            if self._inline[tag] > 0:
                self._inline[tag] -= 1
                self._in_link -= tag == "a"
            self._inline = +self._inline
            return
        at = self._last({tag})
        while at and len(self._stack) > at:
            self._pop()


def content_nodes(lengths: np.ndarray, marks: np.ndarray, paths: np.ndarray, prior: np.ndarray | float = 1.0) -> np.ndarray:
    """Which nodes are content. lengths, marks: characters outside links and punctuation marks of each node; paths: its path's number; prior: its factor.

    The two ratios are the means over all nodes of a path. Neighbours on the page count in the smoothing by their distance, those of another path a quarter.
    """
    n = np.bincount(paths)
    mean = (np.bincount(paths, lengths) / n)[paths]
    text = np.sqrt(np.minimum(mean, PROSE[0]))
    punctuation = np.sqrt(np.minimum(np.bincount(paths, marks) / n, PROSE[1]))[paths]
    near = [(k, np.where(paths[k:] == paths[:-k], 1.0, 0.25) * (3 - k)) for k in (1, 2) if len(paths) > k]

    def smooth(x):
        total, weight = 3 * x, np.full(len(x), 3.0)
        for k, w in near:
            total[k:] += w * x[:-k]
            total[:-k] += w * x[k:]
            weight[k:] += w
            weight[:-k] += w
        return total / weight

    fused = np.sqrt(text * smooth(text)) * (0.25 + np.sqrt(punctuation * smooth(punctuation))) * prior
    # Text that is long without any punctuation counts as well.
    return (fused >= SHARE * min(fused.max(), np.sqrt(PROSE[0]) * (0.25 + np.sqrt(PROSE[1])))) | (mean * prior >= PROSE[0])


def main_text(source: str | None) -> str:
    """The article's text, one line per block; empty for a page without any."""
    if not source:
        return ""
    page = _Page(source)
    dropped = page.dropped()
    blocks = [b for b in page.blocks if not dropped[b[1]]]
    if not blocks:
        return ""
    number: dict[int, int] = {}
    paths = np.array([number.setdefault(page.path[e], len(number)) for _, e, _ in blocks])
    lengths = np.array([len(t) - linked for t, _, linked in blocks], float)
    marks = np.array([sum(map(t.count, PUNCTUATION)) for t, _, _ in blocks], float)
    inside = np.array([page.inside[e] for _, e, _ in blocks])
    near = inside if lengths[inside].any() else _in_container(page, blocks, content_nodes(lengths, marks, paths), lengths)
    chosen = content_nodes(lengths, marks, paths, np.where(near, 1.0, OUTSIDE))
    return "\n".join(t for (t, _, _), c in zip(blocks, _with_short_nodes(page, blocks, chosen, inside, lengths), strict=True) if c)


def _in_container(page: _Page, blocks: list[tuple[str, int, int]], chosen: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which nodes lie in the deepest element with nearly all content text, and never in a lone paragraph only."""
    weight = np.zeros(len(page.tag))
    np.add.at(weight, np.array([e for (_, e, _), c in zip(blocks, chosen, strict=True) if c]), lengths[chosen] + 1)
    for e in range(len(page.tag) - 1, 0, -1):
        weight[page.parent[e]] += weight[e]
    container = int(np.flatnonzero(weight >= 0.9 * weight[0])[-1])
    while container > 0 and page.tag[container] not in ("div", "section", "body", "td", "html"):
        container = page.parent[container]
    within = np.zeros(len(page.tag), bool)
    within[container] = True
    for e in range(container + 1, len(page.tag)):
        within[e] = within[page.parent[e]]
    return within[[e for _, e, _ in blocks]]


def _with_short_nodes(page: _Page, blocks: list[tuple[str, int, int]], chosen: np.ndarray, inside: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The chosen nodes and, whatever their ratios, the headings, lines, list items, cells and captions that stand beside them in one container.

    Outside article and main, nodes that are links only must also lie between chosen ones.
    """
    holds = [False] * len(page.tag)
    for (_, e, _), c in zip(blocks, chosen, strict=True):
        while c and e >= 0 and not holds[e]:
            holds[e] = True
            e = page.parent[e]
    at = np.flatnonzero(chosen)
    first, last = at[0], at[-1]
    out = chosen.copy()
    reached: dict[tuple, int] = {}
    for i, (_, e, _) in enumerate(blocks):
        between = inside[i] or first < i < last
        if out[i] or not (lengths[i] or between):
            continue
        tag = page.tag[e]
        if tag in TEXTUAL:
            fixed = tag in FIXED
            e, passed = page.parent[e], []
            while e > 0 and not holds[e] and (page.tag[e] in WRAPPERS or fixed and between and page.tag[e] in ("div", "section")):
                if (e, fixed, between) in reached:
                    e = reached[e, fixed, between]
                    break
                passed.append((e, fixed, between))
                fixed = fixed or page.tag[e] in FIXED
                e = page.parent[e]
            for state in passed:
                reached[state] = e
        out[i] = holds[e]
    following = False
    for i in range(last, -1, -1):  # a heading goes with the node below it, the page's with all
        tag = page.tag[blocks[i][1]]
        if tag == "h1" or tag in HEADINGS and following:
            out[i] = True
        if tag not in HEADINGS:
            following = out[i]
    return out


def _extracted(batches):
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """Main text of every page: (page_id, url, text, n_chars).

    Null and empty pages and pages without text give an empty text; null ids and urls pass through; repeated rows give repeated results; an unclosed
    comment or script runs to the end of the page; pages of any length and depth are read whole; an empty table gives no rows. n_chars counts code points.
    """
    small_batches(pages.sparkSession)
    source = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return source.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
