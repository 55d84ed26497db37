"""Main text of web pages by maximum-scoring subsequence.

A page becomes a sequence of pieces: text between tags scores per word, tags score negative. The weights are log-odds of being inside
or outside the article, learned from labelled pages: those that mark their article with one <article> or <main> element. Words are told apart by
where they stand (in a menu, footer, advert, ...; in the article; else by the block around them), tags by their name. One linear
scan finds the contiguous region of the highest total, and the words in it that stand in no menu, form, notice or the like are the text, with
character references decoded, white space in a block made one space, and blocks joined by one.

Defined cases: null and empty pages, and pages without words, give the empty text. Unclosed and wrongly nested markup is read as
far as it goes; a tag that the end cuts off goes with all that stands in it, a comment without end too. Ties between regions: the first. No labelled
pages: prior weights. Very long pages are read whole, in one scan. Repeated rows get a row each, an empty table none. Columns beyond html and those to
keep are not read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import count_in_tasks, map_rows

# Facts about HTML elements: fixed values.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp",
    "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
# Elements and class, id or role words that are no part of an article.
OUTSIDE = {
    "head", "title", "nav", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "svg", "canvas", "object", "button", "select",
    "textarea", "menu", "dialog", "noembed", "noframes", "header",
}
OUTSIDE_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "consent",
    "contentinfo", "cookie", "cookies", "disqus", "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice",
    "notices", "pagination", "popup", "promo", "related", "respond", "search", "share", "sharing", "sidebar", "skip", "social", "sponsor", "sponsored", "subscribe",
    "toolbar", "topbar", "widget",
}
ARTICLE = {"article", "main"}
LISTED = INLINE | VOID | OUTSIDE | ARTICLE | RAW | {
    "address", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5",
    "h6", "hgroup", "html", "li", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?][^>]*>?", re.S)
_CUT_OFF = re.compile(r"<[!?/a-zA-Z]")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_CLOSE = {x: re.compile(rf"</{x}(?=[\s/>]|\Z)", re.I) for x in RAW}
_SPLIT = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"\s+")


def names_outside(attributes: str) -> str | None:
    """The first class, id or role word that is no part of an article."""
    if "=" not in attributes:
        return None
    for m in _NAMES.finditer(attributes):
        for word in _SPLIT.split(next(g for g in m.groups() if g is not None).lower()):
            if word in OUTSIDE_NAMES:
                return word
    return None


class Open:
    """The open elements, with what is asked of them kept as it changes."""

    def __init__(self):
        self.stack: list[tuple[str, str | None]] = []  # (element, why it is no part of an article)
        self.names: Counter = Counter()
        self.reasons: list[str] = []
        self.blocks: list[str] = []

    def push(self, name: str, why: str | None) -> None:
        self.stack.append((name, why))
        self.names[name] += 1
        if why:
            self.reasons.append(why)
        if name not in INLINE and name in LISTED:
            self.blocks.append(name)

    def pop(self) -> str:
        name, why = self.stack.pop()
        self.names[name] -= 1
        if why:
            self.reasons.pop()
        if name not in INLINE and name in LISTED:
            self.blocks.pop()
        return name

    def rebuild(self, stack: list[tuple[str, str | None]]) -> None:
        self.__init__()
        for name, why in stack:
            self.push(name, why)

    @property
    def in_article(self) -> bool:
        return any(self.names[x] for x in ARTICLE)

    def place(self, has_article: bool) -> tuple[str, bool]:
        """Where a text stands, and whether it can be taken."""
        if self.reasons:
            return "skip" if self.in_article else f"out:{self.reasons[0]}", False
        if has_article:
            return ("in:article" if self.in_article else "in:rest"), True
        return f"in:{self.blocks[-1] if self.blocks else 'none'}", True


def pieces(page: str):
    """Yields (kind, feature, text): kind 't' tag, 'w' text, 'x' text that is never taken; text of a tag is the break it makes
    ('' none, ' ' of the line, 'b' of the block)."""
    open_ = Open()
    at, size = 0, len(page)
    has_article = re.search(r"<(?:article|main)[\s>]", page, re.I) is not None
    closed = page.rfind(">") + 1  # no tag ends beyond, so none is looked for there
    cut_off = _CUT_OFF.search(page, closed)  # a tag that the end cuts off, with all that stands in it
    size = cut_off.start() if cut_off else size
    while at < size:
        m = _TAG.search(page, at, closed) if at < closed else None
        stop = m.start() if m else size
        if stop > at:
            feature, counted = open_.place(has_article)
            yield "w" if counted else "x", feature, entities.unescape(page[at:stop])
        if not m:
            return
        at = m.end()
        if m.group().startswith("<!--") and not m.group().endswith("-->"):
            return  # a comment without end
        name = (m.group(2) or "").lower()
        if not name:
            continue
        known = name if name in LISTED else "other"
        if open_.reasons and open_.in_article:
            known = "skip"  # an article's own boxes neither help nor part it
        if m.group(1):
            if open_.names[name]:
                while open_.pop() != name:
                    pass
            yield "t", known if known == "skip" else f"/{known}", "" if name in INLINE else "b"
            continue
        if name == "body":
            open_.rebuild([x for x in open_.stack if x[0] not in ("head", "title")])
        inside = open_.in_article
        why = name if name in OUTSIDE and not (name == "header" and inside) else None
        found = names_outside(m.group(3) or "")
        if why is None and found and name not in ("html", "body") and not (inside and found == "header"):
            why = found
        if name in ARTICLE and found not in ("comment", "comments"):
            why = None
            if any(r not in OUTSIDE for r in open_.reasons):  # a wrapper named after its sidebar holds the article
                open_.rebuild([(e, w if e in OUTSIDE else None) for e, w in open_.stack])
        yield "t", known, " " if name == "br" else "" if name in INLINE else "b"
        if name in VOID or (m.group(3) or "").endswith("/") and name not in RAW and name not in ARTICLE:
            continue
        if name in RAW:
            close = _CLOSE[name].search(page, at)
            at = close.start() if close else size
            end = page.find(">", at)
            at = size if end < 0 else end + 1
            continue
        if name in ("p", "li", "option", "tr", "td", "th", "dt", "dd") and open_.stack and open_.stack[-1][0] == name:
            open_.pop()  # closed by the next of its kind
        open_.push(name, why)


def label_counts(pages: DataFrame) -> DataFrame:
    """(feature, inside, n): how often features stand in or out of the article, over all pages that mark exactly one."""

    def make():
        seen: Counter = Counter()

        def feed(page):
            if len(re.findall(r"<(?:article|main)[\s>]", page, re.I)) != 1:
                return
            depth = False
            for kind, feature, text in pieces(page):
                if kind == "t":
                    if feature in ("article", "main"):
                        depth = True
                    elif feature in ("/article", "/main"):
                        depth = False
                    else:
                        seen[feature, depth] += 1
                else:
                    n = len(text.split())
                    if n:
                        seen[feature, depth and kind == "w"] += n

        def drain():
            rows = [(f, i, n) for (f, i), n in seen.items()]
            seen.clear()
            return rows

        return feed, drain, lambda: len(seen)

    part = count_in_tasks(pages.select("html").filter("html IS NOT NULL"), make, "feature string, inside boolean, n long")
    return part.groupBy("feature", "inside").agg(F.sum("n").alias("n"))


PRIOR = {"in:article": 1.0, "in:rest": -1.0, "skip": 0.0}
# Text that is never taken only parts regions: its words weigh little.
APART = 0.1


def learn_weights(counts: DataFrame) -> dict[str, float]:
    """Log-odds per feature, bounded by 3. Features are elements, listed names and places: a fixed number."""
    inside: Counter = Counter()
    outside: Counter = Counter()
    for r in counts.collect():
        (inside if r["inside"] else outside)[r["feature"]] += r["n"]
    weights = {}
    for feature in inside.keys() | outside.keys():
        odds = max(-3.0, min(3.0, math.log((inside[feature] + 1) / (outside[feature] + 1))))
        if feature == "skip":
            weights[feature] = 0.0
        elif feature.startswith("out:"):
            weights[feature] = APART * min(odds, -1.0)
        elif feature == "in:rest":
            weights[feature] = min(odds, -1.0)
        elif feature.startswith("in:"):
            weights[feature] = max(odds, 0.5) if feature == "in:article" else odds
        else:  # a tag costs a little in the article, more where only other parts have it
            weights[feature] = min(-0.01, odds / 3)
    return weights


def weight(weights: dict[str, float], kind: str, feature: str) -> float:
    if feature in weights:
        return weights[feature]
    if feature in PRIOR:
        return PRIOR[feature]
    return -0.05 if kind == "t" else -APART if feature.startswith("out:") else 1.0


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The text of the page's best region."""
    if not page:
        return ""
    sequence = list(pieces(page))
    best = total = 0.0
    begin, region = 0, (0, 0)
    for i, (kind, feature, text) in enumerate(sequence):
        w = weight(weights, kind, feature)
        total += w if kind == "t" else w * len(text.split())
        if total > best + 1e-9:
            best, region = total, (begin, i + 1)
        if total <= 0:
            total, begin = 0.0, i + 1
    blocks: list[list[str]] = [[]]
    for kind, _, text in sequence[slice(*region)]:
        if kind == "w":
            blocks[-1].append(text)
        elif kind == "x" or text == "b":
            blocks.append([])
        elif text == " ":
            blocks[-1].append(" ")
    made = (_SPACE.sub(" ", "".join(b)).strip() for b in blocks)
    return " ".join(b for b in made if b)


def extract_pages(pages: DataFrame, keep: list[str], labelled: DataFrame | None = None) -> DataFrame:
    """keep, and text per page; weights come from `labelled` (pages when not given)."""
    weights = learn_weights(label_counts(pages if labelled is None else labelled))
    sent = pages.sparkSession.sparkContext.broadcast(weights)
    kinds = dict(pages.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", text string"

    def make():
        return lambda *row: (*row[:-1], extract(row[-1], sent.value))

    return map_rows(pages.select(*keep, "html"), make, schema)
