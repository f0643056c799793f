"""Main text of web pages by tag-path ratios.

The text leaves of a page are grouped by their path of block tags from the root. A
path has the length of its text, its punctuation, the part of it in links and the
number of its blocks. The ratio of text and punctuation to blocks is smoothed
over the paths that come before and after in the page, and over the paths of the
same container in the article. It is then fused with what is known of the path: the
share of its text in links, the elements on it that are marked as no article by
their tag or by words of their class, id or role, and whether it is in the article.
Paths whose score reaches a part of the best one are content, and their blocks are
the text.

Marks only weigh. The mark of an element that holds the article is void, and of one
that holds most of the page's text where no article is marked: a wrapper is called
after what is in it. All steps are linear in the page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that hold no text of the page.
SILENT = frozenset("script style noscript template head title svg math iframe object applet canvas audio video button select option textarea".split())
#: Elements marked by their tag; the second ones may hold a whole page.
MARKED = frozenset("nav menu header footer aside dialog".split())
WRAPPING = frozenset("form fieldset".split())
#: Elements that an open paragraph ends at.
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dd dt".split())
#: Elements that end an open element of these kinds, but not across the containers.
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs header masthead footer copyright"
    " cookie cookies consent gdpr notice notices banner popup modal overlay newsletter subscribe subscription share sharing social related recommended trending comment comments disqus"
    " discussion replies respond widget toolbar pagination pager login signin signup search skip contentinfo complementary alert".split()
)
ARTICLE = frozenset("article main content post entry story text body articlebody".split())
#: Beginnings and ends of names that tell of what an element has, not what it is.
STATE_FIRST, STATE_LAST = frozenset("has with without no is not show hide js".split()), frozenset("enabled disabled layout open closed on off visible".split())
#: Part of the best score that a path must reach.
THRESHOLD = 0.1
#: One part in so many of a path's ratio comes from each of its neighbours; less than the threshold.
SMOOTH = 12
#: What a mark, and a place outside the article, leave of a score, and each step to another path of the same container.
MARK, OUTSIDE, STEP = 1e-3, 0.05, 0.75
#: Share of the page's text that the articles hold if they are to count, and one that makes a mark void.
HOLDS, MOST = 0.25, 0.5
#: Share of the content that a container holds to stand in for an article.
CONTAINS = 0.85
_WORD = re.compile("[a-z]+")
_MARKS = re.compile("[.,;:!?…。、，！？]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def _says(names: str) -> tuple[bool, bool]:
    """Whether names in a class, id or role speak of boilerplate, and of an article."""
    bad = good = False
    for name in names.split():
        words = _WORD.findall(name)
        if not words or words[0] in STATE_FIRST or words[-1] in STATE_LAST:
            continue
        if BOILERPLATE.intersection(words):
            bad = True
        elif ARTICLE.issuperset(words):
            good = True
    return bad, good


class _Page(HTMLParser):
    """Reads a page into block elements, parents first, and blocks of text: (element, text, characters in links)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.mark, self.good = [""], [-1], [0], [False]
        self.stack: list[tuple[str, int]] = []  # inline elements have no number
        self.open: dict[str, list[int]] = {}  # where in the stack each tag is open
        self.at = self.links = self.silent = self.linked = 0
        self.blocks: list[tuple[int, str, int]] = []
        self.text: list[str] = []

    def flush(self) -> None:
        if self.text:
            if body := " ".join("".join(self.text).split()):
                self.blocks.append((self.at, body, min(self.linked, len(body))))
            self.text, self.linked = [], 0

    def _last(self, tags) -> int:
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=-1)

    def _push(self, tag: str, number: int) -> None:
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, number))
        self.links += tag == "a"
        self.silent += tag in SILENT

    def _pop_to(self, k: int) -> None:
        while len(self.stack) > k:
            tag, number = self.stack.pop()
            self.open[tag].pop()
            self.links -= tag == "a"
            self.silent -= tag in SILENT
            if number >= 0:
                self.flush()
                self.at = self.parent[number]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSES_P and (k := self._last(("p",))) > self._last(("table", "td", "th", "button", "object")):
            self._pop_to(k)
        if tag in CLOSES:
            ended, within = CLOSES[tag]
            if (k := self._last(ended)) > self._last(within):
                # The outermost of those that end here, as a cell in a row.
                self._pop_to(min((self.open[t][-1] for t in ended if self.open.get(t) and self.open[t][-1] > self._last(within)), default=k))
        if tag == "br":
            self.text.append(" ")
            return
        if tag in VOID:
            if tag == "hr":
                self.flush()
            return
        if tag in SILENT:
            self._push(tag, -1)
            return
        mark, good = (1 if tag in MARKED else 2 if tag in WRAPPING else 0), False
        for name, value in attrs:
            value = (value or "").lower()
            if name in ("class", "id", "role"):
                said, said_good = _says(value)
                mark, good = mark or 2 * said, good or said_good
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
                mark = 1
        if tag in INLINE and not mark:
            self._push(tag, -1)
            return
        if tag in ("html", "body"):
            mark, good = 0, False
        self.flush()
        self.tag.append(tag)
        self.parent.append(self.at)
        self.mark.append(0 if tag in ("article", "main") and mark == 2 else mark)
        self.good.append(good and not mark)
        self.at = len(self.tag) - 1
        self._push(tag, self.at)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # a slash closes no element in HTML

    def handle_endtag(self, tag: str) -> None:
        k = self._last((tag,))
        if k >= 0 and not (tag in INLINE or tag in ("p", "li")) or k > self._last(("td", "th", "table", "article", "main", "body")):
            self._pop_to(k)

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.text.append(data)
            if self.links:
                self.linked += len(data)


def ratios(sums: list[list[float]]) -> list[float]:
    """Of paths in page order, as [characters, punctuation, characters in links, blocks]: text and punctuation to blocks, smoothed."""
    raw = [x[0] * (1 + x[1]) / x[3] ** 1.5 * (1 - x[2] / x[0]) for x in sums]
    return [((SMOOTH - 2) * r + raw[max(0, i - 1)] + raw[min(len(raw) - 1, i + 1)]) / SMOOTH for i, r in enumerate(raw)]


def _summed(parent: list[int], own: list[float]) -> list[float]:
    """Of each element what it and all in it have."""
    out = list(own)
    for k in range(len(out) - 1, 0, -1):
        out[parent[k]] += out[k]
    return out


def _within(page: _Page, roots: list[bool]) -> list[bool]:
    out = list(roots)
    for k in range(1, len(out)):
        out[k] = out[k] or out[page.parent[k]]
    return out


def path_scores(page: _Page) -> tuple[list[int], dict[int, float]]:
    """The path of each element, and of each path with text its score; 0 where only marked paths have text."""
    mass = [0.0] * len(page.tag)
    for at, text, linked in page.blocks:
        mass[at] += len(text) - linked
    mass = _summed(page.parent, mass)
    articles = [t in ("article", "main") for t in page.tag]
    if not any(articles):
        articles = page.good
    # Marks that are void: of what holds the article, or most of the page where there is none.
    core = max((k for k in range(len(mass)) if articles[k]), key=lambda k: mass[k], default=-1)
    mark = list(page.mark)
    if core >= 0 and mass[core] >= MOST * mass[0]:
        k = core
        while k > 0:
            mark[k], k = 0, page.parent[k]
    elif core < 0:
        mark = [0 if m == 2 and mass[k] >= MOST * mass[0] else m for k, m in enumerate(mark)]
    marked = _within(page, [m > 0 for m in mark])
    inside = _within(page, [a and not m for a, m in zip(articles, marked, strict=True)])
    clean = sum(len(t) - n for at, t, n in page.blocks if not marked[at])
    has_article = sum(len(t) - n for at, t, n in page.blocks if inside[at] and not marked[at]) >= max(1, HOLDS * clean)

    # Paths: an element's is its parent's and its tag, and whether it is marked or an article's.
    names: dict[tuple, int] = {(-1, "", False, False): 0}
    path, above = [0] * len(page.tag), [-1]
    for k in range(1, len(path)):
        name = (path[page.parent[k]], page.tag[k], marked[k], inside[k])
        path[k] = names.setdefault(name, len(names))
        if path[k] == len(above):
            above.append(name[0])
    leaves: dict[int, list[float]] = {}
    for at, text, linked in page.blocks:
        x = leaves.setdefault(path[at], [0, 0, 0, 0])
        x[0] += len(text)
        x[1] += len(_MARKS.findall(text))
        x[2] += linked
        x[3] += 1
    weight = {}
    for (_, _, is_marked, is_inside), p in names.items():
        if p in leaves:
            weight[p] = (1 - leaves[p][2] / leaves[p][0]) ** 2 * (MARK if is_marked else 1) * (OUTSIDE if has_article and not is_inside else 1)
    own = dict(zip(leaves, ratios(list(leaves.values())), strict=True))
    score = {p: own[p] * w for p, w in weight.items()}
    top = max(score.values())
    if not top or not any(score[p] == top for (_, _, is_marked, _), p in names.items() if p in score and not is_marked):
        return path, dict.fromkeys(score, 0.0)

    # In the article, or else in the element that holds nearly all content, a path has part of its container's best score.
    if not has_article:
        held = [0.0] * len(page.tag)
        for at, text, _ in page.blocks:
            held[at] += len(text) if score[path[at]] >= THRESHOLD * top else 0
        held = _summed(page.parent, held)
        root = max(k for k in range(len(held)) if held[k] >= CONTAINS * held[0])
        while page.tag[root] in CLOSES_P and page.tag[root] not in ("article", "div", "section", "main", "center") and root:
            root = page.parent[root]
        inside = _within(page, [k == root for k in range(len(held))])
    best = [0.0] * len(above)
    for p, x in score.items():
        best[p] = x
    for p in range(len(best) - 1, 0, -1):
        best[above[p]] = max(best[above[p]], best[p])
    reached = [False] * len(above)
    for k, p in enumerate(path):
        reached[p] = reached[p] or inside[k]
    for p in range(1, len(best)):
        if reached[p] and reached[above[p]]:
            best[p] = max(best[p], STEP * best[above[p]])
    for p, w in weight.items():
        if reached[p]:
            score[p] = max(score[p], best[p] * w)
    return path, score


def main_text(html: str) -> str:
    """The article of one page; blocks in page order, one to a line."""
    page = _Page()
    page.feed(html)
    page.close()
    page.flush()
    if not page.blocks:
        return ""
    path, score = path_scores(page)
    least = THRESHOLD * max(score.values())
    return "\n".join(text for at, text, _ in page.blocks if score[path[at]] >= least > 0)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py() or "") for x in batch.column(2)]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """Per row of ``pages``: page_id, url, text (empty if there is none) and n_chars, its code points.

    Character references are decoded, white space in a block becomes one space,
    blocks are joined by newlines. A null or empty html has no text. Repeated rows
    each get their row. An empty table gives no rows. Only page_id, url and html
    are read.
    """
    return pages.select("page_id", "url", F.col("html")).mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
