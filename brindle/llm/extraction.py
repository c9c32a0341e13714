"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks of text. A linear classifier with fixed weights, over
a block's tags, class names, links and wording, gives the cost of calling it
boilerplate and the cost of calling it content: the capacities of its edges from
the source and to the sink. Edges of smoothness join blocks that follow one
another and blocks of one parent, the stronger the nearer they are in the
document tree. The minimum cut is the labelling of least cost; the source's side
is content.

A name says what an element is, not what the page around it has: names of html
and body don't count, nor do words of layout ("has-sidebar"), and a form or a
name of boilerplate doesn't count on an element that holds the page's main part.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import parted

SMOOTHNESS = 1.5
MAX_COST = 12.0
# Element names of HTML.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
BREAKS = frozenset(["hr"])
SPACES = frozenset(["br", "wbr", "img", "input", "embed", "source", "track", "area"])
SKIPPED = frozenset("script style template noscript textarea select option datalist button svg math iframe object canvas audio video title head".split())
RAW = frozenset(["script", "style", "textarea", "title", "iframe", "noscript"])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
# Weights of the classifier.
TAG_SCORES = {"nav": -7.0, "footer": -7.0, "aside": -6.0, "header": -4.0, "form": -6.0, "fieldset": -4.0, "menu": -6.0, "dialog": -6.0, "article": 5.0, "main": 3.0, "figcaption": -0.5}
BAD_NAMES = frozenset("ad ads advert adverts advertisement advertising promo promos sponsor sponsored banner cookie cookies consent gdpr notice notices alert menu nav navbar navigation breadcrumb breadcrumbs sidebar widget widgets footer masthead topbar toolbar comment comments commentlist disqus reply replies share sharing social related recommended subscribe newsletter signup login popup modal overlay copyright legal pagination pager tag tags meta byline search skip contentinfo complementary".split())
GOOD_NAMES = frozenset("article content post entry story main body text paragraph".split())
#: A class with such a word describes the page or a container of both kinds.
LAYOUT_NAMES = frozenset("no not has have with without is enabled disabled layout page template theme skin".split())
CONTAINERS = frozenset("wrap wrapper container inner outer holder col cols column columns grid row".split())
BAD_NAME, GOOD_NAME = -6.0, 2.0
#: An element that holds the page's first-level heading and more than this share of its plain words holds the main part.
MAIN_SHARE = 0.5
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^<>]*>?|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>"']+|"[^"<]*"|'[^'<]*')*+)>|<(/?)([a-zA-Z][^\s/><]*+)([^<>]*+)>""", re.DOTALL)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.IGNORECASE)


class Block:
    """Words of one block, with what the classifier looks at."""

    __slots__ = ("context", "leaf", "linked", "parent", "path", "text")

    def __init__(self, text: str, linked: int, leaf: str, path: tuple[int, ...]):
        self.text, self.linked, self.leaf, self.context, self.path = text, linked, leaf, 0.0, path
        self.parent = path[-1] if path else 0


class Element:
    """What a shown element adds to the score of its blocks."""

    __slots__ = ("around", "doubtful", "main", "score", "words")

    def __init__(self, around: int, score: float, doubtful: float):
        self.around, self.score, self.doubtful, self.main, self.words = around, score, doubtful, False, 0


@lru_cache(maxsize=4096)
def _names_score(names: str) -> float:
    """Of class, id and role together."""
    good = bad = False
    for name in names.split():
        words = {w.lower() for w in _WORDS.findall(name)}
        some_bad, some_good = not words.isdisjoint(BAD_NAMES), not words.isdisjoint(GOOD_NAMES)
        if words.isdisjoint(LAYOUT_NAMES) and not (some_bad and some_good and not words.isdisjoint(CONTAINERS)):
            bad, good = bad or some_bad, good or (some_good and not some_bad)
    return 0.0 if good and bad else BAD_NAME if bad else GOOD_NAME if good else 0.0


@lru_cache(maxsize=4096)
def _scores(tag: str, attributes: str) -> tuple[float, float, bool] | None:
    """What an element adds to its blocks' score for good, and unless it holds the main part; whether it says that it is the main part. None if it is not shown."""
    score, doubtful = TAG_SCORES.get(tag, 0.0), 0.0
    if tag in ("form", "fieldset"):
        score, doubtful = 0.0, score
    main = tag == "main"
    if attributes and tag not in ("html", "body"):
        if _HIDDEN.search(attributes):
            return None
        names = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes))
        named = _names_score(names)
        main = main or "main" in names.lower().split() and named > 0
        if named < 0:
            doubtful += named
        else:
            score += named
    return score, doubtful, main


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order. Unclosed and stray tags are put up with."""
    out: list[Block] = []
    words: list[str] = []
    linked = 0
    in_link = False
    elements = [Element(0, 0.0, 0.0)]
    # Open elements: name, number, whether shown, whether its name or tag is that of content.
    stack: list[tuple[str, int, bool, bool]] = [("", 0, True, False)]
    headed: list[int] = []

    def close() -> None:
        nonlocal linked, headed
        if words:
            text = " ".join("".join(words).split())
            if text:
                leaf = stack[-1][0]
                inner = leaf == "p" or leaf in HEADINGS or leaf in ("li", "td", "th", "dd", "dt")
                out.append(Block(text, linked, leaf, tuple(x[1] for x in (stack[:-1] if inner else stack))))
                plain = max(0, text.count(" ") + 1 - linked)
                for x in stack:
                    elements[x[1]].words += plain
                if leaf == "h1" and not headed:
                    headed = [x[1] for x in stack]
            words.clear()
        linked = 0

    at, size = 0, len(page)
    while at < size:
        found = _TOKEN.search(page, at)
        begin = found.start() if found else size
        if begin > at and stack[-1][2]:
            text = page[at:begin]
            if "&" in text:
                text = html.unescape(text)
            words.append(text)
            if in_link:
                linked += len(text.split())
        if not found:
            break
        at = found.end()
        name = found[2] or found[5]
        if not name:
            continue
        tag, ending, attributes = name.lower(), found[1] or found[4], found[3] if found[2] else found[6]
        if tag == "a":
            in_link = not ending
        elif tag in SKIPPED:
            if not ending:
                if tag in RAW:
                    end = _end_of(tag).search(page, at)
                    at = end.end() if end else size
                elif not attributes.endswith("/"):
                    elements.append(Element(stack[-1][1], 0.0, 0.0))
                    stack.append((tag, len(elements) - 1, False, False))
            else:
                _pop(stack, tag)
        elif tag in SPACES:
            words.append(" ")
        elif tag in BREAKS:
            close()
        elif tag in BLOCKS:
            close()
            in_link = False
            if ending:
                _pop(stack, tag)
                continue
            if not stack[-1][2] and tag == "body":
                _pop(stack, "head")
            if stack[-1][0] == "p" or (tag == stack[-1][0] and tag in ("li", "dt", "dd", "tr", "td", "th")):
                stack.pop()
            found_scores = _scores(tag, attributes)
            score, doubtful, main = found_scores or (0.0, 0.0, False)
            if tag == "header" and any(x[3] for x in stack):
                score -= TAG_SCORES["header"]
            if tag not in ("html", "body"):
                elements.append(Element(stack[-1][1], score, doubtful))
                stack.append((tag, len(elements) - 1, stack[-1][2] and found_scores is not None, score > 0 and not doubtful))
                if main and stack[-1][2]:
                    for x in stack:
                        elements[x[1]].main = True
    close()
    for i in headed:
        elements[i].main = elements[i].main or elements[i].words > MAIN_SHARE * elements[0].words
    contexts: list[float] = []
    for e in elements:
        score = e.score + (0.0 if e.main else e.doubtful)
        around = contexts[e.around] if contexts else 0.0
        # What is boilerplate by name is so within an article too.
        contexts.append((min(around, 0.0) if score < 0 else around) + score)
    for b in out:
        b.context = contexts[b.path[-1]]
    return out


@lru_cache(maxsize=16)
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE)


def _pop(stack: list[tuple[str, int, bool, bool]], tag: str) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i][0] == tag:
            del stack[i:]
            return


def costs(block: Block) -> tuple[float, float]:
    """Of calling a block boilerplate, and of calling it content."""
    words = block.text.count(" ") + 1
    z = max(-8.0, min(8.0, block.context)) - 6.0 * min(1.0, block.linked / words)
    z += min(2.5, math.log2(words) / 2.0) - 1.0
    if block.text[-1] in ".!?…。！？\"'»”)":
        z += 0.7
    if block.leaf in HEADINGS:
        z += 0.8
    if block.text[0] == "©" or "©" in block.text[:60]:
        z -= 3.0
    content = math.log1p(math.exp(-abs(z))) + max(z, 0.0)
    return min(MAX_COST, content), min(MAX_COST, content - z)


def edges(found: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness between blocks that follow one another, and between those of one parent with others in between."""
    out = []
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            a = found[i - 1]
            common = 0
            for x, y in zip(a.path, b.path):
                if x != y:
                    break
                common += 1
            out.append((i - 1, i, SMOOTHNESS / (1 + len(a.path) + len(b.path) - 2 * common)))
        before = last.get(b.parent)
        if before is not None and before < i - 1:
            out.append((before, i, SMOOTHNESS / 2))
        last[b.parent] = i
    return out


def source_side(capacities: list[tuple[float, float]], smooth: list[tuple[int, int, float]]) -> list[bool]:
    """The source's side of a minimum cut, by augmenting shortest paths.

    Paths start at nodes with supply left over from their own sink edge. Where
    a search finds no sink, all it reached is the source's side for good: no
    later path can enter it and get out. So failed searches cost one visit for
    each node in all.
    """
    n = len(capacities)
    supply = [a - b for a, b in capacities]
    residual: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in smooth:
        residual[a][b] = residual[a].get(b, 0.0) + w
        residual[b][a] = residual[b].get(a, 0.0) + w
    done = [False] * n
    for root in range(n):
        while supply[root] > 1e-12 and not done[root]:
            came: dict[int, int] = {root: root}
            queue, end = deque([root]), -1
            while queue and end < 0:
                i = queue.popleft()
                for j, w in residual[i].items():
                    if w > 1e-12 and j not in came and not done[j]:
                        came[j] = i
                        if supply[j] < -1e-12:
                            end = j
                            break
                        queue.append(j)
            if end < 0:
                for i in came:
                    done[i] = True
                break
            flow, j = min(supply[root], -supply[end]), end
            while j != root:
                flow = min(flow, residual[came[j]][j])
                j = came[j]
            j = end
            while j != root:
                residual[came[j]][j] -= flow
                residual[j][came[j]] = residual[j].get(came[j], 0.0) + flow
                j = came[j]
            supply[root] -= flow
            supply[end] += flow
    return done


def main_text(page: str | None) -> str:
    """The blocks labelled content, two line feeds between them; empty if none."""
    found = blocks(page or "")
    content = source_side([costs(b) for b in found], edges(found))
    return "\n\n".join(b.text for b, c in zip(found, content) if c)


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)``, one row for each row of ``pages``.

    Null and empty pages have an empty text; null and repeated ids stay; an
    empty table gives no rows; other columns are not read. Character references
    are decoded, and white space within a block is one space.
    """
    p = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    schema = p.select("page_id", "url", F.lit("").alias("text")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, found in parted(batch, 2):
                text = [main_text(x).encode("utf-8", "replace").decode() for x in found]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(text, pa.string())], names=["page_id", "url", "text"])

    return p.mapInArrow(run, schema).withColumn("n_chars", F.length("text").cast("long"))
