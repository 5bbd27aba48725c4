"""Main text of web pages by line-block distribution.

Markup is cut into blocks, the lines of the method. A line weighs its characters outside
links (all of them inside a marked article); lines in menus, adverts, forms and the like are
ruled out. Sums over sliding windows of lines rise at surge points and fall at dive points;
what lies between is a region, and the heaviest region is the core of the article. No region
crosses the border of a marked article, whose mark counts as much as its lines do: they weigh
twice. Marked articles side by side that are of like weight are parts of one text.

From the core the article reaches as far as its container: to both ends of a marked article,
or of the first and the last of its parts; on other pages over all regions in the same
container, and on to its nearest lines that are not mostly links. Lines that were ruled out are
left out of it. Inside an article an element is ruled out by what it is, or by a name that
tells a box of the page (reader comments, related posts, a newsletter, an advert, a notice):
a name that holds such a word and else only words of layout.

Null and empty pages, and pages without text, give an empty string. Texts are read whole.
Repeated rows are extracted each; of regions of one weight the first counts; an empty table
gives an empty result. Columns other than id, url and html are not read.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MARK = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)",
    re.S,
)
_NAMED = re.compile(r"""(?:^|[\s/"'])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)|(?=[\s/>]|$))""", re.I)
#: Elements whose content is no text of the page.
RAW = frozenset("script style textarea noscript template iframe svg object canvas audio video select title xmp noframes noembed".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link main menu meta nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never belong to the article; ``OUTER`` ones only outside it.
NEVER = frozenset("nav aside footer form menu dialog button head search".split())
OUTER = frozenset(["header"])
#: Words of class, id and role names that tell the same; ``OUTER_NAMES`` only outside the article. Outside, any word of a
#: hyphenated name counts. Inside, a name counts if its other words are of ``LAYOUT``; one that holds a word of the first
#: list by itself, others (which a topic may be called as well) only if there is no other name.
SURE_NAMES = frozenset(
    "nav navbar navigation menu footer sidebar ad ads advert adverts advertisement advertising advertorial sponsor sponsored promo banner cookie cookies consent gdpr comments commentlist disqus share sharing social breadcrumb breadcrumbs pagination pager popup modal newsletter subscribe signup login widget notice notices".split()
)
NAMES = SURE_NAMES | frozenset(
    "aside promotion alert comment respond reply replies related recommended recommendations overlay subscription form search copyright disclaimer complementary contentinfo".split()
)
LAYOUT = frozenset(
    "area article articles bar block body bottom box button buttons card cards col column container content entry group holder icons inline inner item items left links list main module native page panel post posts right row section side single site slot stories story text thread title top unit wrap wrapper".split()
)
#: Words by which the id of a section, which may be a slug of its heading, rules it out.
BOX_NAMES = frozenset("ads advert advertisement comment commentlist comments disqus newsletter respond sidebar".split())
OUTER_NAMES = frozenset("header masthead topbar toolbar".split())
_ROOTS = frozenset("html body article main".split())
#: Elements whose id is a slug of their text, and those that hold text of the article whatever weaker names say.
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup p".split())
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 hgroup blockquote pre table".split())
#: Elements that hold an article or a part of the page.
CONTAINERS = frozenset("body main article section div center td".split())


def _ruled_out(name: str, rest: str, inside: bool) -> bool:
    if name in NEVER or (name in OUTER and not inside):
        return True
    if not rest or name in VOID:
        return False
    for key, value in _NAMED.findall(rest):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return name not in _ROOTS
        if key == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return name not in _ROOTS
            continue
        if key == "id" and name in _HEADINGS:
            continue
        words = set(re.split(r"[^a-z]+", value))
        if name in ("html", "body", "main"):
            continue
        if name == "article":
            if words & {"comment", "comments", "reply"}:
                return True
            continue
        if inside:
            names = [set(filter(None, re.split(r"[^a-z]+", token))) for token in re.findall(r"\S*[a-z]\S*", value)]
            boxes = [n for n in names if n & NAMES and n <= NAMES | LAYOUT]
            if key == "id" and name == "section":
                boxes = [n for n in boxes if n & BOX_NAMES or len(n) > 1]
            if any(n & SURE_NAMES for n in boxes) or (boxes and len(boxes) == len(names) and name not in _TEXT):
                return True
            continue
        if words & NAMES or (words & OUTER_NAMES and not re.fullmatch("h[1-6]", name)):
            return True
    return False


class Line(NamedTuple):
    """A block of the page: ``article`` is 0 outside of any, else its number; ``container`` is the element that holds it."""

    text: str
    linked: int
    article: int
    out: bool
    container: int


def lines(page: str) -> tuple[list[Line], list[int], list[int]]:
    """The blocks of a page, the parent of every container (0, the page, is its own), and the container around each article."""
    out: list[Line] = []
    parts: list[str] = []
    linked = articles = current = depth = 0
    skip: list[str] = []  # the element that is ruled out and those of its name within it
    links = 0
    around = [0]
    parents, held = [0], [("", 0)]  # containers, and the names and numbers of those that are open

    def end():
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(Line(text, min(linked, len(text)), current, bool(skip), held[-1][1]))
        parts.clear()
        linked = 0

    at = 0
    while at < len(page):
        m = _MARK.search(page, at)
        if not m:
            parts.append(page[at:])
            break
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            if links:
                linked += len(piece.strip())
        at = m.end()
        name = m["name"] or m["name2"]
        if not name:
            if m[0].startswith("<![CDATA["):
                parts.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        name, closing, rest = name.lower(), bool(m["close"] or m["close2"]), m["rest"] or m["rest2"] or ""
        if name in RAW and not closing:
            if not rest.rstrip().endswith("/"):
                stop = re.compile(rf"</{re.escape(name)}(?:\s[^>]*)?>", re.I).search(page, at)
                at = stop.end() if stop else len(page)
            continue
        if name in BLOCKS:
            end()
        elif name == "br":
            parts.append(" ")
        if name == "a":
            links = 0 if closing else 1
        if name in CONTAINERS:
            if not closing:
                parents.append(held[-1][1])
                held.append((name, len(parents) - 1))
            else:
                # an element that was not closed ends with the one around it; a stray end means nothing
                back = next((k for k in range(1, min(len(held), 64)) if held[-k][0] == name), 0)
                del held[len(held) - back :]
        if closing:
            if skip and name == skip[0]:
                skip.pop()
            elif name in ("article", "main") and depth:
                depth -= 1
                skip.clear()
                if not depth:
                    current = 0
            elif name in ("body", "html"):
                skip.clear()
            continue
        if name in VOID or rest.rstrip().endswith("/") and name not in BLOCKS:
            continue
        if name in ("article", "main") and not _ruled_out(name, rest, bool(depth)):
            if not depth:
                skip.clear()  # what ruled out the text before was never closed
                articles += 1
                current = articles
                around.append(parents[-1])
            depth += 1
        elif skip:
            if name == skip[0] and name != "p":
                skip.append(name)
            elif skip[0] == "p" and name in BLOCKS:
                skip.clear()
                if _ruled_out(name, rest, bool(depth)):
                    skip.append(name)
        elif _ruled_out(name, rest, bool(depth)):
            skip.append(name)
    end()
    return out, parents, around


def surges_and_dives(weights: np.ndarray, borders: np.ndarray, window: int = 3, least: int = 80) -> np.ndarray:
    """``[first line, line after the last]`` of every region, in order.

    A region is a run of lines whose windows of ``window`` lines weigh more than ``least``, or more than a
    quarter of the page's heaviest window if that is less. Windows and regions do not cross ``borders``, the
    lines that begin a part of the page.
    """
    n = len(weights)
    if not n:
        return np.empty((0, 2), np.int64)
    total = np.concatenate([[0], np.cumsum(weights)])
    here, half = np.arange(n), window // 2
    part = np.searchsorted(borders, here, "right") - 1
    begins, ends = borders[part], np.append(borders[1:], n)[part]
    sums = total[np.minimum(here + half + 1, ends)] - total[np.maximum(here - half, begins)]
    active = sums > min(least, int(sums.max()) // 4)
    surge = active & ~(np.concatenate([[False], active[:-1]]) & (here > begins))
    dive = active & ~(np.concatenate([active[1:], [False]]) & (here + 1 < ends))
    found = np.stack([np.flatnonzero(surge), np.flatnonzero(dive) + 1], 1)
    # lines at the rims that weigh nothing were only reached by the window
    rims = [np.flatnonzero(weights[a:b]) + a for a, b in found]
    return np.array([(r[0], r[-1] + 1) for r in rims if r.size], np.int64).reshape(-1, 2)


def main_text(page: str | None, window: int = 3, least: int = 80) -> str:
    """The article of a page: its blocks in order, joined by line ends."""
    every, parents, around = lines(page or "")
    found = [x for x in every if not x.out]
    article = np.array([x.article for x in found], np.int64)
    size = np.array([len(x.text) for x in found], np.int64)
    plain = size - np.array([x.linked for x in found], np.int64)
    borders = np.flatnonzero(np.concatenate([[True], article[1:] != article[:-1]])) if found else np.empty(0, np.int64)
    weights = np.where(article > 0, 2 * size, plain)
    regions = surges_and_dives(weights, borders, window, least)
    if not len(regions):
        return ""
    total = np.concatenate([[0], np.cumsum(weights)])
    heavy = total[regions[:, 1]] - total[regions[:, 0]]
    parts = _parts(article, weights, plain * 2 > size, around)
    # a region inside an article stands for all parts of its text
    whole = np.bincount(parts[article[regions[:, 0]]], heavy, len(around))
    heavy = np.where(article[regions[:, 0]] > 0, whole[parts[article[regions[:, 0]]]], heavy)
    first, last = regions[np.argmax(heavy)].tolist()
    if article[first]:
        keep = parts[article] == parts[article[first]]
    else:
        first, last = _reach(first, last, regions, found, parents, weights, plain * 2 > size)
        keep = (np.arange(len(found)) >= first) & (np.arange(len(found)) < last)
    return "\n".join(x.text for x, k in zip(found, keep) if k)


def _parts(article: np.ndarray, weights: np.ndarray, prose: np.ndarray, around: list[int]) -> np.ndarray:
    """For each article the first one of its text: articles in one container that weigh a third of the heaviest there, or more, and are not mostly links."""
    weight = np.bincount(article, weights, len(around))
    text = np.bincount(article, weights * prose, len(around))
    out = np.arange(len(around))
    beside: dict[int, list[int]] = {}
    for a in range(1, len(around)):
        beside.setdefault(around[a], []).append(a)
    for own in beside.values():
        most = max(weight[a] for a in own)
        like = [a for a in own if 3 * weight[a] >= most and 2 * text[a] >= weight[a]]
        for a in like:
            out[a] = like[0]
    return out


def _reach(first: int, last: int, regions: np.ndarray, found: list[Line], parents: list[int], weights: np.ndarray, prose: np.ndarray) -> tuple[int, int]:
    """Brings the core, lines ``first`` to ``last``, to the container of most of the page's regions, over all of them there and the nearest lines."""
    listed = [k for a, b in regions.tolist() for k in range(a, b) if not found[k].article]
    held, depth = [0] * len(parents), [0] * len(parents)
    for k in listed:
        held[found[k].container] += int(weights[k])
    for c in range(len(parents) - 1, 0, -1):  # a container's number is above its parent's
        held[parents[c]] += held[c]
    for c in range(1, len(parents)):
        depth[c] = depth[parents[c]] + 1
    # the innermost container that holds two thirds, and what is in it
    top = max((c for c in range(len(parents)) if 3 * held[c] >= 2 * held[0]), key=lambda c: depth[c])
    inside = [c == top for c in range(len(parents))]
    for c in range(1, len(parents)):
        inside[c] = inside[c] or inside[parents[c]]
    core = [k for k in range(first, last) if inside[found[k].container]] or [k for k in listed if inside[found[k].container]]
    own = {found[k].container for k in core} | {top}

    def belongs(line: Line) -> bool:
        # parts of the page itself belong together only if they hold parts of the core
        return not line.article and (line.container in own or (depth[top] > 1 and inside[line.container]))

    core += [k for k in listed if belongs(found[k])]
    first, last = min(core), max(core) + 1
    while first and prose[first - 1] and belongs(found[first - 1]):
        first -= 1
    while last < len(found) and prose[last] and belongs(found[last]):
        last += 1
    return first, last


def extract_text(pages: DataFrame, window: int = 3, least: int = 80, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every page."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for b in batches:
            texts = [main_text(h.as_py(), window, least) for h in b.column(2)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
