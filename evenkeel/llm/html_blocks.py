"""Main text of web pages by the distribution of text over line blocks."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of one window, the text length at which a window surges, and pages handled at once.
WINDOW, SURGE, PAGES = 3, 86, 256

#: How much more a line inside an article or main element weighs than one outside.
WEIGHT = 2
#: A part named as boilerplate is kept, and its own parts are judged, if it holds more than this share of the page's text.
SHARE = 0.7

# Element names of HTML, and words of class and id names of parts that are not the article.
RAW = frozenset("script style noscript template iframe object svg math canvas textarea title xmp noembed noframes".split())
SKIPPED = frozenset("nav footer aside button select menu datalist audio video map".split())
BOUNDED = frozenset("form dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr img".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset(["article", "main"])
KEPT = frozenset(["html", "body", "head"])
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice "
    "notices banner popup modal overlay menu nav navbar navigation breadcrumb breadcrumbs sidebar widget widgets footer header masthead "
    "comment comments commentlist disqus replies respond related recommended share sharing social newsletter subscribe signup login "
    "search pagination pager toolbar skip".split()
)
#: Words before a name that say that the element only has such a part, and words after it that leave its sense.
HAS = frozenset("has have with without no not is hide show".split())
TAILS = frozenset(
    "area articles bar block body bottom box button buttons col column container content icon icons inner input item items label "
    "left line link links list main news outer panel posts right row section slot slots stories text thread title top topics unit "
    "wrap wrapper".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/<>]*+)(?P<attrs>(?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+|[^<>]*+)>",
    re.S,
)
_ATTR = re.compile(r"(?i)\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}


def _named(value: str, strict: bool) -> bool:
    """Whether a class or id names such a part. ``strict`` wants no other word after the name (``related-work`` is none)."""
    for token in value.split():
        pieces = [x for x in re.split(r"[_-]+", token) if x]
        words = [w.lower() for x in pieces for w in ([x] if x.lower() in NAMES else _PART.findall(x) or [x])]
        hits = [i for i, w in enumerate(words) if w in NAMES]
        if not hits or HAS.intersection(words[: hits[0]]):
            continue
        if not strict or all(w in TAILS or w.isdigit() for w in words[hits[-1] + 1 :]):
            return True
    return False


def _boilerplate(name: str, attrs: str, inside: bool) -> bool:
    """Whether the name, role, class or id of an element is that of a part that is not the article; ``inside`` says that
    an article or main is open."""
    if name in KEPT:
        return False
    if name in BOUNDED or name == "header" and not inside:
        return True
    if "=" not in attrs and "hidden" not in attrs.lower():
        return False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), next((x for x in m.groups()[1:] if x is not None), "")
        if key == "hidden" and value.lower() != "until-found" or key == "aria-hidden" and value.lower() == "true":
            return True
        if key == "role" and value.lower() in ROLES:
            return True
        if name in HEADINGS or key == "id" and inside and name == "section":  # a place to link to
            continue
        if key in ("class", "id") and _named(value, inside or name in MAIN):
            return not (inside and value.lower().split("-")[0] in ("header", "entry"))
    return False


def _pieces(page: str) -> tuple[list[tuple[str, str, bool, str]], dict[int, int]]:
    """Each text with the tag after it (name, whether it ends, attributes), and the end tag of each start tag.

    Comments and elements that are never text are left out; one that ends in ``/>`` has no content.
    """
    pieces, close, opened, at = [], {}, {}, 0
    while True:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if m is None:
            pieces.append((text, "", False, ""))
            return pieces, close
        at, name = m.end(), (m["name"] or "").lower()
        end, attrs = bool(m["end"]), m["attrs"] or ""
        if name in RAW:
            if not end and not attrs.rstrip().endswith("/"):
                found = _RAW_END[name].search(page, at)
                at = found.end() if found else len(page)
            name = ""
        elif name and name not in VOID:
            if not end:
                opened.setdefault(name, []).append(len(pieces))
            elif opened.get(name):
                close[opened[name].pop()] = len(pieces)
        pieces.append((text, name, end, attrs))


def _unlinked(pieces: list[tuple[str, str, bool, str]], close: dict[int, int]) -> list[int]:
    """Characters outside links and parts that are always left out, up to each piece."""
    total, links, until, out = 0, False, -1, []
    for i, (text, name, end, _) in enumerate(pieces):
        if i > until and not links:
            total += len(text.strip())
        out.append(total)
        if name == "a":
            links = not end
        elif name in SKIPPED and not end and i > until:
            until = close.get(i, -1)
    return out


class Lines:
    """The lines of a page once markup is stripped: text, length outside links, and the number of its article or 0."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, int, int]] = []
        self.at: list[int] = []  # the piece that ends each line
        self.parts: list[str] = []
        self.linked: list[str] = []

    def text(self, raw: str, link: bool) -> None:
        self.parts.append(raw)
        if link:
            self.linked.append(raw)

    def end(self, at: int, inside: int, heading: bool = False) -> None:
        """Finish a line; all text of an article's heading counts, for it often links to its own page."""
        words = html.unescape("".join(self.parts)).split()
        line = " ".join(words)
        links = len(" ".join(html.unescape("".join(self.linked)).split())) if self.linked else 0
        if line:
            self.rows.append((line, len(line) if inside and heading else max(0, len(line) - links), inside))
            self.at.append(at)
        self.parts, self.linked = [], []

    def between(self, first: int, last: int) -> bool:
        """Whether a line ends in the pieces after ``first`` up to ``last``."""
        return bisect_right(self.at, last) > bisect_right(self.at, first)


def strip_markup(page: str, level: int = 2) -> list[tuple[str, int, int]]:
    """The lines of a page, one a block element.

    A part that is no article leaves nothing, and lines beside it in the same parent stay neighbours; at the edge of its
    parent it leaves a gap, as do the ends of an article. Level 1 leaves out by element only, level 0 nothing but
    elements that are never text (scripts and the like).
    """
    pieces, close = _pieces(page)
    unlinked = _unlinked(pieces, close)
    lines, i, open_main, articles, links, heading = Lines(), 0, 0, 0, False, False
    parents: list[int] = []
    removed: list[tuple[int, int, list[int]]] = []
    gaps: set[int] = set()

    while i < len(pieces):
        text, name, end, attrs = pieces[i]
        lines.text(text, links)
        inside = articles if open_main else 0
        while parents and close[parents[-1]] <= i:
            parents.pop()
        if not name:
            if i == len(pieces) - 1:
                lines.end(i, inside, heading)
            i += 1
            continue
        if name == "a":
            links = not end
        if not end and i in close and (
            level > 0 and name in SKIPPED
            or level > 1 and _boilerplate(name, attrs, open_main > 0) and unlinked[close[i]] - unlinked[i] <= SHARE * unlinked[-1]
        ):
            lines.end(i, inside, heading)
            removed.append((i, close[i], parents[::-1]))
            i, links = close[i] + 1, False
            continue
        if name in MAIN:
            lines.end(i, inside, heading)
            was, open_main = open_main, max(0, open_main + (-1 if end else 1))
            articles += not was and open_main
            if not was or not open_main:
                gaps.add(len(lines.rows))
        elif name not in INLINE:
            lines.end(i, inside, heading)
        if name in HEADINGS:
            heading = not end
        if i in close:
            parents.append(i)
        i += 1
    for first, last, above in removed:
        for p in [*above, -1]:
            end_of = close.get(p, len(pieces))
            before, after = lines.between(p, first), lines.between(last, end_of)
            if before or after:
                if not (before and after):
                    gaps.add(bisect_right(lines.at, first))
                break
    rows: list[tuple[str, int, int]] = []
    for k, row in enumerate(lines.rows):
        if k in gaps:
            rows += [("", 0, 0)] * WINDOW
        rows.append(row)
    return rows


def regions(lengths: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """Ranges of lines from a surge to a dive of the sums over sliding windows.

    A range begins with the window that first rises from nothing, counts if some window of it reaches ``surge``, and ends
    where a window falls to nothing.
    """
    sums, total = [], 0
    for i, n in enumerate(lengths):
        total += n - (lengths[i - window] if i >= window else 0)
        sums.append(total)  # of the window that ends here
    out, start, top = [], None, 0
    for i, s in enumerate([*sums, 0]):
        if s and start is None:
            start, top = i, 0
        if start is not None:
            top = max(top, s)
            if s == 0:
                if top >= surge:
                    out.append((start, i))
                start = None
    return out


def _ranges(rows: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """The ranges of lines that are the article.

    On every page, ranges that surge. The largest article or main element weighs ``WEIGHT`` times; unless a range
    outside articles still outweighs it, every range of its own counts, however short, and none outside articles.
    """
    lengths = [n for _, n, _ in rows]
    found = regions(lengths)
    sums: dict[int, int] = {}
    for line, n, article in rows:
        if article and line:
            sums[article] = sums.get(article, 0) + n
    best = max(sums, key=lambda k: (sums[k], -k), default=0)
    outside = max((sum(lengths[a:b]) for a, b in found if not rows[a][2]), default=0)
    if best and WEIGHT * sums[best] >= outside:
        own = regions([n if article == best else 0 for _, n, article in rows], surge=1)
        if not own:  # nothing but links
            own = [(i, i + 1) for i, r in enumerate(rows) if r[2] == best]
        return sorted(own + [(a, b) for a, b in found if rows[a][2] not in (0, best)])
    return found or sorted(regions(lengths, surge=1), key=lambda r: -sum(lengths[r[0] : r[1]]))[:1]


def main_text(page: str | None) -> str:
    """The article of a page as one line; empty if there is none."""
    if not page:
        return ""
    for level in (2, 1, 0):
        rows = strip_markup(page, level)
        text = " ".join(r[0] for a, b in _ranges(rows) for r in rows[a:b] if r[0])
        if text:
            return text
    return ""


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page; a null html gives an empty text.

    Pages are independent: no shuffle, one batch in memory. Other columns of ``pages`` are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, PAGES):
                part = batch.slice(a, PAGES)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.record_batch(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
