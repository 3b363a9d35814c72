"""Operator 8, main text of web pages by tree scoring.

Each page is read once by a tag scanner into a small element tree (implied
end tags, void and raw elements). Elements whose tag, role or class names say
menu, header, footer, sidebar, advert, notice, form or comments go, unless an
article lies inside them; forms and names (those of comments and consent apart)
do not count where they hold most of the page's text outside links. Where
nothing is left, the page is scored again without names and forms. Every remaining block of text gives points for its
length and commas to its container (all), the next (half) and further
ancestors (a third over the distance); a container's sum, with a bonus for
its tag, is discounted by its link density. The best container is lifted to an
article or main element around it, else to the nearest ancestor (below body)
whose other children hold half as much, again and again, so that paragraphs in
wrappers of their own stay together. It and its siblings of like score, of
paragraphs or of a title are kept, and a first heading further out where it has
none; link lists go, but not inside an article or main element, where names do
not count against a paragraph or a heading either (adverts apart).

The work is per row in Arrow batches without a shuffle; a page of any length
is one row and is read in time linear in its length and its nesting.

Defined results: null or empty html gives an empty text; repeated pages are
read each; markup cut off at the end of a page is dropped, the text before it
is kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicspark.llm.common import fresh, q

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+\Z""",
    re.DOTALL)
ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$|"|')""", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body button canvas caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav noscript ol option p pre search section select summary svg table tbody td template tfoot th thead tr ul video audio object".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
DROP_TAGS = frozenset("aside audio button canvas dialog footer form head header menu nav noscript object option search select svg template video".split())
DROP_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search".split())
DROP_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header masthead menu modal "
    "nav navbar navigation newsletter notice notices overlay pager pagination popup promo promotion related replies reply respond share sharing sidebar signup skip social sponsor "
    "sponsored subscribe toolbar widget".split())
AD_NAMES = frozenset("ad ads advert adverts advertisement advertising adsense promo promotion sponsor sponsored".split())
#: Elements of running text.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dd td".split())
#: Names that no wrapper of a page's body has.
FIRM_NAMES = frozenset("comment comments consent cookie cookies disqus gdpr replies reply respond".split())
#: Why an element goes: a name of a header or of running text, a form or another name, a firm name, its tag or role or that it is hidden.
HEADER, SOFT, FIRM, ALWAYS = 1, 2, 3, 4
#: Names that tell of a part elsewhere on the page, or of the head of an article.
LAYOUT = re.compile(r"\b(?:has|with|no|without|hide|show)[-_][a-z0-9_-]+|\bcomments?[-_](?:open|closed)\b|\b(?:article|entry|post|story)[-_]?header\b")
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
BONUS = {"article": 25, "main": 25, "div": 5, "section": 5, "td": 3, "blockquote": 3, "pre": 3, "ul": -3, "ol": -3, "dl": -3}
LEVELS = 5


def unwanted(tag: str, attrs: str) -> int:
    if tag in DROP_TAGS and tag != "form":
        return ALWAYS
    why = SOFT if tag == "form" else 0
    if not attrs or tag in ("html", "body"):
        return why
    for name, value in ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in DROP_ROLES:
            return ALWAYS
        if name == "style" and "display:none" in value.replace(" ", ""):
            return ALWAYS
        if name in ("class", "id") and (said := DROP_NAMES.intersection(re.split(r"[^a-z0-9]+", LAYOUT.sub("", value)))):
            mild = said == {"header"} or tag in PROSE and not said & AD_NAMES
            why = max(why, FIRM if said & FIRM_NAMES else HEADER if mild else SOFT)
    return why


class Page:
    """Elements in page order (parent, tag, unwanted) and blocks of text
    (element, text, characters inside links)."""

    def __init__(self, html: str):
        self.parent, self.tag, self.bad = [-1], ["html"], [0]
        self.blocks: list[tuple[int, str, int]] = []
        self.run: list[str] = []
        self.linked, self.links = 0, 0
        self.open = [0]  # of elements; inline ones too
        at, end = 0, len(html)
        while at < end:
            m = TAG.search(html, at)
            self.text(html[at:m.start()] if m else html[at:])
            if not m:
                break
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                self.close(tag)
            else:
                self.start(tag, m[3] or m[6] or "")
                if tag in RAW:
                    stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                    at = stop.end() if stop else end
        self.flush()

    def text(self, raw: str):
        if raw:
            said = unescape(raw) if "&" in raw else raw
            self.run.append(said)
            if self.links:
                self.linked += len(said.strip())

    def flush(self):
        if self.run:
            said = " ".join("".join(self.run).split())
            if said:
                block = next(k for k in reversed(self.open) if self.tag[k] in BLOCK)
                self.blocks.append((block, said, min(self.linked, len(said))))
            self.run, self.linked = [], 0

    def pop(self, depth: int):
        for k in self.open[depth:]:
            self.links -= self.tag[k] == "a"
        del self.open[depth:]

    def find(self, names, stop) -> int:
        """Depth of the innermost open element of ``names`` inside ``stop``; 0 if none."""
        for d in range(len(self.open) - 1, 0, -1):
            t = self.tag[self.open[d]]
            if t in names:
                return d
            if t in stop:
                break
        return 0

    def start(self, tag: str, attrs: str):
        if tag == "br":
            self.run.append(" ")
            return
        if tag in RAW:
            return
        if tag in BLOCK:
            self.flush()
            if d := self.find(("p",), BLOCK - {"p"}):
                self.pop(d)
            if tag in HEADINGS and (d := self.find(HEADINGS, BLOCK - HEADINGS)):
                self.pop(d)
            if tag in CLOSES and (d := self.find(*CLOSES[tag])):
                self.pop(d)
        if tag in VOID or tag == "html":
            return
        self.parent.append(self.open[-1])
        self.tag.append(tag)
        self.bad.append(unwanted(tag, attrs))
        self.open.append(len(self.tag) - 1)
        self.links += tag == "a"

    def close(self, tag: str):
        if tag in BLOCK:
            self.flush()
            if d := self.find((tag,), ()):
                self.pop(d)
        elif d := self.find((tag,), BLOCK):
            self.pop(d)


def main_text(html: str) -> str:
    page = Page(html)
    return chosen(page, bodies(page)) or chosen(page, [b if b == ALWAYS else 0 for b in page.bad], True)


def bodies(page: Page) -> list[int]:
    """Why elements go, without those forms and names that hold most of the text outside links."""
    parent, n = page.parent, len(page.tag)
    if not any(0 < b < FIRM for b in page.bad):
        return page.bad
    off, prose = [False] * n, [0] * n
    for k in range(1, n):
        off[k] = off[parent[k]] or page.bad[k] >= FIRM
    for k, said, inlink in page.blocks:
        if not off[k]:
            prose[k] += len(said) - inlink
    for k in range(n - 1, 0, -1):
        prose[parent[k]] += prose[k]
    return [0 if b < FIRM and 2 * x > prose[0] else b for b, x in zip(page.bad, prose)]


def chosen(page: Page, bad: list[int], scored: bool = False) -> str:
    """The text of the best container; ``scored``: empty if none has a score."""
    parent, tag, blocks = page.parent, page.tag, page.blocks
    n = len(tag)
    holds = [t in ("article", "main") and not b for t, b in zip(tag, bad)]  # an article at or below
    titled = [t in HEADINGS for t in tag]
    for k in range(n - 1, 0, -1):
        holds[parent[k]] |= holds[k]
        titled[parent[k]] |= titled[k]
    inside = [t in ("article", "main") for t in tag]
    gone = [False] * n
    for k in range(1, n):
        inside[k] |= inside[parent[k]]
        itself = tag[k] in ("article", "main")  # an advert or a comment can be an article
        heading = (tag[k] == "header" or bad[k] == HEADER) and inside[k] and (titled[k] or tag[k] in PROSE)  # an article's own title or text
        gone[k] = gone[parent[k]] or bad[k] and (itself or not holds[k]) and not heading
    size, linked, raw, prose, said_in_titles, said_in_p = [0] * n, [0] * n, [0.0] * n, [0.0] * n, [0] * n, [0] * n
    links = [int(t == "a" and not g) for t, g in zip(tag, gone)]
    for k, said, inlink in blocks:
        if gone[k]:
            continue
        size[k] += len(said)
        linked[k] += inlink
        points = 1 + said.count(",") + min(len(said) / 100, 3)
        prose[k] += points * (1 - inlink / len(said))
        said_in_titles[k] += len(said) * (tag[k] in HEADINGS)
        said_in_p[k] += (len(said) - inlink) * (tag[k] == "p")
        at = k if tag[k] in BONUS or tag[k] in ("body", "html") else parent[k]
        for level in range(LEVELS):
            if at < 0:
                break
            raw[at] += points / (1, 2, 6, 9, 12)[level]
            at = parent[at]
    for k in range(n - 1, 0, -1):
        size[parent[k]] += size[k]
        linked[parent[k]] += linked[k]
        links[parent[k]] += links[k]
        prose[parent[k]] += prose[k]
        said_in_titles[parent[k]] += said_in_titles[k]
        said_in_p[parent[k]] += said_in_p[k]
    score = [(r + BONUS.get(t, 0)) * (1 - d / s) if r and s else 0.0 for r, t, d, s in zip(raw, tag, linked, size)]
    best = max(range(n), key=lambda k: (score[k], -k))
    if not score[best]:
        if scored:
            return ""
        best = 0
    for names in (("article",), ("main",)):
        at = best
        while at > 0 and tag[at] not in names:
            at = parent[at]
        if at > 0:
            best = at
            break
    else:
        best = lifted(page, best, gone, size, linked, prose)
    least = max(10.0, score[best] / 5)
    body = tag[best] in ("article", "main") or inside[best]
    keep = [False] * n
    for k in range(n):
        sibling = best and k != best and parent[k] == parent[best] and size[k] and (score[k] >= least or linked[k] < size[k] / 4 and (
            tag[k] in HEADINGS or tag[k] == "p" and size[k] > 80 or 2 * said_in_titles[k] >= size[k] or said_in_p[k] > max(80, size[k] / 2)))
        keep[k] = k == best or sibling or k > 0 and keep[parent[k]]
        if keep[k] and k != best and not body and tag[k] in ("ul", "ol", "div", "table") and links[k] >= 3 and linked[k] > 0.7 * size[k]:
            gone[k] = True
        if k > 0 and gone[parent[k]]:
            gone[k] = True
    if not any(keep[k] and tag[k] == "h1" and not gone[k] for k in range(n)):
        first = next((k for k in range(n) if tag[k] == "h1" and not gone[k] and 0 < size[k] and linked[k] < size[k] / 2), 0)
        if first and first < best:  # the page's own title, before its text
            for k in range(first, n):
                keep[k] |= k == first or keep[parent[k]] and parent[k] >= first
    return "\n".join(said for k, said, _ in blocks if keep[k] and not gone[k])


def lifted(page: Page, best: int, gone: list[bool], size: list[int], linked: list[int], prose: list[float]) -> int:
    """``best``, or the ancestor below body in which it is one of several like parts."""
    parent, tag = page.parent, page.tag
    children: dict[int, list[int]] = {}
    for k in range(1, len(tag)):
        children.setdefault(parent[k], []).append(k)
    at = best
    while at > 0 and parent[at] > 0 and tag[parent[at]] not in ("body", "html"):
        up = parent[at]
        if any(k != at and not gone[k] and linked[k] < size[k] / 4 and 2 * prose[k] >= prose[best] for k in children[up]):
            best = up
        at = up
    return best


def page_texts(pages: DataFrame, html: str = "html") -> DataFrame:
    """The other columns of ``pages`` with text and n_chars (clashing ones
    are replaced)."""
    kept = [c for c in pages.columns if c != html and c.lower() not in ("text", "n_chars")]
    inner, = fresh(pages, "html")
    schema = T.StructType([*pages.select(*[q(c) for c in kept]).schema, T.StructField("text", T.StringType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) if h else "" for h in b.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(kept)], pa.array(texts, pa.string())], names=[*kept, "text"])

    return pages.select(*[q(c) for c in kept], q(html).alias(inner)).mapInArrow(read, schema).withColumn("n_chars", F.length("text").cast("long"))
