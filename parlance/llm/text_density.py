"""Main text of HTML pages by composite text density.

A tolerant scan builds the DOM without scripts, styles, comments and elements that are boilerplate by
their tag, role or class. A class or id speaks if it consists of boilerplate words and words for boxes
alone, so ``related-work`` or ``has-sidebar`` says nothing; that of an article or main element never
does, but for a comment inside an article. Every node gets a density: its characters for each tag, adjusted by a
logarithm of how few of them are links (base and argument as in the composite text density of Sun,
Song and Liao, 2011). The node with the largest sum of its children's densities is the core. The
least density on the path from the body to the core is the threshold: what stands beside the path,
below the body, is kept from that density on. A core inside an article or main element stands for
that whole element, and articles beside an article are kept from the threshold on. Children of the body
beside the core are kept if their density and their sum are at least half of the core's.

A page is read in one pass, in time in proportion to its length, however deep or broken it is.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.session import prepare

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup; nothing of it is text of the page.
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Boilerplate by tag.
DROPPED = frozenset("nav footer aside form menu dialog select button object canvas audio video head search input".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Boilerplate by a class or id of such words, unless the element holds the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice notices notification popup overlay modal newsletter subscribe subscription signup login share sharing social related recommended recommendations pagination pager widget toolbar disclaimer skip".split()
)
COMMENTS = frozenset("comment comments commentlist disqus respond replies".split())
#: Words for boxes, which may stand beside those.
BOXES = frozenset(
    "area articles bar block body bottom box button buttons card column container content desktop form global group inline inner item items label left link links list main message mobile outer page panel post posts primary reader right secondary section site slot text thread title top unit user users wrap wrapper".split()
)
#: What a child of the body beside the core needs, as a share of the core's density and sum.
BESIDE = 0.5
#: A start tag of the second group ends an open element of the first.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_MARKUP = re.compile(
    r"""<!--(?s:.*?)(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z](?s:.*)"""
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_WHITE = re.compile(r"\s+")


class Dom:
    """Nodes in page order: parents come before their children. Node 0 is the root."""

    def __init__(self, page: str):
        self.tag, self.parent, self.attributes = ["#root"], [-1], [""]
        self.events: list[tuple[int, str | None]] = []  # (node, decoded text) and (node, None) at its start, in page order
        # open elements, and where in their list those of a tag, and blocks, stand
        self.stack, self.places, self.blocks = [0], {}, []
        self._read(page)

    def _open(self, tag: str, attributes: str) -> None:
        self.tag.append(tag)
        self.parent.append(self.stack[-1])
        self.attributes.append(attributes)
        self.events.append((len(self.tag) - 1, None))
        if tag not in VOID:
            self.places.setdefault(tag, []).append(len(self.stack))
            if tag in BLOCK:
                self.blocks.append(len(self.stack))
            self.stack.append(len(self.tag) - 1)

    def _end(self, tags: set[str], bounds: set[str] | frozenset[str]) -> None:
        """Closes the nearest open element of ``tags`` if no element of ``bounds`` is nearer."""
        nearest = lambda names: max((self.places[t][-1] for t in names if self.places.get(t)), default=0)
        k = nearest(tags)
        if not k or k < ((self.blocks[-1] if self.blocks else 0) if bounds is BLOCK else nearest(bounds)):
            return
        for node in self.stack[k:]:
            self.places[self.tag[node]].pop()
            if self.tag[node] in BLOCK:
                self.blocks.pop()
        del self.stack[k:]

    def _read(self, page: str) -> None:
        at, size = 0, len(page)
        while at < size:
            found = _MARKUP.search(page, at)
            upto = found.start() if found else size
            if upto > at:
                self.events.append((self.stack[-1], html.unescape(page[at:upto])))
            if not found:
                return
            at = found.end()
            tag = (found[2] or "").lower()
            if not tag:
                continue
            if found[1]:
                if tag in BLOCK:
                    self._end({tag}, frozenset() if tag not in ("p", "li") else frozenset({"article", "body", "td", "table"}))
                else:
                    self._end({tag}, BLOCK)
                continue
            if tag in RAW:
                if not found[3].rstrip().endswith("/") or tag not in ("svg", "math"):
                    close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                    at = close.end() if close else size
                continue
            if tag in _CLOSES:
                self._end(*_CLOSES[tag])
            if tag in BLOCK and tag not in ("option", "tr", "td", "th", "tbody", "thead", "tfoot", "html", "body"):
                self._end({"p"}, frozenset({"article", "section", "div", "table", "td", "th", "li", "body", "button", "object"}))
            self._open(tag, found[3])


def _speaks(name: str, words: frozenset[str]) -> bool:
    """Whether a class or id consists of some of these words, and of words for boxes."""
    found = set(_WORD.findall(name))
    return bool(found & words) and found <= words | MARKS | COMMENTS | BOXES


def _boilerplate(dom: Dom) -> list[bool]:
    """Whether each node is dropped by itself or with an ancestor."""
    n = len(dom.tag)
    holds = [False] * n  # the article or its heading is inside
    inside = [False] * n  # inside article or main
    for i in range(n - 1, 0, -1):
        if holds[i] or dom.tag[i] in ("article", "main", "h1"):
            holds[dom.parent[i]] = True
    out = [False] * n
    for i in range(1, n):
        tag, up = dom.tag[i], dom.parent[i]
        inside[i] = inside[up] or tag in ("article", "main")
        if out[up] or tag in DROPPED or tag == "header" and not inside[i] and not holds[i]:
            out[i] = True
            continue
        if not dom.attributes[i] or tag in ("html", "body"):
            continue
        named = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(dom.attributes[i])}
        names = f"{named.get('class', '')} {named.get('id', '')}".lower().split()
        if "hidden" in named or named.get("aria-hidden") == "true" or _HIDDEN.search(named.get("style", "")):
            out[i] = True
        elif tag in ("article", "main"):
            out[i] = tag == "article" and inside[up] and any(_speaks(x, COMMENTS) for x in names)
        elif any(_speaks(x, COMMENTS) for x in names):
            out[i] = not holds[i] or any(x in COMMENTS for x in names)
        elif not holds[i]:
            out[i] = any(_speaks(x, MARKS) for x in names) or named.get("role", "").lower() in ROLES or not inside[i] and any(_speaks(x, _HEADER) for x in names)
    return out


_HEADER = frozenset(["header"])


def _densities(dom: Dom, dropped: list[bool], body: int) -> tuple[list[float], list[float], list[int]]:
    """Density, sum of the children's densities, and characters of each node."""
    n = len(dom.tag)
    chars, links, tags, link_tags, in_link = [0] * n, [0] * n, [0] * n, [0] * n, [False] * n
    for i in range(1, n):
        in_link[i] = dom.tag[i] == "a" or in_link[dom.parent[i]]
    for node, text in dom.events:
        if text and not dropped[node]:
            size = len(_WHITE.sub(" ", text).strip())
            chars[node] += size
            links[node] += size if in_link[node] else 0
    for i in range(n - 1, 0, -1):
        if not dropped[i]:
            up = dom.parent[i]
            chars[up] += chars[i]
            links[up] += links[i]
            tags[up] += tags[i] + 1
            link_tags[up] += link_tags[i] + (dom.tag[i] == "a")
    whole = links[body] / max(chars[body], 1)
    density, total = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        if dropped[i] or not chars[i]:
            continue
        c, t = chars[i], max(tags[i], 1)
        lc, lt = max(links[i], 1), max(link_tags[i], 1)
        base = math.log(c / max(c - links[i], 1) * links[i] + whole * c + math.e)
        density[i] = c / t * math.log(max(c / lc * t / lt, 1.0)) / math.log(max(base, 1.0) + 1e-9) if base > 1.0000001 else c / t * math.log(max(c / lc * t / lt, 1.0) + math.e)
        if i:
            total[dom.parent[i]] += density[i]
    return density, total, chars


def main_text(page: str | None) -> str:
    """The text of a page's article: its blocks in page order, joined by an empty line; "" if none."""
    if not page:
        return ""
    dom = Dom(page)
    dropped = _boilerplate(dom)
    n = len(dom.tag)
    body = next((i for i in range(n) if dom.tag[i] == "body"), 0)
    density, total, chars = _densities(dom, dropped, body)
    if not chars[body]:
        body = 0
    under = [False] * n
    under[body] = True
    for i in range(body + 1, n):
        under[i] = under[dom.parent[i]] and not dropped[i]
    nodes = [i for i in range(body, n) if under[i] and chars[i]]
    if not nodes:
        return ""
    core = max(nodes, key=lambda i: (total[i], density[i], -i))
    path = [core]
    while path[-1] != body:
        path.append(dom.parent[path[-1]])
    whole = [i for i in path if dom.tag[i] in ("article", "main")]
    keep = [False] * n
    threshold = min(density[i] for i in path)
    if whole:
        own = whole[0]
        keep[own] = True
        if dom.tag[own] == "article":
            for i in nodes:
                if dom.tag[i] == "article" and dom.parent[i] == dom.parent[own] and density[i] >= threshold:
                    keep[i] = True
    else:
        keep[core] = True
        beside = set(path[1:-1]) - {body}
        on_path = set(path)
        for i in nodes:
            up = dom.parent[i]
            if i not in on_path and (
                up in beside and density[i] >= threshold
                or up == body and core != body and density[i] >= BESIDE * min(density[k] for k in path if k != body) and total[i] >= BESIDE * total[core]
            ):
                keep[i] = True
    for i in range(1, n):
        keep[i] = (keep[i] or keep[dom.parent[i]]) and not dropped[i]
    blocks, held, last = [], [], None
    owner = [0] * n
    for i in range(1, n):
        owner[i] = i if dom.tag[i] in BLOCK else owner[dom.parent[i]]
    for node, text in dom.events:
        if text is None:
            if dom.tag[node] in BLOCK and held:
                blocks.append("".join(held))
                held = []
            elif dom.tag[node] == "br" and held:
                held.append(" ")
        elif keep[node]:
            if held and owner[node] != last:
                blocks.append("".join(held))
                held = []
            held.append(text)
            last = owner[node]
    blocks.append("".join(held))
    return "\n\n".join(b for b in (_WHITE.sub(" ", x).strip() for x in blocks) if b)


def extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
        )


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row for each row of ``pages``: page_id, url, text, n_chars.

    Defined cases: a null, empty or textless page has text "" and n_chars 0; a null page_id or url
    stays null; markup that is cut off or wrongly nested is read as browsers do, roughly; repeated
    rows give repeated rows; an empty table gives no rows; other columns are not read.
    """
    prepare(pages.sparkSession)
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html"))
    return rows.mapInArrow(extract_batches, "page_id long, url string, text string, n_chars long")
