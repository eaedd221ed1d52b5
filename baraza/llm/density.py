"""Main text of web pages by composite text density.

A page is parsed to a tree (tag soup allowed). Parts that are never article text by their element or by their class,
id or role - menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments, hidden
parts - are set aside first. Every other node gets its composite density: characters for each tag, adjusted by the share
of characters and tags that stand in links. The node with the largest sum of its children's densities is the core of the
article; it grows to the article or main element around it, or else upwards as long as its parent is denser than the
page's body, the threshold of the path, or adds only headings and paragraphs.

* A null or empty page, or one without text, gives an empty text. Nothing inside the chosen subtree is dropped for being
  short, and nothing is capped.
* Ties go to the node that opens first. A null ``page_id`` and repeated rows are rows like any other.
* Columns besides ``page_id``, ``url`` and ``html`` are ignored; an empty table gives an empty result.
"""

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([a-zA-Z-]+)""")
_NAMES = re.compile("[a-z0-9]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in "script style textarea title xmp iframe noembed noframes".split()}
_ASIDE = frozenset("head script style noscript template iframe object svg canvas math audio video nav footer aside form button select textarea "
                   "fieldset dialog menu title xmp noembed noframes".split())
#: Words in class, id or role that mark what surrounds an article.
_AROUND = frozenset("""ad ads advert adverts advertisement advertisements advertising adsbygoogle sponsor sponsored promo promotion banner
    cookie cookies consent gdpr notice notices popup modal overlay paywall sidebar sidebars aside complementary rail menu menus nav navbar navigation
    breadcrumb breadcrumbs pagination pager footer contentinfo header masthead topbar comment comments commentlist replies disqus
    share sharing social related recommended recommendations newsletter subscribe login signin signup search searchbox toolbar skip""".split())
_HOMES = frozenset(("article", "main"))
_BLOCK = frozenset("""address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul""".split())
_ENDS_P = _BLOCK - {"body", "html", "caption", "tbody", "tfoot", "thead", "tr", "legend"}
#: Elements an opening tag closes, and where the search for them stops.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
           "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
           "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"})}
_CONTAINERS = frozenset("div section center td aside".split())


class _Page:
    """A parsed page: nodes in the order they open, and the stream of texts and breaks."""

    def __init__(self, source: str):
        self.tag, self.parent, self.last, self.around = ["#page"], [-1], [0], [False]
        self.stream: list[tuple[int, str | None]] = []
        self._open = [0]
        at, n = 0, len(source)
        while at < n:
            found = _TAG.search(source, at)
            self._text(source[at:found.start() if found else n])
            if not found:
                break
            at = found.end()
            name = found[2]
            if not name:
                continue
            name = name.lower()
            if found[1]:
                self._end(name)
            else:
                self._start(name, found[3])
                if name in _RAW:
                    close = _RAW[name].search(source, at)
                    at = close.start() if close else n
        self._close(0)

    def _text(self, text: str) -> None:
        if text:
            self.stream.append((self._open[-1], text))

    def _close(self, depth: int) -> None:
        for node in reversed(self._open[depth:]):
            self.last[node] = len(self.tag) - 1
            if self.tag[node] in _BLOCK:
                self.stream.append((node, None))
        del self._open[depth:]

    def _end(self, name: str) -> None:
        for depth in range(len(self._open) - 1, 0, -1):
            if self.tag[self._open[depth]] == name:
                self._close(depth)
                return

    def _start(self, name: str, attributes: str) -> None:
        if name in _ENDS_P:
            self._close_in({"p"}, {"button", "table", "article", "section", "div", "td", "li", "blockquote", "body"})
        if name in _CLOSES:
            self._close_in(*_CLOSES[name])
        above = self._open[-1]
        node = len(self.tag)
        self.tag.append(name)
        self.parent.append(above)
        self.last.append(node)
        self.around.append(name in _ASIDE or _named_around(name, attributes))
        if name in _BLOCK:
            self.stream.append((node, None))
        elif name in ("br", "td", "th"):
            self.stream.append((node, " "))
        if name not in _VOID:
            self._open.append(node)

    def _close_in(self, names: set[str], stop: set[str]) -> None:
        lowest = 0
        for depth in range(len(self._open) - 1, 0, -1):
            tag = self.tag[self._open[depth]]
            if tag in names:
                lowest = depth
            if tag in stop:
                break
        if lowest:
            self._close(lowest)


def _named_around(tag: str, attributes: str) -> bool:
    if not attributes.strip() or tag in ("body", "html", *_HOMES):
        return False
    for found in _ATTRIBUTE.finditer(attributes):
        name = (found[1] or found[5]).lower()
        value = (found[2] or found[3] or found[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name in ("class", "id", "role") and not _AROUND.isdisjoint(_NAMES.findall(value)):
            return True
    return False


def _set_aside(page: _Page) -> list[bool]:
    """Whether each node is set aside, by itself or by what it stands in."""
    many = len(page.tag)
    homes = [0] * (many + 1)  # article and main elements before each node
    for i in range(many):
        homes[i + 1] = homes[i] + (page.tag[i] in _HOMES)
    aside, inside = [False] * many, [False] * many
    for i in range(1, many):
        up = page.parent[i]
        tag = page.tag[i]
        inside[i] = inside[up] or tag in _HOMES
        own = tag in _ASIDE or page.around[i] and homes[page.last[i] + 1] == homes[i] and not (tag == "header" and inside[i])
        aside[i] = aside[up] or own or tag == "header" and not inside[i]
    return aside


def _densities(page: _Page, aside: list[bool], lengths: list[int], body: int) -> tuple[list[float], list[float], list[bool]]:
    """Composite density of every node, the sum of its children's, and whether it is mostly links; own text counts as a child."""
    many = len(page.tag)
    chars, links, tags, link_tags, inside = lengths[:], [0] * many, [0] * many, [0] * many, [False] * many
    for i in range(1, many):
        inside[i] = page.tag[i] == "a" or inside[page.parent[i]]
    for i in range(many - 1, 0, -1):
        if aside[i]:
            continue
        if inside[i]:
            links[i] = chars[i]
        up = page.parent[i]
        chars[up] += chars[i]
        links[up] += links[i]
        tags[up] += tags[i] + 1
        link_tags[up] += link_tags[i] + (page.tag[i] == "a")
    share = links[body] / max(chars[body], 1)
    density, total = [0.0] * many, [float(x) for x in lengths]
    for i in range(many - 1, 0, -1):
        if aside[i] or not chars[i]:
            continue
        c, t = chars[i], max(tags[i], 1)
        plain, linked, linked_tags = max(c - links[i], 1), max(links[i], 1), max(link_tags[i], 1)
        base = math.log(c / plain * links[i] + share * c + math.e)
        density[i] = c / t * math.log(max(c / linked * t / linked_tags, 1)) / base if links[i] else c / t * math.log(max(c * t, 1) + 1) / base
        total[page.parent[i]] += density[i]
    return density, total, [2 * x > c for x, c in zip(links, chars)]


def main_text(source: str) -> str:
    """The blocks of the article, in page order, joined by blank lines."""
    page = _Page(source)
    aside = _set_aside(page)
    lengths = [0] * len(page.tag)
    for node, text in page.stream:
        if text and not aside[node]:
            lengths[node] += len(" ".join(text.split()))
    body = next((i for i, tag in enumerate(page.tag) if tag == "body"), 0)
    density, total, linked = _densities(page, aside, lengths, body)
    inner = [i for i in range(body + 1, page.last[body] + 1 if body else len(page.tag)) if not aside[i] and page.tag[i] in _BLOCK]
    best = max(inner, key=lambda i: total[i], default=body)
    homes = [i for i in inner if page.tag[i] in _HOMES and density[i] > 0]
    if total[body] >= total[best]:
        best = homes[0] if len(homes) == 1 and not lengths[body] else body
    best = _grown(page, aside, density, linked, best, body)
    last = page.last[best] if best else len(page.tag) - 1
    blocks, now = [], []
    for node, text in page.stream:
        if not best <= node <= last or aside[node]:
            continue
        if text is None:
            blocks.append(now)
            now = []
        else:
            now.append(html.unescape(text))
    blocks.append(now)
    joined = (" ".join("".join(b).split()) for b in blocks)
    return "\n\n".join(b for b in joined if b)


def _grown(page: _Page, aside: list[bool], density: list[float], linked: list[bool], best: int, body: int) -> int:
    node = best
    while node > body:
        if page.tag[node] in _HOMES:
            return node
        node = page.parent[node]
    siblings: dict[int, list[int]] = {}
    for i in range(body + 1, len(page.tag)):
        if not aside[i] and density[i] > 0:
            siblings.setdefault(page.parent[i], []).append(i)
    node = best
    while node > body:
        up = page.parent[node]
        if up < body or up == 0 and body:
            break
        plain = all(page.tag[i] not in _CONTAINERS and not linked[i] for i in siblings.get(up, []) if i != node)
        if not (plain or up != body and density[up] > density[body]):
            break
        node = up
    return node


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` of every page."""
    kinds = dict(pages.dtypes)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([main_text(x) for x in batch.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), found], names=["page_id", "url", "text"])

    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).mapInArrow(
        texts, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
