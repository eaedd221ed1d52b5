"""URL and anchor functions as Spark columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from baraza import fixed_values as fv
from baraza.functions.text import let, strip

_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def origin(url: Column) -> Column:
    """``scheme://host[:port]``."""
    return F.concat(F.regexp_extract(url, _PARTS, 1), F.lit("://"), F.regexp_extract(url, _PARTS, 2))


def handle(url: Column) -> Column:
    """The path behind ``/handle/``, else null."""
    parts = F.filter(F.split(F.regexp_extract(url, _PARTS, 3), "/"), lambda p: p != "")
    at = F.array_position(parts, "handle").cast("int")
    return F.when(at > 0, F.array_join(F.slice(parts, at + 1, F.size(parts)), "/"))


def host(url: Column) -> Column:
    authority = F.regexp_replace(F.regexp_extract(url, _PARTS, 2), "^.*@", "")
    return F.lower(F.regexp_replace(authority, r":\d*$", ""))


def _number(dotted: str) -> int:
    a, b, c, d = (int(x) for x in dotted.split("."))
    return (a << 24) + (b << 16) + (c << 8) + d


def url_error(url: Column, blocked=tuple(fv.BLOCKED_NETWORKS)) -> Column:
    """Why a document URL is refused (scheme, host, private address literal), or null.

    Names are not resolved; ``localhost`` counts as the loopback address.
    """
    octet = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    literal = rf"^{octet}\.{octet}\.{octet}\.{octet}$"
    name = F.when(host(url) == "localhost", "127.0.0.1").otherwise(host(url))
    number = F.lit(0).cast("bigint")
    for group in range(1, 5):
        number = number * 256 + F.regexp_extract(name, literal, group).cast("bigint")
    inside = F.lit(False)
    for network, bits in blocked:
        first = _number(network)
        inside = inside | number.between(first, first + (1 << (32 - bits)) - 1)
    return (F.when(~scheme(url).isin("http", "https"), "unsupported_scheme").when(host(url) == "", "missing_host")
            .when(name.rlike(literal), F.when(inside, "private_address")))


def _walk(path: Column) -> Column:
    """An absolute path with its ``.`` and ``..`` steps taken."""
    segments = F.split(path, "/")

    def steps(parts):
        last = F.element_at(parts, -1)
        return F.concat(F.slice(parts, 2, F.size(parts)), F.when(last.isin(".", ".."), F.array(F.lit("")))
                        .otherwise(F.array().cast("array<string>")))

    walked = F.aggregate(let(segments, steps), F.array().cast("array<string>"), lambda acc, s: F.when(
        s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == ".", acc).otherwise(
        F.array_append(acc, s)))
    # Most links have nothing to take.
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), F.concat(F.lit("/"), F.array_join(walked, "/"))).otherwise(path)


def resolve(base: Column, href: Column) -> Column:
    """Absolute URL of ``href`` found on the page ``base``."""
    root, base_path = origin(base), F.regexp_extract(base, _PARTS, 3)
    path, tail = F.regexp_extract(href, r"^[^?#]*", 0), F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    folder = F.regexp_replace(base_path, "[^/]*$", "")
    beside = F.regexp_replace(F.concat(F.when(folder == "", "/").otherwise(folder), path), "/{2,}", "/")
    full = let(F.when(href.startswith("/"), path).otherwise(beside), _walk)
    return (F.when(scheme(href) != "", href).when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
            .when(path == "", F.concat(root, base_path, tail)).otherwise(F.concat(root, full, tail)))


# ---- anchors ---------------------------------------------------------------------------------
def visible_html(html: Column) -> Column:
    """Markup without comments, scripts and styles."""
    return F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", "")


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value inside an opening tag; null if absent."""
    pattern = rf"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    value = F.concat(*[F.regexp_extract(tag, pattern, g) for g in (1, 2, 3)])
    return F.when(tag.rlike(pattern), unescape(value))


def unescape(text: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def inner_text(markup: Column) -> Column:
    """Text pieces between tags, trimmed and joined by single spaces."""
    pieces = F.transform(F.split(markup, r"(?s)<[^>]*>"), lambda p: strip(unescape(p)))
    return F.array_join(F.filter(pieces, lambda p: p != ""), " ")


def anchors(html: Column) -> Column:
    """``array<struct<href, title, is_pdf>>`` of the usable links in page order (repeats included)."""
    found = F.regexp_extract_all(visible_html(html), F.lit(r"(?is)<a\b[^>]*>.*?</a\s*>"), F.lit(0))

    def link(a):
        tag = F.regexp_extract(a, r"(?is)^<a\b[^>]*>", 0)

        def fields(parts):
            href, text = parts["href"], parts["text"]
            title = F.when(text != "", text).otherwise(F.regexp_extract(href, r"([^/]*)$", 1))
            return F.struct(href.alias("href"), strip(title).alias("title"), F.lower(href).endswith(".pdf").alias("is_pdf"))

        return let(F.struct(strip(attribute(tag, "href")).alias("href"), inner_text(a).alias("text")), fields)

    def usable(l):
        h = l["href"]
        return (h.isNotNull() & (h != "") & ~h.startswith("#") & ~h.startswith("javascript:") & ~h.startswith("mailto:"))

    return F.filter(F.transform(found, link), usable)
