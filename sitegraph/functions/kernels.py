"""The plain-Python kernels as Arrow functions: each body crosses into Python once and comes back as one struct."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegraph.functions.columns import simple_url
from sitegraph.html import kernel as html
from sitegraph.html import robots as rules
from sitegraph.url import kernel as url
from sitegraph.url.kernel import DEFAULTS, NormalizeOptions

LINKS = (
    "array<struct<href:string,url:string,tag:string,rel:string,nofollow:boolean,ugc:boolean,sponsored:boolean,region:string,"
    "anchor_text:string,hreflang:string>>"
)
PAGE = f"struct<title:string,base:string,noindex:boolean,nofollow:boolean,raw:array<string>,links:{LINKS}>"
DIRECTIVES = "struct<noindex:boolean,nofollow:boolean,raw:array<string>>"
RULES = "array<struct<group_no:int,agent:string,rule_no:int,allow:boolean,pattern:string,crawl_delay:double>>"
SITEMAP = "struct<kind:string,entries:array<struct<url:string,lastmod:string,changefreq:string,priority:double>>>"

#: Rows that are Python's objects at once.
SLICE = 128

_LINK = pa.struct(
    [(n, pa.bool_() if n in ("nofollow", "ugc", "sponsored") else pa.string()) for n in html.Link._fields]
)
_RAW = pa.list_(pa.string())


def _fn(kernel, kind: str, arrow: pa.DataType):
    def rows(*columns: pa.Array) -> pa.Array:
        # A slice at a time: as Python's objects, texts and what is found in them take many times the room they have in Arrow.
        parts = [pa.array([], arrow)]
        for i in range(0, len(columns[0]), SLICE):
            parts.append(pa.array([kernel(*values) for values in zip(*(c.slice(i, SLICE).to_pylist() for c in columns))], arrow))
        return pa.concat_arrays(parts)

    def one(a: pa.Array) -> pa.Array:
        return rows(a)

    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return rows(a, b)

    def make(*columns: Column | str) -> Column:
        return F.arrow_udf({1: one, 2: two}[len(columns)], kind)(*columns)

    return make


def normalize_url(c: Column, base: Column | None = None, o: NormalizeOptions = DEFAULTS) -> Column:
    """Normal forms; with default options, URLs that are plainly normal stay in the JVM."""
    both = _fn(lambda t, b=None: url.normalize(t, b, o), "string", pa.string())
    if base is not None:
        return both(c, base)
    if o is not DEFAULTS:
        return both(c)
    return F.when(simple_url(c), c).otherwise(both(F.when(~simple_url(c), c)))


def normalize_urls(c: Column, o: NormalizeOptions = DEFAULTS) -> Column:
    """Normal forms of an array's URLs."""
    return _fn(lambda ts: None if ts is None else [url.normalize(t, None, o) for t in ts], "array<string>", _RAW)(c)


def normalize_entry(c: Column, o: NormalizeOptions = DEFAULTS) -> Column:
    return _fn(lambda t: url.normalize_entry(t, o), "string", pa.string())(c)


def resolve_url(href: Column, base: Column) -> Column:
    return _fn(lambda h, b: None if h is None or b is None else url.resolve(h, b), "string", pa.string())(href, base)


mask_userinfo = _fn(url.mask_userinfo, "string", pa.string())
canon_percent = _fn(lambda t: None if t is None else url.canon_percent(t), "string", pa.string())
decode_entities = _fn(lambda t: None if t is None else html.decode(t), "string", pa.string())
text_of = _fn(lambda t: None if t is None else html.collapse(html.decode(html.text_of(t))), "string", pa.string())
base_href = _fn(lambda h, b: html.base_href(h, b or ""), "string", pa.string())
title = _fn(html.title, "string", pa.string())
glob = _fn(lambda p, t: p is not None and rules.glob(p, rules.target(t)), "boolean", pa.bool_())
gunzip = _fn(rules.gunzip, "binary", pa.binary())
#: Whether an origin's rules (pattern, allow) let a path be asked for.
robots_verdict = _fn(lambda own, path: rules.verdict([(r["pattern"], r["allow"]) for r in own or ()], path), "boolean", pa.bool_())


def extract_links(body: Column, base: Column, o: html.ExtractOptions = html.ExtractOptions()) -> Column:
    return _fn(lambda h, b: [x._asdict() for x in html.links(h, b, o)], LINKS, pa.list_(_LINK))(body, base)


def read_page(body: Column, base: Column, o: html.ExtractOptions = html.ExtractOptions()) -> Column:
    """Title, base, directives and links of a page in one pass through Python."""

    def kernel(h: str | None, b: str | None) -> dict:
        noindex, nofollow, raw = html.meta_robots(h)
        found = [x._asdict() for x in html.links(h, b, o)]
        return {"title": html.title(h), "base": html.base_href(h, b or ""), "noindex": noindex, "nofollow": nofollow, "raw": raw, "links": found}

    kind = pa.struct([("title", pa.string()), ("base", pa.string()), ("noindex", pa.bool_()), ("nofollow", pa.bool_()), ("raw", _RAW), ("links", pa.list_(_LINK))])
    return _fn(kernel, PAGE, kind)(body, base)


_THREE = pa.struct([("noindex", pa.bool_()), ("nofollow", pa.bool_()), ("raw", _RAW)])


def meta_robots(body: Column, names: tuple[str, ...] = ("robots",)) -> Column:
    return _fn(lambda h: dict(zip(("noindex", "nofollow", "raw"), html.meta_robots(h, names))), DIRECTIVES, _THREE)(body)


def x_robots_tag(header: Column, bot: str = "") -> Column:
    return _fn(lambda h: dict(zip(("noindex", "nofollow", "raw"), html.x_robots_tag(h, bot))), DIRECTIVES, _THREE)(header)


def robots_rules(text: Column) -> Column:
    names = ("group_no", "agent", "rule_no", "allow", "pattern", "crawl_delay")
    kind = pa.list_(pa.struct(list(zip(names, (pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.float64())))))
    return _fn(lambda t: [dict(zip(names, r)) for r in rules.rows(t)], RULES, kind)(text)


robots_sitemaps = _fn(lambda t: rules.parse_robots(t)[1], "array<string>", _RAW)


def sitemap(text: Column) -> Column:
    names = ("url", "lastmod", "changefreq", "priority")
    kind = pa.struct([("kind", pa.string()), ("entries", pa.list_(pa.struct(list(zip(names, (pa.string(),) * 3 + (pa.float64(),))))))])

    def kernel(t: str | None) -> dict:
        root, entries = rules.sitemap(t)
        return {"kind": root, "entries": [dict(zip(names, e)) for e in entries]}

    return _fn(kernel, SITEMAP, kind)(text)
