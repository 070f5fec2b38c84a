"""A tolerant one-pass reader of HTML: tokens, attributes, entities, links, title, base and robots directives.

Plain Python, no Spark. Every function is total: malformed input gives fewer rows, never an error. Work is linear in the page:
searches for closing tags are bounded by a window, and entities by a length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

from sitegraph.url.kernel import JS_SPACE, parse, units

_CLASS = "[" + re.escape(JS_SPACE) + "]"
_SPACES = re.compile(_CLASS + "+")
_GAP = r"[ \t\n\f\r]"
_NAME = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9\-_:.]*+)")
# One step within a tag: a value after "=" (quoted, bare or missing), or a stretch without "=".
_STEP = re.compile(rf"(=){_GAP}*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|(?=>)|\Z|[^ \t\n\f\r>\"'][^ \t\n\f\r>]*+)|[^=>]++")
_REST = re.compile(rf"(?:{_STEP.pattern.replace('(=)', '=')})*+")
_ATTR = re.compile(rf"([^{re.escape(JS_SPACE)}\"'>/=]+){_CLASS}*(?:={_CLASS}*(\"[^\"]*\"|'[^']*'|[^{re.escape(JS_SPACE)}>]+))?")
_ENTITY = re.compile(r"&(#[xX][0-9a-fA-F]{1,9}|#[0-9]{1,10}|[A-Za-z]{2,11});")
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\xa0"}
RAW_TEXT = frozenset("textarea title style script".split())
LANDMARKS = frozenset("article aside footer header main nav".split())
REGION_DEPTH, WINDOW, TITLE_LENGTH = 64, 4096, 512


class Token(NamedTuple):
    name: str  # empty for what is no tag
    closing: bool
    void: bool
    rest: str
    start: int
    end: int


def _close(name: str, html: str, at: int, limit: int | None = None) -> int:
    """Where a closing tag of this name begins, or -1; names end where a name character doesn't follow."""
    m = _closers(name).search(html, at, len(html) if limit is None else min(len(html), limit + len(name) + 3))
    return m.start() if m and (limit is None or m.start() < limit) else -1


_CLOSERS: dict[str, re.Pattern] = {}


def _closers(name: str) -> re.Pattern:
    if name not in _CLOSERS:
        _CLOSERS[name] = re.compile(rf"</{name}(?![A-Za-z0-9\-_:.])", re.I | re.A)
    return _CLOSERS[name]


def scan(html: str) -> Iterator[Token]:
    """Tags and everything else that isn't text, in order. A tag that the page's end cuts still counts."""
    at, size = 0, len(html)
    while (lt := html.find("<", at)) >= 0:
        mark = None
        if html.startswith("<!--", lt):
            mark, skip = "-->", 4
        elif html.startswith("<![CDATA[", lt):
            mark, skip = "]]>", 9
        elif html[lt + 1 : lt + 2] in ("!", "?"):
            mark, skip = ">", 2
        if mark:
            end = html.find(mark, lt + skip)
            at = size if end < 0 else end + len(mark)
            yield Token("", False, False, "", lt, at)
            continue
        m = _NAME.match(html, lt)
        if not m:
            at = lt + 1
            continue
        stop = _REST.match(html, m.end()).end()
        rest = html[m.end() : stop]
        name, closing = m[2].lower(), m[1] == "/"
        void = False
        if rest.rstrip(" \t\n\f\r").endswith("/"):
            last = None
            for last in _STEP.finditer(rest):
                if last[0].strip(" \t\n\f\r") == "" and not last[1]:
                    continue
                void = not last[1] and last[0].rstrip(" \t\n\f\r").endswith("/")
        at = min(stop + 1, size)
        yield Token(name, closing, void, rest, lt, at)
        if not closing and not void and name in RAW_TEXT:
            end = _close(name, html, at)
            end = size if end < 0 else end
            if end > at:
                yield Token("", False, False, "", at, end)
            at = end


def decode(text: str) -> str:
    """Numeric and six named entities; anything else stays as it stands."""

    def one(m: re.Match) -> str:
        body = m[1]
        if len(body) > 11:
            return m[0]
        if body[0] != "#":
            return _NAMED.get(body.lower(), m[0])
        code = int(body[2:], 16) if body[1] in "xX" else int(body[1:])
        return m[0] if code == 0 or code > 0x10FFFF or 0xD800 <= code <= 0xDFFF else chr(code)

    return _ENTITY.sub(one, text) if "&" in text else text


def attributes(rest: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTR.finditer(rest):
        name, value = m[1].lower(), m[2] or ""
        if name not in found:
            if value[:1] in ('"', "'") and value:
                value = value[1:-1] if len(value) > 1 and value[-1] == value[0] else value[1:]
            found[name] = decode(value)
    return found


def trim(text: str) -> str:
    return text.strip(JS_SPACE)


def collapse(text: str) -> str:
    return trim(_SPACES.sub(" ", text))


def text_of(fragment: str) -> str:
    out, at = [], 0
    for t in scan(fragment):
        out.append(fragment[at : t.start] if t.start > at else "")
        at = t.end
    return "".join([*out, fragment[at:]])


def cap(text: str, most: int) -> str:
    """At most so many UTF-16 units, never half a character."""
    if units(text) <= most:
        return text
    return text.encode("utf-16-le")[: 2 * most].decode("utf-16-le", "ignore")


def tokens_of(rel: str | None) -> frozenset[str]:
    return frozenset(filter(None, re.split(rf"(?:{_CLASS}|,)+", (rel or "").lower())))


def refresh_url(content: str) -> str | None:
    m = re.search("[;,]", content)
    rest = trim(content[m.end() :] if m else content)
    head = re.match(rf"url{_CLASS}*={_CLASS}*", rest, re.I)
    if head:
        rest = trim(rest[head.end() :])
    elif not m:
        return None
    if len(rest) > 1 and rest[0] in "\"'" and rest[-1] == rest[0]:
        rest = trim(rest[1:-1])
    return rest or None


@dataclass(frozen=True)
class ExtractOptions:
    anchors: bool = True
    canonical: bool = True
    next_prev: bool = True
    meta_refresh: bool = True
    alternate: bool = False
    iframes: bool = False
    assets: bool = False
    srcset: bool = False
    max_anchor_text: int = 200
    max_links: int = 10_000


class Link(NamedTuple):
    href: str
    url: str | None
    tag: str
    rel: str
    nofollow: bool
    ugc: bool
    sponsored: bool
    region: str | None
    anchor_text: str | None
    hreflang: str | None


def links(html: str | None, base_url: str | None, o: ExtractOptions = ExtractOptions()) -> list[Link]:
    """The links of a page in order, neither deduplicated nor filtered; a <base> governs those before it too."""
    out: list[tuple] = []
    regions: list[str] = []
    base_href = None
    html = html or ""

    def add(tag: str, rel: str, value: str | None, rels: frozenset = frozenset(), text: str | None = None, lang: str | None = None) -> None:
        if value is not None and (href := trim(value)):
            out.append((href, tag, rel, "nofollow" in rels, "ugc" in rels, "sponsored" in rels, regions[-1] if regions else None, text, lang or None))

    for t in scan(html):
        name = t.name
        if name in LANDMARKS:
            if t.closing:
                if name in regions:
                    del regions[len(regions) - 1 - regions[::-1].index(name) :]
            elif not t.void and len(regions) < REGION_DEPTH:
                regions.append(name)
            continue
        if not name or t.closing:
            continue
        if len(out) >= o.max_links:
            break
        if name not in _SOURCES:
            continue
        attrs = attributes(t.rest)
        get = attrs.get
        if name == "base":
            if base_href is None:
                base_href = trim(get("href", "")) or None
        elif name in ("a", "area"):
            if o.anchors:
                text = None
                if name == "a" and o.max_anchor_text > 0:
                    limit = min(len(html), t.end + WINDOW)
                    end = _close("a", html, t.end, limit)
                    text = cap(collapse(decode(text_of(html[t.end : limit if end < 0 else end]))), o.max_anchor_text) or None
                add(name, "page", get("href"), tokens_of(get("rel")), text)
        elif name == "link":
            rels = tokens_of(get("rel"))
            if not get("href"):
                continue
            for words, rel, on in (
                (("canonical",), "canonical", o.canonical), (("next",), "next", o.next_prev), (("prev", "previous"), "prev", o.next_prev),
                (("stylesheet",), "asset", o.assets), (("alternate",), "alternate", o.alternate),
            ):
                if rels.intersection(words):
                    if on:
                        add("link", rel, get("href"), rels, lang=trim(get("hreflang", "")) if rel == "alternate" else None)
                    break
        elif name == "meta":
            if o.meta_refresh and trim(get("http-equiv", "")).lower() == "refresh":
                add("meta", "page", refresh_url(get("content", "")))
        elif name in ("iframe", "frame"):
            if o.iframes:
                add(name, "iframe", get("src"))
        else:
            if o.assets:
                add(name, "asset", get("src"))
                if name == "video":
                    add(name, "asset", get("poster"))
            if o.srcset and name in ("img", "source"):
                for part in get("srcset", "").split(","):
                    add(name, "asset", _SPACES.split(trim(part))[0])
    root = parse(base_url or "")
    base = root
    if base_href is not None:
        base = parse(base_href, root) or root
    resolved = []
    for href, *rest in out[: o.max_links]:
        url = parse(href, base) if base is not None else None
        resolved.append(Link(href, url.href if url else None, *rest))
    return resolved


_SOURCES = frozenset("base a area link meta iframe frame img source script video audio".split())


def base_href(html: str | None, base_url: str) -> str:
    for t in scan(html or ""):
        if t.name == "base" and not t.closing and (href := trim(attributes(t.rest).get("href", ""))):
            url = parse(href, base_url)
            return url.href if url else base_url
    return base_url


def title(html: str | None, most: int = TITLE_LENGTH) -> str | None:
    depth = 0
    html = html or ""
    for t in scan(html):
        if t.name == "svg":
            depth = max(0, depth - 1) if t.closing else depth + (not t.void)
        elif t.name == "title" and not t.closing and not t.void and depth == 0:
            limit = min(len(html), t.end + WINDOW)
            end = _close("title", html, t.end, limit)
            return cap(collapse(decode(text_of(html[t.end : limit if end < 0 else end]))), most) or None
    return None


class Directives:
    """noindex and nofollow from directive words; ``raw`` keeps each word once, in order."""

    def __init__(self) -> None:
        self.noindex = self.nofollow = False
        self.raw: list[str] = []

    def apply(self, word: str) -> None:
        word = trim(word).lower()
        if word and word not in self.raw:
            self.raw.append(word)
        self.noindex |= word in ("noindex", "none")
        self.nofollow |= word in ("nofollow", "none")

    def tuple(self) -> tuple[bool, bool, list[str]]:
        return self.noindex, self.nofollow, self.raw


def meta_robots(html: str | None, names: tuple[str, ...] = ("robots",)) -> tuple[bool, bool, list[str]]:
    wanted, found = {trim(n).lower() for n in names} - {""}, Directives()
    for t in scan(html or "") if wanted else ():
        if t.name == "meta" and not t.closing:
            attrs = attributes(t.rest)
            if trim(attrs.get("name", "")).lower() in wanted:
                for word in attrs.get("content", "").split(","):
                    found.apply(word)
    return found.tuple()


VALUED = frozenset(("unavailable_after", "max-video-preview", "max-snippet", "max-image-preview"))


def x_robots_tag(header: str | None, bot: str = "") -> tuple[bool, bool, list[str]]:
    """Directives of a header: words before any agent's name are for all, those after ``agent:`` for that agent."""
    found, applies, bot = Directives(), True, trim(bot).lower()
    for part in (header or "").split(","):
        part = trim(part)
        agent, colon, rest = part.partition(":")
        agent = trim(agent).lower()
        if colon and agent not in VALUED:
            applies = agent != "" and bot != "" and agent in bot
            part = rest
        if applies and trim(part):
            found.apply(part)
    return found.tuple()
