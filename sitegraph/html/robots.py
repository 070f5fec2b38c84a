"""robots.txt and sitemaps as rows. Plain Python, total and linear."""

from __future__ import annotations

import gzip
import math
import re
import zlib

from sitegraph.html.kernel import decode, trim
from sitegraph.url.kernel import parse

MAX_LINES, MAX_PATTERN, MAX_ENTRIES = 10_000, 2_000, 50_000
_FLOAT = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")


def number(text: str) -> float | None:
    """The number a text begins with, if finite."""
    m = _FLOAT.match(trim(text))
    value = float(m[0]) if m else math.inf
    return value if math.isfinite(value) else None


def parse_robots(text: str | None) -> tuple[list[dict], list[str]]:
    """(groups, sitemaps); a group has agents, rules as (allow, pattern) and a delay or None."""
    groups: list[dict] = []
    sitemaps: list[str] = []
    gathering = False
    for raw in re.split("\r?\n", (text or "").removeprefix("\ufeff"))[:MAX_LINES]:
        key, colon, value = trim(raw.split("#", 1)[0]).partition(":")
        if not colon:
            continue
        key, value = trim(key).lower(), trim(value)
        if key == "sitemap":
            if value:
                sitemaps.append(value)
        elif key == "user-agent":
            if value:
                if not gathering:
                    groups.append({"agents": [], "rules": [], "delay": None})
                    gathering = True
                groups[-1]["agents"].append(value.lower())
        elif key in ("allow", "disallow", "crawl-delay"):
            if not groups:
                groups.append({"agents": ["*"], "rules": [], "delay": None})
            gathering = False
            if key == "crawl-delay":
                seconds = number(value)
                if groups[-1]["delay"] is None and seconds is not None and seconds >= 0:
                    groups[-1]["delay"] = seconds
            elif value and len(value) <= MAX_PATTERN:
                groups[-1]["rules"].append((key == "allow", value))
    return groups, sitemaps


def rows(text: str | None) -> list[tuple]:
    """(group, agent, rule, allow, pattern, delay): a row for each agent and rule; groups without rules have one row per agent."""
    out = []
    for g, group in enumerate(parse_robots(text)[0]):
        for agent in dict.fromkeys(group["agents"]):
            rules = group["rules"] or [(None, None)]
            out += [(g, agent, r if allow is not None else None, allow, pattern, group["delay"]) for r, (allow, pattern) in enumerate(rules)]
    return out


def glob(pattern: str, path: str) -> bool:
    """Whether a pattern (with * and a final $) matches the beginning of a path; linear in pattern times stars, no backtracking."""
    anchored = pattern.endswith("$")
    parts = (pattern[:-1] if anchored else pattern).split("*")
    if not path.startswith(parts[0]):
        return False
    at = len(parts[0])
    if len(parts) == 1:
        return not anchored or at == len(path)
    for part in parts[1:-1]:
        at = path.find(part, at)
        if at < 0:
            return False
        at += len(part)
    return path.endswith(parts[-1]) and len(path) - len(parts[-1]) >= at if anchored else path.find(parts[-1], at) >= 0


def target(path: str | None) -> str:
    if not path:
        return "/"
    if path[0] != "/":
        url = parse(path) if re.match(r"[a-z][a-z0-9+.\-]*:", path, re.I) else None
        path = url.path + url.search if url else "/" + path
    return path.split("#", 1)[0]


def selected(groups: list[dict], agent: str | None) -> list[dict]:
    """The groups of the longest agent name contained in ours; without one, those for everybody."""
    ua = (agent or "").lower()
    best = [max((len(a) for a in g["agents"] if a != "*" and a in ua), default=-1) for g in groups]
    top = max(best, default=-1)
    return [g for g, b in zip(groups, best) if b == top] if top >= 0 else [g for g in groups if "*" in g["agents"]]


def verdict(rules: list[tuple[str, bool]], path: str | None) -> bool:
    """Of the patterns that match, the longest decides, an allowing one on a tie; without any, yes."""
    hits = [(len(p), a) for p, a in rules if glob(p, target(path))]
    return max(hits)[1] if hits else True


def allowed(groups: list[dict], path: str | None, agent: str | None) -> bool:
    return verdict([(p, a) for g in selected(groups, agent) for a, p in g["rules"]], path)


def delay(groups: list[dict], agent: str | None) -> float | None:
    return max((g["delay"] for g in selected(groups, agent) if g["delay"] is not None), default=None)


def gunzip(body: bytes | None) -> bytes | None:
    """A body unpacked if it begins like gzip; a damaged one as it is."""
    if body and body[:2] == b"\x1f\x8b":
        try:
            return gzip.decompress(body)
        except (OSError, EOFError, zlib.error):
            return body
    return body


_OPEN = re.compile(r"<([A-Za-z_][A-Za-z0-9_\-.:]*+)((?:[^>\"']++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)")


def _tags(xml: str, *names: str):
    """(name, start, end, void) of opening tags with these local names."""
    for m in _OPEN.finditer(xml):
        local = m[1].lower().rpartition(":")[2]
        if local in names:
            yield local, m.start(), m.end(), m[2].endswith("/")


def _close(xml: str, name: str, at: int, limit: int) -> int:
    m = re.compile(rf"</(?:[A-Za-z0-9_\-.:]*:)?{name}(?![A-Za-z0-9_\-.:])", re.I | re.A).search(xml, at, limit)
    return m.start() if m else -1


def _value(raw: str) -> str | None:
    parts = raw.split("<![CDATA[")
    text = parts[0] + "".join(p.replace("]]>", "", 1) for p in parts[1:])
    return trim(decode(text)) or None


def _fields(block: str, names: tuple[str, ...]) -> list[str | None]:
    found: dict[str, str | None] = {}
    for name, _, end, void in _tags(block, *names):
        if name not in found:
            stop = _close(block, name, end, len(block))
            found[name] = None if void else _value(block[end : stop if stop >= 0 else len(block)])
    return [found.get(n) for n in names]


def sitemap(text: str | None) -> tuple[str, list[tuple]]:
    """(kind, entries): entries are (url, lastmod, changefreq, priority); an index has the first two only."""
    text = text or ""
    if "<" not in text:
        lines = [x for x in map(trim, re.split("\r?\n", text)) if re.match("https?:", x, re.I)]
        return "urlset", [(x, None, None, None) for x in lines[:MAX_ENTRIES]]
    root = next(_tags(text, "urlset", "sitemapindex"), ("urlset",))[0]
    name, out = ("sitemap", []) if root == "sitemapindex" else ("url", [])
    blocks = [(end, void, start) for _, start, end, void in _tags(text, name)]
    skip = 0
    for i, (begin, void, start) in enumerate(blocks):
        if void or start < skip:
            continue
        limit = blocks[i + 1][2] if i + 1 < len(blocks) else len(text)
        stop = _close(text, name, begin, limit)
        url, lastmod, freq, priority = _fields(text[begin : stop if stop >= 0 else limit], ("loc", "lastmod", "changefreq", "priority"))
        if url is None:
            continue
        out.append((url, lastmod, None, None) if name == "sitemap" else (url, lastmod, freq, number(priority) if priority else None))
        if len(out) >= MAX_ENTRIES:
            break
    return root, out
