"""URL parsing by the public URL Standard, and the normal form that every table keys on. Plain Python, no Spark."""

from __future__ import annotations

import ipaddress
import re
from dataclasses import dataclass, field, replace
from functools import lru_cache

SPECIAL = {"http": "80", "https": "443", "ftp": "21", "ws": "80", "wss": "443", "file": ""}
#: What a script language of the web counts as white space.
JS_SPACE = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_CONTROL = "".join(map(chr, range(33)))
_HEX = frozenset("0123456789abcdefABCDEF")
_UNRESERVED = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~")
_FRAGMENT = frozenset(' "<>`')
_QUERY = frozenset(' "#<>')
_SPECIAL_QUERY = _QUERY | {"'"}
_PATH = _QUERY | frozenset("?^`{}")
_USERINFO = _PATH | frozenset("/:;=@[\\]|")
_BAD_HOST = frozenset("\0\t\n\r #/:<>?@[\\]^|%") | frozenset(map(chr, range(32))) | {"\x7f"}
_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.\-]*):")

#: Names of tracking and session parameters.
STRIP_PARAMS: tuple = (
    *"_ga _gl dclid fbclid gbraid gclid igshid mc_cid mc_eid msclkid ref spm wbraid".split(),
    re.compile("^utm_", re.I), re.compile("^(?:sid|session_?id|jsessionid|phpsessid)$", re.I),
)


def encode(text: str, escaped: frozenset[str]) -> str:
    """Percent-encode controls, non-ASCII (as UTF-8) and the set's characters."""
    out = []
    for c in text:
        if c in escaped or c < " " or c >= "\x7f":
            out += [f"%{b:02X}" for b in c.encode("utf-8", "replace" if "\ud800" <= c <= "\udfff" else "strict")] if not "\ud800" <= c <= "\udfff" else ["%EF%BF%BD"]
        else:
            out.append(c)
    return "".join(out)


@dataclass
class Url:
    scheme: str = ""
    username: str = ""
    password: str = ""
    host: str | None = None
    port: str = ""
    path: str = ""
    query: str | None = None
    fragment: str | None = None
    opaque: bool = False

    @property
    def hostname(self) -> str:
        return self.host or ""

    @property
    def host_port(self) -> str:
        return f"{self.hostname}:{self.port}" if self.port else self.hostname

    @property
    def search(self) -> str:
        return f"?{self.query}" if self.query else ""

    @property
    def hash(self) -> str:
        return f"#{self.fragment}" if self.fragment else ""

    @property
    def href(self) -> str:
        out = self.scheme + ":"
        if self.host is not None:
            out += "//"
            if self.username or self.password:
                out += self.username + (":" + self.password if self.password else "") + "@"
            out += self.host_port
        elif not self.opaque and self.path.startswith("//"):
            out += "/."
        out += self.path
        out += "" if self.query is None else "?" + self.query
        return out + ("" if self.fragment is None else "#" + self.fragment)


def _number(part: str) -> int | None:
    if part == "":
        return None
    base = 10
    if part[:2] in ("0x", "0X"):
        part, base = part[2:], 16
    elif len(part) > 1 and part[0] == "0":
        part, base = part[1:], 8
    if part == "":
        return 0
    digits = "0123456789abcdef"[:base]
    return int(part, base) if all(c in digits for c in part.lower()) else None


def _ipv4(host: str) -> str | None:
    """The address in dotted form; '' if the host doesn't end in a number; None if it does and is no address."""
    parts = host.split(".")
    if parts[-1] == "" and len(parts) > 1:
        parts.pop()
    last = parts[-1]
    if not (last.isdigit() and last.isascii() or last[:2] in ("0x", "0X") and _number(last) is not None):
        return ""
    if len(parts) > 4:
        return None
    numbers = [_number(p) for p in parts]
    if any(n is None for n in numbers) or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        return None
    total = numbers[-1] + sum(n << 8 * (3 - i) for i, n in enumerate(numbers[:-1]))
    return ".".join(str(total >> s & 255) for s in (24, 16, 8, 0))


def _ipv6(text: str) -> str | None:
    if "%" in text:
        return None
    try:
        groups = [int.from_bytes(ipaddress.IPv6Address(text).packed[i : i + 2], "big") for i in range(0, 16, 2)]
    except ValueError:
        return None
    best, at = (0, 0), 0
    while at < 8:
        end = at
        while end < 8 and groups[end] == 0:
            end += 1
        if end - at > max(best[0], 1):
            best = end - at, at
        at = max(end, at + 1)
    size, at = best
    words = [f"{g:x}" for g in groups]
    return ":".join(words) if not size else ":".join(words[:at]) + "::" + ":".join(words[at + size :])


def _to_ascii(host: str) -> str | None:
    if host.isascii() and "xn--" not in host.lower():
        return host.lower()
    try:
        import idna

        return idna.encode(host, uts46=True, transitional=False).decode().lower()
    except ImportError:
        pass
    except Exception:  # noqa: BLE001 - any refusal means the host is invalid
        return None
    try:
        return host.encode("idna").decode().lower()
    except UnicodeError:
        return None


def _host(text: str, special: bool) -> str | None:
    if text.startswith("["):
        found = _ipv6(text[1:-1]) if text.endswith("]") else None
        return None if found is None else f"[{found}]"
    if not special:
        return None if any(c in _BAD_HOST - {"%"} for c in text) else encode(text, frozenset())
    plain = _unquote(text)
    try:
        decoded = plain.decode("utf-8")
    except UnicodeDecodeError:
        decoded = plain.decode("utf-8", "replace")
    ascii_ = _to_ascii(decoded)
    if not ascii_ or any(c in _BAD_HOST for c in ascii_):
        return None
    address = _ipv4(ascii_)
    return ascii_ if address == "" else address


def _unquote(text: str) -> bytes:
    raw, out, i = text.encode("utf-8", "surrogatepass"), bytearray(), 0
    while i < len(raw):
        if raw[i] == 37 and i + 2 < len(raw) + 0 and chr(raw[i + 1]) in _HEX and chr(raw[i + 2]) in _HEX:
            out.append(int(raw[i + 1 : i + 3], 16))
            i += 3
        else:
            out.append(raw[i])
            i += 1
    return bytes(out)


def _is_dot(segment: str) -> bool:
    return segment == "." or segment.lower() == "%2e"


def _is_dots(segment: str) -> bool:
    return segment.lower().replace("%2e", ".") == ".." and len(segment) <= 6


def _drive(segment: str) -> bool:
    return len(segment) == 2 and segment[0].isalpha() and segment[0].isascii() and segment[1] in ":|"


def _path(text: str, scheme: str, base: list[str]) -> str:
    special = scheme in SPECIAL
    segments = list(base)
    parts = re.split(r"[/\\]" if special else "/", text)
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if _is_dots(part):
            if segments and not (scheme == "file" and len(segments) == 1 and _drive(segments[0])):
                segments.pop()
            if last:
                segments.append("")
        elif _is_dot(part):
            if last:
                segments.append("")
        else:
            if scheme == "file" and not segments and _drive(part):
                part = part[0] + ":"
            segments.append(encode(part, _PATH))
    return "/" + "/".join(segments) if segments else ""


def parse(text: str, base: str | Url | None = None) -> Url | None:
    """The URL of a text, against a base if given; None where the standard's parser fails."""
    if isinstance(base, str):
        base = parse(base)
        if base is None:
            return None
    text = text.strip(_CONTROL)
    if "\t" in text or "\n" in text or "\r" in text:
        text = text.replace("\t", "").replace("\n", "").replace("\r", "")
    m = _SCHEME.match(text)
    if m:
        scheme, rest = m[1].lower(), text[m.end() :]
        relative = scheme in SPECIAL and scheme != "file" and base is not None and base.scheme == scheme and not re.match(r"[/\\]{2}" if scheme in SPECIAL else "//", rest)
        if not relative:
            return _absolute(scheme, rest, base)
        text = rest
    elif base is None:
        return None
    assert base is not None
    scheme = base.scheme
    special = scheme in SPECIAL
    body, fragment = (text.split("#", 1) + [None])[:2]
    frag = None if fragment is None else encode(fragment, _FRAGMENT)
    if base.opaque:
        return replace(base, fragment=frag) if body == "" and fragment is not None else None
    if scheme == "file":
        return _absolute(scheme, text, base)
    start = re.match(r"[/\\]{2}" if special else "//", body)
    if start:
        return _authority(scheme, text[2:])
    body, query = (body.split("?", 1) + [None])[:2]
    quoted = None if query is None else encode(query, _SPECIAL_QUERY if special else _QUERY)
    if body == "":
        return replace(base, query=base.query if query is None else quoted, fragment=frag)
    slashes = "/\\" if special else "/"
    above = [] if body[0] in slashes else base.path.split("/")[1:-1]
    return replace(base, path=_path(body[1:] if body[0] in slashes else body, scheme, above), query=quoted, fragment=frag)


def _absolute(scheme: str, rest: str, base: Url | None) -> Url | None:
    special = scheme in SPECIAL
    if scheme == "file":
        return _file(rest, base if base is not None and base.scheme == "file" else None)
    if special:
        return _authority(scheme, rest.lstrip("/\\"))
    if rest.startswith("//"):
        return _authority(scheme, rest[2:])
    body, fragment = (rest.split("#", 1) + [None])[:2]
    body, query = (body.split("?", 1) + [None])[:2]
    url = Url(scheme, query=None if query is None else encode(query, _QUERY), fragment=None if fragment is None else encode(fragment, _FRAGMENT))
    if body.startswith("/"):
        return replace(url, path=_path(body[1:], scheme, []))
    return replace(url, path=encode(body, frozenset()), opaque=True)


def _file(rest: str, base: Url | None) -> Url | None:
    body, fragment = (rest.split("#", 1) + [None])[:2]
    body, query = (body.split("?", 1) + [None])[:2]
    url = Url("file", host="", query=None if query is None else encode(query, _SPECIAL_QUERY), fragment=None if fragment is None else encode(fragment, _FRAGMENT))
    if re.match(r"[/\\]{2}", body):
        host, slash, path = re.match(r"([^/\\]*)([/\\]?)(.*)", body[2:], re.S).groups()
        if _drive(host):
            return replace(url, path=_path(host + slash + path, "file", []))
        found = _host(host, True) if host else ""
        if found is None:
            return None
        path = _path(path, "file", []) or "/"
        lost = found == "localhost" or _drive(path[1:].split("/")[0])  # a drive letter stands in the host's stead
        return replace(url, host="" if lost else found, path=path)
    if body[:1] in ("/", "\\") and body:
        return replace(url, path=_path(body[1:], "file", []))
    if base is None:
        return replace(url, path=_path(body, "file", []) or "/")
    if body == "":
        return replace(base, query=base.query if query is None else url.query, fragment=url.fragment)
    return replace(url, host=base.host, path=_path(body, "file", base.path.split("/")[1:-1]))


def _authority(scheme: str, rest: str) -> Url | None:
    special = scheme in SPECIAL
    m = re.match(r"[^/\\?#]*" if special else r"[^/?#]*", rest)
    authority, rest = m[0], rest[m.end() :]
    user, at, hostport = authority.rpartition("@")
    username = password = ""
    if at:
        name, _, secret = user.partition(":")
        username, password = encode(name, _USERINFO), encode(secret, _USERINFO)
    m = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::(.*))?", hostport, re.S)
    if not m:
        return None
    host, port = m[1], m[2] or ""
    if port and not (port.isascii() and port.isdigit()) or port and int(port) > 65_535:
        return None
    if host == "" and (special or at or m[2] is not None):
        return None
    found = _host(host, special) if host else ""
    if found is None:
        return None
    port = str(int(port)) if port else ""
    body, fragment = (rest.split("#", 1) + [None])[:2]
    body, query = (body.split("?", 1) + [None])[:2]
    path = _path(body[1:], scheme, []) if body else "/" if special else ""
    return Url(
        scheme, username, password, found, "" if SPECIAL.get(scheme) == port else port, path or ("/" if special else ""),
        None if query is None else encode(query, _SPECIAL_QUERY if special else _QUERY), None if fragment is None else encode(fragment, _FRAGMENT),
    )


def canon_percent(text: str) -> str:
    """Decode triplets of unreserved bytes, put others in upper case, and quote a stray percent sign."""
    if "%" not in text:
        return text
    head, *parts = text.split("%")
    out = [head]
    for part in parts:
        if len(part) >= 2 and part[0] in _HEX and part[1] in _HEX:
            c = chr(int(part[:2], 16))
            out.append((c if c in _UNRESERVED else "%" + part[:2].upper()) + part[2:])
        else:
            out.append("%25" + part)
    return "".join(out)


def parse_form(query: str) -> list[tuple[str, str]]:
    out = []
    for part in query.split("&"):
        if part:
            name, _, value = part.partition("=")
            out.append(tuple(_unquote(x.replace("+", " ")).decode("utf-8", "replace") for x in (name, value)))
    return out


def form(pairs: list[tuple[str, str]]) -> str:
    def one(text: str) -> str:
        return "".join(chr(b) if chr(b) in _FORM else "+" if b == 32 else f"%{b:02X}" for b in text.encode("utf-8", "replace"))

    return "&".join(f"{one(a)}={one(b)}" for a, b in pairs)


_FORM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789*-._")


def units(text: str) -> int:
    """Length in UTF-16 units."""
    return len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2


@dataclass(frozen=True)
class NormalizeOptions:
    allow_schemes: tuple[str, ...] = ("http", "https")
    strip_fragment: bool = True
    keep_hashbang: bool = False
    normalize_encoding: bool = True
    collapse_slashes: bool = True
    trailing_slash: str = "keep"
    normalize_query: bool = True
    strip_params: tuple = field(default=STRIP_PARAMS)
    sort_params: bool = True
    strip_empty_params: bool = False
    strip_www: bool = False
    max_length: int = 2048


DEFAULTS = NormalizeOptions()


def _stripped(name: str, patterns: tuple) -> bool:
    low = name.lower()
    return any(p.lower() == low if isinstance(p, str) else p.search(name) is not None for p in patterns)


def normalize(text: str | None, base: str | None = None, o: NormalizeOptions = DEFAULTS) -> str | None:
    """The normal form of a URL, or None where it isn't one to fetch. Normal forms are fixed points."""
    if text is None or not (text := text.strip(JS_SPACE)):
        return None
    url = parse(text, base if base and base.strip(JS_SPACE) else None)
    if url is None or url.scheme not in {s.strip().lower().rstrip(":") for s in o.allow_schemes}:
        return None
    if url.host is None and url.path.startswith("//"):  # only spelled with a guard, which joining would lose
        return None
    hash_ = url.hash
    if o.strip_fragment and not (o.keep_hashbang and hash_.startswith("#!")):
        hash_ = ""
    elif hash_ and o.normalize_encoding:
        hash_ = canon_percent(hash_)
    hostname = url.hostname.rstrip(".") or url.hostname
    if o.strip_www:
        while hostname.startswith("www.") and "." in hostname[4:]:
            hostname = hostname[4:]
    path = canon_percent(url.path) if o.normalize_encoding else url.path
    if o.collapse_slashes:
        path = re.sub("/{2,}", "/", path)
    if o.trailing_slash == "strip" and path:
        path = path.rstrip("/") or "/"
    if o.normalize_query:
        pairs = [p for p in parse_form(url.query or "") if not (o.strip_empty_params and p[1] == "") and not _stripped(p[0], o.strip_params)]
        if o.sort_params:
            pairs.sort(key=lambda p: p[0].encode("utf-16-be", "surrogatepass"))
        query = form(pairs)
        search = "?" + query if query else ""
    else:
        search = canon_percent(url.search) if o.normalize_encoding else url.search
    user = url.username + (":" + url.password if url.password else "") + "@" if url.username or url.password else ""
    out = f"{url.scheme}:{'//' if url.host is not None else ''}{user}{hostname}{':' + url.port if url.port else ''}{path}{search}{hash_}"
    if units(out) > o.max_length:
        return None
    if url.scheme not in ("http", "https"):
        again = parse(out)
        if again is None or (again.scheme, again.username, again.password, again.hostname, again.port, again.path, again.search, again.hash) != (
            url.scheme, url.username, url.password, hostname, url.port, path, search, hash_,
        ):
            return None
    return out


def resolve(href: str, base: str) -> str | None:
    """The absolute form of a link, as the standard's parser spells it."""
    url = parse(href, _base(base))
    return None if url is None else url.href


@lru_cache(4096)
def _base(base: str) -> Url | None:
    return parse(base)


def normalize_entry(text: str | None, o: NormalizeOptions = DEFAULTS) -> str | None:
    """A seed: as ``normalize``, but a bare host (with port or path) gets https."""
    if text is None or not (text := text.strip(JS_SPACE)):
        return None
    found = normalize(text, None, o)
    if found is not None or re.match("https?://", text, re.I):
        return found
    authority = re.split("[/?#]", text, maxsplit=1)[0]
    return normalize("https://" + text, None, o) if re.fullmatch(r"[^@:\s]+(?::[0-9]+)?", authority) else None


def mask_userinfo(text: str | None) -> str | None:
    """The URL with its password hidden; the user's name stays, and so does everything else as it is spelled."""
    if text is None or "@" not in text or (url := parse(text)) is None or not url.password:
        return text
    m = re.search(r"//([^/?#\\]*)@", text)
    if not m or text.find("//") != m.start():
        return f"{url.scheme}://{url.username}:***@{url.host_port}{url.path}{url.search}{url.hash}"
    return f"{text[: m.start(1)]}{m[1].partition(':')[0]}:***{text[m.end(1) :]}"


def scheme_of(text: str) -> str:
    m = _SCHEME.match(text)
    return m[1].lower() if m else ""


def dotted(host: str) -> list[int] | None:
    """The four numbers of a dotted address, whatever their size up to three digits."""
    parts = host.split(".")
    fits = len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 for p in parts)
    return [int(p) for p in parts] if fits else None


def private_host(host: str | None) -> bool:
    """Loopback, link-local and private addresses and names."""
    host = (host or "").strip(JS_SPACE).lower()
    host = (host[1:-1] if host.startswith("[") and host.endswith("]") else host).rstrip(".")
    if host in ("localhost", "::1", "::") or host.endswith(".localhost"):
        return True
    address = dotted(host.removeprefix("::ffff:"))
    if address:
        a, b, *_ = address
        near = a in (0, 10, 127) or (a, b) in ((169, 254), (192, 168)) or a == 100 and 64 <= b <= 127 or a == 172 and 16 <= b <= 31
        return max(address) <= 255 and near
    return ":" in host and host.startswith(("fe80:", "fc", "fd"))


SECOND_LEVEL = frozenset("ac co com edu go gov mil ne net or org sch".split())


def registrable_domain(host: str | None) -> str | None:
    """The part of a host that is registered: two labels, three under a two-letter country with a second level."""
    host = (host or "").strip(JS_SPACE).lower()
    if host.startswith("["):
        return host
    host = host[:-1] if host.endswith(".") else host
    if not host or dotted(host):
        return host or None
    labels = host.split(".")
    if len(labels) == 1:
        return host
    need = 3 if len(labels[-1]) == 2 and labels[-2] in SECOND_LEVEL else 2
    return None if "" in labels or len(labels) < need else ".".join(labels[-need:])


def same_site(a: str | None, b: str | None, subdomains: str = "same-host") -> bool:
    """Whether two hosts are one site."""
    a, b = ((h or "").strip(JS_SPACE).lower().rstrip(".") for h in (a, b))
    if not a or not b:
        return False
    if subdomains == "any":
        return True
    if subdomains == "same-site":
        x, y = registrable_domain(a), registrable_domain(b)
        return a == b if x is None or y is None else x == y
    return a == b
