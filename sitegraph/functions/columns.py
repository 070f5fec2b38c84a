"""URL rules as native column expressions. They read normal forms (``sitegraph.url.kernel.normalize``), whose parts stand where
a regular expression finds them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegraph.url.kernel import SECOND_LEVEL

_HOST = r"(?i)^[a-z][-+.0-9a-z]*://(?:[^/@]*@)?([^#/:?]*)"
_AUTHORITY = r"^[a-z][-+.0-9a-z]*://(?:[^#/?@]*@)?([^#/?]*)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utf16_length(c: Column | str) -> Column:
    """Length in UTF-16 units (code points above the first plane count twice)."""
    return (F.octet_length(F.encode(_col(c), "UTF-16BE")) / 2).cast("int")


def scheme(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(_col(c), r"(?i)^([a-z][-+.0-9a-z]*):", 1))


def host(c: Column | str) -> Column:
    """The host's name (an IPv6 literal with its brackets), '' where there is none."""
    text = _col(c)
    literal = F.regexp_extract(text, r"(?i)^[a-z][-+.0-9a-z]*://(?:[^/@]*@)?(\[[^\]]*\])", 1)
    return F.when(literal != "", literal).otherwise(F.regexp_extract(text, _HOST, 1))


def host_port(c: Column | str) -> Column:
    return F.regexp_extract(_col(c), _AUTHORITY, 1)


def origin(c: Column | str) -> Column:
    return F.when(host_port(c) == "", F.lit("")).otherwise(F.concat(scheme(c), F.lit("://"), host_port(c)))


def path(c: Column | str) -> Column:
    return F.regexp_extract(_col(c), r"^[a-z][-+.0-9a-z]*:(?://[^#/?]*)?([^#?]*)", 1)


def search(c: Column | str) -> Column:
    """The query with its question mark, or ''."""
    return F.regexp_extract(_col(c), r"^[^?#]*(\?[^#]+)", 1)


def strip_trailing_slashes(c: Column | str) -> Column:
    out = F.regexp_replace(_col(c), "/+$", "")
    return F.when(_col(c).rlike("^/+$"), F.lit("/")).otherwise(out)


def collapse_slashes(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), "/{2,}", "/")


def strip_root_dots(c: Column | str) -> Column:
    out = F.regexp_replace(_col(c), r"\.+$", "")
    return F.when(out == "", _col(c)).otherwise(out)


def strip_www(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"^(?:www\.)+(?=[^.]+\.)", "")


def registrable_domain(c: Column | str) -> Column:
    h = F.regexp_replace(F.lower(F.trim(_col(c))), r"\.$", "")
    labels = F.split(h, r"\.")
    n = F.size(labels)
    need = F.when((F.length(F.element_at(labels, -1)) == 2) & (n >= 2) & F.try_element_at(labels, F.lit(-2)).isin(*sorted(SECOND_LEVEL)), 3).otherwise(2)
    whole = h.startswith("[") | h.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") | (n == 1)
    return (
        F.when(h == "", F.lit(None))
        .when(whole, h)
        .when(F.array_contains(labels, "") | (n < need), F.lit(None))
        .otherwise(F.array_join(F.slice(labels, F.greatest(n - need + 1, F.lit(1)), F.least(need, n)), "."))
    )


def same_site(a: Column | str, b: Column | str, subdomains: str = "same-host", registrable=None) -> Column:
    """Whether two hosts are one site; an empty or missing host is never the same. registrable: another rule for the domain."""
    x, y = (F.regexp_replace(F.lower(F.trim(_col(c))), r"\.+$", "") for c in (a, b))
    if subdomains == "any":
        same = F.lit(True)
    elif subdomains == "same-site":
        p, q = (registrable or registrable_domain)(x), (registrable or registrable_domain)(y)
        same = F.when(p.isNull() | q.isNull(), x == y).otherwise(p == q)
    else:
        same = x == y
    return F.coalesce((x != "") & (y != "") & same, F.lit(False))


def classify(from_host: Column | str, to_host: Column | str, subdomains: str = "same-host", registrable=None) -> Column:
    return F.when(same_site(from_host, to_host, subdomains, registrable), "internal").otherwise("external")


def private_host(c: Column | str) -> Column:
    h = F.lower(F.trim(_col(c)))
    h = F.regexp_replace(F.regexp_replace(h, r"^\[(.*)\]$", "$1"), r"\.+$", "")
    v4 = r"^(?:::ffff:)?([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})$"
    a, b, x, y = (F.regexp_extract(h, v4, i).try_cast("int") for i in (1, 2, 3, 4))
    near = a.isin(0, 10, 127) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
    return F.coalesce(
        F.when(h.isin("localhost", "::1", "::") | h.endswith(".localhost"), F.lit(True))
        .when(h.rlike(v4), near & (F.greatest(a, b, x, y) <= 255))
        .otherwise(h.contains(":") & (h.startswith("fe80:") | h.startswith("fc") | h.startswith("fd"))),
        F.lit(False),
    )


def extension(c: Column | str) -> Column:
    """The last path segment's ending, lower case, at most 8 characters; '' where there is none."""
    return F.lower(F.regexp_extract(F.regexp_extract(_col(c), r"([^/]*)$", 1), r"^.+\.([^.]{1,8})$", 1))


def url_trap(c: Column | str, depth: int = 20, repeats: int = 3, names: int = 32) -> Column:
    """Too deep a path, one segment too often in it, or too many distinct query names."""
    segments = F.filter(F.split(path(c), "/"), lambda s: s != "")
    most = F.array_max(F.transform(F.array_distinct(segments), lambda s: F.size(F.filter(segments, lambda x: x == s))))
    keys = F.array_distinct(F.transform(F.filter(F.split(F.regexp_replace(search(c), r"^\?", ""), "&"), lambda p: p != ""), lambda p: F.substring_index(p, "=", 1)))
    return (F.size(segments) > depth) | F.coalesce(most > repeats, F.lit(False)) | (F.size(keys) > names)


def simple_url(c: Column | str) -> Column:
    """Whether a URL is plainly its own normal form (default options), so that the kernel need not look at it."""
    text = _col(c)
    name = F.regexp_extract(text, r"^https?://([a-z0-9.-]+)(?:/[A-Za-z0-9/_.,~-]*)$", 1)
    return (
        (name != "")
        & ~name.rlike(r"\.$|^\.|\.\.|xn--|(?:^|\.)(?:0[xX][0-9a-fA-F]*|[0-9]+)$")
        & ~F.substring_index(text, "://", -1).rlike(r"//|/\.{1,2}(?:/|$)")
        & (F.length(text) <= 2048)
    )


def content_hash(c: Column | str) -> Column:
    return F.sha2(_col(c), 256)
