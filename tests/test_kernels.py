"""URL, HTML and robots kernels: known answers, properties and growth."""

import random
import time

import pytest

from sitegraph.html import kernel as H
from sitegraph.html import robots as R
from sitegraph.url import kernel as U
from sitegraph.url.kernel import NormalizeOptions as N

CASES = [
    ("HTTPS://Example.COM:443/a/../b/./c?b=2&a=1#x", None, N(), "https://example.com/b/c?a=1&b=2"),
    ("http://example.com", None, N(), "http://example.com/"),
    ("http://example.com./x", None, N(), "http://example.com/x"),
    ("http://bücher.example/ä?ü=1", None, N(), "http://xn--bcher-kva.example/%C3%A4?%C3%BC=1"),
    ("http://0x7f.1/", None, N(), "http://127.0.0.1/"),
    ("http://[2001:DB8:0:0:0:0:0:1]/", None, N(), "http://[2001:db8::1]/"),
    ("http:\\\\example.com\\a\\b", None, N(), "http://example.com/a/b"),
    ("ht\ntp://exa\tmple.com/", None, N(), "http://example.com/"),
    ("http://example.com/%7euser/%2f%3", None, N(), "http://example.com/~user/%2F%253"),
    ("http://example.com//a///b/", None, N(), "http://example.com/a/b/"),
    ("http://example.com/a///", None, N(trailing_slash="strip"), "http://example.com/a"),
    ("http://www.www.example.com/", None, N(strip_www=True), "http://example.com/"),
    ("http://example.com/?utm_source=a&fbclid=b&x=&y=%20~*", None, N(), "http://example.com/?x=&y=+%7E*"),
    ("http://example.com/?x=&y=1", None, N(strip_empty_params=True), "http://example.com/?y=1"),
    ("http://example.com/#!/route", None, N(keep_hashbang=True), "http://example.com/#!/route"),
    ("http://u:p@example.com/", None, N(), "http://u:p@example.com/"),
    ("../c?q", "http://example.com/a/b/x", N(), "http://example.com/a/c?q="),
    ("//other.example/x", "https://example.com/", N(), "https://other.example/x"),
    ("?q=1", "http://example.com/a?b", N(), "http://example.com/a?q=1"),
    ("", "http://example.com/", N(), None),
    ("x", None, N(), None),
    ("mailto:a@b.c", None, N(), None),
    ("http://", None, N(), None),
    ("http://a b/", None, N(), None),
    ("http://example.com:99999/", None, N(), None),
    ("http://1.2.3.4.5/", None, N(), None),
    ("http://example.com/" + "a" * 2048, None, N(), None),
    ("ftp://example.com:21/a", None, N(allow_schemes=("FTP:",)), "ftp://example.com/a"),
]


@pytest.mark.parametrize("text, base, o, wanted", CASES)
def test_normal_forms(text, base, o, wanted):
    assert U.normalize(text, base, o) == wanted
    if wanted is not None:
        assert U.normalize(wanted, None, o) == wanted


def test_normal_forms_are_fixed_points():
    dice = random.Random(7)
    parts = ["HTTP:/", "http://", "//", "https://", "ex.com", "EX.com.", "[::1]", "1.2", "0x1", "ü", "/", "//", "/../", "/./", "%2e", "%2F", "%", "a", "?", "&", "=", "utm_x=1", "#", "\\", ":80", "@", " ", "\t", "'", "~", "+", "|", "^"]
    options = [N(), N(trailing_slash="strip", strip_www=True), N(strip_fragment=False), N(normalize_query=False, collapse_slashes=False)]
    for _ in range(6000):
        text = "".join(dice.choice(parts) for _ in range(dice.randint(1, 10)))
        for o in options:
            found = U.normalize(text, dice.choice([None, "https://base.example/d/e"]), o)
            assert found is None or U.normalize(found, None, o) == found, text


@pytest.mark.parametrize(
    "text, wanted",
    [("example.com/a", "https://example.com/a"), ("example.com:8080", "https://example.com:8080/"), ("mailto:a@b.c", None), (" http://e.com ", "http://e.com/"), ("a b", None), ("user@host", None)],
)
def test_entries(text, wanted):
    assert U.normalize_entry(text) == wanted


def test_masks():
    assert U.mask_userinfo("https://u:p@ss@h.example/x@y") == "https://u:***@h.example/x@y"
    assert U.mask_userinfo("https://u@h.example/") == "https://u@h.example/"
    assert U.mask_userinfo("no url @ all") == "no url @ all"
    assert U.mask_userinfo(r"https:\\u:p@h.example\x") == "https://u:***@h.example/x"


def test_links_of_a_messy_page():
    html = """<a href=one>One<a href='two' rel="nofollow,ugc">T &amp; <b>w</b>o</a><!-- <a href=no> --><script>"<a href=no>"</script><a title="x > y" href="three"
      >3</a><a href=""><a href="  ">5 < 6 <a href=four/>four<A HREF=FIVE target><a href="six"""
    found = H.links(html, "http://e.com/d/")
    assert [(x.href, x.url) for x in found] == [("one", "http://e.com/d/one"), ("two", "http://e.com/d/two"), ("three", "http://e.com/d/three"), ("four/", "http://e.com/d/four/"), ("FIVE", "http://e.com/d/FIVE"), ("six", "http://e.com/d/six")]
    assert found[1].nofollow and found[1].ugc and not found[1].sponsored and found[1].anchor_text == "T & wo"


def test_regions_are_innermost_and_tolerant():
    html = "<header><a href=1></header><main><a href=2><nav><a href=3></main><a href=4></aside><article/><a href=5><footer><a href=6>"
    assert [x.region for x in H.links(html, "http://e/")] == ["header", "main", "nav", None, None, "footer"]


def test_titles_bases_and_directives():
    assert H.title("<svg><title>no</title></svg><title> a\n\xa0b &amp; </title>") == "a b &"
    assert H.title("<title></title>") is None and H.title(None) is None
    assert H.title("<title>" + "😀" * 600 + "</title>") == "😀" * 256
    assert H.base_href("<base target=x><base href='/b/'><base href=/c/>", "http://e/a") == "http://e/b/"
    assert H.meta_robots("<meta name=ROBOTS content='NoIndex, x, noindex'><meta name=other content=nofollow>") == (True, False, ["noindex", "x"])
    assert H.x_robots_tag("a: none, unavailable_after: 2030, b: noindex", "bbot") == (True, False, ["noindex"])
    assert H.decode("&#65;&#x42;&nbsp;&AMP;&amp &#0;&toolongtobeone;&#x110000;") == "AB\xa0&&amp &#0;&toolongtobeone;&#x110000;"


def test_robots():
    groups, maps = R.parse_robots("﻿Disallow: /first\nUser-agent: A\nUser-agent: b\n\nDisallow: /p*x$ # c\nAllow: /p\nCrawl-delay: 1e9999\nCrawl-delay: 3\nSitemap: s\nfoo\nUser-agent: *\nDisallow: /")
    assert maps == ["s"] and [g["agents"] for g in groups] == [["*"], ["a", "b"], ["*"]]
    assert R.allowed(groups, "/pax", "A/1") is False and R.allowed(groups, "/paxy", "a") and R.allowed(groups, "/other", "bb")
    assert R.allowed(groups, "/first", "zzz") is False and R.delay(groups, "a") == 3 and R.delay(groups, "zzz") is None
    assert R.allowed([{"agents": ["*"], "rules": [(False, "/a"), (True, "/a")], "delay": None}], "/a", "x")


def test_globs_equal_a_slow_version():
    def slow(p, t):
        if p == "" or p == "$":
            return p == "" or t == ""
        if p[0] == "*":
            return any(slow(p[1:], t[i:]) for i in range(len(t) + 1))
        return t[:1] == p[0] and slow(p[1:], t[1:])

    dice = random.Random(1)
    for _ in range(4000):
        p = "".join(dice.choice("ab*") for _ in range(dice.randint(0, 6))) + dice.choice(["", "$"])
        t = "".join(dice.choice("ab") for _ in range(dice.randint(0, 7)))
        assert R.glob(p, t) == slow(p, t), (p, t)


def test_sitemaps():
    kind, rows = R.sitemap("<?xml?><x:urlset><x:url><x:loc> http://e/?a&amp;b </x:loc><x:priority>0.7</x:priority></x:url><url><lastmod>1</lastmod></url><url><loc>http://e/2")
    assert kind == "urlset" and rows == [("http://e/?a&b", None, None, 0.7), ("http://e/2", None, None, None)]
    assert R.sitemap("<sitemapindex><sitemap><loc>i</loc><lastmod>2</lastmod></sitemap></sitemapindex>") == ("sitemapindex", [("i", "2", None, None)])
    assert R.sitemap("") == ("urlset", []) and R.sitemap("http://a\n# no\nftp://b\n HTTP://c") == ("urlset", [("http://a", None, None, None), ("HTTP://c", None, None, None)])


@pytest.mark.parametrize("piece", ["<a href=x>", "<a href='", "&", "<!--", "<", "<title>", "<svg>", "</a", "<nav>", '<a x="', "<a =", "&#", "<script>", "<![CDATA["])
def test_readers_are_total_and_linear(piece):
    def took(n):
        start = time.process_time()
        text = piece * n
        H.links(text, "http://e/")
        H.title(text)
        H.meta_robots(text)
        R.sitemap(text)
        R.parse_robots(text)
        return time.process_time() - start

    took(100)
    small, large = took(1000), took(8000)
    assert large < max(24 * small, 2.0)


def test_hostile_patterns():
    start = time.process_time()
    assert not R.glob("*a" * 900 + "b", "/" + "a" * 5000)
    assert time.process_time() - start < 1


def test_private_hosts_and_domains():
    assert U.private_host("[::ffff:10.1.1.1]") and U.private_host("FD00::1") and not U.private_host("300.1.1.1") and not U.private_host("")
    assert U.registrable_domain("a.b.co.uk.") == "b.co.uk" and U.registrable_domain("co.uk") is None and U.registrable_domain("1.2.3.4") == "1.2.3.4"
    assert U.same_site("co.uk", "co.uk", "same-site") and not U.same_site("", "", "any")


def test_few_rows_are_python_objects_at_once(spark):
    """A kernel's finds become Arrow a slice at a time, not a whole batch of them at the end."""
    import weakref

    import pyarrow as pa

    from sitegraph.functions import kernels as K

    class Found(dict):
        pass

    alive = []

    def kernel(i):
        found = Found(i=i)
        alive.append(weakref.ref(found))
        found["n"] = sum(r() is not None for r in alive)
        return found

    made = K._fn(kernel, "struct<i:long,n:long>", pa.struct([("i", pa.int64()), ("n", pa.int64())]))
    rows = [r["v"] for r in spark.range(0, 1500, numPartitions=1).select(made("id").alias("v")).collect()]
    assert [r["i"] for r in rows] == list(range(1500)) and max(r["n"] for r in rows) <= 200
