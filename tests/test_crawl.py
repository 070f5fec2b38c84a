"""Crawls over small sites whose results are known."""

import pytest
from pyspark.sql import functions as F

from sitegraph.operators import policy
from sitegraph.plans.crawl import SiteWalk, Options, crawl
from sitegraph.sources.corpus import CORPUS

S = "http://small.example"


def corpus(spark, pages):
    rows = []
    for url, p in pages.items():
        p = {"html": p} if isinstance(p, str) else p
        rows.append((url, p.get("status"), p.get("type"), None, p.get("html"), p.get("to"), p.get("etag"), p.get("modified"), p.get("robots"), p.get("error"), None))
    return spark.createDataFrame(rows, CORPUS)


SITE = {
    f"{S}/": '<title>Start</title><nav><a href=/one>1</a></nav><main><a href=/two>2</a><a href="/same?utm_source=q">s</a><a href="/moved">m</a><a href="/hidden/x">h</a><a href="http://far.example/x">f</a><a href="/r/k/l/k/l/k/l/k">t</a></main>',
    f"{S}/one": '<title>One</title><a href=/two>two</a><a href=/>start</a>',
    f"{S}/two": '<title>Two</title><a href="/one">one</a><a href="/same">same</a>',
    f"{S}/same": "<title>Same</title>",
    f"{S}/moved": {"to": f"{S}/target"},
    f"{S}/target": "<title>Target</title>",
    f"{S}/hidden/x": "<title>Hidden</title>",
    f"{S}/r/k/l/k/l/k/l/k": "<title>Trap</title>",
    f"{S}/robots.txt": {"type": "text/plain", "html": f"User-agent: *\nDisallow: /hidden/\nSitemap: {S}/map.xml\n"},
    f"{S}/map.xml": {"type": "application/xml", "html": f"<urlset><url><loc>{S}/unlinked</loc></url></urlset>"},
    f"{S}/unlinked": "<title>Unlinked</title>",
    "http://far.example/x": '<title>Far</title><a href=/y>y</a>',
}


@pytest.fixture(scope="module")
def site(spark):
    return corpus(spark, SITE).cache()


def order(report):
    return [(r["url"].removeprefix(S), r["depth"]) for r in report.pages.orderBy("page_seq").collect()]


def reasons(report):
    return {r["skip_reason"]: r["count"] for r in report.links.groupBy("skip_reason").count().collect()}


def test_breadth_first_order_and_reasons(spark, site):
    report = crawl(spark, site, f"{S}/", Options(respect_robots=False, traps=False))
    assert order(report) == [("/", 0), ("/one", 1), ("/two", 1), ("/same", 1), ("/moved", 1), ("/hidden/x", 1), ("/r/k/l/k/l/k/l/k", 1)]
    assert report.stopped_by == "completed"
    assert reasons(report) == {None: 6, "duplicate": 4, "out-of-scope": 1}
    same = {r["from_url"]: r["followed"] for r in report.links.where(F.col("to_url") == f"{S}/same").collect()}
    assert same == {f"{S}/": True, f"{S}/two": False}
    moved = report.pages.where(F.col("url") == f"{S}/moved").head()
    assert moved["final_url"] == f"{S}/target" and moved["redirects"] == [f"{S}/moved"] and moved["title"] == "Target"


def test_robots_traps_and_sitemaps(spark, site):
    report = crawl(spark, site, "http://SMALL.example", Options(sitemaps=True))
    assert order(report) == [("/", 0), ("/unlinked", 0), ("/one", 1), ("/two", 1), ("/same", 1), ("/moved", 1)]
    got = reasons(report)
    assert got["robots-disallow"] == 1 and got["trap"] == 1 and got["out-of-scope"] == 1


def test_limits(spark, site):
    o = Options(respect_robots=False, max_pages=3)
    report = crawl(spark, site, f"{S}/", o)
    assert report.stopped_by == "max-pages" and [u for u, _ in order(report)] == ["/", "/one", "/two"]
    report = crawl(spark, site, f"{S}/", Options(respect_robots=False, max_depth=0))
    assert len(order(report)) == 1 and reasons(report) == {"max-depth": 6, "out-of-scope": 1}
    report = crawl(spark, site, f"{S}/", Options(respect_robots=False, max_total_bytes=10))
    assert report.stopped_by == "max-bytes" and len(order(report)) == 1
    report = crawl(spark, site, f"{S}/", Options(respect_robots=False, max_queued=2))
    assert reasons(report)["queue-full"] >= 1
    for bad in ({"max_pages": 0}, {"max_depth": -1}, {"max_pages": 1.5}, {"strategy": "x"}):
        with pytest.raises(TypeError):
            Options(**bad)


def test_depth_first_and_hooks(spark, site):
    report = crawl(spark, site, f"{S}/", Options(respect_robots=False, strategy="dfs", batch=1, traps=False, max_pages=3))
    assert [u for u, _ in order(report)][:2] == ["/", "/one"]
    o = Options(respect_robots=False, should_visit=lambda u: ~u.contains("two"), on_page=lambda f: F.upper("read.title"))
    report = crawl(spark, site, f"{S}/", o)
    assert reasons(report)["user"] == 2
    assert {r["data"] for r in report.pages.select("data").collect()} >= {"START", "ONE"}


def test_redirects_to_one_page_are_one_page(spark):
    pages = {f"{S}/": '<a href="/p">p</a><a href="/q">q</a><a href="/end">e</a>', f"{S}/p": {"to": f"{S}/end"}, f"{S}/q": {"to": f"{S}/end"}, f"{S}/end": "<title>End</title>"}
    report = crawl(spark, corpus(spark, pages), f"{S}/", Options(respect_robots=False))
    assert [u for u, _ in order(report)] == ["/", "/p"]


def test_calendar_ends(spark):
    pages = {f"{S}/c?d={i}": f'<title>{i}</title><a href="/c?d={i + 1}">n</a>' for i in range(12)}
    report = crawl(spark, corpus(spark, pages), f"{S}/c?d=0", Options(respect_robots=False, max_urls_per_path=5))
    assert len(order(report)) == 6 and reasons(report)["trap"] == 1 and report.stopped_by == "completed"
    nested = {f"{S}/cal/{'2026/' * i}m": '<a href="2026/m">n</a>' for i in range(1, 9)}
    report = crawl(spark, corpus(spark, nested), f"{S}/cal/2026/m", Options(respect_robots=False))
    assert len(order(report)) == 3 and reasons(report)["trap"] == 1


def test_repeated_content_isn_t_expanded(spark):
    pages = {f"{S}/": "<title>Hub</title>" + "".join(f'<a href="/s{i}/i">{i}</a>' for i in range(1, 6))}
    for i in range(1, 6):
        pages[f"{S}/s{i}/i"] = '<title>none</title><a href="child">c</a>'
        pages[f"{S}/s{i}/child"] = f"<title>{i}</title>"
    report = crawl(spark, corpus(spark, pages), f"{S}/", Options(respect_robots=False, soft_dup_threshold=3))
    assert [u for u, _ in order(report) if u.endswith("child")] == ["/s1/child", "/s2/child", "/s3/child"]
    assert reasons(report)["trap"] == 2


def test_unchanged_pages_are_read_from_the_archive(spark):
    from sitegraph.operators.archive import ARCHIVE

    pages = {f"{S}/": {"html": '<a href="/x">x</a>', "etag": "e1"}, f"{S}/x": {"html": "<title>X</title>", "etag": "e2"}}
    rows = [(u, bytearray(p["html"].encode()), "text/html", "utf-8", p["etag"], None, "h", 200, 1, None) for u, p in pages.items()]
    report = crawl(spark, corpus(spark, pages), f"{S}/", Options(respect_robots=False, recrawl=True), spark.createDataFrame(rows, ARCHIVE))
    got = {r["url"]: (r["status"], r["not_modified"], r["content_hash"]) for r in report.pages.collect()}
    assert got == {f"{S}/": (304, True, "h"), f"{S}/x": (304, True, "h")}


def test_a_stopped_crawl_goes_on(spark, site):
    first = SiteWalk(spark, site, Options(respect_robots=False, traps=False, max_pages=2))
    first.run(f"{S}/")
    state = first.state
    again = SiteWalk(spark, site, Options(respect_robots=False, traps=False, scope=policy.Scope(seed_hosts=("small.example",))))
    report = again.run(state=state)
    assert [u for u, _ in order(report)] == ["/", "/one", "/two", "/same", "/moved", "/hidden/x", "/r/k/l/k/l/k/l/k"]


def test_manual_urls_and_private_hosts(spark, site):
    o = Options(respect_robots=False, max_pages=9, traps=False)
    report = SiteWalk(spark, site, o).run(f"{S}/same", manual=[(f"{S}/unlinked", 3), ("http://far.example/x", 0)])
    assert [u for u, _ in order(report)] == ["/same", "/unlinked"]
    o = Options(respect_robots=False, scope=policy.Scope(allow_private_hosts=False))
    assert order(crawl(spark, site, "http://localhost/", o)) == []


def test_first_progress_is_told_whatever_the_clock_shows(spark, site, monkeypatch):
    """The clock may count from the machine's start: an interval longer than that doesn't swallow the first call."""
    from sitegraph.plans import crawl as module

    told: list[dict] = []
    walk = SiteWalk(spark, site, Options(respect_robots=False, progress_interval=3600), on_progress=told.append)
    state, clock = walk.start(f"{S}/"), iter([5.0, 6.0, 3605.5])
    monkeypatch.setattr(module.time, "monotonic", lambda: next(clock))
    walk._progress(state)
    assert len(told) == 1
    walk._progress(state)  # a second later: within the interval
    assert len(told) == 1
    walk._progress(state)
    assert len(told) == 2
