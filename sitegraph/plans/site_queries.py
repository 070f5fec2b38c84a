"""Queries over whole crawls, what is kept of them, and the rules that only such crawls or made-up pages exercise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.functions import columns as U
from sitegraph.functions import kernels as K
from sitegraph.html.kernel import ExtractOptions
from sitegraph.operators import archive, policy, reports
from sitegraph.operators.ranking import ranked_within, running, shared
from sitegraph.plans import views as V
from sitegraph.plans.crawl import Options, SiteWalk, crawl
from sitegraph.plans.persist import Site, json_data
from sitegraph.plans.queries import _NORM, _inline, _next_pairs, _pages, _values, _NEXT, query
from sitegraph.session import scratch, settled
from sitegraph.sources import corpus as net
from sitegraph.url.kernel import NormalizeOptions

S = "http://small.example"


def _corpus(spark: SparkSession, pages: dict[str, dict | str]) -> DataFrame:
    rows = []
    for url, p in pages.items():
        p = {"html": p} if isinstance(p, str) else p
        rows.append((url, p.get("status"), p.get("type"), p.get("charset"), p.get("html"), p.get("to"), p.get("etag"), p.get("modified"), p.get("robots"), p.get("error"), p.get("message")))
    return spark.createDataFrame(rows, net.CORPUS)


def _reasons(links: DataFrame) -> DataFrame:
    return links.groupBy(F.coalesce("skip_reason", F.lit("followed")).alias("reason")).agg(F.count("*").alias("n"))


# every reason, from crawls

_EDGES = {
    f"{S}/": "<main><a href=/p1>1</a><a href=/p2>2</a><a href=/p1>again</a><a href=mailto:x@y.z>m</a><a href=/" + "l" * 60 + ">long</a><a href=http://10.0.0.1/>private</a>"
    "<a href=http://far.example/>far</a><a href=/ex/1>ex</a><a rel=nofollow href=/n>n</a><a href=/f.zip>zip</a><a href=/hidden/x>robots</a><a href=/k/k/k/k/k>trap</a>"
    "<a href=/user>u</a></main><nav><a href=/nav>nav</a></nav><link rel=canonical href=/canon>",
    f"{S}/p1": "<main><a href=/p3>3</a><a href=/>start</a></main>",
    f"{S}/p2": "<main><a href=/p4>4</a><a href=/p3>3</a></main>",
    f"{S}/p3": "<main><a href=/p5>5</a></main>",
    f"{S}/robots.txt": {"type": "text/plain", "html": "User-agent: *\nDisallow: /hidden/"},
}
_EDGE_SCOPE = policy.Scope(subdomains="same-host", exclude=("/ex/",), max_url_length=60, allow_private_hosts=False, follow_regions=("main",))


@query("select * from (" + _values([
    ("followed", 4), ("duplicate", 3), ("bad-scheme", 1), ("too-long", 1), ("private-host", 1), ("out-of-scope", 1), ("excluded", 1), ("nofollow", 1), ("out-of-region", 2), ("unsupported-type", 1),
    ("robots-disallow", 1), ("trap", 1), ("user", 1), ("max-depth", 1),
]) + ") t(reason, n)")
def crawl_reasons_all(spark, sf):
    """One crawl in which every decision on an edge is made, but for the budgets' two."""
    o = Options(scope=_EDGE_SCOPE, max_depth=2, should_visit=lambda u: ~u.contains("/user"))
    return _reasons(crawl(spark, _corpus(spark, _EDGES), f"{S}/", o).links)


_HUB = {f"{S}/": "".join(f"<a href=/p{i}>{i}</a>" for i in range(1, 6)), **{f"{S}/p{i}": f"<a href=/q{i}>q</a><a href=/p5>5</a><a href=/>hub</a>" for i in range(1, 6)}}


@query("select * from (" + _values([("max-pages", "pages", 4), ("max-pages", "followed", 6), ("max-pages", "max-pages", 4), ("max-pages", "duplicate", 4), ("max-pages", "queued", 3), ("completed", "pages", 3), ("completed", "followed", 2), ("completed", "queue-full", 3)]) + ") t(stopped_by, what, n)")
def crawl_budget_reasons(spark, sf):
    """Two pages in flight when the page budget ends are delivered, and what they link to is skipped; a full queue refuses."""
    site, out = _corpus(spark, _HUB), []
    for o in (Options(respect_robots=False, traps=False, max_pages=2, concurrency=3), Options(respect_robots=False, traps=False, max_queued=2, max_depth=1, scope=policy.Scope(exclude=("/q",)))):
        walk = SiteWalk(spark, site, o)
        r = walk.run(f"{S}/")
        rows = [("pages", r.pages.count()), *((x["reason"], x["n"]) for x in _reasons(r.links).collect()), ("queued", r.counts["queued"])]
        out += [(r.stopped_by, what, n) for what, n in rows if n and what not in ("max-depth", "excluded")]
    return _inline(spark, out, "stopped_by string, what string, n long")


# two runs over the pages, kept


def _named(spark: SparkSession, sf: str) -> DataFrame:
    """(url, page_id, html): the first page of each normal form. Bodies move only where they are asked for."""
    (pages,) = shared("url", _pages(spark, sf).select("page_id", K.normalize_url(F.col("url")).alias("url"), "html"))
    return pages.groupBy("url").agg(F.min("page_id").alias("page_id"), F.min_by("html", "page_id").alias("html"))


def _states(pages: DataFrame, second: bool) -> DataFrame:
    """The pages as the first or second crawl finds them; in one pass, since each look at them moves their bodies."""
    if not second:
        return pages
    k = F.col("page_id")
    stays = {"html": F.when(k % 7 == 0, F.concat("html", F.lit("!"))).otherwise(F.col("html"))}
    fresh = {"url": F.concat(F.lit("https://new.example/"), k)}
    old, new = (F.struct(*[how.get(c, F.col(c)).alias(c) for c in pages.columns]) for how in (stays, fresh))
    return pages.select(F.inline(F.array_compact(F.array(F.when(k % 11 != 0, old), F.when(k % 13 == 0, new)))))


def _site_urls(spark: SparkSession, sf: str, second: bool) -> DataFrame:
    return _states(_named(spark, sf).select("url", "page_id"), second).select("url")


def _site_corpus(spark: SparkSession, sf: str, second: bool) -> DataFrame:
    """The pages as a corpus by normal form; in the second state some are gone, some changed and some new."""
    pages, k = _states(_named(spark, sf), second), F.col("page_id")
    if second:  # under other urls, so they are dealt out anew
        (pages,) = shared("url", pages)
    tag = F.concat(F.when(F.lit(second) & (k % 7 == 0), "f").otherwise("e"), k)
    null = F.lit(None).cast("string")
    return pages.select("url", F.lit(200).alias("status"), F.lit("text/html").alias("content_type"), F.lit("utf-8").alias("charset"), F.col("html").alias("body"), null.alias("redirect_to"),
                        tag.alias("etag"), null.alias("last_modified"), null.alias("x_robots_tag"), null.alias("error_kind"), null.alias("error_message"))


_sites: dict[tuple, Site] = {}


def _kept(spark: SparkSession, sf: str) -> Site:
    """A store with two runs over all pages (made once a session): a first crawl, and a second one that asks conditionally."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _sites:
        import uuid

        site = Site(spark, archive.Store(spark, f"{scratch(spark)}/site-{uuid.uuid4().hex}"))
        seeds = settled(_site_urls(spark, sf, False))
        for n, uid in enumerate(("one", "two")):
            corpus = _site_corpus(spark, sf, bool(n))
            o = Options(respect_robots=False, traps=False, max_depth=0, recrawl=bool(n))
            walk = SiteWalk(spark, corpus, o, site.table("archive") if n else None)
            report = walk.run(seeds.union(_site_urls(spark, sf, True)) if n else seeds)
            row = {**site.create(uid, at=_day(n)), "status": "completed", "stopped_by": report.stopped_by}
            site.save(row, report.pages, report.links, report.frontier, at=F.lit(f"2024-0{n + 1}-01").cast("timestamp"))
        _sites[key] = site
    return _sites[key]


def _day(n: int):
    import datetime

    return datetime.datetime(2024, n + 1, 1, tzinfo=datetime.timezone.utc)


_TWO = f"""n as (select min(page_id) as page_id, url from (select page_id, {_NORM} as url from pages) group by url),
a as (select n.page_id, n.url, html from n join pages p on p.page_id = n.page_id),
b as (select page_id, url, case when page_id % 7 = 0 then html || '!' else html end as html from a where page_id % 11 <> 0
  union all select page_id, 'https://new.example/' || page_id, html from a where page_id % 13 = 0)"""


@query(f"""with {_TWO} select coalesce(a.url, b.url) as url, case when a.url is null then 'new' when b.url is null then 'removed' else 'changed' end as change, sha256(b.html) as content_hash, sha256(a.html) as previous_hash
from a full join b on a.url = b.url where a.url is null or b.url is null or a.html <> b.html""")
def l12_incremental_changes(spark, sf):
    """Crawled, kept, crawled again with what was kept, compared with the run before."""
    return _kept(spark, sf).changed("two")


@query(f"with {_TWO} select url, 'new' as change, sha256(html) as content_hash from a")
def l5_changed_without_baseline(spark, sf):
    return _kept(spark, sf).changed("one").select("url", "change", "content_hash")


@query(f"""with {_TWO}, u as (select 'one' as uid, url, 200 as status, true as ok, false as not_modified, sha256(html) as content_hash, strlen(html) as size from a
union all select 'two', b.url, case when a.html = b.html then 304 else 200 end, true, coalesce(a.html = b.html, false), sha256(b.html), case when a.html = b.html then null else strlen(b.html) end from b left join a on a.url = b.url
union all select 'two', url, 404, false, false, null, strlen('not found') from a where page_id % 11 = 0) select * from u""")
def s10_persisted_pages(spark, sf):
    site = _kept(spark, sf)
    runs = site.table("crawl").select("crawl_id", "uid")
    return site.table("page").join(runs, "crawl_id").select("uid", "url", "status", "ok", "not_modified", "content_hash", "size")


@query(f"""with {_TWO} select coalesce(a.url, b.url) as url, coalesce(b.html, a.html) is not null as has_body, sha256(coalesce(b.html, a.html)) as body_hash,
case when b.url is null then null when a.html = b.html or a.url is null then 'e' || b.page_id else 'f' || b.page_id end as etag, case when b.url is null then null else sha256(b.html) end as content_hash,
case when b.url is null then 404 when a.html = b.html then 304 else 200 end as last_status, '2024-02-01' as day from a full join b on a.url = b.url""")
def s10_persisted_archive(spark, sf):
    """What the visit of a gone page lacks is taken from it, but never its body; an unchanged one keeps all."""
    found = _kept(spark, sf).table("archive")
    tag = F.when(F.col("url").startswith("https://new.example/"), F.regexp_replace("etag", "^[ef]", "e")).otherwise(F.col("etag"))
    return found.select("url", F.col("body").isNotNull().alias("has_body"), F.sha2("body", 256).alias("body_hash"), tag.alias("etag"), "content_hash", "last_status", F.date_format("fetched_at", "yyyy-MM-dd").alias("day"))


_OUT = """l as (select page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as href from pages)"""


@query(f"""with {_TWO}, {_OUT} select count(*) as n, count(distinct from_url) as n_from, count(distinct raw_href) as n_href from (
  select a.url as from_url, href as raw_href from a join l using (page_id)) t""")
def s10_persisted_links(spark, sf):
    site = _kept(spark, sf)
    one = site.crawl("one")["crawl_id"]
    return site.table("link").where(F.col("crawl_id") == one).agg(F.count("*").alias("n"), F.countDistinct("from_url").alias("n_from"), F.countDistinct("raw_href").alias("n_href"))


@query(f"""with {_TWO}, g as (select count(*) as n from a where page_id % 11 = 0) select 'one' as uid, 'completed' as status, (select count(*) from a) as done, 0 as failed, 0 as gone
union all select 'two', 'completed', (select count(*) from b), n, n from g""")
def m10_recomputed_stats(spark, sf):
    """Counts from the tables written to each run's row, and read from there."""
    site, out = _kept(spark, sf), []
    for uid in ("one", "two"):
        site.recompute(uid)
        row, stats = site.crawl(uid), site.crawl_stats(uid)
        out.append((uid, row["status"], stats["done"], stats["failed"], stats["by_status"].get("404", 0)))
    return _inline(spark, out, "uid string, status string, done long, failed long, gone long")


@query(f"with {_TWO} select status, count(*) as n from (select case when a.html = b.html then 304 else 200 end as status from b left join a on a.url = b.url union all select 404 from a where page_id % 11 = 0) group by 1")
def a5_live_counts(spark, sf):
    """The walk's own running counts by status, as its summary has them."""
    first, second = _site_corpus(spark, sf, False), _site_corpus(spark, sf, True)
    stored = first.select("url", F.encode("body", "UTF-8").alias("body"), "content_type", "charset", "etag", "last_modified", F.sha2("body", 256).alias("content_hash"), F.lit(200).alias("last_status"), F.lit(None).cast("long").alias("size"), F.current_timestamp().alias("fetched_at"))
    told: list[dict] = []
    walk = SiteWalk(spark, second, Options(respect_robots=False, traps=False, max_depth=0, recrawl=True, events={"on_progress": told.append}), stored)
    walk.run(_site_urls(spark, sf, False).union(_site_urls(spark, sf, True)))
    return _inline(spark, sorted(told[-1]["by_status"].items()), "status int, n long")


@query(f"with {_TWO} select url, page_seq is not null as met, has_body from (select a.url, b.url as page_seq, true as has_body from a left join (select url from b union select url from a where page_id % 11 = 0) b on a.url = b.url union all select url, url, true from b where url like 'https://new.example/%')")
def j3_visited_state(spark, sf):
    return _kept(spark, sf).visited_state("two").select("url", F.col("page_seq").isNotNull().alias("met"), "has_body")


@query(f"with {_TWO} select url, status from (select url, 404 as status from a where page_id % 11 = 0) order by url limit 1000")
def l2_failed_of_a_run(spark, sf):
    """By the run's uid; rows in their fixed projection."""
    return _kept(spark, sf).failed("two", limit=1000).select("url", "status")


@query("select * from (" + _values([("one", 1, True), ("two", 2, True), ("none", None, False)]) + ") t(uid, crawl_id, found)")
def l6_get_crawl(spark, sf):
    site = _kept(spark, sf)
    rows = [(uid, site.crawl(uid)) for uid in ("one", "two", "none")]
    return _inline(spark, [(uid, row and row["crawl_id"], row is not None) for uid, row in rows], "uid string, crawl_id long, found boolean")


@query(f"with {_TWO}, f as (select min(url) as u from b where page_id % 7 <> 0 and url not like 'https://new.example/%') select url, sha256(html) as body_hash, 'e' || page_id as etag from b join f on url = u")
def l7_get_body(spark, sf):
    site = _kept(spark, sf)
    same = site.table("page").where("not_modified").agg(F.min("url")).head()[0]
    return site.body(same).select(F.lit(same).alias("url"), F.sha2("body", 256).alias("body_hash"), "etag")


# crawls of small sites


def _paths(report) -> DataFrame:
    return report.pages.select("page_seq", U.path("url").alias("path"), "depth", "discovered_via")


@query("select * from (" + _values([(0, "/", 0, "seed"), (1, "/a", 2, "manual"), (2, "/b", 3, "link")]) + ") t(page_seq, path, depth, discovered_via)")
def s4_manual_urls(spark, sf):
    site = _corpus(spark, {f"{S}/": "x", f"{S}/a": "<a href=/b>b</a>", f"{S}/b": "y"})
    return _paths(SiteWalk(spark, site, Options(respect_robots=False)).run(f"{S}/", manual=[(f"{S}/a", 2), ("http://far.example/", 0)]))


_PACKED = "<urlset><url><loc>http://small.example/z1</loc></url><url><loc>http://small.example/z2</loc></url></urlset>"


@query("select * from (" + _values([(0, "/", 0, "seed"), (1, "/m1", 0, "sitemap"), (2, "/z1", 0, "sitemap"), (3, "/z2", 0, "sitemap")]) + ") t(page_seq, path, depth, discovered_via)")
def s5_s8_sitemaps(spark, sf):
    """An index, a plain sitemap and a packed one (known by its first bytes); documents of other origins are passed over."""
    import gzip

    index = f"<sitemapindex><sitemap><loc>{S}/two.xml.gz</loc></sitemap><sitemap><loc>http://far.example/m.xml</loc></sitemap></sitemapindex>"
    site = _corpus(spark, {
        f"{S}/": "x", f"{S}/robots.txt": {"type": "text/plain", "html": f"Sitemap: {S}/one.xml\nSitemap: {S}/index.xml"}, f"{S}/one.xml": f"<urlset><url><loc>{S}/m1</loc></url></urlset>",
        f"{S}/index.xml": index, f"{S}/two.xml.gz": "", f"{S}/m1": "1", f"{S}/z1": "2", f"{S}/z2": "3",
    })
    packed = F.lit(bytearray(gzip.compress(_PACKED.encode(), mtime=0)))
    site = site.withColumn("raw", F.when(F.col("url").endswith(".gz"), packed))
    return _paths(crawl(spark, site, f"{S}/", Options(sitemaps=True)))


@query("select * from (" + _values([(0, "/caf\u00e9", "e"), (1, "/\u00fc", "e")]) + ") t(pos, path, kind)")
def s7_stored_charset(spark, sf):
    """Links of an unchanged page come from its stored bytes, read by their charset."""
    html = '<a href="/café">c</a><a href="/ü">u</a>'
    site = _corpus(spark, {f"{S}/": {"html": "changed?", "etag": "e1"}})
    row = (f"{S}/", bytearray(html.encode("latin-1")), "text/html", "iso-8859-1", "e1", None, "h", 200, 1, None)
    report = crawl(spark, site, f"{S}/", Options(respect_robots=False, recrawl=True, max_depth=0), spark.createDataFrame([row], archive.ARCHIVE))
    return report.links.select(F.col("link_seq").cast("int").alias("pos"), F.col("raw_href").alias("path"), F.lit("e").alias("kind"))


@query("select * from (" + _values([(0, "canonical", "/canon"), (1, "next", "/base/n2"), (2, "page", "/base/content")]) + ") t(pos, rel, path)")
def d2_head_and_body_links(spark, sf):
    """A hook narrows the body: links of the head stay, and all resolve against the whole page's base."""
    html = "<head><base href=/base/><link rel=canonical href=/canon><link rel=next href=n2></head><div class=chrome><a href=c>c</a></div><div class=main><a href=content>x</a></div>"
    o = Options(respect_robots=False, max_depth=0, before_extract=lambda h: F.regexp_extract(h, "(<div class=main>.*?</div>)", 1))
    links = crawl(spark, _corpus(spark, {f"{S}/": html}), f"{S}/", o).links
    return links.select(F.col("link_seq").cast("int").alias("pos"), "rel", U.path("to_url").alias("path"))


@query("select * from (" + _values([("/", True, True, 1), ("/h", True, False, 0), ("/plain", False, False, 0)]) + ") t(path, nofollow, noindex, n_nofollow)")
def p10_page_directives(spark, sf):
    """A page's own directives and its header's count together, and bear on each of its links."""
    site = _corpus(spark, {f"{S}/": "<meta name=robots content='noindex,nofollow'><a href=/x>x</a>", f"{S}/h": {"html": "h", "robots": "nofollow"}, f"{S}/plain": "p"})
    report = crawl(spark, site, [f"{S}/", f"{S}/h", f"{S}/plain"], Options(respect_robots=False))
    n = report.links.groupBy(F.col("from_url").alias("url")).agg(F.count_if(F.col("nofollow") & (F.col("skip_reason") == "nofollow")).alias("n"))
    return report.pages.join(n, "url", "left").select(U.path("url").alias("path"), "nofollow", "noindex", F.coalesce("n", F.lit(0)).cast("int").alias("n_nofollow"))


@query("select * from (" + _values([(False, "excluded", 1), (True, "followed", 2)]) + ") t(follow, reason, n_pages)")
def p11_canonical(spark, sf):
    site, out = _corpus(spark, {f"{S}/": "<link rel=canonical href=/c>", f"{S}/c": "c"}), None
    for follow in (False, True):
        r = crawl(spark, site, f"{S}/", Options(respect_robots=False, follow_canonical=follow))
        one = _reasons(r.links).select(F.lit(follow).alias("follow"), "reason", F.lit(r.pages.count()).alias("n_pages"))
        out = one if out is None else out.unionByName(one)
    return out


@query("select * from (" + _values([("/a", "duplicate"), ("/no", "user"), ("/b", "followed")]) + ") t(path, reason)")
def p13_should_visit(spark, sf):
    """A page that is done is a duplicate before the user is asked."""
    site = _corpus(spark, {f"{S}/a": "a", f"{S}/": "<a href=/a>a</a><a href=/no>n</a><a href=/b>b</a>", f"{S}/b": "b"})
    r = crawl(spark, site, [f"{S}/a", f"{S}/"], Options(respect_robots=False, should_visit=lambda u: u.endswith("/b")))
    return r.links.select(U.path("to_url").alias("path"), F.coalesce("skip_reason", F.lit("followed")).alias("reason"))


@query("select * from (" + _values([("/", 0, 3), ("/b", 1, 1), ("/a", 2, 2)]) + ") t(path, page_seq, depth)")
def h_priority(spark, sf):
    """By the hook's number, lower first; null and NaN give the depth."""
    site = _corpus(spark, {f"{S}/": "<a href=/a>a</a><a href=/b>b</a>", f"{S}/a": "a", f"{S}/b": "b"})
    o = Options(respect_robots=False, strategy="priority", batch=1, priority=lambda f: F.when(F.col("url").endswith("/b"), -5.0).otherwise(float("nan")))
    report = crawl(spark, site, f"{S}/", o)
    depth = {"/": 3, "/a": 2, "/b": 1}
    return report.pages.select(U.path("url").alias("path"), "page_seq", reduce(lambda c, k: c.when(U.path("url") == k, depth[k]), depth, F.when(F.lit(False), 0)).alias("depth"))


@query("select * from (" + _values([("on_start", 1), ("on_page_start", 2), ("on_page_done", 2), ("on_page_error", 2), ("on_link", 2), ("on_link_skipped", 2), ("on_progress", 2), ("on_end", 1)]) + ") t(event, n)")
def h_events(spark, sf):
    """Observers are called round by round, and one that fails changes nothing."""
    seen: list[str] = []

    def watch(name: str):
        def call(*_):
            seen.append(name)
            raise ValueError(name)

        return call

    names = ("on_start", "on_page_start", "on_page_done", "on_page_error", "on_link_skipped", "on_progress", "on_end")
    site = _corpus(spark, {f"{S}/": "<a href=/a>a</a>", f"{S}/a": "a"})
    crawl(spark, site, f"{S}/", Options(respect_robots=False, progress_interval=3600, events={n: watch(n) for n in names}, on_link=watch("on_link")))
    return _inline(spark, [(n, seen.count(n)) for n in dict.fromkeys(seen)], "event string, n long")


@query("select * from (" + _values([("abort", 0, 1), ("stop", 1, 1), ("completed", 2, 0)]) + ") t(stopped_by, pages, pending)")
def e4_stop_and_abort(spark, sf):
    site, out = _corpus(spark, {f"{S}/": "<a href=/a>a</a>", f"{S}/a": "a"}), []
    for way in ("abort", "stop", None):
        walk = SiteWalk(spark, site, Options(respect_robots=False))
        state = walk.start(f"{S}/")
        if way == "abort":
            walk.abort()
        why = None
        for why, pages in walk.rounds(state):
            if pages is not None and way == "stop":
                walk.stop()
        out.append((why, state.done, state.pending().count()))
    return _inline(spark, out, "stopped_by string, pages long, pending long")


@query("select * from (" + _values([("/", 1, False), ("http://far.example/x", 0, True)]) + ") t(url, n_links, external)")
def p1e_check_only(spark, sf):
    """Links to other sites are asked for but not read."""
    site = _corpus(spark, {f"{S}/": "<a href=http://far.example/x>far</a>", "http://far.example/x": "<a href=/y>y</a>"})
    r = crawl(spark, site, f"{S}/", Options(respect_robots=False, scope=policy.Scope(check_external=True)))
    n = r.links.groupBy(F.col("from_url").alias("url")).agg(F.count("*").alias("n"))
    far = F.col("url").contains("far.")
    return r.pages.join(n, "url", "left").select(F.when(far, F.col("url")).otherwise(U.path("url")).alias("url"), F.coalesce("n", F.lit(0)).cast("int").alias("n_links"), far.alias("external"))


@query("select * from (" + _values([("timeout", "timeout", None, True), ("broken", "internal", None, False), ("loop", "too-many-redirects", None, False), ("ok", None, None, None)]) + ") t(name, kind, status, retryable)")
def e8_page_errors(spark, sf):
    site = _corpus(spark, {f"{S}/timeout": {"error": "timeout", "message": "slow"}, f"{S}/broken": {"error": "oops"}, f"{S}/loop": {"to": f"{S}/loop"}, f"{S}/ok": "ok"})
    pages = crawl(spark, site, [f"{S}/{x}" for x in ("timeout", "broken", "loop", "ok")], Options(respect_robots=False)).pages
    return pages.select(F.element_at(F.split(U.path("url"), "/"), -1).alias("name"), "error.kind", "error.status", "error.retryable")


# rules over the tables


@query("""select page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) as host, '...' as dots from pages""")
def u5_root_dots(spark, sf):
    host = U.host("url")
    return _pages(spark, sf).select("page_id", U.strip_root_dots(F.concat(host, F.expr("repeat('.', cast(page_id % 4 as int))"))).alias("host"), U.strip_root_dots(F.lit("...")).alias("dots"))


@query("""select page_id, 'https://q.example/?' || case when page_id % 2 = 0 then 'a=1&' else '' end || 'b=' || page_id || '&c=%C3%A9+x' as sorted,
'https://q.example/?b=' || page_id || '&c=%C3%A9+x' || case when page_id % 2 = 0 then '&a=1' else '' end || '&e=' as kept, 'https://q.example/#!/' || page_id as bang from pages""")
def u7_u11_query_and_fragment(spark, sf):
    k = F.col("page_id")
    a = F.when(k % 2 == 0, "&a=1").otherwise("")
    raw = F.concat(F.lit("https://q.example/?b="), k, F.lit("&c=%c3%a9%20x&utm_campaign=z"), a, F.lit("&e=#top"))
    o = NormalizeOptions(sort_params=False)
    return _pages(spark, sf).select(
        "page_id", K.normalize_url(raw, o=NormalizeOptions(strip_empty_params=True)).alias("sorted"), K.normalize_url(raw, o=o).alias("kept"),
        K.normalize_url(F.concat(F.lit("https://q.example/#!/"), k), o=NormalizeOptions(keep_hashbang=True)).alias("bang"),
    )


@query("""select page_id, page_id % 40 + 22 <= 50 as fits, false as guarded from pages""")
def u12_u13_length_and_guard(spark, sf):
    url = F.concat(F.lit("https://long.example/"), F.expr("repeat('x', cast(page_id % 40 + 1 as int))"))
    fits = K.normalize_url(url, o=NormalizeOptions(max_length=50)).isNotNull()
    guard = K.normalize_url(F.concat(F.lit("x:/..//h/"), "page_id"), o=NormalizeOptions(allow_schemes=("x", "http"))).isNotNull()
    return _pages(spark, sf).select("page_id", fits.alias("fits"), guard.alias("guarded"))


@query("select page_id, page_id % 2 = 0 as nofollow, page_id % 3 = 0 as ugc, page_id % 5 = 0 as sponsored, case when page_id % 7 = 0 then 'de-' || page_id end as hreflang from pages")
def x6f_rel_tokens(spark, sf):
    k = F.col("page_id")
    rel = F.concat_ws(" ", F.when(k % 2 == 0, "NoFollow"), F.when(k % 3 == 0, "ugc,"), F.when(k % 5 == 0, "Sponsored"), F.lit("noopener"))
    html = F.when(k % 7 == 0, F.concat(F.lit("<link rel='alternate "), rel, F.lit("' hreflang=' de-"), k, F.lit(" ' href=/x>"))).otherwise(F.concat(F.lit("<a rel='"), rel, F.lit("' href=/x>t</a>")))
    found = _pages(spark, sf).select("page_id", K.extract_links(html, F.col("url"), ExtractOptions(alternate=True))[0].alias("l"))
    return found.select("page_id", "l.nofollow", "l.ugc", "l.sponsored", "l.hreflang")


@query("""select page_id, '/x' || page_id as href, 'a b' as text from pages""")
def x14_x5_spaces_and_close_tags(spark, sf):
    """White space is that of scripts (no-break and other spaces too); a closing tag may hold spaces, another tag may begin alike."""
    html = F.concat(F.lit("<a href='\u00a0\ufeff\t/x"), "page_id", F.lit("\u2003'>\u00a0a<abbr>\u2028</abbr>\n b\u3000</a\n>rest</a>"))
    found = _pages(spark, sf).select("page_id", K.extract_links(html, F.col("url"))[0].alias("l"))
    return found.select("page_id", "l.href", F.col("l.anchor_text").alias("text"))


@query("""select page_id, case when page_id % 8 = 0 then 'bad-scheme' when page_id % 8 = 1 then 'too-long' when page_id % 8 = 2 then 'private-host' when page_id % 8 = 3 then 'excluded'
  when page_id % 8 = 4 then 'unsupported-type' when page_id % 8 = 5 then 'nofollow' end as reason, page_id % 8 = 7 as check_only from pages""")
def p1_each_reason(spark, sf):
    kind = F.pmod("page_id", F.lit(8))
    tail = F.concat(F.lit("/in/"), "page_id")
    to = (
        F.when(kind == 0, F.concat(F.lit("ftp://a.example"), tail)).when(kind == 1, F.concat(F.lit("https://a.example/in/"), F.lit("y" * 300))).when(kind == 2, F.concat(F.lit("http://192.168.1.1"), tail))
        .when(kind == 3, F.concat(F.lit("https://a.example/out/"), "page_id")).when(kind == 4, F.concat(F.lit("https://a.example"), tail, F.lit(".PDF.zip")))
        .when(kind == 7, F.concat(F.lit("https://far.example"), tail, F.lit(".zip"))).otherwise(F.concat(F.lit("https://a.example"), tail))
    )
    links = _pages(spark, sf).select("page_id", F.col("url").alias("from_url"), to.alias("to_url"), F.when(kind == 7, "external").otherwise("internal").alias("kind"), (kind == 5).alias("nofollow"), F.lit(None).cast("string").alias("region"), F.lit("page").alias("rel"))
    scope = policy.Scope(include=("/in/",), max_url_length=200, allow_private_hosts=False, check_external=True)
    return policy.decide(links, scope).select("page_id", F.col("skip_reason").alias("reason"), "check_only")


@query(f"""with {_NEXT} select page_id, case when ha = hb then 'internal' when right(ha, 4) = right(hb, 4) then 'internal' else 'external' end as kind from pairs""")
def h_registrable_override(spark, sf):
    """Another rule for the registrable domain: the last four characters of a host."""
    rule = lambda h: F.right(h, F.lit(4))
    return _next_pairs(spark, sf).select("page_id", U.classify(U.host("from_url"), U.host("to_url"), "same-site", rule).alias("kind"))


@query("select page_id, case when page_id % 3 = 2 then html else 'é ' || page_id end as text from pages")
def charset_decoding(spark, sf):
    kind, text = F.pmod("page_id", F.lit(3)), F.concat(F.lit("é "), "page_id")
    body = F.when(kind == 0, F.encode(text, "ISO-8859-1")).when(kind == 1, F.encode(text, "UTF-16")).otherwise(F.encode("html", "UTF-8"))
    name = F.when(kind == 0, "windows-1252").when(kind == 1, "utf-16").otherwise("x-unknown")
    return _pages(spark, sf).select("page_id", reports.decoded(body, name).alias("text"))


@query("""select page_id, '{"v":{"id":' || page_id || ',"url":"' || url || '"}}' as data from pages""")
def json_page_data(spark, sf):
    return _pages(spark, sf).select("page_id", json_data(F.struct(F.col("page_id").cast("long").alias("id"), "url"), "struct").alias("data"))


@query("select * from (" + _values([("title", 512), ("anchor", 200), ("links", 10000), ("hops", 50)]) + ") t(what, n)")
def o5_o6_caps(spark, sf):
    """The caps that are features of the parsers: title and anchor lengths, links of a page, kept hops."""
    html = "<title>" + "t" * 900 + "</title><a href=/0>" + "x" * 900 + "</a>" + "<a href=/1>y</a>" * 10_500
    row = _inline(spark, [(html, f"{S}/")], "h string, u string").select(K.read_page(F.col("h"), F.col("u")).alias("p"))
    hops = _inline(spark, [([f"u{i}" for i in range(60)],)], "redirects array<string>").select(net.kept_hops("redirects").alias("redirects"))
    found = row.select(F.length("p.title").alias("title"), F.length(F.col("p.links")[0]["anchor_text"]).alias("anchor"), F.size("p.links").alias("links")).head()
    return _inline(spark, [("title", found["title"]), ("anchor", found["anchor"]), ("links", found["links"]), ("hops", hops.select(F.size("redirects")).head()[0])], "what string, n long")


@query("select event_id, cast(sum(user_id) over (order by event_id rows between unbounded preceding and 1 preceding) as bigint) as before from events")
def a13_running_budget(spark, sf):
    rows = running(V.table(spark, sf, "events").select("event_id", "user_id"), ["event_id"], F.col("user_id"), "before")
    return rows.select("event_id", F.when(F.col("event_id") > F.lit(rows.agg(F.min("event_id")).head()[0]), F.col("before")).alias("before"))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() over (partition by l_orderkey % 3 order by l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 as place from lineitem")
def w_ranks_within_hot_keys(spark, sf):
    names = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = V.table(spark, sf, "lineitem").select(*names, (F.col("l_orderkey") % 3).alias("k"))
    return ranked_within(rows, "k", names, "place").select(*names, "place")


@query(f"with {V.WEB_LINKS} select to_url, count(*) as n from web_links where rel = 'page' and to_url like '%/part/1' and kind = 'internal' group by to_url")
def p16_link_filters(spark, sf):
    url = "https://shop.example/part/1"
    found = V.web_links(spark, sf).where(F.col("kind") == "internal")
    return reports.list_links(found, rel="page", to_url=url, limit=1000).groupBy("to_url").agg(F.count("*").alias("n"))


@query(f"with {V.WEB_PAGES} select page_seq from web_pages where not_modified order by page_seq limit 30")
def p16_not_modified(spark, sf):
    return reports.list_pages(V.web_pages(spark, sf), not_modified=True, skipped=False, limit=30).select("page_seq")


@query(f"""with {V.FETCH_LOG} select seq, case when seq % 5 = 0 then 'pending' when seq % 3 = 0 then 'done' else 'pending' end as status, seq % 5 = 0 and seq % 2 = 0 as waits from fetch_log""")
def m6_release_and_defer(spark, sf):
    """Claims acknowledged, released or left in flight and recovered; deferred rows wait for their time."""
    k = F.col("seq")
    rows = V.fetch_log(spark, sf).select("seq", F.concat("url", F.lit("#"), k).alias("url"), "host", F.lit(0.0).alias("priority"), F.lit("in_flight").alias("status"))
    rows = rows.withColumn("ready_at", F.when((k % 5 == 0) & (k % 2 == 0), F.lit("2030-01-01").cast("timestamp")))
    acked = archive.set_status(rows, rows.where((k % 3 == 0) & (k % 5 != 0)), "done", "in_flight")
    released = archive.set_status(acked, acked.where(k % 5 == 0), "pending", "in_flight")
    after = archive.recover(released)
    ready = archive.claim(after, 1 << 30, now=F.lit("2024-01-01").cast("timestamp")).select("seq", F.lit(True).alias("ready"))
    return after.join(ready, "seq", "left").select("seq", "status", ((F.col("status") == "pending") & F.col("ready").isNull()).alias("waits"))


@query("select * from (" + _values([(1, "failed", 1, False), (2, "completed", 4, True), (2, "completed", 4, False)]) + ") t(attempt, status, done, resumed)")
def jb_jobs_resume(spark, sf):
    """A job breaks off, goes on and, asked once more, gives its summary; options come in groups."""
    import uuid

    from sitegraph.plans.jobs import Handler, start_job

    site = _corpus(spark, {f"{S}/": "<a href=/a>a</a><a href=/b>b</a><a href=/no/x>n</a>", f"{S}/a": "<a href=/c>c</a>", f"{S}/b": "b", f"{S}/c": "c"})
    handler = Handler(spark, site, archive.Store(spark, f"{scratch(spark)}/jobs-{uuid.uuid4().hex}"), {"respect_robots": False, "traps": False}, lambda _: None)
    job, out = start_job(f"{S}/", {"max_depth": 5, "scope": {"exclude": ["/no/"]}}, "j1", lambda _: None), []
    try:
        handler.run(job, fail_after=1)
    except RuntimeError:
        row, stats = handler.site.crawl("j1"), handler.site.crawl_stats("j1")
        out.append((row["attempt"], row["status"], stats["done"], False))
    for _ in range(2):
        got = handler.run(job)
        out.append((got["attempt"], handler.site.crawl("j1")["status"], got["done"], got["resumed"]))
    return _inline(spark, out, "attempt int, status string, done long, resumed boolean")
