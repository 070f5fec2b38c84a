"""Every operator as a query over the given tables, and the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.functions import columns as U
from sitegraph.functions import kernels as K
from sitegraph.html.kernel import ExtractOptions
from sitegraph.operators import archive, policy, reports, traversal
from sitegraph.plans import views as V
from sitegraph.plans.crawl import Options, crawl
from sitegraph.sources import corpus as net
from sitegraph.streaming import pages as stream
from sitegraph.url.kernel import NormalizeOptions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "pages")


def _inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _values(rows: list[tuple]) -> str:
    def one(v) -> str:
        return "null" if v is None else str(v).lower() if isinstance(v, (bool, int, float)) else "'" + v.replace("'", "''") + "'"

    return "values " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


# URLs

_NORM = """regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])(utm_[a-z]+|ref)=[^&#]*', '\\1', 'g'), '[?&]+$', '')"""


@query(f"select page_id, {_NORM} as url from pages")
def u1_normalize_pages(spark, sf):
    return _pages(spark, sf).select("page_id", K.normalize_url(F.col("url")).alias("url"))


@query(f"""select page_id, regexp_replace(regexp_replace({_NORM}, '/+$', ''), '://(www\\.)+([^.]+\\.)', '://\\2') as url from pages""")
def u1_normalize_strip_options(spark, sf):
    o = NormalizeOptions(trailing_slash="strip", strip_www=True)
    return _pages(spark, sf).select("page_id", K.normalize_url(F.col("url"), o=o).alias("url"))


_LINKS = """l as (select page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as href,
  generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) - 1 as pos from pages)"""


@query(f"""with {_LINKS} select page_id, pos, regexp_extract(url, '^(https?://[^/?#]+)', 1) || replace(replace(url_encode(href), '%2F', '/'), '%2C', ',') as url from l""")
def u1_resolve_links(spark, sf):
    links = _pages(spark, sf).select("page_id", F.posexplode(K.extract_links(F.col("html"), F.col("url"))).alias("pos", "l"))
    return links.select("page_id", "pos", F.col("l.url").alias("url"))


_PERCENT = [(1, "%7Ea%2fb"), (2, "100%"), (3, "%zz%41"), (4, "a%C3%A9"), (5, "")]


@query("select * from (" + _values([(1, "~a%2Fb"), (2, "100%25"), (3, "%25zzA"), (4, "a%C3%A9"), (5, "")]) + ") t(id, text)")
def u2_percent_encoding(spark, sf):
    return _inline(spark, _PERCENT, "id int, t string").select("id", K.canon_percent(F.col("t")).alias("text"))


@query("""with w as (select distinct '//' || repeat('/', cast(p_partkey % 4 as int)) || p_brand || '//x' || repeat('/', cast(p_size % 3 as int)) as p from part)
select p, case when regexp_full_match(p, '/+') then '/' else regexp_replace(p, '/+$', '') end as stripped, regexp_replace(p, '/{2,}', '/', 'g') as collapsed from w""")
def u3_u4_slashes(spark, sf):
    p = F.expr("concat('//', repeat('/', cast(p_partkey % 4 as int)), p_brand, '//x', repeat('/', cast(p_size % 3 as int)))")
    return V.table(spark, sf, "part").select(p.alias("p")).distinct().select("p", U.strip_trailing_slashes("p").alias("stripped"), U.collapse_slashes("p").alias("collapsed"))


_HOSTS = [
    "example.com", "a.b.example.co.uk", "co.uk", "www.example.com", "www.www.a.b", "www.com", "localhost", "x.localhost", "127.0.0.1", "10.1.2.3", "172.31.0.1", "172.32.0.1",
    "192.168.9.9", "100.64.0.1", "100.128.0.1", "169.254.1.1", "8.8.8.8", "256.1.1.1", "[::1]", "[fe80::1]", "[fd00::2]", "[2001:db8::1]", "example.com.", "a..b", "com.", "0.0.0.0",
    "[::ffff:10.0.0.1]", "gov.au", "x.gov.au", "fcx.example",
]
_HOST_SQL = "(" + _values([(h,) for h in _HOSTS]) + ") t(host)"


@query(f"""with h as (select host, string_split(case when host like '%.' then host[:-2] else host end, '.') as l, case when host like '%.' then host[:-2] else host end as b from {_HOST_SQL}),
n as (select *, len(l) as n, case when len(l) > 1 and length(l[-1]) = 2 and l[-2] in ('ac','co','com','edu','go','gov','mil','ne','net','or','org','sch') then 3 else 2 end as need from h)
select host, case when b like '[%' or regexp_full_match(b, '[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}') or n = 1 then b when list_contains(l, '') or n < need then null
  else array_to_string(l[n - need + 1 : n], '.') end as domain from n
union all select distinct regexp_extract(url, '^https?://([^/?#]+)', 1), regexp_extract(url, '([^./]+\\.[^./]+)/', 1) from pages""")
def u14_registrable_domain(spark, sf):
    hosts = _inline(spark, [(h,) for h in _HOSTS], "host string").unionAll(_pages(spark, sf).select(U.host("url")).distinct())
    return hosts.select("host", U.registrable_domain("host").alias("domain"))


@query(f"""with h as (select distinct regexp_extract(url, '^https?://([^/?#]+)', 1) as host from pages), d as (select host, regexp_extract(host, '([^.]+\\.[^.]+)$', 1) as dom from h),
s as (select min(host) as host, dom from d group by dom)
select s.dom, d.host, d.host = s.host as same_host, true as same_site, true as any_host from d join s using (dom)""")
def u15_same_site_pairs(spark, sf):
    hosts = _pages(spark, sf).select(U.host("url").alias("host")).distinct().withColumn("dom", U.registrable_domain("host"))
    first = hosts.groupBy("dom").agg(F.min("host").alias("seed"))
    pairs = hosts.join(first, "dom")
    return pairs.select("dom", "host", *[U.same_site("host", "seed", m).alias(n) for m, n in (("same-host", "same_host"), ("same-site", "same_site"), ("any", "any_host"))])


_NEXT = """pairs as (select a.page_id, a.url as from_url, b.url as to_url, regexp_extract(a.url, '^https?://([^/?#]+)', 1) as ha, regexp_extract(b.url, '^https?://([^/?#]+)', 1) as hb
  from pages a join pages b on b.page_id = a.page_id + 1)"""


def _next_pairs(spark: SparkSession, sf: str) -> DataFrame:
    pages = _pages(spark, sf).select("page_id", "url")
    return pages.withColumnRenamed("url", "from_url").join(pages.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("to_url")), "page_id")


@query(f"""with {_NEXT} select page_id, case when ha = hb then 'internal' else 'external' end as by_host,
case when regexp_extract(ha, '([^.]+\\.[^.]+)$', 1) = regexp_extract(hb, '([^.]+\\.[^.]+)$', 1) then 'internal' else 'external' end as by_site from pairs""")
def u17_classify_edges(spark, sf):
    a, b = U.host("from_url"), U.host("to_url")
    return _next_pairs(spark, sf).select("page_id", U.classify(a, b).alias("by_host"), U.classify(a, b, "same-site").alias("by_site"))


_PRIVATE = {"localhost", "x.localhost", "127.0.0.1", "10.1.2.3", "172.31.0.1", "192.168.9.9", "100.64.0.1", "169.254.1.1", "[::1]", "[fe80::1]", "[fd00::2]", "0.0.0.0", "[::ffff:10.0.0.1]"}


@query("select * from (" + _values([(h, h in _PRIVATE) for h in _HOSTS]) + ") t(host, private)")
def u18_private_host(spark, sf):
    return _inline(spark, [(h,) for h in _HOSTS], "host string").select("host", U.private_host("host").alias("private"))


@query("""select page_id, replace(url, '://', '://user:***@') as masked, replace(url, '://', '://user@') as plain from pages""")
def u19_mask_userinfo(spark, sf):
    def given(user: str):
        return K.mask_userinfo(F.replace("url", F.lit("://"), F.lit(f"://{user}@")))

    return _pages(spark, sf).select("page_id", given("user:pa@ss").alias("masked"), given("user").alias("plain"))


@query("""select page_id, regexp_extract(url, '^[a-z][-+.0-9a-z]*://(?:[^/@]*@)?([^#/:?]*)', 1) as host, regexp_extract(url, '^(https?://[^/?#]+)', 1) as origin from pages""")
def u22_url_host(spark, sf):
    return _pages(spark, sf).select("page_id", U.host("url").alias("host"), U.origin("url").alias("origin"))


@query("""select page_id, lower(regexp_extract(regexp_extract(url, '^https?://[^/]+([^?#]*)', 1), '/[^/]+\\.([^./]{1,8})$', 1)) as extension from pages""")
def u23_extension(spark, sf):
    return _pages(spark, sf).select("page_id", U.extension(U.path("url")).alias("extension"))


@query("select * from (" + _values([(1, "https://example.com/a"), (2, "https://example.com:8080/"), (3, None), (4, "http://example.com/"), (5, None)]) + ") t(id, url)")
def u21_entry_urls(spark, sf):
    rows = [(1, " example.com/a#x "), (2, "example.com:8080"), (3, "mailto:a@b.com"), (4, "HTTP://EXAMPLE.com"), (5, "")]
    return _inline(spark, rows, "id int, t string").select("id", K.normalize_entry(F.col("t")).alias("url"))


@query(f"""with n as (select page_id, {_NORM} as url from pages) select url, min(page_id) as page_id, count(*) as n from n group by url""")
def a12_dedup_normalized(spark, sf):
    pages = _pages(spark, sf).select("page_id", K.normalize_url(F.col("url")).alias("url"))
    return pages.groupBy("url").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))


# documents


@query(f"with {_LINKS} select page_id, pos, href, 'a' as tag, 'page' as rel, false as nofollow, 'nav' as region, href[2:] as anchor_text from l")
def x6_extract_links(spark, sf):
    links = _pages(spark, sf).select("page_id", F.posexplode(K.extract_links(F.col("html"), F.col("url"))).alias("pos", "l"))
    return links.select("page_id", "pos", "l.href", "l.tag", "l.rel", "l.nofollow", "l.region", "l.anchor_text")


@query(f"with {_LINKS} select href, count(*) as n, count(distinct page_id) as n_pages from l group by href")
def x6_link_targets(spark, sf):
    links = _pages(spark, sf).select("page_id", F.explode(K.extract_links(F.col("html"), F.col("url"))).alias("l"))
    return links.groupBy(F.col("l.href").alias("href")).agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("n_pages"))


_KINDS = """<base href="/b/"><link rel="stylesheet" href="s.css"><link rel=alternate hreflang=de href=de><link rel="next" href="n"><iframe src=f></iframe><img src=i.png srcset="a.png 1x, b.png 2x">
<script src=s.js></script><video src=v poster=p></video><area href="m"><a rel="ugc sponsored,nofollow" href="x">t &amp; u</a><a href="">none</a><aside><a href="../up">Up</aside><meta content='0; url=r' http-equiv=Refresh>"""


@query(
    "select * from ("
    + _values([
        (0, "/b/s.css", "link", "asset", None), (1, "/b/de", "link", "alternate", None), (2, "/b/n", "link", "next", None), (3, "/b/f", "iframe", "iframe", None), (4, "/b/i.png", "img", "asset", None),
        (5, "/b/a.png", "img", "asset", None), (6, "/b/b.png", "img", "asset", None), (7, "/b/s.js", "script", "asset", None), (8, "/b/v", "video", "asset", None), (9, "/b/p", "video", "asset", None),
        (10, "/b/m", "area", "page", None), (11, "/b/x", "a", "page", None), (12, "/up", "a", "page", "aside"), (13, "/b/r", "meta", "page", None),
    ])
    + ") t(pos, path, tag, rel, region)"
)
def x6_all_sources(spark, sf):
    o = ExtractOptions(alternate=True, iframes=True, assets=True, srcset=True)
    rows = _inline(spark, [(_KINDS, "https://e.example/q")], "h string, u string").select(F.posexplode(K.extract_links(F.col("h"), F.col("u"), o)).alias("pos", "l"))
    return rows.select("pos", U.path("l.url").alias("path"), "l.tag", "l.rel", "l.region")


@query(r"""select page_id, nullif(left(trim(regexp_replace(replace(replace(replace(replace(regexp_extract(html, '<title>([\s\S]*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')), 512), '') as title from pages""")
def x8_titles(spark, sf):
    return _pages(spark, sf).select("page_id", K.title(F.col("html")).alias("title"))


@query("""select page_id, case page_id % 3 when 0 then regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/b/' when 1 then 'https://cdn.example/x/' else url end as base from pages""")
def x7_base_href(spark, sf):
    kind = F.pmod("page_id", F.lit(3))
    lead = F.when(kind == 0, "<base target=_top><BASE href=' /b/ '><base href=/c/>").when(kind == 1, '<base href="https://cdn.example/x/">').otherwise("<base href=''>")
    return _pages(spark, sf).select("page_id", K.base_href(F.concat(lead, "html"), F.col("url")).alias("base"))


@query("""select page_id, case page_id % 4 when 0 then true when 1 then true when 2 then false else false end as noindex, page_id % 4 in (0, 2) as nofollow,
case page_id % 4 when 0 then 'none' when 1 then 'noindex,x' when 2 then 'nofollow' else '' end as raw from pages""")
def x9_meta_robots(spark, sf):
    kind = F.pmod("page_id", F.lit(4))
    content = F.when(kind == 0, "NONE").when(kind == 1, "noindex, x,noindex").when(kind == 2, "nofollow")
    tag = F.when(kind == 3, F.lit("<meta name=robots>")).otherwise(F.concat(F.lit('<meta name="Robots" content="'), content, F.lit('">')))
    found = _pages(spark, sf).select("page_id", K.meta_robots(F.concat(tag, F.col("html"))).alias("r"))
    return found.select("page_id", "r.noindex", "r.nofollow", F.array_join("r.raw", ",").alias("raw"))


@query("select * from (" + _values([(1, True, False, "noindex"), (2, False, True, "nofollow"), (3, True, True, "none"), (4, False, False, ""), (5, False, False, "max-snippet:-1"), (6, True, False, "noindex")]) + ") t(id, noindex, nofollow, raw)")
def x10_x_robots_tag(spark, sf):
    rows = [(1, "noindex"), (2, "other: noindex, mybot: nofollow"), (3, "none"), (4, "other: none"), (5, "max-snippet:-1"), (6, "noindex, other: nofollow")]
    found = _inline(spark, rows, "id int, h string").select("id", K.x_robots_tag(F.col("h"), "mybot/1.0").alias("r"))
    return found.select("id", "r.noindex", "r.nofollow", F.array_join("r.raw", ",").alias("raw"))


@query(f"""select page_id, {_NORM} as url, 'weekly' as changefreq, 0.5 as priority from pages""")
def x11_sitemap_entries(spark, sf):
    line = F.concat(F.lit("<url><loc><![CDATA["), F.col("url"), F.lit("]]></loc><changefreq>weekly</changefreq><priority>0.5</priority></url>"))
    doc = F.concat(F.lit("<?xml version='1.0'?><s:urlset xmlns:s='x'>"), line, F.lit("</s:urlset>"))
    rows = _pages(spark, sf).select("page_id", F.explode(K.sitemap(doc)["entries"]).alias("e"))
    return rows.select("page_id", K.normalize_url(F.col("e.url")).alias("url"), "e.changefreq", F.col("e.priority").alias("priority"))


_ROBOTS = "﻿User-agent: mybot\r\nUser-agent: My\r\nDisallow: /private # no\r\nAllow: /private/open\r\nCrawl-delay: 2.5s\r\n\r\nUser-agent: *\r\nDisallow: /*.gif$\r\nDisallow: /e/*\r\nCrawl-delay: 90\r\nAllow:\r\nSitemap: https://x/s.xml\r\nnonsense\r\n"
_RULES = [
    (0, "mybot", 0, False, "/private", 2.5), (0, "mybot", 1, True, "/private/open", 2.5), (0, "my", 0, False, "/private", 2.5), (0, "my", 1, True, "/private/open", 2.5),
    (1, "*", 0, False, "/*.gif$", 90.0), (1, "*", 1, False, "/e/*", 90.0),
]


@query("select * from (" + _values(_RULES) + ") t(group_no, agent, rule_no, allow, pattern, crawl_delay)")
def x12_robots_rules(spark, sf):
    return _inline(spark, [(_ROBOTS,)], "t string").select(F.inline(K.robots_rules(F.col("t"))))


@query("select page_id, sha256(html) as hash from pages")
def p19_content_hash(spark, sf):
    return _pages(spark, sf).select("page_id", U.content_hash("html").alias("hash"))


@query("select * from (" + _values([(1, "a & b < c > d \" e ' f"), (2, "é A &bogus; &amp"), (3, "&#0; &#xD800; 😀")]) + ") t(id, text)")
def x3_decode_entities(spark, sf):
    rows = [(1, "a &amp; b &lt; c &GT; d &quot; e &apos; f"), (2, "&#233; &#x41; &bogus; &amp"), (3, "&#0; &#xD800; &#x1F600;")]
    return _inline(spark, rows, "id int, t string").select("id", K.decode_entities(F.col("t")).alias("text"))


_SCRAPED = """s as (select page_id, case when page_id % 3 = 0 then '<META property=x name="Description" content=" page ' || page_id || ' ">' else '' end || html
  || case when page_id % 2 = 0 then '<h2 class="x">Part <b>' || page_id || '</b> &amp; more</h2><h2> </h2>' else '' end as html from pages)"""


@query(rf"""with {_SCRAPED} select page_id, nullif(left(trim(regexp_replace(replace(replace(replace(replace(regexp_extract(html, '<title>([\s\S]*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')), 512), '') as title,
case when page_id % 3 = 0 then 'page ' || page_id end as description,
array_to_string(list_filter(list_transform(regexp_extract_all(html, '<h[12][^>]*>([\s\S]*?)</h[12]>', 1), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))), lambda x: x <> ''), '|') as headings from s""")
def l11_scrape(spark, sf):
    lead = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<META property=x name="Description" content=" page '), "page_id", F.lit(' ">'))).otherwise("")
    tail = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<h2 class="x">Part <b>'), "page_id", F.lit("</b> &amp; more</h2><h2> </h2>"))).otherwise("")
    pages = _pages(spark, sf).withColumn("html", F.concat(lead, "html", tail)).withColumn("title", K.title(F.col("html")))
    return reports.scrape(pages).select("page_id", "title", "description", F.array_join("headings", "|").alias("headings"))


# policy


@query(f"""with {_NEXT} select page_id, case when ha <> hb and regexp_extract(ha, '([^.]+\\.[^.]+)$', 1) <> regexp_extract(hb, '([^.]+\\.[^.]+)$', 1) then 'out-of-scope'
  when not regexp_matches(to_url, '^https?://[^/]+/(en|fr)') then 'out-of-scope' when contains(to_url, 'page=') or regexp_matches(to_url, '/[0-9]*7\\.html') then 'excluded'
  when page_id % 5 = 0 then 'nofollow' end as reason from pairs""")
def p1_scope_verdicts(spark, sf):
    links = _next_pairs(spark, sf).withColumns({"kind": U.classify(U.host("from_url"), U.host("to_url"), "same-site"), "nofollow": F.col("page_id") % 5 == 0, "region": F.lit(None).cast("string"), "rel": F.lit("page")})
    scope = policy.Scope(subdomains="same-site", path_prefix=("/en", "/fr"), exclude=("page=", ""), exclude_patterns=(r"/[0-9]*7\.html",))
    return policy.decide(links, scope).select("page_id", F.col("skip_reason").alias("reason"))


@query(f"with {V.WEB_LINKS} select coalesce(skip_reason, 'followed') as reason, count(*) as n from web_links group by 1")
def p1_skip_reason_counts(spark, sf):
    links = V.web_links(spark, sf).drop("skip_reason", "followed").withColumn("region", F.lit(None).cast("string"))
    return policy.decide(links, policy.Scope()).groupBy(F.coalesce("skip_reason", F.lit("followed")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"with {_LINKS} select page_id, count(*) as n_out, 0 as n_in from l where page_id % 2 = 0 group by page_id union all select page_id, 0, count(*) from l where page_id % 2 = 1 group by page_id")
def p1i_region_fallback(spark, sf):
    links = _pages(spark, sf).select("page_id", F.col("url").alias("from_url"), F.explode(K.extract_links(F.col("html"), F.col("url"))).alias("l"))
    region = F.when(F.col("page_id") % 2 == 0, F.col("l.region"))  # pages without any region fall back to following
    rows = links.select("page_id", F.concat("from_url", F.lit("#"), "page_id").alias("from_url"), F.col("l.url").alias("to_url"), F.lit("internal").alias("kind"), F.lit(False).alias("nofollow"), region.alias("region"), F.lit("page").alias("rel"))
    out = policy.decide(rows, policy.Scope(follow_regions=("main",)))
    return out.groupBy("page_id").agg(F.count_if(F.col("skip_reason") == "out-of-region").alias("n_out"), F.count_if(F.col("skip_reason").isNull()).cast("int").alias("n_in"))


@query("""select event_id, 1 + user_id % 25 > 3 or user_id % 40 > 32 as trap from events""")
def p2_url_traps(spark, sf):
    names = "array_join(transform(sequence(0, cast(user_id % 40 as int)), i -> concat('k', i, '=1')), '&')"
    url = F.expr(f"concat('https://h.example', repeat(concat('/', event_type), cast(1 + user_id % 25 as int)), '?', case when user_id % 40 = 0 then '' else substring_index({names}, '&', -cast(user_id % 40 as int)) end)")
    return V.table(spark, sf, "events").select("event_id", U.url_trap(url).alias("trap"))


@query(f"""with {V.FETCH_LOG}, f as (select host, event_type, bucket, min(seq) as first from fetch_log group by all),
a as (select *, row_number() over (partition by host, event_type order by first) <= 5 as admitted from f)
select seq, admitted from fetch_log join a using (host, event_type, bucket)""")
def p3_urls_per_path(spark, sf):
    return policy.urls_per_path(V.fetch_log(spark, sf), "seq", 5).select("seq", "admitted")


@query(f"with {V.WEB_PAGES} select page_seq, row_number() over (partition by content_hash order by page_seq) > 10 as soft_dup from web_pages")
def p4_soft_duplicates(spark, sf):
    return policy.soft_duplicates(V.web_pages(spark, sf), "page_seq").select("page_seq", "soft_dup")


def _rules(spark: SparkSession) -> DataFrame:
    return _inline(spark, [("https://h3.example", _ROBOTS, 200), ("https://h4.example", "", 503), ("https://h5.example", "User-agent: *\nDisallow: /", 404)], "origin string, body string, status int").withColumn("content_type", F.lit("text/plain"))


@query(f"""with {V.FETCH_LOG} select url, case when host = 'h4.example' then false when host = 'h3.example' then url not like 'https://h3.example/e/%' else true end as allowed from (select distinct url, host from fetch_log)""")
def p5_robots_allowed(spark, sf):
    rules = policy.robots_table(policy.robots_policy(_rules(spark)))
    urls = V.fetch_log(spark, sf).select("url").distinct()
    return policy.robots_allowed(urls, rules, "otherbot/2").select("url", "allowed")


@query("select * from (" + _values([("/private", False), ("/private/open/x", True), ("/e/1", True), ("/a.gif", True), ("/", True)]) + ") t(path, allowed)")
def p5_longest_match(spark, sf):
    rules = policy.robots_table(policy.robots_policy(_rules(spark)))
    urls = _inline(spark, [(p,) for p in ("/private", "/private/open/x", "/e/1", "/a.gif", "/")], "path string").withColumn("url", F.concat(F.lit("https://h3.example"), "path"))
    return policy.robots_allowed(urls, rules, "MyBot/2").select("path", "allowed")


@query("select * from (" + _values([("mybot/1", 0), ("mytool", 0), ("else", 1)]) + ") t(agent, group_no)")
def p7_agent_groups(spark, sf):
    rules = policy.robots_table(policy.robots_policy(_rules(spark))).where("origin = 'https://h3.example'")
    found = [policy.agent_groups(rules, a).select(F.lit(a).alias("agent"), "group_no").distinct() for a in ("mybot/1", "mytool", "else")]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("select * from (" + _values([("mybot/1", 2500.0), ("else", 30000.0)]) + ") t(agent, delay_ms)")
def p8_crawl_delay(spark, sf):
    rules = policy.robots_table(policy.robots_policy(_rules(spark)))
    found = [policy.crawl_delays(rules, a).select(F.lit(a).alias("agent"), "delay_ms") for a in ("mybot/1", "else")]
    return found[0].unionByName(found[1])


@query("select * from (" + _values([("https://h3.example", "rules"), ("https://h4.example", "disallow-all"), ("https://h5.example", "allow-all")]) + ") t(origin, policy)")
def p9_robots_policy(spark, sf):
    return policy.robots_policy(_rules(spark)).select("origin", "policy")


# joins, aggregates, reports


def _page(sql: str, columns: str) -> str:
    return f"with {V.WEB_PAGES} select {columns} from web_pages {sql}"


@query(_page("where ok and status in (200) order by page_seq limit 50 offset 20", "page_seq, url, status"))
def l1_list_pages(spark, sf):
    return reports.list_pages(V.web_pages(spark, sf), ok=True, status=[200], limit=50, offset=20).select("page_seq", "url", "status")


@query(_page("where not ok order by page_seq limit 100", "page_seq, url, status, error_kind"))
def l2_list_failed(spark, sf):
    return reports.list_failed(V.web_pages(spark, sf)).select("page_seq", "url", "status", "error_kind")


@query(f"with {V.WEB_LINKS} select from_url, to_url from web_links where kind = 'internal' and not followed and skip_reason = 'nofollow' order by l_orderkey, l_linenumber, l_partkey, l_suppkey limit 100")
def l3_list_links(spark, sf):
    return reports.list_links(V.web_links(spark, sf), kind="internal", followed=False, skip_reason="nofollow").select("from_url", "to_url")


@query(f"with {V.WEB_PAGES} select page_seq from web_pages order by page_seq limit 1000 offset 0")
def o1_paging(spark, sf):
    return reports.paged(V.web_pages(spark, sf), "page_seq", limit=5000, offset=-3).select("page_seq")


@query(f"""with {V.WEB_PAGES}, {V.WEB_LINKS} select to_url, status, error_kind, count(*) as n_links, count(distinct from_url) as n_sources, string_agg(distinct from_url, ',' order by from_url) as from_urls
from web_links join web_pages on url = to_url where not ok and web_pages.skip_reason is null group by to_url, status, error_kind""")
def l4_broken_links(spark, sf):
    out = reports.broken_links(V.web_links(spark, sf), V.web_pages(spark, sf))
    return out.select("to_url", "status", "error_kind", F.col("n_links"), F.size("from_urls").cast("long").alias("n_sources"), F.array_join("from_urls", ",").alias("from_urls"))


@query(f"""with {V.RUNS}, c as (select url, content_hash from run_b where ok), p as (select url, content_hash as previous_hash from run_a where ok)
select coalesce(c.url, p.url) as url, case when p.url is null then 'new' when c.url is null then 'removed' else 'changed' end as change, content_hash, previous_hash
from c full join p on c.url = p.url where c.url is null or p.url is null or content_hash <> previous_hash""")
def l5_list_changed(spark, sf):
    first, second = V.runs(spark, sf)
    return reports.changes(second, first)


@query(f"""with {V.WEB_PAGES}, {V.WEB_LINKS} select 3 as queued, 1 as in_flight, (select count(*) from web_pages where ok) as done, (select count(*) from web_pages where not ok) as failed,
(select cast(sum(size) as bigint) from web_pages) as bytes, (select count(*) from web_links where skip_reason is not null) as skipped""")
def l8_recompute_stats(spark, sf):
    frontier = _inline(spark, [("pending",)] * 3 + [("in_flight",), ("done",)], "status string")
    return reports.stats(V.web_pages(spark, sf), V.web_links(spark, sf), frontier)


@query(f"""with {V.WEB_PAGES}, {V.WEB_LINKS} select url, status, error_message as error, count(distinct from_url) as n_sources from web_links join web_pages on url = to_url where not ok group by all""")
def l9_broken_link_report(spark, sf):
    out = reports.broken_link_report(V.web_links(spark, sf), V.web_pages(spark, sf))
    return out.select("url", "status", "error", F.size("from_urls").cast("long").alias("n_sources"))


_MAP_PAGES = """m as (select page_id, case when page_id % 3 = 0 then regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/' else url end as loc, page_id % 7 <> 0 as fit from pages)"""


def _map_pages(spark: SparkSession, sf: str) -> DataFrame:
    return _pages(spark, sf).select(
        F.col("page_id").alias("page_seq"), F.lit(True).alias("ok"), F.lit(200).alias("status"), (F.col("page_id") % 7 == 0).alias("noindex"), F.lit("text/html; charset=utf-8").alias("content_type"),
        F.when(F.col("page_id") % 3 == 0, F.concat(U.origin("url"), F.lit("/"))).alias("canonical"), F.col("url").alias("final_url"), F.when(F.col("page_id") % 2 == 0, "2024-05-01").alias("lastmod"),
    )


@query(f"with {_MAP_PAGES} select loc, min(page_id) as page_seq, case when min(page_id) % 2 = 0 then '2024-05-01' end as lastmod from m where fit group by loc")
def l10_sitemap_rows(spark, sf):
    return reports.sitemap_rows(_map_pages(spark, sf))


@query(f"""with {_MAP_PAGES}, r as (select loc, min(page_id) as page_seq from m where fit group by loc)
select page_seq, chr(9) || '<url><loc>' || replace(loc, '&', '&amp;') || '</loc>' || case when page_seq % 2 = 0 then '<lastmod>2024-05-01</lastmod>' else '' end || '</url>' as line from r""")
def s14_sitemap_lines(spark, sf):
    return reports.sitemap_lines(_map_pages(spark, sf))


@query(f"with {V.WEB_PAGES} select status, count(*) as n from web_pages where status > 0 group by status")
def a3_by_status(spark, sf):
    return reports.by_status(V.web_pages(spark, sf))


@query(f"with {V.WEB_LINKS} select skip_reason, count(*) as n from web_links where skip_reason is not null group by skip_reason")
def a4_skipped_by_reason(spark, sf):
    return reports.skipped_by_reason(V.web_links(spark, sf))


@query("""select regexp_extract(url, '^https?://([^/?#]+)', 1) as host, count(*) as n from pages group by 1 order by n desc, host limit 20""")
def a6_top_hosts(spark, sf):
    return reports.top_hosts(_pages(spark, sf), U.host("url"), 20)


@query(f"with {V.WEB_PAGES}, s as (select status, count(*) as n from web_pages where status > 0 group by status) select status, cast(2 * n as bigint) as n from s")
def a8_merge_stats(spark, sf):
    one = reports.by_status(V.web_pages(spark, sf))
    return reports.merge_counts(one, one, "status")


@query("select 110 as done, 10 as failed, 24.0 as pages_per_second, 1250.0 as eta_ms")
def a7_rates(spark, sf):
    row = _inline(spark, [(110, 10, 25, 5)], "done int, failed int, queued int, in_flight int")
    return reports.rates(row, 5000).select("done", "failed", "pages_per_second", "eta_ms")


@query(f"with {V.WEB_PAGES}, {V.WEB_LINKS} select distinct from_url from web_links where to_url in (select url from web_pages where ok)")
def j5_visited_semi(spark, sf):
    seen = V.web_pages(spark, sf).where("ok").select(F.col("url").alias("to_url"))
    return V.web_links(spark, sf).join(seen, "to_url", "left_semi").select("from_url").distinct()


@query(f"""with {V.WEB_PAGES}, {V.WEB_LINKS} select to_url as url, min(l_orderkey) as seq from web_links where to_url not in (select url from web_pages where page_seq % 2 = 0) group by to_url""")
def j6_frontier_anti(spark, sf):
    new = V.web_links(spark, sf).select(F.col("to_url").alias("url"), F.col("link_seq.l_orderkey").alias("seq"))
    return archive.push(V.web_pages(spark, sf).where("page_seq % 2 = 0"), new)


@query("select o_orderkey as crawl_id from orders order by o_orderdate desc, o_orderkey desc limit 100")
def o2_latest_crawls(spark, sf):
    runs = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("crawl_id"), F.col("o_orderdate").alias("created_at"))
    return reports.latest_crawls(runs).select("crawl_id")


@query("""with own as (select o_orderdate as d, o_orderkey as k from orders order by o_orderkey desc limit 1)
select o_orderkey as crawl_id from orders, own where o_orderstatus = 'F' and (o_orderdate < d or (o_orderdate = d and o_orderkey < k)) order by o_orderdate desc, o_orderkey desc limit 1""")
def w5_baseline_run(spark, sf):
    orders = V.table(spark, sf, "orders")
    last = orders.agg(F.max("o_orderkey")).head()[0]
    runs = orders.select(F.col("o_orderkey").alias("crawl_id"), F.col("o_orderkey").cast("string").alias("uid"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("status"))
    return reports.baseline(runs, str(last))


@query(f"with {V.FETCH_LOG} select seq, host, cast((row_number() over (partition by host order by seq) - 1) * 250 as bigint) as start_ms from fetch_log")
def w6_politeness_schedule(spark, sf):
    return reports.politeness(V.fetch_log(spark, sf), 250).select("seq", "host", "start_ms")


@query(f"""with {V.FETCH_LOG}, r as (select *, row_number() over (partition by host order by seq % 3, seq) as k from fetch_log) select seq from r where k <= 2 and host <> 'h1.example' order by seq % 3, seq limit 25""")
def w2_claim_order(spark, sf):
    frontier = V.fetch_log(spark, sf).withColumns({"priority": F.col("seq") % 3, "status": F.lit("pending")})
    return archive.claim(frontier, 25, exclude_hosts=("h1.example",), per_host=2).select("seq")


@query("select event_id, strftime(ts, '%Y-%m-%d') as day from events")
def l10_http_date(spark, sf):
    text = F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    return V.table(spark, sf, "events").select("event_id", reports.http_date(text).alias("day"))


# state


def _archives(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """An archive of even pages, and a run's responses for those whose number is divisible by three."""
    pages = _pages(spark, sf)
    common = {"charset": F.lit("utf-8"), "content_type": F.lit("text/html"), "fetched_at": F.lit("2024-01-01").cast("timestamp")}
    cols = ["url", "body", "content_type", "charset", "etag", "last_modified", "content_hash", "last_status", "size", "fetched_at"]
    old = pages.where("page_id % 2 = 0").withColumns({**common, "body": F.encode("html", "UTF-8"), "etag": F.concat(F.lit("e"), "page_id"), "last_modified": F.lit("old"), "content_hash": F.sha2("html", 256), "last_status": F.lit(200), "size": F.octet_length("html").cast("long")})
    kept = F.col("page_id") % 4 == 0  # a 304: no body, no tag
    new = pages.where("page_id % 3 = 0").withColumns({**common, "fetched_at": F.lit("2024-02-02").cast("timestamp"), "body": F.when(~kept, F.encode(F.concat("html", F.lit("!")), "UTF-8")), "etag": F.when(~kept, "new"), "last_modified": F.lit(None).cast("string"), "content_hash": F.when(~kept, F.sha2(F.concat("html", F.lit("!")), 256)), "last_status": F.when(kept, 304).otherwise(200), "size": F.when(~kept, F.octet_length("html").cast("long") + 1)})
    return old.select(cols), new.select(cols)


_ARCHIVES = """o as (select url, html as body, 'e' || page_id as etag, 'old' as last_modified, sha256(html) as content_hash, 200 as last_status, strlen(html) as size, timestamp '2024-01-01' as fetched_at from pages where page_id % 2 = 0),
n as (select url, case when page_id % 4 <> 0 then html || '!' end as body, case when page_id % 4 <> 0 then 'new' end as etag, cast(null as varchar) as last_modified, case when page_id % 4 <> 0 then sha256(html || '!') end as content_hash,
  case when page_id % 4 = 0 then 304 else 200 end as last_status, case when page_id % 4 <> 0 then strlen(html) + 1 end as size, timestamp '2024-02-02' as fetched_at from pages where page_id % 3 = 0)"""


@query(f"""with {_ARCHIVES} select url, sha256(coalesce(n.body, o.body)) as body_hash, coalesce(n.etag, o.etag) as etag, coalesce(n.last_modified, o.last_modified) as last_modified, coalesce(n.content_hash, o.content_hash) as content_hash,
case when n.last_status is not null then n.last_status else o.last_status end as last_status, cast(coalesce(n.size, o.size) as bigint) as size, strftime(coalesce(n.fetched_at, o.fetched_at), '%Y-%m-%d') as day from o full join n using (url)""")
def m1_archive_upsert(spark, sf):
    old, new = _archives(spark, sf)
    return archive.upsert_archive(old, new).select("url", F.sha2("body", 256).alias("body_hash"), "etag", "last_modified", "content_hash", "last_status", "size", F.date_format("fetched_at", "yyyy-MM-dd").alias("day"))


@query(f"""with {_ARCHIVES} select url, o.body is not null as has_body, case when n.url is null then o.etag else n.etag end as etag, case when n.url is null then o.content_hash else n.content_hash end as content_hash,
case when n.url is null then o.last_status else n.last_status end as last_status from o full join n using (url)""")
def m5_visited_replace(spark, sf):
    old, new = _archives(spark, sf)
    return archive.visited(old, new).select("url", F.col("body").isNotNull().alias("has_body"), "etag", "content_hash", "last_status")


@query(f"""with {V.RUNS}, a as (select * replace (7 as crawl_id) from run_a), b as (select * replace (7 as crawl_id) from run_b)
select url, content_hash from b union all select url, content_hash from a where url not in (select url from b)""")
def m2_page_upsert(spark, sf):
    first, second = (r.withColumn("crawl_id", F.lit(7)) for r in V.runs(spark, sf))
    return archive.upsert_pages(first, second).select("url", "content_hash")


@query(f"""with {V.WEB_LINKS} select from_url, to_url, count(*) as n from web_links where l_orderkey % 2 = 1 group by all
union all select from_url, 'https://new.example/', 1 from (select distinct from_url from web_links where l_orderkey % 2 = 0)""")
def m3_edge_replace(spark, sf):
    links = V.web_links(spark, sf).withColumn("even", F.col("link_seq.l_orderkey") % 2 == 0)
    pages = links.where("even").select("crawl_id", F.col("from_url").alias("url")).distinct()
    new = pages.select("crawl_id", F.col("url").alias("from_url"), F.lit("https://new.example/").alias("to_url"))
    return archive.replace_links(links.select("crawl_id", "from_url", "to_url"), new, pages).groupBy("from_url", "to_url").agg(F.count("*").alias("n"))


@query(f"""with {V.RUNS} select 'page' as name, crawl_id, count(*) as n from run_a group by 2 union all select 'crawl', 1, 1 union all select 'frontier', 1, count(*) from run_a
union all select 'link', 1, (select count(*) from lineitem where l_orderkey % 2 = 1) union all select 'archive', 0, count(*) from run_b""")
def m8_delete_cascade(spark, sf):
    first, second = V.runs(spark, sf)
    odd = F.col("link_seq.l_orderkey") % 2 == 1
    tables = {
        "crawl": _inline(spark, [(1, "one"), (2, "two")], "crawl_id int, uid string"), "page": first.unionByName(second),
        "link": V.web_links(spark, sf).withColumn("crawl_id", F.when(odd, 1).otherwise(2)), "frontier": first.select("crawl_id", "url").unionByName(second.select("crawl_id", "url")),
    }
    left = archive.cascade(tables, "two")
    counts = [t.groupBy("crawl_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "crawl_id", "n") for name, t in left.items()]
    stays = second.agg(F.count("*").alias("n")).select(F.lit("archive").alias("name"), F.lit(0).alias("crawl_id"), "n")
    return reduce(DataFrame.unionByName, [*counts, stays])


@query("""with h as (select min(regexp_extract(url, '^https?://([^/?#]+)', 1)) as h from pages) select url from pages, h where page_id % 2 = 0 and regexp_extract(url, '^https?://([^/?#]+)', 1) <> h""")
def m9_prune_host(spark, sf):
    name = _pages(spark, sf).agg(F.min(U.host("url"))).head()[0]
    return archive.prune(_archives(spark, sf)[0], host=name.upper())[0].select("url")


@query(f"""with {_ARCHIVES} select url from n""")
def m9_prune_age(spark, sf):
    # An archive has one row a url; of pages that share one any will do, as its age is all that is asked.
    old, new = _archives(spark, sf)
    old = old.dropDuplicates(["url"])
    return archive.prune(archive.upsert_archive(old, new), older_than=F.lit("2024-01-15").cast("timestamp"))[0].select("url")


@query(f"with {_ARCHIVES} select url, etag as if_none_match, last_modified as if_modified_since from o")
def p15_conditional_headers(spark, sf):
    return reports.conditional(_archives(spark, sf)[0])


@query(f"with {_ARCHIVES} select url, etag, last_modified, content_hash, body is not null as has_body from n")
def l7_validators(spark, sf):
    return reports.validators(_archives(spark, sf)[1])


@query(f"with {_ARCHIVES}, f as (select min(url) as u from o) select url, sha256(body) as body_hash, etag from o join f on url = u")
def s15_stored_body(spark, sf):
    stored = _archives(spark, sf)[0]
    url = stored.agg(F.min("url")).head()[0]
    return reports.stored_body(stored, url).select(F.lit(url).alias("url"), F.sha2("body", 256).alias("body_hash"), "etag")


# traversal

_REACH = f"""with recursive {V.SITE}, reach(id, depth) as (
  select page_id, 0 from site_seeds union select to_id, depth + 1 from reach join site_edges on from_id = id where depth < 12)"""


@query(f"{_REACH} select id, min(depth) as depth from reach group by id")
def bfs_depths(spark, sf):
    return traversal.bfs(V.site_edges(spark, sf), V.site_seeds(spark, sf).withColumnRenamed("page_id", "id"), max_depth=12, ordered=False).select("id", "depth")


@query(f"{_REACH}, d as (select id, min(depth) as depth from reach group by id) select depth, count(*) as n from d group by depth")
def bfs_depth_histogram(spark, sf):
    found = traversal.bfs(V.site_edges(spark, sf), V.site_seeds(spark, sf).withColumnRenamed("page_id", "id"), max_depth=12, ordered=False)
    return found.groupBy("depth").agg(F.count("*").alias("n"))


@query(f"{_REACH}, d as (select id, min(depth) as depth from reach group by id) select id from d where depth <= 1")
def p12_max_depth(spark, sf):
    return traversal.bfs(V.site_edges(spark, sf), V.site_seeds(spark, sf).withColumnRenamed("page_id", "id"), max_depth=1, ordered=False).select("id")


_LEVEL1 = f"""with {V.SITE}, s as (select page_id as id, row_number() over (order by page_id) - 1 as seq from site_seeds),
e as (select s.seq as ps, s.id as parent, pos, to_id as id from s join site_edges on from_id = s.id where to_id not in (select id from s)),
f as (select *, row_number() over (partition by id order by ps, pos) as k from e),
g as (select id, parent, pos, row_number() over (order by ps, pos) - 1 + (select count(*) from s) as seq from f where k = 1)"""


@query(f"{_LEVEL1} select id, parent, cast(pos as int) as pos, seq, 1 as depth from g union all select id, null, null, seq, 0 from s")
def bfs_followed_tree(spark, sf):
    return traversal.bfs(V.site_edges(spark, sf), V.site_seeds(spark, sf).withColumnRenamed("page_id", "id"), max_depth=1)


@query(f"{_LEVEL1} select id from (select id, seq from g union all select id, seq from s) where seq < 40")
def bfs_max_pages(spark, sf):
    # A page's place is fixed by its own level, so the deepest level that counts is known once 40 places are taken.
    return traversal.bfs(V.site_edges(spark, sf), V.site_seeds(spark, sf).withColumnRenamed("page_id", "id"), max_depth=1, max_nodes=40).select("id")


@query("""with recursive m as (select p_partkey as k, case when p_partkey % 5 <> 0 then p_partkey - 1 end as nxt from part),
c(start, place, hops) as (select k, k, 0 from m where k % 3 = 0 union all select start, nxt, hops + 1 from c join m on k = place where nxt is not null and hops < 10)
select start as id, min(place) as final, max(hops) as hops from c group by start""")
def s2_redirect_chains(spark, sf):
    k = F.col("p_partkey")
    parts = V.table(spark, sf, "part")
    moves = parts.select(k.cast("string").alias("url"), F.when(k % 5 != 0, (k - 1).cast("string")).alias("redirect_to"))
    asked = parts.where(k % 3 == 0).select(k.alias("id"), k.cast("string").alias("url"))
    found = net.follow_redirects(asked, moves)
    return found.select("id", F.col("final_url").cast("long").alias("final"), F.size("redirects").alias("hops"))


@query(f"""with {V.WEB_PAGES} select page_seq, case when page_seq % 17 in (3, 5, 7, 11) then 404 when page_seq % 2 = 0 then 304 else 200 end as status, page_seq % 17 not in (3, 5, 7, 11) and page_seq % 2 = 0 as not_modified,
case when page_seq % 17 in (3, 5, 7, 11) then false else true end as ok from web_pages""")
def recrawl_304(spark, sf):
    pages = V.web_pages(spark, sf)
    corpus = pages.where("status = 200").select(
        "url", F.lit(200).alias("status"), F.lit("text/html").alias("content_type"), F.lit("utf-8").alias("charset"), F.lit("<p>").alias("body"), F.lit(None).cast("string").alias("redirect_to"),
        F.when(F.col("page_seq") % 2 == 0, F.concat(F.lit("e"), "page_seq")).alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.lit(None).cast("string").alias("error_kind"), F.lit(None).cast("string").alias("error_message"),
    )
    stored = pages.select("url", F.concat(F.lit("e"), "page_seq").alias("if_none_match"), F.lit(None).cast("string").alias("if_modified_since"))
    return net.fetch(pages.select("page_seq", "url"), corpus, stored).select("page_seq", "status", "not_modified", "ok")


@query("select o_orderkey as id, k > 1 or o_custkey % 9 = 0 as dup from (select *, row_number() over (partition by o_custkey order by o_orderkey) as k from orders)")
def j11_redirect_convergence(spark, sf):
    # Orders are claims that redirect to their customer's page; every ninth customer's was fetched before.
    orders = V.table(spark, sf, "orders")
    page = F.concat(F.lit("c"), "o_custkey")
    claimed = orders.select(F.concat(F.lit("o"), "o_orderkey").alias("url"), F.col("o_orderkey").alias("ord"), page.alias("final_key"), F.array(F.concat(F.lit("o"), "o_orderkey")).alias("hops"))
    old = orders.where("o_custkey % 9 = 0").select(page.alias("url")).distinct()
    return policy.converged(claimed, old).select(F.col("ord").alias("id"), "dup")


_SITE = {
    "/": ("<title>Start</title><nav><a href=/one>1</a></nav><a href=/two>2</a><a href='/same?utm_source=q'>s</a><a href=/moved>m</a><a href=/hidden/x>h</a><a href=http://far.example/x>f</a>", None),
    "/one": ("<title>One</title><a href=/two>two</a><a href=/>start</a><a rel=nofollow href=/no>n</a>", None),
    "/two": ("<title>Two</title><a href=/one>one</a><a href=/same>same</a><a href=mailto:a@b.c>mail</a>", None),
    "/same": ("<title>Same</title>", None),
    "/moved": (None, "/target"),
    "/target": ("<title>Target</title><a href=/deep/1>d</a>", None),
    "/deep/1": ("<title>Deep</title>", None),
    "/robots.txt": ("User-agent: *\nDisallow: /hidden/", None),
}
_SITE_ROWS = [
    (0, "/", 0, "Start", 6, 4), (1, "/one", 1, "One", 3, 0), (2, "/two", 1, "Two", 3, 0), (3, "/same", 1, "Same", 0, 0), (4, "/moved", 1, "Target", 1, 1), (5, "/deep/1", 2, "Deep", 0, 0),
]


_crawled: dict[str, object] = {}


def _small_crawl(spark: SparkSession):
    """Made once a session: two queries look at it."""
    key = spark.sparkContext.applicationId
    if key not in _crawled:
        _crawled[key] = _new_small_crawl(spark)
    return _crawled[key]


def _new_small_crawl(spark: SparkSession):
    rows = [(f"http://small.example{u}", 200, "text/plain" if u.endswith("txt") else None, None, h, to and f"http://small.example{to}", None, None, None, None, None) for u, (h, to) in _SITE.items()]
    return crawl(spark, _inline(spark, rows, net.CORPUS), "http://small.example", Options(max_depth=5))


@query("select * from (" + _values(_SITE_ROWS) + ") t(page_seq, path, depth, title, n_links, n_followed)")
def crawl_small_site(spark, sf):
    report = _small_crawl(spark)
    links = report.links.groupBy(F.col("from_url").alias("url")).agg(F.count("*").alias("n_links"), F.count_if("followed").alias("n_followed"))
    pages = report.pages.join(links, "url", "left")
    return pages.select("page_seq", U.path("url").alias("path"), "depth", "title", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_links", "n_followed")])


@query("select * from (" + _values([("followed", 5), ("duplicate", 4), ("out-of-scope", 1), ("robots-disallow", 1), ("nofollow", 1), ("bad-scheme", 1)]) + ") t(reason, n)")
def crawl_small_site_reasons(spark, sf):
    return _small_crawl(spark).links.groupBy(F.coalesce("skip_reason", F.lit("followed")).alias("reason")).agg(F.count("*").alias("n"))


def _stream(spark: SparkSession, sf: str):
    schema = V.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").load(sf, format="parquet")


@query("select event_type as status, count(*) as n, cast(sum(event_id) as bigint) as bytes from events group by event_type")
def stream_counts(spark, sf):
    """The stream of events, counted as it comes; the result is that of the last trigger."""
    made = stream.counts(_stream(spark, sf).select(F.col("event_type").alias("status"), F.col("event_id").alias("size")))
    return stream.collected(made, "complete")


_STREAMED = f"""with {V.FETCH_LOG}"""


@query(f"{_STREAMED} select distinct url from fetch_log")
def stream_first_seen(spark, sf):
    return stream.collected(stream.first_seen(V.fetch_log(spark, sf, _stream(spark, sf)).select("url")), "append")


@query(f"""{_STREAMED}, f as (select host, event_type, bucket, min(seq) as first from fetch_log group by all),
a as (select *, row_number() over (partition by host, event_type order by first) <= 5 as admitted from f)
select seq, admitted from fetch_log join a using (host, event_type, bucket)""")
def stream_admit(spark, sf):
    made = stream.admit(V.fetch_log(spark, sf, _stream(spark, sf)), 5)
    return stream.collected(made, "append").select("seq", "admitted")


@query(f"{_STREAMED} select count(*) as n, count(distinct url) as n_urls from fetch_log")
def stream_persist(spark, sf):
    """Batches written by their number, so that a batch tried twice is there once."""
    return stream.persisted(V.fetch_log(spark, sf, _stream(spark, sf)).select("seq", "url"), again=True).agg(F.count("*").alias("n"), F.countDistinct("url").alias("n_urls"))


@query(f"""{_STREAMED}, h as (select *, row_number() over (partition by url order by seq) as k from fetch_log) select seq, k > 3 as soft_dup from h""")
def stream_soft_duplicates(spark, sf):
    made = stream.repeats(V.fetch_log(spark, sf, _stream(spark, sf)).select("seq", F.col("url").alias("content_hash")), 3)
    return stream.collected(made, "append").select("seq", "soft_dup")


@query(f"""{_STREAMED} select seq, cast((row_number() over (partition by host order by seq) - 1) * 250 as bigint) as start_ms from fetch_log""")
def stream_host_schedule(spark, sf):
    made = stream.schedule(V.fetch_log(spark, sf, _stream(spark, sf)).select("seq", "host"), 250)
    return stream.collected(made, "append").select("seq", "start_ms")


from sitegraph.plans import site_queries  # noqa: E402, F401 - registers its own
