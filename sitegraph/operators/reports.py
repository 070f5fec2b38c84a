"""Reports over page, link, frontier and run tables: each takes and gives DataFrames, with explicit sequence columns for order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegraph.operators.ranking import ranked_within

LIMIT, MOST = 100, 1000


def paged(rows: DataFrame, order: str, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """A page of rows in order; limits default to 100 and stay within 0..1000."""
    n = LIMIT if limit is None else max(0, min(MOST, int(limit)))
    return rows.orderBy(order).offset(max(0, int(offset or 0))).limit(n)


def list_pages(pages: DataFrame, ok: bool | None = None, status: list[int] | None = None, not_modified: bool | None = None, skipped: bool | None = None, **page: int | None) -> DataFrame:
    if ok is not None:
        pages = pages.where(F.col("ok") == ok)
    if status is not None:
        pages = pages.where(F.col("status").isin(*status))
    if not_modified is not None:
        pages = pages.where(F.col("not_modified") == not_modified)
    if skipped is not None:
        pages = pages.where(F.col("skip_reason").isNotNull() if skipped else F.col("skip_reason").isNull())
    return paged(pages, "page_seq", **page)


def list_failed(pages: DataFrame, **page: int | None) -> DataFrame:
    return list_pages(pages, ok=False, skipped=False, **page)


def list_links(links: DataFrame, kind: str | None = None, rel: str | None = None, followed: bool | None = None, skip_reason: str | None = None, to_url: str | None = None, **page: int | None) -> DataFrame:
    for column, value in (("kind", kind), ("rel", rel), ("followed", followed), ("skip_reason", skip_reason), ("to_url", to_url)):
        if value is not None:
            links = links.where(F.col(column) == value)
    return paged(links, "link_seq", **page)


def broken_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(to_url, status, error_kind, from_urls, n_links) of dead pages that this run visited, most links first.

    Dead pages are few and the links many: the join is on the target, and sources are collected per target after a
    distinct, so that a target with many links is aggregated on the map side first.
    """
    dead = pages.where(~F.col("ok") & F.col("skip_reason").isNull()).select(F.col("url").alias("to_url"), "status", "error_kind")
    hits = links.select("from_url", "to_url").join(dead, "to_url")
    sources = hits.groupBy("to_url", "status", "error_kind", "from_url").agg(F.count("*").alias("n"))
    out = sources.groupBy("to_url", "status", "error_kind").agg(F.sort_array(F.collect_list("from_url")).alias("from_urls"), F.sum("n").alias("n_links"))
    return out.orderBy(F.desc("n_links"), "to_url")


def broken_link_report(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(url, status, error, from_urls), by distinct sources."""
    dead = pages.where(~F.col("ok")).select("url", "status", F.col("error_message").alias("error"))
    hits = links.select(F.col("to_url").alias("url"), "from_url").distinct().join(dead, "url")
    out = hits.groupBy("url", "status", "error").agg(F.sort_array(F.collect_list("from_url")).alias("from_urls"))
    return out.orderBy(F.desc(F.size("from_urls")), "url")


def changes(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(url, change, content_hash, previous_hash) between the sound pages of two runs."""
    def sound(pages: DataFrame, name: str) -> DataFrame:
        return pages.where(F.col("ok") & F.col("skip_reason").isNull()).select("url", F.col("content_hash").alias(name), F.lit(True).alias(f"in_{name}"))

    both = sound(current, "content_hash").join(sound(previous, "previous_hash"), "url", "full_outer")
    new, gone = F.col("in_previous_hash").isNull(), F.col("in_content_hash").isNull()
    return both.where(new | gone | ~F.col("content_hash").eqNullSafe(F.col("previous_hash"))).select(
        "url", F.when(new, "new").when(gone, "removed").otherwise("changed").alias("change"), "content_hash", "previous_hash"
    )


def baseline(crawls: DataFrame, uid: str) -> DataFrame:
    """The latest completed run before this one (crawl_id), or no row."""
    own = crawls.where(F.col("uid") == uid).select(F.struct("created_at", "crawl_id").alias("own"))
    before = crawls.where("status = 'completed'").join(F.broadcast(own.limit(1)), F.struct("created_at", "crawl_id") < F.col("own"))
    return before.agg(F.max_by("crawl_id", F.struct("created_at", "crawl_id")).alias("crawl_id")).where("crawl_id is not null")


def stats(pages: DataFrame, links: DataFrame, frontier: DataFrame) -> DataFrame:
    """One row of counts from the three tables, one pass over each."""
    shown = F.col("skip_reason").isNull()
    a = frontier.agg(F.count_if(F.col("status") == "pending").alias("queued"), F.count_if(F.col("status") == "in_flight").alias("in_flight"))
    b = pages.agg(F.count_if(F.col("ok") & shown).alias("done"), F.count_if(~F.col("ok") & shown).alias("failed"), F.coalesce(F.sum(F.col("size").cast("long")), F.lit(0).cast("long")).alias("bytes"))
    c = links.agg(F.count_if(~shown).alias("skipped"))
    one = F.lit(1).alias("one")
    return a.select("*", one).join(b.select("*", one), "one").join(c.select("*", one), "one").drop("one")


def by_status(pages: DataFrame) -> DataFrame:
    return pages.where("status > 0").groupBy("status").agg(F.count("*").alias("n"))


def skipped_by_reason(links: DataFrame) -> DataFrame:
    return links.where("skip_reason is not null").groupBy("skip_reason").agg(F.count("*").alias("n"))


def top_hosts(pages: DataFrame, host: Column, most: int = 100) -> DataFrame:
    return pages.select(host.alias("host")).where("host <> ''").groupBy("host").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "host").limit(most)


def merge_counts(a: DataFrame, b: DataFrame, key: str, value: str = "n") -> DataFrame:
    """Two snapshots of counts as one."""
    return a.unionByName(b).groupBy(key).agg(F.sum(value).alias(value))


def politeness(requests: DataFrame, delay_ms: int, host: str = "host", order: str = "seq") -> DataFrame:
    """Adds ``start_ms``: the earliest moment of each request if those of a host keep the delay."""
    return ranked_within(requests, host, [order], "__turn").withColumn("start_ms", F.col("__turn") * delay_ms).drop("__turn")


def rates(counted: DataFrame, elapsed_ms: int) -> DataFrame:
    """Adds pages per second and the remaining milliseconds at that rate to a row of ``stats``."""
    done = F.col("done") + F.col("failed")
    per = F.when(F.lit(elapsed_ms) > 0, done * 1000.0 / elapsed_ms).otherwise(0.0)
    return counted.withColumns({"pages_per_second": per, "eta_ms": F.when(per > 0, (F.col("queued") + F.col("in_flight")) * 1000.0 / per)})


def sitemap_rows(pages: DataFrame) -> DataFrame:
    """(loc, lastmod) of indexable HTML pages, one per location, the first page's."""
    fit = F.col("ok") & (F.col("status") == 200) & ~F.coalesce(F.col("noindex"), F.lit(False)) & F.coalesce(F.col("content_type").contains("html"), F.lit(False))
    loc = F.coalesce("canonical", "final_url")
    return pages.where(fit).groupBy(loc.alias("loc")).agg(F.min_by("lastmod", "page_seq").alias("lastmod"), F.min("page_seq").alias("page_seq"))


def xml_escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def sitemap_lines(pages: DataFrame) -> DataFrame:
    """(page_seq, line): the entries of a sitemap file, to be written in order between its head and foot."""
    mod = F.when(F.col("lastmod").isNotNull(), F.concat(F.lit("<lastmod>"), xml_escape(F.col("lastmod")), F.lit("</lastmod>"))).otherwise("")
    return sitemap_rows(pages).select("page_seq", F.concat(F.lit("\t<url><loc>"), xml_escape(F.col("loc")), F.lit("</loc>"), mod, F.lit("</url>")).alias("line"))


SITEMAP_HEAD = "<?xml version='1.0' encoding='utf-8'?>\n<urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'>\n"
SITEMAP_FOOT = "\n</urlset>\n"


def http_date(c: Column) -> Column:
    """The day of an HTTP date (the name of the weekday is passed over), null if it isn't one."""
    day = F.try_to_timestamp(F.substring(c, 6, 40), F.lit("dd MMM yyyy HH:mm:ss zzz"))
    return F.date_format(day, "yyyy-MM-dd")


def latest_crawls(crawls: DataFrame, limit: int | None = None, offset: int | None = None) -> DataFrame:
    n = LIMIT if limit is None else max(0, min(MOST, int(limit)))
    return crawls.orderBy(F.desc("created_at"), F.desc("crawl_id")).offset(max(0, int(offset or 0))).limit(n)


def validators(archive: DataFrame) -> DataFrame:
    return archive.select("url", "etag", "last_modified", "content_hash", F.col("body").isNotNull().alias("has_body"))


def stored_body(archive: DataFrame, url: str) -> DataFrame:
    return archive.where((F.col("url") == url) & F.col("body").isNotNull()).select("body", "content_type", "charset", "content_hash", "etag", "last_modified", "fetched_at")


def decoded(body: Column, charset: Column) -> Column:
    """Stored bytes as text by their charset's name; an unknown one counts as UTF-8."""
    name = F.upper(F.coalesce(charset, F.lit("UTF-8")))
    return F.when(name.isin("ISO-8859-1", "LATIN1", "WINDOWS-1252"), F.decode(body, "ISO-8859-1")).when(name.isin("UTF-16", "UTF-16LE", "UTF-16BE"), F.decode(body, "UTF-16")).otherwise(F.decode(F.to_binary(F.hex(body), F.lit("hex")), "UTF-8"))


def page_error(kind: str, message: str, status: str) -> Column:
    """A page's error as (kind, message, status, retryable), null where there is none. What the transport may get over by
    asking again can be tried again; kinds that aren't the transport's are ``internal`` and can't."""
    known, again = ("timeout", "network", "dns", "tls", "aborted", "too-many-redirects", "too-large", "http"), ("timeout", "network", "dns")
    told = F.when(F.col(kind).isin(*known), F.col(kind)).otherwise("internal")
    return F.when(F.col(kind).isNotNull(), F.struct(told.alias("kind"), F.coalesce(message, kind).alias("message"), F.col(status).cast("int").alias("status"), told.isin(*again).alias("retryable")))


def scrape(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds description (of the page's meta tag) and headings (the text of all h1 and h2, in order), without entities decoded."""
    space = r"[\s\x0B\u00A0\uFEFF]+"
    tag = F.regexp_extract(html, r"(?i)(<meta[^>]+name=[\"']?description[\"']?[^>]*>)", 1)
    said = F.trim(F.regexp_extract(tag, r"(?i)content=[\"']([^\"']*)[\"']", 1))
    parts = F.regexp_extract_all(html, F.lit(r"(?i)<h[12][^>]*>([\s\S]*?)</h[12]>"), 1)
    texts = F.transform(parts, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"<[^>]*>", " "), space, " ")))
    return pages.withColumns({"description": F.when(said != "", said), "headings": F.filter(texts, lambda x: x != "")})


def conditional(archive: DataFrame) -> DataFrame:
    """(url, if_none_match, if_modified_since): only where a body is stored to fall back on."""
    return archive.where("body is not null and (etag is not null or last_modified is not null)").select("url", F.col("etag").alias("if_none_match"), F.col("last_modified").alias("if_modified_since"))
