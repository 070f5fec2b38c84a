"""Tables of the site model made from the given ones, in DataFrames and in SQL (for the checks)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per part, with answers of several kinds."""
    k = F.col("p_partkey")
    m = F.pmod(k, F.lit(17))
    status = F.when(m == 3, 404).when(m == 5, 500).when(m == 7, None).when(m == 11, 304).otherwise(200)
    return table(spark, sf_dir, "part").select(
        F.lit(1).alias("crawl_id"), F.concat(F.lit("https://shop.example/part/"), k).alias("url"), k.alias("page_seq"), status.cast("int").alias("status"),
        F.coalesce((status == 200) | (status == 304), F.lit(False)).alias("ok"), F.coalesce(status == 304, F.lit(False)).alias("not_modified"),
        F.when(m == 7, "timeout").alias("error_kind"), F.when(m == 7, "took too long").alias("error_message"), F.sha2("p_name", 256).alias("content_hash"),
        F.col("p_size").cast("long").alias("size"), F.lit(None).cast("string").alias("skip_reason"),
    )


WEB_PAGES = """web_pages as (
  select 1 as crawl_id, 'https://shop.example/part/' || p_partkey as url, p_partkey as page_seq, st as status, coalesce(st in (200, 304), false) as ok,
    coalesce(st = 304, false) as not_modified, case when m = 7 then 'timeout' end as error_kind, case when m = 7 then 'took too long' end as error_message,
    sha256(p_name) as content_hash, cast(p_size as bigint) as size, cast(null as varchar) as skip_reason
  from (select *, case m when 3 then 404 when 5 then 500 when 7 then null when 11 then 304 else 200 end as st from (select *, p_partkey % 17 as m from part)))"""


def web_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A link per line item, from its order to its part; link_seq is given by the four keys."""
    nofollow, external = F.col("l_returnflag") == "R", F.col("l_linenumber") == 7
    reason = F.when(external, "out-of-scope").when(nofollow, "nofollow")
    return table(spark, sf_dir, "lineitem").select(
        F.lit(1).alias("crawl_id"), F.concat(F.lit("https://shop.example/order/"), F.col("l_orderkey")).alias("from_url"),
        F.concat(F.lit("https://shop.example/part/"), F.col("l_partkey")).alias("to_url"), F.when(external, "external").otherwise("internal").alias("kind"),
        F.lit("page").alias("rel"), nofollow.alias("nofollow"), reason.alias("skip_reason"), reason.isNull().alias("followed"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("link_seq"),
    )


WEB_LINKS = """web_links as (
  select 1 as crawl_id, 'https://shop.example/order/' || l_orderkey as from_url, 'https://shop.example/part/' || l_partkey as to_url,
    case when l_linenumber = 7 then 'external' else 'internal' end as kind, 'page' as rel, l_returnflag = 'R' as nofollow,
    case when l_linenumber = 7 then 'out-of-scope' when l_returnflag = 'R' then 'nofollow' end as skip_reason,
    not (l_linenumber = 7 or l_returnflag = 'R') as followed, l_orderkey, l_linenumber, l_partkey, l_suppkey
  from lineitem)"""


def runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two runs over the pages: the second lost some, changed some and found some."""
    pages, k = web_pages(spark, sf_dir), F.col("page_seq")
    first = pages.where(F.pmod(k, F.lit(11)) != 0)
    changed = F.when(F.pmod(k, F.lit(7)) == 0, F.sha2(F.concat("content_hash", F.lit("x")), 256)).otherwise(F.col("content_hash"))
    return first, pages.where(F.pmod(k, F.lit(13)) != 0).withColumns({"crawl_id": F.lit(2), "content_hash": changed})


RUNS = (
    WEB_PAGES
    + """,
run_a as (select * from web_pages where page_seq % 11 <> 0),
run_b as (select * replace (2 as crawl_id, case when page_seq % 7 = 0 then sha256(content_hash || 'x') else content_hash end as content_hash)
  from web_pages where page_seq % 13 <> 0)"""
)


def fetch_log(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """A request per event (of the table, or of a stream of it)."""
    bucket = F.floor(F.col("value") / 10).cast("long")
    host = F.concat(F.lit("h"), F.pmod("user_id", F.lit(20)), F.lit(".example"))
    return (table(spark, sf_dir, "events") if events is None else events).select(
        F.col("event_id").alias("seq"), host.alias("host"), F.col("event_type"), F.col("ts"),
        F.concat(F.lit("https://"), host, F.lit("/e/"), F.col("event_type"), F.lit("?v="), bucket).alias("url"),
    )


FETCH_LOG = """fetch_log as (
  select event_id as seq, 'h' || (user_id % 20) || '.example' as host, event_type, ts,
    'https://h' || (user_id % 20) || '.example/e/' || event_type || '?v=' || cast(floor(value / 10) as bigint) as url,
    cast(floor(value / 10) as bigint) as bucket from events)"""


def site_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed graph of pages: a link's target is a page of the same host, chosen by the link's length (from_id, pos, to_id)."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"), "html")
    rank = F.expr("row_number() over (partition by host order by page_id) - 1")
    numbered = pages.select("page_id", "host", rank.alias("rank"))
    sizes = numbered.groupBy("host").agg(F.count("*").alias("n"))
    links = pages.select("page_id", "host", F.posexplode(F.expr("""regexp_extract_all(html, '<a href="([^"]*)"', 1)""")).alias("pos", "href"))
    aimed = links.join(sizes, "host").select(F.col("page_id").alias("from_id"), "pos", "host", F.expr("length(href) % n").alias("rank"))
    return aimed.join(numbered.select("host", "rank", F.col("page_id").alias("to_id")), ["host", "rank"]).select("from_id", "pos", "to_id")


def site_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of each host."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"))
    return pages.groupBy("host").agg(F.min("page_id").alias("page_id")).select("page_id")


SITE = r"""hosts as (select page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) as host, html from pages),
numbered as (select page_id, host, row_number() over (partition by host order by page_id) - 1 as rk, count(*) over (partition by host) as n from hosts),
raw_links as (select page_id, host, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as href, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) - 1 as pos from hosts),
site_edges as (select r.page_id as from_id, r.pos, t.page_id as to_id
  from raw_links r join (select distinct host, n from numbered) s using (host) join numbered t on t.host = r.host and t.rk = length(r.href) % s.n),
site_seeds as (select min(page_id) as page_id from hosts group by host)"""
