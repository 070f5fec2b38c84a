"""Whether a link is followed, and if not, why: column expressions and joins over link tables. Rejected links are kept."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegraph.functions import columns as U
from sitegraph.functions import kernels as K
from sitegraph.operators.ranking import first_k

#: Endings of files that are no pages.
NO_PAGE = frozenset(
    "7z aac apng avi avif bmp bz2 eot flac flv gif gz heic heif ico jpeg jpg m4a m4v mkv mov mp3 mp4 mpeg mpg oga ogg ogv opus otf png rar "
    "svg svgz tar tgz tif tiff ttf wav webm webp wma wmv woff woff2 xz zip zst".split()
)
PAGE_RELS = tuple("canonical next page prev sitemap".split())


@dataclass(frozen=True)
class Scope:
    subdomains: str = "same-host"
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    include_patterns: tuple[str, ...] = ()
    exclude_patterns: tuple[str, ...] = ()
    path_prefix: tuple[str, ...] = ()
    allow_external: bool = False
    check_external: bool = False
    follow_nofollow: bool = False
    follow_regions: tuple[str, ...] = ()
    max_url_length: int = 2048
    allow_private_hosts: bool = True
    seed_hosts: tuple[str, ...] = ()
    #: Another rule for the registrable domain of a host (null: none), where "same-site" asks for it.
    registrable: Callable[[Column], Column] | None = None


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def _matches(url: Column, words: tuple[str, ...], patterns: tuple[str, ...]) -> Column:
    return any_of([url.contains(w) for w in words if w] + [url.rlike(p) for p in patterns])


def document_has_region(page: str = "from_url") -> Column:
    """Whether any link of the page stands in a landmark; if none does, regions can't be asked for."""
    return F.max(F.col("region").isNotNull()).over(Window.partitionBy(page))


def verdict(o: Scope, url: str = "to_url", kind: str = "kind", has_region: Column | None = None) -> tuple[Column, Column]:
    """(reason or null, check_only) of links with columns url, kind, nofollow, region and rel. The first check that hits counts."""
    u = F.col(url)
    host = U.host(u)
    off_seed = ~any_of([U.same_site(F.lit(s), host, o.subdomains, o.registrable) for s in o.seed_hosts]) if o.seed_hosts else F.lit(False)
    off = (F.col(kind) == "external") | off_seed
    check = off & F.lit(not o.allow_external and o.check_external)
    out = F.when(~U.scheme(u).isin("http", "https") | (host == ""), "bad-scheme").when(U.utf16_length(u) > o.max_url_length, "too-long")
    if not o.allow_private_hosts:
        out = out.when(U.private_host(host), "private-host")
    if not (o.allow_external or o.check_external):
        out = out.when(off, "out-of-scope")
    if o.path_prefix:
        out = out.when(~off & ~any_of([U.path(u).startswith(p) for p in o.path_prefix]), "out-of-scope")
    out = out.when(_matches(u, o.exclude, o.exclude_patterns), "excluded")
    if any(o.include) or o.include_patterns:
        out = out.when(~off & ~_matches(u, o.include, o.include_patterns), "excluded")
    if not o.follow_nofollow:
        out = out.when(F.col("nofollow"), "nofollow")
    if o.follow_regions:
        asked = document_has_region() if has_region is None else has_region
        out = out.when(asked & ~F.coalesce(F.col("region").isin(*o.follow_regions), F.lit(False)), "out-of-region")
    page_like = F.col("rel").isin(*PAGE_RELS)
    out = out.when(~check & page_like & U.extension(U.path(u)).isin(*sorted(NO_PAGE)), "unsupported-type")
    return out, check


def decide(links: DataFrame, o: Scope, follow_canonical: bool = False) -> DataFrame:
    """The links with skip_reason (so far) and check_only; columns as for ``verdict``, plus from_url."""
    reason, check = verdict(o)
    if not follow_canonical:
        reason = F.coalesce(reason, F.when(F.col("rel") == "canonical", F.lit("excluded")))
    return links.withColumns({"skip_reason": reason, "check_only": check})


def urls_per_path(candidates: DataFrame, order: str, cap: int, counted: DataFrame | None = None, url: str = "url") -> DataFrame:
    """Adds ``admitted``: at most ``cap`` distinct queries per host and path, in order of arrival; one seen before passes.

    counted: (host, path, search) of earlier levels.
    """
    key = {"__host": U.host_port(url), "__path": U.path(url), "__search": U.search(url)}
    rows = candidates.withColumns(key)
    first = rows.groupBy(*key).agg(F.min(order).alias("__first"))
    if counted is not None:
        old = counted.select(F.col("host").alias("__host"), F.col("path").alias("__path"), F.col("search").alias("__search")).distinct()
        first = first.join(old.withColumn("__old", F.lit(True)), list(key), "left")
        prior = old.groupBy("__host", "__path").agg(F.count("*").alias("__prior"))
        first = first.join(prior, ["__host", "__path"], "left")
    else:
        first = first.withColumns({"__old": F.lit(None).cast("boolean"), "__prior": F.lit(0).cast("long")})
    new = F.col("__old").isNull()
    # The first so many new queries of a path pass; a path with very many is thinned in shares first.
    early = first_k(first.where(new), ["__host", "__path"], "__first", cap)
    first = first.join(early, ["__host", "__path"], "left")
    left = cap - F.coalesce("__prior", F.lit(0))
    last = F.when(left > 0, F.try_element_at("firsts", F.least(left, F.size("firsts")).cast("int")))
    first = first.withColumn("admitted", ~new | F.coalesce(F.col("__first") <= last, F.lit(False)))
    return rows.join(first.select(*key, "admitted"), list(key)).drop(*key)


def soft_duplicates(pages: DataFrame, order: str, threshold: int = 10, counted: DataFrame | None = None) -> DataFrame:
    """Adds ``soft_dup``: the page's content has been seen more than ``threshold`` times. counted: (content_hash, n) so far.

    Only contents seen so often in all are looked at; of those the first rows decide. Pages without content are none's copy.
    """
    known = pages.where("content_hash is not null")
    many = known.groupBy("content_hash").agg(F.count("*").alias("__n"))
    if counted is None:
        many = many.withColumn("__prior", F.lit(0).cast("long"))
    else:
        many = many.join(counted.select("content_hash", F.col("n").alias("__prior")), "content_hash", "left").withColumn("__prior", F.coalesce("__prior", F.lit(0)))
    many = many.where(F.col("__n") + F.col("__prior") > threshold).drop("__n")
    early = first_k(known.join(many.select("content_hash"), "content_hash", "left_semi"), ["content_hash"], order, threshold)
    left = threshold - F.col("__prior")
    last = F.when(left > 0, F.try_element_at("firsts", F.least(left, F.size("firsts")).cast("int")))
    cut = many.join(early, "content_hash").select("content_hash", last.alias("__last"), F.lit(True).alias("__hot"))
    rows = known.join(cut, "content_hash", "left").withColumn("soft_dup", F.coalesce("__hot", F.lit(False)) & F.coalesce(F.col(order) > F.col("__last"), F.lit(True)))
    rest = pages.where("content_hash is null").withColumn("soft_dup", F.lit(False))
    return rows.select(*pages.columns, "soft_dup").unionByName(rest)


def converged(claimed: DataFrame, fetched: DataFrame) -> DataFrame:
    """Adds ``dup`` to claims (url, ord, final_key, hops): another page took this one's url or final url before it.

    Earlier claims take their url, final url and hops; ``fetched`` (url) holds what earlier rounds took.
    """
    own = F.array_distinct(F.array("url", "final_key"))
    keys = claimed.select("url", "ord", F.explode(own).alias("key"))
    earlier = claimed.select("ord", F.explode(F.array_distinct(F.concat(own, "hops"))).alias("key")).groupBy("key").agg(F.min("ord").alias("first"))
    old = fetched.select(F.col("url").alias("key"), F.lit(True).alias("old")).distinct()
    hits = keys.join(earlier, "key").join(old, "key", "left").groupBy("url").agg(F.max(F.col("old").isNotNull() | (F.col("first") < F.col("ord"))).alias("dup"))
    return claimed.join(hits, "url")


def robots_policy(fetched: DataFrame, most: int = 512_000) -> DataFrame:
    """(origin, policy, text) from fetched robots.txt rows (origin, status, content_type, body): a server error forbids all,
    a missing, empty, HTML or failed answer allows all, otherwise the text rules."""
    text = F.col("body")
    html = F.lower(F.coalesce("content_type", F.lit(""))).contains("html")
    policy = F.when(F.col("status") >= 500, "disallow-all").when(F.col("status").isNull() | (F.col("status") >= 400) | text.isNull() | (text == "") | html, "allow-all").otherwise("rules")
    return fetched.select("origin", policy.alias("policy"), F.when(policy == "rules", F.substring(text, 1, most)).alias("text"))


def robots_table(policies: DataFrame) -> DataFrame:
    """(origin, group_no, agent, rule_no, allow, pattern, crawl_delay) of policies."""
    parsed = policies.where("policy = 'rules'").select("origin", F.inline(K.robots_rules(F.col("text"))))
    shut = policies.where("policy = 'disallow-all'").selectExpr("origin", "0 as group_no", "'*' as agent", "0 as rule_no", "false as allow", "'/' as pattern", "cast(null as double) as crawl_delay")
    return parsed.unionByName(shut)


def agent_groups(rules: DataFrame, agent: str) -> DataFrame:
    """The rules that hold for our agent: the groups of the longest name it contains, else those for everybody."""
    fits = F.when(F.col("agent") == "*", 0).when(F.lit(agent.lower()).contains(F.col("agent")), F.length("agent"))
    ranked = rules.withColumn("__fit", fits).where("__fit is not null")
    return ranked.withColumn("__best", F.max("__fit").over(Window.partitionBy("origin"))).where("__fit = __best").drop("__fit", "__best").dropDuplicates(["origin", "group_no", "rule_no"])


def robots_allowed(urls: DataFrame, rules: DataFrame, agent: str, url: str = "url") -> DataFrame:
    """Adds ``allowed``: of the patterns that match, the longest counts, an allowing one on a tie; without any, yes.

    An origin's rules are one array, and each distinct URL is decided in one call; URLs of origins without rules never meet it.
    """
    own = agent_groups(rules, agent).where("pattern is not null")
    own = own.groupBy("origin").agg(F.collect_list(F.struct("pattern", "allow")).alias("__rules"))
    asked = urls.select(F.col(url).alias("__url")).distinct().withColumns({"origin": U.origin("__url"), "__target": F.concat(U.path("__url"), U.search("__url"))})
    told = asked.join(own, "origin").select("__url", K.robots_verdict(F.col("__rules"), F.col("__target")).alias("__allow"))
    return urls.join(told, urls[url] == told["__url"], "left").withColumn("allowed", F.coalesce("__allow", F.lit(True))).drop("__url", "__allow")


def crawl_delays(rules: DataFrame, agent: str, cap_ms: int = 30_000) -> DataFrame:
    """(origin, delay_ms) for our agent."""
    seconds = agent_groups(rules, agent).groupBy("origin").agg(F.max("crawl_delay").alias("s"))
    return seconds.where("s is not null").select("origin", F.least(F.col("s") * 1000, F.lit(float(cap_ms))).alias("delay_ms"))
