"""The crawl: seeds, claims, fetches, reads, decisions and the next frontier, level by level over DataFrames.

Order is canonical: pages by (priority, seq), links by (page, position). It equals that of one worker taking one page at a time
for breadth-first crawls, whose levels are batches; depth-first and custom priorities are exact with ``batch=1`` and work
in waves of the best ``batch`` otherwise. Each round costs a fixed number of jobs whatever its size; what a round adds is
written once as a part of its table, its other tables go when it ends, and the driver keeps counts only.

With ``concurrency`` above one, so many pages less one are in flight when the page budget is used up: they are finished and
delivered, and what they would queue is skipped as ``max-pages``.
"""

from __future__ import annotations

import math
import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitegraph.functions import columns as U
from sitegraph.functions import kernels as K
from sitegraph.html.kernel import ExtractOptions
from sitegraph.operators import policy
from sitegraph.operators.ranking import ranked, running
from sitegraph.operators.reports import decoded, page_error, top_hosts
from sitegraph.session import Parts, passing, settled
from sitegraph.sources import corpus as net
from sitegraph.url.kernel import DEFAULTS, NormalizeOptions, normalize_entry

SITEMAP_DOCS = 50
TOP_HOSTS = 100
FRONTIER = "url string, host string, depth int, priority double, seq long, referrer string, discovered_via string, status string"


@dataclass(frozen=True)
class Options:
    scope: policy.Scope = policy.Scope()
    normalize: NormalizeOptions = DEFAULTS
    extract: ExtractOptions = ExtractOptions()
    strategy: str = "bfs"
    batch: int = 1000
    concurrency: int = 1
    priority: Callable[[DataFrame], Column] | None = None
    max_depth: int | None = None
    max_pages: int | None = None
    max_duration: float | None = None
    max_total_bytes: int | None = None
    max_queued: int = 100_000
    respect_robots: bool = True
    sitemaps: bool = False
    user_agent: str = "sitegraph"
    robots_max: int = 512_000
    traps: bool = True
    max_segment_repeat: int = 3
    max_path_depth: int = 20
    max_query_params: int = 32
    max_urls_per_path: int = 200
    soft_dup_threshold: int = 10
    follow_canonical: bool = False
    recrawl: bool = False
    should_visit: Callable[[Column], Column] | None = None
    on_page: Callable[[DataFrame], Column] | None = None
    before_extract: Callable[[Column], Column] | None = None
    on_link: Callable[[DataFrame], None] | None = None
    events: dict[str, Callable] = field(default_factory=dict)
    progress_interval: float = 0.5

    def __post_init__(self) -> None:
        for name in ("max_pages", "max_total_bytes", "max_duration", "max_queued", "batch", "max_urls_per_path", "soft_dup_threshold", "concurrency"):
            value = getattr(self, name)
            if value is not None and value <= 0:
                raise TypeError(f"{name} must be above zero")
        if self.max_depth is not None and self.max_depth < 0:
            raise TypeError("max_depth can't be negative")
        for name in ("max_pages", "max_depth", "max_queued", "batch", "concurrency"):
            if isinstance(getattr(self, name), float):
                raise TypeError(f"{name} must be a whole number")
        if self.strategy not in ("bfs", "dfs", "priority"):
            raise TypeError("strategy is bfs, dfs or priority")


@dataclass
class Report:
    pages: DataFrame
    links: DataFrame
    frontier: DataFrame
    stopped_by: str
    counts: dict = field(default_factory=dict)


class Stats:
    """Running counts of a crawl, kept on the driver: one entry for each status and skip reason. ``base`` holds those of
    earlier attempts, which are added to all but the rates."""

    def __init__(self, max_pages: int | None = None, base: dict | None = None, now: Callable[[], float] = time.time) -> None:
        base = base or {}
        self.done, self.failed, self.skipped, self.bytes = (base.get(k, 0) for k in ("done", "failed", "skipped", "bytes"))
        self.by_status = Counter({int(k): v for k, v in base.get("by_status", {}).items()})
        self.skipped_by_reason = Counter(base.get("skipped_by_reason", {}))
        self.max_pages, self.now, self.started_at, self.before = max_pages, now, now(), self.done + self.failed

    def add_pages(self, pages: DataFrame) -> int:
        before = self.done + self.failed
        for r in pages.groupBy("status", "ok").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect():
            self.done, self.failed = self.done + r["n"] * r["ok"], self.failed + r["n"] * (not r["ok"])
            self.bytes += r["bytes"] or 0
            if r["status"]:
                self.by_status[r["status"]] += r["n"]
        return self.done + self.failed - before

    def add_links(self, links: DataFrame) -> int:
        """Counts skips by reason; gives the number of links that are followed."""
        followed = 0
        for r in links.groupBy("skip_reason").agg(F.count("*").alias("n")).collect():
            if r["skip_reason"] is None:
                followed = r["n"]
            else:
                self.skip(r["skip_reason"], r["n"])
        return followed

    def skip(self, reason: str, n: int, size: int = 0) -> None:
        """Skips without an edge count too, and the bytes of pages that turned out to be others'."""
        if n:
            self.skipped += n
            self.skipped_by_reason[reason] += n
            self.bytes += size

    def snapshot(self, queued: int = 0, in_flight: int = 0, by_host: dict | None = None) -> dict:
        elapsed = max(0.0, self.now() - self.started_at)
        completed = self.done + self.failed
        rate = (completed - self.before) / elapsed if elapsed > 0 else 0.0
        out = {
            "queued": queued, "in_flight": in_flight, "done": self.done, "failed": self.failed, "skipped": self.skipped, "bytes": self.bytes,
            "started_at": self.started_at, "elapsed_ms": int(elapsed * 1000), "pages_per_second": rate,
            "by_status": dict(sorted(self.by_status.items())), "skipped_by_reason": dict(sorted(self.skipped_by_reason.items())),
        }
        if by_host:
            out["by_host"] = by_host
        if self.max_pages is not None and rate > 0 and completed < self.max_pages:
            out["eta_ms"] = int((self.max_pages - completed) / rate * 1000)
        return out


class State:
    """What a crawl carries from round to round (and a stopped one resumes from): tables that grow by parts, and counts."""

    TABLES = {
        "queued": FRONTIER, "finished": "url string", "fetched": "url string", "pages": None, "links": None,
        "paths": "host string, path string, search string", "hashes": "content_hash string, n long",
    }

    def __init__(self, spark: SparkSession, seq: int = 0, link_seq: int = 0, done: int = 0, **tables: DataFrame | None) -> None:
        self.seq, self.link_seq, self.done = seq, link_seq, done
        for name, schema in self.TABLES.items():
            setattr(self, name, Parts(spark, tables.get(name), schema))
        self.waiting = self.pending().count()

    @property
    def frontier(self) -> DataFrame:
        """Every url that was queued, with its status."""
        over = self.finished.read().distinct().withColumn("__over", F.lit(True))
        status = F.when(F.col("__over"), "done").otherwise(F.col("status"))
        return self.queued.read().join(over, "url", "left").withColumn("status", status).drop("__over")

    def pending(self) -> DataFrame:
        return self.queued.read().join(self.finished.read(), "url", "left_anti")

    def seen_hashes(self) -> DataFrame:
        return self.hashes.read().groupBy("content_hash").agg(F.sum("n").alias("n"))


class SiteWalk:
    def __init__(self, spark: SparkSession, corpus: DataFrame, options: Options = Options(), archive: DataFrame | None = None, on_progress: Callable[[dict], None] | None = None) -> None:
        self.spark, self.corpus, self.o, self.archive, self.on_progress = spark, corpus, options, archive, on_progress
        self.rules: DataFrame | None = None
        self.known_origins: DataFrame | None = None
        self._stop = self._abort = False
        self.depth = net.chain_depth(corpus)
        self.stats = Stats(options.max_pages)
        self._told = -math.inf  # never yet: the clock may have any start

    def abort(self) -> None:
        """Ends the crawl before its next round; outranks ``stop``."""
        self._abort = True

    def _emit(self, name: str, *values) -> None:
        """An observer never changes the outcome."""
        call = getattr(self.o, name, None) or self.o.events.get(name)
        if call is not None:
            try:
                call(*values)
            except Exception:  # noqa: BLE001
                pass

    def _progress(self, s: State, last: bool = False) -> None:
        """Tells the counts, at most once an interval, and at the end."""
        now = time.monotonic()
        if last or now - self._told >= self.o.progress_interval:
            self._told = now
            shot = self.stats.snapshot(s.waiting)
            self._emit("on_progress", shot)
            if self.on_progress is not None:
                try:
                    self.on_progress(shot)
                except Exception:  # noqa: BLE001
                    pass

    def stop(self) -> None:
        """The running crawl ends after its round; what is pending stays pending."""
        self._stop = True

    # --- sources

    def _priority(self, depth: Column) -> Column:
        return (-depth if self.o.strategy == "dfs" else depth).cast("double")

    def start(self, seeds: list[str] | str | DataFrame, manual: list[tuple[str, int]] = ()) -> State:
        """Seeds (bare hosts get https) and urls added by hand, as the first frontier. Seeds may be a table (url), taken in the
        order of their normal forms; then no seed hosts bound the scope, the page's own host does."""
        if isinstance(seeds, DataFrame):
            rows = seeds.select(K.normalize_entry(F.col("url"), self.o.normalize).alias("url")).where("url is not null").distinct()
            rows = ranked(rows, ["url"], "seq")
            frontier = rows.select("url", U.host_port("url").alias("host"), F.lit(0).alias("depth"), F.lit(0.0).alias("priority"), "seq", F.lit(None).cast("string").alias("referrer"), F.lit("seed").alias("discovered_via"), F.lit("pending").alias("status"))
            count = frontier.count()
        else:
            seeds = [seeds] if isinstance(seeds, str) else list(seeds)
            given = dict.fromkeys(filter(None, (normalize_entry(s, self.o.normalize) for s in seeds)))
            hosts = tuple(dict.fromkeys(r[0] for r in self.spark.createDataFrame([(u,) for u in given], "u string").select(U.host("u")).collect()))
            if self.o.scope.seed_hosts == () and hosts:
                self.o = replace(self.o, scope=replace(self.o.scope, seed_hosts=hosts))
            rows = [(u, None, 0, 0.0, i, None, "seed", "pending") for i, u in enumerate(given)]
            frontier, count = self.spark.createDataFrame(rows, FRONTIER).withColumn("host", U.host_port("url")), len(rows)
        reason, _ = policy.verdict(policy.Scope(exclude=self.o.scope.exclude, exclude_patterns=self.o.scope.exclude_patterns, allow_private_hosts=self.o.scope.allow_private_hosts, allow_external=True, max_url_length=self.o.scope.max_url_length), "url", "kind")
        names = frontier.columns
        judged = settled(frontier.withColumns({"kind": F.lit("internal"), "nofollow": F.lit(False), "region": F.lit(None).cast("string"), "rel": F.lit("page")}).withColumn("r", reason))
        for r in judged.where("r is not null").groupBy("r").agg(F.count("*").alias("n")).collect():
            self.stats.skip(r["r"], r["n"])
        frontier = judged.where("r is null").select(names)
        self._learn_robots(frontier.select("url"))
        if self.o.respect_robots:
            asked = settled(policy.robots_allowed(frontier, self.rules, self.o.user_agent))
            self.stats.skip("robots-disallow", asked.where("not allowed").count())
            frontier = asked.where("allowed").select(names)
        seq = count
        extra = []
        if self.o.sitemaps and self.o.respect_robots:
            extra.append(self._from_sitemaps(frontier).withColumns({"depth": F.lit(0), "discovered_via": F.lit("sitemap")}))
        if manual:
            added = self.spark.createDataFrame([(u, i, d) for i, (u, d) in enumerate(manual)], "text string, pos long, depth int")
            added = added.select(K.normalize_entry(F.col("text"), self.o.normalize).alias("url"), "pos", "depth").where("url is not null")
            extra.append(added.withColumn("discovered_via", F.lit("manual")))
        for rows_ in extra:
            new = self._enter(rows_, frontier, seq)
            seq += new.count()
            frontier = settled(frontier.unionByName(new))
        return State(self.spark, seq=seq, queued=frontier.select([x.split()[0] for x in FRONTIER.split(", ")]))

    def _enter(self, rows: DataFrame, frontier: DataFrame, seq: int) -> DataFrame:
        """Manual and sitemap urls: the full scope check but no regions, traps or depth."""
        links = rows.select(F.col("url").alias("to_url"), "pos", "depth", "discovered_via").withColumns({"kind": F.lit("internal"), "nofollow": F.lit(False), "region": F.lit(None).cast("string"), "rel": F.lit("sitemap"), "from_url": F.lit("")})
        passed = policy.decide(links, self.o.scope, True).where("skip_reason is null").withColumnRenamed("to_url", "url")
        self._learn_robots(passed.select("url"))
        if self.o.respect_robots:
            passed = policy.robots_allowed(passed, self.rules, self.o.user_agent).where("allowed")
        first = passed.groupBy("url").agg(F.min_by(F.struct("pos", "depth", "discovered_via"), "pos").alias("f")).join(frontier.select("url"), "url", "left_anti")
        new = ranked(first.select("url", "f.*"), ["pos", "url"], "seq", seq)
        return new.select("url", U.host_port("url").alias("host"), "depth", self._priority(F.col("depth")).alias("priority"), "seq", F.lit(None).cast("string").alias("referrer"), "discovered_via", F.lit("pending").alias("status"))

    def _from_sitemaps(self, frontier: DataFrame) -> DataFrame:
        """(url, pos): the pages that seed origins' sitemaps name; an index is followed one level, at most 50 documents an origin."""
        texts = self.robots_texts.join(frontier.select(U.origin("url").alias("origin")).distinct(), "origin")
        docs = texts.select("origin", F.posexplode(K.robots_sitemaps(F.col("text"))).alias("pos", "doc"))

        def same_origin(rows: DataFrame) -> DataFrame:
            named = rows.withColumn("doc", K.normalize_url(F.col("doc"))).where(U.origin("doc") == F.col("origin"))
            first = named.groupBy("origin", "doc").agg(F.min("pos").alias("pos"))
            return first.withColumn("n", F.row_number().over(Window.partitionBy("origin").orderBy("pos"))).where(F.col("n") <= SITEMAP_DOCS).drop("n")

        def load(rows: DataFrame) -> DataFrame:
            got = net.fetch(rows.withColumnRenamed("doc", "url"), self.corpus, depth=self.depth).where("ok")
            # A corpus may hold bytes beside text (column raw): a packed sitemap is known by its first bytes.
            body = F.coalesce(F.decode(K.gunzip(F.col("raw")), "UTF-8"), "body") if "raw" in got.columns else F.col("body")
            return got.select("origin", "pos", K.sitemap(body).alias("s"))

        top = settled(load(same_origin(docs)))
        # Places are bounded by the parser's own limit of 50,000 entries a document.
        nested = top.where("s.kind = 'sitemapindex'").select("origin", F.col("pos").cast("long").alias("pos"), F.posexplode("s.entries").alias("p", "e"))
        nested = nested.select("origin", F.col("e.url").alias("doc"), (F.col("pos") * 100_000 + F.col("p") + 1).alias("pos"))
        below = load(same_origin(nested)).where("s.kind = 'urlset'")
        entries = top.where("s.kind = 'urlset'").unionByName(below).select("pos", F.posexplode("s.entries").alias("p", "e"))
        return entries.select(K.normalize_url(F.col("e.url"), o=self.o.normalize).alias("url"), (F.col("pos").cast("long") * 100_000 + F.col("p")).alias("pos")).where("url is not null")

    def _learn_robots(self, urls: DataFrame) -> None:
        """The rules of origins not met before, one request for each."""
        if not self.o.respect_robots:
            return
        new = urls.select(U.origin("url").alias("origin")).where("origin <> ''").distinct()
        if self.known_origins is not None:
            new = new.join(self.known_origins, "origin", "left_anti")
        new = settled(new, stays=True)
        if self.rules is not None and new.isEmpty():
            return
        got = net.fetch(new.withColumn("url", F.concat("origin", F.lit("/robots.txt"))), self.corpus, depth=self.depth)
        policies = settled(policy.robots_policy(got, self.o.robots_max), stays=True)
        rules = settled(policy.robots_table(policies), stays=True)
        texts = policies.select("origin", "text")
        first = self.rules is None
        self.rules = rules if first else self.rules.unionByName(rules)
        self.robots_texts = texts if first else self.robots_texts.unionByName(texts)
        self.known_origins = new if first else self.known_origins.unionByName(new)

    # --- one round

    def _claim(self, s: State) -> DataFrame:
        pending = s.pending()
        budget = None if self.o.max_pages is None else self.o.max_pages + self.o.concurrency - 1 - s.done
        if self.o.strategy == "bfs":
            level = pending.agg(F.min("depth")).head()[0]
            pending = pending.where(F.col("depth") == F.lit(level))
            left = budget
        else:
            left = self.o.batch if budget is None else min(self.o.batch, budget)
        if left is not None:
            pending = pending.orderBy("priority", "seq").limit(left)
        return ranked(pending, ["priority", "seq"], "ord")

    def _converge(self, claimed: DataFrame, s: State) -> DataFrame:
        """Adds ``dup``: another page took this one's url, final url or one of its hops before."""
        if self.o.recrawl:
            return claimed.withColumn("dup", F.lit(False))
        return policy.converged(claimed, s.fetched.read())

    def _round(self, s: State) -> tuple[DataFrame, DataFrame]:
        o = self.o
        claimed = self._claim(s).drop("status")
        conditional = None if self.archive is None else self._conditional()
        claimed = net.follow_redirects(claimed, self.corpus, depth=self.depth)
        claimed = claimed.withColumns({"final_key": F.coalesce(K.normalize_url(F.col("final_url"), o=o.normalize), "url"), "hops": F.transform("redirects", lambda u: u)})
        claimed = settled(self._converge(claimed, s))  # who came first shows in the urls alone
        got = net.fetch(claimed, self.corpus, conditional, self.depth)
        if conditional is not None:
            stored = self.archive.select("url", decoded(F.col("body"), F.col("charset")).alias("stored"), F.col("content_hash").alias("stored_hash"))
            got = got.join(stored, "url", "left")
            got = got.withColumns({"text": F.when(F.col("not_modified"), F.col("stored")).otherwise(F.col("body")), "kept_hash": F.when(F.col("not_modified"), F.col("stored_hash"))})
        else:
            got = got.withColumns({"text": F.col("body"), "kept_hash": F.lit(None).cast("string")})
        html = ~F.col("dup") & F.col("ok") & F.col("content_type").contains("html")
        if o.scope.check_external and not o.scope.allow_external and o.scope.seed_hosts:
            # Pages of other sites are only asked for, not read.
            html = html & policy.any_of([U.same_site(F.lit(x), U.host("url"), o.scope.subdomains, o.scope.registrable) for x in o.scope.seed_hosts])
        got = got.withColumns(
            {
                "size": F.octet_length("body").cast("long"),
                "content_hash": F.coalesce("kept_hash", F.when(F.col("body").isNotNull() & F.col("ok"), F.sha2("body", 256))),
                "read": F.when(html, K.read_page(F.when(html, F.col("text")), F.col("final_url"), o.extract)),
                "header": K.x_robots_tag(F.col("x_robots_tag"), o.user_agent) if "x_robots_tag" in got.columns else F.lit(None),
            }
        )
        if o.before_extract is None and o.on_page is None and not o.events:
            got = got.drop("text", "stored", "stored_hash", "kept_hash")  # nobody is left to ask for them; most are bodies again
        # Bodies are fetched, read and written in one go.
        got = settled(got)
        fresh = got.where("not dup")
        if o.before_extract is not None:
            # Links of the head come from the whole page, those of the body from what is left of it; the page's own base counts for both.
            head = replace(o.extract, anchors=False, iframes=False, assets=False, srcset=False)
            body = replace(o.extract, canonical=False, next_prev=False, meta_refresh=False, alternate=False)
            narrowed = F.coalesce(o.before_extract(F.col("text")), "text")
            both = F.concat(K.extract_links(F.col("text"), F.col("read.base"), head), K.extract_links(narrowed, F.col("read.base"), body))
            fresh = fresh.withColumn("read", F.col("read").withField("links", F.when(F.col("read").isNotNull(), both)))
        if o.traps:
            fresh = policy.soft_duplicates(fresh, "ord", o.soft_dup_threshold, s.seen_hashes())
        else:
            fresh = fresh.withColumn("soft_dup", F.lit(False))
        nofollow = F.coalesce(F.col("read.nofollow"), F.lit(False)) | F.coalesce(F.col("header.nofollow"), F.lit(False))
        noindex = F.coalesce(F.col("read.noindex"), F.lit(False)) | F.coalesce(F.col("header.noindex"), F.lit(False))
        fresh = fresh.withColumns({"page_nofollow": nofollow, "noindex": noindex})
        if o.traps or o.before_extract is not None:
            fresh = settled(fresh)
        if o.max_total_bytes is not None:
            # Budgets cut between pages: the running sum is over the round's (ord, size) pairs alone.
            inside = running(fresh.select("ord", "size"), ["ord"], F.coalesce("size", F.lit(0)), "before", self.stats.bytes)
            fresh = settled(fresh.join(inside.where(F.col("before") < o.max_total_bytes).select("ord"), "ord"))
        return got, fresh

    def _conditional(self) -> DataFrame:
        a = self.archive.where("body is not null and (etag is not null or last_modified is not null)")
        return a.select("url", F.col("etag").alias("if_none_match"), F.col("last_modified").alias("if_modified_since"))

    def _edges(self, fresh: DataFrame, s: State) -> DataFrame:
        """Every link of the round's pages with its decision so far (skip_reason or null), in canonical order."""
        o = self.o
        links = fresh.select("url", "final_url", "ord", "depth", "soft_dup", "page_nofollow", F.posexplode("read.links").alias("pos", "l"))
        links = links.select(
            F.col("url").alias("from_url"), "final_url", "ord", "depth", "soft_dup", "pos", K.normalize_url(F.coalesce("l.url", "l.href"), o=o.normalize).alias("to"), F.coalesce("l.url", "l.href").alias("raw"),
            F.col("l.href").alias("raw_href"), F.col("l.rel").alias("rel"), (F.col("l.nofollow") | F.col("page_nofollow")).alias("nofollow"), F.col("l.region").alias("region"), F.col("l.anchor_text").alias("anchor_text"),
        )
        kind = F.when(F.col("to").isNull(), "external").otherwise(U.classify(U.host("final_url"), U.host("to"), o.scope.subdomains, o.scope.registrable))
        links = links.withColumns({"to_url": F.coalesce("to", "raw"), "kind": kind})
        reason, check = policy.verdict(o.scope)
        reason = F.when(F.col("to").isNull(), "bad-scheme").otherwise(reason)
        if not o.follow_canonical:
            reason = F.coalesce(reason, F.when(F.col("rel") == "canonical", F.lit("excluded")))
        links = links.withColumns({"skip_reason": reason, "check_only": check})
        if o.respect_robots:
            links = settled(links)
            self._learn_robots(links.where("skip_reason is null").select(F.col("to_url").alias("url")))
            links = policy.robots_allowed(links, self.rules, o.user_agent, "to_url")
            links = links.withColumn("skip_reason", F.coalesce("skip_reason", F.when(~F.col("allowed"), "robots-disallow"))).drop("allowed", "origin")
        if o.max_depth is not None:
            links = links.withColumn("skip_reason", F.coalesce("skip_reason", F.when(F.col("depth") + 1 > o.max_depth, "max-depth")))
        return links

    def _trap(self, links: DataFrame, s: State) -> DataFrame:
        o = self.o
        shaped = F.col("soft_dup") | U.url_trap("to_url", o.max_path_depth, o.max_segment_repeat, o.max_query_params)
        links = settled(links.withColumn("skip_reason", F.coalesce("skip_reason", F.when(shaped, "trap"))).withColumn("order", F.struct("ord", "pos")))
        live = links.where("skip_reason is null and to_url like '%?%'")
        over = policy.urls_per_path(live, "order", o.max_urls_per_path, s.paths.read(), "to_url").select("order", "admitted")
        counted = live.join(over.where("admitted"), "order").select(U.host_port("to_url").alias("host"), U.path("to_url").alias("path"), U.search("to_url").alias("search"))
        s.paths.add(counted.distinct())
        return links.join(over, "order", "left").withColumn("skip_reason", F.coalesce("skip_reason", F.when(~F.coalesce("admitted", F.lit(True)), "trap"))).drop("admitted")

    def _admit(self, links: DataFrame, fresh: DataFrame, s: State) -> DataFrame:
        """A link to a page that is done is a duplicate; then the user's word counts, then the budgets of pages and queue; the
        first link to a url that isn't queued is followed, all others to it are duplicates."""
        o = self.o
        if "order" not in links.columns:
            links = links.withColumn("order", F.struct("ord", "pos"))
        links = settled(links)
        over = links.where("skip_reason is not null").withColumn("followed", F.lit(False))  # these are decided, and meet no table
        links = links.where("skip_reason is null")
        if not o.recrawl:
            now = fresh.select("ord", F.explode(F.array_distinct(F.concat(F.array("url", "final_key"), "hops"))).alias("to_url"))
            now = now.groupBy("to_url").agg(F.min("ord").alias("__done"))
            before = s.fetched.read().select(F.col("url").alias("to_url")).distinct().withColumn("__old", F.lit(True))
            links = links.join(now, "to_url", "left").join(before, "to_url", "left")
            visited = F.col("__old").isNotNull() | F.coalesce(F.col("__done") < F.col("ord"), F.lit(False))
            links = links.withColumn("skip_reason", F.coalesce("skip_reason", F.when(visited, "duplicate"))).drop("__done", "__old")
        if o.should_visit is not None:
            links = links.withColumn("skip_reason", F.coalesce("skip_reason", F.when(~o.should_visit(F.col("to_url")), "user")))
        if o.max_pages is not None:
            links = links.withColumn("skip_reason", F.coalesce("skip_reason", F.when(F.col("ord") + s.done >= o.max_pages, "max-pages")))
        links = settled(links)
        firsts = links.where("skip_reason is null").groupBy("to_url").agg(F.min("order").alias("first"))
        firsts = firsts.join(s.queued.read().select(F.col("url").alias("to_url")), "to_url", "left_anti")
        links = links.join(firsts, "to_url", "left")
        new = F.col("skip_reason").isNull() & F.coalesce(F.col("first") == F.col("order"), F.lit(False))
        out = links.withColumn("followed", new).withColumn("skip_reason", F.coalesce("skip_reason", F.when(~new, "duplicate"))).drop("first").unionByName(over)
        end: list[int] = []
        out = ranked(out, ["order"], "link_seq", s.link_seq, end)
        most = end[0] - s.link_seq
        s.link_seq = end[0]
        # Only where all links of the round might not find room are they counted by page.
        return self._refuse(settled(out), s) if s.waiting + most > o.max_queued else out

    def _refuse(self, links: DataFrame, s: State) -> DataFrame:
        """Links that find the queue full are refused, not forgotten: each page taken from the queue makes room for one more.
        The driver sees a count for each page of the round, which are no more than the queue holds."""
        room, pushed, allowed = self.o.max_queued - s.waiting, 0, []
        for r in links.where("followed").groupBy("ord").agg(F.count("*").alias("n")).orderBy("ord").collect():
            take = max(0, min(r["n"], room + r["ord"] + 1 - pushed))
            pushed += take
            if take < r["n"]:
                allowed.append((r["ord"], take))
        if not allowed:
            return links
        tight = self.spark.createDataFrame(allowed, "ord long, __take int")
        place = F.row_number().over(Window.partitionBy("ord", "followed").orderBy("link_seq"))
        links = links.join(F.broadcast(tight), "ord", "left").withColumn("__place", place)
        full = F.col("followed") & F.coalesce(F.col("__place") > F.col("__take"), F.lit(False))
        return links.withColumns({"skip_reason": F.when(full, "queue-full").otherwise(F.col("skip_reason")), "followed": F.col("followed") & ~full}).drop("__place", "__take")

    def _ended(self, s: State, began: float) -> str | None:
        """Why the crawl ends before another round, if it does."""
        o = self.o
        if self._abort:
            return "abort"
        if self._stop:
            return "stop"
        if o.max_pages is not None and s.done >= o.max_pages:
            return "max-pages"
        if o.max_total_bytes is not None and self.stats.bytes >= o.max_total_bytes:
            return "max-bytes"
        if o.max_duration is not None and time.monotonic() - began >= o.max_duration:
            return "max-duration"
        return None if s.waiting > 0 else "completed"

    def rounds(self, s: State) -> Iterator[tuple[str | None, DataFrame | None]]:
        """Runs the crawl, giving each round's pages as they are done, and at the end (why it stopped, None)."""
        began = time.monotonic()
        self._stop = False
        self._emit("on_start")
        while (why := self._ended(s, began)) is None:
            with passing(self.spark):
                pages = self._step(s)
            yield None, pages
        self._progress(s, last=True)
        self._emit("on_end", why, self.stats.snapshot())
        yield why, None

    def _step(self, s: State) -> DataFrame:
        """One round; what it adds is in the parts of the state."""
        o = self.o
        got, fresh = self._round(s)
        self._emit("on_page_start", fresh)
        links = self._edges(fresh, s)
        links = self._admit(self._trap(links, s) if o.traps else links, fresh, s)
        edges = s.links.add(links.select("link_seq", "from_url", "to_url", "raw_href", "kind", "rel", "nofollow", "region", "anchor_text", "followed", "skip_reason", "depth"))
        followed = self.stats.add_links(edges)
        # The first canonical link that isn't a bad scheme, read off the page itself: a join with the edges would move every body.
        named = F.transform(F.filter("read.links", lambda x: x["rel"] == "canonical"), lambda x: F.coalesce(x["url"], x["href"]))
        sound = F.filter(K.normalize_urls(named, o.normalize), lambda u: U.scheme(u).isin("http", "https") & (U.host(u) != ""))
        data = F.lit(None).cast("string") if o.on_page is None else o.on_page(fresh)
        pages = fresh.withColumns({"data": data, "canonical": F.try_element_at(sound, F.lit(1))}).select(
            "url", "final_url", "redirects", "status", "ok", "not_modified", "content_type", "charset", "depth", "referrer", "discovered_via", "size", "content_hash", F.col("read.title").alias("title"),
            "canonical", "noindex", F.col("page_nofollow").alias("nofollow"), "etag", "last_modified", "error_kind", "error_message",
            page_error("error_kind", "error_message", "status").alias("error"), "data", F.lit(None).cast("string").alias("skip_reason"), (F.col("ord") + s.done).alias("page_seq"),
            F.when(F.col("ok"), F.col("body")).alias("body"),
        )
        pages = s.pages.add(pages)
        new = edges.where("followed").select(
            F.col("to_url").alias("url"), U.host_port("to_url").alias("host"), (F.col("depth") + 1).alias("depth"), self._priority(F.col("depth") + 1).alias("priority"), (F.col("link_seq") + s.seq).alias("seq"),
            F.col("from_url").alias("referrer"), F.lit("link").alias("discovered_via"), F.lit("pending").alias("status"),
        )
        if o.priority is not None:
            wanted = o.priority(new).cast("double")
            new = new.withColumn("priority", F.when(wanted.isNull() | F.isnan(wanted), F.col("depth").cast("double")).otherwise(wanted))
        s.queued.add(new)
        s.finished.add(got.where("dup").select("url").union(fresh.select("url")))
        s.fetched.add(fresh.select(F.explode(F.array_distinct(F.concat(F.array("url", "final_key"), "hops"))).alias("url")).distinct())
        if o.traps:
            s.hashes.add(fresh.where("content_hash is not null").groupBy("content_hash").agg(F.count("*").alias("n")))
        many = self.stats.add_pages(pages)
        s.done += many
        twice = got.where("dup").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).alias("bytes")).head()
        self.stats.skip("duplicate", twice["n"], twice["bytes"])
        s.waiting += followed - many - twice["n"]
        self._emit("on_page_done", pages)
        self._emit("on_page_error", pages.where("error is not null"))
        self._emit("on_link", edges)
        self._emit("on_link_skipped", edges.where("skip_reason is not null"))
        self._progress(s)
        return pages

    def run(self, seeds: list[str] | str | DataFrame = (), state: State | None = None, manual: list[tuple[str, int]] = ()) -> Report:
        s = state or self.start(seeds, manual)
        why = "completed"
        for why, _ in self.rounds(s):
            pass
        self.state = s
        empty = self.spark.createDataFrame([], "url string, status int, ok boolean, page_seq long")
        none = self.spark.createDataFrame([], "link_seq long, from_url string, to_url string, kind string, rel string, followed boolean, skip_reason string")
        pages, links = (x.read() if x.count else y for x, y in ((s.pages, empty), (s.links, none)))
        hosts = {} if not s.pages.count else {r["host"]: r["n"] for r in top_hosts(pages, U.host("url"), TOP_HOSTS).collect()}
        counts = self.stats.snapshot(s.waiting, 0, hosts)
        return Report(pages, links, s.frontier, why or "completed", counts)


def crawl(spark: SparkSession, corpus: DataFrame, seeds: list[str] | str, options: Options = Options(), archive: DataFrame | None = None) -> Report:
    return SiteWalk(spark, corpus, options, archive).run(seeds)
