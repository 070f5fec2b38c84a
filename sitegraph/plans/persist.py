"""A crawl in the store: archive, runs, pages, links and frontier, and what is asked of them by a run's uid.

``save`` writes a finished (or broken off) crawl in one commit: the archive is merged with the run's responses, then the visits
replace validators; pages replace those of the same run and url, links all those of the pages written.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.operators import archive as A
from sitegraph.operators import reports
from sitegraph.operators.ranking import shared

CRAWL = (
    "crawl_id long, uid string, job_uid string, seeds string, options string, status string, stopped_by string, stats string, error string, attempt int, "
    "created_at timestamp, started_at timestamp, ended_at timestamp"
)
PAGE = (
    "crawl_id long, page_seq long, url string, final_url string, depth int, discovered_via string, referrer string, status int, ok boolean, not_modified boolean, "
    "content_type string, content_hash string, title string, size long, error_kind string, error_message string, skip_reason string, data string, fetched_at timestamp"
)
LINK = (
    "crawl_id long, link_seq long, from_url string, to_url string, raw_href string, kind string, rel string, nofollow boolean, anchor_text string, followed boolean, skip_reason string"
)
FRONTIER = "crawl_id long, url string, host string, depth int, priority double, seq long, referrer string, discovered_via string, status string"


def names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def json_data(value: Column, kind: str) -> Column:
    """What a page hook gave, as text: strings as they are, all else as JSON."""
    return value if kind == "string" else F.to_json(F.struct(value.alias("v")))


def responses(pages: DataFrame, at: Column, persist_body: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """Rows for the archive from a run's pages: only where there was a response; bodies of sound pages, if wanted."""
    kept = F.col("ok") & F.col("body").isNotNull() & ~F.col("not_modified")
    if persist_body is not None:
        kept = kept & F.coalesce(persist_body(pages), F.lit(False))
    body = F.when(kept, F.encode("body", "UTF-8"))
    return pages.where("status is not null").select(
        "url", body.alias("body"), "content_type", F.when(kept, F.coalesce("charset", F.lit("utf-8"))).otherwise(F.col("charset")).alias("charset"), "etag", "last_modified", "content_hash",
        F.col("status").alias("last_status"), F.col("size").cast("long").alias("size"), at.cast("timestamp").alias("fetched_at"),
    )


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """The archive after a run: responses merged in, then visits; an unchanged answer repeats no validators, so it keeps them.
    That is ``upsert_archive`` and ``visited`` in one join, which moves each body once."""
    if not old.isEmpty():  # else nothing is joined
        old, new = shared("url", old, new)
    both = old.alias("o").join(new.withColumn("hit", F.lit(True)).alias("n"), "url", "full_outer")
    hit, same = F.col("n.hit"), F.col("n.last_status") == 304

    def column(c: str) -> Column:
        own, kept = F.col(f"n.{c}"), F.coalesce(f"n.{c}", f"o.{c}")
        if c == "url":
            return F.col("url")
        if c in ("body", "content_type", "charset", "size"):
            return kept.alias(c)
        if c in ("etag", "last_modified", "content_hash"):
            own = F.when(same, kept).otherwise(own)
        return F.when(hit, own).otherwise(F.col(f"o.{c}")).alias(c)

    return both.select(*[column(c) for c in old.columns])


class Site:
    """The tables of a store, read and written as one model."""

    def __init__(self, spark: SparkSession, store: A.Store) -> None:
        self.spark, self.store = spark, store

    def table(self, name: str) -> DataFrame:
        return self.store.read(name, {"crawl": CRAWL, "page": PAGE, "link": LINK, "frontier": FRONTIER, "archive": A.ARCHIVE}[name])

    def _row(self, row: dict) -> DataFrame:
        return self.spark.createDataFrame([tuple(row.get(c) for c in names(CRAWL))], CRAWL)

    def crawl(self, uid: str) -> dict | None:
        """getCrawl."""
        rows = self.table("crawl").where(F.col("uid") == uid).limit(1).collect()
        return rows[0].asDict() if rows else None

    def crawl_by_job(self, job_uid: str) -> dict | None:
        """The latest run of a job."""
        rows = reports.latest_crawls(self.table("crawl").where(F.col("job_uid") == job_uid), 1).collect()
        return rows[0].asDict() if rows else None

    def crawl_stats(self, uid: str) -> dict | None:
        row = self.crawl(uid)
        return None if row is None else json.loads(row["stats"] or "{}")

    def create(self, uid: str, seeds: list[str] = (), options: dict | None = None, job_uid: str | None = None, at=None) -> dict:
        if self.crawl(uid) is not None:
            raise ValueError(f"a crawl {uid} exists")
        last = self.table("crawl").agg(F.coalesce(F.max("crawl_id"), F.lit(0))).head()[0]
        now = at or self.spark.range(1).select(F.current_timestamp().alias("t")).head()["t"]
        row = {"crawl_id": last + 1, "uid": uid, "job_uid": job_uid, "seeds": json.dumps(list(seeds)), "options": json.dumps(options or {}), "status": "created", "stats": None, "attempt": 0, "created_at": now}
        self.write(row)
        return row

    def write(self, row: dict, grow: dict[str, DataFrame] | None = None, **tables: DataFrame) -> None:
        """The run's row replaced, with other tables in the same commit. A first start and stored counts are kept."""
        old = self.crawl(row["uid"]) or {}
        row = {**row, "started_at": old.get("started_at") or row.get("started_at"), "stats": row.get("stats") or old.get("stats")}
        others = self.table("crawl").where(F.col("uid") != row["uid"])
        self.store.commit(grow, crawl=others.unionByName(self._row(row)), **tables)

    def rows(self, crawl_id: int, pages: DataFrame, links: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
        """A run's pages and links as the tables keep them."""
        def shaped(df: DataFrame, schema: str, **more: Column) -> DataFrame:
            df = df.withColumns({"crawl_id": F.lit(crawl_id).cast("long"), **more})
            return df.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in schema.split(", ")])

        return shaped(pages, PAGE, fetched_at=at), shaped(links, LINK)

    def save(self, row: dict, pages: DataFrame, links: DataFrame, frontier: DataFrame | None = None, persist_body=None, at: Column | None = None) -> None:
        """Everything of a run in one commit."""
        at, crawl_id = F.current_timestamp() if at is None else at, row["crawl_id"]
        own_pages, own_links = self.rows(crawl_id, pages, links, at)
        tables = {
            "archive": merged(self.table("archive"), responses(pages, at, persist_body)),
            "page": A.upsert_pages(self.table("page"), own_pages),
            "link": A.replace_links(self.table("link"), own_links, own_pages.select("crawl_id", "url")),
        }
        if frontier is not None:
            own = frontier.withColumn("crawl_id", F.lit(crawl_id).cast("long")).select(names(FRONTIER))
            tables["frontier"] = A.delete_crawl(self.table("frontier"), crawl_id).unionByName(own)
        self.write(row, **tables)

    # --- questions

    def _of(self, name: str, uid: str) -> DataFrame:
        """A run's rows: the run is looked up by its uid in the same query."""
        own = self.table("crawl").where(F.col("uid") == uid).select("crawl_id")
        return self.table(name).join(F.broadcast(own), "crawl_id", "left_semi")

    def pages(self, uid: str, **filters) -> DataFrame:
        return reports.list_pages(self._of("page", uid), **filters).select(names(PAGE))

    def links(self, uid: str, **filters) -> DataFrame:
        return reports.list_links(self._of("link", uid), **filters).select(names(LINK))

    def failed(self, uid: str, **page) -> DataFrame:
        return reports.list_failed(self._of("page", uid), **page).select(names(PAGE))

    def broken(self, uid: str) -> DataFrame:
        return reports.broken_links(self._of("link", uid), self._of("page", uid))

    def changed(self, uid: str, against: str | None = None) -> DataFrame:
        """Against the latest earlier completed run, or a named one (which must be there); without any, all is new."""
        if against is not None and self.crawl(against) is None:
            raise KeyError(f"no crawl {against}")
        current = self._of("page", uid)
        if against is not None:
            return reports.changes(current, self._of("page", against))
        base = reports.baseline(self.table("crawl"), uid)
        return reports.changes(current, self.table("page").join(F.broadcast(base), "crawl_id", "left_semi"))

    def validators(self, url: str | None = None) -> DataFrame:
        found = reports.validators(self.table("archive"))
        return found if url is None else found.where(F.col("url") == url)

    def body(self, url: str) -> DataFrame:
        return reports.stored_body(self.table("archive"), url)

    def visited_state(self, uid: str) -> DataFrame:
        """The archive's state of each url, with the depth and place it has in the run, if it was met there."""
        own = self._of("page", uid).select("url", "page_seq", "depth")
        state = self.table("archive").select("url", F.col("last_status").alias("status"), "content_hash", "etag", "last_modified", F.col("fetched_at").alias("crawled_at"), F.col("body").isNotNull().alias("has_body"))
        return state.join(own, "url", "left")

    def recompute(self, uid: str) -> dict:
        """Counts from the tables, written to the run's row over whatever stood there."""
        row = self.crawl(uid)
        if row is None:
            raise KeyError(f"no crawl {uid}")
        pages, links = self._of("page", uid), self._of("link", uid)
        counts = reports.stats(pages, links, self._of("frontier", uid)).head().asDict()
        counts["by_status"] = {r["status"]: r["n"] for r in reports.by_status(pages).orderBy("status").collect()}
        counts["skipped_by_reason"] = {r["skip_reason"]: r["n"] for r in reports.skipped_by_reason(links).orderBy("skip_reason").collect()}
        self.write({**row, "stats": json.dumps(counts)})
        return counts

    def delete(self, uid: str) -> None:
        """The run, its pages, links and frontier go in one commit; the archive stays."""
        self.store.commit(**A.cascade({n: self.table(n) for n in ("crawl", "page", "link", "frontier")}, uid))

    def prune(self, **filters) -> int:
        kept, gone = A.prune(self.table("archive"), **filters)
        n = gone.count()
        if n:
            self.store.commit(archive=kept)
        return n
