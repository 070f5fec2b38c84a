"""State tables and their changes, as pure functions of DataFrames, and a store of versioned Parquet folders."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitegraph.functions.columns import host as host_of
from sitegraph.operators.ranking import first_k
from sitegraph.session import CODEC

ARCHIVE = (
    "url string, body binary, content_type string, charset string, etag string, last_modified string, content_hash string, "
    "last_status int, size long, fetched_at timestamp"
)
_KEPT = ("body", "content_type", "charset", "etag", "last_modified", "content_hash", "size")


def upsert_archive(old: DataFrame, new: DataFrame) -> DataFrame:
    """Responses of a run over the archive: what a response lacks is kept, status and time are the response's."""
    both = old.alias("o").join(new.alias("n"), "url", "full_outer")
    hit = F.col("n.last_status").isNotNull() | F.col("n.fetched_at").isNotNull()

    def column(c: str) -> Column:
        if c == "url":
            return F.col("url")
        if c in _KEPT:
            return F.coalesce(f"n.{c}", f"o.{c}").alias(c)
        return F.when(hit, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)

    return both.select(*[column(c) for c in old.columns])


def visited(old: DataFrame, new: DataFrame) -> DataFrame:
    """Visits over the archive: validators, status and time are replaced (also by nothing), bodies untouched."""
    replaced = ("etag", "last_modified", "content_hash", "last_status", "fetched_at")
    both = old.alias("o").join(new.select("url", *replaced, F.lit(True).alias("hit")).alias("n"), "url", "full_outer")
    return both.select(*[F.when(F.col("n.hit"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) if c in replaced else F.col("url" if c == "url" else f"o.{c}").alias(c) for c in old.columns])


def upsert_pages(old: DataFrame, new: DataFrame) -> DataFrame:
    """Pages of a run by (crawl_id, url): the new row replaces the old one whole; of several new ones the last in sequence."""
    rows = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy("crawl_id", "url").orderBy(F.desc("__new"), F.desc("page_seq")))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__new", "__rank")


def replace_links(old: DataFrame, new: DataFrame, pages: DataFrame) -> DataFrame:
    """All links of the pages written (crawl_id, url) give way to the new ones; repeats on one page are legal."""
    written = pages.select("crawl_id", F.col("url").alias("from_url")).distinct()
    return old.join(written, ["crawl_id", "from_url"], "left_anti").unionByName(new)


def push(frontier: DataFrame, new: DataFrame) -> DataFrame:
    """New frontier rows that aren't there in any state; of several with one url the first in sequence."""
    first = new.withColumn("__rank", F.row_number().over(Window.partitionBy("url").orderBy("seq"))).where("__rank = 1").drop("__rank")
    return first.join(frontier.select("url"), "url", "left_anti")


def claim(frontier: DataFrame, limit: int, now: Column | None = None, exclude_hosts: tuple[str, ...] = (), per_host: int | None = None) -> DataFrame:
    """The next pending rows by (priority, seq), with hosts left out, deferred rows waiting, and at most so many of a host."""
    rows = frontier.where("status = 'pending'")
    if now is not None:
        rows = rows.where(F.col("ready_at").isNull() | (F.col("ready_at") <= now))
    if exclude_hosts:
        rows = rows.where(~F.col("host").isin(*exclude_hosts))
    if per_host is not None:
        early = first_k(rows.withColumn("__turn", F.struct("priority", "seq")), ["host"], "__turn", per_host)
        rows = rows.join(early.select(F.explode("firsts").alias("f")).select("f.priority", "f.seq"), ["priority", "seq"], "left_semi")
    return rows.orderBy("priority", "seq").limit(limit)


def set_status(frontier: DataFrame, urls: DataFrame, status: str, only: str | None = None) -> DataFrame:
    """The frontier with the state of these urls set (only of rows in state ``only``, if given)."""
    hit = frontier.join(urls.select("url", F.lit(True).alias("__hit")).dropDuplicates(["url"]), "url", "left")
    change = F.coalesce("__hit", F.lit(False)) & (F.lit(True) if only is None else F.col("status") == only)
    return hit.withColumn("status", F.when(change, status).otherwise(F.col("status"))).select(frontier.columns)


def recover(frontier: DataFrame) -> DataFrame:
    """Rows left in flight by a lost run are pending again."""
    return frontier.withColumn("status", F.when(F.col("status") == "in_flight", "pending").otherwise(F.col("status")))


def delete_crawl(table: DataFrame, crawl_id: int) -> DataFrame:
    return table.where(F.col("crawl_id") != crawl_id)


def cascade(tables: dict[str, DataFrame], uid: str) -> dict[str, DataFrame]:
    """The tables (crawl, page, link, frontier) without a run and all that hangs on it; the archive isn't among them and stays."""
    gone = tables["crawl"].where(F.col("uid") == uid).select("crawl_id")
    return {name: t.join(F.broadcast(gone), "crawl_id", "left_anti") for name, t in tables.items()}


def prune(archive: DataFrame, older_than: Column | None = None, host: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, pruned): rows fetched before a time and/or of a host go; at least one filter is asked for."""
    if older_than is None and not host:
        raise TypeError("prune needs at least one filter: older_than and/or host")
    gone = F.lit(True)
    if older_than is not None:
        gone = gone & (F.col("fetched_at") < older_than)
    if host:
        gone = gone & (F.lower(host_of("url")) == host.lower())
    gone = F.coalesce(gone, F.lit(False))
    return archive.where(~gone), archive.where(gone)


class Store:
    """Named tables under a folder. A commit writes all its tables as new folders and then one manifest row naming them,
    so readers see all or nothing, a run that dies half-way leaves no trace, and a repeated commit replaces its own.

    ``commit`` replaces the tables it names; those given by ``grow`` get a part more, so a growing table is never rewritten.
    """

    MANIFEST = "version long, name string, path string, grows boolean"

    def __init__(self, spark: SparkSession, folder: str, tenant: str = "_default") -> None:
        self.spark, self.folder, self.tenant = spark, f"{folder.rstrip('/')}/tenant={tenant}", tenant

    def _manifests(self) -> DataFrame:
        return self.spark.read.schema(self.MANIFEST).parquet(f"{self.folder}/manifest")

    def _exists(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def version(self) -> int:
        if not self._exists(f"{self.folder}/manifest"):
            return 0
        return self._manifests().agg({"version": "max"}).head()[0] or 0

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        """The current table (its last whole version and the parts after it), or an empty one of the schema."""
        if self._exists(f"{self.folder}/manifest"):
            rows = self._manifests().where(F.col("name") == name).orderBy(F.desc("version"), "path").collect()
            paths = []
            for r in rows:
                paths.append(f"{self.folder}/{r['path']}")
                if not r["grows"]:
                    break
            if paths:
                return self.spark.read.parquet(*paths[::-1])
        if schema is None:
            raise KeyError(name)
        return self.spark.createDataFrame([], schema).limit(0)  # which plans know to be empty

    def has(self, name: str) -> bool:
        return self._exists(f"{self.folder}/manifest") and not self._manifests().where(F.col("name") == name).isEmpty()

    def commit(self, grow: dict[str, DataFrame] | None = None, **tables: DataFrame) -> int:
        version, rows = self.version() + 1, []
        for name, table in {**(grow or {}), **tables}.items():
            path = f"data/{name}/{version:08d}-{uuid.uuid4().hex[:8]}"
            table.write.option("compression", CODEC).parquet(f"{self.folder}/{path}")
            rows.append((version, name, path, name not in tables))
        self.spark.createDataFrame(rows, self.MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")
        return version

    def drop(self) -> None:
        """Everything of this tenant goes."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
