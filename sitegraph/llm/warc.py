"""WARC fixity audit by Merkle trees.

Every record of an archive has a key that orders it (its number or the number of its page). Leaves hash whole records;
a node hashes its ``FAN`` ordered children, that is a range of keys and so a range of offsets of the archive; after
``LEVELS`` levels a root stands for a shard of FAN**LEVELS keys. Two replicas are compared from the roots down: only children
of nodes that differ are joined at the next level, so sound ranges cost one comparison at the top and damage is located
in LEVELS joins whose inputs shrink to the damaged branches.

All of it is built-in DataFrame functions. Groups are bounded: a node has at most FAN children. Records that share a key are
first summed into one leaf (count, bytes and eight 32-bit sums of their digests), with map-side combining, so a key that
holds a third of all records costs one row per task.

Edge cases: null payloads and urls count as empty and differ from nothing else than other payloads; records without a key
are spread by their digest over far negative keys, so that they are compared too; their reported key is null. An empty replica
makes every record of the other one missing or extra; two empty ones give an empty result. Columns other than the
named ones are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.llm.common import keep

FAN, LEVELS = 32, 3
SHARD = FAN**LEVELS
READ = "file string, number long, offset long, length long, type string, uri string, digest string"


def record(url: Column, payload: Column, key: Column) -> Column:
    """A resource record (WARC/1.1) as text; its bytes are the text's UTF-8."""
    payload = F.coalesce(payload, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:record:"), F.coalesce(key.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(payload).cast("string"),
        F.lit("\r\n\r\n"), payload, F.lit("\r\n\r\n"),
    )


def records(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """(key, length, digest) of each page's record."""
    whole = record(F.col(url), F.col(payload), F.col(key))
    return pages.select(F.col(key).cast("long").alias("key"), whole.alias("r")).select(
        "key", F.octet_length("r").cast("long").alias("length"), F.sha2("r", 256).alias("digest")
    )


def leaves(found: DataFrame) -> DataFrame:
    """(at, key, hash, bytes, records): one row per key; at orders the archive."""
    spread = F.lit(-(1 << 62)) - F.pmod(F.xxhash64("digest"), F.lit(1 << 30))  # far from any true key
    words = [F.sum(F.conv(F.substring("digest", 1 + 8 * i, 8), 16, 10).cast("long")) for i in range(8)]
    return (
        found.groupBy(F.coalesce("key", spread).alias("at"), "key")
        .agg(F.count("*").alias("records"), F.sum("length").alias("bytes"), *[w.alias(f"w{i}") for i, w in enumerate(words)])
        .select("at", "key", F.sha2(F.concat_ws(",", F.lit("leaf"), "records", "bytes", *[f"w{i}" for i in range(8)]), 256).alias("hash"), "bytes", "records")
    )


def above(nodes: DataFrame) -> DataFrame:
    """The next level: each node hashes its ordered children."""
    children = F.array_sort(F.collect_list(F.struct("at", "hash")))
    line = F.concat_ws(",", F.transform(children, lambda c: F.concat_ws(":", c["at"], c["hash"])))
    return nodes.groupBy(F.floor(F.col("at") / FAN).cast("long").alias("at")).agg(F.sha2(F.concat(F.lit("node,"), line), 256).alias("hash"))


def tree(spark: SparkSession, found: DataFrame) -> list[DataFrame]:
    """The levels from leaves to roots, each a table in the shared folder."""
    levels = [keep(spark, leaves(found))]
    for _ in range(LEVELS):
        levels.append(keep(spark, above(levels[-1])))
    return levels


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.select("at", F.col("hash").alias("ha")).join(b.select("at", F.col("hash").alias("hb")), "at", "full_outer")
    return both.where(~F.col("ha").eqNullSafe(F.col("hb"))).select("at")


def audit(spark: SparkSession, first: DataFrame, second: DataFrame) -> DataFrame:
    """Damage between two replicas of (key, length, digest) rows: a row per differing key.

    (shard, key, status, offset_first, length_first, offset_second, length_second); offsets are those of the key's records in
    its shard's archive, in order of keys. status: missing (from the second), extra, or altered.
    """
    a, b = tree(spark, first), tree(spark, second)
    suspects = keep(spark, _differing(a[LEVELS], b[LEVELS]))
    shards = suspects
    for level in range(LEVELS - 1, -1, -1):
        parent = F.floor(F.col("at") / FAN).cast("long").alias("parent")
        under = [x[level].select("at", "hash", parent).join(suspects.select(F.col("at").alias("parent")), "parent", "left_semi") for x in (a, b)]
        suspects = keep(spark, _differing(*under))

    def placed(level: DataFrame, name: str) -> DataFrame:
        # Offsets are running sums within the shards that differ (at most SHARD keys each).
        shard = F.floor(F.col("at") / SHARD).cast("long").alias("shard")
        own = level.select("at", "key", "bytes", shard).join(shards.select(F.col("at").alias("shard")), "shard", "left_semi")
        before = F.expr("sum(bytes) over (partition by shard order by at rows between unbounded preceding and current row) - bytes")
        return own.select("at", F.col("key").alias(f"key_{name}"), before.alias(f"offset_{name}"), F.col("bytes").alias(f"length_{name}")).join(suspects, "at", "left_semi")

    both = placed(a[0], "first").join(placed(b[0], "second"), "at", "full_outer")
    status = F.when(F.col("length_second").isNull(), "missing").when(F.col("length_first").isNull(), "extra").otherwise("altered")
    return both.select(
        F.floor(F.col("at") / SHARD).cast("long").alias("shard"), F.coalesce("key_first", "key_second").alias("key"), status.alias("status"),
        "offset_first", "length_first", "offset_second", "length_second",
    )


def parse(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of each record of an archive's bytes, plain or gzipped per record.

    Offsets and lengths are those in the file as it is stored. A damaged tail ends the walk without an error.
    """
    import zlib

    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\x1f\x8b":
            open_, raw, stop = zlib.decompressobj(31), bytearray(), at
            try:
                while not open_.eof and stop < len(data):  # in steps: what is left over is copied
                    raw += open_.decompress(data[stop : stop + 65_536])
                    stop = min(stop + 65_536, len(data))
            except zlib.error:
                return
            size = stop - at - len(open_.unused_data)
            head = _one(bytes(raw), 0)
        else:
            while data[at : at + 2] == b"\r\n":
                at += 2
            head = _one(data, at)
            size = head[2] if head else 0
        if head is None or not size:
            return
        yield at, size, head[0], head[1]
        at += size


def _one(data: bytes, at: int) -> tuple[dict[str, str], bytes, int] | None:
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0 or not data.startswith(b"WARC/", at):
        return None
    headers = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    try:
        size = int(headers.get("content-length", "0"))
    except ValueError:
        return None
    end = stop + 4 + size
    return headers, data[stop + 4 : end], end + 4 - at


def archive(rows: Iterable[tuple[str, bytes]], compress: bool = True) -> bytes:
    """The bytes of an archive of (uri, payload) resources, gzipped record by record if asked."""
    out = io.BytesIO()
    for n, (uri, payload) in enumerate(rows):
        head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:record:{n}>\r\nWARC-Target-URI: {uri}\r\nContent-Type: text/html\r\nContent-Length: {len(payload)}\r\n\r\n"
        raw = head.encode() + payload + b"\r\n\r\n"
        out.write(gzip.compress(raw, mtime=0) if compress else raw)
    return out.getvalue()


def read(spark: SparkSession, path: str, pattern: str = "*.warc*") -> DataFrame:
    """READ: the records of archive files under a folder; a file is one task's work (files are about 1 GB by custom)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")
    names = [x.split()[0] for x in READ.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1)):
                out = []
                for n, (at, size, headers, block) in enumerate(parse(content.as_py())):
                    name = file.as_py().rsplit("/", 1)[-1]
                    digest = hashlib.sha256(headers.get("warc-target-uri", "").encode() + b"\0" + block).hexdigest()
                    out.append((name, n, at, size, headers.get("warc-type"), headers.get("warc-target-uri"), digest))
                columns = list(zip(*out)) if out else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return files.mapInArrow(rows, READ)


def mirror(pages: DataFrame) -> DataFrame:
    """A copy of the pages with set damage, for want of a second replica: of 251 consecutive ids one is cut short, one has a
    blank more, one is lost and one has another address."""
    case = F.pmod("page_id", F.lit(251))
    html = F.when(case == 0, F.expr("left(html, cast(floor(length(html) / 2) as int))")).when(case == 1, F.concat("html", F.lit(" "))).otherwise(F.col("html"))
    url = F.when(case == 3, F.concat("url", F.lit("#"))).otherwise(F.col("url"))
    return pages.where(F.coalesce(case != 2, F.lit(True))).select("page_id", url.alias("url"), html.alias("html"))
