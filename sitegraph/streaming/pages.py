"""Pages as a stream: running counts, first sightings and per-path caps over micro-batches.

Nothing here has an event time, so state grows with what is remembered (urls seen, queries per path), as the batch form's
tables do; a watermark would change results.
"""

from __future__ import annotations

import atexit
import heapq
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sitegraph.functions import columns as U
from sitegraph.session import delete, scratch

#: Rows of one table given back at once, and bytes of a path's requests held in memory before they go to a file of the task's own.
ROWS, HELD = 100_000, 32 << 20


def _in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
    """All sequence numbers of a group, rising, by slices. Spark deals a large group out in many tables, in no order between them."""
    seq = pd.concat([pdf["seq"] for pdf in batches]).sort_values(ignore_index=True)
    for i in range(0, len(seq), ROWS):
        yield seq[i : i + ROWS]


def counts(pages: DataFrame) -> DataFrame:
    """Running page counts and bytes by status, in complete mode."""
    return pages.groupBy("status").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def first_seen(urls: DataFrame) -> DataFrame:
    """Each url once, at its first arrival."""
    return urls.dropDuplicates(["url"])


def admit(urls: DataFrame, cap: int) -> DataFrame:
    """(url, seq, admitted): at most ``cap`` distinct queries per host and path. State per path is its queries, so it is
    bounded by the cap. A path's requests come in many tables, in no order: they are held (in a file, if they are many) until the
    first queries of all of them are known."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = list(state.get[0]) if state.exists else []
        known, first, n = set(seen), {}, 0
        left = cap - len(known)
        with tempfile.SpooledTemporaryFile(HELD) as held:
            for pdf in batches:
                pickle.dump(pdf[["url", "seq", "search"]], held)
                n += 1
                for query, seq in pdf[~pdf["search"].isin(known)].groupby("search")["seq"].min().items():
                    first[query] = min(seq, first.get(query, seq))
                # A query that falls out comes back only by a request that is earlier still, which its own table then brings.
                first = {q: first[q] for q in heapq.nsmallest(left, first, key=first.get)}
            seen += first
            known.update(first)
            held.seek(0)
            for _ in range(n):
                pdf = pickle.load(held)
                yield pd.DataFrame({"url": pdf["url"], "seq": pdf["seq"], "admitted": pdf["search"].isin(known)})
        state.update((seen,))

    search = F.coalesce(U.search("url"), F.lit(""))
    rows = urls.select("url", "seq", U.host_port("url").alias("host"), U.path("url").alias("path"), search.alias("search"))
    return rows.groupBy("host", "path").applyInPandasWithState(step, "url string, seq long, admitted boolean", "seen array<string>", "append", GroupStateTimeout.NoTimeout)


def persist(pages: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Writes each micro-batch by ``write(rows, batch_id)``, which must replace what an earlier try of the batch wrote."""
    return pages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, n: write(rows, n)).trigger(availableNow=True).start()


def repeats(pages: DataFrame, threshold: int) -> DataFrame:
    """(content_hash, seq, soft_dup): whether a content has come more than ``threshold`` times. State per content is its count."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        for seq in _in_order(batches):
            number = range(n + 1, n + 1 + len(seq))
            n += len(seq)
            yield pd.DataFrame({"content_hash": [key[0]] * len(seq), "seq": seq.to_numpy(), "soft_dup": [k > threshold for k in number]})
        state.update((n,))

    return pages.groupBy("content_hash").applyInPandasWithState(step, "content_hash string, seq long, soft_dup boolean", "n long", "append", GroupStateTimeout.NoTimeout)


def schedule(requests: DataFrame, delay_ms: int) -> DataFrame:
    """(host, seq, start_ms): the earliest moment of each request if those of a host keep the delay. State per host is its turn."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        for seq in _in_order(batches):
            yield pd.DataFrame({"host": [key[0]] * len(seq), "seq": seq.to_numpy(), "start_ms": [(n + i) * delay_ms for i in range(len(seq))]})
            n += len(seq)
        state.update((n,))

    return requests.groupBy("host").applyInPandasWithState(step, "host string, seq long, start_ms long", "n long", "append", GroupStateTimeout.NoTimeout)


def collected(made: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what is there, and gives its result as a table in the shared folder: all rows appended, or in complete
    mode those of the last batch."""
    spark = made.sparkSession
    path = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    writer = made.writeStream.option("checkpointLocation", f"{path}/checkpoint").outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{path}/rows").start().awaitTermination()
    else:
        writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{path}/rows")).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{path}/rows")


def persisted(pages: DataFrame, again: bool = False) -> DataFrame:
    """A stream kept by ``persist`` in a folder for each batch. again: every batch is written twice, as a repeated try would."""
    spark = pages.sparkSession
    path = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)

    def write(rows: DataFrame, batch: int) -> None:
        for _ in range(2 if again else 1):
            rows.write.mode("overwrite").parquet(f"{path}/rows/batch-{batch}")

    persist(pages, write, f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(pages.schema).option("recursiveFileLookup", "true").parquet(f"{path}/rows")
