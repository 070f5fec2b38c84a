"""What the operators share: shared-folder scratch tables, Arrow mapping and word arrays."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_U64 = np.uint64
#: Bytes that separate words: tab, line feed, vertical tab, form feed, carriage return, space.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, read by Spark alone (the folder may be in any store Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` of the session wins. Only where it is unset (a single-machine session, as in tests)
    a temporary folder is made; on a cluster an unset folder is an error, since executors would not see a local one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="sitegraph-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session may be gone; the folder is scratch
        pass


def keep(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and a lost executor loses nothing.

    The folder goes when the driver's Python ends.
    """
    path = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, rows: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(rows, schema)


def counted_join(left: DataFrame, right: DataFrame, on: list[str], n: str, total: int | None = None, how: str = "inner") -> DataFrame:
    """left joined with right, whose keys are unique and whose column n counts the rows of left with that key.

    Keys of more rows than a ten-thousandth of all (and than 1000) are hot; they number fewer than 10,000, so they are joined by
    broadcast, where no task gets all rows of one. The others meet by a shuffle. right should be a written table; total is
    the sum of n, or a bound that is not much larger (reckoned if not given). n is dropped.
    """
    if total is None:
        total = right.agg(F.sum(n)).first()[0] or 0
    limit = max(1000, total // 10_000)
    hot = F.broadcast(right.where(F.col(n) > limit))
    rest = left.join(hot.select(on), on, "left_anti").join(right.where(F.col(n) <= limit), on, how)
    return left.join(hot, on).unionByName(rest).drop(n)


def pieces(batch: pa.RecordBatch, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """A batch cut so that each part holds about ``most_bytes`` (at least one row, however long)."""
    rows = max(1, int(batch.num_rows * most_bytes / max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x.astype(_U64, copy=True)
    x ^= x >> _U64(30)
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


class WordHashes:
    """64-bit hashes of words given as bytes, remembered up to a bound (then forgotten and started anew)."""

    def __init__(self, most: int = 400_000) -> None:
        self.most, self.known = most, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        known, digest = self.known, xxhash.xxh3_64_intdigest
        if len(known) > self.most:
            known.clear()
        get = known.get
        out = [get(w) for w in words]
        if None in out:
            for i, h in enumerate(out):
                if h is None:
                    w = words[i]
                    h = get(w)
                    if h is None:
                        h = known[w] = digest(w)
                    out[i] = h
        return np.array(out, dtype=_U64)


def window_hashes(words: np.ndarray, size: int, seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A 64-bit hash of each window of ``size`` word hashes: a polynomial built by doubling, then mixed."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=_U64)
    with np.errstate(over="ignore"):
        # power[k] spans 2**k words; parts of the binary form of size are joined from the left.
        out, at, span, step, power = np.zeros(n, dtype=_U64), 0, words, 1, _U64(seed | 1)
        left = size
        while left:
            if left & 1:
                out = out * power + span[at : at + n]
                at += step
            left >>= 1
            if left:
                span = span[: len(span) - step] * power + span[step:]
                power, step = power * power, step * 2
        return mix(out)
