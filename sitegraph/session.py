"""The session this package is run with, and tables in the shared folder that end a lineage."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Of tables this package writes: bodies take half the room they have with the default.
CODEC = "zstd"


def session(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(master).config("spark.sql.shuffle.partitions", partitions).config("spark.sql.session.timeZone", "UTC")
    for k, v in {"spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false", **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a temporary one on a single machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="sitegraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session may be gone; the folder is scratch
        pass


_open: list[list[str]] = []  # the scopes that are open, innermost last


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables settled inside go when the block ends (but for those settled with ``stays``)."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            delete(spark, path)


def settled(df: DataFrame, stays: bool = False) -> DataFrame:
    """The rows as a table written to the shared folder and read back; it goes with the block it was made in, or when the
    driver's Python ends."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", CODEC).parquet(path)
    if _open and not stays:
        _open[-1].append(path)
    else:
        atexit.register(delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


class Parts:
    """A table that grows by parts: each is written once, all are read as one folder, so neither work nor plans grow with the
    number of parts."""

    def __init__(self, spark: SparkSession, first: DataFrame | None = None, schema: str | None = None) -> None:
        self.spark, self.path, self.count, self.schema = spark, f"{scratch(spark)}/parts-{uuid.uuid4().hex}", 0, schema
        self.last: DataFrame | None = None
        atexit.register(delete, spark, self.path)
        if first is not None:
            self.add(first)

    def add(self, df: DataFrame) -> DataFrame:
        """Writes the part and gives it as it was written."""
        if self.count == 0:
            self.schema = df.schema
        path = f"{self.path}/part-{self.count:06d}"
        df.select(self.schema.names).write.option("compression", CODEC).parquet(path)
        self.count += 1
        self.last = self.spark.read.schema(self.schema).parquet(path)
        return self.last

    def read(self) -> DataFrame:
        if self.count == 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.path)
