"""Places, running sums and first rows without a single task: range partitions and their counts, salted first rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegraph.session import settled

SALTS = 64
#: Bytes of input for each share that rows are dealt out in: a task's share stays the same however large the table is.
SLICE = 16 << 20


def slices(*tables: DataFrame) -> int | None:
    """How many shares the rows need, by the size of the tables they come from; none where the session's partitions will do."""
    plans = [t._jdf.queryExecution().optimizedPlan().collectLeaves() for t in tables]
    sizes = [int(str(p.apply(i).stats().sizeInBytes())) for p in plans for i in range(p.size())]
    n = sum(x for x in sizes if x < 1 << 60) // SLICE + 1  # rows of the driver's have no known size
    return n if n > int(tables[0].sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def shared(key: str, *tables: DataFrame) -> tuple[DataFrame, ...]:
    """Tables of wide rows, dealt by a key they are joined on to as many tasks as they need: the rows of each are sorted in memory."""
    n = slices(*tables)
    return tables if n is None else tuple(t.repartition(n, key) for t in tables)


def _dealt(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows by ranges of the order, with their range's number (``__part``), as a table; and the same with each range in one task."""
    n = slices(rows)
    ranges = rows.repartitionByRange(*order) if n is None else rows.repartitionByRange(n, *order)
    dealt = settled(ranges.withColumn("__part", F.spark_partition_id()))
    return dealt, dealt if n is None else dealt.repartition(n, "__part")


def _by_part(values: dict[int, int]) -> Column:
    """The value of the row's range."""
    return F.lit([values.get(i, 0) for i in range(max(values) + 1)]).cast("array<long>")[F.col("__part")]


def running(rows: DataFrame, order: list[str], value: Column, name: str, start: int = 0, end: list[int] | None = None) -> DataFrame:
    """Adds ``name``: the sum (from ``start``) of a whole-number value over the rows before this one in the order, which must
    be total. Rows are dealt by ranges of the order; the driver sees one sum per partition. The sum after all rows is put in ``end``.
    """
    dealt, by_part = _dealt(rows.withColumn("__value", value.cast("long")), order)
    sums = sorted((r["__part"], r["n"]) for r in dealt.groupBy("__part").agg(F.sum("__value").alias("n")).collect())
    base, at = {}, start
    for part, n in sums:
        base[part] = at
        at += n or 0
    if end is not None:
        end.append(at)
    if not base:
        return dealt.drop("__part", "__value").withColumn(name, F.lit(start).cast("long"))
    before = F.coalesce(F.sum("__value").over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return by_part.withColumn(name, (_by_part(base) + before).cast("long")).drop("__part", "__value")


def ranked(rows: DataFrame, order: list[str], name: str = "rank", start: int = 0, end: list[int] | None = None) -> DataFrame:
    """Adds ``name``: the row's place (from ``start``) in the order, which must be total."""
    return running(rows, order, F.lit(1), name, start, end)


def ranked_within(rows: DataFrame, key: str, order: list[str], name: str = "rank") -> DataFrame:
    """Adds ``name``: the row's place (from 0) among the rows of its key. Ranges cut through a key of very many rows: the first key
    of a range goes on from the range before. The driver sees the first and last key of each range."""
    dealt, by_part = _dealt(rows, [key, *order])
    own = dealt.groupBy("__part", F.col(key).alias("k")).agg(F.count("*").alias("n")).select("__part", F.struct("k", "n").alias("own"))
    ends = own.groupBy("__part").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).collect()
    carried, before = {}, None
    for part, lo, hi in sorted(((r["__part"], r["lo"], r["hi"]) for r in ends), key=lambda e: e[0]):
        same = before is not None and (lo["k"] == before[0] or (lo["k"] != lo["k"] and before[0] != before[0]))
        carried[part] = before[1] if same else 0
        before = (hi["k"], hi["n"] + (carried[part] if lo == hi else 0))
    if not carried:
        return dealt.drop("__part").withColumn(name, F.lit(0).cast("long"))
    number = F.row_number().over(Window.partitionBy("__part", key).orderBy(*order)) - 1
    first = F.dense_rank().over(Window.partitionBy("__part").orderBy(key)) == 1
    return by_part.withColumn(name, (number + F.when(first, _by_part(carried)).otherwise(0)).cast("long")).drop("__part")


def first_k(rows: DataFrame, keys: list[str], order: str, k: int) -> DataFrame:
    """(keys, firsts): the orders of each key's first ``k`` rows, rising. A key's rows are thinned in ``SALTS`` shares first, so
    no task sees more than its share of a hot key, and then at most k of each share."""
    salted = rows.select(*keys, F.col(order).alias("__order")).withColumn("__salt", F.pmod(F.xxhash64("__order"), F.lit(SALTS)))
    for by in ([*keys, "__salt"], keys):
        number = F.row_number().over(Window.partitionBy(*by).orderBy("__order"))
        salted = salted.withColumn("__n", number).where(F.col("__n") <= k).drop("__n")
    return salted.groupBy(*keys).agg(F.sort_array(F.collect_list("__order")).alias("firsts"))
