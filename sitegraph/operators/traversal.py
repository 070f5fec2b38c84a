"""Level-synchronous traversal of an edge table: the first edge in order that reaches a node is the one that is followed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegraph.operators.ranking import ranked
from sitegraph.session import Parts, settled


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, max_nodes: int | None = None, ordered: bool = True) -> DataFrame:
    """(id, depth, seq, parent, pos) of the nodes reached, from edges (from_id, pos, to_id) and seeds (id).

    Order is that of a queue: seeds by id, then by (parent's place, position). Each level is one join of the new nodes with
    the edges, one aggregation to the first edge per target, one anti-join with what has been seen; its rows are written once,
    as a part of the result in the shared folder, so neither lineage nor work grows with the levels before. Unordered mode skips ranks (seq is null) where only depths are wanted.
    """
    edges = settled(edges.dropDuplicates(["from_id", "pos", "to_id"]))
    level = seeds.select("id").distinct()
    level = ranked(level, ["id"], "seq") if ordered else settled(level.withColumn("seq", F.lit(None).cast("long")))
    level = level.withColumns({"depth": F.lit(0), "parent": F.lit(None).cast("long"), "pos": F.lit(None).cast("int")})
    names = ["id", "depth", "seq", "parent", "pos"]
    seen, depth = Parts(edges.sparkSession, level.select(names)), 0
    level = seen.last
    count = level.count()
    while max_depth is None or depth < max_depth:
        if max_nodes is not None and count >= max_nodes:
            break
        depth += 1
        order = F.struct(F.coalesce("seq", "from_id"), F.col("pos").cast("long"))
        reached = level.select(F.col("id").alias("from_id"), "seq").join(edges, "from_id").withColumn("order", order)
        first = reached.groupBy(F.col("to_id").alias("id")).agg(F.min(F.struct("order", "from_id", "pos")).alias("f"))
        new = first.join(seen.read().select("id"), "id", "left_anti").select("id", F.col("f.order").alias("o"), F.col("f.from_id").alias("parent"), F.col("f.pos").cast("int").alias("pos"))
        new = settled(new)
        found = new.count()
        if not found:
            break
        placed = ranked(new, ["o"], "seq", count) if ordered else new.withColumn("seq", F.lit(None).cast("long"))
        level = seen.add(placed.withColumn("depth", F.lit(depth)).select(names))
        count += found
    found = seen.read()
    return found if max_nodes is None else found.where(F.col("seq") < max_nodes)
