"""Connected components of a graph that is spread over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackwork.llm.tables import written


#: Edges of one file of a round.
PART_ROWS = 100_000


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (a, b: bigint); vertices of a component share their root.

    Each round every vertex joins the neighbour with the smallest hash, if that is smaller than its
    own, and the graph shrinks to the vertices that were joined. With a new hash each round at least
    half of the vertices go on average, whatever the shape of the graph. Only counts reach the driver.
    """
    left = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    found, every = None, 1
    salt = 0
    while rows := left.count():
        parts = 1 + rows // PART_ROWS  # the graph shrinks, and so do the files of a round
        every = max(every, parts)
        both = left.union(left.select("b", "a")).toDF("a", "b")
        order = lambda c: F.xxhash64(F.lit(salt), c)
        joins = both.groupBy("a").agg(F.min(order("b")).alias("low"), F.min_by("b", order("b")).alias("b"))
        root = F.when(F.col("low") < order("a"), F.col("b")).otherwise(F.col("a"))
        step = written(joins.select(F.col("a").alias("v"), root.alias("root")).coalesce(parts), "joins")
        if found is None:
            found = step
        else:
            later = step.toDF("_v", "_root")
            found = found.join(later, F.col("root") == F.col("_v"), "left")
            found = written(found.select("v", F.coalesce("_root", "root").alias("root")).coalesce(every), "roots")
        shrunk = left.join(step.toDF("a", "ra"), "a").join(step.toDF("b", "rb"), "b").where("ra <> rb")
        shrunk = shrunk.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        left = written(shrunk.distinct().coalesce(parts), "edges")
        salt += 1
    return found if found is not None else left.toDF("v", "root")
