"""Connected components of a link table, as a few rounds of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.session import materialize

#: Links a task takes when a round ends, and the fewest tasks: most link tables are small beside the number of shuffle partitions.
LINKS_A_TASK, LEAST_TASKS = 50_000, 8


def _settled(links: DataFrame, tasks: int) -> bool:
    """Whether every node hangs on one node only, and on one that hangs on none."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        links.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.filter("up > 1 or (up > 0 and down > 0)").coalesce(tasks).isEmpty()


def _toward(links: DataFrame, only_smaller: bool, tasks: int) -> DataFrame:
    """Hang the neighbours of each node on the smallest node around it.

    The smallest neighbours are aggregated before the shuffle and stored, so that the join back sees two
    plain shuffles and a node with very many neighbours can be split.
    """
    around = links if only_smaller else links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    least = materialize(least.coalesce(tasks), "least")
    joined = around.join(least, "a")
    if only_smaller:
        hung = joined.select(F.col("b").alias("a"), F.col("least").alias("b"))
        hung = hung.union(least.select("a", F.col("least").alias("b")))
    else:
        hung = joined.filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return materialize(hung.filter("a <> b").distinct().coalesce(tasks), "links")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of ``links`` but the smallest of each component.

    ``component`` is the smallest node reachable. Links are undirected, may repeat and may join a node to
    itself; rows with a NULL end are ignored. Nodes absent from the result are their own component.
    Alternates two star steps until every component is a star around its smallest node; each round stores its links in
    the shared folder, and rounds double the distance over which labels travel.
    """
    pairs = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y"))
    pairs = pairs.filter("x is not null and y is not null and a <> b").select("a", "b").distinct()
    current = materialize(pairs, "links")
    tasks = max(LEAST_TASKS, current.count() // LINKS_A_TASK)
    while not _settled(current, tasks):
        current = _toward(_toward(current, False, tasks), True, tasks)
    return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
