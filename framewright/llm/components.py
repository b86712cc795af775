"""Connected components by alternating large-star and small-star.

Edges stay in tables; the driver sees one count per round.  In a large-star
round every node links its larger neighbours to its smallest neighbour; in a
small-star round it links its smaller neighbours and itself to the smallest.  It
ends when the links are stars, each around the smallest node of its component,
which takes a number of rounds that grows with the logarithm of the links.

Minima are aggregated with partial sums before the shuffle and written before
they are joined back, so that both sides of the join are plain exchanges and
the neighbours of one hot node can be split over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import drop_table, tasks_of, write_table


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One round over edges (u, v) with u > v."""
    tasks = tasks_of(links)
    if large:
        near = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = links
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    least = write_table(least, "least", tasks=tasks)
    if large:
        moved = near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = near.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(least.select("u", F.col("m").alias("v")))
    out = write_table(moved.where("u > v").distinct(), "links", tasks=tasks)
    drop_table(least)
    return out


def _unsettled(links: DataFrame) -> int:
    """Nodes that keep the links from being stars around smallest nodes: with several larger ends, or larger and smaller at once."""
    ends = links.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(links.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 or up > 0 and down > 0").count()


def components(links: DataFrame, tasks: int | None = None) -> DataFrame:
    """(node, component) for every node of the links (a, b) that isn't the smallest of its component.

    Links from a node to itself and links with a null end are left out.  ``tasks`` is how many write the links at first.
    """
    edges = write_table(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links", tasks=tasks)
    while _unsettled(edges):
        wide = _star(edges, True)
        drop_table(edges)
        edges = _star(wide, False)
        drop_table(wide)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
