"""Connected components of large graphs by label propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialise


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(v, component) of every end of an edge; the component is its least vertex.

    Each round takes the least label among neighbours and then the label of
    that label, so labels travel twice as far each time; labels only fall, so
    the rounds end. A round is a written table in the shared folder, which the
    next one replaces. Null ends are ignored, as are loops; the least label is
    taken on the map side, so a vertex of any degree is no hot key.
    """
    ends = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL")
    both = materialise(ends.unionByName(ends.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "edges")
    table = materialise(both.groupBy(F.col("src").alias("v")).agg(F.least(F.col("v"), F.min("dst")).alias("component")), "labels")
    while True:
        labels = table.select("v", "component")
        near = both.join(labels, both.dst == labels.v).groupBy(F.col("src").alias("v")).agg(F.min("component").alias("least"))
        moved = labels.join(near, "v").select("v", F.col("component").alias("old"), F.least("component", "least").alias("component"))
        to = labels.select(F.col("v").alias("component"), F.col("component").alias("far"))
        before, table = table, materialise(moved.join(to, "component", "left").select("v", "old", F.coalesce(F.least("component", "far"), F.col("component")).alias("component")), "labels")
        discard(before)
        if table.where("old <> component").isEmpty():
            discard(both)
            return table.select("v", "component")


def merged_components(labels: DataFrame, edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(v, component) of a graph with components ``labels`` after more edges have come.

    The rounds go over the new edges alone, as edges between components, so
    those of the graph before are not read again.
    """
    one = labels.select(F.col("v").alias("src"), F.col("component").alias("a"))
    two = labels.select(F.col("v").alias("dst"), F.col("component").alias("b"))
    ends = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).join(one, "src", "left").join(two, "dst", "left")
    more = connected_components(ends.select(F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst")))
    # ends that had no edge before stand for themselves
    known = labels.select("v", F.col("component").alias("old"))
    known = known.unionByName(more.join(known, "v", "left_anti").select("v", F.col("v").alias("old")))
    to = more.select(F.col("v").alias("old"), F.col("component").alias("new"))
    return materialise(known.join(to, "old", "left").select("v", F.coalesce("new", "old").alias("component")), "merged")
