"""Connected components of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm._spark import written


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long). Returns id, comp for every linked id; comp is the smallest id reachable.

    Each round gives every vertex its smallest neighbour, follows these pointers twice more, and contracts the edges; vertices
    without an edge left are done. Rounds grow with the logarithm of a component's diameter; only the count of edges comes to the driver.
    Null ends and links of an id with itself are ignored; no links: no rows.
    """
    edges = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = written(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("comp", F.col("id")), "labels")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        down = written(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("v")), "pointers")
        for _ in range(2):
            after = down.toDF("v", "w")
            down = down.join(after, "v", "left").select("u", F.coalesce("w", "v").alias("v"))
        down = written(down, "pointers")
        to = down.toDF("comp", "next")
        labels = written(labels.join(to, "comp", "left").select("id", F.coalesce("next", "comp").alias("comp")), "labels")
        moved = edges.join(down.toDF("a", "x"), "a").join(down.toDF("b", "y"), "b").where("x <> y")
        edges = written(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return labels
