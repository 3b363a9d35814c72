"""Distributed union-find over link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspark.llm.common import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, label) of all nodes in ``links`` (a, b); label: the smallest
    node of the component. Each round points every node's neighbours, and
    then the node itself, to the smallest node it knows (large and small
    star), with the sums per node taken before the shuffle; rounds end when
    every link points from a node to its label. State is a table in the shared
    folder, the driver sees only whether there is a row that does not."""
    pairs = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    while not _settled(pairs):
        both = pairs.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.u", "x.v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialize(large, "links")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        pairs = materialize(small.filter("u <> v").distinct(), "links")
    labels = pairs.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return materialize(pairs.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(labels), "components")


def _settled(pairs: DataFrame) -> bool:
    """True if no node points to two others, and none that is pointed to points on."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("n")), F.struct(F.col("v").alias("node"), F.lit(0).alias("n")))).alias("x")).select("x.node", "x.n")
    return ends.groupBy("node").agg(F.sum("n").alias("out"), F.min("n").alias("least")).filter("out > 1 OR out > 0 AND least = 0").isEmpty()
