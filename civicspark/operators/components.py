"""Connected components of a link table by minimum labels with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspark.session import scratch_path


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b); a component is
    named by its least node. Each round gives a node the least label among its
    neighbours' (minima are taken map side) and then its label's own label;
    rounds end when none changes. State is a table in the shared folder. Its
    files are compressed, so their size says little of a broadcast's: the joins
    shuffle."""
    spark = links.sparkSession

    def stored(df: DataFrame) -> DataFrame:
        path = scratch_path(spark, "components")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    both = stored(links.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("l"))
                  .select("l.u", "l.v").filter("u <> v").distinct())
    labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(labels.hint("merge"), F.col("v") == F.col("node")).groupBy("u").agg(F.min("label").alias("m"))
        step = stored(labels.join(near.hint("merge"), F.col("node") == F.col("u")).select("node", F.col("label").alias("was"), F.least("label", "m").alias("label")))
        up = step.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = stored(step.join(up.hint("merge"), "label", "left").select("node", "was", F.least("label", F.coalesce("up", "label")).alias("label")))
        labels = new.select("node", "label")
        if new.filter("was <> label").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
