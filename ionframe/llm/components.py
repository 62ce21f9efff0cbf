"""Connected components of links held in a table, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionframe.storage import Scratch


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b): the smallest node that links reach.

    Each round sends the smallest label of its neighbours to a node and to the node's present root, then lets every node
    take its root's label. Both steps are joins between two tables on disk, so Spark can split a hub's rows, and the
    minima are pre-aggregated. Labels only fall, so the rounds end, however long the chains: when their sum no longer
    falls, all ends of all links agree. The labels of a round are deleted after the next one.
    """
    scratch = Scratch(links.sparkSession)
    real = links.where("a <> b").select("a", "b")
    both = scratch.table(real.unionByName(real.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = scratch.table(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    total = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
    while total is not None:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("label"))
        own = labels.withColumnRenamed("node", "a").alias("l").join(near.alias("n"), "a").select("a", F.col("l.label").alias("root"), F.least("l.label", "n.label").alias("label"))
        hooked = scratch.table(own.select(F.explode(F.array(F.struct(F.col("a").alias("node"), "label"), F.struct(F.col("root").alias("node"), "label"))).alias("x")).select("x.*").groupBy("node").agg(F.min("label").alias("label")), "hooked")
        root = hooked.select(F.col("node").alias("r"), F.col("label").alias("r_label"))
        labels = scratch.table(hooked.join(root, F.col("label") == F.col("r")).select("node", F.least("label", "r_label").alias("label")), "labels")
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == total:
            break
        total = now
    scratch.drop_all_but("labels")
    return labels.select("node", F.col("label").alias("component"))
