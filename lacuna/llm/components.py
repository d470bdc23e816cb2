"""Connected components of a table of links, as rounds of joins; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import stored
from lacuna.llm.decontamination import small


#: Parts among which the rows that look up one vertex are dealt.
SALT = 16


def looked_up(df: DataFrame, key: str, labels: DataFrame, value: str) -> DataFrame:
    """df with the column `value`: the label c of the vertex that df names in `key`. However many rows name one vertex, no task holds them all."""
    there = labels.select(F.col("v").alias(key), F.col("c").alias(value))
    known = small(there)
    if known is not there:
        return df.join(known, key)
    dealt = there.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALT)).cast("int")).join(dealt, [key, "_salt"]).drop("_salt")


def components(links: DataFrame) -> DataFrame:
    """(v, c) for every vertex of links (a, b): c is the smallest vertex that can be reached.

    Each round takes the smallest label among a vertex, its neighbours and the vertex that its label names, so a chain
    shortens by half or more; rounds end when no label has changed. Each is a written table: a lost executor repeats one round at most.
    """
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c")).withColumnRenamed("a", "v"), "labels")
    while True:
        near = looked_up(both, "b", labels, "c").groupBy("a").agg(F.min("c").alias("m"))
        step = stored(labels.join(near, labels["v"] == near["a"]).select("v", "c", F.least("c", "m").alias("m")), "steps")
        moved = stored(looked_up(step, "m", labels, "further").select("v", F.col("c").alias("old"), F.least("m", "further").alias("c")), "labels")
        if moved.where("old <> c").limit(1).count() == 0:
            return moved.select("v", "c")
        labels = moved.select("v", "c")
