"""Components, hierarchies and orders over parent links."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cut(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder that spark.checkpoint.dir names (a local one where unset and the master is local, as in tests; an error on a cluster): lineage ends, a lost executor takes nothing."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.gettempdir()
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(nodes: DataFrame, edges: DataFrame, key: str, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """(key, component): the smallest node reachable, itself included. Smallest labels spread along edges, and every round also jumps to the label's label, so rounds grow with the logarithm of a path.

    Labels grow with the input, so they are merged at every size, never broadcast: their files are far smaller than their rows in memory.
    """
    both = _cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct(), "edges")
    label = _cut(nodes.select(F.col(key).alias("n"), F.col(key).alias("l")), "labels")
    for _ in range(rounds):
        near = both.join(label.hint("merge"), both.v == label.n).groupBy("u").agg(F.min("l").alias("m"))
        step = label.join(near.hint("merge"), label.n == near.u, "left").select("n", F.col("l").alias("was"), F.least("l", F.coalesce("m", "l")).alias("l"))
        step = _cut(step, "labels")
        jump = step.alias("s").join(step.select(F.col("n").alias("k"), F.col("l").alias("ll")).alias("t").hint("merge"), F.col("s.l") == F.col("t.k"), "left").select(F.col("s.n").alias("n"), F.col("s.was").alias("was"), F.least("s.l", F.coalesce("t.ll", "s.l")).alias("l"))
        jump = _cut(jump, "labels")
        moved = jump.where("l <> was").limit(1).count()
        label = jump.select("n", "l")
        if not moved:
            return label.select(F.col("n").alias(key), F.col("l").alias("component"))
    raise RuntimeError("labels did not settle")


def repaired(layers: DataFrame, key: str = "id", parent: str = "parent") -> DataFrame:
    """Parents that don't exist become null."""
    known = layers.select(F.col(key).alias("_known"))
    return layers.join(known, F.col(parent) == F.col("_known"), "left").withColumn(parent, F.col("_known")).drop("_known")


def paths(layers: DataFrame, key: str = "id", parent: str = "parent", order: list[str] | None = None, most: int = 64) -> DataFrame:
    """depth and path (the order values from the root down) of every layer that hangs on a root; layers of a cycle are missing.

    A level is joined to the one above; the number of joins is the forest's height, not its size.
    """
    cols = [F.col(c) for c in (order or [key])]
    step = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(cols)], F.col(key).alias("id"))
    level = layers.where(F.col(parent).isNull()).select(F.col(key).alias("n"), F.lit(0).alias("depth"), F.array(step).alias("path"))
    out = level
    below = layers.where(F.col(parent).isNotNull()).select(F.col(key).alias("c"), F.col(parent).alias("p"), step.alias("s"))
    for depth in range(1, most):
        level = _cut(below.join(level, below.p == level.n).select(F.col("c").alias("n"), F.lit(depth).alias("depth"), F.array_append("path", F.col("s")).alias("path")), "level")
        if not level.limit(1).count():
            return out.withColumnRenamed("n", key)
        out = out.union(level)
    raise ValueError(f"deeper than {most} levels")


def z_order(layers: DataFrame, key: str = "id", parent: str = "parent") -> DataFrame:
    """Layers from the bottom to the top: depth-first, siblings by category, display order and key. path sorts like that traversal; errors tells of repeated ids and cycles."""
    rank = F.when(F.col("category") == "object", 1).when(F.col("category") == "text_raster", 2).otherwise(0)
    src = repaired(layers, key, parent).withColumn("_rank", rank)
    return paths(src, key, parent, ["_rank", "display_order"])


def in_cycle(layers: DataFrame, key: str = "id", parent: str = "parent") -> DataFrame:
    """Layers that hang on no root."""
    return layers.join(paths(repaired(layers, key, parent), key, parent).select(key), key, "left_anti")


def descendants(layers: DataFrame, key: str = "id", parent: str = "parent", most: int = 64) -> DataFrame:
    """(ancestor, descendant, distance) of all layers below each layer."""
    links = layers.where(F.col(parent).isNotNull()).select(F.col(parent).alias("p"), F.col(key).alias("c"))
    level = links.select(F.col("p").alias("ancestor"), F.col("c").alias("descendant"), F.lit(1).alias("distance"))
    out = level
    for distance in range(2, most):
        level = _cut(level.join(links, F.col("descendant") == F.col("p")).select("ancestor", F.col("c").alias("descendant"), F.lit(distance).alias("distance")), "descend")
        if not level.limit(1).count():
            return out
        out = out.union(level)
    raise ValueError(f"deeper than {most} levels")
