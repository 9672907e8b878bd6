"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014).

Each round is a grouped minimum and a join, so a hub with a third of all edges is never collected.
Lineage is cut every round with a checkpoint in the cluster's shared folder.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
    return tuple(row)


def connected_components(edges: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node."""
    ensure_checkpoint_dir(edges.sparkSession)
    base = edges.select(F.col(left).alias("a"), F.col(right).alias("b"))
    nodes = base.select(F.col("a").alias("node")).union(base.select("b")).distinct()
    current = base.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    before = None
    for _ in range(max_rounds):
        # large star: every larger neighbour links to the smallest node of the neighbourhood
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: the node and its smaller neighbours link to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        current = linked.filter("a <> b").distinct().checkpoint()
        now = _signature(current)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(current.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component"))


def key_edges(df: DataFrame, row: str, keys: list[str]) -> DataFrame:
    """One edge from each row to the lowest row sharing a key: linear in rows, no pairs inside a group."""
    out = None
    for key in keys:
        first = df.groupBy(key).agg(F.min(row).alias("_low"))
        part = df.select(row, key).join(first, key).select(F.col(row).alias("a"), F.col("_low").alias("b"))
        out = part if out is None else out.unionByName(part)
    return out


def set_digest(members: DataFrame, component: str, member: str) -> DataFrame:
    """Digest of a component's member set from a mergeable sum, so no member list is built."""
    head = F.conv(F.substring(F.sha2(F.col(member).cast("string"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return members.groupBy(component).agg(
        F.sha2(F.concat_ws(":", F.sum(head).cast("string"), F.count(F.lit(1)).cast("string")), 256).alias("digest"),
        F.count(F.lit(1)).alias("size"))


def merged_components(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) of the given classes (node, component) joined by further edges (a, b) between their nodes.

    Only the classes that an edge connects go through the rounds, not their members.
    """
    of = lambda end: classes.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
    between = edges.join(of("a"), "a").join(of("b"), "b").filter("ca <> cb").select("ca", "cb").distinct()
    joined = connected_components(between, "ca", "cb").withColumnRenamed("component", "_to")
    return classes.join(joined.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
