"""Two snapshots compared: set differences both ways, full outer joins on keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.graph import impact_sizes


def changed_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change): removed (in a alone) and added (in b alone)."""
    gone = a.select(*keys).distinct().join(b.select(*keys).distinct(), keys, "left_anti").withColumn("change", F.lit("removed"))
    new = b.select(*keys).distinct().join(a.select(*keys).distinct(), keys, "left_anti").withColumn("change", F.lit("added"))
    return gone.union(new)


def edge_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """(src, dst, change) of edges with a flag `deferred`: added, removed, or changed where the flag flips."""
    x = a.select("src", "dst", F.col("deferred").alias("da"), F.lit(True).alias("in_a"))
    y = b.select("src", "dst", F.col("deferred").alias("db"), F.lit(True).alias("in_b"))
    both = x.join(y, ["src", "dst"], "full")
    change = F.when(F.col("in_b").isNull(), "removed").when(F.col("in_a").isNull(), "added").when(F.col("da") != F.col("db"), "changed")
    return both.select("src", "dst", change.alias("change")).where("change is not null")


def count_changes(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, before, after, delta) where a count differs in both snapshots."""
    both = a.select(key, F.col(value).alias("before")).join(b.select(key, F.col(value).alias("after")), key)
    return both.withColumn("delta", F.col("after") - F.col("before")).where("delta != 0")


def impact_changes(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame], exact: bool = True) -> DataFrame:
    """(node, before, after, delta) of nodes of both snapshots (edges, nodes) on which another number of nodes depends."""
    sizes = lambda edges, nodes: nodes.select("node").distinct().join(impact_sizes(edges, exact), "node", "left").select("node", F.coalesce("impact", F.lit(0)).alias("impact"))
    return count_changes(sizes(*a), sizes(*b), "node", "impact")


def cycle_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """(members, change) of cycles (node, component), compared by their sorted members."""
    names = lambda c: c.groupBy("component").agg(F.array_join(F.array_sort(F.collect_list("node")), ",").alias("members")).select("members")
    return changed_keys(names(a), names(b), ["members"])


def comparable(schema_a: int, schema_b: int, edges_a: int, edges_b: int) -> bool:
    """False where an old snapshot (schema below 2) has no edges to compare."""
    return not ((schema_a < 2 and not edges_a) or (schema_b < 2 and not edges_b))
