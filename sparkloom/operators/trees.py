"""Trees by interval labels: every node's place in a walk in and out of all nodes, found by pointer doubling.

What lies below a node is then a range of places, whatever the depth: subtree sums are differences of running sums, and no
node is paired with its ancestors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.operators.graph import placed
from sparkloom.session import dropped, stored

#: Places that one window sums: 2 to this power. Doublings at most: a walk of 2^60 places.
RUN_BITS, DOUBLINGS = 12, 60


def labels(nodes: DataFrame) -> DataFrame:
    """(node_id, enter, place) of nodes (node_id, parent_id, ord): a row where the walk enters a node and one where it leaves it.

    The walk goes through children in order of ord and node_id, and through several roots one after the other; a parent that
    is no node makes a root. Each place points at the next; pointers are doubled, so jobs grow with the logarithm of
    the number of nodes and not with the depth. A parent that is its own descendant is an error.
    """
    known = nodes.select(F.col("node_id").alias("parent_id")).distinct()
    rows = nodes.select("node_id", "parent_id", "ord").join(known.withColumn("_has", F.lit(True)), "parent_id", "left")
    rows = stored(placed(rows.select("node_id", F.when(F.col("_has"), F.col("parent_id")).alias("parent_id"), "ord"), ["parent_id", "ord", "node_id"], "at"), "siblings")
    first = rows.where("parent_id is not null").groupBy(F.col("parent_id").alias("node_id")).agg(F.min_by("node_id", "at").alias("child"))
    after = rows.select((F.col("at") - 1).alias("at"), F.col("node_id").alias("sibling"), F.col("parent_id").alias("same"))
    both = rows.join(first, "node_id", "left").join(after, "at", "left")
    into = lambda c: F.concat(F.lit("("), c)
    out = lambda c: F.concat(F.lit(")"), c)
    beside = F.when(F.col("same").eqNullSafe(F.col("parent_id")), into("sibling"))
    steps = F.array(F.struct(into("node_id").alias("event"), F.coalesce(into("child"), out("node_id")).alias("to")), F.struct(out("node_id").alias("event"), F.coalesce(beside, out("parent_id")).alias("to")))
    at = stored(both.select(F.explode(steps).alias("s")).select("s.event", "s.to", F.col("s.to").isNotNull().cast("long").alias("left")), "walk")
    for _ in range(DOUBLINGS // 2):
        further = at
        for _ in range(2):
            past = further.select(F.col("event").alias("to"), F.col("to").alias("to2"), F.col("left").alias("left2"))
            further = further.join(past, "to", "left").select("event", F.col("to2").alias("to"), (F.col("left") + F.coalesce("left2", F.lit(0))).alias("left"))
        seen = Observation()
        more = stored(further.observe(seen, F.count_if(F.col("to").isNotNull()).alias("n")), "walk")
        going = seen.get["n"]
        dropped(at)
        at = more
        if not going:
            break
    else:
        raise ValueError("a node is its own ancestor")
    last = at.agg(F.max("left").alias("_last"))  # one row
    return at.join(F.broadcast(last)).select(F.substring("event", 2, 1 << 30).alias("node_id"), F.col("event").startswith("(").alias("enter"), (F.col("_last") - F.col("left")).alias("place"))


def running(rows: DataFrame, folds: dict, inclusive: bool = False) -> DataFrame:
    """rows (place, ...) with, by name, (column, aggregate) of all rows at smaller places (and the own, if inclusive).

    Windows stay within runs of 4,096 places; what the runs before add is folded over one row a run.
    """
    inside = Window.partitionBy("_run").orderBy("place").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    earlier = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)  # a row for each run
    dealt = rows.withColumn("_run", F.shiftright("place", RUN_BITS))
    whole = dealt.groupBy("_run").agg(*[fold(c).alias(f"_{n}") for n, (c, fold) in folds.items()])
    starts = whole.select("_run", *[fold(f"_{n}").over(earlier).alias(f"_{n}") for n, (_, fold) in folds.items()])
    own = dealt.select("*", *[fold(c).over(inside).alias(n) for n, (c, fold) in folds.items()])
    join = {n: F.coalesce(F.col(n) + F.col(f"_{n}"), n, f"_{n}") if fold is F.sum else F.greatest(n, f"_{n}") for n, (_, fold) in folds.items()}
    return own.join(starts, "_run").select(*rows.columns, *[j.alias(n) for n, j in join.items()])


def subtree_sums(nodes: DataFrame, stats: DataFrame, columns: list[str]) -> DataFrame:
    """(node_id, columns): each node's own stats (node_id, columns; a row a node at most) and those of all below it, 0 where there are none."""
    walk = labels(nodes)
    own = walk.join(stats.withColumn("enter", F.lit(True)), ["node_id", "enter"], "left").select("node_id", "enter", "place", *[F.coalesce(c, F.lit(0)).alias(c) for c in columns])
    sums = running(own, {f"{c}_before": (c, F.sum) for c in columns})
    side = F.when(F.col("enter"), -1).otherwise(1)
    return sums.groupBy("node_id").agg(*[F.sum(side * F.coalesce(f"{c}_before", F.lit(0))).alias(c) for c in columns])


def ancestor_at(nodes: DataFrame, depth: int) -> DataFrame:
    """(node_id, group_id): the ancestor at a depth, or the node itself above it.

    It is the node of that depth which the walk has entered last, so a running maximum finds it.
    """
    walk = labels(nodes).where("enter").join(nodes.select("node_id", "depth"), "node_id")
    tops = walk.withColumn("top", F.when(F.col("depth") == depth, F.struct("place", "node_id")))
    found = running(tops, {"last": ("top", F.max)}, inclusive=True)
    return found.select("node_id", F.when(F.col("depth") >= depth, F.col("last.node_id")).otherwise(F.col("node_id")).alias("group_id"))
