"""Graph operators over edges (src, dst): walks, closures, shortest paths, components, layers.

Loops run on the driver but hold only a plan: each round's frontier is written to the shared folder, joined with the
edges and reduced by an anti join; only a count of new rows reaches the driver. Chains are followed by pointer doubling,
components from many pivots at once, and what reaches a node is passed on as bitmaps, layer by layer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.session import counted, dropped, stored

ROUNDS = 10_000


def turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(turned(edges)).distinct()


def walk(edges: DataFrame, seeds: DataFrame, depth: int | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, node, d): nodes reachable from seeds (keys, node), with the least number of steps; seeds have 0.

    depth bounds the walk; without it the walk ends when nothing new is met, and it is an error if ROUNDS steps do not
    suffice. keys keep walks apart, e.g. by seed. A round is one job: what is new is written and counted at once.
    """
    names = [*keys, "node"]
    links = stored(edges.select("src", "dst").distinct(), "links")
    frontier = stored(seeds.select(*names).distinct().withColumn("d", F.lit(0)), "walk")
    levels, seen = [frontier], frontier
    for d in range(1, (ROUNDS if depth is None else depth) + 1):
        met = frontier.join(links, F.col("node") == F.col("src")).select(*keys, F.col("dst").alias("node")).distinct()
        fresh, many = counted(met.join(seen.select(*names), names, "left_anti").withColumn("d", F.lit(d)), "walk")
        if not many:
            return seen
        levels.append(fresh)
        frontier, seen = fresh, seen.unionByName(fresh)
        if len(levels) % 12 == 0:
            seen = stored(seen, "seen")
            old, levels = levels, [seen]
            dropped(*[x for x in old if x is not frontier])
    if depth is None:
        raise RuntimeError(f"the walk did not end in {ROUNDS} rounds")
    return seen


def impact(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, d, direct) of all that depends on the seeds, over reversed edges; direct where one step suffices."""
    found = walk(turned(edges), seeds)
    return found.where("d > 0").select("node", "d", (F.col("d") == 1).alias("direct"))


def condensed(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, component) of every node, its own where it is on no cycle; and the edges (src, dst) between components, without cycles."""
    loops = cycles(edges)
    names = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    of = stored(names.join(loops, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "condensed")
    one, two = of.select(F.col("node").alias("src"), F.col("component").alias("a")), of.select(F.col("node").alias("dst"), F.col("component").alias("b"))
    between = edges.select("src", "dst").distinct().join(one, "src").join(two, "dst").where("a != b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    return of, stored(between, "between")


def placed(rows: DataFrame, order: list, name: str = "place") -> DataFrame:
    """rows with their place in a total order, from 0: a range-partitioned sort, a partition's offset, the index within it."""
    kept = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_id", 33).cast("int")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition of the sort
    starts = kept.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_many")).select("_part", F.coalesce(F.sum("_many").over(before), F.lit(0)).alias("_start"))
    at = F.col("_start") + F.col("_id").bitwiseAND((1 << 33) - 1)
    return kept.withColumn("_part", part).join(F.broadcast(starts), "_part").select(*rows.columns, at.alias(name))


def reach(edges: DataFrame, exact: bool = True) -> tuple[DataFrame, DataFrame]:
    """(node, component), and (component, word, bits) of the nodes with a path to a component, its own included.

    Nodes are numbered along the layers of the condensed graph; a set of nodes is a row for each word of 64 numbers that
    has any. A layer takes the words of what points at it, merged by a bitwise or, so each edge passes its words on
    once and no seed is walked. With exact=False the sets are sketches (HyperLogLog, about 2 % off) of one row a component:
    for graphs in which nodes times reached nodes over 64 is too much.
    """
    of, between = condensed(edges)
    layers, last = _longest(of.select(F.col("component").alias("node")).distinct(), between)
    merge = (lambda c: F.bit_or(c)) if exact else (lambda c: F.hll_union_agg(c))
    numbered = placed(of.join(layers.withColumnRenamed("node", "component"), "component"), ["layer", "component", "node"])
    fold = F.bit_or(F.expr("shiftleft(1L, cast(place % 64 AS int))")) if exact else F.hll_sketch_agg("node", 12)
    word = F.expr("place div 64") if exact else F.lit(0).cast("long")
    own = stored(numbered.groupBy("layer", "component", word.alias("word")).agg(fold.alias("bits")), "own")
    into = stored(between.join(layers.withColumnRenamed("node", "dst"), "dst"), "into")
    seen = own.where("layer = 0").select("component", "word", "bits")
    for layer in range(1, last + 1):
        come = into.where(F.col("layer") == layer).join(seen, F.col("src") == F.col("component")).select(F.col("dst").alias("component"), "word", "bits")
        here = own.where(F.col("layer") == layer).select("component", "word", "bits").unionByName(come)
        seen = seen.unionByName(stored(here.groupBy("component", "word").agg(merge("bits").alias("bits")), "reach"))
    return of, seen


def _many(exact: bool):
    """The size of a set, over its words; of a sketch the estimate."""
    return F.sum(F.bit_count("bits")).cast("long") if exact else F.max(F.hll_sketch_estimate("bits"))


def impact_sizes(edges: DataFrame, exact: bool = True) -> DataFrame:
    """(node, impact): how many other nodes depend on each node, directly or not."""
    of, words = reach(edges, exact)
    return of.join(words.groupBy("component").agg(_many(exact).alias("n")), "component").select("node", F.greatest(F.col("n") - 1, F.lit(0)).alias("impact"))


def impact_counts(edges: DataFrame, seeds: DataFrame, key: str) -> DataFrame:
    """(key, impacted): how many nodes depend on any seed (key, node) of a key, the seeds counted.

    The bitmaps of a key's components are merged; nothing is walked for a key. Seeds that no edge has count themselves.
    """
    of, words = reach(edges)
    seeds = seeds.select(key, "node").distinct()
    at = seeds.join(of, "node").select(key, "component").distinct()
    merged = at.join(words, "component").groupBy(key, "word").agg(F.bit_or("bits").alias("bits")).select(key, F.bit_count("bits").alias("n"))
    alone = seeds.join(of, "node", "left_anti").select(key, F.lit(1).alias("n"))
    return merged.unionByName(alone).groupBy(key).agg(F.sum("n").cast("long").alias("impacted"))


def shortest_path(edges: DataFrame, start: DataFrame | str, end: DataFrame | str) -> DataFrame:
    """(step, src, dst, and what else edges have) of a shortest path between two nodes, or one-row frames (node); no rows if there is none or both are one.

    The walk keeps a parent for each node, the least that is one step nearer, and stops at the end. Parents are then
    doubled (2, 4, 8 ... steps back), and the nodes of the path are those met by any sum of such leaps from the end: the path
    is read in a number of joins that grows with the logarithm of its length.
    """
    start, end = (edges.sparkSession.createDataFrame([(x,)], "node string") if isinstance(x, str) else x for x in (start, end))
    links = stored(edges.groupBy("src", "dst").agg(*[F.min(c).alias(c) for c in edges.columns if c not in ("src", "dst")], F.count(F.lit(1)).alias("_n")).drop("_n"), "links")
    seen = frontier = stored(start.select("node", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("d")), "walk")
    goal, d = stored(end.select("node"), "goal"), 0
    while not (met := frontier.join(goal, "node", "left_semi")).limit(1).count():
        d += 1
        found = frontier.join(links, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        frontier, many = counted(found.join(seen.select("node"), "node", "left_anti").withColumn("d", F.lit(d)), "walk")
        if not many:
            return links.limit(0).select(F.lit(0).alias("step"), "*")
        seen = seen.unionByName(frontier) if d % 12 else stored(seen.unionByName(frontier), "walk")
    leap = stored(seen.where("parent is not null").select("node", F.col("parent").alias("back")), "leaps")
    leaps = [leap]
    while 1 << len(leaps) <= d:
        further = leap.select(F.col("node").alias("back"), F.col("back").alias("past"))
        leap = stored(leap.join(further, "back").select("node", F.col("past").alias("back")), "leaps")
        leaps.append(leap)
    on = met.select("node")
    for leap in reversed(leaps):
        on = stored(on.union(on.join(leap, "node").select(F.col("back").alias("node"))), "path")
    path = seen.join(on.distinct(), "node").where("parent is not null").select(F.col("d").alias("step"), F.col("parent").alias("src"), F.col("node").alias("dst"))
    return path.join(links, ["src", "dst"]).select("step", *links.columns)


def _chains(links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(node, a, b) of nodes inside chains from a to b; (node, component) of rings that nothing else touches; the edges without both.

    Nodes with one edge in and one out are followed by pointer doubling: rounds grow with the logarithm of the longest chain.
    A chain's edges give way to one edge from a to b.
    """
    ins = links.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("ins"), F.min("src").alias("prev"))
    outs = links.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("outs"), F.min("dst").alias("next"))
    inner = stored(ins.join(outs, "node").where("ins = 1 and outs = 1").select("node", "prev", "next"), "inner")
    names = inner.select(F.col("node").alias("to"))
    at = stored(inner.join(names.withColumnRenamed("to", "next").withColumn("on", F.lit(True)), "next", "left").select("node", F.col("next").alias("to"), F.col("node").alias("last"), F.col("node").alias("least"), F.coalesce("on", F.lit(False)).alias("on")), "chains")
    while True:
        past = at.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("last").alias("last2"), F.col("least").alias("least2"), F.col("on").alias("on2"))
        joined = at.where("on").join(past, "to").select("node", F.col("to2").alias("to"), F.col("last2").alias("last"), F.least("least", "least2").alias("least"), F.col("on2").alias("on"), (~F.col("on2") | (F.col("least2") < F.col("least"))).alias("moved"))
        seen = Observation()
        after = stored(joined.unionByName(at.where("not on").withColumn("moved", F.lit(False))).observe(seen, F.count_if("moved").alias("n")).drop("moved"), "chains")
        moved = seen.get["n"]
        dropped(at)
        at = after
        if not moved:
            break
    rings = at.where("on").select("node", F.col("least").alias("component"))
    inside = at.where("not on").select("node", "last", F.col("to").alias("b"))
    heads = inside.join(inner, "node").join(names.withColumnRenamed("to", "prev"), "prev", "left_anti").select("last", F.col("prev").alias("a"))
    chains = stored(inside.join(heads, "last").select("node", "a", "b"), "inside")
    short = links.join(names.withColumnRenamed("to", "src"), "src", "left_anti").join(names.withColumnRenamed("to", "dst"), "dst", "left_anti")
    return chains, stored(rings, "rings"), short.select("src", "dst").union(chains.select("a", "b")).where("src != dst").distinct()


def settled(at: DataFrame, ways: DataFrame, cols: dict[str, str], name: str, hops: int = 5) -> DataFrame:
    """Each node's columns, merged along ways (x, y, ...) again and again until nothing changes.

    cols: column -> the SQL aggregate of what ways bring to y. ways hold x = y for every node, so a step is one join and
    one group-by, and several steps are one job; a node that stays as it was keeps its hash.
    """
    at, names = stored(at, name), ", ".join(cols)
    step = f"SELECT y AS node, {', '.join(f'{made} AS {c}' for c, made in cols.items())}, bit_or(if(x = y, _was, 0L)) AS _was FROM {{ways}} JOIN (%s) ON x = node GROUP BY y"
    text = f"SELECT *, xxhash64({names}) AS _was FROM {{at}}"
    for _ in range(hops):
        text = step % text
    while True:
        seen = Observation()
        after = at.sparkSession.sql(text, at=at, ways=ways).observe(seen, F.count_if(F.xxhash64(*cols) != F.col("_was")).alias("n"))
        after = stored(after.drop("_was"), name)
        moved = seen.get["n"]
        dropped(at)
        at = after
        if not moved:
            return at


def _by_pivots(edges: DataFrame, words: int = 4) -> DataFrame:
    """(node, component) of all nodes of edges; component is any name that its nodes share.

    Each part of the graph has up to 64 pivots a word, the least of each bucket by a hash. All pivots' forward and backward
    sets grow at once, a bit for each pivot. Nodes with a bit in both are one component with all that have the same
    words; the others fall into parts by their words, as a component never does, and edges between parts go. Where a
    part has fewer nodes than pivots nearly all are found at once, so phases are few.
    """
    fore, back = [f"f{k}" for k in range(words)], [f"b{k}" for k in range(words)]
    (left, many), parts, phase = counted(edges.withColumn("part", F.lit(0).cast("long")), "left"), [], 0
    while many:
        phase += 1
        nodes = left.select(F.explode(F.array("src", "dst")).alias("node"), "part").distinct()
        hashed = F.xxhash64("node", F.lit(phase))
        pivots = nodes.groupBy("part", F.pmod(hashed, F.lit(64 * words)).cast("int").alias("bucket")).agg(F.min_by("node", F.struct(hashed, "node")).alias("node")).select("node", "bucket")
        bits = [F.expr(f"if(coalesce(bucket div 64, -1) = {k}, shiftleft(1L, bucket % 64), 0L)") for k in range(words)]
        at = nodes.join(pivots, "node", "left").select("node", "part", *[b.alias(c) for side in (fore, back) for b, c in zip(bits, side, strict=True)])
        way = lambda x, y, f, b: F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.lit(f).cast("long").alias("f"), F.lit(b).cast("long").alias("b"))
        ways = stored(left.select(F.explode(F.array(way("src", "dst", -1, 0), way("dst", "src", 0, -1), way("src", "src", -1, -1), way("dst", "dst", -1, -1))).alias("w")).select("w.*").distinct(), "ways")
        cols = {"part": "max(part)"} | {c: f"bit_or({c} & {side})" for side, names in (("f", fore), ("b", back)) for c in names}
        at = settled(at, ways, cols, "pivots")
        dropped(ways)
        both = F.expr(" or ".join(f"{f} & {b} != 0" for f, b in zip(fore, back, strict=True)))
        parts.append(at.where(both).select("node", F.concat_ws("/", F.lit(phase), "part", *fore, *back).alias("component")))
        rest = at.where(~both).select("node", F.xxhash64("part", *fore, *back).alias("p"))
        left, many = counted(left.join(rest.toDF("src", "p"), "src").join(rest.toDF("dst", "q"), "dst").where("p = q").select("src", "dst", F.col("p").alias("part")), "left")
    out = edges.sparkSession.createDataFrame([], "node string, component string")
    for p in parts:
        out = out.unionByName(p)
    return out


def _trimmed(links: DataFrame, least: float = 0.1) -> DataFrame:
    """links without those of nodes that nothing leads to or that lead nowhere, again and again while a round takes the share `least` of what is left: such nodes are on no cycle."""
    links, many = counted(links, "trimmed")
    while many:
        ends = links.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(links.select("dst", F.lit(0), F.lit(1)))
        loose = ends.groupBy("node").agg(F.max("o").alias("o"), F.max("i").alias("i")).where("o + i < 2").select("node")
        left, n = counted(links.join(loose.toDF("src"), "src", "left_anti").join(loose.toDF("dst"), "dst", "left_anti"), "trimmed")
        dropped(links)
        links, gone, many = left, many - n, n
        if gone < least * (gone + many):
            break
    return links


def cycles(edges: DataFrame) -> DataFrame:
    """(node, component) of strongly connected components of two nodes or more; component is the least node.

    What hangs loose is trimmed and chains are contracted first, so a long ring takes few rounds; then many pivots at once split the rest. A chain's nodes are
    of a component if both its ends are.
    """
    links = _trimmed(edges.where("src != dst").select("src", "dst").distinct())
    chains, rings, short = _chains(links)
    core = stored(_by_pivots(short), "components")
    named = core.unionByName(chains.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(core, "node", "left_anti").select("node", F.concat(F.lit("="), "node").alias("component")))
    one, two = named.toDF("a", "component"), named.toDF("b", "other")
    along = chains.join(one, "a").join(two, "b").where("component = other").select("node", "component")
    found = stored(named.unionByName(along), "members")
    groups = found.groupBy("component").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("many")).where("many > 1")
    return found.join(groups, "component").select("node", F.col("least").alias("component")).unionByName(rings)


def _longest(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, int]:
    """(node, layer) by the longest path that ends at a node of a graph without cycles, and the last layer."""
    ways = stored(links.select(F.col("src").alias("x"), F.col("dst").alias("y")).union(nodes.select("node", "node")), "ways")
    at = settled(nodes.select("node", F.lit(0).alias("layer")), ways, {"layer": "max(layer + if(x = y, 0, 1))"}, "layers")
    return at, at.agg(F.max("layer")).head()[0] or 0


def layers(edges: DataFrame) -> DataFrame:
    """(node, layer): the longest path that ends at the node, over edges that are not on cycles."""
    loops = cycles(edges)
    one, two = loops.toDF("src", "a"), loops.toDF("dst", "b")
    links = edges.select("src", "dst").where("src != dst").distinct().join(one, "src", "left").join(two, "dst", "left").where("a is null or b is null or a != b").select("src", "dst")
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return _longest(nodes, stored(links, "links"))[0]


def signed_layers(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, layer): steps out are positive, steps in negative; the outward side claims nodes that both reach."""
    out = walk(edges, seeds, depth)
    back = walk(turned(edges), seeds, depth).join(out.select("node"), "node", "left_anti")
    return out.select("node", F.col("d").alias("layer")).union(back.select("node", -F.col("d")))


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """(node, d) within so many steps in either direction."""
    return walk(both_ways(edges), seeds, hops)


def weights(calls: DataFrame) -> DataFrame:
    """(src, dst, n): distinct call edges between two different modules."""
    return calls.where("src != dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def tree_walk(nodes: DataFrame, seeds: DataFrame, most: int, deep: int = 64) -> DataFrame:
    """(node, d): the subtrees below seeds (node), nearest first, then in order; the first `most` of them."""
    below = nodes.where("parent_id is not null").select(F.col("parent_id").alias("src"), F.col("node_id").alias("dst"))
    found = walk(below, seeds, deep)
    return found.join(nodes.select(F.col("node_id").alias("node"), "ord"), "node").orderBy("d", "ord", "node").limit(most).select("node", "d")
