"""Views and panels: rows that commands, pages and tools show, made of the other operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions.scalar import dotted_prefixes
from sparkloom.operators import graph
from sparkloom.session import stored

#: The tags that are read: name, origin, scope, whether it repeats.
TAGS = (
    ("module", "luals", "module", False), ("meta", "luals", "module", False), ("param", "luals", "function", True), ("return", "luals", "function", True),
    ("generic", "luals", "function", True), ("overload", "luals", "function", True), ("deprecated", "luals", "function", False), ("async", "luals", "function", False),
    ("nodiscard", "luals", "function", False), ("see", "luals", "function", True), ("internal", "own", "function", False), ("todo", "own", "function", True),
    ("bug", "own", "function", True), ("test", "own", "function", True), ("since", "own", "function", False), ("example", "own", "function", False),
    ("class", "luals", "type", False), ("field", "luals", "type", True), ("alias", "luals", "type", False), ("enum", "luals", "type", False), ("type", "luals", "type", False),
)
#: Fixed value: the most nodes of a graph that is drawn.
DRAWN = 90


def tag_table(spark) -> DataFrame:
    """(tag, origin, scope, repeats): the tags as a dimension."""
    return spark.createDataFrame(list(TAGS), "tag string, origin string, scope string, repeats boolean")


def tag_use(tags: DataFrame) -> DataFrame:
    """(tag, origin, scope, uses, files) for every known tag, zeros kept; tags as doc_tags() gives them."""
    seen = tags.groupBy("tag").agg(F.count(F.lit(1)).alias("uses"), F.countDistinct("node_id").alias("files"))
    return F.broadcast(tag_table(tags.sparkSession)).join(seen, "tag", "left").select("tag", "origin", "scope", F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("files", F.lit(0)).alias("files"))


def notes(tags: DataFrame, markers: DataFrame) -> DataFrame:
    """(node_id, line, kind, text): what authors left in tags and in markers, one list."""
    left = tags.where(F.col("tag").isin("todo", "bug", "test", "deprecated")).select("node_id", "line", F.upper("tag").alias("kind"), F.col("value").alias("text"))
    return left.unionByName(markers.select("node_id", "line", "kind", "text"))


def structure(nodes: DataFrame, fns: DataFrame) -> DataFrame:
    """(parent, at, kind, label): for each node its children in order, then its functions by line; at counts from 1."""
    below = nodes.where("parent_id is not null").select(F.col("parent_id").alias("parent"), F.lit(0).alias("g"), F.col("ord").alias("o"), "kind", F.col("name").alias("label"))
    own = fns.select(F.col("node_id").alias("parent"), F.lit(1).alias("g"), F.col("line").cast("long").alias("o"), F.lit("function").alias("kind"), F.col("fn_name").alias("label"))
    w = Window.partitionBy("parent").orderBy("g", "o", "label")
    return below.unionByName(own).withColumn("at", F.row_number().over(w)).select("parent", "at", "kind", "label")


def glossary(words: DataFrame, entries: DataFrame, keywords: DataFrame, methods: str | None = None) -> DataFrame:
    """(word, key, kind): the longest dotted prefix among entries (key), else a bare word among keywords (key).

    `x:name` looks up `methods`.name only, where the language has such a namespace. Words without an answer give no row.
    """
    trimmed = words.select(F.regexp_replace("word", r"[.:]+$", "").alias("word")).where("word != ''").distinct()
    method = F.regexp_extract("word", r"^[A-Za-z0-9_.]*:([A-Za-z0-9_]+)$", 1)
    rows = trimmed.withColumn("m", method).withColumn("asked", F.when(F.col("m") == "", F.col("word")).otherwise(F.concat_ws(".", F.lit(methods), F.col("m")) if methods else F.lit(None).cast("string")))
    each = rows.select("word", F.explode(F.when(F.col("m") == "", dotted_prefixes(F.col("asked"))).otherwise(F.array("asked"))).alias("key"))
    std = each.join(entries.select("key").distinct(), "key").groupBy("word").agg(F.max_by("key", F.length("key")).alias("key")).withColumn("kind", F.lit("stdlib"))
    bare = trimmed.where(~F.contains("word", F.lit(".")) & ~F.contains("word", F.lit(":"))).join(std.select("word"), "word", "left_anti")
    return std.unionByName(bare.join(keywords.select(F.col("key").alias("word")).distinct(), "word").select("word", F.col("word").alias("key"), F.lit("keyword").alias("kind")))


def repository_links(external: DataFrame, repositories: DataFrame, linked: DataFrame) -> DataFrame:
    """(module, url) of external modules not linked yet, by the longest prefix of repositories (prefix, base, root)."""
    from sparkloom.operators.resolve import longest_prefix

    left = external.select("module").distinct().join(linked.select("module").distinct(), "module", "left_anti")
    met = longest_prefix(left, repositories.select("prefix", F.concat_ws("/", "base", "root").alias("target"))).where("target is not null")
    return met.select("module", F.concat(F.col("target"), F.lit("/"), F.replace("module", F.lit("."), F.lit("/")), F.lit(".lua")).alias("url"))


def handled(endpoints: DataFrame, fns: DataFrame) -> DataFrame:
    """endpoints (node_id, handler, ...) with fn_key and documented of the function of that name in the node; null if none."""
    index = fns.groupBy("node_id", F.col("fn_name").alias("handler")).agg(F.min_by(F.struct("fn_key", "documented"), "k").alias("x")).select("node_id", "handler", "x.fn_key", "x.documented")
    return endpoints.join(index, ["node_id", "handler"], "left")


def checked_refs(items: DataFrame, nodes: DataFrame) -> DataFrame:
    """(file, cited, resolved, unresolved): references of checklist items against the paths of nodes."""
    paths = nodes.select(F.col("path").alias("ref")).distinct().withColumn("there", F.lit(True))
    met = items.join(paths, "ref", "left")
    return met.groupBy("file").agg(F.count("ref").alias("cited"), F.count("there").alias("resolved"), F.sum((F.col("ref").isNotNull() & F.col("there").isNull()).cast("long")).alias("unresolved"))


def why(edges: DataFrame, start: str, end: str) -> DataFrame:
    """(step, src, dst, deferred, lazy) of a shortest path; lazy where any step of the path is deferred."""
    path = graph.shortest_path(edges, start, end).select("step", "src", "dst")
    flags = edges.groupBy("src", "dst").agg(F.bool_and("deferred").alias("deferred"))
    return path.join(flags, ["src", "dst"]).withColumn("lazy", F.bool_or("deferred").over(Window.partitionBy(F.lit(0)))).select("step", "src", "dst", "deferred", "lazy")


def drawn_layers(edges: DataFrame, seeds: DataFrame, depth: int | None = None, most: int = DRAWN) -> DataFrame:
    """(node, layer, truncated): signed layers moved to begin at 0; the `most` nearest nodes, and whether others were left out."""
    found = stored(graph.signed_layers(edges, seeds, depth), "drawn")
    near = found.orderBy(F.abs("layer"), F.desc("layer"), "node").limit(most)
    return near.select("node", (F.col("layer") - F.min("layer").over(Window.partitionBy(F.lit(0)))).alias("layer"), F.lit(found.count() > most).alias("truncated"))


def families(edges: DataFrame) -> DataFrame:
    """(node, family, layer) of an inheritance graph (src extends dst): the least node of the component, and the longest path above.

    Nodes on a cycle add nothing to a path. Labels halve their way by rounds of least neighbours, each written down.
    """
    links = stored(graph.both_ways(edges.where("src != dst")), "links")
    names = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    labels = stored(names.withColumn("family", F.col("node")), "labels")
    while True:
        sent = links.join(labels, F.col("src") == F.col("node")).select(F.col("dst").alias("node"), "family")
        least = labels.union(sent).groupBy("node").agg(F.min("family").alias("family"))
        jump = stored(least, "least")
        of = jump.select(F.col("node").alias("family"), F.col("family").alias("top"))
        after = stored(jump.join(of, "family").select("node", F.least("family", "top").alias("family")), "labels")
        if after.join(labels, ["node", "family"], "left_anti").isEmpty():
            break
        labels = after
    return labels.join(graph.layers(graph.turned(edges)), "node")


def external_leaves(layers: DataFrame, external: DataFrame) -> DataFrame:
    """(node, layer, src): external modules of the nodes drawn, one layer below the deepest."""
    deepest = layers.agg((F.max("layer") + 1).alias("layer"))
    met = external.join(layers.select(F.col("node").alias("node_id")), "node_id", "left_semi").select("node_id", "module").distinct()
    return met.join(F.broadcast(deepest)).select(F.concat(F.lit("ext:"), F.col("module")).alias("node"), "layer", F.col("node_id").alias("src"))  # deepest is one row


def external_weights(calls: DataFrame) -> DataFrame:
    """(node_id, module, n): calls out of the tree (node_id, module, cnt), summed."""
    return calls.groupBy("node_id", "module").agg(F.sum("cnt").alias("n"))


def positions(layers: DataFrame, width: int = 180, height: int = 90) -> DataFrame:
    """(node, x, y): nodes of a layer side by side, by name."""
    at = F.row_number().over(Window.partitionBy("layer").orderBy("node")) - 1
    return layers.select("node", (at * width).cast("long").alias("x"), (F.col("layer") * height).cast("long").alias("y"))


def load_states(plugins: DataFrame) -> DataFrame:
    """plugins (repo, lazy, triggers array) with state and twice: startup (not lazy, no triggers), trigger (any), ondemand (lazy, none)."""
    state = F.when(F.size("triggers") > 0, "trigger").when(F.col("lazy"), "ondemand").otherwise("startup")
    return plugins.withColumn("state", state).withColumn("twice", F.count(F.lit(1)).over(Window.partitionBy("repo")) > 1)


def trigger_index(plugins: DataFrame) -> DataFrame:
    """(trigger, repos): what each trigger loads, sorted."""
    return plugins.select("repo", F.explode("triggers").alias("trigger")).groupBy("trigger").agg(F.array_join(F.array_sort(F.collect_set("repo")), ",").alias("repos"))


def history_rollup(hit: DataFrame, hunks: DataFrame, calls: DataFrame, each: int = 750_000) -> DataFrame:
    """(sha, files, touched, callers): files changed, functions touched, and functions that call those, none of which is touched.

    Commits fall into lots of about `each` hunks, by ranges where a commit's key is a number, as neighbours touch the same functions.
    A function's callers are a list that goes to a lot once, with the commits of the lot that touch it, and a commit's lists
    are united where they arrive: no row for each commit and caller is ever sent.
    """
    files = hunks.select("sha", "path").repartition("sha").groupBy("sha").agg(F.countDistinct("path").alias("files"))
    ranges = dict(hunks.dtypes)["sha"] in ("tinyint", "smallint", "int", "bigint")
    lots = max(1, round(hunks.count() / each))
    lot = F.pmod(F.xxhash64("sha"), F.lit(lots)).cast("int")
    if ranges:
        ends = hunks.agg(F.percentile_approx("sha", [i / lots for i in range(1, lots)], 100 * lots)).head()[0] if lots > 1 else None
        lot = sum(((F.col("sha") > x).cast("int") for x in ends or ()), F.lit(0))
    met = hit.where("sha is not null").select("sha", "fn_key").repartition("fn_key").groupBy("fn_key", lot.alias("lot")).agg(F.collect_set("sha").alias("shas"))
    callers = calls.select(F.col("to_key").alias("fn_key"), "from_key").groupBy("fn_key").agg(F.collect_set("from_key").alias("callers"))
    sent = met.join(callers, "fn_key", "left").select("lot", "fn_key", "shas", F.coalesce("callers", F.array()).alias("callers")).repartitionById(lots, "lot")
    both = sent.select("lot", F.explode("shas").alias("sha"), "fn_key", "callers").groupBy("lot", "sha").agg(F.collect_list("fn_key").alias("fns"), F.flatten(F.collect_list("callers")).alias("callers"))
    counts = both.select("sha", F.size("fns").cast("long").alias("touched"), F.size(F.array_except("callers", "fns")).cast("long").alias("callers"))
    return files.join(counts, "sha", "left").select("sha", "files", F.coalesce("touched", F.lit(0)).alias("touched"), F.coalesce("callers", F.lit(0)).alias("callers"))


def surface_split(changes: DataFrame) -> DataFrame:
    """changes (fn_name, internal, change) counted by change and part: a helper is internal or has no dot in its name."""
    part = F.when(F.col("internal") | ~F.contains("fn_name", F.lit(".")), "helper").otherwise("public")
    return changes.groupBy("change", part.alias("part")).agg(F.count(F.lit(1)).alias("n"))


def header_plan(nodes: DataFrame, exports: DataFrame) -> DataFrame:
    """(node_id, header): the module line that a source without one would get, from its path; and the name it returns."""
    open_ = nodes.where("kind = 'module' and module is null and path like '%.lua'")
    name = F.replace(F.regexp_replace(F.regexp_replace("path", r"\.lua$", ""), r"/init$", ""), F.lit("/"), F.lit("."))
    return open_.join(exports, "node_id", "left").select("node_id", F.concat(F.lit("---@module '"), name, F.lit("'")).alias("header"), "exported")


def report(nodes: DataFrame, fns: DataFrame) -> DataFrame:
    """(language, files, functions, documented, tested, pct_documented): the counts that a run prints."""
    from sparkloom.functions.scalar import pct

    files = nodes.where("language is not null").groupBy("language").agg(F.count(F.lit(1)).alias("files"))
    work = fns.groupBy("language").agg(F.count(F.lit(1)).alias("functions"), F.sum(F.col("documented").cast("long")).alias("documented"), F.sum(F.col("tested").cast("long")).alias("tested"))
    both = files.join(work, "language", "left").na.fill(0, ["functions", "documented", "tested"])
    return both.withColumn("pct_documented", pct(F.col("documented"), F.col("functions")))


def hooks(fns: DataFrame) -> DataFrame:
    """Functions named as hooks are: use and a capital letter."""
    return fns.where(F.col("fn_name").rlike(r"(^|[.:])use[A-Z]"))


def stage_shares(timings: DataFrame) -> DataFrame:
    """timings (stage, ms) with the share of all, in percent with one decimal."""
    whole = Window.partitionBy(F.lit(0))
    return timings.withColumn("share", F.floor(F.col("ms") * 1000 / F.sum("ms").over(whole) + 0.5) / 10)
