"""Joins and name resolution: requires, calls, prefixes, documents, hunks, run-time names.

First-seen rules carry an order column (`ord`, `seq`) and reduce by min_by or max_by, never by arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions.scalar import bare_name, dotted_prefixes, normalised, parent_dir, route_path, route_pattern
from sparkloom.operators.intervals import meeting, overlapping
from sparkloom.session import stored


def module_index(nodes: DataFrame) -> DataFrame:
    """(module, node_id): of nodes that share a module name, the last in order."""
    return nodes.where("module is not null").groupBy("module").agg(F.max_by("node_id", "ord").alias("node_id"))


def path_index(nodes: DataFrame) -> DataFrame:
    """(path, node_id): of nodes that share a path, the last in order."""
    return nodes.where("path is not null and path != ''").groupBy("path").agg(F.max_by("node_id", "ord").alias("node_id"))


def relative_candidates(spec: Column, importer: Column, extensions: list[str], index: str = "index") -> Column:
    """Ranked paths that a relative import can mean: as written, then X.ext and X/index.ext by extension."""
    base = normalised(F.concat_ws("/", parent_dir(importer), spec))
    ranked = [base] + [F.concat(base, F.lit(s)) for e in sorted(extensions) for s in (f".{e}", f"/{index}.{e}")]
    return F.when(spec.rlike(r"^\.\.?/"), F.array(*ranked))


def resolve_requires(raw: DataFrame, nodes: DataFrame, extensions: list[str] = ("js", "lua", "py", "ts")) -> DataFrame:
    """raw (node_id, seq, module, deferred, line) with dst: by module name first, else by relative path; null if unknown."""
    known = module_index(nodes).select(F.col("module"), F.col("node_id").alias("by_name"))
    paths = path_index(nodes).select(F.col("path").alias("cand"), F.col("node_id").alias("by_path"))
    own = nodes.select("node_id", F.col("path").alias("importer"))
    named = raw.join(known, "module", "left").join(own, "node_id", "left")
    relative = named.where("by_name is null").select("node_id", "seq", F.posexplode(relative_candidates(F.col("module"), F.col("importer"), list(extensions))).alias("rank", "cand"))
    best = relative.join(paths, "cand").groupBy("node_id", "seq").agg(F.min_by("by_path", "rank").alias("by_path"))
    return named.join(best, ["node_id", "seq"], "left").select("node_id", "seq", "module", "deferred", "line", F.coalesce("by_name", "by_path").alias("dst"))


def require_edges(resolved: DataFrame) -> DataFrame:
    """One edge for each (src, dst): deferred only if all are; the first line, lowered by repeats that are not deferred; the first module name."""
    seen = resolved.where("dst is not null and dst != node_id").select(F.col("node_id").alias("src"), "dst", "seq", "module", "deferred", F.col("line").cast("long").alias("line"))
    agg = seen.groupBy("src", "dst").agg(
        F.bool_and("deferred").alias("deferred"), F.min_by("line", "seq").alias("first"), F.min("seq").alias("first_seq"), F.min_by("module", "seq").alias("to_module"),
        F.min(F.when(~F.col("deferred"), F.struct("line", "seq"))).alias("low"), F.count(F.lit(1)).alias("times"),
    )
    return agg.select("src", "dst", "deferred", F.least("first", F.coalesce(F.col("low.line"), F.col("first"))).alias("line"), "to_module", "times")


def external_requires(resolved: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, module) of requires that no node answers, each once, a node's own module left out."""
    own = nodes.select("node_id", F.col("module").alias("own"))
    return resolved.where("dst is null").join(own, "node_id", "left").where("not (module <=> own)").select("node_id", "module").distinct()


def function_index(fns: DataFrame) -> DataFrame:
    """(node_id, name, fn_key): the declared name, else the first function with that bare name."""
    declared = fns.select("node_id", F.col("fn_name").alias("name"), "fn_key", F.lit(0).alias("rank"), F.col("k").alias("ord"))
    bare = fns.select("node_id", bare_name(F.col("fn_name")).alias("name"), "fn_key", F.lit(1).alias("rank"), F.col("k").alias("ord"))
    return declared.union(bare).groupBy("node_id", "name").agg(F.min_by("fn_key", F.struct("rank", "ord")).alias("fn_key"))


def unique_bare(fns: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, name, node_id, fn_key) of bare names that one function alone has, within each group of `by`."""
    keys = [*(by or []), "name"]
    return fns.withColumn("name", bare_name(F.col("fn_name"))).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("node_id").alias("node_id"), F.min("fn_key").alias("fn_key")).where("n = 1").drop("n")


def package_siblings(fns: DataFrame, nodes: DataFrame, languages: tuple[str, ...] = ("go",)) -> DataFrame:
    """(parent_id, name, node_id, fn_key): bare names that one file alone declares among the files of a folder, in languages whose files share a scope."""
    scoped = nodes.where(F.col("language").isin(*languages) & F.col("parent_id").isNotNull()).select("node_id", "parent_id")
    held = fns.withColumn("name", bare_name(F.col("fn_name"))).join(scoped, "node_id").groupBy("parent_id", "name")
    return held.agg(F.countDistinct("node_id").alias("n"), F.min("node_id").alias("node_id"), F.max_by("fn_key", "k").alias("fn_key")).where("n = 1").drop("n")


def ladder_index(fns: DataFrame, aliases: DataFrame, guess: bool, modules: DataFrame | None, siblings: DataFrame | None, imports: DataFrame | None) -> DataFrame:
    """(scope, name, rung, to_key, module, member): all that a call can be looked up in, by one pair of keys.

    A scope is a module, a file's alias, a file under one of its own prefixes, a file, its package, its imports, or the
    tree. A name that is empty says that the scope is there, whatever it holds.
    """
    held = stored(function_index(fns), "index")
    row = lambda df, scope, name, rung, key=None, module=None, member=None: df.select(F.concat(*scope).alias("scope"), F.lit("").alias("name") if name is None else F.col(name).alias("name"), (F.lit(rung) if isinstance(rung, str) else rung).alias("rung"), *[(F.lit(None).cast("string") if c is None else F.col(c)).alias(n) for n, c in (("to_key", key), ("module", module), ("member", member))])
    of = lambda target: held.select(F.col("node_id").alias(target), "name", "fn_key")
    alias = aliases.withColumn("scope", F.concat(F.lit("a:"), "node_id", F.lit("\x01"), "alias"))
    heads = fns.where(F.col("fn_name").contains(".")).select("node_id", F.substring_index("fn_name", ".", 1).alias("head")).distinct()
    parts = [
        row(alias, ["scope"], None, F.when(F.col("target").isNull(), "external").otherwise("alias"), module="module"),
        row(alias.join(of("target"), "target"), ["scope"], "name", "alias", "fn_key"),
        row(heads, [F.lit("p:"), "node_id", F.lit("\x01"), "head"], None, "own"),
        row(heads.join(held, "node_id"), [F.lit("p:"), "node_id", F.lit("\x01"), "head"], "name", "own", "fn_key"),
        row(held, [F.lit("o:"), "node_id"], "name", "own", "fn_key"),
    ]
    if modules is not None:
        parts.append(row(modules, [F.lit("m:"), "module"], None, "inline"))
        parts.append(row(modules.select("module", "node_id").join(held, "node_id"), [F.lit("m:"), "module"], "name", "inline", "fn_key"))
    if siblings is not None:
        parts.append(row(siblings, [F.lit("s:"), "node_id"], "name", "sibling", "fn_key"))
    if imports is not None:
        found = imports.withColumnRenamed("name", "local").withColumn("bare", bare_name(F.col("member")))
        full, short = held.toDF("target", "member", "full_key"), held.toDF("target", "bare", "short_key")
        found = found.join(full, ["target", "member"], "left").join(short, ["target", "bare"], "left").withColumn("fn_key", F.coalesce("full_key", "short_key"))
        parts.append(row(found, [F.lit("i:"), "node_id"], "local", F.when(F.col("target").isNull(), "external").otherwise("import"), "fn_key", "module", "member"))
    if guess:
        parts.append(row(unique_bare(fns), [F.lit("u")], "name", "unique", "fn_key"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def resolve_calls(raw: DataFrame, fns: DataFrame, aliases: DataFrame, guess: bool = False, modules: DataFrame | None = None, siblings: DataFrame | None = None, imports: DataFrame | None = None) -> DataFrame:
    """raw (node_id, seq, callee, from_fn, line) with the rung that applies, and the function it finds.

    Rungs in order: inline (`require("mod").f`, modules: module, node_id), alias (head of a dotted callee is a local name
    of a module in the tree), external (an inline or aliased module that is not), own (the name is this node's, or its
    head begins one of this node's names), sibling (siblings: node_id, name, fn_key: files of the same package), import
    (imports: node_id, name, target or null, module, member), unique (a bare name that one function of the whole
    tree has; only with `guess`, and heuristic). A call stops at the first rung that applies, found or not.
    aliases: (node_id, alias, target node or null, module). Calls from no function, and of itself, are dropped.

    A call is looked up under its few possible keys, ranked, in one index and by one join; the least rank is a minimum that
    the map side takes first. So calls move twice: to the index, and to their minimum.
    """
    pattern = r"^require\s*\(?\s*[\"']([\w.-]+)[\"']\s*\)?\s*\.([\w.]+)$"
    calls = raw.where("from_fn is not null").select("node_id", "seq", "from_fn", "callee", "line", F.regexp_extract("callee", pattern, 1).alias("inline"))
    plain, bare = F.col("callee").rlike(r"^\w+\.[\w.]+$"), F.col("callee").rlike(r"^\w+$")
    rest = F.when(F.col("inline") != "", F.regexp_extract("callee", pattern, 2)).when(plain, F.regexp_replace("callee", r"^[^.]*\.", ""))
    calls = calls.withColumn("rest", rest)
    key = lambda rank, name, *scope: F.struct(F.concat(*scope).alias("scope"), name.alias("name"), F.lit(rank).alias("rank"))
    head = F.substring_index("callee", ".", 1)
    tail, whole, none = bare_name(F.col("rest")), F.col("callee"), F.lit("")
    mod, alias, mine = (F.lit("m:"), F.col("inline")), (F.lit("a:"), F.col("node_id"), F.lit("\x01"), head), (F.lit("p:"), F.col("node_id"), F.lit("\x01"), head)
    within = [key(0, F.col("rest"), *mod), key(1, tail, *mod), key(2, none, *mod)]
    dotted = [key(10, F.col("rest"), *alias), key(11, tail, *alias), key(12, none, *alias), key(20, whole, *mine), key(21, tail, *mine), key(22, none, *mine)]
    single = [key(30, whole, F.lit("o:"), F.col("node_id")), key(40, whole, F.lit("s:"), F.col("node_id")), key(50, whole, F.lit("i:"), F.col("node_id")), key(60, whole, F.lit("u"))]
    ways = F.when(F.col("inline") != "", F.array(*within)).when(plain, F.array(*dotted)).when(bare, F.array(*single)).otherwise(F.array(key(99, none, none)))
    tried = calls.withColumn("k", F.explode(ways)).select("*", "k.*").drop("k")
    index = ladder_index(fns, aliases, guess, modules, siblings, imports)
    met = tried.join(index, ["scope", "name"], "left")
    best = F.min(F.when(F.col("rung").isNotNull(), F.struct("rank", "rung", "to_key", "module", "member")))
    found = met.groupBy("node_id", "seq", "from_fn", "callee", "line", "inline", "rest").agg(best.alias("b"))
    rung = F.coalesce(F.col("b.rung"), F.when(F.col("inline") != "", "external"))
    outer = F.when(F.col("rung") == "external", F.when(F.col("inline") != "", F.col("inline")).otherwise(F.col("b.module")))
    member = F.when(F.col("rung") == "external", F.coalesce("rest", F.col("b.member")))
    found = found.withColumn("rung", rung).select("node_id", "seq", "from_fn", "callee", "line", "rung", F.col("b.to_key").alias("to_key"), outer.alias("alias_module"), member.alias("member"), F.when(F.col("rung") == "unique", "heuristic").otherwise("exact").alias("confidence"))
    return found.where("to_key is null or to_key != from_fn")


def call_edges(resolved: DataFrame) -> DataFrame:
    """One edge for each caller and function called, at the first line seen."""
    return resolved.where("to_key is not null").groupBy("node_id", "from_fn", "to_key").agg(F.min_by("line", "seq").alias("line"), F.min_by("confidence", "seq").alias("confidence"))


def external_calls(resolved: DataFrame) -> DataFrame:
    return resolved.where("rung = 'external'").groupBy("node_id", F.col("alias_module").alias("module"), "member").agg(F.count(F.lit(1)).alias("cnt"))


def longest_prefix(names: DataFrame, prefixes: DataFrame) -> DataFrame:
    """names (module) with the longest of prefixes (prefix, target) that is the name or a dotted prefix of it; null if none.

    An equi-join on exploded prefixes, not a comparison of all with all.
    """
    each = names.select("module").distinct().select("module", F.explode(dotted_prefixes(F.col("module"))).alias("prefix"))
    best = each.join(prefixes, "prefix").groupBy("module").agg(F.max_by(F.struct("prefix", "target"), F.length("prefix")).alias("x"))
    return names.join(best.select("module", "x.prefix", "x.target"), "module", "left")


def tag_audit(linked: DataFrame, surface: DataFrame) -> DataFrame:
    """linked (module, target) against surface (target, module): missing, unavailable (target has no surface) or ok."""
    there = surface.select("target").distinct().withColumn("available", F.lit(True))
    names = surface.select("target", "module").distinct().withColumn("found", F.lit(True))
    both = linked.where("target is not null").join(there, "target", "left").join(names, ["target", "module"], "left")
    return both.select("module", "target", F.when(F.col("available").isNull(), "unavailable").when(F.col("found").isNull(), "missing").otherwise("ok").alias("state"))


def consumers(surface: DataFrame, outside: DataFrame, inside: DataFrame) -> DataFrame:
    """(module, n_consumers, state): external if another tree requires it, else internal if its own does, else unreferenced."""
    out = outside.groupBy("module").agg(F.countDistinct("consumer").alias("n_consumers"))
    own = inside.select("module").distinct().withColumn("used", F.lit(True))
    both = surface.select("module").distinct().join(out, "module", "left").join(own, "module", "left")
    return both.select("module", F.coalesce("n_consumers", F.lit(0)).alias("n_consumers"), F.when(F.col("n_consumers").isNotNull(), "external").when(F.col("used"), "internal").otherwise("unreferenced").alias("state"))


def doc_references(spans: DataFrame, nodes: DataFrame, fns: DataFrame) -> DataFrame:
    """spans (doc_id, text) with the entity meant: an exact module or function if dotted, a unique bare name as a guess."""
    exact = nodes.where("module is not null").select(F.col("module").alias("text"), F.col("node_id").alias("entity")).union(fns.where(F.col("fn_name").contains(".")).select(F.col("fn_name").alias("text"), F.col("fn_key").alias("entity")))
    exact = exact.groupBy("text").agg(F.min("entity").alias("exact"))
    bare = unique_bare(fns).select(F.col("name").alias("text"), F.col("fn_key").alias("guess"))
    both = spans.join(exact, "text", "left").join(bare, "text", "left")
    dotted = F.col("text").contains(".")
    return both.select("doc_id", "text", F.when(dotted, F.col("exact")).otherwise(F.col("guess")).alias("entity"), F.when(dotted, "exact").otherwise("heuristic").alias("confidence")).where("entity is not null")


def missing_members(spans: DataFrame, nodes: DataFrame, fns: DataFrame) -> DataFrame:
    """(doc_id, text, module, member): dotted spans whose longest module prefix leaves one name that the module lacks."""
    entities = nodes.select(F.col("module").alias("text")).union(fns.select(F.col("fn_name").alias("text")))
    dotted = spans.where(F.col("text").contains(".") & ~F.col("text").rlike(r"\.(nvim|lua|init)$")).join(entities, "text", "left_anti")
    found = longest_prefix(dotted.withColumnRenamed("text", "module"), nodes.where("module is not null").select(F.col("module").alias("prefix"), F.col("node_id").alias("target")))
    left = found.where("target is not null").withColumn("member", F.substring(F.col("module"), F.length("prefix") + 2, F.length("module")))
    own = function_index(fns).select(F.col("node_id").alias("target"), F.col("name").alias("member"))
    return left.where(F.col("member").rlike(r"^[A-Za-z_][A-Za-z0-9_]*$")).join(own, ["target", "member"], "left_anti").select("doc_id", F.col("module").alias("text"), F.col("prefix").alias("module"), "member")


def capped(refs: DataFrame, key: str, order: list[str], most: int = 20) -> DataFrame:
    """The first `most` rows of each key in encounter order, and how many more there are.

    Each task keeps its own first ones and counts by itself before the shuffle, so a key of very many rows is no task's burden.
    """
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    first = refs.withColumn("rank", rank).where(F.col("rank") <= most)
    many = refs.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_many"))
    more = F.greatest(F.col("_many") - most, F.lit(0)).alias("more")
    return first.join(many, first[key].eqNullSafe(many["_key"])).select(*refs.columns, "rank", more)


def spans_of(fns: DataFrame) -> DataFrame:
    """fns with last: line_end, else the line before the next function, else none (open); approximate where guessed."""
    nxt = F.lead("line").over(Window.partitionBy("node_id").orderBy("line", "fn_key")) - 1
    return fns.withColumn("last", F.coalesce("line_end", nxt)).withColumn("approximate", F.col("line_end").isNull())


def touched(hunks: DataFrame, fns: DataFrame) -> DataFrame:
    """(sha, node_id, fn_key): functions whose lines overlap a hunk's."""
    return touches(hunks, fns).distinct()


def touches(hunks: DataFrame, fns: DataFrame, name: str = "fn_key") -> DataFrame:
    """touched(), a row for each hunk, by blocks of lines: a hunk is sent once for each block it lies in.

    The last function of a file may have no end: it ends with the file's last hunk. name: the column that names a
    function in the result, where one shorter than the key is at hand.
    """
    spans = spans_of(fns).select("node_id", F.col(name).alias("fn_key"), F.col("line").alias("b_first"), F.col("last").alias("b_last"))
    cut = hunks.select("sha", "node_id", F.col("first").alias("a_first"), F.col("last").alias("a_last"))
    ends = cut.groupBy("node_id").agg(F.max(F.greatest("a_first", "a_last")).alias("_end"))
    endless = spans.where("b_last is null").join(ends, "node_id").where("_end >= b_first").select("node_id", "fn_key", "b_first", F.col("_end").alias("b_last"))
    spans = stored(spans.where("b_last is not null").unionByName(endless), "spans")
    return meeting(cut, spans, ["node_id"]).select("sha", "node_id", "fn_key")


def unattributed(hunks: DataFrame, hit: DataFrame) -> DataFrame:
    """(sha, node_id) of changed files in which no function was touched."""
    return hunks.select("sha", "node_id").distinct().join(hit.select("sha", "node_id").distinct(), ["sha", "node_id"], "left_anti")


def runtime_names(counts: DataFrame, fns: DataFrame) -> DataFrame:
    """counts (name, calls) with fn_key: the exact declared name, else a bare name that is unique."""
    exact = fns.groupBy(F.col("fn_name").alias("name")).agg(F.min("fn_key").alias("exact"))
    bare = unique_bare(fns).select("name", F.col("fn_key").alias("guess"))
    return counts.join(exact, "name", "left").join(bare, "name", "left").select("name", "calls", F.coalesce("exact", "guess").alias("fn_key"))


def quadrant(fns: DataFrame, runtime: DataFrame, calls: DataFrame) -> DataFrame:
    """(fn_key, calls, static, badge): run-time calls against calls in the code; null calls where nothing was recorded."""
    static = calls.groupBy(F.col("to_key").alias("fn_key")).agg(F.count(F.lit(1)).alias("static"))
    both = fns.select("fn_key").join(runtime.select("fn_key", "calls"), "fn_key", "left").join(static, "fn_key", "left").withColumn("static", F.coalesce("static", F.lit(0)))
    badge = F.when(F.col("calls").isNull(), "unknown").when((F.col("calls") > 0) & (F.col("static") > 0), "live").when(F.col("calls") > 0, "runtime-only").when(F.col("static") > 0, "static-only").otherwise("dead")
    return both.withColumn("badge", badge)


def declared_against_loaded(declared: DataFrame, loaded: DataFrame) -> DataFrame:
    """(node_id, name, side): in both, only declared, or only loaded."""
    a, b = declared.select("node_id", "name").distinct().withColumn("a", F.lit(True)), loaded.select("node_id", "name").distinct().withColumn("b", F.lit(True))
    return a.join(b, ["node_id", "name"], "full").select("node_id", "name", F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "declared").otherwise("loaded").alias("side"))


def ab_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(fn_key, calls_a, calls_b, delta) of two snapshots; what one lacks counts 0."""
    both = a.select("fn_key", F.col("calls").alias("calls_a")).join(b.select("fn_key", F.col("calls").alias("calls_b")), "fn_key", "full")
    both = both.select("fn_key", F.coalesce("calls_a", F.lit(0)).alias("calls_a"), F.coalesce("calls_b", F.lit(0)).alias("calls_b"))
    return both.withColumn("delta", F.col("calls_b") - F.col("calls_a"))


#: In a route's segment, what stands for any text without a slash: `:name` or `{name}`.
PARAMETER = r"(:[A-Za-z_][A-Za-z0-9_]*|\{[^}/]*\})"


def _codes(route: str) -> Column:
    """A route's segments, told apart: `*` a parameter, `~` and the segment where only a part is one, `=` and the segment else."""
    code = lambda x: F.when(x.rlike(f"^{PARAMETER}$"), "*").when(x.rlike(PARAMETER), F.concat(F.lit("~"), x)).otherwise(F.concat(F.lit("="), x))
    return F.transform(F.filter(F.split(route, "/"), lambda x: x != ""), code)


def route_trie(routes: DataFrame) -> DataFrame:
    """(node, depth, key, pattern, next) of routes (route): each beginning of a route is a node; a key is what a path's segment is joined by, a pattern what it must fit besides."""
    steps = routes.select(_codes("route").alias("codes")).distinct().select("codes", F.posexplode("codes").alias("depth", "code"))
    upto = lambda n: F.array_join(F.slice("codes", 1, n), "/")
    part = F.col("code").startswith("~")
    key = F.when(part, "~").otherwise(F.col("code"))
    return steps.select(upto(F.col("depth")).alias("node"), "depth", key.alias("key"), F.when(part, route_pattern(F.substring("code", 2, 1 << 30))).alias("pattern"), upto(F.col("depth") + 1).alias("next")).distinct()


def route_coverage(routes: DataFrame, requests: DataFrame) -> DataFrame:
    """(route, method, hits): requests whose path fits the route, by equal method or a route for all; a last slash is free.

    Different paths walk the trie of the routes a segment at a time: joins by equality of node and segment, literal or
    parameter, as many as the longest route has segments (a segment that is a parameter in part is joined by its node and
    held against its pattern). So neither side is sent whole, and no path is tried against all routes.
    """
    paths = requests.groupBy(F.upper("method").alias("m"), route_path(F.col("url")).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    want = routes.select("route", "method", F.array_join(_codes("route"), "/").alias("leaf"))
    trie = stored(route_trie(routes), "trie")
    deep = trie.agg(F.max("depth") + 1).head()[0] or 0
    bare = F.regexp_replace(F.regexp_replace("p", "^/", ""), "/$", "")
    parts = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "/"))
    at = paths.where(F.startswith("p", F.lit("/"))).select("m", "n", parts.alias("parts"), F.lit("").alias("node")).where(F.size("parts") <= deep)
    done = at.where(F.size("parts") == 0)
    for depth in range(deep):
        own = F.get("parts", F.lit(depth))
        each = at.where(F.size("parts") > depth).select("*", own.alias("own"), F.explode(F.array(F.concat(F.lit("="), own), F.lit("*"), F.lit("~"))).alias("key")).where("own != ''")
        met = each.join(trie.where(F.col("depth") == depth).select("node", "key", "pattern", "next"), ["node", "key"]).where("pattern is null or own rlike pattern")
        at = met.select("m", "n", "parts", F.col("next").alias("node"))
        done = done.unionByName(at.where(F.size("parts") == depth + 1))
    fits = done.groupBy("m", F.col("node").alias("leaf")).agg(F.sum("n").alias("n"))
    met = want.join(fits, "leaf").where("upper(method) = m or lower(method) = 'all'").groupBy("route", "method").agg(F.sum("n").alias("hits"))
    return want.select("route", "method").join(met, ["route", "method"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))


def api_surface(fns: DataFrame, calls: DataFrame) -> DataFrame:
    """(fn_key, documented, callers): how many other modules call each function that is not internal."""
    callers = calls.where("src != dst").groupBy(F.col("to_key").alias("fn_key")).agg(F.countDistinct("src").alias("callers"))
    return fns.where("not internal").select("fn_key", "documented").join(callers, "fn_key", "left").withColumn("callers", F.coalesce("callers", F.lit(0)))


def two_sided(hunks: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(sha, node_id, fn_key, sides): hunks (sha, node_id, side, first, last) met by the functions of their side: `-` of the state before, `+` of that after.

    A function that both sides touch is one row, its sides as `+-`.
    """
    old, new = touched(hunks.where("side = '-'"), before).withColumn("side", F.lit("-")), touched(hunks.where("side = '+'"), after).withColumn("side", F.lit("+"))
    return old.unionByName(new).groupBy("sha", "node_id", "fn_key").agg(F.array_join(F.array_sort(F.collect_set("side")), "").alias("sides"))


def entity_index(nodes: DataFrame, fns: DataFrame) -> DataFrame:
    """(text, entity, kind): modules and dotted functions by name; a namespace above a module by the part of its name, where nothing has it exactly."""
    exact = nodes.where("module is not null").select(F.col("module").alias("text"), F.col("node_id").alias("entity"), F.lit("module").alias("kind"))
    exact = exact.union(fns.where(F.col("fn_name").contains(".")).select("fn_name", "fn_key", F.lit("function")))
    exact = exact.groupBy("text").agg(F.min(F.struct("entity", "kind")).alias("x")).select("text", "x.entity", "x.kind")
    above = nodes.where("module is not null").select(F.explode(dotted_prefixes(F.col("module"))).alias("text")).distinct().join(exact.select("text"), "text", "left_anti")
    return exact.unionByName(above.select("text", F.col("text").alias("entity"), F.lit("namespace").alias("kind")))
