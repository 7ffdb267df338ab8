"""Drift checks: each rule is a DataFrame of findings (severity, check, node_id, detail)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.scalar import bare_name, dotted_prefixes, normalised, parent_dir

#: The message of each check; {names} are filled from the finding.
MESSAGES = {
    "missing-module-tag": "{node} has no module tag",
    "missing-summary": "{node} has no summary",
    "module-path-mismatch": "{node} declares {detail}, which its path does not give",
    "missing-readme": "{node} has no readme",
    "dead-readme-link": "{node} links to {detail}, which is not there",
    "doc-references-missing": "{node} names {detail}, which is not there",
    "tools-spec-invalid": "the tools file has an entry that cannot be read: {detail}",
    "unreferenced-module": "nothing requires {node}",
    "tag-require-missing": "{node} requires {detail}, which its tag file lacks",
    "tag-file-unavailable": "the tag file for {detail} is not there",
    "orphaned-class-alias": "type {detail} of {node} is used nowhere",
    "test-references-missing": "a test uses {detail}, which its module lacks",
    "binding-conflict": "{detail} is bound at several places",
    "require-cycle": "{node} is on a load-time cycle with {detail}",
    "require-not-declared": "{node} requires {detail}, which no node declares",
    "unused-require": "{node} requires {detail} and does not use it",
    "consumer-require-missing": "a consumer requires {detail}, which is not there",
    "layer-violation": "{node} requires {detail} across a layer",
    "dead-see-target": "{node} refers to {detail}, which is not there",
    "type-vs-class": "{node} gives {detail} as a type where a class is meant",
    "undocumented-param": "{detail} has parameters that are not documented",
    "param-name-mismatch": "{detail} documents a parameter by another name",
    "dead-function": "{detail} is never used",
    "example-does-not-parse": "the example of {detail} has brackets that do not match",
}


def finding(rows: DataFrame, severity: str, check: str, node="node_id", detail=None) -> DataFrame:
    d = F.lit(None) if detail is None else (F.col(detail) if isinstance(detail, str) else detail)
    n = F.col(node) if isinstance(node, str) else node
    return rows.select(F.lit(severity).alias("severity"), F.lit(check).alias("check"), n.cast("string").alias("node_id"), d.cast("string").alias("detail"))


def missing_module_tag(nodes: DataFrame, identified: list[str]) -> DataFrame:
    """Files of languages that state their module, without one."""
    return finding(nodes.where(F.col("language").isin(identified) & F.col("module").isNull()), "error", "missing-module-tag")


def missing_summary(nodes: DataFrame) -> DataFrame:
    return finding(nodes.where("kind = 'module' and coalesce(summary, '') = ''"), "warn", "missing-summary")


def module_path_mismatch(nodes: DataFrame) -> DataFrame:
    """Declared modules whose last parts are not the path without its extension (and without a trailing init)."""
    expected = F.replace(F.regexp_replace(F.regexp_replace("path", r"\.[A-Za-z0-9]+$", ""), r"/(init|index|__init__|mod)$", ""), F.lit("/"), F.lit("."))
    return finding(nodes.where(F.col("module").isNotNull()).withColumn("e", expected).where("module != e and not endswith(module, concat('.', e))"), "error", "module-path-mismatch", detail="module")


def missing_readme(nodes: DataFrame, readmes: DataFrame) -> DataFrame:
    return finding(nodes.where("kind = 'namespace'").join(readmes, "node_id", "left_anti"), "info", "missing-readme")


def dead_links(links: DataFrame, files: DataFrame) -> DataFrame:
    """links (node_id, near, target): relative targets, fragment cut, that no file answers."""
    t = F.regexp_replace("target", "#.*$", "")
    rel = links.withColumn("t", t).where((F.col("t") != "") & ~F.col("t").rlike("^[A-Za-z][A-Za-z0-9+.-]*:") & ~F.col("t").startswith("/"))
    path = normalised(F.concat_ws("/", parent_dir(F.col("near")), F.col("t")))
    return finding(rel.withColumn("path", path).join(files.select("path").distinct(), "path", "left_anti").select("node_id", "target").distinct(), "warn", "dead-readme-link", detail="target")


def unreferenced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return finding(nodes.where("kind = 'module' and parent_id is not null").join(edges.select(F.col("dst").alias("node_id")), "node_id", "left_anti"), "info", "unreferenced-module")


def tag_findings(audit: DataFrame) -> DataFrame:
    missing = finding(audit.where("state = 'missing'"), "warn", "tag-require-missing", node="target", detail="module")
    return missing.union(finding(audit.where("state = 'unavailable'").select("target").distinct(), "info", "tag-file-unavailable", node="target", detail="target"))


def orphaned_types(types: DataFrame, uses: DataFrame) -> DataFrame:
    """types (node_id, type_name, line) that no use (type_name, node_id, line) names but their own declaration."""
    other = uses.withColumnRenamed("node_id", "u").withColumnRenamed("line", "ul")
    used = types.join(other, "type_name").where("u != node_id or ul != line").select("node_id", "type_name").distinct()
    return finding(types.join(used, ["node_id", "type_name"], "left_anti"), "info", "orphaned-class-alias", detail="type_name")


def test_references(uses: DataFrame, members: DataFrame) -> DataFrame:
    """uses (spec, node_id, member) of modules whose members (node_id, member) are known, of members they lack."""
    known = members.select("node_id").distinct()
    return finding(uses.join(known, "node_id", "left_semi").join(members, ["node_id", "member"], "left_anti").select("node_id", "member").distinct(), "warn", "test-references-missing", detail="member")


def binding_conflicts(bindings: DataFrame) -> DataFrame:
    """Keys bound at more than one site, by mode; bindings of one buffer are left out."""
    each = bindings.where("not buffer_local").select(F.explode(F.split("modes", ",")).alias("mode"), "lhs", "site").distinct()
    hit = each.groupBy("mode", "lhs").agg(F.count(F.lit(1)).alias("n"), F.min("site").alias("site")).where("n > 1")
    return finding(hit, "warn", "binding-conflict", node="site", detail=F.concat_ws(" ", "mode", "lhs"))


def require_cycles(cycles: DataFrame) -> DataFrame:
    return finding(cycles, "warn", "require-cycle", node="node", detail="component")


def covered(modules: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(module): those at or below any of the prefixes; by their own dotted prefixes and equality, whatever the number of either."""
    each = modules.select("module").distinct().select("module", F.explode(dotted_prefixes(F.col("module"))).alias("prefix"))
    return each.join(prefixes.select("prefix").distinct(), "prefix", "left_semi").select("module").distinct()


def not_declared(requires: DataFrame, nodes: DataFrame, prefixes: DataFrame | None = None) -> DataFrame:
    """Requires under one of our own first segments that no node declares and no tag prefix covers."""
    ours = nodes.where("module is not null").select(F.split("module", r"\.")[0].alias("head")).distinct()
    left = requires.withColumn("head", F.split("module", r"\.")[0]).join(ours, "head", "left_semi").join(nodes.select("module"), "module", "left_anti")
    if prefixes is not None:
        left = left.join(covered(left, prefixes), "module", "left_anti")
    return finding(left.select("node_id", "module").distinct(), "warn", "require-not-declared", detail="module")


def unused_requires(requires: DataFrame, tokens: DataFrame) -> DataFrame:
    """requires (node_id, alias, line) whose alias no other line of the file has among its tokens (node_id, word, line)."""
    used = requires.join(tokens.withColumnRenamed("line", "tl").withColumnRenamed("word", "alias"), ["node_id", "alias"]).where("tl != line").select("node_id", "alias").distinct()
    return finding(requires.join(used, ["node_id", "alias"], "left_anti"), "info", "unused-require", detail="alias")


def consumer_missing(outside: DataFrame, nodes: DataFrame) -> DataFrame:
    """(consumer, module) required from us, below one of our heads, that no node declares."""
    ours = nodes.where("module is not null").select(F.split("module", r"\.")[0].alias("head")).distinct()
    left = outside.withColumn("head", F.split("module", r"\.")[0]).join(ours, "head", "left_semi").join(nodes.select("module"), "module", "left_anti")
    return finding(left.groupBy("module").agg(F.array_join(F.array_sort(F.collect_set("consumer")), ",").alias("who")), "warn", "consumer-require-missing", node="who", detail="module")


def layer_violations(requires: DataFrame, rules: DataFrame) -> DataFrame:
    """requires (from_module, to_module) against rules (rule_from, rule_to): into rule_to from rule_from, though not from within rule_to."""
    pairs = requires.select("from_module", "to_module").distinct()
    below = lambda c, p: pairs.select(c).distinct().select(c, F.explode(dotted_prefixes(F.col(c))).alias(p))
    met = pairs.join(below("from_module", "rule_from"), "from_module").join(rules.select("rule_from", "rule_to").distinct(), "rule_from").join(below("to_module", "rule_to"), ["to_module", "rule_to"])
    met = met.where("from_module != rule_to and not startswith(from_module, concat(rule_to, '.'))")
    return finding(met.select("from_module", "to_module").distinct(), "warn", "layer-violation", node="from_module", detail="to_module")


def dead_see(fns: DataFrame, targets: DataFrame) -> DataFrame:
    """fns (node_id, see array) whose targets (target) are not there."""
    each = fns.select("node_id", F.explode("see").alias("target")).distinct()
    return finding(each.join(targets.select("target").distinct(), "target", "left_anti"), "warn", "dead-see-target", detail="target")


def type_for_class(headers: DataFrame) -> DataFrame:
    """headers (node_id, header, rest): a `---@type X` over a table that gets fields assigned."""
    name = F.regexp_extract("header", r"---@type\s+([A-Za-z_.]+)", 1)
    return finding(headers.withColumn("t", name).where((F.col("t") != "") & (F.regexp_count("rest", F.lit(r"(?m)^\s*(?:function )?M[.:][A-Za-z_]+")) > 0)), "warn", "type-vs-class", detail="t")


def undocumented_params(fns: DataFrame) -> DataFrame:
    """fns (node_id, fn_key, declared, params, overloads): fewer documented than declared, `...` apart; an overload with enough counts."""
    many = F.size(F.filter("declared", lambda x: x != "..."))
    return finding(fns.where((many > F.size("params")) & ~((F.size("params") == 0) & (F.coalesce(F.array_max("overloads"), F.lit(-1)) >= many))), "info", "undocumented-param", detail="fn_key")


def param_mismatch(fns: DataFrame) -> DataFrame:
    """fns (node_id, fn_key, fn_name, declared, params): a name declared and another documented in its place.

    A method's `self` is not in its declaration where the colon gives it, and need not be documented where it is declared: it is
    left out of both before places are compared.
    """
    own = lambda c: F.when((F.get(c, F.lit(0)) == "self") & (F.col("fn_name").contains(":") | (F.get("declared", F.lit(0)) == "self")), F.slice(c, 2, 1 << 30)).otherwise(F.col(c))
    pairs = F.arrays_zip(own("declared").alias("d"), own("params").alias("p"))
    off = F.exists(pairs, lambda x: x["d"].isNotNull() & x["p"].isNotNull() & (x["d"] != "...") & (x["d"] != x["p"]))
    return finding(fns.where(off), "info", "param-name-mismatch", detail="fn_key")


def unbalanced_examples(fns: DataFrame) -> DataFrame:
    """Examples in which brackets do not match in number; no parser is at hand, so this is all that is checked."""
    n = lambda c: F.regexp_count("example", F.lit(f"\\{c}"))
    return finding(fns.where("example is not null").where((n("(") != n(")")) | (n("[") != n("]")) | (n("{") != n("}"))), "warn", "example-does-not-parse", detail="fn_key")


def invalid_tools(tools: DataFrame) -> DataFrame:
    return finding(tools.where("name is null or trim(name) = ''"), "warn", "tools-spec-invalid", node=F.lit(None), detail="raw")


def dead_functions(fns: DataFrame, calls: DataFrame, runtime: DataFrame | None = None, see: DataFrame | None = None, no_caller: bool = False, local_refs: DataFrame | None = None) -> DataFrame:
    """Functions that nothing calls or refers to: file-local (no dot in the name), internal, or with no_caller any.

    Run-time calls clear them, and so do local_refs (fn_key, local_refs): names passed as values in the file.
    """
    left = fns.join(calls.select(F.col("to_key").alias("fn_key")).distinct(), "fn_key", "left_anti")
    if see is not None:
        left = left.join(see, F.col("fn_name") == F.col("target"), "left_anti").join(see, bare_name(F.col("fn_name")) == F.col("target"), "left_anti")
    if runtime is not None:
        left = left.join(runtime.where("calls > 0").select("fn_key"), "fn_key", "left_anti")
    if local_refs is not None:
        left = left.join(local_refs.where("local_refs > 0").select("fn_key"), "fn_key", "left_anti")
    variant = F.when(~F.col("fn_name").rlike("[.:]"), "file-local").when(F.col("internal"), "internal").when(F.lit(no_caller), "no-caller")
    return finding(left.withColumn("v", variant).where("v is not null"), "info", "dead-function", detail=F.concat_ws(" ", "fn_key", "v"))


EXTRA: dict[str, Callable[..., DataFrame]] = {}


def check(name: str):
    """Register a rule of one's own: a function that gives findings."""

    def add(rule):
        EXTRA[name] = rule
        return rule

    return add


def extra(*tables) -> list[DataFrame]:
    """The findings of all rules that are registered, each given the same tables."""
    return [rule(*tables).select("severity", "check", "node_id", "detail") for rule in EXTRA.values()]


def all_of(*rules: DataFrame) -> DataFrame:
    """The union of findings, each with its message, numbered in total order (severity, check, node, detail)."""
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    texts = out.sparkSession.createDataFrame(list(MESSAGES.items()), "check string, template string")
    filled = F.replace(F.replace("template", F.lit("{node}"), F.coalesce("node_id", F.lit("?"))), F.lit("{detail}"), F.coalesce("detail", F.lit("?")))
    return out.join(F.broadcast(texts), "check", "left").withColumn("message", filled).select("severity", "check", "node_id", "detail", "message")


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy("severity", "check", "node_id", "detail")


def gate(before: DataFrame, after: DataFrame, findings: DataFrame) -> bool:
    """True where the written artifact equals a fresh one and no finding is an error."""
    same = before.exceptAll(after).isEmpty() and after.exceptAll(before).isEmpty()
    return same and findings.where("severity = 'error'").isEmpty()


