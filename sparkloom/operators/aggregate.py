"""Aggregations: coverage, duplicates, churn, run-time counts, verdicts, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions.scalar import pct
from sparkloom.operators.trees import subtree_sums

#: Good and bad thresholds of each verdict, whether high is good, and its weight.
VERDICTS = {
    "doc_coverage": (80, 50, True, 90), "test_coverage": (70, 30, True, 85), "module_summary": (90, 60, True, 80), "complexity": (90, 70, True, 70),
    "examples": (25, 5, True, 40), "docs_mentions": (50, 10, True, 30), "avg_fn_lines": (25, 45, False, 35), "duplicates": (0, 1, False, 60),
    "drift_errors": (0, 1, False, 100), "drift_warnings": (0, 10, False, 50), "deprecated": (0, 1, False, 45), "todos": (0, 15, False, 25), "recorded_defects": (0, 1, False, 55),
}
#: The least size of a duplicate's shape, evidence kept, what counts as simple.
LEAST_SHAPE, EVIDENCE, SIMPLE = 40, 20, 10


def kind_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


#: What a node counts, itself and below.
COUNTERS = ("modules", "namespaces", "files_lua", "files_md", "files_other", "lines", "functions", "symbols", "types")


def rollup(nodes: DataFrame, stats: DataFrame, columns: list[str] = list(COUNTERS)) -> DataFrame:
    """Each node's columns summed over its subtree, as differences of running sums along the tree's interval labels."""
    return subtree_sums(nodes, stats, columns)


def coverage(fns: DataFrame, by: str, flag: str) -> DataFrame:
    """(by, hit, total, pct) of functions that are not internal."""
    hit = F.sum(F.col(flag).cast("long"))
    return fns.where("not internal").groupBy(by).agg(hit.alias("hit"), F.count(F.lit(1)).alias("total")).withColumn("pct", pct(F.col("hit"), F.col("total")))


def doc_coverage(fns: DataFrame) -> DataFrame:
    """(language, documented, summarised, total)."""
    return fns.where("not internal").groupBy("language").agg(F.sum(F.col("documented").cast("long")).alias("documented"), F.sum((F.col("summary") != "").cast("long")).alias("summarised"), F.count(F.lit(1)).alias("total"))


def mentioned(fns: DataFrame, texts: DataFrame) -> DataFrame:
    """fns whose bare name is a word of any text: distinct words, then a semi join."""
    from sparkloom.functions.scalar import bare_name

    words = texts.select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))).alias("word")).distinct()
    return fns.join(words, bare_name(F.col("fn_name")) == F.col("word"), "left_semi")


def duplicates(fns: DataFrame, least: int = LEAST_SHAPE) -> DataFrame:
    """(shape, size, members, fns): functions of one shape and at least `least` nodes, two or more."""
    return fns.where(F.col("shape_size") >= least).groupBy("shape", "shape_size").agg(F.count(F.lit(1)).alias("members"), F.array_join(F.array_sort(F.collect_list("fn_key")), ",").alias("fns")).where("members > 1")


def commit_counts(commits: DataFrame) -> DataFrame:
    """(path, commits, last_day): each commit counts once for a path."""
    return commits.groupBy("path").agg(F.countDistinct("sha").alias("commits"), F.max("day").alias("last_day"))


def churn(commits: DataFrame, nodes: DataFrame, fns: DataFrame, runtime: DataFrame | None = None, rank: Column | None = None) -> DataFrame:
    """(node_id, commits, complexity, score, hottest, calls): commits times complexity; calls null where none were recorded.

    hottest has the largest rank, an expression over fns: the complexity, then the least k, where none is given.
    """
    rank = F.struct("complexity", -F.col("k")) if rank is None else F.struct(rank, "complexity")
    paths = nodes.select("node_id", "path")
    work = fns.groupBy("node_id").agg(F.sum("complexity").alias("complexity"), F.max_by("fn_key", rank).alias("hottest"))
    out = commit_counts(commits).join(paths, "path").join(work, "node_id").withColumn("score", F.col("commits") * F.col("complexity"))
    if runtime is not None:
        out = out.join(runtime.groupBy("node_id").agg(F.sum("calls").alias("calls")), "node_id", "left")
    return out


def runtime_by_node(runtime: DataFrame) -> DataFrame:
    return runtime.groupBy("node_id").agg(F.sum("calls").alias("calls"), F.count(F.lit(1)).alias("functions"))


def recent(telemetry: DataFrame, now, days: int = 7) -> DataFrame:
    """(name, calls) of the `days` days that end with now, a parameter."""
    return telemetry.where((F.col("day") > F.date_sub(F.lit(now).cast("date"), days)) & (F.col("day") <= F.lit(now).cast("date"))).groupBy("name").agg(F.count(F.lit(1)).alias("calls"))


def untested_hot(fns: DataFrame, runtime: DataFrame) -> DataFrame:
    return fns.where("not tested").join(runtime.select("fn_key", "calls"), "fn_key").where("calls > 0").select("node_id", "fn_key", "calls")


def doc_usage(fns: DataFrame, runtime: DataFrame) -> DataFrame:
    """(documented, used, n): the cross-tab of documents and use, internal functions left out."""
    used = fns.where("not internal").join(runtime.select("fn_key", "calls"), "fn_key", "left")
    return used.groupBy("documented", (F.coalesce("calls", F.lit(0)) > 0).alias("used")).agg(F.count(F.lit(1)).alias("n"))


def checklist_status(items: DataFrame, commits: DataFrame) -> DataFrame:
    """(item, state, newer, last_commit): uncited, unverified, stale (commits since it was verified) or current."""
    history = commits.select(F.col("path").alias("ref"), "sha", "day").distinct()
    met = items.join(history, "ref", "left").groupBy("item", "file", "line", "ref", "verified").agg(F.sum((F.col("day") > F.col("verified")).cast("long")).alias("newer"), F.max("day").alias("last_commit"))
    state = F.when(F.col("ref").isNull(), "uncited").when(F.col("verified").isNull(), "unverified").when(F.coalesce("newer", F.lit(0)) > 0, "stale").otherwise("current")
    return met.select("item", "file", "line", state.alias("state"), F.coalesce("newer", F.lit(0)).alias("newer"), "last_commit")


def fan(edges: DataFrame) -> DataFrame:
    """(node_id, fan_in, fan_out)."""
    i, o = edges.groupBy(F.col("dst").alias("node_id")).agg(F.countDistinct("src").alias("fan_in")), edges.groupBy(F.col("src").alias("node_id")).agg(F.countDistinct("dst").alias("fan_out"))
    return i.join(o, "node_id", "full").select("node_id", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


def tag_adoption(fns: DataFrame, tags: list[str]) -> DataFrame:
    """(tag, functions, files, pct) for boolean columns: how many functions carry each tag, and in how many files."""
    pairs = fns.select("fn_key", "node_id", F.explode(F.array(*[F.struct(F.lit(t).alias("tag"), F.col(t).alias("has")) for t in tags])).alias("x")).select("fn_key", "node_id", "x.tag", "x.has")
    hit = pairs.groupBy("tag").agg(F.sum(F.col("has").cast("long")).alias("functions"), F.countDistinct(F.when(F.col("has"), F.col("node_id"))).alias("files"), F.count(F.lit(1)).alias("total"))
    return hit.select("tag", "functions", "files", pct(F.col("functions"), F.col("total")).alias("pct"))


def probes(fns: DataFrame, nodes: DataFrame, findings: DataFrame) -> DataFrame:
    """(probe, value) in long form: one-row conditional aggregates; a probe without a denominator is skipped."""
    f = fns.where("not internal").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("documented").cast("long")).alias("doc"), F.sum(F.col("tested").cast("long")).alias("test"))
    a = fns.agg(F.count(F.lit(1)).alias("all"), F.sum((F.col("complexity") <= SIMPLE).cast("long")).alias("simple"), F.avg(F.col("line_end") - F.col("line") + 1).alias("lines"))
    m = nodes.where("kind = 'module'").agg(F.count(F.lit(1)).alias("modules"), F.sum((F.coalesce("summary", F.lit("")) != "").cast("long")).alias("summed"))
    d = findings.agg(F.sum((F.col("severity") == "error").cast("long")).alias("errors"), F.sum((F.col("severity") == "warn").cast("long")).alias("warnings"))
    g = duplicates(fns).agg(F.count(F.lit(1)).alias("dup"))
    one = f.join(F.broadcast(a)).join(F.broadcast(m)).join(F.broadcast(d)).join(F.broadcast(g))  # one row each
    pairs = {"doc_coverage": F.when(F.col("n") > 0, pct(F.col("doc"), F.col("n"))), "test_coverage": F.when(F.col("n") > 0, pct(F.col("test"), F.col("n"))), "module_summary": F.when(F.col("modules") > 0, pct(F.col("summed"), F.col("modules"))), "complexity": F.when(F.col("all") > 0, pct(F.col("simple"), F.col("all"))), "avg_fn_lines": F.floor(F.col("lines") * 10 + 0.5) / 10, "duplicates": F.col("dup"), "drift_errors": F.coalesce("errors", F.lit(0)), "drift_warnings": F.coalesce("warnings", F.lit(0))}
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("probe"), v.cast("double").alias("value")) for k, v in pairs.items()])).alias("x")).select("x.*").where("value is not null")


def tag_probes(fns: DataFrame, tags: DataFrame, texts: DataFrame) -> DataFrame:
    """(probe, value): public functions with an example, and named in prose, in percent; deprecated ones, todos and recorded bugs, counted.

    tags as doc_tags() gives them, their node_id the function's key. A percentage of no functions is left out.
    """
    public = fns.where("not internal").select("fn_key", "fn_name")
    with_example = tags.where("tag = 'example'").select(F.col("node_id").alias("fn_key")).distinct()
    a = public.join(with_example.withColumn("has", F.lit(1)), "fn_key", "left").agg(F.count(F.lit(1)).alias("n"), F.count("has").alias("examples"))
    b = mentioned(public, texts).agg(F.count(F.lit(1)).alias("mentions"))
    c = tags.agg(*[F.count_if(F.col("tag") == t).alias(n) for t, n in (("deprecated", "deprecated"), ("todo", "todos"), ("bug", "recorded_defects"))])
    one = a.join(F.broadcast(b)).join(F.broadcast(c))  # one row each
    pairs = {"examples": F.when(F.col("n") > 0, pct(F.col("examples"), F.col("n"))), "docs_mentions": F.when(F.col("n") > 0, pct(F.col("mentions"), F.col("n")))} | {k: F.col(k) for k in ("deprecated", "todos", "recorded_defects")}
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("probe"), v.cast("double").alias("value")) for k, v in pairs.items()])).alias("x")).select("x.*").where("value is not null")


def evidence(rows: DataFrame, by: str, what: str, most: int = EVIDENCE) -> DataFrame:
    """(by, rank, what, total): the first `most` of each group in order, and how many there are; each task keeps its own first ones before the shuffle."""
    w = Window.partitionBy(by).orderBy(what)
    first = rows.select(by, what).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    return first.join(rows.groupBy(by).agg(F.count(F.lit(1)).alias("total")), by).select(by, "rank", what, "total")


def judged(values: DataFrame, most: int = 5, **overrides: tuple[float, float]) -> DataFrame:
    """(probe, value, verdict, distance, weight, rank): the first `most` of each verdict by weight and distance."""
    rows = [(k, float(overrides.get(k, v)[0]), float(overrides.get(k, v)[1]), v[2], v[3]) for k, v in VERDICTS.items()]
    table = values.sparkSession.createDataFrame(rows, "probe string, good double, bad double, high boolean, weight int")
    met = values.join(F.broadcast(table), "probe")
    good = F.when(F.col("high"), F.col("value") >= F.col("good")).otherwise(F.col("value") <= F.col("good"))
    bad = F.when(F.col("high"), F.col("value") < F.col("bad")).otherwise(F.col("value") >= F.col("bad"))
    met = met.withColumn("verdict", F.when(good, "good").when(bad, "bad")).where("verdict is not null").withColumn("distance", F.abs(F.col("value") - F.when(good, F.col("good")).otherwise(F.col("bad"))))
    w = Window.partitionBy("verdict").orderBy(F.desc("weight"), F.desc("distance"), "probe")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("probe", "value", "verdict", "distance", "weight", "rank")


def severity_tally(findings: DataFrame) -> DataFrame:
    """(severity, n), zeros kept."""
    kinds = findings.sparkSession.createDataFrame([("error",), ("warn",), ("info",)], "severity string")
    return kinds.join(findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n")), "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


def collisions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with n, how many share the keys, and the flag `collides`."""
    many = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))  # counted before the shuffle; a join splits keys that many rows share
    return rows.join(many, keys).withColumn("collides", F.col("n") > 1)


def az_buckets(names: DataFrame, column: str = "name") -> DataFrame:
    """(bucket, n): by first letter in upper case; anything else is #."""
    first = F.upper(F.substring(column, 1, 1))
    return names.groupBy(F.when(first.rlike("^[A-Z]$"), first).otherwise("#").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def compare_matrix(rows: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """(attribute, values, differs): each attribute's values by key, and whether they differ."""
    long = rows.select(key, F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.coalesce(F.col(a).cast("string"), F.lit("-")).alias("value")) for a in attributes])).alias("x")).select(key, "x.*")
    return long.groupBy("attribute").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "value"))), lambda x: x["value"]), "|").alias("vals"), (F.countDistinct("value") > 1).alias("differs"))


def facets(nodes: DataFrame, most: int = 1000) -> DataFrame:
    """(node_id, languages): the languages below each node, sorted; a counter for each language along the interval labels.

    Languages are those of a registry; more than `most` are an error.
    """
    known = [r[0] for r in nodes.where("language is not null").select("language").distinct().orderBy("language").limit(most + 1).collect()]
    if len(known) > most:
        raise ValueError(f"more than {most} languages")
    own = nodes.select("node_id", *[(F.col("language").eqNullSafe(n)).cast("long").alias(f"l{k}") for k, n in enumerate(known)])
    sums = subtree_sums(nodes, own, [f"l{k}" for k in range(len(known))])
    names = F.array_compact(F.array(*[F.when(F.col(f"l{k}") > 0, n) for k, n in enumerate(known)]).cast("array<string>"))
    return sums.select("node_id", F.array_join(names, ",").alias("languages")).where("languages != ''")
