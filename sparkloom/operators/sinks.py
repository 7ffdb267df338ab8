"""Sinks: the map as JSON, Markdown, graphs and findings in exchange formats; text is made in columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions.scalar import escaped_label, escaped_markdown
from sparkloom.operators.trees import ancestor_at

#: Levels of findings in the exchange format, and colours of a badge from a percentage.
LEVELS = {"error": "error", "warn": "warning", "info": "note"}
COLOURS = ((90, "brightgreen"), (70, "yellow"), (0, "red"))


def node_json(nodes: DataFrame) -> DataFrame:
    """(ord, json): one line for each node, keys in order."""
    fields = sorted(c for c in nodes.columns if c != "ord")
    return nodes.select("ord", F.to_json(F.struct(*fields)).alias("json"))


def write_map(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as Parquet below path; edges are parted by kind where they have one."""
    for name, df in tables.items():
        out = df.write.mode("overwrite")
        (out.partitionBy("kind") if name == "edges" and "kind" in df.columns else out).parquet(f"{path}/{name}")


def markdown(nodes: DataFrame) -> DataFrame:
    """(ord, text): a bullet for each node, indented by depth."""
    module = F.coalesce(F.concat(F.lit(" — "), escaped_markdown(F.when(F.col("summary") != "", F.col("summary")))), F.lit(""))
    return nodes.select("ord", F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("- **"), escaped_markdown(F.col("name")), F.lit("**"), module).alias("text"))


def mermaid_tree(nodes: DataFrame, depth: int = 2) -> DataFrame:
    """(line) of a graph of folders down to a depth."""
    return nodes.where((F.col("depth") <= depth) & (F.col("kind") == "namespace") & F.col("parent_id").isNotNull()).select(F.format_string('  "%s" --> "%s"', escaped_label(F.col("parent_id")), escaped_label(F.col("node_id"))).alias("line"))


def mermaid_deps(nodes: DataFrame, edges: DataFrame, depth: int = 1) -> DataFrame:
    """(line): edges rolled up to the ancestors at a depth, each once, none to itself."""
    up = ancestor_at(nodes, depth)
    a, b = up.select(F.col("node_id").alias("src"), F.col("group_id").alias("a")), up.select(F.col("node_id").alias("dst"), F.col("group_id").alias("b"))
    return edges.join(a, "src").join(b, "dst").where("a != b").select("a", "b").distinct().select(F.format_string('  "%s" --> "%s"', escaped_label(F.col("a")), escaped_label(F.col("b"))).alias("line"))


def dot(edges: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """(line) of a directed graph, of edges within a scope (node) if given; lazy edges dashed."""
    if scope is not None:
        edges = edges.join(scope.select(F.col("node").alias("src")), "src", "left_semi").join(scope.select(F.col("node").alias("dst")), "dst", "left_semi")
    lazy = F.when(F.col("deferred"), " [style=dashed]").otherwise("") if "deferred" in edges.columns else F.lit("")
    return edges.select(F.concat(F.format_string('  "%s" -> "%s"', escaped_label(F.col("src")), escaped_label(F.col("dst"))), lazy, F.lit(";")).alias("line")).distinct()


def exchange_column(findings: DataFrame):
    level = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])[F.col("severity")]
    region = F.struct(F.lit(1).alias("startLine"))  # findings are of files: line 1 says no more than the file
    place = F.when(F.col("node_id").isNotNull(), F.array(F.struct(F.struct(F.struct(F.col("node_id").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))))
    return F.to_json(F.struct(F.col("check").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), place.alias("locations")))


def exchange(findings: DataFrame) -> DataFrame:
    """(result): a JSON result for each finding, as in static analysis results format 2.1.0."""
    return findings.select(exchange_column(findings).alias("result"))


def exchange_log(findings: DataFrame, tool: str = "sparkloom") -> DataFrame:
    """(part, at, text): the lines of a whole results log: head, a rule for each check that occurs, results in order, tail.

    Written in the order of part and at it is one JSON document; no row holds more than one result.
    """
    spark = findings.sparkSession
    rules = findings.select("check").distinct().withColumn("at", F.row_number().over(Window.orderBy("check")))  # checks are few
    rule = F.to_json(F.struct(F.col("check").alias("id"), F.col("check").alias("name"), F.struct(F.col("check").alias("text")).alias("shortDescription")))
    comma = F.when(F.col("at") > 1, ",").otherwise("")
    head = '{"version":"2.1.0","$schema":"https://json.schemastore.org/sarif-2.1.0.json","runs":[{"tool":{"driver":{"name":"' + tool + '","rules":['
    fixed = spark.createDataFrame([(0, 1, head), (2, 1, ']}},"invocations":[{"executionSuccessful":true}],"results":['), (4, 1, "]}]}")], "part int, at long, text string")
    keyed = findings.withColumn("result", exchange_column(findings)).withColumn("key", F.concat_ws("\x01", "severity", "check", "node_id", "detail"))
    spread = keyed.repartitionByRange("key", "result").sortWithinPartitions("key", "result").withColumn("id", F.monotonically_increasing_id())
    results = spread.select(F.lit(3).alias("part"), F.col("id").alias("at"), F.concat(F.when(F.col("id") > 0, ",").otherwise(""), "result").alias("text"))
    return fixed.union(rules.select(F.lit(1), F.col("at").cast("long"), F.concat(comma, rule))).union(results)


def badge(values: DataFrame) -> DataFrame:
    """values (label, pct) with colour."""
    colour = F.lit(COLOURS[-1][1])
    for least, name in reversed(COLOURS):
        colour = F.when(F.col("pct") >= least, name).otherwise(colour)
    return values.withColumn("colour", colour)


def quickfix(rows: DataFrame, text: str) -> DataFrame:
    return rows.select(F.col("path").alias("filename"), F.col("line").alias("lnum"), F.col(text).alias("text"))
