"""Filters and search over names, modules and summaries."""

from __future__ import annotations

import shlex

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scoped(nodes: DataFrame, prefix: str = "", limit: int = 200, cap: int = 1000) -> DataFrame:
    """Nodes below a prefix, the first by id, with `total`, how many there are; the limit is kept in 1 to cap."""
    held = nodes.where(F.col("node_id").startswith(prefix))
    total = held.agg(F.count(F.lit(1)).alias("total"))
    return held.orderBy("node_id").limit(max(1, min(limit, cap))).join(F.broadcast(total))  # one row


def terms(query: str) -> list[tuple[bool, str]]:
    """(wanted, text) of a query: white space means and, -term not, quotes keep a phrase."""
    lex = shlex.shlex(query, posix=True)
    lex.whitespace_split, lex.commenters, lex.quotes = True, "", '"'
    try:
        found = list(lex)
    except ValueError:
        found = query.replace('"', " ").split()
    return [(not (t.startswith("-") and len(t) > 1), (t[1:] if t.startswith("-") and len(t) > 1 else t).lower()) for t in found if t]


def matches(label: Column, query: str) -> Column:
    """All wanted terms in the label, none of the others, letters alike."""
    out = F.lit(True)
    for wanted, text in terms(query):
        has = F.contains(F.lower(label), F.lit(text))
        out = out & (has if wanted else ~has)
    return out


def ranked(nodes: DataFrame, text: str) -> DataFrame:
    """nodes with rank: 0 the name itself, 1 its start, 2 within name, module or summary; others go."""
    t = F.lit(text.strip().lower())
    name = F.lower("name")
    within = F.contains(F.lower(F.concat_ws("\n", "name", "module", "summary")), t)
    return nodes.withColumn("rank", F.when(name == t, 0).when(F.startswith(name, t), 1).when(within, 2)).where("rank is not null")


def lookup(nodes: DataFrame, key: str) -> DataFrame:
    """The node that a key means: its module, else its id, else its path; the last in order."""
    rank = F.when(F.col("module") == key, 0).when(F.col("node_id") == key, 1).when(F.col("path") == key, 2)
    return nodes.withColumn("rank", rank).where("rank is not null").orderBy("rank", F.desc("ord")).limit(1).drop("rank")


def findings_where(findings: DataFrame, severity: str | None = None, check: str | None = None, node_id: str | None = None) -> DataFrame:
    for column, value in (("severity", severity), ("check", check), ("node_id", node_id)):
        if value is not None:
            findings = findings.where(F.col(column) == value)
    return findings


def whole_groups(members: DataFrame, group: str, text: Column, query: str) -> DataFrame:
    """All members of each group of which one matches."""
    return members.join(members.where(matches(text, query)).select(group).distinct(), group, "left_semi")


def language_facets(nodes: DataFrame) -> DataFrame:
    return nodes.where("language is not null").groupBy("language").agg(F.count(F.lit(1)).alias("n"))


def picker(nodes: DataFrame, fns: DataFrame) -> DataFrame:
    """(label, kind): modules, and module#function."""
    a = nodes.where("module is not null").select(F.col("module").alias("label"), F.lit("module").alias("kind"))
    return a.union(fns.join(nodes.select("node_id", "module"), "node_id").select(F.concat_ws("#", "module", "fn_name"), F.lit("function")))


def without(rows: DataFrame, hidden: DataFrame, key: str) -> DataFrame:
    return rows.join(hidden, key, "left_anti")
