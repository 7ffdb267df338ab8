"""Routes and tools by name: what an HTTP host or an agent's protocol would serve, as functions that give DataFrames."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import extract as X
from sparkloom.plans import catalog, views  # noqa: F401  views adds its queries
from sparkloom.sources.adapters import Tables

#: Routes by name, and the query that answers each; `commits` takes how many.
ROUTES = {"telemetry": "telemetry_by_node", "telemetry/snapshots": "telemetry_daily", "loaded": "loaded_diff", "loaded/snapshots": "telemetry_recent", "checklist": "checklist_status", "commits": "latest_commits"}
#: Tools by name, their query and what they are for.
TOOLS = {
    "find": ("search_rank", "modules by name"), "node": ("node_lookup", "one node"), "why": ("shortest_path_length", "how one module reaches another"),
    "impact": ("impact_closure", "what depends on a module"), "deps": ("require_edges", "requires"), "findings": ("findings", "checks"),
    "coverage": ("coverage_by_module", "tests by module"), "api": ("api_surface", "public functions"), "diff": ("structural_diff", "changes between snapshots"),
}
EXTRA: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def route(name: str):
    """Register a route of one's own."""

    def add(build: Callable[[SparkSession, str], DataFrame]):
        EXTRA[name] = build
        return build

    return add


def answer(spark: SparkSession, sf_dir: str, name: str, param: str | None = None) -> DataFrame:
    """The rows of a route; `commit/<sha>` gives a commit's hunks. An unknown route, or what is no commit's name, is a ValueError that does not repeat it."""
    if name.startswith("commit/"):
        sha = name.removeprefix("commit/")
        if not re.fullmatch(r"[0-9A-Fa-f]{1,40}", sha):
            raise ValueError("not a commit's name")
        return Tables(spark, sf_dir).hunks.where(F.col("sha").cast("string") == sha.lower())
    if name in EXTRA:
        return EXTRA[name](spark, sf_dir)
    if name not in ROUTES:
        raise ValueError("no such route; there are: " + ", ".join(sorted([*ROUTES, *EXTRA, "commit/<sha>"])))
    if name == "commits" and param is not None:
        return X.commit_list(Tables(spark, sf_dir).commits, int(param))
    return catalog.FOUND[ROUTES[name]](spark, sf_dir)


def call(spark: SparkSession, sf_dir: str, tool: str) -> DataFrame:
    """The rows of a tool."""
    if tool not in TOOLS:
        raise ValueError("no such tool; there are: " + ", ".join(sorted(TOOLS)))
    return catalog.FOUND[TOOLS[tool][0]](spark, sf_dir)


def listed(spark: SparkSession) -> DataFrame:
    """(kind, name, query, about): all routes and tools."""
    rows = [("route", k, v, "") for k, v in ROUTES.items()] + [("route", k, "", "") for k in EXTRA] + [("tool", k, *v) for k, v in TOOLS.items()]
    return spark.createDataFrame(rows, "kind string, name string, query string, about string")
