"""Reading source trees, artifacts and logs as tables; language settings."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Language, extension, in registration order.
BACKENDS = [(lang, ext) for lang, exts in (
    ("lua", "lua"), ("javascript", "js jsx mjs cjs"), ("typescript", "ts"), ("tsx", "tsx"), ("python", "py pyi"), ("go", "go"), ("rust", "rs"), ("c", "c h"),
    ("cpp", "cpp cc cxx hpp hh hxx"), ("java", "java"), ("csharp", "cs"), ("kotlin", "kt kts"), ("scala", "scala"), ("swift", "swift"), ("php", "php"),
    ("ruby", "rb"), ("dart", "dart"), ("zig", "zig"), ("haskell", "hs"), ("elixir", "ex exs"), ("erlang", "erl hrl"), ("ocaml", "ml mli"), ("asm", "s asm nasm inc"),
) for ext in exts.split()]
#: Files that own their folder.
OWNERS = ("init.lua", "__init__.py", "index.js", "index.ts", "mod.rs")


def tree(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path, content, mtime, length) of the text files below a root, through Spark's reader only."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    base = root.rstrip("/").split("://", 1)[-1]
    rel = F.regexp_replace("path", rf"^[A-Za-z0-9]+:/*{base.lstrip('/')}/", "")
    return reader.load(root).select(rel.alias("path"), F.col("content").cast("string").alias("content"), F.col("modificationTime").alias("mtime"), "length")


def artifact(spark: SparkSession, path: str) -> DataFrame:
    """(ord, node fields) of a written map: its nodes in order."""
    doc = spark.read.option("multiLine", "true").json(path)
    return doc.select(F.posexplode("nodes").alias("ord", "n")).select("ord", "n.*")


def table_or_empty(spark: SparkSession, path: str | None, schema: str) -> DataFrame:
    """A table that may be absent: then empty, with its schema."""
    return spark.read.schema(schema).parquet(path) if path else spark.createDataFrame([], schema)


def changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """Files that are new or differ in length or time from an earlier listing."""
    return now.join(before.select("path", "length", "mtime"), ["path", "length", "mtime"], "left_anti")


def owned(files: DataFrame) -> DataFrame:
    """files with owner_of: the folder whose module the file is, by name; null for others."""
    name = F.regexp_extract("path", "([^/]+)$", 1)
    folder = F.when(F.contains("path", F.lit("/")), F.regexp_extract("path", "^(.*)/[^/]*$", 1)).otherwise(F.lit("."))
    return files.withColumn("owner_of", F.when(name.isin(*OWNERS), folder))


def at_revision(artifacts: DataFrame, rev: str) -> DataFrame:
    """The snapshot of a revision, of artifacts that carry their revision in `rev`; a hash may be given short, if one revision begins so."""
    revs = artifacts.where(F.col("rev").startswith(rev)).select("rev").distinct().limit(2).collect()
    exact = [r for r in revs if r["rev"] == rev]
    if not exact and len(revs) != 1:
        raise ValueError("no revision, or more than one, begins like that")
    return artifacts.where(F.col("rev") == (exact or revs)[0]["rev"])


def consumers(spark: SparkSession, root: str, name: str = "module_map.json") -> DataFrame:
    """(consumer, ord, node fields) of the maps that sibling projects have written below a root; the consumer is the folder below the root."""
    base = re.escape(root.rstrip("/").split("://", 1)[-1])
    doc = spark.read.option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", name).json(root)
    who = F.regexp_extract(F.input_file_name(), base + r"/+([^/]+)/", 1)
    return doc.withColumn("consumer", who).select("consumer", F.posexplode("nodes").alias("ord", "n")).select("consumer", "ord", "n.*")


def by_project(trees: dict[str, DataFrame]) -> DataFrame:
    """Tables of several projects as one, with a column `project`."""
    out = None
    for name, rows in sorted(trees.items()):
        rows = rows.withColumn("project", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out
