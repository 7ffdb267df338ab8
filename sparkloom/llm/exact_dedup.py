"""Exact duplicates: group by a 128-bit content hash, compare bytes inside the groups, keep one stable id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import named, plain, tie


def content_hash(text):
    return F.unhex(F.md5(text))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", digest=content_hash) -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; grouping on (hash, text) compares the bytes inside each hash group, so
    texts whose hashes collide stay apart. `keep` is min or max of the ids. The map side counts copies before
    the shuffle, so a group with a third of all rows arrives as a row for each task; the join back to the
    documents moves ids and digests (MD5 and SHA-256) only, and its large keys are split by adaptive execution.

    Null text counts as empty. Rows that repeat both id and text give a row each, all alike, and count each. A
    null id stays only where its group has no other. An empty table gives no rows. Other columns of docs are not
    read, whatever their names.
    """
    rows, of = plain(docs)
    rows = rows.select(F.col(of[id_col]).alias("_id"), F.coalesce(F.col(of[text_col]), F.lit("")).alias("_text"))
    marked = rows.select("_id", "_text", digest(F.col("_text")).alias("_h"))
    best = F.max("_id") if keep == "max" else F.min("_id")
    groups = marked.groupBy("_h", "_text").agg(best.alias("keep_id"), F.count(F.lit(1)).alias("group_size")).select("_h", F.unhex(F.sha2("_text", 256)).alias("_sha"), "keep_id", "group_size")
    each = marked.select("_id", "_h", F.unhex(F.sha2("_text", 256)).alias("_sha"))
    return each.join(groups, ["_h", "_sha"]).select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", digest=content_hash) -> DataFrame:
    """One row of docs for each text, with all its columns: the one that exact_groups keeps.

    Rows are grouped as there, by (hash, text), and the group itself carries the row that stays, so a text is moved
    once, after a map-side choice, and nothing is joined. Another text under the same id, or without an id, is a
    group of its own. Of rows that repeat id and text the least by a hash of the other columns stays; a null id
    stays only where its group has no other; null and empty texts are one group. Any column names do.
    """
    rows, of = plain(docs)
    i, t = of[id_col], of[text_col]
    others = [c for c in of.values() if c != t]
    rows = rows.withColumn("_text", F.coalesce(F.col(t), F.lit(""))).withColumn("_none", F.col(t).isNull())
    order = F.struct(F.col(i).isNotNull() if keep == "max" else F.col(i).isNull(), F.col(i), tie(rows, others), F.col("_none"))
    best = (F.max_by if keep == "max" else F.min_by)(F.struct(*others, "_none"), order)
    groups = rows.withColumn("_h", digest(F.col("_text"))).groupBy("_h", "_text").agg(best.alias("_row"))
    text = F.when(F.col("_row._none"), None).otherwise(F.col("_text"))
    return named(groups.select(*[F.col(f"_row.{c}").alias(c) for c in others], text.alias(t)), of)


ORACLE = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.text) AS text_sha256
FROM t JOIN g ON t.text = g.text
"""
