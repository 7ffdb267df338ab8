"""Repeated passages by line: overlapping windows of three lines, later occurrences of a repeated window removed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import named, plain, stored


def _hashes(lines):
    """Two independent 64-bit hashes of each line."""
    return F.transform(lines, lambda x: F.xxhash64(x)), F.transform(lines, lambda x: F.xxhash64(F.concat(F.lit("\x01"), x)))


def _digest(text):
    """128 bits of a text, as two longs: what tells rows of one id, or of none, apart."""
    return F.xxhash64(text), F.xxhash64(F.lit("\x01"), text)


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(row, pos, k1, k2) of each window of `width` lines; pos counts lines from 0.

    row is a struct (whether the id is null, id, digest of the text): rows in order, those without an id last.
    """
    rows, of = plain(docs)
    i, t = F.col(of[id_col]), F.col(of[text_col])
    d1, d2 = _digest(t)
    lines = rows.select(F.struct(i.isNull().alias("none"), i.alias("id"), d1.alias("d1"), d2.alias("d2")).alias("row"), F.split(t, "\n", -1).alias("lines")).where(F.size("lines") >= width)
    one, two = _hashes(F.col("lines"))
    both = lines.select("row", one.alias("a"), two.alias("b"))
    at = lambda c, i: [F.get(F.col(c), i + k) for k in range(width)]
    keys = F.transform(F.sequence(F.lit(0), F.size("a") - width), lambda i: F.struct(F.xxhash64(*at("a", i)).alias("k1"), F.xxhash64(*at("b", i)).alias("k2")))
    return both.select("row", F.posexplode(keys).alias("pos", "k")).select("row", "pos", "k.k1", "k.k2")


def covered_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(row, covered: array of positions) that later occurrences of repeated windows cover; only rows that have some.

    The first occurrence of a window is the one of the first row, then of the smallest position; it stays. It is
    found by a map-side combined minimum: a window in a third of all documents costs a row for each task. Repeated
    windows alone are written and joined back.
    """
    seen = windows(docs, id_col, text_col, width).select("k1", "k2", F.struct("row", "pos").alias("occ"))
    first = stored(seen.groupBy("k1", "k2").agg(F.min("occ").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("k1", "k2", "first"), "windows")
    later = seen.join(first, ["k1", "k2"]).where(~F.col("occ").eqNullSafe(F.col("first")))
    lines = later.select("occ.row", F.explode(F.sequence(F.col("occ.pos"), F.col("occ.pos") + width - 1)).alias("line"))
    return lines.groupBy("row").agg(F.collect_set("line").alias("covered"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """docs with text_col cut, and n_lines, n_removed (long) added.

    Texts of under `width` lines have no window and stay as they are, as do texts with no repeated window; a text
    that is covered whole becomes empty. Null text stays null with n_lines 0. Rows are told apart by id and text,
    and come in the order of id (none last), then of the text's digest: other texts under one id, or without an id,
    are documents of their own. Rows that repeat both count as the same occurrence, so none of them removes
    another's lines. Any column names do, but a column named n_lines or n_removed in docs is replaced.
    """
    marks = covered_lines(docs, id_col, text_col, width)
    rows, of = plain(docs.select(*[docs[f"`{c}`"] for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]))
    i, t = F.col(of[id_col]), F.col(of[text_col])
    d1, d2 = _digest(t)
    marks = marks.select(F.col("row.id").alias("m_id"), F.col("row.d1").alias("m1"), F.col("row.d2").alias("m2"), "covered")
    joined = rows.join(marks, (d1 == F.col("m1")) & (d2 == F.col("m2")) & i.eqNullSafe(F.col("m_id")) & t.isNotNull(), "left").withColumn("lines", F.split(t, "\n", -1))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("covered"))
    text = F.when(F.col("covered").isNull(), t).otherwise(F.array_join(F.transform(kept, lambda k: F.get(F.col("lines"), k)), "\n"))
    out = joined.select(
        *[text.alias(c) if c == of[text_col] else F.col(c) for c in of.values()],
        F.when(t.isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.when(F.col("covered").isNull(), 0).otherwise(F.size("covered")).cast("long").alias("n_removed"),
    )
    return named(out, of | {"n_lines": "n_lines", "n_removed": "n_removed"})


ORACLE = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, i, x[i] || chr(10) || x[i + 1] || chr(10) || x[i + 2] AS t
      FROM (SELECT doc_id, x, unnest(range(1, len(x) - 1)) AS i FROM l WHERE len(x) >= 3)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS n FROM w),
c AS (SELECT doc_id, list(DISTINCT i + k) AS c FROM r, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(l.x), 0) AS n_lines, coalesce(len(c.c), 0) AS n_removed,
       CASE WHEN c.c IS NULL THEN d.text
            ELSE array_to_string(list_transform(list_filter(range(1, len(l.x) + 1), lambda i: NOT list_contains(c.c, i)), lambda i: l.x[i]), chr(10)) END AS text
FROM documents d LEFT JOIN l ON d.doc_id = l.doc_id LEFT JOIN c ON d.doc_id = c.doc_id
"""
