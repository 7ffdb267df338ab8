"""Interval joins by equality: a span is covered by dyadic intervals, a point lies in one of each size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cover(first: str, last: str) -> Column:
    """The least dyadic intervals (level, cell: [cell * 2^level, (cell + 1) * 2^level)) that make up first..last: two for each power of two up to the length at most; none if last < first.

    At each level the multiples of 2^level inside the span are counted: an odd one at either end is not part of an interval
    twice as long.
    """
    low, high = f"shiftright({first} + shiftleft(1L, k) - 1, k)", f"shiftright({last} + 1, k)"
    cells = f"array(if({low} < {high} AND {low} % 2 != 0, {low}, NULL), if({low} < {high} AND {high} % 2 != 0, {high} - 1, NULL))"
    levels = f"if({last} >= {first}, sequence(0, cast(log2({last} - {first} + 1) AS int) + 1), CAST(array() AS array<int>))"
    return F.expr(f"flatten(transform({levels}, k -> transform(filter({cells}, c -> c IS NOT NULL), c -> struct(k AS level, c AS cell))))")


def inside(points: DataFrame, at: str, spans: DataFrame, first: str, last: str, keys: list[str]) -> DataFrame:
    """Each point with each span of its keys that holds it, once: both sides' columns, which differ but for the keys.

    A span comes as its cover, a point as the cells of those sizes only that spans of its keys have. The join is by
    equality of keys, size and cell; what it makes are the results and nothing else.
    """
    cells = spans.where(F.col(first).isNotNull() & F.col(last).isNotNull()).select("*", F.explode(cover(f"cast({first} AS bigint)", f"cast({last} AS bigint)")).alias("_c")).select("*", "_c.level", "_c.cell").drop("_c")
    sizes = cells.groupBy(*keys).agg(F.collect_set("level").alias("_levels"))
    dealt = points.join(sizes, keys).select("*", F.explode("_levels").alias("level")).drop("_levels").withColumn("cell", F.expr(f"shiftright(cast({at} AS bigint), level)"))
    return dealt.join(cells, [*keys, "level", "cell"]).drop("level", "cell")


def overlapping(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of spans (keys, a_first, a_last, ...) and (keys, b_first, b_last, ...) with a common point: one begins inside the other."""
    begun = inside(a, "a_first", b, "b_first", "b_last", keys).where("a_last >= a_first")
    holds = inside(b, "b_first", a, "a_first", "a_last", keys).where("b_first > a_first AND b_last >= b_first")
    return begun.unionByName(holds.select(*begun.columns))


def meeting(a: DataFrame, b: DataFrame, keys: list[str], bits: int = 8, most: int = 16) -> DataFrame:
    """The pairs of overlapping(), where a has very many short spans: they are sent once each and not once a size.

    Lines fall into blocks of 2^bits; a span is a row for each block it lies in, those of b are a list for each block, and a pair is
    given by the block in which the later of both begins. Spans of more than `most` blocks go by their covers. An a that
    ends before it begins meets what holds both its ends.
    """
    blocks = lambda x: F.expr(f"sequence(shiftright(cast({x}_first AS bigint), {bits}), shiftright(cast(greatest({x}_first, {x}_last) AS bigint), {bits}))")
    long = lambda x: F.coalesce(F.expr(f"shiftright(cast({x}_last AS bigint), {bits}) - shiftright(cast({x}_first AS bigint), {bits}) >= {most}"), F.lit(False))
    own = [c for c in b.columns if c not in keys]
    lists = b.where(~long("b")).where("b_last >= b_first").select(*keys, F.explode(blocks("b")).alias("_block"), F.struct(*own).alias("_b")).groupBy(*keys, "_block").agg(F.collect_list("_b").alias("_bs"))
    cut = a.where(~long("a")).where("a_first is not null and a_last is not null").select("*", F.explode(blocks("a")).alias("_block"))
    fits = F.filter("_bs", lambda x: (x["b_first"] <= F.col("a_last")) & (x["b_last"] >= F.col("a_first")) & (F.shiftright(F.greatest(x["b_first"], F.col("a_first")).cast("long"), bits) == F.col("_block")))
    out = cut.join(lists, [*keys, "_block"]).select(*a.columns, F.explode(fits).alias("_b")).select(*a.columns, "_b.*")
    if not b.where(long("b")).isEmpty():
        out = out.unionByName(overlapping(a.where(~long("a")), b.where(long("b")), keys).select(*out.columns))
        turned = inside(a.where("a_last < a_first"), "a_last", b.where(long("b")), "b_first", "b_last", keys).where("b_last >= a_first")
        out = out.unionByName(turned.select(*out.columns))
    if not a.where(long("a")).isEmpty():
        out = out.unionByName(overlapping(a.where(long("a")), b, keys).select(*out.columns))
    return out
