"""Helpers shared by the document operators: shared storage, ranks without one-task groups, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.session import dropped, scratch, shared_dir, stored

__all__ = ["WORD", "components", "documents", "dropped", "held_out", "named", "plain", "ranked", "row_key", "scratch", "shared_dir", "stored", "tie"]
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def plain(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns named c0, c1, ..., and which name each has: no column of a user's can clash with one made inside."""
    of = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*of.values()), of


def named(df: DataFrame, of: dict[str, str]) -> DataFrame:
    """The columns c0, c1, ... of df, under the names they had."""
    return df.select(*of.values()).toDF(*of)


def tie(df: DataFrame, names: list[str]):
    """A hash of some columns, to order rows that are alike in all else; columns that cannot be hashed are left out."""
    return F.xxhash64(F.lit(0), *[F.col(c) for c in names if not any(x in df.schema[c].dataType.simpleString() for x in ("map<", "variant"))])


def row_key(*cols: str):
    """A digest of some columns that tells rows apart, nulls from values too: 32 bytes, never null."""
    text = [F.col(c).cast("string") for c in cols]
    return F.unhex(F.sha2(F.concat(*[F.when(t.isNull(), "n").otherwise(F.concat(F.length(t).cast("string"), F.lit(":"), t)) for t in text]), 256))


def held_out(id_col) -> F.Column:
    """True where crc32 of the id, written as text, leaves no remainder by 5."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def ranked(df: DataFrame, group: list[str], order: list[str], name: str, buckets: int = 256, total: str | None = None) -> DataFrame:
    """Number the rows of each group from 0, gapless, in pseudorandom order; total: column for the group's size.

    Each group is cut into hash buckets of the order columns, the buckets' counts give offsets, and
    row_number runs within one bucket only. So a group with a third of all rows is spread over `buckets` keys.
    With no group columns the whole table is one group.
    """
    keys = [*group, "_b"]
    dealt = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    across = Window.partitionBy(*group) if group else Window.partitionBy()
    offsets = counts.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.coalesce(F.sum("_n").over(across.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"),
        *([F.sum("_n").over(across).alias("_t")] if total else []),
    )
    same = None
    for i, k in enumerate(keys):
        one = dealt[k].eqNullSafe(offsets[f"_k{i}"])
        same = one if same is None else same & one
    out = dealt.join(offsets, same).withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1 + F.col("_o"))
    if total:
        out = out.withColumn(total, F.col("_t"))
    return out.select(*df.columns, F.col(name).cast("long"), *([F.col(total).cast("long")] if total else []))


def _mixed(c, turn: int):
    """A bijection on longs (xor and shifts only), another one each turn."""
    c = c.bitwiseXOR(F.lit((0x9E3779B97F4A7C15 * (turn + 1) & 0x7FFFFFFFFFFFFFFF)))
    c = c.bitwiseXOR(F.shiftleft(c, 13))
    c = c.bitwiseXOR(F.shiftrightunsigned(c, 7))
    return c.bitwiseXOR(F.shiftleft(c, 17))


def components(edges: DataFrame, turns: int = 200) -> DataFrame:
    """Connected components of edges (a long, b long) -> (node, component = the smallest node reachable).

    Contraction: each turn gives the labels a new pseudorandom order, moves each label to the least of itself and
    its neighbours, and rewrites the edges; so edges shrink by a constant factor on average, on chains too. Every
    turn is written to the shared folder; no part of the graph reaches the driver but a count of edges.
    """
    edges = edges.where(F.col("a") != F.col("b"))
    edges = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = stored(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("label")), "labels")
    for turn in range(turns):
        if not edges.limit(1).count():
            break
        a, b = _mixed(F.col("a"), turn), _mixed(F.col("b"), turn)
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("old"), a.alias("own"), b.alias("other")), F.struct(F.col("b").alias("old"), b.alias("own"), a.alias("other")))).alias("x")).select("x.*")
        moves = stored(both.groupBy("old").agg(F.least(F.min("own"), F.min("other")).alias("new")), "moves")
        left, right = moves.select(F.col("old").alias("a"), F.col("new").alias("na")), moves.select(F.col("old").alias("b"), F.col("new").alias("nb"))
        shorter = edges.join(left, "a").join(right, "b").where("na != nb").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct()
        renamed = labels.join(moves, labels.label == moves.old, "left").select("node", F.coalesce("new", _mixed(F.col("label"), turn)).alias("label"))
        shorter, renamed = stored(shorter, "edges"), stored(renamed, "labels")
        for old in (edges, labels, moves):
            dropped(old)
        edges, labels = shorter, renamed
    else:
        raise RuntimeError(f"components did not settle in {turns} turns")
    least = stored(labels.groupBy("label").agg(F.min("node").alias("component")), "least")
    return labels.join(least, "label").select("node", "component")
