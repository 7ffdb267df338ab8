"""Mixing sources to target weights: fixed-length blocks of words drawn through pseudorandom index permutations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.llm.common import WORD, named, plain, row_key, stored, tie

#: Weights of the sources by code point, null last, repeating; the words they share, as a part of all; the most a source gives, in times its size.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
BLOCK, SHARD_SLOTS, SEED, BUCKETS = 256, 16384, 20240229, 256
#: A hash bucket of a source for each 2^26 words of all, BUCKETS at least.
WORDS_BITS = 26
#: Copies of a repeated row that are listed at once.
COPIES = 65536


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """What each source gives: `share` of all by weight; above `most` times its size it stops there, and the excess is shared anew."""
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while free:
        weight = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / weight > most * sizes[i]}
        if not over:
            for i in free:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        free -= over
    return out


def _mixed(x, key: int):
    x = (x ^ np.uint64(key)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def permuted(at: np.ndarray, count: int, key: int, back: bool = False) -> np.ndarray:
    """A pseudorandom permutation of range(count), or its inverse, at any indexes: four Feistel rounds, walked until in range."""
    half = max(1, ((max(count - 1, 1)).bit_length() + 1) // 2)
    low, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out = at.astype(np.uint64)
    todo = np.ones(len(out), dtype=bool)
    while todo.any():
        x = out[todo]
        left, right = x >> shift, x & low
        for turn in reversed(range(4)) if back else range(4):
            seed = (key * 8 + turn) & 0xFFFFFFFFFFFFFFFF
            if back:
                left, right = right ^ (_mixed(left, seed) & low), left
            else:
                left, right = right, left ^ (_mixed(right, seed) & low)
        out[todo] = (left << shift) | right
        todo &= out >= np.uint64(count)
    return out.astype(np.int64)


def _key(source: int, epoch: int, seed: int) -> int:
    return int(_mixed(np.array([source * 1_000_003 + epoch], dtype=np.uint64), seed)[0] >> np.uint64(4))


def slots(size: int, target: float, source: int, block: int = BLOCK, seed: int = SEED) -> tuple[int, int]:
    """How many blocks of a source are drawn, and the words taken of the last of them: the target, to the word."""
    goal = min(int(round(target)), MOST * size)
    if not size or not goal:
        return 0, 0
    count = -(-size // block)
    epochs, rest = divmod(goal, size)
    last = size - (count - 1) * block
    if not rest:
        end = permuted(np.array([count - 1]), count, _key(source, epochs - 1, seed))[0]
        return epochs * count, last if end == count - 1 else block
    perm_at = permuted(np.array([count - 1]), count, _key(source, epochs, seed), back=True)[0]
    n = -(-rest // block)
    words = lambda k: k * block - (block - last if perm_at < k else 0)
    if words(n) < rest:
        n += 1
    return int(epochs * count + n), int(rest - words(n - 1))


def _taken(rng: np.random.Generator, left: np.ndarray, take: int) -> np.ndarray:
    """How many of `take` items drawn from left[i] of each kind are of each kind: hypergeometric, kind after kind.

    Beyond a thousand million items, where numpy has no such draw, the normal law of the same mean and variance, rounded and kept possible.
    """
    out, rest = np.zeros(len(left), dtype=np.int64), int(left.sum())
    for i, n in enumerate(map(int, left)):
        others = rest - n
        low, high = max(0, take - others), min(n, take)
        if low == high:
            got = low
        elif rest < 1_000_000_000:
            got = int(rng.hypergeometric(n, others, take))
        else:
            mean = take * n / rest
            spread = np.sqrt(mean * (others / rest) * ((rest - take) / (rest - 1)))
            got = min(high, max(low, int(round(rng.normal(mean, spread)))))
        out[i], rest, take = got, others, take - got
    return out


def draws(counts: list[int], shards: int, first: int, end: int, seed: int = SEED):
    """(source, shard, first slot, end slot) of the shards from `first` to `end`: multinomial source counts of each, given the sources' totals.

    A multinomial draw conditioned on its totals is multivariate hypergeometric. It is drawn down a binary tree of
    ranges of shards, each node with a seed of its own, so any part of the shards can be drawn alone, anywhere, in
    time that grows with that part and the tree's depth, and agrees with every other part.
    """

    def down(low: int, high: int, left: np.ndarray, used: np.ndarray):
        if high <= first or low >= end:
            return
        if high - low == 1:
            for i in np.nonzero(left)[0]:
                yield int(i), low, int(used[i]), int(used[i] + left[i])
            return
        middle, total = (low + high) // 2, int(left.sum())
        half = _taken(np.random.default_rng([seed, low, high]), left, total * (middle - low) // (high - low))
        yield from down(low, middle, half, used)
        yield from down(middle, high, left - half, used + half)

    if shards and counts:
        yield from down(0, shards, np.array(counts, dtype=np.int64), np.zeros(len(counts), dtype=np.int64))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, block: int = BLOCK, per_shard: int = SHARD_SLOTS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The mix, and the sources: (shard, slot, source number, block, epoch, id, first word, words, key, words of one copy), (key, id, size, copies, sid, source_size, target).

    Each source's words form one stream (documents in pseudorandom order), cut into blocks of `block` words; a
    document stands in the blocks it overlaps. Offsets in the stream come from sums of hash buckets, so a source
    with a third of all rows is no single task's work. What reaches the driver, and goes to the tasks, is a row for each
    source, whose number is that of the weights to be met; the draws are made in the tasks. Slot k of
    a source is block perm(k mod blocks) of epoch k div blocks, so no block is drawn more than twice, and the last
    slot is cut so that a source gives its target to the word. Null text has no words; documents without words
    are never drawn; rows are told apart by key, a digest of id, source and text, so those without an id and other texts
    under one id are documents of their own; rows that repeat all three lie one after the other in the stream (size is that of all copies). An empty table gives no rows.
    """
    spark = docs.sparkSession
    sized = docs.select(row_key(id_col, source_col, text_col).alias("k"), F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = stored(sized.groupBy("k", "id", "source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("copies")), "sizes")
    rows = sorted(sized.groupBy("source").agg(F.sum("size").alias("n")).collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["n"] for r in rows]
    aims = targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], share)
    table = spark.createDataFrame([(i, r["source"], n, a) for i, (r, n, a) in enumerate(zip(rows, sizes, aims, strict=True))], "sid int, source string, source_size long, target double")
    table = F.broadcast(table) if len(rows) <= 100_000 else table
    known = sized.join(table.withColumnRenamed("source", "_s"), sized.source.eqNullSafe(F.col("_s"))).select("k", "id", "size", "copies", "sid", "source_size", "target")
    dealt = known.where("size > 0").withColumn("b", F.pmod(F.xxhash64("k", F.lit(seed)), F.lit(max(BUCKETS, sum(sizes) >> WORDS_BITS))))
    sums = dealt.groupBy("sid", "b").agg(F.sum("size").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("sid").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("sid", "b", before.alias("base"))
    inside = F.sum("size").over(Window.partitionBy("sid", "b").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = dealt.join(sums, ["sid", "b"]).withColumn("at", F.col("base") + inside)
    first, last = F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block)
    parts = placed.select("k", "id", "sid", "at", "size", (F.col("size") / F.col("copies")).cast("long").alias("one"), F.explode(F.sequence(first, last)).alias("block"))
    low, high = F.greatest(F.col("at"), F.col("block") * block), F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block)
    parts = parts.select("k", "sid", "block", "id", "one", (low - F.col("at")).alias("first"), (low - F.col("block") * block).alias("within"), (high - low).alias("words"))

    ends = [slots(n, a, i, block, seed) for i, (n, a) in enumerate(zip(sizes, aims, strict=True))]
    counts, many = [e[0] for e in ends], sum(e[0] for e in ends)
    shards = -(-many // per_shard)
    parts_of = max(1, min(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    given = spark.range(0, shards, 1, parts_of)

    def run(frames):
        for f in frames:
            at = f["id"].to_numpy()
            for sid, shard, low, high in draws(counts, shards, int(at[0]), int(at[-1]) + 1, seed) if len(at) else ():
                blocks, end = -(-sizes[sid] // block), ends[sid]
                k = np.arange(low, high)
                block_of = np.empty(len(k), dtype=np.int64)
                for epoch in np.unique(k // blocks):
                    of = k // blocks == epoch
                    block_of[of] = permuted(k[of] % blocks, blocks, _key(sid, int(epoch), seed))
                yield pd.DataFrame({"sid": np.int32(sid), "shard": np.int32(shard), "slot": k, "epoch": k // blocks, "block": block_of, "most": np.where(k == end[0] - 1, end[1], block)})

    drawn = given.mapInPandas(run, "sid int, shard int, slot long, epoch long, block long, most long")
    taken = F.least(F.col("words"), F.col("most") - F.col("within"))
    #: A few ranges make many slots, which the planner cannot know: a broadcast of them would grow with the data.
    mixed = drawn.hint("merge").join(parts, ["sid", "block"]).withColumn("words", taken).where("words > 0")
    return mixed.select("shard", "slot", "sid", "block", "epoch", "id", "first", "words", "k", "one"), known


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of each row of docs; rows that repeat id, source and text have a row each, with the words that are taken of that copy."""
    mixed, known = mix(docs, **options)
    many = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))).alias("low")
    rows = known.select("*", many).select("*", F.explode(F.sequence("low", F.least(F.col("low") + COPIES, "copies") - 1)).alias("copy"))
    rows = rows.select("k", "copy", "id", "sid", (F.col("size") / F.col("copies")).cast("long").alias("size"), "source_size", "target", F.lit(0).cast("long").alias("words"))
    end = F.col("first") + F.col("words")
    cut = mixed.select("*", F.explode(F.sequence(F.expr("first div one"), F.expr("(first + words - 1) div one"))).alias("copy"))
    words = F.least(end, (F.col("copy") + 1) * F.col("one")) - F.greatest("first", F.col("copy") * F.col("one"))
    cut = cut.select("k", "copy", "id", "sid", F.lit(None).cast("long").alias("size"), F.lit(None).cast("long").alias("source_size"), F.lit(None).cast("double").alias("target"), words.cast("long").alias("words"))
    out = rows.unionByName(cut).groupBy("k", "copy", "id", "sid").agg(F.max("size").alias("size"), F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.sum("words").alias("taken"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """docs as the mix takes them, one row for each: text is what is taken, in order, that of the second draw after a line break.

    Documents of which nothing is taken go. Rows are told apart by id, source and text, and need no id; rows that
    repeat all three are one (the least by a hash of the other columns), with what is taken of all of them. Other columns
    stay, whatever their names; n_chars, where there, follows the text.
    """
    rows, names = plain(docs)
    i, t, source = names[id_col], names[text_col], names[source_col]
    mixed, _ = mix(rows, i, t, source, **options)
    runs = mixed.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("epoch", "first", "words"))).alias("runs"))
    least = F.row_number().over(Window.partitionBy("k").orderBy(tie(rows, [c for c in names.values() if c != t])))
    joined = rows.withColumn("k", row_key(i, source, t)).join(runs, "k").withColumn("at", least).where("at = 1")

    @F.pandas_udf("string")
    def cut(text: pd.Series, of: pd.Series) -> pd.Series:
        import re

        word = re.compile("[^\x20\x09-\x0d]+")

        def one(t: str | None, parts) -> str:
            spans = [m.span() for m in word.finditer(t or "")]
            merged: list[list[int]] = []
            for x in parts:
                e, a, b = int(x["epoch"]), int(x["first"]), int(x["first"] + x["words"])
                if merged and merged[-1][0] == e and merged[-1][2] == a:
                    merged[-1][2] = b
                else:
                    merged.append([e, a, b])
            n, out = len(spans), []
            for _, a, b in merged:
                while a < b:  # past the last word the next copy of a repeated row begins
                    end = min(b, (a // n + 1) * n)
                    out.append(t[spans[a % n][0] : spans[(end - 1) % n][1]])
                    a = end
            return "\n".join(out)

        return pd.Series([one(t, p) for t, p in zip(text, of, strict=True)], dtype=object)

    out = joined.withColumn(t, cut(F.col(t), F.col("runs")))
    if "n_chars" in names:
        out = out.withColumn(names["n_chars"], F.length(t).cast(docs.schema["n_chars"].dataType))
    return named(out, names)
