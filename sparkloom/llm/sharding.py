"""Sharding by balanced label propagation: linked documents move towards their neighbours' shards under capacity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.llm.common import dropped, ranked, stored

#: Rounds at most; rounds in a row that may move nothing, as the next asks for other moves.
ROUNDS, IDLE = 24, 3
#: Rows are ranked in hash buckets of about so many at most; moves between two shards are granted in so many lots.
PER_BUCKET, LOTS = 200_000, 64


def _list(values: list[int]):
    """A literal array; for values by shard, whose number is the operator's parameter."""
    return F.array(*[F.lit(int(v)).cast("long") for v in values])


def _loads(blocks: DataFrame, shards: int) -> list[int]:
    """Members by shard: `shards` numbers."""
    found = {r["s"]: r["n"] for r in blocks.groupBy("s").agg(F.sum("n").alias("n")).collect()}
    return [int(found.get(s, 0)) for s in range(shards)]


def granted(asked: dict[tuple[int, int], list[int]], spare: list[int]) -> dict[tuple[int, int], int]:
    """How many of the first lots of each (from, to) may move: what a shard takes in is within its room and what leaves it.

    So shards without room swap: all is granted first; while a shard would overflow, the last lot that comes to it goes back,
    from the shard that can best do without sending it. A few steps for each pair of shards, on sums by lot only.
    """
    lots = {k: [n for n in v] for k, v in asked.items()}
    take = {k: len(v) for k, v in lots.items()}
    room = list(spare)
    for (s, t), v in lots.items():
        room[t] -= sum(v)
        room[s] += sum(v)
    over = [t for t, r in enumerate(room) if r < 0]
    while over:
        t = over.pop()
        while room[t] < 0:
            came = [k for k in take if k[1] == t and take[k]]
            s, _ = back = max(came, key=lambda k: (room[k[0]], k))
            take[back] -= 1
            n = lots[back][take[back]]
            room[t] += n
            room[s] -= n
            if room[s] < 0 and s not in over:
                over.append(s)
    return take


def propagate(blocks: DataFrame, capacity: list[int], rounds: int = ROUNDS, trace: list[int] | None = None) -> DataFrame:
    """Move members of groups together: blocks (g, part, s, n) -> blocks (g, part, s, n) with loads within capacity.

    Members of a group that are in one shard are alike, so a block with a count stands for them. Each round every group
    (g, part) would gather in the shard where most of it can be, by its members there and the room; of several in that with
    most members, then in the first by a hash that changes with the round. What goes from one shard to another is summed in lots by the group's size and a hash, larger groups first; the
    sums (shards squared times lots) are granted as granted() says, moves in and out together, so full shards swap
    members. Rounds end when nothing is left to move, or when three in a row move nothing. trace gets the number of edges that are cut at the start and after each round.
    """
    shards = len(capacity)
    loads = _loads(blocks, shards)
    spark, idle = blocks.sparkSession, 0
    if trace is not None:
        trace.append(_cut(blocks))
    for turn in range(rounds):
        of_group = Window.partitionBy("g", "part")
        spare = [c - n for c, n in zip(capacity, loads, strict=True)]
        plan = blocks.select("g", "part", "s", "n", F.sum("n").over(of_group).alias("size"))
        reach = F.col("n") + F.least(F.get(_list(spare), F.col("s")), F.col("size") - F.col("n"))
        order = F.struct((-reach).alias("reach"), -F.col("n"), F.xxhash64("g", "part", "s", F.lit(turn)), "s")
        plan = plan.withColumn("t", F.min(order).over(of_group)["s"])
        lot = F.least(F.lit(LOTS // 4 - 1), F.lit(LOTS // 4 - 1) - F.least(F.floor(F.log2("size")), F.lit(LOTS // 4 - 1))).cast("int") * 4 + F.pmod(F.xxhash64("g", "part", F.lit(turn)), F.lit(4)).cast("int")
        plan = stored(plan.withColumn("lot", lot), "plan")
        asked: dict[tuple[int, int], list[int]] = {}
        lots: dict[tuple[int, int], list[int]] = {}
        for r in plan.where("s != t").groupBy("s", "t", "lot").agg(F.sum("n").alias("n")).orderBy("s", "t", "lot").collect():
            asked.setdefault((r["s"], r["t"]), []).append(int(r["n"]))
            lots.setdefault((r["s"], r["t"]), []).append(r["lot"])
        take = granted(asked, spare)
        upto = [(s, t, lots[s, t][k - 1]) for (s, t), k in take.items() if k]
        idle = 0 if upto else idle + 1
        if not asked or idle == IDLE:
            dropped(plan)
            break
        if not upto:
            continue
        allowed = F.broadcast(spark.createDataFrame(upto, "s int, t int, upto int"))
        moved = plan.join(allowed, ["s", "t"], "left").select("g", "part", F.when(F.col("lot") <= F.col("upto"), F.col("t")).otherwise(F.col("s")).alias("s"), "n")
        after = stored(moved.groupBy("g", "part", "s").agg(F.sum("n").alias("n")), "blocks")
        dropped(plan, blocks)
        blocks, loads = after, _loads(after, shards)
        if trace is not None:
            trace.append(_cut(blocks))
    return blocks


def _shares(count: int, room: list[int]) -> list[int]:
    """Where each shard's part of `count` places ends: parts in proportion to the room, none beyond it."""
    total, upto, out = sum(room), 0, []
    for r in room:
        upto += r
        out.append(count * upto // max(1, total))
    return out


def _cut(blocks: DataFrame) -> int:
    """Edges cut: of each text's copies, a chain along the shards, one for each shard after the first."""
    return int(blocks.groupBy("g").agg((F.countDistinct("s") - 1).alias("n")).agg(F.sum("n")).head()[0] or 0)


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, trace: list[int] | None = None) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard, text_md5) for each row: law `rows`, equal texts brought together.

    Sizes by shard differ by one row at most, exactly: linked documents (texts that occur more than once) are dealt out
    in pseudorandom order, evenly, and then moved by propagation under the quotas, groups of an eighth of a quota and more
    first; a text with more copies than three quarters of a quota is several groups of that size. Documents without a link
    have no edge to cut and fill what is left. slot numbers a shard's rows from 0. Null text counts as empty. Repeated rows
    get slots of their own. An empty table gives no rows. Only id and text are read from docs.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("crc"), F.unhex(F.md5(text)).alias("g"))
    total = docs.count()
    buckets = total // PER_BUCKET
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    most = max(2, quota[-1] * 3 // 4)
    ranks = ranked(rows, ["g"], ["id"], "r", max(256, buckets), total="n")
    rows = stored(ranks.withColumn("part", F.expr(f"r div {most}").cast("int")).withColumn("r", F.expr(f"r % {most}")), "sizes")
    linked, alone = rows.where("n > 1"), rows.where("n = 1")
    done, room = None, quota
    for large in (True, False):  # large groups gather while there is room, then the others in what is left
        some = linked.where(F.col("n") >= quota[-1] // 8 if large else F.col("n") < quota[-1] // 8).select("g", "part", "r")
        dealt = ranked(some, [], ["g", "part", "r"], "p", max(8192, buckets))
        ends = _list(_shares(some.count(), room))
        start = dealt.groupBy("g", "part", F.size(F.filter(ends, lambda c: c <= F.col("p"))).cast("int").alias("s")).agg(F.count(F.lit(1)).alias("n"))
        blocks = propagate(stored(start, "start"), room, rounds, trace)
        room = [c - n for c, n in zip(room, _loads(blocks, shards), strict=True)]
        done = blocks if done is None else done.unionByName(blocks)
    blocks, loads = done, [q - r for q, r in zip(quota, room, strict=True)]
    before = F.coalesce(F.sum("n").over(Window.partitionBy("g", "part").orderBy(F.desc("n"), "s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = blocks.select("g", "part", "s", before.alias("start")).groupBy("g", "part").agg(F.array_sort(F.collect_list(F.struct("start", "s"))).alias("ends"))
    ends = stored(ends, "ends")
    together = linked.join(ends, ["g", "part"]).withColumn("shard", F.element_at(F.filter("ends", lambda x: x["start"] <= F.col("r")), -1)["s"])
    at, cuts = 0, []
    for q, n in zip(quota, loads, strict=True):
        cuts.append(at)
        at += q - n
    #: The last shard whose first free place is not after p; shards without free places share the next one's start.
    order = F.size(F.filter(_list(cuts), lambda c: c <= F.col("p"))) - 1
    filled = ranked(alone, [], ["id", "g"], "p", max(8192, buckets)).withColumn("shard", order)
    each = together.select("id", "size", "crc", "g", "shard").unionByName(filled.select("id", "size", "crc", "g", "shard"))
    each = ranked(each, ["shard"], ["id", "crc"], "slot", max(1024, buckets))
    return each.select(F.col("id").alias(id_col), "size", F.col("crc").cast("long").alias("text_crc32"), F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"), F.lower(F.hex("g")).alias("text_md5"))


def cut_edges(sharded: DataFrame) -> DataFrame:
    """One row: linked rows (their text occurs more than once), those outside the shard that has most of their group, and edges cut.

    The copies of a text are linked as a chain along the shards, so a group in k shards cuts k - 1 edges of its size - 1.
    """
    parts = sharded.groupBy("text_md5", "shard").agg(F.count(F.lit(1)).alias("n"))
    groups = parts.groupBy("text_md5").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.count(F.lit(1)).alias("shards")).where("n > 1")
    sums = {"linked": F.sum("n"), "apart": F.sum(F.col("n") - F.col("most")), "edges": F.sum(F.col("n") - 1), "cut": F.sum(F.col("shards") - 1)}
    return groups.agg(*[F.coalesce(x, F.lit(0)).alias(k) for k, x in sums.items()])
