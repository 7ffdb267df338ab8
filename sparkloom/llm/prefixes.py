"""Prefix trie of conversations: which beginnings they share, and how many characters sharing them saves."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.llm.common import stored

#: Rows of a conversation that one window ranks or sums at most: 2 to this power turn numbers.
RUN_BITS = 10
#: Conversation ids are joined in blocks of 2 to this power neighbouring ids.
BLOCK_BITS = 16
#: Turns that a conversation may take over from its head, less one; conversations of one head.
HEADS, FAMILY = 6, 100


def _running(rows: DataFrame, run: str, order: list[str], sums: dict[str, tuple]) -> DataFrame:
    """rows with, for each name of sums, the aggregate (fold, join of two folds) of a conversation's rows up to each row.

    A conversation is cut into runs (column `run`, ascending with the order); windows stay within a run, and what the
    runs before add is folded over one row a run. So no task holds a conversation that has a third of all rows.
    """
    upto = Window.partitionBy("conv_id", run).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    whole = rows.groupBy("conv_id", run).agg(*[fold.alias(f"_{n}") for n, (fold, _) in sums.items()])
    starts = whole.select("conv_id", run, *[refold(f"_{n}", before).alias(f"_{n}") for n, (_, refold) in sums.items()]).where(" OR ".join(f"_{n} IS NOT NULL" for n in sums))
    inside = rows.select("*", *[fold.over(upto).alias(n) for n, (fold, _) in sums.items()])
    join = {n: (lambda c, n=n: F.coalesce(c.bitwiseXOR(F.col(f"_{n}")), c)) if refold is _xor else (lambda c, n=n: c + F.coalesce(f"_{n}", F.lit(0))) for n, (_, refold) in sums.items()}
    both = inside.join(starts, ["conv_id", run], "left")
    return both.select(*rows.columns, *[join[n](F.col(n)).alias(n) for n in sums])


def _add(name: str, window):
    return F.sum(name).over(window)


def _xor(name: str, window):
    return F.bit_xor(name).over(window)


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, x, y, chars): each turn's place from 1 and the digest of its role and text; texts are read once and go no further.

    Null turns come first; of equal turns the order is that of the digests. Null role or text counts as empty. Rows
    without a conv_id belong to no conversation and are left out; rows that repeat are turns of their own.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, -10).cast("long")
    slim = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), half(1).alias("x"), half(17).alias("y"), F.length(text).cast("long").alias("chars"))
    slim = stored(slim.withColumn("run", F.coalesce(F.shiftright("turn", RUN_BITS), F.lit(-(1 << 62)))), "turns")
    placed = _running(slim, "run", [F.asc_nulls_first("turn"), "x", "y"], {"pos": (F.count(F.lit(1)), _add)})
    return placed.select("conv_id", "pos", "x", "y", "chars")


def rebuilt(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, x, y, chars) of conversations that begin with their head's turns, and (conv_id, n): all conversations and their lengths.

    Conversation c takes the first h turns of conversation c - c % 100 (as many as it has), h = crc32(c as text) % 6,
    then its own from the turn h + 1 on.
    """
    sizes = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    heads = sizes.select(F.col("conv_id").alias("head"), F.col("own").alias("has"))
    plan = sizes.select("conv_id", "own", (F.crc32(F.col("conv_id").cast("string")) % HEADS).alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("head"))
    plan = stored(plan.join(heads, "head", "left").select("conv_id", "own", "h", "head", F.least("h", F.coalesce("has", F.lit(0))).alias("taken")), "plan")
    first = placed.where((F.col("pos") < HEADS) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "head")
    begun = plan.where("taken > 0").join(first, "head").where("pos <= taken").select("conv_id", F.col("pos").alias("depth"), "x", "y", "chars")
    went_on = placed.join(plan, "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "x", "y", "chars")
    return begun.unionByName(went_on), plan.select("conv_id", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n"))


def occurrences(path: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv_id, depth, a, b, upto, chars, n, whole): every beginning of every conversation, the empty one too.

    (a, b) names the beginning: the exclusive or, over its turns, of two 64-bit hashes of place and digest, so that runs
    of a long conversation are hashed apart and joined. upto is the characters of its turns, n the turns of the
    conversation.
    """
    keyed = path.select("conv_id", "depth", F.xxhash64("depth", "x", "y").alias("p"), F.xxhash64("y", "x", "depth").alias("q"), "chars", F.shiftright(F.col("depth") - 1, RUN_BITS).alias("run"))
    folded = _running(keyed, "run", ["depth"], {"a": (F.bit_xor("p"), _xor), "b": (F.bit_xor("q"), _xor), "upto": (F.sum("chars"), _add)})
    roots = lengths.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in ("depth", "a", "b", "upto", "chars")])
    return folded.select(*roots.columns).unionByName(roots).join(lengths, "conv_id")


def joined_digests(ends: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) of ends (depth, a, b, conv_id): SHA-256 of a node's ids as text, ascending, comma-joined.

    Ids are joined in blocks of 65,536 neighbours, each an aggregate of bounded size; a node's blocks then pass in order
    through one running digest, a stream that holds one batch, however many conversations end at the node.
    """
    block = F.shiftright("conv_id", BLOCK_BITS)
    text = F.array_join(F.transform(F.array_sort(F.collect_set("conv_id")), lambda c: c.cast("string")), ",")
    blocks = ends.groupBy("depth", "a", "b", block.alias("block")).agg(text.alias("ids"))

    def run(batches):
        at, digest = None, None
        for batch in batches:
            out = []
            for d, a, b, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (d, a, b) == at:
                    digest.update(b",")
                else:
                    if at:
                        out.append((*at, digest.hexdigest()))
                    at, digest = (d, a, b), hashlib.sha256()
                digest.update(ids.encode())
            yield _batch(out)
        if at:
            yield _batch([(*at, digest.hexdigest())])

    dealt = blocks.repartition("depth", "a", "b").sortWithinPartitions("depth", "a", "b", "block")
    return dealt.mapInArrow(run, "depth long, a long, b long, ends_sha256 string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [*zip(*rows, strict=True)] or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["depth", "a", "b", "ends_sha256"])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row for each node of the trie of rebuilt conversations.

    A node belongs to its smallest member. What a conversation owns is the end of its path, so its first owned depth says
    all: the marks need no walk of the trie. One group-by of the beginnings then gives each node its members; its
    children, the next steps that members own; its leaves, the members that own their last node where nobody goes on;
    and what its subtree saves, the characters from the node on of all members less those of the nodes they own. A
    node's owner is a minimum that the map side takes before the shuffle and that is joined back, as a window over a node's members would put all in one task. Both
    summaries are written before they are joined, so that adaptive execution can split the rows of crowded keys (the root,
    a very long conversation).

    Conversations without turns are members of the root and end there. An empty table has no nodes. See turns() for
    nulls, ties and repeated rows; other columns are not read.
    """
    node = ["depth", "a", "b"]
    path, lengths = rebuilt(turns(conversations))
    seen = stored(occurrences(path, lengths), "beginnings")
    last = F.col("depth") == F.col("n")
    owners = stored(seen.groupBy(*node).agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("members"), F.count_if(last).alias("ended")), "owners")
    marked = seen.join(owners, node)
    owned = F.col("owner") == F.col("conv_id")
    before = F.col("upto") - F.col("chars")
    paths = marked.groupBy("conv_id").agg(
        F.min(F.when(owned, F.col("depth"))).alias("first"),
        F.min(F.when(owned, before)).alias("free"),
        F.max("upto").alias("total"),
        F.max_by(F.when(~owned, F.col("owner")), F.when(~owned, F.col("depth"))).alias("above"),
        F.max((owned & last & (F.col("members") == F.col("ended"))).cast("long")).alias("leaf"),
    )
    each = seen.join(stored(paths, "paths"), "conv_id")
    mine = F.coalesce(F.col("depth") >= F.col("first"), F.lit(False))
    next_mine = F.coalesce(F.col("depth") + 1 >= F.col("first"), F.lit(False)) & (F.col("depth") < F.col("n"))
    shared = F.greatest(F.coalesce("free", "total") - before, F.lit(0))
    parent = F.when(F.col("depth") == F.col("first"), F.col("above")).when(F.col("depth") > 0, F.col("conv_id"))
    nodes = each.groupBy(*node).agg(
        F.min("conv_id").alias("conv_id"),
        F.max(F.when(mine, parent)).alias("parent_conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.count_if(next_mine).alias("n_children"),
        F.sum("leaf").alias("n_leaves"),
        F.sum(shared).alias("saved_tokens"),
    )
    ends = joined_digests(seen.where(last).select(*node, "conv_id"))
    empty = hashlib.sha256().hexdigest()
    return nodes.join(ends, node, "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))


_CRC = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda r, x: list_reduce(list_prepend(xor(r, x), range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1))))"

#: Beginnings as lists of turns; subtree figures by joining each node with all beginnings of its owner.
ORACLE = f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, c - c % 100 AS head, xor({_CRC}, 4294967295) % 6 AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT h.c, pos, role, text FROM h JOIN t ON t.c = head AND pos <= h UNION ALL SELECT h.c, 1000000 + pos, role, text FROM h JOIN t ON t.c = h.c AND pos > h),
p AS (SELECT c, row_number() OVER w AS depth, list(sha256(length(role) || ':' || role || text)) OVER w AS node, length(text) AS chars FROM r WINDOW w AS (PARTITION BY c ORDER BY pos)),
o AS (SELECT c, depth, node, chars FROM p UNION ALL SELECT c, 0, [], 0 FROM h),
e AS (SELECT c, max(depth) AS n FROM o GROUP BY c),
v AS (SELECT node, o.depth AS depth, min(o.c) AS own, any_value(chars) AS chars, count(*) AS n_convs, coalesce(string_agg(CASE WHEN n = o.depth THEN o.c::VARCHAR END, ',' ORDER BY o.c), '') AS ends FROM o JOIN e ON o.c = e.c GROUP BY node, o.depth),
k AS (SELECT v.node[1:v.depth - 1] AS node, count(*) AS children FROM v WHERE v.depth > 0 GROUP BY 1),
f AS (SELECT v.*, coalesce(children, 0) AS n_children FROM v LEFT JOIN k ON v.node = k.node),
u AS (SELECT o.node, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * f.chars)::BIGINT AS saved FROM f JOIN o ON o.c = f.own AND o.depth <= f.depth GROUP BY o.node)
SELECT f.own AS conv_id, f.depth, CASE WHEN f.depth > 0 THEN q.own END AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN u ON f.node = u.node LEFT JOIN v q ON q.node = f.node[1:f.depth - 1] AND f.depth > 0
"""
