"""Near duplicates by 64-bit SimHash: variants within half the radius meet in the middle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.llm.common import components, named, plain, row_key, stored, tie

#: Three blocks of bits. Of 3 differing bits, one block holds at least one; the other two then differ in 2 at most.
BLOCKS = (range(0, 21), range(21, 42), range(42, 64))
ROWS = 1 << 15
#: simhash_dedup's fingerprints: of the different words of a text, with two seeds; near copies meet under either.
SEEDS = (42, 43)


def _signed(n: int) -> int:
    return n - (1 << 64) if n >= 1 << 63 else n


def fingerprint(text: str | None, width: int = 3, seed: int = 42, once: bool = False) -> int:
    """SimHash of a text as a signed long: bytes of A-Z in lower case, white space split, `width`-word shingles.

    once: each different shingle counts once, however often the text repeats it.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    found = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    each = [hashed(x, seed) for x in (set(found) if once else found)]
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(each), ROWS):
        part = np.array(each[i : i + ROWS], dtype=">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(each)).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp long) of each row; null text counts as empty, and an empty text has fingerprint 0."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for b in batches:
            found = [fingerprint(x.as_py(), width) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int64())], names=["id", "fp"])

    return rows.mapInArrow(run, "id long, fp long")


def _close(fps: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp) that connect all those at 3 or fewer differing bits, and no others.

    First, which fingerprints can have a partner: each leaves out one block of bits in turn and emits, of the rest, all
    variants within one bit, 132 rows; of 3 differing bits one block holds at least one, so partners differ in 2
    bits of some rest at most, and meet at a variant half way. (It does no harm that variants of two blocks may be
    equal by chance.) Those that met anyone then emit the ball of all 64 bits. No pair is listed, whatever the
    size of a group, and the rows are a multiple of the fingerprints. These are dealt out before they are
    multiplied, however few files hold them.
    """
    keys = []
    for block in BLOCKS:
        rest = [i for i in range(64) if i not in block]
        mask = sum(1 << i for i in rest)
        keys += [F.col("fp").bitwiseAND(F.lit(_signed(mask))).bitwiseXOR(F.lit(_signed(x))) for x in (0, *(1 << i for i in rest))]
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = fps.select("fp").repartition(parts, "fp").select("fp", F.explode(F.array(*keys)).alias("v"))
    others = F.min("fp").over(Window.partitionBy("v")) != F.max("fp").over(Window.partitionBy("v"))
    met = stored(rows.withColumn("met", others).where("met").select("fp").distinct(), "met")
    return _stars(met.repartition(parts, "fp")).distinct()


def _stars(fps: DataFrame) -> DataFrame:
    """Variants within 1 bit, and those 2-bit variants whose bits lie in one half, since of 3 bits two do: 1,057 rows each.

    What is within 1 of a variant is within 3 of all that are within 2 of it, so the least of the former is the hub of a star.
    """
    ones = [1 << i for i in range(64)]
    twos = [ones[i] | ones[j] for half in (range(32), range(32, 64)) for i in half for j in half if i < j]
    lit = lambda values: F.array(*[F.lit(_signed(x)) for x in values])
    near = fps.select("fp", F.explode(lit([0, *ones])).alias("x"), F.lit(True).alias("near"))
    far = fps.select("fp", F.explode(lit(twos)).alias("x"), F.lit(False).alias("near"))
    ball = near.union(far).select("fp", F.col("fp").bitwiseXOR(F.col("x")).alias("v"), "near")
    hub = F.min(F.when(F.col("near"), F.col("fp"))).over(Window.partitionBy("v"))
    return ball.withColumn("hub", hub).where("hub is not null and hub != fp").select(F.least("hub", "fp").alias("a"), F.greatest("hub", "fp").alias("b"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fingerprint of 16 hex digits, component_id = the smallest id reachable over links of 3 or fewer bits).

    Equal fingerprints are merged first, so exact copies, a third of all rows or more, cost one vertex. Texts with
    no word share fingerprint 0 and are linked like any other. Rows with a null id get the component of their
    fingerprint (null if no row of the component has an id). Repeated rows each give a row; an empty table none.
    Only id and text are read from docs.
    """
    rows = stored(fingerprints(docs, id_col, text_col, width), "fps")
    fps = stored(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    links = _close(fps)
    found = components(links)
    joined = fps.join(found, fps.fp == found.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    of = stored(joined.groupBy("c").agg(F.min("least").alias("component_id")), "least")
    each = stored(joined.join(of, "c").select(F.col("fp").alias("f"), "component_id"), "members")
    return rows.join(each, F.col("fp") == F.col("f")).select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _marks(rows: DataFrame, seeds: tuple[int, ...], width: int, once: bool) -> DataFrame:
    """(k, id, f0, f1, ...): fingerprints of rows (k, id, text), one for each seed."""
    names = [f"f{i}" for i in range(len(seeds))]

    def run(batches):
        for b in batches:
            texts = [x.as_py() for x in b.column(2)]
            found = [pa.array([fingerprint(x, width, s, once) for x in texts], pa.int64()) for s in seeds]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *found], names=["k", "id", *names])

    return rows.mapInArrow(run, f"k binary, id {rows.schema['id'].dataType.simpleString()}, " + ", ".join(f"{x} long" for x in names))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seeds: tuple[int, ...] = SEEDS, width: int = 1, once: bool = True) -> DataFrame:
    """(k, id, c): each different (id, text) of docs by its key, and its group; null where the row is alone.

    Rows are linked when their fingerprints under any of the seeds differ in 3 bits at most, and groups are what is
    reachable. A vertex is a fingerprint under one seed; a row joins its two vertices only where both are shared or
    linked, so rows without a copy add no edge.
    """
    rows, of = plain(docs)
    keyed = rows.select(row_key(of[id_col], of[text_col]).alias("k"), F.col(of[id_col]).alias("id"), F.col(of[text_col]).alias("text"))
    marks, edges = stored(_marks(keyed, seeds, width, once), "marks"), None
    marks = stored(marks.dropDuplicates(["k"]), "marks")
    vertex = lambda s, fp: F.xxhash64(F.lit(s), fp)
    for i, s in enumerate(seeds):
        fps = stored(marks.groupBy(F.col(f"f{i}").alias("fp")).agg(F.count(F.lit(1)).alias("n")), "distinct")
        links = stored(_close(fps), "links")
        live = fps.where("n > 1").select("fp").union(links.select(F.explode(F.array("a", "b")))).distinct().withColumn(f"v{i}", vertex(s, F.col("fp")))
        marks = stored(marks.join(live.withColumnRenamed("fp", f"f{i}"), f"f{i}", "left"), "marks")
        own = links.select(vertex(s, F.col("a")).alias("a"), vertex(s, F.col("b")).alias("b"))
        edges = own if edges is None else edges.union(own)
    for i in range(1, len(seeds)):
        edges = edges.union(marks.where(f"v0 is not null and v{i} is not null").select("v0", f"v{i}"))
        for j in range(1, i):
            edges = edges.union(marks.where(f"v{j} is not null and v{i} is not null").select(f"v{j}", f"v{i}"))
    found = components(edges)
    for i in range(len(seeds)):
        marks = marks.join(found.select(F.col("node").alias(f"v{i}"), F.col("component").alias(f"c{i}")), f"v{i}", "left")
    parts = [f"c{i}" for i in range(len(seeds))] + [f"v{i}" for i in range(len(seeds))]
    return marks.select("k", "id", F.coalesce(*parts).alias("c"))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seeds: tuple[int, ...] = SEEDS, width: int = 1, once: bool = True) -> DataFrame:
    """One row of docs for each group of near_groups, with all its columns: that of the smallest id.

    Fingerprints of the different words of a text move less under small edits than those of shingles, and two seeds
    give a pair two chances (figures in the README). Rows are told apart by id and text: other texts under one id, or
    without an id, take part each, a null id after all others, equal ids by a digest. Of rows that repeat id and
    text one stays, the least by a hash of the other columns. Null and empty texts have fingerprint 0 and are near
    copies of each other. Any column names do; an empty table gives no rows.
    """
    groups = stored(near_groups(docs, id_col, text_col, seeds, width, once), "groups")
    first = groups.where("c is not null").groupBy("c").agg(F.min_by("k", F.struct(F.col("id").isNull(), "id", "k")).alias("k"))
    stay = stored(first.select("k").union(groups.where("c is null").select("k")), "stay")
    rows, of = plain(docs)
    kept = rows.withColumn("k", row_key(of[id_col], of[text_col])).join(stay, "k", "left_semi")
    least = F.row_number().over(Window.partitionBy("k").orderBy(tie(rows, [c for c in of.values() if c != of[text_col]])))
    return named(kept.withColumn("at", least).where("at = 1"), of)
