"""Live refresh: write events to debounced rescans, run-time calls by day, views kept current."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.session import dropped, listed, made, removed, stored


def debounced(events: DataFrame, gap: str = "500 milliseconds", late: str | None = "10 seconds", by: str | None = None) -> DataFrame:
    """(key, started, ended, events): bursts of events (ts), each ended by a quiet gap; works on streams and tables alike.

    On a stream the watermark `late` bounds the state; a burst is given out once the watermark has passed it.
    """
    if late and events.isStreaming:
        events = events.withWatermark("ts", late)
    #: A stream's bursts need a key beside the window; without one, a value that is 0 for every row.
    keys = [F.col(by)] if by else [(F.unix_timestamp("ts") * 0).alias("all")] if events.isStreaming else []
    out = events.groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("events"))
    return out.select(*([by] if by else []), F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")


def debounced_in_slices(events: DataFrame, gap_ms: int = 500, slice_s: int = 3600) -> DataFrame:
    """(started, ended, events) as debounced() gives them for a table without a key: bursts inside slices of time, joined where slices meet.

    Each slice is a group of its own, so one endless key is worked on in parallel. A slice gives its first and its last
    event and its bursts; a burst at a slice's end goes on in the next burst if that begins within the gap, which one
    pass over bursts at the borders, two a slice at most, decides.
    """
    gap = F.expr(f"INTERVAL {gap_ms} MILLISECONDS")
    dealt = events.where("ts is not null").select("ts", F.expr(f"unix_timestamp(ts) div {slice_s}").alias("slice"))
    bursts = dealt.groupBy("slice", F.session_window("ts", f"{gap_ms} milliseconds").alias("w")).agg(F.count(F.lit(1)).alias("events"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    bursts = stored(bursts.select("slice", "first", "last", "events"), "bursts")
    ends = bursts.groupBy("slice").agg(F.min("first").alias("low"), F.max("last").alias("high"))
    edge = bursts.join(ends, "slice").withColumn("border", (F.col("first") == F.col("low")) | (F.col("last") == F.col("high")))
    order = Window.orderBy("first")  # two rows a slice
    apart = F.coalesce(F.lag("last").over(order) + gap < F.col("first"), F.lit(True))
    at = edge.where("border").withColumn("new", apart.cast("int"))
    at = at.withColumn("burst", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = at.groupBy("burst").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("events").alias("events")).drop("burst")
    return joined.unionByName(edge.where("not border").select("first", "last", "events")).select(F.col("first").alias("started"), (F.col("last") + gap).alias("ended"), "events")


def daily(events: DataFrame, late: str | None = "1 day", key: str = "name") -> DataFrame:
    """(day, key, n): calls by tumbling days."""
    if late and events.isStreaming:
        events = events.withWatermark("ts", late)
    out = events.groupBy(F.window("ts", "1 day").alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.to_date("w.start").alias("day"), key, "n")


class Handle:
    """The latest state of a stream of changed files, a row for each key, as a view of the session that started it; and its subscribers.

    The state is dealt into hash buckets of the key, each a folder of the shared folder (or of `state`). A batch rewrites the
    buckets that it touches and no others, so what is written follows the batch; which folder is a bucket's is
    written last, as a manifest by batch. Of the rows of a key the latest by `order` stays, so a batch that is delivered
    again changes nothing, and a handle that is given the same `state` goes on from its last manifest.
    """

    def __init__(self, view: str, spark: SparkSession, key: str = "path", order: str = "ts", buckets: int = 64, state: str | None = None):
        self.view, self.spark, self.key, self.order, self.buckets = view, spark, key, order, buckets
        self.state = (state or made(spark, view)).rstrip("/")
        self._subscribers: list[Callable[[DataFrame, int], None]] = []
        self._at: dict[int, str] = {}
        self._old: list[str] = []
        self._turn, self._schema = 0, None
        if manifests := sorted(listed(spark, f"{self.state}/manifest"), key=lambda p: int(p.rpartition("-")[2])):
            self._turn = int(manifests[-1].rpartition("-")[2])
            self._at = {r["bucket"]: r["path"] for r in spark.read.parquet(manifests[-1]).collect()}
            self._show()

    def on_change(self, call: Callable[[DataFrame, int], None]) -> Callable[[], None]:
        """Call with each batch; the result takes the subscription back."""
        self._subscribers.append(call)
        return lambda: self._subscribers.remove(call) if call in self._subscribers else None

    def _show(self) -> None:
        if self._at:
            found = self.spark.read if self._schema is None else self.spark.read.schema(self._schema)
            rows = found.parquet(*self._at.values())
            self._schema = rows.schema
            rows.createOrReplaceTempView(self.view)

    def refresh(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch: bring the touched buckets and the view up to date and tell the subscribers."""
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        come = stored(batch.withColumn("_bucket", bucket), self.view)
        touched = sorted(r[0] for r in come.select("_bucket").distinct().collect())
        before = [self._at[b] for b in touched if b in self._at]
        known = come
        if before:
            known = come.unionByName(spark.read.schema(self._schema).parquet(*before).withColumn("_bucket", bucket))
        row = F.max_by(F.struct(*known.columns), F.struct(self.order, F.xxhash64(*batch.columns)))
        now = known.groupBy(F.col(self.key).alias("own")).agg(row.alias("row")).select("row.*")
        self._turn += 1
        path = f"{self.state}/rows-{self._turn}"
        if touched:
            now.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(path)
        self._schema = batch.schema if self._schema is None else self._schema
        self._at |= {b: f"{path}/_bucket={b}" for b in touched}
        spark.createDataFrame(list(self._at.items()), "bucket int, path string").coalesce(1).write.mode("overwrite").parquet(f"{self.state}/manifest/turn-{self._turn}")
        self._show()
        removed(spark, *self._old)  # what the batch before replaced: readers of its view may have been at work until now
        self._old = before
        dropped(come)
        for call in list(self._subscribers):
            call(batch, batch_id)

    def start(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(self.refresh).option("checkpointLocation", checkpoint).outputMode("append").start()


def stale(files: DataFrame, written_at) -> DataFrame:
    """Files newer than the artifact."""
    return files.where(F.col("mtime") > F.lit(written_at))
