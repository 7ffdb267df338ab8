"""Toxicity: a linear classifier on character n-grams, scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import held_out
from sparkloom.llm.hasharray import Counts

ORDERS = (3, 4, 5)
#: About so many training rows of each class, the first by a hash of their ids; features used; documents that must have a feature.
PER_CLASS, FEATURES, LEAST = 3000, 4096, 3
STEP = 1 << 20
TOP = 20


def grams(text: str | None):
    """Arrays of 64-bit hashes of the 3 to 5 character n-grams of a text in lower case; white space counts as a space."""
    text = f" {(text or '').lower()} "
    for at in range(0, len(text), STEP):
        codes = np.frombuffer(text[max(0, at - max(ORDERS) + 1) : at + STEP].encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        codes[codes <= 32] = 32
        hashed = codes
        for n in range(2, max(ORDERS) + 1):
            if len(codes) < n:
                break
            hashed = hashed[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(n)
            if n in ORDERS:
                yield hashed ^ (hashed >> np.uint64(32))


class Model:
    """Sorted hashes of the features, their weights (ratio times coefficient), and the bias."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(features)
        self.features, self.weights, self.bias = features[order], weights[order], bias
        self.gate = np.zeros(1 << TOP, dtype=bool)
        self.gate[(self.features & np.uint64((1 << TOP) - 1)).astype(np.int64)] = True

    def present(self, text: str | None) -> np.ndarray:
        """Indexes of the features in the whole text, each once."""
        out = []
        if len(self.features):
            for keys in grams(text):
                keys = keys[self.gate[(keys & np.uint64((1 << TOP) - 1)).astype(np.int64)]]
                at = np.minimum(np.searchsorted(self.features, keys), len(self.features) - 1)
                out.append(at[self.features[at] == keys])
        return np.unique(np.concatenate(out)) if out else np.zeros(0, dtype=np.int64)

    def score(self, text: str | None) -> float:
        z = self.bias + float(self.weights[self.present(text)].sum())
        return float(1 / (1 + np.exp(-max(-700.0, min(700.0, z)))))


def _regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient descent; x scaled features, weight of each row."""
    n, d = x.shape
    w, b, total = np.zeros(d, dtype=np.float32), float(np.log((weight[y == 1].sum() + 1) / (weight[y == 0].sum() + 1))), weight.sum()
    v = np.random.default_rng(0).standard_normal(d).astype(np.float32)
    for _ in range(12):
        v = x.T @ (weight * (x @ v)) / total
        norm = float(np.linalg.norm(v)) or 1.0
        v /= norm
    rate, last, lastb = 1.0 / (0.25 * (norm + 1.0) + ridge / total), w, b
    for k in range(steps):
        at, atb = w + (w - last) * (k / (k + 3)), b + (b - lastb) * (k / (k + 3))
        gap = weight * (1 / (1 + np.exp(-np.clip(x @ at + atb, -60, 60))) - y)
        last, lastb = w, b
        w, b = at - rate * ((x.T @ gap) / total + ridge / total * at).astype(np.float32), atb - rate * float(gap.sum() / total)
    return w, b


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS, features: int = FEATURES) -> Model:
    """A model from a bounded sample (per_class) of the labelled rows that are not held out.

    Spark counts, by class, the documents that have each n-gram; the `features` whose counts differ most from chance
    are kept and scaled by their smoothed log-count ratio; the regression runs on the driver over the sample's rows,
    weighted so that the classes have the shares of all labelled rows. With one class or none, the model is a constant.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).cast("long").alias("lid"), F.col(label_col).cast("int").alias("y")).where("lid is not null and y in (0, 1)").groupBy("lid").agg(F.max("y").alias("y"))
    known = known.where(~held_out(F.col("lid")))
    totals = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    many = [totals.get(0, 0), totals.get(1, 0)]
    if not all(many):
        rate = (many[1] + 0.5) / (sum(many) + 2)
        return Model(np.zeros(0, dtype=np.uint64), np.zeros(0), float(np.log(rate / (1 - rate))))
    scale = 1 << 30
    part = F.when(F.col("y") == 1, int(scale * min(1.0, per_class / many[1]))).otherwise(int(scale * min(1.0, per_class / many[0])))
    chosen = known.where(F.pmod(F.xxhash64("lid", F.lit(8)), F.lit(scale)) < part)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("lid")).select("y", "text")

    def count(batches):
        counts = Counts(), Counts()
        for b in batches:
            for y, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                counts[y].add(np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *grams(text.as_py())])).view(np.int64))
        for y, c in enumerate(counts):
            c.merge()
            yield pa.RecordBatch.from_arrays([pa.array(c.keys), pa.array(c.counts if y == 0 else c.counts * 0), pa.array(c.counts if y == 1 else c.counts * 0)], names=["gram", "n0", "n1"])

    taken = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}  # rows, as one label may mark several
    t0, t1 = max(1, taken.get(0, 0)), max(1, taken.get(1, 0))
    table = rows.mapInArrow(count, "gram long, n0 long, n1 long").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(F.col("n0") + F.col("n1") >= LEAST)
    a, b, c, d = F.col("n1"), F.col("n0"), t1 - F.col("n1"), t0 - F.col("n0")
    chi = F.pow((a * d - b * c).cast("double"), 2) * (t0 + t1) / ((a + b).cast("double") * (c + d + 1) * t1 * t0)
    best = table.withColumn("chi", chi).orderBy(F.desc("chi"), "gram").limit(features).collect()
    keys = np.array([r["gram"] for r in best], dtype=np.int64).view(np.uint64)
    ratio = np.array([np.log(((r["n1"] + 1) / (t1 + 2)) / ((r["n0"] + 1) / (t0 + 2))) for r in best], dtype=np.float32)
    plain = Model(keys, ratio, 0.0)
    shared = spark.sparkContext.broadcast(plain)

    def hits(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(b.column(0)), pa.array([shared.value.present(x.as_py()).astype(np.int32) for x in b.column(1)], pa.list_(pa.int32()))], names=["y", "at"])

    found = rows.mapInArrow(hits, "y int, at array<int>").toArrow()
    y = found.column("y").to_numpy().astype(np.float32)
    if not len(y) or not len(keys):
        return Model(np.zeros(0, dtype=np.uint64), np.zeros(0), float(np.log((many[1] + 1) / (many[0] + 1))))
    order = np.lexsort(([str(x) for x in found.column("at").to_pylist()], y))
    x = np.zeros((len(y), len(keys)), dtype=np.float32)
    lists = found.column("at").to_pylist()
    for i, j in enumerate(order):
        x[i, lists[j]] = plain.weights[lists[j]]
    y = y[order]
    weight = np.where(y == 1, many[1] / max(1, (y == 1).sum()), many[0] / max(1, (y == 0).sum())).astype(np.float32)
    weight *= len(y) / weight.sum()
    w, bias = _regression(x, y, weight)
    return Model(plain.features, (plain.weights * w).astype(np.float64), bias)


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for each row; null text counts as empty, and an empty text gets the bias's score.

    Repeated rows each give a row; an empty table none. Only id and text are read from docs.
    """
    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([shared.value.score(x.as_py()) for x in b.column(2)], pa.float64())], names=["id", "held_out", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, held_out boolean, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
