"""Language of a text by partial matching: per-language byte context trees, exact code lengths, frozen statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import held_out, stored
from sparkloom.llm.hasharray import Counts, HashArray

ORDER = 3
#: About so many training documents of each language, the first by a hash of their ids; whole texts.
PER_LANGUAGE = 1500
STEP = 1 << 20
#: Parts of the hash by which rows are chosen; the most languages whose totals are broadcast.
SCALE, BROADCAST = 1 << 30, 100_000


def _grams(text: str, order: int = ORDER):
    """Arrays of the order+1 bytes that end at each byte of the text in lower case, as integers; in steps of bounded size."""
    data = text.lower().encode("utf-8", "surrogatepass")
    for at in range(0, len(data), STEP):
        part = data[max(0, at - order) : at + STEP]
        part = b" " * max(0, order - at) + part
        codes = np.frombuffer(part, dtype=np.uint8).astype(np.int64)
        n = len(codes) - order
        keys = np.zeros(n, dtype=np.int64)
        for k in range(order + 1):
            keys = (keys << 8) | codes[k : k + n]
        yield keys


def _sample(docs: DataFrame, lang_col: str, id_col: str, per_language: int) -> DataFrame:
    """Training rows: not held out, with text and language; about per_language of each, by a hash of the id."""
    rows = docs.where(~held_out(F.col(id_col))).where(F.col(lang_col).isNotNull() & F.col("text").isNotNull())
    totals = stored(rows.groupBy(lang_col).count().withColumnRenamed("count", "many"), "totals")
    totals = F.broadcast(totals) if totals.count() <= BROADCAST else totals
    part = F.least(F.lit(1.0), F.lit(per_language) / F.col("many")) * SCALE
    return rows.join(totals, lang_col).where(F.pmod(F.xxhash64(id_col, F.lit(5)), F.lit(SCALE)) < F.floor(part)).drop("many")


class Trees:
    """Code lengths of the last byte of a gram, in nats, for all languages at once.

    counts: {language: (grams of order+1 bytes, their counts)}. A context gives a byte seen there c of its n times
    the probability c / (n + d), d the number of different bytes seen there; any other byte costs the escape
    d / (n + d) and the length in the next shorter context. A context never seen costs nothing. At the end all 256 bytes are alike.
    """

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER):
        self.names, self.order = sorted(counts), order
        self.levels: list[tuple[HashArray, HashArray]] = []
        many = len(self.names)
        for k in range(order + 1 if many else 0):
            mask = (1 << (8 * (k + 1))) - 1
            seen, inside = {}, {}
            for i, name in enumerate(self.names):
                keys, n = counts[name]
                grams, where = np.unique(keys & mask, return_inverse=True)
                sums = np.bincount(where, weights=n, minlength=len(grams))
                contexts, back = np.unique(grams >> 8, return_inverse=True)
                total, kinds = np.bincount(back, weights=sums, minlength=len(contexts)), np.bincount(back, minlength=len(contexts))
                seen[i] = grams, -np.log(sums / (total + kinds)[back])
                inside[i] = contexts, -np.log(kinds / (total + kinds))
            contexts = np.unique(np.concatenate([inside[i][0] for i in range(many)]))
            escape = np.zeros((len(contexts), many), dtype=np.float32)
            for i in range(many):
                escape[np.searchsorted(contexts, inside[i][0]), i] = inside[i][1]
            grams = np.unique(np.concatenate([seen[i][0] for i in range(many)]))
            escapes = HashArray(contexts, escape)
            lower = self._lengths(grams, k - 1) + self._of(escapes, grams >> 8)
            for i in range(many):
                lower[np.searchsorted(grams, seen[i][0]), i] = seen[i][1]
            self.levels.append((HashArray(grams, lower.astype(np.float32)), escapes))

    @staticmethod
    def _of(table: HashArray, keys: np.ndarray) -> np.ndarray:
        rows = table.find(keys)
        return np.where((rows >= 0)[:, None], table.values[rows], np.float32(0))

    def _lengths(self, keys: np.ndarray, k: int) -> np.ndarray:
        """Of the last byte of each key, from contexts of k bytes and shorter."""
        if k < 0:
            return np.full((len(keys), len(self.names)), np.log(256), dtype=np.float32)
        grams, escapes = self.levels[k]
        keys = keys & ((1 << (8 * (k + 1))) - 1)
        rows = grams.find(keys)
        out = grams.values[rows]
        miss = np.nonzero(rows < 0)[0]
        if len(miss):
            out[miss] = self._of(escapes, keys[miss] >> 8) + self._lengths(keys[miss], k - 1)
        return out

    def lengths(self, text: str) -> np.ndarray:
        """Code length of the whole text in each language."""
        out = np.zeros(len(self.names))
        for keys in _grams(text, self.order):
            out += self._lengths(keys, self.order).sum(axis=0, dtype=np.float64)
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.names or not any(map(str.isalpha, text)):
            return "und", 0.0
        lengths = self.lengths(text)
        best = int(lengths.argmin())
        return self.names[best], float(1 / np.exp(np.clip(lengths[best] - lengths, -700, 0)).sum())


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Trees:
    """Trees from a bounded sample of training rows (per_language bounds it); Spark counts, the driver gets grams and counts."""
    rows = _sample(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")), "lang", "doc_id", per_language).select("lang", "text")

    def run(batches):
        counts: dict[str, Counts] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for keys in _grams(text.as_py()):
                    counts.setdefault(lang, Counts()).add(keys)
        for lang, c in counts.items():
            c.merge()
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c.keys), pa.string()), pa.array(c.keys), pa.array(c.counts)], names=["lang", "gram", "n"])

    found = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = np.array(found.column("lang").to_pylist(), dtype=object)
    grams, n = found.column("gram").to_numpy(), found.column("n").to_numpy()
    return Trees({x: (grams[langs == x], n[langs == x]) for x in sorted(set(langs))})


def predict(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score = the language's share of the likelihoods) for each row.

    A null text, or one without a letter, is `und` with score 0, as all are where nothing was learned. Of equally
    long codes the first language by name wins. Repeated rows each give a row. Only id and text are read.
    """
    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        model = shared.value
        for b in batches:
            found = [model.predict(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["id", "held_out", "lang_pred", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)
