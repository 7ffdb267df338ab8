"""Quality rules: counts of words, symbols and repeats, and bands of n-gram perplexity for each language.

Texts are dealt into FOLDS halves by a hash; all texts are counted, and each is scored by the model of the texts that
are not in its half, so neither a text's own n-grams nor those of its exact copies make it likelier. Log probabilities
are whole numbers of 1 / UNIT nats, so sums do not depend on their order: a model that is sent to the executors and
one that is joined give the same results to the last bit.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.llm.common import row_key, stored
from sparkloom.llm.hasharray import Counts, HashArray

ORDER = 5
#: Quartile distances beyond the quartiles of a language's log perplexity at which its band ends: in halves, the least
#: that rejects at most 2.5 % of the labelled clean documents that are not held out (sf0.1; figures in the README).
BAND = 2.5
#: The most n-grams that are sent to the executors at once; a larger model is joined instead, with the same results to the last bit.
SENT = 12_000_000
STEP = 1 << 18
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
FOLDS, UNIT = 2, 1 << 20
#: Steps of a nat in the histogram of log perplexity; the most rows of a table by language that is broadcast.
STEPS, BROADCAST = 2000, 100_000


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, SPACE))
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    windows = list(zip(words, words[1:], words[2:]))
    repeat, found = 0, Counter(windows)
    if len(found) < len(windows):
        end = 0
        for i, w in enumerate(windows):
            if found[w] > 1:
                repeat += i + 3 - max(end, i)
                end = i + 3
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def grams(text: str, lang: int):
    """Arrays of n-gram keys: the model's number (language and half) above 40 bits, then the 5 bytes that end at each byte of the text in lower case."""
    data = text.lower().encode("utf-8", "surrogatepass")
    for at in range(0, len(data), STEP):
        part = b"\n" * max(0, ORDER - 1 - at) + data[max(0, at - ORDER + 1) : at + STEP]
        codes = np.frombuffer(part, dtype=np.uint8).astype(np.int64)
        n = len(codes) - ORDER + 1
        keys = np.full(n, lang, dtype=np.int64)
        for k in range(ORDER):
            keys = (keys << 8) | codes[k : k + n]
        yield keys


def suffix(keys, order: int):
    """Of keys of `order` bytes: those without the first byte (the language stays)."""
    return ((keys >> (8 * order)) << (8 * (order - 1))) | (keys & ((1 << (8 * (order - 1))) - 1))


def _suffix(key, order: int):
    return F.shiftleft(F.shiftright(key, 8 * order), 8 * (order - 1)).bitwiseOR(key.bitwiseAND(F.lit((1 << (8 * (order - 1))) - 1)))


def languages(docs: DataFrame, lang_col: str) -> dict[str, int]:
    """A number for each language; 0 is for null. Many dirty values are many models, but a row each here."""
    found = sorted(r[0] for r in docs.where(F.col(lang_col).isNotNull()).select(lang_col).distinct().collect())
    return {x: i + 1 for i, x in enumerate(found)}


def fold(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 5) % FOLDS


def counted(docs: DataFrame, langs: dict[str, int]) -> DataFrame:
    """(key, n): how often each n-gram occurs in all of docs (lang, text), by language and half; merged in each task before the shuffle."""

    def run(batches):
        counts = Counts()
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py() or ""
                for keys in grams(text, langs.get(lang, 0) * FOLDS + fold(text)):
                    counts.add(keys)
        counts.merge()
        for i in range(0, len(counts.keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys[i : i + (1 << 16)]), pa.array(counts.counts[i : i + (1 << 16)])], names=["key", "n"])

    return docs.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame, models: int = 0) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1: (key, p = log probability) of the n-grams seen, (key, g = log backoff weight) of their contexts, in units.

    Modified Kneser-Ney, interpolated: the highest order has its counts, each lower one the number of different
    bytes that precede it; three discounts for each order and language, from its counts of counts. The last
    backoff is to all 256 bytes alike. models: how many there are, a row each in the table of discounts.
    """
    tables = [counts]
    for order in range(ORDER, 1, -1):
        tables.insert(0, tables[0].groupBy(_suffix(F.col("key"), order).alias("key")).agg(F.count(F.lit(1)).alias("n")))
    out: list[tuple[DataFrame, DataFrame]] = []
    for order, table in enumerate(tables, 1):
        lang = F.shiftright("key", 8 * order)
        of = [F.sum(F.when(F.col("n") == k, 1).otherwise(0)).cast("double") for k in (1, 2, 3, 4)]
        by = table.groupBy(lang.alias("lang")).agg(*[x.alias(f"n{k}") for k, x in enumerate(of, 1)])
        y = F.when(F.col("n1") + F.col("n2") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2")))
        known = lambda k: k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")
        cut = lambda k: F.when(y.isNotNull() & (F.col(f"n{k}") > 0), F.greatest(F.lit(0.1 * k), F.least(F.lit(0.95 * k), known(k)))).otherwise(0.5 * k)
        by = by.select("lang", *[cut(k).alias(f"d{k}") for k in (1, 2, 3)])
        by = F.broadcast(by) if models <= BROADCAST else by
        with_cuts = table.withColumn("lang", lang).join(by, "lang")
        discount = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        whole = Window.partitionBy("c")
        each = with_cuts.select("key", "n", discount.alias("d"), F.shiftright("key", 8).alias("c")).withColumn("t", F.sum("n").over(whole)).withColumn("g", F.sum("d").over(whole) / F.col("t"))
        if order == 1:
            each = each.withColumn("lower", F.lit(1 / 256))
        else:
            lower = out[-1][0].select(F.col("key").alias("s"), F.exp("p").alias("lower"))
            each = each.join(lower, _suffix(F.col("key"), order) == F.col("s"))
        each = stored(each.select("key", "c", F.log((F.col("n") - F.col("d")) / F.col("t") + F.col("g") * F.col("lower")).alias("p"), F.log("g").alias("g")), f"order{order}")
        out.append((each.select("key", "p"), each.groupBy(F.col("c").alias("key")).agg(F.max("g").alias("g"))))
    units = lambda df, c: df.select("key", F.round(F.col(c) * UNIT).cast("int").alias(c))
    return [(units(p, "p"), units(g, "g")) for p, g in out]


#: A byte of which nothing is known: all 256 are alike.
ALIKE = int(round(float(np.log(1 / 256)) * UNIT))


class Model:
    """Sorted hash arrays of all orders, to score many positions at a time; values are units."""

    def __init__(self, orders: list[tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]]):
        self.orders = [(HashArray(k, p.astype(np.int32)), HashArray(c, g.astype(np.int32))) for (k, p), (c, g) in orders]

    def logs(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), dtype=np.int64)
        todo = None
        for order in range(ORDER, 0, -1):
            seen, inside = self.orders[order - 1]
            at = seen.find(keys)
            hit = at >= 0
            here = np.arange(len(keys)) if todo is None else todo
            out[here[hit]] += seen.values[at[hit]]
            todo, keys = here[~hit], keys[~hit]
            if not len(todo):
                return out
            back = inside.find(keys >> 8)
            out[todo] += np.where(back >= 0, inside.values[back], 0) if len(inside.keys) else 0
            keys = suffix(keys, order)
        out[todo] += ALIKE
        return out


def _fetched(df: DataFrame, value: str) -> tuple[np.ndarray, np.ndarray]:
    table = df.toArrow()
    return table.column("key").to_numpy(), table.column(value).to_numpy()


def _facts(docs: DataFrame, langs: dict[str, int], model) -> DataFrame:
    """The base counts of each row of docs (id, lang, text), and, with a model, its log likelihood in units."""

    def run(batches):
        lm = model.value if model else None
        for b in batches:
            out = []
            for lang, text in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                text = text.as_py() or ""
                n = langs.get(lang, 0) * FOLDS + (fold(text) + 1) % FOLDS
                out.append((*base_counts(text), sum(int(lm.logs(k).sum()) for k in grams(text, n)) if lm else None, len(text.lower().encode("utf-8", "surrogatepass"))))
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = [pa.int64()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "nats", "bytes"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, nats long, bytes long")


def joined_nats(docs: DataFrame, langs: dict[str, int], orders) -> DataFrame:
    """(id, sum) of log likelihoods by joins with the model's tables: for models too large to send. No row goes to one task by language."""

    def run(batches):
        for b in batches:
            for i, lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                text = text.as_py() or ""
                for keys in grams(text, langs.get(lang, 0) * FOLDS + (fold(text) + 1) % FOLDS):
                    keys, n = np.unique(keys, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(keys), b.schema.field(0).type), pa.array(keys), pa.array(n)], names=["id", "key", "n"])

    kind = docs.schema["id"].dataType.simpleString()
    left, parts = docs.mapInArrow(run, f"id {kind}, key long, n long"), []
    for order in range(ORDER, 0, -1):
        seen, inside = orders[order - 1]
        both = stored(left.join(seen, "key", "left"), "scored")
        parts.append(both.where("p is not null").select("id", (F.col("n") * F.col("p")).alias("x")))
        rest = both.where("p is null").select("id", "n", "key", F.shiftright("key", 8).alias("c")).join(inside.withColumnRenamed("key", "c"), "c", "left")
        parts.append(rest.select("id", (F.col("n") * F.coalesce("g", F.lit(0))).alias("x")))
        left = rest.select("id", "n", _suffix(F.col("key"), order).alias("key"))
    parts.append(left.select("id", F.col("n") * F.lit(ALIKE)))
    total = parts[0]
    for x in parts[1:]:
        total = total.union(x)
    return total.groupBy("id").agg(F.sum("x").alias("sum"))


def _bands(facts: DataFrame, band: float) -> DataFrame:
    """(_l, low, high) of each language: quartiles of log by a histogram of 1 / STEPS nats, so they do not depend on the order of rows."""
    w = Window.partitionBy("lang")
    bins = facts.where("log is not null").groupBy("lang", F.floor(F.col("log") * STEPS).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = bins.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
    at = lambda part: F.min(F.when(F.col("upto") >= part * F.col("all"), F.col("bin"))) / STEPS
    spread = bins.groupBy("lang").agg(at(0.25).alias("q1"), at(0.75).alias("q3"))
    wide = F.greatest(F.col("q3") - F.col("q1"), F.lit(0.025)) * band
    return spread.select(F.col("lang").alias("_l"), (F.col("q1") - wide).alias("low"), (F.col("q3") + wide).alias("high"))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", band: float = BAND, sent: int = SENT) -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, perplexity (of a byte), lower, upper.

    The unit of the n-grams is the byte, the order 5: counts cover all of docs, each language (null is one of its
    own) has its models, one for each half, and its band, and the models grow with what differs in the corpus. The band of a language is
    its quartiles of log perplexity, over documents that pass the base rules, widened by `band` quartile distances
    (at least a tenth of a nat each) on either side. The model goes to the executors when it has at most `sent`
    n-grams, a bound that is checked; beyond, documents are scored by joins, each row by its own text there too.

    Null text has no words and fails. An empty text has perplexity null, and fails by the base rules. Repeated rows
    each give a row; an empty table none. Only id, text and lang are read from docs.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    langs = languages(rows, "lang")
    orders = kneser_ney(stored(counted(rows.select("lang", "text"), langs), "counts"), FOLDS * (len(langs) + 1))
    many = sum(p.count() for p, _ in orders)
    if many <= sent:
        model = Model([(_fetched(p, "p"), _fetched(g, "g")) for p, g in orders])
        facts = stored(_facts(rows, langs, rows.sparkSession.sparkContext.broadcast(model)), "facts")
    else:
        key = row_key("id", "lang", "text")
        plain = stored(_facts(rows.select(F.struct("id", key.alias("k")).alias("id"), "lang", "text"), langs, None), "plain")
        sums = joined_nats(rows.select(key.alias("id"), "lang", "text"), langs, orders)
        copies = plain.groupBy(F.col("id.k").alias("_k")).agg(F.count(F.lit(1)).alias("copies"))
        each = sums.join(copies, sums["id"] == copies["_k"]).select("_k", F.expr("sum div copies").alias("nats"))
        scored = plain.drop("nats").join(each, F.col("id.k") == F.col("_k"), "left")
        facts = stored(scored.withColumn("id", F.col("id.id")).drop("_k"), "facts")
    facts = facts.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).withColumn("log", F.when(F.col("bytes") > 0, -F.col("nats") / (F.col("bytes") * F.lit(float(UNIT)))))
    bands = _bands(facts.where("not base_failed"), band)
    bands = F.broadcast(bands) if len(langs) <= BROADCAST else bands
    out = facts.join(bands, F.col("lang").eqNullSafe(F.col("_l")), "left")
    return out.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(F.col("log").between(F.col("low"), F.col("high")), F.lit(False))).alias("kept"),
        F.exp("log").alias("perplexity"), F.exp("low").alias("lower"), F.exp("high").alias("upper"),
    )
