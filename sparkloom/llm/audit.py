"""Filter interaction audit: what each of five filters removes in every order in which they may be applied."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import WORD, stored

#: The filters, each a bit of a mask, in this order; all subsets of them.
LETTERS = "ABCDE"
SUBSETS = range(1 << len(LETTERS))


def word_counts(texts: DataFrame) -> DataFrame:
    """(sha, words, distinct, least) of texts (sha, text, least), one row each: words exploded, counted by (sha, word), then by sha.

    texts comes dealt by sha (its group-by), so both counts run where the text lies: no word crosses the network. A
    text without words keeps its row, with zeros.
    """
    word = F.explode_outer(F.split("text", rf"(?:(?!{WORD})[\s\S])+")).alias("word")
    each = texts.select("sha", "least", word).groupBy("sha", "least", "word").agg(F.count(F.lit(1)).alias("n"))
    real = F.col("word") != ""
    return each.groupBy("sha", "least").agg(
        F.coalesce(F.sum(F.when(real, F.col("n"))), F.lit(0)).alias("words"),
        F.count_if(real).alias("distinct"),
    )


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, mask) for each row of docs: bit 1 << k is set where the row fails filter LETTERS[k].

    A: under 200 words. B: 100 distinct words < 50 words. C: 100 letters A to Z > 3 code points. D: a character of
    #$%&*|. E: the text of any smaller id. Texts are told apart by SHA-256; words are counted once for each different text,
    which the map side thins first, so a group of copies with a third of all rows is counted once. The documents' rows,
    without their text, meet the counts by an outer join that adaptive execution splits at hot texts.

    Null text counts as empty: no words (A), E where a smaller id is empty too. A null id is no smaller than any and
    none is smaller than it: no E. Rows that repeat an id are rows of their own, and no E of each other. A null part
    is the part ''. Only these three columns are read, whatever the others are called.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("sha"))
    texts = rows.groupBy("sha").agg(F.any_value("text").alias("text"), F.min("id").alias("least"))
    counts = stored(word_counts(texts), "words")
    capitals = F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    flags = rows.select("id", "part", "sha", (100 * capitals > 3 * F.length("text")).alias("C"), F.col("text").rlike(r"[#$%&*|]").alias("D"))
    both = flags.join(counts, "sha", "left")
    failed = {
        "A": F.coalesce("words", F.lit(0)) < 200,
        "B": 100 * F.col("distinct") < 50 * F.col("words"),
        "C": F.col("C"),
        "D": F.col("D"),
        "E": F.col("id") > F.col("least"),
    }
    mask = F.lit(0)
    for k, letter in enumerate(LETTERS):
        mask = mask + F.when(failed[letter], 1 << k).otherwise(0)
    return both.select("id", "part", mask.alias("mask"))


def passing(masks: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """For each part 32 conditional counts of documents that fail no filter of a subset: n0 to n31, and the same of good (g) and toxic ones (t).

    labels (id, quality, toxic); of several rows for an id any 1 counts. Rows are first counted by part, mask and label,
    so what the wide aggregate reads is at most 128 rows a part.
    """
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
    alike = masks.join(known, "id", "left").groupBy("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("bad", F.lit(0)).alias("bad")).agg(F.count(F.lit(1)).alias("n"))
    weigh = {"n": F.col("n"), "g": F.col("n") * F.col("good"), "t": F.col("n") * F.col("bad")}
    counted = [F.sum(F.when(F.col("mask").bitwiseAND(F.lit(s)) == 0, w).otherwise(0)).alias(f"{c}{s}") for c, w in weigh.items() for s in SUBSETS]
    return alike.groupBy("part").agg(*counted)


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): 600 rows a part.

    With the counts of passing(): a step keeps what passes the filters up to it, and removes the difference to the step
    before. redundant is what fails the filter and is gone already; unique_fails passes all filters but this one;
    shapley sums what the filter removes over all 120 orders. A table without rows has no parts and gives none.
    """
    counts = passing(failures(docs, id_col, text_col, part_col), labels, id_col)
    last = len(LETTERS) - 1
    orders = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(LETTERS)]))
    shares = []
    for k in range(len(LETTERS)):  # an order's filters before this one are the subset s in s! (4 - s)! orders
        without = [s for s in SUBSETS if not s >> k & 1]
        shares.append(sum((factorial(s.bit_count()) * factorial(last - s.bit_count()) * (F.col(f"n{s}") - F.col(f"n{s | 1 << k}")) for s in without), F.lit(0)))
    wide = counts.select("part", *[F.array(*[f"{c}{s}" for s in SUBSETS]).alias(c) for c in "ngt"], F.array(*shares).alias("shares"))
    each = wide.withColumn("filter_order", orders).select("*", F.posexplode(F.split("filter_order", "")).alias("before", "letter"))
    each = each.selectExpr(
        "*",
        "ascii(letter) - ascii('A') AS k",
        "aggregate(split(left(filter_order, before), ''), 0, (m, x) -> m + if(x = '', 0, shiftleft(1, ascii(x) - ascii('A')))) AS was",
    ).selectExpr("*", "shiftleft(1, k) AS own", "was + shiftleft(1, k) AS now", f"{len(SUBSETS) - 1} AS full")
    return each.selectExpr(
        "part",
        "filter_order",
        "before + 1 AS step",
        "n[now] AS kept",
        "n[was] - n[now] AS removed",
        "n[0] - n[own] - (n[was] - n[now]) AS redundant",
        "n[full - own] - n[full] AS unique_fails",
        "g[was] - g[now] AS good_lost",
        "t[was] - t[now] AS toxic_lost",
        "shares[k] AS shapley",
    )


#: Each filter's flag by DuckDB, then every step of every order counted directly over the documents.
ORACLE = """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
l AS (SELECT doc_id AS id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
    (CASE WHEN len(words) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN doc_id > least THEN 'E' ELSE '' END) AS failed
    FROM w LEFT JOIN l ON doc_id = id),
c AS (SELECT part, failed, good, bad, count(*) AS n FROM f GROUP BY part, failed, good, bad),
x AS (SELECT unnest(string_split('ABCDE', '')) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, i AS step, filter_order[i] AS letter, left(filter_order, i - 1) AS before FROM o, range(1, 6) r(i)),
p AS (SELECT part, filter_order, step, letter, n, good, bad, contains(failed, letter) AS fails,
    len(list_intersect(string_split(before, ''), string_split(failed, ''))) > 0 AND before <> '' AND failed <> '' AS gone, failed = letter AS alone FROM c, s),
r AS (SELECT part, filter_order, step, letter,
    sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN gone AND fails THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN alone THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN NOT gone AND fails THEN n * good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN NOT gone AND fails THEN n * bad ELSE 0 END)::BIGINT AS toxic_lost
    FROM p GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM r
"""
