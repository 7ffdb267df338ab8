"""A corpus from raw documents: toxic texts out, exact and near duplicates out, sources mixed, sequences packed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm.common import dropped, named, plain, row_key, scratch, stored
from sparkloom.llm.exact_dedup import exact_dedup
from sparkloom.llm.mixing import mixed_documents
from sparkloom.llm.packing import pack
from sparkloom.llm.simhash import simhash_dedup
from sparkloom.llm.toxicity import fit, scores


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier (fitted on labelled rows that are not held out) rejects go, each row by its own text, with an id or without."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows, of = plain(docs)
    keyed = rows.withColumn("row", row_key(of["doc_id"], of["text"]))
    marks = scores(keyed, model, id_col="row", text_col=of["text"]).where("predicted = 1").select("row").distinct()
    return named(keyed.join(marks, "row", "left_anti"), of)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    return exact_dedup(docs, keep="min")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: two fingerprints of its different words, 3 or fewer differing bits under either."""
    return simhash_dedup(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: text is what the mix takes of a document."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 ids."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("exact dedup", exact),
    ("near dedup", near),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL has neither the classifier nor the fingerprints; tests/llm holds run() against plain Python, stage by stage.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents, each written as Parquet and read again; what a stage wrote on its way goes when it ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as kept:
            after = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            kept.append(after)
        dropped(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
