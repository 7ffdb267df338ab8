"""The document operators' queries, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from sparkloom.llm.common import documents


def op1_mixing(spark, sf_dir):
    from sparkloom.llm.mixing import mix_report

    return mix_report(documents(spark, sf_dir))


def op2_pii(spark, sf_dir):
    from sparkloom.llm.pii import pii_report

    return pii_report(documents(spark, sf_dir))


def op3_exact_dedup(spark, sf_dir):
    from sparkloom.llm.exact_dedup import exact_groups

    return exact_groups(documents(spark, sf_dir), keep="max")


def op4_language_id(spark, sf_dir):
    from sparkloom.llm.langid import fit, predict

    docs = documents(spark, sf_dir)
    return predict(docs, fit(docs))


def op5_quality(spark, sf_dir):
    from sparkloom.llm.quality import quality

    return quality(documents(spark, sf_dir))


def op6_packing(spark, sf_dir):
    from sparkloom.llm.packing import pack

    return pack(documents(spark, sf_dir))


def op7_sharding(spark, sf_dir):
    from sparkloom.llm.sharding import shard

    return shard(documents(spark, sf_dir), 40)


def op8_toxicity(spark, sf_dir):
    from sparkloom.llm.toxicity import fit, scores

    docs = documents(spark, sf_dir)
    return scores(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op9_simhash(spark, sf_dir):
    from sparkloom.llm.simhash import simhash_groups

    return simhash_groups(documents(spark, sf_dir))


def op10_line_dedup(spark, sf_dir):
    from sparkloom.llm.line_dedup import line_dedup

    return line_dedup(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed", "text")


def op11_prefix_trie(spark, sf_dir):
    from sparkloom.llm.prefixes import prefix_trie

    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_url_filters(spark, sf_dir):
    from sparkloom.llm.urls import judge

    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op13_filter_audit(spark, sf_dir):
    from sparkloom.llm.audit import audit

    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries():
    return {k: v for k, v in globals().items() if k.startswith("op")}


def oracle_sql():
    from sparkloom.llm import audit, exact_dedup, line_dedup, pii, prefixes

    return {"op2_pii": pii.oracle(), "op3_exact_dedup": exact_dedup.ORACLE, "op10_line_dedup": line_dedup.ORACLE, "op11_prefix_trie": prefixes.ORACLE, "op13_filter_audit": audit.ORACLE}
