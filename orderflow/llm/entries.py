"""The registered queries of this subpackage and their SQL. All run over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.llm import bpe, decontaminate, divergence, html_text, licenses, near_dedup, packing, quality, topk, toxicity, url_rules, warc, whitening
from orderflow.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.report(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), is_query=F.col("id") % 20 == 0)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.report(table(spark, sf_dir, "pages"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = bpe.vocabulary()
    return packing.pack(table(spark, sf_dir, "documents"), ranks=bpe.read_ranks(spark, path), pattern=pattern)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.apply_rules(table(spark, sf_dir, "pages"), url_rules.rules_frame(spark, url_rules.RULES))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(table(spark, sf_dir, "pages"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(table(spark, sf_dir, "embeddings"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_bpe, op2_decontaminate, op3_toxicity, op4_top_k, op5_html_text, op6_near_dedup, op7_packing, op8_quality, op9_url_rules, op10_licenses, op11_warc, op12_whitening, op13_divergence)}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": decontaminate.ORACLE, "op4_top_k": topk.ORACLE, "op9_url_rules": url_rules.ORACLE, "op11_warc": warc.ORACLE, "op13_divergence": divergence.ORACLE}
