"""The registered queries of the corpus operators and the SQL that checks them."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import hardneg, language, licences, linededup, maxent, merkle, mixing, multiindex, ngramjoin, pii
from faultline.llm import quality, tokens, urlfilter
from faultline.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_topk_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return multiindex.search(vectors, vectors.filter("vec_id % 20 = 0"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(documents(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(documents(spark, sf_dir))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(documents(spark, sf_dir))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(documents(spark, sf_dir))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_report(documents(spark, sf_dir))


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_report(documents(spark, sf_dir))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.join_report(documents(spark, sf_dir))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_report(documents(spark, sf_dir))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score_report(documents(spark, sf_dir))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.url_report(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hardneg.negatives_report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_report(documents(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "op1_topk_codes": op1_topk_codes,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_personal_data": op4_personal_data,
    "op5_mix_sources": op5_mix_sources,
    "op6_language": op6_language,
    "op7_licence_scan": op7_licence_scan,
    "op8_ngram_join": op8_ngram_join,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_lm_score": op10_lm_score,
    "op11_url_filter": op11_url_filter,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_manifest": op13_manifest,
}
