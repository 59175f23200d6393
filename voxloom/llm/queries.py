"""The queries of the operators in this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cutting, exact_dedup, filter_audit, html_extract, langid, merkle, mixing, neardup, packing, pii, quality, secrets, sharding
from .common import documents

Query = Callable[[SparkSession, str], DataFrame]


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.rendezvous(documents(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir))


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), size=4)


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.secrets(documents(spark, sf_dir)))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.personal_data(documents(spark, sf_dir)))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op11_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutting.pack_by_patterns(documents(spark, sf_dir))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(documents(spark, sf_dir))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # counted as part of this subpackage; it imports the operators

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {"op2_sharding": op2_sharding, "op4_packing": op4_packing, "op8_exact_dedup": op8_exact_dedup, "op5_language": op5_language, "op6_quality": op6_quality, "op7_neardup": op7_neardup, "op1_html": op1_html, "op9_secrets": op9_secrets, "op10_pii": op10_pii, "op3_mixing": op3_mixing, "op11_cutting_stock": op11_cutting_stock, "op12_merkle": op12_merkle, "op13_filter_audit": op13_filter_audit, "pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op2_sharding": sharding.SHARD_SQL, "op8_exact_dedup": exact_dedup.EXACT_SQL, "op3_mixing": mixing.MIX_SQL, "op12_merkle": merkle.merkle_sql(), "op13_filter_audit": filter_audit.AUDIT_SQL}
