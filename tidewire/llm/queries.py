"""The operators' queries over their whole tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@_query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_components

    return simhash_components(_table(spark, sf_dir, "documents"))


@_query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), meta=["n_chars"])


@_query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(_table(spark, sf_dir, "documents"))


@_query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"))


@_query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query
def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import digest, reconstruct, render

    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    role = F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant"))
    values = {"conv_id": F.lit(-7), "turn": F.col("id"), "role": role, "text": F.lit(text)}
    more = spark.range(2).select(*[values[f.name].cast(f.dataType).alias(f.name) for f in rows.schema])
    return digest(render(reconstruct(rows.unionByName(more))))


def _oracles() -> dict[str, str]:
    from . import chat, decontaminate

    return {"op4_decontamination": decontaminate.ORACLE, "op7_chat": chat.ORACLE}


ORACLES |= _oracles()


@_query
def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlfilter import filter_urls

    return filter_urls(_table(spark, sf_dir, "pages"))


@_query
def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


@_query
def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import dedup_substrings

    out = dedup_substrings(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.withColumnsRenamed({"_removed": "removed", "_removed_words": "removed_words"})
