"""Snapshot scans: resumable chunks in key order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.numbering import number_rows
from ..spec import TableSpec

CHUNK = 1000


def chunk(df: DataFrame, spec: TableSpec, region: str, resume: tuple = (), limit: int = CHUNK) -> DataFrame:
    """Own rows strictly after the resume key, in key order; version 0, operation upsert."""
    own = df.where(F.col(spec.region_field) == region)
    if resume:
        own = own.where(keys.after(list(spec.primary_key), list(resume)))
    return own.orderBy(*spec.primary_key).limit(limit).withColumns({"_op": F.lit("upsert"), "_version": F.lit(0).cast("bigint")})


def chunks(df: DataFrame, spec: TableSpec, region: str, size: int = CHUNK, resume: tuple = ()) -> DataFrame:
    """Every remaining own row with its chunk number from 1, numbered in parallel.

    A chunk with fewer rows than ``size`` is the last; after a whole number of
    full chunks, an empty one follows that no row shows.
    """
    own = df.where(F.col(spec.region_field) == region)
    if resume:
        own = own.where(keys.after(list(spec.primary_key), list(resume)))
    return number_rows(own, list(spec.primary_key), "_row").withColumn("chunk_no", F.ceil(F.col("_row") / size).cast("bigint")).drop("_row")


def is_last(rows: int, limit: int = CHUNK) -> bool:
    return rows < limit
