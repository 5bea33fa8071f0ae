"""Watermark polling: keyset pages of own-region rows that changed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys
from ..spec import TableSpec

PAGE = 1000


@dataclass
class Cursor:
    """Where polling stands: the last version and key values (none: only newer versions count)."""

    version: int = 0
    pk: tuple = field(default_factory=tuple)


def high_water(df: DataFrame, spec: TableSpec, region: str) -> DataFrame:
    """The largest version among own rows, 0 where there are none."""
    own = df.where(F.col(spec.region_field) == region)
    return own.agg(F.coalesce(F.max(keys.version_of(F.col(spec.updated_at_field))), F.lit(0)).alias("version"))


def changed(df: DataFrame, spec: TableSpec, region: str, cursor: Cursor) -> DataFrame:
    """Own rows after the cursor, with _version; not ordered.

    The version is computed, which the scan cannot use, so the bare watermark
    column is bounded as well: that bound reaches the Parquet reader.
    """
    ts = F.col(spec.updated_at_field)
    version = keys.version_of(ts)
    since = datetime(1970, 1, 1) + timedelta(microseconds=cursor.version)
    bound = F.lit(since).cast(df.schema[spec.updated_at_field].dataType)
    own = df.where((F.col(spec.region_field) == region) & (ts >= bound))
    newer = keys.after([version, *spec.primary_key], [cursor.version, *cursor.pk]) if cursor.pk else version > cursor.version
    return own.where(newer).withColumn("_version", version)


def page(df: DataFrame, spec: TableSpec, region: str, cursor: Cursor, limit: int = PAGE) -> DataFrame:
    """The next page as upserts, in order of version and key (a distributed top-k)."""
    rows = changed(df, spec, region, cursor).orderBy("_version", *spec.primary_key).limit(limit)
    return rows.withColumn("_op", F.lit("upsert"))


def poll(df: DataFrame, spec: TableSpec, region: str, cursor: Cursor, handle: Callable[[DataFrame], None], limit: int = PAGE) -> Cursor:
    """Hand pages to ``handle`` until one is short; the cursor moves after each has been handled."""
    while True:
        rows = page(df, spec, region, cursor, limit).persist()
        try:
            last = rows.agg(F.count("*").alias("n"), F.max(F.struct("_version", *spec.primary_key)).alias("last")).first()
            if not last["n"]:
                return cursor
            handle(rows)
            cursor = Cursor(last["last"][0], tuple(last["last"][1:]))
            if last["n"] < limit:
                return cursor
        finally:
            rows.unpersist()
