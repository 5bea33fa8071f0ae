"""Primary keys, event ids, keyset predicates and identifiers as Column expressions."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..spec import TableSpec, pk_type

PK_SCHEMA = "array<struct<column string, type string, int_value bigint, bool_value boolean, str_value string>>"


def json_fragment(c: Column) -> Column:
    """One value as JSON text."""
    whole = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


def row_json(columns: Sequence[str]) -> Column:
    """A row as a JSON object, nulls kept."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"})


def pk_array(spec: TableSpec, schema: StructType, prefix: str = "") -> Column:
    """The key as an ordered array of parts; it sorts by column, type, value, shorter first.

    Strings are kept as JSON text, whose bytes are what keys compare by.
    """
    parts = []
    for c in spec.primary_key:
        kind, col = pk_type(schema[prefix + c].dataType), F.col(f"`{prefix}{c}`")
        parts.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit(kind).alias("type"),
                (col.cast("bigint") if kind == "integer" else F.lit(None).cast("bigint")).alias("int_value"),
                (col if kind == "boolean" else F.lit(None).cast("boolean")).alias("bool_value"),
                (json_fragment(col.cast("string")) if kind == "string" else F.lit(None).cast("string")).alias("str_value"),
            )
        )
    return F.array(*parts)


def no_key() -> Column:
    """The key of a cursor that has none: before every key."""
    return F.array().cast(PK_SCHEMA)


def part_json(part: Column) -> Column:
    return F.coalesce(part["int_value"].cast("string"), part["bool_value"].cast("string"), part["str_value"])


def pk_json(pk: Column) -> Column:
    """The array of {column, type, json_value} that travels."""
    return F.to_json(F.transform(pk, lambda p: F.struct(p["column"].alias("column"), p["type"].alias("type"), part_json(p).alias("json_value"))))


def parse_pk(text: Column) -> Column:
    """The reverse of pk_json; an empty or null text is the key of no row."""
    raw = F.from_json(F.when(F.length(text) > 0, text), "array<struct<column string, type string, json_value string>>")
    value = lambda p, kind, cast: F.when(p["type"] == kind, p["json_value"].cast(cast))
    one = lambda p: F.struct(p["column"].alias("column"), p["type"].alias("type"), value(p, "integer", "bigint").alias("int_value"), value(p, "boolean", "boolean").alias("bool_value"), F.when(~p["type"].isin("integer", "boolean"), p["json_value"]).alias("str_value"))
    return F.coalesce(F.transform(raw, one), no_key())


def pk_object(pk: Column) -> Column:
    """The key as a map from column to JSON value."""
    return F.map_from_entries(F.transform(pk, lambda p: F.struct(p["column"], part_json(p))))


def typed_text(text: Column, kind: str) -> Column:
    """Key text as its JSON value; integers and booleans must parse. t and f become true and false."""
    if kind == "integer":
        made = F.expr("try_cast(__t AS BIGINT)") if text is None else text.try_cast("bigint").cast("string")
    elif kind == "boolean":
        made = F.when(F.lower(text).isin("1", "t", "true"), F.lit("true")).when(F.lower(text).isin("0", "f", "false"), F.lit("false"))
    else:
        return json_fragment(text)
    return F.when(made.isNull(), F.raise_error(F.concat(F.lit(f"not a {kind} key: "), text)).cast("string")).otherwise(made)


def _sized(c: Column) -> Column:
    return F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)


def event_id(table: Column | str, pk: Column, version: Column, op: Column) -> Column:
    """SHA-256 in hex of the byte-length-prefixed table, key parts, version and operation."""
    table = F.lit(table) if isinstance(table, str) else table
    parts = F.array_join(F.transform(pk, lambda p: F.concat(_sized(p["column"]), _sized(p["type"]), _sized(part_json(p)))), "")
    text = F.concat(_sized(table), F.size(pk).cast("string"), F.lit(":"), parts, _sized(version.cast("string")), _sized(op))
    return F.sha2(text.cast("binary"), 256)


def after(columns: Sequence[str | Column], values: Sequence[object]) -> Column:
    """(columns...) > (values...) by rows, as comparisons that reach the Parquet scan."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    cond, equal = None, None
    for c, v in zip(cols, values, strict=True):
        v = v if isinstance(v, Column) else F.lit(v)
        step = c > v if equal is None else equal & (c > v)
        cond = step if cond is None else cond | step
        equal = (c == v) if equal is None else equal & (c == v)
    # the first column alone bounds the scan
    first = values[0] if isinstance(values[0], Column) else F.lit(values[0])
    return (cols[0] >= first) & cond


def version_of(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp, with or without time zone (session zone UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def lsn_text(position: Column) -> Column:
    """A log position as X/Y in hex."""
    return F.concat(F.hex(F.shiftrightunsigned(position, 32)), F.lit("/"), F.hex(position.bitwiseAND(F.lit(0xFFFFFFFF))))


def lsn_number(text: Column) -> Column:
    """X/Y as a long; beyond 64 bits an error."""
    two = F.split(text, "/")
    high, low = F.conv(two[0], 16, 10).cast("bigint"), F.conv(two[1], 16, 10).cast("bigint")
    return F.when(high > 0x7FFFFFFF, F.raise_error(F.concat(F.lit("log position too large: "), text)).cast("bigint")).otherwise(high * F.lit(1 << 32) + low)


def table_name(name: str) -> tuple[str, str]:
    """(schema, table) of ``table`` or ``schema.table``; the default schema is public."""
    parts = [p.strip() for p in name.split(".")]
    if len(parts) > 2 or not all(parts):
        raise ValueError(f"not a table name: {name!r}")
    return (parts[0], parts[1]) if len(parts) == 2 else ("public", parts[0])


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def backoff(attempt: int, base: float, cap: float = 30.0, rand: random.Random | None = None) -> float:
    """Seconds to wait: base doubled per attempt, capped; half of it fixed, the rest drawn, base at least."""
    delay = min(cap, base * 2 ** min(attempt, 62))
    return max(base, delay / 2 + (rand or random).random() * delay / 2)


def handshake_version(columns: DataFrame) -> DataFrame:
    """columns(table_name, column_name, data_type) as one compact JSON of tables and columns in name order."""
    per = columns.groupBy("table_name").agg(F.array_sort(F.collect_list(F.struct(F.col("column_name").alias("name"), F.col("data_type")))).alias("columns"))
    return per.agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("table_name").alias("name"), "columns")))).alias("config"))
