"""Change-log decoding: committed transactions of row changes.

A log row is (tx_id, ord, relation, kind, old struct, new struct, toast
array<string>, committed): ``old`` and ``new`` are rows of the table, ``toast``
names columns whose value the log did not carry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import TableSpec


def committed(log: DataFrame) -> DataFrame:
    """Changes of committed transactions only; a transaction without changes gives none."""
    return log.where("committed") if "committed" in log.columns else log


def whole(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of transactions whose end is there, the rest): ``last`` is true in the row that ends one."""
    done = log.groupBy("tx_id").agg(F.max("last").alias("done")).where("done").select("tx_id")
    return log.join(done, "tx_id", "left_semi"), log.join(done, "tx_id", "left_anti")


def relation(log: DataFrame, spec: TableSpec) -> DataFrame:
    """The changes of one configured table; other relations are dropped here."""
    return log.where(F.col("relation") == spec.name)


def _fail(test: Column, message: str, value: Column) -> Column:
    return F.when(test, F.raise_error(F.lit(message)).cast("boolean")).otherwise(value)


def differing(columns: list[str], spec: TableSpec) -> Column:
    """The columns whose value differs between old and new, key columns always, unsent ones never."""
    each = [F.when(F.lit(c in spec.primary_key) | (~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")) & ~F.array_contains(F.coalesce("toast", F.array().cast("array<string>")), c)), F.lit(c)) for c in columns]
    return F.array_compact(F.array(*each))


def decode(log: DataFrame, spec: TableSpec, region: str, update_diff: bool = False) -> DataFrame:
    """The table's columns, _op, _version, _changed, _tx, _ord of own-region changes.

    Inserts and updates of rows that another region (or nobody) owns are
    dropped. A delete without its owner column, an update with an unsent value
    (full mode) or without its old row (diff mode), and an empty text key fail.
    """
    rows = relation(committed(log), spec)
    columns = rows.schema["new"].dataType.names
    is_delete = F.col("kind") == "delete"
    owner = F.when(is_delete, F.col(f"old.{spec.region_field}")).otherwise(F.col(f"new.{spec.region_field}"))
    own = _fail(is_delete & owner.isNull(), "delete without its owner column: the log needs full row identity", F.coalesce(owner == region, F.lit(False)))
    rows = rows.where(own)
    toast = F.coalesce(F.size("toast"), F.lit(0)) > 0
    is_update = F.col("kind") == "update"
    sound = _fail(is_update & toast & F.lit(not update_diff), "update with a value that the log did not carry", F.lit(True))
    sound = _fail(is_update & F.col("old").isNull() & F.lit(update_diff), "diff needs the old row", sound)
    for c in spec.primary_key:
        value = F.when(is_delete, F.col(f"old.{c}")).otherwise(F.col(f"new.{c}"))
        sound = _fail(F.length(value.cast("string")) == 0, "empty key value", sound)
    rows = rows.where(sound)
    # a delete carries its key alone
    out = [F.when(is_delete, F.col(f"old.{c}") if c in spec.primary_key else F.lit(None)).otherwise(F.col(f"new.{c}")).alias(c) for c in columns]
    every = F.array(*[F.lit(c) for c in columns])
    changed = F.when(is_delete, F.array(*[F.lit(c) for c in spec.primary_key])).when(is_update & F.lit(update_diff), differing(columns, spec)).otherwise(every)
    return rows.select(*out, F.col("kind").alias("_op"), F.col("version").alias("_version"), changed.alias("_changed"), F.col("tx_id").alias("_tx"), F.col("ord").alias("_ord"))
