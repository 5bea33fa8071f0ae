"""What is replicated: table, peer, transformer and lease descriptions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from enum import StrEnum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BooleanType, ByteType, DataType, IntegerType, LongType, ShortType, StructType


class Op(StrEnum):
    INSERT = "insert"
    UPDATE = "update"
    UPSERT = "upsert"
    DELETE = "delete"


class Mode(StrEnum):
    """Which operations are broadcast, or applied."""

    INSERT_ONLY = "insert_only"
    UPSERT = "upsert"
    FULL_SYNC = "full_sync"


class JobStatus(StrEnum):
    PENDING = "pending"
    SNAPSHOTTING = "snapshotting"
    CATCHING_UP = "catching_up"
    FINISHED = "finished"


class LeaseKind(StrEnum):
    PRODUCER = "producer"
    STREAM = "stream"
    SNAPSHOT = "snapshot"


def pk_type(kind: DataType) -> str:
    """integer, boolean or (for anything else) string."""
    if isinstance(kind, ByteType | ShortType | IntegerType | LongType):
        return "integer"
    return "boolean" if isinstance(kind, BooleanType) else "string"


@dataclass(frozen=True)
class TableSpec:
    """A replicated table: its key in order, owner column and watermark column."""

    name: str
    primary_key: tuple[str, ...]
    region_field: str
    updated_at_field: str | None = None

    def check(self, schema: StructType) -> None:
        """Raise ValueError if a column that the table needs is missing."""
        wanted = [*self.primary_key, self.region_field, *([self.updated_at_field] if self.updated_at_field else [])]
        if missing := [c for c in wanted if c not in schema.names]:
            raise ValueError(f"table {self.name} has no column {', '.join(missing)}")

    def values(self, columns: list[str]) -> list[str]:
        """The columns that are not part of the key, sorted."""
        return sorted(set(columns) - set(self.primary_key))


@dataclass(frozen=True)
class PeerSpec:
    region: str
    endpoint: str


@dataclass(frozen=True)
class TransformerSpec:
    table: str
    fields: tuple[str, ...]
    key_id: str
    crypto_type: str = "aes-gcm"
    type: str = "crypto"


@dataclass(frozen=True)
class Lease:
    kind: LeaseKind
    region: str
    peer: str = ""
    table: str = ""
    owner: str = ""
    generation: int = 0
    expires_at: float = 0.0


@dataclass
class Config:
    region: str
    tables: list[TableSpec] = field(default_factory=list)
    peers: list[PeerSpec] = field(default_factory=list)
    transformers: list[TransformerSpec] = field(default_factory=list)
    source_type: str = "cdc"
    update_diff: bool = False
    poll_interval: float = 5.0
    status_interval: float = 10.0
    chunk_size: int = 1000
    apply_mode: Mode = Mode.UPSERT
    broadcast_mode: Mode = Mode.FULL_SYNC
    max_batch_events: int = 1000
    lease_ttl: float = 15.0
    lease_renew: float = 5.0
    lease_cleanup: float = 300.0
    outbox_cleanup: float = 300.0
    max_batch_age: float = 168 * 3600.0
    max_pending_per_peer: int = 100_000
    reconnect_delay: float = 5.0
    key_refresh: float = 60.0
    key_attempts: int = 3
    key_delay: float = 1.0
    active_key_id: str = "current"
    log_level: str = "info"
    log_format: str = "text"


def columns(spark: SparkSession, tables: Iterable[TableSpec], schemas: Mapping[str, StructType]) -> DataFrame:
    """The column catalogue: table_name, column_name, data_type, key_at (from 1, null for others), key_type."""
    rows = []
    for t in tables:
        for f in schemas[t.name]:
            at = t.primary_key.index(f.name) + 1 if f.name in t.primary_key else None
            rows.append((t.name, f.name, f.dataType.simpleString(), at, pk_type(f.dataType) if at else None))
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, key_at int, key_type string")
