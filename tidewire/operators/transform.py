"""Transformer chains: decrypt for transit, restore and encrypt on arrival, scrub metadata.

Rows carry ``fields`` and ``metadata``, maps from name to JSON text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import aead
from ..spec import TransformerSpec

PREFIX = "transit.crypto."
#: Fixed pattern: dotted, non-empty segments of lower-case letters, digits, _ and -.
METADATA_KEY = r"^[\p{Ll}\p{Nd}_-]+(\.[\p{Ll}\p{Nd}_-]+)*$"
_EMPTY = "map<string,string>"

#: Custom types: name -> (encrypt, decrypt), each taking (column, key).
Handler = tuple[Callable[[Column, bytes], Column], Callable[[Column, bytes], Column]]
_REGISTRY: dict[str, Handler] = {}


def register(name: str, encrypt: Callable[[Column, bytes], Column], decrypt: Callable[[Column, bytes], Column]) -> None:
    """Add a crypto type of one's own."""
    _REGISTRY[name.strip().lower()] = (encrypt, decrypt)


def handler(name: str) -> Handler:
    if (own := _REGISTRY.get((name or "").strip().lower())) is not None:
        return own
    kind = aead.algorithm(name)
    return (lambda c, k: aead.encrypt(c, k, kind)), (lambda c, k: aead.decrypt(c, k, kind))


def is_transit(key: Column) -> Column:
    return (key == "transit") | key.startswith("transit.")


def transit_field(key: Column) -> Column:
    """The field that a transit key names, null where it is none."""
    name = F.regexp_extract(key, r"^transit\.crypto\.([a-z0-9_-]+)$", 1)
    return F.when(name != "", name)


def valid_key(key: Column) -> Column:
    return key.rlike(METADATA_KEY)


def counted(df: DataFrame, step: str) -> DataFrame:
    """df, its rows counted as an observed metric.

    The node also keeps the optimizer from inlining a step's expressions into
    each of their uses in the next, which multiplies them.
    """
    return df.observe(f"{step}-{uuid.uuid4().hex[:8]}", F.count(F.lit(1)).alias("rows"))


def chain(df: DataFrame, steps: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    for step in steps:
        df = counted(df, "transform").transform(step)
    return df


def _unquoted(value: Column) -> Column:
    return F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")


def _quoted(value: Column) -> Column:
    whole = F.to_json(F.struct(value.alias("v")))
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


def _replace(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """fields with each named one that is present set to column __new<k>; helper columns go."""
    named = F.array(*[F.lit(n) for n in names]).cast("array<string>")
    entries = [F.struct(F.lit(n).alias("k"), F.col(f"__new{k}").alias("v"), F.map_contains_key("fields", n).alias("has")) for k, n in enumerate(names)]
    made = F.map_from_entries(F.transform(F.filter(F.array(*entries), lambda e: e["has"]), lambda e: F.struct(e["k"], e["v"])))
    out = df.withColumn("__fields", F.map_concat(F.map_filter("fields", lambda k, _: ~F.array_contains(named, k)), made))
    return out.withColumn("fields", F.col("__fields")).drop(*[c for c in out.columns if c.startswith("__")])


def _fields(specs: Sequence[TransformerSpec]) -> list[tuple[TransformerSpec, str]]:
    return list({f: (s, f) for s in specs for f in s.fields}.values())


def decrypt_fields(df: DataFrame, specs: Sequence[TransformerSpec], keys: Mapping[str, bytes]) -> DataFrame:
    """fields with the configured ones decrypted; values that are no JSON strings stay.

    A JSON null is an empty plain text, as an empty string is. Bytes in the
    text form of the database (\\x and hex) are decoded first. Each step is a
    column of its own, so that no step is evaluated once for every use.
    """
    if not (every := _fields(specs)):
        return df
    n = range(len(every))
    df = counted(df, "decrypt").withColumns({f"__raw{k}": F.try_element_at("fields", F.lit(f)) for k, (_, f) in enumerate(every)})
    df = df.withColumns({f"__text{k}": F.coalesce(_unquoted(F.col(f"__raw{k}")), F.lit("")) for k in n})

    def cipher(text: Column) -> Column:
        hexed = text.startswith("\\x") & (F.length(text) % 2 == 0) & F.substr(text, F.lit(3)).rlike("^[0-9a-fA-F]*$")
        return F.when(hexed, F.unhex(F.substr(text, F.lit(3))).cast("string")).otherwise(text)

    df = df.withColumns({f"__cipher{k}": cipher(F.col(f"__text{k}")) for k in n})
    df = df.withColumns({f"__plain{k}": handler(s.crypto_type)[1](F.col(f"__cipher{k}"), keys[s.key_id]) for k, (s, _) in enumerate(every)})
    secret = lambda raw: raw.startswith('"') | (raw == "null")
    df = df.withColumns({f"__new{k}": F.when(secret(F.col(f"__raw{k}")), F.col(f"__plain{k}")).otherwise(F.col(f"__raw{k}")) for k in n})
    return _replace(df, [f for _, f in every])


def encrypt_fields(df: DataFrame, specs: Sequence[TransformerSpec], keys: Mapping[str, bytes]) -> DataFrame:
    """fields with the configured ones, where present, encrypted as JSON strings; deletes stay."""
    if not (every := _fields(specs)):
        return df
    raw = {f"__raw{k}": F.try_element_at("fields", F.lit(f)) for k, (_, f) in enumerate(every)}
    if "_op" in df.columns:
        raw = {k: F.when(F.col("_op") != "delete", c) for k, c in raw.items()}
    df = counted(df, "encrypt").withColumns(raw)
    df = df.withColumns({f"__cipher{k}": handler(s.crypto_type)[0](F.col(f"__raw{k}"), keys[s.key_id]) for k, (s, _) in enumerate(every)})
    kept = (lambda f, c: F.when(F.col("_op") == "delete", F.try_element_at("fields", F.lit(f))).otherwise(c)) if "_op" in df.columns else (lambda f, c: c)
    df = df.withColumns({f"__new{k}": kept(f, _quoted(F.col(f"__cipher{k}"))) for k, (_, f) in enumerate(every)})
    return _replace(df, [f for _, f in every])


def to_transit(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Move the named fields into metadata as transit.crypto.<field>."""
    named = F.array(*[F.lit(n) for n in names]).cast("array<string>")
    moved = F.transform_keys(F.map_filter("fields", lambda k, _: F.array_contains(named, k)), lambda k, _: F.concat(F.lit(PREFIX), k))
    kept = F.map_filter(F.coalesce("metadata", F.create_map().cast(_EMPTY)), lambda k, _: ~F.map_contains_key(moved, k))
    return df.withColumn("_moved", F.map_concat(kept, moved)).withColumn("fields", F.map_filter("fields", lambda k, _: ~F.array_contains(named, k))).withColumn("metadata", F.col("_moved")).drop("_moved")


def from_transit(df: DataFrame) -> DataFrame:
    """Move transit.crypto.<field> metadata back into fields; deletes stay as they are."""
    back = F.map_filter(F.coalesce("metadata", F.create_map().cast(_EMPTY)), lambda k, _: transit_field(k).isNotNull())
    named = F.transform_keys(back, lambda k, _: transit_field(k))
    fields = F.map_concat(F.map_filter(F.coalesce("fields", F.create_map().cast(_EMPTY)), lambda k, _: ~F.map_contains_key(named, k)), named)
    rest = F.map_filter("metadata", lambda k, _: transit_field(k).isNull())
    if "_op" in df.columns:
        is_delete = F.col("_op") == "delete"
        fields, rest = F.when(is_delete, F.col("fields")).otherwise(fields), F.when(is_delete, F.col("metadata")).otherwise(rest)
    return df.withColumns({"fields": fields, "metadata": rest})


def scrub(df: DataFrame) -> DataFrame:
    """metadata without transit keys; a malformed key is an error."""
    bad = F.exists(F.map_keys("metadata"), lambda k: ~valid_key(k))
    kept = F.map_filter("metadata", lambda k, _: ~is_transit(k))
    return df.withColumn("metadata", F.when(bad, F.raise_error(F.lit("invalid metadata key")).cast(_EMPTY)).otherwise(kept))


def outbound(specs: Sequence[TransformerSpec], keys: Mapping[str, bytes]) -> list[Callable[[DataFrame], DataFrame]]:
    names = sorted({f for s in specs for f in s.fields})
    return [lambda df: decrypt_fields(df, specs, keys), lambda df: to_transit(df, names)]


def inbound(specs: Sequence[TransformerSpec], keys: Mapping[str, bytes]) -> list[Callable[[DataFrame], DataFrame]]:
    return [from_transit, lambda df: encrypt_fields(df, specs, keys), scrub]
