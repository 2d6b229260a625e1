"""Weighted rendezvous hashing of stable record keys over shards.

Every row scores every shard by a hash of (key, shard) and goes to the best one.
A shard's scores don't depend on the other shards, so a shard that is added
takes rows only into itself, and one that is removed gives away only its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, text_or_empty

#: Hex digits of the MD5 that make a score's fraction.
DIGITS = 13


def _draw(key: Column, shard: int) -> Column:
    """A fraction between 0 and 1, fixed by the key and the shard."""
    return (F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{shard}"))), 1, DIGITS), 16, 10).cast("double") + 0.5) / float(16**DIGITS)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard 0..len(weights)-1 of a string key; a null key counts as an empty one.

    Shards get keys in proportion to their weights. Ties, which need equal
    52-bit hashes, go to the lower shard.
    """
    k = F.coalesce(key, F.lit(""))
    scored = [F.struct((-F.ln(_draw(k, s)) / F.lit(float(w))).alias("cost"), F.lit(s).alias("shard")) for s, w in enumerate(weights) if w > 0]
    return F.array_min(F.array(*scored))["shard"]


def shard_rows(docs: DataFrame, weights: Sequence[float] = (1.0,) * 16, key: str = "doc_id", slots: bool = True) -> DataFrame:
    """All rows and columns of ``docs`` with shard, and slot: its place in the shard, gapless from 0.

    Input columns named shard or slot are replaced. Slots follow the key's hash,
    which shuffles each shard the same way in every run; rows with the same key
    share a shard and take neighbouring slots in an order fixed by all their
    columns that can be compared. Null keys share one shard.
    """
    text_key = F.col(key).cast("string")
    out = docs.drop("shard", "slot").withColumn("shard", rendezvous(text_key, weights))
    if not slots:
        return out
    digest = F.md5(F.coalesce(text_key, F.lit("")))
    rest = F.xxhash64(*[F.col(c) for c, kind in docs.dtypes if c not in ("shard", "slot") and "map" not in kind and kind != "variant"])
    out = numbered(out, ["shard"], [digest, rest], F.substring(digest, 1, 3), "slot")
    return out.withColumn("slot", F.col("slot").cast("long"))


def shard_digest(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """Per document its size, text checksum, shard of ``n_shards`` equal ones, slot and shard when there is one more."""
    narrow = docs.select("doc_id", (F.octet_length(text_or_empty()) + 1).cast("long").alias("size"), F.crc32(text_or_empty()).alias("text_crc32"))
    sharded = shard_rows(narrow, (1.0,) * n_shards)
    grown = rendezvous(F.col("doc_id").cast("string"), (1.0,) * (n_shards + 1))
    return sharded.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", grown.alias("grown_shard"))


def op5_sql(n_shards: int = 16) -> str:
    """The same over DuckDB, which has no CRC-32 of its own: it is folded from the bytes and the usual table."""
    table = []
    for b in range(256):
        for _ in range(8):
            b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
        table.append(b)
    crc = f"xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: ('0x' || h)::BIGINT), lambda a, b: xor(a >> 8, ({table})[(xor(a, b) & 255) + 1]), 4294967295::BIGINT))"
    draw = f"((('0x' || substr(md5(k || '/' || s), 1, {DIGITS}))::BIGINT)::DOUBLE + 0.5) / {16**DIGITS}.0"
    return f"""
    WITH t AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, coalesce(text, '') AS t FROM documents),
    d AS (SELECT doc_id, k, (strlen(t) + 1)::BIGINT AS size, CASE WHEN t = '' THEN 0 ELSE {crc} END AS text_crc32 FROM t),
    c AS (SELECT *, -ln({draw}) AS cost FROM d, (SELECT unnest(range(0, {n_shards + 1})) AS s)),
    b AS (SELECT doc_id, k, size, text_crc32, (arg_min(s, cost) FILTER (s < {n_shards}))::INTEGER AS shard, arg_min(s, cost)::INTEGER AS grown_shard FROM c GROUP BY doc_id, k, size, text_crc32)
    SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY md5(k)) - 1 AS slot, grown_shard FROM b"""
