"""Keyed hashing and key handling. Secrets enter plans through a scalar subquery, so neither
explain output nor event logs print them."""

import hashlib
import hmac

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_BLOCK = 64


def secret(spark: SparkSession, value: bytes) -> Column:
    """A binary constant that is not shown in the plan."""
    return spark.createDataFrame([(bytearray(value),)], "secret binary").scalar()


def hmac_sha256(spark: SparkSession, key: bytes, message: Column) -> Column:
    """Lowercase hex HMAC-SHA256 of a text column (RFC 2104), computed by two nested sha2 calls."""
    if len(key) > _BLOCK:
        key = hashlib.sha256(key).digest()
    padded = key.ljust(_BLOCK, b"\0")
    inner = secret(spark, bytes(byte ^ 0x36 for byte in padded))
    outer = secret(spark, bytes(byte ^ 0x5C for byte in padded))
    first = F.sha2(F.concat(inner, message.cast("string").cast("binary")), 256)
    return F.sha2(F.concat(outer, F.unhex(first)), 256)


def derive_key(key: bytes, context: bytes, length: int = 32) -> bytes:
    """HKDF-SHA256 (RFC 5869) with an empty salt; up to 32 bytes, so one expansion block."""
    if length > 32:
        raise ValueError("derive_key gives at most 32 bytes")
    pseudo_random = hmac.new(b"\0" * 32, key, hashlib.sha256).digest()
    return hmac.new(pseudo_random, context + b"\x01", hashlib.sha256).digest()[:length]


def canonical_json(frame_columns: dict[str, Column]) -> Column:
    """JSON object with sorted keys and no spaces; null values are written."""
    fields = [frame_columns[name].alias(name) for name in sorted(frame_columns)]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def lookup(mapping: dict[str, object], key: Column) -> Column:
    """Small constant mapping as an expression; null for an unknown key."""
    result: Column = F.lit(None)
    for name, value in mapping.items():
        result = F.when(key == name, F.lit(value)).otherwise(result)
    return result


