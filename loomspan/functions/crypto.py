"""Field encryption and blind indexes, by built-in functions.

A value is ``base64(version (4 bytes) + nonce (12) + ciphertext + tag (16))`` under
AES-256-GCM; its place (schema, table, column) is authenticated with it, so that a value
moved elsewhere does not decrypt.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column
from pyspark.sql import functions as F


def place(schema: str, table: str, column: str) -> str:
    return f"{schema}|{table}|{column}"


def encrypt(value: Column, key: bytes, version: int, where: str) -> Column:
    sealed = F.aes_encrypt(value.cast("string").cast("binary"), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), F.lit(where.encode()))
    return F.base64(F.concat(F.lit(version.to_bytes(4, "big")), sealed))


def decrypt(value: Column, keys: dict[int, bytes], where: str) -> Column:
    """Null for an unknown key version or a value that was changed or moved."""
    raw = F.unbase64(value)
    version = F.conv(F.hex(F.substring(raw, 1, 4)), 16, 10).cast("int")
    out = F.lit(None).cast("string")
    for number, key in keys.items():
        plain = F.try_aes_decrypt(F.substring(raw, 5, 1 << 30), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(where.encode()))
        out = F.when(version == number, plain.cast("string")).otherwise(out)
    return out


def blind_index(value: Column, key: bytes) -> Column:
    """HMAC-SHA256 of the text in hex: equal values have equal tokens, and nothing else shows."""
    block = hashlib.sha256(key).digest() if len(key) > 64 else key
    block = block.ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in block) for pad in (0x36, 0x5C))
    digest = F.unhex(F.sha2(F.concat(F.lit(inner), value.cast("string").cast("binary")), 256))
    return F.sha2(F.concat(F.lit(outer), digest), 256)


def blind_token(value: str, key: bytes) -> str:
    """The same token for a literal, as filters need it."""
    return hmac.new(key, value.encode(), hashlib.sha256).hexdigest()


def reencrypt(value: Column, keys: dict[int, bytes], version: int, where: str) -> Column:
    """Under the key ``version``; values that have it already, or that no key opens, stay as they are."""
    current = F.conv(F.hex(F.substring(F.unbase64(value), 1, 4)), 16, 10).cast("int")
    plain = decrypt(value, keys, where)
    return F.when((current != version) & plain.isNotNull(), encrypt(plain, keys[version], version, where)).otherwise(value)


def sealed(actions, table, keys: dict[int, bytes], version: int):
    """Mutation actions with encrypted columns sealed and their blind indexes filled in."""
    for name, column in table.columns.items():
        if not column.metadata.get("encrypt"):
            continue
        blind = column.metadata.get("blind-index")
        if blind:
            actions = actions.withColumn(blind, blind_index(F.col(name), keys[version]))
            actions = actions.withColumn("__set", F.when(F.array_contains("__set", name), F.array_union("__set", F.array(F.lit(blind)))).otherwise(F.col("__set")))
        actions = actions.withColumn(name, F.when(F.col(name).isNotNull(), encrypt(F.col(name), keys[version], version, place(table.schema, table.name, name))))
    return actions
