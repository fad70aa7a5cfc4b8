"""Fingerprints, checksums and shared prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Multipliers of the fingerprint, polynomial of CRC-32C (reflected).
K, P1, P2 = 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D
POLYNOMIAL = 0x82F63B78
ALL = 0xFFFFFFFF


def fingerprint_of(data: bytes) -> int:
    """32-bit fingerprint of bytes; the exact form for any bytes."""
    n = len(data)
    load = lambda at: int.from_bytes(data[at : at + 4], "little")
    if n > 4:
        h = (n * K + load(0) + load(n - 4)) & ALL
        for i in range((n - 4) // 8):
            h = ((h + load(8 + 8 * i)) & ALL) ^ load(4 + 8 * i)
    else:
        signed = [b - 256 if b > 127 else b for b in data]
        a = sum(b << 8 * i for i, b in enumerate(signed)) * K if n < 4 else 0
        h = (K * (n + a)) & ALL ^ (load(0) if n == 4 else 0)
    h ^= h >> 17
    h = h * P1 & ALL
    h ^= h >> 13
    h = h * P2 & ALL
    return h ^ h >> 16


def _times(a: Column, k: int) -> Column:
    """a * k mod 2^32 by halves, so no product overflows."""
    low = a.bitwiseAND(F.lit(0xFFFF)) * F.lit(k)
    high = F.shiftleft((F.shiftright(a, 16) * F.lit(k)).bitwiseAND(F.lit(0xFFFF)), 16)
    return (low + high).bitwiseAND(F.lit(ALL))


def fingerprint32(column: str | Column) -> Column:
    """Fingerprint of a string column as a long, in built-in functions.

    The bytes are read from the hexadecimal form, so any text is hashed as its
    UTF-8; texts of four bytes or fewer take the short form.
    """
    c = F.col(column) if isinstance(column, str) else column
    digits = F.hex(F.encode(c, "utf-8"))
    n = F.octet_length(c).cast("long")

    def byte(at: Column) -> Column:
        return F.conv(F.substr(digits, (at * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("long")

    def load(at: Column) -> Column:
        word = F.substr(digits, (at * 2 + 1).cast("int"), F.lit(8))
        turned = F.concat(*(F.substring(word, 7 - 2 * i, 2) for i in range(4)))
        return F.conv(turned, 16, 10).cast("long")

    mask = F.lit(ALL)
    start = ((n * F.lit(K)).bitwiseAND(mask) + load(F.lit(0).cast("long")) + load(n - 4)).bitwiseAND(mask)
    rounds = F.when(n >= 12, F.sequence(F.lit(0).cast("long"), F.floor((n - 4) / 8).cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))
    long = F.aggregate(rounds, start, lambda z, i: (z + load(i * 8 + 8)).bitwiseAND(mask).bitwiseXOR(load(i * 8 + 4)))
    signed = lambda i: F.when(n > i, F.shiftleft(byte(F.lit(i).cast("long")) - F.when(byte(F.lit(i).cast("long")) > 127, 256).otherwise(0), 8 * i)).otherwise(F.lit(0).cast("long"))
    three = (signed(0) + signed(1) + signed(2)).bitwiseAND(mask)
    short = _times((n + F.when(n < 4, _times(three, K)).otherwise(0)).bitwiseAND(mask), K).bitwiseXOR(F.when(n == 4, load(F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long")))
    mixed = F.when(n > 4, long).otherwise(short)
    # each step is bound once, or the doubled terms would be computed over and over
    steps = F.array(F.lit(0), F.lit(1), F.lit(2))

    def step(h: Column, i: Column) -> Column:
        by = F.when(i == 0, F.shiftright(h, 17)).when(i == 1, F.shiftright(h, 13)).otherwise(F.shiftright(h, 16))
        x = h.bitwiseXOR(by)
        return F.when(i == 0, _times(x, P1)).when(i == 1, _times(x, P2)).otherwise(x)

    return F.aggregate(steps, mixed, step)


def _steps() -> list[int]:
    """What eight steps of the polynomial make of each byte."""
    table = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (POLYNOMIAL if c & 1 else 0)
        table.append(c)
    return table


_STEPS = _steps()


def crc32c_of(data: bytes) -> int:
    """CRC-32C from 0, without the final complement."""
    crc = 0
    for b in data:
        crc = crc >> 8 ^ _STEPS[(crc ^ b) & 255]
    return crc


def crc32c(column: str | Column) -> Column:
    """Checksum of a string or binary column as a long; null for null. Spark's own crc32 is of another polynomial.

    A fold over the bytes, read from the hexadecimal form, by a table of 256.
    """
    c = F.col(column) if isinstance(column, str) else column
    digits = F.hex(c.cast("binary"))
    places = F.when(F.octet_length(c) > 0, F.sequence(F.lit(1), F.octet_length(c))).otherwise(F.array().cast("array<int>"))
    table = F.array(*(F.lit(x).cast("long") for x in _STEPS))

    def step(crc: Column, at: Column) -> Column:
        byte = F.conv(F.substr(digits, at * 2 - 1, F.lit(2)), 16, 10).cast("long")
        return F.shiftright(crc, 8).bitwiseXOR(F.get(table, crc.bitwiseXOR(byte).bitwiseAND(F.lit(255)).cast("int")))

    return F.when(c.isNotNull(), F.aggregate(places, F.lit(0).cast("long"), step))


def common_prefix(a: Column, b: Column) -> Column:
    """Leading bytes that two strings share."""
    x, y = F.hex(F.encode(a, "utf-8")), F.hex(F.encode(b, "utf-8"))
    n = F.least(F.octet_length(a), F.octet_length(b))
    differ = F.filter(F.sequence(F.lit(1), n), lambda i: F.substr(x, i * 2 - 1, F.lit(2)) != F.substr(y, i * 2 - 1, F.lit(2)))
    return F.when(n == 0, F.lit(0)).otherwise(F.coalesce(F.get(differ, F.lit(0)) - 1, n)).cast("long")
