"""Packed records: a float key inside the data, and key and value in one padded field."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_at(data: Column, offset: int) -> Column:
    """The 32-bit little-endian float that begins ``offset`` bytes into the data; null where the data ends before it does."""
    digits = F.hex(F.substring(data, offset + 1, 4))
    bits = F.conv(F.concat(*[F.substring(digits, k, 2) for k in (7, 5, 3, 1)]), 16, 10).cast("bigint")
    sign = F.when(bits >= 1 << 31, F.lit(-1.0)).otherwise(1.0)
    exponent, mantissa = F.shiftright(bits, 23).bitwiseAND(F.lit(255)), bits.bitwiseAND(F.lit((1 << 23) - 1))
    value = (
        F.when((exponent == 255) & (mantissa > 0), F.lit(float("nan")))
        .when(exponent == 255, sign * F.lit(float("inf")))
        .when(exponent == 0, sign * mantissa * F.lit(2.0**-149))
        .otherwise(sign * (mantissa + F.lit(1 << 23)) * F.pow(F.lit(2.0), exponent - 150))
    )
    return F.when(F.octet_length(data) >= offset + 4, value.cast("float"))


def pack_record(key: Column, value: Column, size: int) -> Column:
    """Key and value one after the other, filled with zero bytes up to ``size``. A longer record is an error."""
    joined = F.concat(key.cast("binary"), value.cast("binary"))
    return F.when(F.octet_length(joined) > size, F.raise_error(F.lit("the record is longer than its field"))).otherwise(F.rpad(joined, size, F.lit(b"\x00")))


def written(parts: Column, most: int = 255) -> Column:
    """What several writes to one file leave in it: one after the other, cut at ``most`` bytes."""
    return F.substring(F.aggregate(parts, F.lit(b"").cast("binary"), lambda done, p: F.concat(done, p)), 1, most)
