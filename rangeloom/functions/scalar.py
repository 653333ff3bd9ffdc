"""Scalar functions as column expressions (names, hashes, units) and a few driver-side helpers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def env_truth(text: str | None) -> bool:
    """Set, not empty and not "0"."""
    return bool(text) and text != "0"


def particle_id(rank: Column, i: Column, shift: int = 28) -> Column:
    """The id of particle ``i`` of ``rank``: rank << shift | i. ``shift`` is 28, 24 or 32 by the simulator's variant."""
    return F.shiftleft(rank.cast("bigint"), shift).bitwiseOR(i.cast("bigint"))


def particle_name(pid: Column, n_bytes: int = 6) -> Column:
    """Base64 of the low ``n_bytes`` bytes of an id, least significant byte first, without padding.

    Six bytes give 8 characters, eight give 11. Null gives null.
    """
    h = F.lpad(F.hex(pid), 16, "0")
    little = F.concat(*[F.substring(h, 15 - 2 * k, 2) for k in range(n_bytes)])
    return F.regexp_replace(F.base64(F.unhex(little)), "=+$", "")


def hash_rank(key: Column, n: int, radix: int = 0) -> Column:
    """The receiving rank of a key: a 64-bit hash modulo ``n``, cut to the receivers by ``radix`` low bits."""
    if n < 1 or not 0 <= radix <= 8:
        raise ValueError("n must be positive, radix within 0 and 8")
    rank = F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    return rank if radix == 0 else rank.bitwiseAND(F.lit(-1 << radix))


def is_receiver(rank: Column, radix: int = 0) -> Column:
    """Whether a rank takes records when only every 2**radix-th does."""
    return rank.bitwiseAND(F.lit(-1 << radix)) == rank


def message_signature(size: Column, dst: Column, src: Column, epoch: Column, payload: Column) -> Column:
    """A 64-bit fingerprint of a message and where it goes."""
    return F.xxhash64(size, dst, src, epoch, payload)


def byte_fingerprint(data: Column) -> Column:
    """A short checksum to recognise equal log lines by."""
    return F.crc32(data.cast("binary"))


def uniform_int(lo: int, hi: int, seed: int) -> Column:
    """A whole number from lo to hi, both included, the same for the same seed and partitioning."""
    return (F.floor(F.rand(seed) * F.lit(hi - lo + 1)) + F.lit(lo)).cast("bigint")


def next_float32(x: float) -> float:
    """The next larger 32-bit float."""
    return float(np.nextafter(np.float32(x), np.float32(np.inf)))


def _scaled(x: Column, steps: list[tuple[float, str]], digits: int) -> Column:
    value, out = x.cast("double"), None
    for factor, unit in steps:
        text = F.format_string(f"%.{digits}f {unit}".replace("%%", "%"), value / F.lit(factor))
        out = F.when(F.abs(value) >= factor, text) if out is None else out.when(F.abs(value) >= factor, text)
    smallest = steps[-1]
    return out.otherwise(F.format_string(f"%.{digits}f {smallest[1]}", value / F.lit(smallest[0])))


# The unit steps in which durations, numbers and sizes are told.
DURATION_STEPS = [(86400.0 * 365, "years"), (86400.0, "days"), (3600.0, "hrs"), (60.0, "min"), (1.0, "s"), (1e-3, "ms"), (1e-6, "us")]
NUMBER_STEPS = [(1e12, "T"), (1e9, "G"), (1e6, "M"), (1e3, "K"), (1.0, "")]
DECIMAL_SIZE_STEPS = [(1e12, "TB"), (1e9, "GB"), (1e6, "MB"), (1e3, "KB"), (1.0, "B")]
BINARY_SIZE_STEPS = [(2.0**40, "TiB"), (2.0**30, "GiB"), (2.0**20, "MiB"), (2.0**10, "KiB"), (1.0, "B")]


def pretty_duration(seconds: Column, digits: int = 2) -> Column:
    return _scaled(seconds, DURATION_STEPS, digits)


def pretty_number(x: Column, digits: int = 2) -> Column:
    return F.rtrim(_scaled(x, NUMBER_STEPS, digits))


def pretty_size(n_bytes: Column, digits: int = 2, binary: bool = True) -> Column:
    return _scaled(n_bytes, BINARY_SIZE_STEPS if binary else DECIMAL_SIZE_STEPS, digits)


def pretty_rate(n: Column, seconds: Column, digits: int = 2) -> Column:
    """Operations a second."""
    return F.concat(F.rtrim(_scaled(n / seconds, NUMBER_STEPS, digits)), F.lit("op/s"))


def pretty_bandwidth(n_bytes: Column, seconds: Column, digits: int = 2, binary: bool = True) -> Column:
    return F.concat(pretty_size(n_bytes / seconds, digits, binary), F.lit("/s"))
