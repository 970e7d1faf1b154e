"""Reproducible random draws: a draw depends on seed, row id and purpose, never on partitioning."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, functions as F

_SPAN = float(2 ** 52)


def uniform(seed: int, row_id: Column, purpose: str) -> Column:
    """A number in the open interval (0, 1) from an MD5 hash, alike on every engine."""
    return uniform_of(seed, F.lit(purpose), row_id.cast("string"))


def uniform_of(seed: int, *parts: Column) -> Column:
    """A number in (0, 1) from the MD5 hash of the seed and texts, joined by slashes."""
    digest = F.md5(F.concat_ws("/", F.lit(str(seed)), *parts))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(_SPAN)


def uniform_number(seed: int, *parts: object) -> float:
    """What ``uniform_of`` gives for these parts as texts."""
    digest = hashlib.md5("/".join(map(str, (seed, *parts))).encode()).hexdigest()
    return (int(digest[:13], 16) + 0.5) / _SPAN


def normal(seed: int, row_id: Column, purpose: str, mean: float = 0.0, std: float = 1.0) -> Column:
    """A normal draw from two uniform ones (Box and Muller 1958)."""
    radius = F.sqrt(-2.0 * F.log(uniform(seed, row_id, purpose + "/radius")))
    angle = F.cos(2.0 * math.pi * uniform(seed, row_id, purpose + "/angle"))
    return mean + std * radius * angle


def integer(seed: int, row_id: Column, purpose: str, low: Column | int, high: Column | int) -> Column:
    """A whole number in ``low..high``, both included."""
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return (low + F.floor(uniform(seed, row_id, purpose) * (high - low + 1))).cast("long")
