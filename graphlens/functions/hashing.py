"""Order and choice by hash, in place of a random stream: the same on every run, partitioning and engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _cols(parts) -> list[Column]:
    return [p if isinstance(p, Column) else F.col(p) for p in parts]


def det_key(seed: str, *parts) -> Column:
    """sha256 of the seed and the parts, joined by bars; order by it to shuffle or sample."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *_cols(parts)), 256)


def det_number(seed: str, *parts) -> Column:
    """The first 15 hexadecimal digits of det_key as a long."""
    return F.conv(F.substring(det_key(seed, *parts), 1, 15), 16, 10).cast("long")


def det_index(n: Column, seed: str, *parts) -> Column:
    """A number from 0 to n - 1; null where n is 0."""
    return F.when(n > 0, F.pmod(det_number(seed, *parts), n))


def unit(seed: str, *parts) -> Column:
    """A number in [0, 1) with four decimal places."""
    return (det_number(seed, *parts) % 10000).cast("double") / F.lit(10000.0)
