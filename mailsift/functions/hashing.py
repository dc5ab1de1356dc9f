"""Stable pseudo-random values from keys: the same on every run, engine and partitioning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def bucket(seed: str, *keys: Column | str, size: int) -> Column:
    """Integer in ``[0, size)`` from an md5 of seed and keys."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    text = F.concat_ws(":", F.lit(seed), *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % F.lit(size)


def unit(seed: str, *keys: Column | str) -> Column:
    """Fraction in ``[0, 1)`` in steps of one millionth."""
    return bucket(seed, *keys, size=1_000_000) / F.lit(1_000_000.0)
