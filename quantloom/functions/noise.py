"""Counter-based pseudo-random columns: the draw depends on the keys only, not on row order or
partitioning, so a recomputed partition gives the same values."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_HEX = 13  # 52 bits, exactly representable in a double


def uniform(*keys: str | Column, seed: int = 0, stream: int = 0) -> Column:
    """Uniform in (0, 1) from md5 over the keys."""
    parts = [F.lit(f"{seed}:{stream}")] + [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    digits = F.substring(F.md5(F.concat_ws("|", *parts)), 1, _HEX)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16 ** _HEX)


def gaussian(*keys: str | Column, seed: int = 0) -> Column:
    """Standard normal by Box-Muller from two keyed uniforms."""
    u1 = uniform(*keys, seed=seed, stream=1)
    u2 = uniform(*keys, seed=seed, stream=2)
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * math.pi * u2)


# ---------------------------------------------------------------- the same inside tasks, for many draws per row

def _finish(h: np.ndarray) -> np.ndarray:
    """32-bit finaliser (xor-shift, multiply) on 64-bit words."""
    low = np.uint64(0xFFFFFFFF)
    h = ((h ^ (h >> np.uint64(16))) * np.uint64(0x85EBCA6B)) & low
    h = ((h ^ (h >> np.uint64(13))) * np.uint64(0xC2B2AE35)) & low
    return h ^ (h >> np.uint64(16))


def key32(*keys: str | Column, seed: int = 0) -> Column:
    """32-bit key of a row for :func:`counter_uniform`, from md5."""
    parts = [F.lit(str(seed))] + [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def counter_uniform(key: int, counter: np.ndarray) -> np.ndarray:
    """Uniforms in (0, 1) that depend on the key and the counter (modulo 2^32) only."""
    inner = _finish(counter.astype(np.uint64) & np.uint64(0xFFFFFFFF))
    return (_finish(inner ^ np.uint64(key)) + 0.5) / 4294967296.0
