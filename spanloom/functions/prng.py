"""A 32-bit counter generator as columns and arrays: draw n of a seed depends on nothing but n."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the generator (mulberry32).
STEP, M1, M2, FULL = 0x6D2B79F5, 1, 61, 4294967295


def _imul(x: Column, y: Column) -> Column:
    """x * y mod 2^32 by halves of y, so that no product passes 2^63 under ANSI rules."""
    low, high = y.bitwiseAND(F.lit(65535)), F.shiftright(y, 16)
    return (x * low + F.shiftleft((x * high).bitwiseAND(F.lit(65535)), 16)).bitwiseAND(F.lit(FULL))


def draw(seed: int, n: Column) -> Column:
    """A double in [0, 1) for each counter n >= 1; counters 2^32 apart draw the same."""
    a = (F.lit(seed).cast("long") + n.cast("long").bitwiseAND(F.lit(FULL)) * F.lit(STEP)).bitwiseAND(F.lit(FULL))
    t = _imul(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(F.lit(M1)))
    t = (t + _imul(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(M2)))).bitwiseAND(F.lit(FULL)).bitwiseXOR(t)
    return t.bitwiseXOR(F.shiftright(t, 14)) / F.lit(4294967296.0)


def stream(seed: int, first: int, count: int) -> np.ndarray:
    """Draws ``first`` to ``first + count - 1`` of the seed in an array, equal to those of draw()."""
    a = np.uint64(seed) + np.arange(first, first + count, dtype=np.uint64) * np.uint64(STEP) & np.uint64(FULL)
    t = (a ^ a >> np.uint64(15)) * (a | np.uint64(M1)) & np.uint64(FULL)
    t = t + (t ^ t >> np.uint64(7)) * (t | np.uint64(M2)) & np.uint64(FULL) ^ t
    t &= np.uint64(FULL)
    return (t ^ t >> np.uint64(14)) / 4294967296.0
