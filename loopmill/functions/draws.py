"""Seeded uniform draws: the n-th draw is a function of (seed, n), so walkers need no running state."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF
#: Fixed values of the generator: what its state gains a draw, and two multiplicative mixers' terms.
STATE_STEP, FIRST_OR, SECOND_OR = 0x6D2B79F5, 1, 61


def multiply32(a: Column, b: Column) -> Column:
    """Low 32 bits of a product of two 32-bit values, without leaving 64 bits."""
    high = F.shiftright(a, 16).bitwiseAND(F.lit(0xFFFF)) * b
    low = a.bitwiseAND(F.lit(0xFFFF)) * b
    return (F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16) + low).bitwiseAND(F.lit(MASK))


def shift(x: Column, n: int) -> Column:
    return F.shiftright(x, n)


def uniform(seed: Column, n: Column) -> Column:
    """Draw n (from 1) in [0, 1)."""
    state = (seed.cast("long") + n.cast("long") * STATE_STEP).bitwiseAND(F.lit(MASK))
    t = multiply32(state.bitwiseXOR(shift(state, 15)), state.bitwiseOR(F.lit(FIRST_OR)))
    mixed = (t + multiply32(t.bitwiseXOR(shift(t, 7)), t.bitwiseOR(F.lit(SECOND_OR)))).bitwiseAND(F.lit(MASK))
    t = t.bitwiseXOR(mixed)
    return t.bitwiseXOR(shift(t, 14)).bitwiseAND(F.lit(MASK)) / 4294967296.0
