"""Hash functions that any SQL engine computes alike, in 64-bit integers without overflow (for any id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Multiplicative (Fibonacci) hashing constants.
FIRST, SECOND = 2654435761, 2246822519
WORD = 2**32 - 1
MIX = 73244475


def low(v: Column) -> Column:
    """The lowest 32 bits, which are all that those of a sum or product depend on."""
    return v.bitwiseAND(F.lit(WORD))


def _times(v: Column, constant: int) -> Column:
    """The lowest 32 bits of a product with a constant below 2^32, by halves of ``v``: the whole product may not fit."""
    upper = F.shiftright(low(v), 16) * F.lit(constant)
    return low(v.bitwiseAND(F.lit(0xFFFF)) * F.lit(constant) + F.shiftleft(upper.bitwiseAND(F.lit(0xFFFF)), 16))


def spread(v: Column) -> Column:
    """32 hashed bits of an id."""
    return _times(v, FIRST)


def spread_again(v: Column) -> Column:
    """32 bits of a second hash."""
    return _times(low(v) + 1, SECOND)


def bloom_positions(v: Column, bits: int) -> Column:
    """Four bit positions of an id in a filter of ``bits`` bits (a power of two): two halves of two hashes."""
    if bits < 2 or bits & bits - 1:
        raise ValueError("the number of bits must be a power of two")
    mask = F.lit(bits - 1)
    halves = [spread(v), F.shiftright(spread(v), 16), spread_again(v), F.shiftright(spread_again(v), 16)]
    return F.array(*(h.bitwiseAND(mask).cast("int") for h in halves))


def _folded(parts: tuple[int, ...]) -> int:
    """The state of the hash after constant parts."""
    x = 0
    for part in parts:
        x = x * 31 + part & WORD
        for _ in range(2):
            x = (x ^ x >> 16) * MIX & WORD
    return x


def with_mixed(df: DataFrame, column: str, names: dict[str, tuple[int, ...]]) -> DataFrame:
    """Adds columns of 32 well-mixed bits that depend on constants and on ``column``.

    Made in steps of their own: in one expression each step would be written out twice for the next.
    """
    mix = lambda x: x.bitwiseXOR(F.shiftright(x, 16))
    df = df.withColumns({n: (F.lit(_folded(parts) * 31) + F.col(column) % F.lit(2**31)).bitwiseAND(F.lit(WORD)) for n, parts in names.items()})
    for _ in range(2):
        df = df.withColumns({n: (mix(F.col(n)) * F.lit(MIX)).bitwiseAND(F.lit(WORD)) for n in names})
    return df.withColumns({n: mix(F.col(n)) for n in names})


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(2**53))


def trailing_rank(h: Column, most: int = 32) -> Column:
    """Place of the lowest set bit, from 1; ``most`` + 1 if none is set."""
    low = h.bitwiseAND(-h)
    return F.when(h == 0, F.lit(most + 1)).otherwise(F.round(F.log2(low.cast("double"))).cast("int") + 1)
