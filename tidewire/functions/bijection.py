"""Keyed bijections of 0 ... n - 1, worked out from a row alone.

A number below n is a pair of digits below a and b, where a b is the least such
product with a the root of n rounded up.  Feistel rounds add to one digit a mixed
value of the other, in turn, so that a key decides on a bijection of a b numbers; what
falls on n or beyond walks on until it is below n, which keeps it a bijection.  Fewer
than a numbers are n or beyond, so a walk of ``STEPS`` is all there can be up to n of
256, and of larger n one in more than 16**16 would be longer; that raises.

Nothing is sorted, dealt or joined.  Each intermediate value is a lambda's variable, as
an expression that is named twice would be worked out twice, round after round.
Values stay below 2**62, as products in a long must.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS, STEPS = 6, 16
#: A multiplier that spreads bits, and 31 bits.
FACTOR, MASK = 73_244_475, (1 << 31) - 1
#: Keys of successive rounds lie so far apart before they are mixed.
APART = 40_503


def mixed(h: Column) -> Column:
    """31 bits that hang on all of 31 bits."""
    for _ in range(2):
        h = (h.bitwiseXOR(F.shiftright(h, 16)) * FACTOR).bitwiseAND(F.lit(MASK))
    return h


def mixed_number(h: int | np.ndarray) -> int | np.ndarray:
    for _ in range(2):
        h = ((h ^ h >> 16) * FACTOR) & MASK
    return h


def named(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def key_of(seed: int, *parts: Column) -> Column:
    """A key of 31 bits that follows from the seed and numbers."""
    start = F.lit(mixed_number(seed & MASK)).cast("long")
    return F.aggregate(F.array(*(p.cast("long") for p in parts)), start, lambda k, p: named((k + p + 1).bitwiseAND(F.lit(MASK)), mixed))


def _sides(n: int | Column) -> tuple[Column, Column, Column]:
    """n, a, b."""
    if isinstance(n, int):
        a = math.isqrt(max(n - 1, 0)) + 1
        return F.lit(n).cast("long"), F.lit(a).cast("long"), F.lit(max(1, -(-n // a))).cast("long")
    a = F.greatest(F.ceil(F.sqrt(n)).cast("long"), F.lit(1))
    return n.cast("long"), a, F.greatest(F.ceil(n / a).cast("long"), F.lit(1))


def bijection(i: Column, n: int | Column, key: Column) -> Column:
    """The place below n of each i below n."""
    rounds = F.array(*(F.lit(r).cast("long") for r in range(1, ROUNDS + 1)))

    def of(s: Column) -> Column:
        x, size, a, b, keys = (s[c] for c in ("x", "n", "a", "b", "keys"))

        def turn(x: Column, e: Column) -> Column:
            high, low = F.call_function("div", x, b), x % b
            return F.when(e["odd"], (high + mixed(e["k"].bitwiseXOR(low))) % a * b + low).otherwise(x - low + (low + mixed(e["k"].bitwiseXOR(high))) % b)

        def walk(x: Column) -> Column:
            return F.aggregate(keys, x, turn)

        out = F.aggregate(F.sequence(F.lit(2), F.lit(STEPS)), walk(x), lambda y, _: F.when(y < size, y).otherwise(walk(y)))
        return named(out, lambda y: F.when(y < size, y).otherwise(F.raise_error(F.lit("a walk didn't end")).cast("long")))

    size, a, b = _sides(n)
    keys = named(key, lambda k: F.transform(rounds, lambda r: F.struct((r % 2 == 1).alias("odd"), mixed((k + r * APART).bitwiseAND(F.lit(MASK))).alias("k"))))
    return named(F.struct(i.cast("long").alias("x"), size.alias("n"), a.alias("a"), b.alias("b"), keys.alias("keys")), of)


def with_bijection(df: DataFrame, out: str, i: Column, n: int | Column, key: Column) -> DataFrame:
    """``df`` with the place below n of each i below n."""
    return df.withColumn(out, bijection(i, n, key))


def places(i: np.ndarray, n: int, key: np.ndarray | int) -> np.ndarray:
    """The same bijection in numpy, for tasks that hold arrays anyway; a key for all, or one for each i."""
    a = math.isqrt(max(n - 1, 0)) + 1
    b = max(1, -(-n // a))
    i, key = np.broadcast_arrays(np.asarray(i, dtype=np.int64), np.asarray(key, dtype=np.int64))
    keys = [mixed_number((key.ravel() + r * APART) & MASK) for r in range(1, ROUNDS + 1)]

    def walk(x: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
        for r, e in enumerate(keys, 1):
            high, low = x // b, x % b
            x = (high + mixed_number(e[at] ^ low)) % a * b + low if r % 2 else high * b + (low + mixed_number(e[at] ^ high)) % b
        return x

    x = walk(i.ravel(), slice(None))
    while len(at := np.flatnonzero(x >= n)):
        x[at] = walk(x[at], at)
    return x.reshape(i.shape)


#: Numbers whose digits a round holds together, so that they stay in a processor's cache.
CACHED = 1 << 14


def places_by_key(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """``places`` of many i with one key: what a round adds hangs on one digit alone, so it is looked up in a table."""
    a = math.isqrt(max(n - 1, 0)) + 1
    b = max(1, -(-n // a))
    i = np.asarray(i, dtype=np.int64)
    if len(i) < a:
        return places(i, n, key)
    digits = np.arange(max(a, b), dtype=np.int64)
    # a digit less its size is below 0, which without a sign is a large number
    adds = [mixed_number(int(mixed_number((int(key) + r * APART) & MASK)) ^ digits) % (a if r % 2 else b) - (a if r % 2 else b) for r in range(1, ROUNDS + 1)]
    highs, lows = np.divmod(i, b)
    out = np.empty(len(i), dtype=np.int64)

    def turned(digit: np.ndarray, add: np.ndarray, size: int) -> np.ndarray:
        under = add + digit
        return np.minimum(under.view(np.uint64), (under + size).view(np.uint64)).view(np.int64)

    for begin in range(0, len(i), CACHED):
        high, low = highs[begin : begin + CACHED], lows[begin : begin + CACHED]
        at = np.arange(begin, begin + len(high))
        while len(at):
            for r, add in enumerate(adds, 1):
                if r % 2:
                    high = turned(high, add.take(low, mode="clip"), a)
                else:
                    low = turned(low, add.take(high, mode="clip"), b)
            x = high * b + low
            out[at] = x
            on = np.flatnonzero(x >= n)
            at, high, low = at[on], high[on], low[on]
    return out


def key_number(seed: int, *parts: np.ndarray | int) -> np.ndarray | int:
    """``key_of`` in numpy."""
    key = mixed_number(seed & MASK)
    for p in parts:
        key = mixed_number((key + p + 1) & MASK)
    return key
