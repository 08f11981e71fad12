"""Sampling without replacement by a keyed permutation, as Column expressions.

The permutation is the swap-or-not shuffle: each round pairs place ``x`` with ``pivot - x`` (modulo the size) and
a keyed bit of the pair decides whether the two change places. It works on 0..size-1 for any size and one place at
a time, so a draw of ``n`` of ``m`` rows costs ``n`` evaluations, whatever ``m`` is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Enough for the first few places of sizes in the hundred thousands to look uniform.
ROUNDS = 48
#: Modulus of the keyed bit; sizes must stay below it.
PRIME = (1 << 31) - 1


def round_keys(key: Column, rounds: int = ROUNDS) -> Column:
    """Pivot, factor and offset of every round: three runs of seven hex digits of the MD5 of key and round."""

    def number(digest: Column, at: int) -> Column:
        return F.conv(F.substring(digest, at, 7), 16, 10).cast("long")

    digests = F.transform(F.sequence(F.lit(1), F.lit(rounds)), lambda i: F.md5(F.concat_ws("|", key, i.cast("string"))))
    return F.transform(digests, lambda h: F.struct(number(h, 1).alias("pivot"), number(h, 9).alias("factor"), number(h, 17).alias("offset")))


def permuted(places: Column, size: Column, keys: Column) -> Column:
    """Where the permutation of 0..size-1 sends each of an array of places; those of one key are a bijection."""
    size = size.cast("long")

    def turn(xs: Column, k: Column) -> Column:
        def one(x: Column) -> Column:
            other = F.pmod(k["pivot"] - x, size)
            return F.when((k["factor"] * F.greatest(x, other) + k["offset"]) % PRIME % 2 == 1, other).otherwise(x)

        return F.transform(xs, one)

    # The keys are folded once for all places, so they are made once a draw.
    return F.aggregate(keys, places.cast("array<long>"), turn)
