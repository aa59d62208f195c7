"""Seeded draws from md5, equal under every partitioning and in other SQL engines."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 60


def _text(part: Column | str | int | float) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))


def hash60(*parts: Column | str | int) -> Column:
    """Unsigned 60-bit number from the parts joined by ``|``; strings are literals."""
    digest = F.md5(F.concat_ws("|", *[_text(p) for p in parts]))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def unit_hash(*parts: Column | str | int) -> Column:
    """Uniform number in [0, 1)."""
    return hash60(*parts).cast("double") / F.lit(float(2**HASH_BITS))


def index_draw(size: int | Column, *parts: Column | str | int) -> Column:
    """Uniform index in ``0 .. size-1``."""
    return hash60(*parts) % (size if isinstance(size, Column) else F.lit(int(size)))


# Fixed value: rounds of the permutation; each of them swaps every number with its partner or not.
SHUFFLE_ROUNDS = 16


def shuffled_index(index: Column, size: int, seed: int | str) -> Column:
    """Place of ``index`` under a keyed permutation of ``0 .. size - 1`` (swap-or-not shuffle, Hoang et al. 2012).

    In each round a number's partner is ``key - number`` modulo the size, and one hashed bit of the larger of the two
    says whether they change places; so every round is a permutation, for any size.
    """
    return _swapped_index(index, size, seed, range(SHUFFLE_ROUNDS))


def unshuffled_index(place: Column, size: int, seed: int | str) -> Column:
    """The index that :func:`shuffled_index` puts at ``place``: every round is its own inverse."""
    return _swapped_index(place, size, seed, reversed(range(SHUFFLE_ROUNDS)))


def _swapped_index(index: Column, size: int, seed: int | str, order: Iterable[int]) -> Column:
    keys = [int(hashlib.md5(f"{seed}|key|{r}".encode()).hexdigest()[:15], 16) % size for r in range(SHUFFLE_ROUNDS)]
    rounds = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(keys[r]).cast("bigint").alias("key")) for r in order])

    def swap(x: Column, step: Column) -> Column:
        partner = F.pmod(step["key"] - x, F.lit(size).cast("bigint"))
        return F.when(hash60(str(seed), step["r"], F.greatest(x, partner)) % 2 == 1, partner).otherwise(x)

    return F.aggregate(rounds, index.cast("bigint"), swap)
