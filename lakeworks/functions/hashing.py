"""Row fingerprints and seeded draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeworks.functions.columns import as_column

# 2^53: the number of steps of a double in [0, 1).
_STEPS = 1 << 53


def row_hash(columns: Sequence[str]) -> Column:
    """64-bit fingerprint of a row.

    ``xxhash64`` passes over nulls, so ``(null, 'a')`` and ``('a', null)`` would agree;
    the null flags are hashed as well to keep them apart.
    """
    cols = [F.col(c) for c in columns]
    return F.xxhash64(*cols, *[c.isNull() for c in cols])


def uniform(seed: Column | str, salt: str) -> Column:
    """Draw in [0, 1) that depends only on the seed column and the salt.

    It does not depend on partitioning, so a task that runs again gives the same rows.
    """
    return F.pmod(F.xxhash64(as_column(seed), F.lit(salt)), F.lit(_STEPS)) / F.lit(float(_STEPS))


def uniform_int(seed: Column | str, salt: str, low: int, high: int) -> Column:
    """Whole number drawn evenly from ``low`` to ``high``, both included."""
    return F.lit(low) + F.pmod(F.xxhash64(as_column(seed), F.lit(salt)), F.lit(high - low + 1))


def pick(seed: Column | str, salt: str, values: Sequence[str]) -> Column:
    """One of the values, all equally likely."""
    return F.element_at(
        F.array(*[F.lit(v) for v in values]), uniform_int(seed, salt, 1, len(values)).cast("int")
    )


def pick_weighted(seed: Column | str, salt: str, weights: dict[str, float]) -> Column:
    """One of the values, with the given probabilities."""
    draw = uniform(seed, salt)
    *head, last = weights
    out, bound = None, 0.0
    for value in head:
        bound += weights[value]
        out = (F.when if out is None else out.when)(draw < F.lit(bound), F.lit(value))
    return F.lit(last) if out is None else out.otherwise(F.lit(last))
