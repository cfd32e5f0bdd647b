"""What the two vector operators share: which vectors count, and packing rows for block work."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Not null, not empty, no null and no non-finite component."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ok, F.lit(False))


def class_key(vector: Column) -> Column:
    """128 bits of hash as a string: equal for equal vectors."""
    return F.concat(F.hex(F.xxhash64(F.lit(1), vector)), F.lit("-"), F.hex(F.xxhash64(F.lit(2), vector)))
