"""Pooling of frozen features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def masked_mean(vectors: Column, mask: Column) -> Column:
    """Mean of the vectors whose mask is 1; zeros where none is."""
    kept = F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"] == 1)
    total = F.aggregate(
        kept, F.transform(F.get(vectors, F.lit(0)), lambda _: F.lit(0.0)), lambda s, x: F.zip_with(s, x["v"], lambda a, b: a + b.cast("double"))
    )
    return F.transform(total, lambda x: x / F.greatest(F.size(kept), F.lit(1)))
