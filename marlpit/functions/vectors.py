"""Vector functions as column expressions, in double precision."""

from __future__ import annotations

from hashlib import blake2b

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: buckets of the hash embedding.
HASH_WIDTH = 32


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product; vectors of different lengths raise an error."""
    same = F.size(a) == F.size(b)
    return F.when(same, _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))).otherwise(F.raise_error("vectors of different lengths").cast("double"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 for empty vectors, different lengths or a zero norm."""
    product = _sum(F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0)).cast("double") * F.coalesce(y, F.lit(0)).cast("double")))
    norms = F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double")))) * F.sqrt(_sum(F.transform(b, lambda x: x.cast("double") * x.cast("double"))))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), product / norms).otherwise(0.0)


def squared_distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def hash_embedding(text: pd.Series) -> pd.Series:
    """Counts of lower-cased words by BLAKE2b of 4 bytes modulo 32, scaled to length 1: a stand-in embedding without a model. Null texts have no words."""

    def one(t: str | None) -> list[float]:
        counts = [0.0] * HASH_WIDTH
        for word in (t or "").lower().split():
            counts[int.from_bytes(blake2b(word.encode(), digest_size=4).digest(), "big") % HASH_WIDTH] += 1.0
        norm = sum(x * x for x in counts) ** 0.5
        return [x / norm for x in counts] if norm else counts

    return text.map(one)
