"""Vector functions: JVM expressions, and a deterministic hash embedder."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(v: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v]).cast("array<double>")


def _d(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_d(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 for a null or empty vector, a norm of zero, or what isn't finite; unequal sizes are an error."""
    a, b = _d(a), _d(b)
    size = F.when((F.size(a) > 0) & (F.size(b) > 0) & (F.size(a) != F.size(b)), F.raise_error(F.lit("vectors of unequal size"))).otherwise(F.lit(0))
    n = norm(a) * norm(b)
    c = dot(a, b) / n
    good = a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(b) > 0) & (n > 0) & ~F.isnan(c) & (F.abs(c) <= 1.1)
    return F.when(size == 1, F.lit(0.0)).otherwise(F.coalesce(F.when(good, c), F.lit(0.0)))


def l2_normalize(a: Column | str) -> Column:
    """Scaled to length 1; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(_d(a), lambda x: x / n)).otherwise(_d(a))


def hash_embed(texts: list[str | None], dim: int) -> np.ndarray:
    """Words, upper-cased, counted at xxHash64 (seed 0) modulo dim, scaled to length 1."""
    import xxhash

    out = np.zeros((len(texts), dim), dtype=np.float32)
    for i, t in enumerate(texts):
        for w in (t or "").split():
            out[i, xxhash.xxh64_intdigest(w.upper().encode(), seed=0) % dim] += 1
    n = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(n > 0, n, 1)


def hash_embedder(dim: int = 1024):  # noqa: ANN201
    """A column function: text to array<float>."""

    @F.pandas_udf("array<float>")
    def embed(s: pd.Series) -> pd.Series:
        return pd.Series(list(hash_embed(s.tolist(), dim)))

    return embed


def fill_vectors(df, text: str, vector: str, dim: int = 1024):  # noqa: ANN001, ANN201
    """Rows without a vector get one of their text on one line; others keep theirs."""
    from tempograph.functions.text import one_line

    have, lack = df.where(F.col(vector).isNotNull()), df.where(F.col(vector).isNull())
    return have.unionByName(lack.withColumn(vector, hash_embedder(dim)(one_line(text))))
