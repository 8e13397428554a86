"""Hook for an embedding model: texts in, unit vectors out. No model comes with the library."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType


def embedder(load: Callable[[], Callable[[Sequence[str]], np.ndarray]], prefix: str = ""):
    """pandas UDF text -> vector. ``load`` is called once per task and gives the model; vectors are brought to unit length."""

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            vectors = np.asarray(model([prefix + (t or "") for t in texts]), np.float32).reshape(len(texts), -1)
            length = np.linalg.norm(vectors, axis=1, keepdims=True)
            yield pd.Series(list(vectors / np.where(length > 0, length, 1)))

    return embed


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors, summed in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
