"""Dense vectors: array<double> columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """The length; 0 counts as 1, so that dividing by it is safe."""
    n = F.sqrt(dot(a, a))
    return F.when(n == 0, F.lit(1.0)).otherwise(n)


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    return dot(a, b) / ((norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b))


def normalize(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: x / n)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def matrix(column: pa.ChunkedArray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, and which of them are none: null, with a null component, or not of d numbers (zeros here)."""
    lists = pa.chunked_array(column.chunks, column.type).combine_chunks()
    whole = pc.fill_null(pc.equal(pc.list_value_length(lists), d), False)
    flat = pc.list_flatten(lists.filter(whole))
    rows, at = np.zeros((len(lists), d)), whole.to_numpy(zero_copy_only=False)
    rows[at] = flat.to_numpy(zero_copy_only=False).reshape(-1, d)
    none = ~at
    if flat.null_count:
        none[at] = flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, d).any(1)
        rows[none] = 0
    return rows, none
