"""Shared helpers of the operators on embeddings: usable rows, whole numbers of any size, matrices of Arrow lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a task turns into numbers at once; products of two 20-bit numbers summed over so many stay below 2**53.
ROWS = 4096
#: Bits of a limb in which tasks send whole numbers of any size: sums of limbs over 2**33 tasks fit a long.
LIMB = 30
#: Whole numbers of components are clipped to this size, so that each fits a long beside any offset.
CLIP = 2.0**62


def usable(df: DataFrame, vec_id: str, vector: str, **more: str) -> tuple[DataFrame, int]:
    """Rows i (id), v (array of doubles) and the columns of more (new name: old), and the number of components.

    A row goes if its vector is null or empty, if a component is null, NaN or infinite, or if its length is not the one that most rows
    have (of equally frequent lengths the greatest). Rows with a null id or a repeated one stay. Columns are taken by name once and renamed, so further ones may have any names.
    """
    v = F.col(f"`{vector}`").cast("array<double>").alias("v")
    rows = df.select(F.col(f"`{vec_id}`").alias("i"), v, *[F.col(f"`{old}`").alias(new) for new, old in more.items()])
    rows = rows.where("size(v) > 0 and forall(v, x -> x is not null and abs(x) < double('Infinity'))")
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    width = common[0].d if common else 0
    return rows.where(F.size("v") == width), width


def matrix(col: pa.Array, width: int) -> np.ndarray:
    """The rows of a list column whose lists all have `width` doubles."""
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def floors(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale x) as longs, clipped to CLIP."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values * scale), -CLIP, CLIP).astype(np.int64)


def limbs(values: np.ndarray, most: int) -> list[np.ndarray]:
    """Whole numbers (Python's, in an object array) as `most` limbs, the lowest first; all but the last are not negative."""
    out = []
    for _ in range(most - 1):
        out.append((values & ((1 << LIMB) - 1)).astype(np.int64))
        values = values >> LIMB
    return [*out, values.astype(np.int64)]


def unlimbed(parts: list[np.ndarray]) -> np.ndarray:
    """The inverse of limbs, also of sums of limbs."""
    return sum(p.astype(object) << (LIMB * k) for k, p in enumerate(parts))


def limb_fields(most: int) -> list[T.StructField]:
    return [T.StructField(f"l{k}", T.LongType()) for k in range(most)]
