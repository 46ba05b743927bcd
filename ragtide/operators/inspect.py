"""What an array is."""

from __future__ import annotations

from typing import Any

from pyspark.sql import types as T

from ragtide.operators.array import Array, Record, Scalar


def fields(collection: Any) -> list[str]:
    return list(collection.fields) if isinstance(collection, Array | Record) else []


def backend(*arrays: Any) -> str:
    """Where kernels run: for all lazy arrays the same."""
    return "spark"


def type(array: Any) -> T.DataType | None:
    """Spark's type of a row, of a scalar; None for other things."""
    return array.dtype if isinstance(array, Array | Scalar) else None


def normalize_single_outer_inner_index(divisions: tuple[int, ...], index: int) -> tuple[int, int]:
    """The partition that has a row, and the row's place in it."""
    total = divisions[-1]
    row = index + total if index < 0 else index
    if not 0 <= row < total:
        raise IndexError(f"row {index} of {total}")
    for k, (a, b) in enumerate(zip(divisions, divisions[1:])):
        if a <= row < b:
            return k, row - a
    raise IndexError(index)
