"""What the driver knows of a collection: shapes, dtype and index. The data itself is a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass
from math import prod

import numpy as np

#: The Spark element type that holds each numpy dtype.
SPARK_TYPES = {
    "bool": "boolean", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint",
    "uint8": "smallint", "uint16": "int", "uint32": "bigint", "float16": "float", "float32": "float", "float64": "double",
}


def spark_type(dtype) -> str:
    name = np.dtype(dtype).name
    if name not in SPARK_TYPES:
        raise ValueError(f"no Spark type holds {name}")
    return SPARK_TYPES[name]


@dataclass(frozen=True)
class Meta:
    """`base` is the shape of the record keys, `value` that of one record."""

    base: tuple[int, ...]
    value: tuple[int, ...]
    dtype: np.dtype
    index: tuple | None = None
    labelled: bool = False

    @property
    def shape(self) -> tuple[int, ...]:
        return self.base + self.value

    @property
    def size(self) -> int:
        return prod(self.value)
