"""Vectors as the operators on embeddings take them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VECTOR = pa.schema([("vec_id", pa.int64()), ("dim", pa.int32()), ("vec", pa.binary())])
VECTOR_DDL = "vec_id long, dim int, vec binary"


def _read(keep: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, data = [], [], []
            for i, row in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = row.values
                x = values.to_numpy(zero_copy_only=False) if values is not None and len(values) and not values.null_count else np.zeros(1)
                usable = bool(np.isfinite(x).all() and x.any())
                if usable or keep:
                    ids.append(i)
                    dims.append(len(x) if usable else None)
                    data.append(x.tobytes() if usable else None)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(data, pa.binary())], schema=VECTOR)

    return run


def read(rows: DataFrame, keep: bool = False) -> tuple[DataFrame, np.dtype]:
    """``(vec_id, dim, vec)`` of the rows ``(vec_id, embedding)`` and the vectors' type.

    Usable is what is not null, empty or zero and holds finite numbers only; with
    ``keep`` the other rows stay, without a vector.
    """
    kind = np.dtype("<f4" if rows.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8")
    element = "float" if kind.itemsize == 4 else "double"
    return rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast(f"array<{element}>")).mapInArrow(_read(keep), VECTOR_DDL), kind


def matrix(column: pa.ChunkedArray | pa.Array, kind: np.dtype) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1).astype(np.float64)
