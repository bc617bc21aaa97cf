"""What the vector operators share: which vectors count, and rows in groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Whether a vector is not null or zero and holds finite numbers alone."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column of one length, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


def by_group(batches: Iterator[pa.RecordBatch], each: Callable[[pa.Table], None]) -> Iterator[None]:
    """Call ``each`` with the rows of each value of the first column, which is sorted; yields after every batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        for a, b in zip(edges, edges[1:], strict=False):
            if held and held[-1].column(0)[0].as_py() != keys[a]:
                each(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(a, b - a))
        yield
    if held:
        each(pa.Table.from_batches(held))
    yield
