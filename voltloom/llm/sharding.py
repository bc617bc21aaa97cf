"""Uniform sharding through a hypergeometric communication matrix.

The input's partitions and the output's cells (equal slices of the shards)
span a matrix of row counts: how many rows partition ``p`` sends to cell
``c``. Drawing that matrix from the multivariate hypergeometric law, permuting
each partition, sending its rows in runs of those lengths, and permuting each
cell gives a uniform permutation of all rows in which every shard has exactly
its size. The matrix is never held whole: halves of the partitions are split
from each other by seeded draws, and a task walks down to its own row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voltloom.llm.durable import Workspace

#: Rows of one cell at most; a cell is permuted in one task.
ROWS_PER_CELL = 131_072
_ROW_BITS = 33


def split_counts(rng: np.random.Generator, sizes: np.ndarray, take: int) -> np.ndarray:
    """How many of ``take`` rows fall in each cell of the given sizes, drawn without replacement."""
    return rng.multivariate_hypergeometric(sizes, take, method="marginals") if take else np.zeros_like(sizes)


def matrix_row(counts: np.ndarray, cells: np.ndarray, wanted: int, seed: int) -> np.ndarray:
    """Row ``wanted`` of the communication matrix with row sums ``counts`` and column sums ``cells``.

    The partitions are halved again and again; each split is drawn from a
    generator seeded by its range alone, so all tasks see the same matrix.
    """
    starts = np.concatenate([[0], np.cumsum(counts)])
    low, high, have = 0, len(counts), np.asarray(cells, dtype=np.int64)
    while high - low > 1:
        mid = (low + high) // 2
        first = split_counts(np.random.default_rng([seed, low, high]), have, int(starts[mid] - starts[low]))
        low, high, have = (low, mid, first) if wanted < mid else (mid, high, have - first)
    return have


def cell_sizes(rows: int, shards: int, rows_per_cell: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shard, first slot and size of each cell; shard sizes differ by one at most."""
    shard, start, size = [], [], []
    for s in range(shards):
        n = rows // shards + (s < rows % shards)
        parts = max(1, -(-n // rows_per_cell))
        edges = [n * k // parts for k in range(parts + 1)]
        shard += [s] * parts
        start += edges[:-1]
        size += [b - a for a, b in zip(edges, edges[1:], strict=False)]
    return np.array(shard, np.int32), np.array(start, np.int64), np.array(size, np.int64)


def shuffle_into_shards(rows: DataFrame, n_shards: int, *, seed: int = 11, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """Deal all rows of ``rows`` uniformly into ``n_shards`` shards of equal size.

    Returns the input's columns with ``shard`` (int, from 0) and ``slot``
    (long, gapless from 0 in each shard); input columns of those two names are
    replaced. Shard sizes differ by one at most. A row is dealt by its place in
    its partition, not by what it holds, so nulls, ties and repeated rows are
    dealt like any other; with fewer rows than shards some shards stay empty,
    and an empty table gives an empty one. Reruns agree as long as partitions
    hold the same rows in the same order, as those of a table do. The driver
    holds one count per input partition.
    """
    spark = rows.sparkSession
    space = Workspace(spark, "sharding")
    rows = rows.drop("shard", "slot")
    names = rows.columns
    # local permutation: a seeded hash of partition and place orders each partition, equal rows apart from each other
    mixed = rows.withColumn("__order", F.xxhash64(F.lit(seed), F.monotonically_increasing_id()))
    dealt = space.settle(mixed.sortWithinPartitions("__order").drop("__order").withColumn("__at", F.monotonically_increasing_id()), "permuted")
    found = {r["p"]: r["n"] for r in dealt.groupBy(F.shiftright("__at", _ROW_BITS).alias("p")).agg(F.count("*").alias("n")).collect()}
    counts = np.array([found.get(p, 0) for p in range(max(found, default=-1) + 1)], dtype=np.int64)
    shard_of, start_of, cells = cell_sizes(int(counts.sum()), n_shards, rows_per_cell)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ends = -1, np.zeros(0, np.int64)
        for batch in batches:
            where = batch.column(batch.num_columns - 1).to_numpy()
            part, index = where >> _ROW_BITS, where & ((1 << _ROW_BITS) - 1)
            cell = np.empty(len(where), np.int32)
            for p in np.unique(part):
                if p != at:
                    at, ends = p, np.cumsum(matrix_row(counts, cells, int(p), seed))
                mine = part == p
                cell[mine] = np.searchsorted(ends, index[mine], side="right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(shard_of[cell]), pa.array(start_of[cell])], names=[*batch.schema.names, "__cell", "shard", "__start"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    sent = dealt.mapInArrow(deal, f"{schema}, __cell int, shard int, __start long")
    inside = W.partitionBy("__cell").orderBy(F.xxhash64(F.lit(seed + 1), F.col("__at")), F.col("__at"))
    return sent.withColumn("slot", F.col("__start") + F.row_number().over(inside) - 1).select(*[f"`{c}`" for c in names], "shard", "slot")
