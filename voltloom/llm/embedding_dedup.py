"""Near-duplicate vectors by sorted projection passes.

In each pass every vector gets a key of concatenated random hyperplane bits;
vectors are sorted by label and key, each is compared with a bounded window of
those before it, and pairs whose cosine reaches the threshold are united. Over
enough passes, close vectors stand near each other in some order. How far a vector's
window reaches is measured in every pass; vectors of dense places, whose
windows leave too large a chance of a miss, are compared with their whole
label in blocks.

Equal vectors are one vector from the start. What passes unite is a component;
every link lies inside one, so links are counted by comparing each component
with itself in blocks, whatever its size, and no list of pairs is made.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltloom.llm.components import connected_components
from voltloom.llm.durable import Workspace
from voltloom.llm.vectors import by_group, matrix, usable

#: Neighbours before a vector that it is compared with, bits of a key.
WINDOW, BITS = 64, 60
#: Chance that a pair at the threshold is missed by all passes, by which their number is set.
MISS = 1e-5
#: Key bits beyond an even spread for which passes are made, so that few vectors of an even spread are left to blocks.
SPARE = 2
#: Vectors of a block in the count of links.
BLOCK = 1_024
#: Vectors of a block in the comparison with a whole label.
WIDE = 8_192


def passes_for(largest: int, threshold: float, window: int = WINDOW, miss: float = MISS) -> int:
    """Passes that keep the chance of missing a pair at the threshold below ``miss``.

    Two vectors are sure to be compared when they share so many leading bits
    that no more than a window of the largest label's vectors do too. This is
    for keys that spread evenly; ``_depths`` measures how they do.
    """
    bits = max(1.0, math.log2(max(2, largest) / window) + 1 + SPARE)
    return max(4, math.ceil(math.log(miss) / math.log(1 - 0.95 * same_bit(threshold) ** bits)))


def same_bit(threshold: float) -> float:
    """Chance that a bit is the same for two vectors at the threshold."""
    return 1 - math.acos(threshold) / math.pi


def _depths(group: np.ndarray, key: np.ndarray, window: int) -> np.ndarray:
    """Leading bits that a vector must share with each sorted row, from ``window`` to ``-window``, to be in its window for sure; above ``BITS`` where no number is enough."""
    mid = slice(window, len(key) - window)
    depth = np.zeros(max(0, len(key) - 2 * window), np.int64)
    for other in (slice(0, len(key) - 2 * window), slice(2 * window, len(key))):
        x = key[mid] ^ key[other]
        x &= ~(x >> 1)  # the highest bit stays and cannot be rounded up
        depth = np.maximum(depth, np.where(group[mid] == group[other], BITS + 1 - np.frexp(x.astype(float))[1], 0))
    return depth


def _spanning(near: np.ndarray, rows: np.ndarray, columns: np.ndarray, root: np.ndarray) -> list[tuple[int, int]]:
    """Links that unite what ``near`` links (places in ``root`` of its rows and columns), and were not united in ``root`` before."""
    found = []
    for k in np.flatnonzero(near.any(axis=1)):
        roots = np.unique(root[columns[near[k]]])
        mine = root[rows[k]]
        roots = roots[roots != mine]
        if len(roots):
            found += [(int(mine), int(r)) for r in roots]
            root[np.isin(root, roots)] = mine
    return found


def _window_links(rows: pa.RecordBatch, tail: tuple[np.ndarray, np.ndarray, np.ndarray] | None, threshold: float, window: int) -> tuple[list[tuple[int, int]], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A spanning set of the links in sorted rows (group, key, id, vector), and the rows the next batch needs."""
    group, ids, vectors = rows.column(0).to_numpy(), rows.column(2).to_numpy(), matrix(rows.column(3))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    fresh = 0
    if tail is not None and tail[2].shape[1] == vectors.shape[1]:
        fresh = len(tail[0])
        group, ids, vectors = np.concatenate([tail[0], group]), np.concatenate([tail[1], ids]), np.vstack([tail[2], vectors])
    root: dict[int, int] = {}

    def find(k: int) -> int:
        while root.setdefault(k, k) != k:
            root[k] = k = root[root[k]]
        return k

    found = []
    step = 256
    for a in range(fresh, len(ids), step):
        b, low = min(len(ids), a + step), max(0, a - window)
        near = vectors[a:b] @ vectors[low:b].T >= threshold
        i, j = np.nonzero(near)
        i, j = i + a, j + low
        keep = (j < i) & (i - j <= window) & (group[i] == group[j])
        for x, y in zip(i[keep].tolist(), j[keep].tolist(), strict=True):
            if find(x) != find(y):
                root[find(x)] = find(y)
                found.append((int(ids[x]), int(ids[y])))
    return found, (group[-window:], ids[-window:], vectors[-window:])


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, seed: int = 23) -> DataFrame:
    """Link vectors of one label whose cosine reaches ``threshold``.

    Returns ``vec_id``, ``n_links`` (other vectors linked directly),
    ``component_id`` (smallest id that links lead to, itself included) and
    ``kept`` (whether that is itself), a row for each input row. Vectors that
    are null, zero or hold null or non-finite components, and those of a null
    label or null id, link with nothing and are kept; vectors of different
    lengths never link; equal vectors and repeated rows count as others, rows
    that repeat an id with another vector are vectors of their own; an empty
    table gives an empty one; other columns are not read.
    """
    spark = vectors.sparkSession
    space = Workspace(spark, "embedding-dedup")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    rows = rows.withColumn("usable", usable("vector") & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    single = rows.filter("usable").groupBy("label", "vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    # a vector's own number: ids may repeat with other vectors
    single = space.settle(single.withColumn("first", F.monotonically_increasing_id()), "single")
    # a group is what is compared: one label, one length
    single = single.withColumn("group", F.xxhash64("label", F.size("vector")))
    largest = single.groupBy("group").count().agg(F.max("count")).first()[0] or 0
    passes = passes_for(largest, threshold)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.left_shift(np.int64(1), np.arange(BITS - 1, -1, -1, dtype=np.int64))
        for batch in batches:
            lengths = batch.column(2).value_lengths().to_numpy()
            for n in np.unique(lengths):
                part = batch.filter(pa.array(lengths == n))
                x = matrix(part.column(2))
                for p in range(passes):
                    planes = np.random.default_rng([seed, p, n]).standard_normal((n, BITS))
                    keys = ((x @ planes) > 0) @ weight
                    yield pa.RecordBatch.from_arrays([pa.array(part.column(0).to_numpy() ^ np.int64(p)), pa.array(keys), part.column(1), part.column(2)], names=["group", "key", "first", "vector"])

    kind = dict(single.dtypes)["vector"]
    keyed = single.select("group", "first", "vector").mapInArrow(key, f"group long, key long, first long, vector {kind}")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(single.count() * passes / 100_000))
    ordered = keyed.repartitionByRange(ranges, "group", "key", "first").sortWithinPartitions("group", "key", "first")

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            edges = [0, *(np.flatnonzero(np.diff(batch.column(0).to_numpy())) + 1), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                if b > a:
                    found, tail = _window_links(batch.slice(a, b - a), tail, threshold, WINDOW)
                    x, y = zip(*found, strict=True) if found else ([], [])
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.nulls(len(x), pa.int16())], names=["a", "b", "depth"])
            # rows without a whole window on both sides in this task count as not compared
            held = [np.concatenate([h, batch.column(k).to_numpy()]) for k, h in enumerate(held)]
            if len(held[0]) > 2 * WINDOW:
                depth = _depths(held[0], held[1], WINDOW)
                known = depth <= BITS
                ids = held[2][WINDOW:-WINDOW][known]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.array(depth[known].astype(np.int16))], names=["a", "b", "depth"])
                held = [h[-2 * WINDOW :] for h in held]

    passed = space.settle(ordered.mapInArrow(unite, "a long, b long, depth short"), "passed")
    chance = F.lit(1.0) - F.pow(F.lit(same_bit(threshold)), F.col("depth"))
    missed = F.sum(F.log(F.greatest(chance, F.lit(1e-300))))
    sure = passed.filter("depth is not null").groupBy(F.col("a").alias("first")).agg(missed.alias("missed")).filter(F.col("missed") <= math.log(MISS))
    dense = space.settle(single.join(sure, "first", "left_anti").select("group", "first", "vector"), "dense")

    def wide(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("group").agg(F.ceil(F.count("*") / WIDE).cast("long").alias(name))

    sizes = wide(dense, "asking").join(wide(single, "asked"), "group")

    def side(df: DataFrame, mine: str, other: str, role: int) -> DataFrame:
        placed = df.join(sizes, "group").withColumn("__m", F.pmod(F.xxhash64("first"), F.col(mine))).withColumn("__o", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        return placed.select(F.xxhash64("group", *(("__m", "__o") if role else ("__o", "__m"))).alias("pair"), F.lit(role).alias("role"), "first", "vector")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []

        def each(part: pa.Table) -> None:
            asks = part.column(1).to_numpy() == 1
            ids, at = np.unique(part.column(2).to_numpy(), return_inverse=True)
            x = matrix(part.column(3).combine_chunks())
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            rows, columns, root = np.flatnonzero(asks), np.flatnonzero(~asks), np.arange(len(ids))
            for a in range(0, len(rows), 512):
                some = rows[a : a + 512]
                united = _spanning(x[some] @ x[columns].T >= threshold, at[some], at[columns], root)
                found.extend((int(ids[i]), int(ids[j])) for i, j in united)

        for _ in by_group(batches, each):
            i, j = zip(*found, strict=True) if found else ([], [])
            found.clear()
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(j, pa.int64())], names=["a", "b"])

    pairs = side(dense, "asking", "asked", 1).union(side(single.select("group", "first", "vector"), "asked", "asking", 0))
    exact = pairs.repartition("pair").sortWithinPartitions("pair").mapInArrow(compare, "a long, b long")
    links = passed.filter("b is not null").select("a", "b").union(exact)
    stars = space.settle(connected_components(links, space), "components")
    blocks = stars.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    members = stars.join(blocks, "component").join(single, stars["node"] == single["first"]).select("component", "blocks", "first", "copies", "vector")
    members = members.withColumn("mine", F.pmod(F.xxhash64("first"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    members = members.select(F.xxhash64("component", F.least("mine", "other"), F.greatest("mine", "other")).alias("pair"), "mine", "other", "first", "copies", "vector")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def each(group: pa.Table) -> None:
            mine, other, ids, copies = (group.column(k).to_numpy() for k in (1, 2, 3, 4))
            x = matrix(group.column(5).combine_chunks())
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            if mine[0] == other[0]:  # a block with itself
                near = x @ x.T >= threshold
                np.fill_diagonal(near, False)
                found.append((ids, near @ copies))
            else:  # either may be empty
                first = mine == min(mine[0], other[0])
                a, b = np.flatnonzero(first), np.flatnonzero(~first)
                near = x[a] @ x[b].T >= threshold
                found.append((ids[a], near @ copies[b]))
                found.append((ids[b], copies[a] @ near))

        for _ in by_group(batches, each):
            i, n = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            found.clear()
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(n, pa.int64())], names=["first", "links"])

    counted = members.repartition("pair").sortWithinPartitions("pair").mapInArrow(count, "first long, links long").groupBy("first").agg(F.sum("links").alias("links"))
    stars = stars.withColumnRenamed("node", "first")
    smallest = stars.join(single.select("first", "id"), "first").groupBy("component").agg(F.min("id").alias("smallest"))
    known = single.join(counted, "first", "left").join(stars.join(smallest, "component"), "first", "left")
    known = known.select(F.lit(True).alias("usable"), "label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("smallest", "id").alias("component"))
    out = rows.filter("usable").join(known, ["usable", "label", "vector"]).select("vec_id", F.col("links").cast("long").alias("n_links"), F.col("component").alias("component_id"))
    out = out.union(rows.filter("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


#: DuckDB SQL for the same rows, over the registered view ``embeddings``.
SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM usable a JOIN usable b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
counts AS (
  SELECT x, count(*) AS n FROM links GROUP BY x),
reach AS (
  SELECT vec_id AS x, vec_id AS y FROM embeddings
  UNION
  SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
smallest AS (
  SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, s.component_id, e.vec_id = s.component_id AS kept
FROM embeddings e JOIN smallest s ON s.x = e.vec_id LEFT JOIN counts c ON c.x = e.vec_id
"""
