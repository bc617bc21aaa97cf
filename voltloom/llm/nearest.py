"""Approximate nearest neighbours by inner product with a projection forest.

Trees of random hyperplanes are fitted on a bounded sample of the vectors,
extended by one component that turns the largest inner product into the
nearest point; every row is put into one leaf of each tree. A query walks all
trees through one priority queue, nearest half-spaces first, until the leaves
it has opened hold a share of the sample, and the rows of those leaves are
ranked by the exact measure.

The share is measured, not given: probes from the sample are searched exactly,
and the share is the one at which the queue has met the wanted part of their
true neighbours. Vectors with structure need a small one; for vectors without
any, no forest does with little.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voltloom.llm.durable import Workspace
from voltloom.llm.shingles import mix
from voltloom.llm.vectors import by_group, matrix, usable

#: Trees, and rows of a leaf (about).
TREES, LEAF = 8, 256
#: Part of the true neighbours that the search is set to find, and probes of the sample by which it is set.
RECALL, PROBES = 0.96, 192
#: Rows and queries that meet in one group at most (about); larger leaves are compared in blocks.
BLOCK = 8_192
#: Rows the forest is fitted on at most (the documented bound of the sample).
MAX_SAMPLE = 16_384
#: Found rows a task holds before it drops what is no longer among the best.
HELD = 1_000_000


@dataclass
class Forest:
    """Directions by tree and level, thresholds by tree, level and node, and the sample's rows by leaf."""

    depth: int
    directions: np.ndarray
    thresholds: list[list[np.ndarray]]
    leaves: list[list[np.ndarray]]
    sample: int
    longest: float

    def extended(self, x: np.ndarray) -> np.ndarray:
        """Rows with the component that gives all of them the same length."""
        rest = np.sqrt(np.maximum(0.0, self.longest - (x * x).sum(1)))
        return np.hstack([x, rest[:, None]])

    def place(self, x: np.ndarray, tree: int) -> np.ndarray:
        """The leaf of each (extended) row in a tree."""
        side = x @ self.directions[tree].T
        node = np.zeros(len(x), np.int64)
        for level in range(self.depth):
            node = 2 * node + (side[:, level] > self.thresholds[tree][level][node])
        return node

    def walk(self, query: np.ndarray) -> Iterator[tuple[int, int]]:
        """Leaves (tree, node) in the order of a queue that all trees share: the least squared margins on the way first."""
        side = self.directions @ np.append(query, 0.0)
        queue = [(0.0, tree, 0, 0) for tree in range(len(self.thresholds))]
        while queue:
            far, tree, level, node = heapq.heappop(queue)
            if level == self.depth:
                yield tree, node
                continue
            margin = side[tree, level] - self.thresholds[tree][level][node]
            near = int(margin > 0)
            heapq.heappush(queue, (far, tree, level + 1, 2 * node + near))
            heapq.heappush(queue, (far + margin * margin, tree, level + 1, 2 * node + 1 - near))

    def open(self, query: np.ndarray, share: float) -> list[tuple[int, int]]:
        """Leaves to search for a query: those walked until they hold ``share`` of the sample."""
        seen, wanted, count = np.zeros(self.sample, bool), share * self.sample, 0
        found = []
        for tree, node in self.walk(query):
            found.append((tree, node))
            rows = self.leaves[tree][node]
            count += len(rows) - int(seen[rows].sum())
            seen[rows] = True
            if count >= wanted:
                break
        return found

    def share_for(self, sample: np.ndarray, k: int, recall: float, probes: int = PROBES) -> float:
        """The share of the sample that leaves must hold for ``recall`` of the probes' k nearest to be in them."""
        met = []
        for at in range(min(probes, len(sample))):
            score = sample @ sample[at]
            score[at] = -np.inf
            best = np.argsort(-score, kind="stable")[: min(k, len(sample) - 1)]
            when, count, seen = np.full(self.sample, np.nan), 0, np.zeros(self.sample, bool)
            for tree, node in self.walk(sample[at]):
                rows = self.leaves[tree][node]
                fresh = rows[~seen[rows]]
                seen[fresh] = True
                count += len(fresh)
                when[fresh] = count / self.sample
                if seen[best].all():
                    break
            met.append(when[best])
        found = np.sort(np.concatenate(met)) if met else np.ones(1)
        return float(found[min(len(found) - 1, math.ceil(recall * len(found)))]) if len(found) else 1.0


def fit_forest(sample: np.ndarray, rows: int, longest: float, *, trees: int = TREES, leaf: int = LEAF, seed: int = 3) -> Forest:
    """Fit the trees on the sample; their depth follows the number of rows, as far as the sample has any to split."""
    depth = max(0, min(round(math.log2(max(1, rows) / leaf)), int(math.log2(max(1, len(sample)) / 8)) if len(sample) > 8 else 0))
    width = sample.shape[1] + 1
    directions = np.random.default_rng(seed).standard_normal((trees, max(1, depth), width))
    forest = Forest(depth, directions, [], [], len(sample), longest)
    x = forest.extended(sample)
    for tree in range(trees):
        side, node, levels = x @ directions[tree].T, np.zeros(len(x), np.int64), []
        for level in range(depth):
            order = np.lexsort((side[:, level], node))
            count = np.bincount(node, minlength=1 << level)
            start = np.cumsum(count) - count
            middle = np.minimum(start + count // 2, len(x) - 1)
            levels.append(np.where(count > 0, side[order[middle], level], 0.0))
            node = 2 * node + (side[:, level] > levels[-1][node])
        forest.thresholds.append(levels)
        order = np.argsort(node, kind="stable")
        forest.leaves.append(np.split(order, np.cumsum(np.bincount(node, minlength=1 << depth))[:-1]))
    return forest


def spread(ids: np.ndarray, parts: int) -> np.ndarray:
    """Ids dealt evenly into ``parts``."""
    return (mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(parts)).astype(np.int64)


def best_of(query: np.ndarray, row: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best distinct rows of each query, ties to the smaller row."""
    order = np.lexsort((row, -score, query))
    query, row, score = query[order], row[order], score[order]
    if len(query):  # the same row, found in several trees, has the same score
        again = np.concatenate([[False], (query[1:] == query[:-1]) & (row[1:] == row[:-1]) & (score[1:] == score[:-1])])
        query, row, score = query[~again], row[~again], score[~again]
        first = np.concatenate([[True], query[1:] != query[:-1]])
        start = np.maximum.accumulate(np.where(first, np.arange(len(query)), 0))
        keep = np.arange(len(query)) - start < k
        query, row, score = query[keep], row[keep], score[keep]
    return query, row, score


def score_leaf(queries: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices of each query's k best rows of a leaf, with scores that equal rows share exactly."""
    rough = queries @ rows.T
    if len(rows) > k:
        cut = -np.partition(-rough, k - 1, axis=1)[:, k - 1]
        i, j = np.nonzero(rough >= (cut - 1e-9 * (1 + np.abs(cut)))[:, None])
    else:
        i, j = (x.ravel() for x in np.indices(rough.shape))
    return i, j, (queries[i] * rows[j]).sum(axis=1)


def nearest_by_product(vectors: DataFrame, queries: str, *, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, recall: float = RECALL, block: int = BLOCK, seed: int = 3) -> DataFrame:
    """The ``k`` rows of largest inner product for each query row, itself left out.

    ``queries`` is a predicate on the input that names the query rows. Returns
    ``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` (the inner product
    in double precision), nearest first, ties to the smaller id; all candidates
    if they are fewer. Vectors that are null, zero or hold null or non-finite
    components, vectors of another length than most, and null ids take no part;
    equal rows count once, an id that repeats with another vector is one
    candidate for each of them and none of its own queries'; an empty table gives an empty one; other
    columns are not read. Of equal vectors only the ``k + 1`` smallest ids can
    ever be among a query's ``k`` nearest, so no more are stored. ``recall`` is
    the part of the true neighbours that the search is set to find, by probes
    among the sample; no group holds many more than ``block`` rows or queries.
    """
    spark = vectors.sparkSession
    space = Workspace(spark, "nearest")
    rows = vectors.withColumn("__asks", F.coalesce(F.expr(queries), F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.col("__asks").alias("asks"))
    rows = rows.filter(usable("vector") & F.col("id").isNotNull()).withColumn("length", F.size("vector"))
    lengths = rows.groupBy("length").count().orderBy(F.desc("count"), "length").first()
    rows = rows.filter(F.col("length") == (lengths["length"] if lengths else 0)).drop("length")
    asking = rows.filter("asks").groupBy("vector").agg(F.min("id").alias("query"))
    asking = space.settle(asking, "queries")
    # equal vectors beyond the k + 1 smallest ids are behind those for every query
    of_vector = W.partitionBy("vector").orderBy("id")
    indexed = rows.select("id", "vector").withColumn("__n", F.row_number().over(of_vector)).filter(F.col("__n") <= k + 1).drop("__n")
    indexed = space.settle(indexed, "rows")
    stats = indexed.agg(F.count("*").alias("n"), F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("longest")).first()
    sample = indexed.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(MAX_SAMPLE).select("vector").toPandas()["vector"]
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    points = np.stack([np.asarray(v, float) for v in sample])
    forest = fit_forest(points, stats["n"], stats["longest"], trees=trees, seed=seed)
    share = forest.share_for(points, k, recall)
    kind = dict(rows.dtypes)["vector"]
    leaves = 1 << forest.depth
    # a leaf is compared with its queries in blocks: so many parts of its rows, so many of the queries
    across, down = max(1, math.ceil(stats["n"] / leaves / block)), max(1, math.ceil(asking.count() / block))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = forest.extended(matrix(batch.column(1)))
            part = spread(batch.column(0).to_numpy(), across)
            for tree in range(trees):
                leaf = ((tree * leaves + forest.place(x, tree)) * across + part) * down
                for d in range(down):
                    yield pa.RecordBatch.from_arrays([pa.array(leaf + d), pa.array(np.zeros(len(leaf), np.int8)), batch.column(0), batch.column(1)], names=["leaf", "asks", "id", "vector"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                rows = batch.slice(start, 64)
                opened = [forest.open(q, share) for q in matrix(rows.column(1))]
                at = np.repeat(np.arange(len(opened)), [len(o) for o in opened])
                leaf = np.array([tree * leaves + node for o in opened for tree, node in o], np.int64)
                mine = spread(rows.column(0).to_numpy(), down)[at]
                for a in range(0, len(at), 8192):
                    part = pa.array(at[a : a + 8192])
                    for c in range(across):
                        key = (leaf[a : a + 8192] * across + c) * down + mine[a : a + 8192]
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.ones(len(part), np.int8)), rows.column(0).take(part), rows.column(1).take(part)], names=["leaf", "asks", "id", "vector"])

    schema = f"leaf long, asks byte, id long, vector {kind}"
    met = indexed.select("id", "vector").mapInArrow(put, schema).union(asking.select(F.col("query").alias("id"), "vector").mapInArrow(route, schema))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def each(group: pa.Table) -> None:
            asks, ids = group.column(1).to_numpy() == 1, group.column(2).to_numpy()
            x = matrix(group.column(3).combine_chunks())
            here, there = np.flatnonzero(asks), np.flatnonzero(~asks)
            for a in range(0, len(here), 256):
                for b in range(0, len(there), 8192):
                    q, r = here[a : a + 256], there[b : b + 8192]
                    i, j, score = score_leaf(x[q], x[r], k + 1)
                    held.append((ids[q][i], ids[r][j], score))
            if sum(len(h[0]) for h in held) > HELD:
                held[:] = [best_of(*(np.concatenate(c) for c in zip(*held, strict=True)), k + 1)]

        def out() -> pa.RecordBatch:
            q, r, s = best_of(*(np.concatenate(c) for c in zip(*held, strict=True)), k + 1) if held else (np.zeros(0, np.int64),) * 3
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(r, pa.int64()), pa.array(s, pa.float64())], names=["query", "id", "score"])

        for _ in by_group(batches, each):
            if sum(len(h[0]) for h in held) > 8 * HELD:  # more queries than a task should hold: hand on what is found so far
                yield out()
        yield out()

    found = met.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(search, "query long, id long, score double").distinct()
    ranked = found.withColumn("__n", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))).filter(F.col("__n") <= k + 1)
    each_query = rows.filter("asks").select(F.col("id").alias("query_id"), "vector").distinct().join(asking, "vector").select("query_id", "query")
    own = each_query.join(ranked, "query").filter(F.col("id") != F.col("query_id"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id")).cast("int")
    return own.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
