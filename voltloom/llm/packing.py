"""Packing documents into sequences along a space-filling curve.

A document's token counts are hashed to a vector, the vector is projected to
three dimensions, and the cell of that point on a Hilbert curve is the
document's key. Documents are range-sorted by key, laid end to end, and the
stream is cut every ``sequence`` tokens: neighbours on the curve share
sequences, and only the last sequence is padded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltloom.llm.durable import Workspace, small_batches
from voltloom.llm.token_counts import PLAIN_ONLY, MergeCounter

SEQUENCE = 2048
END_ID = 1
#: Size of the hashed vector, dimensions it is projected to, and bits of each on the curve.
HASHED, DIMS, BITS = 256, 3, 16
#: Entries of a worker's memories of words and of their parts before they are emptied (bounds memory, not results).
MEMORY_WORDS, MEMORY_PARTS = 200_000, 400_000
#: Rows of a range of the curve, about: bounds what one task sorts.
ROWS_PER_RANGE = 65_536


class WordEncoder:
    """Token ids of texts as the library gives them, remembered word by word."""

    def __init__(self, path: str):
        base = MergeCounter(path)
        if len(base.vocab) + len(base.specials) > 65_536:
            raise ValueError("ids of more than 16 bits")
        self.library, self.model, self.letters = base.library, base.library.model, base.letters
        self.by_words, self.pattern = base.by_words, base.pattern
        self.specials = base.specials
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        if len(self.words) >= MEMORY_WORDS:
            self.words.clear()
        out = []
        for part in self.pattern.findall(word):
            got = self.parts.get(part)
            if got is None:
                if len(self.parts) >= MEMORY_PARTS:
                    self.parts.clear()
                letters = part if part.isascii() and part.isalnum() else "".join([self.letters[b] for b in part.encode()])
                got = self.parts[part] = np.array([t.id for t in self.model.tokenize(letters)], "<u2").tobytes()
            out.append(got)
        got = self.words[word] = b"".join(out)
        return got

    def encode(self, text: str) -> bytes:
        """Little-endian 16-bit ids of a whole text, without added special tokens."""
        if not self.by_words or PLAIN_ONLY.search(text) or any(s in text for s in self.specials):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        find, new = self.words.get, self._word
        return b"".join([find(w) or new(w) for w in text.lower().split()])


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions of integer points (one a row) along the Hilbert curve.

    The cube is halved bit by bit: each step reads off one bit per axis, and
    the quadrant found decides which axes are swapped or mirrored below it.
    """
    x = cells.T.astype(np.int64).copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        high, low = 1 << level, (1 << level) - 1
        for d in range(dims):
            upper = (x[d] & high) != 0
            mirrored = x[0] ^ low
            differ = np.where(upper, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(upper, mirrored, x[0] ^ differ)
            if d:
                x[d] ^= differ
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> level) & 1, (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            key = key << 1 | (x[d] >> level) & 1
    return key


def curve_keys(ids: list[np.ndarray], seed: int = 5) -> np.ndarray:
    """Hilbert keys of documents given by their token ids."""
    rng = np.random.default_rng(seed)
    bucket, sign = rng.integers(0, HASHED, 65_536), rng.choice([-1.0, 1.0], 65_536)
    project = rng.standard_normal((HASHED, DIMS))
    hashed = np.zeros((len(ids), HASHED))
    for k, doc in enumerate(ids):
        hashed[k] = np.bincount(bucket[doc], sign[doc], HASHED)
    hashed /= np.maximum(1e-12, np.linalg.norm(hashed, axis=1, keepdims=True))
    cells = np.clip((hashed @ project + 4.0) / 8.0 * (1 << BITS), 0, (1 << BITS) - 1)
    return hilbert_keys(cells.astype(np.int64))


def pack_along_curve(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Pack all documents into sequences of ``sequence`` tokens.

    Returns a row for each piece: ``doc_id``, ``start`` (the document's ids
    before it), ``length``, ``ids`` (little-endian unsigned 32-bit), ``doc_tokens``
    (with the end id), ``sequence_id``, ``offset`` (gapless from 0 in each
    sequence). Every id lies in exactly one piece, and all sequences but the
    last are full. Null and empty texts have the end id alone; very long texts
    span as many sequences as they need; null ids, ties on the curve and
    repeated rows are told apart by their row; an empty table gives no pieces.
    Other columns are not read.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "packing")
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u2").tobytes()

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                ids = [(encode(t.as_py()) if t.is_valid else b"") + end for t in part.column(1)]
                keys = curve_keys([np.frombuffer(x, "<u2") for x in ids])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(keys, pa.int64())], names=["doc_id", "tokens", "n", "key"])

    tokens = docs.select(id_col, text_col).mapInArrow(tokenize, f"doc_id {kind}, tokens binary, n long, key long")
    tokens = space.settle(tokens.withColumn("row", F.monotonically_increasing_id()), "tokens")
    order = tokens.select("row", "n", "key")
    ranges = max(1, -(-tokens.count() // ROWS_PER_RANGE), int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = order.repartitionByRange(ranges, "key", "row").sortWithinPartitions("key", "row")

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            n = batch.column(1).to_numpy()
            until = done + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(until - n), batch.column(1), batch.column(3)], names=["row", "at", "n", "range"])
            done = int(until[-1]) if len(until) else done

    laid = space.settle(order.withColumn("range", F.spark_partition_id()).mapInArrow(lay, "row long, at long, n long, range int"), "order")
    sums = {r["range"]: r["n"] for r in laid.groupBy("range").agg(F.sum("n").alias("n")).collect()}  # one number a range
    starts = np.concatenate([[0], np.cumsum([sums.get(k, 0) for k in range(max(sums, default=-1) + 1)])]).astype(np.int64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at, rng = batch.column(1), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            out: list[list] = [[] for _ in range(7)]
            doc_ids = batch.column(0)
            for k in range(batch.num_rows):
                words = np.frombuffer(ids[k].as_buffer(), "<u2").astype("<u4")
                place, start, n = int(starts[rng[k]] + at[k]), 0, len(words)
                while start < n:
                    length = min(n - start, sequence - place % sequence)
                    row = (k, start, length, words[start : start + length].tobytes(), n, place // sequence, place % sequence)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    start += length
                    place += length
            yield pa.RecordBatch.from_arrays(
                [doc_ids.take(pa.array(out[0], pa.int32())), *[pa.array(c, t) for c, t in zip(out[1:], (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)]],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    placed = tokens.join(laid.select("row", "at", "range"), "row").select("doc_id", "tokens", "at", "range")
    return placed.mapInArrow(cut, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
