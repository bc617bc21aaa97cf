"""Removal of long passages that stand in an earlier document, by sorted suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also stands in a
document with a smaller id. Equal strings of that length meet by their anchor:
the 16-byte gram of the smallest hash in them, which depends on the string
alone. Neighbouring strings mostly have one anchor and travel as one passage.

1. Texts are packed into slices, a written table of compressed rows.
2. Every slice names its different anchors, four bytes each; an anchor that no
   other slice and no second document of this one has is out, with all strings
   it anchors. Anchors of very many slices are noted as hot.
3. Passages of the remaining anchors go to buckets by anchor. Equal passages of
   a slice go once, for its first document: later documents lose them anyway.
   Strings of hot anchors go alone, by their own hash, so that even an anchor in
   every slice spreads, and a string is sent once a slice at most.
4. A bucket drops equal passages in the same way, and sorts the suffixes that are
   left (those whose hash stands there twice) by deep-shallow sorting, to
   ``LENGTH`` bytes. Runs of equal suffixes decide, by their smallest id.
5. The decisions meet their slices again, which cut their texts.

Hashes only choose what is compared; bytes decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltloom.llm.durable import Workspace
from voltloom.llm.shingles import _buffers, mix
from voltloom.llm.suffixes import keys_at, sort_suffixes

#: Bytes of a repeated string (fixed by the contract), and of an anchor.
LENGTH, GRAM = 50, 16
#: Bytes of texts in a slice (one text at least), and bytes whose anchors are found at a time.
SLICE_BYTES, _PIECE = 8 << 20, 1 << 20
#: Bytes of all texts for each bucket of anchors and of passages.
_ANCHOR_BYTES, _PASSAGE_BYTES = 64 << 20, 8 << 20
#: Slices that hold an anchor, above which its strings travel alone.
HOT_SLICES = 1024
#: Strings of a passage at most: a bit each.
_BITS = 64
_SPARE = 128
_FULL = np.concatenate([(np.uint64(1) << np.arange(_BITS, dtype=np.uint64)) - np.uint64(1), [np.uint64(0xFFFFFFFFFFFFFFFF)]])
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def _zip(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join(a.tobytes() for a in arrays))


def _unzip(blob: bytes, *kinds: tuple[str, int]) -> list[np.ndarray]:
    """Arrays of the given types and lengths out of what ``_zip`` made."""
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for kind, n in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return out


def _padded(raw: np.ndarray | bytes) -> np.ndarray:
    """The bytes and some spare zeros, so that keys can be read from every place."""
    out = np.zeros(len(raw) + _SPARE, np.uint8)
    out[: len(raw)] = raw if isinstance(raw, np.ndarray) else np.frombuffer(raw, np.uint8)
    return out


def _orders(ids: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Ids as unsigned numbers of the same order; a null one comes last."""
    return np.where(valid, ids.view(np.uint64) ^ np.uint64(1 << 63), _LAST)


class _Slice:
    """A slice's texts, taken from its row."""

    def __init__(self, row: pa.Table):
        self.id = row["slice_id"][0].as_py()
        n, size = row["n_docs"][0].as_py(), row["n_bytes"][0].as_py()
        self.ids, self.sizes, self.valid, raw = _unzip(row["packed"][0].as_py(), ("<i8", n), ("<i8", n), ("?", n), ("u1", size))
        self.raw, self.size = _padded(raw), size
        self.ends = np.cumsum(self.sizes)
        self.order = _orders(self.ids, self.valid)

    def passages(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, number of strings and anchor hash of the passages, in the order of the text."""
        found = []
        grams = length - GRAM + 1
        for a in range(0, self.size, _PIECE):
            b = min(a + _PIECE, self.size)
            key = keys_at(self.raw[a : b + length + 8])
            n = b - a
            gram = mix(key[: n + grams - 1] * np.uint64(0x9E3779B97F4A7C15) + mix(key[8 : n + grams + 7].astype(np.uint64)))
            low, step = gram, 1
            while step * 2 <= grams:
                low, step = np.minimum(low[:-step], low[step:]), step * 2
            low = np.minimum(low[:n], low[grams - step : grams - step + n])
            # strings do not go over the end of a document
            near = np.searchsorted(self.ends, [a, b + length])
            over = np.zeros(n + 1, np.int64)
            ends, sizes = self.ends[near[0] : near[1] + 1] - a, self.sizes[near[0] : near[1] + 1]
            np.add.at(over, np.clip(np.maximum(ends - sizes, ends - length + 1), 0, n), 1)
            np.add.at(over, np.clip(ends, 0, n), -1)
            at = np.flatnonzero(np.cumsum(over[:-1]) == 0)
            if not len(at):
                continue
            new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (low[at[1:]] != low[at[:-1]])])
            first = np.flatnonzero(new)
            new[(np.arange(len(at)) - first[np.cumsum(new) - 1]) % _BITS == 0] = True
            first = np.flatnonzero(new)
            found.append((at[first] + a, np.diff(np.append(first, len(at))), low[at[first]]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def orders_at(self, starts: np.ndarray) -> np.ndarray:
        return self.order[np.searchsorted(self.ends, starts, "right")]


def _anchor_codes(anchor: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 further bits of an anchor's hash."""
    return ((anchor >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | anchor & np.uint64(0xFFFFFFFF)


def _hashes(keys: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of the ``sizes`` bytes from each place on."""
    out = sizes.astype(np.uint64)
    for k in range(-(-int(sizes.max(initial=0)) // 8)):
        more = mix(out * np.uint64(0xD6E8FEB86659FD93) + keys[at + np.minimum(8 * k, sizes - 8)])
        out = np.where(8 * k < sizes, more, out)  # of its own bytes only, whatever it is hashed with
    return out


def _same(keys: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the ``sizes`` bytes from ``a`` on are those from ``b`` on."""
    same = np.ones(len(a), bool)
    for k in range(-(-int(sizes.max(initial=0)) // 8)):
        step = np.minimum(8 * k, sizes - 8)
        same &= keys[a + step] == keys[b + step]
    return same


def _collapse(raw: np.ndarray, at: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each passage the first of the equal ones, by order; whether it is equal to it; and the passages' hashes."""
    keys = keys_at(raw)
    hashes = _hashes(keys, at, sizes)
    by = np.lexsort((order, hashes))
    new = np.concatenate([[True], hashes[by[1:]] != hashes[by[:-1]]]) if len(by) else np.zeros(0, bool)
    first = np.empty(len(at), np.int64)
    first[by] = by[np.flatnonzero(new)[np.cumsum(new) - 1]]
    equal = (sizes == sizes[first]) & _same(keys, at, at[first], np.minimum(sizes, sizes[first]))
    return first, equal, hashes


def pack_slices(docs: DataFrame, slice_bytes: int) -> DataFrame:
    """Rows ``(slice_id, n_docs, n_bytes, packed)`` of ``docs(id, text)``."""

    def row(number: int, held: list[tuple[pa.Array, np.ndarray, bytes]]) -> pa.RecordBatch:
        ids = pa.chunked_array([h[0] for h in held])
        sizes = np.concatenate([h[1] for h in held])
        packed = _zip(ids.fill_null(0).to_numpy(), sizes, ids.is_valid().to_numpy(), np.frombuffer(b"".join(h[2] for h in held), np.uint8))
        n = [(number, pa.int64()), (len(sizes), pa.int32()), (int(sizes.sum()), pa.int64()), (packed, pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in n], names=["slice_id", "n_docs", "n_bytes", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, total = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            raw, at = _buffers(batch.column(1))
            first = 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(at, at[first] + slice_bytes - total, "right")) - 1)
                held.append((batch.column(0)[first:last], np.diff(at[first : last + 1]), raw[at[first] : at[last]].tobytes()))
                total += int(at[last] - at[first])
                first = last
                if total >= slice_bytes or first < batch.num_rows:
                    yield row(number, held)
                    number, held, total = number + 1, [], 0
        if held:
            yield row(number, held)

    return docs.mapInArrow(run, "slice_id long, n_docs int, n_bytes long, packed binary")


def name_anchors(slices: DataFrame, length: int, buckets: int) -> DataFrame:
    """``(bucket, slice_id, anchors)``: the different anchors of each slice, in ascending order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = _Slice(pa.Table.from_batches([batch.slice(i, 1)]))
                codes = np.unique(_anchor_codes(part.passages(length)[2], buckets))
                bucket = (codes >> np.uint64(32)).astype(np.int64)
                first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(codes) else []
                named = [x.astype(np.uint32).tobytes() for x in np.split(codes & np.uint64(0xFFFFFFFF), first[1:])] if len(codes) else []
                columns = [pa.array(bucket[first] if len(codes) else [], pa.int64()), pa.array([part.id] * len(named), pa.int64()), pa.array(named, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "slice_id", "anchors"])

    return slices.mapInArrow(run, "bucket long, slice_id long, anchors binary")


def mark_shared(anchors: DataFrame, hot_slices: int) -> DataFrame:
    """``(slice_id, bucket, shared, hot)``: bits for the anchors of each row, in their order."""

    def run(table: pa.Table) -> pa.Table:
        rows = [np.frombuffer(x, np.uint32) for x in table["anchors"].to_pylist()]
        _, where, n = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
        cuts = np.cumsum([len(r) for r in rows])[:-1]
        bits = [[np.packbits(x).tobytes() for x in np.split(n[where] > least, cuts)] for least in (1, hot_slices)]
        return pa.table({"slice_id": table["slice_id"], "bucket": table["bucket"], "shared": pa.array(bits[0], pa.binary()), "hot": pa.array(bits[1], pa.binary())})

    return anchors.groupBy("bucket").applyInArrow(run, "slice_id long, bucket long, shared binary, hot binary")


def send_passages(slices: DataFrame, marks: DataFrame, length: int, anchor_buckets: int, buckets: int) -> DataFrame:
    """``(bucket, slice_id, n, n_later, n_bytes, packed)``: passages of shared anchors, and places of those an earlier document of the slice holds."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        part = _Slice(left)
        starts, counts, anchor = part.passages(length)
        codes = _anchor_codes(anchor, anchor_buckets)
        order = part.orders_at(starts)
        different, where = np.unique(codes, return_inverse=True)
        flags = []
        per_bucket = np.unique(different >> np.uint64(32), return_counts=True)[1]
        by = np.argsort(right["bucket"].to_numpy())
        for name in ("shared", "hot"):
            blobs = right[name].to_pylist()
            bits = [np.unpackbits(np.frombuffer(blobs[i], np.uint8), count=int(n)) for i, n in zip(by.tolist(), per_bucket, strict=True)]
            flags.append(np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool))
        low, high = np.full(len(different), _LAST), np.zeros(len(different), np.uint64)
        np.minimum.at(low, where, order)
        np.maximum.at(high, where, order)
        open_, hot = (flags[0] | (low < high))[where], flags[1][where]
        alone = np.flatnonzero(open_ & hot)
        plain = np.flatnonzero(open_ & ~hot)
        step = np.arange(int(counts[alone].sum())) - np.repeat(np.cumsum(counts[alone]) - counts[alone], counts[alone])
        starts = np.concatenate([starts[plain], np.repeat(starts[alone], counts[alone]) + step])
        order = np.concatenate([order[plain], np.repeat(order[alone], counts[alone])])
        counts = np.concatenate([counts[plain], np.ones(len(step), np.int64)])
        first, equal, hashes = _collapse(part.raw, starts, counts + length - 1, order)
        to = np.concatenate([mix(codes[plain]), hashes[len(plain) :]]) % np.uint64(buckets)
        later = equal & (order > order[first])
        by = np.lexsort((starts, later, to))
        out = {k: [] for k in ("bucket", "n", "n_later", "n_bytes", "packed")}
        for group in np.split(by, np.flatnonzero(to[by[1:]] != to[by[:-1]]) + 1) if len(by) else []:
            sent, rest = group[~later[group]], group[later[group]]
            sizes = counts[sent] + length - 1
            total = int(sizes.sum())
            at = np.repeat(starts[sent] - np.cumsum(sizes) + sizes, sizes) + np.arange(total)
            packed = _zip(starts[group].astype(np.uint32), counts[group].astype(np.uint8), order[sent], part.raw[at])
            for k, v in zip(out, (int(to[group[0]]), len(sent), len(rest), total, packed), strict=True):
                out[k].append(v)
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
        columns = {k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds, strict=True)}
        return pa.table({"bucket": columns.pop("bucket"), "slice_id": pa.array([part.id] * len(out["n"]), pa.int64())} | columns)

    return slices.groupBy("slice_id").cogroup(marks.groupBy("slice_id")).applyInArrow(run, "bucket long, slice_id long, n int, n_later int, n_bytes long, packed binary")


def _repeated(raw: np.ndarray, at: np.ndarray, counts: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each passage a bit for each of its strings that a passage of smaller order holds too."""
    first, equal, _ = _collapse(raw, at, counts + length - 1, order)
    later = equal & (order > order[first])
    own = np.flatnonzero(~equal | (first == np.arange(len(at))))  # different passages
    owner = np.repeat(own, counts[own])
    bit = np.arange(len(owner)) - np.repeat(np.cumsum(counts[own]) - counts[own], counts[own])
    suffix = at[owner] + bit
    # what stands here once cannot be repeated
    hashes = _hashes(keys_at(raw), suffix, np.full(len(suffix), length))
    by = np.argsort(hashes)
    twice = np.zeros(len(by), bool)
    same = hashes[by[1:]] == hashes[by[:-1]]
    twice[by[1:]] |= same
    twice[by[:-1]] |= same
    some = np.flatnonzero(twice)
    masks = np.zeros(len(at), np.uint64)
    if len(some):
        by, begins = sort_suffixes(raw, suffix[some], length)
        some = some[by]
        run = np.flatnonzero(begins)
        lowest = np.minimum.reduceat(order[owner[some]], run)[np.cumsum(begins) - 1]
        gone = some[order[owner[some]] > lowest]
        np.bitwise_or.at(masks, owner[gone], np.uint64(1) << bit[gone].astype(np.uint64))
    masks[equal] = masks[first[equal]]  # those of the same document as the first
    masks[later] = _FULL[counts[later]]
    return masks


def decide(passages: DataFrame, length: int) -> DataFrame:
    """``(slice_id, n, packed)``: places of passages and bits of their repeated strings."""

    def run(table: pa.Table) -> pa.Table:
        starts, counts, orders, texts, edges = [], [], [], [], [0]
        for row in table.to_pylist():
            n, rest = row["n"], row["n_later"]
            got = _unzip(row["packed"], ("<u4", n + rest), ("u1", n + rest), ("<u8", n), ("u1", row["n_bytes"]))
            for held, x in zip((starts, counts, orders, texts), got, strict=True):
                held.append(x)
            edges.append(edges[-1] + n)
        sent = np.concatenate([c[:n] for c, n in zip(counts, np.diff(edges).tolist(), strict=True)]).astype(np.int64)
        sizes = sent + length - 1
        masks = _repeated(_padded(np.concatenate(texts)), np.cumsum(sizes) - sizes, sent, np.concatenate(orders), length)
        ids, n, packed = [], [], []
        for i, number in enumerate(table["slice_id"].to_pylist()):
            own = masks[edges[i] : edges[i + 1]]
            rest = _FULL[counts[i][len(own) :]]
            all_ = np.concatenate([own, rest])
            hit = all_ > 0
            if hit.any():
                ids.append(number)
                n.append(int(hit.sum()))
                packed.append(_zip(starts[i][hit], all_[hit]))
        return pa.table({"slice_id": pa.array(ids, pa.int64()), "n": pa.array(n, pa.int32()), "packed": pa.array(packed, pa.binary())})

    return passages.groupBy("bucket").applyInArrow(run, "slice_id long, n int, packed binary")


def cut_texts(slices: DataFrame, decisions: DataFrame, length: int) -> DataFrame:
    """``(id, n_bytes, spans, kept)`` of every document of the slices."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        part = _Slice(left)
        hit = np.zeros(part.size + 1, np.int8)
        for row in right.to_pylist():
            starts, masks = _unzip(row["packed"], ("<u4", row["n"]), ("<u8", row["n"]))
            which, bit = np.nonzero(np.unpackbits(masks.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            hit[starts[which].astype(np.int64) + bit] = 1
        upto = np.cumsum(hit, dtype=np.int32)[: part.size]
        gone = upto > 0
        gone[length:] = upto[length:] > upto[:-length]
        begin = np.concatenate([[0], part.ends[:-1]]).astype(np.int64)
        edge = np.zeros(part.size + 1, bool)
        edge[begin] = edge[part.ends] = True
        starts = np.flatnonzero(gone & (np.concatenate([[True], ~gone[:-1]]) | edge[:-1]))
        ends = np.flatnonzero(gone & (np.concatenate([~gone[1:], [True]]) | edge[1:])) + 1
        doc = np.searchsorted(part.ends, starts, "right")
        spans = pa.StructArray.from_arrays([pa.array(starts - begin[doc]), pa.array(ends - begin[doc])], ["start", "end"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(part.ids)))]), pa.int32()), spans)
        kept_at = np.concatenate([[0], np.cumsum(~gone)])[np.concatenate([[0], part.ends])]
        kept = pa.Array.from_buffers(pa.large_binary(), len(part.ids), [None, pa.py_buffer(kept_at.astype(np.int64)), pa.py_buffer(part.raw[: part.size][~gone].tobytes())])
        return pa.table({"id": pa.array(part.ids, mask=~part.valid), "n_bytes": pa.array(part.sizes), "spans": lists, "kept": kept.cast(pa.binary())})

    return slices.groupBy("slice_id").cogroup(decisions.groupBy("slice_id")).applyInArrow(run, "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, slice_bytes: int = SLICE_BYTES, hot_slices: int = HOT_SLICES) -> DataFrame:
    """Cut from every text the bytes that strings of an earlier document cover.

    A text is its UTF-8 bytes, a null one is empty. A byte goes if a string of
    ``length`` bytes (24 to 64) that covers it also stands in a document with a
    smaller id, in the input as it is: overlaps count, and what was cut from the
    earlier document counts too. Returns ``id_col`` (as long), ``n_bytes``,
    ``spans`` (start and end of the maximal runs cut, in bytes) and ``kept``
    (the remaining bytes), one row per input row. Documents of equal ids do not
    cut each other; a null id comes after all others; repeated rows are rows of
    their own; an empty table gives an empty one; other columns of the input are
    not read.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "suffix-dedup")
    slices = space.settle(pack_slices(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), slice_bytes), "slices")
    total = slices.agg(F.sum("n_bytes")).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    anchor_buckets, buckets = max(least, total // _ANCHOR_BYTES), max(least, total // _PASSAGE_BYTES)
    marks = mark_shared(name_anchors(slices, length, anchor_buckets), hot_slices)
    decisions = decide(send_passages(slices, marks, length, anchor_buckets, buckets), length)
    return cut_texts(slices, decisions, length).withColumnRenamed("id", id_col)


#: DuckDB SQL for the rows of the query, over the registered view ``documents``.
SQL = """
WITH texts AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(doc_id, 9223372036854775807) AS place, hex(encode(coalesce(text, ''))) AS bytes FROM documents),
chunks AS (
  SELECT row, place, base, substr(bytes, 2 * base + 1, 2098) AS chunk
  FROM (SELECT row, place, bytes, unnest(range(0, length(bytes) // 2 - 49, 1000)) AS base FROM texts WHERE length(bytes) >= 100)),
strings AS (
  SELECT row, place, base + step AS spot, substr(chunk, 2 * step + 1, 100) AS string
  FROM (SELECT row, place, base, chunk, unnest(range(least(1000, length(chunk) // 2 - 49))) AS step FROM chunks)),
first AS (SELECT string, min(place) AS lowest FROM strings GROUP BY string HAVING min(place) < max(place)),
hits AS (
  SELECT row, spot, spot > 50 + coalesce(lag(spot) OVER (PARTITION BY row ORDER BY spot), -99) AS begins
  FROM strings JOIN first ON strings.string = first.string WHERE place > lowest),
spans AS (
  SELECT row, min(spot) AS a, max(spot) + 50 AS b
  FROM (SELECT row, spot, sum(begins::INT) OVER (PARTITION BY row ORDER BY spot) AS span FROM hits) GROUP BY row, span),
pieces AS (
  SELECT t.row, s.a, substr(bytes, 2 * coalesce(lag(b) OVER of_row, 0) + 1, 2 * (s.a - coalesce(lag(b) OVER of_row, 0))) AS before,
         CASE WHEN lead(s.a) OVER of_row IS NULL THEN substr(bytes, 2 * s.b + 1) ELSE '' END AS after, s.b - s.a AS gone
  FROM texts t JOIN spans s ON t.row = s.row WINDOW of_row AS (PARTITION BY t.row ORDER BY s.a)),
cut AS (
  SELECT row, string_agg(before || after, '' ORDER BY a) AS kept, sum(gone) AS n_removed, count(*) AS n_spans FROM pieces GROUP BY row)
SELECT doc_id, (length(bytes) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, bytes))) AS kept_sha256
FROM texts t LEFT JOIN cut c ON t.row = c.row
"""
