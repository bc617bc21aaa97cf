"""Groups of spelling variants: words one inserted, deleted or replaced character apart, without pairs.

Two words differ by a replaced character if they agree in everything before and
after one position: such words share a wildcard group of (position, prefix,
suffix), which can have no more members than the alphabet has letters. A group
keeps its size and its two foremost words, and that tells each member how many
near words it has there and which of them comes first. Two words differ by an
inserted character if one of them is the other with a character taken out:
every word's deletions are looked up in the vocabulary. What a word hears from
its groups and look-ups is summed up; pairs of a group never exist.

Words carry numbers in the order of their counts (ties by code points), so that
"the foremost" is the smallest number. Prefix and suffix are stood for by four
polynomial hashes modulo primes (124 bits), taken from running sums, so that a
word of any length costs a row of fixed size for each position.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltloom.llm.durable import Workspace
from voltloom.llm.shingles import _buffers

#: Of the contract: code points and occurrences of a word, how much commoner its form is, what runs lose a character.
MIN_LENGTH, MIN_COUNT, TIMES, LOSES = 7, 2, 10, 31
#: Bytes of text whose runs are found at a time, and distinct words counted before they are sent on.
_SEGMENT, _WORDS = 1 << 20, 200_000
#: Runs up to this length have their CRC-32 taken side by side.
_SHORT = 48
#: Code points whose keys are made at a time (a word at least).
_KEYED = 1 << 17
_PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
_BASES = (1000003, 998244353, 1234577, 700000001)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: a-z, A-Z and the lead byte of U+00C0 to U+00FF in UTF-8; the byte after that lead belongs to it.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3]] = True
_LEAD = 0xC3


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> np.uint32(1)), table >> np.uint32(1)).astype(np.uint32)
    return table


_CRC = _crc_table()


def _letter_runs(raw: np.ndarray, edges: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Start, end and code points of the letter runs in the bytes ``edges[0]`` to ``edges[-1]``, a segment at a time; no run goes over an edge."""
    at, until, size = int(edges[0]), int(edges[-1]), _SEGMENT
    while at < until:
        end = min(at + size, until)
        piece = raw[at:end]
        letter = _LETTER[piece]
        lead = piece == _LEAD
        letter[1:] |= lead[:-1]
        cut = np.zeros(len(piece) + 1, bool)
        cut[edges[np.searchsorted(edges, at) : np.searchsorted(edges, end, "right")] - at] = True
        if end < until and letter[-1] and not cut[-1]:  # a run that may go on: leave it to the next segment
            stop = max([0, *(np.flatnonzero(~letter)[-1:] + 1).tolist(), *np.flatnonzero(cut)[-1:].tolist()])
            if stop == 0:
                size *= 2
                continue
            end, piece, letter, lead, cut = at + stop, piece[:stop], letter[:stop], lead[:stop], cut[: stop + 1]
        starts = np.flatnonzero(letter & (np.concatenate([[True], ~letter[:-1]]) | cut[:-1]))
        ends = np.flatnonzero(letter & (np.concatenate([~letter[1:], [True]]) | cut[1:])) + 1
        leads = np.concatenate([[0], np.cumsum(lead)])
        yield starts + at, ends + at, ends - starts - (leads[ends] - leads[starts])
        at, size = end, _SEGMENT


def _checksums(low: bytes, starts: np.ndarray, sizes: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """CRC-32 of every run, each carried on from the checksum ``begun`` of what stands before it."""
    raw = np.frombuffer(low, np.uint8)
    out = np.zeros(len(starts), np.uint32)
    by = np.argsort(-sizes, kind="stable")
    long = int(np.count_nonzero(sizes > _SHORT))
    for i in by[:long].tolist():
        out[i] = zlib.crc32(low[starts[i] : starts[i] + sizes[i]], int(begun[i]))
    by = by[long:]
    if len(by):
        state, at, left = ~begun[by], starts[by], sizes[by]
        for k in range(int(left[0])):
            n = int(np.searchsorted(-left, -k))  # runs longer than k
            state[:n] = _CRC[(state[:n] ^ raw[at[:n] + k]) & np.uint32(0xFF)] ^ (state[:n] >> np.uint32(8))
        out[by] = ~state
    return out


def count_words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, loses: int = LOSES) -> DataFrame:
    """``(word, n)`` of all whole texts: lower-cased letter runs of ``min_length`` code points and more.

    A run whose CRC-32 of ``<id>:<run>`` is divisible by ``loses`` first loses
    the code point at that number modulo its length. A null text has no words,
    a null id counts as the text ``null``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = [zlib.crc32(x.encode()) for x in batch.column(0).to_pylist()]
            raw, edges = _buffers(batch.column(1))
            begun = np.array(before, np.uint32)
            found: Counter[bytes] = Counter()
            for starts, ends, points in _letter_runs(raw, edges):
                enough = points >= min_length
                starts, ends, points = starts[enough], ends[enough], points[enough]
                if not len(starts):
                    continue
                base = int(starts[0])
                low = _LOWER[raw[base : ends[-1]]].tobytes()
                row = np.searchsorted(edges, starts, "right") - 1
                crc = _checksums(low, starts - base, ends - starts, begun[row])
                less = crc % np.uint32(loses) == 0
                for a, b in zip((starts[~less] - base).tolist(), (ends[~less] - base).tolist(), strict=True):
                    found[low[a:b]] += 1
                for a, b, n, h in zip((starts[less] - base).tolist(), (ends[less] - base).tolist(), points[less].tolist(), crc[less].tolist(), strict=True):
                    if n > min_length:
                        word = low[a:b].decode()
                        found[(word[: h % n] + word[h % n + 1 :]).encode()] += 1
                if len(found) >= _WORDS:
                    yield _counted(found)
                    found = Counter()
            if found:
                yield _counted(found)

    named = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"))
    found = docs.select(named.alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def _counted(found: Counter[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """``base ** k % prime`` for k below n."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)])
    return out[:n]


def _keys(numbers: np.ndarray, words: list[str]) -> pa.RecordBatch:
    """Rows of every word's own key (place -2), its distinct deletions (-1) and its wildcards (the position)."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.array([len(w) for w in words])
    first = np.cumsum(size) - size
    word = np.repeat(np.arange(len(words)), size)
    at = np.arange(len(points)) - first[word]
    parts: list[list[np.ndarray]] = [[], [], []]
    for prime, base in zip(_PRIMES, _BASES, strict=True):
        p = np.uint64(prime)
        term = (points + np.uint64(1)) * _powers(base, prime, int(size.max()))[at] % p
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(term)])  # below 2**31 each, so the sums fit
        total = (upto[first + size] - upto[first]) % p
        left = upto[:-1] - upto[first][word]
        right = (upto[first + size][word] - upto[1:]) % p
        parts[0].append(total)
        parts[1].append((left + right * np.uint64(pow(base, -1, prime))) % p)
        parts[2].append((left + right * np.uint64(1)) % p)
    # the same letter again: the deletion is the one before
    fresh = np.ones(len(points), bool)
    fresh[1:] = (points[1:] != points[:-1]) | (at[1:] == 0)
    whole = lambda k, keep: [(p[0][keep] << np.uint64(32) | p[1][keep]).view(np.int64) for p in (parts[k][:2], parts[k][2:])]
    every = slice(None)
    keys = [np.concatenate(x) for x in zip(whole(0, every), whole(1, fresh), whole(2, every), strict=True)]
    columns = [
        np.concatenate([numbers, numbers[word[fresh]], numbers[word]]),
        np.concatenate([size, size[word[fresh]] - 1, size[word]]).astype(np.int32),
        np.concatenate([np.full(len(words), -2), np.full(int(fresh.sum()), -1), at]).astype(np.int32),
        *keys,
    ]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["word_id", "size", "place", "key1", "key2"])


def word_keys(vocabulary: DataFrame) -> DataFrame:
    """``(word_id, size, place, key1, key2)`` of ``vocabulary(word_id, word)``: see ``_keys``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, words = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            first = total = 0
            for i, w in enumerate(words):
                if total and total + len(w) > _KEYED:
                    yield _keys(numbers[first:i], words[first:i])
                    first, total = i, 0
                total += len(w)
            if words:
                yield _keys(numbers[first:], words[first:])

    return vocabulary.select("word_id", "word").mapInArrow(run, "word_id long, size int, place int, key1 long, key2 long")


def near_words(keys: DataFrame) -> DataFrame:
    """``(word_id, n_near, best)`` of every word with near words; ``best`` is the smallest number among them."""
    same = ["size", "key1", "key2"]
    # a group's members differ in one character only, so their list is no longer than the alphabet
    groups = keys.filter("place >= 0").groupBy("place", *same).agg(F.sort_array(F.collect_list("word_id")).alias("members")).filter(F.size("members") > 1)
    groups = groups.select("members", (F.size("members") - 1).cast("long").alias("others"), F.col("members")[0].alias("foremost"), F.col("members")[1].alias("next"))
    replaced = groups.select(F.explode("members").alias("word_id"), "others", "foremost", "next")
    replaced = replaced.select("word_id", "others", F.when(F.col("word_id") == F.col("foremost"), F.col("next")).otherwise(F.col("foremost")).alias("best"))
    links = keys.filter("place = -1").select(F.col("word_id").alias("longer"), *same).join(keys.filter("place = -2").select(F.col("word_id").alias("shorter"), *same), same)
    one = F.lit(1).cast("long").alias("others")
    heard = replaced.union(links.select("longer", one, "shorter")).union(links.select("shorter", one, "longer"))
    return heard.groupBy("word_id").agg(F.sum("others").alias("n_near"), F.min("best").alias("best"))


def follow(forms: DataFrame, space: Workspace) -> DataFrame:
    """``(word_id, root)`` of ``forms(word_id, form_id)``: the end of every chain, by doubling the steps.

    Each step at least multiplies the count, so chains are short and few rounds do.
    """
    roots = space.settle(forms.select("word_id", F.col("form_id").alias("root")), "roots")
    while True:
        ahead = roots.select(F.col("word_id").alias("root"), F.col("root").alias("further"))
        further = space.settle(roots.join(ahead, "root", "left").select("word_id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        space.drop(roots)
        roots = further.select("word_id", "root")
        roots._settled_at = further._settled_at  # noqa: SLF001
        if further.filter("moved").isEmpty():
            return roots


def spelling_variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_count: int = MIN_COUNT, times: int = TIMES) -> DataFrame:
    """Words of all whole texts with their commoner spellings.

    Returns, for every word of ``count_words`` with ``min_count`` occurrences,
    ``word``, ``n`` (occurrences), ``n_near`` (words one inserted, deleted or
    replaced code point away), ``form`` (the near word of most occurrences, the
    smallest in code point order among equals, if it has ``times`` the word's;
    else null), ``form_n`` (its occurrences) and ``root`` (the end of the chain
    of forms; the word itself without one). Null and empty texts add nothing; a
    null id counts as the text ``null``; repeated rows count again; an empty
    table gives an empty one; other columns of the input are not read.
    """
    space = Workspace(docs.sparkSession, "spelling")
    counted = space.settle(count_words(docs, id_col=id_col, text_col=text_col).filter(F.col("n") >= min_count), "counts")
    by = [F.col("n").desc(), F.col("word")]
    ordered = counted.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("word_id", F.monotonically_increasing_id())
    vocabulary = space.settle(ordered, "vocabulary")
    keys = space.settle(word_keys(vocabulary), "keys")
    near = space.settle(near_words(keys), "near")
    space.drop(counted, keys)
    best = vocabulary.select(F.col("word_id").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    known = vocabulary.join(near, "word_id", "left").join(best, "best", "left")
    fits = F.col("form_n") >= times * F.col("n")
    known = known.select("word_id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), *[F.when(fits, F.col(c)).alias(a) for c, a in (("best", "form_id"), ("form", "form"), ("form_n", "form_n"))])
    known = space.settle(known, "known")
    roots = follow(known.filter("form_id is not null"), space).join(vocabulary.select(F.col("word_id").alias("root"), F.col("word").alias("root_word")), "root")
    return known.join(roots.select("word_id", "root_word"), "word_id", "left").select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


#: DuckDB SQL for the same rows, over the registered view ``documents``. The
#: CRC-32 is computed bit by bit from its polynomial.
SQL = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{7,}')) AS run FROM documents)
  GROUP BY ALL),
summed AS (
  SELECT run, k, xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(named))), lambda i: ('0x' || substr(hex(encode(named)), 2 * i + 1, 2))::BIGINT)),
           lambda crc, byte: list_reduce(
             list_prepend(xor(crc, byte), range(8)),
             lambda r, i: CASE WHEN r & 1 = 1 THEN xor(3988292384, r >> 1) ELSE r >> 1 END))) AS h
  FROM (SELECT run, k, coalesce(doc_id::VARCHAR, 'null') || ':' || run AS named FROM runs)),
vocabulary AS (
  SELECT word, sum(k)::BIGINT AS n
  FROM (SELECT k, CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM summed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
cut AS (
  SELECT DISTINCT word, n, place, left(word, place) AS head, substr(word, place + 2) AS tail
  FROM (SELECT word, n, unnest(range(length(word))) AS place FROM vocabulary)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.place = b.place AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION
  SELECT a.word, b.word, b.n FROM cut a JOIN vocabulary b ON a.head || a.tail = b.word
  UNION
  SELECT b.word, a.word, a.n FROM cut a JOIN vocabulary b ON a.head || a.tail = b.word),
best AS (
  SELECT word, count(*) AS n_near, arg_min(other, {'n': -other_n, 'w': other}) AS other, max(other_n) AS other_n FROM near GROUP BY word),
formed AS (
  SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near,
         CASE WHEN other_n >= 10 * v.n THEN other END AS form, CASE WHEN other_n >= 10 * v.n THEN other_n END AS form_n
  FROM vocabulary v LEFT JOIN best ON v.word = best.word),
chain AS (
  SELECT word, word AS root FROM formed
  UNION
  SELECT c.word, f.form FROM chain c JOIN formed f ON c.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
FROM formed f JOIN chain c ON f.word = c.word JOIN formed e ON c.root = e.word WHERE e.form IS NULL
"""
