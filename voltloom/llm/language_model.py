"""Log-probabilities of texts under a hashed maximum-entropy language model.

The probability of a token is factored by classes: the class given the history
by a softmax over hashed features, times the token given its class and the
history, over hashed features too. The most frequent words are classes of their
own, so that the history decides on them directly; all others fall into classes
by their endings. The features of a history are the class before (bigram), the
one before that (skip) and both (trigram), hashed into one weight table. Within
a class they are the words before themselves, each frequent word and each ending
of the rest. There the classes are carried on: a Huffman tree parts a class into
two and these again, down to words, each parting a softmax of two outcomes whose
features are hashed with its place in the tree, so that the words'
probabilities sum to one without a sum over the class. What is not frequent is
one leaf of its class, in which a word has its add-one share.

The softmax of classes is fitted by gradient updates over counts of (history,
class) that cover every training token: tasks hold the counts of their histories
and return expected feature counts under the current weights, the driver moves
the weights. Those within classes are fitted alike, by passes over every
training text: a task adds up its texts' feature counts in one table of fixed
size, the tables are added piece by piece. Scoring looks histories up in blocks
of whole texts.

Counts of words grow with the corpus and stay distributed. The most frequent
words are broadcast (a fixed number of them); the rest of a text's words meet
their counts in a join.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltloom.llm.durable import Workspace

#: Classes: the end, the most frequent words, and classes of endings.
OWN, ENDINGS = 79, 80
CLASSES = 1 + OWN + ENDINGS
#: Frequent words that workers hold with their counts (a bound on memory; the rest are joined).
FREQUENT = 65_536
#: Bits of a row in the weight table within classes, rounds of its updates, tokens looked at together, and pieces in which such tables are added.
WORD_BITS, WORD_ROUNDS, TOKENS, PIECES = 19, 2, 8_192, 64
#: Code of the places before a text.
START = FREQUENT + ENDINGS
#: Rows of the hashed weight table, rounds of gradient updates, pseudo-counts against rare features, and ridge penalty.
HASHED, ROUNDS, PRIOR, RIDGE = 4_096, 6, 30.0, 1.0
#: Tasks that share the counted histories in training; each returns one table of fixed size a round.
OWNERS = 4
#: Histories whose probabilities a task holds at once in training.
HISTORIES = 2_048
#: Distinct words a task counts before it hands its counts on.
COUNTED = 400_000


def ending_class(word: bytes) -> int:
    """The class of a word that has none of its own."""
    return 1 + OWN + zlib.crc32(word[-2:]) % ENDINGS


def feature_rows() -> np.ndarray:
    """The weight rows of every history (class two before x class before): skip, bigram, trigram."""
    two, one = np.divmod(np.arange(CLASSES * CLASSES, dtype=np.uint64), np.uint64(CLASSES))

    def hashed(kind: int, value: np.ndarray) -> np.ndarray:
        x = (value + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(kind * 0x5851F42D4C957F2D % (1 << 63))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x ^ (x >> np.uint64(29))) % np.uint64(HASHED)).astype(np.int64)

    return np.stack([hashed(1, two), hashed(2, one), hashed(3, two * np.uint64(CLASSES) + one)])


def log_softmax(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Natural log-probabilities of the classes after histories with these weight rows."""
    logit = bias + weights[rows[0]] + weights[rows[1]] + weights[rows[2]]
    logit -= logit.max(axis=1, keepdims=True)
    return logit - np.log(np.exp(logit).sum(axis=1, keepdims=True))


def fit_softmax(counts: DataFrame, *, rounds: int = ROUNDS) -> np.ndarray:
    """log10 P(class | history), a row for each history, from counts ``(cell, n)``; cell = history * CLASSES + class.

    There are no more cells than CLASSES ** 3, whatever the corpus. ``OWNERS``
    tasks share them: in the first round each returns the observed count of each
    (weight row, class), afterwards the expected one. Both are sums over cells,
    so it does not matter which task has which; a task without cells is silent.
    """
    features = feature_rows()
    owned = counts.select((F.col("cell") / CLASSES).cast("long").alias("history"), (F.col("cell") % CLASSES).cast("long").alias("class"), "n").coalesce(OWNERS)

    def gather(weights: np.ndarray | None, bias: np.ndarray | None) -> np.ndarray:
        sent = None if weights is None else weights.astype(np.float32)  # half of what each round ships

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = np.zeros((CLASSES * CLASSES, CLASSES))
            for b in batches:
                np.add.at(seen, (b.column(0).to_numpy(), b.column(1).to_numpy()), b.column(2).to_numpy())
            owned_here = np.flatnonzero(seen.sum(axis=1))
            total = np.zeros((HASHED, CLASSES))
            for a in range(0, len(owned_here), HISTORIES):
                mine = owned_here[a : a + HISTORIES]
                value = seen[mine]
                if sent is not None:
                    value = value.sum(axis=1, keepdims=True) * np.exp(log_softmax(sent, bias, features[:, mine]))
                for rows in features[:, mine]:
                    order = np.argsort(rows, kind="stable")
                    at = np.flatnonzero(np.diff(rows[order], prepend=-1))
                    total[rows[order][at]] += np.add.reduceat(value[order], at)
            if len(owned_here):
                yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["sums"])

        parts = owned.mapInArrow(run, "sums binary").collect()  # OWNERS tables of fixed size
        return sum((np.frombuffer(p["sums"], np.float32).astype(float).reshape(HASHED, CLASSES) for p in parts), np.zeros((HASHED, CLASSES)))

    seen = gather(None, None)
    by_class = seen.sum(axis=0) / 3 + 0.5
    bias = np.log(by_class / by_class.sum())
    share = (seen + PRIOR * np.exp(bias)) / (seen.sum(axis=1, keepdims=True) + PRIOR)
    weights = 0.4 * (np.log(share) - bias)  # a start between no feature and each alone
    for _ in range(rounds):
        expected = gather(weights, bias)
        weights += 0.5 * np.clip((seen - expected - RIDGE * weights) / (np.minimum(seen, expected) + PRIOR * np.exp(bias) + 0.1), -1.0, 1.0)
    table = np.empty((CLASSES * CLASSES, CLASSES), np.float32)
    for a in range(0, len(table), CLASSES):
        table[a : a + CLASSES] = log_softmax(weights, bias, features[:, a : a + CLASSES]) / np.log(10)
    return table


def word_tree(own: np.ndarray, weight: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, ...]:
    """Partings within the classes of endings, as ``(first, length, node, side, odds)``.

    A code's way to its leaf is ``node`` and ``side`` (0 or 1) from ``first`` on;
    ``odds`` are the nodes' log-odds of side 1 by weight alone. ``own`` is the
    class of each frequent word, ``weight`` its count plus one, ``rest`` the
    weight of all other words in each class; ties go by rank.
    """
    ways: list[tuple] = [()] * (FREQUENT + ENDINGS)
    odds: list[float] = []
    for c in range(1 + OWN, CLASSES):
        leaves = [(float(rest[c]), FREQUENT + c - 1 - OWN), *((float(weight[w]), int(w)) for w in np.flatnonzero(own == c))]
        heap = [(m, k, code) for k, (m, code) in enumerate(leaves)]
        heapify(heap)
        for k in range(len(leaves), 2 * len(leaves) - 1):
            light, heavy = heappop(heap), heappop(heap)
            heappush(heap, (light[0] + heavy[0], k, (len(odds), light[2], heavy[2])))
            odds.append(math.log(heavy[0] / light[0]))
        down = [(heap[0][2], ())]
        while down:
            at, way = down.pop()
            if isinstance(at, tuple):
                down += [(at[1 + side], (*way, 2 * at[0] + side)) for side in (0, 1)]
            else:
                ways[at] = way
    length = np.array(list(map(len, ways)))
    steps = np.array([x for way in ways for x in way], np.int64)
    return np.cumsum(length) - length, length, (steps >> 1).astype(np.int32), (steps & 1).astype(np.int8), np.array(odds, np.float32)


def word_partings(classes: np.ndarray, codes: np.ndarray, tree: tuple[np.ndarray, ...]) -> Iterator[tuple[np.ndarray, ...]]:
    """``(places, begins, rows, node, side)``: tokens of classes of endings, and from each one's begin on its partings.

    Rows are those of skip, bigram and trigram. Texts come one after the other,
    two places 0 before each one's classes and two-byte codes.
    """
    first, length, node, side, odds = tree
    u, mix = np.uint32, np.uint32(0x9E3779B1)
    marks = np.arange(1, len(odds) + 1, dtype=u) * u(0x85EBCA6B)
    marks = (marks ^ (marks >> u(15))) * u(0xC2B2AE35)
    full = np.where(classes == 0, START, np.where((codes == 0) & (classes > OWN), FREQUENT - 1 - OWN + classes.astype(np.int64), codes))
    within = np.flatnonzero((classes > OWN) & (length[full % START] > 0))
    for a in range(0, len(within), TOKENS):
        i = within[a : a + TOKENS]
        code, two, one = full[i], full[i - 2].astype(np.uint64), full[i - 1].astype(np.uint64) + np.uint64(1 << 20)
        before = [(x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) for x in (two, one, two + one * np.uint64(1 << 20))]
        times = length[code]
        ends = np.cumsum(times)
        steps = np.arange(ends[-1]) + np.repeat(first[code] - (ends - times), times)
        at = node.take(steps)
        mark = marks.take(at)
        rows = [((np.repeat((x >> np.uint64(32)).astype(u), times) ^ mark) * mix >> u(32 - WORD_BITS)).astype(np.int64) for x in before]
        yield i, ends - times, rows, at, side.take(steps)


def word_odds(weights: np.ndarray, odds: np.ndarray, rows: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    """Natural log-odds of side 1 at nodes ``at`` with these weight rows."""
    return odds.take(at) + weights.take(rows[0]) + weights.take(rows[1]) + weights.take(rows[2])


def padded(classes: pa.Array, codes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes and codes of texts behind two places 0 each, in one array each, and the texts' starts in them."""
    raw, two = [x.as_py() for x in classes], [x.as_py() for x in codes]
    size = np.array(list(map(len, raw))) + 2
    return np.frombuffer(b"".join([b"\0\0" + x for x in raw]), np.uint8), np.frombuffer(b"".join([b"\0\0\0\0" + x for x in two]), np.uint16), np.cumsum(size) - size


def fit_words(texts: DataFrame, tree: tuple[np.ndarray, ...], *, rounds: int = WORD_ROUNDS) -> np.ndarray:
    """Weights within classes, from all training texts ``(classes, codes)``.

    As many tasks as there are cores read the texts, since each returns tables
    of fixed size a round. The first round counts partings, sides 1 and those
    that the odds alone expect, for each row; the others what the weights expect.
    """
    odds = tree[4]
    texts = texts.coalesce(max(1, texts.sparkSession.sparkContext.defaultParallelism))

    def gather(weights: np.ndarray | None) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            expected, counted, any_text = np.zeros(1 << WORD_BITS), np.zeros(1 << WORD_BITS if weights is None else 0, np.int64), False
            for batch in batches:
                any_text |= batch.num_rows > 0
                for a in range(0, batch.num_rows, 512):
                    classes, codes, _ = padded(batch.column(0).slice(a, 512), batch.column(1).slice(a, 512))
                    here = np.zeros(1 << WORD_BITS, np.float32)
                    for _, _, rows, at, side in word_partings(classes, codes, tree):
                        value = 1 / (1 + np.exp(-(odds.take(at) if weights is None else word_odds(weights, odds, rows, at))))
                        for row in rows:
                            np.add.at(here, row, value)
                            if weights is None:
                                np.add.at(counted, row, side + np.int64(1 << 32))  # sides 1 below, all partings above
                    expected += here
            if any_text:
                sums = [expected] if weights is not None else [expected, counted & 0xFFFFFFFF, counted >> 32]
                parts = np.stack(sums).astype(np.float32).reshape(len(sums), PIECES, -1)
                for k in range(PIECES):
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([parts[:, k].tobytes()], pa.binary())], names=["piece", "sums"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                for k, sums in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    held[k] = held.get(k, 0.0) + np.frombuffer(sums.as_buffer(), np.float32).astype(float)
            for k, sums in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([sums.astype(np.float32).tobytes()], pa.binary())], names=["piece", "sums"])

        whole = np.zeros((3 if weights is None else 1, PIECES, (1 << WORD_BITS) // PIECES), np.float32)
        added = texts.mapInArrow(run, "piece int, sums binary").repartition("piece").mapInArrow(add, "piece int, sums binary")
        for r in added.collect():  # PIECES rows of fixed size
            whole[:, r["piece"]] = np.frombuffer(r["sums"], np.float32).reshape(len(whole), -1)
        return whole.reshape(len(whole), -1)

    expected, seen, times = gather(None)
    prior = expected / np.maximum(times, 1)
    most = PRIOR * prior + np.float32(1e-6), PRIOR * (1 - prior) + np.float32(1e-6)
    weights = np.float32(0.4) * (np.log((seen + most[0]) / (expected + most[0])) - np.log((times - seen + most[1]) / (np.maximum(times - expected, 0) + most[1])))
    for _ in range(rounds):
        expected = gather(weights)[0]
        weights += np.float32(0.5) * np.clip((seen - expected - RIDGE * weights) / (np.minimum(expected, np.maximum(times - expected, 0)) + PRIOR * prior * (1 - prior) + np.float32(0.1)), -1, 1)
    return weights


class _Codes(dict):
    """Codes of frequent words; others get a code of their ending's class."""

    def __missing__(self, word: bytes) -> int:
        return FREQUENT + ending_class(word) - 1 - OWN


def words_of(text: str | None) -> list[bytes]:
    """Words parted by ASCII white space, lower-cased in A-Z."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def count_words(texts: DataFrame) -> DataFrame:
    """``(word, n)`` partial counts of a one-column table of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return made

        for batch in batches:
            for text in batch.column(0):
                held.update(words_of(text.as_py()))
                if len(held) > COUNTED:
                    yield out()
        yield out()

    return texts.mapInArrow(run, "word string, n long")


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2) -> DataFrame:
    """Train on the documents outside the held fold and score all of them.

    The fold is the CRC-32 of the id as text (null: empty) modulo ``folds``.
    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score``, a row for each input row: tokens are the words and one end;
    ``base_score`` is their add-one unigram log10 probability, ``score`` the
    model's. All unseen words of one ending class are one outcome, so the
    outcomes' probabilities sum to one. Null and empty texts are the end alone;
    repeated rows count repeatedly; without training rows every class has the
    same probability; an empty table gives an empty one; other columns are not
    read.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "language-model")
    kind = docs.schema[id_col].dataType.simpleString()
    fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (fold == held_fold).alias("held"))

    vocabulary = space.settle(count_words(rows.filter("not held").select("text")).groupBy("word").agg(F.sum("n").alias("n")), "words")
    ends = rows.filter("not held").count()
    stats = vocabulary.agg(F.count("*").alias("words"), F.sum("n").alias("tokens")).first()
    known_tokens, distinct = (stats["tokens"] or 0) + ends, stats["words"] + (ends > 0)
    top = vocabulary.orderBy(F.desc("n"), "word").limit(FREQUENT).toArrow()
    names, times = [w.encode("utf-8", "surrogatepass") for w in top.column("word").to_pylist()], top.column("n").to_numpy()
    codes = {w: k for k, w in enumerate(names)}
    own = np.array([1 + k if k < OWN else ending_class(w) for k, w in enumerate(names)] + [0] * (FREQUENT - len(names)), np.uint8)
    class_of = np.concatenate([own, np.arange(1 + OWN, CLASSES, dtype=np.uint8)])
    log_times = np.zeros(len(class_of))
    log_times[: len(times)] = np.log10(times + 1)
    log_ends = float(np.log10(ends + 1))
    own_words = set(names[:OWN])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES, np.int64)
        for batch in batches:
            n = batch.column(1).to_numpy()
            of = np.array([0 if w in own_words else ending_class(w) for w in (t.encode() for t in batch.column(0).to_pylist())], np.int64)
            total += np.bincount(of, n + 1, CLASSES).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(total)], names=["class", "n"])

    mass = {r["class"]: r["n"] for r in vocabulary.mapInArrow(weigh, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).collect()}
    weight = np.concatenate([times + 1, np.zeros(FREQUENT - len(times), times.dtype)])
    rest = np.array([0 if c <= OWN else mass.get(c, 0) for c in range(CLASSES)]) - np.bincount(own, weight, CLASSES)
    rest = np.where(np.arange(CLASSES) > OWN, rest, 0.0) + 1.0
    log_rest, tree = np.log10(rest), word_tree(own, weight, rest)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _Codes(codes).__getitem__
        seen = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            held = batch.column(2).to_pylist()
            made: list[tuple] = []
            for k, text in enumerate(batch.column(1)):
                words = words_of(text.as_py())
                code = np.fromiter(map(of, words), np.int64, len(words))
                classes = np.append(class_of[code], 0).astype(np.uint8)
                frequent = code < FREQUENT
                logs = log_times[code]
                if not held[k]:
                    c = np.concatenate([[0, 0], classes]).astype(np.int64)
                    cells, times = np.unique((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], return_counts=True)
                    seen[cells] += times
                rare = b" ".join([words[i] for i in np.flatnonzero(~frequent)])
                known = int(frequent.sum())
                two = np.append(np.where(frequent, code, 0), 0).astype(np.uint16)
                made.append((len(words) + 1, classes.tobytes(), two.tobytes(), known + (ends > 0), float(logs.sum()) + log_ends, rare.decode("utf-8", "surrogatepass") or None))
            columns = zip(*made, strict=True) if made else [[]] * 6
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.float64(), pa.string())
            nulls = pa.nulls(len(made), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], nulls, nulls], names=encoded_names)
        cells = np.flatnonzero(seen)
        if len(cells):
            none = [pa.nulls(len(cells), t) for t in (id_type, pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.float64(), pa.string())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(cells), pa.array(seen[cells])], names=encoded_names)

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(rows.schema["doc_id"].dataType)
    encoded_names = ["doc_id", "held", "n_tokens", "classes", "codes", "known", "base", "rare", "cell", "n"]
    encoded = rows.mapInArrow(encode, f"doc_id {kind}, held boolean, n_tokens long, classes binary, codes binary, known long, base double, rare string, cell long, n long")
    encoded = space.settle(encoded.withColumn("row", F.monotonically_increasing_id()), "encoded")
    cells = space.settle(encoded.filter("cell is not null").groupBy("cell").agg(F.sum("n").alias("n")), "cells")
    documents = encoded.filter("cell is null")
    table = fit_softmax(cells)
    weights = fit_words(documents.filter("not held").select("classes", "codes"), tree)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds = tree[4]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # blocks of whole texts
                part = batch.slice(at, 512)
                classes, codes, start = padded(part.column(0), part.column(1))
                c = classes.astype(np.int64)
                logs = np.zeros(len(c))
                logs[2:] = table[c[:-2] * CLASSES + c[1:-1], c[2:]]
                logs -= np.where((codes == 0) & (c > OWN), log_rest[c], 0.0)
                for i, begins, rows, of, side in word_partings(classes, codes, tree):
                    away = word_odds(weights, odds, rows, of) * (1 - 2 * side).astype(np.float32)
                    logs[i] -= np.add.reduceat(np.log(1 + np.exp(np.minimum(away, np.float32(80)))), begins) / np.log(10)
                logs[np.concatenate([start, start + 1])] = 0.0  # the two places before a text
                yield pa.RecordBatch.from_arrays([*part.columns[2:], pa.array(np.add.reduceat(logs, start))], names=[*batch.schema.names[2:], "outer"])

    scored = documents.select("classes", "codes", "row", "doc_id", "held", "n_tokens", "known", "base")
    scored = scored.mapInArrow(score, f"row long, doc_id {kind}, held boolean, n_tokens long, known long, base double, outer double")
    rare = documents.filter("rare is not null").select("row", F.explode(F.split("rare", " ")).alias("word"))
    rare = rare.join(vocabulary, "word").groupBy("row").agg(F.sum(F.log10(F.col("n") + 1)).alias("rare_log"), F.count("*").alias("rare_known"))
    scored = scored.join(rare, "row", "left")
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    return scored.select(
        "doc_id",
        F.col("held").alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(known_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + rare_log - F.col("n_tokens") * F.log10(F.lit(float(known_tokens + distinct + 1)))).alias("base_score"),
        (F.col("outer") + rare_log).alias("score"),
    )
