"""Exact Jaccard self-join on word shingles with a token-group matrix.

1. Shingles are ordered by how common they are, then by hash. By the size of
   its set alone, a document can only link to one that shares one of its first
   ``n - ceil(0.8 n) + 1`` shingles, and k of a few more (its head), whichever
   order is used.
2. Equal sets are one document from here on. Documents with an equal min-hash
   are put in one group and compared; what links there is one group.
3. The matrix holds, for every group, the union of its members' heads with the
   range of their sizes. The place of a document's first shingle in a group's
   union bounds its overlap with every member; only groups whose bound reaches
   the threshold are opened, and all their members are compared.

Links inside a group need no more than a spanning set, so comparing stops as
soon as two documents are known to be connected, and no list of pairs exists.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltloom.llm.components import connected_components
from voltloom.llm.durable import Workspace, small_batches
from voltloom.llm.shingles import distinct, mix, shingle_sequences, shingle_sets

#: Threshold as a ratio of whole numbers: link when DEN * both >= NUM * either.
NUM, DEN = 80, 100
#: Min-hashes that make groups, and members of a group compared in one task.
ROUNDS, CHUNK = 4, 200
#: A head is longer by 1 / EXTRA of the set than one common shingle needs, so that more must be in common.
EXTRA = 25
#: Common shingles whose order by frequency is kept (any order is exact; the bound is on memory).
COMMON = 1 << 20
#: Shingles a task counts at a time, and bits that sift out most of those that are not common.
COUNTED, _SIEVE = 2_000_000, 1 << 22
#: Documents' ids that are broadcast to the texts at most (16 bytes each); above, a join is shuffled.
BROADCAST_IDS = 2_000_000
_SEEDS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89], np.uint64)


def needed(n: int | np.ndarray) -> int | np.ndarray:
    """Shingles that a set of n must share with any set it links to."""
    return -(-NUM * n // DEN)


def head_sizes(n: np.ndarray) -> np.ndarray:
    """Length of each set's head: k of its shingles are in the head of any set it links to.

    Of n shingles at most ``n - needed(n)`` are missing from the other set; the
    k-th of those in common is within so many and k more.
    """
    return n - needed(n) + np.minimum(1 + n // EXTRA, needed(n))


def links(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two ascending sets reach the threshold."""
    if min(len(x), len(y)) * DEN < NUM * max(len(x), len(y)):
        return False
    both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
    return DEN * both >= NUM * (len(x) + len(y) - both)


def _per_text(ufunc: np.ufunc, values: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``ufunc`` reduced over each text's values; zero for texts without any."""
    out = np.zeros(len(count), np.uint64)
    some = count > 0
    if some.any():
        out[some] = ufunc.reduceat(values, (np.cumsum(count) - count)[some])
    return out


def common_shingles(docs: DataFrame, text: str, space: Workspace, keep: int = COMMON) -> np.ndarray:
    """The most common shingles, the commonest last: counted over all documents, chunk by chunk.

    Chunks report the shingles they see more than once, equal texts counted
    once, and the counts are added: what many documents share is sure to meet
    itself in some chunk. Of these, the ``keep`` commonest are returned; of
    those about as common as the last, the ones of smallest hash.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()
        size = 0

        def flush() -> pa.RecordBatch:
            flat = np.concatenate(held) if held else np.zeros(0, np.uint64)
            held.clear(), seen.clear()
            flat.sort()
            edge = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1], [True]])) if len(flat) else np.zeros(1, np.int64)
            times = np.diff(edge)
            often = times > 1
            return pa.RecordBatch.from_arrays([pa.array(flat[edge[:-1][often]].view(np.int64)), pa.array(times[often])], names=["token", "times"])

        for batch in batches:
            for hashes, per_text in shingle_sequences(batch.column(0)):
                marks = _per_text(np.add, mix(hashes), per_text).tolist()
                fresh = np.array([m not in seen and not seen.add(m) for m in marks], bool)
                held.append(hashes[np.repeat(fresh, per_text)])
                size += len(held[-1])
                if size > COUNTED:
                    yield flush()
                    size = 0
        yield flush()

    counted = space.settle(docs.select(text).mapInArrow(count, "token long, times long").groupBy("token").agg(F.sum("times").alias("times")), "counted")
    # how many shingles are about as common, in classes of a sixteenth of a doubling (up to 1024: of one count)
    about = F.when(F.col("times") < 1024, F.col("times")).otherwise(F.floor(F.log2("times") * 16) + (1024 - 160)).cast("long")
    classes = counted.groupBy(about.alias("about")).count().orderBy(F.desc("about")).collect()  # a few thousand rows at most
    total, least, rest = 0, 0, 0
    for c in classes:
        least, rest = c["about"], keep - total
        total += c["count"]
        if total > keep:
            break
    else:
        least = 0
    top = counted.filter(about > least)
    if least:
        top = top.union(counted.filter(about == least).orderBy("token").limit(rest))
    top = top.toArrow().sort_by([("times", "ascending"), ("token", "ascending")])  # `keep` rows at most
    space.drop(counted)
    return top.column("token").to_numpy().view(np.uint64)


def digest(docs: DataFrame, id_col: str, text_col: str, common: np.ndarray, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: set size, fingerprint of the set, min-hashes and head."""
    order = np.argsort(common)
    known, rank = common[order], order.astype(np.uint32)
    names = ["doc_id", *carry, "n", "f1", "f2", "low", "head"]

    def lists(flat: np.ndarray, count: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(flat.view(np.int64)))

    def heads(flat: np.ndarray, n: np.ndarray, wanted: np.ndarray, maybe: np.ndarray) -> np.ndarray:
        """The first ``wanted`` of each set in the order: the others by hash, then the common ones by rank."""
        hot = maybe[(flat & np.uint64(len(maybe) - 1)).astype(np.int64)]
        some = np.flatnonzero(hot)
        at = np.minimum(np.searchsorted(known, flat[some]), max(0, len(known) - 1))
        hot[some] = known[at] == flat[some] if len(known) else False
        ranked = np.zeros(len(flat), np.uint32)
        if len(known):
            ranked[some] = rank[at]
        cold = np.concatenate([[0], np.cumsum(~hot)])
        edges = np.concatenate([[0], np.cumsum(n)])
        place = cold[:-1] - np.repeat(cold[edges[:-1]], n)  # among the set's others
        chosen = ~hot & (place < np.repeat(wanted, n))
        out = np.empty(int(wanted.sum()), np.uint64)
        to = np.cumsum(wanted) - wanted
        out[np.repeat(to, n)[chosen] + place[chosen]] = flat[chosen]
        others = cold[edges[1:]] - cold[edges[:-1]]
        for k in np.flatnonzero(others < wanted).tolist():
            a, b = edges[k], edges[k + 1]
            rest = flat[a:b][hot[a:b]]
            lacking = wanted[k] - others[k]
            out[to[k] + others[k] : to[k] + wanted[k]] = rest[np.argsort(ranked[a:b][hot[a:b]], kind="stable")[:lacking]]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = np.zeros(_SIEVE, bool)
        maybe[(known & np.uint64(_SIEVE - 1)).astype(np.int64)] = True
        for batch in batches:
            done = 0
            for hashes, per_text in shingle_sequences(batch.column(1)):
                flat, n = distinct(hashes, per_text)
                wanted = head_sizes(n)
                lows = np.stack([_per_text(np.minimum, mix(flat ^ seed), n) for seed in _SEEDS[:ROUNDS]], axis=1)
                made = [
                    pa.array(n, pa.int64()),
                    pa.array(_per_text(np.add, flat, n).view(np.int64)),
                    pa.array(_per_text(np.add, mix(flat ^ _SEEDS[3]), n).view(np.int64)),
                    lists(lows[n > 0].ravel(), np.where(n > 0, ROUNDS, 0)),
                    lists(heads(flat, n, wanted, maybe), wanted),
                ]
                rows = batch.slice(done, len(n))
                done += len(n)
                yield pa.RecordBatch.from_arrays([rows.column(0), *rows.columns[2:], *made], names=names)

    kinds = dict(docs.dtypes)
    carried = "".join(f", `{c}` {kinds[c]}" for c in carry)
    return docs.select(F.col(id_col).cast("long"), text_col, *carry).mapInArrow(run, f"doc_id long{carried}, n long, f1 long, f2 long, low array<long>, head array<long>")


def _grouped(batches: Iterator[pa.RecordBatch], compare: Callable[[list[int], list[int], list[np.ndarray]], list[tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
    """Feed rows (group, role, id, text), sorted by group, to ``compare`` a group at a time."""
    found: list[tuple[int, int]] = []
    now, roles, ids, sets = None, [], [], []

    def flush() -> None:
        if len(ids) > 1:
            found.extend(compare(roles, ids, sets))
        roles.clear(), ids.clear(), sets.clear()

    def out() -> pa.RecordBatch:
        a, b = zip(*found, strict=True) if found else ([], [])
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        groups, kinds, numbers = (batch.column(k).to_pylist() for k in range(3))
        for group, kind, number, shingles in zip(groups, kinds, numbers, shingle_sets(batch.column(3)), strict=True):
            if group != now:
                flush()
                now = group
            roles.append(kind)
            ids.append(number)
            sets.append(shingles)
        yield out()
    flush()
    yield out()


def compare_members(roles: list[int], ids: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning set of the links among a group's members; role 0 is compared first."""
    order = sorted(range(len(ids)), key=lambda k: (roles[k], ids[k]))
    root = {k: k for k in order}

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    found = []
    for at, k in enumerate(order):
        for j in order[:at]:
            if find(j) != find(k) and ids[j] != ids[k] and links(sets[j], sets[k]):
                root[find(k)] = find(j)
                found.append((ids[k], ids[j]))
    return found


def compare_queries(roles: list[int], ids: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """For each query (role 1) a link to the group, whose members (role 0) are connected already."""
    members = [(i, s) for r, i, s in zip(roles, ids, sets, strict=True) if r == 0]
    found = []
    for r, i, s in zip(roles, ids, sets, strict=True):
        if r:
            for j, t in members:
                if links(s, t):
                    found.append((i, j))
                    break
    return found


def _with_texts(rows: DataFrame, docs: DataFrame, id_col: str, text_col: str, space: Workspace) -> DataFrame:
    """``rows`` joined with the texts of their ``doc_id``; only those texts move."""
    rows = space.settle(rows, "openings")
    ids = space.settle(rows.select("doc_id").distinct(), "opened")
    few = ids.count() <= BROADCAST_IDS
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts = texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    return rows.join(texts, "doc_id")


def _compared(rows: DataFrame, compare: Callable[[list[int], list[int], list[np.ndarray]], list[tuple[int, int]]]) -> DataFrame:
    rows = rows.select("group", "role", "doc_id", "text").repartition("group").sortWithinPartitions("group")
    return rows.mapInArrow(lambda batches: _grouped(batches, compare), "a long, b long")


def similar_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Classes of documents connected by shingle Jaccard similarity of 0.8 or more.

    Returns ``doc_id`` (long), the columns named in ``carry``, ``n_shingles``
    and ``component_id`` (the smallest id that links lead to, itself included),
    a row for each input row. Words are lower-cased in A-Z and parted by ASCII
    white space; a text of fewer than five words is one shingle. Null texts and
    texts without words have no shingles and link with nothing; rows of a null
    id link with nothing and have a null component; repeated rows and equal
    texts share a component; an empty table gives an empty one; other columns
    are not read.
    """
    space = Workspace(docs.sparkSession, "ngram-join")
    small_batches(docs.sparkSession)
    common = common_shingles(docs, text_col, space)
    known = space.settle(digest(docs, id_col, text_col, common, carry), "digest")
    # equal sets become one document, that of the smallest id
    linked = known.filter("n > 0 and doc_id is not null")
    sets = space.settle(linked.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("first")), "sets")
    one = linked.join(sets.select(F.col("first").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "n", "low", "head")

    # groups of an equal min-hash; large ones in chunks, each with the group's first document
    lows = one.select("doc_id", F.posexplode("low").alias("round", "low")).distinct()
    groups = lows.groupBy("round", "low").agg(F.count("*").alias("size"), F.min("doc_id").alias("pivot")).filter("size > 1")
    parts = F.ceil(F.col("size") / CHUNK).cast("long")
    members = lows.join(groups, ["round", "low"]).select("round", "low", "doc_id", "pivot", parts.alias("parts"))
    placed = members.select("round", "low", "doc_id", F.lit(1).alias("role"), F.pmod(F.xxhash64("doc_id"), F.col("parts")).alias("part"))
    pivots = groups.select("round", "low", F.col("pivot").alias("doc_id"), F.lit(0).alias("role"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    keyed = placed.union(pivots).select(F.xxhash64("round", "low", "part").alias("group"), "role", "doc_id")
    near = _compared(_with_texts(keyed, docs, id_col, text_col, space), compare_members)
    stars = space.settle(connected_components(near, space), "groups")

    # the token-group matrix over the heads' shingles that more than one group has
    sizes = stars.groupBy("component").agg(F.count("*").alias("members"))
    grouped = one.join(stars.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    grouped = grouped.select("doc_id", F.coalesce("component", "doc_id").alias("of"), F.posexplode("head").alias("place", "token"))
    apart = grouped.groupBy("token").agg(F.min("of").alias("least"), F.max("of").alias("most")).filter("least <> most").select("token")
    heads = space.settle(grouped.join(space.settle(apart, "tokens"), "token"), "heads")
    # what stands before the k-th shared shingle of a head, the shared ones aside, is absent from every other group's sets
    k = F.least(1 + F.floor(F.col("n") / EXTRA), F.ceil(F.col("n") * NUM / DEN)).cast("int")
    able = heads.groupBy("doc_id").agg(F.array_sort(F.collect_set("place")).alias("places")).join(one.select("doc_id", "n").distinct(), "doc_id").withColumn("k", k)
    able = able.filter(F.size("places") >= F.col("k")).select("doc_id", "n", "k", (F.element_at("places", F.col("k")) - F.col("k") + 1).alias("absent"))
    shared = heads.join(able, "doc_id").join(sizes.withColumnRenamed("component", "of"), "of", "left")
    shared = space.settle(shared.withColumn("members", F.coalesce("members", F.lit(1).cast("long"))), "shared")
    present = (F.col("n") - F.col("absent")) * (NUM + DEN)
    matrix = shared.groupBy("token", F.col("of").alias("group"), F.col("members").alias("group_members")).agg(F.min("n").alias("n_min"), F.max("n").alias("n_max"), F.max(present - F.col("n") * NUM).alias("reach"))
    # a smaller group asks a larger one; between equals the larger id asks
    asks = (F.col("members") < F.col("group_members")) | ((F.col("members") == F.col("group_members")) & (F.col("of") > F.col("group")))
    fits = (F.col("n_max") * DEN >= F.col("n") * NUM) & (F.col("n") * DEN >= F.col("n_min") * NUM)
    # and what is not absent must suffice, on both sides
    smallest = F.greatest(F.col("n_min"), F.ceil(F.col("n") * NUM / DEN))
    fits = fits & (present >= (F.col("n") + smallest) * NUM) & (F.col("reach") >= F.col("n") * NUM)
    met = shared.join(matrix, "token").filter(asks & fits).groupBy("doc_id", "n", "k", "group", "group_members").agg(F.min("place").alias("place"), F.min("n_min").alias("n_min"), F.count("*").alias("hits"))
    bound = (F.col("n") - F.col("place")) * (NUM + DEN) >= (F.col("n") + smallest) * NUM
    asked = space.settle(met.filter(bound & (F.col("hits") >= F.col("k"))).select("doc_id", "group", F.ceil(F.col("group_members") / CHUNK).cast("long").alias("parts")), "asked")
    opened = asked.select("group", "parts").distinct()
    queries = asked.select("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(1).alias("role"), "doc_id")
    inside = one.select("doc_id").distinct().join(stars.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("group"))
    inside = inside.join(opened, "group").select("group", F.pmod(F.xxhash64("doc_id"), F.col("parts")).alias("part"), F.lit(0).alias("role"), "doc_id")
    keyed = queries.union(inside).select(F.xxhash64("group", "part").alias("group"), "role", "doc_id")
    far = _compared(_with_texts(keyed, docs, id_col, text_col, space), compare_queries)
    found = connected_components(stars.select(F.col("node").alias("a"), F.col("component").alias("b")).union(far), space)

    rows = known.select("doc_id", *carry, "n", "f1", "f2").join(sets.join(found, sets["first"] == found["node"], "left").select("f1", "f2", "n", F.coalesce("component", "first").alias("component")), ["f1", "f2", "n"], "left")
    return rows.select("doc_id", *carry, F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def drop_similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs``, that of the smallest id, of each class of similar texts.

    Where ids repeat or are null, rows are told apart by themselves: links are
    between texts, never by way of an id; of rows that share the smallest id of
    a class one stays, and a null id comes after all others. Documents without
    shingles (null, empty, only white space) are in no class and all stay; an
    empty table gives an empty one; other columns pass through.
    """
    space = Workspace(docs.sparkSession, "drop-similar")
    keyed = docs.withColumn("__id", F.col(id_col).cast("long"))
    per_id = keyed.groupBy("__id").count().agg(F.max("count").alias("most"), F.count_if(F.col("__id").isNull()).alias("nulls")).first()
    unique = (per_id["most"] or 0) <= 1 and not per_id["nulls"]
    keyed = keyed.withColumn("__row", F.col("__id")) if unique else space.settle(keyed.withColumn("__row", F.monotonically_increasing_id()), "rows")
    classes = similar_documents(keyed, id_col="__row", text_col=text_col, carry=("__id",)).filter("n_shingles > 0")
    classes = classes.select(F.col("doc_id").alias("__row"), "__id", "component_id")
    if unique:
        gone = classes.filter("__row <> component_id")
    else:
        classes = space.settle(classes, "classes")
        first = classes.groupBy("component_id").agg(F.min(F.struct(F.col("__id").isNull(), "__id", "__row")).alias("first"))
        gone = classes.join(first, "component_id").filter(F.col("__row") != F.col("first.__row"))
    gone = space.settle(gone.select("__row"), "gone")
    few = gone.count() <= BROADCAST_IDS
    return keyed.join(F.broadcast(gone) if few else gone, "__row", "left_anti").select(*[f"`{c}`" for c in docs.columns])


#: DuckDB SQL for the same rows, over the registered view ``documents``.
SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s
  FROM worded),
sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * n_both >= 80 * (p.n + q.n - n_both)),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT d.doc_id, coalesce(any_value(s.n), 0)::BIGINT AS n_shingles, min(r.y) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN reach r ON r.x = d.doc_id
GROUP BY d.doc_id
"""
