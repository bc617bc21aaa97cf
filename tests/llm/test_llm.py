"""The operators against brute force, exact round trips and held-out accuracy, and their edge cases."""

import html
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from voltloom.llm import components, durable, embedding_dedup, html_text, language_model, mixing, nearest, ngram_join, packing, registry, sharding, shingles, token_counts, toxicity

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, toxic string"
LONG = "many words here " * 9000
#: Nulls in every column, empty and very long texts, repeated rows, clashing column names.
ODD = [
    (1, "The quick brown fox jumps over the lazy dog", "en", "a", 1, "x", "y"),
    (2, None, None, None, None, None, None),
    (3, "", "en", "", 0, "x", "y"),
    (None, "no id but words", "en", "b", 1, "x", "y"),
    (4, LONG, "en", "a", 1, "x", "y"),
    (5, "  \t\n ", "en", "b", 1, "x", "y"),
    (1, "The quick brown fox jumps over the lazy dog", "en", "a", 1, "x", "y"),
    (6, "Ça İstanbul ΣΑΣ 数字 <|endoftext|> it's   é", "fr", "b", 1, "x", "y"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- op1


def test_sharding(spark, odd, empty):
    rows = registry.op1_hypergeometric_shards(spark, SF).toPandas()
    docs = documents(spark).toPandas().set_index("doc_id")
    assert sorted(rows.doc_id) == sorted(docs.index)
    sizes = rows.groupby("shard").slot.agg(["count", "min", "max", "nunique"])
    assert sizes["count"].max() - sizes["count"].min() <= 1 and (sizes["nunique"] == sizes["count"]).all() and (sizes["max"] == sizes["count"] - 1).all() and (sizes["min"] == 0).all()
    for r in rows.itertuples():
        raw = docs.text[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
    again = registry.op1_hypergeometric_shards(spark, SF).toPandas()
    assert rows.sort_values("doc_id").slot.tolist() == again.sort_values("doc_id").slot.tolist()
    dealt = sharding.shuffle_into_shards(odd, 3, rows_per_cell=2)
    assert sorted(Counter(r["shard"] for r in dealt.collect()).values()) == [2, 3, 3]
    assert sharding.shuffle_into_shards(empty, 3).count() == 0


def test_repeated_rows_are_dealt_like_others(spark):
    """Rows that are equal do not keep together: every shard has about its part of every value."""
    rows = spark.createDataFrame([(k // 1000,) for k in range(4000)], "value int").repartition(4)
    counts = Counter((r["shard"], r["value"]) for r in sharding.shuffle_into_shards(rows, 10, rows_per_cell=150).collect())
    assert sum(counts.values()) == 4000 and len(counts) == 40
    assert sum((n - 100) ** 2 / 100 for n in counts.values()) < 65  # chi-square, 27 degrees of freedom


def test_matrix_is_exact_and_uniform():
    counts, cells = np.array([5, 0, 7, 3]), np.array([4, 4, 7])
    total = np.zeros((4, 3))
    for seed in range(400):
        rows = np.array([sharding.matrix_row(counts, cells, p, seed) for p in range(4)])
        assert (rows.sum(axis=1) == counts).all() and (rows.sum(axis=0) == cells).all()
        total += rows
    assert np.abs(total / 400 - np.outer(counts, cells) / 15).max() < 0.25


# --- op2


def test_toxicity(spark, odd, empty):
    rng = random.Random(3)
    common = [f"w{k}" for k in range(300)]
    bad = ["vilezor", "vilezan", "vilepor", "scorn", "rotten"]
    rows, labels = [], []
    for k in range(900):
        toxic = k % 6 == 0
        text = rng.choices(common, k=rng.randint(30, 200)) + (rng.sample(bad, 3) if toxic else [])
        rng.shuffle(text)
        rows.append((k, " ".join(text)))
        if k < 600:
            labels.append((k, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit_on_labels(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r["toxic"] for r in toxicity.score_toxicity(docs, model).collect()}
    wrong = [k for k in range(600, 900) if got[k] != (k % 6 == 0)]
    assert len(wrong) <= 3
    assert toxicity.drop_toxic(docs, model).count() == sum(not t for t in got.values())
    scored = toxicity.score_toxicity(odd, model).collect()
    assert len(scored) == len(ODD) and not any(r["toxic"] for r in scored)
    assert toxicity.drop_toxic(odd, model).columns == odd.columns and toxicity.drop_toxic(odd, model).count() == len(ODD)
    assert toxicity.score_toxicity(empty, model).count() == 0
    nothing = toxicity.fit_on_labels(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert not any(r["toxic"] for r in toxicity.score_toxicity(odd, nothing).collect())


def test_toxicity_against_plain_sums(spark):
    """Every probability equals the chain worked out word by word, and labels that contradict each other are settled."""
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=20) + (["vilezor"] if k % 3 == 0 else []) + (["junkword"] if k % 4 == 0 else []))) for k in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = [(k, int(k % 4 != 0), int(k % 3 == 0)) for k, _ in rows]
    model = toxicity.fit_on_labels(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    # labels that contradict each other are settled for the worse, in any order of rows
    kinds = "doc_id long, quality int, toxic int"
    again = toxicity.fit_on_labels(docs.repartition(3), spark.createDataFrame([*labels, (3, 1, 0), (9, 1, 0)], kinds).repartition(5))
    worse = toxicity.fit_on_labels(docs, spark.createDataFrame([*labels, (6, 0, 0), (5, 1, 1)], kinds))
    plain = toxicity.fit_on_labels(docs, spark.createDataFrame([(k, 0 if k == 6 else q, 1 if k == 5 else t) for k, q, t in labels], kinds))
    for a, b in ((again, model), (worse, plain)):
        assert a.column == b.column and all(np.allclose(x, y) for x, y in zip(a.weights, b.weights, strict=True))
    assert not all(np.allclose(x, y) for x, y in zip(worse.weights, model.weights, strict=True) if len(x) == len(y)) or worse.column != model.column
    for r in toxicity.score_toxicity(docs, model).collect():
        found, ratios = toxicity.words_of(dict(rows)[r["doc_id"]])
        held = {int(h) for h in toxicity.features_of(found)} & model.column.keys()
        given = []
        for w in model.weights:
            z = sum(w[model.column[h]] for h in held) + sum(a * b for a, b in zip(w[len(model.column) :], [*ratios, *given, 1.0], strict=True))
            given.append(1 / (1 + math.exp(-z)))
        assert [r["p_low_quality"], r["p_toxic"]] == pytest.approx(given, abs=1e-9)
        assert r["toxic"] == (given[-1] >= 0.5) == (r["doc_id"] % 3 == 0)


def test_folds_choose_their_own_words(monkeypatch):
    """A word that only one fold has is not among those that its out-of-fold probabilities come from."""
    seen = []
    chosen = toxicity.select_words
    monkeypatch.setattr(toxicity, "select_words", lambda at, rows, n, labels: (seen.append((set(rows.tolist()), int((~np.isnan(labels)).sum()))), chosen(at, rows, n, labels))[1])
    docs = [(np.array(sorted({k % 7, 100 + k % 2}), np.uint32), (0.0, 0.0, 0.0, 0.0)) for k in range(30)]
    toxicity.train_chain(docs, np.array([[k % 2, k % 3 == 0] for k in range(30)], float), ("a", "b"))
    assert seen == [(set(range(30)), 60)] + [({k for k in range(30) if k % 3 != fold}, 40) for fold in range(3)]


# --- op3 and op10


def vectors(seed=1):
    """Clusters, copies, near copies and odd vectors."""
    rng = np.random.default_rng(seed)
    rows = [(k, rng.standard_normal(16), k % 3) for k in range(150)]
    base = rng.standard_normal(16)
    rows += [(1000 + k, base + 0.08 * rng.standard_normal(16), 0) for k in range(60)]
    rows += [(2000 + k, base, 1) for k in range(30)]
    rows += [(3000 + k, rows[k][1] * 3, k % 3) for k in range(10)]
    rows = [(i, [float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    rows += [(4000, None, 0), (4001, [0.0] * 16, 0), (4002, [math.nan] + [1.0] * 15, 0), (4003, [None] + [1.0] * 15, 0), (4004, rows[0][1], None), (4005, [1.0, 2.0], 0), (4006, [math.inf] + [1.0] * 15, 1)]
    return rows


def test_vector_dedup(spark):
    rows = vectors()
    good = {i: (np.array(v), lab) for i, v, lab in rows if lab is not None and i not in (4000, 4001, 4002, 4003, 4006)}
    near = defaultdict(set)
    for i, (v, a) in good.items():
        for j, (w, b) in good.items():
            if i < j and a == b and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
                near[i].add(j)
                near[j].add(i)
    low = {}
    for i in sorted(i for i, *_ in rows):
        if i not in low:
            todo, low[i] = [i], i
            while todo:
                for j in near[todo.pop()]:
                    if j not in low:
                        low[j] = i
                        todo.append(j)
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, kept string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == {i: (len(near[i]), low[i], low[i] == i) for i, *_ in rows}
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_blocks_count_every_link(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)
    test_vector_dedup(spark)


def test_links_with_empty_blocks_repeated_and_null_ids(spark, monkeypatch):
    """Blocks that no vector falls into change no count; rows of one id are vectors of their own; null ids link with nothing."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 1)
    rows = [(k, [1.0, 0.01 * k, 0.0], 0) for k in range(6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert [(r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df).orderBy("vec_id").collect()] == [(5, 0)] * 6
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.01], 0), (2, [1.0, 0.02], 0), (None, [1.0, 0.0], 0), (3, [0.0, 1.0], 0)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert Counter(tuple(r) for r in got) == Counter([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 0, None, True), (3, 0, 3, True)])


def test_pairs_in_a_dense_label(spark):
    """Unrelated vectors have a cosine of 0.9; pairs at 0.981 among them are all found."""
    rng = np.random.default_rng(11)
    n, dims, pairs = 8000, 64, 300
    noise = rng.standard_normal((n, dims)) / math.sqrt(dims)
    x = math.sqrt(0.9) * np.eye(dims)[0] + math.sqrt(0.1) * noise
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    other = rng.standard_normal((pairs, dims))
    other -= (other * x[:pairs]).sum(axis=1, keepdims=True) * x[:pairs]
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    x = np.vstack([x, 0.981 * x[:pairs] + math.sqrt(1 - 0.981**2) * other]).astype(np.float32)
    df = spark.createDataFrame([(k, v, 0) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r["component_id"] for r in embedding_dedup.near_duplicates(df).collect()}
    assert [got[n + k] for k in range(pairs)] == [got[k] for k in range(pairs)] and len(set(got.values())) == n


def test_nearest(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1500, 24)).astype(np.float32)
    x[:30] = x[0]
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(5000, None), (5020, [0.0] * 24), (5040, [math.nan] * 24), (None, [1.0] * 24)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    got = defaultdict(list)
    for r in nearest.nearest_by_product(df, "vec_id % 20 = 0").orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    x = x.astype(float)
    hits = 0
    for q in range(0, 1500, 20):
        score = (x * x[q]).sum(axis=1)
        best = [i for i in np.lexsort((np.arange(1500), -score)) if i != q][:20]
        assert len(got[q]) == 20 and [(-s, i) for i, s in got[q]] == sorted((-s, i) for i, s in got[q])
        assert all(abs(s - score[i]) < 1e-12 * (1 + abs(s)) for i, s in got[q])
        hits += len({i for i, _ in got[q]} & set(best))
    assert hits / (75 * 20) >= 0.9
    assert [i for i, _ in got[0]][:20] == list(range(1, 21)) and [i for i, _ in got[20]] == [*range(20)]
    assert nearest.nearest_by_product(df.limit(0), "vec_id % 20 = 0").count() == 0
    few = nearest.nearest_by_product(df.filter("vec_id < 3"), "vec_id % 20 = 0")
    assert [(r["query_id"], r["vec_id"]) for r in few.orderBy("rank").collect()] == [(0, 1), (0, 2)]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_nearest_recall_on_the_tables(spark, sf):
    """At least 0.95 of the true neighbours of every registered query, by exact search."""
    table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").toPandas()
    table = table[[v is not None and np.isfinite(np.array(v, float)).all() and np.any(v) for v in table.embedding]].drop_duplicates("vec_id").reset_index(drop=True)
    x, ids = np.stack(table.embedding.map(lambda v: np.asarray(v, float))), table.vec_id.to_numpy()
    got = registry.op10_projection_forest(spark, f"/root/testdata/{sf}").toPandas().groupby("query_id").vec_id.agg(set)
    hits = wanted = 0
    for at in np.flatnonzero(ids % 20 == 0):
        score = x @ x[at]
        order = [i for i in np.lexsort((ids, -score)) if i != at][:20]
        hits, wanted = hits + len(got[ids[at]] & set(ids[order])), wanted + len(order)
    assert hits / wanted >= 0.95


def test_forest_opens_little_of_structured_vectors():
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 32)) * 6
    x = np.repeat(centres, 100, axis=0) + rng.standard_normal((4000, 32))
    x = x[rng.permutation(len(x))]
    forest = nearest.fit_forest(x, len(x), float((x * x).sum(1).max()), leaf=64)
    assert forest.share_for(x, 20, 0.95) < 0.35


def test_nearest_in_blocks_with_repeated_ids(spark):
    rng = np.random.default_rng(6)
    rows = [(k % 300, [float(v) for v in np.float32(rng.standard_normal(8))]) for k in range(320)]
    rows += rows[:7]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = nearest.nearest_by_product(df, "vec_id % 20 = 0", k=5, recall=1.0).collect()
    parts = nearest.nearest_by_product(df, "vec_id % 20 = 0", k=5, recall=1.0, block=16).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, parts)) and {r["query_id"] for r in whole} == set(range(0, 300, 20))


# --- op4


def test_mixing(spark, odd, empty):
    docs = documents(spark)
    got = mixing.mix_to_targets(docs).toPandas()
    source = docs.select("doc_id", "source").toPandas().set_index("doc_id").source
    size = got.groupby(got.doc_id.map(source))["size"].sum().sort_index()
    total, cap = size.sum(), 3.0 * size
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(size.index)}
    target, open_ = {}, set(size.index)
    while True:  # reshare until none is above its cap
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        above = [s for s in open_ if share[s] > cap[s]]
        if not above:
            target |= share
            break
        for s in above:
            target[s] = cap[s]
            open_.discard(s)
    for s, part in got.groupby(got.doc_id.map(source)):
        assert part.target.iloc[0] == pytest.approx(target[s]) and part.taken.sum() == math.floor(part.target.iloc[0] + 1e-9)
        assert (part.taken <= 3 * part["size"]).all() and (part.source_size == size[s]).all()
    rows = mixing.mix_to_targets(odd).collect()
    assert len(rows) == len(ODD) and all(r["size"] == len(words(t)) for r in rows for i, t, *_ in ODD if i == r["doc_id"] and i != 1)
    assert sum(r["taken"] for r in rows) <= sum(r["size"] for r in rows)
    mixed = mixing.apply_mix(odd)
    assert mixed.columns == odd.columns and sum(len(words(r["text"])) for r in mixed.collect()) == pytest.approx(sum(r["taken"] for r in rows), abs=2)
    assert mixing.mix_to_targets(empty).count() == 0 and mixing.apply_mix(empty).count() == 0


def test_mix_takes_each_row_by_itself(spark):
    """Rows without an id, or with one that repeats, get their own words and no others'."""
    sizes = [1, 500, 3, 40, 1000, 7, 90, 2, 300, 12]
    rows = [(None if k % 2 else 5, " ".join(f"t{k}w{i}" for i in range(n)), "abc"[k % 3]) for k, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter()
    for r in mixing.apply_mix(df).collect():
        got[int(r["text"].split("w")[0][1:])] += len(words(r["text"]))
    decided = Counter({(r["doc_id"], r["size"]): r["taken"] for r in mixing.mix_to_targets(df).collect()})
    want = {k: decided[None if k % 2 else 5, n] for k, n in enumerate(sizes)}
    assert got == Counter({k: n for k, n in want.items() if n}) and all(got[k] <= 3 * n for k, n in enumerate(sizes))


# --- op5


def test_language_model(spark, odd, empty):
    docs = documents(spark, "/root/testdata/sf0.01")
    got = language_model.score_texts(docs).toPandas().set_index("doc_id")
    texts = docs.select("doc_id", "text").toPandas().set_index("doc_id").text
    tokens = {i: [*(t or "").encode().lower().split(), b" end"] for i, t in texts.items()}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(w for i in train for w in tokens[i])
    n, v = sum(count.values()), len(count)
    assert set(got.index[~got.held_out]) == set(train) and (got.train_tokens == n).all()
    for i, t in tokens.items():
        assert got.n_tokens[i] == len(t) and got.n_known[i] == sum(count[w] > 0 for w in t)
        assert got.base_score[i] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), rel=1e-9)
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum() + 0.1 * held.n_tokens.sum() and (held.score > held.base_score).mean() > 0.9
    assert language_model.score_texts(odd).count() == len(ODD) and language_model.score_texts(empty).count() == 0


def test_scores_against_a_plain_model(spark):
    """Counts, gradients and scores worked out history by history give the same log-probabilities."""
    lm, rng = language_model, random.Random(12)
    names = ["the", "of", "a", "river", "stone", "Walking", "talking", "x", "yz", "über"]
    docs = [(k, " ".join(rng.choices(names, weights=range(len(names), 0, -1), k=rng.randrange(0, 12)))) for k in range(60)] + [(60, None), (61, "never seen words")]
    split = {k: lm.words_of(t) for k, t in docs}
    held = {k for k, _ in docs if zlib.crc32(str(k).encode()) % 7 == 2}
    counts = Counter(w for k, ws in split.items() if k not in held for w in ws)
    order = sorted(counts, key=lambda w: (-counts[w], w.decode()))
    own = {w: 1 + k for k, w in enumerate(order[: lm.OWN])}

    def class_of(w):
        return own.get(w) or lm.ending_class(w)

    ends, mass = len(docs) - len(held), Counter()
    for w, n in counts.items():
        if w not in own:
            mass[class_of(w)] += n + 1
    rows_of = lm.feature_rows().T
    seen = Counter()
    for k, ws in split.items():
        c = [0, 0, *map(class_of, ws), 0]
        if k not in held:
            seen.update(((x, y), z) for x, y, z in zip(c, c[1:], c[2:], strict=False))
    observed = np.zeros((lm.HASHED, lm.CLASSES))
    for ((x, y), z), n in seen.items():
        for r in rows_of[x * lm.CLASSES + y]:
            observed[r, z] += n
    share = observed.sum(axis=0) / 3 + 0.5
    bias = np.log(share / share.sum())
    weights = 0.4 * (np.log((observed + lm.PRIOR * np.exp(bias)) / (observed.sum(axis=1, keepdims=True) + lm.PRIOR)) - bias)

    def logs(x, y):
        z = bias + sum(weights[r] for r in rows_of[x * lm.CLASSES + y])
        return z - z.max() - np.log(np.exp(z - z.max()).sum())

    for _ in range(lm.ROUNDS):
        expected = np.zeros_like(observed)
        for h in {h for h, _ in seen}:
            times = sum(n for (g, _), n in seen.items() if g == h)
            for r in rows_of[h[0] * lm.CLASSES + h[1]]:
                expected[r] += times * np.exp(logs(*h))
        weights += 0.5 * np.clip((observed - expected - lm.RIDGE * weights) / (np.minimum(observed, expected) + lm.PRIOR * np.exp(bias) + 0.1), -1.0, 1.0)
    tokens, distinct = sum(counts.values()) + ends, len(counts) + 1
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for r in lm.score_texts(frame).collect():
        ws = split[r["doc_id"]]
        c = [0, 0, *map(class_of, ws), 0]
        model = sum(logs(x, y)[z] / math.log(10) for x, y, z in zip(c, c[1:], c[2:], strict=False))
        model += sum(math.log10((counts[w] + 1) / (mass[class_of(w)] + 1)) for w in ws if w not in own)
        base = sum(math.log10((counts[w] + 1) / (tokens + distinct + 1)) for w in ws) + math.log10((ends + 1) / (tokens + distinct + 1))
        assert r["held_out"] == (r["doc_id"] in held) and r["base_score"] == pytest.approx(base, abs=1e-9)
        assert r["score"] == pytest.approx(model, abs=2e-3 * (1 + len(ws)))


def test_softmax_sums_to_one(spark):
    rng = np.random.default_rng(2)
    cells = spark.createDataFrame([(int(c), int(n)) for c, n in zip(rng.integers(0, language_model.CLASSES**3, 500), rng.integers(1, 9, 500), strict=True)], "cell long, n long")
    table = language_model.fit_softmax(cells, rounds=2)
    assert np.allclose((10.0 ** table[::977].astype(float)).sum(axis=1), 1, atol=1e-4)


def test_model_is_not_shrunk():
    assert language_model.CLASSES >= 160 and language_model.ROUNDS >= 6
    rows = language_model.feature_rows()
    assert rows.shape == (3, language_model.CLASSES**2) and language_model.ending_class(b"word") < language_model.CLASSES


def test_words_within_a_class_follow_the_words_before(spark):
    """Pairs of words that are no classes of their own and share one ending: only features within the class tell the pairs apart."""
    lm, rng = language_model, random.Random(5)
    fill = [f"f{k}" for k in range(lm.OWN)]
    first, second = [f"a{k}xx" for k in range(8)], [f"b{k}xx" for k in range(8)]
    docs = []
    for k in range(900):
        i = rng.randrange(8)
        docs.append((k, " ".join([*rng.choices(fill, k=12), first[i], second[i], *rng.choices(fill, k=12)])))
    held = [k for k in range(900, 9000) if zlib.crc32(str(k).encode()) % 7 == 2][:64]
    pairs = {k: divmod(j, 8) for j, k in enumerate(held)}
    docs += [(k, f"f0 f1 {first[i]} {second[j]} f0") for k, (i, j) in pairs.items()]
    got = {r["doc_id"]: r["score"] for r in lm.score_texts(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    for i in range(8):
        seen = next(got[k] for k, p in pairs.items() if p == (i, i))
        assert all(seen > got[k] + 0.3 for k, p in pairs.items() if p[0] == i != p[1])


def test_partings_within_classes(spark):
    """Leaves of every class sum to one whatever the weights and the words before; without weights a word has its share; blocks do not matter."""
    lm, rng = language_model, np.random.default_rng(4)
    own = np.zeros(lm.FREQUENT, np.uint8)
    own[:300] = np.concatenate([np.arange(1, lm.OWN + 1), rng.integers(1 + lm.OWN, 1 + lm.OWN + 5, 300 - lm.OWN)])
    weight, rest = np.where(own > 0, rng.integers(2, 10**9, lm.FREQUENT), 0), rng.integers(1, 99, lm.CLASSES).astype(float)
    tree = lm.word_tree(own, weight, rest)
    weights = rng.normal(0, 2, 1 << lm.WORD_BITS).astype(np.float32)
    for c in range(1 + lm.OWN, 1 + lm.OWN + 6):
        words = np.flatnonzero(own == c)
        classes = np.array([x for _ in range(len(words) + 1) for x in (0, 0, 120, c)], np.uint8)
        codes = np.array([x for w in (0, *words) for x in (0, 0, 0, w)], np.uint16)
        share = np.append(rest[c], weight[words]) / (rest[c] + weight[words].sum())
        for used in (weights, weights * 0):
            p = np.ones(len(words) + 1)
            for i, begins, rows, at, side in lm.word_partings(classes, codes, tree):
                odds = lm.word_odds(used, tree[4], rows, at).astype(float)
                p[i // 4] *= np.multiply.reduceat(1 / (1 + np.exp(odds * (1 - 2.0 * side))), begins)
            assert p.sum() == pytest.approx(1, abs=1e-4)
            assert used.any() or p == pytest.approx(share, rel=1e-4)
    texts = [(bytearray(rng.integers(1, lm.CLASSES, n).astype(np.uint8).tobytes() + b"\0"),) for n in rng.integers(0, 40, 60)]
    coded = [(c, bytearray(np.array([rng.choice(np.flatnonzero(own == x)) if x and (own == x).any() and rng.random() < 0.9 else 0 for x in c], np.uint16).tobytes())) for (c,) in texts]
    frame = spark.createDataFrame(coded, "classes binary, codes binary")
    whole = lm.fit_words(frame.repartition(1), tree)
    assert np.isfinite(whole).all() and np.abs(whole).max() > 0.1
    assert np.allclose(whole, lm.fit_words(frame.repartition(5), tree), atol=1e-3)
    assert not lm.fit_words(frame.limit(0), tree).any()


def test_histories_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    cells = spark.createDataFrame([(int(c), int(n)) for c, n in zip(rng.integers(0, language_model.CLASSES**3, 300), rng.integers(1, 9, 300), strict=True)], "cell long, n long")
    whole = language_model.fit_softmax(cells, rounds=2)
    monkeypatch.setattr(language_model, "HISTORIES", 7)
    assert np.allclose(whole, language_model.fit_softmax(cells, rounds=2), atol=1e-4)


# --- op6


def test_main_text(spark):
    page = (
        '<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href="/a>b">menu</a></li></ul></nav><div class="cookie-notice">Cookies &amp; more text than anyone reads in a day</div>'
        '<article><h1>Head</h1><!-- c --><p>One\n two &eacute;&nbsp;<b>x</b><br>y<p>short</p><script>var a="</p>";</script><div class="ad">Buy</div><form>f<input></form></article>'
        '<aside>side</aside><section id="comments"><p>reader</p></section><footer>&copy; end</footer></body></html>'
    )
    assert html_text.main_text(page) == "Head\nOne two é x\ny\nshort"
    body = "<div id=nav><a href=x>home</a></div><div class='has-sidebar'><p>" + "plain words " * 20 + "</p><p>tiny</p><p>" + "more words " * 20 + "</p></div><div class=footer>end</div>"
    assert html_text.main_text(body) == "\n".join([("plain words " * 20).strip(), "tiny", ("more words " * 20).strip()])
    rows = [(1, "u", page, "x"), (2, None, None, "x"), (3, "u", "", "x"), (None, "u", "<p>" + "word " * 50000, "x"), (1, "u", page, "x"), (4, "u", "<nav>only</nav>", "x")]
    got = html_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [r["n_chars"] for r in got] == [len(r["text"]) for r in got] and [r["text"] for r in got][1:3] == ["", ""] and got[3]["n_chars"] == 50000 * 5 - 1 and got[5]["text"] == ""
    assert html_text.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def article_lines(page):
    """The blocks inside a page's article element, by splitting at block tags."""
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"<(?:/?(?:p|h\d|br|li|ul|ol|div|table|tr|td|section|blockquote)\b)[^>]*>", inside)
    return [t for t in (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks) if t]


def test_articles_of_the_table(spark):
    """On the table's pages the text is the article, and with their names taken away the windows still find it."""
    pages = [r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect()]
    more = found = 0
    for page in pages:
        wanted = article_lines(page)
        assert html_text.main_text(page) == "\n".join(wanted)
        bare = re.sub(r"<head>.*?</head>", "", page, flags=re.S)
        bare = re.sub(r"<(/?)(?:article|main|nav|footer|aside|header)\b[^>]*>", r"<\1div>", re.sub(r'\s(?:class|id|role)="[^"]*"', "", bare))
        if sum(map(len, wanted)) < html_text.SURGE:
            continue  # without names, less text than a surge is nobody's article
        got = html_text.main_text(bare).split("\n")
        assert not Counter(wanted) - Counter(got)
        found += len(wanted)
        more += sum((Counter(got) - Counter(wanted)).values())
    assert more <= len(pages) and more < 0.15 * found


def test_windows_decide_and_names_only_weigh():
    long, line = "running text of the page " * 40, ("running text of the page " * 40).strip()
    assert html_text.main_text(f'<div><p class="register">{long}</p><p>{long}</p></div>') == f"{line}\n{line}"
    assert html_text.main_text(f'<div id="toc-legal">Contents</div><div><p>{long}</p></div>') == line
    links = "<nav><ul>" + '<li><a href="x">link</a></li>' * 5 + "</ul></nav>"
    assert html_text.main_text(f"<article><h1>H</h1>{links}<p>{long}</p>{links}<p>End.</p></article><p>beside</p>") == f"H\n{line}\nEnd."
    assert html_text.main_text(f"<div>stray</div><div><h1>Head</h1><p>{long}</p><p>End</p></div><div>stray</div>") == f"Head\n{line}\nEnd"
    assert html_text.main_text(f"<article><p>{long}</p></article><div>{'unmarked words ' * 20}</div>") == line


def test_minor_parts_stay():
    """A short part after a long one and a list of links is text of the page all the same."""
    links = "<ul>" + "<li><a href=x>link</a></li>" * 4 + "</ul>"
    long, short, late = ("plain words " * 170).strip(), ("short part " * 14).strip(), ("late part " * 12).strip()
    page = f"<div id=content><p>{long}</p>{links}<p>{short}</p>{links}<p>{late}</p></div>"
    assert html_text.main_text(page) == "\n".join([long, short, late])


# --- op7 and op9


def test_curve_is_hilbert():
    for dims, bits in ((2, 4), (3, 3)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = packing.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells))) and set(np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1)) == {1}


def library_ids(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(VOCABULARY).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check_packing(pieces, docs):
    want = {k: [*ids, 1] for k, ids in zip(docs, library_ids(docs.values()), strict=True)}
    filled, parts = defaultdict(list), defaultdict(list)
    for r in pieces:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert ids == want[r["doc_id"]][r["start"] : r["start"] + r["length"]] and r["doc_tokens"] == len(want[r["doc_id"]])
        parts[r["doc_id"]] += range(r["start"], r["start"] + r["length"])
        filled[r["sequence_id"]] += range(r["offset"], r["offset"] + r["length"])
    assert {k: sorted(v) for k, v in parts.items()} == {k: list(range(len(v))) for k, v in want.items()}
    assert all(sorted(v) == list(range(len(v))) and len(v) <= 2048 for v in filled.values())
    assert sum(len(v) < 2048 for v in filled.values()) <= 1


def test_packing(spark, odd, empty):
    docs = documents(spark)
    check_packing(packing.pack_along_curve(docs, VOCABULARY).collect(), dict(docs.select("doc_id", "text").collect()))
    distinct = odd.dropDuplicates(["doc_id"])
    check_packing(packing.pack_along_curve(distinct, VOCABULARY).collect(), dict(distinct.select("doc_id", "text").collect()))
    assert packing.pack_along_curve(odd, VOCABULARY).filter("doc_id = 1").count() >= 2
    assert packing.pack_along_curve(empty, VOCABULARY).count() == 0


def test_token_counts(spark, odd, empty):
    docs = documents(spark).select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in registry.op9_bpe_token_counts(spark, SF).collect()}
    for (k, text), ids in zip(docs, library_ids([t for _, t in docs]), strict=True):
        assert (got[k]["n_tokens"], got[k]["n_bytes"], got[k]["over_limit"]) == (len(ids), len(text.encode()), len(ids) > 2048)
    counted = token_counts.bpe_token_counts(odd, VOCABULARY).collect()
    assert [r["n_tokens"] for r in counted] == [len(ids) for ids in library_ids([t for _, t, *_ in ODD])]
    assert token_counts.bpe_token_counts(empty, VOCABULARY).count() == 0


def test_token_counts_of_random_texts():
    rng = random.Random(4)
    alphabet = "abcXYZ019'\"-_ \t\n.,ßéÉñßæŁż–€'sİΣ中あ́  " + "the in er "
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(400)] + ["<|endoftext|>x<|startoftext|><|endoftext|", "a" * 3000, "Don'T WE'LL'S"]
    count, encode = token_counts.MergeCounter(VOCABULARY).count, packing.WordEncoder(VOCABULARY).encode
    ids = library_ids(texts)
    assert [count(t) for t in texts] == list(map(len, ids))
    assert [np.frombuffer(encode(t), "<u2").tolist() for t in texts] == ids


# --- op8


def shingle_set(text):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = words(w)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    """Smallest reachable id of each id, by comparing every pair."""
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, set()).add(frozenset(shingle_set(t)))
    low = {i: i for i in sets}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and any(a and b and 100 * len(a & b) >= 80 * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = sorted((find(i), find(j)))
                low[b] = a
    return {i: find(i) for i in sets}


def similar_rows():
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = rng.choices(vocabulary, k=70)
    rows = []
    base = rng.choices(vocabulary, k=160)
    for k in range(60):  # a large group of near copies
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((k, " ".join(w)))
    rows += [(100 + k, " ".join(rng.choices(vocabulary, k=100) + passage)) for k in range(40)]  # a passage that many share
    rows += [(200 + k, " ".join(base).upper()) for k in range(20)]  # copies in another case
    rows += [(300 + k, " ".join(base[: 150 - 6 * k])) for k in range(8)]  # a chain of ever shorter texts
    rows += [(400, "one two three"), (401, "One  two three"), (402, "one two"), (403, ""), (404, None), (405, "  "), (406, "ONE"), (407, "one")]
    return rows


def test_similar_documents(spark, odd, empty):
    rows = similar_rows()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_documents(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int")).collect()}
    low = brute_components(rows)
    assert got == {i: (len(shingle_set(t)), low[i]) for i, t in rows}
    got = ngram_join.similar_documents(odd).collect()
    assert len(got) == len(ODD) and {r["component_id"] for r in got} == {1, 2, 3, 4, 5, 6, None}
    assert ngram_join.similar_documents(empty).count() == 0


def test_groups_in_chunks(spark, monkeypatch):
    """Large groups are compared in parts, and what min-hashes miss is found through the matrix."""
    monkeypatch.setattr(ngram_join, "CHUNK", 7)
    monkeypatch.setattr(ngram_join, "ROUNDS", 1)
    rows = similar_rows()
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_drop_similar(spark, odd):
    rows = similar_rows()
    kept = {r["doc_id"] for r in ngram_join.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {i for i, low in brute_components(rows).items() if i == low}
    assert Counter(r["doc_id"] for r in ngram_join.drop_similar(odd).collect()) == Counter({i: 1 for i, *_ in ODD})


def test_shingle_hashes_tell_sets_apart():
    texts = [t for _, t in similar_rows()] + ["a b c d e", "a b c d e f", "ab c d e", None]
    sets = [set(s.tolist()) for s in shingles.shingle_sets(pa.array(texts, pa.string()))]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert len(sets[i] & sets[j]) == len(shingle_set(a) & shingle_set(b))


def test_shingles_over_segments(monkeypatch):
    """Wherever texts are cut for hashing, the hashes are the same; long words too."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab  c\t") for _ in range(rng.randrange(0, 300))) for _ in range(60)] + [None, "", " ", "x" * 64, "y" * 65, "a " + "z" * 200, "z" * 200 + " a b"]
    words_in = {w for t in texts for w in words(t)}
    monkeypatch.setattr(shingles, "_SEGMENT", 64)
    cut = [s.tolist() for s in shingles.shingle_sets(pa.array(texts, pa.string()))]
    alone = [next(iter(shingles.shingle_sets(pa.array([t], pa.string())))).tolist() for t in texts]
    assert cut == alone == [s.tolist() for s in shingles.shingle_sets(pa.array(["no", *texts], pa.string()).slice(1))]
    by_word = {w: next(iter(shingles.shingle_sets(pa.array([w.upper()], pa.string())))).tolist() for w in words_in}
    assert len({v[0] for v in by_word.values()}) == len(words_in)
    for t, got in zip(texts, cut, strict=True):
        assert len(got) == len(shingle_set(t))


def test_more_common_shingles_than_kept(spark):
    """The commonest are kept, the commonest of them last, however many are as common as each other."""
    texts = ["a b c d e f g h"] * 3 + [f"a b c d e f g h {k} x{k}" for k in range(5)] + [f"p q r s t u v w {k}" for k in range(3)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    space = durable.Workspace(spark, "t")
    every = ngram_join.common_shingles(docs, "text", space, 100)
    few = ngram_join.common_shingles(docs, "text", space, 6)
    assert len(few) == 6 and set(few[-4:]) == set(every[-4:])
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.similar_documents(docs).collect()} == brute_components(list(enumerate(texts)))


def test_drop_similar_tells_rows_of_one_id_apart(spark):
    a, b = "one two three four five six seven", "quite another text of some more words than that"
    rows = [(1, a), (1, b), (2, a), (None, b), (None, "alone with no id at all here"), (3, None), (3, "")]
    kept = ngram_join.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(tuple(r) for r in kept) == Counter([(1, a), (1, b), (None, "alone with no id at all here"), (3, None), (3, "")])


# --- shared


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)] + [(2000, 2000 + k) for k in range(1, 50)]
    low = {i: i for e in edges for i in e}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        low[b] = a
    got = dict(components.connected_components(spark.createDataFrame(edges, "a long, b long"), durable.Workspace(spark, "t")).collect())
    assert all(got.get(i, i) == find(i) for i in low) and len(set(got)) == len(got)


def test_pipeline(spark):
    import corpus_pipeline

    docs, names = documents(spark), [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_jaccard_join", "mixing", "packing"]
    after = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, after = after, durable.Workspace(spark, "t").settle(stage(spark, after, SF), name)
        assert after.columns == docs.columns
        if name == "ngram_jaccard_join":
            rows = before.select("doc_id", "text").collect()
            assert sorted(r["doc_id"] for r in after.collect()) == sorted(i for i, low in brute_components(rows).items() if i == low)
    check = after.withColumn("n", F.char_length("text")).filter("n <> n_chars").count()
    assert check == 0
    total = corpus_pipeline.run(spark, SF).agg(F.sum("length")).first()[0]
    assert total == sum(len(ids) + 1 for ids in library_ids([r["text"] for r in after.select("text").collect()]))
