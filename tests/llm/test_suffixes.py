"""Sorted suffixes and what they remove, against plain strings."""

import random

import numpy as np
import pytest

from voltloom.llm import suffix_dedup, suffixes

SCHEMA = "doc_id long, text string, id string, kept string, slice_id string, spans string"


@pytest.mark.parametrize("seed", range(60))
def test_suffix_order(seed):
    r = random.Random(seed)
    letters = r.choice([b"a", b"ab", b"abc", bytes(range(256))])
    unit = bytes(r.choice(letters) for _ in range(r.randint(1, 40)))
    raw = b""
    while len(raw) < r.randint(120, 600):
        raw += unit if r.random() < 0.8 else bytes(r.choice(letters) for _ in range(r.randint(1, 5)))
    depth = r.choice([50, 50, 24, 9, 3])
    at = np.array(sorted(r.sample(range(len(raw) - depth), r.randint(1, len(raw) - depth))))
    order, begins = suffixes.sort_suffixes(np.frombuffer(raw + bytes(8), np.uint8), at, depth, shallow=r.choice([0, 1, 3]))
    found = [raw[i : i + depth] for i in at[order]]
    assert sorted(order.tolist()) == list(range(len(at)))
    assert found == sorted(raw[i : i + depth] for i in at)
    assert begins.tolist() == [i == 0 or found[i] != found[i - 1] for i in range(len(found))]


def brute(rows, length=50):
    lowest = {}
    texts = [(float("inf") if d is None else d, (t or "").encode()) for d, t in rows]
    for d, t in texts:
        for i in range(len(t) - length + 1):
            s = t[i : i + length]
            lowest[s] = min(d, lowest.get(s, d))
    out = []
    for (doc, _), (d, t) in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if lowest[t[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        spans, i = [], 0
        while i < len(t):
            j = i
            while j < len(t) and gone[j]:
                j += 1
            if j > i:
                spans.append((i, j))
            i = max(j, i + 1)
        out.append((doc, len(t), tuple(spans), bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return sorted(out, key=str)


def cut(spark, rows, parts=3, **options):
    docs = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA).repartition(parts)
    got = suffix_dedup.remove_repeats(docs, **options).collect()
    return sorted(((r["doc_id"], r["n_bytes"], tuple((s["start"], s["end"]) for s in r["spans"]), bytes(r["kept"])) for r in got), key=str)


def texts(seed, n=60):
    """Texts from few phrases, so that copies, edits and overlaps of all lengths occur."""
    r = random.Random(seed)
    phrases = ["".join(r.choice("abcdé ü") for _ in range(r.randint(5, 120))) for _ in range(12)]
    rows = []
    for doc in range(n):
        text = ""
        for _ in range(r.randint(0, 12)):
            p = r.choice(phrases)
            a = r.randint(0, len(p) // 3)
            text += p[a:] if r.random() < 0.7 else p[a:] + str(r.random())
        rows.append((r.choice([doc, doc, doc, doc // 2, None]), text))
    return rows + rows[:5]


@pytest.mark.parametrize(("seed", "slice_bytes", "hot"), [(1, 8 << 20, 1024), (2, 1500, 1024), (3, 700, 3), (4, 1, 1)])
def test_cuts_against_strings(spark, seed, slice_bytes, hot):
    rows = texts(seed)
    want = brute(rows)
    assert sum(len(x[2]) for x in want) > 30
    assert cut(spark, rows, slice_bytes=slice_bytes, hot_slices=hot) == want


def test_periodic_and_exact_limits(spark):
    base = "".join(chr(97 + i * i % 23) for i in range(200))
    rows = [(1, "a" * 500), (2, "a" * 49), (3, "a" * 50), (4, "b" + "a" * 300 + "b"), (5, "xy" * 200), (6, "yx" * 60), (7, base), (8, base[:49]), (9, base[100:150]), (10, "q" + base[20:69] + "q"), (11, base[:80] + base[80:200])]
    assert cut(spark, rows) == brute(rows)


def test_odd_texts(spark):
    long = "".join(random.Random(5).choice("abcdefgh ") for _ in range(150_000))
    rows = [(1, None), (2, ""), (3, " "), (None, "no id " * 20), (None, "no id " * 20), (-5, "minus " * 20), (4, "minus " * 21), (9, long[:60] + "é" * 40)]
    assert cut(spark, rows) == brute(rows)
    got = {r[0]: r for r in cut(spark, [(5, long), (6, long[1000:149_000] + "!"), (7, "x" + long)], slice_bytes=1 << 16)}
    assert got[5][2] == () and got[6][2] == ((0, 148_000),) and got[7][3] == b"x"
    assert cut(spark, [(1, None), (2, "")]) == brute([(1, None), (2, "")])
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
