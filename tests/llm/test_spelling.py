"""Spelling variants against comparing every word with every other."""

import random
import re
import zlib
from collections import Counter

import pytest

from voltloom.llm import spelling

SCHEMA = "doc_id long, text string, word string, n string, word_id string, place string"


def extra(rows):
    return [(*r, "a", "b", "c", "d") for r in rows]


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'null' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    form, count = {}, {}
    for w in n:
        others = [v for v in n if near(v, w)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        count[w] = len(others)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], count[w], None if form[w] is None else n[form[w]]))
    return sorted(out)


def rows_of(frame):
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in frame.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_against_all_pairs(spark, seed):
    r = random.Random(seed)
    stems = ["".join(r.choice("abcdeéÿ") for _ in range(r.randint(6, 9))) for _ in range(40)]
    rows = []
    for doc in range(300):
        picked = []
        for _ in range(30):
            w = stems[min(int(r.expovariate(0.2)), len(stems) - 1)]
            if r.random() < 0.2:
                i = r.randrange(len(w))
                w = r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("abcÀ×") + w[i:], w[:i] + r.choice("abé") + w[i + 1 :]])
            picked.append(w.upper() if r.random() < 0.1 else w)
        rows.append((doc, r.choice([" ", ", ", "-", "’", "1"]).join(picked)))
    rows += rows[:20]
    got = spelling.spelling_variants(spark.createDataFrame(extra(rows), SCHEMA).repartition(3))
    want = brute(rows)
    assert sum(x[1] is not None for x in want) > 20 and max(x[4] for x in want) > 3
    assert rows_of(got) == want


def test_chain_and_ties(spark):
    chain = [("aaaaaaaa", 2), ("aaaaaaab", 20), ("aaaaaabb", 200), ("aaaaabbb", 2000)]
    tied = [("zzzzzzzy", 30), ("zzzzzzzx", 30), ("zzzzzzzz", 3)]
    rows = [(None, " ".join([w] * k)) for w, k in chain + tied]
    got = rows_of(spelling.spelling_variants(spark.createDataFrame(extra(rows), SCHEMA)))
    assert got == brute(rows)
    assert {x[0]: x[2] for x in got}["aaaaaaaa"] == "aaaaabbb"


def test_odd_texts(spark):
    long = "abcdefg" * 3_000
    rows = [(1, None), (None, ""), (2, "ÀÉÎÕÜàé ÀÉÎÕÜàé Ābcdefgh Ābcdefgh ÃƒÂ©abcdef"), (3, f"{long} x {long[:-1]}q"), (3, long), (4, long[:-1] + "q"), (5, " \t\n"), (5, "abcdefg")]
    rows += rows
    got = rows_of(spelling.spelling_variants(spark.createDataFrame(extra(rows), SCHEMA)))
    assert got == brute(rows) and sum(len(x[0]) > 1000 and x[4] > 0 for x in got) >= 2
    assert spelling.spelling_variants(spark.createDataFrame([], SCHEMA)).count() == 0
