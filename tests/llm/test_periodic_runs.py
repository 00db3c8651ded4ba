"""Runs against all starts and periods, and edge cases."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cataloom.llm import periodic_runs as pr

SMALL = "/root/testdata/sf0.001"


def all_runs(w):
    """Maximal runs from the definition: for each period, stretches in which words so far apart are identical."""
    found, n = {}, len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= max(6, 4 * q) and (s, e) not in found:  # a lower period of the same stretch comes first
                found[s, e] = q
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=600, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60))
def test_short_sequences(w):
    assert pr.runs_of_words([b"w%d" % x for x in w]) == all_runs(w)


@pytest.mark.parametrize("seed", range(150))
def test_periodic_sequences(seed):
    r = random.Random(seed)
    w = []
    for _ in range(r.randrange(1, 6)):
        base = [r.randrange(r.choice([1, 2, 5, 40])) for _ in range(r.randrange(1, 12))]
        if r.random() < 0.4:
            base = base * r.randrange(1, 6) + [99]
        w += base * r.randrange(1, 9) + base[: r.randrange(len(base))] + [r.randrange(50) for _ in range(r.randrange(5))]
    assert pr.runs_of_words([b"w%d" % x for x in w]) == all_runs(w)
    if len(w) >= 6:
        names = {}
        assert pr.runs_of(np.array([names.setdefault(x, len(names)) for x in w])) == all_runs(w)


def test_grammar_derives_the_words():
    r = random.Random(5)
    for w in ([0] * 100, [r.randrange(4) for _ in range(500)], [r.randrange(200) for _ in range(150)] * 7, [0, 1]):
        names = {}
        ids = np.array([names.setdefault(x, len(names)) for x in w])
        left, right, size = pr.re_pair(ids)
        t = len(size) - len(left)

        def derived(s, left=left, right=right, t=t):
            return [s] if s < t else derived(left[s - t]) + derived(right[s - t])

        assert derived(len(size) - 1) == ids.tolist() and size[-1] == len(ids)
        assert len(left) < len(ids)
    left, _, _ = pr.re_pair(np.tile(np.arange(512), 64))
    assert len(left) < 512 + 40  # the period once, then about one rule for each doubling


def expected(k, text):
    w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if x]
    n = len(w)
    h = zlib.crc32(str(k).encode())
    if k is not None and n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = all_runs(w)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def got(df):
    return [tuple(r) for r in pr.run_digests(pr.periodic_runs(df, periodic_by_key=True)).collect()]


def test_given_documents(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = {r[0]: r[1:] for r in got(df)}
    want = {r["doc_id"]: expected(r["doc_id"], r["text"]) for r in df.collect()}
    assert found == want and any(x[0] for x in found.values())


def test_edges(spark):
    r = random.Random(1)
    long = " ".join(r.choice(["a", "bb", "cé", " d"]) for _ in range(3000)) + " x y z" * 3000 + " " + "q " * 5000
    rows = [(None, "a a a a a a a"), (1, None), (2, ""), (3, " \n\t "), (4, "a b " * 4), (5, "a b a b a b a"), (6, "one"), (6, "one"), (7, "w" * 100_000), (4, "a b " * 4), *((k, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 3) for k in range(100, 160)), (8, long[:40_000])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("k", F.lit("1")).withColumn("runs", F.lit(2)).withColumn("start", F.lit(3))
    assert sorted(got(df), key=str) == sorted([(k, *expected(k, t)) for k, t in rows], key=str)
    assert got(df.filter("false")) == []


def test_long_runs_and_repeats_are_fast():
    words = [b"%d" % i for i in range(50_000)]
    assert pr.runs_of_words(words * 4) == [(0, 200_000, 50_000)]
    assert pr.runs_of_words([b"a"] * 300_000) == [(0, 300_000, 1)]
    assert pr.runs_of_words(words + [b"-"] + words + [b"+"] + words) == []
