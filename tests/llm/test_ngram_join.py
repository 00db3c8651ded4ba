"""The join against all pairs, with its ways for short, long and hot lists, and edge cases."""

import os
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cataloom.llm import ngram_join as nj

SMALL = "/root/testdata/sf0.001"
R = random.Random(2)
WORDS = [f"{a}{b}{c}" for a in "bdkmtrs" for b in "aeiou" for c in "lnrs"]


def words(n, r=R):
    return [r.choice(WORDS) for _ in range(n)]


def shingled(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def expected(rows):
    """(key, size, lowest key that links reach) of each row, by all pairs."""
    sets = [shingled(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            where[g].append(i)
    for i, s in enumerate(sets):
        met = defaultdict(int)
        for g in s:
            for j in where[g]:
                if j < i:
                    met[j] += 1
        for j, shared in met.items():
            if 100 * shared >= 80 * (len(s) + len(sets[j]) - shared):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[find(i)] = min(low.get(find(i), k), k)
    return sorted(((k, len(s), low.get(find(i)) if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def got(df):
    return sorted((tuple(r) for r in nj.set_components(df).collect()), key=str)


def test_given_documents(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = expected([(r["doc_id"], r["text"]) for r in df.collect()])
    assert got(df) == want and any(k != c for k, _, c in want)


def edited(base, n, r):
    w = list(base)
    for _ in range(n):
        w[r.randrange(len(w))] = r.choice(WORDS) + str(r.randrange(1000))
    return " ".join(w)


def crowd(r, groups, members, most):
    """Groups of copies about the threshold, chains and lists that several groups share."""
    rows, shared = [], words(40, r)
    for g in range(groups):
        base = words(r.choice([30, 60, 150]), r) + shared
        now = base
        for i in range(members):
            if g % 3 == 0:  # a chain
                now = edited(now, 1, r).split(" ")
                rows.append(" ".join(now))
            else:
                rows.append(edited(base, r.randrange(most), r))
            if i % 7 == 0:
                rows.append(rows[-1])
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("short", "hot", "groups", "members"), [(64, 1000, 12, 12), (4, 1000, 5, 40), (4, 10, 5, 40), (64, 20, 4, 60)])
def test_groups_of_copies(spark, monkeypatch, short, hot, groups, members):
    monkeypatch.setattr(nj, "SHORT", short)
    monkeypatch.setattr(nj, "HOT", hot)
    rows = crowd(random.Random(short + hot), groups, members, 9)
    want = expected(rows)
    assert len({c for _, _, c in want}) > groups
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == want


def test_edges(spark):
    base = words(300)
    rows = [(None, "a b"), (1, None), (2, ""), (3, " \n"), (4, "A b"), (5, "a  B"), (6, "one"), (6, "one"), (None, " ".join(base)), (9, edited(base, 1, R)), (10, "x" * 100_000), (11, " ".join(words(20_000))), (None, "alone here"), (12, "a b c d e"), (13, "a b c d e a b c d e a b c d e")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("k", F.lit("1")).withColumn("x", F.lit(2)).withColumn("root", F.lit(3)).withColumn("n", F.lit(0))
    assert got(df) == expected(rows)
    assert got(df.filter("false")) == [] and got(df.filter("doc_id < 4")) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


def test_prefixes_bound_the_overlap():
    r = np.random.default_rng(0)
    ranks = r.integers(0, 50, 1 << nj.COUNTER_BITS).astype(np.uint16)
    for _ in range(300):
        n = int(r.integers(1, 60))
        a = r.integers(0, 2**63, n).astype(np.uint64)
        b = a.copy()
        b[: int(r.integers(0, n + 1))] = r.integers(0, 2**63, 1)
        a, b = np.unique(a), np.unique(b)
        shared = len(np.intersect1d(a, b))
        pa, pb = (nj.ordered(x, ranks)[: nj.prefix_length(len(x))] for x in (a, b))
        assert nj.most_shared(pa, len(a), pb, len(b)) >= shared
        if nj.linked(shared, len(a), len(b)):
            assert set(pa.tolist()) & set(pb.tolist())


def test_pairs_within_lists_lose_no_link():
    """Sets over a small universe: each linked pair of different roots is found in the list of some shared prefix shingle."""
    r = random.Random(4)
    sets = []
    for _ in range(60):
        base = r.sample(range(400), r.randrange(5, 40))
        for _ in range(4):
            sets.append(sorted(set(base) - set(r.sample(base, r.randrange(3))) | {r.randrange(400) for _ in range(r.randrange(3))}))
    posts = sorted((t, i, x, len(s)) for x, s in enumerate(sets) for i, t in enumerate(s[: nj.prefix_length(len(s))]))
    token, pos, x, n = (np.array(c) for c in zip(*posts, strict=True))
    a, b = nj.within_lists(token, x, n, pos, x)
    found = {frozenset(p) for p in zip(a.tolist(), b.tolist(), strict=True)}
    links = {frozenset((i, j)) for i in range(len(sets)) for j in range(i) if nj.linked(len(set(sets[i]) & set(sets[j])), len(sets[i]), len(sets[j]))}
    assert links and links <= found


def test_packed_texts_come_back_in_bounded_parts():
    texts = [b"", b"a" * 3_000_000, "wörter im Text".encode() * 10, b"b" * 3_000_000, os.urandom(500)]
    column = nj.packed(texts)
    assert column.nbytes < 100_000  # so the size of the packed column says nothing of the memory that its texts take
    parts = list(nj.unpacked(iter([pa.record_batch([column], names=["t"])]), 1 << 20))
    assert [t for _, own in parts for t in own] == texts
    assert all(batch.num_rows == len(own) for batch, own in parts) and max(sum(map(len, own)) for _, own in parts) < 5_000_000
