"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cataloom.llm import decontaminate, html_extract, line_dedup, minhash_dedup, mixing, pieces, quality_rules, queries, suffix_dedup, token_counts, token_store, url_filter
from cataloom.llm.components import components

R = random.Random(1)
WORDS = [f"{a}{b}{c}" for a in "bdkmt" for b in "aeiou" for c in "lnrs"]
PATH = queries.tokenizer_path()


def words(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


LONG = words(30_000)
ROWS = [(1, "one two three"), (2, None), (3, ""), (None, "null key"), (1, "one two three"), (1, "same key, other text"), (5, LONG), (6, "x" * 50_000), (7, " \n\n ")]
#: Names that the operators use inside.
CLASH = "k long, r long, x long, h long, t string, n long, s string, doc long, pos int, start long, n_tokens long, mix_copy int, text2 string, id string, kept boolean"


@pytest.fixture(scope="module")
def docs(spark):
    extra = ["".join(c for c in part.split()[0]) for part in CLASH.split(",")]
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("source", F.lit("a"))
    for name, kind in zip(extra, [p.split()[1] for p in CLASH.split(",")], strict=True):
        df = df.withColumn(name, F.lit(None).cast(kind))
    return df


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.filter("false")


def library(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_token_counts(docs, nothing):
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in token_counts.token_counts(docs, PATH).collect())
    assert got == sorted((k or 0, len((t or "").encode()), len(library(t))) for k, t in ROWS)
    assert token_counts.token_counts(nothing, PATH).count() == 0


@pytest.mark.parametrize("text", ["it's they'RE 'S '", "a<|endoftext|>b <|ENDOFTEXT|>", "ÀÉ İstanbul ΣΑΣ ß", "é ́x\x1cy z w", "1234 5a6 ½", "don't!!!###$$$ foo_bar", "日本語 テキスト 👩‍👩‍👧", "\r\n\t\x0b\x0c"])
def test_pieces_are_the_library_s(text):
    ids, n = pieces.Pieces(PATH).ids([text.encode(), b"", text.encode()])
    assert ids.tolist() == library(text) * 2 and n.tolist() == [len(library(text)), 0, len(library(text))]


def test_other_tokenizers_get_whole_texts():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    texts = ["two  words\n\nand 'more", "", " lead", "x" * 300]
    path = public_tokenizers.path("byte_bpe_50k.json")
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    model = public_tokenizers.path("piece_bpe_32k.model")
    for file, ids in ((path, want), (model, sentencepiece.SentencePieceProcessor(model_file=model).encode(texts))):
        table = pieces.Pieces(file)
        assert not table.encoder.drops_space and table.lengths([t.encode() for t in texts]).tolist() == [len(x) for x in ids]
        assert table.ids([t.encode() for t in texts])[0].tolist() == sum(ids, [])
    assert pieces.Encoder(PATH).drops_space and pieces.Encoder(PATH).separate_words


def test_a_full_table_starts_anew(monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_PIECES", 50)
    monkeypatch.setattr(pieces, "KEPT_WORDS", 20)
    table = pieces.Pieces(PATH)
    for text in (words(100), LONG, words(40) + " strange0! Strange1?"):
        assert table.ids([text.encode()])[0].tolist() == library(text)


def test_token_store(docs, nothing):
    got = sorted(token_store.token_table(docs, PATH, end_id=2).collect(), key=lambda r: r["start"])
    want = sorted(ROWS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    start = 0
    for r, (k, t) in zip(got, want, strict=True):
        ids = [*library(t), 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_store.token_table(nothing, PATH, end_id=2).count() == 0


def test_keyed_access(spark, docs):
    store = token_store.write_store(docs, PATH, end_id=2)
    asked = spark.createDataFrame([(5,), (99,), (None,), (1,), (1,)], "doc_id long")
    got = token_store.read_records(token_store.locate(asked, store), store, payload=True).collect()
    assert sorted(r["k"] or 0 for r in got) == [0, 1, 1, 1, 5]
    long = next(r for r in got if r["k"] == 5)
    assert np.frombuffer(long["ids"], store.dtype).tolist() == [*library(LONG), 2]


def test_perfect_hash():
    r = np.random.default_rng(0)
    h = np.unique(r.integers(0, 2**63, 20_000).astype(np.uint64))
    levels, rest, slots = token_store.build_mph(h)
    assert sorted(slots.tolist()) == list(range(len(h)))
    # of these, five keys share their hash with another, and two with two others
    h = np.concatenate((h, h[:5], h[3:5]))
    g = r.permutation(np.arange(len(h), dtype=np.uint64) * np.uint64(2**40 + 2**32))
    mph = token_store.Mph(token_store._pack(h, g, {"record": np.arange(len(h))}))
    assert (mph.entries["record"][mph.find(h, g)] == np.arange(len(h))).all()
    assert (mph.find(h[:1000], g[1000:2000]) == -1).all()
    strange = r.integers(2**63, 2**64 - 1, 1000, dtype=np.uint64)
    assert (mph.find(strange, strange) == -1).mean() > 0.99


def test_line_dedup(spark, docs, nothing):
    rows = [(i, f" Shared Line \nown {i}\n\nshared line") for i in range(12)] + [(1, " Shared Line \nown 1\n\nshared line"), (20, None), (21, "a\n" * 200 + "shared LINE"), (22, "rare\nrare"), (None, "SHARED line")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0), r["n_lines"], r["n_dropped"], r["kept"]) for r in line_dedup.kept_lines(df, line_dedup.line_bitmaps(df, min_docs=10, keep_first=False)).collect())

    def brute(t):
        lines = (t or "").split("\n")
        keep = [x for x in lines if x.strip(" \t\n\x0b\x0c\r").lower() != "shared line"]
        return len(lines), len(lines) - len(keep), "\n".join(keep)

    assert got == sorted((k or 0, *brute(t)) for k, t in rows)
    first = {r["doc_id"]: r["kept"] for r in line_dedup.kept_lines(df, line_dedup.line_bitmaps(df, min_docs=10)).collect()}
    assert first[None] == "SHARED line" and first[0] == "own 0\n"
    assert line_dedup.kept_lines(docs, line_dedup.line_bitmaps(docs)).count() == len(ROWS)
    assert line_dedup.kept_lines(nothing, line_dedup.line_bitmaps(nothing)).count() == 0


def test_decontamination(spark, docs, nothing):
    phrase = words(20)
    items = spark.createDataFrame([(1, phrase), (2, "short ITEM"), (3, None), (4, ""), (1, phrase), (5, "never seen here")], "item_id long, text string")
    rows = [(1, f"{words(30)} {phrase} {words(5)}"), (2, " ".join(phrase.split()[2:14])), (3, " ".join(phrase.split()[3:17]).upper()), (4, "a Short-item, short item"), (5, None), (6, ""), (None, phrase), (3, words(4))]
    got = sorted(((r["doc_id"] or 0), r["n_words"], r["n_hit"], r["item_ids"]) for r in decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), items).collect())
    assert got == sorted([(1, 55, 20, ["1"]), (2, 12, 0, []), (3, 14, 14, ["1"]), (4, 5, 4, ["2"]), (5, 0, 0, []), (6, 0, 0, []), (0, 20, 20, ["1"]), (3, 4, 0, [])])
    assert {r["n_hit"] for r in decontaminate.contamination(docs, items).collect()} == {0}
    assert decontaminate.contamination(nothing, items).count() == 0
    assert {r["contaminated"] for r in decontaminate.contamination(docs, items.filter("false")).collect()} == {False}


def test_proximity(spark):
    item = "alpha beta gamma delta epsilon"
    rows = [(1, "x alpha beta gamma delta epsilon"), (2, "alpha beta gamma delta word word epsilon"), (3, "epsilon alpha")]
    index = decontaminate.build_index(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string"))
    got = {r["k"]: r["gap"] for r in decontaminate.proximity_matches(index, slop=3).collect()}
    assert got[1] == 0 and 3 not in got


def test_quality(spark, docs, nothing):
    labels = spark.createDataFrame([(1, 0), (1, 1), (5, 1), (None, 0), (7, None)], "doc_id long, quality int")
    rules = quality_rules.fit_rules(docs, labels)
    got = quality_rules.judge(docs, rules).collect()
    assert len(got) == len(ROWS) and {r["doc_id"] for r in got if r["kept"]} == {5}
    assert quality_rules.judge(nothing, rules).count() == 0
    assert quality_rules.kept(docs, rules).columns == docs.columns and quality_rules.kept(docs, rules).count() == 1


def test_rules_learn_a_threshold():
    x = {"a": np.arange(300.0), "b": np.random.default_rng(0).random(300)}
    rules = quality_rules.learn_rules(x, x["a"] > 200)
    assert len(rules) == 1 and rules[0][0].feature == "a" and 195 < rules[0][0].value < 206


def test_mixing(spark, docs, nothing):
    rows = [(i, "a" if i % 4 else "b") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, source string").withColumn("mix_order", F.lit(1))
    got = mixing.poisson_mix(df, {"a": 1.0, "b": 3.0}, seed=3)
    n = {r["source"]: r["count"] for r in got.groupBy("source").count().collect()}
    assert abs(n["b"] / (n["a"] + n["b"]) - 0.75) < 0.04 and got.columns == ["doc_id", "source", "mix_copy", "mix_order"]
    order = [r["mix_order"] for r in got.collect()]
    assert order == sorted(order)
    assert mixing.poisson_mix(df, {"a": 0.0}, seed=3).filter("source = 'a'").count() == 0
    assert mixing.poisson_mix(docs, {}, total=90).count() > 30 and mixing.poisson_mix(nothing, {}).count() == 0


def test_a_rare_source_with_a_large_target(spark):
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2, "rare").otherwise("usual").alias("source"))
    got = {r["source"]: r["count"] for r in mixing.poisson_mix(df, {"rare": 1.0, "usual": 1.0}, seed=1).groupBy("source").count().collect()}
    assert abs(got["rare"] - 15_000) < 700 and abs(got["usual"] - 15_000) < 700
    copies = mixing.poisson_mix(df, {"rare": 1.0}, seed=1).filter("source = 'rare'").groupBy("doc_id").agg(F.max("mix_copy").alias("top"), F.count("*").alias("n"), F.countDistinct("mix_copy").alias("d")).collect()
    assert len(copies) == 2 and all(r["top"] == r["n"] == r["d"] for r in copies)


@pytest.mark.parametrize("rate", [0.0, 0.3, 7.5, 1999.0, 2001.0])
def test_counts_have_the_distribution(spark, rate):
    u = spark.range(20_000).select(mixing.uniform("id").alias("u"))
    r = u.select(mixing.poisson_count(F.lit(rate), F.col("u")).alias("k")).agg(F.avg("k"), F.var_samp("k")).first()
    assert abs(r[0] - rate) <= 5 * (rate / 20_000) ** 0.5 and abs(r[1] - rate) <= 0.06 * rate


def test_mixing_with_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "a").alias("source"))
    salted = sorted(tuple(r) for r in mixing.poisson_mix(df, {"a": 2.0}).collect())
    monkeypatch.undo()
    assert salted == sorted(tuple(r) for r in mixing.poisson_mix(df, {"a": 2.0}).collect())


def test_passages(docs, nothing, spark):
    p = words(80)
    rows = [(1, p), (2, f"{words(9)} {p}"), (3, words(80)), (None, p), (4, None), (5, ""), (1, p)]
    got = {(r["doc_id"], r["begin"], r["end"], r["source"]) for r in suffix_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 0, 80, 1), (2, 9, 89, 1), (None, 0, 80, 1)}
    assert suffix_dedup.repeated_passages(docs).count() == 0 and suffix_dedup.repeated_passages(nothing).count() == 0


def passages_by_force(rows):
    where = {}
    for k, t in rows:
        w = t.split()
        for i in range(len(w) - 49):
            where.setdefault(tuple(w[i : i + 50]), set()).add(k)
    want = set()
    for k, t in rows:
        w, merged = t.split(), []
        for i in range(len(w) - 49):
            if len(where[tuple(w[i : i + 50])]) > 1:
                merged = [*merged[:-1], (merged[-1][0], i + 50)] if merged and i <= merged[-1][1] else [*merged, (i, i + 50)]
        want |= {(k, *x) for x in merged}
    return want


def test_passages_that_share_different_stretches(spark):
    r = random.Random(3)
    rows = []
    for _ in range(150):
        base = words(70).split()
        for _ in range(4):
            a, b = r.randint(0, 19), r.randint(51, 70)
            rows.append((len(rows), f"{words(25)} {' '.join(base[a:b])} {words(25)}"))
    got = suffix_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(x["doc_id"], x["begin"], x["end"]) for x in got} == passages_by_force(rows)


def test_passages_of_a_document_over_several_ranges(spark):
    base = words(50)
    fresh = [words(20) for _ in range(300)]
    rows = [(0, " ".join(f"{f} {base}" for f in fresh))]
    # each shares 12 words before the base with one of its places only, and the base in part
    rows += [(1 + j, f"{words(30)} {' '.join(fresh[15 * j].split()[-12:] + base.split()[:38])} {words(30)}") for j in range(20)]
    got = suffix_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(x["doc_id"], x["begin"], x["end"]) for x in got} == passages_by_force(rows)


def test_passages_of_a_large_group_are_asked_without_a_join(spark, monkeypatch):
    base, plans, write = words(60).split(), {}, suffix_dedup.written

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(suffix_dedup, "written", noted)
    # all have one core; its class goes over all ranges, and what two of them share differs
    rows = [(i, f"{words(25)} {' '.join(base[i % 9 : 52 + i % 8])} {words(25)}") for i in range(400)]
    got = suffix_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(x["doc_id"], x["begin"], x["end"]) for x in got} == passages_by_force(rows)
    assert "Join" not in plans["suffix-open"]


def test_passages_of_texts_without_keys_of_their_own(spark):
    p, q = words(60), words(60)
    rows = [(None, p), (None, f"{words(5)} {p}"), (7, q), (7, f"{words(5)} {q}"), (8, words(60))]
    got = suffix_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(x["doc_id"], x["begin"], x["end"], x["source"]) for x in got} == {(None, 0, 60, None), (None, 5, 65, None), (7, 0, 60, 7), (7, 5, 65, 7)}


def test_near_duplicates(spark, docs, nothing):
    base = words(200).split()
    near = base.copy()
    near[100] = "changed"
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, words(200)), (4, " ".join(base)), (5, None), (6, ""), (7, "a b"), (8, "a b"), (9, "a c"), (None, words(60))]
    got = {r["doc_id"]: (r["class_id"], r["class_size"], r["n_links"]) for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 3, 1), 2: (1, 3, 1), 4: (1, 3, 1), 3: (3, 1, 0), 5: (5, 2, 0), 6: (5, 2, 0), 7: (7, 2, 0), 8: (7, 2, 0), 9: (9, 1, 0), None: (None, 1, 0)}
    assert minhash_dedup.near_duplicates(docs).count() == len(ROWS) and minhash_dedup.near_duplicates(nothing).count() == 0
    kept = minhash_dedup.one_of_each(docs)
    # id 1 has two texts that are not alike
    assert kept.columns == docs.columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 1, 2, 5, 6, 7]


def test_classes_with_null_or_foreign_keys_keep_a_row(spark):
    a, b, c = (words(100) for _ in range(3))
    rows, want = [(None, a), (1, a), (None, b), (2, b), (None, c)], [(0, a), (0, b), (0, c)]
    for i in range(10, 20):
        # of the two texts under one id, the first belongs to a class with a lower one
        known, own, other = words(100), words(100), words(100)
        rows += [(i, known), (100 + i, known), (100 + i, own), (100 + i, other), (100 + i, other)]
        want += [(i, known), (100 + i, own), (100 + i, other)]
    kept = minhash_dedup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == sorted(want)


def test_samples_estimate_weighted_jaccard():
    r = np.random.default_rng(4)
    h = np.unique(r.integers(0, 2**63, 400).astype(np.uint64))
    wa, wb = r.choice([0.95, 1.0, 2.0, 3.0], len(h)), r.choice([0.95, 1.0, 2.0, 3.0], len(h))
    j = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    est = []
    for seed in range(30):
        s = minhash_dedup.Sampler(seed)
        a, b = (s.signatures(h, w, np.array([0, len(h)])) for w in (wa, wb))
        est.append((a == b).mean())
    assert abs(np.mean(est) - j) < 0.03


def weighted_by_force(texts):
    """All weighted Jaccard similarities of different texts, the inverse document frequency as near-dedup states it."""
    sets = {k: Counter(zip(*(t.split()[i:] for i in range(5)), strict=False)) for k, t in texts.items()}
    df = Counter(g for c in sets.values() for g in c)
    n, least = len(sets), max(minhash_dedup.FREQUENT * len(sets), 2)
    idf = {g: 1 - minhash_dedup.DAMPING * math.log(c / least) / math.log(n / least) if c >= least else 1.0 for g, c in df.items()}
    weight = lambda c: sum(idf[g] * m for g, m in c.items())
    return {(a, b): s / (weight(sets[a]) + weight(sets[b]) - s) for a in sets for b in sets if a < b for s in [weight(sets[a] & sets[b])]}


def variants(count, rate):
    """A text, versions of it that have their own word at every place with a probability up to rate, and two versions of a version."""
    r, base, out = random.Random(5), words(120).split(), {}
    for i in range(count):
        p = rate * i / count
        w = [f"own{i}x{j}" if r.random() < p else x for j, x in enumerate(base)]
        out[3 * i] = " ".join(w)
        for k in (1, 2):
            out[3 * i + k] = " ".join(f"own{i}x{j}x{k}" if r.random() < 0.02 else x for j, x in enumerate(w))
    return out


def test_classes_are_those_of_all_pairs(spark):
    texts = variants(60, 0.1) | {1000 + i: " ".join(["rep eat"] * 40 + [f"end{i}"] * (i % 3)) for i in range(9)}
    texts = {k: t for k, t in texts.items() if t not in {texts[j] for j in texts if j < k}}
    j = weighted_by_force(texts)
    root = {k: k for k in texts}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    degree = Counter()
    for (a, b), v in sorted(j.items()):
        if v >= 0.8:
            root[max(top(a), top(b))] = min(top(a), top(b))
            degree.update((a, b))
    assert 20 < len({top(k) for k in texts}) < len(texts) - 40 and min(abs(v - 0.8) for v in j.values()) > 1e-6
    got = {r["doc_id"]: r for r in minhash_dedup.near_duplicates(spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")).collect()}
    assert {k: r["class_id"] for k, r in got.items()} == {k: top(k) for k in texts}
    sizes = Counter(map(top, texts))
    assert all(r["class_size"] == sizes[top(k)] and (r["n_links"] > 0) == (degree[k] > 0) and r["n_links"] <= degree[k] for k, r in got.items())


def test_differences_tell_the_similarity():
    none = np.empty(0, np.uint64), np.empty(0)
    texts = [t.encode() for t in variants(12, 0.2).values()] + [b"a b c d e " * 9, b"a b c d e " * 8]
    sets = minhash_dedup.elements(texts, none)
    seen = Counter()
    for hub in (sets[0], sets[20], sets[-1], none):
        whole = [minhash_dedup.differences(x, hub) for x in sets]
        often = [n for n, c in Counter(n for d in whole for n in d[2].tolist()).most_common() if c > 8][::-1]
        parts = [(d[0], *minhash_dedup.prefix(*d, np.array(often, np.int64))) for d in whole]
        for i, j in itertools.combinations(range(len(sets)), 2):
            (pa, na, ta), (pb, nb, tb) = parts[i], parts[j]
            v, star = minhash_dedup.weighted_jaccard(sets[i], sets[j]), [minhash_dedup.weighted_jaccard(sets[k], hub) >= 0.8 for k in (i, j)]
            if not all(star) and v >= 0.8:
                tails = {**dict(zip(nb, tb, strict=True))}
                assert any(n in tails and pa + pb <= min(t, tails[n]) + 1e-6 for n, t in zip(na, ta, strict=True))
                seen[sum(star)] += 1
    assert seen[0] > 5 and seen[1] > 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7), (200, 150), (150, 180)]
    got = {r["v"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 180: 150, 200: 150}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_urls(spark):
    rows = [(1, "HTTP://A.Example.COM/en/7?x"), (2, None), (3, "no scheme"), (4, "https://b.example.net"), (None, "https://x.org/es/1"), (5, "http://com/en/#f"), (1, "HTTP://A.Example.COM/en/7?x")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1)).withColumn("n", F.lit(2))
    labels = spark.createDataFrame([(1, 0), (4, None)], "doc_id long, quality int")
    got = sorted((r["page_id"] or 0, r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, labels, queries.URL_RULES).collect())
    want = [(1, "a.example.com", "/en/7", "example.com/en/7", "allow")] * 2 + [(2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "b.example.net", "", None, "allow"), (0, "x.org", "/es/1", "org/es/", "block"), (5, "com", "/en/", "com/en/", "block")]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert url_filter.judge_urls(pages.filter("false"), labels, queries.URL_RULES).count() == 0


def test_bad_branch_is_rejected(spark):
    rows = [(i, f"https://h.example/{'spam' if i % 2 else 'news'}/{i}.html") for i in range(400)] + [(1000 + i, f"https://h.example/news/w{i}") for i in range(50)]
    labels = [(i, 0 if i % 2 else 1) for i in range(0, 200)]
    got = {r["page_id"]: (r["template"], r["verdict"]) for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int"), []).collect()}
    assert got[301] == ("/spam/<n>.html", "block") and got[300][1] == "allow" and got[1000] == ("/news/*", "allow")


def test_alike_branches_are_merged_with_each_other(spark):
    # two bad branches, two good ones, and one of which half is bad
    bad = {"ads": 1.0, "spam": 1.0, "news": 0.0, "blog": 0.0, "mixed": 0.5}
    rows = [(i, f"https://h.example/{list(bad)[i % 5]}/p{i}") for i in range(1000)]
    labels = [(i, int(i % 10 < 5 if list(bad)[i % 5] == "mixed" else bad[list(bad)[i % 5]] == 0.0)) for i in range(500)]
    got = {r["page_id"]: (r["template"], r["verdict"]) for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int"), []).collect()}
    assert {got[i] for i in (0, 1)} == {("/{ads|spam}/*", "block")} and {got[i] for i in (2, 3)} == {("/{blog|news}/*", "allow")} and got[4][0] == "/mixed/*"


def test_deep_and_odd_paths(spark):
    deep = "/".join(f"d{i}" for i in range(400))
    rows = [(i, f"https://h.example/{deep}/{'x' if i % 2 else 'y'}") for i in range(100)] + [(200, "https://h.example/<n>/1"), (201, "https://h.example/2024-01-02/7.html"), (202, "https://h.example/" + "z" * 100_000)]
    segs = {r[0]: r[1] for r in spark.createDataFrame(rows, "k long, url string").select("k", url_filter.typed_segments(url_filter.path_of(F.col("url")))).collect()}
    assert len(segs[0]) == 401 and segs[0][-2:] == ["d399", "y"] and segs[1][-2:] == ["d399", "x"]
    assert segs[200] == ["=<n>", "<n>"] and segs[201] == ["<date>", "<n>.html"] and segs[202] == ["z" * 100_000]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), labels, []).collect()}
    assert len(got) == len(rows) and {got[i] for i in range(0, 100, 2)} == {"block"} and {got[i] for i in range(1, 100, 2)} == {"allow"}


def test_html(spark):
    page = "<html><body><nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>Some  text,\nmore <b>bold<br>words.</p></article><footer>End</footer></body></html>"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "<p"), (1, "u", page), (4, "u", "<article>" + "<p>word word word.</p>" * 3000 + "</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("k", F.lit(1))
    net = html_extract.fit_labeller(pages)
    got = html_extract.main_text(pages, net).collect()
    assert len(got) == len(rows) and next(r for r in got if r["page_id"] == 2)["text"] == ""
    assert html_extract.main_text(pages.filter("false"), net).count() == 0
    assert [b.text for b in html_extract.blocks_of(page)] == ["Home", "A & B", "Some text, more bold words.", "End"]


def test_all_words_of_a_block_count():
    hasher, start = html_extract.Hasher(), words(12)
    assert not np.array_equal(hasher.text(f"{start} {words(40)}"), hasher.text(f"{start} {words(40)}"))


def test_gradients():
    r = np.random.default_rng(0)
    net = html_extract.Labeller.fresh(2)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x = r.standard_normal((2, 5, html_extract.PATH_DIM + html_extract.WORD_DIM + html_extract.NUMBERS)) * 0.3
    mask = np.array([[True] * 5, [True] * 3 + [False] * 2])
    y = (r.random((2, 5)) > 0.5).astype(float)
    _, g = net.gradients(x, mask, y)
    for k in ("xf", "hb", "cf", "o"):
        flat = net.w[k].ravel()
        i = int(r.integers(len(flat)))
        keep, e = flat[i], 1e-3
        flat[i] = keep + e
        up = net.gradients(x, mask, y)[0]
        flat[i] = keep - e
        down = net.gradients(x, mask, y)[0]
        flat[i] = keep
        assert abs((up - down) / (2 * e) - g[k].ravel()[i]) < 2e-3


def test_held_out_accuracy(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = [html_extract.blocks_of(r["html"]) for r in pages.orderBy("page_id").collect()]
    labels = [html_extract.weak_labels(b) for b in rows]
    r, hasher = np.random.default_rng(0), html_extract.Hasher()
    strange = [b.text for p in rows[:120] for b in p]
    xs, ys = [], []
    for b, y in zip(rows[:120], labels[:120], strict=True):
        for c, z in ((b, y), *(html_extract.variant(b, y, strange, r) for _ in range(2))):
            xs.append(hasher.page(c))
            ys.append(z)
    net = html_extract.train(xs, ys)
    found = html_extract.label_pages(net, rows[120:], hasher)
    assert np.mean(np.concatenate([a == (y > 0) for a, y in zip(found, labels[120:], strict=True)])) > 0.995
    others = [html_extract.variant(b, y, strange, r) for b, y in zip(rows[120:], labels[120:], strict=True)]
    found = html_extract.label_pages(net, [b for b, _ in others], hasher)
    assert np.mean(np.concatenate([a == (y > 0) for a, (_, y) in zip(found, others, strict=True)])) > 0.97


def test_unlisted_containers_and_notices(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()]
    known = [(b, html_extract.weak_labels(b)) for b in map(html_extract.blocks_of, pages[:150])]
    net, hasher = html_extract.fit_blocks(known), html_extract.Hasher()
    notice = '</h1><div class="gdpr">We use cookies to improve your visit. Accept all.</div>'
    replies = '<div class="replies"><p>Great read, thanks a lot for this.</p><p>I do not agree with the second part.</p></div><footer>'
    forms = {
        "div": (0.95, lambda p: p.replace("<article>", "<div>").replace("</article>", "</div>")),
        "id": (0.9, lambda p: p.replace("<article>", '<div id="body">').replace("</article>", "</div>")),
        "section": (0.95, lambda p: p.replace("<article>", "<section>").replace("</article>", "</section>")),
        "notice": (0.95, lambda p: p.replace("</h1>", notice, 1)),
        "replies": (0.95, lambda p: p.replace("<footer>", replies)),
        "list": (0.95, lambda p: p.replace("</article>", "<ul><li>First thing</li><li>Second thing</li></ul></article>")),
    }
    for name, (least, change) in forms.items():
        exact = 0
        for page in pages[150:]:
            before = html_extract.blocks_of(page)
            want = [b.text for b, y in zip(before, html_extract.weak_labels(before), strict=True) if y] + (["First thing", "Second thing"] if name == "list" else [])
            found = html_extract.blocks_of(change(page))
            exact += want == [b.text for b, y in zip(found, html_extract.label_pages(net, [found], hasher)[0], strict=True) if y]
        assert exact >= least * len(pages[150:]), (name, exact)
