"""Registered queries against SQL, or against brute force over the whole smallest tables."""

import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from cataloom.llm import queries as q

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "documents benchmark pages labels".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.fixture(scope="module")
def docs(duck):
    return dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(q.tokenizer_path())


def rows(spark, name, key="doc_id"):
    return {r[key]: r for r in q.queries()[name](spark, DATA).collect()}


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = q.queries()[name](spark, DATA)
    got = sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())
    r = duck.execute(q.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    assert got == sorted(tuple(str(row[names.index(c)]) for c in sorted(names)) for row in r.fetchall())


def test_op1_counts_are_the_library_s(spark, docs, tokenizer):
    got = rows(spark, "op1_token_counts")
    assert {k: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for k, r in got.items()} == {k: (len(t.encode()), n := len(tokenizer.encode(t, add_special_tokens=False).ids), n > 2048) for k, t in docs.items()}


def test_op2_rules(spark, duck):
    got = rows(spark, "op2_url_filter", "page_id")
    for page_id, url in duck.execute("SELECT page_id, url FROM pages").fetchall():
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0].lower()
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        fits = [(h + p, v) for h, p, v in q.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=lambda x: len(x[0]), default=(None, None))
        r = got[page_id]
        assert (r["host"], r["path"], r["rule"]) == (host, path, best[0])
        assert r["verdict"] == (best[1] or ("block" if r["share"] >= 0.5 and r["labelled"] >= 5 else "allow"))


def test_op4_base_statistics(spark, docs):
    got = rows(spark, "op4_quality_rules")
    for k, t in docs.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        triples = Counter(zip(words, words[1:], words[2:], strict=False))
        hit = {i + j for i in range(len(words) - 2) if triples[tuple(words[i : i + 3])] > 1 for j in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            dup += line in seen and bool(re.search(r"[^\x20\x09-\x0D]", line))
            seen.add(line)
        failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit), failed)
        assert not (failed and r["kept"])


def test_op6_passages(spark, docs):
    where = defaultdict(set)
    words = {k: t.encode().split() for k, t in docs.items()}
    for k, w in words.items():
        for i in range(len(w) - 49):
            where[tuple(w[i : i + 50])].add(k)
    want = set()
    for k, w in words.items():
        merged = []
        for i in range(len(w) - 49):
            if len(where[tuple(w[i : i + 50])]) > 1:
                if merged and i <= merged[-1][1]:
                    merged[-1][1] = i + 50
                else:
                    merged.append([i, i + 50])
        want |= {(k, a, b) for a, b in merged}
    assert {(r["doc_id"], r["begin"], r["end"]) for r in q.queries()["op6_suffix_dedup"](spark, DATA).collect()} == want


def test_op7_is_the_library_s_ids_in_order(spark, docs, tokenizer):
    got = rows(spark, "op7_token_store")
    start = 0
    for k in sorted(docs):
        ids = [*tokenizer.encode(docs[k], add_special_tokens=False).ids, 2]
        assert (got[k]["start"], got[k]["n_tokens"], got[k]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op8_finds_every_link(spark, docs):
    got = rows(spark, "op8_near_dedup")
    sets = {}
    for k, t in docs.items():
        w = t.split()
        sets[k] = Counter(zip(*(w[i:] for i in range(5)), strict=False)) if len(w) >= 5 else Counter([tuple(w)])
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            shared = sum((sets[a] & sets[b]).values())
            j = shared / (sum(sets[a].values()) + sum(sets[b].values()) - shared)
            if docs[a] == docs[b] or j >= 0.805:  # the weights are not all 1
                assert got[a]["class_id"] == got[b]["class_id"]
    for k, r in got.items():
        assert r["class_id"] <= k and got[r["class_id"]]["class_id"] == r["class_id"]


def test_op10_keeps_articles_only(spark, duck):
    got = rows(spark, "op10_html_extraction", "page_id")
    from cataloom.llm.html_extract import blocks_of

    wrong = 0
    for page_id, page in duck.execute("SELECT page_id, html FROM pages").fetchall():
        want = "\n".join(b.text for b in blocks_of(page) if "article" in b.path)
        wrong += got[page_id]["text"] != want
        assert got[page_id]["n_chars"] == len(got[page_id]["text"])
    assert wrong <= 0.02 * len(got)


def test_pipeline(spark, docs, tokenizer):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "tokens"]
    kept = {}
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = df.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, DATA).cache()
        assert df.columns == columns
        kept[name] = [r["doc_id"] for r in df.collect()]
    q4, q3 = rows(spark, "op4_quality_rules"), rows(spark, "op3_decontamination")
    assert sorted(kept["quality"]) == sorted(k for k, r in q4.items() if r["kept"])
    assert len(set(kept["near_dedup"])) == len(kept["near_dedup"]) and set(kept["near_dedup"]) <= set(kept["quality"])
    assert sorted(kept["decontaminate"]) == sorted(k for k in kept["near_dedup"] if not q3[k]["contaminated"])
    got = corpus_pipeline.STAGES[-1][1](spark, df, DATA).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(kept["mix"])
    start = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == start and r["ids_crc32"] == zlib.crc32(np.array([*tokenizer.encode(docs[r["doc_id"]], add_special_tokens=False).ids, 2], "<u4").tobytes())
        start += r["n_tokens"]




def test_op4_rules_are_evaluated_in_order(spark):
    from cataloom.llm import quality_rules as qr

    data = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rules = qr.fit_rules(docs, spark.read.parquet(f"{data}/labels.parquet"))
    assert rules
    stats = {r["doc_id"]: r for r in qr.text_statistics(docs, key="doc_id", text="text").collect()}
    judged = qr.judge(docs, rules).collect()
    assert any(r["rule"] for r in judged) and len(judged) == len(stats)
    for r in judged:
        first = next((i for i, rule in enumerate(rules, 1) if all((stats[r["doc_id"]][c.feature] > c.value) == c.above for c in rule)), 0)
        assert (r["rule"], r["kept"]) == (first, not r["base_failed"] and first == 0)


def test_op4_rules_hold_on_unseen_documents(spark):
    """Fitted on half of the labels of sf0.1, judged by the other half; the 200 labels of half of sf0.01 are too few for all rules."""
    from cataloom.llm import quality_rules as qr

    data = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{data}/labels.parquet")
    docs = spark.read.parquet(f"{data}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    half = labels.filter("pmod(xxhash64(doc_id, 'half'), 2) = 0")
    judged = {r["doc_id"]: r for r in qr.judge(docs, qr.fit_rules(docs, half)).collect()}
    unseen = {r["doc_id"]: r["quality"] for r in labels.join(half, "doc_id", "left_anti").collect() if r["doc_id"] in judged}
    fine = [k for k, good in unseen.items() if good and not judged[k]["base_failed"]]
    bad = [k for k, good in unseen.items() if not good]
    assert sum(judged[k]["kept"] for k in fine) >= 0.98 * len(fine)
    assert sum(not judged[k]["kept"] for k in bad) >= 0.9 * len(bad)
