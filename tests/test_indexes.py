"""The stored indexes against the plain ways, and what they read."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cataloom.functions.stem import stem
from cataloom.operators import retrieve, sparse_index, vector_index
from cataloom.sources.storage import shared_dir

R = random.Random(7)
WORDS = [a + b for a in ["wafer", "saw", "etch", "laser", "probe", "test", "clean", "bond", "mask", "gas"] for b in ["", "s", "ing", "er"]]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, " ".join(R.choices(WORDS, weights=[1 / (j + 1) for j in range(len(WORDS))], k=R.randrange(1, 60)))) for i in range(3000)]
    rows += [(10_000, None), (10_001, ""), (10_002, "unique lasers"), (10_003, "THE Wafer!")]
    return spark.createDataFrame(rows, "id long, text string")


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, "wafer saws"), (2, "lasering unique probe"), (3, "nothing-known"), (4, None), (5, "wafer wafer gaser"), (6, "unique")], "query_id long, text string")


def rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "id", "score").collect())


def test_search_is_bm25(spark, texts, asked):
    index = sparse_index.build(texts, shared_dir(spark, "t"), segment_docs=64, buckets=8)
    want = retrieve.bm25(texts, asked)
    assert rows(index.search(asked)) == rows(want)
    for k in (1, 10, 100, 500):
        got = retrieve.top(index.search(asked, k), k)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, retrieve.top(want, k).select(*got.columns).collect()))
    few = texts.filter("id % 3 = 0")
    assert rows(index.search(asked, 10, allowed=few)) == rows(retrieve.bm25(few, asked, corpus=texts))
    assert rows(index.search(asked, idf=False)) == rows(retrieve.bm25(texts, asked, idf=False))


def test_pairs_of_query_and_document_are_not_shuffled(spark, texts, asked, monkeypatch):
    """The best of a filtered search: scored where a segment's blocks meet, by single documents too, and as joins find them."""
    index = sparse_index.build(texts, shared_dir(spark, "t"), segment_docs=64, buckets=8)
    few = texts.filter("id % 3 = 0").select(F.col("id").cast("int").alias("id"))
    for allowed in (few.union(few).union(spark.sql("SELECT CAST(NULL AS INT)")), None, few.filter("false")):
        want = retrieve.top(retrieve.bm25(texts if allowed is None else texts.join(allowed.distinct(), "id", "left_semi"), asked, corpus=texts), 10)
        found = index.best(asked, 10, allowed=allowed)
        columns = found.columns
        # pairs once met by id and by (query_id, id); shortlists meet by query_id
        plan = found._jdf.queryExecution().executedPlan().toString().split("MapInArrow")
        assert len(plan) == 2 and "Exchange hashpartitioning(query_id#" in plan[0] and "Exchange hashpartitioning(seg#" in plan[1] and not any("partitioning(id#" in p for p in plan)
        got = sorted(map(tuple, found.collect()))
        assert got == sorted(map(tuple, want.select(*columns).collect())) and bool(got) == (allowed is None or allowed.count() > 0)
        with monkeypatch.context() as m:
            m.setattr(sparse_index, "CELLS", 1)
            assert sorted(map(tuple, index.best(asked, 10, allowed=allowed).collect())) == got
            m.setattr(sparse_index, "BROADCAST_PAIRS", -1)
            assert sorted(map(tuple, index.best(asked, 10, allowed=allowed).collect())) == got


def test_many_terms_are_joined(spark, texts, asked, monkeypatch):
    index = sparse_index.build(texts, shared_dir(spark, "t"), segment_docs=500, buckets=4)
    monkeypatch.setattr(sparse_index, "LITERAL_TERMS", 2)
    assert rows(index.search(asked)) == rows(retrieve.bm25(texts, asked))


def test_segments_are_skipped(spark, texts):
    """Rare and frequent terms together: most segments can't reach the tenth of the rare term."""
    more = texts.union(spark.createDataFrame([(20_000 + i, "zirconium") for i in range(12)], "id long, text string"))
    index = sparse_index.build(more, shared_dir(spark, "t"), segment_docs=32, buckets=8)
    query = spark.createDataFrame([(1, "zirconium wafer")], "query_id long, text string")
    every, kept = index.segments(query, 10)
    assert kept.count() < 0.3 * every.count()
    top = retrieve.top(index.search(query, 10), 10)
    assert sorted(map(tuple, top.collect())) == sorted(map(tuple, retrieve.top(retrieve.bm25(more, query), 10).select(*top.columns).collect()))


def test_only_folders_and_row_groups_of_the_terms_are_read(spark, texts, asked):
    index = sparse_index.build(texts, shared_dir(spark, "t"), buckets=16)
    plan = index.search(asked.filter("query_id = 6"), 10)._jdf.queryExecution().executedPlan().toString()
    bucket = sparse_index._bucket(F.lit("unique"), 16)
    number = spark.range(1).select(bucket).first()[0]
    assert "bucket#" in plan and f"= {number})" in plan.split("PartitionFilters")[1].split("PushedFilters")[0].replace("IN (", "= ")
    assert "PushedFilters: [EqualTo(term,unique)" in plan.replace("IsNotNull(term), ", "") or "In(term" in plan


def test_hot_terms_have_bounded_blocks(spark):
    df = spark.range(5000).select("id", F.lit("same words here").alias("text"))
    index = sparse_index.build(df, shared_dir(spark, "t"), segment_docs=100)
    blocks = spark.read.parquet(f"{index.path}/blocks")
    assert blocks.agg(F.max("n")).first()[0] < 250 and blocks.filter("term = 'same'").count() == 50
    assert index.terms.filter("term = 'same'").first()["df"] == 5000


def test_empty_index_and_clashing_columns(spark, texts, asked):
    none = sparse_index.build(texts.filter("false"), shared_dir(spark, "t"))
    assert none.search(asked, 5).count() == 0
    odd = texts.limit(50).withColumns({c: F.lit(1) for c in ("term", "tf", "dl", "seg", "bucket", "n", "top")})
    assert rows(sparse_index.build(odd, shared_dir(spark, "t")).search(asked)) == rows(retrieve.bm25(odd.select("id", "text"), asked))


def test_stems_and_stopwords(spark, asked):
    docs = {1: "the lasers and the probes", 2: "laser testing", 3: "a mask", 4: "cleaning the mask masks"}
    analyser = sparse_index.Analyser(stems=True, stopwords=("the", "and", "a"))
    index = sparse_index.build(spark.createDataFrame(list(docs.items()), "id long, text string"), shared_dir(spark, "t"), analyser=analyser)
    words = {k: [stem(w) for w in t.split() if w not in analyser.stopwords] for k, t in docs.items()}
    query = [stem(w) for w in ["lasering", "masking"]]
    avg, want = sum(map(len, words.values())) / 4, []
    for k, ws in words.items():
        score = sum(math.log(1 + (4 - df + 0.5) / (df + 0.5)) * ws.count(q) * 2.2 / (ws.count(q) + 1.2 * (0.25 + 0.75 * len(ws) / avg)) for q in query if (df := sum(q in x for x in words.values())) and q in ws)
        want += [(9, k, round(score, 6))] if score else []
    asked = spark.createDataFrame([(9, "The lasering, and a masking")], "query_id long, text string")
    assert rows(index.search(asked)) == want and len(want) == 4


def clustered(spark, n=4000, dim=24, seed=1):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((60, dim))
    x = centres[r.integers(0, 60, n)] + 0.35 * r.standard_normal((n, dim))
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>")


def answers(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    return {q: sorted(v) for q, v in out.items()}


def test_probes_recall_and_the_exact_way(spark):
    vectors = clustered(spark)
    asked = vectors.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
    index = vector_index.build(vectors, shared_dir(spark, "v"))
    want = answers(retrieve.top(retrieve.dense(vectors, asked, 10), 10))
    assert answers(index.search(asked, 10, exact=True, probes=2)) == want
    got = answers(index.search(asked, 10, probes=8))
    recall = sum(len({i for _, i, _ in want[q]} & {i for _, i, _ in got[q]}) for q in want) / (10 * len(want))
    assert recall >= 0.95
    lists = {r["list"]: r["n"] for r in index.lists.collect()}
    assert sum(lists.values()) == 4000 and len(lists) > 40


def test_recall_on_the_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = df.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
    index = vector_index.build(df, shared_dir(spark, "v"))
    want, got = answers(retrieve.top(retrieve.dense(df, asked, 10), 10)), answers(index.search(asked, 10, probes=20))
    recall = sum(len({i for _, i, _ in want[q]} & {i for _, i, _ in got[q]}) for q in want) / sum(map(len, want.values()))
    assert recall >= 0.95
    assert answers(index.search(asked, 10, probes=3, exact=True)) == want


def test_odd_vectors(spark):
    odd = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [1.0, 1.0, 1.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0])]
    vectors = spark.createDataFrame(odd, "id long, vector array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.1]), (2, [1.0, 0.0, 0.0]), (3, None), (4, [1.0])], "query_id long, vector array<double>")
    index = vector_index.build(vectors, shared_dir(spark, "v"), lists=2)
    for k in (1, 3, 10):
        assert answers(index.search(asked, k, probes=1, exact=True)) == answers(retrieve.top(retrieve.dense(vectors, asked, k), k))
    nothing = vector_index.build(vectors.filter("false"), shared_dir(spark, "v"))
    assert nothing.search(asked, 3, exact=True).count() == 0 and nothing.search(asked, 3).count() == 0


def test_an_engine_over_indexes_answers_like_one_over_tables(spark, texts, asked, tmp_path):
    from cataloom.operators.filters import Selection
    from cataloom.operators.judge import DEFAULT_REASON, StubJudge
    from cataloom.plans.engine import Engine

    none = F.array().cast("array<int>")
    few = texts.filter("id < 300")
    firms = few.select("id", F.concat(F.lit("F"), F.col("id").cast("string")).alias("company_name"), F.array(F.when(F.col("id") % 2 == 0, "T").otherwise("J")).alias("expos"), F.lit("Japan").alias("hq_country"), none.alias("cat_l1_ids"), none.alias("cat_l2_ids"), F.array().cast("array<struct<l1_id:int,l1_name:string,children:array<struct<id:int,name:string>>>>").alias("cat_tree"))
    vectors = clustered(spark, 300, 8)
    queries = vectors.filter("id < 6").select(F.col("id").alias("query_id"), "vector")
    plain, path = Engine(firms, few, vectors), str(tmp_path / "engine")
    made = Engine.seed(firms, vectors, path, texts=few)
    assert made.health() == {"status": "ok", "count": 300} and made.taxonomy().count() == 0
    for selection in (Selection(), Selection(expo="T")):
        want, got = (sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in e.search(asked, queries, selection).collect()) for e in (plain, made))
        assert want == got and want
    # it is there already, until it is forced
    assert Engine.seed(firms.filter("id < 5"), vectors, path, texts=few).health()["count"] == 300
    assert Engine.seed(firms.filter("id < 5"), vectors, path, texts=few, force=True).health()["count"] == 5
    judged = made.search(asked, queries, client=StubJudge, limit=3)
    assert {r["position"] for r in judged.collect()} <= {1, 2, 3} and judged.filter("final_score IS NOT NULL").count() > 0
    reasons = made.explained(plain.search(asked, queries).select("query_id", "id", "rank"), asked)
    assert {r["reason"][:6] for r in reasons.collect()} == {"Shares"} and DEFAULT_REASON
    with pytest.raises(FileNotFoundError):
        Engine.open(spark, str(tmp_path / "nothing"))


def test_entities_are_seeded_by_their_chunks(spark, tmp_path):
    from cataloom.plans.engine import Engine
    from cataloom.schema import REFINED

    firms = spark.createDataFrame([(1, "Acme", "Wafer saws for fabs.", "Japan"), (2, "Beta", "", "Taiwan")], "id long, company_name string, about string, hq_country string").withColumns({"refined": F.lit(None).cast(REFINED), "hq_location": F.lit(""), "cat_l1_names": F.array(F.lit("Equipment")), "cat_l2_names": F.array().cast("array<string>"), "expos": F.array(F.lit("T")), "cat_l1_ids": F.array(F.lit(1)), "cat_l2_ids": F.array().cast("array<int>"), "cat_tree": F.array().cast("array<struct<l1_id:int,l1_name:string,children:array<struct<id:int,name:string>>>>")})
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vector array<float>")
    made = Engine.seed(firms, vectors, str(tmp_path / "e"))
    got = made.text_index.search(spark.createDataFrame([(1, "equipment saws")], "query_id long, text string")).collect()
    assert {r["id"] for r in got} == {1, 2} and max(got, key=lambda r: r["score"])["id"] == 1
