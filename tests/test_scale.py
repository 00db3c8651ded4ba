"""Results that must not depend on the number or order of rows, and plans that must not grow faster than their input."""

import math

from pyspark.sql import functions as F

from cataloom.operators import html, nodes, report, resolve, retrieve


def test_mean_doesnt_depend_on_the_order_of_rows(spark):
    values = [89.83, 63.27, 54.91, 5.39]  # 53.35 exactly, 53.349999999999994 as doubles added in this order
    rows = [("a", "ok", v) for v in values] + [("b", "ok", -v) for v in values] + [("c", "ok", math.nan), ("d", "timeout", 1.0)]
    df = spark.createDataFrame(rows, "_file string, status string, chars double").coalesce(1)
    got = {r["_file"]: r["avg_chars"] for r in report.scrape_summary(df).collect()}
    assert got["a"] == 53.4 and got["b"] == -53.4 and math.isnan(got["c"]) and got["d"] is None


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(df):
    return sorted((r["query_id"], r["id"], round(r["score"], 5)) for r in df.collect())


def test_bm25_scores_where_documents_are_read(spark, monkeypatch):
    words = ["a", "b", "c", "d", "e f", "g", "a a", "x-y", ""]
    docs = [(i, None if i == 7 else " ".join(words[(i * j + j) % 9] for j in range(i % 13)), "en" if i % 3 else "de") for i in range(300)]
    docs = spark.createDataFrame(docs, "id long, text string, lang string")
    asked = spark.createDataFrame([(1, "a b a"), (2, "zz"), (3, "F x"), (4, None), (5, "c d e f g x y")], "query_id long, text string")
    some = docs.filter("lang = 'de'")
    made = [retrieve.bm25(docs, asked), retrieve.bm25(docs, asked, idf=False), retrieve.bm25(some, asked, corpus=docs)]
    assert "Exchange hash" not in _plan(made[0])
    got, best = [_rows(df) for df in made], _rows(retrieve.top(retrieve.bm25(docs, asked, 5), 5))
    twice = docs.union(docs.filter("id < 9"))
    repeated = _rows(retrieve.bm25(twice, asked))
    # all by joins
    monkeypatch.setattr(retrieve, "BROADCAST_PAIRS", -1)
    assert got == [_rows(retrieve.bm25(docs, asked)), _rows(retrieve.bm25(docs, asked, idf=False)), _rows(retrieve.bm25(some, asked, corpus=docs))]
    assert best == _rows(retrieve.top(retrieve.bm25(docs, asked), 5)) and len(best) == 15
    assert repeated == _rows(retrieve.bm25(twice, asked))


def test_bm25_in_small_pieces(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 17}" for j in range(1 + i % 29))) for i in range(200)], "id long, text string")
    asked = spark.createDataFrame([(q, " ".join(f"w{(q + j) % 17}" for j in range(q))) for q in range(1, 8)], "query_id long, text string")
    want = _rows(retrieve.bm25(docs, asked)), _rows(retrieve.top(retrieve.bm25(docs, asked), 3))
    monkeypatch.setattr(retrieve, "CELLS", 40)
    monkeypatch.setattr(retrieve, "ADDED", 5)
    assert want == (_rows(retrieve.bm25(docs, asked)), _rows(retrieve.top(retrieve.bm25(docs, asked, 3), 3)))


def test_records_with_categories_are_read_once(spark):
    columns = "_seq long, company_name string, about string, hq_country string, hq_location string, website string, website_scrape string, locations array<string>, sources array<struct<location:string,ebooth_url:string>>, cat_l1_ids array<int>, cat_l1_names array<string>"
    rows = [(i, f"Firm {i % 2}", "", "Japan", "", f"https://f{i % 2}.example", "", ["T"], [("T", "u")], [i % 3], [f"c{i}"]) for i in range(12)]
    df = spark.createDataFrame(rows, columns)
    for fold in (resolve.by_name, resolve.by_domain):
        found = fold(df)
        assert "ExistingRDD" not in _plan(found) and "LocalTableScan" not in _plan(found)
        assert sorted((r["company_name"], r["cat_l1_ids"], r["cat_l1_names"]) for r in found.collect()) == [("Firm 0", [0, 2, 1], ["c0", "c2", "c4"]), ("Firm 1", [1, 0, 2], ["c1", "c3", "c5"])]


def test_categories_are_dealt_once_by_entity(spark):
    tree = "array<struct<l1_id:int,l1_name:string,children:array<struct<id:int,name:string>>>>"
    rows = [
        (1, 5, [(2, "b", [(21, "x"), (None, "n")]), (1, "a", [])]),
        (1, 3, [(1, None, [(11, "p")]), (3, "c", None)]),
        (1, 7, [(2, "B", [(22, "y"), (21, "X"), (None, "m")]), (1, "late", [(12, "q"), (11, "P")]), (None, "u", [(9, "z")])]),
        (None, 1, [(4, "d", [])]),
        (2, 1, []),
        (3, 1, None),
    ]
    df = spark.createDataFrame(rows, f"k long, _seq long, cat_tree {tree}").repartition(3, "_seq")
    found = resolve.merged_trees(df, "k")
    assert _plan(found).count("Exchange hash") == 1 + 1  # the one of this test
    got = {r["k"]: [(n["l1_id"], n["l1_name"], [tuple(c) for c in n["children"]]) for n in r["cat_tree"]] for r in found.collect()}
    assert got == {1: [(1, None, [(11, "p"), (12, "q")]), (3, "c", []), (2, "b", [(21, "x"), (None, "n"), (22, "y")]), (None, "u", [(9, "z")])], None: [(4, "d", [])]}
    lists = df.select("k", "_seq", F.col("cat_tree.l1_id").alias("ids"), F.col("cat_tree.l1_name").alias("names"))
    few, many = (resolve.id_union(lists, "k", "ids", "names", many=m) for m in (False, True))
    assert _plan(many).count("Exchange hash") == 1 + 1 and _plan(few).count("Exchange hash") == 2 + 1
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect())) == ["Row(k=1, ids=[3, 2, 1], names=['c', 'b', 'a'])", "Row(k=None, ids=[4], names=['d'])"]


def test_booths_that_repeat_are_one_row(spark):
    rows = [("a", "B1", [2], None, 5), ("a", "B12", [1], "x", 6), ("a", "B1", [1], "y", 3), ("a", None, None, "", 1), ("a", "B2", [3], "z", 4), (None, "", [], None, 2)]
    df = spark.createDataFrame(rows * 50, "name string, booth string, halls array<int>, website string, _seq long")
    found = resolve.merged_exhibitors(df, F.col("name"))
    assert {r["name"]: (r["booth"], r["halls"], r["website"]) for r in found.collect()} == {"a": ("B1 / B2 / B12", [1, 2, 3], "y"), None: ("", [], "")}
    # the lists of a group are made of distinct booths, not of its rows
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString().split("Aggregate [name")[-1]


def test_pages_are_parsed_once_in_bounded_batches(spark):
    pages = spark.createDataFrame([(1, "<h1>Firm</h1><p>Booth: A1</p><table><tr><td>x</td></tr></table>")], "page_id long, html string")
    found = nodes.profiles(nodes.node_table(pages, "page_id"), "page_id")
    assert "MapInArrow" not in _plan(found) and [r["booth"] for r in found.collect()] == ["A1"]
    assert [r["cells"] for r in html.table_rows(pages, "page_id").collect()] == [["x"]]
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1024


def test_words_are_counted_before_they_are_dealt(spark, tmp_path):
    from cataloom.operators import sparse_index

    texts = spark.createDataFrame([(1, "b a b"), (2, ""), (3, None), (4, "a " * 500)], "id long, text string")
    words = texts.select("id", sparse_index._counted(F.split("text", " ")).alias("c")).filter("id = 1").first()["c"]
    assert [tuple(x) for x in words] == [("a", 1), ("b", 2)]
    index = sparse_index.build(texts, str(tmp_path / "i"))
    assert sorted((r["term"], r["df"], r["cf"]) for r in index.terms.collect()) == [("a", 2, 501), ("b", 1, 2)]
