"""Operators of the catalogue on small tables."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from cataloom.operators import enrich, facets, html, integrate, present, resolve, retrieve
from cataloom.operators.filters import Selection, browse, catalogue_view
from cataloom.schema import FALLBACK_ABOUT, RECORD
from cataloom.sources import readers, sinks
from cataloom.streaming import incremental

# classes below are sent to the workers, which can't import this file
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TREE = "array<struct<l1_id:int,l1_name:string,children:array<struct<id:int,name:string>>>>"


@pytest.fixture(scope="module")
def mini(spark):
    rows = [(1, "beta", ["T", "J"], "Japan", [10], [101, 102]), (2, "Alpha", ["T"], "Taiwan", [10, 20], [101, 201]), (3, "gamma", ["J"], None, [20], [202])]
    return catalogue_view(spark.createDataFrame(rows, "id long, company_name string, expos array<string>, hq_country string, cat_l1_ids array<int>, cat_l2_ids array<int>"))


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([(10, "A", 101, "a1"), (10, "A", 102, "a2"), (20, "B", 201, "b1"), (20, "B", 202, "b2")], "l1_id int, l1_name string, l2_id int, l2_name string")


def counts(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["dim"], {})[r["value"]] = r["n"]
    return out


def test_facets(mini, pairs):
    got = counts(facets.facets(mini, Selection(), pairs))
    assert got["expos"] == {"J": 2, "T": 2} and got["countries"] == {"Japan": 1, "Taiwan": 1, "Unknown": 1} and got["total"] == {"all": 3}
    got = counts(facets.facets(mini, Selection(countries=["Japan"]), pairs))
    assert len(got["countries"]) == 3 and got["expos"] == {"J": 1, "T": 1} and got["l1"] == {"10": 1} and got["total"] == {"all": 1}
    got = counts(facets.facets(mini, Selection(l1=[10]), pairs))
    assert got["l1"] == {"10": 2, "20": 2} and got["l2"] == {"101": 2, "102": 1} and got["total"] == {"all": 2}
    got = counts(facets.facets(mini, Selection(l1=[10], l2=[202]), pairs))
    assert got["total"] == {"all": 1} and got["l2"] == {"101": 2, "102": 1}


def test_browse(mini):
    page, total = browse(mini, Selection())
    assert [r["company_name"] for r in page.collect()] == ["Alpha", "beta", "gamma"] and total.first()[0] == 3
    page, _ = browse(mini, Selection(expo="All"), limit=1, offset=1)
    assert [r["company_name"] for r in page.collect()] == ["beta"]


def test_rrf(spark):
    d = spark.createDataFrame([(0, 1, 1.0, 1), (0, 2, 0.9, 2), (0, 3, 0.8, 3)], "query_id long, id long, score double, rank int")
    s = spark.createDataFrame([(0, 3, 5.0, 1), (0, 1, 3.0, 3)], "query_id long, id long, score double, rank int")
    got = {r["id"]: r["score"] for r in retrieve.rrf(d, s).collect()}
    assert got == {1: 0.032266, 2: 0.016129, 3: 0.032266}
    assert [r["id"] for r in retrieve.top(retrieve.rrf(d, s), 2).orderBy("rank").collect()] == [1, 3]


def _short(spark, scores):
    return spark.createDataFrame([(0, i + 1, s, i + 1) for i, s in enumerate(scores)], "query_id long, id long, score double, rank int")


def test_rerank(spark):
    judged = spark.createDataFrame([(0, 1, 0.2), (0, 2, 0.9)], "query_id long, id long, judge double")
    got = retrieve.rerank(_short(spark, [0.0328, 0.0320, 0.0161]), judged).orderBy("position").collect()
    assert [r["id"] for r in got] == [2, 1, 3]
    assert {r["id"]: (r["retrieval_norm"], r["final_score"]) for r in got} == {1: (1.0, 0.52), 2: (0.9521, 0.9208), 3: (0.0, 0.33)}
    few = retrieve.rerank(_short(spark, [0.3, 0.2, 0.1]), judged.filter("id = 1")).orderBy("position").collect()
    assert [r["id"] for r in few] == [1, 2, 3] and few[0]["final_score"] is None
    one = retrieve.rerank(_short(spark, [0.3]), judged).collect()
    assert one[0]["retrieval_norm"] is None
    flat = retrieve.rerank(_short(spark, [0.3, 0.3]), judged).collect()
    assert {r["retrieval_norm"] for r in flat} == {0.5}


def test_judge_replies(spark):
    raws = ['{"results":[[1,0.9]]}', '[{"id":1,"relevance_score":2}]', '```json\n[[1, 0.4], ["x"], [1, 0.5]]\n```', "nothing", None]
    got = enrich.judge_scores(spark.createDataFrame(list(enumerate(raws)), "query_id long, raw string")).collect()
    assert {r["query_id"]: r["judge"] for r in got} == {0: 0.9, 1: 1.0, 2: 0.5}


def test_explanations(spark):
    raws = ['{"explanations": {"1": "a"}}', '{"results": [{"id": 2, "reason": "b"}]}', '{"3": "c"}']
    got = enrich.explanation_rows(spark.createDataFrame(list(enumerate(raws)), "query_id long, raw string")).collect()
    assert {(r["id"], r["reason"]) for r in got} == {("1", "a"), ("2", "b"), ("3", "c")}


def test_snippets(spark):
    firms = spark.createDataFrame([("VON  ARDENNE GMBH",), ("Other",)], "company_name string")
    notes = spark.createDataFrame([(0, "Von Ardenne GmbH", "We make coaters", "")], "_seq long, company string, website string, snippet string")
    got = {r["company_name"]: (r["snippet"], r["snippet_match"]) for r in integrate.with_snippets(firms, notes).collect()}
    assert got == {"VON  ARDENNE GMBH": ("We make coaters", "text"), "Other": ("", "none")}


def test_zip_needs_equal_counts(spark):
    a, b = spark.range(3).withColumnRenamed("id", "_seq"), spark.range(2).withColumnRenamed("id", "_seq")
    with pytest.raises(ValueError, match="3 and 2"):
        integrate.zipped(a, b)


def records(spark, rows):
    columns = "_seq long, company_name string, about string, hq_country string, hq_location string, website string, website_scrape string, locations array<string>, sources array<struct<location:string,ebooth_url:string>>"
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], columns)


def test_dedupe_by_name(spark):
    df = records(spark, [
        ("Advantest Co., Ltd.", FALLBACK_ABOUT, "Unknown", "", "", "", ["T"], [("T", "u")]),
        ("ADVANTEST CORPORATION", "ATE maker", "Japan", "Tokyo", "", "", ["J"], [("J", "v")]),
        ("Advantest", "x", "USA", "", "", "", ["K"], [("K", "w")]),
        ("", "", "Unknown", "", "", "", [], []),
        ("", "", "Unknown", "", "", "", [], []),
    ])
    rows = resolve.by_name(df).collect()
    assert len(rows) == 3
    r = next(r for r in rows if r["company_name"])
    assert (r["company_name"], r["about"], r["hq_country"], r["hq_location"]) == ("Advantest Co., Ltd.", "ATE maker", "Japan", "Tokyo")
    assert (r["hq_country_conflict"], r["locations"], len(r["sources"])) == (["Japan", "USA"], ["T", "J", "K"], 3)


def test_dedupe_by_domain(spark):
    df = records(spark, [
        ("A", "One.", "Unknown", "", "http://www.a.com", "", ["T"], [("T", "")]),
        ("A Inc", "one.", "Japan", "", "https://a.com/x", "zz", ["J"], [("J", "v")]),
        ("AB", "", "", "", "", "", [], []),
        ("Co., Ltd.", "", "", "", "", "", [], []),
    ])
    got = {r["_merge_key"]: r for r in resolve.by_domain(df).collect()}
    assert set(got) == {"a.com", "__name__"}
    a = got["a.com"]
    assert (a["company_name"], a["about"], a["hq_country"], a["_hq_country_conflict"], len(a["sources"])) == ("A Inc", "One.", "Japan", ["Unknown", "Japan"], 1)
    assert got["__name__"]["website"] == "#"


def test_tree_in_page_order(spark):
    hrefs = ["SubCatID=5", "CatID=203", "SubCatID=11", "SubCatID=11", "CatID=219", "SubCatID=12", "CatID=  203", "SubCatID=13"]
    page = "".join(f'<a href="x.aspx?{h}">n{i}</a>' for i, h in enumerate(hrefs))
    marks = html.category_marks(html.links(spark.createDataFrame([(1, page), (2, None)], "k long, html string"), "k"), "k")
    row = html.category_tree(marks, "k").select("cat_tree", html.flat_categories(F.col("cat_tree")).alias("f")).collect()
    assert len(row) == 1
    assert [(n["l1_id"], [c["id"] for c in n["children"]]) for n in row[0]["cat_tree"]] == [(None, [5]), (203, [11, 13]), (219, [12])]
    assert (row[0]["f"]["l1_ids"], row[0]["f"]["l2_ids"]) == ([203, 219], [5, 11, 13, 12])


def test_main_text(spark):
    page = "<html><body><nav>Menu</nav><main><h1>Title</h1><p>Text &amp; more</p><script>x</script></main><footer>End</footer></body></html>"
    got = spark.createDataFrame([(page,), (None,)], "html string").select(html.main_text("html")).collect()
    assert [r[0] for r in got] == ["Title\n\nText & more", ""]


def test_category_split(spark):
    tree = [(10, "Front-End Equipment", [(101, "Lithography"), (102, "Etch"), (103, "CMP")]), (20, "Back-End / Packaging", [(201, "Die Attach"), (202, "Burn-in Test")]), (30, "Facilities & UHP", [])]
    df = spark.createDataFrame([(1, tree)], f"id long, cat_tree {TREE}")
    hits = lambda **k: [r["label"] for r in present.split_categories(df, **k).filter("hit").orderBy("pos").collect()]
    assert hits(l2=[102], query="x") == ["Etch"] and present.split_categories(df).count() == 6
    assert hits(l1=[20]) == ["Die Attach", "Burn-in Test"] and hits(query="litho tooling") == ["Lithography"]
    assert hits(query="packaging") == ["Die Attach", "Burn-in Test"] and hits(query="facilities") == ["Facilities & UHP"]
    many = spark.createDataFrame([(1, [(1, "P", [(i, f"Cat {i}") for i in range(50)])])], f"id long, cat_tree {TREE}")
    v = present.visible_categories(present.split_categories(many)).first()
    assert (len(v["shown"]), v["hidden"]) == (3, 47)
    v = present.visible_categories(present.split_categories(many, query="Cat")).first()
    assert (len(v["shown"]), v["hidden"]) == (6, 44)


def test_refinement_uses_the_cache(spark):
    rows = spark.createDataFrame([("A", "word " * 200, "", "", ["c"], []), ("B", "", "", "", [], [])], "company_name string, about string, website_scrape string, snippet string, cat_l1_names array<string>, cat_l2_names array<string>")
    first = enrich.routed(rows)
    key = first.filter("company_name = 'A'").first()["cache_key"]
    cache = spark.createDataFrame([(key, '{"summary": "kept"}', "ok")], "cache_key string, raw string, status string")
    got = {r["company_name"]: r for r in enrich.refined(rows, cache, wait=0.0).collect()}
    assert got["A"]["refined"]["summary"] == "kept" and got["B"]["refine_status"] == "empty-input"


def test_sources_and_sinks(spark, tmp_path):
    records = [{"company_name": "A", "extra": 1}, {"company_name": "B", "location": "T"}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/b.json").write_text(json.dumps(records), encoding="utf-8-sig")
    (tmp_path / "in/a.json").write_text(json.dumps(records[:1]))
    (tmp_path / "in/broken.json").write_text("{oops")
    rows = readers.json_arrays(spark, str(tmp_path / "in"), RECORD)
    ordered = readers.global_order(rows).orderBy("_seq").collect()
    assert [r["company_name"] for r in ordered] == ["A", "A", "B"] and [r["_seq"] for r in ordered] == [0, 1, 2]
    drift = integrate.schema_drift(readers.json_maps(spark, str(tmp_path / "in")), ["company_name", "about"]).collect()
    assert all("about" in r["missing"] for r in drift) and any(r["dropped"] == ["extra", "location"] for r in drift)
    assert [r["_file"].rsplit("/", 1)[1] for r in readers.broken_files(spark, str(tmp_path / "in")).collect()] == ["broken.json"]
    (tmp_path / "x.csv").write_text('name,Website CONTENT,halls\n"A ""q""\nB",c,1|x|3\n', encoding="utf-8-sig")
    csv = readers.csv_records(spark, str(tmp_path / "x.csv"))
    assert csv.columns == ["name", "Website CONTENT", "halls"] and readers.content_column(csv.columns) == "Website CONTENT"
    assert csv.select("name", readers.pipe_numbers(F.col("halls"))).first()[1] == [1, 3]
    (tmp_path / "log.jsonl").write_text('{"booth_id": 1, "v": "a", "_seq": 1}\n{"booth_id": 1, "v": "b", "_seq": 2}\nbroken\n')
    assert readers.checkpoint_log(spark, str(tmp_path / "log.jsonl"), "booth_id int, v string, _seq long", "booth_id").first()["v"] == "b"
    out = spark.createDataFrame([(1, ["a", "b"])], "id int, v array<string>")
    sinks.write_csv(out, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first()["v"] == "a | b" and readers.is_written(spark, str(tmp_path / "csv"))
    sinks.export_json_array(out, str(tmp_path / "out.json"))
    assert json.loads((tmp_path / "out.json").read_text()) == [{"id": 1, "v": ["a", "b"]}]


def test_incremental_upsert(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "ck"))
    for d in ("in", "state"):
        (tmp_path / d).mkdir()
    write = lambda name, rows: (tmp_path / "in" / name).write_text("".join(json.dumps(r) + "\n" for r in rows))
    go = lambda: incremental.follow(spark, str(tmp_path / "in"), spark.createDataFrame([], "_seq long, company_name string, v string").schema, str(tmp_path / "state/t"), str(tmp_path / "stream"), buckets=4).awaitTermination()
    write("1.json", [{"_seq": 1, "company_name": "A Ltd", "v": "x"}, {"_seq": 2, "company_name": "B", "v": "y"}])
    go()
    write("2.json", [{"_seq": 1, "company_name": "A Inc", "v": "z"}, {"_seq": 3, "company_name": "C", "v": "w"}])
    go()
    got = {r["_seq"]: r["v"] for r in spark.read.parquet(str(tmp_path / "state/t")).collect()}
    assert got == {1: "z", 2: "y", 3: "w"}


def test_log_of_files_of_different_size(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"k": 1, "v": "old"}\n')
    (tmp_path / "b.json").write_text("".join(f'{{"k": {i}, "v": "{"x" * 50}"}}\n' for i in range(2, 300)) + 'broken\n{"k": 1, "v": "new"}\n')
    (tmp_path / "c.json").write_text('{"k": 2, "v": "last"}\n')
    got = {r["k"]: r["v"] for r in readers.checkpoint_log(spark, str(tmp_path), "k int, v string", "k").collect()}
    assert got[1] == "new" and got[2] == "last" and len(got) == 299


def test_dense_leaves_out_what_has_no_direction(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", None), ("d", [3.0, 4.0]), ("e", [1.0, None]), ("f", [1.0, 2.0, 3.0]), ("g", [0.0, 2.0]), ("a", [1.0, 0.0])], "id string, vector array<double>")
    asked = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, [0.0, 0.0, 1.0])], "query_id int, vector array<float>")
    got = sorted(tuple(r) for r in retrieve.dense(vectors, asked).collect())
    assert got == [(1, "a", 1.0), (1, "a", 1.0), (1, "d", 0.6), (1, "g", 0.0), (3, "f", 0.801784)]
    assert sorted(tuple(r)[:2] for r in retrieve.top(retrieve.dense(vectors.coalesce(1), asked, 2), 2).collect()) == [(1, "a"), (1, "a"), (3, "f")]
    assert retrieve.dense(vectors.filter("false"), asked).count() == retrieve.dense(vectors, asked.filter("false")).count() == 0


def test_last_judgement_wins(spark):
    short = spark.createDataFrame([(1, 5, 2.0, 1), (1, 6, 1.0, 2)], "query_id int, id int, score double, rank int")
    judged = spark.createDataFrame([(1, 5, 0.9, 0), (1, 5, 0.1, 1), (1, 6, 0.5, 0)], "query_id int, id int, judge double, pos int")
    assert {r["id"]: r["llm_score"] for r in retrieve.rerank(short, judged).collect()} == {5: 0.1, 6: 0.5}
    assert {r["id"]: r["llm_score"] for r in retrieve.rerank(short, judged.drop("pos")).collect()} == {5: 0.9, 6: 0.5}


def test_csv_with_byte_order_mark(spark, tmp_path):
    from cataloom.sources.sinks import write_csv

    df = spark.createDataFrame([("a", ["x", "y"])], "name string, halls array<string>").coalesce(1)
    write_csv(df, str(tmp_path / "out"), bom=True)
    raw = next((tmp_path / "out").glob("*.csv")).read_bytes()
    assert raw.decode("utf-8-sig").splitlines() == ["name,halls", "a,x | y"] and raw.startswith(b"\xef\xbb\xbf")


def test_retest_and_toggle(spark):
    from cataloom.operators.filters import to_retest
    from cataloom.operators.present import toggled

    rows = spark.createDataFrame([(1, "ok"), (2, "timeout"), (3, None)], "id int, status string")
    assert sorted(r.id for r in to_retest(rows).collect()) == [2, 3]
    assert to_retest(rows.drop("status")).count() == 3
    assert toggled([], 3) == [3] and toggled([3, 4], "3") == [4] and toggled(["a"], "b") == ["a", "b"]


def test_one_query_is_searched_or_browsed(spark):
    from cataloom.plans.engine import Engine

    catalogue = spark.createDataFrame([(1, "B", "Japan"), (2, "a", "Japan"), (3, "C", None)], "id long, company_name string, hq_country string").selectExpr("*", "array('x') AS expos", "array(1) AS cat_l1_ids", "array(2) AS cat_l2_ids")
    texts = spark.createDataFrame([(1, "wafer saws"), (2, "etching"), (3, "wafer")], "id long, text string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vector array<float>")
    engine = Engine(catalogue, texts, vectors)
    assert [r.id for r in engine.answer("", None).collect()] == [2, 1, 3]
    assert [r.id for r in engine.answer(None, None, limit=1, offset=1).collect()] == [1]
    assert {r.id for r in engine.answer("wafer", None).collect()} == {1, 3}
    assert {r.id for r in engine.answer("wafer", [0.0, 1.0]).collect()} == {1, 2, 3}


def test_zipped_by_place(spark):
    a = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "_seq long, x string")
    b = spark.createDataFrame([(5, "r"), (0, "p"), (1, "q")], "_seq long, y string")
    assert sorted(tuple(r) for r in integrate.zipped(a, b).select("_seq", "x", "y").collect()) == [(0, "a", "p"), (1, "b", "q"), (2, "c", "r")]
    for odd in ([(0, "a"), (0, "b"), (2, "c")], [(0, "a"), (None, "b"), (2, "c")]):
        with pytest.raises(ValueError, match="ordinals"):
            integrate.zipped(a, spark.createDataFrame(odd, "_seq long, y string"))


def test_lift_location_keeps_lists(spark):
    rows = [("Taipei", "u", ["Tokyo", "Seoul"]), ("Taipei", "u", None), ("", "u", None), (None, "u", None), ("Taipei", "u", [])]
    got = integrate.lift_location(spark.createDataFrame(rows, "location string, ebooth_url string, locations array<string>")).collect()
    assert [r["locations"] for r in got] == [["Tokyo", "Seoul"], ["Taipei"], [], [], []]
    assert [None if r["sources"] is None else [tuple(s) for s in r["sources"]] for r in got] == [None, [("Taipei", "u")], [], [], None]
    bare = integrate.lift_location(spark.createDataFrame([("X", "u")], "location string, ebooth_url string")).first()
    assert bare["locations"] == ["X"] and [tuple(s) for s in bare["sources"]] == [("X", "u")]


def test_numbered_is_dense(spark):
    from cataloom.operators.numbering import numbered

    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v"), F.lit("x").alias("_at")).repartition(7)
    assert sorted((r["v"], r["_n"]) for r in numbered(df.drop("_at"), "v").collect()) == [(i, i) for i in range(1000)]
    assert numbered(df.filter("false"), "v").count() == 0


class Counting:
    """Notes each call in a folder."""

    folder = ""

    def resolve(self, values):
        import os
        import uuid

        with open(os.path.join(Counting.folder, uuid.uuid4().hex), "w") as f:
            f.write("\n".join(values))
        if "bad" in values and len(values) > 1:
            raise ValueError("no reply")
        return {v: v.upper() for v in values if len(values) == 1 or not v.startswith("m")}


def test_resolver_is_called_once_a_batch(spark, tmp_path):
    Counting.folder, folder = str(tmp_path), str(tmp_path)

    def make():
        Counting.folder = folder
        return Counting()

    values = [f"v{i:03d}" for i in range(120)] + ["m1", "m2"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values * 3 + [" ", None, " v001 "])], "id long, place string")
    out = integrate.resolved_in_batches(df, "place", make, "found")
    got = {r["id"]: (r["place"], r["found"]) for r in out.collect()}
    out.count()
    assert len(got) == len(values) * 3 + 3 and all(f == ((p or "").strip().upper() or None) for p, f in got.values())
    calls = [len((tmp_path / p).read_text().split("\n")) for p in __import__("os").listdir(folder)]
    # 122 values are three batches, and the two that were left out are asked for alone
    assert sorted(calls) == [1, 1, 22, 50, 50]


def test_a_batch_that_fails_is_asked_one_by_one(spark, tmp_path):
    folder = str(tmp_path)

    def make():
        Counting.folder = folder
        return Counting()

    df = spark.createDataFrame([("bad",), ("a",), ("b",)], "place string")
    assert {r["place"]: r["found"] for r in integrate.resolved_in_batches(df, "place", make, "found").collect()} == {"bad": "BAD", "a": "A", "b": "B"}


def test_overlay_by_name_then_id(spark):
    c = spark.createDataFrame([(1, "Acme", "Old", "w1", "X"), (2, "Beta", "Old", "w2", "X"), (3, "Gamma", "Old", "w3", "X"), (4, "Delta", "Old", "w4", "X")], "id long, company_name string, hq_location string, website string, hq_country string").withColumn("refined", F.when(F.col("id") == 2, "own"))
    fixes = [(None, " ACME ", "New", "", "Japan", "r1", 0), (2, "other", None, "n2", None, "r2", 1), (1, None, "By id", "n1", "Y", "r", 2), (3, "gamma", "A", "a", "A", "ra", 3), (3, "gamma", "B", "b", "B", None, 4)]
    got = {r["id"]: tuple(r)[2:] for r in enrich.overlaid(c, spark.createDataFrame(fixes, "id long, company_name string, hq_location string, website string, hq_country string, refined string, _seq int")).collect()}
    assert got == {1: ("New", "w1", "Japan", "r1"), 2: (None, "n2", None, "own"), 3: ("B", "b", "B", None), 4: ("Old", "w4", "X", None)}
    row = enrich.shaped(spark.createDataFrame([(0.123456789,), (None,)], "score double")).collect()
    assert (row[0]["score"], row[0]["retrieval_score"]) == (0.1235, 0.123457) and row[1]["score"] is None


def test_halls_count_where_no_listing_does(spark):
    row = "source string, priority int, hall int, name string"
    lists = [("a", 1, None, f"n{i}") for i in range(19)] + [("b", 2, None, f"n{i}") for i in range(20)]
    halls = [("map", 9, 1, f"h{i}") for i in range(5)] + [("map", 9, 2, f"h{i}") for i in range(4)] + [("map", 9, 3, f"h{i}") for i in range(8)]
    picked = lambda rows: sorted((r["source"], r["hall"]) for r in integrate.picked_listing(spark.createDataFrame(rows, row)).collect())
    assert picked(lists + halls) == [("b", None)] * 20
    assert picked(lists[:30] + halls) == [("map", 1)] * 5 + [("map", 3)] * 8 and picked(halls[5:9]) == []


def test_failures_of_a_client_have_classes(spark):
    names = ["SSLError:bad certificate " + "x" * 99, "ReadTimeout", "TooManyRedirects:30", "ConnectionError", "ValueError:x", None]
    df = spark.createDataFrame([(i, "u", n, "<p>", "t" * 200) for i, n in enumerate(names)], "i int, url string, error string, html string, text string")
    got = [r[0] for r in df.orderBy("i").select(html.fetch_status(F.col("url"), F.col("html"), F.col("text"), error=F.col("error"))).collect()]
    assert got == ["ssl_error:bad certificate " + "x" * 44, "timeout", "too_many_redirects", "connection_error", "other:ValueError", "ok"]


def test_folds_merge_categories_into_one_entity(spark):
    fields = "_seq long, company_name string, about string, hq_country string, hq_location string, website string, website_scrape string, locations array<string>, sources array<struct<location:string,ebooth_url:string>>, cat_l1_ids array<int>, cat_l1_names array<string>, cat_l2_ids array<int>, cat_l2_names array<string>, " + f"cat_tree {TREE}"
    tree = lambda *nodes: [(i, n, kids) for i, n, kids in nodes]
    rows = [
        (1, "Acme Inc.", "One  two", "Unknown", "", "https://acme.example", "", ["T"], [("T", "")], [1, 2], ["a", "b"], [11], ["x"], tree((1, "a", [(11, "x")]), (2, "b", []))),
        (2, "ACME", "one two", "Japan", "Kyoto", "https://www.acme.example/en", "", ["J"], [("J", "v")], [2, 3], ["B", "c"], [21, 11], ["y", "X"], tree((2, "B", [(21, "y")]), (3, "c", []))),
        (3, "Solo", None, None, None, None, None, [], [], None, None, [], [], None),
    ]
    df = spark.createDataFrame(rows, fields)
    for e in (resolve.by_name(df), resolve.by_domain(df)):
        got = {r["company_name"].split()[0].lower(): r for r in e.collect()}
        assert (got["acme"]["cat_l1_ids"], got["acme"]["cat_l1_names"], got["acme"]["cat_l2_ids"], got["acme"]["cat_l2_names"]) == ([1, 2, 3], ["a", "b", "c"], [11, 21], ["x", "y"])
        assert [(n["l1_id"], n["l1_name"], [tuple(c) for c in n["children"]]) for n in got["acme"]["cat_tree"]] == [(1, "a", [(11, "x")]), (2, "b", [(21, "y")]), (3, "c", [])]
        assert got["solo"]["cat_l1_ids"] == [] and got["solo"]["cat_tree"] == []
    assert (r := {x["_merge_key"]: x for x in resolve.by_domain(df).collect()}["acme.example"]) and (r["about"], r["hq_location"], r["ebooth_url"]) == ("One  two", "Kyoto", "v")
