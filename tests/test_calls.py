"""Logs of answers, the limit on calls, judges, and tables that are rebuilt only when something changed."""

import json
import os
import sys
import time
import uuid
from collections import Counter

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from cataloom.operators import enrich, judge, pace, retrieve
from cataloom.schema import MIN_JUDGE_COVERAGE, REFINED
from cataloom.sources.answers import AnswerLog
from cataloom.sources.commits import Commits
from cataloom.sources.manifest import materialised

# the clients below are sent to the workers, which can't import this file
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Noting:
    """Notes each prompt as a file with its time, and dies at some."""

    def __init__(self, folder, dies=""):
        self.folder, self.dies = folder, dies

    def complete(self, prompt):
        name = next(w for w in prompt.split() if w.startswith("Firm"))
        with open(os.path.join(self.folder, f"{name}-{uuid.uuid4().hex}"), "w") as f:
            f.write(repr(time.time()))
        if name == self.dies:
            os._exit(1)
        if name == "Firm-bad":
            raise ValueError("bad")
        return json.dumps({"summary": f"about {name}"})


def calls(folder):
    return Counter(f.rsplit("-", 1)[0] for f in os.listdir(folder))


def entities(spark, names):
    rows = [(n, f"{n} makes saws", "", "", [], []) for n in names]
    return spark.createDataFrame(rows, "company_name string, about string, website_scrape string, snippet string, cat_l1_names array<string>, cat_l2_names array<string>").withColumn("website", F.lit(""))


def test_each_key_is_called_once(spark, tmp_path):
    folder, log = str(tmp_path / "calls"), AnswerLog(spark, str(tmp_path / "log"))
    os.mkdir(folder)
    df = entities(spark, [f"Firm-{i}" for i in range(25)] + ["Firm-bad"])
    options = {"round_keys": 7, "wait": 0.0, "tries": 1, "concurrency": 2}
    out = enrich.refined_with_log(df, log, lambda: Noting(folder), **options)
    first = {r["company_name"]: (r["refine_status"], r["refined"] and r["refined"]["summary"]) for r in out.collect()}
    out.count()
    assert first.pop("Firm-bad") == ("api-error-ValueError", None) and set(first.values()) == {("ok", f"about Firm-{i}") for i in range(25)}
    assert calls(folder) == Counter([*first, "Firm-bad"])
    # a later plan asks only for what failed and what is new
    enrich.refined_with_log(df.union(entities(spark, ["Firm-new"])), log, lambda: Noting(folder), **options).count()
    assert calls(folder) == Counter([*first, "Firm-new", "Firm-bad", "Firm-bad"])


def test_a_killed_run_loses_its_round_only(spark, tmp_path):
    folder, log = str(tmp_path / "calls"), AnswerLog(spark, str(tmp_path / "log"))
    os.mkdir(folder)
    df = entities(spark, [f"Firm-{i:02d}" for i in range(20)])
    options = {"round_keys": 5, "wait": 0.0, "tries": 1, "concurrency": 1}
    names = [r["company_name"] for r in enrich.routed(df).orderBy("cache_key").collect()]
    with pytest.raises(Exception, match="Firm|worker|exit|crash"):  # noqa: B017
        enrich.refined_with_log(df, log, lambda: Noting(folder, names[12]), **options)
    assert {r["cache_key"] for r in log.read().collect()} == {r["cache_key"] for r in enrich.routed(df).filter(F.col("company_name").isin(names[:10])).collect()}
    before = calls(folder)
    enrich.refined_with_log(df, log, lambda: Noting(folder), **options).count()
    again = calls(folder) - before
    assert not set(again) & set(names[:10]) and set(again) == set(names[10:]) and log.read().count() == 20


def test_a_repair_asks_only_its_keys(spark, tmp_path):
    folder, log = str(tmp_path / "calls"), AnswerLog(spark, str(tmp_path / "log"))
    os.mkdir(folder)
    df = entities(spark, [f"Firm-{i}" for i in range(9)])
    enrich.refined_with_log(df, log, lambda: Noting(folder), wait=0.0).count()
    wrong = enrich.routed(df).filter("company_name = 'Firm-3'").select("cache_key")
    enrich.refined_with_log(df, log, lambda: Noting(folder), repair=wrong, wait=0.0).count()
    assert calls(folder) == Counter({f"Firm-{i}": 1 + (i == 3) for i in range(9)})
    attempts = Counter(r["attempt"] for r in log.read().collect())
    assert attempts == {1: 8, 2: 1} and log.rows().count() == 10
    log.compact()
    assert Counter(r["attempt"] for r in log.rows().collect()) == attempts and len(log.commits.last()[1]["folders"]) == 1


def test_the_last_good_answer_counts(spark, tmp_path):
    log = AnswerLog(spark, str(tmp_path / "log"))
    make = lambda *rows: spark.createDataFrame(rows, "cache_key string, raw string, status string")
    assert log.read().count() == 0
    log.append(make(("a", "1", "ok"), ("b", None, "network-error")))
    log.append(make(("a", None, "network-error"), ("b", None, "api-error-X"), ("c", "3", "ok")))
    log.append(make(("c", "4", "ok")))
    want = {"a": ("1", "ok", 1), "b": (None, "api-error-X", 2), "c": ("4", "ok", 2)}
    assert {r["cache_key"]: (r["raw"], r["status"], r["attempt"]) for r in log.read().collect()} == want
    # a folder without commit, and a commit without content, are as if they weren't
    make(("a", "9", "ok")).selectExpr("*", "9 AS attempt").write.parquet(log.commits.folder("answers"))
    n = log.commits.last()[0]
    open(tmp_path / "log" / "_commits" / f"{n + 1:012d}", "w").close()
    assert {r["cache_key"]: r["raw"] for r in log.read().collect()} == {"a": "1", "b": None, "c": "4"}
    log.append(make(("d", "5", "ok")))
    log.compact()
    assert {r["cache_key"]: r["raw"] for r in log.read().collect()} == {"a": "1", "b": None, "c": "4", "d": "5"}


def test_two_writers_can_t_have_one_number(spark, tmp_path):
    a, b = Commits(spark, str(tmp_path)), Commits(spark, str(tmp_path))
    assert a.last() == (0, {}) and a.add(1, {"x": 1}) and not b.add(1, {"x": 2}) and b.last() == (1, {"x": 1})


class FakeTime:
    def __init__(self):
        self.now = 100.0

    def clock(self):
        return self.now

    def sleep(self, s):
        self.now += s


@pytest.mark.parametrize(("limit", "partitions"), [(60, 5), (7, 3), (3, 8), (601, 10), (1, 1)])
def test_no_minute_has_more_calls_than_the_limit(limit, partitions):
    shares = pace.quotas(limit, partitions)
    assert sum(shares) == limit and min(shares) >= 1
    times = []
    for i, share in enumerate(shares):
        t = FakeTime()
        bucket = pace.Bucket(share, place=i / len(shares), clock=t.clock, sleep=t.sleep)
        model = pace.Paced(type("Quick", (), {"complete": lambda self, p, t=t: times.append(t.now) or "x"})(), bucket)
        for j in range(share * 4):
            model.complete("p")
            t.now += 0.01 * (j % 3)  # calls take a while
    times.sort()
    for k, start in enumerate(times):
        assert sum(start <= x < start + 60 - 1e-6 for x in times[k : k + limit + 5]) <= limit


def test_a_job_keeps_the_limit(spark, tmp_path):
    folder = str(tmp_path)
    df = enrich.routed(entities(spark, [f"Firm-{i}" for i in range(24)]))
    enrich.called(df, lambda: Noting(folder), concurrency=3, per_minute=360, wait=0.0).count()
    times = sorted(float((tmp_path / f).read_text()) for f in os.listdir(folder))
    assert len(times) == 24
    # 360 a minute are 6 a second
    assert all(sum(a <= x < a + 1 - 0.05 for x in times) <= 6 for a in times)


def cards(spark, rows):
    return spark.createDataFrame(rows, "id long, company_name string, about string, hq_country string").withColumns({"refined": F.lit(None).cast(REFINED), "cat_l1_names": F.lit(None).cast("array<string>"), "cat_l2_names": F.array(F.lit("Saws"))})


def test_prompts_are_bounded_and_replies_are_told_apart(spark):
    people = cards(spark, [(i, f"Firm {i}", "word " * (i * 40), None) for i in range(12)])
    short = spark.createDataFrame([(q, i, i + 1, 1.0 - i / 20) for q in (1, 2) for i in range(12)], "query_id long, id long, rank int, score double")
    asked = spark.createDataFrame([(1, "diamond saws"), (2, None)], "query_id long, text string")
    parts = judge.prompts(short, asked, people, "Judge.", chars=2000).collect()
    assert all(len(p["prompt"]) <= 2000 + 100 for p in parts) and len(parts) > 4
    assert [i for p in sorted((p for p in parts if p["query_id"] == 1), key=lambda p: p["part"]) for i in p["ids"]] == list(range(12))
    assert all(f"Buyer query: {judge.DEFAULT_QUERY}" in p["prompt"] for p in parts if p["query_id"] == 2)
    scores = judge.judgements(short, asked, people, chars=2000, wait=0.0).collect()
    assert len(scores) == 24 and {r["judge"] for r in scores if r["query_id"] == 1} == {0.5}
    said = judge.reasons(short, asked, people, chars=2000, wait=0.0).collect()
    assert len(said) == 24 and {r["reason"] for r in said if r["query_id"] == 1} == {"Shares saws."}


def test_a_card_tells_what_the_record_does(spark):
    made = cards(spark, [(1, "A", "x" * 600 + " " + "y" * 300, ""), (2, None, None, "Japan")])
    got = [r[0] for r in made.orderBy("id").select(judge.candidate_card(F.lit(4))).collect()]
    assert got[0] == "[Rank 4] id=1\n  company: A\n  hq: Unknown\n  categories: Saws\n  overview: " + "x" * 600 + " ..."
    assert got[1] == "[Rank 4] id=2\n  company: \n  hq: Japan\n  categories: Saws\n  overview: (no overview provided)"


class Failing:
    """Fails for one query, judges few of another, and names ids that it wasn't shown."""

    def complete(self, prompt):
        if "Buyer query: fails" in prompt:
            raise ConnectionError
        if "Buyer query: few" in prompt:
            return json.dumps({"results": [[0, 1.0], [77, 1.0]]})
        return json.dumps({"results": [[i, i / 10] for i in range(99)]})


def test_failures_and_low_coverage_keep_the_order(spark):
    people = cards(spark, [(i, f"Firm {i}", "text", "Japan") for i in range(5)])
    short = spark.createDataFrame([(q, i, i + 1, 1.0 - i / 20) for q in (1, 2, 3) for i in range(5)], "query_id long, id long, rank int, score double")
    asked = spark.createDataFrame([(1, "fails"), (2, "few"), (3, "fine")], "query_id long, text string")
    judged = judge.judgements(short, asked, people, Failing, tries=2, wait=0.0)
    assert sorted((r["query_id"], r["id"]) for r in judged.collect()) == [(2, 0), *((3, i) for i in range(5))] and 1 / 5 < MIN_JUDGE_COVERAGE
    order = {}
    for r in retrieve.rerank(short, judged, alpha=0.0).orderBy("position").collect():
        order.setdefault(r["query_id"], []).append(r["id"])
    assert order == {1: [0, 1, 2, 3, 4], 2: [0, 1, 2, 3, 4], 3: [4, 3, 2, 1, 0]}
    assert {r["reason"] for r in judge.reasons(short, asked, people, Failing, tries=1).collect()} == {judge.DEFAULT_REASON}


def test_tables_are_rebuilt_when_something_changed(spark, tmp_path):
    source, path, built = str(tmp_path / "in"), str(tmp_path / "out"), []
    spark.range(5).write.parquet(source)

    def get(settings={}, **options):  # noqa: B006
        df = spark.read.parquet(source)

        def build():
            built.append(1)
            return df.withColumn("x", F.col("id") * 2)

        return materialised(spark, path, build, [df], settings, **options).count()

    assert get() == 5 and get() == 5 and len(built) == 1
    assert get({"k": 1}) == 5 and get({"k": 1}) == 5 and len(built) == 2
    spark.range(5, 8).write.mode("append").parquet(source)
    assert get({"k": 1}) == 8 and len(built) == 3
    assert get({"k": 1}, force=True) == 8 and len(built) == 4
    # a table that was written in part, and a manifest that wasn't filled
    os.makedirs(f"{path}/table-half")
    last = max(os.listdir(f"{path}/_commits"))
    open(f"{path}/_commits/{int(last) + 1:012d}", "w").close()
    assert get({"k": 1}) == 8 and len(built) == 4
    spark.range(8, 9).write.mode("append").parquet(source)
    assert get({"k": 1}) == 9 and len(built) == 5
    tables = [f for f in os.listdir(path) if f.startswith("table-") and f != "table-half"]
    assert len(tables) == 2  # the last and the one before it
