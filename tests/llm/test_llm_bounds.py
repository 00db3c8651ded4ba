"""No switch by depth, rate, repetition or length changes a result or its bound."""

import json
import os
import random
import resource
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from cataloom.llm import html_extract, mixing, quality_rules, url_filter

R = random.Random(5)


def judged(spark, urls, bad):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i in bad else 1) for i in range(0, len(urls), 2)], "doc_id long, quality int")
    return {r["page_id"]: (r["template"], r["verdict"]) for r in url_filter.judge_urls(pages, labels, []).collect()}


@pytest.mark.parametrize("head", ["", "a", "a/b/c/d", "a/b/c/d/e/f/g", "/".join(f"d{i}" for i in range(60))])
def test_verdicts_do_not_depend_on_depth(spark, head):
    head = f"https://h.example/{head}/" if head else "https://h.example/"
    urls = [f"{head}{i}/w{i}x" for i in range(200)] + [f"https://other.example/{i}/w{i}x" for i in range(200)]
    got = judged(spark, urls, set(range(200)))
    assert {got[i] for i in range(200)} == {(head[len("https://h.example") :] + "<n>/*", "block")} and {got[i][1] for i in range(200, 400)} == {"allow"}


def test_deep_branches_are_told_apart(spark):
    head = "https://h.example/" + "/".join(f"d{i}" for i in range(30))
    urls = [f"{head}/{'spam' if i % 4 < 2 else 'news'}/x/{'y' if i % 3 else 'z'}/{i}" for i in range(600)]
    got = judged(spark, urls, {i for i in range(600) if i % 4 < 2})
    assert {got[i][1] for i in range(600) if i % 4 < 2} == {"block"} and {got[i][1] for i in range(600) if i % 4 >= 2} == {"allow"}


def tree_by_hand(rows):
    """Templates of (host, typed segments, label) by recursion over nodes, with the rules of merged_branches."""
    out = {}

    def typed(s):
        return s.startswith("<") or s == ""

    def names(kids):
        free = {s: v for s, v in kids.items() if not typed(s)}
        total = sum(len(v) for v in free.values())
        if len(free) == 1:
            return {s: s for s, v in free.items() if len(v) >= url_filter.MIN_URLS}
        stat = lambda vs: (sum(x is not None for v in vs for *_, x in v), sum(x or 0 for v in vs for *_, x in v))
        own = {s for s, v in free.items() if len(v) >= url_filter.MIN_URLS and len(v) >= url_filter.MIN_SHARE * total and stat([v])[0]}
        items = sorted([((n := stat([free[s]]))[1] / n[0], [s], False, *n) for s in own])
        rest = stat([v for s, v in free.items() if s not in own])
        if rest[0]:
            items = sorted([*items, (rest[1] / rest[0], [], True, *rest)])
        groups = []
        for _, segs, is_rest, lab, bad in items:
            if groups:
                g = groups[-1]
                p = (g[3] + bad) / (g[2] + lab)
                if abs(g[3] / g[2] - bad / lab) <= url_filter.MERGE_Z * (p * (1 - p) * (1 / g[2] + 1 / lab)) ** 0.5:
                    groups[-1] = (g[0] + segs, g[1] or is_rest, g[2] + lab, g[3] + bad)
                    continue
            groups.append((segs, is_rest, lab, bad))
        if len(groups) < 2:
            return {}
        return {s: g[0][0] if len(g[0]) == 1 else "{" + "|".join(sorted(g[0])) + "}" for g in groups if not g[1] for s in g[0]}

    def go(node, prefix):
        kids = {}
        for host, segs, rest, label in node:
            if rest:
                kids.setdefault(rest[0], []).append((host, segs, rest[1:], label))
            else:
                out[host, tuple(segs)] = prefix
        named, below = names(kids), {}
        for s, v in kids.items():
            below.setdefault(s if typed(s) else named.get(s, "*"), []).extend(v)
        for s, v in below.items():
            go(v, f"{prefix}/{s}")

    for host in {r[0] for r in rows}:
        go([(h, segs, segs, label) for h, segs, label in rows if h == host], "")
    return out


@pytest.mark.parametrize("seed", range(4))
def test_the_tree_is_that_of_a_recursion(spark, seed):
    r = random.Random(seed)
    rows = []
    for _ in range(1500):
        host, depth = r.choice(["a.x", "a.x", "b.x"]), r.choice([1, 2, 3, 12])
        segs = [r.choice(["s", "t", "u", str(r.randrange(99)), f"w{r.randrange(40)}q"]) for _ in range(min(depth, 3))] + (["k"] * 8 + [r.choice(["e", "f"])] if depth > 3 else [])
        rows.append((host, "/" + "/".join(segs), None if r.random() < 0.4 else int((segs[0] == "s") != (r.random() < 0.2))))
    df = spark.createDataFrame(rows, "host string, path string, label int")
    typed = {r["path"]: r["segs"] for r in df.select("path", url_filter.typed_segments(F.col("path")).alias("segs")).distinct().collect()}
    want = tree_by_hand([(h, typed[p], x) for h, p, x in rows])
    assert {(r["host"], tuple(r["segs"])): r["template"] for r in url_filter.template_tree(df).collect()} == want


@pytest.mark.parametrize("rate", [50.0, 150.0, 746.0, 1999.0, 2001.0, 50_000.0, 1_000_000.0])
def test_counts_are_the_inverse_distribution(spark, rate):
    """Against sums of the terms around the mean in extended precision."""
    k = np.arange(max(0, int(rate - 40 * rate**0.5)), int(rate + 40 * rate**0.5) + 60)
    logs = np.log(np.maximum(np.arange(1, k[-1] + 1), 1).astype(np.longdouble))
    log_factorial = np.concatenate(([0], np.cumsum(logs)))[k]
    cdf = np.cumsum(np.exp(k * np.log(np.longdouble(rate)) - np.longdouble(rate) - log_factorial))
    us = [R.random() for _ in range(60)] + [1e-9, 1 - 1e-9, 0.0]
    got = [r["k"] for r in spark.createDataFrame([(i, u) for i, u in enumerate(us)], "i int, u double").select("i", mixing.poisson_count(F.lit(rate), F.col("u")).alias("k")).orderBy("i").collect()]
    for u, n in zip(us[:-1], got, strict=False):
        at = n - int(k[0])
        # u lies in the step of n, but for the error of sums of doubles
        assert cdf[at] > u - 1e-9 and (at == 0 or cdf[at - 1] <= u + 1e-9)


def test_fit_rows_bounds_rows(spark, monkeypatch):
    """A key that repeats is one row of the sample, whatever it says."""
    sizes = []
    monkeypatch.setattr(quality_rules, "learn_rules", lambda x, bad, **_: sizes.append(len(bad)) or [])
    docs = spark.range(6000).select((F.col("id") % 3).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, 0), (77, 1)], "doc_id long, quality int")
    quality_rules.fit_rules(docs, labels, fit_rows=2)
    quality_rules.fit_rules(docs, labels)
    assert sizes and max(sizes) <= 3


def test_markup_is_no_text():
    texts = lambda page: [b.text for b in html_extract.blocks_of(page)]
    assert texts('<p>a</p><script src="x.js"/>code</script><p>b</p>') == ["a", "b"]
    assert texts('<style/>p {}</style><p>b</p>') == ["b"] and texts("<p>x <svg/> y</p>") == ["x y"]
    assert texts('<p title="a>b</p>') == ["b"] and texts("<p title=don't>c</p><div x='>d</div>") == ["c", "d"]
    assert texts("1 < 2 and 3 > 2") == ["1 < 2 and 3 > 2"] and texts("a <") == ["a <"]


def test_long_pages_run_in_steps():
    net, hasher = html_extract.Labeller.fresh(3), html_extract.Hasher()
    page = html_extract.blocks_of("".join(f"<div class=c{i % 7}><p>{'word ' * (i % 5 + 1)}</p></div>" for i in range(700)))
    x, mask = html_extract.padded([hasher.page(page)])
    whole = net.scores(x, mask)[0]
    for steps in (1, 64, 699, 700, 5000):
        assert np.allclose(net.long_scores(page, hasher, steps), whole, atol=1e-4)
    pages = [page[:n] for n in (0, 1, 5, 700, 30, 200)]
    for most in (16, 100, 10_000):
        got = html_extract.label_pages(net, pages, hasher, most=most)
        assert [len(g) for g in got] == [len(p) for p in pages]
        assert (got[3] == (whole > 0)).mean() > 0.99


def test_memory_does_not_follow_the_longest_page():
    """63 one-block pages beside one of 40,000 blocks."""
    code = """
import json, resource
from cataloom.llm import html_extract as h
net, hasher = h.Labeller.fresh(1), h.Hasher()
pages = [h.blocks_of("<p>short</p>") for _ in range(63)] + [h.blocks_of("<p>some words here.</p>" * 40_000)]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
h.label_pages(net, pages, hasher)
print(json.dumps((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024))
"""
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss > 0
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=sys.path[0] or ".", env={"PYTHONPATH": ":".join(sys.path), "OMP_NUM_THREADS": "1", "PATH": "/usr/bin"})
    assert json.loads(out.stdout.splitlines()[-1]) < 120


def test_a_worker_that_waits_gives_its_free_memory_back():
    code = """
import os, psutil
from cataloom.llm.common import by_bytes
rss = lambda: psutil.Process().memory_info().rss >> 20
blocks = [os.urandom(100_000) for _ in range(3000)]
last = blocks[-1]
del blocks
before = rss()
list(by_bytes(iter([]), "t", 1))
print(before - rss())
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env={**os.environ, "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))}, check=True)
    assert int(done.stdout) > 200
