"""Repair of conversations against a search through all states, and edge cases."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cataloom.llm import conversation_repair as cr

SMALL = "/root/testdata/sf0.001"
NEXT = {"": {"s", "u"}, "s": {"u"}, "u": {"a"}, "a": {"u"}}


def searched(codes):
    """Least (cost, audit) by relaxing all ways through (turns read, last symbol), without any bound."""
    best = {(0, ""): (0, "")}
    for i in range(len(codes) + 1):
        for _ in range(4):
            for (j, last), (cost, audit) in list(best.items()):
                for sym in NEXT[last] - {"s"} if j == i else ():
                    best[i, sym] = min(best.get((i, sym), (10**9, "")), (cost + 3, audit + "I"))
        if i == len(codes):
            break
        c = codes[i]
        for (j, last), (cost, audit) in list(best.items()):
            if j != i:
                continue
            ways = [(last, cost + 4, "D")]
            if c != "x":
                stay = 3 if c.isupper() else 0
                for sym in NEXT[last]:
                    if sym == c.lower():
                        ways.append((sym, cost + stay, "K"))
                    elif sym != "s":
                        ways.append((sym, cost + stay + 3, "R"))
            for sym, total, letter in ways:
                best[i + 1, sym] = min(best.get((i + 1, sym), (10**9, "")), (total, audit + letter))
    return min(best[k] for k in ((len(codes), ""), (len(codes), "a")) if k in best)


def test_all_short_conversations():
    for n in range(5):
        for codes in itertools.product("suaoxSUA", repeat=n):
            codes = "".join(codes)
            assert cr.best_audit(cr.align(codes)) == searched(codes), codes


@pytest.mark.parametrize("seed", range(60))
def test_longer_conversations_whole_and_in_blocks(seed):
    r = random.Random(seed)
    n = r.randrange(5, 70)
    codes = "".join(("ua"[i % 2] if r.random() < 0.6 else r.choice("suaoxSUAO")) for i in range(n))
    want = searched(codes)
    assert cr.best_audit(cr.align(codes)) == want
    cuts = sorted({0, n, *(r.randrange(n) for _ in range(r.randrange(6)))})
    assert cr.best_audit(cr.fold([cr.align(codes[a:b]) for a, b in itertools.pairwise(cuts)])) == want


def expected(rows):
    """The contract's columns of (conv, turn, role, text) rows by plain Python."""
    groups = defaultdict(list)
    for c, t, role, text in rows:
        groups[c]  # also those of which nothing is left
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if h == 0:
            continue
        text = "" if h == 1 else "".join(x for x in text if x not in ".!?") if h == 2 else text
        groups[c] += [(t is not None, t or 0, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    out = {}
    for c, turns in groups.items():
        turns.sort(key=lambda x: (*x[:3], hashlib.md5(x[3].encode()).digest()))
        seen, codes, n = set(), "", defaultdict(int)
        for _, _, role, text in turns:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            code = role[:1] if role[:1] in ("s", "u", "a") else "o"
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            n[fault] += 1
            codes += "x" if fault in ("blank", "duplicate") else code.upper() if fault else code
        known = [t for k, t, _, _ in turns if k]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        cost, audit = searched(codes)
        length = len(audit) - audit.count("D")
        want = "s" * (length % 2) + "ua" * (length // 2)
        parts, left = [], iter(turns)
        for letter in audit:
            turn = None if letter == "I" else next(left)
            if letter == "D":
                continue
            role = turn[2] if letter == "K" else {"u": "user", "a": "assistant"}[want[len(parts)]]
            parts.append(f"{role}:{turn[3] if turn else ''}")
        assert len(parts) == length
        out[c] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(parts).encode()).hexdigest())
    return out


def got(df):
    return {r["conv_id"]: tuple(r)[1:] for r in cr.repaired_conversations(df).collect()}


def test_given_conversations(spark):
    df = spark.read.parquet(f"{SMALL}/conversations.parquet")
    assert got(df) == expected([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in df.collect()])


def edge_rows():
    r = random.Random(3)
    rows = [(None, i, role, "Yes.") for i, role in enumerate(["user", "assistant", None, "tool"])]
    rows += [(1, None, "user", "Hello."), (1, None, None, None), (1, None, "user", "Hello."), (2, 5, "system", ""), (3, 0, "", " \t\n"), (4, 7, "user", "a" * 200_000)]
    rows += [(5, t, r.choice(["user", "assistant", "system"]), r.choice(["One.", "Two", "Three!", ""])) for t in (0, 0, 1, 1, 1, 2, 9, 9, 9, 9)]
    rows += [(6, 3, "user", "Same.")] * 40 + [(6, 4, "assistant", "Same.")] * 40
    rows += [(7, t, r.choice(["user", "assistant"]), f"{r.random()}" + r.choice([".", "", "?"])) for t in range(700)]
    rows += [(8 + i, 0, "user", "x.") for i in range(60)]
    return rows


def test_nulls_ties_repeats_and_long_conversations(spark, monkeypatch):
    rows = edge_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("c", F.lit(1)).withColumn("audit", F.lit("x")).withColumn("h", F.lit(None).cast("string"))
    want = expected(rows)
    assert got(df) == want
    monkeypatch.setattr(cr, "BLOCK", 7)
    monkeypatch.setattr(cr, "FAN", 2)
    assert got(df.repartition(5)) == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert got(df) == {}


def test_repaired_turns_follow_the_grammar(spark):
    df = spark.read.parquet(f"{SMALL}/conversations.parquet")
    turns = cr.damaged(df)
    found = cr.audits(turns).cache()
    by = defaultdict(list)
    for r in cr.repaired_turns(turns, found).collect():
        by[r["conv_id"]].append(r)
    for r in found.collect():
        initials = "".join(x["role"][0] for x in sorted(by[r["conv_id"]], key=lambda x: x["pos"]))
        assert initials == cr.targets(r["audit"])
        assert "".join(x["edit"] for x in sorted(by[r["conv_id"]], key=lambda x: x["pos"])) == r["audit"].replace("D", "")
