"""Conversation structure repair: Wagner-Fischer alignment of turns with each feasible length of the alternating grammar string.

A repaired conversation has role initials (s?(ua)+)?, so its length alone tells the target string. Edits of turns are K(eep),
R(erole to user or assistant), D(elete, required for blank and duplicate turns) and I(nsert an empty user or assistant turn).
All targets of one last symbol are suffixes of one alternating string, so one matrix of costs from each cell to the end aligns the
turns with every feasible length at once. The incumbent, a greedy repair, bounds the cost, and so the band of cells (Ukkonen) and the
lengths. Lengths of equal cost are compared by their backtraced audits, the letters of the edits in order; the least in ASCII wins.

A conversation is cut into blocks of consecutive turns, wherever Spark's ranges and BLOCK cut it. A block is aligned for each pair of
symbols before and after it, and blocks are folded in order: min-plus products of four by four tables. Of two audits of one block with
equal cost and ends none begins with the other, so the lesser one stays the lesser whatever follows, and the fold is exact. No task so
holds more than BLOCK turns of a conversation, or FAN tables, however long it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

#: Costs of the edits, and what a truncated turn costs that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Turns of a block, and tables that are folded at a time.
BLOCK, FAN = 256, 256
#: What came last before or in a block: nothing, the system turn, a user turn, an assistant turn.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
_FAR = 1 << 40
_SPACE = " \t\n\x0b\x0c\r"
ROLES = {"s": "system", "u": "user", "a": "assistant"}


# --- one block -----------------------------------------------------------------------------------------------------------
# Turns are coded as letters: x must be deleted; s, u, a and o (any other) tell the role's initial; capitals are truncated.


def _greedy(turns: str, want: str) -> int:
    """The cost of keeping or reroling each turn in order: an upper bound, but for what the end needs."""
    cost = 0
    for c in turns:
        if c == "x":
            cost += DELETE
            continue
        cost += (0 if c.lower() == want else REROLE) + (TRUNCATED if c.isupper() else 0)
        want = "a" if want == "u" else "u"
    return cost


class _Matrix:
    """cost[i, k]: the least cost of aligning the turns from i on with the last k symbols of the alternating string that ends with end.

    first[i, k] is the same with a kept system turn before those k symbols. Cells off the band are _FAR.
    """

    def __init__(self, turns: str, end: str, most: int):
        n, self.turns, self.end = len(turns), turns, end
        must = turns.count("x")
        spare = most - DELETE * must
        width = n - must + spare // INSERT
        ks = np.arange(width + 1)
        self.symbols = np.where(ks % 2 == 1, ord(end), ord("u" if end == "a" else "a"))
        self.cost = np.full((n + 1, width + 1), _FAR, np.int64)
        self.first = np.full((n + 1, width + 1), _FAR, np.int64)
        left = 0
        for i in range(n, -1, -1):
            if i == n:
                row = np.where(ks <= spare // INSERT, INSERT * ks, _FAR)
            else:
                c, below = turns[i], self.cost[i + 1]
                left += c != "x"
                row = below + DELETE
                stay = TRUNCATED if c.isupper() else 0
                if c != "x":
                    row[1:] = np.minimum(row[1:], below[:-1] + stay + np.where(self.symbols[1:] == ord(c.lower()), 0, REROLE))
                row = np.minimum.accumulate(row - INSERT * ks) + INSERT * ks
                self.first[i] = self.first[i + 1] + DELETE
                if c.lower() == "s":
                    self.first[i] = np.minimum(self.first[i], below + stay)
            row[(ks < left - spare // DELETE) | (ks > left + spare // INSERT)] = _FAR
            self.cost[i] = np.minimum(row, _FAR)

    def audit(self, k: int, system: bool) -> str:
        """The least audit in ASCII among those of the least cost for k symbols."""
        out, i, n = [], 0, len(self.turns)
        if system:
            while self.first[i, k] == self.first[i + 1, k] + DELETE:
                out.append("D")
                i += 1
            out.append("K")
            i += 1
        cost = self.cost
        while i < n or k:
            here, c = cost[i, k], self.turns[i] if i < n else ""
            if i < n and here == cost[i + 1, k] + DELETE:
                out.append("D")
                i += 1
            elif k and here == cost[i, k - 1] + INSERT:
                out.append("I")
                k -= 1
            else:
                out.append("K" if c.lower() == chr(self.symbols[k]) else "R")
                i, k = i + 1, k - 1
        return "".join(out)

    def best(self, odd: int, least: int, system: bool) -> tuple[int, str] | None:
        """Least (cost, audit) over all lengths k of one parity from least on."""
        row = (self.first if system else self.cost)[0]
        ks = np.arange(least, len(row))
        ks = ks[ks % 2 == odd]
        if not len(ks) or (low := int(row[ks].min())) >= _FAR:
            return None
        return low, min(self.audit(int(k), system) for k in ks[row[ks] == low])


Table = list[tuple[int, str] | None]


def _aligned(turns: str) -> Table:
    """(cost, audit) of a block for each symbol before it (four rows) and after it (four columns); None where there is no way."""
    out: Table = [None] * 16
    n = len(turns)
    gone = (DELETE * n, "D" * n)
    most = max(_greedy(turns, "u"), _greedy(turns, "a")) + 2 * INSERT
    for end, after in (("u", USER), ("a", ASSISTANT)):
        m = _Matrix(turns, end, most)
        start_u, start_a = int(end == "u"), int(end == "a")  # parity of the lengths that begin with u, or with a
        out[USER * 4 + after] = m.best(start_a, 0, False)
        out[ASSISTANT * 4 + after] = m.best(start_u, 0, False)
        out[SYSTEM * 4 + after] = m.best(start_u, 1, False)
        out[NOTHING * 4 + after] = min(filter(None, (m.best(start_u, 1, False), m.best(start_u, 1, True))), default=None)
    # without a symbol of the alternating string
    out[NOTHING * 4 + NOTHING] = out[SYSTEM * 4 + SYSTEM] = gone
    kept = [(DELETE * (n - 1) + (TRUNCATED if c == "S" else 0), "D" * i + "K" + "D" * (n - 1 - i)) for i, c in enumerate(turns) if c in "sS"]
    out[NOTHING * 4 + SYSTEM] = min(kept, default=None)
    return out


_short = lru_cache(maxsize=1 << 16)(_aligned)


def align(turns: str) -> Table:
    """_aligned, remembered for short blocks: conversations have few different patterns."""
    return _short(turns) if len(turns) <= 16 else _aligned(turns)


def fold(tables: list[Table]) -> Table:
    """The table of consecutive blocks together."""
    out = tables[0]
    for t in tables[1:]:
        ways = [[(x[0] + y[0], x[1] + y[1]) for m in range(4) if (x := out[i * 4 + m]) and (y := t[m * 4 + o])] for i in range(4) for o in range(4)]
        out = [min(w, default=None) for w in ways]
    return out


def best_audit(table: Table) -> tuple[int, str]:
    """Least (cost, audit) of a whole conversation: it ends with an assistant turn, or nothing is left."""
    return min(x for x in (table[NOTHING * 4 + NOTHING], table[NOTHING * 4 + ASSISTANT]) if x)


def targets(audit: str) -> str:
    """The role initials of the repaired turns."""
    n = len(audit) - audit.count("D")
    return "s" * (n % 2) + "ua" * (n // 2)


# --- Spark ---------------------------------------------------------------------------------------------------------------

_COUNTS = ["blank", "duplicate", "truncated", "illegal", "turns"]
_TABLE = "p int, s long, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, head string, tail string, costs array<long>, audits array<string>"


def _summary(p: int, s: int, initials: str, faults: str, turns: list[int | None]) -> dict:
    """One block: what is counted in it, what is needed at its ends, and its table. faults: a letter of b, d, t or - for each turn."""
    known = [t for t in turns if t is not None]
    code = [("x" if f in "bd" else c.upper() if f == "t" else c) for c, f in zip((c if c in "sua" else "o" for c in initials), faults, strict=True)]
    table = align("".join(code))
    return {
        "p": p, "s": s, "blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t"),
        "illegal": sum(_illegal(a, b) for a, b in zip(initials, initials[1:], strict=False)),
        "turns": len(set(known)), "low": min(known, default=None), "high": max(known, default=None), "head": initials[0], "tail": initials[-1],
        "costs": [x and x[0] for x in table], "audits": [x and x[1] for x in table],
    }


def _illegal(a: str, b: str) -> bool:
    return a + b not in ("su", "ua", "au")


def _joined(rows: list[dict]) -> dict:
    """Consecutive blocks as one."""
    out = {c: sum(r[c] for r in rows) for c in _COUNTS} | {"p": rows[0]["p"], "s": rows[0]["s"], "head": rows[0]["head"], "tail": rows[-1]["tail"]}
    out["illegal"] += sum(_illegal(a["tail"], b["head"]) for a, b in zip(rows, rows[1:], strict=False))
    known = [r for r in rows if r["low"] is not None]
    out["turns"] -= sum(a["high"] == b["low"] for a, b in zip(known, known[1:], strict=False))
    out |= {"low": known[0]["low"] if known else None, "high": known[-1]["high"] if known else None}
    table = fold([[None if c is None else (c, a) for c, a in zip(r["costs"], r["audits"], strict=True)] for r in rows])
    return out | {"costs": [x and x[0] for x in table], "audits": [x and x[1] for x in table]}


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[bool, dict]]:
    """Each row, and whether it begins another group of keys."""
    last = None
    for batch in batches:
        for row in batch.to_pylist():
            key = [row[k] for k in keys]
            yield key != last, row
            last = key


def _packed(schema: pa.Schema, rows: Iterator[dict], size: int = 500) -> Iterator[pa.RecordBatch]:
    """Rows as batches of some hundred, or fewer with long texts."""
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += sum(len(x) for x in row.values() if isinstance(x, str)) + sum(len(x or "") for x in row.get("audits", ()))
        if len(held) >= size or chars > 1 << 22:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _arrow(df_schema, extra: str) -> tuple[str, pa.Schema]:
    """The schema (c, extra) as Spark and Arrow have it, c being of the key's type."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    kind = StructType([*df_schema.fields[:1], *_parse_datatype_string(extra).fields])
    return kind, to_arrow_schema(kind)


def _ordered(turns: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """(c, known, t, role, h, text): null roles and texts as one space, h the md5 of the text. Order is by all but text."""
    whole = F.coalesce(F.col(text), F.lit(" "))
    return turns.select(F.col(key).alias("c"), F.col(turn).isNotNull().cast("int").alias("known"), F.col(turn).cast("long").alias("t"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.unhex(F.md5(whole)).alias("h"), whole.alias("text"))


_ORDER = ["c", "known", "t", "role", "h"]


def _solid(text: Column) -> Column:
    """The text without ASCII white space at its end."""
    return F.rtrim(text, F.lit(_SPACE))


def audits(turns: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, gaps, blank, duplicate, truncated, illegal, cost, audit), a row for each conversation of turns.

    Turns go by number, null first; those of one number by role and md5 of the text, so that rows that repeat are side by side. Null
    roles and texts are one space: a role that isn't in the grammar, and a blank turn. A null key is a conversation. Each turn's first
    fault counts: blank (no character but ASCII white space), duplicate (role and text came before in the conversation), truncated (its
    last such character isn't one of .!?). gaps counts the missing numbers between the lowest and the highest turn, 0 if all are null.
    illegal counts adjacent turns whose role initials aren't su, ua or au. An empty table gives an empty table; other columns aren't read.
    """
    small_batches(turns.sparkSession)
    rows = _ordered(turns, key, turn, role, text)
    end = F.substring(_solid(F.col("text")), -1, 1)
    fault = F.when(end == "", "b").when(end.isin(".", "!", "?"), "-").otherwise("t")
    # rows that repeat are one with a number, added up before the shuffle
    once = rows.select(*_ORDER, fault.alias("f")).groupBy(*_ORDER, "f").agg(F.count("*").alias("n"))
    said = once.groupBy("c", "role", "h").agg(F.min(F.struct("known", "t")).alias("low"), F.max(F.struct("known", "t")).alias("high")).filter("low <> high OR (low.known = 0 AND high.known = 1)")
    # a table of its own, so that the join can split a conversation that says one thing all the time
    said = written(said.select(F.col("c").alias("c2"), F.col("role").alias("role2"), F.col("h").alias("h2"), "low"), "said-again")
    again = once.join(said, F.col("c").eqNullSafe(F.col("c2")) & (F.col("role") == F.col("role2")) & (F.col("h") == F.col("h2")), "left")
    first = F.col("low").isNull() | ((F.col("low.known") == F.col("known")) & F.col("low.t").eqNullSafe(F.col("t")))
    marked = again.select(*_ORDER, F.substring("role", 1, 1).alias("initial"), "f", first.alias("first"), "n")
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind, schema = _arrow(marked.schema, _TABLE)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            part, s = TaskContext.get().partitionId(), 0
            c, initials, faults, ts = None, [], [], []

            def out() -> dict:
                # an initial that isn't there is a blank, so that each turn has one letter
                return {"c": c} | _summary(part, s, "".join(initials), "".join(faults), ts)

            for new, row in _runs(batches, ["c"]):
                if new:
                    if initials:
                        yield out()
                    c, s, initials, faults, ts = row["c"], 0, [], [], []
                for j in range(row["n"]):
                    if len(initials) == BLOCK:
                        yield out()
                        s, initials, faults, ts = s + 1, [], [], []
                    initials.append(row["initial"] or " ")
                    faults.append(row["f"] if row["f"] == "b" or (j == 0 and row["first"]) else "d")
                    ts.append(row["t"])
            if initials:
                yield out()

        yield from _packed(schema, each())

    ranges = marked.repartitionByRange(n, *_ORDER).sortWithinPartitions(*_ORDER)
    tables = written(ranges.mapInArrow(blocks, kind), "turn-blocks")

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            held: list[dict] = []
            for new, row in _runs(batches, ["c", "g1", "g2"]):
                if new and held:
                    yield {"c": held[0]["c"]} | _joined(held)
                    held = []
                held.append(row)
            if held:
                yield {"c": held[0]["c"]} | _joined(held)

        yield from _packed(schema, each())

    while True:
        high = tables.groupBy("c").agg(F.count("*").alias("n"), F.max("s").alias("s")).agg(F.max("n"), F.max("s")).first()
        last = (high[0] or 0) <= FAN
        groups = [F.lit(0), F.lit(0)] if last else [F.col("p"), F.floor(F.col("s") / FAN)] if high[1] else [F.floor(F.col("p") / FAN), F.lit(0)]
        grouped = tables.withColumns({"g1": groups[0].cast("long"), "g2": groups[1].cast("long")})
        sorted_ = grouped.repartition(n, "c", "g1", "g2").sortWithinPartitions("c", "g1", "g2", "p", "s")
        got = sorted_.mapInArrow(folded, kind)
        if last:
            break
        tables = written(got.withColumn("s", F.floor(F.col("s") / FAN)) if high[1] else got.withColumn("p", F.floor(F.col("p") / FAN).cast("int")), "turn-folds")
    whole = [F.struct(F.get("costs", F.lit(i)).alias("cost"), F.get("audits", F.lit(i)).alias("audit")) for i in (NOTHING * 4 + NOTHING, NOTHING * 4 + ASSISTANT)]
    usable = F.filter(F.array(*whole), lambda x: x["cost"].isNotNull())
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long")
    return got.withColumn("best", F.array_min(usable)).select(F.col("c").alias(key), gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"))


def repaired_turns(turns: DataFrame, found: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, pos, edit, role, text): the repaired turns, by the audits found of the same turns.

    A conversation is in one partition, in order of pos; it is streamed, so only its audit is held. Inserted turns have an empty text.
    """
    spark = turns.sparkSession
    small_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _ordered(turns, key, turn, role, text).withColumn("audit", F.lit(None).cast("string"))
    heads = found.select(F.col(key).alias("c"), F.lit(-1).alias("known"), F.lit(None).cast("long").alias("t"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("h"), F.lit(None).cast("string").alias("text"), "audit")
    both = heads.unionByName(rows).repartition(n, "c").sortWithinPartitions(*_ORDER).select("c", "known", "role", "text", "audit")
    kind, schema = _arrow(both.schema, "pos long, edit string, role string, text string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            c, audit, want, at, pos = None, "", "", 0, 0

            def inserted() -> Iterator[dict]:
                nonlocal at, pos
                while at < len(audit) and audit[at] == "I":
                    yield {"c": c, "pos": pos, "edit": "I", "role": ROLES[want[pos]], "text": ""}
                    at, pos = at + 1, pos + 1

            for new, row in _runs(batches, ["c"]):
                if new:
                    yield from inserted()
                    c, audit, want, at, pos = row["c"], row["audit"], targets(row["audit"]), 0, 0
                    continue
                yield from inserted()
                edit = audit[at]
                at += 1
                if edit != "D":
                    yield {"c": c, "pos": pos, "edit": edit, "role": row["role"] if edit == "K" else ROLES[want[pos]], "text": row["text"]}
                    pos += 1
            yield from inserted()

        yield from _packed(schema, each())

    return both.mapInArrow(run, kind).withColumnRenamed("c", key)


def digests(repaired: DataFrame, *, key: str = "conv_id") -> DataFrame:
    """(key, repaired_sha256): of the role:text of each conversation, joined by newlines, streamed from repaired_turns."""
    kind, schema = _arrow(repaired.select(F.col(key).alias("c")).schema, "repaired_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            c, digest = None, None
            for new, row in _runs(batches, ["c"]):
                if new:
                    if digest is not None:
                        yield {"c": c, "repaired_sha256": digest.hexdigest()}
                    c, digest = row["c"], hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{row['role']}:{row['text']}".encode())
            if digest is not None:
                yield {"c": c, "repaired_sha256": digest.hexdigest()}

        yield from _packed(schema, each())

    return repaired.select(F.col(key).alias("c"), "role", "text").mapInArrow(run, kind).withColumnRenamed("c", key)


def damaged(turns: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """turns with faults by crc32(key:turn) % 20, nulls as one space: 0 drops the row, 1 empties its text, 2 removes its .!?, 3 repeats
    it, 4 makes its role user. (key, turn, role, text); other columns go."""
    name = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (key, turn)]
    fault = F.crc32(F.concat(name[0], F.lit(":"), name[1]).cast("binary")) % 20
    said = F.coalesce(F.col(text), F.lit(" "))
    rows = turns.select(F.col(key), F.col(turn), F.when(fault == 4, "user").otherwise(F.coalesce(F.col(role), F.lit(" "))).alias(role), F.when(fault == 1, "").when(fault == 2, F.regexp_replace(said, "[.!?]", "")).otherwise(said).alias(text), fault.alias("#fault"))
    return rows.filter(F.col("#fault") != 0).withColumn("#copy", F.explode(F.when(F.col("#fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("#fault", "#copy")


def repaired_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for each conv_id of conversations, after damage."""
    turns = damaged(conversations)
    found = written(audits(turns), "audits")
    digest = digests(repaired_turns(turns, found)).select(F.col("conv_id").alias("d"), "repaired_sha256")
    ids = conversations.select(F.col("conv_id").alias("id")).distinct()
    both = ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left").join(digest, F.col("id").eqNullSafe(F.col("d")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return both.select(F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
