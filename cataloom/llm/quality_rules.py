"""Quality rules: learned decision lists over text statistics.

Sequential covering grows and prunes conjunctions of thresholds from labelled statistics; the list is emitted as one ordered
conditional expression, which Spark evaluates for every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, mix64, small_batches, texts_of, windows, word_hashes

#: Labelled rows for fitting, at most; chosen by a hash of their id, so alike at every size.
FIT_ROWS = 20_000
BATCH_BYTES = 4 << 20

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What rules may test, beside the counts: shares of what the text has.
SHARES = ("symbols_per_word", "symbol_share", "upper_share", "digit_share", "repeat_share", "dup_line_share", "bang_share", "bar_share", "word_length", "words_per_line", "ascii_share", "distinct_share")
FEATURES = (*COUNTS, *SHARES)


def _table(*members: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list("".join(members).encode())] = True
    return t


_SPACES = _table(" \t\n\x0b\x0c\r")
_SYMBOLS = _table("#*$%&|<>")
_UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGITS = _table("0123456789")
_BANG, _BAR, _NEWLINE = _table("!"), _table("|"), _table("\n")


def _dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split(b"\n")
    if len(lines) < 2:
        return 0
    seen: set[bytes] = set()
    n = 0
    for line in lines:
        if line in seen:
            n += bool(line.strip(b" \t\n\x0b\x0c\r"))
        else:
            seen.add(line)
    return n


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The counts and shares of each text. Words are runs of anything but ASCII white space."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(t + b"\n" for t in texts), np.uint8)
    starts = np.cumsum(size + 1) - size - 1

    def count(flags: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flags, starts, dtype=np.int64) if len(texts) else np.zeros(0, np.int64)

    hashes, first = word_hashes(texts)
    n_words = np.diff(first)
    repeat, distinct = _repeats(hashes, first)
    chars = count((data & 0xC0 != 0x80) & ~_SPACES[data])
    lines = count(_NEWLINE[data])
    out = {
        "n_words": n_words,
        "word_chars": chars,
        "n_symbols": count(_SYMBOLS[data]),
        "n_dup_lines": np.fromiter(map(_dup_lines, texts), np.int64, len(texts)),
        "n_repeat_words": repeat,
    }
    c, w, n = np.maximum(chars, 1), np.maximum(n_words, 1), np.maximum(lines, 1)
    shares = {
        "symbols_per_word": out["n_symbols"] / w,
        "symbol_share": out["n_symbols"] / c,
        "upper_share": count(_UPPER[data]) / c,
        "digit_share": count(_DIGITS[data]) / c,
        "repeat_share": repeat / w,
        "dup_line_share": out["n_dup_lines"] / n,
        "bang_share": count(_BANG[data]) / c,
        "bar_share": count(_BAR[data]) / c,
        "word_length": chars / w,
        "words_per_line": n_words / n,
        "ascii_share": count((data < 128) & ~_SPACES[data]) / c,
        "distinct_share": distinct / w,
    }
    return out | shares


def _repeats(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text: words in 3-word windows found twice or more in it, and distinct words."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    salt = mix64(np.arange(len(first) - 1, dtype=np.uint64) + np.uint64(1))
    inside = np.zeros(len(hashes), np.int64)
    three = windows(hashes, 3)
    if len(three):
        whole = owner[:-2] == owner[2:]
        at = np.flatnonzero(whole)
        _, place, often = np.unique(three[at] ^ salt[owner[at]], return_inverse=True, return_counts=True)
        hit = at[often[place] > 1]
        for i in range(3):
            inside[hit + i] = 1
    unique = np.unique(hashes ^ salt[owner], return_index=True)[1]
    total = lambda x: np.bincount(owner, weights=x, minlength=len(first) - 1).astype(np.int64)
    return total(inside), np.bincount(owner[unique], minlength=len(first) - 1)


def text_statistics(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and all FEATURES of every whole text, a row for each row of docs. A null or empty text has no words and all values 0."""
    small_batches(docs.sparkSession)
    schema = T.StructType([T.StructField("k", docs.schema[key].dataType), *(T.StructField(f, T.LongType() if f in COUNTS else T.DoubleType()) for f in FEATURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, "t", BATCH_BYTES):
            m = measure(texts_of(part.column("t")))
            yield pa.record_batch([part.column("k"), *(pa.array(m[f], pa.int64() if f in COUNTS else pa.float64()) for f in FEATURES)], names=["k", *FEATURES])

    return docs.selectExpr(f"`{key}` AS k", f"`{text}` AS t").mapInArrow(run, schema).withColumnRenamed("k", key)


# --- learning ------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Condition:
    """feature <= value, or feature > value."""

    feature: str
    above: bool
    value: float

    def column(self) -> Column:
        return F.col(self.feature) > self.value if self.above else F.col(self.feature) <= self.value

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.value if self.above else x[self.feature] <= self.value


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _best(x: dict[str, np.ndarray], bad: np.ndarray, cover: np.ndarray) -> Condition | None:
    """The condition of the greatest information gain over what a rule covers so far."""
    p0, n0 = int(bad[cover].sum()), int((~bad[cover]).sum())
    before = np.log2(p0 / (p0 + n0))
    best, gain = None, 1e-9
    for f, values in x.items():
        order = np.argsort(values[cover], kind="stable")
        v, b = values[cover][order], bad[cover][order]
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        p, n = np.cumsum(b)[cut], np.cumsum(~b)[cut]
        for above, pp, nn in ((False, p, n), (True, p0 - p, n0 - n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                g = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - before), -1)
            i = int(np.argmax(g))
            if g[i] > gain:
                gain, best = g[i], Condition(f, above, float((v[cut[i]] + v[cut[i] + 1]) / 2))
    return best


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, *, min_precision: float = 0.9, min_support: int = 8, max_conditions: int = 4, max_rules: int = 24, seed: int = 7) -> list[Rule]:
    """Rules for bad rows, in order; a row that none covers is good.

    Two thirds of the rows grow a rule and the rest prune it. A rule stays if its smoothed precision over all rows left,
    (bad + 1) / (covered + 2), reaches min_precision and it covers min_support bad rows; else learning ends.
    """
    n = len(bad)
    left = np.ones(n, bool)
    grow = (mix64(np.arange(n, dtype=np.uint64) + np.uint64(seed)) % np.uint64(3)) != 0
    rules: list[Rule] = []
    while len(rules) < max_rules and bad[left].sum() >= min_support:
        rule: Rule = ()
        cover = left & grow
        while len(rule) < max_conditions and bad[cover].any() and (~bad[cover]).any():
            c = _best(x, bad, cover)
            if c is None:
                break
            rule, cover = (*rule, c), cover & c.holds(x)
        if not rule:
            break
        held = left & ~grow

        def worth(r: Rule, held: np.ndarray = held) -> float:
            c = _covers(r, x, n) & held
            p, q = int(bad[c].sum()), int((~bad[c]).sum())
            return (p + 1) / (p + q + 2)

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        c = _covers(rule, x, n) & left
        p = int(bad[c].sum())
        if p < min_support or (p + 1) / (int(c.sum()) + 2) < min_precision:
            break
        rules.append(rule)
        left &= ~c
    return rules


def fit_rules(docs: DataFrame, labels: DataFrame, *, fit_rows: int = FIT_ROWS, key: str = "doc_id", text: str = "text", label: str = "quality", **learning: float) -> list[Rule]:
    """Learns rules for label 0 from at most fit_rows labelled documents, chosen by a hash of their key.

    Null labels and keys are left out, and so are keys with labels that differ or without a document. Of rows with one key the text
    with the lowest hash counts, so there is one row for each key. The statistics of the chosen rows, a few MB, go to the driver.
    Without labels of both kinds there are no rules.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("lk")).agg(F.min(label).alias("a"), F.max(label).alias("b")).filter("a = b")
    known = known.join(docs.select(F.col(key).alias("lk")).distinct(), "lk", "left_semi")
    chosen = known.select("lk", F.col("a").alias("label")).orderBy(F.xxhash64("lk"), "lk").limit(fit_rows)
    rows = docs.select(F.col(key).alias("lk"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(chosen), "lk")
    # combined before the shuffle, so a key that repeats without end sends one text from each task
    rows = rows.groupBy("lk", "label").agg(F.min_by("t", F.struct(F.xxhash64("t"), F.col("t"))).alias("t")).select(F.struct("lk", "label").alias("id"), "t")
    sample = text_statistics(rows, key="id", text="t").selectExpr("id.lk AS lk", "id.label AS label", *FEATURES).toPandas()
    sample = sample.sort_values(["lk", *FEATURES], kind="stable")
    if sample["label"].nunique() < 2:
        return []
    return learn_rules({f: sample[f].to_numpy(np.float64) for f in FEATURES}, (sample["label"] == 0).to_numpy(), **learning)


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, or 0: WHEN rule 1 THEN 1 WHEN rule 2 THEN 2 ... ELSE 0."""
    out = None
    for i, rule in enumerate(rules, 1):
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = F.when(test, i) if out is None else out.when(test, i)
    return F.lit(0) if out is None else out.otherwise(0)


def judge(docs: DataFrame, rules: list[Rule], *, min_words: int = 50, max_repeat_percent: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the COUNTS, base_failed, rule (the learned rule that rejects, or 0) and kept, a row for each row of docs.

    base_failed: fewer than min_words words, or more than max_repeat_percent of them in repeated 3-word windows. kept is false if
    base_failed, else whether no rule holds. A null or empty text has no words and so fails; repeated rows give repeated rows.
    """
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    stats = text_statistics(docs, key=key, text=text).withColumn("rule", verdict(rules))
    return stats.select(key, *COUNTS, failed.alias("base_failed"), "rule", (~failed & (F.col("rule") == 0)).alias("kept"))


def kept(docs: DataFrame, rules: list[Rule], *, text: str = "text", **limits: int) -> DataFrame:
    """The rows of docs that judge keeps, with their columns.

    Rows are carried through the statistics as they are, so there is no join back; columns may have any names.
    """
    failed = judge(docs.select(F.struct("*").alias("id"), F.col(text).alias("t")), rules, key="id", text="t", **limits)
    return failed.filter("kept").select("id.*")
