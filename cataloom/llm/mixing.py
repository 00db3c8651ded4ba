"""Mixing sources to target weights by Poisson replication, with DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Sources up to this number are broadcast, a name and some 2,000 bytes each at most, if their names have NAME_BYTES together at most; more are
#: joined with salt.
BROADCAST_SOURCES, NAME_BYTES = 20_000, 4 << 20
#: Parts into which a source's rows are dealt where the sources are too many to broadcast.
SALTS = 64
#: Below this rate, a source's distribution is an array of its own, 250 numbers at most; from it on, its terms are summed for each row.
ARRAY_RATE = 100.0
#: Sums of terms go over so many standard deviations, and TAIL numbers more, on both sides of the mean.
DEVIATIONS, TAIL = 12, 30
#: Copies of one row that are made at a time.
COPIES = 1000


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) of 52 bits that depends on the parts alone; a null part counts as the word null."""
    text = F.concat_ws(":", *(F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))


def _log_term(k: Column, rate: Column) -> Column:
    """ln P(X = k) for k = 0 or a k of some hundred at least, by Stirling's series, whose error is then below that of the numbers."""
    # k ln(rate / k) + k - rate without the difference of two large numbers
    apart = k * F.log1p((rate - k) / k) + (k - rate)
    return F.when(k > 0, apart - 0.5 * F.log(2 * math.pi * k) - 1 / (12 * k) + 1 / (360 * k * k * k)).otherwise(-rate)


def poisson_count(rate: Column, u: Column) -> Column:
    """The lowest k with P(X <= k) > u of a Poisson distribution, at any rate: sums of its terms, kept as two numbers, no array of them.

    The sum begins DEVIATIONS standard deviations and TAIL numbers below the mean, or at 0; what lies below has a probability under
    1e-30. Where the sum is 1 in double precision, k is the last before. So it takes 2 * DEVIATIONS * sqrt(rate) steps, fewer than the
    copies that it counts from a rate of some hundred on.
    """
    rate = rate.cast("double")
    top = F.ceil(rate + DEVIATIONS * F.sqrt(rate) + TAIL).cast("bigint")
    low = F.floor(rate - DEVIATIONS * F.sqrt(rate) - TAIL)
    low = F.when(low >= 300, low).otherwise(0).cast("bigint")
    log = _log_term(low.cast("double"), rate)
    first = F.named_struct(F.lit("log"), log, F.lit("sum"), F.exp(log), F.lit("k"), low + F.when(F.exp(log) <= u, 1).otherwise(0))

    def step(acc: Column, k: Column) -> Column:
        log = acc["log"] + F.log(rate / k)
        total = acc["sum"] + F.exp(log)
        return F.named_struct(F.lit("log"), log, F.lit("sum"), total, F.lit("k"), acc["k"] + F.when((total <= u) & (total < 1 - 2.0**-52), 1).otherwise(0))

    return F.when(rate > 0, F.aggregate(F.sequence(low + 1, top), first, step)["k"]).otherwise(F.lit(0).cast("bigint"))


def poisson_cdf(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of a Poisson distribution with a rate below ARRAY_RATE, up to where it is 1 in double precision."""
    top = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    first = F.named_struct(F.lit("log"), -rate, F.lit("sum"), F.exp(-rate), F.lit("all"), F.array(F.exp(-rate)))

    def step(acc: Column, k: Column) -> Column:
        log = acc["log"] + F.log(rate) - F.log(k.cast("double"))
        total = acc["sum"] + F.exp(log)
        return F.named_struct(F.lit("log"), log, F.lit("sum"), total, F.lit("all"), F.concat(acc["all"], F.array(total)))

    cdf = F.aggregate(F.sequence(F.lit(1), F.when(rate < ARRAY_RATE, top).otherwise(1)), first, step)["all"]
    return F.when(rate >= ARRAY_RATE, F.lit(None)).when(rate > 0, F.filter(cdf, lambda c: c < F.lit(1 - 2.0**-52))).otherwise(F.array().cast("array<double>"))


def source_rates(docs: DataFrame, weights: Mapping[str, float], *, default_weight: float = 1.0, total: int | None = None, source: str = "source") -> DataFrame:
    """The mean repetitions of a document of each source, so that the sources share total rows (all rows of docs by default) by
    weight: s, n, rate, cdf (null from ARRAY_RATE on). The rows of all docs are counted. A null source is a source without a name; a source that weights
    lacks has default_weight."""
    named = F.create_map(*(F.lit(x) for pair in weights.items() for x in (pair[0], float(pair[1])))) if weights else F.lit(None).cast("map<string,double>")
    counts = written(docs.groupBy(F.col(source).alias("s")).agg(F.count("*").alias("n")).withColumn("w", F.coalesce(named[F.col("s")], F.lit(float(default_weight)))), "mix-counts")
    sums = counts.agg(F.sum("n"), F.sum("w")).first()
    rows, weight = (total if total is not None else sums[0] or 0), sums[1] or 1.0
    rate = F.lit(float(rows)) * F.col("w") / F.lit(float(weight)) / F.col("n")
    return counts.select("s", "n", rate.alias("rate")).withColumn("cdf", poisson_cdf(F.col("rate")))


def poisson_mix(docs: DataFrame, weights: Mapping[str, float], *, seed: int = 0, default_weight: float = 1.0, total: int | None = None, key: str = "doc_id", source: str = "source") -> DataFrame:
    """Repeats each document a Poisson number of times whose mean is its source's target rate, and shuffles all copies globally.

    The number is the inverse of the distribution at a uniform hash of (seed, key), so it depends on nothing else and a rerun
    gives the same; repeated rows with one key get the same number. Returns all columns of docs, then mix_copy (1, 2, ...) and
    mix_order, a hash by which the rows are sorted. Columns of docs with these names are replaced. A null key or source is a value
    like others; an empty table gives an empty table; texts are carried whole. A source with weight 0 gives no rows.

    Sources are few beside documents; their rates are broadcast up to BROADCAST_SOURCES of them with NAME_BYTES of names, and joined
    with salt beyond, so that a hot source is dealt over SALTS parts. A rare source with a large weight repeats few documents very
    often: their copies are made in parts of COPIES, and the shuffle by hash spreads them.
    """
    columns = [c for c in docs.columns if c not in ("mix_copy", "mix_order")]
    rates = written(source_rates(docs, weights, default_weight=default_weight, total=total, source=source), "mix-rates")
    packed = docs.select(F.struct(*columns).alias("doc"), F.col(key).alias("k"), F.col(source).alias("s"))
    size = rates.agg(F.count("*"), F.sum(F.octet_length(F.col("s").cast("string")))).first()
    if size[0] <= BROADCAST_SOURCES and (size[1] or 0) <= NAME_BYTES:
        joined = packed.join(F.broadcast(rates), packed["s"].eqNullSafe(rates["s"]))
    else:
        salted = rates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        packed = packed.withColumn("salt", F.pmod(F.xxhash64("k"), F.lit(SALTS)).cast("int"))
        joined = packed.join(salted, packed["s"].eqNullSafe(salted["s"]) & (packed["salt"] == salted["salt"]))
    drawn = joined.select("doc", "k", "rate", "cdf", uniform(F.lit(seed), "k").alias("u"))
    listed = F.size(F.filter("cdf", lambda c: c <= F.col("u"))).cast("bigint")
    counted = drawn.select("doc", "k", F.when(F.col("cdf").isNotNull(), listed).otherwise(poisson_count(F.col("rate"), F.col("u"))).alias("times")).filter("times > 0")
    parts = counted.select("doc", "k", "times", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("times") - 1) / COPIES))).alias("part"))
    copies = parts.select("doc", "k", F.explode(F.sequence(F.col("part") * COPIES + 1, F.least("times", (F.col("part") + 1) * COPIES))).alias("mix_copy")).withColumn("mix_copy", F.col("mix_copy").cast("int"))
    order = F.md5(F.concat_ws(":", F.lit(f"{seed}"), F.coalesce(F.col("k").cast("string"), F.lit("null")), F.col("mix_copy").cast("string")))
    return copies.withColumn("mix_order", order).orderBy("mix_order").select(*(F.col("doc")[c].alias(c) for c in columns), "mix_copy", "mix_order")
