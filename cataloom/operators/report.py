"""Profiles of data quality, as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import cleaned_overview, presence, strip
from ..schema import FALLBACK_ABOUT


def distribution(df: DataFrame, value: Column, name: str = "value") -> DataFrame:
    """(name, n, percent) of the first word of a column; blank is unset."""
    token = F.coalesce(F.nullif(F.get(F.split(strip(value), r"(?U)\s+"), F.lit(0)), F.lit("")), F.lit("unset"))
    counted = df.groupBy(token.alias(name)).agg(F.count("*").alias("n"))
    # one row for each distinct word
    return counted.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 1))


def completeness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(field, filled, empty, percent) of each column, from one pass; a field all has rows with every column."""
    tests = {c: presence(F.col(c).cast("string")).isNotNull() for c in columns}
    every = F.lit(True)
    for t in tests.values():
        every = every & t
    sums = df.agg(F.count("*").alias("rows"), *(F.count_if(t).alias(f"f{i}") for i, t in enumerate([*tests.values(), every])))
    cells = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"f{i}").alias("filled")) for i, c in enumerate([*tests, "all"])))
    out = sums.select("rows", F.explode(cells).alias("c")).select("c.field", "c.filled", (F.col("rows") - F.col("c.filled")).alias("empty"), "rows")
    return out.select("field", "filled", "empty", F.when(F.col("rows") > 0, F.round(100 * F.col("filled") / F.col("rows"), 1)).alias("percent"))


def coverage(entities: DataFrame) -> DataFrame:
    """Counts of a catalogue: rows, those of several shows, with conflicts, real descriptions, websites and categories."""
    return entities.agg(
        F.count("*").alias("rows"),
        F.count_if(F.size("locations") > 1).alias("multi_show"),
        F.count_if(F.coalesce(F.size("hq_country_conflict"), F.lit(0)) > 1).alias("conflicts"),
        F.count_if((strip(F.col("about")) != "") & (F.col("about") != FALLBACK_ABOUT)).alias("with_about"),
        F.count_if(presence(F.col("website")).isNotNull()).alias("with_website"),
    )


def _exact_mean(value: Column) -> Column:
    """The mean to one digit, from an exact sum: tenths are the whole part of (20 sum + n) / 2 n for what isn't negative."""
    exact = value.try_cast("decimal(28,6)")
    total, n = F.sum(exact), F.count(exact)
    tenths = F.call_function("div", 20 * F.abs(total) + n, (2 * n).cast("decimal(20,0)"))
    mean = F.when(n > 0, F.signum(total) * tenths / 10)
    return F.when(F.count(value) > n, F.round(F.avg(value), 1)).otherwise(mean)


def scrape_summary(df: DataFrame, group: str = "_file") -> DataFrame:
    """By file: rows, without url, read, failed, rate of success in percent, mean characters, and "reason: n; ..." of failures.

    The mean is that of the values as decimals of six digits, rounded half up from the exact quotient, so it doesn't depend on the order
    of rows. Values that aren't decimals (NaN, infinite) make it a mean of doubles.
    """
    ok, no_url = F.col("status") == "ok", F.col("status") == "no_url"
    reasons = df.filter(~ok & ~no_url).groupBy(group, "status").agg(F.count("*").alias("n"))
    texts = reasons.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "status", "n"))), lambda x: F.concat_ws(": ", x["status"], x["n"])), "; ").alias("errors"))
    sums = df.groupBy(group).agg(F.count("*").alias("total"), F.count_if(no_url).alias("no_url"), F.count_if(ok).alias("success"), F.count_if(~ok & ~no_url).alias("failed"), _exact_mean(F.when(ok, F.col("chars"))).alias("avg_chars"))
    tried = F.col("success") + F.col("failed")
    return sums.join(texts, group, "left").withColumns({"success_rate": F.when(tried > 0, F.round(100 * F.col("success") / tried, 1)), "errors": F.coalesce("errors", F.lit(""))})


def failures(df: DataFrame) -> DataFrame:
    """(status, n) of rows that weren't read."""
    return df.filter("status <> 'ok'").groupBy("status").agg(F.count("*").alias("n"))


def by_halls(df: DataFrame) -> DataFrame:
    """(halls, n) with halls joined by |."""
    return df.groupBy(F.concat_ws("|", F.transform("halls", lambda h: h.cast("string"))).alias("halls")).agg(F.count("*").alias("n"))


def duplicate_ids(df: DataFrame, column: str) -> DataFrame:
    """(column, n) of ids that stand in several rows."""
    return df.groupBy(column).agg(F.count("*").alias("n")).filter("n > 1")


def boilerplate_audit(df: DataFrame, key: str, text: str, limit: int | None = None) -> DataFrame:
    """(key, removed, cleaned) of rows that lose a sentence to cleaning; limit makes it the sample of a report."""
    rows = df.select(key, cleaned_overview(F.col(text)).alias("c")).filter(F.size("c.removed") > 0).select(key, F.col("c.removed").alias("removed"), F.col("c.cleaned").alias("cleaned"))
    return rows.orderBy(key).limit(limit) if limit else rows


def completeness_of_scan(df: DataFrame, page_text: str, parsed: str = "parsed") -> DataFrame:
    """Adds announced (the "N Exhibitors" of a page) and complete: fewer than five rows off."""
    announced = F.nullif(F.regexp_extract(page_text, r"(\d+) Exhibitors", 1), F.lit("")).try_cast("int")
    return df.withColumns({"announced": announced, "complete": F.abs(announced - F.col(parsed)) < 5})


def inferred(*columns: Column) -> Column:
    """Texts marked (inferred): at most one for each text; columns may be texts, lists or maps of texts."""
    mark = lambda x: F.lower(F.coalesce(x, F.lit(""))).contains("(inferred)")
    total = F.lit(0)
    for c in columns:
        total = total + F.coalesce(F.size(F.filter(c, mark)), F.lit(0))
    return total


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows that depend on the seed and key alone, in order of key."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n).orderBy(key)
