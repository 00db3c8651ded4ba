"""Conforming sources to one schema, and the joins that enrich them. First or last wins by an explicit ordinal."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import is_suspicious
from ..functions.text import presence, snippet_key, strip
from ..functions.urls import booth_id
from ..schema import RECORD
from ..sources.storage import stored
from .numbering import numbered


class Resolver(Protocol):
    """Says what each of some values stands for, for instance the country of an address."""

    def resolve(self, values: Sequence[str]) -> Mapping[str, str]: ...


def conformed(df: DataFrame, schema: T.StructType = RECORD, keep: Sequence[str] = ()) -> DataFrame:
    """The fields of schema, nulls as empty strings and arrays, and the columns named in keep; other columns are dropped.

    A record that has sources or locations but no url or location of its own takes those of the first.
    """
    have = set(df.columns)

    def column(f: T.StructField) -> Column:
        c = F.col(f.name) if f.name in have else F.lit(None)
        if f.name == "ebooth_url" and "sources" in have:
            c = F.coalesce(c, F.get("sources", F.lit(0))["ebooth_url"])
        if f.name == "location" and "locations" in have:
            c = F.coalesce(c, F.get("locations", F.lit(0)))
        empty = F.array().cast(f.dataType) if isinstance(f.dataType, T.ArrayType) else F.lit("").cast(f.dataType)
        return F.coalesce(c.cast(f.dataType), empty).alias(f.name)

    return df.select(*keep, *(column(f) for f in schema.fields))


def union_conformed(parts: Sequence[DataFrame], schema: T.StructType = RECORD) -> DataFrame:
    """All parts as one table of schema, each row with _file and _seq."""
    out = None
    for i, df in enumerate(parts):
        ready = df if "_file" in df.columns else df.withColumn("_file", F.lit(f"part-{i}"))
        ready = conformed(ready if "_seq" in ready.columns else ready.withColumn("_seq", F.monotonically_increasing_id()), schema, ("_file", "_seq"))
        out = ready if out is None else out.unionByName(ready)
    return out


def schema_drift(raw: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(_file, dropped, missing) from records as maps: fields that the schema lacks, and fields that no record of the file has."""
    keys = raw.select("_file", F.explode(F.map_keys("record")).alias("field")).distinct().groupBy("_file").agg(F.collect_set("field").alias("have"))
    wanted = F.array(*(F.lit(f) for f in fields))
    return keys.select("_file", F.array_sort(F.array_except("have", wanted)).alias("dropped"), F.array_sort(F.array_except(wanted, F.col("have"))).alias("missing"))


def lift_location(df: DataFrame) -> DataFrame:
    """location and url as lists, for records of one show. Records that have locations keep them and their sources; one without a place
    gets empty lists."""
    source = T.StructType([T.StructField("location", T.StringType()), T.StructField("ebooth_url", T.StringType())])
    have = lambda c, kind: F.col(c) if c in df.columns else F.lit(None).cast(T.ArrayType(kind))
    lifted = have("locations", T.StringType()).isNull()
    placed = F.coalesce(F.col("location"), F.lit("")) != ""
    locations = F.when(placed, F.array("location")).otherwise(F.array().cast("array<string>"))
    sources = F.when(placed, F.array(F.struct("location", "ebooth_url").cast(source))).otherwise(F.array().cast(T.ArrayType(source)))
    return df.withColumns({"locations": F.when(lifted, locations).otherwise(have("locations", T.StringType())), "sources": F.when(lifted, sources).otherwise(have("sources", source))})


def last_by(df: DataFrame, key: Column, columns: Sequence[str], seq: str = "_seq") -> DataFrame:
    """(k, columns): the row of each key with the highest ordinal; rows without key are left out."""
    return df.select(key.alias("k"), F.col(seq).alias("_o"), *columns).filter("k IS NOT NULL").groupBy("k").agg(F.max_by(F.struct(*columns), "_o").alias("v")).select("k", "v.*")


def recovered_snippets(df: DataFrame) -> DataFrame:
    """Rows whose website holds the snippet, as shifted columns leave it, get it back."""
    shifted = presence(F.col("website")).isNotNull() & ~F.lower(strip(F.col("website"))).startswith("http")
    return df.withColumns({"snippet": F.when(shifted, F.col("website")).otherwise(F.col("snippet")), "website": F.when(shifted, "").otherwise(F.col("website"))})


def with_snippets(entities: DataFrame, snippets: DataFrame) -> DataFrame:
    """Adds snippet by name, the last of a name, "" where there is none; snippet_match tells text, empty or none."""
    found = last_by(recovered_snippets(snippets), snippet_key(F.col("company")), ["snippet"])
    out = entities.join(found, snippet_key(entities["company_name"]) == found["k"], "left")
    state = F.when(F.col("k").isNull(), "none").when(presence(F.col("snippet")).isNull(), "empty").otherwise("text")
    return out.withColumns({"snippet_match": state, "snippet": F.coalesce("snippet", F.lit(""))}).drop("k")


def overwritten(base: DataFrame, translations: DataFrame, columns: Sequence[str] = ("about", "hq_location", "website_scrape")) -> DataFrame:
    """Columns of matched rows (by trimmed name) replaced by the translation's, also by empty ones; others unchanged."""
    t = last_by(translations, strip(F.col("company_name")), list(columns))
    t = t.select(F.col("k").alias("_k"), *(F.col(c).alias(f"_t_{c}") for c in columns))
    out = base.join(t, strip(base["company_name"]) == F.col("_k"), "left")
    return out.withColumns({c: F.when(F.col("_k").isNotNull(), F.coalesce(f"_t_{c}", F.lit(""))).otherwise(F.col(c)) for c in columns}).select(*base.columns)


def backfilled(base: DataFrame, supplement: DataFrame, columns: Sequence[str] = ("about", "website"), groups: Sequence[Sequence[str]] = ()) -> DataFrame:
    """Empty columns filled from the row with the same booth number, or else the same trimmed name.

    The columns of a group are filled together, if its first is empty.
    """
    every = [*columns, *(c for g in groups for c in g)]
    by_booth = last_by(supplement, F.nullif(booth_id(F.col("ebooth_url")), F.lit("")), every).select(F.col("k").alias("_bk"), F.struct(*every).alias("_b"))
    by_name = last_by(supplement, F.nullif(strip(F.col("company_name")), F.lit("")), every).select(F.col("k").alias("_nk"), F.struct(*every).alias("_n"))
    out = base.join(by_booth, booth_id(base["ebooth_url"]) == F.col("_bk"), "left").join(by_name, strip(base["company_name"]) == F.col("_nk"), "left").withColumn("_s", F.coalesce("_b", "_n"))
    kinds = dict(base.dtypes)

    def empty(c: str) -> Column:
        return F.coalesce(F.size(c), F.lit(0)) <= 0 if kinds[c].startswith("array") else strip(F.col(c)) == ""

    new = {c: F.when(empty(c), F.coalesce(F.col("_s")[c], F.col(c))).otherwise(F.col(c)) for c in columns}
    for g in groups:
        new |= {c: F.when(empty(g[0]), F.coalesce(F.col("_s")[c], F.col(c))).otherwise(F.col(c)) for c in g}
    return out.select(*(new.get(c, F.col(c)).alias(c) for c in base.columns))


def trusted_overwrite(base: DataFrame, trusted: DataFrame) -> DataFrame:
    """hq_location replaced by the trusted row's with the same booth number, suspicious or not; hq_location_source tells from where,
    and still_suspicious which values look like a scraper's default."""
    t = last_by(trusted, F.nullif(booth_id(F.col("ebooth_url")), F.lit("")), ["hq_location"]).select(F.col("k").alias("_k"), F.col("hq_location").alias("_hq"))
    out = base.join(t, booth_id(base["ebooth_url"]) == F.col("_k"), "left")
    hit = F.col("_k").isNotNull()
    out = out.withColumns({"hq_location": F.when(hit, F.col("_hq")).otherwise(F.col("hq_location")), "hq_location_source": F.when(hit, "trusted").otherwise("base")})
    return out.withColumn("still_suspicious", is_suspicious(F.col("hq_location"))).drop("_k", "_hq")


def only_in(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of a whose key b lacks; a null key is in no table."""
    return a.join(b.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")


def zipped(a: DataFrame, b: DataFrame, seq: str = "_seq") -> DataFrame:
    """Rows side by side by their place in the order of the ordinal, whatever gaps it has: row i of a with row i of b, and a's ordinal.
    Raises if the numbers of rows differ, or if an ordinal is null or repeats, since there is no order then."""
    sides = []
    for df in (a, b):
        n, known = df.agg(F.count("*"), F.countDistinct(seq)).first()
        if n != known:
            raise ValueError(f"{n} rows have {known} different ordinals")
        sides.append(n)
    if sides[0] != sides[1]:
        raise ValueError(f"tables of {sides[0]} and {sides[1]} rows can't be joined by position")
    return numbered(a, seq, name="_place").join(numbered(b, seq, name="_place").drop(seq), "_place").drop("_place")


def fallback_join(base: DataFrame, other: DataFrame, columns: Sequence[str], index: str = "row_index") -> DataFrame:
    """Columns of other by row index, else by lower-case trimmed name; null where neither fits."""
    by_index = last_by(other, F.col(index), list(columns), index).select(F.col("k").alias("_ik"), F.struct(*columns).alias("_i"))
    by_name = last_by(other, F.lower(strip(F.col("company_name"))), list(columns), index).select(F.col("k").alias("_nk"), F.struct(*columns).alias("_n"))
    out = base.join(by_index, base[index] == F.col("_ik"), "left").join(by_name, F.lower(strip(base["company_name"])) == F.col("_nk"), "left")
    return out.select(*base.columns, *(F.coalesce(F.col("_i")[c], F.col("_n")[c]).alias(c) for c in columns))


def merged_into(catalogue: DataFrame, new: DataFrame) -> DataFrame:
    """Entities (company_name, locations, sources, ...) joined by lower-case trimmed name: known ones get the new locations and
    sources, unknown ones are added. Both tables have _seq; the catalogue's rows come first."""
    other = [c for c in catalogue.columns if c not in ("locations", "sources", "_seq")]
    rows = catalogue.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    order = F.struct("_side", "_seq")
    grouped = rows.groupBy(F.lower(strip(F.col("company_name"))).alias("_k")).agg(
        F.min_by(F.struct(*other), order).alias("v"),
        F.sort_array(F.collect_list(F.struct(order.alias("o"), "locations", "sources"))).alias("all"),
    )
    return grouped.select("v.*", F.array_distinct(F.flatten("all.locations")).alias("locations"), F.flatten("all.sources").alias("sources"))


def mapped_distinct(df: DataFrame, column: str, mapping: Column, name: str) -> DataFrame:
    """Applies a costly mapping to the distinct values of a column and joins the result back."""
    values = df.select(column).filter(presence(F.col(column)).isNotNull()).distinct().withColumn(name, mapping)
    return df.join(values, column, "left")


def resolved_in_batches(df: DataFrame, column: str, resolver: Callable[[], Resolver], name: str, size: int = 50) -> DataFrame:
    """Adds what a resolver says of each distinct value of column, white space at its ends aside; null where it says nothing.

    Distinct values are numbered densely and dealt in batches of size, so there are as few calls as can be; a value that a batch's reply
    leaves out, or a batch that fails, is asked for once more, alone. Blank values aren't asked for. Replies are stored before they
    are joined, so a plan that is reused doesn't ask again.
    """
    value = strip(F.col(column))
    values = numbered(df.select(value.alias("value")).filter("value <> ''").distinct(), "value").withColumn("batch", F.floor(F.col("_n") / size))

    def run(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        model, asked = resolver(), batch["value"].tolist()
        said = _asked(model, asked) or {}
        for v in asked:
            if v not in said and len(asked) > 1:
                said |= {v: x for w, x in (_asked(model, [v]) or {}).items() if w == v}
        return pd.DataFrame({"value": asked, "found": [said.get(v) for v in asked]})

    found = stored(values.groupBy("batch").applyInPandas(run, "value string, found string"), "resolved")
    return df.join(found.withColumnRenamed("value", "_value"), value == F.col("_value"), "left").drop("_value").withColumnRenamed("found", name)


def _asked(model: Resolver, values: list[str]) -> dict[str, str] | None:
    try:
        return dict(model.resolve(values))
    except Exception:  # noqa: BLE001  a resolver may raise anything; what it doesn't answer is asked for alone, then stays null
        return None


def united_passes(*passes: DataFrame, key: Column) -> DataFrame:
    """Rows of several passes over one listing, or of a flat list and lists of each hall, merged by key: what an earlier pass holds
    comes before what a later one adds."""
    from .resolve import merged_exhibitors

    rows = None
    for i, df in enumerate(passes):
        ready = df.withColumn("_seq", F.struct(F.lit(i).alias("pass"), F.col("_seq").alias("seq")))
        rows = ready if rows is None else rows.unionByName(ready, allowMissingColumns=True)
    return merged_exhibitors(rows, key)


def picked_source(rows: DataFrame, least: int = 20) -> DataFrame:
    """Rows of the first source, by priority, that has at least so many."""
    good = rows.groupBy("source", "priority").agg(F.count("*").alias("n")).filter(F.col("n") >= least).agg(F.min_by("source", "priority").alias("source"))
    return rows.join(F.broadcast(good), "source", "left_semi")


def picked_listing(rows: DataFrame, least: int = 20, hall_least: int = 5) -> DataFrame:
    """Rows of the first whole listing (hall is null), by priority, that has at least so many; if there is none, those of all hall maps
    with at least hall_least rows."""
    lists = picked_source(rows.filter("hall IS NULL"), least)
    known = F.broadcast(rows.filter("hall IS NULL").groupBy("source").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") >= least).alias("_lists")))
    halls = rows.filter("hall IS NOT NULL")
    good = halls.groupBy(F.col("hall").alias("_hall")).agg(F.count("*").alias("n")).filter(F.col("n") >= hall_least).select("_hall")
    mapped = halls.join(F.broadcast(good), F.col("hall") == F.col("_hall"), "left_semi").join(known).filter("_lists = 0").drop("_lists")
    return lists.unionByName(mapped)
