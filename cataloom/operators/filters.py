"""Filters and row matching over the catalogue view; one builder for browsing, facets and retrieval."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import presence, strip
from ..schema import ALL_EXPOS, UNKNOWN_COUNTRY


@dataclass(frozen=True)
class Selection:
    """What a user has chosen: dimensions are combined by AND, values of one by OR; level 2 categories supersede level 1."""

    expo: str | None = None
    countries: Sequence[str] = ()
    l1: Sequence[int] = ()
    l2: Sequence[int] = ()

    def without(self, *dims: str) -> Selection:
        """The selection with some dimensions cleared."""
        empty = {"expo": None, "countries": (), "l1": (), "l2": ()}
        return replace(self, **{d: empty[d] for d in dims})


def matches(s: Selection) -> Column:
    """The condition of a selection on columns expos, hq_country, cat_l1_ids and cat_l2_ids; true where nothing is chosen."""
    out = F.lit(True)
    if s.expo and s.expo != ALL_EXPOS:
        out = out & F.array_contains("expos", s.expo)
    if s.countries:
        out = out & F.col("hq_country").isin(list(s.countries))
    for chosen, column in ((s.l2, "cat_l2_ids"), (s.l1, "cat_l1_ids")):
        if chosen:
            return out & F.arrays_overlap(column, F.array(*(F.lit(int(x)) for x in chosen)))
    return out


def catalogue_view(df: DataFrame) -> DataFrame:
    """Unknown country and expo instead of nothing, and distinct category ids, so that filters and facets see the same."""
    expos = F.coalesce("expos", F.array().cast("array<string>"))
    return df.withColumns(
        {
            "hq_country": F.coalesce(presence(F.col("hq_country")), F.lit(UNKNOWN_COUNTRY)),
            "expos": F.when(F.size(expos) == 0, F.array(F.lit(UNKNOWN_COUNTRY))).otherwise(expos),
            "cat_l1_ids": F.array_distinct(F.coalesce("cat_l1_ids", F.array().cast("array<int>"))),
            "cat_l2_ids": F.array_distinct(F.coalesce("cat_l2_ids", F.array().cast("array<int>"))),
        }
    )


def is_empty(c: Column, kind: str = "string") -> Column:
    """Null, blank, or an array without elements."""
    return F.coalesce(F.size(c), F.lit(0)) <= 0 if kind.startswith("array") else strip(c) == ""


def browse(catalogue: DataFrame, selection: Selection, *, limit: int | None = None, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """The page of matching rows by name and id, and their number; no limit gives all. A null name sorts as an empty one."""
    rows = catalogue.filter(matches(selection))
    page = rows.orderBy(F.lower(F.coalesce("company_name", F.lit(""))), "id").offset(max(offset, 0))
    return page.limit(limit) if limit else page, rows.agg(F.count("*").alias("total"))


def unfinished(directory: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of the directory that aren't done."""
    return directory.join(done.select(key).distinct(), key, "left_anti")


def to_retest(rows: DataFrame) -> DataFrame:
    """Rows whose status isn't ok, a missing one included; all of them where there is no status."""
    return rows.filter(~F.col("status").eqNullSafe(F.lit("ok"))) if "status" in rows.columns else rows


def resumable(rows: DataFrame) -> Column:
    """Earlier results worth keeping: a real description and at least one category."""
    from ..schema import FALLBACK_ABOUT

    return (strip(F.col("about")) != "") & (F.col("about") != FALLBACK_ABOUT) & (F.size("cat_l1_ids") > 0)
