"""Rows from HTML: links, tables, category trees and main text, by Python table functions over the standard parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import squash
from ..functions.urls import digits_id
from ..session import small_batches

# Elements without main text, elements that break lines, and where main text is looked for.
DROPPED = frozenset("script style nav header footer aside noscript svg canvas form".split())
BREAKS = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 tr td th table section article main body blockquote".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINER = re.compile(r"content|main|article|about|company", re.I)


class _Links(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[str]] = []
        self.open = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "a":
            self.open = True
            self.rows.append([dict(attrs).get("href") or "", ""])

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.open = False

    def handle_data(self, data: str) -> None:
        if self.open:
            self.rows[-1][1] += data


class _Tables(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[str]] = []
        self.cell = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.rows[-1].append("")
            self.cell = True

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr"):
            self.cell = False

    def handle_data(self, data: str) -> None:
        if self.cell:
            self.rows[-1][-1] += data


class _Text(HTMLParser):
    """Lines of text, with the candidates that hold them: main, article, and elements named as content."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int | None]] = []
        self.dropped = 0
        self.parts: dict[int, list[str]] = {0: []}
        self.rank: dict[int, int] = {0: 4}

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BREAKS:
            self._add("\n")
        if tag in VOID:
            return
        a = dict(attrs)
        rank = 0 if tag == "main" else 1 if tag == "article" else 2 if CONTAINER.search(a.get("id") or "") else 3 if CONTAINER.search(a.get("class") or "") else None
        at = None
        if rank is not None:
            at = len(self.parts)
            self.parts[at], self.rank[at] = [], rank
        self.stack.append((tag, at))
        self.dropped += tag in DROPPED

    def handle_endtag(self, tag: str) -> None:
        if tag in BREAKS:
            self._add("\n")
        if any(t == tag for t, _ in self.stack):
            while self.stack:
                t, _ = self.stack.pop()
                self.dropped -= t in DROPPED
                if t == tag:
                    break

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self._add(data)

    def _add(self, data: str) -> None:
        self.parts[0].append(data)
        for _, at in self.stack:
            if at is not None:
                self.parts[at].append(data)


def _parsed(parser: HTMLParser, page: str | None) -> HTMLParser:
    parser.feed(page or "")
    parser.close()
    return parser


def _rows(kind: type, fields: str):
    """Rows of the pages of one batch at a time; small_batches bounds it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [(k, i, *(r if kind is _Links else (r,))) for k, page in zip(f["k"], f["h"], strict=True) for i, r in enumerate(_parsed(kind(), page).rows)]
            yield pd.DataFrame(out, columns=["k", "pos", *fields.split()])

    return run


def links(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, pos, href, text) of each anchor, in page order; a null page has none."""
    small_batches(pages.sparkSession, rows=1024)
    kind = pages.schema[key].dataType.simpleString()
    out = pages.select(F.col(key).alias("k"), F.col(html).alias("h")).mapInPandas(_rows(_Links, "href text"), f"k {kind}, pos int, href string, text string")
    return out.select(F.col("k").alias(key), "pos", "href", squash(F.col("text")).alias("text"))


def table_rows(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, pos, cells) of each table row, in page order."""
    small_batches(pages.sparkSession, rows=1024)
    kind = pages.schema[key].dataType.simpleString()
    out = pages.select(F.col(key).alias("k"), F.col(html).alias("h")).mapInPandas(_rows(_Tables, "cells"), f"k {kind}, pos int, cells array<string>")
    return out.select(F.col("k").alias(key), "pos", F.transform("cells", squash).alias("cells"))


def directory_links(found: DataFrame, key: str, by: str = "text") -> DataFrame:
    """Links to booths of a directory, the first of each name (or of each booth number, or url)."""
    booth = F.regexp_extract("href", r"(?i)BoothID=\s*(\d+)", 1)
    rows = found.filter(F.col("href").rlike("(?i)ebooth.aspx") & F.col("href").rlike("(?i)IndexInList")).withColumn("booth_id", booth)
    one = {"text": F.col("text"), "booth": F.col("booth_id"), "url": F.col("href")}[by]
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key, one).orderBy("pos"))).filter("_n = 1").drop("_n")


def category_marks(found: DataFrame, key: str) -> DataFrame:
    """(key, pos, l1, l2, name) of category links: CatID opens a level-1 node, SubCatID names a child."""
    href = F.regexp_replace("href", r"\s", "")
    l2 = digits_id(F.regexp_extract(href, r"(?i)SubCatID=(\d+)", 1))
    l1 = F.when(l2.isNull(), digits_id(F.regexp_extract(href, r"(?i)[?&]CatID=(\d+)", 1)))
    return found.select(key, "pos", l1.cast("int").alias("l1"), l2.cast("int").alias("l2"), F.col("text").alias("name")).filter("l1 IS NOT NULL OR l2 IS NOT NULL")


def category_tree(marks: DataFrame, key: str) -> DataFrame:
    """(key, cat_tree): a child belongs to the level-1 node seen last before it; those before any are Uncategorized."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = marks.withColumns({"parent": F.last("l1", ignorenulls=True).over(w), "parent_name": F.last(F.when(F.col("l1").isNotNull(), F.col("name")), ignorenulls=True).over(w)})
    heads = placed.groupBy(key, "parent").agg(F.min("pos").alias("at"), F.min_by("parent_name", "pos").alias("l1_name"))
    kids = placed.filter("l2 IS NOT NULL").groupBy(key, "parent", "l2").agg(F.min("pos").alias("cat"), F.min_by("name", "pos").alias("cname"))
    lists = kids.groupBy(key, "parent").agg(F.transform(F.sort_array(F.collect_list(F.struct("cat", "l2", "cname"))), lambda x: F.struct(x["l2"].alias("id"), x["cname"].alias("name"))).alias("children"))
    joined = heads.alias("h").join(lists.alias("l"), F.col(f"h.{key}").eqNullSafe(F.col(f"l.{key}")) & F.col("h.parent").eqNullSafe(F.col("l.parent")), "left")
    node = F.struct("at", F.col("h.parent").alias("l1_id"), F.coalesce(F.when(F.col("h.parent").isNotNull(), F.col("l1_name")), F.lit("Uncategorized")).alias("l1_name"), F.coalesce("children", F.array().cast("array<struct<id:int,name:string>>")).alias("children"))
    tree = F.transform(F.sort_array(F.collect_list(node)), lambda x: F.struct(x["l1_id"].alias("l1_id"), x["l1_name"].alias("l1_name"), x["children"].alias("children")))
    return joined.groupBy(F.col(f"h.{key}").alias(key)).agg(tree.alias("cat_tree"))


def flat_categories(tree: Column) -> Column:
    """Struct of the four lists of a tree: level-1 ids and names without Uncategorized, distinct level-2 ids and names."""
    real = F.filter(tree, lambda n: n["l1_id"].isNotNull())
    kids = F.array_distinct(F.flatten(F.transform(tree, lambda n: n["children"])))
    return F.struct(real["l1_id"].alias("l1_ids"), real["l1_name"].alias("l1_names"), kids["id"].alias("l2_ids"), kids["name"].alias("l2_names"))


@F.pandas_udf(T.StringType())
def main_text(pages: pd.Series) -> pd.Series:
    """Text of main, else article, else an element with an id and then a class of content, else the body; blank lines at most two."""

    def one(page: str | None) -> str:
        p = _parsed(_Text(), page)
        best = min((at for at in p.parts if "".join(p.parts[at]).strip() or at == 0), key=lambda at: (p.rank[at], at))
        lines = "".join(p.parts[best]).split("\n")
        return re.sub(r"\n{3,}", "\n\n", "\n".join(" ".join(x.split()) for x in lines)).strip()

    return pages.map(one)


def visible_text(pages: Column) -> Column:
    return main_text(pages)


#: Classes of a client's errors, by parts of their names, in the order in which they are looked for.
ERRORS = {"ssl": "ssl_error", "timeout": "timeout", "timedout": "timeout", "redirect": "too_many_redirects", "connection": "connection_error"}


def fetch_status(url: Column, html: Column, text: Column, content_type: Column | None = None, http: Column | None = None, error: Column | None = None) -> Column:
    """Why a homepage gave no text, or ok. error is the name of what the client raised, with a message behind a colon: ssl errors keep 60
    characters of it, names that aren't known are other:name."""
    out = F.when(F.trim(F.coalesce(url, F.lit(""))) == "", "no_url")
    if error is not None:
        name, message = F.substring_index(error, ":", 1), F.substring(F.regexp_replace(error, "^[^:]*:?", ""), 1, 60)
        for part, status in ERRORS.items():
            said = F.concat(F.lit("ssl_error:"), message) if status == "ssl_error" else F.lit(status)
            out = out.when(F.lower(F.coalesce(name, F.lit(""))).contains(part), said)
        out = out.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit("other:"), name))
    if http is not None:
        out = out.when(http >= 400, F.concat(F.lit("http_error:"), http.cast("string")))
    if content_type is not None:
        out = out.when(~F.lower(F.coalesce(content_type, F.lit(""))).contains("html"), F.concat(F.lit("non_html_content_type:"), F.coalesce(content_type, F.lit(""))))
    return out.when(html.isNull(), "connection_error").when(F.length(text) == 0, "empty_after_extraction").when(F.length(text) < 150, "likely_js_rendered_spa").otherwise("ok")


def about_of(text: Column) -> Column:
    """A description from a profile's lines: what stands between Overview and Categories, or else between Booth and what follows."""
    block = F.regexp_extract(text, r"(?is)\bOverview\b\s*(.*?)(?:\bCategories\b|\z)", 1)
    booth = F.regexp_extract(text, r"(?is)\bBooth\b[^\n]*\n(.*?)(?:\bCategories\b|\z)", 1)
    long = lambda c, n: F.nullif(F.array_join(F.filter(F.transform(F.split(c, "\n"), squash), lambda x: F.length(x) > n), " "), F.lit(""))
    return F.coalesce(long(block, 20), long(booth, 30))


def profile_website(found: DataFrame, key: str) -> DataFrame:
    """(key, website): the first link whose text is a url and isn't the show's own."""
    rows = found.filter(F.col("text").rlike(r"(?i)^(https?://|www\.)") & ~F.lower("text").contains("semi.org"))
    return rows.groupBy(key).agg(F.min_by("text", "pos").alias("website"))
