"""Company pages as records, language preference among pages of one company, translation, and the records of one portal."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..functions import urls
from ..functions.geo import headquarters_of
from . import html as pages_html
from . import nodes
from .enrich import synthesised_about

OVERVIEW_CHARS, PARAGRAPH_CHARS = 4000, 80


def _inside(html: Column, tag: str, names: str | None = None) -> Column:
    """The text of the first element with this tag, or of any with a class among names; for single elements without nesting."""
    pattern = rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>" if names is None else rf"(?is)<(?:div|p|span|section|address)\b[^>]*class=\"[^\"]*(?:{names})[^\"]*\"[^>]*>(.*?)</(?:div|p|span|section|address)>"
    return tx.squash(F.regexp_replace(F.regexp_extract(html, pattern, 1), "<[^>]*>", " "))


def portal_profiles(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, name, website, booth, address, overview, email, phone, country) of company pages; empty where a page doesn't tell.

    The website is the first link that can be a company's own. The overview is an element named so, else the meta description,
    else the longest paragraph of more than PARAGRAPH_CHARS characters. The country is the last part of the address.
    """
    h = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"(?is)<(script|style|noscript)\b.*?</\1>", " ")
    body = F.regexp_replace(h, "<[^>]*>", "\n")
    meta = F.regexp_extract(h, r"(?is)<meta\b[^>]*(?:name=\"description\"|property=\"og:description\")[^>]*content=\"([^\"]*)\"", 1)
    paragraphs = F.filter(F.transform(F.regexp_extract_all(h, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), 1), lambda p: tx.squash(F.regexp_replace(p, "<[^>]*>", " "))), lambda p: F.length(p) > PARAGRAPH_CHARS)
    longest = F.aggregate(paragraphs, F.lit(""), lambda a, p: F.when(F.length(p) > F.length(a), p).otherwise(a))
    overview = F.coalesce(F.nullif(_inside(h, "div", "overview|description|about|company-profile|profile-text"), F.lit("")), F.nullif(tx.squash(meta), F.lit("")), longest)
    address = F.coalesce(F.nullif(_inside(h, "address"), F.lit("")), F.nullif(_inside(h, "div", "address|location|contact-info"), F.lit("")), tx.squash(F.regexp_extract(body, r"(?i)Address\s*:?\s*\n?(.{10,300})", 1)))
    rows = pages.select(
        key,
        F.coalesce(F.nullif(_inside(h, "h1"), F.lit("")), _inside(h, "h2")).alias("name"),
        tx.booth_of(body).alias("booth"),
        address.alias("address"),
        F.when(F.length(overview) > OVERVIEW_CHARS, F.concat(F.substring(overview, 1, OVERVIEW_CHARS), F.lit("..."))).otherwise(overview).alias("overview"),
        tx.email_of(body).alias("email"),
        tx.squash(tx.phone_of(body)).alias("phone"),
    ).withColumn("country", F.coalesce(tx.address_country(F.col("address")), F.lit("")))
    sites = pages_html.links(pages, key, html).withColumn("site", urls.tidy_website(F.col("href"))).filter(urls.is_company_website(F.col("href")))
    first = sites.groupBy(key).agg(F.min_by("site", "pos").alias("website"))
    return rows.join(first, key, "left").withColumn("website", F.coalesce("website", F.lit("")))


def portal_pages(pages: DataFrame, key: str, url: str = "url", html: str = "html") -> DataFrame:
    """portal_profiles with the website by all three passes and the overview by all four fallbacks (see nodes), and which of them decided
    (website_by, overview_by); empty where a page doesn't tell."""
    table = nodes.node_table(pages, key, html)
    sites = nodes.linked_websites(table, key, pages, url).withColumnRenamed("found_by", "website_by")
    texts = nodes.portal_overviews(table, key).withColumnRenamed("found_by", "overview_by")
    out = portal_profiles(pages, key, html).drop("website", "overview")
    for part in (sites, texts):
        other = part.withColumnRenamed(key, "_k")
        out = out.join(other, out[key].eqNullSafe(other["_k"]), "left").drop("_k")
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in ("website", "overview")})


def preferred_pages(candidates: DataFrame, key: str = "booth_id", language: str = "en") -> DataFrame:
    """One page of each company: the first in the wanted language, else the first; columns key, ordinal, page_lang, landed_id, ....

    A page that landed on another company is out. warnings tells of other languages and of such redirects.
    """
    strayed = F.col("landed_id").isNotNull() & (F.col("landed_id") != F.col(key))
    lost = candidates.filter(strayed).groupBy(key).agg(F.array_sort(F.collect_set(F.concat(F.lit("redirected_to_booth_"), F.col("landed_id").cast("string")))).alias("_lost"))
    order = Window.partitionBy(key).orderBy((F.col("page_lang") != language).cast("int"), "ordinal")
    best = candidates.filter(~strayed).withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
    foreign = F.when(F.col("page_lang") != language, F.array(F.lit("page_not_english"))).otherwise(F.array().cast("array<string>"))
    return best.join(lost, key, "left").withColumn("warnings", F.concat(F.coalesce("_lost", F.array().cast("array<string>")), foreign)).drop("_lost")


class Translator(Protocol):
    def translate(self, text: str, source: str) -> str: ...


class NoTranslator:
    """Leaves texts as they are; stands in offline."""

    def translate(self, text: str, source: str) -> str:
        return text


def translated(df: DataFrame, column: str, cache: DataFrame | None = None, translator: Callable[[], Translator] = NoTranslator, concurrency: int = 4) -> DataFrame:
    """Adds column_en: texts with Chinese or Japanese letters translated, others as they are, null where the translator failed.

    Each distinct text is translated once, in parts, unless cache (key, english) has it; key is the SHA-1 of the text.
    """
    text = tx.strip(F.col(column))
    rows = df.withColumn("_key", F.when(tx.is_cjk(text), F.sha1(text.cast("binary"))))
    todo = rows.filter("_key IS NOT NULL").select("_key", text.alias("t")).dropDuplicates(["_key"])
    if cache is not None:
        todo = todo.join(cache.select(F.col("key").alias("_key")), "_key", "left_anti")
    parts = todo.select("_key", F.col("t").rlike("[\\u3040-\\u30ff]").alias("kana"), F.col("t").contains("\n").alias("lines"), tx.chunks(F.col("t")).alias("parts"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = translator()
        for f in frames:
            out = []
            for key, kana, lines, parts in zip(f["_key"], f["kana"], f["lines"], f["parts"], strict=True):
                try:
                    done = [engine.translate(p, "ja" if kana else "auto").strip() for p in parts]
                    out.append((key, ("\n" if lines else " ").join(done)))
                except Exception:  # noqa: BLE001  a translator may raise anything; the text is tried again in the next run
                    out.append((key, None))
            yield pd.DataFrame(out, columns=["_key", "english"])

    found = parts.repartition(concurrency, "_key").mapInPandas(run, "_key string, english string")
    if cache is not None:
        found = found.unionByName(cache.select(F.col("key").alias("_key"), "english"))
    return rows.join(found, "_key", "left").withColumn(f"{column}_en", F.when(F.col("_key").isNull(), text).otherwise(F.col("english"))).drop("_key", "english")


def portal_records(rows: DataFrame, refined: Column, expo: str = "India expo") -> DataFrame:
    """Records of a portal in the catalogue's form from company_name, ebooth_url, website, address and booth: no categories, one show,
    headquarters from the address, a description from the refined block. Rows without name are left out."""
    name, site = tx.strip(F.col("company_name")), tx.strip(F.col("website"))
    url = tx.strip(F.col("ebooth_url"))
    hq = headquarters_of(F.col("address"))
    none, ids = F.array().cast("array<string>"), F.array().cast("array<int>")
    return rows.filter(name != "").select(
        name.alias("company_name"), url.alias("ebooth_url"), synthesised_about(refined, F.col("booth")).alias("about"), hq["location"].alias("hq_location"), hq["country"].alias("hq_country"),
        F.when((site != "") & ~site.rlike("^https?://"), F.concat(F.lit("https://"), site)).otherwise(site).alias("website"), ids.alias("cat_l1_ids"), none.alias("cat_l1_names"), ids.alias("cat_l2_ids"), none.alias("cat_l2_names"),
        F.array(F.lit(expo)).alias("locations"), F.array(F.struct(F.lit(expo).alias("location"), url.alias("ebooth_url"))).alias("sources"),
    )
