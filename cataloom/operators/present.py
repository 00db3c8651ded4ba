"""What cards show: parsed overviews, categories with hits, scores, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import has_token, query_tokens, strip
from ..functions.urls import tidy_website
from ..schema import UNKNOWN_COUNTRY

# Labels in overviews, the fields they fill, and limits of fields.
LABELS = {
    "booth": "Booth", "valueChain": "Value Chain Role", "relevance": "Semiconductor Relevance", "capabilities": "Key Capabilities",
    "technicalExpertise": "Technical Expertise", "endMarkets": "End Markets", "indiaPresence": "India Presence",
}
LISTS = ("capabilities", "technicalExpertise", "endMarkets")
SHORT = {"booth": 20, "valueChain": 40, "relevance": 20}
LIST_CHARS, PRESENCE_CHARS = 600, 900


def parsed_overview(about: Column) -> Column:
    """Struct (summary, booth, valueChain, relevance, indiaPresence, three lists, structured) from an overview with labels.

    Each label's value reaches up to the next label. Short fields that swallowed a sentence and lists that are too long are
    dropped; if no field is left, the whole text is the summary.
    """
    text = strip(about)
    names = sorted(LABELS.values(), key=len, reverse=True)
    # \u0001 name \u0002 value, once for each label
    marked = F.regexp_replace(text, rf"(?i)\b({'|'.join(names)}):\s*", "\u0001$1\u0002")
    parts = F.split(marked, "\u0001")
    summary = strip(F.get(parts, F.lit(0)))

    def value(field: str) -> Column:
        found = F.filter(F.slice(parts, 2, 1_000_000), lambda p: F.lower(F.get(F.split(p, "\u0002"), F.lit(0))) == LABELS[field].lower())
        texts = F.transform(found, lambda p: F.regexp_replace(strip(F.get(F.split(p, "\u0002"), F.lit(1))), r"\.\s*$", ""))
        return F.try_element_at(F.filter(texts, lambda t: t != ""), F.lit(-1))

    out: dict[str, Column] = {}
    for f in LABELS:
        v = value(f)
        if f in SHORT:
            v = F.when((F.length(v) <= SHORT[f]) & ~v.rlike(r"\.\s+[A-Z]"), v)
        elif f in LISTS:
            items = F.filter(F.transform(F.split(F.coalesce(v, F.lit("")), ","), strip), lambda x: x != "")
            v = F.when(F.length(F.array_join(items, ", ")) > LIST_CHARS, F.array().cast("array<string>")).otherwise(items)
        else:
            v = F.when(F.length(v) <= PRESENCE_CHARS, v)
        out[f] = v
    some = F.lit(False)
    for f, v in out.items():
        some = some | (F.size(v) > 0 if f in LISTS else v.isNotNull())
    some = some & (F.size(parts) > 1)
    empty = F.array().cast("array<string>")
    fields = [F.when(some, v).otherwise(empty if f in LISTS else F.lit(None)).alias(f) for f, v in out.items()]
    return F.struct(F.when(some, summary).otherwise(text).alias("summary"), *fields, some.alias("structured"))


def structured_overview(about: Column, refined: Column) -> Column:
    """The same from a refined block: lists as they are, regions as "name: text; ..."."""
    none = F.array().cast("array<string>")
    regions = F.array_join(F.transform(F.map_entries(refined["regional_presence"]), lambda e: F.when(F.coalesce(e["value"], F.lit("")) != "", F.concat_ws(": ", e["key"], e["value"])).otherwise(e["key"])), "; ")
    return F.struct(
        strip(F.coalesce(F.nullif(refined["summary"], F.lit("")), about)).alias("summary"),
        refined["value_chain_position"].alias("valueChain"),
        refined["semiconductor_relevance"].alias("relevance"),
        F.coalesce(refined["capabilities"], none).alias("capabilities"),
        F.coalesce(refined["technical_expertise"], none).alias("technicalExpertise"),
        F.coalesce(refined["end_markets"], none).alias("endMarkets"),
        F.nullif(regions, F.lit("")).alias("regionalPresence"),
    )


def relevance_level(value: Column) -> Column:
    low = F.lower(strip(value))
    return F.when(low.startswith("high"), "high").when(low.startswith("medium"), "medium").when(low.startswith("low"), "low")


def split_categories(rows: DataFrame, *, l1: list[int] = (), l2: list[int] = (), query: str = "", key: str = "id") -> DataFrame:
    """(key, parent, label, hit, reason, pos) from category trees: why an entry matched, hits first.

    A chosen child is a hit, then a child of a chosen parent, then a name that holds a word of the query; a parent without children
    is an entry itself. Of entries with the same parent and label the first stays, hits before others.
    """
    tokens = query_tokens(F.lit(query))
    nodes = rows.select(key, F.posexplode("cat_tree").alias("npos", "n"))
    kids = F.when(F.size("n.children") > 0, F.col("n.children")).otherwise(F.array(F.struct(F.col("n.l1_id").alias("id"), F.col("n.l1_name").alias("name"))))
    entries = nodes.select(key, "npos", F.col("n.l1_id").alias("l1_id"), F.col("n.l1_name").alias("parent"), (F.size("n.children") > 0).alias("is_child"), F.posexplode(kids).alias("cpos", "c"))
    reason = F.lit(None).cast("string")
    if query:
        reason = F.when(has_token(F.col("c.name"), tokens) | has_token(F.col("parent"), tokens), "query")
    if l1:
        reason = F.when(F.col("l1_id").isin(list(l1)), "l1").otherwise(reason)
    if l2:
        reason = F.when(F.col("is_child") & F.col("c.id").isin(list(l2)), "l2").otherwise(reason)
    marked = entries.select(key, "parent", F.col("c.name").alias("label"), reason.isNotNull().alias("hit"), reason.alias("reason"), F.struct("npos", "cpos").alias("at"))
    first = marked.withColumn("_n", F.row_number().over(Window.partitionBy(key, "parent", "label").orderBy(F.col("hit").desc(), "at"))).filter("_n = 1")
    return first.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy(F.col("hit").desc(), "at"))).drop("_n", "at")


def visible_categories(entries: DataFrame, cap: int = 6, key: str = "id") -> DataFrame:
    """(key, shown, hidden): the first hits up to cap, or up to three entries without hits, and how many are hidden."""
    hits = F.count_if("hit")
    agg = entries.groupBy(key).agg(F.count("*").alias("total"), hits.alias("hits"), F.sort_array(F.collect_list(F.struct("pos", "label"))).alias("all"))
    n = F.when(F.col("hits") > 0, F.least("hits", F.lit(cap))).otherwise(F.least("total", F.lit(min(cap, 3))))
    return agg.select(key, F.slice(F.col("all.label"), F.lit(1), n.cast("int")).alias("shown"), (F.col("total") - n).alias("hidden"))


def card_links(website: Column, sources: Column) -> Column:
    """Distinct links of a card, the website's first."""
    urls = F.concat(F.array(tidy_website(website)), F.transform(sources, lambda s: tidy_website(s["ebooth_url"])))
    return F.array_distinct(F.filter(urls, lambda u: (u != "") & (u != "https://#")))


def score_line(final: Column, judge: Column, retrieval: Column, score: Column) -> Column:
    """final / judge / search with two digits, or the score with three; null when browsing."""
    two = lambda c: F.format_number(c, 2)
    return F.when(final.isNotNull(), F.concat_ws(" / ", two(final), F.coalesce(two(judge), F.lit("-")), two(retrieval))).when(score.isNotNull(), F.format_number(score, 3))


def badges(country: Column, booth: Column, segment: Column) -> Column:
    """What a card puts beside the name."""
    return F.filter(F.array(F.when(country != UNKNOWN_COUNTRY, country), F.nullif(booth, F.lit("")), F.nullif(segment, F.lit(""))), lambda x: x.isNotNull())


def toggled(chosen: list, value: object) -> list:
    """A panel's selection after a click on value: without it where it stood, compared as text, or with it at the end."""
    left = [x for x in chosen if str(x) != str(value)]
    return left if len(left) < len(chosen) else [*chosen, value]


def is_clamped(summary: Column, limit: int = 320) -> Column:
    return F.length(summary) > limit
