"""Registered queries of what is decided record by record: matching, filters, links, prompts, cards. Imported by catalog_queries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog_queries import _FIRMS, _HREFS, _M, _PAIRS, _ROW, _STRIP, CHOSEN, FACETS, _firms, _in, _row, query
from .functions import text, urls
from .operators import enrich, facets, filters, html, integrate, nodes, present, report
from .plans.engine import Engine
from .plans.standin import SQL as CAT
from .plans.standin import catalogue, table
from .schema import FALLBACK_ABOUT
from .sources.storage import shared_dir, stored
from .streaming.live_facets import LiveFacets

# --- the engine ----------------------------------------------------------------------------------------------------------


@query("search_fork_blank", f"WITH {CAT} SELECT {_ROW} FROM cat WHERE {' AND '.join(_M.values())} ORDER BY lower(company_name), id LIMIT 10")
def search_fork_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query without words is answered by browsing."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return _row(Engine(catalogue(spark, sf_dir), texts, vectors).answer("  ", None, CHOSEN, limit=10))


@query("facet_order", f"WITH {CAT}, {_PAIRS}, f AS ({' UNION ALL '.join(f'({s})' for s in FACETS.values())}) SELECT *, (row_number() OVER (PARTITION BY dim ORDER BY n DESC, label, value))::INTEGER AS pos FROM f")
def facet_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalogue(spark, sf_dir)
    return facets.ranked(facets.facets(c, CHOSEN, facets.taxonomy(c)))


@query("live_facets", f"WITH {CAT}, {_PAIRS}, f AS ({' UNION ALL '.join(f'({s})' for s in FACETS.values())}) SELECT * FROM f")
def live_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue comes in three batches: everything in an earlier form, then half of it as it is, then the rest and an older form of
    the first half, which is late and doesn't count. The catalogue is computed once, and not again for each batch."""
    c = stored(catalogue(spark, sf_dir), "live-catalogue")
    # no cell comes from the trees
    rows = c.drop("cat_tree").withColumns({"_seq": F.lit(2).cast("long"), "_deleted": F.lit(False)})
    early = rows.withColumns({"_seq": F.lit(1).cast("long"), "expos": F.array(F.lit("1998"), F.lit("1901")), "hq_country": F.lit("NATION_1"), "cat_l1_ids": F.array(F.lit(2)), "cat_l2_ids": F.array(F.lit(203))})
    gone = early.filter("id = 1").withColumns({"id": F.lit(-1).cast("long"), "_seq": F.lit(1).cast("long")})
    folder, half = shared_dir(spark, "upserts"), F.col("id") % 2 == 0
    counts = LiveFacets(spark, shared_dir(spark, "live-facets"), CHOSEN)
    again = early.filter(half).withColumn("_seq", F.lit(0).cast("long"))
    batches = [early.unionByName(gone), rows.filter(half).unionByName(gone.withColumns({"_seq": F.lit(2).cast("long"), "_deleted": F.lit(True)})), rows.filter(~half).unionByName(again)]
    for batch in batches:
        batch.write.mode("append").parquet(folder)
        counts.follow(folder, batch.schema).awaitTermination()
    return facets.named_counts(counts.counts(), CHOSEN, facets.taxonomy(c))


# --- names, urls and contacts --------------------------------------------------------------------------------------------

_OTHER = "CASE WHEN c_acctbal >= 0 THEN 'THE ' || upper(c_name) || ', ' || c_mktsegment ELSE c_mktsegment END"
_LOOSE = r"regexp_replace(lower({}), '[\W_]+', '', 'g')"


@query("names_match", f"WITH p AS (SELECT c_custkey AS id, {_LOOSE.format('c_name')} AS a, {_LOOSE.format(_OTHER)} AS b FROM customer) SELECT id, a <> '' AND b <> '' AND (contains(a, b) OR contains(b, a)) AS same FROM p")
def names_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), text.names_match(F.col("c_name"), F.expr(_OTHER)).alias("same"))


@query(
    "slug_variants",
    r"WITH " + _FIRMS + r""", s AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(name), '\s+', '-', 'g'), '[^a-z0-9&.\-]', '', 'g'), '-{2,}', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM firms),
v AS (SELECT id, slug, unnest([replace(slug, '.', ''), replace(slug, '&', 'and'), regexp_replace(slug, '[&.]', '', 'g')]) AS x FROM s)
SELECT id, slug, coalesce(string_agg(DISTINCT x, '|' ORDER BY x) FILTER (x <> slug AND x <> ''), '') AS variants FROM v GROUP BY id, slug""",
)
def slug_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _firms(spark, sf_dir).select("id", text.slug(F.col("name")).alias("slug"))
    return s.withColumn("variants", F.array_join(F.array_sort(text.slug_variants(F.col("slug"))), "|"))


@query(
    "english_half",
    "SELECT doc_id, CASE lang WHEN 'de' THEN '123 ' || source WHEN 'fr' THEN source WHEN 'es' THEN source || ' / ' || lang ELSE '半導体 / 装置' END AS label FROM documents",
)
def english_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels in two languages, in one, and with two Japanese halves."""
    source, lang = F.col("source"), F.col("lang")
    label = F.when(lang == "de", F.concat(F.lit("123 半導体 / "), source)).when(lang == "fr", F.concat(F.lit("装置 / "), source)).when(lang == "es", F.concat_ws(" / ", source, lang)).otherwise("半導体 / 装置")
    return table(spark, sf_dir, "documents").select("doc_id", text.english_half(label).alias("label"))


@query(
    "contact_fields",
    f"SELECT doc_id, regexp_extract(text, '({text.EMAIL})', 1) AS email, regexp_extract(text, '({text.PHONE})', 1) AS phone, CASE WHEN length(last) BETWEEN 2 AND 30 AND NOT regexp_matches(last, '[0-9]') THEN last END AS country FROM (SELECT doc_id, text, trim(string_split(text, ',')[-1]) AS last FROM documents)",
)
def contact_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.email_of(c).alias("email"), text.phone_of(c).alias("phone"), text.address_country(c).alias("country"))


_LINK = "CASE WHEN url LIKE '%/de/%' THEN url || '#top' WHEN url LIKE '%/fr/%' THEN 'https://www.facebook.com/x' WHEN url LIKE '%/es/%' THEN 'mailto:a@b.example' ELSE url END"
_ANY = lambda parts: "|".join(re.escape(p) for p in parts)
_BLOCKED = rf"(regexp_matches(lower(u), '{_ANY(urls.BLOCKED_PARTS)}') OR regexp_matches(regexp_extract(lower(u), '^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)', 1), '{_ANY(urls.BLOCKED_HOSTS)}'))"


@query("blocked_urls", f"SELECT page_id, {_BLOCKED} AS blocked FROM (SELECT page_id, {_LINK} AS u FROM pages)")
def blocked_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.is_blocked(F.expr(_LINK)).alias("blocked"))


@query("external_links", rf"SELECT page_id, CASE WHEN NOT {_BLOCKED} AND regexp_matches(u, '(?i)^https?://[^/?#]*\.[^/?#]*') THEN regexp_replace(u, '/+$', '') END AS website FROM (SELECT page_id, {_LINK} AS u FROM pages)")
def external_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.external_url(F.col("url"), F.expr(_LINK)).alias("website"))


# --- filters and joins ---------------------------------------------------------------------------------------------------


@query("emptiness", "SELECT doc_id, coalesce(trim(text), '') = '' AS no_text, lang = 'es' AS no_list FROM documents")
def emptiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.when(F.col("lang") == "es", F.array().cast("array<string>")).otherwise(F.array("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", filters.is_empty(F.col("text")).alias("no_text"), filters.is_empty(listed, "array<string>").alias("no_list"))


@query("retest_rows", "SELECT event_id, event_type AS status FROM events WHERE event_type IS DISTINCT FROM 'ok'")
def retest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.to_retest(table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("status")))


@query("resume_filter", "SELECT doc_id, lang NOT IN ('de', 'es') AND trim(text) <> '' AS keep FROM documents")
def resume_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier results with the stock description (de) or without categories (es) are made anew."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") == "de", FALLBACK_ABOUT).otherwise(F.col("text")).alias("about"), F.when(F.col("lang") == "es", F.array().cast("array<int>")).otherwise(F.array(F.lit(1))).alias("cat_l1_ids"))
    return rows.select("doc_id", filters.resumable(rows).alias("keep"))


@query(
    "location_lift",
    """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'Tokyo|' || n_name WHEN s_suppkey % 3 = 1 AND s_acctbal > 0 THEN n_name WHEN s_suppkey % 3 = 2 THEN '' WHEN s_acctbal > 0 THEN n_name ELSE '' END AS locations,
  (CASE WHEN s_suppkey % 3 = 0 THEN 2 WHEN s_suppkey % 3 = 2 THEN 0 WHEN s_acctbal > 0 THEN 1 ELSE 0 END)::INTEGER AS n_sources FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)
def location_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three records one has lists with two places, one has an empty list, and one has none."""
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    source = lambda place: F.struct(place.alias("location"), F.lit("").alias("ebooth_url"))
    pick = lambda two, none, kind: F.when(F.col("s_suppkey") % 3 == 0, two).when(F.col("s_suppkey") % 3 == 2, none).otherwise(F.lit(None).cast(kind))
    rows = rows.select(
        F.col("s_suppkey").alias("id"), F.when(F.col("s_acctbal") > 0, F.col("n_name")).otherwise("").alias("location"), F.lit("").alias("ebooth_url"),
        pick(F.array(F.lit("Tokyo"), F.col("n_name")), F.array().cast("array<string>"), "array<string>").alias("locations"),
        pick(F.array(source(F.lit("Tokyo")), source(F.col("n_name"))), F.array().cast("array<struct<location:string,ebooth_url:string>>"), "array<struct<location:string,ebooth_url:string>>").alias("sources"),
    )
    return integrate.lift_location(rows).select("id", F.array_join("locations", "|").alias("locations"), F.size("sources").alias("n_sources"))


@query("distinct_mapping", "SELECT doc_id, source, CASE WHEN trim(source) <> '' THEN upper(source) || '!' END AS mapped FROM documents")
def distinct_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrate.mapped_distinct(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", F.concat(F.upper("source"), F.lit("!")), "mapped")


@query("source_priority", "WITH s AS (SELECT source FROM documents GROUP BY source HAVING count(*) >= 20 ORDER BY md5(source) LIMIT 1) SELECT doc_id, source FROM documents JOIN s USING (source)")
def source_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5("source").alias("priority"))
    return integrate.picked_source(rows).select("doc_id", "source")


@query("halls_report", "SELECT halls, count(*) AS n FROM (SELECT l_orderkey, string_agg(DISTINCT l_linenumber::VARCHAR, '|' ORDER BY l_linenumber::VARCHAR) AS halls FROM lineitem GROUP BY l_orderkey) GROUP BY halls")
def halls_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.by_halls(table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("halls")))


@query(
    "website_overlay",
    """WITH o AS (SELECT lower(c_name) AS k, arg_max(o_orderpriority, o_orderkey) AS hq, arg_max(CASE WHEN o_orderstatus = 'F' THEN '' ELSE 'https://o' || o_orderkey || '.example' END, o_orderkey) AS website FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT c_custkey AS id, CASE WHEN k IS NOT NULL THEN hq ELSE c_mktsegment END AS hq_location, coalesce(nullif(o.website, ''), 'https://old.example') AS website FROM customer LEFT JOIN o ON lower(c_name) = k""",
)
def website_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last order of a customer as a correction of its record."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("company_name"), F.col("c_mktsegment").alias("hq_location"), F.lit("https://old.example").alias("website"))
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    fixes = o.select(F.upper("c_name").alias("company_name"), F.col("o_orderpriority").alias("hq_location"), F.when(F.col("o_orderstatus") == "F", "").otherwise(F.concat(F.lit("https://o"), F.col("o_orderkey").cast("string"), F.lit(".example"))).alias("website"), F.col("o_orderkey").alias("_seq"))
    return enrich.overlaid(c, fixes).select("id", "hq_location", "website")


# --- prompts and cards ---------------------------------------------------------------------------------------------------


def _refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a refined block made of their language and source."""
    lang, source = F.col("lang"), F.col("source")
    some = lambda c: F.when(lang == "es", F.array().cast("array<string>")).otherwise(F.array(c))
    block = F.struct(
        F.when(lang != "fr", F.concat(F.lit("About "), source)).alias("summary"), F.when(lang == "de", "Equipment").otherwise("Other").alias("value_chain_position"), F.when(lang == "en", "High").otherwise("Low").alias("semiconductor_relevance"),
        some(source).alias("capabilities"), some(lang).alias("technical_expertise"), F.array().cast("array<string>").alias("end_markets"), F.create_map(F.lit("Asia"), source, F.lit("Europe"), F.lit("")).alias("regional_presence"),
    )
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", block.alias("refined"))


_ABOUT_700 = rf"SELECT doc_id, source, lang, CASE WHEN length(t) <= 700 THEN t ELSE regexp_replace(t[1:700], ' [^ ]*$', '') || ' ...' END AS about FROM (SELECT doc_id, source, lang, {_STRIP.format('text')} AS t FROM documents)"


@query("candidate_prompts", f"SELECT doc_id, concat_ws(chr(10), 'id: ' || doc_id, 'name: ' || source, CASE WHEN about <> '' THEN 'about: ' || about END, 'categories: ' || lang, CASE WHEN lang <> 'es' THEN 'capabilities: ' || source END) AS prompt FROM ({_ABOUT_700})")
def candidate_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _refined(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("source").alias("company_name"), F.col("text").alias("about"), F.array("lang").alias("cat_l2_names"), "refined")
    return rows.select(F.col("id").alias("doc_id"), enrich.candidate_prompt().alias("prompt"))


@query(
    "overview_structured",
    f"SELECT doc_id, CASE WHEN lang = 'fr' THEN {_STRIP.format('text')} ELSE 'About ' || source END AS summary, CASE WHEN lang <> 'es' THEN source ELSE '' END AS capabilities, 'Asia: ' || source || '; Europe' AS regions, length(CASE WHEN lang = 'fr' THEN {_STRIP.format('text')} ELSE 'About ' || source END) > 320 AS clamped FROM documents",
)
def overview_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _refined(spark, sf_dir).select("doc_id", present.structured_overview(F.col("text"), F.col("refined")).alias("o"))
    return rows.select("doc_id", "o.summary", F.array_join("o.capabilities", "|").alias("capabilities"), F.col("o.regionalPresence").alias("regions"), present.is_clamped(F.col("o.summary")).alias("clamped"))


@query(
    "about_synthesised",
    "SELECT doc_id, concat_ws(' ', CASE WHEN lang <> 'fr' THEN 'About ' || source END, CASE WHEN lang <> 'en' THEN 'Booth: ' || lang || '.' END, CASE WHEN lang = 'de' THEN 'Value Chain Role: Equipment.' END, CASE WHEN lang = 'en' THEN 'Semiconductor Relevance: High.' END, CASE WHEN lang <> 'es' THEN 'Key Capabilities: ' || source || '. Technical Expertise: ' || lang || '.' END) AS about FROM documents",
)
def about_synthesised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refined(spark, sf_dir).select("doc_id", enrich.synthesised_about(F.col("refined"), F.when(F.col("lang") != "en", F.col("lang"))).alias("about"))


@query(
    "card_links",
    r"WITH l AS (SELECT page_id, unnest([url, regexp_replace(url, '[?].*$', ''), regexp_replace(url, '^https?://', '')]) AS u, unnest([1, 2, 3]) AS pos FROM pages), t AS (SELECT page_id, pos, regexp_replace(CASE WHEN regexp_matches(u, '^https?://') THEN u ELSE 'https://' || u END, '/+$', '') AS u FROM l) SELECT page_id, string_agg(u, ' ' ORDER BY pos) AS links FROM (SELECT page_id, u, min(pos) AS pos FROM t GROUP BY page_id, u) GROUP BY page_id",
)
def card_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = [F.regexp_replace("url", "[?].*$", ""), F.regexp_replace("url", "^https?://", "")]
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(present.card_links(F.col("url"), F.array(*(F.struct(u.alias("ebooth_url")) for u in other))), " ").alias("links"))


@query("score_lines", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN printf('%.2f', l_discount) || ' / ' || CASE WHEN l_linestatus = 'F' THEN printf('%.2f', l_tax) ELSE '-' END || ' / ' || printf('%.2f', l_tax) WHEN l_returnflag = 'A' THEN printf('%.3f', l_discount) END AS line FROM lineitem")
def score_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reranked (R), searched (A) and browsed rows."""
    flag, rate, tax = F.col("l_returnflag"), F.col("l_discount"), F.col("l_tax")
    line = present.score_line(F.when(flag == "R", rate), F.when(F.col("l_linestatus") == "F", tax), tax, F.when(flag != "N", rate))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", line.alias("line"))


@query("card_badges", "SELECT c_custkey AS id, concat_ws('|', CASE WHEN c_acctbal > 0 THEN n_name END, CASE WHEN c_nationkey > 12 THEN 'B' || c_nationkey END, c_mktsegment) AS badges FROM customer JOIN nation ON c_nationkey = n_nationkey")
def card_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    shown = present.badges(F.when(F.col("c_acctbal") > 0, F.col("n_name")).otherwise("Unknown"), F.when(F.col("c_nationkey") > 12, F.concat(F.lit("B"), F.col("c_nationkey").cast("string"))).otherwise(""), F.col("c_mktsegment"))
    return rows.select(F.col("c_custkey").alias("id"), F.array_join(shown, "|").alias("badges"))


@query(
    "directory_anchors",
    f"""WITH {_HREFS}, b AS (SELECT page_id, i, '/eBooth.aspx?IndexInList=' || i || '&BoothID= ' || length(x) AS href, length(x)::VARCHAR AS booth FROM (SELECT page_id, unnest(h) AS x, generate_subscripts(h, 1) AS i FROM a) WHERE x LIKE '/%')
SELECT page_id, booth AS booth_id, arg_min(href, i) AS href, count(*) AS n FROM b GROUP BY page_id, booth""",
)
def directory_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the given pages as links to booths, the length of a link being its booth: the first of each booth, and how many there are."""
    found = html.links(table(spark, sf_dir, "pages"), "page_id")
    booths = F.concat(F.lit("/eBooth.aspx?IndexInList="), (F.col("pos") + 1).cast("string"), F.lit("&BoothID= "), F.length("href").cast("string"))
    rows = found.withColumn("href", F.when(F.col("href").startswith("/"), booths).otherwise(F.col("href")))
    first = html.directory_links(rows, "page_id", "booth").select("page_id", "booth_id", "href")
    counts = rows.filter(F.col("href").startswith("/eBooth")).groupBy("page_id", F.regexp_extract("href", r"BoothID= (\d+)", 1).alias("booth_id")).agg(F.count("*").alias("n"))
    return first.join(counts, ["page_id", "booth_id"])


# --- node tables ---------------------------------------------------------------------------------------------------------

_INLINE_TAGS = _in(tuple(sorted(nodes.INLINE)))
_NODES = f"""
h AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>', '<i>', 'g'), '(?is)<style\\b.*?</style>', '<i>', 'g'), '(?is)<noscript\\b.*?</noscript>', '<i>', 'g') AS h FROM pages),
tok AS (SELECT page_id, unnest(regexp_extract_all(h, '(?s)<!--.*?-->|<[^>]*>|[^<]+')) AS tok, generate_subscripts(regexp_extract_all(h, '(?s)<!--.*?-->|<[^>]*>|[^<]+'), 1) AS pos FROM h),
marked AS (SELECT *, tok LIKE '<%' AS is_tag, lower(regexp_extract(tok, '^</?([a-zA-Z0-9]+)', 1)) AS tag, tok LIKE '</%' AS closing,
  replace(replace(replace(regexp_replace(tok, '&amp;?', '&', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '"') AS said FROM tok),
n AS (SELECT *, sum((is_tag AND tag NOT IN ({_INLINE_TAGS}))::INTEGER) OVER (PARTITION BY page_id ORDER BY pos) AS line,
  sum(CASE WHEN tag = 'a' THEN CASE WHEN closing THEN -1 ELSE 1 END ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS linked FROM marked),
strings AS (SELECT page_id, pos, line, linked, trim(regexp_replace(said, '\\s+', ' ', 'g')) AS s FROM n WHERE NOT is_tag AND trim(regexp_replace(said, '\\s+', ' ', 'g')) <> ''),
h1 AS (SELECT page_id, min(pos) FILTER (tag = 'h1' AND NOT closing) AS a, min(pos) FILTER (tag = 'h1' AND closing) AS b FROM n WHERE is_tag GROUP BY page_id),
name AS (SELECT page_id, string_agg(s, ' ' ORDER BY pos) AS name FROM strings JOIN h1 USING (page_id) WHERE pos BETWEEN a AND b GROUP BY page_id),
lines AS (SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY line)) - 1 AS i, s FROM (SELECT page_id, line, trim(regexp_replace(string_agg(said, '' ORDER BY pos), '\\s+', ' ', 'g')) AS s FROM n WHERE NOT is_tag GROUP BY page_id, line) WHERE s <> '')"""


def _quoted(values: list[str]) -> str:
    return _in(tuple(values))


@query(
    "html_profile",
    f"""WITH {_NODES},
after_h1 AS (SELECT page_id, pos, b, trim(regexp_replace(said, '\\s+', ' ', 'g')) AS s, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS k FROM n JOIN h1 USING (page_id) WHERE NOT is_tag AND pos > a),
below AS (SELECT *, max((regexp_matches(s, '{nodes.URLISH}') OR regexp_matches(s, '{nodes.BOOTH_LABEL}') OR lower(s) IN ({_quoted([*nodes.TAB_LABELS, '#'])}))::INTEGER) OVER (PARTITION BY page_id ORDER BY pos) AS stopped FROM after_h1 WHERE k <= {nodes.NEXT_STRINGS} AND pos > b AND s <> ''),
two AS (SELECT page_id, s, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS k FROM below WHERE stopped = 0),
place AS (SELECT page_id, max(s) FILTER (k = 1) AS city, max(s) FILTER (k = 2) AS country FROM two GROUP BY page_id),
st AS (SELECT l.page_id, coalesce(min(i) FILTER (s = name) + 1, 0) AS start FROM lines l LEFT JOIN name USING (page_id) GROUP BY l.page_id),
tab AS (SELECT page_id, coalesce(min(i) FILTER (i >= start AND lower(s) IN ({_quoted(nodes.HOME_LABELS)})), min(i) FILTER (i >= start AND regexp_matches(s, '{nodes.BOOTH_LABEL}')), any_value(start)) AS tab FROM lines JOIN st USING (page_id) GROUP BY page_id),
head AS (SELECT page_id, min(i) AS head FROM lines JOIN tab USING (page_id) WHERE i > tab AND lower(s) NOT IN ({_quoted([*nodes.TAB_LABELS, '#'])}) GROUP BY page_id),
ends AS (SELECT page_id, min(i) AS ends FROM lines JOIN head USING (page_id) WHERE i >= head AND lower(s) IN ({_quoted(nodes.END_LABELS)}) GROUP BY page_id),
about AS (SELECT page_id, string_agg(s, chr(10) ORDER BY i) AS about FROM lines JOIN head USING (page_id) LEFT JOIN ends USING (page_id) WHERE i >= head AND (ends IS NULL OR i < ends) GROUP BY page_id),
whole AS (SELECT page_id, string_agg(s, ' ' ORDER BY pos) AS w FROM strings GROUP BY page_id)
SELECT page_id, name, nullif(regexp_extract(w, '{nodes.BOOTH_LABEL}', 1), '') AS booth, nullif(array_to_string(list_distinct_ordered, ', '), '') AS city_region, country,
  CASE WHEN length(about) >= {nodes.MIN_ABOUT} THEN about END AS about, CASE WHEN regexp_matches(w, '{nodes.JAPANESE}') THEN 'ja' ELSE 'en' END AS page_lang
FROM whole LEFT JOIN name USING (page_id) LEFT JOIN about USING (page_id) LEFT JOIN (SELECT *, list_filter(list_transform(string_split(city, ','), lambda x: trim(x)), lambda x, i: x <> '' AND list_position(list_transform(string_split(city, ','), lambda y: trim(y)), x) = i) AS list_distinct_ordered FROM place) USING (page_id)""",
)
def html_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles from node tables of the given pages; their websites are links without a url as text, so none is shown."""
    found = nodes.profiles(nodes.node_table(table(spark, sf_dir, "pages"), "page_id"), "page_id")
    return found.drop("website")


@query("html_lines", f"WITH {_NODES} SELECT page_id, count(*) AS n, sum(length(s))::BIGINT AS n_chars, md5(string_agg(s, chr(10) ORDER BY i)) AS digest FROM lines GROUP BY page_id")
def html_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = nodes.page_lines(nodes.node_table(table(spark, sf_dir, "pages"), "page_id"), "page_id")
    chars = F.aggregate("lines", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x))
    return lines.select("page_id", F.size("lines").cast("bigint").alias("n"), chars.alias("n_chars"), F.md5(F.array_join("lines", "\n")).alias("digest"))


@query(
    "linked_texts",
    f"WITH {_NODES}, a AS (SELECT page_id, pos, regexp_extract(tok, 'href=\"([^\"]*)\"', 1) AS href, lead(pos) OVER (PARTITION BY page_id, tag ORDER BY pos) AS b FROM n WHERE tag = 'a' AND is_tag) SELECT a.page_id, href, coalesce(string_agg(s, ' ' ORDER BY s.pos), '') AS said FROM a LEFT JOIN strings s ON a.page_id = s.page_id AND s.pos BETWEEN a.pos AND b WHERE href <> '' GROUP BY a.page_id, a.pos, href",
)
def linked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nodes.element_texts(nodes.node_table(table(spark, sf_dir, "pages"), "page_id"), "page_id", (F.col("tag") == "a") & (F.col("href") != ""))
    return found.select("page_id", "href", "said")
