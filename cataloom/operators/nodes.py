"""Pages as node tables, and the rules of company profiles as plans over them.

node_table reads each page once, with the standard parser, and gives its elements and texts as rows in document order. What is inside an
element is a range of positions; what stands nearest before a link is a window; a line is what no element but an inline one interrupts.
So each rule of a profile is a filter, a window or a grouping within one page, and needs no parser of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import deduped_place
from ..functions.text import is_listing, squash
from ..functions.urls import external_url, joined
from ..session import small_batches
from ..sources.storage import stored

# Elements whose content isn't read, elements without content, and elements that don't break a line.
DROPPED = frozenset("script style noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("strong b em i u span font a small sup sub mark".split())
# Labels and patterns of profile pages.
BOOTH_LABEL = r"(?i)(?:Booth|小間番号)\s*[:：]?\s*([A-Za-z0-9][A-Za-z0-9\-]*)"
URLISH = r"(?i)^(https?://|www\.)"
SOCIAL = ["linkedin.", "facebook.", "twitter.", "x.com", "youtube.", "instagram."]
OWN_HOSTS = ["semi.org", "a2zinc"]
TAB_LABELS = ["home", "products", "ホーム", "出展製品", "製品"]
END_LABELS = ["products", "出展製品", "categories", "カテゴリ", "カテゴリー"]
HOME_LABELS = ["home", "ホーム"]
JAPANESE = "小間番号|ホーム"
WEBSITE_LABEL = r"(?i)\b(visit\s+website|website|company\s+website|www\b)"
WEBSITE_CLASS = r"(?i)web(site)?|globe|external-?link"
OVERVIEW_LABEL = r"(?i)\b(overview|about\s+us|about|company\s+profile|profile)\b"
OVERVIEW_CLASS = r"(?i)overview|about|company-profile|profile-text|description"
HEADER_LABELS = ["company name", "booth", "booth#", "booth no", "booth no.", "website"]
STANDALONE_BOOTH = r"^\s*([A-Z]{0,3}[-\s]?\d{1,5}[A-Z]?)\s*$"
#: Strings behind a heading in which a place is looked for, the shortest overview of a profile, and bounds of portal overviews.
NEXT_STRINGS, MIN_ABOUT, MIN_OVERVIEW, PARAGRAPH, MAX_OVERVIEW = 14, 8, 30, 80, 4000

_FIELDS = ["pos", "depth", "tag", "close", "id", "cls", "href", "label", "content", "line", "text"]
_KINDS = "pos int, depth int, tag string, close int, id string, cls string, href string, label string, content string, line int, text string"


class _Nodes(HTMLParser):
    """Rows of one page. An end tag closes the last open element of its name and what is open inside; others end with the page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.stack: list[int] = []
        self.pieces: list[str] = []
        self.line = self.dropped = 0

    def flush(self) -> None:
        if self.pieces:
            self.rows.append([len(self.rows), len(self.stack), None, len(self.rows), None, None, None, None, None, self.line, "".join(self.pieces)])
            self.pieces = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.flush()
        if tag in DROPPED:
            self.dropped += 1
        if self.dropped:
            return
        a = {k: v or "" for k, v in reversed(attrs)}
        if tag not in INLINE:
            self.line += 1
        self.rows.append([len(self.rows), len(self.stack), tag, len(self.rows), a.get("id"), a.get("class"), a.get("href"), a.get("name") or a.get("property"), a.get("content"), self.line, None])
        if tag not in VOID:
            self.stack.append(len(self.rows) - 1)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.flush()
        if tag in DROPPED:
            self.dropped = max(0, self.dropped - 1)
        if self.dropped or tag in DROPPED:
            return
        if tag not in INLINE:
            self.line += 1
        if any(self.rows[i][2] == tag for i in self.stack):
            while self.rows[i := self.stack.pop()][2] != tag:
                self.rows[i][3] = len(self.rows) - 1
            self.rows[i][3] = len(self.rows) - 1

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self.pieces.append(data)

    def handle_comment(self, data: str) -> None:
        self.flush()
        self.line += 1

    def read(self, page: str) -> list[list]:
        self.feed(page)
        self.close()
        self.flush()
        for i in self.stack:
            self.rows[i][3] = len(self.rows) - 1
        return self.rows


def node_table(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, pos, depth, tag, close, id, cls, href, label, content, line, text) of the elements and texts of each page.

    pos goes on in document order; an element's content is pos to close. A text has no tag. label is the name or property of a meta
    element. Texts on one line, through inline elements, have one line number. Scripts, styles and comments aren't there. A null or
    empty page has no rows; pages with one key are told apart only if keys are unique. The rows are stored, since rules read them many
    times.
    """
    small_batches(pages.sparkSession, rows=1024)
    kind = pages.schema[key].dataType.simpleString()
    strings = {"tag", "id", "cls", "href", "label", "content", "text"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, page in enumerate(batch.column("h").to_pylist()):
                rows = _Nodes().read(page or "")
                for a in range(0, len(rows), 5000):
                    columns = list(zip(*rows[a : a + 5000], strict=True))
                    keys = batch.column("k").take(pa.array([i] * len(columns[0])))
                    yield pa.record_batch([keys, *(pa.array(c, pa.string() if f in strings else pa.int32()) for f, c in zip(_FIELDS, columns, strict=True))], names=["k", *_FIELDS])

    return stored(pages.select(F.col(key).alias("k"), F.col(html).alias("h")).mapInArrow(run, f"k {kind}, {_KINDS}").withColumnRenamed("k", key), "nodes")


def _strings(nodes: DataFrame, key: str) -> DataFrame:
    """(key, at, said, line): texts that aren't blank, white space as one space."""
    return nodes.filter("text IS NOT NULL").select(key, F.col("pos").alias("at"), squash(F.col("text")).alias("said"), "line").filter("said <> ''")


def _joined(rows: DataFrame, by: list[str], sep: str, order: str = "at", text: str = "said") -> DataFrame:
    """(by, said): texts in order, joined."""
    listed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return rows.groupBy(*by).agg(F.array_join(F.transform(listed, lambda x: x["t"]), sep).alias("said"))


def element_texts(nodes: DataFrame, key: str, which: Column, sep: str = " ") -> DataFrame:
    """(key, pos, close, href, said) of the elements which, with the texts inside them; those without any text have an empty one."""
    heads = nodes.filter(F.col("tag").isNotNull() & which).select(key, "pos", "close", "href")
    said = _strings(nodes, key).withColumnRenamed(key, "_k")
    inside = heads.join(said, heads[key].eqNullSafe(said["_k"]) & F.col("at").between(F.col("pos"), F.col("close"))).select(key, "pos", "at", "said")
    texts = _joined(inside, [key, "pos"], sep).select(F.col(key).alias("_k"), F.col("pos").alias("_p"), "said")
    return heads.join(texts, heads[key].eqNullSafe(texts["_k"]) & (F.col("pos") == F.col("_p")), "left").select(key, "pos", "close", "href", F.coalesce("said", F.lit("")).alias("said"))


def _first(rows: DataFrame, key: str, *columns: str, order: Column | None = None) -> DataFrame:
    """One row of each key: that with the lowest order, by position."""
    by = F.struct(*([order] if order is not None else []), "pos")
    return rows.groupBy(key).agg(*(F.min_by(c, by).alias(c) for c in columns))


def page_lines(nodes: DataFrame, key: str) -> DataFrame:
    """(key, lines): the lines of each page in order, as an array; blank ones left out."""
    raw = _joined(nodes.filter("text IS NOT NULL"), [key, "line"], "", "pos", "text").select(key, "line", squash(F.col("said")).alias("said")).filter("said <> ''")
    listed = F.sort_array(F.collect_list(F.struct("line", "said")))
    return raw.groupBy(key).agg(listed["said"].alias("lines"))


def _index(lines: Column, test) -> Column:
    """The lowest index, from 0 on, of a line that passes test(line, index); null if there is none."""
    return F.array_min(F.filter(F.transform(lines, lambda x, i: F.when(test(x, i), i)), lambda i: i.isNotNull()))


def cleaned_lines(lines: Column) -> Column:
    """Lines without the tab labels at their head, up to a label that ends them; null if that is shorter than MIN_ABOUT."""
    head = F.coalesce(_index(lines, lambda x, i: ~F.lower(x).isin(*TAB_LABELS, "#")), F.size(lines))
    end = F.coalesce(_index(lines, lambda x, i: (i >= head) & F.lower(x).isin(END_LABELS)), F.size(lines))
    text = F.array_join(F.slice(lines, head + 1, F.greatest(end - head, F.lit(0))), "\n")
    return F.when(F.length(text) >= MIN_ABOUT, text)


def overviews(nodes: DataFrame, key: str, names: DataFrame) -> DataFrame:
    """(key, about): the lines of the pane with id home, or else those of the page behind its name (key, name) and the first tab label,
    or else its booth."""
    pane = _first(nodes.filter(F.col("tag").isNotNull() & F.lower("id").eqNullSafe("home")).withColumnRenamed("pos", "p").withColumn("pos", F.col("p")), key, "p", "close").select(F.col(key).alias("_k"), F.col("p").alias("_from"), F.col("close").alias("_to"))
    inner = nodes.join(pane, nodes[key].eqNullSafe(pane["_k"]) & F.col("pos").between(F.col("_from"), F.col("_to"))).drop("_k", "_from", "_to")
    inside = page_lines(inner, key).select(F.col(key).alias("_ik"), cleaned_lines(F.col("lines")).alias("inner"))
    named = names.select(F.col(key).alias("_nk"), "name")
    rows = page_lines(nodes, key)
    rows = rows.join(named, rows[key].eqNullSafe(named["_nk"]), "left").join(inside, rows[key].eqNullSafe(inside["_ik"]), "left")
    lines = F.col("lines")
    start = F.coalesce(F.array_position("lines", F.col("name")).cast("int"), F.lit(0))
    tab = F.coalesce(_index(lines, lambda x, i: (i >= F.col("start")) & F.lower(x).isin(HOME_LABELS)), _index(lines, lambda x, i: (i >= F.col("start")) & x.rlike(BOOTH_LABEL)), F.col("start"))
    rest = F.slice(lines, F.col("tab") + 2, F.greatest(F.size(lines) - F.col("tab") - 1, F.lit(0)))
    return rows.withColumn("start", start).withColumn("tab", tab).select(key, F.coalesce("inner", cleaned_lines(rest)).alias("about"))


def places(nodes: DataFrame, key: str) -> DataFrame:
    """(key, city_region, country): the first two texts under the first heading with a text, before a url, a booth or a tab label."""
    heads = element_texts(nodes, key, F.col("tag") == "h1").filter("said <> ''")
    first = heads.groupBy(key).agg(F.min_by(F.struct("pos", "close"), "pos").alias("h")).select(F.col(key).alias("_k"), F.col("h.pos").alias("_from"), F.col("h.close").alias("_to"))
    texts = nodes.filter("text IS NOT NULL").select(key, "pos", squash(F.col("text")).alias("said"))
    w = Window.partitionBy(key).orderBy("pos")
    behind = texts.join(first, texts[key].eqNullSafe(first["_k"]) & (F.col("pos") > F.col("_from"))).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= NEXT_STRINGS)
    behind = behind.filter((F.col("pos") > F.col("_to")) & (F.col("said") != ""))
    stop = F.col("said").rlike(URLISH) | F.col("said").rlike(BOOTH_LABEL) | F.lower("said").isin(*TAB_LABELS, "#")
    good = behind.withColumn("stopped", F.max(stop.cast("int")).over(w)).filter("stopped = 0").withColumn("n", F.row_number().over(w)).filter("n <= 2")
    found = good.groupBy(key).agg(F.max(F.when(F.col("n") == 1, F.col("said"))).alias("city_region"), F.max(F.when(F.col("n") == 2, F.col("said"))).alias("country"))
    return found.select(key, deduped_place(F.col("city_region")).alias("city_region"), "country")


def _any(text: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def shown_websites(nodes: DataFrame, key: str) -> DataFrame:
    """(key, website): the first link whose text is a url, links of the redirector first; not the show's own and no social network."""
    links = element_texts(nodes, key, (F.col("tag") == "a") & F.col("href").isNotNull(), "")
    low = F.lower("said")
    good = links.filter(F.col("said").rlike(URLISH) & ~_any(low, OWN_HOSTS + SOCIAL))
    site = _first(good, key, "said", order=~F.lower("href").contains("boothurl.aspx"))
    return site.select(key, F.when(F.lower("said").startswith("http"), F.col("said")).otherwise(F.concat(F.lit("https://"), F.col("said"))).alias("website"))


def profiles(nodes: DataFrame, key: str) -> DataFrame:
    """(key, name, booth, city_region, country, website, about, page_lang) of profile pages in English or Japanese; null where a page
    doesn't tell. A page without any text has no row."""
    names = _first(element_texts(nodes, key, F.col("tag") == "h1").filter("said <> ''"), key, "said").withColumnRenamed("said", "name")
    whole = _joined(_strings(nodes, key), [key], " ")
    out = whole.select(key, F.nullif(F.regexp_extract("said", BOOTH_LABEL, 1), F.lit("")).alias("booth"), F.when(F.col("said").rlike(JAPANESE), "ja").otherwise("en").alias("page_lang"))
    for part in (names, places(nodes, key), shown_websites(nodes, key), overviews(nodes, key, names)):
        other = part.withColumnRenamed(key, "_k")
        out = out.join(other, out[key].eqNullSafe(other["_k"]), "left").drop("_k")
    return out.select(key, "name", "booth", "city_region", "country", "website", "about", "page_lang")


def headquarters(nodes: DataFrame, key: str, names: DataFrame) -> DataFrame:
    """(key, hq_location, website): the labelled city and country, by id or else by class, or else the two lines that follow the
    company's name (key, name) on the page, before its booth; and the first link whose text is a url that isn't the show's own."""
    found = None
    for label, which in (
        ("by_id", [F.lower("id").contains("lblcity"), F.lower("id").contains("lblcountry")]),
        ("by_class", [F.array_contains(F.split("cls", r"\s+"), f"BoothContact{x}") for x in ("City", "Country")]),
    ):
        parts = None
        for i, c in enumerate(which):
            one = _first(element_texts(nodes, key, F.coalesce(c, F.lit(False)), ""), key, "said").select(key, F.lit(i).alias("i"), "said")
            parts = one if parts is None else parts.union(one)
        place = parts.filter("said <> ''").groupBy(key).agg(F.array_join(F.array_distinct(F.sort_array(F.collect_list(F.struct("i", "said")))["said"]), ", ").alias(label))
        place = place.withColumnRenamed(key, f"_{label}")
        found = place if found is None else found.join(place, F.col("_by_id").eqNullSafe(F.col("_by_class")), "full").select(F.coalesce("_by_id", "_by_class").alias("_k"), F.coalesce("by_id", "by_class").alias("labelled"))
    whole = _joined(_strings(nodes, key), [key], "\n")
    named = names.select(F.col(key).alias("_nk"), "name")
    rows = whole.join(named, whole[key].eqNullSafe(named["_nk"]), "left").join(found, whole[key].eqNullSafe(found["_k"]), "left")
    at = F.expr("instr(said, name)")
    after = F.filter(F.transform(F.split(F.expr("substring(said, instr(said, name) + length(name))"), "\n"), squash), lambda x: x != "")
    low = lambda x: F.lower(x)
    useful = F.filter(after, lambda x: ~(low(x).startswith("http") | low(x).startswith("www.") | low(x).contains(".com") | low(x).contains(".tw")))
    ends = F.coalesce(_index(useful, lambda x, i: low(x).startswith("booth:") | F.regexp_replace(low(x), " ", "").contains("sendemail")), F.size(useful))
    two = F.array_distinct(F.slice(useful, 1, F.least(ends, F.lit(2))))
    read = F.when(at > 0, F.nullif(F.array_join(two, ", "), F.lit("")))
    links = element_texts(nodes, key, (F.col("tag") == "a") & F.col("href").isNotNull(), "")
    sites = _first(links.filter(F.lower("said").rlike(r"^(https?://|www\.)") & ~F.lower("said").contains("semi.org")), key, "said").select(F.col(key).alias("_sk"), F.col("said").alias("website"))
    out = rows.withColumn("hq_location", deduped_place(F.coalesce("labelled", read)))
    return out.join(sites, out[key].eqNullSafe(sites["_sk"]), "left").select(key, "hq_location", "website")


def linked_websites(nodes: DataFrame, key: str, pages: DataFrame, url: str = "url") -> DataFrame:
    """(key, website, found_by) of portal pages (key, url), in three passes: a link whose text, or the text nearest before it, says
    website; a link with an icon's class; any external link."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    near = nodes.withColumn("before", F.last("text", ignorenulls=True).over(w)).filter((F.col("tag") == "a") & F.col("href").isNotNull()).select(F.col(key).alias("_k"), F.col("pos").alias("_p"), "before", "cls")
    links = element_texts(nodes, key, (F.col("tag") == "a") & F.col("href").isNotNull())
    rows = links.join(near, links[key].eqNullSafe(near["_k"]) & (F.col("pos") == F.col("_p")))
    base = pages.select(F.col(key).alias("_bk"), F.col(url).alias("_base"))
    rows = rows.join(base, rows[key].eqNullSafe(base["_bk"]), "left").withColumn("website", external_url(F.col("_base"), F.col("href")))
    says = F.col("said").rlike(WEBSITE_LABEL) | F.coalesce("before", F.lit("")).rlike(WEBSITE_LABEL)
    ranked = rows.filter("website IS NOT NULL").withColumn("found_by", F.when(says, 1).when(F.coalesce("cls", F.lit("")).rlike(WEBSITE_CLASS), 2).otherwise(3))
    return _first(ranked, key, "website", "found_by", order=F.col("found_by"))


def portal_overviews(nodes: DataFrame, key: str) -> DataFrame:
    """(key, overview, found_by) of portal pages: an element named so, the block behind a heading that says so, the meta description, the
    longest paragraph."""
    classed = _first(element_texts(nodes, key, F.coalesce(F.col("cls").rlike(OVERVIEW_CLASS), F.lit(False))), key, "said").select(key, F.lit(1).alias("found_by"), "said")
    heads = element_texts(nodes, key, F.col("tag").isin("h2", "h3", "h4", "strong", "b")).filter(F.col("said").rlike(OVERVIEW_LABEL)).select(F.col(key).alias("_k"), F.col("pos").alias("_h"))
    blocks = element_texts(nodes, key, F.col("tag").isin("p", "div"))
    nexts = blocks.join(heads, blocks[key].eqNullSafe(heads["_k"]) & (F.col("pos") > F.col("_h"))).groupBy(key, "_h").agg(F.min_by("said", "pos").alias("said")).filter(F.length("said") > MIN_OVERVIEW)
    labelled = nexts.groupBy(key).agg(F.min_by("said", "_h").alias("said")).select(key, F.lit(2).alias("found_by"), "said")
    metas = nodes.filter((F.col("tag") == "meta") & F.col("label").isin("description", "og:description"))
    meta = _first(metas.withColumn("said", squash(F.col("content"))), key, "said", order=F.col("label") != "description").select(key, F.lit(3).alias("found_by"), "said")
    long = element_texts(nodes, key, F.col("tag") == "p").filter(F.length("said") > PARAGRAPH)
    longest = long.groupBy(key).agg(F.max_by("said", F.struct(F.length("said"), -F.col("pos"))).alias("said")).select(key, F.lit(4).alias("found_by"), "said")
    every = classed.union(labelled).union(meta).union(longest).filter(F.length("said") > MIN_OVERVIEW)
    best = every.groupBy(key).agg(F.min_by("said", "found_by").alias("said"), F.min("found_by").alias("found_by"))
    # the meta description isn't cut
    return best.select(key, F.when(F.col("found_by") == 3, F.col("said")).otherwise(F.substring("said", 1, MAX_OVERVIEW)).alias("overview"), "found_by")


def directory_rows(nodes: DataFrame, key: str, pages: DataFrame, url: str = "url") -> DataFrame:
    """(key, row, name, booth, ebooth_url, portal_url, status) of the table rows of a directory with two cells or more.

    The booth is the first cell that is a booth number alone, the name the first other cell. Rows with a header's label and rows that
    name no company are out. The first link of a row counts if it leads to the portal (ok) or to a booth page; a row without either is
    no-portal-listed.
    """
    heads = nodes.filter("tag = 'tr'").select(F.col(key).alias("_k"), F.col("pos").alias("row"), F.col("close").alias("_to"))
    cells = element_texts(nodes, key, F.col("tag").isin("td", "th"))
    both = cells.join(heads, cells[key].eqNullSafe(heads["_k"]) & F.col("pos").between(F.col("row"), F.col("_to")))
    listed = both.groupBy(key, "row").agg(F.sort_array(F.collect_list(F.struct("pos", "said")))["said"].alias("cells"))
    listed = listed.filter((F.size("cells") >= 2) & ~F.exists("cells", lambda c: F.lower(c).isin(HEADER_LABELS)))
    number = lambda c: c.rlike(STANDALONE_BOOTH)
    rows = listed.select(key, "row", F.coalesce(F.get(F.filter("cells", lambda c: (c != "") & ~number(c)), F.lit(0)), F.lit("")).alias("name"), F.regexp_replace(F.coalesce(F.get(F.filter("cells", number), F.lit(0)), F.lit("")), " ", "").alias("booth"))
    links = nodes.filter((F.col("tag") == "a") & F.col("href").isNotNull()).select(F.col(key).alias("_ak"), F.col("pos").alias("_at"), "href")
    inside = links.join(heads, links["_ak"].eqNullSafe(heads["_k"]) & F.col("_at").between(F.col("row"), F.col("_to"))).groupBy("_ak", F.col("row").alias("_row")).agg(F.min_by("href", "_at").alias("href"))
    base = pages.select(F.col(key).alias("_bk"), F.col(url).alias("_base"))
    out = rows.join(inside, rows[key].eqNullSafe(inside["_ak"]) & (rows["row"] == inside["_row"]), "left")
    out = out.join(base, out[key].eqNullSafe(base["_bk"]), "left").withColumn("link", joined(F.col("_base"), F.col("href")))
    booth_page = F.lower("link").contains("ebooth.aspx")
    good = F.when(booth_page | F.col("link").contains("/co/"), F.col("link"))
    out = out.withColumns({"ebooth_url": F.when(booth_page, good), "portal_url": F.when(~booth_page, good)})
    status = F.when(F.col("portal_url").isNotNull(), "ok").when(F.col("ebooth_url").isNull(), "no-portal-listed").otherwise("")
    return out.filter((F.col("name") != "") & ~is_listing(F.col("name"))).select(key, "row", "name", "booth", "ebooth_url", "portal_url", status.alias("status"))


def _window(text: Column, pattern: str, least: int) -> Column:
    """The lines of what the pattern's first group holds that are longer than least, joined by spaces; null if there are none."""
    lines = F.filter(F.transform(F.split(F.regexp_extract(text, pattern, 1), "\n"), F.trim), lambda x: F.length(x) > least)
    return F.nullif(F.array_join(lines, " "), F.lit(""))


def abouts(nodes: DataFrame, key: str) -> DataFrame:
    """(key, about, found_by) of booth pages, by three strategies: an element named as a description with more than 40 characters; the
    lines of more than 20 between Overview and Categories in the content's container; those of more than 30 behind the booth."""
    has = lambda name: F.array_contains(F.split(F.coalesce("cls", F.lit("")), r"\s+"), name)
    named = [F.lower(F.coalesce("id", F.lit(""))).contains("description"), has("exhibitor-description"), has("co-description")]
    found = None
    for i, which in enumerate(named):
        one = _first(element_texts(nodes, key, which), key, "said").filter(F.length("said") > 40).select(key, F.lit(1).alias("found_by"), F.lit(i).alias("o"), F.col("said").alias("about"))
        found = one if found is None else found.union(one)
    for i, name in enumerate(("content-container", "ctl00_dvContent")):
        texts = _first(element_texts(nodes, key, F.col("id").eqNullSafe(name), "\n"), key, "said")
        about = _window(F.col("said"), r"(?im)^[^\S\n]*Overview[^\S\n]*$([\s\S]*?)(?:^[^\S\n]*Categories[^\S\n]*$|Type your information and click|Send Mail|Appointment|\z)", 20)
        found = found.union(texts.select(key, F.lit(2), F.lit(i), about.alias("about")))
    whole = _joined(_strings(nodes, key), [key], "\n").withColumn("after", F.regexp_extract("said", r"Booth:\s*\S+([\s\S]*)", 1))
    behind = F.when(F.col("after").rlike(r"(?im)^[^\S\n]*Overview[^\S\n]*$"), F.regexp_extract("after", r"(?im)^[^\S\n]*Overview[^\S\n]*$([\s\S]*)", 1)).otherwise(F.col("after"))
    third = _window(behind, r"(?im)\A([\s\S]*?)(?:^[^\S\n]*Categories[^\S\n]*$|Type your information and click|Character Limit:|Send Mail|Appointment Date|\z)", 30)
    found = found.union(whole.select(key, F.lit(3), F.lit(0), third.alias("about"))).filter("about IS NOT NULL")
    return _first(found.withColumn("pos", F.col("o")), key, "about", "found_by", order=F.col("found_by"))
