"""Entity resolution: records with one merge key become one entity, by folds in input order.

Each fold is an aggregate that Spark combines partially: first and last values by ordinal as min_by and max_by, ordered lists as
sorted structs. Lists of an entity hold what its own records hold; a record without key is its own entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fallback_key, name_key, presence, strip
from ..functions.urls import full_domain, website_domain
from ..schema import FALLBACK_ABOUT, MISSING_URL, UNKNOWN_COUNTRY
from ..sources.storage import released, stored


def in_order(value: Column, seq: str = "_seq") -> Column:
    """The values of a group by ordinal."""
    return F.transform(F.sort_array(F.collect_list(F.struct(F.col(seq).alias("o"), value.alias("v")))), lambda x: x["v"])


def first_where(value: Column, condition: Column, seq: str = "_seq") -> Column:
    """The first value by ordinal for which condition holds, or null."""
    return F.min_by(F.when(condition, value), F.when(condition, F.col(seq)))


def longest(value: Column, condition: Column | None = None, seq: str = "_seq") -> Column:
    """The longest value, the first of equals."""
    keep = value.isNotNull() if condition is None else condition
    return F.max_by(F.when(keep, value), F.when(keep, F.struct(F.length(value), -F.col(seq))))


def merged_about(seq: str = "_seq") -> Column:
    """The longest description that isn't the fallback, else the first that isn't empty, else the fallback."""
    about = F.col("about")
    real = presence(about).isNotNull() & (about != FALLBACK_ABOUT)
    return F.coalesce(longest(about, real, seq), first_where(about, presence(about).isNotNull(), seq), F.lit(FALLBACK_ABOUT))


def distinct_trimmed(values: Column) -> Column:
    """Trimmed values in order, without blanks and repeats."""
    return F.array_distinct(F.filter(F.transform(values, strip), lambda x: x != ""))


def id_union(df: DataFrame, key: str, ids: str, names: str, seq: str = "_seq", many: bool = False) -> DataFrame:
    """(key, ids, names): ids of a group in order of first appearance, each with the first name; a list that is longer is cut.

    many tells that most ids of a group appear once or twice, so that combining before the shuffle saves little: pairs are then dealt by
    key, once, for the ids and for the lists.
    """
    pairs = df.select(key, F.col(seq).alias("o"), F.posexplode(F.arrays_zip(F.col(ids).alias("id"), F.col(names).alias("name"))).alias("pos", "p"))
    pairs = pairs.filter("p.id IS NOT NULL AND p.name IS NOT NULL").select(key, "o", "pos", "p.id", "p.name")
    if many:
        pairs = pairs.repartition(key)
    first = pairs.groupBy(key, "id").agg(F.min(F.struct("o", "pos")).alias("at"), F.min_by("name", F.struct("o", "pos")).alias("name"))
    lists = first.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "id", "name"))).alias("v"))
    return lists.select(key, F.col("v.id").alias(ids), F.col("v.name").alias(names))


def merged_trees(df: DataFrame, key: str, seq: str = "_seq") -> DataFrame:
    """(key, cat_tree): category trees merged by level-1 id and child id, in order of first appearance; first names win.

    Nodes are dealt by key, once, for children, their lists and the tree. A node without children is a row without a child.
    """
    nodes = df.select(key, F.col(seq).alias("o"), F.posexplode("cat_tree").alias("pos", "n"))
    rows = nodes.select(key, "o", "pos", "n.l1_id", "n.l1_name", F.posexplode_outer("n.children").alias("cpos", "c"))
    rows = rows.select(key, "o", "pos", "l1_id", "l1_name", "cpos", F.col("c.id").alias("id"), F.col("c.name").alias("name")).repartition(key)
    at, cat = F.struct("o", "pos"), F.struct("o", "pos", "cpos")
    firsts = rows.groupBy(key, "l1_id", F.col("cpos").isNotNull().alias("real"), "id").agg(F.min(at).alias("at"), F.min_by("l1_name", at).alias("l1_name"), F.min(cat).alias("cat"), F.min_by("name", cat).alias("name"))
    child = F.when(F.col("real"), F.struct("cat", "id", "name"))
    heads = firsts.groupBy(key, "l1_id").agg(F.min_by("l1_name", "at").alias("l1_name"), F.min("at").alias("at"), F.transform(F.sort_array(F.collect_list(child)), lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name"))).alias("children"))
    tree = F.transform(F.sort_array(F.collect_list(F.struct("at", "l1_id", "l1_name", "children"))), lambda x: F.struct(x["l1_id"].alias("l1_id"), x["l1_name"].alias("l1_name"), x["children"].alias("children")))
    return heads.groupBy(key).agg(tree.alias("cat_tree"))


def with_categories(entities: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Adds the categories of each entity's records, where rows have them: ids of both levels with their names, and the merged tree."""
    none = {"cat_l1_ids": "array<int>", "cat_l1_names": "array<string>", "cat_l2_ids": "array<int>", "cat_l2_names": "array<string>"}
    out = entities
    for level in (1, 2):
        ids, names = f"cat_l{level}_ids", f"cat_l{level}_names"
        if ids in rows.columns and names in rows.columns:
            lists = id_union(rows, key, ids, names, many=level == 2)
            out = out.join(lists, key, "left").withColumns({c: F.coalesce(c, F.array().cast(none[c])) for c in (ids, names)})
    if "cat_tree" in rows.columns:
        trees = merged_trees(rows, key)
        out = out.join(trees, key, "left").withColumn("cat_tree", F.coalesce("cat_tree", F.array().cast(trees.schema["cat_tree"].dataType)))
    return out


def _read_once(rows: DataFrame, key: str) -> DataFrame:
    """Records with categories as a table in order of their keys, since each fold of categories reads them again; others as they are.
    Records of one entity that lie together combine before they are shuffled, and are small."""
    if not any(c.startswith("cat_") for c in rows.columns):
        return rows
    out = stored(rows.sortWithinPartitions(key, "_seq"), "records", "zstd")
    released(rows.sparkSession)
    return out


def by_name(records: DataFrame, ordered: bool = True) -> DataFrame:
    """Entities by name key, from records with _seq, locations and sources; sorted by name unless ordered is false. Categories are merged
    where records have them.

    Description: the longest real one. Headquarters: the first known country with its location; other known ones make
    hq_country_conflict, sorted. Website and name: the first. Locations are distinct, sources all. Records without key stay alone.
    """
    key = name_key(F.col("company_name"))
    rows = _read_once(records.withColumn("_key", F.when(key == "", F.concat(F.lit("\0"), F.col("_seq").cast("string"))).otherwise(key)), "_key")
    country = presence(F.col("hq_country"))
    known = country.isNotNull() & (F.col("hq_country") != UNKNOWN_COUNTRY)
    all_known = F.array_sort(F.collect_set(F.when(known, F.col("hq_country"))))
    out = rows.groupBy("_key").agg(
        F.min("_seq").alias("_seq"),
        F.min_by("company_name", "_seq").alias("company_name"),
        merged_about().alias("about"),
        F.coalesce(first_where(F.col("hq_country"), known), F.lit(UNKNOWN_COUNTRY)).alias("hq_country"),
        F.coalesce(first_where(F.col("hq_location"), known), F.min_by("hq_location", "_seq")).alias("hq_location"),
        F.when(F.size(all_known) > 1, all_known).alias("hq_country_conflict"),
        F.coalesce(first_where(F.col("website"), presence(F.col("website")).isNotNull()), F.lit("")).alias("website"),
        F.array_distinct(F.flatten(in_order(F.col("locations")))).alias("locations"),
        F.flatten(in_order(F.col("sources"))).alias("sources"),
    )
    out = with_categories(out, rows, "_key")
    return out.orderBy(F.lower("company_name"), "_seq") if ordered else out


def _paragraphs(rows: DataFrame, key: str) -> DataFrame:
    """(key, about): distinct real descriptions in order, apart from case and white space, one of each before anything is collected."""
    about = F.col("about")
    real = rows.filter(presence(about).isNotNull() & (about != FALLBACK_ABOUT))
    norm = F.lower(F.regexp_replace(strip(about), r"(?U)\s+", " "))
    once = real.groupBy(key, norm.alias("norm")).agg(F.min("_seq").alias("o"), F.min_by(strip(about), "_seq").alias("t"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("o", "t"))), lambda x: x["t"])
    return once.groupBy(key).agg(F.array_join(listed, "\n\n").alias("about"))


def by_domain(records: DataFrame) -> DataFrame:
    """Entities by full website domain, or by fallback name key where there is none; names without key are one entity together.

    Name: the longest. Description: distinct paragraphs. Country: the first that isn't Unknown; several make a conflict list, in
    order, Unknown included. Sources without url are left out; a missing website is "#". Categories are merged where records have them.
    """
    key = F.coalesce(full_domain(F.col("website")), F.concat(F.lit("__name__"), fallback_key(F.col("company_name"))))
    rows = _read_once(records.withColumn("_merge_key", key), "_merge_key")
    countries = F.array_distinct(F.filter(in_order(F.coalesce(presence(F.col("hq_country")), F.lit(UNKNOWN_COUNTRY))), lambda x: x.isNotNull()))
    agg = rows.groupBy("_merge_key").agg(
        F.min("_seq").alias("_first"),
        F.coalesce(longest(F.col("company_name"), presence(F.col("company_name")).isNotNull()), F.lit("")).alias("company_name"),
        distinct_trimmed(in_order(F.col("company_name"))).alias("_all_names"),
        distinct_trimmed(in_order(F.col("website"))).alias("_all_websites"),
        F.get(distinct_trimmed(in_order(F.col("hq_location"))), F.lit(0)).alias("hq_location"),
        F.coalesce(F.get(F.filter(in_order(F.get(F.filter("sources", lambda x: F.coalesce(x["ebooth_url"], F.lit("")) != ""), F.lit(0))["ebooth_url"]), lambda x: x.isNotNull()), F.lit(0)), F.lit(MISSING_URL)).alias("ebooth_url"),
        countries.alias("countries"),
        F.coalesce(longest(F.col("website_scrape")), F.lit("")).alias("website_scrape"),
        F.array_distinct(F.filter(F.flatten(in_order(F.col("locations"))), lambda x: x != "")).alias("locations"),
        F.filter(F.flatten(in_order(F.col("sources"))), lambda s: F.coalesce(s["ebooth_url"], F.lit("")) != "").alias("sources"),
    )
    rest = F.filter("countries", lambda x: x != UNKNOWN_COUNTRY)
    agg = agg.join(_paragraphs(rows, "_merge_key"), "_merge_key", "left")
    out = agg.withColumns(
        {
            "about": F.coalesce("about", F.lit(FALLBACK_ABOUT)),
            "hq_country": F.coalesce(F.get(rest, F.lit(0)), F.lit(UNKNOWN_COUNTRY)),
            "_hq_country_conflict": F.when(F.size("countries") > 1, F.col("countries")),
            "website": F.coalesce(F.get("_all_websites", F.lit(0)), F.lit(MISSING_URL)),
        }
    ).drop("countries").withColumnRenamed("_first", "_seq")
    return with_categories(out, rows, "_merge_key")


def merged_exhibitors(rows: DataFrame, key: Column) -> DataFrame:
    """Exhibitors by key: halls in one list, booths joined by " / " where one doesn't hold the next, and the first value of each
    other text column."""
    fill = [c for c, kind in rows.dtypes if kind == "string" and c not in ("booth", "name")]
    known = {c: presence(F.col(c)).isNotNull() for c in fill}
    # a booth that repeats adds nothing, so its first place is enough
    once = rows.groupBy(key.alias("_key"), F.coalesce("booth", F.lit("")).alias("booth")).agg(
        F.min(F.struct("_seq")).alias("_at"),
        F.min_by(F.struct("name"), "_seq").alias("_name"),
        F.min("_seq").alias("_seq"),
        F.collect_set("halls").alias("halls"),
        *(F.min(F.when(known[c], F.struct("_seq", F.col(c).alias("v")))).alias(c) for c in fill),
    )
    listed = F.transform(F.sort_array(F.collect_list(F.struct(F.col("_at").alias("o"), F.col("booth").alias("v")))), lambda x: x["v"])
    booths = F.aggregate(
        F.filter(listed, lambda b: b != ""),
        F.lit(""),
        lambda a, b: F.when(a == "", b).when(a.contains(b), a).otherwise(F.concat(a, F.lit(" / "), b)),
    )
    out = once.groupBy("_key").agg(
        F.min_by("_name", "_seq")["name"].alias("name"),
        booths.alias("booth"),
        F.array_sort(F.array_distinct(F.flatten(F.flatten(F.collect_list("halls"))))).alias("halls"),
        *(F.coalesce(F.min(c)["v"], F.lit("")).alias(c) for c in fill),
    )
    return out.orderBy(F.lower("name"))


def collisions(entities: DataFrame, url: str = "website", name: str = "company_name") -> DataFrame:
    """(domain, names): domains that entities with different names share."""
    rows = entities.select(website_domain(F.col(url)).alias("domain"), F.col(name).alias("name")).filter("domain IS NOT NULL")
    return rows.groupBy("domain").agg(F.array_sort(F.collect_set("name")).alias("names")).filter(F.size("names") > 1)


def url_collisions(rows: DataFrame, url: str, name: str) -> DataFrame:
    """(url, names): urls that several rows share, their names with repeats."""
    return rows.filter(presence(F.col(url)).isNotNull()).groupBy(F.col(url).alias("url")).agg(F.array_sort(F.collect_list(name)).alias("names")).filter(F.size("names") > 1)
