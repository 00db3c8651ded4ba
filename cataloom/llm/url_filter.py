"""URL filters: explicit rules, and a tree of path templates judged by labelled purity; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: A segment can stay literal if it has so many urls, and such a share of its parent's; so 1 / MIN_SHARE of them at most.
MIN_URLS, MIN_SHARE = 20, 0.01
#: Branches whose labelled rates differ by fewer standard errors are merged.
MERGE_Z = 1.96
#: Labelled urls that a host's own rate counts for in its templates, and the overall rate in a host.
SMOOTHING = 8.0
#: Templates of which such a smoothed share of urls is labelled bad are rejected, if so many of their own urls are labelled.
REJECT_SHARE, REJECT_LABELS = 0.5, 5

_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"
WILD = "*"


def host_of(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _SPLIT, 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as a string, and its verdict; both null where none fits. rules: (host, path, verdict)."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, f"{h}{p}").otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def typed_segments(path: Column) -> Column:
    """The segments of a path, all of them, with numbers, dates, hexadecimal and mixed ids as typed wildcards; an end slash is an empty
    segment, and one that itself begins with < gets a =."""
    raw = F.split(F.regexp_replace(path, "^/", ""), "/", -1)

    def kind(s: Column) -> Column:
        number = F.regexp_replace(s, r"^\d+(?=$|\.)", "<n>")
        return (
            F.when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.lit("<date>"))
            .when(s.rlike(r"^(?=.*\d)[0-9a-fA-F]{8,}$|^[0-9a-fA-F]{8}-[0-9a-fA-F-]{27}$"), F.when(s.rlike(r"^\d+$"), F.lit("<n>")).otherwise(F.lit("<hex>")))
            .when(s.startswith("<"), F.concat(F.lit("="), s))
            .otherwise(number)
        )

    return F.transform(raw, kind)


def _is_typed(seg: Column) -> Column:
    return seg.startswith("<") | (seg == "")


def _alike(a: Column, b: Column) -> Column:
    """Whether the labelled rates of two branches (labelled, bad), both with labels, don't differ significantly."""
    pooled = (a["bad"] + b["bad"]) / (a["labelled"] + b["labelled"])
    error = F.sqrt(pooled * (1 - pooled) * (1 / a["labelled"] + 1 / b["labelled"]))
    return F.abs(a["bad"] / a["labelled"] - b["bad"] / b["labelled"]) <= MERGE_Z * error


def merged_branches(children: DataFrame) -> DataFrame:
    """(host, prefix, seg, name) for the children (host, prefix, seg, n, labelled, bad) of each parent that keep a name of their own.

    Frequent segments with labels are put in order of their rate, the rest of the siblings among them as one; neighbours that are
    alike become one branch, and then it and the next are compared. A branch with the rest, or the only one, is a wildcard; any
    other is named by its segments. At most 1 / MIN_SHARE segments of a parent are compared. An only child keeps its name.
    """
    free = children.filter(~_is_typed(F.col("seg")))
    sums = free.groupBy("host", "prefix").agg(F.sum("n").alias("all_n"), F.count("*").alias("siblings"))
    ranked = free.join(sums, ["host", "prefix"]).withColumn("own", (F.col("n") >= MIN_URLS) & (F.col("n") >= MIN_SHARE * F.col("all_n")) & (F.col("labelled") > 0))
    kind = "array<struct<segs:array<string>,rest:boolean,labelled:bigint,bad:bigint>>"
    rate = F.col("bad") / F.col("labelled")
    item = F.struct(rate.alias("rate"), F.array("seg").alias("segs"), F.lit(False).alias("rest"), F.col("labelled").cast("bigint").alias("labelled"), F.col("bad").cast("bigint").alias("bad"))
    none = F.array().cast("array<string>")
    parents = ranked.groupBy("host", "prefix", "siblings").agg(F.collect_list(F.when(F.col("own"), item)).alias("items"), *(F.coalesce(F.sum(F.when(~F.col("own"), F.col(c))), F.lit(0)).cast("bigint").alias(c) for c in ("labelled", "bad")))
    rest = F.struct((F.col("bad") / F.nullif("labelled", F.lit(0))).alias("rate"), none.alias("segs"), F.lit(True).alias("rest"), F.col("labelled"), F.col("bad"))
    ordered = F.array_sort(F.when(F.col("labelled") > 0, F.concat("items", F.array(rest))).otherwise(F.col("items")))

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        fresh = F.struct(x["segs"].alias("segs"), x["rest"].alias("rest"), x["labelled"].alias("labelled"), x["bad"].alias("bad"))
        both = F.struct(F.concat(last["segs"], x["segs"]).alias("segs"), (last["rest"] | x["rest"]).alias("rest"), (last["labelled"] + x["labelled"]).alias("labelled"), (last["bad"] + x["bad"]).alias("bad"))
        return F.when(F.size(acc) == 0, F.array(fresh)).when(_alike(last, x), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(both))).otherwise(F.concat(acc, F.array(fresh)))

    groups = parents.filter("siblings > 1").select("host", "prefix", F.aggregate(ordered, F.array().cast(kind), step).alias("groups")).filter("size(groups) > 1")
    branch = groups.select("host", "prefix", F.explode("groups").alias("g")).filter("NOT g.rest")
    name = F.when(F.size("g.segs") == 1, F.col("g.segs")[0]).otherwise(F.concat(F.lit("{"), F.array_join(F.array_sort("g.segs"), "|"), F.lit("}")))
    named = branch.select("host", "prefix", name.alias("name"), F.explode("g.segs").alias("seg")).select("host", "prefix", "seg", "name")
    return named.union(ranked.filter("siblings = 1 AND n >= " + str(MIN_URLS)).select("host", "prefix", "seg", F.col("seg").alias("name")))


def _behind(segs: str, n: Column) -> Column:
    return F.slice(segs, n + 1, F.greatest(F.size(segs) - n, F.lit(0)))


def _descended(leaves: DataFrame) -> DataFrame:
    """leaves (host, rest, n, prefix, ...) further down their nodes (host, prefix), as far as one step decides: through the segments
    that all leaves of a node share, and to the end below nodes of fewer than MIN_URLS urls, where no segment keeps a name."""
    ends = leaves.groupBy("host", "prefix").agg(F.min("rest").alias("low"), F.max("rest").alias("high"), F.sum("n").alias("node_n"))
    differ = F.array_position(F.zip_with("low", "high", lambda a, b: a.eqNullSafe(b)), False)
    nodes = ends.select("host", "prefix", "node_n", F.when(differ > 0, differ - 1).otherwise(F.size("low")).cast("int").alias("shared"))
    few = F.col("node_n") < MIN_URLS
    named = F.transform(F.slice("rest", 1, F.when(few, F.size("rest")).otherwise(F.col("shared"))), lambda x: F.concat(F.lit("/"), F.when(few & ~_is_typed(x), WILD).otherwise(x)))
    both = leaves.join(written(nodes, "url-nodes"), ["host", "prefix"])
    return both.withColumns({"prefix": F.concat("prefix", F.array_join(named, "")), "rest": F.when(few, F.array().cast("array<string>")).otherwise(_behind("rest", F.col("shared")))})


def template_tree(urls: DataFrame) -> DataFrame:
    """Templates from (host, path, label), label being 1 for bad, 0 for good and null for unknown.

    Returns (host, segs, template, n, labelled, bad, share, reject), a row for each host and typed path. From the root down,
    frequent segments whose labelled rates don't differ significantly are merged, see merged_branches; typed segments stay, and all
    others are a wildcard. Paths of any depth are followed: a turn goes through all segments that a node's urls share, and then one branching. share is the template's smoothed share of bad urls: towards
    its host's share, and that towards the share of all. All urls count.
    """
    leaves = urls.groupBy("host", typed_segments(F.col("path")).alias("segs")).agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).alias("bad"))
    leaves = written(leaves.withColumns({"rest": F.col("segs"), "prefix": F.lit("")}), "url-leaves")
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "bad")]
    columns = ["host", "segs", "rest", "n", "labelled", "bad", "prefix"]
    node, done, turn = ["host", "prefix"], [], 0
    while not leaves.isEmpty():
        leaves = written(_descended(leaves).select(*columns), f"url-common-{turn}")
        done.append(leaves.filter("size(rest) = 0").select(*columns))
        open_ = leaves.filter("size(rest) > 0").withColumn("seg", F.col("rest")[0])
        children = written(open_.groupBy(*node, "seg").agg(*sums), f"url-children-{turn}")
        names = children.join(written(merged_branches(children), f"url-branches-{turn}"), [*node, "seg"], "left")
        step = F.when(_is_typed(F.col("seg")), F.col("seg")).otherwise(F.coalesce("name", F.lit(WILD)))
        names = names.select(*node, "seg", F.concat("prefix", F.lit("/"), step).alias("next"))
        leaves = written(open_.join(names, [*node, "seg"]).withColumns({"prefix": F.col("next"), "rest": _behind("rest", F.lit(1))}).select(*columns), f"url-level-{turn}")
        turn += 1
    leaves = done[0] if done else leaves
    for more in done[1:]:
        leaves = leaves.union(more)
    templates = leaves.groupBy("host", F.col("prefix").alias("template")).agg(*sums)
    hosts = templates.groupBy("host").agg(F.sum("labelled").alias("host_labelled"), F.sum("bad").alias("host_bad"))
    total = templates.agg(F.sum("labelled"), F.sum("bad")).first()
    overall = (total[1] or 0) / total[0] if total[0] else 0.0
    host_share = (F.col("host_bad") + SMOOTHING * overall) / (F.col("host_labelled") + SMOOTHING)
    share = (F.col("bad") + SMOOTHING * host_share) / (F.col("labelled") + SMOOTHING)
    judged = templates.join(hosts, "host").withColumn("share", share).withColumn("reject", (F.col("share") >= REJECT_SHARE) & (F.col("labelled") >= REJECT_LABELS)).drop("host_labelled", "host_bad")
    return leaves.select("host", "segs", F.col("prefix").alias("template")).join(judged, ["host", "template"])


def judge_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]], *, key: str = "page_id", url: str = "url", label_key: str = "doc_id", label: str = "quality") -> DataFrame:
    """(key, host, path, rule, template, labelled, share, verdict), a row for each row of pages.

    The longest rule that fits decides; else a url is blocked if its template is rejected. labels give label 0 (bad) or 1 by key;
    null labels, and keys with labels that differ, are unknown. A null url, or one without ://, has an empty host and path, and is
    judged like others. Repeated pages give repeated rows. An empty table of pages gives an empty table; without labels, templates
    are never rejected. Other columns aren't read.
    """
    rows = pages.select(F.col(key).alias("k"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    known = labels.filter(F.col(label).isNotNull()).groupBy(F.col(label_key).alias("lk")).agg(F.min(label).alias("a"), F.max(label).alias("b")).filter("a = b").select("lk", (1 - F.col("a")).alias("label"))
    tree = written(template_tree(rows.join(known, F.col("k") == F.col("lk"), "left").select("host", "path", "label")), "url-templates")
    found = rows.withColumn("segs", typed_segments(F.col("path"))).join(tree.select("host", "segs", "template", "labelled", "share", "reject"), ["host", "segs"], "left")
    rule, decided = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(decided, F.when(F.col("reject"), "block").otherwise("allow"))
    return found.select(F.col("k").alias(key), "host", "path", rule.alias("rule"), "template", "labelled", F.round("share", 6).alias("share"), verdict.alias("verdict"))
