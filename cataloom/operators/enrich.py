"""Model calls as batch steps: routed prompts, a content-addressed cache, bounded concurrency and tolerant parsing.

A client is any object with complete(prompt) -> str; without one a deterministic stub answers, so that plans run offline.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cache_key, cleaned_overview, digest, presence, strip, truncated, without_fences
from ..schema import ABOUT_BUDGET, FALLBACK_ABOUT, MAX_CATEGORY_NAMES, REFINED, SNIPPET_BUDGET, SPARSE_ABOUT_CHARS, UNKNOWN_COUNTRY, WEBSITE_BUDGET
from ..sources.answers import AnswerLog
from .numbering import numbered
from .pace import Bucket, Paced, quotas


class Client(Protocol):
    def complete(self, prompt: str) -> str: ...


class Stub:
    """Answers with a refined block made of the prompt's own words."""

    def complete(self, prompt: str) -> str:
        words = prompt.split()
        return json.dumps({"value_chain_position": "Other", "semiconductor_relevance": "None -- offline", "summary": " ".join(words[:24]), "capabilities": words[24:27], "technical_expertise": [], "end_markets": [], "regional_presence": {}})


def text_chunk() -> Column:
    """What is indexed of an entity: name, description, segment, capabilities, expertise, headquarters and categories.

    Reads company_name, about, refined, hq_location, hq_country, cat_l1_names and cat_l2_names.
    """
    about, refined = strip(F.col("about")), F.col("refined")
    real = (about != "") & (about != FALLBACK_ABOUT)
    summary = strip(refined["summary"])
    none = F.array().cast("array<string>")
    listed = lambda label, c, n: F.when(F.size(F.coalesce(c, none)) > 0, F.concat(F.lit(label), F.array_join(F.slice(c, 1, n), "; ")))
    hq = F.coalesce(presence(F.col("hq_location")), presence(F.col("hq_country")))
    categories = F.array_distinct(F.concat(F.coalesce("cat_l1_names", none), F.coalesce("cat_l2_names", none)))
    return F.concat_ws(
        " | ",
        F.nullif(F.coalesce("company_name", F.lit("")), F.lit("")),
        F.when(summary != "", F.concat(F.lit("About: "), summary)).when(real, F.concat(F.lit("About: "), cleaned_overview(about)["cleaned"])),
        F.when((F.coalesce(refined["value_chain_position"], F.lit("")) != "") & (refined["value_chain_position"] != "Other"), F.concat(F.lit("Segment: "), refined["value_chain_position"])),
        listed("Capabilities: ", refined["capabilities"], 6),
        listed("Expertise: ", refined["technical_expertise"], 4),
        F.when(hq != UNKNOWN_COUNTRY, F.concat(F.lit("HQ: "), hq)),
        listed("Categories: ", categories, 1_000_000),
        F.when((summary == "") & ~real & (about != ""), about),
    )


def routed(df: DataFrame) -> DataFrame:
    """Adds input, route and content_hash: a long description goes alone (rich), a short one with the website (sparse, two stages)."""
    about = F.when(F.col("about") == FALLBACK_ABOUT, "").otherwise(strip(F.col("about")))
    rich = F.length(about) >= SPARSE_ABOUT_CHARS
    site = F.when(rich, "").otherwise(strip(F.col("website_scrape")))
    names = F.array_join(F.slice(F.array_distinct(F.concat("cat_l1_names", "cat_l2_names")), 1, MAX_CATEGORY_NAMES), ", ")
    parts = [truncated(about, ABOUT_BUDGET), truncated(site, WEBSITE_BUDGET), truncated(F.col("snippet"), SNIPPET_BUDGET), names]
    text = F.concat_ws("\n", F.concat(F.lit("Company: "), F.col("company_name")), *(F.when(p != "", F.concat(F.lit(f"{label}: "), p)) for label, p in zip(("About", "Website", "Snippet", "Categories"), parts, strict=True)))
    empty = (parts[0] == "") & (parts[1] == "") & (parts[2] == "")
    route = F.when(empty, "empty-input").when(rich, "single").when(parts[1] != "", "two-stage").otherwise("single")
    h = digest(*parts)
    return df.withColumns({"input": text, "route": route, "content_hash": h, "cache_key": cache_key(F.col("company_name"), h)})


def misses(df: DataFrame, cache: DataFrame, statuses: tuple[str, ...] = ("ok", "empty-input")) -> DataFrame:
    """Rows whose key the cache lacks, or holds with another status."""
    return df.join(cache.filter(F.col("status").isin(*statuses)).select("cache_key").distinct(), "cache_key", "left_anti")


def called(df: DataFrame, client: Callable[[], Client] = Stub, *, concurrency: int = 5, tries: int = 4, wait: float = 2.0, per_minute: int | None = None) -> DataFrame:
    """(cache_key, raw, status) for rows with input and route, at most concurrency calls at a time.

    A failing call is repeated with growing waits; its last error is the status. Rows without input aren't sent, and those of route
    direct as they are. With per_minute no
    minute has more calls, repeated ones and both stages included: each task has its share of them, see pace.
    """
    shares = quotas(per_minute, concurrency) if per_minute else None
    concurrency = len(shares) if shares else concurrency

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = client()
        if shares:
            part = TaskContext.get().partitionId()
            model = Paced(model, Bucket(shares[part], place=part / len(shares)))

        def ask(prompt: str) -> tuple[str | None, str]:
            for i in range(tries):
                try:
                    return model.complete(prompt), "ok"
                except ConnectionError:
                    status = "network-error"
                except Exception as e:  # noqa: BLE001  a client may raise anything
                    status = f"api-error-{type(e).__name__}"
                if i + 1 < tries:
                    time.sleep(wait**i)
            return None, status

        for f in frames:
            rows = []
            for key, text, route in zip(f["cache_key"], f["input"], f["route"], strict=True):
                if route == "empty-input":
                    rows.append((key, None, route))
                    continue
                status = "ok"
                if route == "two-stage":
                    text, status = ask(f"Summarise.\n{text}")
                    if status != "ok":
                        rows.append((key, None, f"summarise-failed:{status}"))
                        continue
                raw, status = ask(text if route == "direct" else f"Refine.\n{text}")
                rows.append((key, raw, status))
            yield pd.DataFrame(rows, columns=["cache_key", "raw", "status"])

    return df.select("cache_key", "input", "route").repartition(concurrency, "cache_key").mapInPandas(run, "cache_key string, raw string, status string")


def json_object(raw: Column) -> Column:
    """The object in a reply: without fences, or else from the first { to the last }."""
    text = without_fences(raw)
    return F.coalesce(F.when(text.startswith("{"), F.try_parse_json(text)), F.try_parse_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1)))


def coerced(raw: Column) -> Column:
    """A reply as a refined block: missing fields empty, single values as lists, anything but an object as no regions; null if
    the reply holds no object."""
    v = json_object(raw)
    text = lambda p: F.coalesce(F.try_variant_get(v, p, "string"), F.lit(""))

    def strings(p: str) -> Column:
        many = F.try_variant_get(v, p, "array<string>")
        one = F.try_variant_get(v, p, "string")
        listed = F.coalesce(one, F.lit("")).startswith("[")
        return F.coalesce(F.filter(many, lambda x: x.isNotNull()), F.when((F.coalesce(one, F.lit("")) != "") & ~listed, F.array(one)), F.array().cast("array<string>"))

    block = F.struct(
        text("$.value_chain_position").alias("value_chain_position"), text("$.semiconductor_relevance").alias("semiconductor_relevance"), text("$.summary").alias("summary"),
        strings("$.capabilities").alias("capabilities"), strings("$.technical_expertise").alias("technical_expertise"), strings("$.end_markets").alias("end_markets"),
        F.coalesce(F.try_variant_get(v, "$.regional_presence", "map<string,string>"), F.create_map().cast("map<string,string>")).alias("regional_presence"),
    )
    return F.when(v.isNotNull() & (F.schema_of_variant(v).startswith("OBJECT")), block.cast(REFINED))


def refined_with_log(df: DataFrame, log: AnswerLog, client: Callable[[], Client] = Stub, *, repair: DataFrame | None = None, round_keys: int = 1000, **calls: int) -> DataFrame:
    """refined, from a log of answers that it adds to: what the log has isn't asked for again, by this plan or a later one.

    Keys are asked for in rounds of round_keys, and a round's answers are committed before the next begins, so a run that is killed
    loses one round at most. repair (cache_key) names answers to ask for again, once, whatever their status; only these get a further
    attempt, and the last good one counts.
    """
    rows = routed(df)
    todo = misses(rows, log.read())
    if repair is not None:
        todo = todo.unionByName(rows.join(log.repaired(repair), "cache_key", "left_semi"))
    todo = numbered(todo.select("cache_key", "input", "route").dropDuplicates(["cache_key"]), "cache_key", name="_place")
    n = todo.count()
    for start in range(0, n, round_keys):
        log.append(called(todo.filter(F.col("_place").between(start, start + round_keys - 1)), client, **calls))
    return _with_answers(rows, log.read().select("cache_key", "raw", "status"))


def refined(df: DataFrame, cache: DataFrame | None = None, client: Callable[[], Client] = Stub, **calls: int) -> DataFrame:
    """Adds refined and refine_status to entities: from the cache (cache_key, raw, status) where it has them, else by the client."""
    rows = routed(df)
    todo = rows if cache is None else misses(rows, cache)
    answers = called(todo.dropDuplicates(["cache_key"]), client, **calls)
    if cache is not None:
        answers = answers.unionByName(cache.filter(F.col("status").isin("ok", "empty-input")).select("cache_key", "raw", "status"))
    return _with_answers(rows, answers)


def _with_answers(rows: DataFrame, answers: DataFrame) -> DataFrame:
    parsed = answers.select("cache_key", coerced(F.col("raw")).alias("refined"), "status")
    parsed = parsed.withColumn("refine_status", F.when((F.col("status") == "ok") & F.col("refined").isNull(), "parse-error").otherwise(F.col("status"))).drop("status")
    return rows.join(parsed, "cache_key", "left").drop("input", "route", "content_hash", "cache_key")


def judge_scores(replies: DataFrame) -> DataFrame:
    """(query_id, id, judge) from replies (query_id, raw): lists [[id, score], ...] or [{id, relevance_score}, ...], alone or as results.

    Scores are kept between 0 and 1; rows without number are skipped; of an id's scores the last wins.
    """
    v = F.coalesce(F.try_parse_json(without_fences(F.col("raw"))), F.try_parse_json(F.regexp_extract("raw", r"(?s)([\[{].*[\]}])", 1)))
    rows = F.coalesce(F.try_variant_get(v, "$.results", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"))
    each = replies.select("query_id", F.posexplode(rows).alias("pos", "r"))
    ident = F.coalesce(F.try_variant_get("r", "$[0]", "bigint"), F.try_variant_get("r", "$.id", "bigint"))
    score = F.coalesce(F.try_variant_get("r", "$[1]", "double"), F.try_variant_get("r", "$.relevance_score", "double"))
    found = each.select("query_id", "pos", ident.alias("id"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("judge")).filter("id IS NOT NULL AND judge IS NOT NULL")
    return found.groupBy("query_id", "id").agg(F.max_by("judge", "pos").alias("judge"))


def explanation_rows(replies: DataFrame) -> DataFrame:
    """(query_id, id, reason) from replies: objects {id: text}, alone or as explanations, results or candidates, or lists of {id, reason}."""
    v = F.try_parse_json(without_fences(F.col("raw")))
    inner = F.coalesce(*(F.try_variant_get(v, f"$.{k}", "variant") for k in ("explanations", "results", "candidates")), v)
    base = replies.select("query_id", inner.alias("v"))
    flat = base.select("query_id", F.explode(F.try_variant_get("v", "$", "map<string,string>")).alias("id", "reason"))
    each = base.select("query_id", F.explode(F.try_variant_get("v", "$", "array<variant>")).alias("r"))
    listed = each.select("query_id", F.try_variant_get("r", "$.id", "string").alias("id"), F.coalesce(*(F.try_variant_get("r", f"$.{k}", "string") for k in ("reasoning", "reason", "explanation"))).alias("reason"))
    return flat.unionByName(listed).filter("id IS NOT NULL AND reason IS NOT NULL")


def candidate_prompt() -> Column:
    """A candidate as the judge reads it: id, name, description up to 700 characters, six categories, five capabilities."""
    return F.concat_ws(
        "\n",
        F.concat_ws(": ", F.lit("id"), F.col("id")),
        F.concat_ws(": ", F.lit("name"), F.col("company_name")),
        F.when(presence(F.col("about")).isNotNull(), F.concat(F.lit("about: "), truncated(F.col("about"), 700, " ..."))),
        F.when(F.size("cat_l2_names") > 0, F.concat(F.lit("categories: "), F.array_join(F.slice("cat_l2_names", 1, 6), ", "))),
        F.when(F.size(F.col("refined")["capabilities"]) > 0, F.concat(F.lit("capabilities: "), F.array_join(F.slice(F.col("refined")["capabilities"], 1, 5), ", "))),
    )


def overlaid(catalogue: DataFrame, overlay: DataFrame) -> DataFrame:
    """Local corrections (company_name, hq_location, website, _seq) by lower-case name, the last of a name, or else by id where overlay
    has one. A headquarters counts even if null, and so does hq_country where overlay has it; a website only if it isn't empty, and
    refined, where overlay has it, only for entities without one of their own."""
    fields = [c for c in ("hq_location", "website", "hq_country", "refined") if c in overlay.columns]
    k = F.lower(strip(F.col("company_name")))
    last = F.max_by(F.struct(*fields), "_seq")
    named = overlay.filter(presence(F.col("company_name")).isNotNull()).groupBy(k.alias("_ok")).agg(last.alias("_o"))
    out = catalogue.join(named, F.lower(strip(catalogue["company_name"])) == F.col("_ok"), "left")
    if "id" in overlay.columns:
        numbered_ = overlay.filter("id IS NOT NULL").groupBy(F.col("id").alias("_oid")).agg(last.alias("_oi"))
        out = out.join(numbered_, out["id"] == F.col("_oid"), "left").withColumn("_o", F.coalesce("_o", "_oi")).drop("_oid", "_oi")
    hit = F.col("_o").isNotNull()
    new = {"hq_location": F.when(hit, F.col("_o.hq_location")).otherwise(F.col("hq_location")), "website": F.coalesce(F.nullif(F.col("_o.website"), F.lit("")), F.col("website"))}
    if "hq_country" in fields:
        new["hq_country"] = F.when(hit, F.col("_o.hq_country")).otherwise(F.col("hq_country"))
    if "refined" in fields:
        new["refined"] = F.coalesce("refined", "_o.refined") if "refined" in catalogue.columns else F.col("_o.refined")
    return out.withColumns(new).drop("_ok", "_o")


def shaped(found: DataFrame) -> DataFrame:
    """Rows of a search as they are shown: score in four digits, and the score before in six as retrieval_score."""
    return found.withColumns({"retrieval_score": F.round("score", 6), "score": F.round("score", 4)})


def synthesised_about(refined: Column, booth: Column) -> Column:
    """A description made of a refined block's fields, without other and none or low relevance."""
    relevance = F.lower(F.coalesce(refined["semiconductor_relevance"], F.lit("")))
    listed = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{label}: "), F.array_join(c, ", "), F.lit(".")))
    return F.concat_ws(
        " ",
        F.nullif(strip(refined["summary"]), F.lit("")),
        F.when(F.coalesce(booth, F.lit("")) != "", F.concat(F.lit("Booth: "), booth, F.lit("."))),
        F.when(~F.lower(F.coalesce(refined["value_chain_position"], F.lit("other"))).isin("other", ""), F.concat(F.lit("Value Chain Role: "), refined["value_chain_position"], F.lit("."))),
        F.when(~relevance.rlike("^(none|low)") & (relevance != ""), F.concat(F.lit("Semiconductor Relevance: "), refined["semiconductor_relevance"], F.lit("."))),
        listed("Key Capabilities", refined["capabilities"]),
        listed("Technical Expertise", refined["technical_expertise"]),
        listed("End Markets", refined["end_markets"]),
    )
