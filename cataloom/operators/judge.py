"""Judging and explaining shortlists by calls to a model: one shortlist becomes one prompt, or a few of bounded size.

Replies are taken apart by id again. An id that its prompt didn't show is nobody's; a call that fails leaves its candidates without a
judgement, and then rerank keeps the order of retrieval.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import presence, strip, truncated
from ..schema import FALLBACK_ABOUT, UNKNOWN_COUNTRY
from ..sources.storage import stored
from .enrich import Client, called, explanation_rows, judge_scores

# What a card says where a record is silent, its bounds, and the reason without a reply.
NO_OVERVIEW, NO_CATEGORIES = "(no overview provided)", "none listed"
CARD_ABOUT, CARD_CATEGORIES, CARD_CAPABILITIES = 700, 6, 5
DEFAULT_QUERY = "semiconductor suppliers"
DEFAULT_REASON = "Matches query criteria based on supplier profile and industry capabilities."
#: Characters of the candidates in one prompt.
PROMPT_CHARS = 24_000


class StubJudge:
    """Scores a candidate by the share of the query's words in its card, and explains by the words they share."""

    def complete(self, prompt: str) -> str:
        words = lambda t: set(re.findall(r"[^\W_]+", t.lower()))
        query = words(re.search(r"Buyer query: (.*?)\n\n", prompt, re.S)[1])
        cards = [(int(m[1]), words(m[2])) for m in re.finditer(r"(?m)^(?:\[Rank \d+\] )?id=(-?\d+)\n((?:  .*\n?)*)", prompt)]
        if prompt.startswith("Explain"):
            return json.dumps({"explanations": [{"id": i, "reasoning": f"Shares {', '.join(sorted(query & w)) or 'nothing'}."} for i, w in cards]})
        return json.dumps({"results": [[i, round(len(query & w) / max(len(query), 1), 3)] for i, w in cards]})


def candidate_card(rank: Column | None = None) -> Column:
    """A candidate as a model reads it, from id, company_name, about, refined, hq_country, cat_l1_names and cat_l2_names; with its rank
    for explanations."""
    none = F.array().cast("array<string>")
    capabilities = F.array_join(F.slice(F.coalesce(F.col("refined")["capabilities"], none), 1, CARD_CAPABILITIES), ", ")
    names = F.when(F.size(F.coalesce("cat_l2_names", none)) > 0, F.col("cat_l2_names")).otherwise(F.coalesce("cat_l1_names", none))
    categories = F.array_join(F.slice(names, 1, CARD_CATEGORIES), ", ")
    text = F.coalesce(presence(F.col("refined")["summary"]), strip(F.col("about")))
    silent = (text == "") | (text == FALLBACK_ABOUT)
    about = F.when(silent & (capabilities != ""), F.concat(F.lit("Capabilities: "), capabilities)).when(silent, NO_OVERVIEW).otherwise(truncated(F.regexp_replace(text, r"\s+", " "), CARD_ABOUT, " ..."))
    head = F.concat(F.lit("id="), F.col("id").cast("string"))
    role = presence(F.col("refined")["value_chain_position"])
    return F.concat_ws(
        "\n",
        head if rank is None else F.concat(F.lit("[Rank "), rank.cast("string"), F.lit("] "), head),
        F.concat(F.lit("  company: "), F.coalesce("company_name", F.lit(""))),
        F.concat(F.lit("  role: "), role),
        F.concat(F.lit("  hq: "), F.coalesce(presence(F.col("hq_country")), F.lit(UNKNOWN_COUNTRY))),
        F.concat(F.lit("  categories: "), F.coalesce(F.nullif(categories, F.lit("")), F.lit(NO_CATEGORIES))),
        F.when((capabilities != "") & ~silent, F.concat(F.lit("  capabilities: "), capabilities)),
        F.concat(F.lit("  overview: "), about),
    )


def prompts(shortlist: DataFrame, queries: DataFrame, entities: DataFrame, task: str, *, chars: int = PROMPT_CHARS, ranked: bool = False) -> DataFrame:
    """(query_id, part, ids, prompt): the cards of each query's shortlist (query_id, id, rank), in order, in as many prompts as their size
    asks for. entities have the columns of candidate_card. A card is cut at half of chars, and a prompt has chars of cards at most."""
    half = max(1, chars // 2)
    cards = entities.join(shortlist.select("query_id", "id", "rank"), "id").select("query_id", "id", "rank", F.substring(candidate_card(F.col("rank") if ranked else None), 1, half).alias("card"))
    before = Window.partitionBy("query_id").orderBy("rank", "id").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("card") + 2
    dealt = cards.withColumn("part", F.floor(F.coalesce(F.sum(size).over(before), F.lit(0)) / half))
    listed = F.sort_array(F.collect_list(F.struct("rank", "id", "card")))
    parts = dealt.groupBy("query_id", "part").agg(listed.alias("c")).select("query_id", "part", F.col("c.id").alias("ids"), F.array_join(F.col("c.card"), "\n\n").alias("cards"))
    asked = queries.select("query_id", F.coalesce(F.nullif(strip(F.col("text")), F.lit("")), F.lit(DEFAULT_QUERY)).alias("text"))
    return parts.join(asked, "query_id").select("query_id", "part", "ids", F.concat(F.lit(f"{task}\n\nBuyer query: "), "text", F.lit("\n\n"), "cards").alias("prompt"))


def _replies(asked: DataFrame, client: Callable[[], Client], calls: dict) -> tuple[DataFrame, DataFrame]:
    """The replies (query_id, raw), query_id being a prompt's name; and what each prompt showed (name, asked, id). Replies are stored, so
    that plans over them don't call again."""
    named = asked.withColumn("cache_key", F.concat_ws(":", F.col("query_id").cast("string"), F.col("part").cast("string")))
    rows = called(named.select("cache_key", F.col("prompt").alias("input"), F.lit("direct").alias("route")), client, **calls)
    got = stored(rows.filter("status = 'ok'").select(F.col("cache_key").alias("query_id"), "raw"), "replies")
    shown = named.select(F.col("cache_key").alias("name"), F.col("query_id").alias("asked"), F.explode("ids").alias("shown"))
    return got, shown


def judgements(shortlist: DataFrame, queries: DataFrame, entities: DataFrame, client: Callable[[], Client] = StubJudge, *, chars: int = PROMPT_CHARS, **calls: int) -> DataFrame:
    """(query_id, id, judge) for rerank: the model's scores between 0 and 1 of candidates that it was shown."""
    replies, shown = _replies(prompts(shortlist, queries, entities, "Judge each candidate.", chars=chars), client, calls)
    scores = judge_scores(replies)
    return scores.join(shown, (F.col("query_id") == F.col("name")) & (F.col("id") == F.col("shown"))).select(F.col("asked").alias("query_id"), F.col("shown").alias("id"), "judge")


def reasons(shortlist: DataFrame, queries: DataFrame, entities: DataFrame, client: Callable[[], Client] = StubJudge, *, chars: int = PROMPT_CHARS, **calls: int) -> DataFrame:
    """The shortlist with a reason for each candidate's rank, DEFAULT_REASON where the model gives none."""
    replies, shown = _replies(prompts(shortlist, queries, entities, "Explain the rank of each candidate.", chars=chars, ranked=True), client, calls)
    said = explanation_rows(replies).groupBy("query_id", "id").agg(F.max(strip(F.col("reason"))).alias("reason"))
    known = said.join(shown, (F.col("query_id") == F.col("name")) & (F.col("id") == F.col("shown").cast("string"))).select(F.col("asked").alias("_q"), F.col("shown").alias("_i"), F.nullif("reason", F.lit("")).alias("reason"))
    out = shortlist.join(known, (shortlist["query_id"] == known["_q"]) & (shortlist["id"] == known["_i"]), "left").drop("_q", "_i")
    return out.withColumn("reason", F.coalesce("reason", F.lit(DEFAULT_REASON)))
