"""Calls to an outside model, answered from a content-addressed cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions import text as T
from concordat.session import settle

CACHE = ("cache_key string, stage string, model string, prompt_version string, "
         "response_text string, tokens_in int, tokens_out int")


def request_key() -> Column:
    """SHA-256 of the request as canonical JSON; the prompt version is part of it."""
    return F.sha2(
        F.to_json(F.struct(
            T.content_text("input").alias("input"), F.col("model"),
            F.col("prompt_version"), F.col("stage"),
        )), 256,
    )


def _firsts(keyed: DataFrame, cache: DataFrame) -> DataFrame:
    """One row per key: the first request for it, and what the cache holds."""
    known = cache.withColumn("_cached", F.lit(True)).dropDuplicates(["cache_key"])
    return keyed.groupBy("cache_key").agg(F.min("request_id").alias("first_request_id")).join(
        known, "cache_key", "left")


def _hit() -> Column:
    return F.col("_cached").isNotNull() | (F.col("request_id") != F.col("first_request_id"))


def split_requests(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests with `hit`, distinct unanswered requests).

    `request_id` orders the requests: the first of an unseen key is the miss, the ones
    after it find the answer that one will have stored.
    """
    keyed = requests.withColumn("cache_key", request_key())
    firsts = _firsts(keyed, cache.select("cache_key"))
    marked = keyed.join(firsts, "cache_key").withColumn("hit", _hit()).drop("_cached", "first_request_id")
    missing = firsts.filter(F.col("_cached").isNull()).select(F.col("first_request_id").alias("request_id"))
    return marked, keyed.join(missing, "request_id", "left_semi")


def enrich_cached(
    requests: DataFrame, cache: DataFrame,
    answer: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
    store: Callable[[DataFrame], DataFrame],
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(responses, new cache rows, hits and misses by stage).

    `answer` maps batches of (cache_key, stage, model, prompt_version, input) to batches
    of CACHE rows.  It runs once per distinct unanswered request: `store` writes the new
    rows and returns them as written, so that nothing later asks again.
    """
    marked, missing = split_requests(requests, cache)
    fresh = store(
        missing.select("cache_key", "stage", "model", "prompt_version", "input").mapInPandas(answer, CACHE))
    # What is known per key comes together first; requests then meet it in a single join,
    # which may split a key that very many requests share.
    known = cache.select(*fresh.columns).unionByName(fresh)
    keyed = requests.withColumn("cache_key", request_key()).select("request_id", "cache_key", "stage")
    responses = keyed.join(
        known.dropDuplicates(["cache_key"]).select("cache_key", "response_text", "tokens_in", "tokens_out"),
        "cache_key", "left")
    return responses, fresh, hit_counts(marked)


PREFIX = 2  # hex digits of a key that name its partition in the stored cache


def key_prefix() -> Column:
    return F.left("cache_key", F.lit(PREFIX))


def keyed_requests(asked: DataFrame, by: str, stage: str, model: str, prompt_version: str) -> DataFrame:
    """(`by`, cache_key): one key per request; the rows that share `by` are one request (a bounded batch)."""
    columns = sorted(c for c in asked.columns if c != by)
    rows = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    request = asked.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(rows)), "\n").alias("input"))
    return request.withColumns({"model": F.lit(model), "prompt_version": F.lit(prompt_version), "stage": F.lit(stage)}).select(
        by, request_key().alias("cache_key"))


def ask_once(asked: DataFrame, keys: DataFrame, by: str, answer: Callable[[DataFrame], DataFrame],
             known: Callable[[list[str]], DataFrame], keep: Callable[[DataFrame], None],
             about: dict[str, str], at_once: int = 10_000) -> tuple[DataFrame, int, int]:
    """C1 in front of a responder: ((`by`, response_text) for every request, requests, calls made).

    ``known(prefixes)`` reads the stored answers of some key prefixes, ``keep`` appends answers, and
    ``about`` holds their fixed columns.  Keys the store has are never asked.  The others are asked in rounds of about
    ``at_once``, each appended before the next begins: what breaks off loses one round at most, and
    a retried task or a replayed batch finds the keys of the rounds that were kept.  Requests
    without an answer (NULL) are not kept and will be asked again.
    """
    firsts = keys.groupBy("cache_key").agg(F.min(by).alias(by))
    prefixes = [r[0] for r in keys.select(key_prefix()).distinct().collect()]  # 16 ** PREFIX at most
    missing = settle(firsts.join(known(prefixes).select("cache_key"), "cache_key", "left_anti"), "missing")
    calls = missing.count()
    rounds = -(-calls // at_once)
    for i in range(rounds):
        part = missing.filter(F.pmod(F.crc32("cache_key"), F.lit(rounds)) == i)
        given = answer(asked.join(part.select(by), by, "left_semi")).join(part, by)
        tokens = [(F.col(c) if c in given.columns else F.lit(None)).cast("int").alias(c) for c in ("tokens_in", "tokens_out")]
        keep(given.filter(F.col("response_text").isNotNull()).select(
            "cache_key", *[F.lit(v).alias(n) for n, v in about.items()], "response_text", *tokens))
    stored = known(prefixes).select("cache_key", "response_text").dropDuplicates(["cache_key"])
    return keys.join(stored, "cache_key", "left").select(by, "response_text"), keys.count(), calls


def hit_counts(marked: DataFrame) -> DataFrame:
    return marked.groupBy("stage").agg(
        F.count_if("hit").alias("cache_hits"), F.count_if(~F.col("hit")).alias("cache_misses")
    )
