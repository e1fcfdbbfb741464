"""URL filter: rules first, then a character language-model ratio.

Two smoothed variable-order Markov models over the characters of host and path are learned,
one from accepted and one from rejected URLs.  The probability of a character mixes all
context lengths up to ``order``, each weighted by how often its context was seen against
how many different characters followed it (Witten-Bell).  Every labelled URL is counted.  A URL is judged by the difference of
its log-likelihoods divided by its length, against a threshold calibrated on labelled URLs
that the models have not seen.

Here the labels are the verdicts of the rules.  Null URLs, and those without ``://``, have an
empty host and path, fit no rule and are judged like any other text.  If either side has no
example, everything not covered by a rule is allowed.  Ties with the threshold are allowed.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.session import settle

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
START, END = "\x02", "\x03"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule as text, else null.  A rule is (verdict, host and path)."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is asked first
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


@dataclass
class CharModel:
    """Counts of characters after contexts of up to ``order`` characters, kept by places.

    A place is the CRC-32 of a string, without its higher bits; strings that share one share their sums.  So a model
    has one size, whatever the number of texts that are counted.
    """

    order: int
    counts: np.ndarray  # by place of context and character
    totals: np.ndarray  # by place of context
    kinds: np.ndarray  # different characters, by place of context

    def __post_init__(self):
        self.memo: dict[tuple[str, str], float] = {}

    def chance(self, context: str, char: str) -> float:
        known = self.memo.get((context, char))
        if known is None:
            last = len(self.totals) - 1
            place = zlib.crc32(context.encode()) & last
            total = float(self.totals[place])
            shorter = self.chance(context[1:], char) if context else 1 / 65536
            if total:
                kinds = float(self.kinds[place])
                seen = min(float(self.counts[zlib.crc32((context + char).encode()) & last]), total)
                shorter = (seen + kinds * shorter) / (total + kinds)
            if len(self.memo) > 500_000:
                self.memo.clear()
            known = self.memo[context, char] = shorter
        return known

    def log_likelihood(self, text: str) -> float:
        line = START + text + END
        return sum(math.log(self.chance(line[max(0, i - self.order) : i], line[i])) for i in range(1, len(line)))


@dataclass
class UrlModel:
    accepted: CharModel
    rejected: CharModel
    threshold: float

    def ratio(self, text: str) -> float:
        return (self.accepted.log_likelihood(text) - self.rejected.log_likelihood(text)) / (len(text) + 1)


def _grams(rows: DataFrame, order: int) -> DataFrame:
    """How often each character follows each context: accepted, calibrates, context, char, n.  Every text counts."""

    def of_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = Counter()
            for text, accepted, calibrates in zip(batch["text"], batch["accepted"], batch["calibrates"]):
                line = START + text + END
                found.update((accepted, calibrates, line[i - n : i], line[i]) for i in range(1, len(line)) for n in range(min(order, i) + 1))
            yield pd.DataFrame([(*gram, n) for gram, n in found.items()], columns=["accepted", "calibrates", "context", "char", "n"])

    schema = "accepted boolean, calibrates boolean, context string, char string, n long"
    return rows.mapInPandas(of_batch, schema).groupBy("accepted", "calibrates", "context", "char").agg(F.sum("n").alias("n"))


def _models(grams: DataFrame, order: int, places: int) -> dict[bool, CharModel]:
    """The model of each side; at most ``places`` sums of each kind come to the driver."""
    place = lambda *parts: F.crc32(F.concat(*parts)).bitwiseAND(F.lit(places - 1)).alias("place")
    once = grams.groupBy("accepted", "context", "char").agg(F.sum("n").alias("n"))
    of_pairs = once.groupBy("accepted", place("context", "char")).agg(F.sum("n").alias("n")).toPandas()
    of_contexts = once.groupBy("accepted", place("context")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).toPandas()

    def sums(rows: pd.DataFrame, side: bool, name: str) -> np.ndarray:
        own, made = rows[rows["accepted"] == side], np.zeros(places, np.float32)
        made[own["place"].to_numpy(np.int64)] = own[name].to_numpy(np.float32)
        return made

    return {side: CharModel(order, sums(of_pairs, side, "n"), sums(of_contexts, side, "n"), sums(of_contexts, side, "kinds"))
            for side in (True, False)}


def _ratio(spark: SparkSession, model: UrlModel | None):
    """The model's ratio as a column function; null stays null."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def ratio(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for texts in parts:
            yield texts.map(lambda t: None if t is None or model is None else model.ratio(t)).astype("float64")

    return ratio


STEPS = 4096  # of a threshold, to one


def _threshold(counted: list[tuple[int, int, int]]) -> float:
    """The point with the fewest balanced errors, from (step, accepted, rejected) in order of the steps."""
    good, bad = sum(a for _, a, _ in counted), sum(r for _, _, r in counted)
    if not good or not bad:
        return 0.0
    lost, kept, best = 0, bad, (float("inf"), 0.0, 0.0)
    for i, (step, accepted, rejected) in enumerate(counted):  # below the threshold: rejected
        between = (counted[i - 1][0] + 1 + step) / 2 / STEPS if i else (step - 1) / STEPS
        best = min(best, (lost / good + kept / bad, abs(between), between))
        lost, kept = lost + accepted, kept - rejected
    return best[-1]


def fit(labelled: DataFrame, order: int = 5, places: int = 1 << 20) -> UrlModel | None:
    """Learn from (text, accepted): every different text of each side.

    A fifth of the texts, by hash, first calibrates the threshold on models of the others; then all are counted.
    """
    spark = labelled.sparkSession
    rows = labelled.where(F.col("accepted").isNotNull()).select("text", "accepted").distinct().withColumn(
        "calibrates", F.pmod(F.xxhash64("text"), F.lit(5)) == 0)
    if rows.select("accepted").distinct().count() < 2:
        return None
    grams = settle(_grams(rows, order), "grams")
    models = _models(grams.where(~F.col("calibrates")), order, places)
    ratio = _ratio(spark, UrlModel(models[True], models[False], 0.0))
    step = F.floor(ratio(F.col("text")) * STEPS).alias("step")
    counted = rows.where("calibrates").select(step, "accepted").groupBy("step").agg(
        F.count_if("accepted").alias("good"), F.count_if(~F.col("accepted")).alias("bad")).orderBy("step").collect()
    whole = _models(grams, order, places)
    return UrlModel(whole[True], whole[False], _threshold([(r["step"], r["good"], r["bad"]) for r in counted]))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], order: int = 5) -> DataFrame:
    """page_id, host, path, rule, verdict, ratio (null where a rule decides) of every row."""
    own = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    own = own.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    allowed = [r for v, r in rules if v == "allow"]
    text = F.concat("host", "path")
    model = fit(own.where(F.col("rule").isNotNull()).select(text.alias("text"), F.col("rule").isin(allowed).alias("accepted")), order)
    ratio = _ratio(pages.sparkSession, model)
    threshold = model.threshold if model else 0.0
    own = own.withColumn("ratio", ratio(F.when(F.col("rule").isNull(), text)))
    by_rule = F.when(F.col("rule").isin(allowed), "allow").otherwise("block")
    by_ratio = F.when(F.col("ratio") < threshold, "block").otherwise("allow")
    return own.withColumn("verdict", F.when(F.col("rule").isNotNull(), by_rule).otherwise(by_ratio)).select("page_id", "host", "path", "rule", "verdict", "ratio")
