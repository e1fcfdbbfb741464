"""Toxic passages by maximum-scoring segments.

Tokens get log-odds of toxic against other documents, with an informative Dirichlet prior:
every count is raised by the token's share of the prior mass, and a token counts only where its
log-odds stand clear of their standard error.  All other tokens cost a fixed drift, so a random
stretch scores below zero.  One linear pass finds all maximal scoring segments of a document.
Extreme-value statistics turn a segment score S into the number E = K n exp(-lambda S) of such
segments that chance would give in n tokens; lambda solves the moment equation of the scores
under clean text, K comes from the clean documents' own segments.  The evidence of the
significant segments is summed and a one-dimensional logistic fit maps it to a probability.

Null, empty and wordless texts have no segment and get the score of no evidence.
Labels meeting several rows of one id, or repeated rows, count each.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concordat.llm.common import text_blocks

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def tokens(text: str | None) -> list[bytes]:
    return _WORD.findall(text.lower().encode("utf-8", "replace")) if text else []


@dataclass
class ToxicModel:
    scores: dict[bytes, float] = field(default_factory=dict)
    drift: float = 1.0
    decay: float = 1.0  # lambda
    scale: float = 1.0  # K
    intercept: float = -4.0
    slope: float = 1.0


def segments(places: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a row of tokens.

    ``places`` lists the tokens that have a score of their own, in order; each token between
    them scores -drift.  Linear: every segment is pushed and merged at most once.
    """
    kept: list[tuple] = []  # first, last, sum before, sum up to its end, nearest earlier one with a lower sum before
    total, end = 0.0, 0
    for place, score in places:
        total -= drift * (place - end)
        end = place + 1
        before, total = total, total + score
        if score <= 0:
            continue
        first, high = place, total
        while True:
            at = len(kept) - 1
            while at >= 0 and kept[at][2] >= before:
                at = kept[at][4]
            if at < 0 or kept[at][3] >= high:
                break
            first, before = kept[at][0], kept[at][2]
            del kept[at:]
        kept.append((first, place, before, high, at))
    return [(a, b, hi - lo) for a, b, lo, hi, _ in kept]


def evidence(n: int, found: list[tuple[int, int, float]], model: ToxicModel) -> float:
    """Sum over segments of how far their expected chance count lies below one, in natural logarithms."""
    return sum(max(0.0, model.decay * s - math.log(max(model.scale * n, 1e-9))) for _, _, s in found)


def scan(words: list[bytes], model: ToxicModel) -> list[tuple[int, int, float]]:
    scores = model.scores
    return segments([(i, scores[w]) for i, w in enumerate(words) if w in scores], model.drift)


def labelled_sample(documents: DataFrame, labels: DataFrame, learn: Column, per_class: int) -> DataFrame:
    """(text, toxic) of at most ``per_class`` labelled documents of each class, those with the lowest hashes; each text once."""
    marks = labels.where(F.col("toxic").isNotNull()).select("doc_id", (F.col("toxic") == 1).cast("int").alias("toxic"))
    known = documents.where(learn).select("doc_id").join(marks, "doc_id").distinct()
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = F.lit(0.0)
    for toxic, n in sizes.items():
        share = F.when(F.col("toxic") == toxic, min(1.0, (1.2 * per_class + 60) / n)).otherwise(share)
    near = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    nth = F.row_number().over(W.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id"))
    picked = near.withColumn("nth", nth).where(F.col("nth") <= per_class).select("doc_id", "toxic")
    # two classes of per_class ids at most: small enough to send to every task
    return documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "toxic").distinct()


def fit(documents: DataFrame, labels: DataFrame, learn: Column, per_class: int = 10_000, prior_share: float = 0.1, least_z: float = 2.58,
        most_tokens: int = 50_000, drift: float = 1.0) -> ToxicModel:
    """Learn from a bounded sample of the labelled documents where ``learn`` holds.

    The prior holds ``prior_share`` of all counts.  A token counts once per text, so a text that repeats a word does not weigh more.  The model
    keeps at most ``most_tokens`` tokens, those with the clearest log-odds.
    """
    rows = labelled_sample(documents, labels, learn, per_class).persist()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "text"):
            sums: Counter = Counter()
            for text, toxic in zip(block.column("text").to_pylist(), block.column("toxic").to_pylist()):
                sums.update((w, toxic) for w in set(tokens(text)))
            if sums:
                yield pa.RecordBatch.from_pydict({"token": pa.array([w for w, _ in sums], pa.binary()), "toxic": pa.array([t for _, t in sums], pa.int32()),
                                                  "n": pa.array(list(sums.values()), pa.int64())})

    counted = rows.mapInArrow(count, "token binary, toxic int, n long").groupBy("token").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("y1"), F.sum(F.when(F.col("toxic") == 1, 0).otherwise(F.col("n"))).alias("y0")).persist()
    sizes = counted.agg(F.sum("y1").alias("n1"), F.sum("y0").alias("n0")).first()
    n1, n0 = float(sizes["n1"] or 0), float(sizes["n0"] or 0)
    if not n1 or not n0:
        return ToxicModel()
    prior = prior_share * (n1 + n0)
    alpha = (F.col("y1") + F.col("y0")) * F.lit(prior_share)
    odds = F.log((F.col("y1") + alpha) / (n1 + prior - F.col("y1") - alpha)) - F.log((F.col("y0") + alpha) / (n0 + prior - F.col("y0") - alpha))
    error = F.sqrt(1 / (F.col("y1") + alpha) + 1 / (F.col("y0") + alpha))
    best = (counted.withColumn("odds", odds).withColumn("z", F.col("odds") / error).withColumn("chance", (F.col("y0") + alpha) / (n0 + prior))
            .where(F.abs("z") >= least_z).orderBy(F.desc(F.abs("z")), "token").limit(most_tokens).select("token", "odds", "chance").collect())
    counted.unpersist()
    model = ToxicModel({bytes(r["token"]): max(-4.0, min(8.0, r["odds"])) - drift for r in best}, drift)
    _fit_decay(model, {bytes(r["token"]): r["chance"] for r in best})
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "text"):
            words = [tokens(t) for t in block.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"toxic": block.column("toxic"), "n": pa.array([len(w) for w in words], pa.int64()),
                                              "found": pa.array([[s for _, _, s in scan(w, shared.value)] for w in words], pa.list_(pa.float64()))})

    seen = rows.mapInArrow(measure, "toxic int, n long, found array<double>").collect()  # the sample is bounded
    rows.unpersist()
    _fit_scale(model, [(r["n"], r["found"]) for r in seen if r["toxic"] != 1])
    _fit_logistic(model, np.array([evidence(r["n"], [(0, 0, s) for s in r["found"]], model) for r in seen]), np.array([float(r["toxic"] == 1) for r in seen]))
    return model


def _fit_decay(model: ToxicModel, chance: dict[bytes, float]) -> None:
    """The positive root of sum p exp(lambda s) = 1 over clean text."""
    rest = max(0.0, 1 - sum(chance.values()))
    scores = np.array([*model.scores.values(), -model.drift])
    shares = np.array([*(chance[w] for w in model.scores), rest])
    if not (scores > 0).any():
        return
    low, high = 1e-6, 1.0
    while (shares * np.exp(high * scores)).sum() < 1 and high < 64:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if (shares * np.exp(middle * scores)).sum() < 1 else (low, middle)
    model.decay = high


def _fit_scale(model: ToxicModel, clean: list[tuple[int, list[float]]]) -> None:
    """K from the clean documents: observed segments above a level, against n exp(-lambda level)."""
    total = sum(n for n, _ in clean)
    found = [s for _, segs in clean for s in segs]
    level = float(np.quantile(found, 0.9)) if found else 0.0
    count = max(0.5, sum(s >= level for s in found))
    if total:
        model.scale = min(1.0, max(1e-6, count / total * math.exp(min(50.0, model.decay * level))))


def _fit_logistic(model: ToxicModel, x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> None:
    """Logistic fit of label on evidence.  Clean documents weigh three times as much as toxic ones, whatever the sample holds."""
    if not (0 < y.sum() < len(y)):
        return
    x = np.log1p(x)
    weight = np.where(y == 1, 0.25 / y.sum(), 0.75 / (len(y) - y.sum()))
    a, b = 0.0, 1.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        gradient = np.array([(weight * (p - y)).sum() + penalty * a, (weight * (p - y) * x).sum() + penalty * b])
        h = weight * p * (1 - p)
        hessian = np.array([[h.sum() + penalty, (h * x).sum()], [(h * x).sum(), (h * x * x).sum() + penalty]])
        a, b = np.array([a, b]) - np.linalg.solve(hessian, gradient)
    model.intercept, model.slope = float(a), float(max(b, 0.0))


def score_documents(documents: DataFrame, model: ToxicModel, threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted, and the passages: word positions (from 0), score, expected chance count."""
    id_type = documents.schema["doc_id"].dataType.simpleString()
    shared = documents.sparkSession.sparkContext.broadcast(model)
    passages = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("score", pa.float64()), ("chance", pa.float64())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for block in text_blocks(batches, "text"):
            scores, spans = [], []
            for text in block.column("text").to_pylist():
                words = tokens(text)
                found = scan(words, model)
                x = math.log1p(evidence(len(words), found, model))
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, model.intercept + model.slope * x)))))
                chances = [model.scale * len(words) * math.exp(-min(600.0, model.decay * s)) for _, _, s in found]
                spans.append([{"first_word": a, "last_word": b, "score": s, "chance": e} for (a, b, s), e in zip(found, chances) if e < 0.05])
            yield pa.RecordBatch.from_pydict({"doc_id": block.column("doc_id"), "score": pa.array(scores, pa.float64()),
                                              "predicted": pa.array([int(s >= threshold) for s in scores], pa.int32()), "passages": pa.array(spans, passages)})

    return documents.select("doc_id", "text").mapInArrow(
        score, f"doc_id {id_type}, score double, predicted int, passages array<struct<first_word: long, last_word: long, score: double, chance: double>>")
