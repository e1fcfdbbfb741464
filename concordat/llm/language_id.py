"""Language identification by nearest centroid.

A text is a TF-IDF vector of hashed byte n-grams of its lower-cased letters, of length 1.
Every language has a few centroids, clustered from a bounded sample of labelled texts by
spherical k-means.  A text gets the language of the centroid with the highest cosine; texts
too far from it are marked as rejected.

Texts without a letter, and nulls, are ``und`` with score 0 and rejected, as is everything
if there is nothing to learn from.  Equal cosines go to the language that sorts first.
Only doc_id, text and (for learning) lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concordat.llm.common import text_blocks

UNKNOWN = "und"
#: Number of hashed n-gram features, a power of two.
WIDTH = 4096
#: Bytes that are no letters become spaces; bytes of letters beyond ASCII stay.
_LETTERS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


def term_counts(texts: list[str]) -> np.ndarray:
    """Hashed bigram and trigram counts, one row per text."""
    rows = [b" " + b" ".join(t.lower().encode("utf-8", "replace").translate(_LETTERS).split()) + b" " for t in texts]
    sizes = np.array([len(r) for r in rows])
    data = np.frombuffer(b"".join(rows), np.uint8).astype(np.uint32)
    base = np.repeat(np.arange(len(rows), dtype=np.int64) * WIDTH, sizes)
    counts = np.zeros(len(rows) * WIDTH, np.float32)
    shift = 32 - WIDTH.bit_length() + 1
    for n, factor in ((2, 2654435761), (3, 2246822519)):
        if len(data) < n:
            continue
        code = data[: len(data) - n + 1].copy()
        for k in range(1, n):
            code = code * np.uint32(256) + data[k : len(data) - n + 1 + k]
        slot = ((code * np.uint32(factor)) >> np.uint32(shift)).astype(np.int64)
        within = base[: len(slot)] == base[n - 1 :]
        counts += np.bincount((base[: len(slot)] + slot)[within], minlength=len(counts)).astype(np.float32)
    return counts.reshape(len(rows), WIDTH)


def unit_vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    vectors = np.log1p(counts) * idf
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def clusters(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from far-apart starts; deterministic for a given order of rows."""
    centre = vectors.mean(axis=0)
    chosen = [int(np.argmax(vectors @ centre))]
    while len(chosen) < min(k, len(vectors)):
        chosen.append(int(np.argmin((vectors @ vectors[chosen].T).max(axis=1))))
    centres = vectors[chosen]
    for _ in range(rounds):
        nearest = np.argmax(vectors @ centres.T, axis=1)
        sums = np.stack([vectors[nearest == c].sum(axis=0) if (nearest == c).any() else centres[c] for c in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


@dataclass
class Centroids:
    languages: list[str]  # one entry per centroid
    centres: np.ndarray
    idf: np.ndarray
    least: np.ndarray  # per centroid: texts with a lower cosine, for their fullness, are rejected


def fullness(counts: np.ndarray) -> np.ndarray:
    """How near a text is to showing its language: short texts have few n-grams and lower cosines."""
    return np.sqrt(np.minimum(1.0, (counts > 0).sum(axis=1) / 200))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def fit(documents: DataFrame, learn: Column, per_language: int = 400, k: int = 3, slack: float = 0.3) -> Centroids:
    """Learn centroids from at most ``per_language`` texts of each language where ``learn`` holds.

    The texts are those with the lowest hashes of their ids.  A text is rejected later if its
    cosine, in proportion to its fullness, is below ``slack`` times the lowest of the sampled texts
    of that language.
    What reaches the driver is k vectors per language.
    """
    rows = documents.where(learn & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    key = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Centroids([], np.zeros((0, WIDTH), np.float32), np.ones(WIDTH, np.float32), np.zeros(0))
    share = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, int((1 << 30) * min(1.0, 1.5 * per_language / n + 60 / n)))])
    picked = rows.where(key < share[F.col("lang")])
    first = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    ids = picked.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= per_language)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "text"):
            texts = block.column("text").to_pylist()
            keep = [i for i, t in enumerate(texts) if has_letter(t)]
            if keep:
                counts = term_counts([texts[i] for i in keep])
                yield pa.RecordBatch.from_pydict({
                    "lang": block.column("lang").take(pa.array(keep)), "nth": block.column("nth").take(pa.array(keep)),
                    "slots": pa.array([np.flatnonzero(c).astype(np.int32) for c in counts], pa.list_(pa.int32())),
                    "counts": pa.array([c[c > 0] for c in counts], pa.list_(pa.float32()))})

    sparse = ids.select("lang", "nth", "text").mapInArrow(count, "lang string, nth int, slots array<int>, counts array<float>").persist()
    found = sparse.select(F.explode("slots").alias("slot")).groupBy("slot").count().collect()
    n_sampled = sparse.count()
    idf = np.full(WIDTH, np.log(1 + n_sampled), np.float32)
    for r in found:
        idf[r["slot"]] = np.log(1 + n_sampled / r["count"])

    def centres(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("nth")
        counts = np.zeros((len(group), WIDTH), np.float32)
        for row, (slots, values) in enumerate(zip(group["slots"], group["counts"])):
            counts[row, slots] = values
        vectors = unit_vectors(counts, idf)
        made = clusters(vectors, k)
        cosines = vectors @ made.T
        nearest = cosines.argmax(axis=1)
        return pd.DataFrame({"lang": group["lang"].iloc[0], "centre": [c for c in made], "least": float((cosines.max(axis=1) / fullness(counts)).min() * slack),
                             "nth": range(len(made)), "members": [int((nearest == c).sum()) for c in range(len(made))]})

    made = sparse.groupBy("lang").applyInPandas(centres, "lang string, centre array<float>, least double, nth int, members int").collect()
    sparse.unpersist()
    made = sorted(made, key=lambda r: (r["lang"], r["nth"]))
    return Centroids([r["lang"] for r in made], np.array([r["centre"] for r in made], np.float32).reshape(-1, WIDTH), idf,
                     np.array([r["least"] for r in made]))


def judge(texts: list[str | None], model: Centroids) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and rejection of each text."""
    known = [i for i, t in enumerate(texts) if model.languages and has_letter(t)]
    names, scores, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    for start in range(0, len(known), 512):
        part = known[start : start + 512]
        counts = term_counts([texts[i] for i in part])
        cosines = unit_vectors(counts, model.idf) @ model.centres.T
        for i, best, row, full in zip(part, cosines.argmax(axis=1), cosines, fullness(counts)):
            names[i], scores[i] = model.languages[best], min(1.0, max(0.0, float(row[best])))
            rejected[i] = row[best] < model.least[best] * full
    return names, scores, rejected


def identify(documents: DataFrame, model: Centroids) -> DataFrame:
    """doc_id, lang_pred, score (the cosine, 0 to 1), rejected."""
    id_type = documents.schema["doc_id"].dataType.simpleString()
    shared = documents.sparkSession.sparkContext.broadcast(model)  # k vectors per language

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "text"):
            names, scores, rejected = judge(block.column("text").to_pylist(), shared.value)
            yield pa.RecordBatch.from_pydict({"doc_id": block.column("doc_id"), "lang_pred": pa.array(names, pa.string()),
                                              "score": pa.array(scores), "rejected": pa.array(rejected)})

    return documents.select("doc_id", "text").mapInArrow(predict, f"doc_id {id_type}, lang_pred string, score double, rejected boolean")


def keep_identified(documents: DataFrame, model: Centroids) -> DataFrame:
    """The rows, with all their columns, whose text is not rejected."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "text"):
            yield block.filter(pa.array(~judge(block.column("text").to_pylist(), shared.value)[2]))

    return documents.mapInArrow(keep, documents.schema)
