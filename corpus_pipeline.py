"""From raw documents to training sequences: five stages, each one operator over all rows of the last.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the
shared folder and hands what it reads back to the next.  All stages but the last return the
columns of ``documents`` as they came, in their order.  Rows without a doc_id cannot be compared by
id: the stages for near duplicates and repeats keep them unchanged, and so does decontamination.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.llm import language_id
from concordat.llm.common import held_out, importable, tokenizer_file
from concordat.llm.decontamination import contamination
from concordat.llm.near_dedup import near_duplicate_classes
from concordat.llm.packing import pack
from concordat.llm.substring_dedup import remove_repeats
from concordat.session import settle


def _beside(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Documents with the columns of decisions beside them (as ``decided``), by doc_id; one row per row of docs."""
    once = decisions.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
    own = once.select(F.col("doc_id").alias("decided_id"), F.struct(*[F.col(c) for c in once.columns if c != "doc_id"]).alias("decided"))
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"))
    return whole.join(own, F.col("own_id") == F.col("decided_id"), "left")


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; null, wordless and far-off texts go."""
    importable(spark)
    model = language_id.fit(docs.select("doc_id", "text", "lang"), ~held_out(F.col("doc_id")))
    return language_id.keep_identified(docs, model)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest doc_id."""
    importable(spark)
    classes = near_duplicate_classes(docs.select("doc_id", "text"))
    gone = settle(classes.where(F.col("class_id") != F.col("doc_id")).select(F.col("doc_id").alias("gone_id")).distinct(), "gone")
    own = docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
    # rows that share a doc_id are one document: of them, one with the first text in order stays
    repeated = docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id")
    if repeated.isEmpty():
        return own
    texts = docs.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("first_text"))
    both = _beside(own, texts)
    chosen = both.where(F.col("decided").isNotNull() & F.col("row.text").eqNullSafe(F.col("decided.first_text"))).dropDuplicates(["own_id"])
    kept = both.where(F.col("decided").isNull()).unionByName(chosen)
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has; the rest of their words stay, joined by spaces.

    Documents that lose nothing keep their text as it is; n_chars follows the text.
    """
    importable(spark)
    changed = remove_repeats(docs.select("doc_id", "text")).where(F.col("n_removed") > 0).select("doc_id", "kept")
    both = _beside(docs, changed)
    text = F.coalesce("decided.kept", "row.text")
    made = {"text": text}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(F.col("decided").isNull(), F.col("row.n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)
    return both.select(*[(made[c] if c in made else F.col("row")[c]).alias(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = contamination(docs.select("doc_id", "text"), benchmark, near=None)  # proximity matches decide nothing here
    gone = found.where("contaminated").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of powers of two of tokens, at most 2048."""
    importable(spark)
    return pack(docs.select("doc_id", "text"), tokenizer_file("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_known_languages),
    ("near_dedup", keep_one_of_near_duplicates),
    ("substring_dedup", remove_repeated_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack_documents),
]

#: SQL cannot express signatures, centroids and the tokenizer; tests/llm compares with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
