"""Documents and their chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.fixed_values import MIME_OF_SUFFIX
from concordat.functions import text as T
from concordat.functions.vocabulary import lookup

# Running sums go block by block, so a text of n paragraphs costs about n * BLOCK steps.
BLOCK = 256


def document_id(corpus: Column | str, sha256: Column | str) -> Column:
    return F.sha2(F.concat_ws("\n", T.col(corpus), T.col(sha256)), 256)


def partition_readable(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """B1: (readable documents, a medium finding for each of the others).

    Needs uri and text; text is NULL or blank where nothing could be read.
    """
    supported = ", ".join(sorted(MIME_OF_SUFFIX))
    name, kind = T.basename("uri"), T.suffix("uri")
    problem = (
        F.when(~kind.isin(*MIME_OF_SUFFIX), F.concat(
            name, F.lit(": "), F.coalesce(T.none_if_empty(kind), F.lit("no extension")),
            F.lit(f" is not a supported format. Supported: {supported}.")))
        .when(F.coalesce(T.strip("text"), F.lit("")) == "",
              F.concat(name, F.lit(": no readable text found.")))
    )
    checked = documents.withColumn("_problem", problem)
    readable = checked.filter(F.col("_problem").isNull()).drop("_problem").withColumn(
        "mime", lookup(kind, MIME_OF_SUFFIX)
    )
    findings = checked.filter(F.col("_problem").isNotNull()).select(
        "uri", F.lit("medium").alias("severity"), F.lit("document").alias("target_kind"),
        F.concat(name, F.lit(" skipped: "), F.col("_problem")).alias("explanation"),
    )
    return readable, findings


def first_arrivals(new: DataFrame) -> DataFrame:
    """The first arrival of each (corpus, content): keys only, combined on the map side."""
    return new.groupBy("corpus", "sha256").agg(F.min("arrival").alias("arrival"))


def dedupe_documents(new: DataFrame, existing: DataFrame) -> DataFrame:
    """B2: new documents of unseen content, one per (corpus, content).

    `arrival` is a unique order number.  A popular content only costs its keys; the
    texts of the copies are never brought together.
    """
    fresh = first_arrivals(new).join(existing.select("corpus", "sha256"), ["corpus", "sha256"], "left_anti")
    return new.join(fresh.select("arrival"), "arrival", "left_semi").withColumn(
        "document_id", document_id("corpus", "sha256")
    )


def resolve_arrivals(new: DataFrame, existing: DataFrame) -> DataFrame:
    """B2: the document each arrival stands for and whether it was already there."""
    known = existing.select("corpus", "sha256", F.lit(True).alias("_known")).dropDuplicates(
        ["corpus", "sha256"]
    )
    first = first_arrivals(new).join(known, ["corpus", "sha256"], "left").withColumnRenamed(
        "arrival", "_first"
    )
    return new.join(first, ["corpus", "sha256"]).select(
        "corpus", "arrival", document_id("corpus", "sha256").alias("document_id"),
        F.when(F.col("_known"), "known").when(F.col("arrival") == F.col("_first"), "new")
        .otherwise("copy").alias("state"),
    )


# Inside a lambda only its own variables are used: the optimizer would inline a column of
# the row into the lambda and compute it again for every element.


def with_running_starts(rows: DataFrame, lengths: str, starts: str) -> DataFrame:
    """Exclusive running sums of an array column, without leaving the row."""
    zero = F.array(F.lit(0))
    add = lambda sums, n: F.array_append(sums, F.element_at(sums, -1) + n)
    cuts = F.sequence(F.lit(1), F.size(lengths), F.lit(BLOCK))
    blocks = F.zip_with(cuts, F.array_repeat(F.col(lengths), F.size(cuts)), lambda at, all_: F.slice(all_, at, F.lit(BLOCK)))
    return (
        rows.withColumn("_inner", F.transform(blocks, lambda block: F.aggregate(block, zero, add)))
        # Each block holds one sum more than entries; the last one is its total.
        .withColumn("_offsets", F.slice(F.aggregate(
            F.transform("_inner", lambda sums: F.element_at(sums, -1)), zero, add), F.lit(1), F.size("_inner")))
        .withColumn(starts, F.flatten(F.zip_with("_inner", "_offsets", lambda sums, offset: F.transform(
            F.slice(sums, F.lit(1), F.size(sums) - 1), lambda n: n + offset))))
        .drop("_inner", "_offsets")
    )


def with_chunks(documents: DataFrame) -> DataFrame:
    """Adds `chunks`: the paragraphs of `text` with their exact offsets, in order."""
    split = documents.withColumn("_piece", F.split("text", "\n\n")).withColumn(
        "_length", F.transform("_piece", lambda p: F.length(p) + 2))
    placed = with_running_starts(split, "_length", "_start")
    # What is trimmed on the left moves the start.
    left = F.zip_with("_piece", "_start", lambda piece, start: F.struct(
        F.ltrim(piece, F.lit(T.WHITESPACE)).alias("rest"), (start + F.length(piece)).alias("end")))
    trimmed = F.transform(left, lambda p: F.struct(
        F.rtrim(p["rest"], F.lit(T.WHITESPACE)).alias("text"), (p["end"] - F.length(p["rest"])).alias("char_start")))
    return placed.withColumn(
        "chunks", F.transform(F.filter(trimmed, lambda c: c["text"] != ""), lambda c, i: F.struct(
            i.alias("ordinal"), c["text"].alias("text"), c["char_start"].alias("char_start"),
            (c["char_start"] + F.length(c["text"])).alias("char_end")))
    ).drop("_piece", "_length", "_start")


def chunk_documents(documents: DataFrame) -> DataFrame:
    """One row per paragraph.  No shuffle: everything happens within the document's row."""
    return (
        with_chunks(documents.select("document_id", "text"))
        # The outer form: the plain one would add a filter that chunks every text twice.
        .select("document_id", F.explode_outer("chunks").alias("c"))
        .filter(F.col("c").isNotNull())
        .select("document_id", "c.*")
        .withColumn("chunk_id", F.concat_ws("#", F.col("document_id").cast("string"),
                                            F.col("ordinal").cast("string")))
    )


def joined_text(chunks: Column) -> Column:
    """Chunks (an array in order) joined by a blank line."""
    return F.array_join(F.transform(chunks, lambda c: c["text"]), "\n\n")


def text_at_offsets(chunks: Column) -> Column:
    """Chunks at their original offsets; the gaps are filled with newlines."""
    ends = F.concat(F.array(F.lit(0)), F.transform(chunks, lambda c: c["char_end"]))
    padded = F.zip_with(chunks, ends, lambda c, before: F.concat(
        F.repeat(F.lit("\n"), c["char_start"] - before), c["text"]))
    # There is one end more than chunks; its entry is NULL and not joined.
    return F.array_join(padded, "")


def chunks_of_documents(chunks: DataFrame) -> DataFrame:
    """One row per document with its chunks in order (as many as its text had)."""
    chunk = F.struct("ordinal", "text", "char_start", "char_end")
    return chunks.groupBy("document_id").agg(F.array_sort(F.collect_list(chunk)).alias("chunks"))


def document_text(chunks: DataFrame) -> DataFrame:
    """The text of each document, joined and at original offsets."""
    return chunks_of_documents(chunks).select(
        "document_id", joined_text(F.col("chunks")).alias("text"),
        text_at_offsets(F.col("chunks")).alias("text_at_offsets"),
    )
