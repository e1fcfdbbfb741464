"""The rendered register as text files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.fixed_values import REGISTER_PREFACE, REGISTER_TITLE


def register_head(corpus: str, run_id: str, sections: DataFrame) -> DataFrame:
    count = sections.agg(F.count("*").cast("string").alias("n"))
    text = F.concat(
        F.lit(f"{REGISTER_TITLE}\n\nCorpus **{corpus}** · run `{run_id[:8]}` · "), "n",
        F.lit(f" obligations.\n\n{REGISTER_PREFACE}\n\n---\n"),
    )
    return count.select(F.lit("").alias("section_key"), F.lit("").alias("part"), text.alias("text"))


def register_rows(rendered: DataFrame, corpus: str, run_id: str) -> DataFrame:
    """Head and sections; in order of section_key and part they are the document."""
    head = register_head(corpus, run_id, rendered.filter(F.col("part") == ""))
    return head.unionByName(rendered.select(
        "section_key", "part",
        # A blank line after each section.
        F.when(F.col("text").endswith("*"), F.concat("text", F.lit("\n"))).otherwise(F.col("text")).alias("text"),
    ))


def write_register(rows: DataFrame, path: str) -> None:
    """Text files whose names sort in reading order; the sort is by range, not in one task.

    A section kept in parts has a line break between two parts of its list.
    """
    ordered = rows.repartitionByRange("section_key", "part").sortWithinPartitions("section_key", "part")
    ordered.select("text").write.mode("overwrite").text(path)
