"""Run tables: Parquet by corpus and run (A2-A4).

One writer per corpus.  A run's rows are one partition, so repeating a run replaces
exactly its own rows and a lost attempt leaves nothing behind that counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordat.schemas import SCHEMAS

RUN = ["corpus", "run_id"]


def new_rows(rows: DataFrame, target: DataFrame, keys: list[str], order: str) -> DataFrame:
    """A4: the rows whose key is not in the target yet; of equal keys the first by `order`.

    Only keys and `order` (unique) are grouped; the rows themselves are picked by it.
    """
    first = rows.groupBy(*keys).agg(F.min(order).alias("_first"))
    unseen = first.join(target.select(*keys), keys, "left_anti").select(F.col("_first").alias(order))
    return rows.join(unseen, order, "left_semi")


@dataclass(frozen=True)
class Tables:
    """The tables below one folder that every executor can reach."""

    spark: SparkSession
    folder: str

    def path(self, name: str) -> str:
        return f"{self.folder.rstrip('/')}/{name}"

    def schema(self, name: str) -> T.StructType:
        return T._parse_datatype_string(SCHEMAS[name])

    def exists(self, name: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def read(self, name: str, corpus: str | None = None, run_id: str | None = None) -> DataFrame:
        """A2: a table with its fixed schema; corpus and run prune partitions."""
        schema = self.schema(name)
        if not self.exists(name):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(self.path(name))
        if corpus is not None:
            rows = rows.filter(F.col("corpus") == corpus)
        if run_id is not None:
            rows = rows.filter(F.col("run_id") == run_id)
        return rows

    def _shaped(self, rows: DataFrame, name: str) -> DataFrame:
        return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema(name)])

    def _partition(self, name: str, corpus: str, value: str, column: str = "run_id") -> str:
        escape = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        return f"{self.path(name)}/corpus={escape(corpus)}/{column}={escape(value)}"

    def write_run(self, rows: DataFrame, name: str, corpus: str, run_id: str) -> DataFrame:
        """A3: replace the partition of one run.

        Written to the partition's own folder: overwriting the table dynamically would
        leave the old rows in place when there are no new ones.
        """
        shaped = self._shaped(
            rows.withColumn("corpus", F.lit(corpus)).withColumn("run_id", F.lit(run_id)), name)
        shaped.drop(*RUN).write.mode("overwrite").parquet(self._partition(name, corpus, run_id))
        return self.read(name, corpus, run_id)

    def write_batch(self, rows: DataFrame, name: str, corpus: str, batch: str, by: str) -> DataFrame:
        """Store rows under a batch name of their own, by the values of one column; hot values are split."""
        shaped = self._shaped(rows.withColumn("corpus", F.lit(corpus)).withColumn("batch", F.lit(batch)), name)
        folder = self._partition(name, corpus, batch, "batch")
        shaped.drop("corpus", "batch").hint("rebalance", by).write.mode("overwrite").partitionBy(by).parquet(folder)
        return self.read(name, corpus).filter(F.col("batch") == batch)

    def append(self, rows: DataFrame, name: str, *by: str) -> None:
        """Append rows to the partitions named by some columns."""
        self._shaped(rows, name).write.mode("append").partitionBy(*by).parquet(self.path(name))

    def append_new(self, rows: DataFrame, name: str, keys: list[str], order: str, corpus: str) -> None:
        """A4: append the rows of a corpus whose key is new; only that corpus is read."""
        shaped = self._shaped(new_rows(rows, self.read(name, corpus), keys, order), name)
        shaped.write.mode("append").partitionBy("corpus").parquet(self.path(name))
