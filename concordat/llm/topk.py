"""Exact top-k inner products by no-random-access aggregation.

Vectors are spread over blocks.  A block keeps one list per dimension, sorted by component, and
a query reads all lists from the end that suits the sign of its own component, a stretch of every
list at a time.  What it has read of a vector gives a lower bound of the score (unread
components count as bad as they can be) and an upper bound (as good as the place its lists have
been read to).  A vector whose upper bound lies below the k-th best lower bound is out for
good; so are all unread vectors once the sum of the lists' places does.  A query starts with a
lower bound from a bounded sample of the candidates, so that every block knows about how good
the best of all blocks are.  Reading stops when no outsider can qualify or when few vectors are
left; their final scores are then summed, and ties go to the smaller id.  Each block gives its k best for a query, and the best of those are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component as a whole number."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vector: Column) -> Column:
    """Vectors with components, none of them null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


class SortedLists:
    """A block of whole-number vectors with a list per dimension, ascending by component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        up = np.ascontiguousarray(np.argsort(self.vectors, axis=0, kind="stable").T)
        values = np.take_along_axis(np.ascontiguousarray(self.vectors.T), up, axis=1).astype(float)
        # [0]: from the low end, for negative query components; [1]: from the high end
        self.lists = np.stack((up, up[:, ::-1]))
        self.values = np.stack((values, values[:, ::-1]))

    def top(self, query: np.ndarray, own: int, k: int, few: int = 768, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best vectors but the query's own; those that cannot reach ``floor`` may be left out."""
        alive = self.ids != own
        if query.any() and len(self.ids) > max(few, 4 * k):
            alive = self._aggregate(query, alive, k, few, floor)
        left = np.flatnonzero(alive)
        scores = self.vectors[left] @ query
        best = np.lexsort((self.ids[left], -scores))[:k]
        return self.ids[left][best], scores[best]

    def _aggregate(self, query: np.ndarray, alive: np.ndarray, k: int, few: int, floor: float = -np.inf) -> np.ndarray:
        """Read the lists in turn until no vector outside can be among the k best, or few are left.

        Sums of bounds are doubles, exact for whole numbers up to 2^53.
        """
        n, width = self.vectors.shape
        side, dims, weights = (query > 0).astype(int), np.arange(width), query.astype(float)
        worst = self.values[1 - side, dims, 0] * weights
        read = np.zeros(n)  # sum of what has been read
        missing = np.ones((width, n))  # 1 for each component that has not
        depth = 0
        for end in sorted({*range(n // 2, n, max(1, n // 8)), n}):
            vectors = self.lists[side, dims, depth:end]
            read += np.bincount(vectors.ravel(), (self.values[side, dims, depth:end] * weights[:, None]).ravel(), n)
            missing[dims[:, None], vectors] = 0
            depth = end
            places = self.values[side, dims, depth - 1] * weights
            bounds = np.stack((worst, places)) @ missing
            lower = (read + bounds[0])[alive]
            kth = np.partition(lower, -k)[-k] if len(lower) >= k else -np.inf
            alive = alive & (read + bounds[1] >= max(kth, floor))
            if int(alive.sum()) <= few:
                break
        return alive


def with_floors(asking: DataFrame, candidates: DataFrame, k: int, n: int, sample: int) -> DataFrame:
    """Queries with a score that k candidates of a bounded sample reach (null if the sample has fewer)."""
    near = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / max(n, 1)))
    some = candidates.where(near).limit(2 * sample).toArrow()
    widths = some.column("width").to_numpy()
    known = {}
    for width in np.unique(widths):
        own = some.filter(pa.array(widths == width))
        known[int(width)] = (own.column("id").to_numpy(), own.column("v").combine_chunks().flatten().to_numpy().reshape(-1, width).astype(float))
    shared = asking.sparkSession.sparkContext.broadcast(known)  # at most 2 * sample vectors

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for query_id, v in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist()):
                ids, vectors = shared.value.get(len(v), (np.zeros(0, np.int64), np.zeros((0, len(v)))))
                scores = (vectors @ np.array(v, float))[ids != query_id]
                found.append(float(np.partition(scores, -k)[-k]) if len(scores) >= k else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, "floor"])

    return asking.mapInArrow(floors, "id long, v array<long>, width int, floor double")


def top_k(embeddings: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, block_rows: int = 3072, sample: int = 16_384, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every query but its own row.

    ``embeddings`` are the candidates and ``queries`` rows of the same columns.  Components are
    turned into floor(scale * x).  ``sample`` bounds the candidates that give the queries' first lower bounds.  Vectors that are null or empty, or hold null or non-finite
    components, and rows without an id take no part; vectors of another length than the query's are
    no candidates of it.  Fewer than k candidates give as many rows.  Rows that share an id are each a
    candidate (of queries with another id); equal scores go to the smaller id.
    """
    def whole(rows: DataFrame) -> DataFrame:
        return (rows.where(F.col(id_column).isNotNull() & usable(F.col(vector)))
                .select(F.col(id_column).cast("long").alias("id"), quantised(F.col(vector), scale).alias("v")).withColumn("width", F.size("v")))

    candidates, asking = whole(embeddings), whole(queries).distinct()
    n, m = candidates.count(), asking.count()
    blocks, query_blocks = max(1, -(-n // block_rows)), max(1, -(-m // block_rows))
    spark = embeddings.sparkSession
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks * query_blocks)
    # every block of candidates meets every block of queries; both are bounded, and so is each meeting
    left = candidates.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("side", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = with_floors(asking, candidates, k, n, sample).withColumn("side", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(query_blocks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(own: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if own.num_rows and asked.num_rows:
            width = own.column("width")[0].as_py()
            flat = lambda t: t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, width)
            lists = SortedLists(own.column("id").to_numpy(), flat(own))
            floors = asked.column("floor").fill_null(float("-inf")).to_numpy()
            for query_id, query, floor in zip(asked.column("id").to_numpy(), flat(asked), floors):
                ids, scores = lists.top(query, query_id, k, floor=floor)
                out[0].append(np.full(len(ids), query_id))
                out[1].append(ids)
                out[2].append(scores)
        arrays = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, arrays))))

    keys = ("block", "side", "width")
    best = (left.repartition(tasks, *keys).groupBy(*keys).cogroup(right.repartition(tasks, *keys).groupBy(*keys))
            .applyInArrow(meet, "query_id long, vec_id long, score long"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
