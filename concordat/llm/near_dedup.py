"""Near-duplicate classes by BagMinHash.

A text is the multiset of its five-word shingles.  *Signature*: every shingle owns Poisson
processes over the weight axis, one for each dyadic interval [0,1), [1,2), [2,4), ...; a point
has a time, a component and a weight position found by halving the interval, and counts for a
text if that position lies below the shingle's multiplicity.  The first point of each component
is an unbiased sample: two texts agree in a component with their weighted Jaccard similarity.
Points are drawn in order of time and only as long as a component can still change.

*Bands* of four components bring candidates together; texts that are the same multiset collapse
first.  *Links* are verified on the texts themselves, by exact multiset overlap, in two rounds.
The first compares each member of a bucket with one text: the smallest of the buckets, of which
it shares most.  What that links becomes one component.  The second round takes the buckets that
still hold several components and tests all their members across components, block against block:
by signature first, and exactly where that allows the threshold.  It gives the links that join
components, not all pairs.  So no bucket is gathered in one task or written out as pairs, and
no candidate is left untested.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.llm.common import text_blocks
from concordat.llm.shingles import mix, window_hashes, window_starts, word_hashes
from concordat.session import settle

_U = np.uint64
BANDS, ROWS = 24, 4
COMPONENTS = BANDS * ROWS
#: Four and a half standard deviations of an estimate from the signature at similarity 0.8.
SLACK = 0.185
#: Members of a bucket that meet in one comparison; number of ids (8 bytes each) up to which they are sent to every task.
BLOCK, FEW_IDS = 512, 400_000


def multisets(texts: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different shingles of all texts, sorted per text: text number, hash, multiplicity; and two digests of each text's words.

    A text of fewer words than a shingle, but at least one, is one shingle.
    """
    words, counts = word_hashes(texts, folded=True)
    starts, owner = window_starts(counts, shingle)
    hashes = window_hashes(words, shingle, 7)[starts]
    ends = np.cumsum(counts)
    digests = np.zeros((2, len(texts)), np.uint64)
    place = np.arange(len(words)) - np.repeat(ends - counts, counts)
    for k in range(2):
        own = mix(words * _U(2 * k + 1) + mix(place.astype(np.uint64) + _U(k + 11)))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(own, dtype=np.uint64)))
        digests[k] = mix(sums[ends] - sums[ends - counts] + counts.astype(np.uint64))
    short = np.flatnonzero((counts > 0) & (counts < shingle))
    hashes, owner = np.concatenate((hashes, digests[0][short])), np.concatenate((owner, short))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    heads = np.flatnonzero(new)
    return owner[heads], hashes[heads], np.diff(heads, append=len(hashes)), digests[0], digests[1]


def signatures(owner: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n_texts: int) -> np.ndarray:
    """BagMinHash signatures, one row of 32-bit values per text; rows of texts without shingles are 0."""
    total = np.bincount(owner, weights, n_texts)
    best = np.full(n_texts * COMPONENTS, np.iinfo(np.uint64).max, np.uint64)
    until = np.full(n_texts, np.log(COMPONENTS) + 5.0)
    open_texts = total > 0
    while open_texts.any():
        limit = np.where(open_texts, until / np.maximum(total, 1), -1.0)
        level, low = 0, 0
        while True:  # the interval from low up to twice low, first [0, 1)
            length = max(low, 1)
            own = np.flatnonzero((weights > low) & open_texts[owner])
            if not len(own):
                break
            _draw(best, owner[own], hashes[own], weights[own], low, length, level, limit)
            level, low = level + 1, low + length
        unfilled = (best.reshape(n_texts, COMPONENTS) == np.iinfo(np.uint64).max).any(axis=1)
        open_texts &= unfilled
        until = until * 2
    found = (best.reshape(n_texts, COMPONENTS) & _U(0xFFFFFFFF)).astype(np.uint32)
    found[total == 0] = 0
    return found


def _draw(best: np.ndarray, owner: np.ndarray, hashes: np.ndarray, weights: np.ndarray, low: int, length: int, level: int, limit: np.ndarray) -> None:
    """Points of one interval's processes in order of time, up to the limit of each text."""
    state = mix(hashes + _U((level + 1) * 0xA24BAED4963EE407 % (1 << 64)))
    time, rate, k = np.zeros(len(owner)), float(length * COMPONENTS), 0
    bound = limit[owner]
    while len(owner):
        k += 1
        first = mix(state + _U(k * 0x9FB21C651E98DF25 % (1 << 64)))
        time = time - np.log(((first >> _U(11)).astype(np.float64) + 1) * 2.0**-53) / rate
        on = time <= bound
        if not on.all():
            owner, weights, state, time, bound, first = owner[on], weights[on], state[on], time[on], bound[on], first[on]
        if not len(owner):
            return
        second = mix(first ^ _U(0x8CB92BA72F3D8DD7))
        component = ((second >> _U(40)) * _U(COMPONENTS) >> _U(24)).astype(np.int64)
        counted = slice(None)
        if length > 1:  # halving the interval by the bits of a number finds the weight position
            counted = low + ((second & _U((1 << 40) - 1)).astype(np.float64) * (length / 2.0**40)).astype(np.int64) < weights
        keys = (time.astype(np.float32).view(np.uint32).astype(np.uint64) << _U(32)) | (mix(second) >> _U(32))
        np.minimum.at(best, (owner * COMPONENTS + component)[counted], keys[counted])


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Overlap of two multisets given as sorted different hashes and multiplicities."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / max(1, int(a[1].sum()) + int(b[1].sum()) - both)


def signed(documents: DataFrame, shingle: int) -> DataFrame:
    """doc_id, d1, d2 (digest of the words), n (shingles), signature; texts without words are left out."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "text", 1 << 21):
            texts = [t or b"" for t in block.column("text").cast(pa.binary()).to_pylist()]
            owner, hashes, weights, d1, d2 = multisets(texts, shingle)
            found = signatures(owner, hashes, weights, len(texts))
            n = np.bincount(owner, weights, len(texts)).astype(np.int64)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({
                "doc_id": block.column("doc_id").take(pa.array(some)), "d1": pa.array(d1[some].view(np.int64)), "d2": pa.array(d2[some].view(np.int64)),
                "n": pa.array(n[some]), "signature": pa.array([found[i].tobytes() for i in some], pa.binary())})

    return documents.mapInArrow(sign, "doc_id long, d1 long, d2 long, n long, signature binary")


def _needed(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of the documents with these ids, one row each."""
    if ids.count() <= FEW_IDS:  # bounded, so every task can filter its texts before they move
        ids = F.broadcast(ids)
    return documents.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])


def verified(pairs: DataFrame, documents: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """Pairs (a, b) whose texts' multisets overlap enough, with their similarity."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = _needed(documents, needed)

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "text_b", 1 << 20):
            texts = [t or b"" for name in ("text_a", "text_b") for t in block.column(name).cast(pa.binary()).to_pylist()]
            owner, hashes, weights, _, _ = multisets(texts, shingle)
            at = np.searchsorted(owner, np.arange(len(texts) + 1))
            sets = [(hashes[i:j], weights[i:j]) for i, j in zip(at[:-1], at[1:])]
            found = [weighted_jaccard(sets[i], sets[i + block.num_rows]) for i in range(block.num_rows)]
            yield pa.RecordBatch.from_pydict({"a": block.column("a"), "b": block.column("b"), "similarity": pa.array(found, pa.float64())})

    both = (pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
            .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b"))
    return both.mapInArrow(overlap, "a long, b long, similarity double").where(F.col("similarity") >= threshold)


def components(links: DataFrame) -> DataFrame:
    """id, label (the smallest id of its component) of all ids in links (a, b).

    Each round takes the smallest label among neighbours and then the label of that label; every
    round is written to the shared folder, and the number of rounds grows with the logarithm of
    the longest chain.
    """
    edges = settle(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = settle(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("to"))
        jumped = lower.join(labels.select(F.col("id").alias("to"), F.col("label").alias("up")), "to").select("id", "label", F.least("to", "up").alias("to"))
        made = settle(jumped, "labels")
        if made.where("label <> to").isEmpty():
            return labels
        labels = made.select("id", F.col("to").alias("label"))


def _overlaps(own: int, others: np.ndarray, starts: np.ndarray, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Exact similarity of one multiset with others; those of text t lie at starts[t] to starts[t + 1]."""
    mine, sizes = hashes[starts[own] : starts[own + 1]], starts[others + 1] - starts[others]
    ends = np.cumsum(sizes)
    at = np.arange(ends[-1]) + np.repeat(starts[others] - (ends - sizes), sizes)
    place = np.minimum(np.searchsorted(mine, hashes[at]), len(mine) - 1)
    shared = np.where(mine[place] == hashes[at], np.minimum(weights[at], weights[starts[own] : starts[own + 1]][place]), 0)
    both = np.add.reduceat(shared, ends - sizes)
    total = np.add.reduceat(weights[at], ends - sizes) + weights[starts[own] : starts[own + 1]].sum()
    return both / (total - both)


def _across(members: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """Links (a, b) between different components in one bucket: enough of them to join all that are linked.

    members: band, key, id, component, signature, text, size (of the bucket).
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = members.withColumn("own", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    # a large bucket is a grid of blocks; small buckets share a group
    spread = placed.select("*", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    spread = spread.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    groups = max(64, members.count() // BLOCK)
    grouped = spread.select("band", "key", "id", "component", "signature", "text", "own", "i", "j", F.pmod(F.xxhash64("band", "key", "i", "j"), F.lit(groups)).alias("chunk"))
    least = threshold - SLACK

    def compare(table: pa.Table) -> pa.Table:
        frame, found = table.to_pandas(), set()
        up: dict[int, int] = {}  # what this group has joined so far: links enough to join it, no more

        def top(part: int) -> int:
            while part in up:
                part = up[part]
            return part

        for (band, _, i, j), own in frame.groupby(["band", "key", "i", "j"], sort=False):
            if own["component"].nunique() < 2:
                continue
            ids, parts, side = own["id"].to_numpy(), own["component"].to_numpy(), own["own"].to_numpy()
            signs = np.frombuffer(b"".join(own["signature"]), np.uint32).reshape(len(own), COMPONENTS)
            sets = None
            for x in np.flatnonzero(side == i):
                y = np.flatnonzero((parts != parts[x]) & ((ids > ids[x]) if i == j else (side == j)))
                same = signs[y] == signs[x]
                near = same.mean(axis=1) >= least
                y, same = y[near], same[near]
                if len(y):  # a pair counts in the first band it shares
                    y = y[same.reshape(len(y), BANDS, ROWS).all(axis=2).argmax(axis=1) == band]
                mine = top(parts[x])
                y = y[[top(parts[z]) != mine for z in y]] if len(y) else y
                if not len(y):
                    continue
                if sets is None:
                    owner, hashes, weights, _, _ = multisets([(t or "").encode() for t in own["text"]], shingle)
                    sets = (np.searchsorted(owner, np.arange(len(own) + 1)), hashes, weights)
                for z in y[_overlaps(x, y, *sets) >= threshold]:
                    mine, other = top(parts[x]), top(parts[z])
                    if mine != other:
                        up[max(mine, other)] = min(mine, other)
                        found.add((int(min(ids[x], ids[z])), int(max(ids[x], ids[z]))))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return grouped.groupBy("chunk", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def near_duplicate_classes(documents: DataFrame, text: str = "text", shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, class_id, n_shingles, copy_of of every row.

    class_id is the smallest doc_id of the class: texts linked by multiset similarity of at least
    ``threshold``, directly or through others.  copy_of is the smallest doc_id with the very same
    words.  Words are folded: A-Z lower-cased, runs of letters, digits and characters beyond ASCII.
    Null, empty and wordless texts are like no other text: class_id and copy_of are their own
    doc_id.  Rows that share a doc_id share its class; rows without a doc_id have none (null).
    """
    docs = documents.select(F.col("doc_id").cast("long"), documents[text].alias("text"))
    known = docs.where(F.col("doc_id").isNotNull())
    marks = settle(signed(known, shingle), "signatures")
    first = marks.groupBy("d1", "d2").agg(F.min("doc_id").alias("id"))
    # of rows that share an id, the first text found stands for it
    own = marks.join(first.select(F.col("id").alias("doc_id"), "d1", "d2"), ["doc_id", "d1", "d2"]).select(F.col("doc_id").alias("id"), "n", "signature").dropDuplicates(["id"])
    own = settle(own, "different")
    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))
    rows = own.select("id", "signature", band.alias("band")).select("id", "band", F.expr(f"substring(signature, band * {4 * ROWS} + 1, {4 * ROWS})").alias("key"))
    buckets = rows.groupBy("band", "key").agg(F.min("id").alias("pivot"), F.count("*").alias("size")).where("size > 1")
    members = settle(rows.join(buckets, ["band", "key"]), "members")

    shares = members.where("id <> pivot").groupBy("id", "pivot").agg(F.count("*").alias("shared"))
    nearest = shares.groupBy("id").agg(F.max_by("pivot", F.struct("shared", -F.col("pivot"))).alias("pivot"))
    tried = settle(nearest.select(F.col("pivot").alias("a"), F.col("id").alias("b")), "tried")
    links = settle(verified(tried, known, shingle, threshold), "links")
    labels = components(links)

    placed = members.join(labels, "id", "left").select("band", "key", "id", "size", F.coalesce("label", "id").alias("component"))
    mixed = placed.groupBy("band", "key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("band", "key")
    across = placed.join(mixed, ["band", "key"])
    texts = _needed(known, across.select(F.col("id").alias("doc_id")).distinct()).withColumnRenamed("doc_id", "id")
    across = settle(across.join(own.select("id", "signature"), "id").join(texts, "id"), "across")
    further = settle(_across(across, shingle, threshold), "further")
    if not further.isEmpty():
        labels = components(links.select("a", "b").unionByName(further))

    member = marks.select("doc_id", "d1", "d2", "n").join(first, ["d1", "d2"]).select("doc_id", "n", F.col("id").alias("copy"))
    classed = member.join(labels.withColumnRenamed("id", "copy"), "copy", "left").select("doc_id", "n", "copy", F.coalesce("label", "copy").alias("class_id"))
    by_id = classed.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("n").alias("n_shingles"), F.min("copy").alias("copy_of"))
    return (documents.select(F.col("doc_id").cast("long")).join(by_id, "doc_id", "left")
            .select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_shingles", F.lit(0)).alias("n_shingles"), F.coalesce("copy_of", "doc_id").alias("copy_of")))
