"""Removal of repeated passages by seed and extend.

*Seeds.*  Every window of ``length`` words picks, of the runs of ``seed`` words in it, the one
with the lowest hash: its anchor.  Equal windows pick equal anchors, so a repeat of ``length``
words or more shares an anchor (winnowing), while only about a fifth of all positions is one.
Anchors are joined: those of one document alone are dropped.

*Extension.*  Around each shared anchor, the match is extended both ways as far as windows
that hold it reach, and each such window is looked up under its 96-bit key with the smallest
doc_id that has it.  Windows next to each other unite to maximal repeats; no repeat of fewer
words than ``length`` is kept.

*How it is laid out.*  Documents are spread over blocks by a hash of doc_id.  A block asks, packed
per range of hashes, for its different anchors, later for its different windows, each at most
twice or once whatever the number of occurrences; so a passage in a third of all documents
weighs as many entries as there are blocks.  Ranges answer per block.  The text itself moves by
block only; nothing is collected on the driver, and no pairs of documents are formed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.llm.common import text_blocks
from concordat.llm.shingles import window_hashes, window_starts, word_hashes
from concordat.session import settle

_U = np.uint64
_ASK_ANCHORS = "part int, anchors binary, blocks binary"
_ASK_WINDOWS = "part int, block int, first binary, second binary, low binary"
_ANSWER = "block int, part int, payload binary"


def _anchors(words: np.ndarray, counts: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts, the text of each, and its anchor."""
    starts, texts = window_starts(counts, length)
    runs = window_hashes(words, seed, 1)
    if not len(starts):
        return starts, texts, np.zeros(0, np.uint64)
    lowest = runs[: len(runs) - (length - seed)].copy()
    for k in range(1, length - seed + 1):
        np.minimum(lowest, runs[k : k + len(lowest)], out=lowest)
    return starts, texts, lowest[starts]


def _parts(values: np.ndarray, parts: int) -> np.ndarray:
    return (values >> _U(40)).astype(np.int64) % parts


def _by_part(part: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal parts in a sorted row."""
    cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield int(part[a]), slice(a, b)


def _ask_anchors(block: pa.RecordBatch, parts: int, length: int, seed: int) -> Iterator[dict]:
    ids = block.column("doc_id").to_numpy(zero_copy_only=False)
    blocks = block.column("block").to_numpy(zero_copy_only=False)
    words, counts = word_hashes([t or b"" for t in block.column("text").cast(pa.binary()).to_pylist()])
    _, texts, anchors = _anchors(words, counts, length, seed)
    if not len(anchors):
        return
    own = pd.DataFrame({"block": blocks[texts], "anchor": anchors, "id": ids[texts]}).drop_duplicates()
    own = own[own.groupby(["block", "anchor"]).cumcount() < 2]  # two documents of a block say as much as all
    part = _parts(own["anchor"].to_numpy(), parts)
    order = np.argsort(part, kind="stable")
    packed, asking = own["anchor"].to_numpy()[order], own["block"].to_numpy().astype(np.int32)[order]
    for p, run in _by_part(part[order]):
        yield {"part": p, "anchors": packed[run].tobytes(), "blocks": asking[run].tobytes()}


def _shared_anchors(table: pa.Table) -> pa.Table:
    """Which anchors of a range more than one document has, for each block that asked."""
    anchors = np.frombuffer(b"".join(table.column("anchors").to_pylist()), np.uint64)
    blocks = np.frombuffer(b"".join(table.column("blocks").to_pylist()), np.int32)
    order = np.lexsort((anchors, blocks))
    values, counts = np.unique(anchors, return_counts=True)
    shared = order[counts[np.searchsorted(values, anchors[order])] > 1]
    anchors, blocks = anchors[shared], blocks[shared]
    new = np.ones(len(shared), bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (blocks[1:] != blocks[:-1])
    anchors, blocks = anchors[new], blocks[new]
    runs = list(_by_part(blocks.astype(np.int64))) if len(blocks) else []
    return pa.table({"block": pa.array([b for b, _ in runs], pa.int32()), "part": pa.array([-1] * len(runs), pa.int32()),
                     "payload": pa.array([anchors[r].tobytes() for _, r in runs], pa.binary())})


class _Block:
    """A block's documents, its windows with a shared anchor and their different keys in a fixed order."""

    def __init__(self, docs: pa.Table, answers: pa.Table, parts: int, length: int, seed: int):
        self.ids = docs.column("doc_id")
        self.texts = [t or b"" for t in docs.column("text").cast(pa.binary()).to_pylist()]
        numbers = self.ids.fill_null(0).to_numpy()
        words, self.counts = word_hashes(self.texts)
        starts, texts, anchors = _anchors(words, self.counts, length, seed)
        shared = [np.frombuffer(p, np.uint64) for k, p in zip(answers.column("part").to_pylist(), answers.column("payload").to_pylist()) if k < 0]
        known = self.ids.is_valid().to_numpy(zero_copy_only=False)[texts] if len(texts) else np.zeros(0, bool)
        asked = np.flatnonzero(np.isin(anchors, np.concatenate(shared)) & known) if shared else np.zeros(0, np.int64)
        self.starts, own = starts[asked], numbers[texts[asked]]
        first, second = (window_hashes(words, length, s)[self.starts] if len(asked) else np.zeros(0, np.uint64) for s in (2, 3))
        second = (second >> _U(32)).astype(np.uint32)
        part = _parts(first, parts)
        order = np.lexsort((own, second, first, part))
        first, second, part, own = first[order], second[order], part[order], own[order]
        new = np.ones(len(order), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        heads = np.flatnonzero(new)
        self.group = np.empty(len(order), np.int64)  # of each window: the number of its key
        self.group[order] = np.cumsum(new) - 1
        self.first, self.second, self.part, self.low = first[heads], second[heads], part[heads], own[heads]
        self.own = np.empty(len(order), np.int64)
        self.own[order] = own


def _ask_windows(block_id: int, block: _Block) -> pa.Table:
    rows = [(p, block.first[r], block.second[r], block.low[r]) for p, r in _by_part(block.part)] if len(block.part) else []
    return pa.table({"part": pa.array([p for p, *_ in rows], pa.int32()), "block": pa.array([block_id] * len(rows), pa.int32()),
                     **{name: pa.array([r[k].tobytes() for r in rows], pa.binary()) for k, name in ((1, "first"), (2, "second"), (3, "low"))}})


def _earlier_windows(table: pa.Table) -> pa.Table:
    """For each block that asked: per key, in its order, whether a smaller doc_id elsewhere has the window."""
    sizes = [len(b) // 8 for b in table.column("first").to_pylist()]
    first, second, low = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("first", np.uint64), ("second", np.uint32), ("low", np.int64)))
    order = np.lexsort((low, second, first))
    new = np.ones(len(order), bool)
    new[1:] = (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])
    least = low[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    earlier = np.empty(len(order), bool)
    earlier[order] = least < low[order]
    ends = np.cumsum(sizes)
    flags = [np.packbits(earlier[e - n : e]).tobytes() for n, e in zip(sizes, ends)]
    return pa.table({"block": table.column("block"), "part": table.column("part"), "payload": pa.array(flags, pa.binary())})


def _covered(block: _Block, answers: pa.Table, length: int) -> np.ndarray:
    """Words of the block inside a window that also starts in a document with a smaller doc_id."""
    flags = np.zeros(len(block.part), bool)
    found = {k: p for k, p in zip(answers.column("part").to_pylist(), answers.column("payload").to_pylist()) if k >= 0}
    for part, run in _by_part(block.part) if len(block.part) else []:
        if part in found:
            flags[run] = np.unpackbits(np.frombuffer(found[part], np.uint8), count=run.stop - run.start).astype(bool)
    repeated = flags[block.group] | (block.own > block.low[block.group]) if len(block.group) else np.zeros(0, bool)
    steps = np.zeros(int(block.counts.sum()) + 1, np.int64)
    np.add.at(steps, block.starts[repeated], 1)
    np.add.at(steps, block.starts[repeated] + length, -1)
    return np.cumsum(steps)[:-1] > 0


def blocks_and_answers(documents: DataFrame, text: str, length: int, seed: int, block_bytes: int) -> tuple[DataFrame, DataFrame, int]:
    """Documents with their block, all answers to each block, and the number of hash ranges."""
    docs = documents.select(F.col("doc_id").cast("long"), documents[text].alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(16, int(size // block_bytes) + 1)
    docs = docs.withColumn("block", F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0))), F.lit(parts)).cast("int"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, "text"):
            rows = list(_ask_anchors(batch, parts, length, seed))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("part", pa.int32()), ("anchors", pa.binary()), ("blocks", pa.binary())]))

    # a fixed number of tasks: these rows are small for the work they mean
    tasks = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = docs.where(F.col("doc_id").isNotNull()).mapInArrow(ask, _ASK_ANCHORS).repartition(tasks, "part")
    shared = settle(asked.groupBy("part").applyInArrow(_shared_anchors, _ANSWER), "shared")

    def ask_windows(key: tuple, own: pa.Table, answers: pa.Table) -> pa.Table:
        return _ask_windows(key[0].as_py(), _Block(own, answers, parts, length, seed))

    docs = docs.repartition(tasks, "block")
    windows = docs.groupBy("block").cogroup(shared.repartition(tasks, "block").groupBy("block")).applyInArrow(ask_windows, _ASK_WINDOWS)
    earlier = settle(windows.repartition(tasks, "part").groupBy("part").applyInArrow(_earlier_windows, _ANSWER), "earlier")
    return docs, shared.unionByName(earlier).repartition(tasks, "block"), parts


def remove_repeats(documents: DataFrame, text: str = "text", length: int = 13, seed: int = 5, block_bytes: int = 1 << 21) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256, kept (its remaining words joined by a space), spans.

    A word is removed if it lies in a window of ``length`` words that also starts in a document
    with a smaller doc_id; windows are judged on the input.  Words are runs of anything but
    ASCII white space, unchanged.  ``spans`` lists the removed passages as first word and number
    of words.  Null and empty texts have no words; shorter texts lose none.  Rows with one doc_id
    never remove each other's words.  Rows without a doc_id keep all words and remove none.
    """
    docs, answers, parts = blocks_and_answers(documents, text, length, seed, block_bytes)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, spans array<struct<first: long, words: long>>"
    span = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))

    def result(key: tuple, own: pa.Table, answers: pa.Table) -> pa.Table:
        block = _Block(own, answers, parts, length, seed)
        gone = _covered(block, answers, length)
        kept, digests, removed, spans, end = [], [], [], [], 0
        for text, n in zip(block.texts, block.counts):
            out = gone[end : end + n]
            end += n
            words = text.split()
            if out.any():
                words = [w for w, g in zip(words, out) if not g]
                edges = np.flatnonzero(np.diff(out.astype(np.int8), prepend=0, append=0))
                spans.append([{"first": int(a), "words": int(b - a)} for a, b in zip(edges[0::2], edges[1::2])])
            else:
                spans.append([])
            joined = b" ".join(words)
            kept.append(joined)
            digests.append(hashlib.sha256(joined).hexdigest())
            removed.append(int(out.sum()))
        return pa.table({"doc_id": block.ids, "n_words": pa.array(block.counts), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string()),
                         "kept": pa.array(kept, pa.binary()).cast(pa.string()), "spans": pa.array(spans, span)})

    return docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(result, schema)
