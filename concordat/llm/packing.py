"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are powers of two: as many of the
longest length as fit, then the binary digits of the rest, longest first.  Every piece is a
training sequence by itself and goes to the bucket of its length, so no sequence crosses
documents, batches are drawn from buckets of equal lengths, and nothing is padded.

Tokens come from a public tokenizer.  Its vocabulary never holds white space, so a text is
the row of its runs between ASCII white space; the ids of a run are kept per worker.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.llm.common import one_thread, text_blocks

#: Bounds of what a worker keeps: so many runs, and none longer than so many bytes.
MOST_RUNS, LONGEST_RUN = 500_000, 48


class RunIds:
    """Ids of a text as little-endian unsigned 32-bit numbers."""

    def __init__(self, tokenizer_file: str):
        one_thread()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab()
        #: Ids that end a word, by id; None where the vocabulary does not tell.
        self.ends = None
        if suffix:
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def together(self, words: list[str]) -> list[bytes] | None:
        """Ids of runs of letters, encoded as one text and cut after the ids that end a word.

        A run gives a word at least, so as many ends as runs mean one each; else None.
        """
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        after = np.flatnonzero(self.ends[ids]) + 1
        if len(after) != len(words) or after[-1] != len(ids):
            return None
        row, cuts = ids.tobytes(), [0, *(4 * after).tolist()]
        return [row[a:b] for a, b in zip(cuts, cuts[1:])]

    def encoded(self, runs: list[bytes]) -> dict[bytes, bytes]:
        """Ids of runs by themselves.  Most are of letters alone, which are one word each."""
        found, texts = {}, [r.decode() for r in runs]
        if self.ends is not None:
            words = [(r, t) for r, t in zip(runs, texts) if t.isalpha() and t.lower().isalpha()]
            ids = self.together([t for _, t in words]) if words else None
            if ids is not None:
                found = {r: i for (r, _), i in zip(words, ids)}
        rest = [(r, t) for r, t in zip(runs, texts) if r not in found] if found else list(zip(runs, texts))
        encoded = self.tokenizer.encode_batch_fast([t for _, t in rest], add_special_tokens=False)
        found.update((r, np.array(e.ids, "<u4").tobytes()) for (r, _), e in zip(rest, encoded))
        return found

    def learn(self, runs: list[bytes]) -> dict[bytes, bytes]:
        """Ids of new runs.  Punctuation after a letter or digit is a unit by itself, so its ids are put behind."""
        bases = {}
        for run in runs:
            base = run.rstrip(b".,;:!?%*#&$")
            if base != run and base[-1:].isalnum() and len(run) - len(base) <= 4:
                bases[run] = base
        whole = {r for r in runs if r not in bases}.union(bases.values(), (r[len(b) :] for r, b in bases.items()))
        found = {r: ids for r in whole if (ids := self.known.get(r, self.older.get(r))) is not None}
        new = [r for r in whole if r not in found]
        found.update(self.encoded(new))
        found.update((r, found[b] + found[r[len(b) :]]) for r, b in bases.items())
        return found

    def lowered(self, text: bytes) -> bytes:
        """The tokenizer ignores case.  Where no special string and no combining mark stands, lower it first: fewer runs."""
        return text if b"<|" in text or b"\xcc" in text or b"\xcd" in text else text.lower()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        split = [self.lowered(t).split() for t in texts]  # bytes split at ASCII white space only
        missing = set().union(*split).difference(self.known)
        found = {r: self.older[r] for r in missing if r in self.older}
        if len(found) < len(missing):
            found |= self.learn([r for r in missing if r not in found])
        if len(self.known) + len(found) > MOST_RUNS:  # runs not met for so long are forgotten
            self.known, self.older = {r: self.known[r] for r in set().union(*split) if r in self.known}, self.known
        self.known.update((r, ids) for r, ids in found.items() if len(r) <= LONGEST_RUN)
        long = {r: ids for r, ids in found.items() if len(r) > LONGEST_RUN}
        get = self.known.get
        return [b"".join([get(r) or long.get(r, b"") for r in runs] if long else map(get, runs)) for runs in split]


def cut(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; longest is a power of two."""
    pieces, start = [], 0
    while n - start >= longest:
        pieces.append((start, longest))
        start += longest
    for bit in reversed(range((longest - 1).bit_length())):
        if n - start >= 1 << bit:
            pieces.append((start, 1 << bit))
            start += 1 << bit
    return pieces


_IDS: dict[str, RunIds] = {}


def pack(documents: DataFrame, tokenizer_file: str, end_id: int = 1, longest: int = 2048, text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, bucket, ids_crc32, doc_tokens, sequence_id, offset.

    ``bucket`` is the binary logarithm of the length.  sequence_id numbers the pieces; it is
    unique, and the same again when a lost task is repeated, since the plan has no shuffle.
    A null or empty text, or one without words, has the end id alone and gives one piece of one token.
    Repeated rows are packed each.  Only doc_id and ``text`` are read.
    """
    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    id_type = documents.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_file not in _IDS:
            _IDS[tokenizer_file] = RunIds(tokenizer_file)
        for block in text_blocks(batches, "text"):
            texts = [t or b"" for t in block.column("text").cast(pa.binary()).to_pylist()]
            rows, cuts, crcs, totals = [], [], [], []
            for row, ids in enumerate(_IDS[tokenizer_file].encode(texts)):
                ids += end
                total = len(ids) // 4
                for start, length in cut(total, longest):
                    rows.append(row)
                    cuts.append((start, length))
                    crcs.append(zlib.crc32(ids[4 * start : 4 * (start + length)]))
                    totals.append(total)
            starts, lengths = (np.array(x, np.int64) for x in zip(*cuts))
            yield pa.RecordBatch.from_pydict({
                "doc_id": block.column("doc_id").take(pa.array(rows, pa.int64())),
                "start": pa.array(starts), "length": pa.array(lengths),
                "bucket": pa.array(np.log2(lengths).round().astype(np.int32)),
                "ids_crc32": pa.array(crcs, pa.int64()), "doc_tokens": pa.array(totals, pa.int64()),
            })

    schema = f"doc_id {id_type}, start long, length long, bucket int, ids_crc32 long, doc_tokens long"
    cut_up = documents.select("doc_id", documents[text].alias("text")).mapInArrow(pieces, schema)
    return cut_up.select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
