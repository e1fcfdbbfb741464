"""Token counts by a compiled finite-state transducer.

A piece vocabulary with merge priorities (byte-pair encoding) defines which pieces a text
becomes.  Two facts make this a finite-state job.  A sequence of pieces is the encoding of
its text exactly if every two neighbours encode to themselves; and the encoding of a text
up to any position ends with one certain piece.  So the state after a character needs only
the longest suffix that a piece may still continue and, for the positions inside it, the
piece that ends there and the number of pieces up to there.  ``Transducer`` determinises
this as texts need it: a transition carries the next state and how many pieces it adds
(below zero if pieces fuse).  Its memory is bounded: once it holds ``MOST_STATES`` states, a
word that leaves the compiled part is counted by the same rule position by position.

Pieces never hold a word mark after another character and never hold an unknown character,
so both bring the transducer back to its start.  That makes chunks composable: the state map
of a chunk is constant from its first such reset on.  ``ChunkMap`` holds a chunk's head (up
to the first reset), the count between, and its tail (from the last reset on); ``compose``
is associative, and ``scan`` folds the maps of a long text pairwise, as a parallel prefix
scan does.

Empty and null texts have no tokens.  Strings that look like special pieces are ordinary text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from concordat.llm.common import text_blocks

MARK = "▁"
#: Bounds of what a worker keeps; beyond them the kept entries are dropped and made again.
MOST_WORDS, MOST_STATES, MOST_FITS, LONGEST_WORD, CHUNK = 500_000, 100_000, 1_000_000, 48, 1 << 16


class State:
    __slots__ = ("ends", "steps", "suffix")

    def __init__(self, suffix: str, ends: tuple[tuple[str, int] | None, ...]):
        # ends[k]: the piece that ends k characters into the suffix, and the number of pieces
        # up to there less the number up to here; None where no piece can go on from there.
        self.suffix, self.ends, self.steps = suffix, ends, {}


class Transducer:
    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.prefixes = {piece[:n] for piece in scores for n in range(1, len(piece) + 1)}
        self.fits: dict[tuple[str, str], bool] = {}
        self.states: dict[tuple, State] = {}
        self.start = self._state("", (("", 0),))
        # For the last three characters: lengths of the pieces that end with them, longest first.
        lengths: dict[str, set[int]] = {}
        for piece in scores:
            if len(piece) >= 3:
                lengths.setdefault(piece[-3:], set()).add(len(piece))
        self.lengths = {end: (*sorted(found, reverse=True), 2, 1) for end, found in lengths.items()}

    def _state(self, suffix: str, ends: tuple[tuple[str, int] | None, ...]) -> State:
        known = self.states.get((suffix, ends))
        if known is None:
            known = self.states[suffix, ends] = State(suffix, ends)
        return known

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by repeated merging of the best pair, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best = max((self.scores.get(parts[i] + parts[i + 1], float("-inf")), -i) for i in range(len(parts) - 1))
            if best[0] == float("-inf"):
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _neighbours(self, left: str, right: str) -> bool:
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) >= MOST_FITS:
                self.fits.clear()
            known = self.fits[left, right] = self.merged(left + right) == [left, right]
        return known

    def compile(self, state: State, char: str) -> tuple[State, int]:
        """The transition of a known character: next state and pieces added."""
        text, size = state.suffix + char, len(state.suffix) + 1
        for length in range(size, 0, -1):
            piece = text[size - length :]
            if piece in self.scores:
                before, count = state.ends[size - length]
                if not before or self._neighbours(before, piece):
                    break
        added = count + 1
        keep = size
        while keep and text[size - keep :] not in self.prefixes:
            keep -= 1
        left = text[size - keep :]
        ends = (*((e[0], e[1] - added) if left[k:] in self.prefixes else None
                  for k, e in enumerate(state.ends[size - keep :])), (piece, 0))
        made = state.steps[char] = (self._state(left, ends), added)
        return made

    def count(self, text: str) -> int:
        """The pieces of a text that starts in the start state."""
        state, total = self.start, 0
        for i, char in enumerate(text):
            step = state.steps.get(char)
            if step is None:
                if char not in self.scores:  # falls back to bytes, and nothing merges across it
                    step = state.steps[char] = (self.start, len(char.encode("utf-8", "surrogatepass")))
                elif len(self.states) < MOST_STATES:
                    step = self.compile(state, char)
                else:
                    return total + self.by_position(state, text[i:])
            state, added = step
            total += added
        return total

    def by_position(self, state: State, rest: str) -> int:
        """What the rest of a text adds after a state, from the rule itself, without compiling."""
        scores, fits, lengths = self.scores, self.fits, self.lengths
        last = [e and e[0] for e in state.ends]
        counts = [e and e[1] for e in state.ends]
        text, base = state.suffix + rest, 0
        for i in range(len(last), len(text) + 1):
            char = text[i - 1]
            if char not in scores:
                last.append("")
                counts.append(counts[-1] + len(char.encode("utf-8", "surrogatepass")))
                base = i
                continue
            for length in lengths.get(text[i - 3 : i], (2, 1)) if i - base > 2 else (2, 1):
                j = i - length
                if j < base:
                    continue
                piece = text[j:i]
                if piece in scores:
                    before = last[j]
                    if not before:
                        break
                    fit = fits.get((before, piece))
                    if fit or fit is None and self._neighbours(before, piece):
                        break
            last.append(piece)
            counts.append(counts[j] + 1)
        return counts[-1]


class ChunkMap(NamedTuple):
    """A chunk as a function of the state before it.

    Without a reset everything is head.  With one: head, then a constant count, then the tail,
    which starts in the start state.
    """

    head: str
    reset: bool
    count: int
    tail: str


class Counter:
    """Counts pieces of whole texts, word by word and chunk by chunk."""

    def __init__(self, scores: dict[str, float]):
        self.machine = Transducer(scores)
        self.words: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.openings: dict[str, int] = {}
        self.breaks = not any("\n" in piece for piece in scores)

    def segment(self, text: str) -> int:
        """Pieces of a text that starts in the start state and is followed by a reset or the end."""
        return self.machine.count(text)

    def word(self, word: str) -> int:
        """Pieces of one mark and a word (or of further marks and a word)."""
        known = self.words.get(word)
        if known is None:
            known = self.older.get(word)
            if known is None:
                known = self.lines(word) if self.breaks and "\n" in word else self.segment(MARK + word)
            if len(word) <= LONGEST_WORD:
                if len(self.words) >= MOST_WORDS:  # words not met for so long are forgotten
                    self.words, self.older = {}, self.words
                self.words[word] = known
        return known

    def lines(self, word: str) -> int:
        """The same for a word with line breaks, at which the transducer starts anew."""
        first, *others = word.split("\n")
        total = self.word(first) + len(others)
        for part in others:
            if part:
                known = self.openings.get(part)
                if known is None:
                    known = self.segment(part)  # no mark stands before it
                    if len(part) <= LONGEST_WORD:
                        if len(self.openings) >= MOST_WORDS:
                            self.openings.clear()
                        self.openings[part] = known
                total += known
        return total

    def chunk_map(self, chunk: str) -> ChunkMap:
        """The map of a chunk of marked text."""
        first = re.search(f"(?<=[^{MARK}]){MARK}", chunk)
        if not first:
            return ChunkMap(chunk, False, 0, "")
        last = re.compile(f".*[^{MARK}](?={MARK})", re.S).match(chunk).end()
        between = sum(map(self.word, [s[1:] for s in re.findall(f"{MARK}+[^{MARK}]+", chunk[first.start() : last])]))
        return ChunkMap(chunk[: first.start()], True, between, chunk[last:])

    def compose(self, left: ChunkMap, right: ChunkMap) -> ChunkMap:
        """The map of two neighbouring chunks."""
        if not left.reset and not right.reset:
            whole = left.head + right.head
            cut = re.search(f"(?<=[^{MARK}]){MARK}", whole[max(0, len(left.head) - 1) : len(left.head) + 1])
            if not cut:
                return ChunkMap(whole, False, 0, "")
            return ChunkMap(left.head, True, 0, right.head)
        if not left.reset:
            if left.head and left.head[-1] != MARK and right.head.startswith(MARK):
                return ChunkMap(left.head, True, self.segment(right.head) + right.count, right.tail)
            return ChunkMap(left.head + right.head, True, right.count, right.tail)
        joined = left.tail + right.head
        split = left.tail and left.tail[-1] != MARK and right.head.startswith(MARK)
        if not right.reset:
            if split:
                return ChunkMap(left.head, True, left.count + self.segment(left.tail), right.head)
            return ChunkMap(left.head, True, left.count, joined)
        closed = self.segment(left.tail) + self.segment(right.head) if split else self.segment(joined)
        # the tail of the left chunk and the head of the right one meet a reset on both sides
        return ChunkMap(left.head, True, left.count + closed + right.count, right.tail)

    def scan(self, maps: list[ChunkMap]) -> ChunkMap:
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def count(self, text: str, chunk: int = CHUNK) -> int:
        if not text:
            return 0
        text = text.replace(MARK, " ")
        if len(text) <= chunk:
            words = text.split(" ")
            if "" in words:  # runs of marks belong to the word after them
                words = [s[1:].replace(" ", MARK) for s in re.findall(" *[^ ]+| +", " " + text)]
            counts = list(map(self.words.get, words))
            if None in counts:
                counts = [self.word(w) if n is None else n for n, w in zip(counts, words)]
            return sum(counts)
        text = MARK + text.replace(" ", MARK)
        whole = self.scan([self.chunk_map(text[i : i + chunk]) for i in range(0, len(text), chunk)])
        return self.segment(whole.head) + whole.count + self.segment(whole.tail)


def piece_scores(model_file: str) -> dict[str, float]:
    """The mergeable pieces of a sentencepiece model and their merge scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return {
        model.id_to_piece(i): model.get_score(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))
    }


_COUNTERS: dict[str, Counter] = {}


def counter_of(model_file: str) -> Counter:
    """A worker's counter; kept between batches and tasks, its memory is bounded."""
    if model_file not in _COUNTERS:
        _COUNTERS[model_file] = Counter(piece_scores(model_file))
    return _COUNTERS[model_file]


def token_counts(documents: DataFrame, model_file: str, limit: int = 4096, text: str = "text") -> DataFrame:
    """Bytes and tokens of every text: doc_id, n_bytes, n_tokens, over_limit.

    Reads the columns doc_id and ``text`` only, so further columns of any name do no harm.
    Null and empty texts count 0 bytes and 0 tokens.  Repeated rows are counted each.
    """
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(model_file)
        for block in text_blocks(batches, "text"):
            texts = block.column("text").to_pylist()
            sizes = pc.fill_null(pc.binary_length(block.column("text")), 0)
            tokens = [counter.count(t) if t else 0 for t in texts]
            yield pa.RecordBatch.from_pydict({
                "doc_id": block.column("doc_id"), "n_bytes": sizes.cast(pa.int64()),
                "n_tokens": pa.array(tokens, pa.int64()), "over_limit": pa.array([n > limit for n in tokens], pa.bool_()),
            })

    return documents.select("doc_id", documents[text].alias("text")).mapInArrow(
        count, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
