"""Benchmark decontamination over a positional inverted index, with DataFrame functions only.

*Index.*  The training texts' words are counted once; from the counts, every benchmark window
takes its rarest terms.  The postings (term, document, position) of these terms are stored in
the shared folder, sorted by term.

*Intersection.*  A posting of a window's rarest term gives, less the term's offset in the window,
a place where the window may start; the same place has to follow from the window's next rarest
term.  What both lists agree on is a candidate alignment of an item with a document.

*Proximity.*  A window of n words that lies in a document with at most e words changed, inserted or
deleted keeps one of any e + 1 parts of it whole.  So the postings of short runs of consecutive words
give every rough alignment that can hold a proximity match, whatever word differs.

*Result.*  Each document meets its own candidates, and their windows are compared word by word:
an equal window is an exact phrase match, one within e edits of the words around it a proximity match.

A posting list of any length, and an item or a document of any number of matches, is spread as
rows over all tasks until a document gathers its own candidates.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.session import settle

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words; A-Z are part of words before they are lower-cased.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _BETWEEN, -1), "")


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """item, item_id, words, n (words of a window), starts: every item that has words."""
    items = benchmark.select("item_id", words_of(lowered(F.col("text"))).alias("words")).where(F.size("words") > 0)
    n = F.least(F.size("words"), F.lit(window))
    return items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("string").alias("item_id"), "words", n.alias("n"))


def rarest_terms(items: DataFrame, counts: DataFrame) -> DataFrame:
    """item, start, then term and offset (from the item's first word) of a window's rarest and next rarest word.

    Windows with a word that no document has cannot occur and are left out.  A window of one word has it twice.
    """
    places = items.select("item", "n", F.size("words").alias("length"), F.posexplode("words").alias("place", "term")).join(counts, "term", "left")
    first, last = F.greatest(F.lit(0), F.col("place") - F.col("n") + 1), F.least(F.col("place"), F.col("length") - F.col("n"))
    within = places.select("item", "n", "place", "term", F.coalesce("count", F.lit(0)).alias("count"), F.explode(F.sequence(first, last)).alias("start"))
    ranked = within.groupBy("item", "start").agg(F.slice(F.sort_array(F.collect_list(F.struct("count", "place", "term"))), 1, 2).alias("rare"))
    rare, then = F.col("rare")[0], F.element_at("rare", -1)
    return ranked.where(rare["count"] > 0).select("item", "start", rare["term"].alias("term"), rare["place"].alias("place"), then["term"].alias("next_term"), then["place"].alias("next_place"))


def candidates(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id and its candidates: alignments of items (shift, the words, window starts) that the two rarest terms agree on."""
    vocabulary = items.select(F.explode("words").alias("term")).distinct()
    words = documents.select(F.explode(words_of(F.col("text"))).alias("word")).groupBy("word").count()
    counted = settle(words.withColumn("term", lowered(F.col("word"))).join(vocabulary, "term"), "counts")
    windows = settle(rarest_terms(items, counted.groupBy("term").agg(F.sum("count").alias("count"))), "windows")
    rare = windows.select("term").union(windows.select("next_term")).distinct()
    written = counted.join(rare, "term").select("word", "term")
    postings = settle(
        documents.where(F.col("doc_id").isNotNull()).select("doc_id", F.posexplode(words_of(F.col("text"))).alias("position", "word"))
        .join(written, "word").select("term", "doc_id", "position").sortWithinPartitions("term", "doc_id", "position"), "postings")
    heads = postings.join(windows, "term").select("doc_id", "item", "start", (F.col("position") - F.col("place")).alias("shift"), "next_term", "next_place")
    heads = heads.where(F.col("shift") + F.col("start") >= 0).withColumn("position", F.col("shift") + F.col("next_place"))
    agreed = heads.join(postings.withColumnRenamed("term", "next_term"), ["doc_id", "next_term", "position"], "left_semi")
    aligned = agreed.groupBy("doc_id", "item", "shift").agg(F.sort_array(F.collect_set("start")).alias("starts"))
    return aligned.join(items, "item").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "shift", "starts", "n", "words")).alias("candidates"))


#: Longest run of words by which a rough alignment is looked for.
_SEED = 3


def _edits(n: int, near: float) -> int:
    """How many words a proximity match of n words may differ in."""
    return n - math.ceil(round(near * n, 9))


def _seeds(words: Column, length: int, named: str) -> Column:
    """Place and hash of every run of so many words."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - length + 1), lambda i: F.struct(
        (i - 1).alias(named), F.xxhash64(F.lit(length), F.slice(words, i, length)).alias("seed")))
    return F.when(F.size(words) >= length, runs).otherwise(F.array().cast(f"array<struct<{named}: int, seed: bigint>>"))


def near_candidates(documents: DataFrame, items: DataFrame, window: int, near: float) -> DataFrame:
    """doc_id and its near candidates: rough alignments of items (shift, the words, window starts) that share a run of words."""
    allowed = {n: _edits(n, near) for n in range(1, window + 1)}
    edits = F.element_at(F.create_map(*[F.lit(x) for pair in allowed.items() for x in pair]), F.col("n"))
    lengths = {n: min(_SEED, n // (e + 1)) for n, e in allowed.items() if e}
    held = sorted({lengths[r["n"]] for r in items.select("n").distinct().collect() if r["n"] in lengths and lengths[r["n"]]})
    wanted = items.select("item", "item_id", "words", "n", edits.alias("edits")).where("edits > 0")
    seeded = [wanted.where(F.col("n").isin([n for n, q in lengths.items() if q == length]))
              .select("item", F.lit(length).alias("length"), "n", F.size("words").alias("of"), F.inline(_seeds(F.col("words"), length, "place"))) for length in held]
    nothing = wanted.select("item", F.lit(0).alias("length"), "n", F.lit(0).alias("of"), F.lit(0).alias("place"), F.lit(0).cast("long").alias("seed")).limit(0)
    places = nothing
    for part in seeded:
        places = places.unionByName(part)
    places = settle(places, "near_places")
    split = documents.where(F.col("doc_id").isNotNull()).select("doc_id", words_of(lowered(F.col("text"))).alias("words"))
    seeds = split.select("doc_id", F.inline(F.concat(*[_seeds(F.col("words"), length, "position") for length in held or [_SEED]])))
    hits = seeds.join(places, "seed").select("doc_id", "item", (F.col("position") - F.col("place")).alias("shift"), F.explode(F.sequence(
        F.greatest(F.lit(0), F.col("place") + F.col("length") - F.col("n")), F.least(F.col("place"), F.col("of") - F.col("n")))).alias("start"))
    aligned = hits.groupBy("doc_id", "item", "shift").agg(F.sort_array(F.collect_set("start")).alias("starts"))
    return aligned.join(wanted, "item").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "shift", "starts", "n", "edits", "words")).alias("near_candidates"))


def _distance(wanted: Column, n: Column, span: Column) -> Column:
    """The least number of words changed, inserted or deleted between wanted and any run of words within span."""
    def column(held: Column, word: Column) -> Column:
        step = lambda built, i: F.concat(built, F.array(F.least(
            F.get(held, i - 1) + F.when(F.get(wanted, i - 1) == word, 0).otherwise(1), F.get(held, i) + 1, F.get(built, i - 1) + 1)))
        return F.aggregate(F.sequence(F.lit(1), n), F.array(F.lit(0)), step)

    def read(state: Column, word: Column) -> Column:
        # the new column is made once and read twice
        made = F.transform(F.array(column(state["held"], word)), lambda c: F.struct(c.alias("held"), F.least(state["best"], F.get(c, n)).alias("best")))
        return F.get(made, F.lit(0))

    first = F.struct(F.sequence(F.lit(0), n).alias("held"), n.alias("best"))
    return F.aggregate(span, first, read, lambda state: state["best"])


def matches(documents: DataFrame, benchmark: DataFrame, window: int = 10, near: float | None = 0.8) -> DataFrame:
    """doc_id, n_words, phrases and near_phrases of every row of documents.

    phrases and near_phrases list (start, words, item_id): windows of items found word for word, and
    windows that keep at least the share ``near`` of their words where the others are changed, inserted
    or deleted.  The start of the latter is where a whole part of the window puts it, so a match with
    an insertion or deletion is listed at each such place.  Without ``near`` they are not looked for.
    """
    docs = documents.select("doc_id", "text")
    items = settle(item_windows(benchmark, window), "items")
    both = candidates(docs, items)
    if near is not None:
        both = both.join(near_candidates(docs, items, window, near), "doc_id", "full")
    joined = docs.join(both, "doc_id", "left").select(*both.columns, words_of(lowered(F.col("text"))).alias("words"))

    def found(candidate: Column) -> Column:
        own = lambda start: F.slice(F.col("words"), candidate["shift"] + start + 1, candidate["n"])
        wanted = lambda start: F.slice(candidate["words"], start + 1, candidate["n"])
        return F.transform(candidate["starts"], lambda start: F.struct(
            (candidate["shift"] + start).alias("start"), candidate["n"].alias("words"), candidate["item_id"].alias("item_id"),
            (own(start) == wanted(start)).alias("exact")))

    all_found = F.flatten(F.transform(F.coalesce("candidates", F.array().cast(joined.schema["candidates"].dataType)), found))
    plain = lambda m: F.struct(m["start"].alias("start"), m["words"].alias("words"), m["item_id"].alias("item_id"))

    def around(candidate: Column) -> Column:
        def span(start: Column) -> Column:
            place = candidate["shift"] + start
            first = F.greatest(F.lit(0), place - candidate["edits"])
            return F.slice(F.col("words"), first + 1, place + candidate["n"] + candidate["edits"] - first)
        return F.transform(candidate["starts"], lambda start: F.struct(
            (candidate["shift"] + start).alias("start"), candidate["n"].alias("words"), candidate["item_id"].alias("item_id"), candidate["edits"].alias("edits"),
            F.slice(candidate["words"], start + 1, candidate["n"]).alias("wanted"), span(start).alias("span")))

    phrases = F.array_distinct(F.transform(F.filter(all_found, lambda m: m["exact"]), plain))
    if near is None:
        near_phrases = F.array().cast("array<struct<start: int, words: int, item_id: string>>")
    else:
        rough = F.flatten(F.transform(F.coalesce("near_candidates", F.array().cast(joined.schema["near_candidates"].dataType)), around))
        shared = lambda m: F.size(F.filter(m["wanted"], lambda w: F.array_contains(m["span"], w)))
        likely = F.filter(rough, lambda m: shared(m) >= m["words"] - m["edits"])
        measured = F.transform(likely, lambda m: F.struct(
            m["start"].alias("start"), m["words"].alias("words"), m["item_id"].alias("item_id"), m["edits"].alias("edits"), _distance(m["wanted"], m["words"], m["span"]).alias("distance")))
        near_phrases = F.array_sort(F.array_distinct(F.transform(F.filter(measured, lambda m: (m["distance"] > 0) & (m["distance"] <= m["edits"])), plain)))
    return joined.select("doc_id", F.size("words").cast("long").alias("n_words"), phrases.alias("phrases"), near_phrases.alias("near_phrases"))


def _covered(phrases: Column) -> Column:
    """How many words the phrases cover together."""
    spans = F.sort_array(F.array_distinct(F.transform(phrases, lambda m: F.struct(m["start"].cast("long").alias("start"), (m["start"] + m["words"]).cast("long").alias("end")))))
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("reach"))
    step = lambda held, s: F.struct(
        (held["sum"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(s["start"], held["reach"]))).alias("sum"), F.greatest(held["reach"], s["end"]).alias("reach"))
    return F.aggregate(spans, zero, step)["sum"]


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = 10, near: float | None = 0.8) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near of every row.

    Words: A-Z lower-cased, runs of digits, letters and characters beyond ASCII.  An item of fewer
    words than ``window`` is one window; one without words is none.  A word inside any occurrence of
    a window is hit.  Null and empty texts have no words.  Items without item_id hit words but are
    not listed; equal items are all listed.  Rows with one doc_id are judged each by their own
    text.  Rows without doc_id are not looked up: they have no hits.  n_near counts the proximity
    matches that ``matches`` lists; it is 0 if ``near`` is None.
    """
    ids = F.array_sort(F.array_distinct(F.filter(F.transform("phrases", lambda m: m["item_id"]), lambda i: i.isNotNull())))
    found = matches(documents, benchmark, window, near).select(
        "doc_id", "n_words", _covered(F.col("phrases")).alias("n_hit"), ids.alias("items"), F.size("near_phrases").cast("long").alias("n_near"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"), "n_near")
