"""Quotes and the passages that hold them (C9), by anchors instead of text against text.

All readings of a text (as it stands, with ASCII punctuation, without layout marks, with single blanks)
have the same words: runs of letters and digits.  A passage that holds a quote has the words
inside the quote next to each other, so it has each pair of them.  Words and pairs of the chunks meet
those of the document's quotes in an equi-join; a quote then looks only where its rarest pair
stands, and one that misses a pair is nowhere.  So a document of any number of chunks and quotes is
spread over tasks, and only chunks that may hold a quote are read for it.

A quote that runs over several chunks is found the same way: pairs across a border are posted too,
and the chunks around the anchor that its words can reach are put together.  Quotes of one or two
words have no word inside; they are met with the chunks of their document in blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordat.functions import text as T
from concordat.operators.ingest import text_at_offsets
from concordat.session import settle

WORD = r"[\p{L}\p{N}]+"
BLOCK = 256  # short quotes that a chunk meets at once
SEEDS = 4096  # wanted seeds that a chunk meets at once, about
READINGS = ["text", "plain", "bare", "words", "bare_words"]
QUOTE = ["document_id", "quote"]


def with_readings(rows: DataFrame, source: str, prefix: str, holding: str | None = None) -> DataFrame:
    """Columns `prefix` + reading; each fold is computed once, and not at all for a text that holds another as it stands."""
    name = lambda reading: f"{prefix}{reading}"
    plain = T.fold_typography(name("text"))
    if holding is not None:
        plain = F.when(~F.col(name("text")).contains(F.col(holding)), plain)
    return (
        rows.withColumn(name("text"), F.col(source))
        .withColumn(name("plain"), plain)
        .withColumn(name("bare"), T.fold_markdown(name("plain")))
        .withColumn(name("words"), T.squash(name("plain")))
        .withColumn(name("bare_words"), T.squash(name("bare")))
    )


def _reading(prefix: str) -> dict[str, Column]:
    return {r: F.col(f"{prefix}{r}") for r in READINGS}


def strictness(passage, quote) -> Column:
    """0 as it stands, 1 with ASCII punctuation, 2 by words, 3 by words without layout marks; NULL if not held."""
    return (
        F.when(passage["text"].contains(quote["text"]), 0)
        .when(passage["plain"].contains(quote["plain"]), 1)
        .when((quote["words"] != "") & passage["words"].contains(quote["words"]), 2)
        .when((quote["bare_words"] != "") & passage["bare_words"].contains(quote["bare_words"]), 3)
    )


def _pattern(words: Column) -> Column:
    """A regex for words (one blank between them) with any whitespace between them."""
    literal = F.replace(words, F.lit(r"\E"), F.lit(r"\E\\E\Q"))
    gap = F.lit(rf"\E{T.SPACE}+\Q")
    return F.concat(F.lit(r"\Q"), F.replace(literal, F.lit(" "), gap), F.lit(r"\E"))


def span(passage, quote, by: Column) -> Column:
    """(offset, length) of a quote in a passage that holds it by a reading."""
    def located(text: Column, part: Column) -> Column:
        return F.struct((F.instr(text, part) - 1).alias("offset"), F.length(part).alias("length"))

    def worded(text: Column, words: Column) -> Column:
        return located(text, F.regexp_substr(text, _pattern(words)))

    return (
        F.when(by == 0, located(passage["text"], quote["text"])).when(by == 1, located(passage["plain"], quote["plain"]))
        .when(by == 2, worded(passage["plain"], quote["words"])).when(by == 3, worded(passage["bare"], quote["bare_words"]))
    )


def _words(text: Column | str) -> Column:
    return F.regexp_extract_all(T.fold_typography(text), F.lit(WORD), F.lit(0))


def _pairs(words: str) -> Column:
    """Hashes of neighbouring words; the last word has no neighbour and stands alone."""
    return F.zip_with(F.col(words), F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), lambda a, b: F.xxhash64(a, b))


def chunk_index(chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks by document_id, ordinal and group; their seeds, an array a chunk; seeds over borders).

    Groups number the chunks that have words; a chunk without belongs to the one before it.  A seed is a
    word or a pair of neighbours.
    """
    read = settle(chunks.select("document_id", "ordinal", _words("text").alias("tokens")), "tokens")
    in_order = Window.partitionBy("document_id").orderBy("ordinal")
    edges = read.select("document_id", "ordinal", F.get("tokens", F.lit(0)).alias("first"), F.try_element_at("tokens", F.lit(-1)).alias("last"))
    placed = settle(edges.withColumn("group", F.count("first").over(in_order)), "groups")
    after = Window.partitionBy("document_id").orderBy("group")
    borders = placed.filter(F.col("first").isNotNull()).withColumn("next", F.lead("first").over(after)).filter(F.col("next").isNotNull()).select(
        "document_id", "ordinal", "group", F.xxhash64("last", "next").alias("seed"))
    own = read.select("document_id", "ordinal", F.concat(F.transform("tokens", lambda w: F.xxhash64(w)), _pairs("tokens")).alias("seeds"))
    return placed.select("document_id", "ordinal", "group"), own, borders


def _postings(index: tuple[DataFrame, DataFrame, DataFrame], wanted: DataFrame) -> DataFrame:
    """Where wanted seeds (document_id, seed) stand: document_id, seed, ordinal, group, inside.

    A chunk meets the wanted seeds of its document in blocks, array against array, so that only those
    that are wanted become rows.
    """
    groups, own, borders = index
    n = F.count("*").over(Window.partitionBy("document_id"))
    blocks = wanted.withColumn("block", F.pmod("seed", 1 + F.floor(n / SEEDS))).groupBy("document_id", "block").agg(F.collect_list("seed").alias("wanted"))
    met = own.join(blocks, "document_id").select("document_id", "ordinal", F.explode(F.array_intersect("seeds", "wanted")).alias("seed"))
    inside = met.join(groups, ["document_id", "ordinal"]).select("document_id", "seed", "ordinal", "group", F.lit(True).alias("inside"))
    across = borders.join(wanted, ["document_id", "seed"], "left_semi").select("document_id", "seed", "ordinal", "group", F.lit(False).alias("inside"))
    return inside.unionByName(across)


def quote_seeds(quotes: DataFrame) -> DataFrame:
    """(document_id, quote, n_words, seed, place): pairs of words inside a quote, or its one inner word."""
    read = quotes.withColumn("tokens", _words("quote"))
    inner = read.select(*QUOTE, F.size("tokens").alias("n_words"), F.slice("tokens", F.lit(2), F.greatest(F.size("tokens") - 2, F.lit(0))).alias("inner"))
    several = F.size("inner") > 1
    pairs = _pairs("inner")
    seeds = F.when(several, F.slice(pairs, F.lit(1), F.greatest(F.size("inner") - 1, F.lit(0)))).otherwise(F.transform("inner", lambda w: F.xxhash64(w)))
    return inner.select(*QUOTE, "n_words", F.posexplode_outer(seeds).alias("place", "seed")).withColumn("place", F.col("place") + 1)


def _held(pairs: DataFrame, order: list[str]) -> DataFrame:
    """Of (quote, passage) rows with their readings those that hold, with by, offset and length; the first per quote by `order`."""
    passage, quote = _reading("p_"), _reading("q_")
    found = pairs.withColumn("by", strictness(passage, quote)).filter(F.col("by").isNotNull())
    placed = found.withColumn("span", span(passage, quote, F.col("by")))
    answer = F.struct((F.col("base") + F.col("span.offset")).alias("char_start"), F.col("span.length").alias("length"), "ordinal")
    return placed.select(*QUOTE, answer.alias("answer"), *order).groupBy(*QUOTE).agg(F.min_by("answer", F.struct(*order)).alias("answer"))


def _meet(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """Candidates (document_id, quote, ordinal) with the readings of both."""
    texts = chunks.select("document_id", "ordinal", "text", F.col("char_start").alias("base"))
    both = candidates.join(texts, ["document_id", "ordinal"])
    return with_readings(with_readings(both, "text", "p_", "quote"), "quote", "q_").drop("text")


def _regions(candidates: DataFrame, groups: DataFrame, chunks: DataFrame, key: list[str]) -> DataFrame:
    """The chunks of groups low to high put together: `key`, base, text, holders (ordinal, char_start, char_end)."""
    wanted = candidates.select(*key, F.explode(F.sequence(F.greatest("low", F.lit(0)), F.col("high"))).alias("group"))
    own = wanted.join(groups, ["document_id", "group"]).join(chunks.select("document_id", "ordinal", "text", "char_start", "char_end"), ["document_id", "ordinal"])
    rows = own.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("ordinal", "text", "char_start", "char_end"))).alias("near"))
    base = F.get("near", F.lit(0))["char_start"]
    moved = F.transform(F.arrays_zip("near", F.array_repeat(base, F.size("near")).alias("base")), lambda c: F.struct(
        c["near"]["ordinal"].alias("ordinal"), c["near"]["text"].alias("text"),
        (c["near"]["char_start"] - c["base"]).alias("char_start"), (c["near"]["char_end"] - c["base"]).alias("char_end")))
    return rows.withColumn("base", base).withColumn("moved", moved).select(
        *key, "base", text_at_offsets(F.col("moved")).alias("text"),
        F.transform("near", lambda c: F.struct(c["ordinal"].alias("ordinal"), c["char_start"].alias("char_start"), c["char_end"].alias("char_end"))).alias("holders"))


def _held_across(pairs: DataFrame) -> DataFrame:
    """The strictest, then first place of each quote in the regions it may lie in."""
    passage, quote = _reading("p_"), _reading("q_")
    found = pairs.withColumn("by", strictness(passage, quote)).filter(F.col("by").isNotNull()).withColumn("span", span(passage, quote, F.col("by")))
    start = F.col("base") + F.col("span.offset")
    placed = found.select(*QUOTE, "by", start.alias("char_start"), F.col("span.length").alias("length"), "holders").withColumn(
        "place", F.array_repeat("char_start", F.size("holders")))
    holder = F.get(F.filter(F.arrays_zip("holders", "place"), lambda h: (h["holders"]["char_start"] <= h["place"]) & (h["place"] < h["holders"]["char_end"])), F.lit(0))
    answer = F.struct("char_start", "length", holder["holders"]["ordinal"].alias("ordinal"))
    return placed.select(*QUOTE, answer.alias("answer"), "by", "char_start").groupBy(*QUOTE).agg(F.min_by("answer", F.struct("by", "char_start")).alias("answer"))


def _by_anchors(quotes: DataFrame, chunks: DataFrame, index: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    groups = index[0]
    asked = settle(quote_seeds(quotes), "quote_seeds")
    wanted = settle(asked.select("document_id", "seed").distinct(), "wanted")
    postings = settle(_postings(index, wanted), "postings")
    counts = postings.groupBy("document_id", "seed").agg(F.count("*").alias("n"), F.count_if("inside").alias("n_inside"))
    counted = asked.join(counts, ["document_id", "seed"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n", "n_inside")})
    seed = F.struct("seed", "place", "n_words")
    best = settle(counted.groupBy(*QUOTE).agg(
        F.min("n").alias("least"), F.min_by(seed, F.struct("n", "place")).alias("any"),
        F.min("n_inside").alias("least_inside"), F.min_by(seed, F.struct("n_inside", "place")).alias("in")), "rarest")
    inside = best.filter("least_inside > 0").select(*QUOTE, F.col("in.seed").alias("seed"))
    candidates = settle(inside.join(postings.filter("inside").select("document_id", "seed", "ordinal"), ["document_id", "seed"]).drop("seed"), "candidates")
    firsts = candidates.groupBy(*QUOTE).agg(F.min("ordinal").alias("ordinal"))
    at_first = settle(_held(_meet(firsts, chunks), ["ordinal"]), "at_first")
    others = candidates.join(firsts, [*QUOTE, "ordinal"], "left_anti").join(at_first, QUOTE, "left_anti")
    found = at_first.unionByName(settle(_held(_meet(others, chunks), ["ordinal"]), "further_on"))
    # what no chunk holds alone: around the rarest pair, as far as the quote's words reach, and the chunks beside for its marks
    missed = best.filter("least > 0").join(found, QUOTE, "left_anti").select(*QUOTE, F.col("any.seed").alias("seed"), F.col("any.place").alias("place"), F.col("any.n_words").alias("n_words"))
    around = missed.join(postings.select("document_id", "seed", "group").distinct(), ["document_id", "seed"]).select(
        *QUOTE, (F.col("group") - F.col("place") - 1).alias("low"), (F.col("group") + F.col("n_words") - F.col("place")).alias("high"))
    regions = _regions(around, groups, chunks, [*QUOTE, "low", "high"])
    across = _held_across(with_readings(with_readings(regions, "text", "p_", "quote"), "quote", "q_").drop("text"))
    return found.unionByName(across)


def _in_blocks(quotes: DataFrame, chunks: DataFrame, groups: DataFrame) -> DataFrame:
    """Quotes of one or two words against all chunks of their document, a block of quotes at a time."""
    def blocks(rows: DataFrame) -> DataFrame:
        read = with_readings(rows.select(*QUOTE), "quote", "q_")
        number = F.row_number().over(Window.partitionBy("document_id").orderBy("quote"))
        quote = F.struct("quote", *[F.col(f"q_{r}").alias(r) for r in READINGS])
        return read.withColumn("block", F.floor(number / BLOCK)).groupBy("document_id", "block").agg(F.collect_list(quote).alias("asked"))

    def met(passages: DataFrame, rows: DataFrame, keep: list[str]) -> DataFrame:
        # a passage's readings are an array of one, so that they are not computed again for every quote
        passage = F.struct(*[F.col(f"p_{r}").alias(r) for r in READINGS])
        read = with_readings(passages, "text", "p_").select("document_id", *keep, F.array(passage).alias("passage"))
        both = read.join(blocks(rows), "document_id")
        hits = F.flatten(F.transform("passage", lambda p: F.filter("asked", lambda a: strictness(p, a).isNotNull())))
        found = both.select("document_id", *keep, F.get("passage", F.lit(0)).alias("p"), F.explode(hits).alias("a"))
        return found.select("document_id", "a.quote", *keep, *[F.col(f"p.{r}").alias(f"p_{r}") for r in READINGS], *[F.col(f"a.{r}").alias(f"q_{r}") for r in READINGS])

    inside = settle(_held(met(chunks.select("document_id", "ordinal", "text", F.col("char_start").alias("base")), quotes, ["ordinal", "base"]), ["ordinal"]), "short")
    missed = settle(quotes.join(inside, QUOTE, "left_anti"), "missed")
    if missed.isEmpty():
        return inside
    of_missed = groups.join(missed.select("document_id").distinct(), "document_id", "left_semi")
    pairs = of_missed.select("document_id", (F.col("group") - 1).alias("low"), (F.col("group") + 2).alias("high")).distinct()
    regions = _regions(pairs, groups, chunks, ["document_id", "low", "high"])
    return inside.unionByName(_held_across(met(regions, missed, ["base", "holders"])))


def locate(facts: DataFrame, chunks: DataFrame) -> DataFrame:
    """Facts with char_start, char_end and chunk_ordinal, NULL where the quote is nowhere.

    Each quote is searched for in the chunks of its document in order, then over chunk borders, where
    the strictest reading counts before the place.
    """
    asked = settle(facts.select(*QUOTE).distinct().withColumn("n_words", F.size(_words("quote"))), "quotes")
    own = chunks.join(asked.select("document_id").distinct(), "document_id", "left_semi")
    index = chunk_index(own)
    answers = _by_anchors(asked.filter("n_words > 2").select(*QUOTE), own, index)
    short = asked.filter("n_words <= 2").select(*QUOTE)
    if not short.isEmpty():
        answers = answers.unionByName(_in_blocks(short, own, index[0]))
    both = facts.join(answers, QUOTE, "left")
    rest = [c for c in facts.columns if c != "document_id"]
    return both.select(
        "document_id", *rest, F.col("answer.char_start").alias("char_start"),
        (F.col("answer.char_start") + F.col("answer.length")).alias("char_end"), F.col("answer.ordinal").alias("chunk_ordinal"))
