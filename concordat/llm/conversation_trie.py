"""The prefix trie of conversations: a node for each distinct sequence of first turns.

Truncation peeling.  Conversations are cut back from the deepest turn.  What is alive at a depth are the
conversations that end there, equal ones merged into one entry with a count, and the nodes one turn
deeper, stripped of that turn.  Entries with the same prefix are one node: its counts are sums over them.
A round strips a whole band of turns.  Within a band, each node belongs to the entry with the smallest
conv_id, so what lies below is a running sum along each entry's turns, and adds up by node.
Bands double in width, so a trie of depth d takes log2(d) rounds, and what a round carries on is one entry a node.

A prefix is its depth and two 60-bit values: the exclusive or over its turns of a hash of depth, role and
text.  Both it and the numbers of turns are running values in two levels (blocks of turns, then within a
block), so neither a conversation nor a node that holds any share of the rows is ever gathered.

Order: by turn, nulls first; turns of one number by the MD5 of role and text.  Null role or text is an
empty one.  Rows without conv_id belong to no conversation and take no part.  Without conversations there
is no node, not even the root.  Repeated rows are turns like others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordat.llm.common import joined_sha256
from concordat.session import settle, shared_folder

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of a turn's number within its block, and of a conv_id within those that are joined before they are hashed.
BLOCK, IDS = 10, 12
#: Depth of the first band; each further band is as deep as all before it.
FIRST_BAND = 8
_FIRST_BITS = (FIRST_BAND - 1).bit_length()
NODE = ["depth", "high", "low"]


def _half(digest: Column, half: int) -> Column:
    return F.conv(F.substring(digest, 1 + 15 * half, 15), 16, 10).cast("long")


def turns_of(conversations: DataFrame) -> DataFrame:
    """Light rows (conv_id, turn, said, words): no text, only what is needed of it."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    return conversations.where("conv_id is not null").select("conv_id", "turn", said.alias("said"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))


def _running(rows: DataFrame, block: Column, order: list[str], totals: dict[str, Column], running: Callable[[str, Column | None, Window], Column]) -> DataFrame:
    """Running values over each conversation's rows, in two levels.

    ``totals`` aggregates a block by name; ``running(name, before, window)`` makes the value of a row from
    what precedes its block and the window within it.
    """
    placed = rows.withColumn("block", block)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("conv_id", "block").agg(*[total.alias(name) for name, total in totals.items()])
    offsets = sums.select(F.col("conv_id").alias("of"), F.col("block").alias("in_block"), *[running(name, None, before).alias(f"before_{name}") for name in totals])
    both = placed.join(offsets, (F.col("conv_id") == F.col("of")) & F.col("block").eqNullSafe(F.col("in_block")))
    within = Window.partitionBy("conv_id", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return both.select(*rows.columns, *[running(name, F.col(f"before_{name}"), within).alias(name) for name in totals])


def numbered(turns: DataFrame) -> DataFrame:
    """Turns with their place in the conversation, from 1."""

    def place(name: str, before: Column | None, window: Window) -> Column:
        return F.coalesce(F.sum(name).over(window), F.lit(0)) if before is None else before + F.row_number().over(window)

    # a block of turns without number holds those whose hash starts alike, in order of the hash
    block = F.when(F.col("turn").isNull(), F.conv(F.left("said", F.lit(3)), 16, 10).cast("long") - (1 << 62)).otherwise(F.shiftright("turn", BLOCK))
    return _running(turns, block, ["turn", "said"], {"place": F.count("*")}, place)


def rebuilt(turns: DataFrame, group: int, head: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """Conversations that start with the first turns of their group's first one: (conv_id, depth, said, words) and (conv_id, length).

    ``head(conv_id)`` is how many turns a conversation takes from there; it leaves out as many of its own.
    """
    placed = settle(numbered(turns), "turns")
    sizes = placed.groupBy("conv_id").agg(F.count("*").alias("own"))
    whole = sizes.withColumns({"base": F.col("conv_id") - F.col("conv_id") % group, "takes": head(F.col("conv_id")).cast("long")})
    bases = sizes.select(F.col("conv_id").alias("of"), F.col("own").alias("base_turns"))
    taken = F.least("takes", F.coalesce("base_turns", F.lit(0)))
    whole = whole.join(bases, F.col("base") == F.col("of"), "left").select("conv_id", "base", "takes", "own", taken.alias("taken"))
    lengths = settle(whole.withColumn("length", F.col("taken") + F.greatest(F.lit(0), F.col("own") - F.col("takes"))), "lengths")
    most = lengths.agg(F.max("taken")).first()[0] or 0
    firsts = placed.where((F.col("conv_id") % group == 0) & (F.col("place") <= most)).select(F.col("conv_id").alias("of"), F.col("place").alias("depth"), "said", "words")
    heads = lengths.join(firsts, (F.col("base") == F.col("of")) & (F.col("depth") <= F.col("taken"))).select("conv_id", "depth", "said", "words")
    shifts = lengths.where("own > takes").select(F.col("conv_id").alias("of"), "takes", "taken")
    tails = placed.join(shifts, (F.col("conv_id") == F.col("of")) & (F.col("place") > F.col("takes"))).select("conv_id", (F.col("place") - F.col("takes") + F.col("taken")).alias("depth"), "said", "words")
    return heads.unionByName(tails), lengths.select("conv_id", "length")


def _prefixes(turns: DataFrame) -> DataFrame:
    """Turns with the prefix that ends with them (high, low) and the one before (high_up, low_up)."""
    turn = F.sha2(F.concat_ws(":", F.col("depth").cast("string"), "said"), 256)
    own = turns.select("conv_id", "depth", "words", _half(turn, 0).alias("own_high"), _half(turn, 1).alias("own_low"))

    def mixed(name: str, before: Column | None, window: Window) -> Column:
        return F.coalesce(F.bit_xor(name).over(window), F.lit(0)) if before is None else before.bitwiseXOR(F.bit_xor(f"own_{name}").over(window))

    run = _running(own, F.shiftright("depth", BLOCK), ["depth"], {"high": F.bit_xor("own_high"), "low": F.bit_xor("own_low")}, mixed)
    return run.select("conv_id", "depth", "words", "high", "low", *[F.col(h).bitwiseXOR(F.col(f"own_{h}")).alias(f"{h}_up") for h in ("high", "low")])


def _band(depth: Column) -> Column:
    """0 up to FIRST_BAND, then one more each time the depth doubles."""
    return F.greatest(F.lit(0), F.length(F.bin(depth - 1)) - _FIRST_BITS)


def _strip(entries: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of a band from what is alive at its deep end or ends within it.

    entries: conv_id (the smallest one), ends (depth), n_convs, and for nodes stripped of a turn
    (``stripped``) their n_leaves and saved_tokens.  turns: the band's turns with their prefixes.
    """
    named = entries.select(F.col("conv_id").alias("entry"), "ends", "stripped", F.col("n_convs").alias("here"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    paths = settle(turns.join(named, (F.col("conv_id") == F.col("entry")) & (F.col("depth") <= F.col("ends"))).drop("conv_id"), "paths")
    # written, so that the join with it is dealt anew and a node that many entries share can be split
    merged = settle(paths.groupBy(*NODE).agg(F.min("entry").alias("conv_id"), F.sum("here").alias("n_convs")), "merged")
    shared = merged.select(*[F.col(c).alias(f"of_{c}") for c in NODE], "conv_id", "n_convs")
    both = paths.join(shared, [F.col(c) == F.col(f"of_{c}") for c in NODE])
    deep = Window.partitionBy("entry").orderBy(F.desc("depth"))
    owned = F.col("entry") == F.col("conv_id")
    summed = both.select(
        *NODE, "high_up", "low_up", "conv_id", "n_convs", "words",
        # the node below on this path is this entry's: counted once among the children
        F.when(F.col("depth") == F.col("ends"), F.col("stripped")).otherwise(F.lag(owned.cast("long")).over(deep)).alias("child"),
        F.when(F.col("stripped") == 1, F.col("leaves")).otherwise((F.first("n_convs").over(deep) == F.col("here")).cast("long")).alias("leaves"),
        (F.col("saved") + F.sum(F.when(owned, (F.col("n_convs") - 1) * F.col("words")).otherwise(0)).over(deep)).alias("saved"),
    )
    return summed.groupBy(*NODE).agg(
        F.first("high_up").alias("high_up"), F.first("low_up").alias("low_up"), F.first("conv_id").alias("conv_id"), F.first("n_convs").alias("n_convs"),
        F.sum("child").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def _ended_ids(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at a node; ids of a block are joined first, blocks then pass in order."""
    block = F.shiftright("conv_id", IDS)
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    pieces = ends.groupBy(*NODE, block.alias("block")).agg(ids.alias("ids"))
    return joined_sha256(pieces.repartition(*NODE).sortWithinPartitions(*NODE, "block"), NODE, "ids", ",", "ends_sha256")


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """The nodes over conversations given by turns (conv_id, depth, said, words) and lengths (conv_id, length; 0: no turns)."""
    spark = turns.sparkSession
    folder = shared_folder(spark, "prefixes")
    prefixes = _prefixes(turns).withColumn("band", _band(F.col("depth")))
    prefixes.write.partitionBy("band").parquet(folder)
    stored = spark.read.schema(prefixes.schema).parquet(folder)
    last = stored.select(F.col("conv_id").alias("of"), "depth", "high", "low").join(lengths, (F.col("conv_id") == F.col("of")) & (F.col("depth") == F.col("length")))
    none = lengths.where("length = 0").select("conv_id", *[F.lit(0).cast("long").alias(c) for c in NODE])
    ends = settle(last.select("conv_id", F.col("depth").cast("long").alias("depth"), "high", "low").unionByName(none), "ends")
    ended = settle(ends.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")), "ended").select(
        "conv_id", F.col("depth").alias("ends"), F.lit(0).cast("long").alias("stripped"), "n_convs", F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))

    def stripped(nodes: DataFrame, depth: int) -> DataFrame:
        return nodes.where(F.col("depth") == depth).select("conv_id", F.lit(depth - 1).cast("long").alias("ends"), F.lit(1).cast("long").alias("stripped"), "n_convs", "n_leaves", "saved_tokens")

    deepest = lengths.agg(F.max("length")).first()[0] or 0
    found, alive = [], None
    for band in reversed(range(max((deepest - 1).bit_length() - _FIRST_BITS, 0) + 1 if deepest else 0)):
        low, high = (FIRST_BAND << band - 1 if band else 0), FIRST_BAND << band
        entries = ended.where((F.col("ends") > low) & (F.col("ends") <= high))
        entries = entries if alive is None else entries.unionByName(stripped(alive, high + 1))
        alive = settle(_strip(entries, stored.where(F.col("band") == band).drop("band")), "nodes")
        found.append(alive)
    entries = ended.where("ends = 0")
    entries = entries if alive is None else entries.unionByName(stripped(alive, 1))
    zero = F.lit(0).cast("long")
    root = entries.agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("stripped").alias("n_children"), F.sum("n_leaves").alias("below"), F.sum("saved_tokens").alias("saved_tokens")).where("n_convs > 0")
    nodes = root.select(*[zero.alias(c) for c in NODE], *[F.lit(None).cast("long").alias(c) for c in ("high_up", "low_up")], "conv_id", "n_convs", "n_children", F.greatest("below", F.lit(1)).alias("n_leaves"), "saved_tokens")
    for band in found:
        nodes = nodes.unionByName(band)
    nodes = settle(nodes, "trie")
    parents = nodes.select((F.col("depth") + 1).alias("of_depth"), F.col("high").alias("of_high"), F.col("low").alias("of_low"), F.col("conv_id").alias("parent_conv_id"))
    hashed = _ended_ids(ends).toDF(*[f"end_{c}" for c in NODE], "ends_sha256")
    both = nodes.join(parents, (F.col("depth") == F.col("of_depth")) & (F.col("high_up") == F.col("of_high")) & (F.col("low_up") == F.col("of_low")), "left")
    both = both.join(hashed, [F.col(c) == F.col(f"end_{c}") for c in NODE], "left")
    return both.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
