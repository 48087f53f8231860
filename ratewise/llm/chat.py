"""Operator 1: chat formatting with cumulative-snapshot collapse.

Chat logs often hold a conversation several times, each time a turn longer.
A rolling hash over its first turns names every prefix of a conversation; a
conversation whose whole hash is a proper prefix of another one, or that
repeats another one, is dropped by an anti-join.  What stays is rendered.

Only DataFrame functions run here.  A turn's hash holds its number, and a
prefix hash is the sum of its turns' hashes, so it needs no order within a
task: totals of chunks of turns are summed first, then turns inside a chunk.
A conversation of any length is therefore spread over tasks, and is rendered
in parts of a fixed number of turns.  Prefix hashes are made distinct before
they are joined, so a first turn that all conversations share is one row.
Hashes of turns are written once in the shared folder, so texts are read for
them once; rendered text is not shuffled again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewise.sinks.io import materialize

#: Turns whose prefix sums, or whose rendering, are made in one task.
CHUNK = 256


def _hash(seed: str) -> Column:
    """64 bits of a row's turn number, role and text; nulls differ from empty
    texts.  Decimal, so that sums of any length neither wrap nor fail."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in ("turn", "role", "text")]
    sized = [F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts]
    return F.xxhash64(F.lit(seed), *sized).cast("decimal(20,0)")


def turn_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, h1, h2, rows): one row per conversation and turn number;
    repeated rows of a turn count once."""
    return (turns.select("conv_id", "turn", _hash("a").alias("h1"), _hash("b").alias("h2"))
            .groupBy("conv_id", "turn", "h1", "h2").agg(F.lit(1).alias("one"))
            .groupBy("conv_id", "turn").agg(F.sum("h1").alias("h1"), F.sum("h2").alias("h2")))


def prefix_hashes(hashes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, turn, n, p1, p2, last): the hash of turns up to this one."""
    part = F.floor(F.col("turn") / chunk)
    hashes = hashes.withColumn("part", part)
    inside = Window.partitionBy("conv_id", "part").orderBy("turn")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("conv_id").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    sums = hashes.groupBy("conv_id", "part").agg(F.sum("h1").alias("s1"), F.sum("h2").alias("s2"), F.count("*").alias("c"))
    zero = F.lit(0)
    offsets = sums.select("conv_id", "part", "c", *[F.coalesce(F.sum(c).over(before), zero).alias("o_" + c) for c in ("s1", "s2", "c")],
                          F.coalesce(F.sum("c").over(after), zero).alias("later"))
    rolled = hashes.select("conv_id", "part", "turn", F.sum("h1").over(inside).alias("h1"), F.sum("h2").over(inside).alias("h2"),
                           F.row_number().over(inside).alias("i"))
    return (rolled.join(offsets, ["conv_id", "part"])
            .select("conv_id", "turn", (F.col("i") + F.col("o_c")).cast("long").alias("n"),
                    (F.col("h1") + F.col("o_s1")).cast("decimal(38,0)").alias("p1"),
                    (F.col("h2") + F.col("o_s2")).cast("decimal(38,0)").alias("p2"),
                    ((F.col("later") == 0) & (F.col("i") == F.col("c"))).alias("last")))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies): conversations that are no proper prefix of
    another one, the smallest id of those with equal turns, and how many
    logged conversations say just the same."""
    key = ["n", "p1", "p2"]
    prefixes = prefix_hashes(materialize(turn_hashes(turns), "turn-hashes"))
    whole = prefixes.where("last").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    inner = prefixes.where("NOT last").select(*key).distinct()
    return whole.join(inner, key, "left_anti").select("conv_id", F.col("n").alias("n_turns"), "copies")


def render(turns: DataFrame, start: str = "<|im_start|>", end: str = "<|im_end|>", chunk: int = CHUNK,
           also: tuple[str, ...] = ()) -> DataFrame:
    """(conv_id, part, text, columns ``also`` of the conversation): turns by
    number, role and text, each as start, role, line feed, text, end, line feed.
    Delimiters inside a text are defused by a space after their ``<``.  Part k
    holds the turns numbered k * chunk and up; repeated rows of a turn are
    written once."""
    clean = lambda c: F.replace(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit(start), F.lit("< " + start[1:])),
                                F.lit(end), F.lit("< " + end[1:]))
    line = F.concat(F.lit(start), clean("role"), F.lit("\n"), clean("text"), F.lit(end + "\n"))
    said = F.struct("turn", F.coalesce("role", F.lit("")).alias("r"), F.coalesce("text", F.lit("")).alias("t"), line.alias("line"))
    ordered = F.array_sort(F.collect_set(said))
    return (turns.groupBy("conv_id", *also, F.floor(F.col("turn") / chunk).alias("part"))
            .agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "").alias("text")))


def collapse_and_render(conversations: DataFrame) -> DataFrame:
    """The maximal conversations of (conv_id, turn, role, text), rendered.

    Returns conv_id, part, n_turns (distinct turn numbers), copies, text and
    n_chars.  Rows with a null conv_id or turn belong to no conversation and
    are left out; null roles and texts differ from empty ones in the hashes
    and are rendered as empty.  Two different rows under one turn number both
    belong to that turn.  An empty table gives an empty result; other columns
    are not looked at."""
    turns = conversations.select("conv_id", "turn", "role", "text").where("conv_id IS NOT NULL AND turn IS NOT NULL")
    kept = maximal_conversations(turns)
    said = render(turns.join(kept, "conv_id"), also=("n_turns", "copies"))
    return (said.select("conv_id", "part", "n_turns", "copies", "text", F.char_length("text").cast("long").alias("n_chars")))
