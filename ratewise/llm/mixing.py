"""Operator 10: mixing sources to target weights by Poisson replication.

Every document is repeated a Poisson number of times whose mean is its
source's repetition rate: target share * total / size of the source.  The
number comes from inverting the Poisson distribution at a uniform value hashed
from seed and id, so a rerun or a retried task draws the same number.

Only DataFrame functions run here.  Targets are the sources present, in equal
parts, or named weights.  Sizes and rates are a table with a row per source,
written and joined: the planner broadcasts it if it is small, and splits a hot
source if it is not.  A large mean is a sum of draws of small means, each with
a hash of its own, so no distribution is ever longer than ``STEPS``; draws and
copies are exploded one after the other.  The one shuffle of texts is the
global one, keyed by a hash of seed, id and copy.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewise.sinks.io import materialize

#: Largest mean of one draw, and the steps of its distribution: beyond them
#: doubles do not tell the probability from 1.
MEAN, STEPS = 16.0, 128
#: Draws of a document that one array holds; further ones come from further rows.
DRAWS = 4096
#: What a draw adds to the numbers of its copies, more than it can give.
STRIDE = 1000


def uniform(seed: int, *cols: Column) -> Column:
    """A value in [0, 1) hashed from seed and columns, as texts without the
    null ones (52 bits of md5)."""
    text = F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def poisson_count(u: Column, mean: Column) -> Column:
    """The smallest k with P(X <= k) > u, for a mean of at most ``MEAN``: how
    many of the steps of the distribution lie at or under u."""
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), first.alias("cdf"), F.when(first <= u, 1).otherwise(0).alias("n"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * mean / k
        cdf = s["cdf"] + p
        under = (cdf <= u) & (cdf > s["cdf"])  # it has not come to a stop
        return F.struct(p.alias("p"), cdf.alias("cdf"), (s["n"] + F.when(under, 1).otherwise(0)).alias("n"))

    enough = F.least(F.lit(STEPS), F.ceil(mean + 12 * F.sqrt(mean) + 24).cast("int"))
    count = F.aggregate(F.sequence(F.lit(1), enough), start, step, lambda s: s["n"])
    return F.when(mean > 0, count).otherwise(0)


def repetition_rates(docs: DataFrame, targets: Mapping[str, float] | None = None, total: float | None = None) -> DataFrame:
    """(source, rate): mean copies per document of each source that ``targets``
    names (default: of all that are not null, equally), so that its expected
    share of ``total`` characters (default: as many as go in) is its share of
    the weights of the sources with text.  A source without text, or with a
    weight of 0, has the rate 0."""
    size = F.sum(F.coalesce(F.char_length("text"), F.lit(0)).cast("long")).alias("size")
    sizes = docs.where(F.col("source").isNotNull()).groupBy("source").agg(size)
    if targets is None:
        sizes = sizes.withColumn("weight", F.lit(1.0))
    else:
        named = docs.sparkSession.createDataFrame([(s, float(w)) for s, w in targets.items()], "source string, weight double")
        sizes = sizes.join(named, "source")
    sizes = materialize(sizes.withColumn("weight", F.when((F.col("size") > 0) & (F.col("weight") > 0), F.col("weight"))), "source-sizes")
    sums = sizes.agg(F.sum("weight").alias("weights"), F.sum("size").alias("sizes"))  # one row
    rate = F.col("weight") / F.col("weights") * (F.col("sizes") if total is None else F.lit(float(total))) / F.col("size")
    return materialize(sizes.crossJoin(F.broadcast(sums)).select("source", F.coalesce(rate, F.lit(0.0)).alias("rate")), "source-rates")


def mix_sources(docs: DataFrame, targets: Mapping[str, float] | None = None, seed: int = 42,
                total_chars: float | None = None) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) repeated and shuffled.

    All columns of ``docs`` come back, whatever their names, and ``mix_copy``,
    which tells a row's copies apart (0, 1, ... ; those of further draws go on
    from the next multiple of ``STRIDE``), and ``mix_key`` (the row's place in
    the global order); input columns of these two names give way.  Without
    ``targets`` all sources present share equally.  Sources that ``targets``
    does not name, and null sources, go in as they are, once.  A target of 0
    and a source of empty texts alone leave no rows.  Null and empty texts of
    other sources are repeated like the rest.  The draw depends on the id, and
    where that is null on the text, so equal rows are repeated alike.  An empty
    table gives an empty result."""
    source = F.col("source").cast("string")
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null|"), F.md5(F.coalesce("text", F.lit("null")))))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("mix_copy", "mix_key")]).alias("row"),
                       source.alias("source"), key.alias("key"), F.monotonically_increasing_id().alias("salt"))
    rates = repetition_rates(docs.select(source.alias("source"), "text"), targets, total_chars)
    rows = rows.join(rates, "source", "left").where(F.col("rate").isNull() | (F.col("rate") > 0))
    draws = F.greatest(F.lit(1), F.ceil(F.coalesce("rate", F.lit(0.0)) / MEAN)).cast("long")
    rows = rows.withColumn("draws", draws).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(draws - 1) div {DRAWS}"))))
    first = F.col("block") * DRAWS
    rows = rows.withColumn("draw", F.explode(F.sequence(first, F.least(first + (DRAWS - 1), F.col("draws") - 1))))
    u = uniform(seed, F.col("key"), F.when(F.col("draw") > 0, F.col("draw")))
    copies = F.when(F.col("rate").isNull(), 1).otherwise(poisson_count(u, F.col("rate") / F.col("draws")))
    rows = rows.withColumn("copies", copies).where("copies > 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    out = rows.select("row", "key", "salt", (F.col("draw") * STRIDE + F.col("copy")).alias("mix_copy"))
    out = out.withColumn("mix_key", uniform(seed + 1, F.col("key"), F.col("mix_copy")))
    # The key is uniform: dealing by it (and, for equal rows, by a salt) and sorting inside partitions is
    # a random order over all rows, without the second reading of the input that range boundaries would take.
    return out.repartition("mix_key", "salt").sortWithinPartitions("mix_key", "mix_copy", "salt").select("row.*", "mix_copy", "mix_key")
