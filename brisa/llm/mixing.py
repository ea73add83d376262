"""Mixing sources to target weights by Poisson replication.

Every document gets a uniform number from a hash of its id and the seed. Inverting the Poisson
distribution whose mean is the target repetition rate of the document's source turns it into a
number of copies. The copies are exploded and shuffled globally by a hash of (id, copy), so that
the mixture and its order are the same in every run, whatever tasks are lost."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from brisa.llm.common import small, staged

#: A Poisson number of mean m is the sum of floor(m / STEP) numbers of mean STEP and one of the
#: rest, each from a hash of its own, so that no mean is too large for exp(-m) in a double.
STEP = 16.0
#: Terms of the inverted distribution: beyond them the probability is below 2^-52 for means up
#: to STEP, finer than the uniform numbers.
TERMS = 80
#: Distinct sources (a name and a rate each) that are broadcast; with more the rates are joined
#: by a shuffle on (source, salt), so that a source with a third of the rows is cut in SALTS parts.
BROADCAST_SOURCES, SALTS = 100_000, 256


def uniform(*parts: Column | str) -> Column:
    """Number in (0, 1) with 52 bits from an MD5 of the parts; null parts are empty."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2 ** 52))


def inverse_poisson(u: Column, mean: Column) -> Column:
    """Smallest k with P(X <= k) >= u, for means up to STEP: a fold over the terms that adds one
    to the count for each cumulative probability below u."""
    start = F.struct(F.lit(0).alias("n"), F.exp(-mean).alias("term"), F.exp(-mean).alias("total"))

    def step(s, k):
        term = s["term"] * mean / k
        return F.struct((s["n"] + F.when(s["total"] < u, 1).otherwise(0)).alias("n"), term.alias("term"), (s["total"] + term).alias("total"))

    terms = F.sequence(F.lit(1), F.lit(TERMS)).cast("array<double>")
    return F.aggregate(terms, start, step, lambda s: s["n"])


def copies(mean: Column, *key: Column | str) -> Column:
    """Poisson count of any mean, seeded by the hash of `key`."""
    whole = F.floor(mean / STEP).cast("int")
    parts = F.when(whole > 0, F.transform(F.sequence(F.lit(1), whole), lambda i: inverse_poisson(uniform(*key, i), F.lit(STEP))))
    summed = F.coalesce(F.aggregate(parts, F.lit(0), lambda a, x: a + x), F.lit(0))
    return summed + inverse_poisson(uniform(*key, F.lit(0)), mean - whole * STEP)


def rates(docs: DataFrame, weights: Mapping[str | None, float] | None = None, temperature: float = 0.5, budget: float = 1.0,
          source_col: str = "source", size: Column | None = None) -> DataFrame:
    """Target repetition rate of each source: (source, size, weight, rate).

    With sizes n(s) and weights w(s) that sum to one, the mixture shall hold budget * sum(n) units,
    w(s) of them from source s: rate = w(s) * budget * sum(n) / n(s). Without `weights` they are
    n(s) ** temperature. Sources absent from `weights` get none; null is a source like any other;
    a source of size zero has rate zero. `size` is the unit: one a row unless given."""
    counted = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(F.lit(1) if size is None else size).cast("double").alias("size"))
    if weights is None:
        counted = counted.withColumn("share", F.when(F.col("size") > 0, F.pow("size", F.lit(temperature))).otherwise(0.0))
    else:
        pairs = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "name string, share double")
        counted = counted.join(F.broadcast(pairs), F.col("source").eqNullSafe(F.col("name")), "left").drop("name").fillna(0.0, ["share"])
    counted = staged(counted, "source-sizes")
    total = counted.agg(F.sum("size").alias("size"), F.sum("share").alias("share")).first()
    whole, shares = (total["size"] or 0.0), (total["share"] or 0.0)
    weight = F.col("share") / shares if shares else F.lit(0.0)
    rate = F.when(F.col("size") > 0, weight * F.lit(budget * whole) / F.col("size")).otherwise(0.0)
    return counted.select("source", "size", weight.alias("weight"), rate.alias("rate"))


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, temperature: float = 0.5, budget: float = 1.0,
        seed: str = "mix", size: Column | None = None, id_col: str = "doc_id", source_col: str = "source", marks: bool = True) -> DataFrame:
    """`docs` replicated to the target weights and globally shuffled.

    All columns are kept; with `marks` these follow: mix_copy (1, 2, ...), mix_rate and mix_key,
    the place in the order (columns of these names are replaced). Rows are dealt by mix_key over
    the shuffle partitions and sorted by it in each. Rows with the same id draw the same number of
    copies and the same keys; rows with a null id do too. An empty table gives no rows. Documents
    that draw zero copies are absent, as the target weights ask."""
    plain = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("mix_copy", "mix_rate", "mix_key")])
    rate = rates(docs, weights, temperature, budget, source_col, size).select(F.col("source").alias("__source"), F.col("rate").alias("mix_rate"))
    hinted = small(rate, BROADCAST_SOURCES)
    same = F.col(f"`{source_col}`").eqNullSafe(F.col("__source"))
    if hinted is rate:
        plain = plain.withColumn("__salt", F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(SALTS)).cast("int"))
        hinted = rate.withColumn("__salt_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        same = same & (F.col("__salt") == F.col("__salt_of"))
    key = F.col(f"`{id_col}`")
    drawn = plain.join(hinted, same).withColumn("__n", copies(F.col("mix_rate"), seed, key)).filter("__n > 0")
    spread = drawn.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__n", "__source", "__salt", "__salt_of")
    spread = spread.withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(seed + "/order"), F.coalesce(key.cast("string"), F.lit("")), "mix_copy")))
    shuffled = spread.repartition("mix_key").sortWithinPartitions("mix_key")
    return shuffled if marks else shuffled.select(*[F.col(f"`{c}`") for c in docs.columns])
