"""Mixing sources to target weights: Poisson replication (all DataFrame functions).

Each source gets a mean repetition rate ``weight * output_size / size``.
Every row draws a uniform number from a seeded hash of its id, the Poisson
distribution of its source's rate is inverted at that number, the row is
exploded by the count, and all copies are shuffled globally.

Defined results.  A null text counts as empty, a null source is a source of
its own, a source without a weight in ``weights`` gets rate 0, and so does a
source of weight 0.  Rows of the same id draw the same count; a row without
an id draws by its text instead.  An empty
table gives an empty result.  Extra columns stay as they are; the columns
that the operator adds are ``copy`` and ``shuffle_key`` (existing ones of
these names are replaced).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.base import materialise, unit_hash

#: A rate above this is drawn as a sum of equal Poisson shares of at most
#: this mean, so that exp(-mean) stays well inside double precision.
SHARE = 32.0


def row_key(id_col: str, text_col: str):
    """The id as text; without one, the MD5 of the text."""
    return F.coalesce(F.col(id_col).cast("string"),
                      F.concat(F.lit("null"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, temper: float = 0.5,
                 epochs: float = 1.0, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``(source, size, rate)``; size is code points plus one a document.

    ``weights`` are target shares (normalised here); without them the
    target is the share of sizes raised to ``temper``."""
    size = F.coalesce(F.length(F.col(text_col)), F.lit(0)).cast("long") + F.lit(1)
    s = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(size).alias("size"))
    if weights is None:
        w = F.pow(F.col("size").cast("double"), F.lit(float(temper)))
    else:
        pairs = [F.when(F.col("source") == F.lit(k), F.lit(float(v))) for k, v in weights.items()]
        w = F.coalesce(*pairs, F.lit(0.0))
    s = materialise(s.select("*", w.alias("w")), "source-sizes")
    total = s.agg(F.sum("w").alias("w"), F.sum("size").alias("size")).first()
    share = F.col("w") / F.lit(float(total["w"] or 1.0))
    rate = F.round(share * F.lit(float(epochs) * float(total["size"] or 0)) / F.col("size"), 9)
    return s.select("source", "size", rate.alias("rate"))


def poisson_cdf(rate):
    """``(shares, cdf)``: the number of equal shares of a rate and the
    cumulative Poisson probabilities of one share, past any draw of 52 bits."""
    shares = F.greatest(F.ceil(rate / F.lit(SHARE)), F.lit(1)).cast("int")
    mean = rate / shares
    steps = F.sequence(F.lit(1), F.ceil(mean + 12 * F.sqrt(mean) + F.lit(30)).cast("int"))
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("cdf"))

    def step(acc, k):
        p = acc["p"] * mean / k.cast("double")
        c = acc["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.concat(acc["cdf"], F.array(c)).alias("cdf"))
    return shares, F.aggregate(steps, start, step, lambda acc: acc["cdf"])


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, temper: float = 0.5,
                epochs: float = 1.0, seed: int = 1, id_col: str = "doc_id",
                source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Copies of ``docs`` by source weight, in a global random order, with
    ``copy`` (from 0) and ``shuffle_key`` (the order within a partition)."""
    docs = docs.drop("copy", "shuffle_key")
    rates = source_rates(docs, weights, temper, epochs, source_col, text_col)
    shares, cdf = poisson_cdf(F.col("rate"))
    # one row a source, written out: Catalyst sees its size, and broadcasts it only if it is small
    table = materialise(rates.select(F.col("source").alias("_source"), shares.alias("_shares"), cdf.alias("_cdf")),
                        "source-cdf")
    joined = docs.withColumn("_key", row_key(id_col, text_col)).join(table, F.col(source_col).eqNullSafe(F.col("_source")))
    draws = F.transform(F.sequence(F.lit(1), F.col("_shares")), lambda k: unit_hash(F.col("_key"), k, seed=seed))
    # an inverted draw is the number of cumulative probabilities at or below it
    count = F.aggregate(draws, F.lit(0), lambda n, u: n + F.size(F.filter(F.col("_cdf"), lambda c: c <= u)))
    copies = (joined.withColumn("_n", count).where(F.col("_n") > 0)
              .select("_key", *[F.col(c) for c in docs.columns],
                      F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("copy")))
    key = F.md5(F.concat_ws("|", F.lit(f"shuffle{seed}"), F.col("_key"), F.col("copy").cast("string")).cast("binary"))
    copies = copies.withColumn("shuffle_key", key).drop("_key")
    # one shuffle: every copy goes to a random partition and to a random place in it
    return copies.repartition(F.col("shuffle_key")).sortWithinPartitions("shuffle_key")
