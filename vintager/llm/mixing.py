"""Mixing sources to target weights by Pareto order sampling.

A source with S words and a target of T gets floor(T / S) certain copies of every document. The
rest of its target is a sample of fixed size in words: document i has random odds u/(1-u), from a
hash, divided by its inclusion odds, and documents are taken in ascending order of that quotient
until the words reach the rest of the target; the document at the edge is taken if that comes
nearer. The inclusion odds are the source's (share f of its words: f/(1-f)) times a preference of
the document, which makes the probabilities unequal within a source too.

The order is cut without sorting a source: words are summed by source and bin of the quotient, the
bin of the edge is found from those sums, and only that bin's documents are ordered.

Defined cases: a null text has size 0 and is never taken; a null source is a source of its own,
last in order; repeated rows have the same quotient and are ordered as equals; an empty table gives
no rows; other columns of the input are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vintager.llm.common import WORD, stored
from vintager.operators.sizing import broadcast_if_small

WEIGHTS = (5.0, 2.0, 1.0)
TOTAL_SHARE = 1.5
MOST_COPIES = 2.0
BINS = 1024


def source_targets(
    sizes: DataFrame, weights: Sequence[float], total_share: float, most: float
) -> DataFrame:
    """(source, source_size, target): shares by weight, capped, the excess shared again.

    ``sizes`` has a row per source. Each round caps the sources whose share exceeds ``most`` times
    their size; the driver only sees two sums a round.
    """
    spark = sizes.sparkSession
    names = sizes.select("source").orderBy(F.col("source").asc_nulls_last())
    numbered = spark.createDataFrame(
        names.rdd.zipWithIndex().map(lambda x: (x[0][0], x[1])), "source string, place long"
    )
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        (F.col("place") % len(weights) + 1).cast("int"),
    )
    ranked = stored(
        sizes.alias("s")
        .join(numbered.alias("n"), F.col("s.source").eqNullSafe(F.col("n.source")))
        .select("s.source", "s.source_size", weight.alias("weight"))
        .withColumn("cap", F.lit(most) * F.col("source_size"))
    )
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        over = F.lit(level) * F.col("weight") >= F.col("cap")
        held, free = ranked.agg(
            F.sum(F.when(over, F.col("cap")).otherwise(0.0)),
            F.sum(F.when(over, 0.0).otherwise(F.col("weight"))),
        ).first()
        if not free:
            break
        rest = (total_share * total - held) / free
        if rest <= level:
            break
        level = rest
    return ranked.select(
        "source",
        "source_size",
        F.least(F.col("cap"), F.lit(level) * F.col("weight")).alias("target"),
    )


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    total_share: float = TOTAL_SHARE,
    most: float = MOST_COPIES,
    preference: str = "1 + ln(1 + size)",
    seed: int = 7,
    bins: int = BINS,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) per row of ``docs``.

    ``preference`` is SQL over doc_id, source and size; longer documents are likelier by default.
    """
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    random = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "source", "text"), 11)
    slim = stored(
        docs.select(
            "doc_id",
            F.col("source").cast("string").alias("source"),
            size.alias("size"),
            ((random + 0.5) / float(1 << 53)).alias("u"),
        ).withColumn("preference", F.expr(preference).cast("double"))
    )
    sizes = stored(slim.groupBy("source").agg(F.sum("size").alias("source_size")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = source_targets(sizes, weights, total_share, most).withColumn(
        "copies", F.floor(ratio).cast("long")
    )
    share = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), ratio - F.col("copies")))
    plan = stored(
        plan.withColumns(
            {
                "odds": share / (1 - share),
                "rest": F.greatest(
                    F.lit(0.0), F.col("target") - F.col("copies") * F.col("source_size")
                ),
            }
        )
    )

    def joined(rows: DataFrame, per_source: DataFrame) -> DataFrame:
        side = broadcast_if_small(per_source.withColumnRenamed("source", "__source"))
        return rows.join(side, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")

    quotient = (F.col("u") / (1 - F.col("u"))) / (F.col("preference") * F.col("odds"))
    ordered = joined(slim, plan).withColumn("q", quotient).withColumn(
        "bin", F.least(F.lit(bins - 1), F.floor(F.col("q") / (1 + F.col("q")) * bins)).cast("int")
    )
    sums = stored(ordered.groupBy("source", "bin").agg(F.sum("size").alias("words")))
    up_to = F.sum("words").over(Window.partitionBy("source").orderBy("bin"))
    edge = stored(
        joined(sums.withColumn("up_to", up_to), plan.select("source", "rest"))
        .filter("up_to > rest")
        .groupBy("source")
        .agg(F.min("bin").alias("edge_bin"), F.min("up_to").alias("edge_up_to"))
        .join(
            sums.withColumnsRenamed({"source": "__source", "bin": "edge_bin_"}),
            F.col("source").eqNullSafe(F.col("__source"))
            & (F.col("edge_bin") == F.col("edge_bin_")),
        )
        .select("source", "edge_bin", (F.col("edge_up_to") - F.col("words")).alias("before"))
    )
    side = broadcast_if_small(edge.withColumnRenamed("source", "__source"))
    cut = ordered.join(
        side, F.col("source").eqNullSafe(F.col("__source")), "left"
    ).drop("__source")
    at_edge = F.coalesce(F.col("bin") == F.col("edge_bin"), F.lit(False))
    inner = cut.filter(~at_edge).withColumn(
        "sampled", F.coalesce(F.col("bin") < F.col("edge_bin"), F.col("rest") > 0)
    )
    run = Window.partitionBy("source").orderBy("q", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    ends = F.col("before") + F.sum("size").over(run)
    edge_rows = cut.filter(at_edge).withColumn(
        "sampled", ends - F.col("size") / 2.0 <= F.col("rest")
    )
    taken = (F.col("copies") + F.when(F.col("sampled"), 1).otherwise(0)) * F.col("size")
    columns = ["doc_id", "source", "size", "source_size", "target"]
    both = inner.unionByName(edge_rows)
    return both.select(
        *columns,
        (F.col("copies") + F.when(F.col("sampled"), 1).otherwise(0)).cast("long").alias("copies"),
        taken.cast("long").alias("taken"),
    )
