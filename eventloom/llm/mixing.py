"""Mixing sources to target weights (DataFrame operations only).

Words are summed per source; a source's target is its share of the wanted total,
but at most ``max_repeat`` times its size, and what that cuts off is shared again
by weight. Every document is then emitted floor(rate) times, and once more if a
hash of seed, id and text falls below the rate's fraction: no state, no random
generator, the same result on every run.

Only the table of sources (one row each) is sorted as a whole; documents meet it
in a join that Spark broadcasts when the written table is small and otherwise
splits at a hot source.

Defined cases: null text is empty; null source is a source of its own, ordered
last; size 0 gives target 0 and no copy; repeated rows are counted and drawn alike;
an empty table gives an empty result; other columns pass through unread.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import keep, text_of, word_count


def source_rates(sized: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_repeat: float = 2.0) -> DataFrame:
    """One row per source: source, source_size, target, rate.

    ``sized`` has source and size. Weights repeat over the sources in code-point
    order. The targets are min(cap, level * weight), where one level makes them
    sum to the wanted total; it is found from running sums over the sources in
    the order in which they reach their caps.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    everything = Window.partitionBy(F.lit(1)).orderBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sizes = sized.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"))
    listed = sizes.select(
        "source",
        "source_size",
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).alias("weight"),
        (F.col("source_size") * F.lit(float(max_repeat))).alias("cap"),
    )
    reached = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = reached.rowsBetween(Window.unboundedPreceding, -1)
    onward = reached.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levels = listed.withColumn(
        "level",
        (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward),
    )
    level = F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(everything)
    return levels.withColumn("level", level).select(
        "source",
        "source_size",
        F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight"))).alias("target"),
    ).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))


def draw(seed: str, doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) fixed by seed, id and text: 52 bits of an MD5."""
    key = F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), text)
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(2**52))


def copies(rate: Column, drawn: Column) -> Column:
    """floor(rate), plus one if the draw falls below the fraction."""
    return (F.floor(rate) + F.when(drawn < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def plan(docs: DataFrame, seed: str = "mix", **options) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies."""
    sized = keep(docs.select("doc_id", "source", word_count(text_of()).alias("size"), draw(seed, F.col("doc_id"), text_of()).alias("drawn")), "mix-sizes")
    rates = keep(source_rates(sized, **options), "mix-rates")
    rates = rates.withColumnRenamed("source", "rated_source")
    return sized.join(rates, F.col("source").eqNullSafe(F.col("rated_source"))).select(
        "doc_id", "source", "size", "source_size", "target", copies(F.col("rate"), F.col("drawn")).alias("copies")
    )


def mix(docs: DataFrame, seed: str = "mix", **options) -> DataFrame:
    """The mixed documents with their own columns: each as often as its draw says."""
    sized = docs.select("source", word_count(text_of()).alias("size"))
    rates = keep(source_rates(sized, **options), "mix-rates").select(F.col("source").alias("__source"), F.col("rate").alias("__rate"))
    drawn = docs.join(rates, F.col("source").eqNullSafe(F.col("__source"))).withColumn("__copies", copies(F.col("__rate"), draw(seed, F.col("doc_id"), text_of())))
    return drawn.filter("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*docs.columns)
