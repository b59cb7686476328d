"""Source divergence audit: how far each source's words stand from its language and from other sources.

Within a language, every source gives each kept term (one in at least ``least_docs`` of the
language's documents) the smoothed share p = 1 + floor(10^9 (count + 1) / (N + V)), and two
shares differ by f(p, q) = floor((p - q)^2 / q). All arithmetic is in whole numbers.

* *Pairs of sources* sum f over all V terms, most of which neither source has. Those count
  as a baseline, V f(p0, q0). Each source corrects it by a histogram of its own counts, and
  only terms that both have are met in a join, whose rows correct what the two
  histograms counted as one-sided. So the work follows the terms that are there, not V
  times the pairs.
* *Top terms* of a source are found by radix select: histograms over the bits of the values,
  most significant first, narrow down each source's k-th largest value; ties at that value
  are refined by their UTF-8 bytes in the same way. Only what is selected is sorted.

Words are counted per task in Python, bounded tables at a time, and meet partitioned by
language and term, so neither a hot source nor a frequent word is one task's work.

Defined cases:

* null text, lang and source count as the empty string;
* a source without terms has all shares at their baseline; a language with V = 0 gives 0 for
  every pair, and no terms;
* repeated rows are documents of their own; equal values rank by UTF-8 order of the item;
* an empty table gives an empty result; other columns are never looked at;
* V up to 5 * 10^8 terms a language: beyond, a sum may pass the range of a long, which
  Spark reports as an error instead of a wrong value.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import arrow_rows, keep, passing, text_of

#: Terms of a text whose A-Z are lower-cased, in UTF-8: ASCII letters and all beyond ASCII.
_term = re.compile(rb"[a-z\x80-\xff]+")

#: Terms that a task counts before it hands them on.
HELD_TERMS = 300_000

_GROUP = ["lang", "source"]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per (lang, source, term): occurrences and documents, as far as the task has read."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    terms_held = 0

    def handed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            of_group = [pa.repeat(pa.scalar(name, pa.string()), len(terms)) for name in (lang, source)]
            counts = [pa.array([c[t] for t in terms], pa.int64()) for c in (n, docs)]
            yield pa.RecordBatch.from_arrays([*of_group, pa.array(terms, pa.binary()).cast(pa.string()), *counts], ["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang, source, text in zip(langs, sources, batch.column(2).cast(pa.binary()), strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            of_text = Counter(_term.findall(text.as_py().lower()))
            terms_held -= len(n)
            n.update(of_text)
            docs.update(of_text.keys())
            terms_held += len(n)
            if terms_held > HELD_TERMS:
                yield from handed_on()
                terms_held = 0
    yield from handed_on()


def term_counts(docs: DataFrame, least_docs: int = 3, text_rows: int = 500) -> DataFrame:
    """Per (lang, source, kept term): n in the source, lang_n in the language; first: in one row of each (lang, term). A written table."""
    texts = docs.select(text_of("lang").alias("lang"), text_of("source").alias("source"), text_of().alias("text"))
    seen = texts.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    # One exchange serves the sums per source and those per language.
    summed = seen.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_lang = Window.partitionBy("lang", "term")
    with_lang = summed.select(
        "lang", "source", "term", "n", F.sum("n").over(of_lang).alias("lang_n"), F.sum("docs").over(of_lang).alias("lang_docs"), (F.min("source").over(of_lang) == F.col("source")).alias("first")
    )
    with arrow_rows(docs.sparkSession, text_rows):
        return keep(with_lang.filter(F.col("lang_docs") >= least_docs).drop("lang_docs"), "term-counts")


def _share(n: str, size: str, terms: str) -> Column:
    """p of a count, exact for counts of any size."""
    return F.expr(f"1 + (cast(1000000000 as decimal(10,0)) * cast({n} + 1 as decimal(19,0))) div cast({size} + {terms} as decimal(20,0))")


def _apart(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) div ({q}))"


def _groups(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """Per occurring (lang, source): its size N, and of its language lang_size, V and the baseline share p0 (null if V = 0)."""
    occurring = docs.select(text_of("lang").alias("lang"), text_of("source").alias("source")).distinct()
    sizes = keep(counts.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count_if("first").alias("own"), F.sum(F.expr("if(first, lang_n, 0L)")).alias("own_n")), "term-sizes")
    terms = sizes.groupBy("lang").agg(F.sum("own").alias("v"), F.sum("own_n").alias("lang_size"))
    named = occurring.join(sizes.select("lang", "source", "size"), _GROUP, "left").join(terms, "lang", "left")
    filled = named.select("lang", "source", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("size", "lang_size", "v")])
    return keep(filled.withColumn("p0", F.when(F.col("v") > 0, _share("0", "size", "v"))), "term-groups")


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source), value: f summed over all terms of the language."""
    mine = groups.select("lang", "source", "v", "p0")
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("o0"))
    base = mine.join(other, "lang").filter("source <> item").select("lang", "source", "item", F.expr(f"if(v = 0, 0L, v * {_apart('p0', 'o0')})").alias("value"))
    # What a source's own terms change, if the other had none of them: in both directions.
    histogram = shares.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("m"))
    met = histogram.join(other, "lang").filter("source <> item")
    there = met.select("lang", "source", "item", F.expr(f"m * ({_apart('p', 'o0')} - {_apart('p0', 'o0')})").alias("value"))
    back = met.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.expr(f"m * ({_apart('o0', 'p')} - {_apart('o0', 'p0')})").alias("value"))
    # Terms that both have: each pair of sources once, summed before it is turned round.
    a = shares.select("lang", "term", "source", "p", "p0")
    b = shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("o"), F.col("p0").alias("o0"))
    fix = lambda p, p0, q, q0: f"sum({_apart(p, q)} - {_apart(p, q0)} - {_apart(p0, q)} + {_apart(p0, q0)})"
    shared = (
        a.join(b, ["lang", "term"])
        .filter("source < item")
        .groupBy("lang", "source", "item")
        .agg(F.expr(fix("p", "p0", "o", "o0")).alias("there"), F.expr(fix("o", "o0", "p", "p0")).alias("back"))
    )
    turned = F.explode(F.array(F.struct("source", "item", F.col("there").alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value"))))
    both = shared.select("lang", turned.alias("x")).select("lang", "x.source", "x.item", "x.value")
    return base.union(there).union(back).union(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def largest(rows: DataFrame, group: list[str], k: int, digit_bits: int = 12, direct: int = 4_096) -> DataFrame:
    """Of each group's (item, value) the ``k`` largest by value, ties by UTF-8 order of the item (radix select).

    ``rows`` is a written table; within a group items differ, values are not negative.
    Ties at the k-th value are sorted outright where a group has at most ``direct`` of them.
    """
    top = rows.agg(F.max("value")).first()[0]
    if top is None:
        return rows
    shift = -(-max(1, top.bit_length()) // digit_bits) * digit_bits
    # Per group: high bits that the k-th value has, and how many rows with these bits are wanted.
    state = keep(rows.select(*group).distinct().select(*group, F.lit(0).cast("long").alias("high"), F.lit(k).cast("long").alias("need")), "radix")
    while shift:
        shift -= digit_bits
        among = rows.join(state, group)
        if shift + digit_bits < 64:
            among = among.filter(F.shiftright("value", shift + digit_bits) == F.col("high"))
        digit = F.shiftright("value", shift).bitwiseAND(F.lit((1 << digit_bits) - 1))
        bins = among.groupBy(*group, "high", "need", digit.alias("digit")).agg(F.count(F.lit(1)).alias("n"))
        state = keep(_boundary(bins, group, F.desc("digit")).select(*group, (F.shiftleft("high", digit_bits) + F.col("digit")).alias("high"), F.col("left").alias("need")), "radix")
    met = rows.join(state, group)
    ties = keep(met.filter(F.col("value") == F.col("high")).select(*group, "item", "need"), "radix-ties")
    cut = _last_wanted(ties, group, direct)
    return met.join(cut, group, "left").filter((F.col("value") > F.col("high")) | (F.col("value") == F.col("high")) & (F.col("item") <= F.col("last"))).select(*rows.columns)


def _boundary(bins: DataFrame, group: list[str], order: Column) -> DataFrame:
    """Per group the bin (digit, n) that its last wanted row is in, and how many of that bin are wanted (left).

    A group with fewer rows than wanted ends in its last bin, all of which is wanted.
    """
    so_far = F.sum("n").over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = F.lead("digit").over(Window.partitionBy(*group).orderBy(order)).isNull()
    ranked = bins.withColumn("upto", so_far).withColumn("last", last)
    wanted = (F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")) | F.col("last") & (F.col("upto") < F.col("need"))
    return ranked.filter(wanted).withColumn("left", F.least(F.col("need") - F.col("upto") + F.col("n"), F.col("n")))


def _common_bytes(a: Column, b: Column) -> Column:
    """Length of the common start of two binaries, by halving."""
    steps = F.array(*[F.lit(1 << i) for i in range(30, -1, -1)])
    fits = lambda n: (n <= F.least(F.length(a), F.length(b))) & (F.substring(a, 1, n) == F.substring(b, 1, n))
    return F.aggregate(steps, F.lit(0), lambda have, step: F.when(fits(have + step), have + step).otherwise(have))


def _last_wanted(ties: DataFrame, group: list[str], direct: int) -> DataFrame:
    """Per group of (item, need): ``last``, the need-th item in UTF-8 order."""
    rest, done = ties, None
    while True:
        found = rest.groupBy(*group).agg(F.first("need").alias("need"), F.count(F.lit(1)).alias("n"), F.min("item").alias("least"), F.max("item").alias("most"))
        found = keep(found.withColumn("ends", (F.col("need") >= F.col("n")) | (F.col("n") <= direct)), "radix-ends")
        few = rest.join(found.filter(F.col("ends")).select(*group, "n"), group)
        nth = F.row_number().over(Window.partitionBy(*group).orderBy("item"))
        # Where all are wanted the last is the largest; else the few that are left are numbered.
        ended = found.filter("need >= n").select(*group, F.col("most").alias("last")).union(few.filter("need < n").withColumn("nth", nth).filter("nth = need").select(*group, F.col("item").alias("last")))
        done = keep(ended if done is None else done.union(ended), "radix-last")
        open_groups = found.filter(~F.col("ends"))
        if open_groups.isEmpty():
            return done
        raw = F.col("item").cast("binary")
        start = open_groups.select(*group, _common_bytes(F.col("least").cast("binary"), F.col("most").cast("binary")).alias("same"))
        digit = F.hex(F.substring(raw, F.col("same") + 1, 2))
        among = rest.join(start, group).withColumn("digit", digit)
        bins = among.groupBy(*group, "need", "digit").agg(F.count(F.lit(1)).alias("n"))
        bound = _boundary(bins, group, F.asc("digit")).select(*group, "digit", F.col("left").alias("need"))
        rest = keep(among.drop("need").join(bound, [*group, "digit"]).select(*group, "item", "need"), "radix-ties")


def audit(docs: DataFrame, least_docs: int = 3, top: int = 200, digit_bits: int = 12, direct: int = 4_096) -> DataFrame:
    """Rows lang, source, part, item, value, rank.

    Part ``pair``: every other source of the language, by divergence. Part ``term``: the
    ``top`` terms that the source has more often than its language, by their f.
    """
    spark = docs.sparkSession
    with passing(spark):
        counts = term_counts(docs, least_docs)
        groups = _groups(docs, counts)
        shares = counts.join(groups, _GROUP).select("lang", "source", "term", "p0", _share("n", "size", "v").alias("p"), _share("lang_n", "lang_size", "v").alias("q"))
        shares = keep(shares, "term-shares")
        pairs = _pairs(shares, groups).withColumn("part", F.lit("pair"))
        over = keep(shares.filter("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(_apart("p", "q")).alias("value")), "term-values")
        terms = largest(over, _GROUP, top, digit_bits, direct).withColumn("part", F.lit("term"))
        rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
        columns = ["lang", "source", "part", "item", "value"]
        return keep(pairs.select(columns).union(terms.select(columns)).withColumn("rank", rank), "divergence", lasting=True)
