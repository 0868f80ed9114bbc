"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets: source ``i`` asks for ``weight_i * level`` words, the level being such that all
targets sum to the words there are, and no target exceeds ``max_epochs`` times its source
(the excess thereby falls to the others by weight).

Taking: a source's whole epochs come first; what is left of its target is filled with
documents in the order of ``-ln(u) / quality`` (``u`` uniform from a hash of the doc_id,
``quality`` a weight from the text), until the next would go beyond the middle of its
own size.  Nothing is drawn at run time, so reruns agree.

No source is sorted in one place: keys fall into buckets, ``buckets`` equal shares of the
distribution for quality 1 crossed with as many for quality 0.1 (so no quality piles its keys
up in one), bucket sums are pre-aggregated and prefix-summed (at most twice ``buckets`` rows
for a source), and only the one bucket in which a source's budget ends is sorted.  What
comes out is a row for each source - its epochs and the last key that is taken - and every
document is decided in the scan by comparing its own key.

Defined results: null and wordless texts have size 0 and are never taken in part;
null is a source of its own, the last one; rows that agree in doc_id and size are taken
together; an empty table has no sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import cut
from .text_stats import SYMBOLS, char_count, whole_text, word_count


def quality(text: Column) -> Column:
    """1 for a text without symbols, falling to 0.1 for one with a tenth of them or more."""
    return F.greatest(F.lit(0.1), 1.0 - 9.0 * char_count(text, SYMBOLS) / F.greatest(F.length(text), F.lit(1)))


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1) from 52 bits of a hash."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long")
    return (bits + 0.5) / float(1 << 52)


def with_keys(docs: DataFrame, seed: str, buckets: int) -> DataFrame:
    """``docs`` with a struct column ``mix`` of size, key and bucket."""
    text = whole_text()
    key = -F.log(uniform(F.col("doc_id"), seed)) / quality(text)
    keyed = docs.withColumn("mix", F.struct(word_count(text).alias("size"), key.alias("key")))
    # equal shares of the keys of quality 1, and of those of quality 0.1 where the first leave a long tail
    share = lambda q: F.least(F.lit(buckets - 1), F.floor(buckets * (1 - F.exp(-q * F.col("mix.key")))))
    bucket = (share(1.0) + share(0.1)).cast("int")
    return keyed.withColumn("mix", F.struct("mix.size", "mix.key", bucket.alias("bucket"), F.col("doc_id").cast("long").alias("doc_id")))


def source_targets(totals: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """``source, source_size, target`` from a row per source: the level at which capped and uncapped targets add up."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")  # a row per source
    weighed = totals.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    asked = weighed.withColumn("ratio", max_epochs * F.col("source_size") / F.col("w"))
    up = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    capped, weight_capped = F.coalesce(F.sum("source_size").over(up), F.lit(0)), F.coalesce(F.sum("w").over(up), F.lit(0))
    level = (F.sum("source_size").over(every) - max_epochs * capped) / (F.sum("w").over(every) - weight_capped)
    leveled = asked.withColumn("level", level)
    found = leveled.withColumn("level", F.min_by(F.when(F.col("ratio") >= F.col("level"), F.col("level")), F.when(F.col("ratio") >= F.col("level"), F.col("ratio"))).over(every))
    return found.select("source", "source_size", F.least(max_epochs * F.col("source_size"), F.col("level") * F.col("w")).cast("double").alias("target"))


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix", buckets: int = 4_096) -> DataFrame:
    """A row per source: source, source_size, target, epochs, and up to which bucket and key another copy is taken."""
    keyed = cut(with_keys(docs.select("doc_id", "source", "text"), seed, buckets).select("source", "mix.*"), "mix-keys")
    filled = cut(keyed.groupBy("source", "bucket").agg(F.sum("size").alias("size")), "mix-buckets")
    targets = source_targets(filled.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    targets = cut(targets.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-targets")
    same = lambda other: F.col("source").eqNullSafe(F.col(other))

    sums = filled.withColumn("until", F.sum("size").over(Window.partitionBy("source").orderBy("bucket")))
    budgets = targets.select(F.col("source").alias("s"), "budget")
    # the bucket in which the budget ends; budgets at or beyond the last key take every bucket
    ends = sums.join(budgets, same("s")).where((F.col("until") - F.col("size") < F.col("budget")) & (F.col("until") >= F.col("budget"))).select("s", F.col("bucket").alias("last_bucket"), (F.col("until") - F.col("size")).alias("before"), "budget")
    inside = keyed.join(ends, same("s") & (F.col("bucket") == F.col("last_bucket"))).where("size > 0")
    running = inside.withColumn("until", F.sum("size").over(Window.partitionBy("source").orderBy("key", "doc_id", "size")) + F.col("before"))
    last = running.where(F.col("until") - F.col("size") / 2 <= F.col("budget")).groupBy("source").agg(F.max(F.struct("key", "doc_id", "size")).alias("last"))
    ends = ends.join(last.withColumnRenamed("source", "t"), F.col("s").eqNullSafe(F.col("t")), "left").select("s", "last_bucket", "last")
    return cut(targets.join(ends, same("s"), "left").select("source", "source_size", "target", "epochs", F.coalesce("last_bucket", F.lit(-1)).alias("last_bucket"), "last"), "mix-plan")


def with_copies(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix", buckets: int = 4_096) -> DataFrame:
    """``docs`` with a struct column ``mix``: size, source_size, target, copies and taken (words)."""
    plan = plan_mix(docs, weights, max_epochs, seed, buckets).withColumnRenamed("source", "plan_source")
    columns = [F.col(f"d.`{c}`") for c in docs.columns]
    keyed = with_keys(docs, seed, buckets).alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.plan_source")))
    m = lambda f: F.col("d.mix").getField(f)
    place = F.struct(m("key").alias("key"), m("doc_id").alias("doc_id"), m("size").alias("size"))
    more = (m("size") > 0) & ((m("bucket") < F.col("p.last_bucket")) | ((m("bucket") == F.col("p.last_bucket")) & F.coalesce(place <= F.col("p.last"), F.lit(False))))
    copies = F.col("p.epochs") + more.cast("long")
    return keyed.select(*columns, F.struct(m("size").alias("size"), F.col("p.source_size").alias("source_size"), F.col("p.target").alias("target"), copies.alias("copies"), (copies * m("size")).alias("taken")).alias("mix"))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as it is taken, with the columns of ``docs``."""
    counted = with_copies(docs, **settings)
    return counted.where("mix.copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix.copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])
