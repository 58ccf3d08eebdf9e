"""Mixing sources to target weights with a time-varying curriculum.

Every source has a weight schedule over training time t in [0, 1]:
w(t) = start + (end - start) * t. Its integral gives the share of the source's
target that training has consumed by t. Laying the source's documents end to
end (epoch after epoch, in a fixed pseudo-random order) and inverting that
cumulative demand gives the position of each document in training; a range
sort by position is the training order.

DataFrame functions only. Documents of a source never meet in one task: the
running word counts are summed per (source, chunk of the pseudo-random order),
chunks are numbered by a sum over per-chunk totals, and only inside a chunk of
bounded size does a window order rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, bounded, carry, materialize, pick, unpack

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: A target is at most so many times its source's words.
MAX_EPOCHS = 3
#: Documents in a chunk, on average.
CHUNK = 4096
#: (start, end) of the schedules in source order, repeating: falling, flat, rising.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size -> also rank, weight, target.

    target = min(max_epochs * source_size, level * weight) with the one level
    at which the targets add up to all words: the limit of sharing out the
    excess by weight until no target is above its bound. Sources without words
    get 0. One row per source, so the window without partitions is as long as
    the list of sources, not the corpus.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy("__fill", "__rank")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("__fill", "__rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("__rank") - 1) % len(weights) + 1).cast("int"))
    cap = F.col("source_size").cast("double") * max_epochs
    s = (
        sizes.withColumn("__rank", F.row_number().over(by_name))
        .withColumn("__w", w)
        .withColumn("__fill", cap / F.col("__w"))
        .withColumn("__total", F.sum(F.col("source_size").cast("double")).over(everything))
        .withColumn("__rest", F.col("__total") - F.coalesce(F.sum(cap).over(before), F.lit(0.0)))
        .withColumn("__wrest", F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(before), F.lit(0.0)))
        # the level if exactly the sources before this one are at their bounds
        .withColumn("__level", F.col("__rest") / F.col("__wrest"))
        .withColumn("__level", F.first(F.when(F.col("__level") <= F.col("__fill"), F.col("__level")), ignorenulls=True).over(everything))
    )
    target = F.least(cap, F.coalesce(F.col("__level") * F.col("__w"), cap))
    return s.select("source", "source_size", F.col("__rank").alias("source_rank"), F.col("__w").alias("weight"), target.alias("target"))


def _invert(share: Column, start: Column, end: Column) -> Column:
    """t with (start*t + (end-start)*t*t/2) / ((start+end)/2) = share."""
    area = share * (start + end) / 2
    slope = end - start
    root = F.sqrt(F.greatest(start * start + slope * area * 2, F.lit(0.0)))
    return F.when(slope == 0, area / start).otherwise((root - start) / slope)


def _laid_out(docs: DataFrame, text: str, seed: int, weights, max_epochs: int, schedules, whole: bool) -> DataFrame:
    """doc_id, source, size, source_size, target, __kept (starts of the passes taken), __a, __b and, if whole, __row."""
    # the order takes in the text, so that rows without an id, or with one id, are spread, too, and reruns agree
    place = F.xxhash64("doc_id", F.col(text), F.lit(seed)).alias("__u")
    base = materialize(pick(docs, "doc_id", text, "source").select("doc_id", "source", n_words(F.col(text)).alias("size"), place), "mix-sizes")
    sizes = base.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count(F.lit(1)).alias("__n"))
    src = source_targets(sizes.select("source", "source_size"), weights, max_epochs)
    src = src.join(sizes.select(F.col("source").alias("__s"), "__n"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    starts = F.array(*[F.lit(float(a)) for a, _ in schedules])
    ends = F.array(*[F.lit(float(b)) for _, b in schedules])
    at = ((F.col("source_rank") - 1) % len(schedules) + 1).cast("int")
    src = src.select(
        F.col("source").alias("__s"), "source_size", "target", F.col("source_rank").alias("__rank"), "__n", F.element_at(starts, at).alias("__a"), F.element_at(ends, at).alias("__b")
    )
    # sent to all executors only if proven short; beyond that a shuffle join, which AQE splits at hot sources
    src = bounded(materialize(src, "mix-sources"))
    # 31 bits of the hash spread a source's documents over its chunks
    part = F.shiftrightunsigned("__u", 33)
    chunks = F.greatest(F.ceil(F.col("__n") / CHUNK), F.lit(1))
    chunk = lambda df: df.join(src, F.col("source").eqNullSafe(F.col("__s"))).withColumn("__chunk", F.floor(part * chunks / F.lit(2.0**31)).cast("long"))
    per_chunk = chunk(base).groupBy("__rank", "__chunk").agg(F.sum("size").alias("__sum"))
    before = Window.partitionBy("__rank").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    base_of = per_chunk.select("__rank", "__chunk", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    rows = base
    if whole:
        rows = carry(docs, "doc_id", text, "source").select("__row", "doc_id", "source", n_words(F.col(text)).alias("size"), place)
    inside = Window.partitionBy("__rank", "__chunk").orderBy("__u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = chunk(rows).withColumn("__in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(base_of, ["__rank", "__chunk"])
    passes = F.array(*[F.lit(float(e)) for e in range(max_epochs)])
    first = (F.col("__in") + F.col("__base")).cast("double")
    begins = F.transform(passes, lambda e: e * F.col("source_size") + first)
    kept = F.filter(begins, lambda c: c + F.col("size") / 2.0 <= F.col("target"))
    kept = F.when(F.col("size") > 0, kept).otherwise(F.array().cast("array<double>"))
    share = lambda c: F.least(c / F.col("target"), F.lit(1.0))
    return laid.withColumn("positions", F.transform(kept, lambda c: _invert(share(c), F.col("__a"), F.col("__b"))))


def mix_positions(docs: DataFrame, text: str = "text", seed: int = 7, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, schedules=SCHEDULES) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, positions.

    positions holds the training position in [0, 1] of each time the document
    is taken, at most max_epochs of them; taken is their number times size. A
    pass over a document counts if at least half of it lies below the source's
    target, so a source's taken words miss its target by half a document at
    most. Null and empty texts have size 0 and are never taken; null sources are one
    source, the last; nulls in doc_id stay; equal rows are told apart by nothing
    and lie end to end; texts may be of any length; extra columns don't matter;
    an empty table gives no rows. Reruns agree.
    """
    laid = _laid_out(docs, text, seed, weights, max_epochs, schedules, whole=False)
    return laid.select("doc_id", "source", "size", "source_size", "target", (F.size("positions") * F.col("size")).cast("long").alias("taken"), "positions")


def mixed_documents(docs: DataFrame, text: str = "text", seed: int = 7, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, schedules=SCHEDULES) -> DataFrame:
    """The mix itself, with all columns of docs: a row for each pass over a document, range-sorted by position.

    Which rows are taken, and how often, is as in mix_positions: texts without
    words never, null sources as one source, nulls in doc_id like others. Equal
    rows each have passes of their own. Texts may be of any length; extra
    columns, whatever their names, don't matter; an empty table gives no rows.
    """
    laid = _laid_out(docs, text, seed, weights, max_epochs, schedules, whole=True)
    passes = laid.select("__row", "doc_id", "__u", F.posexplode("positions").alias("__epoch", "__position"))
    passes = passes.orderBy("__position", "doc_id", "__u", "__epoch")
    return unpack(passes, docs)
