"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

DataFrame functions only, no Python in tasks.

A window has an item's number of words and may start at any word. It reaches
the least similarity only if enough of its places hold a shingle of that item,
wherever that stands in the item; a running count over the places that do tells
which starts these are - first for all items of one size together, then for
each item - and only those windows are cut and fingerprinted. That loses
nothing, for passages in another order neither, and spares fingerprinting every
window of every size. Fingerprints of an item and of its windows meet by
blocks: with radius + 1 blocks, two fingerprints within the radius agree in one
block at least, so a join on (item, block, its bits) finds all of them, and the
number of candidates follows the shingles that a document shares with an item,
never windows times items. What remains is checked exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import MAX_BROADCAST_BYTES, bounded, carry, fits, materialize, pick, unpack, words

SHINGLE = 5
SIMILARITY = 0.8
#: At similarity 0.8 fingerprints differ in about 10 of 64 bits with a deviation of 3, and in 12 if one side has but four shingles:
#: the radius is 8 deviations and more above that. Unlike fingerprints differ in 32 bits, so it prunes little; the shared shingles have done that before.
RADIUS = 40


def _shingles(w: Column, width: int) -> Column:
    """Hashes of an array's shingles; arrays that are too short have none."""
    n = F.size(w) - F.lit(width) + 1
    one = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)])
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), one)).otherwise(F.array().cast("array<bigint>"))


def _split(text: Column) -> Column:
    """The words of a text; one without words has a single empty one, too few for a shingle."""
    return F.split(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), "[\\x20\\x09-\\x0D]+", -1)


def _fingerprint(keyed: DataFrame, key: list[str], hashes: str) -> DataFrame:
    """key, fp: the majority of each bit over an array of hashes."""
    bits = keyed.select(*key, F.explode(hashes).alias("__h"))
    sums = [F.sum(F.shiftright("__h", b).bitwiseAND(F.lit(1))).alias(f"__b{b}") for b in range(64)]
    out = bits.groupBy(*key).agg(F.count(F.lit(1)).alias("__m"), *sums)
    fp = F.lit(0).cast("bigint")
    for b in range(64):
        fp = fp.bitwiseOR(F.when(F.col(f"__b{b}") * 2 > F.col("__m"), F.shiftleft(F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint")))
    return out.select(*key, fp.alias("fp"))


def _blocks(df: DataFrame, radius: int) -> DataFrame:
    """A row for each of radius + 1 blocks of the fingerprint: block, its bits."""
    n = radius + 1
    cut = [64 * i // n for i in range(n + 1)]
    parts = [F.struct(F.lit(i).alias("block"), F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (z - a)) - 1)).alias("bits")) for i, (a, z) in enumerate(zip(cut, cut[1:]))]
    return df.withColumn("__p", F.explode(F.array(*parts))).select("*", F.col("__p.block").alias("block"), F.col("__p.bits").alias("bits")).drop("__p")


def _least(n: Column, nd: Column, shingle: int, similarity: float) -> Column:
    """Shingles that a window must share with an item of n words: s / (both - s) >= similarity."""
    both = (F.least(n, nd) - shingle + 1) + (n - shingle + 1)
    return F.greatest(F.ceil(both * (similarity / (1 + similarity)) - 1e-9), F.lit(1)).cast("int")


def _spans(at: Column, least: Column, k: Column, end: Column) -> Column:
    """Runs of starts (a to z) whose windows of k places hold at least `least` of the ascending places `at`.

    A run ends where its first place inside leaves; `end` is the last start there is.
    """
    low = lambda i: F.greatest(F.when(i > 0, F.get(at, i - 1) + 1).otherwise(0), F.get(at, i + least - 1) - k + 1)
    runs = F.transform(F.sequence(F.lit(0), F.size(at) - least), lambda i: F.struct(low(i).alias("a"), F.least(F.get(at, i), end).alias("z")))
    return F.filter(runs, lambda x: x["a"] <= x["z"])


def _repeats(rows: DataFrame, benchmark: DataFrame, item_text: str, shingle: int, similarity: float, radius: int) -> DataFrame:
    """rows (doc_id, stamp, text) -> doc_id, stamp, item_id, n, start, n_shared, n_all, similarity of every window that is similar enough."""
    items = pick(benchmark, "item_id", item_text).select("item_id", words(F.lower(F.col(item_text))).alias("w")).where("item_id is not null").distinct()
    items = items.select("item_id", F.size("w").alias("n"), _shingles(F.col("w"), shingle).alias("ih")).where(F.size("ih") > 0)
    items = materialize(items.withColumn("item", F.monotonically_increasing_id()), "decon-items")
    held = materialize(items.select("item", "n", F.explode("ih").alias("h")).groupBy("item", "n", "h").agg(F.count(F.lit(1)).alias("times")), "decon-seeds")

    # rows of a few numbers each: their counts bound their bytes
    few = lambda df, rows: F.broadcast(df) if 64 * rows <= MAX_BROADCAST_BYTES else df
    n_items, n_held = items.count(), held.count()

    # 1. where windows may lie, first by items' sizes and then by item
    hashed = rows.select("doc_id", "stamp", _split(F.lower("text")).alias("w"))
    # positions are generated and hashed inside one stage of generated code; the array of words is not copied
    hashed = hashed.select("doc_id", "stamp", "w", F.explode(F.when(F.size("w") >= shingle, F.sequence(F.lit(0), F.size("w") - shingle))).alias("p"))
    hashed = hashed.select("doc_id", "stamp", F.size("w").alias("nd"), "p", F.xxhash64(*[F.get("w", F.col("p") + k) for k in range(shingle)]).alias("h"))
    found = hashed.join(few(held.select("n", "h").distinct(), n_held), "h").groupBy("doc_id", "stamp", "n", "nd").agg(F.sort_array(F.collect_set(F.struct("p", "h"))).alias("hits"))
    n, nd = F.col("n"), F.col("nd")
    least, k, end = _least(n, nd, shingle, similarity), F.least(n, nd) - shingle + 1, F.greatest(nd - n, F.lit(0))
    sized = lambda df: df.withColumn("least", least).where(F.size("at") >= F.col("least")).withColumn("runs", _spans(F.col("at"), F.col("least"), k, end)).where(F.size("runs") > 0)
    found = materialize(sized(found.withColumn("at", F.col("hits.p"))).select("doc_id", "stamp", "n", "nd", "hits"), "decon-hits")
    hits = found.select("doc_id", "stamp", "n", "nd", F.explode("hits").alias("x")).select("doc_id", "stamp", "n", "nd", "x.p", "x.h")
    near = hits.join(few(held.select("item", "n", "h"), n_held), ["n", "h"]).groupBy("doc_id", "stamp", "item", "n", "nd").agg(F.sort_array(F.collect_set("p")).alias("at"))
    starts = sized(near).select("doc_id", "stamp", "item", "n", F.explode("runs").alias("x")).select("doc_id", "stamp", "item", "n", F.explode(F.sequence("x.a", "x.z")).alias("start"))
    windows = materialize(starts, "decon-windows")

    # 2. cut them from the documents that have any, and fingerprint both sides
    holders = windows.groupBy(F.col("doc_id").alias("__d"), F.col("stamp").alias("__s")).agg(F.collect_list(F.struct("item", "n", "start")).alias("at"))
    holders = F.broadcast(holders) if fits(windows) else holders
    own = rows.join(holders, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("stamp") == F.col("__s")))
    own = own.dropDuplicates(["doc_id", "stamp"]).select("doc_id", "stamp", _split(F.lower("text")).alias("w"), F.explode("at").alias("at"))
    # the slice is a column of its own, else it would be cut anew for every word
    own = own.select("doc_id", "stamp", "at.*", F.slice("w", F.col("at.start") + 1, F.col("at.n")).alias("w"))
    cut = own.select("doc_id", "stamp", "item", "n", "start", _shingles(F.col("w"), shingle).alias("wh"))
    cut = materialize(cut.withColumn("window", F.monotonically_increasing_id()), "decon-cut")
    window_fp = _fingerprint(cut, ["window", "item"], "wh")
    item_fp = _fingerprint(items, ["item"], "ih")

    # 3. windows within the radius of their item, by blocks
    right = _blocks(item_fp, radius).withColumnRenamed("fp", "item_fp")
    near = _blocks(window_fp, radius).join(few(right, n_items * (radius + 1)), ["item", "block", "bits"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
    # written here, so that the driver plans and compiles fewer stages at once
    near = materialize(near.select("window").distinct(), "decon-near")

    # 4. the exact similarity: a shared shingle counts as often as both have it
    again = cut.join(near, "window").select("window", "item", F.explode("wh").alias("h")).groupBy("window", "item", "h").agg(F.count(F.lit(1)).alias("c"))
    shared = again.join(few(held.select("item", "h", "times"), n_held), ["item", "h"]).groupBy("window").agg(F.sum(F.least("c", "times")).alias("n_shared"))
    sizes = bounded(items.select("item", "item_id", F.size("ih").alias("m")))
    full = cut.select("window", "doc_id", "stamp", "item", "n", "start", F.size("wh").alias("k")).join(shared, "window").join(sizes, "item")
    full = full.withColumn("n_all", F.col("k") + F.col("m") - F.col("n_shared")).withColumn("similarity", F.col("n_shared") / F.col("n_all"))
    return full.where(F.col("similarity") >= similarity).select("doc_id", "stamp", "item_id", "n", "start", "n_shared", "n_all", "similarity")


def _stamped(df: DataFrame, text: str) -> DataFrame:
    return df.select("doc_id", F.xxhash64(F.col(text)).alias("stamp"), F.col(text).alias("text")).where("text is not null")


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_text: str = "text",
    shingle: int = SHINGLE,
    similarity: float = SIMILARITY,
    radius: int = RADIUS,
) -> DataFrame:
    """Pairs of a document and a benchmark item that it repeats: doc_id, item_id, n_shared, n_all, similarity, start, n_words.

    n_shared and n_all are the shingles in both and in either of the best
    window, each weighted by its number of repeats; of equals the first window
    goes; similarity is their quotient, `similarity` at least. start is the
    window's first word. Texts are lower-cased. A document shorter than an item
    is one window. Items with fewer words than a shingle, null and empty texts,
    and rows with a null id match nothing; equal rows are one, and of several
    texts with one id the best window goes. Texts may be of any length. Extra
    columns, whatever their names, don't matter, and an empty table on either
    side gives no rows.
    """
    rows = _stamped(pick(docs, "doc_id", text).where("doc_id is not null"), text)
    full = _repeats(rows, benchmark, item_text, shingle, similarity, radius)
    best = full.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"), "n_shared", "n_all", "n")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_shared", "b.n_all", "b.similarity", (-F.col("b.s")).cast("long").alias("start"), F.col("b.n").cast("long").alias("n_words"))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS
) -> DataFrame:
    """The documents that repeat no item, with all their columns and as often as they are there.

    A row goes by its own text, so rows without a doc_id, and others with the
    same doc_id, are judged for themselves. Null and empty texts stay. Items
    without an id are ignored. With an empty benchmark all rows stay. Texts may
    be of any length; extra columns, whatever their names, don't matter; an
    empty table stays empty.
    """
    rows = _stamped(pick(docs, "doc_id", text), text)
    bad = _repeats(rows, benchmark, item_text, shingle, similarity, radius).select(F.col("doc_id").alias("__bad"), F.col("stamp").alias("__stamp")).distinct()
    bad = bounded(materialize(bad, "decon-bad"))
    return unpack(carry(docs, "doc_id", text).join(bad, F.col("doc_id").eqNullSafe(F.col("__bad")) & (F.xxhash64(F.col(text)) == F.col("__stamp")), "left_anti"), docs)
