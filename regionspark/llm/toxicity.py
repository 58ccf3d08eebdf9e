"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression.

Features are densities of insults (a fixed list and a list learned from the
labelled rows), their distance to second-person words, capitals, punctuation and
obfuscation rates. Boosted trees (Spark ML) rank the texts; isotonic regression
on labelled rows that the trees have not seen turns their output into a
probability. All fits use at most MAX_LABELLED labelled rows, chosen by a hash.
"""

from __future__ import annotations

from typing import NamedTuple

import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import hash_sample, held_out, materialize, pick
from .textfeat import ToxicLexicon, bare, lexicon_keys

#: Most labelled rows that any part of the fit sees.
MAX_LABELLED = 12_000
#: Most keys of the learned list, and what a key needs to be on it.
MAX_KEYS = 2_000
MIN_TOXIC = 3
MIN_RATIO = 20.0
THRESHOLD = 0.5


def _labelled(docs: DataFrame, labels: DataFrame, text: str, label: str) -> DataFrame:
    """doc_id, text, y, part (0-3 fit, 4 calibration) of at most MAX_LABELLED rows that may be learned from."""
    rows = pick(labels, "doc_id", label).where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("__d")).agg(F.max(label).cast("double").alias("y"))
    # labels without a document use up no places
    rows = rows.join(pick(docs, "doc_id").select(F.col("doc_id").cast("long").alias("__have")), F.col("__d") == F.col("__have"), "left_semi")
    rows = hash_sample(rows, MAX_LABELLED, "__d").select("__d", "y", F.pmod(F.xxhash64("__d", F.lit(1)), F.lit(5)).cast("int").alias("part"))
    texts = pick(docs, "doc_id", text).select(F.col("doc_id").cast("long"), F.col(text).alias("text"))
    # at most MAX_LABELLED rows of 20 bytes are broadcast
    found = texts.join(F.broadcast(rows), F.col("doc_id") == F.col("__d")).dropDuplicates(["doc_id"])
    return found.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "y", "part")


def learn_lexicon(labelled: DataFrame, max_keys: int = MAX_KEYS, min_toxic: int = MIN_TOXIC, min_ratio: float = MIN_RATIO) -> frozenset[str]:
    """Words and word beginnings far more frequent in toxic texts: by documents that hold them, rates compared with one more clean text."""

    def count(batches):
        from collections import Counter

        toxic, clean = Counter(), Counter()
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                keys = {k for w in {bare(w) for w in t.split()} if 3 <= len(w) <= 40 for k in lexicon_keys(w)}
                (toxic if y == 1 else clean).update(keys)
        names = list(toxic)  # a key that no toxic text holds is of no use
        for i in range(0, len(names), 10_000):
            part = names[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([toxic[k] for k in part], pa.int64()), pa.array([clean[k] for k in part], pa.int64())], names=["key", "a", "b"])
        rest = [k for k in clean if k not in toxic]
        for i in range(0, len(rest), 10_000):
            part = rest[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([0] * len(part), pa.int64()), pa.array([clean[k] for k in part], pa.int64())], names=["key", "a", "b"])

    n = {r["y"]: r["n"] for r in labelled.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    counted = labelled.select("text", "y").mapInArrow(count, "key string, a long, b long").groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    ratio = (F.col("a") / F.lit(float(n.get(1.0, 0) or 1))) / ((F.col("b") + 1) / F.lit(float(n.get(0.0, 0) + 1)))
    # the fewer toxic texts hold a key, the less chance must explain it
    kept = counted.where(F.col("a") >= min_toxic).withColumn("r", ratio).where((F.col("r") >= min_ratio) & (F.col("a") * F.log2("r") >= 14))
    return frozenset(r["key"] for r in kept.orderBy(F.desc(F.col("a") * F.log2("r")), "key").limit(max_keys).collect())


def features(docs: DataFrame, learned: frozenset[str], text: str = "text", *more: str) -> DataFrame:
    """The columns `more`, and x: the dense features of each row's whole text."""
    rows = docs.select(F.col(text).alias("__t"), *more)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    lexicon = docs.sparkSession.sparkContext.broadcast(learned)  # MAX_KEYS short strings at most

    def run(batches):
        look = ToxicLexicon(lexicon.value)
        for b in batches:
            x = [look.features(t.as_py() or "") for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(x, pa.list_(pa.float64()))], names=[*more, "x"])

    return rows.mapInArrow(run, ", ".join([*(f"{m} {types[m]}" for m in more), "x array<double>"]))


class Model(NamedTuple):
    """What a fit gives: the learned list, boosted trees and their isotonic calibration; without both classes only the rate of toxic rows."""

    rate: float
    learned: frozenset[str] = frozenset()
    trees: GBTClassificationModel | None = None
    level: IsotonicRegressionModel | None = None


def _raw(trees: GBTClassificationModel, df: DataFrame) -> DataFrame:
    return trees.transform(df).withColumn("p", vector_to_array("probability")[1])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic") -> Model:
    """List and trees from four fifths of the labelled rows, the calibration from the rest."""
    labelled = materialize(_labelled(docs, labels, text, label), "toxic-labelled")
    rate = labelled.agg(F.avg("y"), F.min("y"), F.max("y")).first()
    if rate[0] is None or rate[1] == rate[2]:
        return Model(float(rate[0] or 0))
    learned = learn_lexicon(labelled.where("part < 4"))
    train = materialize(features(labelled, learned, "text", "y", "part"), "toxic-train").select("y", "part", array_to_vector("x").alias("features"))
    fit_rows, rest = train.where("part < 4"), train.where("part = 4")
    classes = {r["part"]: r["n"] for r in train.groupBy((F.col("part") == 4).cast("int").alias("part")).agg(F.countDistinct("y").alias("n")).collect()}
    if classes.get(0, 0) < 2 or classes.get(1, 0) < 2:  # too few rows to set some aside
        fit_rows = rest = train
    trees = GBTClassifier(featuresCol="features", labelCol="y", maxIter=20, maxDepth=4, stepSize=0.3, seed=7, maxBins=64).fit(fit_rows.coalesce(4))
    level = IsotonicRegression(featuresCol="p", labelCol="y", predictionCol="score").fit(_raw(trees, rest).select("p", "y").coalesce(1))
    return Model(float(rate[0]), learned, trees, level)


def score_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score.

    Held-out rows give no label. Null and empty texts are scored by their zero
    features, texts of any length by all of theirs; null doc_ids are scored but
    never learned from, an id labelled both ways counts as toxic, labels
    without a document are ignored, extra columns don't matter, and an empty
    table gives no rows. If the labelled rows hold one class only, every text
    gets that class's rate (0 if there are none).
    """
    model = fit(docs, labels, text, label)
    rows = pick(docs, "doc_id", text).select(F.col("doc_id").cast("long"), F.col(text).alias("text"))
    out = held_out(F.col("doc_id")).alias("held_out")
    if model.trees is None:
        return rows.select("doc_id", out, F.lit(model.rate).alias("score"))
    feats = features(rows, model.learned, "text", "doc_id").select("doc_id", array_to_vector("x").alias("features"))
    scored = model.level.transform(_raw(model.trees, feats))
    return scored.select("doc_id", out, F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0)).alias("score"))
