"""Topology of noded coverages from shared edges and vertices: equi-joins instead of overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .._store import expanded, stored


def point_key(x: Column, y: Column) -> Column:
    """The endpoint with nine decimals, without the sign of a zero."""
    return F.format_string("%.9f,%.9f", x + 0.0, y + 0.0)


def ring_edges(rings: DataFrame) -> DataFrame:
    """territory, part, ring + open vertices (array of points) -> a row per edge with its undirected key."""
    nxt = F.concat(F.slice("points", 2, F.greatest(F.size("points") - 1, F.lit(0))), F.slice("points", 1, 1))
    e = rings.select("territory", "part", "ring", F.posexplode(F.arrays_zip(F.col("points").alias("a"), nxt.alias("b"))).alias("seq", "e"))
    e = e.select("territory", "part", "ring", "seq", F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by"))
    a, b = point_key(F.col("ax"), F.col("ay")), point_key(F.col("bx"), F.col("by"))
    return e.withColumn("edge", F.concat_ws(";", F.least(a, b), F.greatest(a, b)))


def shared_edges(edges: DataFrame) -> DataFrame:
    """edge, uses of edges that occur more than once."""
    return edges.groupBy("edge").agg(F.count(F.lit(1)).alias("uses")).where("uses > 1")


def outline(edges: DataFrame) -> DataFrame:
    """Edges used exactly once: the boundary of the union of the coverage."""
    return edges.join(edges.groupBy("edge").agg(F.count(F.lit(1)).alias("uses")).where("uses = 1").select("edge").hint("merge"), "edge", "left_semi")


def _classes(one: DataFrame, *facts: str) -> tuple[DataFrame, DataFrame]:
    """(class, member) of territories with equal sets of `facts` columns, and class and facts, once a class."""
    digest = F.sha2(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct(*facts))).alias("f"))), 256)
    classes = stored(one.groupBy("territory").agg(digest.alias("class")).select("class", F.col("territory").alias("member")), "classes")
    first = classes.groupBy("class").agg(F.min("member").alias("territory"))
    return classes, stored(one.join(first.hint("merge"), "territory").select("class", *facts), "class-facts")


def _sides(facts: DataFrame, key: list[str], *rest: str) -> DataFrame:
    """Pairs of classes, each once and with itself, that share a key."""
    side = lambda s: facts.select(*key, F.col("class").alias(f"{s}_class"), *[F.col(c).alias(f"{s}_{c}") for c in rest])
    return side("l").join(side("r").hint("merge"), key).where("l_class <= r_class")


def _ordered(pairs: DataFrame) -> DataFrame:
    """left < right of expanded pairs; turned tells that left is the member of r_class."""
    met = pairs.where("l <> r AND (l_class <> r_class OR l < r)").withColumn("turned", F.col("l") > F.col("r"))
    return met.withColumns({"left": F.least("l", "r"), "right": F.greatest("l", "r")})


def neighbours(edges: DataFrame) -> DataFrame:
    """left < right territories that share an edge, with the number of edges and their total length.

    Territories with the same edges are one class: classes meet by edge, and
    their pairs are written out by member, so no row of a pair is shuffled once an edge.
    """
    length = F.sqrt(F.pow(F.col("bx") - F.col("ax"), 2) + F.pow(F.col("by") - F.col("ay"), 2))
    one = stored(edges.groupBy("edge", "territory").agg(F.min(length).alias("length")), "territory-edges")
    classes, facts = _classes(one, "edge", "length")
    met = _sides(facts, ["edge"], "length").groupBy("l_class", "r_class").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("l_length").alias("l_length"), F.sum("r_length").alias("r_length"))
    return _ordered(expanded(met, classes)).select("left", "right", "n_edges", F.when(F.col("turned"), F.col("r_length")).otherwise(F.col("l_length")).alias("length"))


def touching(edges: DataFrame) -> DataFrame:
    """left < right territories that share a vertex, with the number of vertices; by classes, as neighbours."""
    v = stored(edges.select("territory", (F.col("ax") + 0.0).alias("x"), (F.col("ay") + 0.0).alias("y")).distinct(), "territory-vertices")
    classes, facts = _classes(v, "x", "y")
    met = _sides(facts, ["x", "y"]).groupBy("l_class", "r_class").agg(F.count(F.lit(1)).alias("n_vertices"))
    return _ordered(expanded(met, classes)).select("left", "right", "n_vertices")
