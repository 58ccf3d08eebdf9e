"""Box joins without a theta join: boxes are dealt to grid cells and meet in one cell only.

A pair that overlaps shares the cell of its reference point (the larger of both
lower corners on either axis), so keeping pairs in that cell alone needs no
distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cells(df: DataFrame, cell: float, prefix: str, by: tuple[str, ...] = ()) -> DataFrame:
    c = lambda name: F.floor(F.col(name) / cell)
    out = df.select(*[F.col(n).alias(n if n in by else f"{prefix}{n}") for n in df.columns], c("min_x").alias("x0"), c("max_x").alias("x1"), c("min_y").alias("y0"), c("max_y").alias("y1"))
    out = out.withColumn("cx", F.explode(F.sequence("x0", "x1"))).withColumn("cy", F.explode(F.sequence("y0", "y1")))
    return out.drop("x0", "x1", "y0", "y1")


def cell_size(boxes: DataFrame) -> float:
    """The median of the boxes' longer sides: most boxes then lie in few cells."""
    side = boxes.agg(F.expr("approx_percentile(greatest(max_x - min_x, max_y - min_y), 0.5)").alias("s")).first()["s"]
    return float(side) if side else 1.0


def box_join(left: DataFrame, right: DataFrame, cell: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs with equal `by` columns whose closed boxes meet: columns of `by`, l_* and r_*. Equal to the theta join on min/max."""
    a, b = _cells(left, cell, "l_", by), _cells(right, cell, "r_", by)
    meet = (F.col("l_min_x") <= F.col("r_max_x")) & (F.col("l_max_x") >= F.col("r_min_x")) & (F.col("l_min_y") <= F.col("r_max_y")) & (F.col("l_max_y") >= F.col("r_min_y"))
    here = (F.floor(F.greatest("l_min_x", "r_min_x") / cell) == F.col("cx")) & (F.floor(F.greatest("l_min_y", "r_min_y") / cell) == F.col("cy"))
    return a.join(b.hint("merge"), [*by, "cx", "cy"]).where(meet & here).drop("cx", "cy")


def point_join(points: DataFrame, boxes: DataFrame, cell: float) -> DataFrame:
    """points (x, y, ...) in closed boxes: columns p_* and b_*; a point is in one cell, so it meets a box once."""
    p = points.select(*[F.col(n).alias(f"p_{n}") for n in points.columns]).withColumn("cx", F.floor(F.col("p_x") / cell)).withColumn("cy", F.floor(F.col("p_y") / cell))
    b = _cells(boxes, cell, "b_")
    inside = F.col("p_x").between(F.col("b_min_x"), F.col("b_max_x")) & F.col("p_y").between(F.col("b_min_y"), F.col("b_max_y"))
    return p.join(b.hint("merge"), ["cx", "cy"]).where(inside).drop("cx", "cy")


#: Groups of so many rows at most on either side meet whole; larger ones by grid.
SMALL = 512


def _small_first(left: DataFrame, right: DataFrame, by: tuple[str, ...]) -> tuple[DataFrame, DataFrame | None]:
    """(left rows of groups that are small on both sides, the large groups or None if there are none)."""
    one = lambda df, s: df.select(*by, F.lit(int(s == "l")).alias("__l"), F.lit(int(s == "r")).alias("__r"))
    n = one(left, "l").unionByName(one(right, "r")).groupBy(*by).agg(F.greatest(F.sum("__l"), F.sum("__r")).alias("__n"))
    large = n.where(F.col("__n") > SMALL).select(*by)
    few = left.join(n.where(F.col("__n") <= SMALL).hint("merge"), [*by]).drop("__n")
    return few, None if large.isEmpty() else large


def _prefixed(df: DataFrame, prefix: str, by: tuple[str, ...]) -> DataFrame:
    return df.select(*[F.col(n).alias(n if n in by else f"{prefix}{n}") for n in df.columns])


def aspect(boxes: DataFrame) -> float:
    """The usual height of boxes over their usual width, where both are above zero: grids of such cells fit flat boxes, too."""
    s = boxes.agg(*[F.expr(f"approx_percentile(max_{z} - min_{z}, 0.5)") for z in "xy"]).first()
    return float(s[1]) / float(s[0]) if s[0] and s[1] else 1.0


def _level(size: Column) -> Column:
    """The exponent of the least power of two that is no smaller than size; points count as 2 ** -20."""
    return F.when(size > 0, F.ceil(F.log2(size))).otherwise(F.lit(-20)).cast("int")


def _levels(*sides: DataFrame) -> list[int]:
    """The levels that boxes have: exponents of doubles, so a short list whatever the number of rows."""
    found: set[int] = set()
    for df in sides:
        found |= {r[0] for r in df.select("level").distinct().collect()}
    return sorted(found)


def _spread(df: DataFrame, prefix: str, by: tuple[str, ...], levels: list[int], own: bool, aspect: float) -> DataFrame:
    """Rows in the cells of their own level, or in those of all coarser levels that there are; up to four cells a level."""
    out = df.select(*[F.col(n).alias(n if n in by else f"{prefix}{n}") for n in df.columns])
    low = F.col(f"{prefix}level")
    at = F.array(low) if own else F.filter(F.array(*[F.lit(v) for v in levels]), lambda v: v > low)
    out = out.withColumn("level", F.explode(at)).withColumn("__w", F.pow(F.lit(2.0), F.col("level")))
    cell = lambda c, by: F.floor(F.col(f"{prefix}{c}") / by)
    w, h = F.col("__w"), F.col("__w") * aspect
    out = out.withColumn("cx", F.explode(F.sequence(cell("min_x", w), cell("max_x", w)))).withColumn("cy", F.explode(F.sequence(cell("min_y", h), cell("max_y", h))))
    return out.drop("__w")


def level_join(left: DataFrame, right: DataFrame, by: tuple[str, ...] = (), aspect: float = 1.0) -> DataFrame:
    """Pairs of rows with equal `by` columns whose closed boxes meet: columns of `by`, l_* and r_*.

    Each box lies in the cells of a grid as coarse as itself, four at most, so
    one huge box among small ones costs four rows, not all cells below it. A
    pair meets on the coarser of its two grids, in the cell of its reference
    point: the coarser box is there by itself and the finer one as a guest.
    Guests of one cell never meet each other. Cells are `aspect` times as high as wide.

    Rows of a group of at most SMALL rows meet without a grid, so they are
    shuffled once, and each is held against SMALL others at most.
    """
    meet = (F.col("l_min_x") <= F.col("r_max_x")) & (F.col("l_max_x") >= F.col("r_min_x")) & (F.col("l_min_y") <= F.col("r_max_y")) & (F.col("l_max_y") >= F.col("r_min_y"))
    small = None
    if by:
        few, large = _small_first(left, right, by)
        small = _prefixed(few, "l_", by).join(_prefixed(right, "r_", by).hint("merge"), [*by]).where(meet)
        if large is None:
            return small
        left, right = (df.join(large.hint("merge"), [*by], "left_semi") for df in (left, right))
    sized = lambda df: df.withColumn("level", _level(F.greatest(F.col("max_x") - F.col("min_x"), (F.col("max_y") - F.col("min_y")) / aspect)))
    a, b = sized(left), sized(right)
    levels = _levels(a, b)
    keys = [*by, "level", "cx", "cy"]
    own_a, own_b = _spread(a, "l_", by, levels, True, aspect), _spread(b, "r_", by, levels, True, aspect)
    pairs = own_a.join(own_b.hint("merge"), keys)
    if len(levels) > 1:
        pairs = pairs.unionByName(own_a.join(_spread(b, "r_", by, levels, False, aspect).hint("merge"), keys)).unionByName(_spread(a, "l_", by, levels, False, aspect).join(own_b.hint("merge"), keys))
    w = F.pow(F.lit(2.0), F.col("level"))
    here = (F.floor(F.greatest("l_min_x", "r_min_x") / w) == F.col("cx")) & (F.floor(F.greatest("l_min_y", "r_min_y") / (w * aspect)) == F.col("cy"))
    pairs = pairs.where(meet & here).drop("level", "cx", "cy", "l_level", "r_level")
    return pairs if small is None else pairs.unionByName(small)


def stab_join(probes: DataFrame, walls: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Probes (at, ...) with the walls (low, high, ...; low < high) of equal `by` columns for which low <= at < high: p_* and w_*.

    One-dimensional, with levels as in level_join: a wall lies in two cells at
    most, and a probe looks into one cell of each level. Small groups meet whole, as there.
    """
    within = (F.col("w_low") <= F.col("p_at")) & (F.col("p_at") < F.col("w_high"))
    few, large = _small_first(probes, walls, by)
    small = _prefixed(few, "p_", by).join(_prefixed(walls, "w_", by).hint("merge"), [*by]).where(within)
    if large is None:
        return small
    probes, walls = (df.join(large.hint("merge"), [*by], "left_semi") for df in (probes, walls))
    walls = walls.withColumn("level", _level(F.col("high") - F.col("low")))
    levels = _levels(walls)
    if not levels:
        levels = [0]
    w = F.pow(F.lit(2.0), F.col("level"))
    ws = walls.select(*[F.col(n).alias(n if n in by or n == "level" else f"w_{n}") for n in walls.columns])
    ws = ws.withColumn("cell", F.explode(F.sequence(F.floor(F.col("w_low") / w), F.floor(F.col("w_high") / w))))
    ps = probes.select(*[F.col(n).alias(n if n in by else f"p_{n}") for n in probes.columns]).withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels]))).withColumn("cell", F.floor(F.col("p_at") / w))
    return ps.join(ws.hint("merge"), [*by, "level", "cell"]).where(within).drop("level", "cell").unionByName(small)
