"""The ledger of recorded changes: a closed vocabulary, canonical totals, derived flags, its stored form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 2
STAGES = ("upstream", "simplification", "triangulation")
#: kind, category, side, needs_detail, changes_topology (fixed values).
KINDS = [
    ("dropped_part", "loss", "removed", True, True),
    ("dropped_hole", "loss", "added", True, True),
    ("dropped_islet", "loss", "removed", True, True),
    ("dropped_source_hole", "loss", "added", True, True),
    ("skipped_part", "loss", "removed", False, True),
    ("skipped_ring", "loss", "added", False, True),
    ("degenerate_triangle", "loss", "neutral", False, False),
    ("part_merge", "change", "added", False, True),
    ("part_split", "change", "removed", False, True),
    ("part_created", "change", "added", True, True),
    ("artifact_hole_removed", "change", "neutral", False, False),
    ("hole_merge", "change", "neutral", False, True),
    ("hole_split", "change", "neutral", False, True),
    ("boundary_retreat", "change", "removed", False, False),
    ("boundary_advance", "change", "added", False, False),
    ("severe_shrink", "change", "neutral", True, False),
]
EVENT = "stage string, kind string, count long, area double, details array<string>"


def kinds(spark: SparkSession) -> DataFrame:
    """The dimension table, 16 rows."""
    table = spark.createDataFrame(KINDS, "kind string, category string, side string, needs_detail boolean, changes_topology boolean")
    return table.withColumn("picking_unsafe", (F.col("category") == "loss") | F.col("changes_topology"))


def _stage_rank():
    return F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage"))


def described(events: DataFrame) -> DataFrame:
    """Events with their kind's columns; those of an unknown kind have nulls there."""
    return events.join(F.broadcast(kinds(events.sparkSession)), "kind", "left")


def canonical(events: DataFrame, *by: str) -> DataFrame:
    """One row per `by`, stage and kind: counts and areas summed, details in order of seq; empty events are dropped.

    events has `by`, stage, kind, count, area, details, seq. Partial sums are
    made before the shuffle; details are sorted, so the result is the same
    however the rows were dealt.
    """
    real = events.where((F.col("count") > 0) | (F.col("area") > 0))
    out = real.groupBy(*by, "stage", "kind").agg(
        F.sum("count").alias("count"), F.sum("area").alias("area"), F.array_sort(F.collect_list(F.struct("seq", "details"))).alias("d")
    )
    return out.withColumn("details", F.flatten(F.transform("d", lambda x: F.coalesce(x["details"], F.array().cast("array<string>"))))).drop("d").withColumn("stage_rank", _stage_rank())


def merged(first: DataFrame, second: DataFrame, *by: str) -> DataFrame:
    """The ledger of both, details of the first before those of the second."""
    both = first.withColumn("seq", F.struct(F.lit(0).alias("o"), F.col("seq"))).unionByName(second.withColumn("seq", F.struct(F.lit(1).alias("o"), F.col("seq"))))
    return canonical(both, *by)


def flags(events: DataFrame, *by: str) -> DataFrame:
    """Per `by`: lossy, topology_changed, picking_unsafe, removed_area, added_area, n_loss, n_change, stages."""
    e = described(events)
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("area")).otherwise(0.0))
    return e.groupBy(*by).agg(
        F.bool_or(F.col("category") == "loss").alias("lossy"),
        F.bool_or("changes_topology").alias("topology_changed"),
        F.bool_or("picking_unsafe").alias("picking_unsafe"),
        side("removed").alias("removed_area"),
        side("added").alias("added_area"),
        F.sum(F.when(F.col("category") == "loss", F.col("count")).otherwise(0)).alias("n_loss"),
        F.sum(F.when(F.col("category") == "change", F.col("count")).otherwise(0)).alias("n_change"),
        F.array_sort(F.collect_set("stage")).alias("stages"),
    )


def invalid_events(events: DataFrame) -> DataFrame:
    """Events that no constructor would accept, with the first rule each breaks."""
    e = described(events)
    rule = (
        F.when(F.col("stage").isNull() | ~F.col("stage").isin(*STAGES), "unknown_stage")
        .when(F.col("category").isNull(), "unknown_kind")
        .when(F.col("count").isNull() | (F.col("count") < 0), "negative_count")
        .when(F.col("area").isNull() | F.isnan("area") | (F.col("area") < 0), "negative_area")
        .when(F.col("needs_detail") & (F.coalesce(F.size("details"), F.lit(0)) != F.col("count")), "detail_count")
    )
    return e.withColumn("rule", rule).where(F.col("rule").isNotNull()).select(*events.columns, "rule")


def client_flags_wrong(stated: DataFrame, events: DataFrame, *by: str) -> DataFrame:
    """Rows of stated (by, topology_changed, picking_unsafe) that the events of all stages contradict, or that are null."""
    derived = flags(events, *by).select(*by, F.col("topology_changed").alias("t"), F.col("picking_unsafe").alias("p"))
    both = stated.join(derived, list(by), "left").withColumn("t", F.coalesce("t", F.lit(False))).withColumn("p", F.coalesce("p", F.lit(False)))
    each = F.array(
        F.struct(F.lit("topologyChanged").alias("flag"), F.col("topology_changed").alias("stated"), F.col("t").alias("derived")),
        F.struct(F.lit("pickingUnsafe").alias("flag"), F.col("picking_unsafe").alias("stated"), F.col("p").alias("derived")),
    )
    return both.select(*by, F.inline(each)).where(~F.col("stated").eqNullSafe(F.col("derived")))


def serialised(events: DataFrame, *by: str) -> DataFrame:
    """Per `by`, block: the ledger of its events as JSON, in canonical order; the flag `lossy` follows from them."""
    e = described(canonical(events, *by))
    one = F.struct("stage_rank", "kind", F.struct("stage", "kind", "count", "area", "details").alias("event"))
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("area")).otherwise(0.0))
    whole = e.groupBy(*by).agg(
        F.array_sort(F.collect_list(one)).alias("e"), F.collect_set("stage").alias("seen"), side("removed").alias("removed"), side("added").alias("added"), F.bool_or(F.col("category") == "loss").alias("lossy")
    )
    stages = F.array(*[F.lit(s) for s in STAGES])
    block = F.struct(
        F.lit(SCHEMA_VERSION).alias("schemaVersion"),
        stages.alias("stages"),
        F.filter(stages, lambda s: F.array_contains("seen", s)).alias("stagesRecorded"),
        F.col("e.event").alias("events"),
        F.col("removed").alias("removedArea"),
        F.col("added").alias("addedArea"),
        F.col("lossy").alias("lossy"),
    )
    return whole.select(*by, F.to_json(block).alias("block"))


def parsed(blocks: DataFrame, *by: str) -> tuple[DataFrame, DataFrame]:
    """Stored ledgers (by, block) -> (events: by, seq, stage, kind, count, area, details; problems: by, seq, rule).

    Fails closed: a block without the schema's version or lists gives no events
    and one problem (seq is null); so does an event without its keys, of an
    unknown stage or kind, or with a wrong count, area or list of details.
    """
    v = F.try_parse_json("block")
    is_list = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")).startswith("ARRAY"), F.lit(False))
    rule = (
        F.when(F.col("block").isNull(), "no_block")
        .when(v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"), "not_an_object")
        .when(F.coalesce(F.try_variant_get(v, "$.schemaVersion", "int"), F.lit(-1)) != SCHEMA_VERSION, "schema_version")
        .when(~is_list("$.events"), "no_events")
        .when(~is_list("$.stagesRecorded"), "no_stages_recorded")
    )
    read = blocks.withColumn("rule", rule).withColumn("v", v)
    broken = read.where("rule is not null").select(*by, F.lit(None).cast("int").alias("seq"), "rule")
    one = read.where("rule is null").select(*by, F.posexplode(F.try_variant_get("v", "$.events", "array<variant>")).alias("seq", "e"))
    get = lambda key, kind: F.try_variant_get("e", f"$.{key}", kind)
    details = get("details", "variant")
    shape = (
        F.when(F.col("e").isNull() | ~F.schema_of_variant("e").startswith("OBJECT"), "not_an_object")
        .when(get("stage", "string").isNull() | get("kind", "string").isNull() | get("count", "long").isNull(), "missing_key")
        .when(details.isNotNull() & ~F.schema_of_variant(details).startswith("ARRAY"), "details")
    )
    area = F.when(get("area", "variant").isNull(), 0.0).otherwise(get("area", "double"))
    typed = one.select(*by, "seq", shape.alias("shape"), get("stage", "string").alias("stage"), get("kind", "string").alias("kind"), get("count", "long").alias("count"), area.alias("area"), F.coalesce(get("details", "array<string>"), F.array().cast("array<string>")).alias("details"))
    events = typed.where("shape is null").drop("shape")
    wrong = invalid_events(events).select(*by, "seq", "rule")
    problems = broken.unionByName(typed.where("shape is not null").select(*by, "seq", F.col("shape").alias("rule"))).unionByName(wrong)
    return events.join(wrong.select(*by, "seq"), [*by, "seq"], "left_anti"), problems


def upstream_only(events: DataFrame) -> DataFrame:
    """What a loaded dataset may say about itself: events of the stage upstream; any other is an error of its producer."""
    return events.where(F.when(F.col("stage") == STAGES[0], True).otherwise(F.raise_error(F.concat(F.lit("a dataset may record upstream events only, found "), F.coalesce("stage", F.lit("null")))).cast("boolean")))
