"""Publishing snapshots: content hashes, reconciliation, retention, cache eviction, file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LODS = ("high", "medium", "low")
KEEP = 3
LEASE_SECONDS = 300
RESERVED = ("con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10)))


def revision_ids(files: DataFrame, *by: str) -> DataFrame:
    """Per `by`, the id of a snapshot of files (lod, path, content): a hash over levels in order and paths sorted.

    Each file is reduced to its digest before rows meet, so what is gathered per
    snapshot is some 100 bytes a file. path starts with its level.
    """
    one = F.concat(
        F.lpad(F.hex(F.octet_length("path").cast("long")), 8, "0"), F.hex(F.col("path").cast("binary")), F.lpad(F.hex(F.octet_length("content").cast("long")), 16, "0"), F.sha2(F.col("content").cast("binary"), 256)
    )
    rank = F.array_position(F.array(*[F.lit(x) for x in LODS]), F.col("lod"))
    rows = files.where(F.col("lod").isin(*LODS)).select(*by, F.struct(rank.alias("r"), F.col("path").alias("p"), one.alias("b")).alias("s"))
    rows = rows.groupBy(*by).agg(F.array_sort(F.collect_list("s")).alias("s"))
    return rows.select(*by, F.sha2(F.unhex(F.array_join(F.col("s.b"), "")), 256).alias("revision_id"), F.size("s").alias("n_files"))


def cache_key(dataset: Column, lod: Column, encoding: Column, ids: Column) -> Column:
    """The same for every order of ids and however often each is named."""
    return F.sha2(F.concat(dataset, F.lit("/"), lod, F.lit("/"), encoding, F.lit("/"), F.array_join(F.array_sort(F.array_distinct(ids)), ",")).cast("binary"), 256)


def short_digest(*values: Column) -> Column:
    """96 bits over values, each ended by a zero byte; a null is the byte FF."""
    parts = [F.concat(F.coalesce(v.cast("binary"), F.unhex(F.lit("FF"))), F.unhex(F.lit("00"))) for v in values]
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 24)


def reconcile(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """file, problem: missing, extra, duplicate_claim, length, digest.

    manifest: file, byte_length, sha256; files: file, content.
    """
    claims = manifest.groupBy("file").agg(F.count(F.lit(1)).alias("claims"), F.min("byte_length").alias("byte_length"), F.min("sha256").alias("sha256"))
    have = files.select("file", F.octet_length("content").alias("length"), F.sha2(F.col("content").cast("binary"), 256).alias("digest"))
    both = claims.join(have, "file", "full_outer")
    problem = (
        F.when(F.col("digest").isNull(), "missing")
        .when(F.col("claims").isNull(), "extra")
        .when(F.col("claims") > 1, "duplicate_claim")
        .when(F.col("byte_length") != F.col("length"), "length")
        .when(F.col("sha256") != F.col("digest"), "digest")
    )
    return both.select("file", problem.alias("problem")).where("problem is not null")


def verify_copy(source: DataFrame, staged: DataFrame) -> DataFrame:
    """file, problem between two sets of files (file, content): missing, unexpected, content."""
    s = source.select("file", F.sha2(F.col("content").cast("binary"), 256).alias("a"))
    t = staged.select("file", F.sha2(F.col("content").cast("binary"), 256).alias("b"))
    problem = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unexpected").when(F.col("a") != F.col("b"), "content")
    return s.join(t, "file", "full_outer").select("file", problem.alias("problem")).where("problem is not null")


def prunable(revisions: DataFrame, leases: DataFrame, now: float, keep: int = KEEP, stale: float = LEASE_SECONDS) -> DataFrame:
    """Revisions (dataset, revision_id, published_at, is_current) that retention removes.

    The newest `keep` of a dataset and the current one stay, as do those with a
    lease (revision_id, taken_at in seconds) younger than `stale`. Equal times
    are ordered by revision_id.
    """
    newest = F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc("published_at"), "revision_id"))
    old = revisions.withColumn("n", newest).where((F.col("n") > keep) & ~F.col("is_current"))
    live = leases.where(F.lit(float(now)) - F.col("taken_at") < stale).select("revision_id").distinct()
    return old.join(live, "revision_id", "left_anti").select("dataset", "revision_id", "published_at")


def evict(entries: DataFrame, budget: int, accesses: DataFrame | None = None) -> DataFrame:
    """Cache entries (cache, name, bytes, mtime) to delete: the least recently used first, until a cache's total is within budget.

    accesses (cache, name, at): each counts as a touch at its time, so an entry's
    recency is the latest of its mtime and its accesses. One large cache is
    spread over all tasks by ranges of recency.
    """
    from .ordering import running_sum

    e = entries.select("cache", "name", "bytes", F.col("mtime").alias("used"))
    if accesses is not None:
        last = accesses.groupBy("cache", "name").agg(F.max("at").alias("last"))
        e = e.join(last, ["cache", "name"], "left").select("cache", "name", "bytes", F.greatest("used", "last").alias("used"))
    gone = running_sum(e, ("cache",), ("used", "name"), "bytes")
    return gone.where(F.col("total") - F.col("before") > budget).select("cache", "name", "bytes")


#: Characters that stay in a file name (fixed values).
_UNSAFE = "[^A-Za-z0-9._-]"


def file_stem(text: Column) -> Column:
    """A name that every file system takes."""
    clean = F.regexp_replace(F.regexp_replace(text, _UNSAFE, "_"), "[. ]+$", "")
    clean = F.when(clean == "", "_").otherwise(clean)
    return F.when(F.lower(F.substring_index(clean, ".", 1)).isin(*RESERVED), F.concat(F.lit("_"), clean)).otherwise(clean)


def unique_names(ids: DataFrame, *by: str) -> DataFrame:
    """`by`, id, name (and other columns): in order of id each takes its stem, or stem-2, -3 ... if that is taken, whatever its case.

    Names can only meet if they are alike but for the numbers at their ends. In
    such a family without equal stems each keeps its own; one whose stems are
    all equal is numbered by running counts, however large it is; only families
    that mix equal stems with numbered ones are settled name by name.
    """
    from .ordering import running_sum

    columns = [*ids.columns, "name"]
    stemmed = ids.withColumn("name", file_stem(F.col("id"))).withColumn("__stem", F.lower("name"))
    stemmed = stemmed.withColumn("__family", F.regexp_replace("__stem", "(-[0-9]+)+$", ""))
    stems = stemmed.groupBy(*by, "__family", "__stem").agg(F.count(F.lit(1)).alias("n"))
    family = stems.groupBy(*by, "__family").agg(F.sum("n").alias("__rows"), F.count(F.lit(1)).alias("__stems"), F.first("__stem").alias("__one"))
    family = family.withColumn("__kind", F.when(F.col("__rows") == F.col("__stems"), "plain").when((F.col("__stems") == 1) & (F.col("__one") == F.col("__family")), "equal").otherwise("mixed"))
    known = stemmed.join(family.select(*by, "__family", "__kind"), [*by, "__family"])
    plain = known.where("__kind = 'plain'").select(*columns)
    equal = running_sum(known.where("__kind = 'equal'").withColumn("__1", F.lit(1)), (*by, "__stem"), ("id",), "__1", "__before", "__total")
    equal = equal.withColumn("name", F.when(F.col("__before") > 0, F.concat_ws("-", "name", (F.col("__before") + 1).cast("string"))).otherwise(F.col("name"))).select(*columns)
    mixed = known.where("__kind = 'mixed'").select(*columns, "__family")

    def settle(group):
        group = group.sort_values("id", kind="stable")
        taken, following, names = set(), {}, []
        for stem in group["name"]:
            low, name = stem.lower(), stem
            n = following.get(low, 2)
            while name.lower() in taken:
                name, n = f"{stem}-{n}", n + 1
            following[low] = n  # all numbers below it are taken for good
            taken.add(name.lower())
            names.append(name)
        return group.assign(name=names).drop(columns="__family")

    return plain.unionByName(equal).unionByName(mixed.groupBy(*by, "__family").applyInPandas(settle, mixed.drop("__family").schema))


def resolve(requests: DataFrame, datasets: DataFrame, pointers: DataFrame, revisions: DataFrame, tombstones: DataFrame) -> DataFrame:
    """request_id, status, code, revision_id, published_at, is_current.

    requests: request_id, dataset, revision (null: the current one). datasets:
    dataset; pointers: dataset, revision_id, published_at; revisions: dataset,
    revision_id, published_at, intact; tombstones: dataset, revision_id.
    """
    p = pointers.select("dataset", F.col("revision_id").alias("current"), F.col("published_at").alias("current_at"))
    r = requests.join(datasets.select("dataset", F.lit(True).alias("known")).distinct(), "dataset", "left").join(p, "dataset", "left")
    r = r.withColumn("want", F.coalesce("revision", "current"))
    r = r.join(revisions.select("dataset", F.col("revision_id").alias("want"), "published_at", "intact"), ["dataset", "want"], "left")
    r = r.join(tombstones.select("dataset", F.col("revision_id").alias("want"), F.lit(True).alias("pruned")).distinct(), ["dataset", "want"], "left")
    code = (
        F.when(F.col("known").isNull(), "dataset_not_found")
        .when(F.col("want").isNull(), "no_current_revision")
        .when(F.col("intact").isNull() & F.col("pruned").isNotNull(), "revision_gone")
        .when(F.col("intact").isNull(), "revision_not_found")
        .when(~F.col("intact"), "revision_corrupted")
        .otherwise("ok")
    )
    r = r.withColumn("code", code)
    status = F.when(F.col("code") == "ok", 200).when(F.col("code") == "revision_gone", 410).when(F.col("code") == "revision_corrupted", 500).otherwise(404)
    ok = F.col("code") == "ok"
    return r.select(
        "request_id",
        status.alias("status"),
        "code",
        F.when(ok, F.col("want")).alias("revision_id"),
        F.when(ok, F.when(F.col("revision").isNull(), F.col("current_at")).otherwise(F.col("published_at"))).alias("published_at"),
        F.when(ok, F.coalesce(F.col("want") == F.col("current"), F.lit(False))).alias("is_current"),
    )


def lookup(requested: DataFrame, entries: DataFrame) -> DataFrame:
    """Distinct requested ids with `found` and the entry's columns (null if it is missing)."""
    return requested.select("id").distinct().join(entries.withColumn("found", F.lit(True)), "id", "left").withColumn("found", F.coalesce("found", F.lit(False)))
