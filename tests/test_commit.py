"""Batches that are committed whole, prefix sums over ranges, names of large families."""

import random

import pytest
from conftest import DATA

from regionspark.operators import ordering, publish
from regionspark.plans import fixtures
from regionspark.streaming import commit


def test_a_stream_that_dies_between_two_writes_shows_nothing_of_its_batch(spark, tmp_path):
    r = fixtures.requests(spark, f"{DATA}/sf0.001").select("request_id", "route", "status")
    r.repartition(3).write.parquet(f"{tmp_path}/in")
    root, seen = f"{tmp_path}/out", []
    read = lambda name, schema: commit.committed(spark, root, name, schema)
    assert read("added", r.schema).count() == 0

    def tables(df, dies):
        def fail(rows):
            raise RuntimeError("lost between two writes")
            yield rows

        seen.append(1)
        removed = df.where("status = 404").select("request_id")
        return {"added": df, "removed": removed.mapInPandas(fail, "request_id long") if dies and len(seen) == 2 else removed}

    def start(dies):
        stream = spark.readStream.schema(r.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        writer = commit.sink(stream, root, lambda df: tables(df, dies)).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True)
        return writer.start()

    with pytest.raises(Exception, match="lost between two writes"):
        start(True).awaitTermination()
    one = read("added", r.schema)
    assert one.select("generation").distinct().count() == 1 and 0 < one.count() < r.count()
    assert spark.read.parquet(f"{root}/added").count() > one.count()  # written, but never marked
    start(False).awaitTermination()
    assert sorted(map(tuple, read("added", r.schema).drop("generation").collect())) == sorted(map(tuple, r.collect()))
    assert read("removed", "request_id long").count() == r.where("status = 404").count()
    assert commit.newest(spark, root, "added", r.schema).count() == read("added", r.schema).where(f"generation = '{2:020d}'").count()
    assert not commit.commit(spark, root, 0, {"added": r})  # a replay of a committed batch writes nothing


def test_running_sums_over_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 8 + ["x", None]), k, rng.randrange(100)) for k in range(5000)]
    df = spark.createDataFrame(rows, "g string, k int, v long").repartition(7)
    got = {r.k: (r.before, r.total) for r in ordering.running_sum(df, ("g",), ("k",), "v").collect()}
    sums = {}
    for g, k, v in rows:
        sums.setdefault(g, 0)
        assert got[k][0] == sums[g]
        sums[g] += v
    assert all(got[k][1] == sums[g] for g, k, _ in rows)


def _names(ids):
    taken, out = set(), {}
    for i in sorted(ids):
        name, n = i, 2
        while name.lower() in taken:
            name, n = f"{i}-{n}", n + 1
        taken.add(name.lower())
        out[i] = name
    return out


def test_mixed_families_and_a_large_one(spark):
    ids = [f"adm-{k}" for k in range(1, 300)] + ["adm", "ADM", "Adm", "ADM-2", "Adm-2", "b-1", "B-1", "b", "B", "b-1-2", "x-7", "x-8"]
    got = {r.id: r.name for r in publish.unique_names(spark.createDataFrame([(i,) for i in ids], "id string")).collect()}
    assert got == _names(ids)
    import time

    many = spark.range(20_000).selectExpr("concat('a', translate(cast(id AS string), '0123456789', '?*:;,+=!@#')) AS id")
    t = time.time()
    names = publish.unique_names(many)
    assert names.select("name").distinct().count() == 20_000 and time.time() - t < 60
