import pytest
from pyspark.sql import functions as F

from tracewell import api
from tracewell.operators.chain import Hop
from tracewell.streaming.lookup import resolve_stream


def test_delta_options(spark):
    old = spark.createDataFrame([("a/K", "m", "()V", 1), ("a/K", "hidden", "()V", 2), ("b/K", "x", "()V", 1), ("b/K", "y", "()V", 4)], "owner string, name string, desc string, access int")
    new = old.where("name = 'zzz'").unionByName(spark.createDataFrame([("a/K", "n", "()V", 1), ("b/K", "z", "()V", 0x1001)], "owner string, name string, desc string, access int"))
    assert {(r["list"], r["name"]) for r in api.delta(old, new).collect()} == {("removed", "m"), ("added", "n")}
    every = api.DeltaOptions.of(public_only=False)
    assert {(r["list"], r["n"]) for r in api.delta_summary(old, new, every).collect()} == {("removed", 4), ("added", 2), ("descChanged", 0)}
    capped = api.delta(old, new, api.DeltaOptions.of(public_only=False, prefix="b/", cap=1)).collect()
    assert {(r["list"], r["total"], r["truncated"]) for r in capped} == {("removed", 2, True), ("added", 1, False)}
    with pytest.raises(TypeError, match="prefix"):
        api.DeltaOptions.of(prefx="a")


def test_resolve_batch_and_stream_agree(spark, tmp_path):
    table = spark.createDataFrame([("x", "1")], "k string, v string")
    hops = [Hop("t", table, "k", "v", "no t")]
    queries = spark.createDataFrame([("x",), ("y",)], "name string")
    queries.write.parquet(str(tmp_path / "in"))
    stream = resolve_stream(spark.readStream.schema(queries.schema).parquet(str(tmp_path / "in")), "name", hops)
    run = stream.writeStream.format("memory").queryName("resolved").trigger(availableNow=True).start()
    run.awaitTermination()
    want = sorted(map(tuple, api.resolve(queries, "name", hops).collect()))
    assert sorted(map(tuple, spark.table("resolved").collect())) == want
    assert {r["chain"] for r in api.resolve(queries, "name", hops, include_chains=False).collect()} == {""}


def test_options_batches_and_listings(spark):
    with pytest.raises(TypeError, match="did you mean 'prefix'"):
        api.DeltaOptions.of(prefx="a")
    rows = spark.createDataFrame([("x", 2, "0.0.0"), ("x", 1, "1.2"), ("y", 1, "0.0.0")], "version string, at int, build string")
    assert api.at_most(rows, 3).count() == 3
    for bad in (rows, rows.limit(0)):
        with pytest.raises(ValueError):
            api.at_most(bad, 2)
    assert {(r["version"], r["build"], r["reason"] is None) for r in api.build(rows).collect()} == {("x", "1.2", True), ("y", "0.0.0", False)}
    files = spark.createDataFrame([("file:/c/maps/1.1/b", 1), ("file:/c/maps/1.1/a", 2), ("file:/c/jars/9/z", 3)], "path string, length long")
    assert [(r["kind"], r["name"]) for r in api.cache_listing(files).collect()] == [("jars", "z"), ("maps", "a"), ("maps", "b")]
    surface = spark.createDataFrame([("A", "method", "m", "()V"), ("A", "field", "f", "I"), ("A", "method", "a", "()V")], "owner string, kind string, name string, desc string")
    assert [tuple(m) for m in api.members_of(surface).first()["members"]] == [("field", "f", "I"), ("method", "a", "()V"), ("method", "m", "()V")]


def test_surface_of_decoded_classes(spark):
    from tracewell.sources import archives

    kind = "path string, name string, owner string, access int, major int, super string, interfaces array<string>, members array<struct<kind:string,name:string,desc:string,access:int>>, error string"
    rows = [("p", "A.class", "A", 1, 65, "O", ["I"], [("method", "m", "()V", 1), ("field", "f", "I", 2)], None), ("p", "B.class", "B", 0, 65, "O", [], [("method", "m", "()V", 1)], None), ("p", "C.class", None, None, None, None, None, None, "bad magic")]
    found, errors = archives.surface(spark.createDataFrame(rows, kind))
    assert [(r["owner"], r["name"]) for r in found.collect()] == [("A", "m")] and [r["name"] for r in errors.collect()] == ["C.class"]


def test_era_hints_and_skipped_folders(spark):
    from tracewell import api
    from tracewell.operators import flatten

    rows = [("1", "2", "pre", "pre"), ("3", "4", "post", "post"), ("1", "4", "unknown", "post"), ("4", "1", "post", "pre")]
    df = spark.createDataFrame(rows, "a string, b string, ea string, eb string")
    hints = [r[0] for r in df.select(api.era_hint(F.col("a"), F.col("b"), F.col("ea"), F.col("eb"), F.lit("no"))).collect()]
    assert hints == ["no; from 2 to 1 may be what was meant", "3 and 4 have the same names; compare them with delta instead", "no", "no; from 1 to 4 may be what was meant"]
    paths = {"a/build/X.java": True, "build": False, "a\\out\\b\\X.java": True, "builds/X.java": False, "a/X/target": False, "": False}
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", flatten.skipped(F.col("p")).alias("s")).collect()
    assert {r["p"]: r["s"] for r in got} == paths
