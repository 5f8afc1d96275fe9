import pytest
from pyspark.sql import functions as F

from vouchlake.functions import columns as C
from vouchlake.operators import graph
from vouchlake.streaming import flows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("levels", "want"),
    [(["EAL6+", "none", "EAL4 augmented", "EAL4+"], "EAL4"), (["package EAL2+, ALC_FLR.1", "EAL3"], "EAL2+"), (["basic", ""], None), (["EAL12", "EAL7+"], "EAL7+"), ([], None)],
)
def test_lowest_level(spark, levels, want):
    assert one(spark, C.lowest_level(F.array(*map(F.lit, levels)).cast("array<string>"))) == want


def test_versions_and_names(spark):
    assert one(spark, C.versions(F.lit("Single Sign-On, Version 8.2"))) == ["8.2"]
    assert one(spark, C.versions(F.lit("Product 7"))) == ["7"]
    assert one(spark, C.versions(F.lit("Product"))) == ["-"]
    assert one(spark, C.versions(F.lit("Build123.4 and v1.2, again 1.2"))) == ["123.4", "1.2"]
    assert one(spark, C.cpe_part(F.lit("cpe:2.3:a:end\\\\:item:1"), 4)) == "item"
    uri = F.lit("cpe:2.3:a:ven\\:dor:item:*:x")
    assert (one(spark, C.cpe_part(uri, 3)), one(spark, C.cpe_version(uri))) == ("ven:dor", "-")
    assert one(spark, C.sanitize_link(F.lit("http://a.b:443/x y"))) == "https://a.b/x%20y"


def test_closure_of_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src int, dst int")
    assert {tuple(r) for r in graph.closure(edges).collect()} == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3, 4)}


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    stream = flows.window_counts(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(60)
    batch = flows.window_counts(events)
    assert spark.table("counts").select("start", "event_type", "n").exceptAll(batch.select("start", "event_type", "n")).count() == 0
    assert spark.table("counts").count() == batch.count()
