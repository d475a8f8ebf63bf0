from pyspark.sql import functions as F

from strandline import streaming
from strandline.plans import apps
from strandline.sources import store


def test_app_over_a_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "long text"), (2, "x")], "id int, text string").write.parquet(src)
    stream = spark.readStream.schema("id int, text string").parquet(src)
    q = streaming.apply_app(stream, apps.gate("long", F.length("text") > 3, "short"), out, str(tmp_path / "c"))
    q.awaitTermination(60)
    assert {r.status: r.number for r in store.describe(store.read_results(spark, out)).collect()} == {"completed": 1, "not_completed": 1}


def test_windowed_counts(spark, tmp_path):
    src = str(tmp_path / "events")
    spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS event_type UNION ALL SELECT timestamp'2024-01-01 00:50:00', 'a' UNION ALL SELECT timestamp'2024-01-01 03:00:00', 'b'").write.parquet(src)
    counts = streaming.feature_counts(spark.readStream.schema("ts timestamp, event_type string").parquet(src))
    q = counts.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.biotype, r.n) for r in spark.table("counts").collect()} == {("a", 2), ("b", 1)}
