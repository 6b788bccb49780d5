import datetime as dt

from sievework import streaming
from sievework.operators import contracts, maintenance
from sievework.sources.versions import Catalog


def test_stream_gate_windows_and_merge(spark, tmp_path):
    schema = "user_id long, item_id long, ts timestamp, rating double"
    at = dt.datetime(2023, 1, 1)
    base = spark.createDataFrame([(i, i, at + dt.timedelta(hours=i), 1.0) for i in range(10)], schema)
    late = spark.createDataFrame([(9, 9, at + dt.timedelta(hours=9), 5.0), (10, 10, at + dt.timedelta(hours=10), 5.0), (None, 1, at, 5.0)], schema)
    late.coalesce(1).write.parquet(f"{tmp_path}/in")
    catalog = Catalog(spark, f"file://{tmp_path}/tables")
    catalog.publish(maintenance.with_month(base), "inter", "backfill", ("month",))
    contract = contracts.Contract("inter", (), (contracts.Check("keys", "not_null", "quarantine", {"columns": ["user_id", "item_id"]}),))
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    kept, _ = streaming.gated(stream, contract)
    run = kept.writeStream.foreachBatch(streaming.merge_sink(catalog, "inter", ["user_id", "item_id", "ts"])).option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    assert run.awaitTermination(60)
    out = catalog.read("inter")
    assert out.count() == 11 and out.where("rating = 5.0").count() == 2
    counts = streaming.window_counts(stream, "ts", "1 hour", "1 day")
    run = counts.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    assert run.awaitTermination(60)
    assert spark.table("windows").first()["n"] == 3
