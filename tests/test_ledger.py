import pytest
from pyspark.sql import functions as F

from sievework.sources import ledger


def test_append_twice_adds_once(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    rows = spark.createDataFrame([("gate", 3), ("audit", 4)], "check_id string, n long")
    for run, batch in (("2024-01", 0), ("2024-01", 0), ("2024-01", 1), ("2024-02", 0), ("2024-01", 0)):
        ledger.append(rows.withColumn("n", F.col("n") + batch), path, run, batch)
    got = sorted(tuple(r) for r in ledger.read(spark, path).select("run_id", "batch", "check_id", "n").collect())
    assert got == [(r, b, c, n + b) for r, b in (("2024-01", 0), ("2024-01", 1), ("2024-02", 0)) for c, n in (("audit", 4), ("gate", 3))]
    assert {r["run_id"] for r in ledger.latest_run(ledger.read(spark, path)).collect()} == {"2024-02"}
    assert {r["run_id"] for r in ledger.latest_run(ledger.read(spark, path), F.col("n") == 5).collect()} == {"2024-01"}
    assert ledger.latest_run(ledger.read(spark, path), F.col("n") > 99).count() == 0
    with pytest.raises(ValueError, match="batch"):
        ledger.append(rows.withColumn("batch", F.lit(1)), path, "x", 0)


def test_a_replayed_stream_adds_nothing(spark, tmp_path):
    source, path = str(tmp_path / "in"), f"file://{tmp_path}/ledger"
    spark.range(6).write.parquet(source)
    for attempt in range(2):  # a lost checkpoint replays all micro-batches
        stream = spark.readStream.schema("id long").parquet(source)
        stream.writeStream.foreachBatch(ledger.sink(path, "s")).option("checkpointLocation", str(tmp_path / f"c{attempt}")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["id"] for r in ledger.read(spark, path).collect()) == list(range(6))
