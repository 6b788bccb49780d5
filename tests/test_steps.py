import pytest
from pyspark.sql import functions as F

from sievework.operators.steps import Recorder, lineage
from sievework.sources import ledger


def rows(spark, rec):
    return {(r["step"], r["source"]): r for r in lineage(ledger.read(spark, rec.ledger)).where(F.col("run_id") == rec.run_id).collect()}


def test_counts_come_from_the_one_scan(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    spark.range(1000).withColumn("rows", F.col("id") % 7).write.parquet(str(tmp_path / "in"))
    rec = Recorder(spark, f"file://{tmp_path}/run", "r1")
    big = rec.source(spark.read.parquet(str(tmp_path / "in")).mapInPandas(count, "id long, rows long"), "big")
    small = rec.source(spark.range(10).withColumnRenamed("id", "rows"), "small")
    joined = rec.step(big.join(small, "rows").where("rows < 3"), "joined", ["big", "small"])
    assert seen.value == 1000 and joined.count() == 429
    last = rec.step(joined.groupBy("rows").agg(F.count(F.lit(1)).alias("step")), "counts", ["joined"], ("rows",))
    assert last.count() == 3
    got = rows(spark, rec)
    assert {k: (r["ordinal"], r["rows_in"], r["rows_out"], r["left_out"]) for k, r in got.items()} == {
        ("joined", "big"): (0, 1000, 429, 571), ("joined", "small"): (0, 10, 429, -419), ("counts", "joined"): (1, 429, 3, 426)
    }
    end = got["counts", "joined"]
    assert end["files"] == 3 and end["bytes"] > 0 and end["bytes_in"] == got["joined", "big"]["bytes"] and got["joined", "big"]["bytes_in"] is None
    assert end["run_wall_s"] == pytest.approx(end["wall_s"] + got["joined", "big"]["wall_s"])


def test_a_step_again_replaces_itself_and_one_that_fails_records_nothing(spark, tmp_path):
    rec = Recorder(spark, f"file://{tmp_path}/run", "r1")
    for n in (5, 8):
        rec.step(rec.source(spark.range(n), "ids"), "kept", ["ids"])
    other = Recorder(spark, f"file://{tmp_path}/run", "r2")
    with pytest.raises(Exception, match="lost"):
        other.step(other.source(spark.range(3), "ids").withColumn("x", F.raise_error(F.lit("lost"))), "bad", ["ids"])
    empty = other.step(other.source(spark.range(4), "ids").where("id > 9"), "empty", ["ids"])
    assert empty.count() == 0
    assert {k: (r["ordinal"], r["rows_in"], r["rows_out"]) for k, r in rows(spark, rec).items()} == {("kept", "ids"): (0, 8, 8)}
    assert {k: (r["ordinal"], r["rows_in"], r["rows_out"]) for k, r in rows(spark, other).items()} == {("empty", "ids"): (0, 4, 0)}
    for args in (("x", ["nowhere"]), ("x", []), ("x", ["kept", "kept"]), ("a/b", ["kept"])):
        with pytest.raises(ValueError):
            rec.step(spark.range(1), *args)
    with pytest.raises(ValueError):
        rec.source(spark.range(1), "kept")
    with pytest.raises(ValueError):
        Recorder(spark, "x", "a/b")


def test_a_source_that_the_plan_drops_has_no_count(spark, tmp_path):
    rec = Recorder(spark, f"file://{tmp_path}/run", "r1")
    ids = rec.source(spark.range(100), "ids")
    none = rec.step(ids.join(spark.range(100).where("false"), "id"), "none", ["ids"])
    assert none.count() == 0
    r = rows(spark, rec)["none", "ids"]
    assert r["rows_out"] == 0 and r["rows_in"] is None
