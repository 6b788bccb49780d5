"""Steps of a run that record themselves: rows in and out as Spark saw them while it did the work."""

from __future__ import annotations

import time

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sievework.sources import ledger

def _observed(o: Observation) -> int | None:
    """None for an observation that the optimizer took out of the plan: Spark then completes it without metrics."""
    try:
        return o.get["rows"]
    except (Py4JJavaError, KeyError):
        return None


def _size(spark: SparkSession, path: str) -> tuple[int, int]:
    """Bytes and data files below a written folder, from the file system's own summary."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    summary, done = fs.getContentSummary(p), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return summary.getLength(), summary.getFileCount() - int(fs.exists(done))


class Recorder:
    """Writes the tables of a run below `root` and one ledger row for each step and each of its sources.

    A ledger row: step, source, rows_in, rows_out, bytes, files, wall_s, with run_id and batch (the step's ordinal).
    Nothing is counted by a second scan. A step that is run again under its run and ordinal replaces its table and its
    rows; one that fails records nothing. `root` must be a folder that the driver and all executors share.
    """

    def __init__(self, spark: SparkSession, root: str, run_id: str):
        if not run_id or "/" in run_id:
            raise ValueError(f"run {run_id!r} can't name a folder")
        self.spark, self.root, self.run_id = spark, root, run_id
        self.ledger = f"{root}/ledger"
        self._steps: dict[str, int | None] = {}  # rows of the steps so far
        self._seen: dict[str, Observation] = {}

    def source(self, df: DataFrame, name: str) -> DataFrame:
        """The same rows, counted as the next step reads them.

        Filters above it aren't pushed into the scan, as they would change the count: put into df what is to be pushed.
        Columns are pruned as ever. A plan may hold it once. Rows may be counted twice if a lost executor makes Spark
        repeat a map task; steps that read earlier steps take those rows from the ledger and have no such doubt.
        """
        if name in self._steps:
            raise ValueError(f"{name} is a step of this run")
        self._seen[name] = Observation()
        return df.observe(self._seen[name], F.count(F.lit(1)).alias("rows"))

    def step(self, df: DataFrame, name: str, sources: list[str], partition_by: tuple[str, ...] = ()) -> DataFrame:
        """Writes df as the table `name` and returns it as read; sources are names of steps or of `source`.

        rows_in is null where Spark never read a source to its end, as the plan turned out not to need it.
        """
        unknown = [s for s in sources if s not in self._steps and s not in self._seen]
        if unknown or not sources or len(set(sources)) != len(sources) or name in self._seen or not name.isidentifier():
            raise ValueError(f"step {name!r}: sources {sources}, unknown {unknown}")
        batch = list(self._steps).index(name) if name in self._steps else len(self._steps)
        path, out = f"{self.root}/{self.run_id}/{name}", Observation()
        began = time.monotonic()
        df.observe(out, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").partitionBy(*partition_by).parquet(path)
        wall = round(time.monotonic() - began, 3)
        rows_out = _observed(out) or 0  # a plan that folds to nothing isn't observed
        bytes_, files = _size(self.spark, path)
        rows_in = {s: self._steps[s] if s in self._steps else _observed(self._seen[s]) for s in sources}
        rows = [(name, s, n, rows_out, bytes_, files, wall) for s, n in rows_in.items()]
        ledger.append(self.spark.createDataFrame(rows, "step string, source string, rows_in long, rows_out long, bytes long, files long, wall_s double"), self.ledger, self.run_id, batch)
        self._steps[name] = rows_out
        for s in sources:
            self._seen.pop(s, None)  # an observation holds for one action
        return self.spark.read.schema(df.schema).parquet(path)


def lineage(records: DataFrame) -> DataFrame:
    """One row for each run, step and source of a recorder's ledger, with what lies before it.

    run_id, ordinal, step, source, rows_in, rows_out, left_out (rows_in - rows_out), bytes_in (of a source that is a
    step of the run, else null), bytes, files_in, files, wall_s and run_wall_s, the seconds of the run's steps up to it.
    """
    made = records.groupBy("run_id", "step").agg(F.max("bytes").alias("bytes_in"), F.max("files").alias("files_in"), F.max("wall_s").alias("wall_s"), F.max("batch").alias("at"))
    before = made.alias("m")
    r = records.withColumnRenamed("batch", "ordinal").alias("r")
    came = r.join(before, (F.col("r.run_id") == F.col("m.run_id")) & (F.col("r.source") == F.col("m.step")), "left")
    rows = came.select("r.*", "m.bytes_in", "m.files_in")
    upto = rows.select("run_id", "step", "ordinal").distinct().alias("s").join(made.alias("u"), (F.col("s.run_id") == F.col("u.run_id")) & (F.col("u.at") <= F.col("s.ordinal")))
    spent = upto.groupBy("s.run_id", "s.step").agg(F.round(F.sum("u.wall_s"), 3).alias("run_wall_s"))
    return rows.join(spent, ["run_id", "step"]).select(
        "run_id", "ordinal", "step", "source", "rows_in", "rows_out", (F.col("rows_in") - F.col("rows_out")).alias("left_out"),
        "bytes_in", "bytes", "files_in", "files", "wall_s", "run_wall_s",
    )
