import pytest
from pyspark.sql import functions as F

from sievework.operators.guards import Attested, LineageError, Scored, admit, unequal

SCHEMA = "month string, user_id long, note string, rows long"
ROWS = [("2020-01", 1, "a", 1), ("2020-01", 1, "a", 1), ("2020-02", 2, None, 2), (None, 3, "", 3)]


def test_guard_branches(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    versions = {1: df, 2: df.repartition(3).select(*reversed(df.columns)), 3: df.where("user_id < 3")}
    arms, mixed = [Scored("pop", "r1", 2), Scored("con", "r2", 2)], [Scored("pop", "r1", 1), Scored("con", "r2", 2)]
    e = Attested("pop", "r1", 1, 2, "rebuilt from the same rows")

    def take(*a, **k):
        return admit(*a, versions.__getitem__, ["month"], **k)

    assert admit(arms, 2, None, ["month"]) == {"exception_used": False}
    with pytest.raises(LineageError, match=r"pop \(r1\) on 1"):
        admit(mixed, 2, None, ["month"])
    assert take(mixed, 2, attested=e)["exception_used"]
    with pytest.raises(LineageError, match="isn't needed"):
        take(arms, 2, attested=e)
    with pytest.raises(LineageError, match="differ in 1 groups"):
        take([Scored("pop", "r1", 1), Scored("con", "r2", 3)], 3, attested=Attested("pop", "r1", 1, 3, ""))
    with pytest.raises(LineageError, match="doesn't cover con"):
        take([Scored("pop", "r1", 1), Scored("con", "r2", 1)], 2, attested=e)
    for wrong in (Attested("pop", "r9", 1, 2, ""), Attested("pop", "r1", 3, 2, ""), Attested("pop", "r1", 1, 3, "")):
        with pytest.raises(LineageError):
            take(mixed, 2, attested=wrong)
    with pytest.raises(LineageError, match="twice"):
        take([*arms, arms[0]], 2)


def test_unequal_groups(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert unequal(df, df.orderBy(F.desc("user_id")), ["month"]).count() == 0
    once = df.dropDuplicates().withColumn("note", F.coalesce("note", F.lit("")))
    got = {r["month"]: (r["rows_a"], r["rows_b"]) for r in unequal(df, once, ["month"]).collect()}
    assert got == {"2020-01": (2, 1), "2020-02": (1, 1)}  # null isn't the empty text
    assert {r["month"]: r["rows_b"] for r in unequal(df, df.limit(0), ["month"]).collect()} == {"2020-01": 0, "2020-02": 0, None: 0}
    assert unequal(df, df.drop("note"), ["month"]).count() == 3
    assert unequal(df.limit(0), df.limit(0), ["month"]).count() == 0
