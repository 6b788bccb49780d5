"""The session that the engine expects: UTC, adaptive execution, Arrow."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(name: str = "sievework", **extra: str) -> SparkSession:
    """Environment variables replace defaults only; `extra` (underscores for dots) comes last."""
    conf = dict(DEFAULTS)
    for key in conf:
        conf[key] = os.environ.get(key.upper().replace(".", "_"), conf[key])
    conf |= {k.replace("_", "."): v for k, v in extra.items()}
    return SparkSession.builder.appName(name).config(map=conf).getOrCreate()
