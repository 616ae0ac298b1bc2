"""Session settings that the library's results depend on or that its plans assume."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Without the call site of every Column operation: a group of factors has tens of thousands of them.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # HotSpot never compiles a method of over 8000 bytes: a list of factors in one method is interpreted, several
    # times slower. Over the limit Spark evaluates it by projections, whose code it splits into short methods.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def short_methods(spark: SparkSession) -> None:
    """The method limit for a session that was made elsewhere."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", SETTINGS["spark.sql.codegen.hugeMethodLimit"])


def session(app: str = "tidegrid", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**SETTINGS, **settings}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
