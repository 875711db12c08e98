"""The session that tests, bench and scripts use; a cluster brings its own."""

import os

from pyspark.sql import SparkSession


def local_session(cpus: int = 8, name: str = "veilspark", **more: str) -> SparkSession:
    """A local session with UTC times and adaptive execution. more: further settings."""
    os.environ.setdefault("PYSPARK_PYTHON", os.sys.executable)
    conf = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in more.items()}
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
