"""Session settings every entry point shares."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that results depend on. Sizing settings are left to the cluster.
REQUIRED = {"spark.sql.session.timeZone": "UTC"}


def get_session(app: str = "confab", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the required settings; an active one is reused and only those are set."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (REQUIRED | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the input tables; column pruning and filters are left to the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
