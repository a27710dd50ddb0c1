"""Session settings and the shared storage folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that can be changed on a running session and that results or skew handling rely on.
RUNTIME_CONF = {
    # NTZ columns are cast to TIMESTAMP for epoch arithmetic and watermarks.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where the aggregate above would have reused the join's
    # partitioning; the exchange this adds carries partially aggregated rows only.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A repeated JSON key takes its last value instead of making the message malformed.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

# Read once per Python process: off, building a plan takes a fraction of the calls to the JVM.
STARTUP_CONF = {"spark.python.sql.dataFrameDebugging.enabled": "false"}

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(app_name: str = "flightops", **conf: str) -> SparkSession:
    """Session with the package's settings; master and sizes come from spark-submit or `conf`."""
    builder = SparkSession.builder.appName(app_name)
    own = {**RUNTIME_CONF, **STARTUP_CONF, "spark.sql.streaming.stateStore.providerClass": STATE_STORE}
    for key, value in {**own, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder.

    Only a local session, where driver and executors are one process, may fall back to a
    temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="flightops-")
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


def written(rows: DataFrame, name: str) -> DataFrame:
    """`rows` written to the shared folder and read again: later steps start from files that any executor can read."""
    path = shared_dir(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
